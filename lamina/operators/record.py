"""Records: one interface over plain directories and resolved stacks."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.frames import R, cast_declared, matches, ordered, q, renamed, union_by_name, with_missing
from lamina.operators.resolve import Resolver
from lamina.schema import Schema
from lamina.sources.layers import Frames, Layer


@dataclass(frozen=True)
class Flags:
    """How an attribute uses the axes.  The sets are not complements: a dim may be in both."""

    varies: frozenset[str]
    broadcast: frozenset[str]
    breakpoints: bool


@runtime_checkable
class Record(Protocol):
    schema: Schema
    dims: Mapping[str, DataFrame]
    components: Mapping[str, DataFrame]
    connections: Mapping[str, DataFrame]
    attributes: Mapping[str, DataFrame]
    outputs: Mapping[str, DataFrame]

    def flags(self, ctype: str) -> dict[str, Flags]: ...


def as_flags(rows: DataFrame) -> dict[str, Flags]:
    """One entry an attribute: as many rows reach the driver as attributes times dims."""
    got: dict[str, list] = {}
    for r in rows.collect():
        got.setdefault(r.attribute, []).append(r)
    return {a: Flags(frozenset(r.dim for r in own if r.varies), frozenset(r.dim for r in own if r.broadcast), any(r.breakpoints for r in own)) for a, own in sorted(got.items())}


class LayeredRecord:
    """The record that a stack of layers resolves to."""

    def __init__(self, resolver: Resolver, store=None):
        self.resolver, self.store, self.schema = resolver, store, resolver.schema

    @property
    def dims(self) -> Mapping[str, DataFrame]:
        r = self.resolver
        return Frames(lambda: tuple(r.axes), r.axis)

    def _entities(self, kind: str) -> Mapping[str, DataFrame]:
        return Frames(lambda: self.resolver.types(kind), lambda t: ordered(self.resolver.entities(kind, t), "order_key"))

    @property
    def components(self) -> Mapping[str, DataFrame]:
        return self._entities("components")

    @property
    def connections(self) -> Mapping[str, DataFrame]:
        return self._entities("connections")

    @property
    def attributes(self) -> Mapping[str, DataFrame]:
        return Frames(self.resolver.attribute_names, self.resolver.attribute)

    @property
    def outputs(self) -> Mapping[str, DataFrame]:
        last = self.resolver.layers[-1].outputs
        return Frames(lambda: tuple(sorted(last)), self.resolver.outputs)

    def flags(self, ctype: str) -> dict[str, Flags]:
        return as_flags(self.resolver.flags(ctype))


class DirectoryRecord:
    """One plain directory, presented as its files are: tombstoned rows included."""

    def __init__(self, spark: SparkSession, uri: str, schema: Schema | None = None):
        from lamina.sources.store import Files, read_layer

        files = Files(spark)
        if schema is None:
            text = files.read(f"{uri}/manifest.json")
            schema = Schema() if text is None else Schema.from_json(text)
        self.spark, self.uri, self.schema = spark, uri, schema
        self.layer: Layer = read_layer(spark, files, uri, schema, "directory")
        self._flags: dict[str, dict[str, Flags]] | None = None

    @property
    def dims(self) -> Mapping[str, DataFrame]:
        return Frames(lambda: tuple(self.layer.dims), lambda d: self.layer.dims[d].orderBy("_row").drop("_row"))

    def _by(self, column: str, held: Mapping[str, DataFrame], types: Mapping[str, str]) -> Mapping[str, DataFrame]:
        """Frames by the distinct values that the rows carry, whatever their files are called."""

        def frame(k: str) -> DataFrame:
            return cast_declared(with_missing(held[k], {column: "VARCHAR"}), {c: t for c, t in types.items() if c in held[k].columns})

        def keys() -> tuple[str, ...]:
            found = union_by_name([frame(k).select(column) for k in held]).distinct().collect() if len(held) else []
            return tuple(sorted(r[0] for r in found if r[0] is not None))

        def build(k: str) -> DataFrame:
            own = [frame(x).filter(q(column) == k) for x in ([k] if k in held else held)]
            got = union_by_name(own)
            return got.orderBy("_row").drop("_row") if "_row" in got.columns else got

        return Frames(keys, build)

    @property
    def components(self) -> Mapping[str, DataFrame]:
        return self._by("component_type", self.layer.components, self.schema.types_of(["name", *self.schema.member_dims]))

    @property
    def connections(self) -> Mapping[str, DataFrame]:
        return self._by("component_type", self.layer.connections, self.schema.types_of(["name", "bus", *self.schema.link_dims]))

    @property
    def attributes(self) -> Mapping[str, DataFrame]:
        return self._by("attribute", self.layer.inputs, self.schema.types_of(["name", "bus", *self.schema.dimensions, "breakpoint"]))

    @property
    def outputs(self) -> Mapping[str, DataFrame]:
        return self._by("attribute", self.layer.outputs, self.schema.types_of(["name", "bus", *self.schema.dimensions, "breakpoint"]))

    def flags(self, ctype: str) -> dict[str, Flags]:
        if self._flags is None:
            self._flags = self._every_flag()
        return self._flags.get(ctype, {})

    def _every_flag(self) -> dict[str, dict[str, Flags]]:
        """Flags of every type in one pass: of each name first, so that names and not rows are joined;
        as many rows reach the driver as types times attributes."""
        dims, yes = list(self.schema.dimensions), []
        for n, d in enumerate(dims):
            yes += [(f"v{n}", q(d).isNotNull()), (f"b{n}", q(d).isNull())]
        yes.append(("bp", q("breakpoint").isNotNull()))
        own = {a: with_missing(f, self.schema.types_of(["bus", *dims, "breakpoint"])) for a, f in self.attributes.items()}
        if not own:
            return {}
        named = union_by_name([f.groupBy("name").agg(*[F.bool_or(c).alias(k) for k, c in yes]).select(F.lit(a).alias("attribute"), "*") for a, f in own.items()])
        found = [f.select("name").distinct().withColumn("component_type", F.lit(t)) for t, f in self.components.items()]
        if not found:
            return {}
        rows = named.join(renamed(union_by_name(found)), matches(["name"])).groupBy(q(R + "component_type").alias("component_type"), "attribute")
        out: dict[str, dict[str, Flags]] = {}
        for r in sorted(rows.agg(*[F.bool_or(k).alias(k) for k, _ in yes]).collect()):
            on = lambda p: frozenset(d for n, d in enumerate(dims) if r[f"{p}{n}"])  # noqa: B023, E731
            out.setdefault(r.component_type, {})[r.attribute] = Flags(on("v"), on("b"), r.bp)
        return out


def default_fill(rows: DataFrame, members: DataFrame, axes: Mapping[str, DataFrame], schema: Schema, attribute: str) -> DataFrame:
    """A value for every member and label of the attribute's axes: its row's, a broadcast row's, or
    the schema's default.  Readers leave this to their consumer, as it has a row a coordinate."""
    spec = schema.spec(attribute)
    dims = [d for d in schema.dimensions if spec is not None and d in spec.dims and d in axes]
    grid = members.select("name").distinct()
    for d in dims:
        grid = grid.crossJoin(axes[d].select(q(d)).distinct())
    r = rows.select(q("name").alias("__name"), *[q(d).alias("__" + d) for d in dims], q("value").alias("__value"))
    on = q("name") == q("__name")
    for d in dims:
        on &= q("__" + d).isNull() | (q("__" + d) == q(d))
    exact = sum((F.when(q("__" + d).isNotNull(), 1).otherwise(0) for d in dims), F.lit(0))
    got = grid.join(r, on, "left").groupBy("name", *map(q, dims)).agg(F.max_by("__value", exact).alias("value"))
    default = spec.default if spec is not None else None
    return got.withColumn("value", F.coalesce("value", F.lit(default).cast(got.schema["value"].dataType)))
