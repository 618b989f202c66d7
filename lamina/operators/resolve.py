"""Owner maps in one pass over all layers, and the reads they gate."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.functions.frames import R, cast_declared, empty, matches, q, renamed, semi, union_by_name, with_missing
from lamina.operators.axes import expand, fold_axis, order_of
from lamina.schema import Schema
from lamina.sources.layers import Layer


#: Bits of flags below the depth of a packed winner: two a dim and one for curves.
MASK_BITS = 40


@dataclass(frozen=True)
class Maps:
    """Owner maps of an ancestor, to start from: its rows keep their layer and depth."""

    depth: int
    inputs: DataFrame
    components: DataFrame
    connections: DataFrame
    axes: Mapping[str, DataFrame]


def _row(df: DataFrame) -> DataFrame:
    if "_row" in df.columns:
        return df
    keys = [c for c in ("name", "bus") if c in df.columns] or df.columns[:1]
    # no order was stored: names order; only frames made in memory come here
    return df.withColumn("_row", F.row_number().over(Window.orderBy(*map(q, keys))) - 1)


def _of(df: DataFrame, names: DataFrame | None) -> DataFrame:
    return df if names is None else semi(df, names, ["name"])


def _packed(schema: Schema) -> Column:
    """The flags of a written map as bits."""
    on = lambda c, n: F.when(c, 1 << n).otherwise(0)
    bits = [on(F.col(f).getField(x), 2 * n + k) for n, x in enumerate(schema.dimensions) for k, f in enumerate(("varies", "broadcast"))]
    return sum(bits, on(F.col("breakpoints"), 2 * len(schema.dimensions))).cast("bigint")


class Resolver:
    """Reads of a stack of layers, root first.

    Each map is one aggregate over the union of all layers, whatever their number: per key the
    deepest layer wins, and a tombstone kills what lies above it in the stack's past.  A layer's own
    rows survive its own tombstones.
    """

    def __init__(self, spark: SparkSession, schema: Schema, layers: Sequence[Layer], base: Maps | None = None, *, keep: bool = False):
        if schema.partial is None and any(s.keys for s in schema.dimensions.values()):
            raise ValueError("a layered record whose dims key entities must say which dims are partial")
        if 2 * len(schema.dimensions) >= MASK_BITS:
            raise ValueError(f"more than {MASK_BITS // 2 - 1} dims")
        self.spark, self.schema, self.layers, self.base = spark, schema, list(layers), base
        # maps by what they are of: folded once and persisted, for layers that never change
        self._kept: dict | None = {} if keep else None

    def _once(self, key, build) -> DataFrame:
        if self._kept is None:
            return build()
        if key not in self._kept:
            self._kept[key] = build().persist()
        return self._kept[key]

    def release(self) -> None:
        """Let go of kept maps; they are folded anew when asked for."""
        for df in (self._kept or {}).values():
            df.unpersist()
        if self._kept:
            self._kept.clear()

    @property
    def _new(self) -> list[tuple[int, Layer]]:
        """Layers that the cached maps do not cover yet."""
        done = self.base.depth if self.base else -1
        return [(d, x) for d, x in enumerate(self.layers) if d > done]

    @cached_property
    def axes(self) -> dict[str, DataFrame]:
        """Folded axes with ``_pos``; a dim without rows anywhere is absent."""
        out = {}
        for dim in self.schema.dimensions:
            frames = [(d, _row(x.dims[dim])) for d, x in self._new if dim in x.dims]
            if self.base and dim in self.base.axes:
                frames.insert(0, (0, self.base.axes[dim]))
            if frames:
                key = [k for k in self.schema.label_key(dim)]
                frames = [(d, cast_declared(with_missing(f, self.schema.types_of(key)), self.schema.types_of(key))) for d, f in frames]
                out[dim] = fold_axis(frames, key)
        return out

    def axis(self, dim: str) -> DataFrame:
        return self.axes[dim].orderBy("_pos").drop("_pos")

    def _deaths(self, kind: str, key: Sequence[str], dims: Sequence[str]) -> DataFrame | None:
        frames = []
        for d, layer in self._new:
            for f in getattr(layer, kind).values():
                if "deleted" in f.columns:
                    rows = with_missing(f.filter("deleted"), self.schema.types_of(key)).select(*[q(k).cast(self._ddl(k)).alias(k) for k in key])
                    frames.append(rows.withColumn("_dead", F.lit(d)))
        if not frames:
            return None
        return expand(union_by_name(frames), dims, self.axes).groupBy(*map(q, key)).agg(F.max("_dead").alias("_dead"))

    @cached_property
    def _last_removal(self) -> int:
        """The deepest layer that may remove members or connections, -1 if none does."""
        return max((d for d, x in self._new for kind in (x.components, x.connections) for f in kind.values() if "deleted" in f.columns), default=-1)

    def _ddl(self, column: str) -> str:
        from lamina.functions.types import ddl

        return ddl(self.schema.column_type(column))

    def _alive(self, df: DataFrame, dead: DataFrame | None, key: Sequence[str]) -> DataFrame:
        if dead is None:
            return df
        gone = dead.groupBy(*map(q, key)).agg(F.max("_dead").alias("_dead"))
        joined = df.join(renamed(gone), matches(key), "left").filter(q(R + "_dead").isNull() | (q("depth") >= q(R + "_dead")))
        return joined.select(*map(q, df.columns))

    @cached_property
    def _dead_components(self) -> DataFrame | None:
        return self._deaths("components", self.schema.member_key, self.schema.member_dims)

    @cached_property
    def _dead_connections(self) -> DataFrame | None:
        return self._deaths("connections", self.schema.link_key, self.schema.link_dims)

    def inputs_map(self, attributes: Iterable[str] | None = None) -> DataFrame:
        """(input key, depth, layer, varies, broadcast, breakpoints); only key columns are read."""
        only = None if attributes is None else frozenset(attributes)
        if only is not None and ("inputs", None) in (self._kept or {}) and ("inputs", only) not in self._kept:
            return self._kept["inputs", None].filter(q("attribute").isin(*only))
        return self._once(("inputs", only), lambda: self._inputs_map(only))

    def _inputs_map(self, only: frozenset[str] | None, among: DataFrame | None = None) -> DataFrame:
        """Hash aggregates over numbers alone: flags are bits, or-ed for each key and layer, first as
        the rows were written and then a label each; then the greatest (depth, flags) of each key
        wins.  ``among``: of these names alone."""
        s, key = self.schema, self.schema.values_key
        frames = []
        for d, layer in self._new:
            for a in layer.inputs:
                if only is not None and a not in only:
                    continue
                f = with_missing(_of(layer.inputs[a], among), s.types_of(["bus", *s.dimensions, "breakpoint"]))
                name = q("attribute") if "attribute" in f.columns else F.lit(a)
                cols = [name.alias("attribute") if k == "attribute" else q(k).cast(self._ddl(k)).alias(k) for k in key]
                bits = [F.when(q(x).isNotNull(), 1 << 2 * n).otherwise(2 << 2 * n) for n, x in enumerate(s.dimensions)]
                flags = sum(bits, F.when(q("breakpoint").isNotNull(), 1 << 2 * len(s.dimensions)).otherwise(0)).cast("bigint")
                frames.append(f.select(*cols, flags.alias("__flags"), F.lit(d).cast("bigint").alias("depth")))
        won = None
        if frames:
            written = union_by_name(frames).groupBy(*map(q, key), "depth").agg(F.bit_or("__flags").alias("__flags"))
            # placed by key, so that neither aggregate moves rows again
            rows = expand(written, s.split_dims, self.axes).repartition(*map(q, key))
            own = rows.groupBy(*map(q, key), "depth").agg(F.bit_or("__flags").alias("__flags"))
            won = own.select(*map(q, key), (F.shiftleft("depth", MASK_BITS) + F.col("__flags")).alias("__won"))
        if self.base:
            old = self.base.inputs if only is None else self.base.inputs.filter(q("attribute").isin(*only))
            old = _of(old, among).select(*map(q, key), (F.shiftleft(F.col("depth").cast("bigint"), MASK_BITS) + _packed(s)).alias("__won"))
            won = old if won is None else won.unionByName(old)
        if won is None:
            won = empty(self.spark, s.types_of([*key])).withColumn("__won", F.lit(0).cast("bigint"))
        best = won.groupBy(*map(q, key)).agg(F.max("__won").alias("__won"))
        depth = F.shiftright("__won", MASK_BITS).cast("int")
        bit = lambda n: F.shiftright("__won", n).bitwiseAND(1) == 1
        ids = F.array(*[F.lit(x.id) for x in self.layers])
        none = F.lit(None).cast("boolean")
        each = [F.struct(*[bit(2 * n + k).alias(x) for n, x in enumerate(s.dimensions)]) if s.dimensions else none for k in (0, 1)]
        best = best.select(*map(q, key), depth.alias("depth"), F.element_at(ids, depth + 1).alias("layer"), each[0].alias("varies"), each[1].alias("broadcast"), bit(2 * len(s.dimensions)).alias("breakpoints"))
        best = self._alive(best, self._dead_components, s.member_key)
        return self._alive(best, self._dead_connections, s.link_key)

    def entity_map(self, kind: str) -> DataFrame:
        """(entity key, depth, layer, component_type, order_key) of members or connections."""
        return self._once(kind, lambda: self._entity_map(kind))

    def _entity_map(self, kind: str) -> DataFrame:
        s = self.schema
        key, dims = (s.member_key, s.member_dims) if kind == "components" else (s.link_key, s.link_dims)
        frames = []
        for d, layer in self._new:
            for t in getattr(layer, kind):
                f = getattr(layer, kind)[t]
                f = _row(with_missing(f, s.types_of(key)))
                live = f.filter(~q("deleted")) if "deleted" in f.columns else f
                ctype = q("component_type") if "component_type" in f.columns else F.lit(t)
                cols = [q(k).cast(self._ddl(k)).alias(k) for k in key]
                frames.append(live.select(*cols, ctype.alias("component_type"), order_of(F.lit(d), q("_row")).alias("order_key"), F.lit(d).alias("depth")))
        packs = ["depth", "component_type", "order_key"]
        won = None
        if frames:
            won = expand(union_by_name(frames), dims, self.axes)
        if self.base:
            old = getattr(self.base, kind).drop("layer")
            won = old if won is None else union_by_name([old, won])
        if won is None:
            return empty(self.spark, s.types_of([*key, "depth", "layer", "component_type", "order_key"]))
        # deepest layer, then its first row
        best = won.groupBy(*map(q, key)).agg(F.max_by(F.struct(*packs), F.struct("depth", F.negative("order_key"))).alias("__w"))
        # a layer's id follows from its depth, so no row carries it through the aggregate
        layer = F.element_at(F.array(*[F.lit(x.id) for x in self.layers]), F.col("__w.depth") + 1)
        best = best.select(*map(q, key), F.col("__w.depth").alias("depth"), layer.alias("layer"), *[F.col("__w").getField(p).alias(p) for p in packs[1:]])
        if kind == "components":
            return self._alive(best, self._dead_components, key)
        # keyed by fewer dims than components: a removal in any of the others removes the connection
        shared = [k for k in s.member_key if k in key]
        best = self._alive(best, self._dead_components, shared)
        return self._alive(best, self._dead_connections, key)

    def maps(self) -> Maps:
        return Maps(len(self.layers) - 1, self.inputs_map(), self.entity_map("components"), self.entity_map("connections"), {d: a.withColumn("_row", F.col("_pos")).drop("_pos") for d, a in self.axes.items()})

    def attribute_names(self) -> tuple[str, ...]:
        rows = self.inputs_map().select("attribute").distinct().collect()  # names of attributes
        return tuple(sorted(r.attribute for r in rows))

    def members_named(self, names: Sequence[str]) -> DataFrame:
        """The part of the map of members that has these names; without a kept map only they are folded."""
        held = (self._kept or {}).get("components")
        return (self._entity_map("components") if held is None else held).filter(q("name").isin(list(names)))

    def types(self, kind: str = "components") -> tuple[str, ...]:
        rows = self.entity_map(kind).select("component_type").distinct().collect()  # names of types
        return tuple(sorted(r.component_type for r in rows))

    def attribute(self, attribute: str, among: DataFrame | None = None) -> DataFrame:
        """The long rows of an attribute that the stack resolves to; ``among``: of these names alone.

        Only files of this attribute are read.  NULL in a partial dim with labels comes back as the
        labels that the row's layer owns; other dims keep their NULL.  Defaults are not filled in.
        """
        s = self.schema
        held = [(d, _of(layer.inputs[attribute], among)) for d, layer in enumerate(self.layers) if attribute in layer.inputs]
        types = s.types_of(["name", "bus", *s.dimensions, "attribute", "breakpoint"]) | {"value": s.value_type(attribute)}
        if not held:
            return empty(self.spark, {c: types[c] for c in s.row_columns})
        rows = union_by_name([cast_declared(with_missing(f, types | {"attribute": "VARCHAR"}), types).select(*map(q, s.row_columns), F.lit(d).alias("depth")) for d, f in held])
        if len(held) == 1 and self.base is None and held[0][0] >= self._last_removal:
            # one layer has the attribute and no later one removes names: it owns each of its keys
            return expand(rows.drop("depth").withColumn("attribute", F.lit(attribute)), s.split_dims, self.axes)
        owned = self.inputs_map([attribute]) if among is None else self._inputs_map(frozenset([attribute]), among)
        owner = renamed(owned.select("name", "bus", *map(q, s.split_dims), "depth"))
        got = rows.join(owner, matches(["name", "bus", "depth"], s.split_dims), "inner")
        pick = [F.coalesce(q(c), q(R + c)).alias(c) if c in s.split_dims else F.lit(attribute).alias(c) if c == "attribute" else q(c) for c in s.row_columns]
        return got.select(*pick)

    def entities(self, kind: str, ctype: str) -> DataFrame:
        """Live members or connections of a type, wide, with ``order_key``."""
        s = self.schema
        key, dims = (s.member_key, s.member_dims) if kind == "components" else (s.link_key, s.link_dims)
        frames = []
        for d, layer in enumerate(self.layers):
            if ctype in getattr(layer, kind):
                f = with_missing(getattr(layer, kind)[ctype], s.types_of(key))
                f = f.filter(~q("deleted")).drop("deleted") if "deleted" in f.columns else f
                f = cast_declared(f.drop("_row", "order_key"), s.types_of(c for c in f.columns if c in key or c in s.attributes.get(ctype, {}) or c == "role"))
                frames.append(f.withColumn("component_type", F.lit(ctype)).withColumn("__depth", F.lit(d)))
        if not frames:
            return empty(self.spark, s.types_of(["component_type", *key, "order_key"]))
        rows = union_by_name(frames)
        owner = self.entity_map(kind).filter(q("component_type") == ctype).select(*map(q, key), q("depth").alias("__depth"), "order_key")
        exact = [k for k in key if k not in dims]
        got = rows.join(renamed(owner), matches([*exact, "__depth"], dims), "inner")
        pick = [F.coalesce(q(c), q(R + c)).alias(c) if c in dims else q(c) for c in rows.columns if c != "__depth"]
        return got.select(*pick, q(R + "order_key").alias("order_key"))

    def outputs(self, attribute: str) -> DataFrame:
        """Results of the last layer alone: they are never inherited."""
        return self.layers[-1].outputs[attribute]

    def flags(self, ctype: str | None = None) -> DataFrame:
        """(attribute, dim, varies, broadcast, breakpoints) over the winning keys of a type's names."""
        owned = self.inputs_map()
        if ctype is not None:
            names = self.entity_map("components").filter(q("component_type") == ctype).select("name")
            owned = semi(owned, names, ["name"])
        return flag_rows(owned, self.schema)


def flag_rows(owned: DataFrame, schema: Schema) -> DataFrame:
    each = [F.struct(F.lit(d).alias("dim"), F.col("varies").getField(d).alias("v"), F.col("broadcast").getField(d).alias("b")) for d in schema.dimensions]
    rows = owned.select("attribute", "breakpoints", F.explode(F.array(*each)).alias("f"))
    out = rows.groupBy("attribute", F.col("f.dim").alias("dim"))
    yes = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return out.agg(yes(F.col("f.v")).alias("varies"), yes(F.col("f.b")).alias("broadcast"), yes(F.col("breakpoints")).alias("breakpoints"))


def flags_by_scan(frames: Mapping[str, DataFrame], schema: Schema) -> DataFrame:
    """The same flags for plain files, from their rows."""
    parts = []
    for a, f in frames.items():
        f = with_missing(f, schema.types_of(["bus", *schema.dimensions, "breakpoint"]))
        varies = F.struct(*[F.bool_or(q(d).isNotNull()).alias(d) for d in schema.dimensions])
        broad = F.struct(*[F.bool_or(q(d).isNull()).alias(d) for d in schema.dimensions])
        parts.append(f.agg(varies.alias("varies"), broad.alias("broadcast"), F.bool_or(q("breakpoint").isNotNull()).alias("breakpoints"), F.count("*").alias("n")).filter("n > 0").select(F.lit(a).alias("attribute"), "varies", "broadcast", "breakpoints"))
    return flag_rows(union_by_name(parts), schema)
