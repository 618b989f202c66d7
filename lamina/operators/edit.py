"""Staged edits: read back at once, committed as a layer or flattened to a directory."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.functions.frames import R, anti, latest_per, matches, q, renamed, semi, strict, union_by_name, with_missing
from lamina.functions.settle import settled
from lamina.functions.types import ddl
from lamina.operators.axes import expand
from lamina.operators.record import DirectoryRecord, Flags, LayeredRecord, as_flags
from lamina.operators.resolve import Resolver
from lamina.operators.write import RecordError, write_record
from lamina.schema import Schema
from lamina.sources.layers import EMPTY, Frames, Layer
from lamina.sources.store import Store, ingest


@dataclass(frozen=True)
class NewChild:
    """Commit the edits alone, as a child of ``parent`` (default: the edited revision)."""

    parent: str | None = None


@dataclass(frozen=True)
class Directory:
    """Commit everything, resolved, as a standalone directory."""

    uri: str


@dataclass(frozen=True)
class Pending:
    """Staged rows, not collapsed keys; falsy when nothing is staged."""

    inputs: Mapping[str, int] = field(default_factory=dict)
    outputs: Mapping[str, int] = field(default_factory=dict)
    components: Mapping[str, int] = field(default_factory=dict)
    connections: Mapping[str, int] = field(default_factory=dict)

    def __bool__(self) -> bool:
        return any((self.inputs, self.outputs, self.components, self.connections))


def is_frame(value: Any) -> bool:
    return isinstance(value, DataFrame) or (hasattr(value, "columns") and not isinstance(value, Mapping)) or hasattr(value, "column_names")


def normalise_value(value: Any, names: Sequence[str], labels: Sequence[Any] | None) -> list[tuple[str | None, Any, Any]]:
    """(name, label, value) of a scalar, sequence, mapping or labelled series; None stands for all.

    A mapping's keys are labels where every key is one, else names; what could be both is refused,
    as is a sequence whose length fits neither or both.
    """
    known = list(labels or [])
    if hasattr(value, "index") and hasattr(value, "items") and not isinstance(value, (Mapping, str, list, tuple)):
        value = dict(value.items())
    if isinstance(value, Mapping):
        keys = list(value)
        as_label = bool(known) and all(k in known for k in keys)
        as_name = all(k in names for k in keys)
        if as_label and as_name:
            raise ValueError("the keys are both names and labels")
        if not as_label and not as_name:
            raise ValueError(f"keys that are neither all names nor all labels: {[k for k in keys if k not in names and k not in known][:5]}")
        return [(None, k, v) if as_label else (k, None, v) for k, v in value.items()]
    if isinstance(value, (list, tuple)) or (hasattr(value, "__len__") and not isinstance(value, (str, bytes))):
        got = list(value)
        fits_names, fits_labels = len(got) == len(names), bool(known) and len(got) == len(known)
        if fits_names and fits_labels and len(got) != 1:
            raise ValueError(f"{len(got)} values fit both the names and the labels")
        if fits_names:
            return [(n, None, v) for n, v in zip(names, got)]
        if fits_labels:
            return [(None, k, v) for k, v in zip(known, got)]
        raise ValueError(f"{len(got)} values for {len(names)} names" + (f" or {len(known)} labels" if known else ""))
    return [(None, None, value)]


class WorkingRecord:
    """A record with edits on top.  Pending edits are one more layer through the same fold, so what
    is read now is what a commit will give."""

    def __init__(self, base: LayeredRecord | DirectoryRecord, store: Store | None = None, revision: str | None = None):
        if isinstance(base, DirectoryRecord):
            self._base = Resolver(base.spark, base.schema, [base.layer])
        else:
            self._base = base.resolver
            store = store or base.store
            revision = revision or self._base.layers[-1].id
        self.spark, self.store, self.revision = self._base.spark, store, revision
        self.schema: Schema = self._base.schema
        self._seq = 0
        self._values: list[tuple[int, str, str, DataFrame]] = []
        self._entities: list[tuple[int, str, str, DataFrame]] = []
        self._now: Resolver | None = None

    def _stage_values(self, kind: str, attribute: str, rows: DataFrame) -> None:
        s = self.schema
        types = s.types_of(["name", "bus", *s.dimensions, "attribute", "breakpoint"]) | {"value": s.value_type(attribute)}
        if s.spec(attribute) is None and "value" in rows.columns:
            types["value"] = rows.schema["value"].dataType.simpleString()
        full = with_missing(rows, types).withColumn("attribute", F.lit(attribute))
        # only a value may fail its cast: a label that became NULL would mean every label
        full = strict(full, {c: t for c, t in types.items() if c != "value"})
        full = full.select(*[q(c) if c != "value" else q(c).try_cast(_ddl(types[c])).alias(c) for c in s.row_columns], q("_nth") if "_nth" in full.columns else _place())
        self._seq += 1
        self._values.append((self._seq, kind, attribute, full))
        self._now = None

    def _stage_entities(self, kind: str, ctype: str, rows: DataFrame, deleted: bool) -> None:
        s = self.schema
        key = s.member_key if kind == "components" else s.link_key
        rows = strict(with_missing(rows.drop("component_type", "deleted"), s.types_of(key)), s.types_of(key))
        if "_nth" not in rows.columns:
            rows = rows.withColumn("_nth", _place())
        self._seq += 1
        self._entities.append((self._seq, kind, ctype, rows.withColumn("component_type", F.lit(ctype)).withColumn("deleted", F.lit(deleted))))
        self._now = None

    def _check_dims(self, dims: Mapping[str, Any], attribute: str | None = None, kind: str = "inputs") -> None:
        unknown = [d for d in dims if d not in self.schema.dimensions]
        if unknown:
            raise RecordError(f"dims that are not declared: {unknown}")
        if attribute is not None and kind == "inputs":
            spec = self.schema.spec(attribute)
            if spec is None:
                raise KeyError(f"no type declares {attribute}")
            beyond = [d for d in dims if spec.dims and d not in spec.dims]
            if beyond:
                raise RecordError(f"{attribute} does not vary along {beyond}")

    def _types_of(self, names: Sequence[str]) -> dict[str, str]:
        """Type of each asked-for name; only those names are collected."""
        rows = self._members.members_named(names).select("name", "component_type").distinct().collect()
        return {r.name: r.component_type for r in rows}

    def _check_names(self, attribute: str, names: Sequence[str]) -> None:
        types = self._types_of(names)
        lost = [n for n in names if n not in types]
        if lost:
            raise KeyError(f"no member is named {lost[:5]}")
        odd = [n for n in names if attribute not in self.schema.attributes.get(types[n], {})]
        if odd:
            raise KeyError(f"the types of {odd[:5]} do not declare {attribute}")

    def names_declaring(self, attribute: str) -> DataFrame:
        """Names of the live members whose type declares the attribute."""
        types = list(self.schema.types_with(attribute))
        return self._members.entity_map("components").filter(q("component_type").isin(types)).select("name").distinct()

    def set(self, attribute: str, value: Any, *, names: Sequence[str] | str | None = None, bus: str | None = None, kind: str = "inputs", **dims: Any) -> None:
        """Stage values: a scalar, sequence, mapping or series, a long frame, or a Column over the
        present ``value``.  Without ``names`` every member whose type declares the attribute is meant."""
        if kind not in ("inputs", "outputs"):
            raise ValueError(f"kind must be 'inputs' or 'outputs', not {kind!r}")
        self._check_dims(dims, attribute, kind)
        names = [names] if isinstance(names, str) else names
        if isinstance(value, Column):
            return self._derive(attribute, value, names, bus, dims)
        if is_frame(value):
            return self._set_frame(attribute, value, names, bus, kind, dims)
        if kind == "inputs" and names is not None:
            self._check_names(attribute, names)
        plain = not (isinstance(value, (Mapping, list, tuple)) or (hasattr(value, "__len__") and not isinstance(value, (str, bytes))))
        if names is None and plain:
            rows = self.names_declaring(attribute).withColumn("value", F.lit(value))
            return self._stage_values(kind, attribute, self._scoped(rows, bus, dims))
        if names is None:
            names = [r.name for r in self.names_declaring(attribute).orderBy("name").collect()]  # the caller's values are as many
        free, labels = self._free_axis(attribute, dims), None
        if not plain and free is not None:
            labels = [r[0] for r in self._resolver.axis(free).select(free).collect()]  # an axis, as long as the caller's values
        rows = []
        for name, label, v in normalise_value(value, names, labels):
            for n in [name] if name is not None else names:
                rows.append({"name": n, "value": v} | ({free: label} if label is not None else {}))
        types = self.schema.types_of(["name", *([free] if labels is not None else [])]) | {"value": self.schema.value_type(attribute)}
        self._stage_values(kind, attribute, self._scoped(ingest(self.spark, rows, types), bus, dims))

    def _free_axis(self, attribute: str, dims: Mapping[str, Any]) -> str | None:
        spec = self.schema.spec(attribute)
        open_ = [d for d in (*self.schema.whole_dims, *self.schema.split_dims) if spec is not None and d in spec.dims and d not in dims and d in self._resolver.axes]
        return open_[0] if open_ else None

    def _scoped(self, rows: DataFrame, bus: str | None, dims: Mapping[str, Any]) -> DataFrame:
        if bus is not None:
            rows = rows.withColumn("bus", F.lit(bus))
        for d, v in dims.items():
            rows = rows.withColumn(d, F.lit(v).cast(ddl(self.schema.dimensions[d].dtype)))
        return rows

    def _set_frame(self, attribute: str, value, names, bus, kind: str, dims) -> None:
        rows = ingest(self.spark, value)
        if "component_type" in rows.columns:
            raise RecordError("a long frame has no component_type: a name has one type")
        for c in ("name", "value"):
            if c not in rows.columns:
                raise RecordError(f"a long frame needs {c}")
        if names is not None:
            rows = rows.filter(q("name").isin(list(names)))
        if kind == "inputs":
            lost = anti(rows.select("name").distinct(), self.names_declaring(attribute), ["name"]).limit(5).collect()  # a few for the message
            if lost:
                raise KeyError(f"names that no declaring type has: {[r.name for r in lost]}")
            spec = self.schema.spec(attribute)
            beyond = [d for d in self.schema.dimensions if d in rows.columns and spec.dims and d not in spec.dims]
            if beyond:
                raise RecordError(f"{attribute} does not vary along {beyond}")
        self._stage_values(kind, attribute, self._scoped(rows, bus, dims))

    def _derive(self, attribute: str, value: Column, names, bus, dims) -> None:
        """New values from present ones, pending edits included; a broadcast row matches any label
        and gives a row of that label.  The result is settled: later edits do not change it."""
        if names is not None:
            self._check_names(attribute, names)
        # names are told apart before labels are spread
        rows = self._resolver.attribute(attribute).filter(q("name").isin(list(names))) if names is not None else self._resolver.attribute(attribute, self.names_declaring(attribute))
        if bus is not None:
            rows = rows.filter(q("bus") == bus)
        for d, v in dims.items():
            label = F.lit(v).cast(ddl(self.schema.dimensions[d].dtype))
            rows = rows.filter(q(d).isNull() | (q(d) == label)).withColumn(d, label)
        rows = settled(rows.withColumn("value", value.cast(ddl(self.schema.value_type(attribute)))))
        if rows.isEmpty():
            if names is not None:
                raise KeyError(f"{attribute} has no value to derive from for {list(names)[:5]}")
            return
        self._stage_values("inputs", attribute, rows)

    def add(self, ctype: str, frame) -> None:
        """Stage members: varying attributes become input rows, with the frame's dims; ``bus`` columns
        and connection attributes become connections; every other column stays with the member."""
        rows = ingest(self.spark, frame)
        own = self.schema.attributes.get(ctype, {})
        if "name" not in rows.columns:
            raise RecordError("members need a name")
        clash = semi(self._members.entity_map("components").filter(q("component_type") != ctype), rows, ["name"]).select("name").limit(5).collect()  # a few for the message
        if clash:
            raise RecordError(f"names of another type: {[r.name for r in clash]}")
        varying = [c for c in rows.columns if c in own and own[c].varying]
        linked = [c for c in rows.columns if c in own and own[c].bus == "connection" and not own[c].varying]
        dims = [d for d in self.schema.dimensions if d in rows.columns]
        key = [d for d in self.schema.member_dims if d in rows.columns]
        member = [c for c in rows.columns if c not in (*varying, *linked, "bus", "role", *[d for d in dims if d not in key])]
        rows = rows.withColumn("_nth", _place())
        self._stage_entities("components", ctype, _first_places(rows.select(*map(q, member), "_nth")), False)
        for a in varying:
            extra = ["bus"] if "bus" in rows.columns and own[a].bus == "connection" else []
            values = rows.filter(q(a).isNotNull()).select("name", *extra, *[q(d) for d in dims if d in own[a].dims], q(a).alias("value"), "_nth")
            self._stage_values("inputs", a, _first_places(values))
        if "bus" in rows.columns:
            cols = ["name", "bus", *[c for c in ("role",) if c in rows.columns], *[d for d in self.schema.link_dims if d in rows.columns], *linked]
            self.connect(ctype, _first_places(rows.select(*map(q, cols), "_nth")))

    def remove(self, ctype: str, names: Sequence[str] | str, **member_dims: Any) -> None:
        """Stage tombstones, in the given scope of component dims or everywhere."""
        beyond = [d for d in member_dims if d not in self.schema.member_dims]
        if beyond:
            raise RecordError(f"components are not keyed by {beyond}")
        names = [names] if isinstance(names, str) else list(names)
        rows = ingest(self.spark, [{"name": n} for n in names], {"name": "VARCHAR"})
        self._stage_entities("components", ctype, self._scoped(rows, None, member_dims), True)

    def connect(self, ctype: str, frame) -> None:
        rows = ingest(self.spark, frame)
        for c in ("name", "bus"):
            if c not in rows.columns:
                raise RecordError(f"connections need {c}")
        self._stage_entities("connections", ctype, rows, False)

    def disconnect(self, ctype: str, pairs: Sequence[tuple[str, str]], **link_dims: Any) -> None:
        beyond = [d for d in link_dims if d not in self.schema.link_dims]
        if beyond:
            raise RecordError(f"connections are not keyed by {beyond}")
        rows = ingest(self.spark, [{"name": n, "bus": b} for n, b in pairs], {"name": "VARCHAR", "bus": "VARCHAR"})
        self._stage_entities("connections", ctype, self._scoped(rows, None, link_dims), True)

    def pending_rows(self) -> DataFrame:
        """(kind, item, rows) of everything staged."""
        parts = [f.select(F.lit(k).alias("kind"), F.lit(a).alias("item")) for _, k, a, f in [*self._values, *self._entities]]
        if not parts:
            return self.spark.createDataFrame([], "kind string, item string, rows bigint")
        return union_by_name(parts).groupBy("kind", "item").agg(F.count("*").alias("rows"))

    @property
    def pending(self) -> Pending:
        got: dict[str, dict[str, int]] = {}
        for r in self.pending_rows().collect() if self._values or self._entities else []:  # a row an attribute or type
            got.setdefault(r.kind, {})[r["item"]] = r.rows
        return Pending(**got)

    def rollback(self) -> None:
        self._values.clear()
        self._entities.clear()
        self._now = None

    def collapsed_entities(self, kind: str) -> DataFrame | None:
        """The last staged row of each key, whatever its type; within a call the later row."""
        key = self.schema.member_key if kind == "components" else self.schema.link_key
        frames = [f.withColumn("_seq", F.lit(n)) for n, k, _, f in self._entities if k == kind]
        return latest_per(union_by_name(frames), key, ["_seq", "_nth"]) if frames else None

    def collapsed_values(self, attribute: str, kind: str = "inputs") -> DataFrame:
        """The last staged value of each coordinate, within a call the later row; names or connections
        now removed have none."""
        s = self.schema
        frames = [f.withColumn("_seq", F.lit(n)) for n, k, a, f in self._values if k == kind and a == attribute]
        # of one call, places alone tell which row is later
        order = ["_nth"] if len(frames) == 1 else ["_seq", "_nth"]
        rows = latest_per(union_by_name(frames), ["name", "bus", *s.dimensions, "attribute", "breakpoint"], order).drop("_seq", "_nth")
        if kind == "inputs":
            for k, key, dims in (("components", s.member_key, s.member_dims), ("connections", s.link_key, s.link_dims)):
                last = self.collapsed_entities(k)
                if last is not None:
                    rows = anti(rows, last.filter("deleted"), [c for c in key if c not in dims], dims)
        return rows

    def restated(self, attribute: str, staged: DataFrame) -> DataFrame:
        """What the edited keys must repeat of the base, as a layer owns whole what it owns: the rows
        of their keys whose coordinate no staged row covers; a staged NULL covers every label."""
        s = self.schema
        key = ["name", "bus", *s.split_dims]
        spec = s.spec(attribute)
        spread = [d for d in s.whole_dims if d in self._base.axes and spec is not None and d in spec.dims]
        # a row a key, and of which axes it has labels
        owned = expand(staged.select(*map(q, key), *map(q, spread)), s.split_dims, self._base.axes)
        owned = owned.groupBy(*map(q, key)).agg(F.count("*").alias("__n"), *[F.bool_or(q(d).isNotNull()).alias("__named_" + d) for d in spread])
        rows = self._base.attribute(attribute, staged.select("name"))
        rows = rows.join(renamed(owned), matches(key)).select(*map(q, rows.columns), *[q(R + "__named_" + d).alias("__named_" + d) for d in spread])
        for d in spread:
            # labels were edited under a row that holds for all: it goes on for the others
            rows = expand(rows, [d], self._base.axes, q("__named_" + d))
        return anti(rows.select(*map(q, s.row_columns)), staged, ["name", "bus"], list(s.dimensions))

    def staged_layer(self) -> Layer:
        entities: dict[str, dict[str, DataFrame]] = {"components": {}, "connections": {}}
        for kind, out in entities.items():
            rows = self.collapsed_entities(kind)
            if rows is not None:
                # in the order they were staged, each a number of its own; as many rows as callers gave
                nth = F.row_number().over(Window.orderBy("_seq", "_nth")) - 1
                rows = rows.withColumn("_row", nth.cast("bigint"))
                for t in dict.fromkeys(t for _, k, t, _ in self._entities if k == kind):
                    own = [f.columns for _, k, x, f in self._entities if k == kind and x == t]
                    keep = dict.fromkeys(c for cols in own for c in cols if c != "_nth")
                    out[t] = rows.filter(q("component_type") == t).select(*map(q, keep), "_row")

        held: dict[str, DataFrame] = {}

        def inputs(a: str) -> DataFrame:
            if a not in held:
                staged = self.collapsed_values(a)
                if any(a in x.inputs for x in self._base.layers):
                    # read by the owner map and by the rows, and written at commit: each part is computed once
                    staged = settled(staged)
                    staged = staged.unionByName(settled(self.restated(a, staged)))
                held[a] = staged
            return held[a]

        def keys(kind: str) -> tuple[str, ...]:
            return tuple(dict.fromkeys(a for _, k, a, _ in self._values if k == kind))

        return Layer("staged", {}, entities["components"], entities["connections"], Frames(lambda: keys("inputs"), inputs), Frames(lambda: keys("outputs"), lambda a: self.collapsed_values(a, "outputs")))

    @property
    def _resolver(self) -> Resolver:
        if not self._values and not self._entities:
            return self._base
        if self._now is None:
            self._now = Resolver(self.spark, self.schema, [*self._base.layers, self.staged_layer()], self._base.base)
        return self._now

    @property
    def _members(self) -> Resolver:
        """What resolves members: staged values change none, so the base, whose maps may be kept."""
        return self._resolver if self._entities else self._base

    @property
    def _view(self) -> LayeredRecord:
        return LayeredRecord(self._resolver)

    @property
    def dims(self) -> Mapping[str, DataFrame]:
        return self._view.dims

    @property
    def components(self) -> Mapping[str, DataFrame]:
        return self._view.components

    @property
    def connections(self) -> Mapping[str, DataFrame]:
        return self._view.connections

    @property
    def attributes(self) -> Mapping[str, DataFrame]:
        return self._view.attributes

    @property
    def outputs(self) -> Mapping[str, DataFrame]:
        """Staged results alone: the base's belong to the base."""
        return self.staged_layer().outputs

    def flags(self, ctype: str) -> dict[str, Flags]:
        return as_flags(self._resolver.flags(ctype))

    def commit(self, target: NewChild | Directory, *, strict: bool = False):
        """Write the edits and clear them; a revision for NewChild, a record for Directory."""
        if isinstance(target, NewChild):
            if self.store is None:
                raise ValueError("a record outside a store has no children")
            parent = target.parent or self.revision
            self._require_unique()
            child = self.store.create(parent)
            write_record(self.store, _Source(self.schema, self.staged_layer()), revision=child.id, strict=strict)
            self.rollback()
            return child
        store = self.store or Store(self.spark, target.uri.rsplit("/", 1)[0])
        now = self._resolver
        # every type is read by the same maps: folded once for all of them
        once = Resolver(self.spark, self.schema, now.layers, now.base, keep=True)
        view = LayeredRecord(once)
        flat = Layer("flat", dict(view.dims.items()), view.components, view.connections, view.attributes, self.outputs)
        try:
            write_record(store, _Source(self.schema, flat), uri=target.uri, strict=strict)
        finally:
            once.release()
        self.rollback()
        return DirectoryRecord(self.spark, target.uri)

    def _require_unique(self) -> None:
        """No staged member may take a name that the resolved parent has under another type."""
        rows = self.collapsed_entities("components")
        if rows is None:
            return
        live = renamed(rows.filter("NOT deleted").select("name", "component_type"))
        if live.isEmpty():
            return
        gone = rows.filter("deleted").select("name")
        old = anti(self._base.entity_map("components"), gone, ["name"])
        bad = old.join(live, matches(["name"])).filter(q("component_type") != q(R + "component_type")).select("name").limit(5).collect()  # a few for the message
        if bad:
            raise RecordError(f"names of another type: {[r.name for r in bad]}")


def _place() -> Column:
    """Where a row stands in the frame of a call."""
    return F.monotonically_increasing_id().alias("_nth")


def _first_places(df: DataFrame) -> DataFrame:
    """Distinct rows, each where it first stood."""
    return df.groupBy(*[q(c) for c in df.columns if c != "_nth"]).agg(F.min("_nth").alias("_nth"))


def _ddl(kind: str) -> str:
    try:
        return ddl(kind)
    except ValueError:
        return kind


@dataclass(frozen=True)
class _Source:
    schema: Schema
    layer: Layer

    @property
    def dims(self):
        return self.layer.dims

    @property
    def components(self):
        return self.layer.components

    @property
    def connections(self):
        return self.layer.connections

    @property
    def attributes(self):
        return self.layer.inputs

    @property
    def outputs(self):
        return self.layer.outputs or EMPTY
