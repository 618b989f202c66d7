"""Validated, all-or-nothing writes of whole records."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions.frames import q, union_by_name
from lamina.schema import Schema, SchemaError
from lamina.sources.store import Store, typed


class RecordError(ValueError):
    """A frame that does not fit its record."""


def require_columns(df: DataFrame, needed, what: str) -> None:
    lacking = [c for c in needed if c not in df.columns]
    if lacking:
        raise RecordError(f"{what} lacks columns {lacking}")


def ambiguous_names(frames: Mapping[str, DataFrame]) -> DataFrame:
    """(name, types) of names that more than one type uses; tombstones count."""
    rows = union_by_name([f.select("name").withColumn("component_type", F.lit(t)) for t, f in frames.items()])
    return rows.groupBy("name").agg(F.countDistinct("component_type").alias("types")).filter("types > 1")


def check_unique(frames: Mapping[str, DataFrame]) -> None:
    if len(frames) > 1:
        # types by number: one aggregate, of least and greatest
        rows = union_by_name([f.select("name", F.lit(n).alias("n")) for n, f in enumerate(frames.values())])
        many = rows.groupBy("name").agg(F.min("n").alias("a"), F.max("n").alias("z")).filter("a < z")
        bad = [r.name for r in many.orderBy("name").limit(5).collect()]  # a few for the message
        if bad:
            raise RecordError(f"names of more than one type: {bad}")


def check_long(df: DataFrame, schema: Schema, attribute: str, strict: bool) -> None:
    require_columns(df, schema.row_columns, f"attribute {attribute}")
    spec = schema.spec(attribute)
    if strict and spec is not None:
        if not spec.breakpoints and df.filter(q("breakpoint").isNotNull()).limit(1).count():
            raise RecordError(f"{attribute} takes no breakpoints")
        for d in schema.dimensions:
            if d not in spec.dims and df.filter(q(d).isNotNull()).limit(1).count():
                raise RecordError(f"{attribute} does not vary along {d}")


def write_record(store: Store, source, *, revision: str | None = None, uri: str | None = None, strict: bool = False) -> str:
    """Write a record as the layer of ``revision``, or as a standalone directory at ``uri``.

    Nothing is replaced: an existing place raises FileExistsError.  Frames are checked, cast and
    written beside the place one by one, each looked up once, and renamed into it as the last act;
    a failure leaves neither a layer nor a changed schema.  Member and axis files keep their row order,
    over parts too, as it is data; outputs appear only where there are any.
    """
    if (revision is None) == (uri is None):
        raise ValueError("give either a revision or a uri")
    place, schema, files = uri or store.layer_uri(revision), source.schema, store.files
    if files.exists(place):
        raise FileExistsError(place)
    if uri is None:
        if not schema and store.schema:
            schema = store.schema
        store.reconcile(schema)
    stage = f"{place.rsplit('/', 1)[0]}/.staging/{uuid.uuid4().hex}"
    try:
        for dim, f in source.dims.items():
            if dim not in schema.dimensions:
                raise SchemaError(f"axis {dim} is not declared")
            require_columns(f, schema.label_key(dim), f"axis {dim}")
            _file(typed(f.drop("_pos"), schema), f"{stage}/dims/{dim}s.parquet", True)
        for kind, key in (("components", schema.member_key), ("connections", schema.link_key)):
            written = {}
            for t, f in getattr(source, kind).items():
                require_columns(f, key, f"{kind[:-1]} frame {t}")
                f = f.drop("order_key")
                if "component_type" not in f.columns:
                    f = f.withColumn("component_type", F.lit(t))
                _file(typed(f, schema, t), f"{stage}/dims/{kind}/{t}.parquet", True)
                written[t] = store.spark.read.parquet(f"{stage}/dims/{kind}/{t}.parquet")
            if kind == "components":
                check_unique(written)
        for a, f in source.attributes.items():
            check_long(f, schema, a, strict)
            _file(typed(f, schema, value=schema.value_type(a)), f"{stage}/inputs/{a}.parquet", False)
        for a, f in source.outputs.items():
            require_columns(f, schema.row_columns, f"output {a}")
            _file(typed(f, schema), f"{stage}/outputs/{a}.parquet", False)
        if uri is not None:
            files.write(f"{stage}/manifest.json", schema.to_json())
        elif not files.names(stage):
            files.write(f"{stage}/empty.json", "{}")
        files.rename(stage, place)
        if uri is None:
            store.write_schema(schema)
            store.forget()
    except BaseException:
        files.delete(stage)
        raise
    return place


def _file(df: DataFrame, uri: str, in_order: bool) -> None:
    """Parts are written side by side.  Members and axes are sorted into them, so that the parts'
    names and the rows' places in them give the order back."""
    if in_order and "_row" in df.columns:
        df = df.orderBy("_row").drop("_row")
    df.write.parquet(uri)
