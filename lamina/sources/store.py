"""A store: one root holding a schema, a tree of revisions and their write-once layers."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.frames import cast_declared, union_by_name
from lamina.functions.frames import q as _q
from lamina.operators.axes import ORDER_SHIFT
from lamina.operators.resolve import Maps
from lamina.schema import Schema, SchemaError
from lamina.sources.layers import Frames, Layer

ROOT_VARIABLE = "LAMINA_ROOT"


class Files:
    """Listing, small text files and renames through the Hadoop file system of a URI."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, uri: str):
        path = self._jvm.org.apache.hadoop.fs.Path(uri)
        return path.getFileSystem(self._conf), path

    def exists(self, uri: str) -> bool:
        fs, p = self._at(uri)
        return fs.exists(p)

    def names(self, uri: str) -> list[str]:
        fs, p = self._at(uri)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, uri: str) -> str | None:
        fs, p = self._at(uri)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, uri: str, text: str) -> None:
        """To a name beside it, then renamed into place."""
        fs, p = self._at(uri)
        tmp = self._at(f"{uri}.{uuid.uuid4().hex}")[1]
        out = fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        # one step: at no time is there no file, as a crash between two would leave
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self._conf)
        over = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        how = self._jvm.java.lang.reflect.Array.newInstance(over.getClass(), 1)
        how[0] = over
        context.rename(fs.makeQualified(tmp), fs.makeQualified(p), how)

    def rename(self, a: str, b: str) -> None:
        fs, p = self._at(a)
        to = self._at(b)[1]
        fs.mkdirs(to.getParent())
        if not fs.rename(p, to):
            raise OSError(f"cannot rename {a} to {b}")

    def delete(self, uri: str) -> None:
        fs, p = self._at(uri)
        fs.delete(p, True)


def read_frame(spark: SparkSession, uri: str, *, rows: bool = False) -> DataFrame:
    """A parquet file or folder; with ``rows``, ``_row`` restores the order of its rows."""
    df = spark.read.parquet(uri)
    if not rows:
        return df
    if "_row" in df.columns:
        return df
    parts = [n for n in Files(spark).names(uri) if n.endswith(".parquet")]
    row = F.col("_metadata.row_index")
    if len(parts) > 1:
        # by part, then by place in it; 40 bits hold both
        nth = F.array_position(F.array(*map(F.lit, parts)), F.col("_metadata.file_name")) - 1
        row = F.shiftleft(nth, ORDER_SHIFT - (len(parts) - 1).bit_length()) + row
    return df.select("*", row.alias("_row"))


def read_json(files: Files, uri: str) -> dict | None:
    text = files.read(uri)
    return None if text is None else json.loads(text)


def try_read(spark: SparkSession, uri: str, **how) -> DataFrame | None:
    """The frame at ``uri``, None where nothing is; every other error raises."""
    from pyspark.errors import AnalysisException

    try:
        return read_frame(spark, uri, **how)
    except AnalysisException as e:
        if (e.getCondition() or "").startswith("PATH_NOT_FOUND"):
            return None
        raise


def read_layer(spark: SparkSession, files: Files, uri: str, schema: Schema, id: str) -> Layer:
    """A layer of parquet files; listing its frames opens none."""

    def frames(sub: str, rows: bool) -> Mapping[str, DataFrame]:
        return Frames(lambda: tuple(n[: -len(".parquet")] for n in files.names(f"{uri}/{sub}") if n.endswith(".parquet")), lambda k: read_frame(spark, f"{uri}/{sub}/{k}.parquet", rows=rows))

    dims = Frames(lambda: tuple(d for d in schema.dimensions if files.exists(f"{uri}/dims/{d}s.parquet")), lambda d: read_frame(spark, f"{uri}/dims/{d}s.parquet", rows=True))
    return Layer(id, dims, frames("dims/components", True), frames("dims/connections", True), frames("inputs", False), frames("outputs", False))


@dataclass(frozen=True)
class Revision:
    """A node of the tree; its layer's place follows from its id."""

    store: Store
    id: str
    parent: str | None

    def child(self) -> Revision:
        return self.store.create(self)

    def ancestry(self) -> list[str]:
        return self.store.ancestry(self.id)

    @property
    def record(self):
        return self.store.record(self.id)

    def materialise(self) -> None:
        self.store.materialise(self.id)


class Store:
    """Everything under one root; every path, the schema's included, derives from it."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.files = spark, Files(spark)
        self.root = (root or os.environ.get(ROOT_VARIABLE) or "lamina-store").rstrip("/")
        self._tree: dict[str, str | None] | None = None
        self._records: dict[str, object] = {}

    def layer_uri(self, id: str) -> str:
        return f"{self.root}/layers/{id}"

    def resolved_uri(self, id: str) -> str:
        return f"{self.layer_uri(id)}/resolved"

    @property
    def schema(self) -> Schema:
        text = self.files.read(f"{self.root}/manifest.json")
        return Schema() if text is None else Schema.from_json(text)

    def write_schema(self, schema: Schema) -> None:
        self.files.write(f"{self.root}/manifest.json", schema.to_json())

    def reconcile(self, schema: Schema) -> None:
        """Refuse a schema that would make existing layers unreadable."""
        old = self.schema
        if old and (why := old.conflicts(schema)):
            raise SchemaError("; ".join(why))

    def _revisions(self) -> dict[str, str | None]:
        if self._tree is None:
            self._tree = {}
            for n in self.files.names(f"{self.root}/revisions"):
                if n.endswith(".json"):
                    got = read_json(self.files, f"{self.root}/revisions/{n}") or {}
                    self._tree[got["id"]] = got["parent"]
        return self._tree

    def create(self, parent: Revision | str | None = None) -> Revision:
        up = parent.id if isinstance(parent, Revision) else parent
        if up is not None:
            self.get(up)
        id = str(uuid.uuid4())
        self.files.write(f"{self.root}/revisions/{id}.json", json.dumps({"id": id, "parent": up}))
        self._revisions()[id] = up
        return Revision(self, id, up)

    def get(self, id: str) -> Revision:
        tree = self._revisions()
        if id not in tree:
            self._tree = None  # another session may have added it
            tree = self._revisions()
        if id not in tree:
            raise KeyError(f"no revision {id}")
        return Revision(self, id, tree[id])

    def ancestry(self, id: str) -> list[str]:
        """Ids from the root down to ``id``."""
        out, at = [], id
        while at is not None:
            if at in out:
                raise ValueError(f"revision {at} is its own ancestor")
            out.append(at)
            at = self.get(at).parent
        return out[::-1]

    def layer(self, id: str, schema: Schema | None = None) -> Layer:
        return read_layer(self.spark, self.files, self.layer_uri(id), schema or self.schema, id)

    def record(self, id: str):
        """The resolved record; layers are write-once, so a session keeps it."""
        from lamina.operators.record import LayeredRecord
        from lamina.operators.resolve import Resolver

        if id not in self._records:
            schema, chain = self.schema, self.ancestry(id)
            layers = [self.layer(x, schema) for x in chain]
            base = next((b for k in range(len(chain) - 1, -1, -1) if (b := self._cached(chain[k], k, layers, schema)) is not None), None)
            self._records[id] = LayeredRecord(Resolver(self.spark, schema, layers, base, keep=True), self)
        return self._records[id]

    def forget(self) -> None:
        """Drop kept records and their maps, as after a schema change."""
        for r in self._records.values():
            r.resolver.release()
        self._records.clear()

    def materialised(self, id: str) -> bool:
        return self.files.exists(f"{self.resolved_uri(id)}/owner_map/done.json")

    def materialise(self, id: str) -> None:
        """Write the owner maps and axes of a revision beside its layer; answers do not change."""
        maps, at = self.record(id).resolver.maps(), self.resolved_uri(id)
        for kind in ("inputs", "components", "connections"):
            getattr(maps, kind).write.mode("overwrite").parquet(f"{at}/owner_map/{kind}.parquet")
        for d, a in maps.axes.items():
            a.coalesce(1).write.mode("overwrite").parquet(f"{at}/dims/{d}s.parquet")
        self.files.write(f"{at}/owner_map/done.json", json.dumps({"depth": maps.depth, "axes": sorted(maps.axes)}))
        self.forget()

    def _cached(self, id: str, depth: int, layers: list[Layer], schema: Schema) -> Maps | None:
        """A revision's cache; unusable where a later layer adds labels to a dim that keys are
        expanded over, as NULL rows would have to cover those too."""
        if not self.materialised(id):
            return None
        got = read_json(self.files, f"{self.resolved_uri(id)}/owner_map/done.json")
        wide = {*schema.split_dims, *schema.member_dims, *schema.link_dims}
        if any(d in wide for x in layers[depth + 1 :] for d in x.dims) or set(got["axes"]) - set(schema.dimensions):
            return None
        at = self.resolved_uri(id)
        maps = [read_frame(self.spark, f"{at}/owner_map/{k}.parquet") for k in ("inputs", "components", "connections")]
        if set(maps[0].schema["varies"].dataType.fieldNames()) != set(schema.dimensions) and schema.dimensions:
            return None
        return Maps(depth, *maps, {d: read_frame(self.spark, f"{at}/dims/{d}s.parquet") for d in got["axes"]})


def typed(df: DataFrame, schema: Schema, ctype: str | None = None, value: str | None = None) -> DataFrame:
    """Declared columns cast to their declared types, ready to be written."""
    own = schema.attributes.get(ctype, {}) if ctype else {}
    types = {c: schema.column_type(c) for c in df.columns if c in schema.dimensions or c in own or c in ("component_type", "name", "bus", "role", "attribute", "breakpoint", "deleted")}
    if value is not None:
        types["value"] = value
    return cast_declared(df, types)


def ingest(spark: SparkSession, data, types: Mapping[str, str] | None = None) -> DataFrame:
    """A Spark frame as it is; pandas, Arrow, polars or rows become one, with declared types."""
    from lamina.functions.types import ddl

    if isinstance(data, DataFrame):
        return data
    if hasattr(data, "to_arrow"):
        data = data.to_arrow()
    if hasattr(data, "to_pylist"):
        data = data.to_pylist()
    elif hasattr(data, "to_dict") and hasattr(data, "columns"):
        data = data.astype(object).where(data.notna(), None).to_dict("records")
    rows = [dict(r) for r in data]
    names = list(dict.fromkeys(c for r in rows for c in r))
    if types:
        names = list(dict.fromkeys([*names, *([] if rows else types)]))
        declared = ", ".join(f"`{n}` {ddl(types[n])}" for n in names if n in types)
        if all(n in types for n in names):
            return spark.createDataFrame([tuple(_plain(r.get(n), types[n]) for n in names) for r in rows], declared)
    return spark.createDataFrame([tuple(_plain(r.get(n)) for n in names) for r in rows], names) if rows else union_by_name([spark.createDataFrame([], "name string")]).select(_q("name"))


def _plain(x, kind: str | None = None):
    from lamina.functions.types import ddl

    if x is None or x != x and kind != "DOUBLE":
        return None
    if hasattr(x, "to_pydatetime"):
        x = x.to_pydatetime()
    elif hasattr(x, "item"):
        x = x.item()
    if kind is not None:
        want = ddl(kind)
        if want == "double" and isinstance(x, (int, bool)):
            return float(x)
        if want == "string" and not isinstance(x, str):
            return str(x)
    return x
