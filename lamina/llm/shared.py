"""Where intermediate tables live, and how Arrow batches are bounded.

Intermediate tables go to the folder the cluster names in ``spark.checkpoint.dir``, which every
executor shares, so that losing an executor never loses them.  Only a session that names none
(a test) gets a folder of its own.
"""

from __future__ import annotations

import ctypes
import os
import re
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of text that a vectorised step holds at once.
SLICE_BYTES = 4 << 20
#: Masters whose executors are this process.
LOCAL = re.compile(r"local(\[.*\])?")


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and bound Arrow batches by bytes."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, str(16 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session.  A local session that names none, as in tests, gets a new
    one; a cluster that names none has no folder that outlives an executor, so that raises."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not LOCAL.fullmatch(spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lamina-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def new_path(spark: SparkSession, name: str) -> str:
    """A new path below this application's folder; ``clean`` removes them all."""
    return f"{shared_dir(spark).rstrip('/')}/lamina/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lamina_path = path
    return out


def discard(spark: SparkSession, *tables: DataFrame | str | None) -> None:
    """Delete settled tables, or paths, that nothing reads any more."""
    for t in tables:
        path = t if isinstance(t, str) else getattr(t, "_lamina_path", None)
        if path:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean(spark: SparkSession) -> None:
    """Delete every intermediate table of this application.  Frames that the operators returned and
    that are not yet written read them, so call it last."""
    discard(spark, f"{shared_dir(spark).rstrip('/')}/lamina/{spark.sparkContext.applicationId}")


def cached(key, build):
    """A value kept for the life of a Python worker."""
    store = sys.modules.setdefault("_lamina_cache", type(sys)("_lamina_cache")).__dict__
    if key not in store:
        store[key] = build()
    return store[key]


def tidied(run):
    """``run``, after which the worker gives unused memory back: workers live on from stage to stage,
    and what one has used would stay with it beside the next one's."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not this C library
                pass

    return wrapped


def offsets_of(col: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary array, slices included."""
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    if not len(col):
        return np.zeros(1, kind)
    return np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1]


def slices(col: pa.Array, limit: int = SLICE_BYTES):
    """(start, stop) of runs of rows, each of at most ``limit`` bytes of text or of one row."""
    off, start, n = offsets_of(col), 0, len(col)
    while start < n:
        stop = max(start + 1, int(np.searchsorted(off, int(off[start]) + limit, side="right")) - 1)
        yield start, min(stop, n)
        start = stop


def texts_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column with null as empty."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)), "")


def as_frame(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only what an operator reads, under its own names: other columns cannot clash."""
    cols = [F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")]
    return docs.select(*cols, *[F.col(f"`{c}`").cast("string").alias(c) for c in more])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def take_rows(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, others: bool = False) -> DataFrame:
    """Rows of ``docs`` by key; ``chosen`` has (doc_id, text_hash, take, rows), one row a key.

    A key is the id with the hash of its text.  ``take`` of the ``rows`` equal rows stay, and with
    ``others`` every row whose key is not in ``chosen``.  Rows are shuffled once.  Only where some key
    loses a part of its equal rows are those joined once more and numbered, first within each of 64
    salts, so that a key with countless equal rows is never numbered in one task.
    """
    i, h, t, n, r, s = fresh(docs, "__id", "__hash", "__take", "__rows", "__nth", "__salt")
    keyed = docs.withColumn(i, F.col(f"`{id_col}`").cast("bigint")).withColumn(h, F.xxhash64(F.col(f"`{text_col}`").cast("string")))
    keys = chosen.select(F.col("doc_id").alias(i + "2"), F.col("text_hash").alias(h + "2"), F.col("take").alias(t), F.col("rows").alias(n))
    on = F.col(i).eqNullSafe(F.col(i + "2")) & (F.col(h) == F.col(h + "2"))
    back = [F.col(f"`{c}`") for c in docs.columns]
    if others:
        out = keyed.join(keys.filter(F.col(t) < F.col(n)), on, "left_anti").select(*back)
    else:
        out = keyed.join(keys.filter(F.col(t) >= F.col(n)), on, "left_semi").select(*back)
    some = keys.filter((F.col(t) < F.col(n)) & (F.col(t) > 0))
    if some.isEmpty():
        return out
    part = keyed.withColumn(s, F.pmod(F.monotonically_increasing_id(), F.lit(64))).join(some, on)
    for by in ([i, h, s], [i, h]):
        part = part.withColumn(r, F.row_number().over(Window.partitionBy(*by).orderBy(s))).filter(F.col(r) <= F.col(t)).drop(r)
    return out.unionByName(part.select(*back))
