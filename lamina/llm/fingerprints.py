"""Bottom-k sketches of shingle hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from lamina.llm.shared import as_frame, prepare, settled, slices, texts_of, tidied
from lamina.llm.text import shingles, word_hashes

K, SHINGLE = 128, 5
#: Values that a task holds before it folds them.
HELD = 2 << 20
#: Hashes have 63 bits, so that they order alike as signed numbers.
SPACE = 2.0**63


def bottom_k(h: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` smallest distinct hashes of each text in order, and their offsets."""
    h = h >> np.uint64(1)
    out, size = [], np.zeros(len(off), np.int64)
    for d in range(len(off) - 1):
        own = h[off[d] : off[d + 1]]
        want = k
        # repeats may hide among the smallest: widen until k distinct ones are in hand
        while True:
            low = np.unique(np.partition(own, want - 1)[:want] if want < len(own) else own)
            if len(low) >= k or want >= len(own):
                break
            want *= 2
        out.append(low[:k])
        size[d + 1] = min(k, len(low))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)).view(np.int64), np.cumsum(size)


def sketches(docs: DataFrame, *, k: int = K, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, sketch, shingles, *more): each row's bottom-k sketch and estimated distinct shingles.

    Shingles are runs of ``shingle`` lower-cased words; a shorter text is one shingle; null, empty
    and white text give an empty sketch and 0.  Fewer than ``k`` hashes mean the sketch is the whole
    set and the count exact.  Equal rows give equal rows; columns not in ``more`` are ignored.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = texts_of(b)
            for lo, hi in slices(col):
                flat, off = bottom_k(*shingles(*word_hashes(col.slice(lo, hi - lo)), shingle), k)
                n = np.diff(off)
                last = np.where(n > 0, flat[np.maximum(off[1:] - 1, 0)] if len(flat) else 0, 0).astype(np.float64)
                est = np.where(n < k, n, np.round((k - 1) * SPACE / np.maximum(last + 1, 1)))
                arr = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), arr, pa.array(est.astype(np.int64)), *[b.column(2 + j).slice(lo, hi - lo) for j in range(len(more))]], ["doc_id", "sketch", "shingles", *more])

    return as_frame(docs, id_col, text_col, *more).mapInArrow(tidied(run), "doc_id bigint, sketch array<bigint>, shingles bigint" + "".join(f", `{c}` string" for c in more))


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sets: the k smallest of both sketches."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def merge_parts(parts: DataFrame, by: str, *, k: int = K) -> DataFrame:
    """(by, sketch, shingles) over all sketches of a group.

    The k smallest distinct values of a group are found in two steps: each task sorts what it holds
    by (group, value), keeps k values a group and gives them out; then values are numbered within
    their group, where again only k a group leave a task.  So a hot group moves k values a task, no
    row and no task holds more than k of a group at the end, and any number of groups passes, as a
    task gives out what it holds once that is ``HELD`` values.  Null groups are a group; empty
    sketches add nothing but their group; null sketches are left out.
    """
    kind = parts.schema[by].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict = {}
        group, value, fresh_ = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        more: list[tuple[np.ndarray, np.ndarray]] = []
        field = None

        def fold():
            g, v = np.concatenate([group, *(x for x, _ in more)]), np.concatenate([value, *(x for _, x in more)])
            more.clear()
            order = np.lexsort((v, g))
            g, v = g[order], v[order]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
            g, v = g[new], v[new]
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
            nth = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
            return g[nth < k], v[nth < k]

        def give():
            # a group without values is still a group
            bare = np.setdiff1d(np.arange(len(names)), group)
            keys = pa.array(list(names), field)
            for lo in range(0, len(group), 1 << 18):
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(group[lo : lo + (1 << 18)])), pa.array(value[lo : lo + (1 << 18)])], ["part", "value"])
            if len(bare):
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(bare)), pa.nulls(len(bare), pa.int64())], ["part", "value"])

        for b in batches:
            field = b.schema.field(0).type
            code = b.column(0).dictionary_encode(null_encoding="encode")
            at = np.array([names.setdefault(g, len(names)) for g in code.dictionary.to_pylist()], np.int64)
            off = b.column(1).offsets.to_numpy()
            if len(at):
                more.append((np.repeat(at[code.indices.to_numpy()], np.diff(off)), b.column(1).values.to_numpy()[off[0] : off[-1]]))
                fresh_ += int(off[-1] - off[0])
            if fresh_ > HELD or len(names) > HELD:
                (group, value), fresh_ = fold(), 0
                if len(group) > HELD // 2 or len(names) > HELD:
                    yield from give()
                    names, group, value = {}, np.zeros(0, np.int64), np.zeros(0, np.int64)
        group, value = fold()
        if names:
            yield from give()

    schema = StructType([StructField("part", kind), StructField("value", LongType())])
    few = parts.filter(F.col("sketch").isNotNull()).select(F.col(f"`{by}`").alias("part"), "sketch").mapInArrow(tidied(run), schema).distinct()
    nth = F.row_number().over(Window.partitionBy("part").orderBy(F.col("value").asc_nulls_last()))
    few = few.withColumn("nth", nth).filter(F.col("nth") <= k).drop("nth")
    out = few.groupBy("part").agg(F.array_sort(F.collect_list("value")).alias("sketch"))
    return out.select(F.col("part").alias(by), "sketch", distinct(F.col("sketch"), k).alias("shingles"))


def distinct(sketch: Column, k: int = K) -> Column:
    """Distinct shingles estimated from a sketch: exact below k, else (k-1) / the k-th value."""
    return F.when(F.size(sketch) < k, F.size(sketch).cast("bigint")).otherwise(F.round(F.lit((k - 1) * SPACE) / (F.element_at(sketch, -1) + F.lit(1).cast("bigint"))).cast("bigint"))


def _shared_fraction(a: Column, b: Column, k: int) -> tuple[Column, Column]:
    both = merged(a, b, k)
    return F.size(F.array_intersect(F.array_intersect(both, a), b)), F.size(both)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; null where both sets are empty."""
    same, n = _shared_fraction(a, b, k)
    return F.when(n > 0, same / n)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; null where a is empty."""
    union = distinct(merged(a, b, k), k)
    return F.when(F.size(a) > 0, F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct(a, k)))


def fingerprints(docs: DataFrame, *, k: int = K, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``sketches`` of every document; see ``merge_parts``, ``resemblance`` and ``containment``."""
    return sketches(docs, k=k, shingle=shingle, id_col=id_col, text_col=text_col)


def source_fingerprints(docs: DataFrame, *, k: int = K, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(level, doc_id, source, sketch, shingles, resemblance, containment): the documents' sketches,
    with each one's resemblance to and containment in its source, and below them the sources' own.

    Rows of level ``source`` have no id and hold the merged sketch of all documents of the source; a
    null source is a source.  Both measures are null for documents without shingles.
    """
    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{source_col}`").alias("source"))
    own = settled(sketches(named, k=k, shingle=shingle, more=("source",)), "sketches")
    whole = settled(merge_parts(own, "source", k=k), "sources")
    to = whole.select(F.col("source").alias("to"), F.col("sketch").alias("whole"))
    a, b = F.col("sketch"), F.col("whole")
    measures = [F.when(F.size(a) > 0, resemblance(a, b, k)).alias("resemblance"), containment(a, b, k).alias("containment")]
    each = own.join(to, F.col("source").eqNullSafe(F.col("to")), "left").select(F.lit("document").alias("level"), "doc_id", "source", "sketch", "shingles", *measures)
    none = F.lit(None).cast("double")
    return each.unionByName(whole.select(F.lit("source").alias("level"), F.lit(None).cast("bigint").alias("doc_id"), "source", "sketch", "shingles", none.alias("resemblance"), none.alias("containment")))
