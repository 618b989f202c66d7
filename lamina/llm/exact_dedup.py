"""Exact deduplication by Grace hashing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.shared import as_frame, fresh, new_path, prepare, settled, tidied

FANOUT = 16
NO_ID = np.iinfo(np.int64).max


class Table:
    """Open addressing with linear probing over hashes; equal hashes compare complete contents."""

    def __init__(self, capacity: int = 1024):
        self.slots = [-1] * capacity
        self.mask = capacity - 1
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def _grow(self) -> None:
        self.mask = (self.mask + 1) * 2 - 1
        self.slots = [-1] * (self.mask + 1)
        for n, h in enumerate(self.hashes):
            at = h & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = n

    def add(self, content: bytes, h: int) -> int:
        """The number of this content, a new one if no stored content equals it."""
        at, slots, mask = h & self.mask, self.slots, self.mask
        while (n := slots[at]) >= 0:
            if self.hashes[n] == h and self.contents[n] == content:
                return n
            at = (at + 1) & mask
        n = slots[at] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + 150
        if 2 * n > mask:
            self._grow()
        return n

    def add_all(self, col: pa.Array) -> np.ndarray:
        texts = col.cast(pa.binary()).to_pylist()
        return np.fromiter(map(self.add, texts, map(_h, texts)), np.int64, len(texts))


def _h(x: bytes) -> int:
    return xxhash.xxh3_64_intdigest(x, seed=99)


class Folds:
    """A bucket of folded rows (text, local, id, rows): one content once, 32 bytes for each row."""

    def __init__(self):
        self.table, self.parts = Table(), []
        self.rows = 0

    def add(self, b: pa.RecordBatch) -> None:
        self.parts.append((self.table.add_all(b.column(0)), *(b.column(k).to_numpy() for k in (1, 2, 3))))
        self.rows += b.num_rows

    @property
    def bytes(self) -> int:
        return self.table.bytes + 32 * self.rows

    @property
    def contents(self) -> int:
        return len(self.table.contents)

    def held(self) -> Iterator[pa.RecordBatch]:
        """What came in, to be split further."""
        for group, local, ids, rows in self.parts:
            for lo, hi in _runs([len(self.table.contents[g]) for g in group]):
                texts = pa.array([self.table.contents[g] for g in group[lo:hi]], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([texts, *(pa.array(x[lo:hi]) for x in (local, ids, rows))], ["text", "local", "id", "rows"])

    def finish(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        group, local, ids, rows = (np.concatenate(x) for x in zip(*self.parts))
        first = np.full(self.contents, NO_ID)
        np.minimum.at(first, group, ids)
        total = np.zeros(self.contents, np.int64)
        np.add.at(total, group, rows)
        yield pa.RecordBatch.from_arrays([pa.array(local), pa.array(first[group], mask=first[group] == NO_ID), pa.array(total[group])], ["local", "keep_id", "copies"])


class Keepers:
    """A bucket that holds the best row of each content: smallest id (null last), then smallest row hash.

    Columns 0, 1, 2 are text, id and row hash.  Rows that a better one replaced are let go of once
    what is held has doubled.
    """

    def __init__(self):
        self.table, self.batches = Table(), []
        self.size = self.stale = self.floor = 0
        self.id, self.hash, self.at, self.row = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, b: pa.RecordBatch) -> None:
        group = self.table.add_all(b.column(0))
        ids, mark = b.column(1).fill_null(NO_ID).to_numpy(), b.column(2).to_numpy()
        more = self.contents - len(self.id)
        self.id, self.hash = np.append(self.id, np.full(more, NO_ID)), np.append(self.hash, np.full(more, NO_ID))
        self.at, self.row = np.append(self.at, np.full(more, -1)), np.append(self.row, np.zeros(more, np.int64))
        order = np.lexsort((mark, ids, group))
        best = order[np.concatenate([[True], np.diff(group[order]) != 0])]
        g = group[best]
        won = (self.at[g] < 0) | (ids[best] < self.id[g]) | ((ids[best] == self.id[g]) & (mark[best] < self.hash[g]))
        best, g = best[won], g[won]
        if not len(best):
            return
        self.stale += int((self.at[g] >= 0).sum())
        self.id[g], self.hash[g], self.at[g], self.row[g] = ids[best], mark[best], len(self.batches), np.arange(len(best))
        self.batches.append(b.take(pa.array(best)))
        self.size += self.batches[-1].nbytes
        if self.stale and self.size > 2 * self.floor + (1 << 20):
            whole = list(self.finish())
            self.batches, self.stale, self.size = whole, 0, sum(x.nbytes for x in whole)
            self.floor = self.size
            # finish() goes by batch, then by row
            order, start = np.lexsort((self.row, self.at)), 0
            for n, x in enumerate(whole):
                mine = order[start : start + x.num_rows]
                self.at[mine], self.row[mine] = n, np.arange(x.num_rows)
                start += x.num_rows

    @property
    def bytes(self) -> int:
        return self.table.bytes + self.size

    @property
    def contents(self) -> int:
        return len(self.table.contents)

    def held(self) -> Iterator[pa.RecordBatch]:
        return self.finish()

    def finish(self) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((self.row, self.at))
        at = self.at[order]
        for n, b in enumerate(self.batches):
            mine = order[np.searchsorted(at, n) : np.searchsorted(at, n + 1)]
            if len(mine):
                yield b.take(pa.array(self.row[mine]))


def _runs(sizes: list[int], limit: int = 8 << 20) -> Iterator[tuple[int, int]]:
    start, total = 0, 0
    for k, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def grace(batches: Iterator[pa.RecordBatch], spill: str, budget: int, bucket: Callable[[], Folds | Keepers], level: int = 0) -> Iterator[pa.RecordBatch]:
    """Fold records by content, splitting them by hash again and again until a bucket fits ``budget``.

    Copies fold into the bucket as they come, so only different contents fill it.  A bucket that
    overflows goes, with all that follows, to ``FANOUT`` Arrow files under ``spill`` (in the shared
    folder; the task removes them, a retry writes its own), each read back as a stream.  A single
    content never overflows, as no hash would split it.
    """
    table, batches = bucket(), iter(batches)
    for b in batches:
        table.add(b)
        if table.bytes > budget and table.contents > 1:
            break
    else:
        yield from table.finish()
        return
    fs, root = pafs.FileSystem.from_uri(spill)
    root = f"{root}/{uuid.uuid4().hex}"
    fs.create_dir(root, recursive=True)
    sinks: dict[int, tuple] = {}
    held = table.held()
    del table

    def split(b: pa.RecordBatch) -> None:
        part = np.array([xxhash.xxh3_64_intdigest(x, seed=level) % FANOUT for x in b.column(0).cast(pa.binary()).to_pylist()], np.int64)
        for p in np.unique(part).tolist():
            if p not in sinks:
                f = fs.open_output_stream(f"{root}/{p}")
                sinks[p] = (f, pa.ipc.new_stream(f, b.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")))
            sinks[p][1].write_batch(b.take(pa.array(np.flatnonzero(part == p))))

    try:
        for b in held:
            split(b)
        del held
        for b in batches:
            split(b)
        for f, w in sinks.values():
            w.close()
            f.close()
        for p in sinks:
            with fs.open_input_stream(f"{root}/{p}") as f:
                yield from grace(iter(pa.ipc.open_stream(f)), spill, budget, bucket, level + 1)
            fs.delete_file(f"{root}/{p}")
    finally:
        fs.delete_dir(root)


def _fold(budget: int):
    """Of each row (text, doc_id): (local, doc_id); of each content (local, least id, text, rows).

    A task's table of contents is given out and begun anew once it is full, so a content may have
    several local numbers; rows of one number have one content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get()
        base, table, first, rows = own.partitionId() << 40, Table(), np.zeros(0, np.int64), np.zeros(0, np.int64)
        names = ["local", "doc_id", "text", "rows"]

        def done():
            for lo, hi in _runs([len(x) for x in table.contents]):
                least = first[lo:hi]
                texts = pa.array(table.contents[lo:hi], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(base + np.arange(lo, hi)), pa.array(least, mask=least == NO_ID), texts, pa.array(rows[lo:hi])], names)

        for b in batches:
            if not b.num_rows:
                continue
            group = table.add_all(b.column(1))
            more = len(table.contents) - len(first)
            first, rows = np.append(first, np.full(more, NO_ID)), np.append(rows, np.zeros(more, np.int64))
            np.minimum.at(first, group, b.column(0).fill_null(NO_ID).to_numpy())
            np.add.at(rows, group, 1)
            yield pa.RecordBatch.from_arrays([pa.array(base + group), b.column(0), pa.nulls(b.num_rows, pa.string()), pa.nulls(b.num_rows, pa.int64())], names)
            if table.bytes > budget:
                yield from done()
                base += len(table.contents)
                table, first, rows = Table(), np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield from done()

    return run


def exact_duplicates(docs: DataFrame, *, bucket_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, copies) for every row: the smallest id with this very text, and how many.

    Tasks first fold their own copies, so a text crosses the network about once a task, whatever its
    copies; ids meet their text's answer by the number their task gave it.  No task holds all ids of
    a text, and its memory is bounded by ``bucket_bytes`` and the largest text.  Null text equals
    nothing: its row is its own group of one.  Empty text is a text.  Equal rows are copies.  A null
    id never names a group that has another id; it stands as the largest 64-bit number inside.
    """
    spark = docs.sparkSession
    prepare(spark)
    few = as_frame(docs, id_col, text_col)
    folded = settled(few.filter("text IS NOT NULL").mapInArrow(tidied(_fold(bucket_bytes)), "local bigint, doc_id bigint, text string, rows bigint"), "folded")
    spill = new_path(spark, "spill")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return grace((b for b in batches if b.num_rows), spill, bucket_bytes, Folds)

    texts = folded.filter("text IS NOT NULL").select("text", "local", F.coalesce("doc_id", F.lit(int(NO_ID))).alias("id"), "rows")
    answers = texts.repartition("text").mapInArrow(tidied(run), "local bigint, keep_id bigint, copies bigint")
    out = folded.filter("text IS NULL").select("local", "doc_id").join(answers, "local").select("doc_id", "keep_id", "copies")
    alone = few.filter("text IS NULL").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("copies"))
    return out.unionByName(alone)


def drop_exact_duplicates(docs: DataFrame, *, bucket_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row of each text: that of smallest id (null ids last), and of rows
    equal in both that of smallest hash over all columns.

    Tasks first drop the copies they hold themselves, so a text with countless copies crosses the
    network once a task.  Rows with null text all stay.  Every column is carried, whatever its name.
    """
    spark = docs.sparkSession
    prepare(spark)
    t, i, h = fresh(docs, "__text", "__id", "__row")
    rest = [c for c in docs.columns if c != text_col]
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    keyed = docs.select(F.col(f"`{text_col}`").cast("string").alias(t), F.col(f"`{id_col}`").cast("bigint").alias(i), F.xxhash64(*[F.col(f"`{c}`") for c in plain]).alias(h), *[F.col(f"`{c}`") for c in rest])
    live = keyed.filter(F.col(t).isNotNull())
    spill = new_path(spark, "spill")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return grace((b for b in batches if b.num_rows), spill, bucket_bytes, Keepers)

    kept = live.mapInArrow(tidied(run), live.schema).repartition(t).mapInArrow(tidied(run), live.schema)
    back = [F.col(t).cast(docs.schema[c].dataType).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return kept.select(*back).unionByName(docs.filter(F.col(f"`{text_col}`").isNull()))
