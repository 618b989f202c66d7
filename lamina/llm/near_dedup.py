"""MinHash near-duplicates with sequential Bayesian verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.shared import as_frame, discard, new_path, prepare, settled, slices, take_rows, texts_of, tidied
from lamina.llm.text import mix, shingles, word_hashes

ROWS, BANDS, SHINGLE = 4, 40, 3
HASHES = ROWS * BANDS
BATCH = 16
#: Members of a bucket that one task compares at once, and partners of a document that share one copy of its set.
BLOCK, PARTNERS = 1024, 1024
#: Bytes of a shingle in a stored set: 48 bits of its hash.
WIDTH = 6


@lru_cache(1)
def _multipliers() -> np.ndarray:
    return np.random.default_rng(10).integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, HASHES) minima of 32-bit hash families over each text's shingles; 2^32-1 for none."""
    out = np.full((len(off) - 1, HASHES), 0xFFFFFFFF, np.uint32)
    live = np.flatnonzero(np.diff(off) > 0)
    if len(live):
        at = off[:-1][live]
        with np.errstate(over="ignore"):
            for k, a in enumerate(_multipliers()):
                x = ((h * a) >> np.uint64(32)).astype(np.uint32)
                out[live, k] = np.minimum.reduceat(x, at)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    key = np.zeros((len(sig), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            key = mix(key * np.uint64(31) + sig[:, r::ROWS].astype(np.uint64) + np.uint64(r + 1))
        return mix(key + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


@lru_cache
def least_matches(threshold: float, miss: float) -> tuple[int, ...]:
    """For each batch, the fewest matches at which P(similarity >= threshold | matches) >= ``miss``.

    With a uniform prior the posterior after m of n matches is Beta(m+1, n-m+1), whose upper tail is
    a binomial sum.
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def _signatures(docs: DataFrame, folder: str) -> DataFrame:
    """A row a text with words; its shingle set goes to a file of the task's own below ``folder``.

    ``node`` numbers the rows, (d1, d2) is a digest of the shingle set, and ``file``, ``at``, ``n`` say
    where the set lies.  Of rows with equal sets a task gives bands, signature and place once.  Rows
    name the file that their own attempt wrote, so attempts never mix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name = f"{own.partitionId()}-{own.taskAttemptId()}.sets"
        seen: set[bytes] = set()
        node, at = own.partitionId() << 40, 0
        with fs.open_output_stream(f"{root}/{name}") as out:
            for b in batches:
                col = texts_of(b)
                for lo, hi in slices(col, 2 << 20):
                    h, off = shingles(*word_hashes(col.slice(lo, hi - lo)), SHINGLE)
                    full = np.flatnonzero(np.diff(off) > 0)
                    if not len(full):
                        continue
                    h >>= np.uint64(16)
                    sets = [np.unique(h[off[k] : off[k + 1]]) for k in full]
                    digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                    new = np.zeros(len(full), bool)
                    for k, d in enumerate(digests):
                        if d not in seen:
                            seen.add(d)
                            new[k] = True
                    some = [s for s, yes in zip(sets, new) if yes]
                    size = np.zeros(len(full), np.int64)
                    size[new] = [len(s) for s in some]
                    place = at + np.concatenate([[0], np.cumsum(size * WIDTH)])
                    for s in some:
                        out.write((s >> np.uint64(16)).astype(np.uint32).tobytes() + (s & np.uint64(0xFFFF)).astype(np.uint16).tobytes())
                    at = int(place[-1])
                    bands, low = pa.nulls(len(full), pa.list_(pa.int64())), pa.nulls(len(full), pa.binary())
                    if some:
                        sig = signature(np.concatenate(some) << np.uint64(16), np.concatenate([[0], np.cumsum(size[new])]))
                        raw = np.ascontiguousarray(sig.astype(np.uint16)).tobytes()
                        where = pa.array(np.where(new, np.cumsum(new) - 1, 0), mask=~new)
                        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1) * BANDS, pa.int32()), pa.array(band_keys(sig).ravel())).take(where)
                        low = pa.Array.from_buffers(pa.binary(), len(sig), [None, pa.py_buffer((np.arange(len(sig) + 1) * HASHES * 2).astype(np.int32)), pa.py_buffer(raw)]).take(where)
                    d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                    mine, rows = pa.array(lo + full), len(full)
                    files = pa.array([f"{folder}/{name}"]).take(pa.array(np.zeros(rows, np.int32), mask=~new))
                    cols = [pa.array(node + np.arange(rows)), b.column(0).take(mine), b.column(2).take(mine), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), bands, low, files, pa.array(place[:-1]), pa.array(size.astype(np.int32))]
                    node += rows
                    yield pa.RecordBatch.from_arrays(cols, ["node", "doc_id", "text_hash", "d1", "d2", "bands", "sig", "file", "at", "n"])

    return docs.mapInArrow(tidied(run), "node bigint, doc_id bigint, text_hash bigint, d1 bigint, d2 bigint, bands array<bigint>, sig binary, file string, at bigint, n int")


def _unpack(col) -> np.ndarray:
    """(rows, HASHES) of a column of signatures."""
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, HASHES)


def _survivors(sig: np.ndarray, x: np.ndarray, y: np.ndarray, need: tuple[int, ...]) -> np.ndarray:
    """Which of the pairs (x, y) of rows of ``sig`` pass every batch of comparisons."""
    live, seen = np.arange(len(x)), np.zeros(len(x), np.int64)
    for k, least in enumerate(need):
        part = slice(k * BATCH, (k + 1) * BATCH)
        seen[live] += (sig[x[live], part] == sig[y[live], part]).sum(1)
        live = live[seen[live] >= least]
        if not len(live):
            break
    return live


def _prune(pairs: DataFrame, sigs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Pairs that survive every batch of signature comparisons."""
    a = sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa"))
    b = sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
    need = least_matches(threshold, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not t.num_rows:
                continue
            n = t.num_rows
            live = pa.array(_survivors(np.concatenate([_unpack(t.column(2)), _unpack(t.column(3))]), np.arange(n), n + np.arange(n), need))
            yield pa.RecordBatch.from_arrays([t.column(0).take(live), t.column(1).take(live)], ["a", "b"])

    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(tidied(run), "a bigint, b bigint").distinct()


def _fetch(routes: DataFrame) -> DataFrame:
    """(a, way, turn, b, items) of (a, way, turn, b, file, at, n): reads the sets where they lie.

    Routes are brought together by stretches of 8 MB of a file and read in order, so each stretch is
    read once, from front to back; texts and unwanted sets are not touched.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f, held, start, out, size = None, None, b"", 0, [], 0

        def done():
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["a", "way", "turn", "b", "items"])

        try:
            for t in batches:
                for a, way, turn, b, file, at, n in zip(*(c.to_pylist() for c in t.columns)):
                    if file != name:
                        if f is not None:
                            f.close()
                        fs, path = pafs.FileSystem.from_uri(file)
                        name, f, held, start = file, fs.open_input_file(path), b"", 0
                    if not (start <= at and at + n * WIDTH <= start + len(held)):
                        f.seek(at)
                        held, start = f.read(max(n * WIDTH, 1 << 20)), at
                    out.append((a, way, turn, b, held[at - start : at - start + n * WIDTH]))
                    size += n * WIDTH
                    if size > 4 << 20:
                        yield done()
                        out, size = [], 0
            if out:
                yield done()
        finally:
            if f is not None:
                f.close()

    near = routes.select("a", "way", "turn", "b", "file", "at", "n").withColumn("stretch", F.shiftright("at", 23))
    near = near.repartition("file", "stretch").sortWithinPartitions("file", "at").drop("stretch")
    return near.mapInArrow(tidied(run), "a bigint, way int, turn int, b bigint, items binary")


def _set_of(raw) -> np.ndarray:
    n = len(raw) // WIDTH
    return np.frombuffer(raw, np.uint32, n).astype(np.uint64) << np.uint64(16) | np.frombuffer(raw, np.uint16, n, 4 * n)


def _verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose shingle sets have at least ``threshold`` Jaccard similarity, computed in full.

    A first member and up to about ``PARTNERS`` of its partners meet in one task; one with more
    partners is sent out as many times, so no task gets all partners of a hot document.  A set
    streams past once a pair, and a task holds two.
    """
    heads = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("ways"))
    tails = pairs.join(heads, "a").select("a", F.pmod(F.xxhash64("b"), F.col("ways")).cast("int").alias("way"), F.lit(1).alias("turn"), "b", F.col("b").alias("node"))
    first = heads.select("a", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("way"), F.lit(0).alias("turn"), F.lit(None).cast("bigint").alias("b"), F.col("a").alias("node"))
    routed = _fetch(tails.unionByName(first).join(sets.select("node", "file", "at", "n"), "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head = None, None
        for t in batches:
            out = []
            for a, way, turn, b, raw in zip(*(t.column(k).to_pylist() for k in range(4)), t.column(4)):
                own = _set_of(raw.as_buffer())
                if turn == 0:
                    key, head = (a, way), own
                    continue
                if key != (a, way):
                    raise RuntimeError("a set is missing in the shared folder")
                both = len(np.intersect1d(head, own, assume_unique=True))
                if both >= threshold * (len(head) + len(own) - both):
                    out.append((a, b))
            x = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].copy()), pa.array(x[:, 1].copy())], ["a", "b"])

    return routed.repartition("a", "way").sortWithinPartitions("a", "way", "turn").mapInArrow(tidied(run), "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest number each node of (a, b) reaches, by alternating star contractions."""
    spark = edges.sparkSession
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    e, before = settled(e, "edges"), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).filter("u != v").distinct()
        old, e = e, settled(small, "edges")
        discard(spark, old)
        # two numbers: the count and a fingerprint of the edges
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    out = settled(e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "groups")
    discard(spark, e)
    return out


def _parts(members: DataFrame, groups: DataFrame | None) -> DataFrame:
    """(node, key, head, part, size) of the members of buckets that still hold several groups."""
    if groups is None:
        at = members.withColumn("part", F.col("node"))
    else:
        at = members.join(groups, "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root")
    mixed = at.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("size")).filter("lo != hi")
    return at.join(mixed.select("key", "size"), "key")


def _nearest_heads(members: DataFrame, groups, sigs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Each set with the smallest number among its buckets' smallest: one pair a set."""
    pairs = members.groupBy("node").agg(F.min("head").alias("a")).filter("node != a").select("a", F.col("node").alias("b"))
    return _prune(pairs, sigs, threshold, miss)


def _all_heads(members: DataFrame, groups, sigs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Each set with the smallest of every bucket where that is of another group."""
    at = _parts(members, groups).select("node", "head", "part")
    if groups is not None:
        at = at.join(groups.select(F.col("node").alias("head"), F.col("root").alias("first")), "head", "left")
        at = at.filter(F.col("part") != F.coalesce("first", "head"))
    return _prune(at.filter("node != head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), sigs, threshold, miss)


def _in_blocks(members: DataFrame, groups, sigs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Every two sets of a bucket that are of different groups, compared where their signatures meet.

    A bucket is split into blocks of about ``BLOCK`` members, by a hash; a task compares two blocks and
    gives only pairs that survive, so no bucket is in one task and its pairs are never written out.
    """
    at = _parts(members, groups).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    at = at.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    at = at.select("node", "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "part")
    need = least_matches(threshold, miss)

    def compare(t: pa.Table) -> pa.RecordBatch:
        key, lo, hi, block, part, node = (t.column(k).to_numpy() for k in range(6))
        sig = _unpack(t.column(6))
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
        first = np.flatnonzero(new)
        end = np.append(first[1:], len(key))[np.cumsum(new) - 1]
        found, x, step = [np.zeros((0, 2), np.int64)], np.arange(len(key)), 0
        while True:
            step += 1
            x = x[x + step < end[x]]
            if not len(x):
                break
            y = x + step
            ask = (part[x] != part[y]) & ((lo[x] == hi[x]) | (block[x] != block[y]))
            live = _survivors(sig, x[ask], y[ask], need)
            found.append(np.stack([node[x[ask][live]], node[y[ask][live]]], 1))
        got = np.sort(np.concatenate(found), 1)
        return pa.RecordBatch.from_arrays([pa.array(got[:, 0].copy()), pa.array(got[:, 1].copy())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows < 4 * BLOCK:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            # the last group may go on in the next batch
            key, lo, hi = (t.column(k).to_numpy() for k in range(3))
            cut = len(key) - int(np.argmax(((key != key[-1]) | (lo != lo[-1]) | (hi != hi[-1]))[::-1])) if (key[0], lo[0], hi[0]) != (key[-1], lo[-1], hi[-1]) else 0
            if cut:
                yield compare(t.slice(0, cut))
            held, rows = t.slice(cut).to_batches(), len(key) - cut
        if rows:
            yield compare(pa.Table.from_batches(held).combine_chunks())

    met = at.join(sigs.select("node", "sig"), "node").select("key", "lo", "hi", "block", "part", "node", "sig")
    return met.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(tidied(run), "a bigint, b bigint").distinct()


def clusters(docs: DataFrame, *, threshold: float = 0.5, miss: float = 0.005, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, root, group_id) of every row that has a near-duplicate; see ``near_groups``.

    Rows are told apart by id and text, so rows that share an id but not a text may be of different
    clusters (``root``), or one of them of none.
    """
    spark = docs.sparkSession
    prepare(spark)
    few = as_frame(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    folder = new_path(spark, "sets")
    sigs = settled(_signatures(few, folder), "signatures")
    # equal sets are one node from here on: that of smallest number, whose task gave its bands
    same = sigs.groupBy("d1", "d2").agg(F.min("node").alias("rep"))
    rows = settled(sigs.join(same, ["d1", "d2"]).select("doc_id", "text_hash", "rep"), "rows")
    live = sigs.filter("bands IS NOT NULL").join(rows.select(F.col("rep").alias("node")).distinct(), "node", "left_semi")
    live = settled(live.select("node", "bands", "sig", "file", "at", "n"), "nodes")
    discard(spark, sigs)
    keyed = live.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("tail")).filter("head != tail")
    members = settled(keyed.join(shared.select("key", "head"), "key").select("node", "key", "head"), "members")
    cand = settled(live.drop("bands").join(members.select("node").distinct(), "node", "left_semi"), "candidates")
    discard(spark, live)
    groups, met = None, []
    for step in (_nearest_heads, _all_heads, _in_blocks):
        pairs = step(members, groups, cand, threshold, miss)
        for m in met:
            pairs = pairs.join(m, ["a", "b"], "left_anti")
        pairs = settled(pairs, "survivors")
        met.append(pairs)
        if pairs.isEmpty():
            continue
        found = _verify(pairs, cand, threshold)
        if groups is not None:
            found = found.unionByName(groups.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
        old, groups = groups, components(found)
        discard(spark, old)
    discard(spark, members, cand, folder, *met)
    if groups is not None:
        rows_ = rows.join(groups, F.col("rep") == F.col("node"), "left").select("doc_id", "text_hash", F.coalesce("root", "rep").alias("root"))
    else:
        rows_ = rows.select("doc_id", "text_hash", F.col("rep").alias("root"))
    several = rows_.groupBy("root").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("size")).filter("size > 1").drop("size")
    out = settled(rows_.join(several, "root").select("doc_id", "text_hash", "root", "group_id"), "clusters")
    discard(spark, rows, groups)
    return out


def near_groups(docs: DataFrame, *, threshold: float = 0.5, miss: float = 0.005, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_id) of the documents with a near-duplicate; ``group_id`` is the smallest id.

    Similarity is the Jaccard index of sets of three lower-cased words.  Texts with equal sets are
    one node from the start.  Nodes that agree in any of 40 bands of 4 minima are candidates.  First
    each meets the smallest node of its buckets, then the smallest of each bucket, then what still
    lies in separate groups of a bucket meets in blocks: every candidate pair is either compared or
    already in one group, and nothing is capped.  A pair is dropped once the posterior of reaching
    ``threshold`` falls below ``miss``; survivors are compared in full.  Groups are the connected parts.

    The plan is the same at every size: a first pass writes each set once to the shared folder, and
    survivors' sets are read from there by place, so no text is shuffled.  Rows with null id, or null
    or wordless text, join no group; equal rows are copies of each other; an id with several texts has
    a row for each group that one of them is in; texts of fewer than three words are one shingle.
    """
    return clusters(docs, threshold=threshold, miss=miss, id_col=id_col, text_col=text_col).select("doc_id", "group_id").distinct()


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, one of each near-duplicate group: that of smallest id.

    Of several rows with that id, the one of smallest text hash stays; of rows equal in both, any one.
    Rows in no group all stay, null ids and texts among them; every column is carried.
    """
    spark = docs.sparkSession
    found = clusters(docs, id_col=id_col, text_col=text_col, **how)
    best = found.filter("doc_id = group_id").groupBy("root").agg(F.min("text_hash").alias("best"))
    keys = found.groupBy("doc_id", "text_hash", "root", "group_id").agg(F.count("*").alias("rows")).join(best, "root")
    keys = keys.withColumn("take", ((F.col("doc_id") == F.col("group_id")) & (F.col("text_hash") == F.col("best"))).cast("bigint"))
    keys = settled(keys.select("doc_id", "text_hash", "take", "rows"), "keys")
    discard(spark, found)
    return take_rows(docs, keys, id_col, text_col, others=True)
