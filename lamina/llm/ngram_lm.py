"""Unbounded n-gram scoring over sharded corpus suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.llm.shared import as_frame, prepare, settled, slices, texts_of, tidied
from lamina.llm.text import mix, word_hashes

SHARD_BYTES = 12 << 20


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Positions of ``ids`` in the order of the suffixes that start there; a suffix's end sorts first.

    Prefix doubling; after each doubling only suffixes whose rank still ties are sorted again.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, np.int32)
    # two words in one key start the doubling at length 2
    key = ids.astype(np.int64) * (int(ids.max()) + 2)
    key[:-1] += ids[1:] + 1
    sa = np.argsort(key, kind="stable").astype(np.int32)
    key = key[sa]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    del key
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), np.int32(0)))
    size = 2
    # places in sa whose rank another suffix shares
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(tied):
        pos = sa[tied]
        ahead = pos + size
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        order = np.lexsort((second, rank[pos]))
        pos, second = pos[order], second[order]
        group = rank[pos]
        sa[tied] = pos
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        first = np.maximum.accumulate(np.where(new, np.arange(len(pos)), 0))
        rank[pos] = tied[first]
        tied = tied[~(new & np.append(new[1:], True))]
        size *= 2
    return sa


class Shard:
    """A suffix array over reversed text, so that a context grows leftwards as a prefix does."""

    def __init__(self, hashes: np.ndarray, off: np.ndarray):
        self.words, ids = np.unique(hashes, return_inverse=True)
        # 0 ends each document: no context crosses it
        n = np.diff(off)
        at = np.arange(len(hashes)) + np.repeat(np.arange(len(n)), n)
        flat = np.zeros(len(hashes) + len(n), np.int32)
        flat[at] = ids + 1
        del at, ids
        self.text = flat[::-1].copy()
        self.sa = suffix_array(self.text)
        self.tokens = len(hashes)

    def counts(self, q: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, positions, counts): occurrences of the k words that end at each position of ``q``,
        for k = 1, 2, ... as long as they occur.  ``begin`` is where each position's text begins."""
        at = np.searchsorted(self.words, q)
        code = np.where((at < len(self.words)) & (self.words[np.minimum(at, max(len(self.words) - 1, 0))] == q), at + 1, -1) if len(self.words) else np.full(len(q), -1)
        pos = np.flatnonzero(code > 0)
        lo, hi = np.zeros(len(pos), np.int64), np.full(len(pos), len(self.sa), np.int64)
        k = 0
        while len(pos):
            want = code[pos - k]
            left = self._bound(lo, hi, k, want)
            right = self._bound(left, hi, k, want + 1)
            live = right > left
            pos, lo, hi = pos[live], left[live], right[live]
            k += 1
            if len(pos):
                yield k, pos, hi - lo
            more = (pos - k >= begin[pos]) & (code[np.maximum(pos - k, 0)] > 0)
            pos, lo, hi = pos[more], lo[more], hi[more]

    def _bound(self, lo: np.ndarray, hi: np.ndarray, k: int, want: np.ndarray) -> np.ndarray:
        """First place in [lo, hi) whose suffix has a k-th word not below ``want``."""
        lo, hi, n = lo.copy(), hi.copy(), len(self.text)
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi) >> 1
            at = self.sa[np.minimum(mid, n - 1)] + k
            below = open_ & (np.where(at < n, self.text[np.minimum(at, n - 1)], -1) < want)
            lo = np.where(below, mid + 1, lo)
            hi = np.where(open_ & ~below, mid, hi)


def lm_scores(corpus: DataFrame, queries: DataFrame, *, smoothing: float = 1.0, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(item_id, words, logprob, perplexity, mean_context, longest_context) for every query row.

    The corpus is cut into shards of about ``shard_bytes``; each task builds a suffix array over its
    own and searches it for every context of every query word.  Counts of equal contexts are summed
    over the shards.  The probability of a word mixes all orders up to the longest context the whole
    corpus has: p_k = (c(context_k, word) + s * p_(k-1)) / (c(context_k) + s), from p_0 uniform over
    the words of the queries plus one for all others, so unseen words keep some probability.

    Queries are a bounded table: they are collected to the driver and sent to every task, in blocks of
    64 MB of text.  Every block builds the shards' suffix arrays anew, so the cost grows with the
    number of blocks; scores do not depend on it.

    Words are lower-cased and split at white space; no context is cut short.  Null or empty query
    text gives 0 words and null scores; null or empty corpus rows hold no words; equal rows count
    and are scored apart; an empty corpus leaves p_0.
    """
    spark = queries.sparkSession
    prepare(spark)
    # the queries travel to every task: they are a benchmark, whose size does not follow the corpus
    rows = as_frame(queries, query_id, query_text).orderBy("doc_id", "text").collect()
    limit = 64 << 20
    size = sum(len(r.text or "") for r in rows)
    blocks, held, bytes_ = [], [], 0
    for n, r in enumerate(rows):
        held.append((n, r.doc_id, r.text or ""))
        bytes_ += len(r.text or "")
        if bytes_ > limit:
            blocks, held, bytes_ = [*blocks, held], [], 0
    blocks = [*blocks, held] if held or not blocks else blocks
    out = None
    vocabulary = len(np.unique(word_hashes(pa.array([r.text or "" for r in rows], pa.string()))[0])) + 1 if size else 1
    for block in blocks:
        got = _block(corpus, block, smoothing, shard_bytes, id_col, text_col, vocabulary)
        out = got if out is None else out.unionByName(got)
    return out


def _block(corpus: DataFrame, block: list, smoothing: float, shard_bytes: int, id_col: str, text_col: str, vocabulary: int) -> DataFrame:
    spark = corpus.sparkSession
    h, off = word_hashes(pa.array([t for _, _, t in block], pa.string()))
    begin = np.repeat(off[:-1], np.diff(off))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sizes, held = [], [], 0

        def search():
            shard = Shard(np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]))
            hashes.clear()
            sizes.clear()
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int32()), pa.array([shard.tokens], pa.int64())], ["pos", "k", "count"])
            for k, pos, count in shard.counts(h, begin):
                yield pa.RecordBatch.from_arrays([pa.array(pos.astype(np.int32)), pa.array(np.full(len(pos), k), pa.int32()), pa.array(count)], ["pos", "k", "count"])

        for b in batches:
            col = texts_of(b)
            for lo, hi in slices(col):
                x, o = word_hashes(col.slice(lo, hi - lo))
                hashes.append(x)
                sizes.append(np.diff(o))
                held += len(x) * 6
            if held >= shard_bytes:
                yield from search()
                held = 0
        if hashes:
            yield from search()

    found = as_frame(corpus, id_col, text_col).select("doc_id", "text").filter("text IS NOT NULL").mapInArrow(tidied(run), "pos int, k int, count bigint")
    counts = settled(found.groupBy("pos", "k").agg(F.sum("count").alias("count")), "counts")
    # c(context of k-1 words before pos, word at pos) is c(k words ending at pos); its context ends at pos - 1
    joint = counts.filter("k > 0").withColumn("order", F.col("k") - 1)
    context = counts.filter("k > 0").select((F.col("pos") + 1).alias("pos"), F.col("k").alias("order"), F.col("count").alias("context"))
    total = counts.filter("k = 0").select(F.col("count").alias("total"))
    items = spark.createDataFrame([(n, i, int(off[k]), int(off[k + 1])) for k, (n, i, _) in enumerate(block)], "n bigint, item_id bigint, lo bigint, hi bigint")
    places = F.when(F.col("hi") > F.col("lo"), F.sequence(F.col("lo"), F.col("hi") - 1))
    words = items.select("n", "item_id", "lo", F.explode_outer(places).alias("place")).select("n", "item_id", "lo", F.col("place").cast("int").alias("pos"))
    # orders of a word: 0 with the corpus total as context, then each context found before it in its text
    base = words.join(F.broadcast(total), how="left").select("n", "item_id", "pos", F.lit(0).alias("order"), F.coalesce("total", F.lit(0)).alias("context"))
    longer = words.join(context, "pos").filter(F.col("pos") - F.col("order") >= F.col("lo")).select("n", "item_id", "pos", "order", "context")
    orders = base.unionByName(longer).join(joint.select("pos", "order", F.col("count").alias("joint")), ["pos", "order"], "left")
    s, p0 = F.lit(float(smoothing)), F.lit(1.0 / vocabulary)
    chain = orders.groupBy("n", "item_id", "pos").agg(F.array_sort(F.collect_list(F.struct("order", "context", F.coalesce("joint", F.lit(0)).alias("joint")))).alias("chain"))
    p = F.aggregate("chain", p0, lambda acc, x: (x["joint"] + s * acc) / (x["context"] + s))
    scored = chain.select("n", "item_id", "pos", F.log(p).alias("lp"), (F.size("chain") - 1).alias("used"))
    live = F.col("pos").isNotNull()
    agg = scored.groupBy("n", "item_id").agg(
        F.count("pos").alias("words"),
        F.sum(F.when(live, F.col("lp"))).alias("logprob"),
        F.avg(F.when(live, F.col("used"))).alias("mean_context"),
        F.max(F.when(live, F.col("used"))).cast("bigint").alias("longest_context"),
    )
    return agg.select("item_id", "words", "logprob", F.exp(-F.col("logprob") / F.col("words")).alias("perplexity"), "mean_context", "longest_context")
