"""Mixing sources to target weights by subset sums over exact token lengths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.llm.shared import as_frame, prepare, settled, slices, take_rows, texts_of, tidied
from lamina.llm.text import VOCAB, encode_chunks

SEED = 20
#: Documents of one source and length that one task ranks.
CELL = 4096
#: Of all tokens, the share that the registered mixture asks for, with equal target weights.
KEEP = 0.7


def token_lengths(docs: DataFrame, *, vocab: str = VOCAB, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, n_tokens, text_hash); each distinct chunk of a batch is encoded once."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col, out = texts_of(b), []
            for lo, hi in slices(col):
                code, off, ids = encode_chunks(col.slice(lo, hi - lo), vocab)
                total = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))[code])])
                out.append(total[off[1:]] - total[off[:-1]])
            n = np.concatenate(out) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), b.column(3)], ["doc_id", "source", "n_tokens", "text_hash"])

    few = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("text_hash"),
    )
    return few.mapInArrow(tidied(run), "doc_id bigint, source string, n_tokens bigint, text_hash bigint")


def _knapsack(length: np.ndarray, spare: np.ndarray, budget: int, order: np.ndarray) -> np.ndarray:
    """Of ``spare`` items of each length, those whose sum is the largest that ``budget`` allows.

    Counts are split into powers of two; the bits of an integer are the sums in reach.
    """
    take, items, mask, sums = np.zeros_like(spare), [], (1 << (budget + 1)) - 1, [1]
    for k in order:
        if not 0 < length[k] <= budget:
            continue
        rest, size = int(min(spare[k], budget // length[k])), 1
        while rest > 0 and not sums[-1] >> budget & 1:
            n = min(size, rest)
            items.append((int(k), n))
            sums.append((sums[-1] | sums[-1] << n * int(length[k])) & mask)
            rest, size = rest - n, size * 2
    at = sums[-1].bit_length() - 1
    for (k, n), before in zip(reversed(items), reversed(sums[:-1])):
        if not before >> at & 1:
            take[k] += n
            at -= n * int(length[k])
    return take


def fit_counts(length: np.ndarray, count: np.ndarray, budget: int, seed: int = SEED) -> np.ndarray:
    """How many documents of each length to take so that their tokens are the most that fit ``budget``.

    Every length first gives its share rounded down; lengths then give one more, in order of the
    fraction they lost, until what is left fits ``4 x`` the longest remaining length; a bounded
    knapsack fits that remainder.  Where no subset of what remains does exactly, documents of the
    shortest lengths are put back, twice as many lengths and documents each time, and fitted anew, until
    a subset is exact or every document has been put back, when the knapsack covers all.  Lengths and
    budget are first divided by what divides all lengths.  Zero-length documents cost nothing and are
    taken whole.
    """
    order = np.argsort(length, kind="stable")
    length, count = length[order].astype(np.int64), count[order].astype(np.int64)
    common = max(1, int(np.gcd.reduce(length))) if len(length) else 1
    length, budget = length // common, max(0, int(budget)) // common
    total = int((length * count).sum())
    if total <= budget:
        take = count.copy()
    else:
        share = count * (budget / total)
        take = np.minimum(np.floor(share).astype(np.int64), count)
        take[length == 0] = count[length == 0]
        while int((length * take).sum()) > budget:  # rounding of a float share
            take[np.flatnonzero((take > 0) & (length > 0))[-1]] -= 1
        left = budget - int((length * take).sum())
        most = 4 * int(length[count > take].max(initial=0))
        rng = np.random.default_rng(seed)
        for k in sorted(range(len(length)), key=lambda k: (-(share[k] - np.floor(share[k])), rng.random())):
            if left <= most:
                break
            if count[k] > take[k] and 0 < length[k] <= left:
                take[k] += 1
                left -= int(length[k])
        while left > most and (k := next((k for k in range(len(length)) if count[k] > take[k] and 0 < length[k] <= left), None)) is not None:
            n = min(int(count[k] - take[k]), (left - most) // int(length[k]) + 1, left // int(length[k]))
            take[k] += n
            left -= n * int(length[k])
        mixed, live = rng.permutation(len(length)), np.flatnonzero(length > 0)
        base, best, lengths, each = take.copy(), None, 8, 1
        while True:
            room = budget - int((length * base).sum())
            got = base + _knapsack(length, count - base, room, mixed)
            if best is None or (length * got).sum() > (length * best).sum():
                best = got
            back = np.minimum(take[live[:lengths]], each)
            if (length * best).sum() == budget or not base[live].any():
                break
            base = take.copy()
            base[live[:lengths]] -= back
            lengths, each = lengths * 2, each * 2
        take = best
    out = np.empty_like(take)
    out[order] = take
    return out


def quotas(rows: Mapping[str | None, int], share: Mapping[str | None, float], total: float) -> dict[str | None, int]:
    """Tokens to take from each source: a source that falls short of its share of ``total`` gives all
    it has, and what it leaves open is shared out again among the others by their weights."""
    out, left = dict.fromkeys(share, 0), float(total)
    live = {s for s, w in share.items() if w > 0 and rows[s] > 0}
    while live:
        unit = left / sum(share[s] for s in live)
        short = {s for s in live if rows[s] <= unit * share[s]}
        out |= {s: rows[s] for s in short} if short else {s: min(rows[s], int(unit * share[s] * (1 + 1e-12) + 1e-6)) for s in live}
        if not short:
            break
        left, live = left - sum(rows[s] for s in short), live - short
    return out


def plan_mix(lengths: DataFrame, weights: Mapping[str, float] | None = None, total_tokens: int | None = None, seed: int = SEED, keep: float | None = None) -> DataFrame:
    """(source, n_tokens, take, count): the histogram of lengths with the number to take from each.

    ``weights`` maps a source to its share (None: equal shares; sources left out get none).
    ``total_tokens`` or ``keep``, a share of all tokens there are, is what ``quotas`` shares out.
    Both None: the most that meets every share without repeating a document.
    """
    hist = lengths.groupBy("source", "n_tokens").agg(F.count("*").alias("count"))
    totals = hist.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("count")).alias("tokens"))
    # a row a source: as many as there are weights
    rows = {r.source: int(r.tokens) for r in totals.collect()}
    share = {s: 1.0 for s in rows} if weights is None else {s: float(weights.get(s, 0)) for s in rows}
    whole = sum(w for s, w in share.items() if rows[s] > 0) or 1.0
    share = {s: w / whole for s, w in share.items()}
    feasible = min((rows[s] / w for s, w in share.items() if w > 0 and rows[s] > 0), default=0)
    if total_tokens is None and keep is not None:
        total_tokens = round(keep * sum(rows.values()))
    quota = quotas(rows, share, feasible if total_tokens is None else total_tokens)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        s = frame["source"].iloc[0]
        s = None if s is None or s != s else s
        own = int.from_bytes(hashlib.blake2b(f"{seed}/{s}".encode(), digest_size=6).digest(), "big")
        frame = frame.sort_values("n_tokens")
        if not share.get(s):
            return frame.assign(take=0)[["source", "n_tokens", "take", "count"]]
        take = fit_counts(frame["n_tokens"].to_numpy(), frame["count"].to_numpy(), quota[s], own)
        return frame.assign(take=take)[["source", "n_tokens", "take", "count"]]

    return hist.groupBy("source").applyInPandas(fit, "source string, n_tokens bigint, take bigint, count bigint")


def _chosen(docs: DataFrame, weights, total_tokens, seed: int, keep: float | None, **cols) -> DataFrame:
    """Rows of ``token_lengths`` with ``kept``: those of smallest seeded hash in each source and length.

    Where all or none of a length are taken nothing is ranked.  Else the hashes are cut into cells of
    about ``CELL`` rows: cells below the cut stay whole, and only the one that it falls into is ranked.
    """
    lengths = settled(token_lengths(docs, **cols), "lengths")
    plan = settled(plan_mix(lengths, weights, total_tokens, seed, keep), "plan")
    p = plan.select(F.col("source").alias("p_source"), F.col("n_tokens").alias("p_tokens"), "take", "count")
    h = lengths.withColumn("h", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_hash")))
    some = h.join(p, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("n_tokens") == F.col("p_tokens"))).drop("p_source", "p_tokens")
    cut = (F.col("take") > 0) & (F.col("take") < F.col("count"))
    cells = F.ceil(F.col("count") / CELL)
    cell = F.when(cut, F.floor((F.col("h") / 2.0**64 + 0.5) * cells)).otherwise(F.lit(0))
    some = some.withColumn("cell", cell.cast("bigint"))
    key = ["source", "n_tokens", "cell"]
    size = some.filter(cut).groupBy(*key).agg(F.count("*").alias("rows"))
    upto = F.sum("rows").over(Window.partitionBy("source", "n_tokens").orderBy("cell"))
    size = size.select(*[F.col(c).alias("c_" + c) for c in key], (upto - F.col("rows")).alias("below"), upto.alias("upto"))
    on = F.col("source").eqNullSafe(F.col("c_source")) & (F.col("n_tokens") == F.col("c_n_tokens")) & (F.col("cell") == F.col("c_cell"))
    some = some.join(size, on, "left")
    hit = cut & (F.col("below") < F.col("take")) & (F.col("take") < F.col("upto"))
    sure = F.when(cut, F.col("upto") <= F.col("take")).otherwise(F.col("take") > 0)
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("h", "doc_id", "text_hash"))
    ranked = some.filter(hit).withColumn("kept", nth + F.col("below") <= F.col("take"))
    out = some.filter(~F.coalesce(hit, F.lit(False))).withColumn("kept", sure).unionByName(ranked)
    return out.select("doc_id", "source", "n_tokens", "text_hash", "kept")


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, total_tokens: int | None = None, *, keep: float | None = None, seed: int = SEED, vocab: str = VOCAB, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, n_tokens) of the documents that the mixture takes.

    Token lengths are exact for every document.  Of the documents of one source and length, those
    with the smallest seeded hash are taken, so the choice depends on no partitioning.  Null text
    has length 0; a null source is a source of its own; equal rows count apart; a source of no
    tokens takes no part in the shares and its zero-length documents cost nothing.
    """
    got = _chosen(docs, weights, total_tokens, seed, keep, vocab=vocab, id_col=id_col, text_col=text_col, source_col=source_col)
    return got.filter("kept").select("doc_id", "source", "n_tokens")


def mix_rows(docs: DataFrame, weights: Mapping[str, float] | None = None, total_tokens: int | None = None, *, keep: float | None = None, seed: int = SEED, vocab: str = VOCAB, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows that ``mix`` takes, with all their columns; rows alike in id and text stand for each other.

    Null texts have length 0, null ids and sources are kept as such, equal rows count apart, an empty
    table stays empty, and columns may have any names.
    """
    got = _chosen(docs, weights, total_tokens, seed, keep, vocab=vocab, id_col=id_col, text_col=text_col, source_col=source_col)
    keys = got.groupBy("doc_id", "text_hash").agg(F.sum(F.col("kept").cast("bigint")).alias("take"), F.count("*").alias("rows"))
    return take_rows(docs, settled(keys, "keys"), id_col, text_col)
