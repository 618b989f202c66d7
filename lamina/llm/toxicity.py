"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.shared import as_frame, fresh, offsets_of, prepare, slices, texts_of, tidied

BITS = 20
GRAMS = (4, 5, 6)


def _fold(b: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the two-byte Latin letters; the length stays."""
    b = b.copy()
    b[(b >= 65) & (b <= 90)] += 32
    late = np.zeros(len(b), bool)
    late[1:] = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)
    b[late] += 32
    return b


def sentences(raw: np.ndarray, doc_off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of all sentences, and the index of the first sentence of each document.

    A sentence ends after ``.``, ``!`` or ``?`` before white space, after a line break, and with
    its document.  An empty document has one empty sentence.
    """
    white = (raw == 32) | (raw == 10) | (raw == 13) | (raw == 9)
    end = raw == 10
    stop = (raw == 46) | (raw == 33) | (raw == 63)
    end[:-1] |= stop[:-1] & white[1:]
    cut = np.zeros(len(raw) + 1, bool)
    cut[1:] = end
    cut[doc_off] = True
    cut[len(raw)] = False
    starts = np.flatnonzero(cut)
    # one more start for each empty document
    empty = doc_off[:-1][np.diff(doc_off) == 0]
    starts = np.sort(np.concatenate([starts, empty])) if len(empty) else starts
    if len(empty):
        # several documents may begin at one byte: the last of them owns the text there
        first = np.searchsorted(starts, doc_off[:-1], side="left")
        same = np.concatenate([[0], (np.diff(doc_off[:-1]) == 0).astype(np.int64)])
        run = np.cumsum(same) - np.maximum.accumulate(np.where(same == 0, np.cumsum(same), 0))
        return starts, first + run
    return starts, np.searchsorted(starts, doc_off[:-1])


def _grams(raw: np.ndarray, sent: np.ndarray):
    """(positions, feature) of the byte n-grams that lie within one sentence."""
    b = _fold(raw).astype(np.uint32)
    with np.errstate(over="ignore"):
        for n in GRAMS:
            if len(b) < n:
                continue
            m = len(b) - n + 1
            acc = np.full(m, n, np.uint32)
            for j in range(n):
                acc *= np.uint32(0x01000193)
                acc += b[j : j + m] + np.uint32(1)
            acc ^= acc >> np.uint32(15)
            acc *= np.uint32(0x85EBCA6B)
            acc >>= np.uint32(32 - BITS)
            yield np.flatnonzero(sent[:m] == sent[n - 1 : n - 1 + m]), acc


def _layout(col: pa.Array):
    off = offsets_of(col).astype(np.int64)
    raw = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    starts, first = sentences(raw, off)
    sent = np.zeros(len(raw), np.int32)
    inner = starts[(starts < len(raw))]
    if len(raw):
        np.add.at(sent, inner, 1)
        sent = np.cumsum(sent, dtype=np.int32) - 1
    return raw, off, starts, first, sent


def fit(texts: list[str], labels: np.ndarray, *, features: int = 8192, epochs: int = 150, rate: float = 0.25, decay: float = 1e-4) -> dict:
    """Sentence weights from document labels, by gradient descent on the noisy-or likelihood."""
    docs_n = np.array([int((labels == 0).sum()), int((labels == 1).sum())])
    seen = np.zeros((2, 1 << BITS), np.int32)
    held = []
    for t, y in zip(texts, labels):
        raw, _, starts, _, sent = _layout(pa.array([t]))
        own = [(acc[at], sent[at]) for at, acc in _grams(raw, sent)]
        f = np.concatenate([a for a, _ in own]) if own else np.zeros(0, np.uint32)
        seen[int(y), np.unique(f)] += 1
        held.append(len(starts))
    rate_of = (seen + 0.5) / (docs_n[:, None] + 1)
    both = seen.sum(0)
    odds = np.log(rate_of[1] / (1 - np.minimum(rate_of[1], 0.999))) - np.log(rate_of[0] / (1 - np.minimum(rate_of[0], 0.999)))
    strength = np.where(both >= 3, np.abs(odds) * np.sqrt(both), 0)
    top = np.argsort(-strength, kind="stable")[:features]
    top = top[strength[top] > 0]
    index = np.full(1 << BITS, -1, np.int32)
    index[top] = np.arange(len(top))
    rows, cols, base = [], [], 0
    for t, n in zip(texts, held):
        raw, _, _, _, sent = _layout(pa.array([t]))
        for at, acc in _grams(raw, sent):
            k = index[acc[at]]
            rows.append(sent[at][k >= 0].astype(np.int64) + base)
            cols.append(k[k >= 0])
        base += n
    row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    col = np.concatenate(cols) if cols else np.zeros(0, np.int64)
    bounds = np.concatenate([[0], np.cumsum(held)]).astype(np.int64)[:-1]
    doc = np.repeat(np.arange(len(texts)), held)
    w, bias = np.zeros(len(top)), -4.0
    gw, gb = np.full(len(top), 1e-3), 1e-3
    weight = np.where(labels == 1, 0.5 / max(docs_n[1], 1), 0.5 / max(docs_n[0], 1)) * len(texts)
    for _ in range(epochs):
        z = np.clip(bias + np.bincount(row, w[col], base), -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.exp(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-9)), bounds))
        pull = np.where(labels == 1, -none / np.maximum(1 - none, 1e-9), 1.0) * weight
        g = p * pull[doc]
        dw = np.bincount(col, g[row], len(top)) / len(texts) + decay * w
        db = g.sum() / len(texts)
        gw += dw * dw
        gb += db * db
        w -= rate * dw / np.sqrt(gw)
        bias -= rate * db / np.sqrt(gb)
    table = np.zeros(1 << BITS, np.float32)
    table[top] = w
    return {"bias": float(bias), "at": np.flatnonzero(table).astype(np.int32), "w": table[np.flatnonzero(table)]}


def score(col: pa.Array, model: dict, table: np.ndarray):
    """(document scores, sentence scores, sentence byte starts, first sentence of each, bytes, offsets)."""
    raw, off, starts, first, sent = _layout(col)
    at_byte = np.zeros(len(raw) + 1, np.float32)
    for at, acc in _grams(raw, sent):
        v = table[acc]
        inside = np.zeros(len(v), bool)
        inside[at] = True
        at_byte[: len(v)] += np.where(inside, v, np.float32(0))
    ends = np.append(starts[1:], len(raw))
    # each sentence is summed on its own, so equal texts score equally wherever they stand
    own = np.add.reduceat(at_byte.astype(np.float64), starts) if len(starts) else np.zeros(0)
    z = np.clip(model["bias"] + np.where(ends > starts, own, 0.0), -30, 30)
    p = 1 / (1 + np.exp(-z))
    none = np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), first) if len(first) else np.zeros(0)
    return 1 - np.exp(none), p, starts, first, raw, off


def _table(model: dict) -> np.ndarray:
    table = np.zeros(1 << BITS, np.float32)
    table[model["at"]] = model["w"]
    return table


def train(docs: DataFrame, labels: DataFrame, *, toxic_rows: int = 1500, clean_rows: int = 3000, seed: int = 9, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """A sentence model from at most ``toxic_rows`` + ``clean_rows`` labelled documents.

    The sample is the labelled ids of smallest seeded hash of each class; an id labelled both ways
    counts as toxic, and of several texts with one id the smallest in byte order is taken, so that
    repeated rows make the sample no larger.  The model is fitted in one task; it is some tens of kilobytes.
    """
    prepare(docs.sparkSession)
    lab = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("bigint").alias("l_id")).agg(F.max("toxic").alias("y"))
    h = F.xxhash64(F.lit(seed), F.col("l_id"))
    picked = lab.filter("y = 1").orderBy(h, "l_id").limit(toxic_rows).unionByName(lab.filter("y = 0").orderBy(h, "l_id").limit(clean_rows))
    # at most toxic_rows + clean_rows pairs of numbers
    sample = as_frame(docs, id_col, text_col).filter("text IS NOT NULL").join(F.broadcast(picked), F.col("doc_id") == F.col("l_id"))
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(i, t, y) for b in batches for i, t, y in zip(*(c.to_pylist() for c in b.columns))]
        rows.sort()
        y = np.array([r[2] for r in rows], np.int64)
        if len(rows) and 0 < y.sum() < len(y):
            model = fit([r[1] for r in rows], y)
        else:
            model = {"bias": -30.0, "at": np.zeros(0, np.int32), "w": np.zeros(0, np.float32)}
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    got = sample.select("doc_id", "text", "y").repartition(1).mapInArrow(tidied(run), "model binary").collect()
    return pickle.loads(bytes(got[0].model)) if got else {"bias": -30.0, "at": np.zeros(0, np.int32), "w": np.zeros(0, np.float32)}


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.6, id_col: str = "doc_id", text_col: str = "text", **training) -> DataFrame:
    """(doc_id, score, toxic, sentences) for every row; ``sentences`` locates the offending ones.

    ``score`` is the noisy-or of the sentence scores; each offending sentence comes with its
    character range and score.  Null or empty text scores near 0 with no sentence; equal rows
    score equally; without labels of both classes nothing is toxic.
    """
    spark = docs.sparkSession
    model = train(docs, labels, id_col=id_col, text_col=text_col, **training)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model)
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for b in batches:
            col, scores, found = texts_of(b), [], []
            for lo, hi in slices(col, 1 << 20):
                s, p, starts, first, raw, off = score(col.slice(lo, hi - lo), model, table)
                scores.append(s)
                found += locate(s, p, starts, first, raw, off, threshold)
            s = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array(s >= threshold), pa.array(found, kind)], ["doc_id", "score", "toxic", "sentences"])

    return as_frame(docs, id_col, text_col).mapInArrow(tidied(run), "doc_id bigint, score double, toxic boolean, sentences array<struct<begin:int,end:int,score:double>>")


def locate(s, p, starts, first, raw, off, threshold: float) -> list:
    """Offending sentences of each document as character ranges, in falling score: as many as it takes
    for the noisy-or of all others to fall below the threshold."""
    out: list = [[] for _ in s]
    bad = np.flatnonzero(s >= threshold)
    if not len(bad):
        return out
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    last = np.append(first[1:], len(starts))
    ends = np.append(starts[1:], len(raw))
    for d in bad:
        own = np.arange(first[d], last[d])
        own = own[np.argsort(-p[own], kind="stable")]
        none = np.log1p(-np.minimum(p[own], 1 - 1e-12))
        # what is left over after 1, 2, ... are listed
        rest = 1 - np.exp(np.append(np.cumsum(none[::-1])[::-1][1:], 0))
        hit = own[: 1 + int(np.argmax(rest < threshold))]
        zero = chars[off[d]]
        out[d] = [{"begin": int(chars[starts[k]] - zero), "end": int(chars[ends[k]] - zero), "score": float(p[k])} for k in hit]
    return out


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.6, id_col: str = "doc_id", text_col: str = "text", **training) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns.

    Null and empty texts score as empty sentences and stay; equal rows go or stay together; null ids
    are scored like others; an empty table stays empty, and without labels of both classes all stay.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col, **training)
    (t,) = fresh(docs, "__text")
    keyed = docs.withColumn(t, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model)
        for b in batches:
            col = b.column(b.num_columns - 1)
            keep = [score(col.slice(lo, hi - lo), model, table)[0] < threshold for lo, hi in slices(col, 1 << 20)]
            if keep:
                yield b.filter(pa.array(np.concatenate(keep))).select(range(b.num_columns - 1))

    return keyed.mapInArrow(tidied(run), docs.schema)
