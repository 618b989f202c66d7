"""Vectorised words, shingles and token encoders shared by the operators."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from lamina.llm.shared import cached, offsets_of

TOKENIZERS = "/opt/tokenizers"
VOCAB = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
#: The published split pattern of this family of byte-level vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as these vocabularies' encoders know it.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: ``SPLIT`` with that white space spelt out.
EXACT = SPLIT.replace(r"[^\s\p{L}", rf"[^{WHITE}\p{{L}}").replace(r"\S", rf"[^{WHITE}]").replace(r"\s", rf"[{WHITE}]")
#: Where no token crosses: before white space, and after a run of letters or of digits.
SAFE = rf"(?<=[^{WHITE}])(?=[{WHITE}])|(?<=\p{{L}})(?=\P{{L}})|(?<=\p{{N}})(?=\P{{N}})"


def ranks(path: str) -> dict[bytes, int]:
    def build():
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}

    return cached(("ranks", path), build)


def encoding(path: str):
    def build():
        import tiktoken

        return tiktoken.Encoding("lamina", pat_str=SPLIT, mergeable_ranks=ranks(path), special_tokens={})

    return cached(("encoding", path), build)


def compiled(pattern: str):
    import regex

    return cached(("regex", pattern), lambda: regex.compile(pattern))


def safe_pieces(text: str, limit: int) -> list[str]:
    """``text`` cut where no token can cross, once a piece has ``limit`` characters; joins back exactly.

    A token is white space, or letters, digits or other marks with at most one space before them, so
    none goes on past the end of a word, of letters or of digits: texts of lines, of base64 or in
    scripts without spaces are cut too.  Only one unbroken run of letters, digits or marks stays whole,
    as it is one token candidate.
    """
    out, start, find = [], 0, compiled(SAFE).search
    while len(text) - start > limit:
        m = find(text, start + limit)
        if not m or m.start() >= len(text):
            break
        out.append(text[start : m.start()])
        start = m.start()
    out.append(text[start:])
    return out


def white(raw: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 are part of a white character."""
    out = (raw == 32) | ((raw >= 9) & (raw <= 13))
    lead = np.flatnonzero((raw == 0xC2) | (raw == 0xE1) | (raw == 0xE2) | (raw == 0xE3))
    if len(lead):
        x, y, z = raw[lead].astype(np.int64), raw[np.minimum(lead + 1, len(raw) - 1)].astype(np.int64), raw[np.minimum(lead + 2, len(raw) - 1)].astype(np.int64)
        two = (x == 0xC2) & ((y == 0x85) | (y == 0xA0))
        three = ((x == 0xE1) & (y == 0x9A) & (z == 0x80)) | ((x == 0xE3) & (y == 0x80) & (z == 0x80))
        three |= (x == 0xE2) & (((y == 0x80) & (((z >= 0x80) & (z <= 0x8A)) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))) | ((y == 0x81) & (z == 0x9F)))
        for k, where in ((0, two | three), (1, two | three), (2, three)):
            out[lead[where] + k] = True
    return out


def chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(chunk number of each chunk, chunk offsets of each text, the distinct chunks).

    A text is cut wherever white space follows other characters: no token crosses such a place, and
    what comes after it splits as it would on its own.  So a chunk is a word with the white space
    before it, whatever that is; an empty text has none.
    """
    bounds = offsets_of(texts).astype(np.int64)
    base = int(bounds[0])
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[base : bounds[-1]] if bounds[-1] > base else np.zeros(0, np.uint8)
    bounds = bounds - base
    blank = white(raw)
    cut = np.zeros(len(raw) + 1, bool)
    cut[1:-1] = blank[1:] & ~blank[:-1]
    cut[bounds] = True
    cut[len(raw)] = False
    starts = np.flatnonzero(cut)
    off = np.searchsorted(starts, bounds)
    ends = np.append(starts, len(raw)).astype(np.int32)
    if not len(starts):
        return np.zeros(0, np.int64), off, pa.array([], pa.string())
    coded = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), off, coded.dictionary


def encode_chunks(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """``chunks`` with the ids of each distinct chunk, each encoded once."""
    enc = encoding(path).encode_ordinary
    code, off, distinct = chunks(texts)
    memo = cached(("memo", path), dict)
    if len(memo) > 100_000:
        memo.clear()
    ids = []
    add = ids.append
    for w in distinct.to_pylist():
        got = memo.get(w)
        if got is None:
            got = enc(w)
            if len(w) < 40:
                memo[w] = got
        add(got)
    return code, off, ids


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of lower-cased white-space words, and the word offsets of each text."""
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(texts)))
    off, flat = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
    coded = flat.dictionary_encode()
    words = np.array(coded.dictionary.to_pylist(), dtype=object)
    h = pd.util.hash_array(words, categorize=False) if len(words) else np.zeros(0, np.uint64)
    h = h[coded.indices.to_numpy()] if len(flat) else h
    empty = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, bool)
    if empty.any():
        gone = np.concatenate([[0], np.cumsum(empty)])
        return h[~empty], off - gone[off]
    return h, off


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(h: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``k`` words, and their offsets; a shorter text is one shingle."""
    n = np.diff(off)
    many = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
    start = np.repeat(off[:-1] - out[:-1], many) + np.arange(out[-1])
    short = np.repeat(np.minimum(n, k), many)
    acc = np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            live = short > j
            if live.all():
                acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[start + j]
            else:
                acc[live] = acc[live] * np.uint64(0x9E3779B97F4A7C15) + h[start[live] + j]
    return mix(acc + short.astype(np.uint64)), out
