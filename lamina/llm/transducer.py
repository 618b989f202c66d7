"""BPE through a minimal acyclic transducer of frequent words."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.shared import as_frame, cached, discard, new_path, offsets_of, prepare, settled, slices, texts_of, tidied
from lamina.llm.text import EXACT, VOCAB, chunks, compiled, encoding, ranks

WORDS = 65_536
#: Bytes of the longest word that is compiled, and up to which a chunk is counted unsplit.
LONGEST, WHOLE = 256, 40
#: Bytes from which a word is merged by a heap of its own.
HEAP = 96
_MUL = np.uint64(0x9E3779B97F4A7C15)


def minimal_automaton(words: Iterable[bytes]):
    """(edge keys, targets, skips, final flags, words in order) of the smallest acyclic automaton.

    Words are added in byte order; states that can change no more are merged with equal ones, so
    common endings are stored once.  ``skip`` on an edge is how many words come before those through
    it: the skips along a word's path add up to its number, which is the transducer's output.
    """
    edges: list[dict[int, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    free: list[int] = []
    path: list[tuple[int, int, int]] = []  # (state, byte, child) not yet merged

    def settle(down_to: int) -> None:
        while len(path) > down_to:
            state, byte, child = path.pop()
            sig = (final[child], tuple(edges[child].items()))
            old = known.get(sig)
            if old is None:
                known[sig] = child
            else:
                edges[state][byte] = old
                edges[child] = {}
                free.append(child)

    last, order = b"", []
    for w in sorted(set(words)):
        if not w:
            continue
        order.append(w)
        same = 0
        top = min(len(w), len(last))
        while same < top and w[same] == last[same]:
            same += 1
        settle(same)
        state = path[-1][2] if path else 0
        for byte in w[same:]:
            if free:
                child = free.pop()
                edges[child], final[child] = {}, False
            else:
                child = len(edges)
                edges.append({})
                final.append(False)
            edges[state][byte] = child
            path.append((state, byte, child))
            state = child
        final[state] = True
        last = w
    settle(0)
    below: dict[int, int] = {}
    stack = [0]
    while stack:
        s = stack[-1]
        todo = [c for c in edges[s].values() if c not in below]
        if todo:
            stack += todo
        else:
            below[s] = final[s] + sum(below[c] for c in edges[s].values())
            stack.pop()
    number = {s: n for n, s in enumerate(sorted(below, key=lambda s: (s != 0, s)))}
    keys, targets, skips = [], [], []
    flags = np.zeros(len(number), np.uint8)
    for s, n in number.items():
        flags[n] = final[s]
        skip = int(final[s])
        for byte, c in sorted(edges[s].items()):
            keys.append(n * 256 + byte)
            targets.append(number[c])
            skips.append(skip)
            skip += below[c]
    at = np.argsort(np.array(keys, np.int64), kind="stable") if keys else np.zeros(0, np.int64)
    return np.array(keys, np.int64)[at], np.array(targets, np.int32)[at], np.array(skips, np.int32)[at], flags, order


def _pair_table(table: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """An open-addressing table of (left id, right id) -> rank of the merge."""
    keys, vals = [], []
    for t, r in table.items():
        for k in range(1, len(t)):
            a, b = table.get(t[:k]), table.get(t[k:])
            if a is not None and b is not None:
                keys.append(a << 32 | b)
                vals.append(r)
    bits = max(4, (4 * len(keys)).bit_length())
    slots, ranks_ = np.full(1 << bits, -1, np.int64), np.full(1 << bits, np.iinfo(np.int32).max, np.int32)
    k, v = np.array(keys, np.int64), np.array(vals, np.int32)
    with np.errstate(over="ignore"):
        at = ((k.astype(np.uint64) * _MUL) >> np.uint64(64 - bits)).astype(np.int64)
    todo = np.arange(len(k))
    while len(todo):
        empty = slots[at[todo]] < 0
        slots[at[todo][empty]] = k[todo][empty]
        won = slots[at[todo]] == k[todo]
        ranks_[at[todo][won]] = v[todo][won]
        todo = todo[~won]
        at[todo] = (at[todo] + 1) & ((1 << bits) - 1)
    return slots, ranks_


def compile_lexicon(words: Iterable[bytes], vocab: str, path: str) -> None:
    """Write the transducer over ``words`` and the vocabulary, its id outputs and the merge table to
    one file that readers map into memory."""
    table, enc = ranks(vocab), encoding(vocab)
    keys, targets, skips, flags, order = minimal_automaton([*words, *table])
    out = [[table[w]] if w in table else enc.encode_ordinary(w.decode()) for w in order]
    slots, pair_ranks = _pair_table(table)
    by_id = sorted(table.items(), key=lambda x: x[1])
    top = by_id[-1][1] + 1
    lens = np.zeros(top, np.int64)
    lens[[r for _, r in by_id]] = [len(t) for t, _ in by_id]
    byte_id = np.array([table[bytes([b])] for b in range(256)], np.int32)
    arrays = {
        "keys": keys, "targets": targets, "skips": skips, "final": flags,
        "out_off": np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64), "out_ids": np.array([i for x in out for i in x], np.int32),
        "slots": slots, "ranks": pair_ranks, "tok_off": np.concatenate([[0], np.cumsum(lens)]), "tok": np.frombuffer(b"".join(t for t, _ in by_id), np.uint8), "byte_id": byte_id,
    }
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = [str(a.dtype), at, len(a)]
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode().ljust(4096)
    fs, p = pafs.FileSystem.from_uri(path)
    fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(p) as f:
        f.write(text)
        for a in arrays.values():
            raw = a.tobytes()
            f.write(raw + bytes(-len(raw) % 64))


class Lexicon:
    """A compiled lexicon, mapped where the shared folder is a file system, else read."""

    def __init__(self, path: str):
        self.path = path
        url = urlparse(path)
        if url.scheme in ("", "file"):
            raw = np.memmap(url.path, np.uint8, "r")
        else:
            fs, p = pafs.FileSystem.from_uri(path)
            with fs.open_input_file(p) as f:
                raw = np.frombuffer(f.read(), np.uint8)
        for name, (kind, at, n) in json.loads(bytes(raw[:4096])).items():
            start = 4096 + at
            setattr(self, name, np.frombuffer(raw, np.dtype(kind), n, start))

    def find(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The number of each word, -1 where the lexicon has none; all words step together."""
        out = np.full(len(off) - 1, -1, np.int64)
        word = np.flatnonzero(np.diff(off) > 0)
        state, num = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
        j, size = 0, np.diff(off)
        while len(word):
            key = state * 256 + raw[off[word] + j]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            word, at, num = word[ok], at[ok], num[ok]
            state, num = self.targets[at].astype(np.int64), num + self.skips[at]
            j += 1
            end = size[word] == j
            good = end & (self.final[state] == 1)
            out[word[good]] = num[good]
            word, state, num = word[~end], state[~end], num[~end]
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        bits = (len(self.slots) - 1).bit_length()
        with np.errstate(over="ignore"):
            at = ((key.astype(np.uint64) * _MUL) >> np.uint64(64 - bits)).astype(np.int64)
        got = self.slots[at]
        out = np.where(got == key, self.ranks[at], np.iinfo(np.int32).max)
        more = np.flatnonzero((got != key) & (got >= 0))
        while len(more):
            at[more] = (at[more] + 1) & (len(self.slots) - 1)
            got = self.slots[at[more]]
            hit = got == key[more]
            out[more[hit]] = self.ranks[at[more[hit]]]
            more = more[~hit & (got >= 0)]
        return out

    def merge(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words by merging: in each word, the first of its lowest-ranked pairs at a
        time, until no pair is in the table.  All words take their next merge together."""
        n = len(off) - 1
        sym = self.byte_id[raw[off[0] : off[-1]]]
        word = np.repeat(np.arange(n), np.diff(off))
        none = np.iinfo(np.int32).max
        done_sym, done_word = [], []
        pair = np.full(len(sym), none, np.int32)
        if len(sym) > 1:
            pair[:-1] = np.where(word[:-1] == word[1:], self._rank(sym[:-1], sym[1:]), none)
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(pair, first)
            size = np.diff(np.append(first, len(sym)))
            over = np.repeat(best == none, size)
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                keep = ~over
                sym, word, pair = sym[keep], word[keep], pair[keep]
                if not len(sym):
                    break
                best, size = best[best != none], size[best != none]
            hit = np.flatnonzero(pair == np.repeat(best, size))
            hit = hit[np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])]
            sym[hit] = pair[hit]  # an id is its rank
            gone = np.ones(len(sym), bool)
            gone[hit + 1] = False
            at = np.cumsum(gone) - 1
            sym, word, pair = sym[gone], word[gone], pair[gone]
            here = at[hit]
            nxt = np.minimum(here + 1, len(sym) - 1)
            pair[here] = np.where((here + 1 < len(sym)) & (word[nxt] == word[here]), self._rank(sym[here], sym[nxt]), none)
            prev = here[here > 0]
            prev = prev[word[prev - 1] == word[prev]] - 1
            pair[prev] = self._rank(sym[prev], sym[prev + 1])
        sym = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int32)
        word = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
        return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=n)

    def outputs(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.out_off[number + 1] - self.out_off[number]
        return self.out_ids[_ranges(self.out_off[number], size)], size

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a run of ids."""
        start = self.tok_off[ids]
        return self.tok[_ranges(start, self.tok_off[ids + 1] - start)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts: distinct chunks pass the transducer; those it lacks are split into
        words, which pass it again, and what is still unseen is merged."""
        code, off, distinct = chunks(texts)
        ids, size = self._chunks(distinct)
        start = np.cumsum(size) - size
        n = size[code]
        total = np.concatenate([[0], np.cumsum(n)])
        return ids[_ranges(start[code], n)], total[off]

    def _look(self, words: pa.Array, fallback) -> tuple[np.ndarray, np.ndarray]:
        off = offsets_of(words).astype(np.int64)
        raw = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] is not None else np.zeros(0, np.uint8)
        number = self.find(raw, off)
        seen, unseen = np.flatnonzero(number >= 0), np.flatnonzero((number < 0) & (np.diff(off) > 0))
        a_ids, a_size = self.outputs(number[seen])
        b_ids, b_size = fallback(words.take(pa.array(unseen))) if len(unseen) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        size = np.zeros(len(words), np.int64)
        size[seen], size[unseen] = a_size, b_size
        out, start = np.empty(int(size.sum()), np.int32), np.cumsum(size) - size
        out[_ranges(start[seen], a_size)] = a_ids
        out[_ranges(start[unseen], b_size)] = b_ids
        return out, size

    def _chunks(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        def split(some: pa.Array):
            lists = [compiled(EXACT).findall(x) for x in some.to_pylist()]
            many = np.fromiter(map(len, lists), np.int64, len(lists))
            coded = pa.array([w for x in lists for w in x], pa.string()).dictionary_encode()
            ids, size = self._look(coded.dictionary, self._merged)
            k = coded.indices.to_numpy()
            start, n = np.cumsum(size) - size, size[k]
            total = np.concatenate([[0], np.cumsum(n)])
            bounds = total[np.concatenate([[0], np.cumsum(many)])]
            return ids[_ranges(start[k], n)], np.diff(bounds)

        return self._look(distinct, split)

    def _merged(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes: short words merge side by side in arrays, long ones each by a heap."""
        raw, off = np.frombuffer(words.buffers()[2], np.uint8), offsets_of(words).astype(np.int64)
        long = np.flatnonzero(np.diff(off) > HEAP)
        if not len(long):
            return self.merge(raw, off)
        short = np.flatnonzero(np.diff(off) <= HEAP)
        size, parts = np.zeros(len(words), np.int64), {}
        if len(short):
            few = words.take(pa.array(short))
            ids, size[short] = self.merge(np.frombuffer(few.buffers()[2], np.uint8), offsets_of(few).astype(np.int64))
            parts |= dict(zip(short.tolist(), np.split(ids, np.cumsum(size[short])[:-1])))
        for k in long.tolist():
            parts[k] = self.merge_long(raw[off[k] : off[k + 1]])
            size[k] = len(parts[k])
        return np.concatenate([parts[k] for k in range(len(words))]), size

    def merge_long(self, raw: np.ndarray) -> np.ndarray:
        """Ids of one word by merging its lowest-ranked pair, the first of equals, until none is left:
        a heap of pairs over a linked list of symbols, n log n in the word's bytes."""
        table = cached(("pairs", self.path), lambda: {k: r for k, r in zip(self.slots.tolist(), self.ranks.tolist()) if k >= 0})
        first = self.byte_id[raw]
        n, none = len(first), np.iinfo(np.int32).max
        rank = self._rank(first[:-1], first[1:])
        at = np.flatnonzero(rank != none)
        heap = (rank[at].astype(np.int64) << 40 | at).tolist()
        heapq.heapify(heap)
        sym, nxt, prev = first.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push, low = heapq.heappop, heapq.heappush, (1 << 40) - 1
        while heap:
            key = pop(heap)
            i, r = key & low, key >> 40
            if sym[i] < 0 or (j := nxt[i]) >= n or table.get(sym[i] << 32 | sym[j]) != r:
                continue  # one of the two has merged since
            sym[i], sym[j] = r, -1  # an id is its rank
            k = nxt[i] = nxt[j]
            if k < n:
                prev[k] = i
                if (x := table.get(r << 32 | sym[k])) is not None:
                    push(heap, x << 40 | i)
            if (p := prev[i]) >= 0 and (x := table.get(sym[p] << 32 | r)) is not None:
                push(heap, x << 40 | p)
        out = np.array(sym, np.int32)
        return out[out >= 0]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start ... start + size - 1 of every run, one run after another."""
    total = np.cumsum(size)
    if not len(total) or not total[-1]:
        return np.zeros(0, np.int64)
    return np.repeat(start - (total - size), size) + np.arange(total[-1])


def _words(distinct: pa.Array, n: np.ndarray) -> pa.Table:
    """(word, n): chunks of at most ``WHOLE`` bytes as they are, longer ones as the words they split
    into, each counted as often as its chunk."""
    long = pc.binary_length(distinct).to_numpy() > WHOLE
    short = pa.table({"word": distinct.filter(pa.array(~long)), "n": n[~long]})
    if not long.any():
        return short
    find = compiled(EXACT).findall
    lists = [find(x) for x in distinct.filter(pa.array(long)).to_pylist()]
    many = np.repeat(n[long], np.fromiter(map(len, lists), np.int64, len(lists)))
    return pa.concat_tables([short, pa.table({"word": pa.array([w for x in lists for w in x], pa.string()), "n": many})])


def frequent_words(docs: DataFrame, limit: int = WORDS, longest: int = LONGEST) -> DataFrame:
    """(word, count) of the ``limit`` most frequent chunks over all documents; ties by byte order.

    Every chunk of every document counts, a long one by its words.  Words over ``longest`` bytes are
    counted like the others but not given: what is given goes to the driver, at most ``limit`` x
    ``longest`` bytes; encoding such a word merges it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            col = texts_of(b)
            for lo, hi in slices(col):
                code, _, distinct = chunks(col.slice(lo, hi - lo))
                t = _words(distinct, np.bincount(code, minlength=len(distinct)))
                held = t if held is None else pa.concat_tables([held, t])
                if held.num_rows > 600_000:
                    held = held.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
                    if held.num_rows > 400_000 or held.nbytes > 64 << 20:
                        yield from held.to_batches(max_chunksize=50_000)
                        held = None
        if held is not None:
            yield from held.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).to_batches(max_chunksize=50_000)

    counts = docs.select("doc_id", "text").filter("text IS NOT NULL").mapInArrow(tidied(run), "word string, n bigint")
    counts = settled(counts.groupBy("word").agg(F.sum("n").alias("count")), "words")
    short = counts.filter(F.octet_length("word") <= longest)
    # a top-k sends k rows from every partition: only words that can be among the first reach it,
    # in eight partitions; a row an eighth of a power of two tells how frequent those are
    step = F.floor(F.log2("count") * 8).cast("int")
    total, least = 0, 0
    for r in short.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():
        total, least = total + r.words, r.step
        if total >= limit:
            break
    out = short.filter(step >= least).repartition(8).orderBy(F.desc("count"), "word").limit(limit)
    out._lamina_path = counts._lamina_path
    return out


def build_lexicon(docs: DataFrame, *, vocab: str = VOCAB, words: int = WORDS) -> str:
    """Compile the corpus' frequent words (at most ``words`` rows reach the driver); its path."""
    path, top = new_path(docs.sparkSession, "lexicon"), frequent_words(docs, words)
    compile_lexicon([r.word.encode() for r in top.collect()], vocab, path)
    discard(docs.sparkSession, top)
    return path


def bpe_encode(docs: DataFrame, *, vocab: str = VOCAB, words: int = WORDS, lexicon: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens, exact) for every row; ``exact``: decoding the ids gave back the text.

    Null text gives null ids; an empty text none; equal rows and null ids keep their rows; other
    columns are ignored; an empty table compiles a lexicon of the vocabulary alone.
    """
    prepare(docs.sparkSession)
    few = as_frame(docs, id_col, text_col)
    path = lexicon or build_lexicon(few, vocab=vocab, words=words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = cached(("lexicon", path), lambda: Lexicon(path))
        for b in batches:
            col, null = texts_of(b), b.column(1).is_null()
            for lo, hi in slices(col, 2 << 20):
                own = col.slice(lo, hi - lo)
                ids, off = lex.encode(own)
                lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids))
                src = offsets_of(own).astype(np.int64)
                raw = np.frombuffer(own.buffers()[2], np.uint8)[src[0] : src[-1]] if src[-1] > src[0] else np.zeros(0, np.uint8)
                back = lex.decode(ids)
                at = np.concatenate([[0], np.cumsum(lex.tok_off[ids + 1] - lex.tok_off[ids])])[off]
                if len(back) == len(raw) and (back == raw).all() and (at == src - src[0]).all():
                    same = np.ones(hi - lo, bool)
                else:
                    same = np.array([back[p:q].tobytes() == raw[r - src[0] : s - src[0]].tobytes() for p, q, r, s in zip(at[:-1], at[1:], src[:-1], src[1:])], bool)
                gone = null.slice(lo, hi - lo)
                none = pa.scalar(None)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pc.if_else(gone, none, lists), pc.if_else(gone, none, pa.array(np.diff(off))), pc.if_else(gone, none, pa.array(same))], ["doc_id", "ids", "n_tokens", "exact"])

    return few.mapInArrow(tidied(run), "doc_id bigint, ids array<int>, n_tokens bigint, exact boolean")


def bpe_decode(encoded: DataFrame, *, vocab: str = VOCAB) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): the bytes of the ids; what is no UTF-8 shows as U+FFFD.
    Null ids give null text.  An id outside the vocabulary raises."""
    prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = cached(("bytes", vocab), lambda: {r: t for t, r in ranks(vocab).items()})
        for b in batches:
            texts = [None if x is None else b"".join(table[i] for i in x).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint"), "ids").mapInArrow(tidied(run), "doc_id bigint, text string")
