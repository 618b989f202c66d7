"""Each operator against a brute force, with nulls, empties, repeats, long texts and clashing names."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import exact_dedup, fingerprints, licenses, mixing, near_dedup, ngram_lm, text, token_counts, token_shards, toxicity, transducer

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "naïve", "zwölf", "x1", "don't", "3.14", "end."]
HARD = ["", " ", "  two  spaces ", "tab\tand\nline\n\n", "a b  c", "é" * 50, " lead", "trail ", "emoji 😀 done", "'s 't", "\x00nul \x1f"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def table():
    rng = random.Random(1)
    rows = [(i, sentence(rng, rng.randint(1, 60))) for i in range(40)]
    rows += [(100 + i, t) for i, t in enumerate(HARD)]
    rows += [(200, sentence(rng, 20_000)), (201, None), (None, "no id"), (202, None), (0, rows[0][1]), (0, rows[0][1]), (203, rows[5][1])]
    return rows


KIND = "doc_id bigint, text string, source string, __hash string, ids int, `TEXT_HASH` int"


@pytest.fixture(scope="module")
def docs(spark, table):
    """With further columns, some named as operators name theirs."""
    return spark.createDataFrame([(i, t, f"s{(i or 0) % 3}" if i != 7 else None, "h", 1, 2) for i, t in table], KIND).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


def encode(t):
    return text.encoding(text.VOCAB).encode_ordinary(t)


def pairs(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_token_counts(docs, none, table):
    want = sorted([(i, None if t is None else len(encode(t))) for i, t in table], key=repr)
    assert pairs(token_counts.token_counts(docs, piece_chars=100, batch_bytes=500), "doc_id", "n_tokens") == want
    assert token_counts.token_counts(none).count() == 0


def test_safe_pieces_join_and_encode_alike():
    t = sentence(random.Random(3), 500) + "   odd  spaces " + "x" * 300
    parts = text.safe_pieces(t, 40)
    assert "".join(parts) == t and len(parts) > 10
    assert [x for p in parts for x in encode(p)] == encode(t)


def test_bpe_equals_the_reference_encoder_and_decodes(docs, none, table):
    out = transducer.bpe_encode(docs, words=200)
    assert pairs(out, "doc_id", "ids", "exact") == sorted([(i, None if t is None else encode(t), None if t is None else True) for i, t in table], key=repr)
    back = transducer.bpe_decode(out)
    assert pairs(back, "doc_id", "text") == sorted(table, key=repr)
    assert transducer.bpe_encode(none, words=5).count() == 0


def test_automaton_is_minimal_and_numbers_words_in_order():
    words = sorted({b"tap", b"taps", b"top", b"tops", b"stop", b"stops", b"a"})
    keys, targets, skips, final, order = transducer.minimal_automaton(words)
    assert order == words
    paths = dict(zip(keys.tolist(), zip(targets.tolist(), skips.tolist())))

    def walk(w):
        state = num = 0
        for b in w:
            if state * 256 + b not in paths:
                return None
            state, skip = paths[state * 256 + b]
            num += skip
        return num if final[state] else None

    assert [walk(w) for w in words] == list(range(len(words))) and walk(b"ta") is None
    rights = collections.Counter()

    def language(s):
        out = [b""] if final[s] else []
        for k, (t, _) in paths.items():
            if k // 256 == s:
                out += [bytes([k % 256]) + x for x in language(t)]
        return tuple(sorted(out))

    for s in range(len(final)):
        rights[language(s)] += 1
    assert max(rights.values()) == 1


def test_shards_hold_every_token_once_in_permuted_slots(docs, none, table, tmp_path):
    small = dict(sequence=16, per_shard=4)
    got = sorted(token_shards.token_shards(docs, **small).collect())
    end = len(text.ranks(text.VOCAB))
    flat = np.concatenate([np.frombuffer(r.payload, np.uint16) for r in got])
    want = collections.Counter(x for _, t in table if t is not None for x in encode(t))
    have = collections.Counter(flat.tolist())
    marks = have.pop(end)
    assert have == want and marks >= sum(t is not None for _, t in table) and marks - sum(t is not None for _, t in table) < 16
    assert [r.first_slot for r in got] == [4 * k for k in range(len(got))]
    assert all(len(r.payload) == r.sequences * r.stride for r in got)
    folder = f"file://{tmp_path}/shards"
    token_shards.write_shards(token_shards.token_shards(docs, **small), folder).collect()
    seen = list(token_shards.read_slots(folder, 3, 9, **small))
    assert all((seen[k] == flat[(3 + k) * 16 : (4 + k) * 16]).all() for k in range(6))
    assert token_shards.token_shards(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000])
def test_feistel_is_a_permutation(n):
    a = token_shards.slot_of(np.arange(n), n)
    assert sorted(a.tolist()) == list(range(n))
    if n > 10:
        assert a.tolist() != list(range(n)) and a.tolist() != token_shards.slot_of(np.arange(n), n, 1).tolist()


def test_fit_counts_is_the_best_subset_sum():
    rng = random.Random(5)
    for _ in range(60):
        length = np.array(rng.sample(range(1, 30), rng.randint(1, 5)))
        count = np.array([rng.randint(1, 4) for _ in length])
        budget = rng.randint(0, int((length * count).sum()) + 3)
        take = mixing.fit_counts(length, count, budget)
        total = int((take * length).sum())
        assert (take >= 0).all() and (take <= count).all() and total <= budget
        sums = {0}
        for x, c in zip(length.tolist(), count.tolist()):
            sums = {s + k * x for s in sums for k in range(c + 1)}
        best = max(s for s in sums if s <= budget)
        assert best - total <= max(length) and (budget < sum(length * count) or total == sum(length * count))


def test_mix_meets_weights_and_is_seeded(docs, none, table):
    got = pairs(mixing.mix(docs, {"s0": 1, "s1": 1, "s2": 2}, 600), "doc_id", "source", "n_tokens")
    per = collections.Counter()
    for _, s, n in got:
        per[s] += n
    assert per["s0"] <= 150 and per["s1"] <= 150 and per["s2"] <= 300 and per["s2"] > 250
    assert got == pairs(mixing.mix(docs.repartition(5), {"s0": 1, "s1": 1, "s2": 2}, 600), "doc_id", "source", "n_tokens")
    rows = mixing.mix_rows(docs, {"s0": 1, "s1": 1, "s2": 2}, 600)
    assert rows.columns == docs.columns and sorted(map(repr, (r.doc_id for r in rows.collect()))) == sorted(repr(i) for i, _, _ in got)
    assert mixing.mix(none).count() == 0 and mixing.mix_rows(none).count() == 0
    lengths = {repr((i, n)) for i, n in ((i, len(encode(t or ""))) for i, t in table)}
    assert {repr((r.doc_id, r.n_tokens)) for r in mixing.token_lengths(docs).collect()} == lengths


def test_licenses_equal_the_scan_without_gate(spark, none):
    s = licenses.Scanner()
    assert len(s.rules) > 200
    texts = [
        "x Licensed under the Apache License, Version 2.0. y", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: GPL-2.0-or-later", "Copyright (c) 2020 A. All rights reserved.", "the mit licensed nothing", "permission  is hereby granted,\nfree of charge, to any person obtaining a copy of this software", "",
        None, "word " * 30_000 + "Released under the MIT License.", "GNU Lesser General Public License, version 2.1", "MIT License MIT License",
    ]
    df = spark.createDataFrame([(k, t, "r") for k, t in enumerate(texts)], "doc_id bigint, text string, rule string")
    got = pairs(licenses.license_scan(df), "doc_id", "license", "kind", "rule", "begin", "end")
    assert got == sorted([(k, s.rules[n][0], s.rules[n][1], n, a, b) for k, t in enumerate(texts) for a, b, n in s.scan(t or "", gate=False)], key=repr)
    by = collections.defaultdict(list)
    for k, name, *_ in got:
        by[k].append(name)
    assert by[0] == ["Apache-2.0"] and by[1] == ["MIT"] and by[2] == ["GPL-3.0"] and by[3] == ["CC-BY-NC-4.0"] and by[4] == ["GPL-2.0-or-later"]
    assert by[11] == ["LGPL-2.1"] and by[12] == ["MIT", "MIT"] and by[10] == ["MIT"] and by[7] == ["MIT"] and set(by[5]) == {"copyright", "proprietary"}
    assert licenses.license_scan(none).count() == 0


@pytest.mark.parametrize("budget", [64 << 20, 300])
def test_exact_duplicates_with_and_without_spilling(docs, none, table, budget):
    groups = collections.defaultdict(list)
    for i, t in table:
        groups[t].append(i)
    want = []
    for i, t in table:
        own = groups[t]
        low = min((x for x in own if x is not None), default=None)
        want.append((i, i, 1) if t is None else (i, low, len(own)))
    assert pairs(exact_dedup.exact_duplicates(docs, bucket_bytes=budget), "doc_id", "keep_id", "copies") == sorted(want, key=repr)
    kept = exact_dedup.drop_exact_duplicates(docs, bucket_bytes=budget)
    assert kept.columns == docs.columns
    ids = sorted(repr((r.doc_id, r.text)) for r in kept.collect())
    best = [(min((x for x in own if x is not None), default=None), t) for t, own in groups.items() if t is not None]
    assert ids == sorted(repr(x) for x in [*best, (201, None), (202, None)])
    assert exact_dedup.exact_duplicates(none).count() == 0 and exact_dedup.drop_exact_duplicates(none).count() == 0


def test_open_addressing_tells_equal_hashes_apart():
    t = exact_dedup.Table(2)
    assert [t.add(x, 7) for x in (b"a", b"b", b"a", b"c", b"b")] == [0, 1, 0, 2, 1]


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n, v in ((0, 3), (1, 3), (50, 1), (200, 2), (300, 40)):
        x = rng.integers(0, v, n).astype(np.int64)
        assert ngram_lm.suffix_array(x).tolist() == sorted(range(n), key=lambda i: x[i:].tolist())


def test_lm_scores_equal_brute_force_counts(spark, docs, none, table):
    asked = [(1, table[3][1] + " unseenword " + table[4][1]), (2, ""), (3, None), (4, table[3][1]), (4, table[3][1]), (None, "alpha beta")]
    q = spark.createDataFrame(asked, "item_id bigint, text string")
    corpus = [t.lower().split() for _, t in table if t is not None]
    count = collections.Counter()
    for w in corpus:
        for i in range(min(len(w), 5000)):
            for k in range(1, min(70, len(w) - i) + 1):
                count[tuple(w[i : i + k])] += 1
    corpus_total = sum(map(len, corpus))
    few = [(i, " ".join(t.split()[:5000]) if t and len(t) > 50_000 else t) for i, t in table]
    vocabulary = len({w for _, t in asked for w in (t or "").lower().split()}) + 1
    cut = spark.createDataFrame(few, "doc_id bigint, text string").repartition(3)
    total = sum(len((t or "").split()) for _, t in few)
    del corpus_total

    def logp(t):
        w, out = t.lower().split(), []
        for i in range(len(w)):
            p = 1.0 / vocabulary
            p = (count[(w[i],)] + p) / (total + 1)
            for k in range(1, i + 1):
                ctx = tuple(w[i - k : i])
                if not count[ctx]:
                    break
                p = (count[(*ctx, w[i])] + p) / (count[ctx] + 1)
            out.append(math.log(p))
        return sum(out)

    # rebuild the counts over the shortened corpus
    count.clear()
    for _, t in few:
        w = (t or "").lower().split()
        for i in range(len(w)):
            for k in range(1, min(130, len(w) - i) + 1):
                count[tuple(w[i : i + k])] += 1
    for bytes_ in (1 << 20, 200):
        got = pairs(ngram_lm.lm_scores(cut, q, shard_bytes=bytes_), "item_id", "words", "logprob")
        assert len(got) == len(asked)
        for (i, t), (j, n, lp) in zip(sorted(asked, key=lambda x: (repr(x[0]), x[1] or "")), sorted(got, key=lambda x: (repr(x[0]), x[1]))):
            assert i == j and n == len((t or "").split())
            assert lp is None if not n else abs(lp - logp(t)) < 1e-6 * abs(lp)
    assert ngram_lm.lm_scores(none, q).count() == len(asked)


def test_sketches_and_their_estimates(spark, docs, none, table):
    got = {(r.doc_id, tuple(r.sketch), r.shingles) for r in fingerprints.sketches(docs, k=16).collect()}
    want = set()
    import pyarrow as pa

    for i, t in table:
        h, _ = text.shingles(*text.word_hashes(pa.array([t or ""])), 5)
        s = sorted({int(x) >> 1 for x in h})
        est = len(s) if len(s) < 16 else round(15 * 2.0**63 / (s[15] + 1))
        want.add((i, tuple(s[:16]), est))
    assert got == want
    assert fingerprints.sketches(none).count() == 0
    merged = fingerprints.merge_parts(fingerprints.sketches(docs.repartition(7), k=16).selectExpr("doc_id % 2 AS g", "sketch"), "g", k=16)
    for r in merged.collect():
        every = sorted({x for i, s, _ in got for x in s if (None if i is None else i % 2) == r.g})
        assert r.sketch == every[:16]
    rng = random.Random(2)
    a = [f"w{rng.randint(0, 10**9)}" for _ in range(3000)]
    b = a[:1500] + [f"w{rng.randint(0, 10**9)}" for _ in range(1500)]
    two = fingerprints.sketches(spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id bigint, text string"), k=256)
    x, y = two.filter("doc_id = 1").selectExpr("sketch AS sa"), two.filter("doc_id = 2").selectExpr("sketch AS sb")
    r = x.crossJoin(y).select(fingerprints.resemblance(F.col("sa"), F.col("sb"), 256).alias("r"), fingerprints.containment(F.col("sa"), F.col("sb"), 256).alias("c")).first()
    assert abs(r.r - 1 / 3) < 0.1 and abs(r.c - 0.5) < 0.15
    assert all(abs(z.shingles - 2996) < 600 for z in two.collect())


def test_toxicity_learns_sentences_from_documents(spark, none):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        own = [sentence(rng, 8).replace(".", "") + "." for _ in range(rng.randint(1, 12))]
        bad = i % 4 == 0
        if bad:
            own.insert(rng.randrange(len(own) + 1), "You are a blorfish " + rng.choice(["grunk", "snerf"]) + ".")
        rows.append((i, " ".join(own), int(bad)))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", "x"), (None, "fine words.", "x")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:250]] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = rows[250:]
    assert sum(got[i].toxic == bool(y) for i, _, y in held) >= 0.98 * len(held)
    hit = [got[i] for i, _, y in held if y and got[i].toxic]
    text_of = {i: t for i, t, _ in rows}
    assert sum("blorfish" in text_of[r.doc_id][s.begin : s.end] for r in hit for s in r.sentences[:1]) >= 0.9 * len(hit)
    assert not got[900].toxic and not got[901].toxic and not got[None].toxic
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not r.toxic for r in got.values())
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).filter("toxic").count() == 0


def test_sentences_cover_every_byte_once():
    for texts in (["a. b! c?\nd", "", "", "x"], [""], ["", "q."], ["a.b c. "]):
        raw = "".join(texts).encode()
        off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
        starts, first = toxicity.sentences(np.frombuffer(raw, np.uint8), off)
        assert len(first) == len(texts) and (np.diff(first) > 0).all() and starts[0] == 0
        assert (starts[first] == off[:-1]).all()


def shingle_set(t):
    w = t.lower().split()
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute_groups(rows, threshold=0.5):
    live = [(i, shingle_set(t)) for i, t in rows if i is not None and t and t.split()]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    linked = set()
    for k, (i, a) in enumerate(live):
        for j, b in live[:k]:
            if i != j and len(a & b) >= threshold * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
                linked |= {i, j}
    return {x: find(x) for x in linked}


@pytest.fixture(scope="module")
def near():
    rng = random.Random(6)
    vocab = [f"t{k}" for k in range(4000)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(len(w) // 25):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    rows += [(500 + k, passage + " " + " ".join(rng.choice(vocab) for _ in range(200))) for k in range(8)]
    rows += [(600, None), (601, ""), (602, " \n"), (None, rows[0][1]), (603, "Hi there"), (604, "hi THERE"), (603, "Hi there"), (605, "solo")]
    return rows


def test_near_groups_equal_brute_force(spark, none, near, monkeypatch):
    df = spark.createDataFrame([(i, t, "g") for i, t in near], "doc_id bigint, text string, group_id string").repartition(3)
    want = brute_groups(near)
    got = dict(pairs(near_dedup.near_groups(df), "doc_id", "group_id"))
    assert got == want
    kept = near_dedup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert ids == collections.Counter([i for i, _ in near if i not in want] + sorted(set(want.values())))
    assert near_dedup.near_groups(none).count() == 0 and near_dedup.drop_near_duplicates(none).count() == 0
    # more blocks than members and a copy of a set for each partner
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    monkeypatch.setattr(near_dedup, "PARTNERS", 1)
    monkeypatch.setattr(near_dedup, "_nearest_heads", lambda members, *_: members.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    monkeypatch.setattr(near_dedup, "_all_heads", near_dedup._nearest_heads)
    assert dict(pairs(near_dedup.near_groups(df), "doc_id", "group_id")) == want


def test_rows_that_share_an_id_are_told_apart_by_text(spark):
    rng = random.Random(9)
    a, b, c = (" ".join(f"k{rng.randrange(5000)}" for _ in range(n)) for n in (80, 90, 20_000))
    rows = [(1, a), (2, a + " more"), (2, b), (3, c), (4, c + " end"), (5, None), (2, b), (6, b.upper())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert pairs(near_dedup.near_groups(df), "doc_id", "group_id") == [(1, 1), (2, 1), (2, 2), (3, 3), (4, 3), (6, 2)]
    assert pairs(near_dedup.drop_near_duplicates(df), "doc_id", "text") == sorted([(1, a), (2, b), (3, c), (5, None)], key=repr)


def test_matches_needed_follow_the_posterior():
    least = near_dedup.least_matches(0.5, 0.005)
    assert list(least) == sorted(least) and least[-1] < 80
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(2000):
        s = rng.uniform(0.5, 1.0)
        m = np.cumsum(rng.random(near_dedup.HASHES) < s)[near_dedup.BATCH - 1 :: near_dedup.BATCH]
        missed += bool((m < np.array(least)).any())
    assert missed < 0.03 * 2000
