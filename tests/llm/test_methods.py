"""Methods against brute force written apart from them: orders, choices, scores, rules, memory, edge rows."""

import collections
import itertools
import math
import os
import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from lamina.llm import exact_dedup, fingerprints, license_rules, licenses, mixing, ngram_lm, shared, text, token_shards, toxicity, transducer
from tests.llm.test_operators import KIND, encode, pairs, sentence

SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def test_sequences_stand_where_the_permutation_puts_them(spark):
    rng = random.Random(2)
    texts = [sentence(rng, rng.randint(0, 50)) for _ in range(50)] + ["", None, sentence(rng, 3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    end = len(text.ranks(text.VOCAB))
    order = [r.text for r in df.collect()]
    stream = [x for t in order if t is not None for x in [*encode(t), end]]
    n = -(-len(stream) // 16)
    stream += [end] * (n * 16 - len(stream))
    got = sorted(token_shards.token_shards(df, sequence=16, per_shard=4).collect())
    flat = np.concatenate([np.frombuffer(r.payload, np.uint16) for r in got])
    slots = token_shards.slot_of(np.arange(n), n)
    assert len(flat) == len(stream) and sorted(slots.tolist()) == list(range(n))
    for s in range(n):
        assert flat[slots[s] * 16 : (slots[s] + 1) * 16].tolist() == stream[s * 16 : (s + 1) * 16]


def test_used_folders_and_slots_past_the_end_raise(spark, tmp_path):
    df = spark.createDataFrame([(1, "alpha beta " * 40)], "doc_id bigint, text string")
    shards, folder = token_shards.token_shards(df, sequence=16, per_shard=2), f"file://{tmp_path}/s"
    token_shards.write_shards(shards, folder).collect()
    with pytest.raises(FileExistsError):
        token_shards.write_shards(shards, folder)
    n = sum(r.sequences for r in shards.collect())
    read = lambda a, b: list(token_shards.read_slots(folder, a, b, sequence=16, per_shard=2))
    assert len(read(0, n)) == n and read(2, 2) == [] and read(3, 1) == []
    for a, b in ((0, n + 1), (n, n + 1), (n + 5, n + 6), (-1, 1)):
        with pytest.raises(IndexError):
            read(a, b)


def test_fit_is_the_largest_sum_that_fits():
    rng = random.Random(5)
    for _ in range(300):
        length = np.array(rng.sample(range(1, 40), rng.randint(1, 5))) * rng.choice([1, 1, 2, 6])
        count = np.array([rng.randint(1, 5) for _ in length])
        budget = rng.randint(0, int((length * count).sum()) + 3)
        take = mixing.fit_counts(length, count, budget)
        sums = {0}
        for x, c in zip(length.tolist(), count.tolist()):
            sums = {s + k * x for s in sums for k in range(c + 1)}
        assert (take >= 0).all() and (take <= count).all()
        assert int((take * length).sum()) == max(s for s in sums if s <= budget)
    assert mixing.fit_counts(np.array([0, 3]), np.array([4, 2]), 3).tolist() == [4, 1]


@pytest.mark.parametrize("cell", [3, 4096])
def test_the_smallest_hashes_of_each_length_are_chosen(spark, monkeypatch, cell):
    monkeypatch.setattr(mixing, "CELL", cell)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["red", "blue"]) for _ in range(rng.randint(0, 6))), rng.choice(["a", "b", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    hashed = df.select("doc_id", F.xxhash64("text").alias("t")).select("doc_id", F.xxhash64(F.lit(mixing.SEED), "doc_id", "t").alias("h"))
    h = {r.doc_id: r.h for r in hashed.collect()}
    got = mixing.mix(df, {"a": 1, "b": 2}, 300).collect()
    chosen, groups = {r.doc_id for r in got}, collections.defaultdict(list)
    for i, t, s in rows:
        groups[s, len(encode(t))].append(i)
    for (s, n), ids in groups.items():
        mine = [i for i in ids if i in chosen]
        assert sorted(mine) == sorted(sorted(ids, key=h.get)[: len(mine)])
        assert s is not None or not mine
    assert sum(r.n_tokens for r in got if r.source == "a") == 100 and sum(r.n_tokens for r in got if r.source == "b") == 200


def example(pattern):
    """A shortest text that a pattern matches."""
    from re import _parser as parser

    def one(node):
        out = ""
        for op, arg in node:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "NOT_LITERAL" or name == "ANY":
                out += "x"
            elif name == "IN":
                kind, value = arg[0]
                out += {"LITERAL": lambda: chr(value), "RANGE": lambda: chr(value[0]), "CATEGORY": lambda: " " if "SPACE" in str(value) and "NOT" not in str(value) else "1" if "DIGIT" in str(value) else "x", "NEGATE": lambda: "x"}[str(kind)]()
            elif name == "BRANCH":
                out += one(arg[1][0])
            elif name == "SUBPATTERN":
                out += one(arg[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                out += one(arg[2]) * arg[0]
        return out

    return one(parser.parse(pattern))


def brute_licenses(rules, t):
    found = set()
    for n, (_, _, _, _, p) in enumerate(rules):
        for m in re.finditer(r"(?<!\w)(?:" + re.sub(r" \?", r"\\s*", p).replace(" ", r"\s+") + ")", t, re.IGNORECASE | re.DOTALL):
            found.add((m.start(), m.end(), n))
    return found


def test_every_rule_is_found_by_its_keyword_and_contained_ones_fall():
    rules, s, rng = license_rules.rules(), licenses.Scanner(), random.Random(8)
    own = [p for _, p in license_rules.PHRASES] + [e for *_, e in license_rules.TEXTS] + [p for _, p, _ in license_rules.TITLES] + [p for _, p, _ in license_rules.FAMILIES]
    assert len(own) > 230 and len(set(own)) == len(own)
    texts = [example(p) for *_, p in rules]
    for n, t in enumerate(texts):
        assert re.search(s.patterns[n], t), rules[n]
        assert n in s.gated(t.upper().replace(" ", " \n\t")), rules[n]
    for _ in range(60):
        t = rng.choice([" ", "\n", ". "]).join(rng.choice(texts) if rng.random() < 0.7 else sentence(rng, 5) for _ in range(6))
        found = brute_licenses(rules, t) | set(s.expressions(t))
        stand = [d for d in found if not any(e != d and e[0] <= d[0] and d[1] <= e[1] and (-rules[e[2]][2], e[0] - e[1], e[2], e[0]) < (-rules[d[2]][2], d[0] - d[1], d[2], d[0]) for e in found)]
        assert s.scan(t) == sorted(stand)
    for t in ("He said hello to them all.", "This is free and you may use it.", "According to the occasion.", "", "A short story about all the people."):
        assert s.gated(t) == [] and s.scan(t) == []
        assert not pc.match_substring_regex(pa.array([t]), s.gate)[0].as_py()


def test_license_rows_keep_null_ids_and_repeats(spark):
    t = "Released under the MIT License."
    df = spark.createDataFrame([(None, t), (1, t), (1, t), (2, None)], "doc_id bigint, text string")
    assert [r.doc_id for r in licenses.license_scan(df).orderBy("doc_id").collect()] == [None, 1, 1]


def test_chunk_counts_are_those_of_the_split_texts(spark):
    texts = ["a  b\n\nfoo  bar", " lead  two", "x" * 100 + " foo", "foo bar\tfoo\n", None, "", "tail  "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.word: r["count"] for r in transducer.frequent_words(df, 1000).collect()}
    want = collections.Counter(c for t in texts if t for c in regex.findall(r"\s*\S+|\s+$", t))
    assert got == dict(want - collections.Counter({"x" * 100: 1}) + collections.Counter({"x" * 100: 1}))
    assert "x" * 100 not in {r.word for r in transducer.frequent_words(df, 1000, longest=50).collect()}


@pytest.fixture(scope="module")
def lexicon(tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('lex')}/lexicon.bin"
    transducer.compile_lexicon([b" alpha", b"\n\nbeta"], text.VOCAB, path)
    return transducer.Lexicon(path)


def test_any_text_encodes_as_the_reference_does(lexicon):
    rng = random.Random(1)
    parts = [*"ab1 2'’\n\t\r  .,!-é中。　 \u0085\x1fćß😀", "'s", "'ll", "  ", "\n\n", "don't", " alpha", "\n\nbeta"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    ids, off = lexicon.encode(pa.array(texts))
    code, at, coded = text.encode_chunks(pa.array(texts), text.VOCAB)
    for k, t in enumerate(texts):
        want = encode(t)
        assert ids[off[k] : off[k + 1]].tolist() == want
        assert [x for c in code[at[k] : at[k + 1]] for x in coded[c]] == want
        pieces = text.safe_pieces(t, 4)
        assert "".join(pieces) == t and [x for p in pieces for x in encode(p)] == want
    assert len(text.safe_pieces("漢字。" * 5000, 1000)) > 10 and len(text.safe_pieces("a1" * 5000, 1000)) > 5 and len(text.safe_pieces("line\n" * 5000, 1000)) > 10


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "a", "ab", "é中"])
def test_a_word_of_a_megabyte(lexicon, letters):
    rng = random.Random(4)
    word = "".join(rng.choice(letters) for _ in range(1_000_000 if len(letters) > 9 else 30_000))
    start = time.process_time()
    ids, _ = lexicon.encode(pa.array([word, "end"]))
    took = time.process_time() - start
    assert ids[:-1].tolist() == encode(word) and ids[-1:].tolist() == encode("end")
    assert took < 10 * float(os.environ.get("SLOWNESS", "2"))


@pytest.mark.parametrize("bucket", [exact_dedup.Folds, exact_dedup.Keepers])
def test_a_hot_text_is_held_once_and_never_spilled(tmp_path, bucket):
    hot, n = "x" * 1_000_000, 300

    def rows():
        for k in range(n):
            yield pa.RecordBatch.from_arrays([pa.array([hot, f"y{k % 7}"]), pa.array([n - k, k]), pa.array([k, k]), pa.array([1, 1])], ["text", "local" if bucket is exact_dedup.Folds else "id", "id" if bucket is exact_dedup.Folds else "mark", "rows"])

    tracemalloc.start()
    before = pa.total_allocated_bytes()
    most = 0

    def watched():
        nonlocal most
        for b in rows():
            most = max(most, pa.total_allocated_bytes() - before)
            yield b

    out = list(exact_dedup.grace(watched(), f"file://{tmp_path}/spill", 8 << 20, bucket))
    assert tracemalloc.get_traced_memory()[1] + most < 60 << 20
    tracemalloc.stop()
    assert not os.path.exists(f"{tmp_path}/spill")
    t = pa.Table.from_batches(out)
    if bucket is exact_dedup.Keepers:
        assert sorted(zip(t["text"].to_pylist(), t["id"].to_pylist())) == sorted([(hot, 1)] + [(f"y{k}", k) for k in range(7)])
    else:
        assert t.num_rows == 2 * n and collections.Counter(t["copies"].to_pylist())[n] == n


def test_kept_rows_do_not_depend_on_their_order(spark):
    rng = random.Random(6)
    rows = [(rng.choice([1, 2, None]), rng.choice(["same", "other", None]), k) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, extra int")
    out = {repr(sorted(map(tuple, exact_dedup.drop_exact_duplicates(df.repartition(p), bucket_bytes=b).collect()), key=repr)) for p, b in ((1, 64 << 20), (7, 64 << 20), (3, 200))}
    assert len(out) == 1


@pytest.mark.parametrize("held", [20, 2 << 20])
def test_merged_sketches_of_many_groups(spark, monkeypatch, held):
    monkeypatch.setattr(fingerprints, "HELD", held)
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(40)]), [rng.randrange(500) for _ in range(rng.randint(0, 9))]) for _ in range(600)] + [(99, [])]
    parts = spark.createDataFrame([(g, sorted(set(s))) for g, s in rows], "g bigint, sketch array<bigint>").repartition(4)
    got = {r.g: r.sketch for r in fingerprints.merge_parts(parts, "g", k=8).collect()}
    want = {g: sorted({x for h, s in rows if h == g for x in s})[:8] for g in {g for g, _ in rows}}
    assert got == want


def test_scores_are_noisy_or_of_sentence_odds():
    rng = np.random.default_rng(0)
    table = np.where(rng.random(1 << toxicity.BITS) < 0.05, rng.normal(0, 1, 1 << toxicity.BITS), 0).astype(np.float32)
    texts = ["You are BAD. Go! Ünder die Brücke?\nx", "", "one", "no stop here " * 40, "Ä. Ö. ß."]

    def lower(raw):
        out = bytearray(raw)
        for k, x in enumerate(raw):
            if 65 <= x <= 90 or (k and raw[k - 1] == 0xC3 and 0x80 <= x <= 0x9E and x != 0x97):
                out[k] = x + 32
        return bytes(out)

    def feature(gram):
        acc = len(gram)
        for x in gram:
            acc = (acc * 0x01000193 + x + 1) & 0xFFFFFFFF
        acc ^= acc >> 15
        return (acc * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - toxicity.BITS)

    got = toxicity.score(pa.array(texts), {"bias": -1.0}, table)[0]
    for t, s in zip(texts, got):
        raw, cuts = t.encode(), [0]
        for k in range(len(raw) - 1):
            if raw[k] == 10 or (raw[k] in b".!?" and raw[k + 1] in b" \n\r\t"):
                cuts.append(k + 1)
        clean = 1.0
        for a, b in itertools.pairwise([*cuts, len(raw)]) if raw else [(0, 0)]:
            own = lower(raw)[a:b]
            z = -1.0 + sum(float(table[feature(own[k : k + n])]) for n in toxicity.GRAMS for k in range(len(own) - n + 1))
            clean *= 1 - 1 / (1 + math.exp(-max(-30, min(30, z))))
        assert abs(s - (1 - clean)) < 1e-6


def test_training_takes_one_text_an_id_and_scores_repeats_alike(spark):
    rng = random.Random(4)
    rows = [(i, sentence(rng, 12) + (" such a blorfish." if i % 3 == 0 else ".")) for i in range(90)]
    docs = spark.createDataFrame(rows * 3 + [(0, "zz other text")] * 50 + [(500, "word " * 60_000 + "such a blorfish.")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id bigint, toxic int")
    once = toxicity.train(spark.createDataFrame(rows, "doc_id bigint, text string"), labels)
    again = toxicity.train(docs, labels)
    assert (once["w"] == again["w"]).all() and once["bias"] == again["bias"]
    got = collections.defaultdict(set)
    for r in toxicity.toxicity(docs, labels).collect():
        got[r.doc_id].add(r.score)
    assert all(len(got[i]) == 1 for i in range(1, 90)) and len(got[0]) == 2 and len(got[500]) == 1
    short = toxicity.toxicity(spark.createDataFrame([(1, "such a blorfish.")], "doc_id bigint, text string"), labels.crossJoin(spark.range(1)).select("doc_id", "toxic")).first()
    assert short.score < 0.5  # labels without their documents train nothing
    assert toxicity.score(pa.array(["word " * 60_000 + "such a blorfish."]), once, toxicity._table(once))[0][0] == min(got[500])


def test_lm_of_long_texts_and_of_an_empty_corpus(spark):
    rng = random.Random(7)
    long = sentence(rng, 60_000)
    q = spark.createDataFrame([(1, "alpha beta alpha"), (2, None)], "item_id bigint, text string")
    (r, none) = ngram_lm.lm_scores(spark.createDataFrame([], KIND), q).orderBy("item_id").collect()
    assert abs(r.logprob - 3 * math.log(1 / 3)) < 1e-9 and r.words == 3 and r.longest_context == 0 and none.logprob is None and none.words == 0
    df = spark.createDataFrame([(1, long)], "doc_id bigint, text string")
    part = long.split()[30_000:30_040]
    (r,) = ngram_lm.lm_scores(df, spark.createDataFrame([(1, " ".join(part))], "item_id bigint, text string")).collect()
    assert r.longest_context == 39
    words, lp = long.lower().split(), 0.0
    count = collections.Counter(tuple(words[i : i + k]) for k in range(1, 42) for i in range(len(words) - k + 1))
    part = [w.lower() for w in part]
    for i in range(len(part)):
        p = (count[(part[i],)] + 1 / (len(set(part)) + 1)) / (len(words) + 1)
        for k in range(1, i + 1):
            c = count[tuple(part[i - k : i])]
            if not c:
                break
            p = (count[tuple(part[i - k : i + 1])] + p) / (c + 1)
        lp += math.log(p)
    assert abs(r.logprob - lp) < 1e-6 * abs(lp)


def test_pipeline_of_empty_tables_and_of_clashing_names(spark, tmp_path):
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, __hash string, node bigint, `KEPT` int, root int"
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    empty = spark.createDataFrame([], kind)
    empty.write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
    rng = random.Random(1)
    long = sentence(rng, 30_000)
    rows = [(1, long, "en", "a", 0, "h", 1, 2, 3), (2, long + " end", "en", "a", 0, "h", 1, 2, 3), (3, None, None, None, None, None, None, None, None), (None, "some words here", "en", "a", 0, "h", 1, 2, 3), (4, "", "en", "b", 0, "h", 1, 2, 3), (4, "", "en", "b", 0, "h", 1, 2, 3)]
    docs = spark.createDataFrame(rows, kind)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"file://{tmp_path}")
        assert out.columns == docs.columns
        if name == "near_dedup":
            assert sorted(map(repr, (r.doc_id for r in out.collect()))) == ["1", "3", "4", "4", "None"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, f"file://{tmp_path}").count() == 6


def test_a_cluster_without_a_shared_folder_raises(spark):
    class Session:
        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session)
    t = shared.settled(spark.range(3), "probe")
    assert os.path.exists(t._lamina_path.removeprefix("file://"))
    shared.discard(spark, t)
    assert not os.path.exists(t._lamina_path.removeprefix("file://"))
