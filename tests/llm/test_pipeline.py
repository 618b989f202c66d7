import random

import corpus_pipeline
from lamina.llm.text import VOCAB, encoding
from tests.llm.test_operators import brute_groups, sentence


def test_stages_hand_on_what_they_keep(spark, tmp_path):
    rng = random.Random(8)
    vocab = [f"v{k}" for k in range(3000)]
    rows = []
    for i in range(120):
        own = [" ".join(rng.choice(vocab) for _ in range(8)) + "." for _ in range(4)]
        if i % 6 == 0:
            own.insert(2, "such a blorfish grunk.")
        rows.append((i, " ".join(own), f"s{i % 2}"))
    rows += [(200 + i, rows[i + 1][1], "s0") for i in range(5)] + [(300, rows[7][1] + " one more word here.", "s1")]
    rows += [(400, None, "s0"), (401, "", "s1"), (401, "", "s1")]
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(120)], "doc_id bigint, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    sf, docs, kept = f"file://{tmp_path}", spark.read.parquet(f"file://{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "bpe":
            assert out.columns == df.columns
        out.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        kept[name] = docs
    ids = lambda n: sorted(r.doc_id for r in kept[n].select("doc_id").collect())
    clean = [(i, t) for i, t, _ in rows if not (t and "blorfish" in t)]
    assert ids("toxicity") == sorted(i for i, _ in clean)
    first, seen = [], set()
    for i, t in sorted(clean):
        if t is None or t not in seen:
            first.append((i, t))
        seen.add(t)
    assert ids("exact_dedup") == sorted(i for i, _ in first)
    groups = brute_groups(first)
    assert ids("near_dedup") == sorted(i for i, _ in first if groups.get(i, i) == i)
    length = {i: len(encoding(VOCAB).encode_ordinary(t or "")) for i, t, _ in rows}
    per = {s: sum(length[r.doc_id] for r in kept["mixing"].collect() if r.source == s) for s in ("s0", "s1")}
    assert abs(per["s0"] - per["s1"]) <= 2 and set(ids("mixing")) <= set(ids("near_dedup"))
    text = dict((i, t) for i, t, _ in rows)
    for r in kept["bpe"].collect():
        assert r.ids is None if text[r.doc_id] is None else r.ids == encoding(VOCAB).encode_ordinary(text[r.doc_id])
    assert sentence(rng, 2)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == ids("bpe")
