"""Whole jobs: what the registered queries and stages must not leave out."""

import collections
import random

import numpy as np
import pytest

import corpus_pipeline
from lamina.llm import licenses, mixing, toxicity
from lamina.llm.queries import QUERIES
from tests.llm.test_operators import encode, sentence


@pytest.fixture(scope="module")
def scanner():
    return licenses.Scanner()


def test_a_tiny_source_does_not_shrink_the_mixture(spark, tmp_path):
    rng = random.Random(11)
    rows = [(k, sentence(rng, rng.randint(5, 40)), s) for k, s in enumerate(["hot"] * 300 + ["a"] * 60 + ["b"] * 60)] + [(900, "alpha beta", "tiny"), (901, "", "tiny"), (902, "gamma", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    size, every = {i: len(encode(t)) for i, t, _ in rows}, collections.Counter()
    for i, _, s in rows:
        every[s] += size[i]
    got = QUERIES["op4_mix"](spark, f"file://{tmp_path}").collect()
    per = collections.Counter()
    for r in got:
        per[r.source] += r.n_tokens
    assert per["tiny"] == every["tiny"] and per[None] == every[None] and per["a"] == every["a"] and per["b"] == every["b"]
    assert abs(mixing.KEEP * sum(every.values()) - sum(per.values())) <= 2
    staged = corpus_pipeline.mixing(spark, df, "").collect()
    assert sorted(r.doc_id for r in staged) == sorted(r.doc_id for r in got)


def test_quotas_share_out_what_short_sources_leave():
    assert mixing.quotas({"a": 10, "b": 100, "c": 1000}, {"a": 1, "b": 1, "c": 2}, 600) == {"a": 10, "b": 100, "c": 490}
    assert mixing.quotas({"a": 10, "b": 0}, {"a": 1, "b": 1}, 50) == {"a": 10, "b": 0}
    assert mixing.quotas({"a": 100, "b": 100}, {"a": 1, "b": 0}, 60) == {"a": 60, "b": 0}


#: What a line is detected as, and a line much like it that holds no such license.
LINES = [
    ("BSD 3-Clause License", "BSD-3-Clause", "BSD 3-clauses"), ("BSD 2-Clause License", "BSD-2-Clause", "BSD 22-Clause License"), ('BSD 3-Clause "New" or "Revised" License', "BSD-3-Clause", "a 3 clause sentence"),
    ("under GPLv3.", "GPL-3.0", "GPLv31"), ("GPL v2 here", "GPL-2.0", "GPL vx2"), ("the GNU GPL, of course", "GPL", "GNU GPLX"), ("GNU LGPL", "LGPL", "GNU LGPLs"), ("LGPLv2.1", "LGPL-2.1", "LGPLv2.15"), ("AGPLv3", "AGPL-3.0", "AGPLv35"),
    ("GPLv3+", "GPL-3.0-or-later", "GPLv3 and later work"), ("GPL v2 or later", "GPL-2.0-or-later", "GPL v2 or never"), ("LGPLv2.1+", "LGPL-2.1-or-later", "LGPLv2.1"), ("AGPL-3.0-or-later", "AGPL-3.0-or-later", "AGPL-3.0"),
    ("license: Apache-2.0", "Apache-2.0", "license: Apache-2.0.1"), ("Apache 2.0", "Apache-2.0", "Apache 2.4"), ("GPL-3.0", "GPL-3.0", "XGPL-3.0"), ("GPL-2.0-only", "GPL-2.0", "GPL-2.0-or-later"), ("CC-BY-4.0", "CC-BY-4.0", "CC-BY-4.01"),
    ("MPL 2.0", "MPL-2.0", "MPL 2.5"), ("EPL-2.0", "EPL-2.0", "EPL-2.05"), ("released under the GPL", "GPL", "released under the GPLX"), ("ASL 2.0", "Apache-2.0", "ASL 20"), ("EUPL 1.2", "EUPL-1.2", "EUPL 1.25"), ("CDDL 1.0", "CDDL-1.0", "CDDL 1.05"),
    ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "Classpath-exception-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
]


@pytest.mark.parametrize("line, name, not_so", LINES)
def test_usual_forms_of_licenses(scanner, line, name, not_so):
    found = lambda t: [scanner.rules[n][0] for *_, n in scanner.scan(t)]
    assert name in found(line) and name not in found(not_so)


@pytest.mark.parametrize("line, names", [
    ("SPDX-License-Identifier: MIT OR Apache-2.0", ["MIT", "Apache-2.0"]), ("SPDX-License-Identifier: (MIT OR Apache-2.0) AND ISC", ["MIT", "Apache-2.0", "ISC"]),
    ("SPDX-License-Identifier: GPL-2.0+ OR (MIT AND BSD-3-Clause) and more", ["GPL-2.0-or-later", "MIT", "BSD-3-Clause"]), ("SPDX-License-Identifier: MIT\nOR ISC", ["MIT"]),
])
def test_every_id_of_an_spdx_expression(scanner, line, names):
    assert [scanner.rules[n][0] for *_, n in scanner.scan(line)] == names


def test_only_contained_detections_fall(scanner):
    for mark, version, own in ((";", "3", "GPL-2.0"), (":", "2", "GPL-3.0")):
        head = f"This program is free software{mark} you can redistribute it and/or modify it under the terms of the GNU General Public License version {version} as published by the Free Software Foundation."
        assert [scanner.rules[n][0] for *_, n in scanner.scan(head)] == [own, f"GPL-{version}.0"]
    rng = random.Random(3)
    for _ in range(200):
        found = [(a := rng.randrange(30), a + rng.randint(1, 12), rng.randrange(len(scanner.rules))) for _ in range(12)]
        stand = []
        for d in sorted(set(found), key=lambda d: (-scanner.rules[d[2]][2], d[0] - d[1], d[2], d[0])):
            if not any(a <= d[0] and d[1] <= b for a, b, _ in stand):
                stand.append(d)
        assert scanner.resolve(found) == sorted(stand)


@pytest.mark.parametrize("p, listed", [([0.5] * 5, 4), ([0.5, 0.9, 0.5, 0.5], 3), ([0.1, 0.7, 0.1], 1), ([0.2, 0.3], 0)])
def test_offenders_are_listed_until_the_rest_is_clean(p, listed):
    p, n = np.array(p), len(p)
    s = np.array([1 - np.prod(1 - p)])
    raw = np.frombuffer(b"a. " * n, np.uint8)
    (got,) = toxicity.locate(s, p, 3 * np.arange(n), np.array([0]), raw, np.array([0, 3 * n]), 0.6)
    assert [x["score"] for x in got] == sorted(p.tolist(), reverse=True)[:listed]
    assert len({x["begin"] for x in got}) == listed


def test_fingerprints_reach_their_sources(spark, tmp_path):
    rng = random.Random(7)
    rows = [(k, sentence(rng, rng.randint(0, 30)), rng.choice(["a", "b", None])) for k in range(60)] + [(None, None, "b"), (70, "one two", "alone")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = QUERIES["op8_fingerprints"](spark, f"file://{tmp_path}").collect()
    each, whole = [r for r in got if r.level == "document"], {r.source: r for r in got if r.level == "source"}
    assert len(each) == len(rows) and set(whole) == {s for *_, s in rows}
    for s, w in whole.items():
        assert w.sketch == sorted({x for r in each if r.source == s for x in r.sketch})[:128]
    for r in each:
        both = sorted({*r.sketch, *whole[r.source].sketch})[:128]
        same = len({*both} & {*r.sketch} & {*whole[r.source].sketch})
        assert r.resemblance is None if not r.sketch else abs(r.resemblance - same / len(both)) < 1e-9
        assert (r.containment is None) == (not r.sketch)
    alone = next(r for r in each if r.doc_id == 70)
    assert alone.resemblance == alone.containment == 1
