"""Bounded retrieval by shared tokens against scoring every document."""

import math
import random
from collections import Counter, defaultdict

import pytest

from priorlens.operators import retrieve


@pytest.mark.parametrize(("share", "trials"), [(0.3, 5), (0.0, 1), (0.9, 1), (1.0, 2)])
def test_top_by_tokens(spark, share, trials):
    r = random.Random(3)
    vocabulary = [f"t{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    docs = {d: set(r.choices(vocabulary, weights, k=r.randint(1, 40))) for d in range(300)} | {d: {"t0", "t150"} for d in range(300, 320)}
    items = {i: set(r.choices(vocabulary, weights, k=r.randint(1, 15))) for i in range(30)} | {100: {"t0", "t1"}, 101: {"unknown"}, 102: {"t150", "unknown"}, 103: set(vocabulary)}
    df = Counter(t for x in docs.values() for t in x)
    want = []
    for i, asked in items.items():
        scores = defaultdict(float)
        for d, x in docs.items():
            for t in asked & x:
                scores[d] += math.log((len(docs) + 1) / (df[t] + 1)) + 1
        best = sorted(((-round(s, 4), d) for d, s in scores.items()))[:4]
        want += [(i, n + 1, d, -s) for n, (s, d) in enumerate(best)]
    asked = spark.createDataFrame([(i, t) for i, x in items.items() for t in x], "item_id long, t string")
    words = spark.createDataFrame([(d, t) for d, x in docs.items() for t in x], "doc_id long, t string")
    got = retrieve.top_by_tokens(asked, words, len(docs), 4, common_share=share, trials=trials).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(tuple(x) for x in got) == sorted(want)
