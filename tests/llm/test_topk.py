import random

import numpy as np
import pytest
from llm import cases

from quern.llm import topk


def brute(rows, is_query, k):
    out = []
    for q in sorted({i for i, _ in rows if is_query(i)}):
        v = min(v for i, v in rows if i == q)
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in rows if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread,chunk", [(3, 10_000), (1000, 7), (1 << 29, 10_000)])
def test_against_brute_force(spark, spread, chunk):
    """Small values give many ties, very large ones go through whole-number products."""
    rnd = random.Random(spread)
    rows = [(i, [rnd.randrange(-spread, spread) for _ in range(6)]) for i in range(900)]
    rows += [(i, rows[5][1]) for i in range(2000, 2300)] + [(10, rows[0][1]), (10, rows[10][1]), (4000, []), (4010, [spread])]
    frame = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(5)
    got = sorted(map(tuple, topk.top_k(frame, "vec_id % 10 = 0", 5, chunk).collect()))
    assert got == brute(rows, lambda i: i % 10 == 0, 5)


def test_most_blocks_are_skipped():
    """Of clustered vectors in any order, a query scores the blocks of its own cluster; the answers are those of a full scan."""
    rng = np.random.default_rng(7)
    centres = rng.integers(-4000, 4000, (40, 16))
    vectors = np.concatenate([c + rng.integers(-60, 60, (400, 16)) for c in centres])[rng.permutation(16_000)]
    ids = np.arange(len(vectors))
    search = topk.Search(ids[::50], vectors[::50], 5)
    for lo in range(0, len(ids), 8000):
        search.add(ids[lo : lo + 8000], vectors[lo : lo + 8000])
    assert search.scored < 0.2 * search.seen
    scores = vectors[::50] @ vectors.T
    scores[np.arange(320), ids[::50]] = -(1 << 62)
    want = np.lexsort((np.broadcast_to(ids, scores.shape), -scores))[:, :5]
    assert (search.found.reshape(-1, 5) == want).all()


def test_like_together():
    rng = np.random.default_rng(8)
    for n in (0, 1, 256, 257, 1000, 5000):
        assert sorted(topk.like_together(rng.normal(size=(n, 4)))) == list(range(n))
    assert sorted(topk.like_together(np.zeros((1000, 3)))) == list(range(1000))


def test_other_columns(spark):
    frame = spark.createDataFrame([(0, [1], 5, 7), (1, [2], 6, 8)], "vec_id long, v array<long>, score long, query_id long")
    assert [tuple(r) for r in topk.top_k(frame, "vec_id = 0").collect()] == [(0, 1, 1, 2)]


def test_odd_rows(spark):
    rows = [(0, [0.5, -0.5]), (1, None), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (5, [1.0, 2.0]), (None, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    numbers = topk.whole_numbers(frame)
    assert cases.sorted_rows(numbers) == [(0, [128, -128]), (5, [256, 512])]
    assert [tuple(r) for r in topk.top_k(numbers, "vec_id % 50 = 0").collect()] == [(0, 1, 5, 128 * 256 - 128 * 512)]
    assert topk.top_k(numbers.limit(0), "vec_id % 50 = 0").count() == 0
    assert topk.top_k(numbers, "vec_id = 77").count() == 0


def test_against_sql(spark):
    cases.against_sql(spark, topk.op1_topk, topk.ORACLE_SQL)
