import random

import numpy as np

from veilspark.llm import topk


def brute(rows, k=5):
    ok = [(i, [int(np.floor(256 * v)) for v in x]) for i, x in rows if i is not None and x is not None and all(v is not None and np.isfinite(v) for v in x)]
    out = []
    for q in {i for i, _ in ok if i % 50 == 0}:
        own = [x for i, x in ok if i == q]
        scores = {(-sum(a * b for a, b in zip(x, y)), i) for x in own for i, y in ok if i != q and len(x) == len(y)}
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 0, "r") for i, x in rows], "vec_id long, embedding array<float>, block int, ids string").repartition(3)


def test_equals_brute_force(spark):
    rnd = random.Random(2)
    rows = [(i, [float(np.float32(rnd.gauss(0, 1))) for _ in range(8)]) for i in range(700)]
    rows += [(i, rows[3][1]) for i in range(700, 760)] + [(800, None), (850, [1.0, None] * 4), (900, [float("nan")] * 8), (901, [float("inf")] * 8), (None, rows[0][1]), (950, [1.0, 2.0]), (951, [3.0, 1.0])]
    got = topk.top_k(frame(spark, rows), block=128, queries=4).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0]), (1, [2.0]), (50, [2.0])]
    assert sorted(map(tuple, topk.top_k(frame(spark, rows)).collect())) == brute(rows)
    assert topk.top_k(frame(spark, rows).where("false")).count() == 0


def test_reading_stops_early_without_loss():
    random_ = np.random.default_rng(1)
    rows = np.floor(random_.normal(0, 1, (3000, 6)) ** 3 * 256)
    lists = topk.Lists(np.arange(3000), rows)
    for q in range(40):
        exact = rows @ rows[q]
        exact[q] = -np.inf
        want = set(np.argsort(-exact, kind="stable")[:5])
        assert want <= {i for i, _ in lists.top(rows[q], q, 5)}


def test_reading_stops_when_outsiders_cannot_qualify():
    """On vectors without any favoured direction: most lists are left before their ends, and few scores are resolved."""
    random_ = np.random.default_rng(3)
    rows = random_.normal(0, 1, (4_000, 64))
    rows = np.floor(256 * rows / np.linalg.norm(rows, axis=1)[:, None])
    lists = topk.Lists(np.arange(len(rows)), rows)
    for q in range(30):
        exact = rows @ rows[q]
        exact[q] = -np.inf
        best = sorted(zip(-exact, range(len(rows))))[:5]
        for floor in (-np.inf, -best[4][0]):
            assert {i for _, i in best} <= {i for i, _ in lists.top(rows[q], q, 5, floor)}
    assert 0 < lists.resolved < 0.01 * 60 * len(rows) and lists.read < 0.9 * lists.asked


def test_scores_beyond_a_long(spark):
    rows = [(0, [3e38, 3e38]), (1, [3e38, 1.0]), (2, [-3e38, 0.0]), (3, [1.0, 2.0]), (50, [1.0, 1.0])]
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_k(frame(spark, rows)).collect()}
    assert got[0, 1] == 2**63 - 1 and got[0, 2] == -(2**63) and got[50, 3] == 256 * 256 + 256 * 512


def test_repeated_ids(spark):
    rnd = random.Random(4)
    rows = [(i % 120, [float(rnd.randint(-9, 9)) for _ in range(6)]) for i in range(600)] + [(7, [9.0] * 6)] * 40
    assert sorted(map(tuple, topk.top_k(frame(spark, rows), block=64).collect())) == brute(rows)
