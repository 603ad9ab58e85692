import zlib

import numpy as np

from veilspark.llm import quality


def test_linear_time_equals_all_pairs():
    random = np.random.default_rng(0)
    machine = quality.Machine(0.3, random.normal(size=quality.BUCKETS + quality.STATS), random.normal(size=(quality.BUCKETS + quality.STATS, quality.FACTORS)))
    at, x = quality.features("Some words, some MORE words!\nand 12 numbers")
    pairs = sum(machine.v[at[i]] @ machine.v[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
    assert abs(machine.margin(at, x) - (machine.bias + machine.w[at] @ x + pairs)) < 1e-8


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id in got]
    assert all(g.held_out for g, _ in held) and len(held) > 500
    good, bad = np.array([g.score for g, q in held if q]), np.array([g.score for g, q in held if not q])
    area = (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean()
    right = np.mean([g.predicted == q for g, q in held])
    print(area, right, np.mean(good >= 0.3), np.mean(bad < 0.3))
    assert area > 0.97 and right > 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "text " * 5000, "y"), (3, "a", "z"), (3, "a", "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert quality.classify(docs.where("false"), labels).count() == 0
    assert quality.classify(docs, labels.where("false")).count() == 5
