import random

import numpy as np

from veilspark.llm import jaccard


def words(text):
    return [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()]


def brute(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdÉe") for _ in range(rnd.randint(1, 6))) for _ in range(200)]
    licence = " ".join(rnd.choice(vocabulary) for _ in range(30))
    bases = [[rnd.choice(vocabulary) for _ in range(rnd.randint(3, 160))] for _ in range(25)]
    rows = []
    for i in range(220):
        base = rnd.choice(bases)[:]
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
            base[rnd.randrange(len(base))] = rnd.choice(vocabulary)
        text = " ".join(base)
        if rnd.random() < 0.3:
            text += "\n" + licence
        rows.append((i * 7 % 1009, text.upper() if rnd.random() < 0.1 and text.isascii() else text))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "a b"), (2004, "A  b"), (2005, "a b c"), (2006, licence), (2006, licence), (2007, bases[0] and " ".join(bases[0]) * 40)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, key string").repartition(4)


def test_equals_brute_force(spark):
    rows = corpus(1)
    assert sorted(tuple(r)[:3] for r in jaccard.similarity_classes(frame(spark, rows)).collect()) == brute(rows)


def test_only_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "STARS", 0)
    rows = corpus(2)[::2]
    assert sorted(tuple(r)[:3] for r in jaccard.similarity_classes(frame(spark, rows)).collect()) == brute(rows)


def test_buckets_make_no_pairs_as_rows(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "STARS", 1)
    made, sketched = [], jaccard.sketched

    def watched(pairs, classes):
        made.append(pairs.count())
        return sketched(pairs, classes)

    monkeypatch.setattr(jaccard, "sketched", watched)
    rows = corpus(4)[::2]
    got = jaccard.similarity_classes(frame(spark, rows).repartition(1)).collect()
    assert sorted(tuple(r)[:3] for r in got) == brute(rows)
    assert len(made) == 1  # pairs with hubs only, which are fewer than the rows of the buckets


def test_near_pairs_are_those_of_a_join(spark):
    rnd = random.Random(6)
    bases = [rnd.sample(range(8_000), 30) for _ in range(6)]
    sets = {k: np.sort(np.array([x if rnd.random() < 0.9 else rnd.randrange(8_000) for x in rnd.choice(bases)], np.uint64) << np.uint64(24)) for k in range(40)}
    cuts = lambda x: np.searchsorted(x >> np.uint64(24), np.arange(jaccard.FRAGMENTS + 1) * 1_000)
    classes = spark.createDataFrame([(k, jaccard.sketch(x, cuts(x))) for k, x in sets.items()], "sid long, sketch binary")
    rows = [(g, k, rnd.randrange(12), 30, rnd.randrange(7)) for g in range(30) for k in rnd.sample(sorted(sets), rnd.choice([2, 3, 30]))]
    buckets = spark.createDataFrame(rows, "gram long, sid long, c long, n int, at int").repartition(3)
    right = buckets.toDF("gram", "other", "oc", "m", "on")
    joined = buckets.join(right, "gram").where("c < oc").where(jaccard.possible("n", "m", "at", "on")).selectExpr("least(sid, other) AS a", "greatest(sid, other) AS b").distinct()
    wanted = jaccard.sketched(joined, classes.selectExpr("sid", "30L AS n", "sketch"))
    for batch in ("7", "2000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        assert sorted(map(tuple, jaccard.near_pairs(buckets, classes).collect())) == sorted(map(tuple, wanted.collect()))
    assert 0 < wanted.count() < joined.count()


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "STARS", 0)
    monkeypatch.setattr(jaccard, "WIDE", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    rows = corpus(3)[::2]
    assert sorted(tuple(r)[:3] for r in jaccard.similarity_classes(frame(spark, rows)).collect()) == brute(rows)


def test_empty_table_and_null_id(spark):
    assert jaccard.similarity_classes(frame(spark, [(1, "x")]).where("false")).count() == 0
    got = jaccard.similarity_classes(frame(spark, [(None, "a b c"), (4, "d e f")])).collect()
    assert {tuple(r)[:3] for r in got} == {(None, 1, None), (4, 1, 4)}
