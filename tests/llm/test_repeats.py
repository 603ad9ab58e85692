import dataclasses
import hashlib
import random

import numpy as np
import pytest

from veilspark.llm import fmindex, repeats, suffixes


def corpus(seed=0, n=60):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeéz") for _ in range(rnd.randint(1, 5))) for _ in range(40)]
    passages = [" ".join(rnd.choice(words) for _ in range(rnd.randint(40, 130))) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            kind = rnd.random()
            if kind < 0.4:
                parts.append(rnd.choice(passages))
            elif kind < 0.5:
                parts.append(rnd.choice(["ab " * 90, "=" * 300, "x y z " * 60]))
            elif kind < 0.6 and rows:
                parts.append((rnd.choice(rows)[1] or "")[5:900])
            else:
                parts.append(" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 90))))
        rows.append((i * 3 % 101, rnd.choice([" ", "\n", "\t\x0b "]).join(parts)))
    rows += [(500, None), (501, ""), (502, "short"), (None, passages[0] + " tail"), (7000, rows[3][1]), (7000, rows[3][1]), (7001, rows[4][1]), (7001, rows[5][1] + passages[1])]
    rnd.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "key", 3) for i, t in rows], "doc_id long, text string, key string, start int").repartition(4)


def runs(gone):
    return int((np.diff(np.append(0, gone.astype(int))) == 1).sum())


def brute_bytes(rows, n=100):
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for s in range(len(raw) - n + 1):
            k, at = raw[s : s + n], (-1 if i is None else i, s)
            first[k] = min(first.get(k, at), at)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - n + 1):
            if first[raw[s : s + n]] < (-1 if i is None else i, s):
                gone[s : s + n] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i, len(raw), int(gone.sum()), runs(gone), hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(rows, n=50):
    first = {}
    for i, t in rows:
        words = (t or "").encode().split()
        for s in range(len(words) - n + 1):
            k, at = tuple(words[s : s + n]), (-1 if i is None else i)
            first[k] = min(first.get(k, at), at)
    out = []
    for i, t in rows:
        words = (t or "").encode().split()
        gone = np.zeros(len(words), bool)
        for s in range(len(words) - n + 1):
            if first[tuple(words[s : s + n])] < (-1 if i is None else i):
                gone[s : s + n] = True
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return out


def order(rows):
    return sorted(tuple(-1 if x is None else x for x in r) for r in rows)


@pytest.mark.parametrize("seed", [0, 1])
def test_bytes_equal_brute_force(spark, seed):
    rows = corpus(seed)
    assert order(tuple(r)[:5] for r in suffixes.remove_repeats(frame(spark, rows)).collect()) == order(brute_bytes(rows))


@pytest.mark.parametrize("seed", [2, 3])
def test_words_equal_brute_force(spark, seed):
    rows = corpus(seed)
    got = fmindex.remove_repeats(frame(spark, rows)).collect()
    assert order(tuple(r)[:4] for r in got) == order(brute_words(rows))
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)


def edges(words, n=120):
    """One passage between surroundings that differ, but for a few bytes next to it in some: all its edges share a key."""
    rnd = random.Random(7)
    passage = " ".join("%06d" % rnd.randrange(10**6) for _ in range(words))
    near = ["a b", "a c", "d c"]
    around = lambda: " ".join("%05d" % rnd.randrange(10**5) for _ in range(60))
    return [(i, f"{around()} {rnd.choice(near)} {passage} {rnd.choice(near)} {around()}") for i in range(n)]


@pytest.mark.parametrize("module, name, brute, columns", [(suffixes, "BYTES", brute_bytes, 5), (fmindex, "WORDS", brute_words, 4)])
def test_frequent_keys_are_split(spark, monkeypatch, module, name, brute, columns):
    unit = dataclasses.replace(getattr(module, name), key_units=300)
    monkeypatch.setattr(module, name, unit)
    fullest = []
    contents = repeats.contents

    def watched(texts, entries, unit):
        fullest.append(max((r.n for r in entries.groupBy("key").agg({"windows": "count"}).withColumnRenamed("count(windows)", "n").collect()), default=0))
        return contents(texts, entries, unit)

    monkeypatch.setattr(repeats, "contents", watched)
    rows = edges(unit.length // 3 if name == "BYTES" else unit.length + 20)
    got = module.remove_repeats(frame(spark, rows)).collect()
    assert order(tuple(r)[:columns] for r in got) == order(brute(rows))
    assert fullest[0] * unit.length <= 2 * unit.key_units  # each entry has a window's units at least
    rows = corpus(4)
    got = module.remove_repeats(frame(spark, rows)).collect()
    assert order(tuple(r)[:columns] for r in got) == order(brute(rows))


def test_empty_table(spark):
    empty = frame(spark, [(1, "x")]).where("false")
    assert suffixes.remove_repeats(empty).count() == 0 and fmindex.remove_repeats(empty).count() == 0


def test_buckets_are_the_order_of_suffixes():
    rnd = random.Random(5)
    text = bytes(rnd.choice(b"ab") for _ in range(400)) * 2
    raw = np.frombuffer(text, np.uint8)
    pointer = suffixes.buckets(raw, 100)
    whole = range(len(text) - 99)
    for p in whole:
        for q in (p + 1, (p * 7) % len(whole), (p + 400) % len(whole)):
            if q in whole:
                assert (text[p : p + 100] == text[q : q + 100]) == (pointer[p] == pointer[q])
                assert (text[p : p + 100] < text[q : q + 100]) == (pointer[p] < pointer[q])


def test_wavelet_ranks_and_suffix_array():
    rnd = np.random.default_rng(3)
    text = rnd.integers(0, 37, 1000)
    tree = fmindex.WaveletTree(text, 37)
    symbol, at = rnd.integers(0, 37, 300), rnd.integers(0, 1001, 300)
    assert list(tree.rank(symbol, at)) == [int((text[:a] == s).sum()) for s, a in zip(symbol, at)]
    small = rnd.integers(0, 3, 200)
    assert list(fmindex.suffix_array(small)) == sorted(range(200), key=lambda i: list(small[i:]))
