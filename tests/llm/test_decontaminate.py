import random

import numpy as np

from veilspark.llm import decontaminate as dec


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_banded_distance():
    rnd = random.Random(1)
    for _ in range(300):
        a = [rnd.randrange(4) for _ in range(rnd.randint(0, 14))]
        b = a[:] if rnd.random() < 0.5 else [rnd.randrange(4) for _ in range(rnd.randint(0, 14))]
        for _ in range(rnd.randint(0, 3)):
            if b:
                b.pop(rnd.randrange(len(b))) if rnd.random() < 0.5 else b.insert(rnd.randrange(len(b)), rnd.randrange(4))
        for most in (0, 1, 3, 6):
            assert dec.edit_distance(np.array(a, int), np.array(b, int), most) == min(levenshtein(a, b), most + 1)


def make(seed):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(500)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(5, 40)))) for i in range(15)]
    docs, planted = [], {}
    for d in range(60):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 90))]
        if d % 3 == 0:
            item, text = rnd.choice(items)
            leak, n = text.split(), len(text.split())
            for _ in range(rnd.randint(0, dec.edits_allowed(n)) // 2):
                # An insertion and a deletion, or two substitutions: windows have the item's length.
                if rnd.random() < 0.5:
                    leak.insert(rnd.randrange(n), rnd.choice(vocabulary))
                    leak.pop(rnd.randrange(n))
                else:
                    leak[rnd.randrange(n)], leak[rnd.randrange(n)] = rnd.choice(vocabulary), rnd.choice(vocabulary)
            at = rnd.randint(0, len(words))
            words[at:at] = [w.upper() + rnd.choice(["", ",", "."]) for w in leak]
            planted[d] = item
        docs.append((d, " ".join(words)))
    return docs, items, planted


def plain(text):
    """Words as the contract of the operator has them, written apart from it."""
    words = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in text.split()]
    return ["".join(c for c in w if not c.isascii() or c.isalnum()) or w for w in words]


def numbers(text, known={}):
    return np.array([known.setdefault(w, len(known)) for w in plain(text)], int)


def test_words():
    same = dec.tokens("It's ITS its, (its) --- --- é! É " + "w" * 80 + " " + "W" * 40 + "-" + "w" * 40 + " .")
    assert len(same) == 11 and len(set(same[:4].tolist())) == 1 and same[4] == same[5] and same[6] != same[7]
    assert same[8] == same[9] and len(set(same.tolist())) == 6


def test_every_text_of_an_item_is_looked_for(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "one two three four five six"), (1, "seven eight nine ten eleven twelve"), (2, "a b c d e f g"), (2, "a b c d e f g")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x seven eight nine ten eleven twelve y"), (2, "one two three four five six seven"), (3, "nothing of this kind is here at all")], "doc_id long, text string")
    for most in (20_000, 1):
        monkeypatch.setattr(dec, "PASS_ITEMS", most)
        assert sorted((r.doc_id, r.item_id, r.distance, r.start, r.n_words) for r in dec.contaminated(docs, bench).collect()) == [(1, 1, 0, 1, 6), (2, 1, 0, 0, 6)]
        assert [r.doc_id for r in dec.decontaminate(docs, bench).collect()] == [3]


def brute(docs, items):
    out = set()
    for d, t in docs:
        words = numbers(t)
        for i, x in items:
            item = numbers(x)
            n, most = len(item), dec.edits_allowed(len(item))
            if n >= dec.LEAST_WORDS and any(dec.edit_distance(item, words[s : s + n], most) <= most for s in range(len(words) - n + 1)):
                out.add((d, i))
    return out


def test_finds_what_brute_force_finds(spark, monkeypatch):
    docs, items, planted = make(3)
    frame = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert set(planted.items()) <= want
    got = {(r.doc_id, r.item_id) for r in dec.contaminated(frame, bench).collect()}
    assert got <= want and len(got) >= 0.98 * len(want)
    clean = {r.doc_id for r in dec.decontaminate(frame, bench).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in got}
    monkeypatch.setattr(dec, "PASS_ITEMS", 7)
    assert {(r.doc_id, r.item_id) for r in dec.contaminated(frame, bench).collect()} == got


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "one two three four five six"), (4, "one two " * 3000), (5, "!!! ??? ... --- ***")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three four five six"), (1, "other text"), (2, None), (None, "a b c d e f"), (3, "short"), (4, "")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.distance) for r in dec.contaminated(docs, bench).collect()] == [(None, 1, 0)]
    assert dec.contaminated(docs, bench.where("false")).count() == 0
    assert dec.contaminated(docs.where("false"), bench).count() == 0
    assert dec.decontaminate(docs, bench).count() == 4
