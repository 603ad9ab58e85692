import random

from tests.llm.test_lines import BLANK, corpus
from veilspark.llm import lines


def whole(rows):
    """Lines left and gone where every run of SHORTEST lines, or of fewer with LONG words, with any earlier place goes; no hashes, no fingerprints."""
    k = lines.SHORTEST
    rank = lambda i: -(2**63) if i is None else i
    full = [[x.strip(BLANK) for x in (t or "").split("\n") if x.strip(BLANK)] for _, t in rows]
    runs = [[(p, tuple(f[p : p + n])) for n in range(1, k + 1) for p in range(len(f) - n + 1) if n == k or sum(len(x.encode().split()) for x in f[p : p + n]) >= lines.LONG] for f in full]
    first = {}
    for (i, _), held in zip(rows, runs):
        for _, run in held:
            first[run] = min(first.get(run, rank(i)), rank(i))
    out = []
    for (i, t), f, held in zip(rows, full, runs):
        gone, met = set(), set()
        for p, run in held:
            if first[run] < rank(i) or run in met:
                gone.update(range(p, p + len(run)))
            met.add(run)
        kept, n = [], 0
        for x in (t or "").split("\n"):
            full_line = bool(x.strip(BLANK))
            if not full_line or n not in gone:
                kept.append(x)
            n += full_line
        out.append((i, "\n".join(kept), len(f), len(gone)))
    return sorted(map(str, out))


def removed(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(str(tuple(r)) for r in lines.remove_repeated_runs(frame).collect())


def test_any_earlier_run_goes(spark):
    rows = [(1, "x\ny"), (2, "w\nx\ny\nz"), (3, "w\nx\ny\nz"), (4, "w\nx\ny\nq"), (4, "x\ny\nz\nq"), (5, "q\nx\ny\nz")]
    rows += [(10 * i + k, t) for i, (a, b) in enumerate(["pq", "qr", "rs", "st", "tu"], 2) for k, t in enumerate([f"{a}\n{b}", f"{b}\n{a}", f"0\n{a}\n{b}\n1", f"0\n{a}\n{b}\n1"])]
    assert removed(spark, rows) == whole(rows)


def test_equals_whole_brute_force(spark):
    for seed in (1, 2, 3):
        rows = corpus(seed)
        assert removed(spark, rows) == whole(rows)
    rnd = random.Random(4)
    rows = [(rnd.randint(0, 60), "\n".join(rnd.choice("abc") for _ in range(rnd.randint(0, 12)))) for _ in range(120)]
    assert removed(spark, rows) == whole(rows)


def test_short_runs_of_many_words_go(spark):
    many, half, rest = (" ".join(f"{c}{k}" for k in range(n)) for c, n in (("m", lines.LONG), ("h", lines.LONG // 2), ("r", lines.LONG - lines.LONG // 2)))
    few = many.rpartition(" ")[0]
    rows = [(1, f"a\n{many}\nb\n{few}"), (2, f"c\n {many}\nd"), (3, many), (4, f"{half}\n{rest}"), (5, f"e\n{half}\n\n{rest}\nf"), (6, f"{half}\ng\n{rest}"), (7, f"{few}\nh"), (8, f"a\n{many}"), (9, f"i\n{rest}\n{half}\n{rest}"), (9, f"{half}\n{rest}")]
    left = [(1, rows[0][1]), (2, "c\nd"), (3, ""), (4, rows[3][1]), (5, "e\n\nf"), (6, rows[5][1]), (7, rows[6][1]), (8, ""), (9, f"i\n{rest}"), (9, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((r.doc_id, r.text) for r in lines.remove_repeated_runs(frame).collect()) == sorted(left)
