import random

from veilspark.llm import lines

BLANK = " \t\n\x0b\x0c\r"


def brute(spark, rows):
    """Every earlier run, from the contract and without fingerprints: the rule by first places of fingerprints is no longer the operator's."""
    from tests.llm.test_lines_whole import whole

    return whole(rows)


def corpus(seed):
    rnd = random.Random(seed)
    pool = [" ".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 4))) for _ in range(60)]
    blocks = [[rnd.choice(pool) for _ in range(rnd.randint(1, 7))] for _ in range(8)]
    rows = []
    for i in range(80):
        text = []
        for _ in range(rnd.randint(0, 5)):
            text += rnd.choice(blocks) if rnd.random() < 0.5 else [rnd.choice(pool) for _ in range(rnd.randint(1, 4))]
            if rnd.random() < 0.3:
                text.append(rnd.choice(["", "  ", "\t"]))
        rows.append((i * 11 % 83, "\n".join("  " + x if rnd.random() < 0.2 else x for x in text)))
    return [*rows, (200, None), (201, ""), (202, "\n\n"), (None, "\n".join(blocks[0] + blocks[1])), (203, rows[5][1]), (203, rows[5][1]), (204, "one\n" * 500)]


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, gone int, hashes string").repartition(3)
        assert sorted(str(tuple(r)) for r in lines.remove_repeated_runs(frame).collect()) == brute(spark, rows)
    assert lines.remove_repeated_runs(frame.where("false")).count() == 0


def test_a_run_of_guaranteed_length_goes(spark):
    rows = [(1, "a\nb\nc\nd\ne"), (2, "x\nb\nc\nd\ny\nz"), (3, "b\nc\nq")]
    got = {r.doc_id: r.text for r in lines.remove_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "a\nb\nc\nd\ne", 2: "x\ny\nz", 3: "b\nc\nq"}


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame([(1, "a\nb\nc")], "doc_id long, text string")
    plan = lines.remove_repeated_runs(frame)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
