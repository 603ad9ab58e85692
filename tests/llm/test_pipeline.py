import numpy as np
import pytest

import corpus_pipeline as pipeline
from tests.llm import test_decontaminate as decontaminate_cases
from tests.llm import test_jaccard as jaccard_cases
from tests.llm import test_lines_whole as line_cases
from veilspark.llm import decontaminate, lines, quality, tokens


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output on the smallest tables, written and read again."""
    at, sf = tmp_path_factory.mktemp("stages"), "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(at / str(k)))
        after = spark.read.parquet(str(at / str(k)))
        out.append((docs, after))
        docs = after
    return sf, out


def pairs(frame):
    return sorted((r.doc_id, r.text) for r in frame.collect())


def test_columns_are_those_of_documents(stages):
    for before, after in stages[1][:4]:
        assert set(after.columns) == set(pipeline.COLUMNS) and dict(after.dtypes) == dict(before.dtypes)


def test_quality(spark, stages):
    before, after = stages[1][0]
    machine = quality.train(before, spark.read.parquet(f"{stages[0]}/labels.parquet"))
    assert pairs(after) == [x for x in pairs(before) if machine.score(x[1]) >= 0.3]


def test_lines(spark, stages):
    before, after = stages[1][1]
    brute = line_cases.whole(pairs(before))
    assert sorted(str(tuple(r)) for r in lines.remove_repeated_runs(before).collect()) == brute
    kept = [x for x in map(eval, brute)]
    assert pairs(after) == sorted((i, t) for i, t, *_ in kept)


def test_jaccard(stages):
    before, after = stages[1][2]
    found = jaccard_cases.brute(pairs(before))
    assert [i for i, _ in pairs(after)] == sorted(i for i, n, c in found if n == 0 or i == c)


def test_decontamination(spark, stages):
    """Against every window of every document, without the operator's index."""
    before, after = stages[1][3]
    items = [decontaminate_cases.numbers(r.text) for r in spark.read.parquet(f"{stages[0]}/benchmark.parquet").collect()]
    clean = []
    for i, t in pairs(before):
        words = decontaminate_cases.numbers(t)
        hit = False
        for x in items:
            n, most = len(x), decontaminate.edits_allowed(len(x))
            if n <= len(words) and not hit:
                # Words that both have, over windows: edits change one each at most.
                common = np.concatenate([[0], np.cumsum(np.isin(words, x))])
                starts = np.flatnonzero(common[n:] - common[:-n] >= n - most)
                windows = words[starts[:, None] + np.arange(n)]
                hit = bool(len(starts)) and bool((decontaminate.edit_distances(np.tile(x, (len(starts), 1)), windows, most) <= most).any())
        if not hit:
            clean.append((i, t))
    assert pairs(after) == clean


def test_packing_and_run(spark, stages):
    before, after = stages[1][4]
    assert after.agg({"length": "sum"}).first()[0] == sum(len(x) // 4 + 1 for x in tokens.encoder(tokens.tokenizer_path()).batch([t for _, t in pairs(before)]))
    key = lambda f: sorted((r.doc_id, r.start, r.ids_crc32, r.length) for r in f.collect())
    got = pipeline.run(spark, stages[0])
    assert {x[0] for x in key(got)} == {x[0] for x in key(after)} and got.agg({"length": "sum"}).first() == after.agg({"length": "sum"}).first()
