import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from veilspark.llm import tokens

TEXTS = [
    (5, "It's the End, of  it.\n\nAnd\tmore: 12345 !!! naïve ÉCOLE"),
    (3, None),
    (3, ""),
    (9, " \n "),
    (None, "no id <|endoftext|> here"),
    (7, "same words " * 3000),
    (7, "same words " * 3000),
    (-4, "ﬁ é  x y \x1c z"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ids string, start int").repartition(3)


def expected(rows):
    tokenizer = Tokenizer.from_file(tokens.tokenizer_path())
    return [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows]


def test_files_hold_every_id_in_order(spark):
    got = sorted(tuple(r) for r in tokens.token_output(frame(spark, TEXTS)).fillna(-(10**9), ["doc_id"]).collect())
    want, start = [], 0
    for doc, ids in sorted(expected([(-(10**9) if i is None else i, t) for i, t in TEXTS]), key=lambda x: x[0]):
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [x[0] for x in got] == [x[0] for x in want]
    assert sorted(x[2:] for x in got) == sorted(x[2:] for x in want)
    assert [s for s, _ in sorted((x[1], x[2]) for x in got)] == list(np.cumsum([0] + [n for _, n in sorted((x[1], x[2]) for x in got)])[:-1])


def test_pieces_rebuild_every_document(spark):
    rows = [x for x in TEXTS if x[0] is not None]
    got = [r.asDict() for r in tokens.pack(frame(spark, rows), length=64).collect()]
    total = sum(len(ids) for _, ids in expected(rows))
    filled = sorted((r["sequence_id"] * 64 + r["offset"], r["length"]) for r in got)
    at = 0
    for position, size in filled:
        assert position == at
        at += size
    assert at == total
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        whole = [x for i, x in expected(rows) if i == r["doc_id"] and len(x) == r["doc_tokens"]]
        assert any(list(ids) == x[r["start"] : r["start"] + r["length"]] for x in whole)
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and r["offset"] + r["length"] <= 64


def test_empty_table(spark):
    empty = frame(spark, [(1, "x")]).where("false")
    assert tokens.token_output(empty).count() == 0 and tokens.pack(empty).count() == 0


def test_one_document_is_read_without_the_rest():
    out = tokens.TokenFile(b"")
    for doc in range(3):
        out.add(doc, np.arange(doc, doc + 5, dtype="<u4"))
    data = out.data()
    assert [(d, b, list(i)) for d, b, i in tokens.read_file(data, b"", {1})] == [(1, 5, [1, 2, 3, 4, 5])]
    with pytest.raises(ValueError):
        list(tokens.read_file(data, b"other"))
