import hashlib

import pytest

from tests.llm.test_warc import expected, records
from veilspark.llm import warc


def test_long_urls(spark):
    rows = [(1, "data:," + "x" * 70_000, "a" * 200), (2, "\t" * 30_000, "b" * 200), (3, "data:," + "y" * 200_000, "a" * 200), (4, "u", "c")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = warc.warc_round_trip(frame).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, expected(rows)))


def test_long_headers_in_plain_archives():
    block = b"payload " * 20
    long = warc.build_record(7, "data:," + "x" * 70_000, block, hashlib.sha256(block).hexdigest(), len(block), None)
    whole = list(warc.salvage(b"".join([*records()[:2], long, *records()[2:]])))
    assert [x[3]["x-page-id"] for x in whole] == ["0", "1", "7", "2", "3", "4"]
    cut = list(warc.salvage(b"".join([*records()[:2], long[:50_000] + b"\r\n", *records()[2:]])))
    assert [x[0] for x in cut] == ["record", "record", "gap", "record", "record", "record"]


def test_a_record_that_is_not_read_back_is_an_error(spark, monkeypatch):
    def cut(folder, name, read=warc.get_file):
        return read(folder, name)[:-40]

    monkeypatch.setattr(warc, "get_file", cut)
    frame = spark.createDataFrame([(1, "u", "a" * 200)], "page_id long, url string, html string")
    with pytest.raises(Exception, match="0 of 1 records, gaps"):
        warc.warc_round_trip(frame).collect()


def test_what_a_lost_attempt_left_is_not_read(spark, monkeypatch):
    rows = [(k, "u", f"page {k} " * 40) for k in range(20)]

    def write(pages, folder, *rest, write=warc.write_warc):
        warc.put_file(folder, "pages-00000000-00000-lost.warc.gz", b"".join(map(warc.gzip_member, records())))
        return write(pages, folder, *rest)

    monkeypatch.setattr(warc, "write_warc", write)
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(map(str, (tuple(r) for r in warc.warc_round_trip(frame).collect()))) == sorted(map(str, expected(rows)))
