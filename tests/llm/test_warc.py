import hashlib

from veilspark.llm import warc

LONG = "<p>" + "é" * 80 + "</p>"


def pages():
    return [(1, "http://a/1", LONG), (2, "http://a/\r\n2", LONG), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", "null id " * 30), (8, "u", "x" * 99), (9, "u", "x" * 99), (10, "u", "WARC/1.1\r\n\r\n" * 40), (0, "u", LONG)]


def expected(rows):
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h in rows:
        raw, original = (h or "").encode(), first.get(h)
        later = original is not None and original != i
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if later else "response", original if later else None))
    return out


def test_round_trip(spark):
    frame = spark.createDataFrame([(*r, 1) for r in pages()], "page_id long, url string, html string, digest int")
    got = warc.warc_round_trip(frame.repartition(3)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, expected(pages())))
    assert warc.warc_round_trip(frame.where("false")).count() == 0


def records():
    return [warc.build_record(i, "u", f"payload {i} ".encode() * 20, hashlib.sha256(f"payload {i} ".encode() * 20).hexdigest(), 0, None) for i in range(5)]


def check(data, lost):
    found = list(warc.salvage(data))
    assert [x[3]["x-page-id"] for x in found if x[0] == "record"] == [str(i) for i in range(5) if i not in lost]
    gaps = [x for x in found if x[0] == "gap"]
    assert bool(gaps) == bool(lost)
    at = 0
    for _, a, b, *_ in found:
        assert a == at
        at = b
    assert at == len(data)
    return gaps


def test_salvage_members():
    members = [warc.gzip_member(r) for r in records()]
    check(b"".join(members), [])
    bad = members[:]
    bad[2] = bad[2][:40] + b"\0\0\0\0" + bad[2][44:]
    (gap,) = check(b"".join(bad), [2])
    assert gap[1:3] == (len(bad[0]) + len(bad[1]), len(bad[0]) + len(bad[1]) + len(bad[2]))
    check(b"".join(members[:4]) + members[4][:-30], [4])
    garbage = list(warc.salvage(b"junk" + b"".join(members)))
    assert garbage[0][:3] == ("gap", 0, 4) and sum(x[0] == "record" for x in garbage) == 5


def test_salvage_plain_records():
    plain = records()
    check(b"".join(plain), [])
    bad = plain[:]
    bad[1] = bad[1].replace(b"payload 1", b"payl0ad 1")
    (gap,) = check(b"".join(bad), [1])
    assert gap[3] == "the block digest differs"
    bad[3] = bad[3].replace(b"Content-Length: ", b"Content-Length: 9")
    assert len(check(b"".join(bad), [1, 3])) == 2
    assert list(warc.salvage(b"")) == []


def test_gaps_are_reported(spark, tmp_path):
    members = [warc.gzip_member(r) for r in records()]
    (tmp_path / "a.warc.gz").write_bytes(members[0] + b"broken" + members[1])
    rows = warc.read_warc(spark, f"file://{tmp_path}").orderBy("gap_start").collect()
    assert [r.status for r in rows] == ["record", "gap", "record"]
    assert rows[1].gap_end - rows[1].gap_start == 6
