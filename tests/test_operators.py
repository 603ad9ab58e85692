import json

import pytest
from pyspark.sql import functions as F

from tests.test_text import BATCH
from veilspark import sql_api
from veilspark.operators import detect, pool, redact, review, sessions
from veilspark.sources import audit, files
from veilspark.streaming.sessions import extend_sessions


def docs(spark, texts, session="s1"):
    return spark.createDataFrame([(session, k, k, t) for k, t in enumerate(texts)], "session_id string, doc_id long, ord long, text string")


def spans(spark, rows, session="s1"):
    return spark.createDataFrame([(session, o, s, k, t) for o, t, k, s in rows], "session_id string, ord long, start int, type string, text string")


FIRST = [(1, "Acme Corporation", "ORGANIZATION", 0), (1, "John Smith", "PERSON", 30), (1, "Acme Corp.", "ORGANIZATION", 50), (1, "jsmith@example.com", "EMAIL_ADDRESS", 80)]
SECOND = [(2, "Acme Corporation", "ORGANIZATION", 0), (2, "Jane Doe", "PERSON", 20), (2, "Pepsi Inc.", "ORGANIZATION", 40)]


def by_text(spark, rows, pooled):
    return {r.text: r.placeholder for r in pool.assign(spans(spark, rows), pooled).collect()}


def test_pool_is_extended(spark):
    one = pool.build_pool(spans(spark, FIRST)).cache()
    assert by_text(spark, FIRST, one) == {"Acme Corporation": "<ORG_1>", "John Smith": "<PERSON_1>", "Acme Corp.": "<ORG_1a>", "jsmith@example.com": "<EMAIL_1>"}
    kept = pool.from_state_json(pool.state_json(one))
    two = pool.build_pool(spans(spark, SECOND), kept)
    assert by_text(spark, SECOND, two) == {"Acme Corporation": "<ORG_1>", "Jane Doe": "<PERSON_2>", "Pepsi Inc.": "<ORG_2>"}
    assert two.count() == 6


def test_pool_from_mapping(spark):
    rows = [("s1", "<ORG_1>", "Acme Corporation"), ("s1", "<ORG_1a>", "Acme Corp."), ("s1", "<PERSON_1>", "John Smith"), ("s1", "<EMAIL_1>", "jsmith@example.com"), ("s1", "odd", "x")]
    made = pool.reconstruct(spark.createDataFrame(rows, "session_id string, placeholder string, raw string"))
    assert {(r.type, r.counter) for r in pool.counters(made).collect()} == {("ORGANIZATION", 1), ("PERSON", 1), ("EMAIL_ADDRESS", 1)}
    assert by_text(spark, SECOND, pool.build_pool(spans(spark, SECOND), made)) == {"Acme Corporation": "<ORG_1>", "Jane Doe": "<PERSON_2>", "Pepsi Inc.": "<ORG_2>"}
    prefixed = pool.reconstruct(spark.createDataFrame([("s1", "<D1_ORG_1>", "Acme")], "session_id string, placeholder string, raw string")).first()
    assert (prefixed.type, prefixed.norm, prefixed.family) == ("ORGANIZATION", "acme", 1)


def test_families_equal_a_plain_loop(spark):
    texts = [f"Zarvo {k % 23}{' Trading' if k % 3 else ''}{' Holdings of Lund' if k % 7 == 0 else ''}" for k in range(90)]
    rows = [(k, t, "ORGANIZATION", 0) for k, t in enumerate(texts)]
    heads, seen, want = [], {}, {}
    for t in texts:
        n = t.lower()
        if n in seen:
            continue
        family = next((h for h in heads if (h[0] in n or n in h[0]) and min(len(n), len(h[0])) / max(len(n), len(h[0])) >= 0.5), None)
        if family:
            family[2] += 1
            seen[n] = f"<ORG_{family[1]}{pool.letters(family[2])}>"
        else:
            heads.append([n, len(heads) + 1, 0])
            seen[n] = f"<ORG_{len(heads)}>"
        want[n] = seen[n]
    got = {r.norm: r.placeholder for r in pool.build_pool(spans(spark, rows)).collect()}
    assert got == want


def test_letters():
    assert [pool.letters(k) for k in (0, 1, 26, 27, 52, 53)] == ["", "a", "z", "aa", "az", "ba"]
    assert all(pool.number(pool.letters(k)) == k for k in range(1, 800))


def test_round_trip_over_a_session(spark):
    out, assigned, pooled = redact.anonymize(docs(spark, BATCH))
    out = out.cache()
    texts = {r.doc_id: r.anonymized_text for r in out.collect()}
    assert texts[0] == "John Smith works at <ORG_1>. His email is <EMAIL_1> and SSN <US_SSN_1>."
    assert "<ORG_1a> announced" in texts[1] and "<EMAIL_1>" in texts[1] and "<US_SSN_1>" in texts[2] and "<ORG_1>" in texts[2]
    back = redact.restore(out, pool.mapping(pooled))
    assert all(r.restored_text == r.text for r in back.collect())
    assert redact.verify(out, pool.mapping(pooled)).count() == 0
    leaky = out.withColumn("anonymized_text", F.concat("anonymized_text", F.lit(" ask leak@example.com")))
    assert {r.leak for r in redact.verify(leaky).collect()} == {"leak@example.com"}
    assert out.select(redact.already_anonymized(F.col("anonymized_text")).alias("x")).where("x").count() == 3
    assert {r.type for r in pool.safe_mapping(pool.mapping(pooled)).collect()} == {"ORGANIZATION", "EMAIL_ADDRESS", "US_SSN"}


def test_prefix_and_odd_documents(spark):
    out, *_ = redact.anonymize(docs(spark, [None, "", BATCH[0], "no data"]), prefix="D1")
    texts = [r.anonymized_text for r in out.orderBy("doc_id").collect()]
    assert texts[:2] == [None, ""] and "<D1_ORG_1>" in texts[2] and texts[3] == "no data"


def test_columns_equal_the_chain(spark):
    rows = docs(spark, ["call +1 (499) 555-6503 now", "host 192.168.100.7 or section 2.30.1.1", "tel: 555 123 4567", *BATCH])
    names = ["email", "phone_intl", "phone_us_paren", "ipv4", "us_ssn", "uk_nhs", "org_mixed_suffix"]
    from veilspark.functions import registry
    from veilspark.functions import text as one

    got = {r.doc_id: [(s.start, s.end, s.type, round(s.score, 6)) for s in r.spans] for r in detect.scan(rows, names).collect()}
    for k, r in enumerate(rows.orderBy("doc_id").collect()):
        want = [(s.start, s.end, s.kind, round(s.score, 6)) for s in one.regex_spans(r.text, [registry.BY_NAME[n] for n in names]) if s.score >= 0.3]
        assert got[k] == want


def test_scan_needs_no_python(spark):
    plan = detect.scan(docs(spark, BATCH), ["email", "ipv4"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_overrides(spark):
    df = detect.detect(docs(spark, ["Agreement of Acme Corp and Pepsi Tower, pepsi tower."]))
    df = df.withColumn("overrides", F.expr("named_struct('remove', array(0), 'add', array(named_struct('text', 'Pepsi Tower', 'type', 'LOCATION', 'start', cast(null as int), 'end', cast(null as int))))"))
    got = review.apply_overrides(df).first().spans
    assert [(s.type, s.text) for s in got] == [("LOCATION", "Pepsi Tower"), ("LOCATION", "pepsi tower")]


def test_normalized_additions(spark):
    df = docs(spark, ["one two"]).withColumn("add", F.expr("array(named_struct('text', 'two', 'type', 'X', 'start', cast(null as int), 'end', cast(null as int)), named_struct('text', 'zz', 'type', 'X', 'start', cast(null as int), 'end', cast(null as int)))"))
    got = df.select(review.normalized_additions(F.col("add"), F.col("text")).alias("a")).first().a
    assert [(x.text, x.start, x.end) for x in got] == [("two", 4, 7)]


def test_store_and_archive(spark, tmp_path):
    pooled = pool.build_pool(spans(spark, FIRST))
    path = str(tmp_path / "pool")
    sessions.save(pooled, path)
    sessions.save(pool.build_pool(spans(spark, SECOND, "s2")), path)
    assert sessions.load(spark, path, "s1").count() == 4 and sessions.load(spark, path).count() == 7
    rows = [r.asDict() for r in sessions.load(spark, path, "s1").collect()]
    sealed = sessions.export_session(rows, "sess_1", "secret", spark)
    found = sessions.import_session(sealed, "secret", spark)
    assert found["session_id"] == "sess_1" and sorted(map(json.dumps, found["pool"])) == sorted(json.dumps(r) for r in [dict(sorted(x.items())) for x in rows])
    cases = {
        "wrong_passphrase": (sealed, "other!", {}),
        "short_passphrase": (sealed, "abc", {}),
        "bad_magic": (b"XXXX" + sealed[4:], "secret", {}),
        "bad_version": (sealed[:4] + b"\x09" + sealed[5:], "secret", {}),
        "truncated": (sealed[:-5], "secret", {}),
        "bad_length": (sealed + b"x", "secret", {}),
        "exists": (sealed, "secret", {"existing": {"sess_1"}}),
    }
    for code, (data, word, more) in cases.items():
        with pytest.raises(sessions.ArchiveError) as e:
            sessions.import_session(data, word, spark, **more)
        assert e.value.code == code
    flipped = bytearray(sealed)
    flipped[60] ^= 1
    with pytest.raises(sessions.ArchiveError):
        sessions.import_session(bytes(flipped), "secret", spark)
    with pytest.raises(sessions.ArchiveError):
        sessions.export_session([], "sess_1", "secret", spark)


def test_hashes_and_ids(spark):
    row = spark.sql("select cast('hello world' as binary) a, cast('' as binary) b").select(sessions.sha256_of(F.col("a")).alias("a"), sessions.sha256_of(F.col("b")).alias("b")).first()
    assert row.a == "sha256:b94d27b9934d3e08a52e52d7da7dabfac484efe37a5380ee9088f7ace2efcde9"
    assert row.b == "sha256:e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    odd = spark.createDataFrame([("md5:abc",), ("sha256:zz",), (row.a,)], "h string").select(sessions.parsed_hash(F.col("h")).alias("h")).collect()
    assert [r.h for r in odd] == [None, None, row.a[7:]]
    import re

    assert re.fullmatch(sessions.ID, sessions.new_session_id())


def test_audit_hides_values():
    out = json.loads(audit.redact_json(json.dumps({"text": "Marta", "id": 3, "entities": [{"type": "PERSON", "start": 0, "raw": "Marta"}]})))
    assert out == {"text": "[5]", "id": 3, "entities": "[1]"} or out == {"text": "[5]", "id": 3, "entities": [{"type": "PERSON", "start": 0}]}
    assert audit.redact_json("no json") == "[7]" and audit.redact_json(None) is None and len(audit.redact_json(json.dumps({"a": "x" * 9000}))) == audit.CLIP + 1


def test_packages(spark, tmp_path):
    package = files.write_docx("HEADING\nContact Marta Brandt at Acme Corp.\nplain")
    assert files.docx_text(package) == "HEADING\nContact Marta Brandt at Acme Corp.\nplain"
    hidden = files.rewrite_docx(package, {"marta brandt": "<PERSON_1>", "Acme Corp": "<ORG_1>"})
    assert "Contact <PERSON_1> at <ORG_1>." in files.docx_text(hidden)
    again = files.rewrite_docx(hidden, {"<PERSON_1>": "Marta Brandt", "<ORG_1>": "Acme Corp"})
    assert files.docx_text(again) == files.docx_text(package)
    (tmp_path / "a.docx").write_bytes(package)
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "c.txt").write_text("plain é")
    got = {r.path[-6:]: r.text for r in files.read_docx(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": files.docx_text(package), "b.docx": None}
    assert [r.text for r in files.read_text(spark, str(tmp_path)).collect()] == ["plain é"]
    mapped = spark.createDataFrame([(bytearray(package), {"Marta Brandt": "<PERSON_1>"})], "content binary, mapping map<string,string>")
    assert "<PERSON_1>" in files.docx_text(bytes(files.map_docx(mapped).first().rewritten))


def test_tracked_changes():
    plain = files.write_docx("x")
    w = files.W[1:-1]
    import io
    import zipfile

    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>keep </w:t></w:r><w:ins><w:r><w:t>new</w:t></w:r></w:ins><w:del><w:r><w:delText>old</w:delText></w:r></w:del></w:p></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(plain)) as z, zipfile.ZipFile(out, "w") as to:
        for n in z.namelist():
            to.writestr(n, body if n == "word/document.xml" else z.read(n))
    assert files.docx_text(out.getvalue()) == "keep new"
    assert files.docx_text(files.resolve_changes(out.getvalue(), True)) == "keep new"
    assert files.docx_text(files.resolve_changes(out.getvalue(), False)) == "keep old"


def test_page_layout(spark):
    rows = [("d", 1, 10.0, 700.0, 40.0, "Name"), ("d", 1, 120.0, 701.0, 60.0, "Marta"), ("d", 1, 10.0, 680.0, 30.0, "next"), ("d", 1, 42.0, 680.0, 30.0, "words"), ("d", 2, 10.0, 700.0, 30.0, "end")]
    got = files.page_text(spark.createDataFrame(rows, "doc_id string, page int, x double, y double, width double, str string")).first()
    assert got.text == "Name: Marta\nnext words\n\nend"


def test_stream_extends_sessions(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    docs(spark, BATCH[:1]).coalesce(1).write.parquet(f"{src}/a")
    schema = docs(spark, []).schema

    def go():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))
        extend_sessions(stream, str(tmp_path / "pool"), out, str(tmp_path / "check")).awaitTermination(120)

    go()
    docs(spark, BATCH).where("doc_id > 0").coalesce(1).write.parquet(f"{src}/b")
    go()
    texts = {r.doc_id: r.anonymized_text for r in spark.read.parquet(out).collect()}
    assert "<ORG_1>" in texts[0] and "<ORG_1a> announced" in texts[1] and "<US_SSN_1>" in texts[2] and "<EMAIL_1>" in texts[1]


def test_sql_functions(spark):
    sql_api.register(spark)
    row = spark.sql("select pii_redact('mail a@b.example.com now') r, pii_detect('mail a@b.example.com now') d, pii_restore('x <EMAIL_1>', map('<EMAIL_1>', 'a@b')) s").first()
    assert row.r == "mail <EMAIL> now" and row.d[0].type == "EMAIL_ADDRESS" and row.s == "x a@b"


def test_a_model_that_fails_loses_nothing(spark):
    def make():
        def model(part):
            raise RuntimeError("no model")

        return model

    assert detect.detect(docs(spark, BATCH[:1]), make_model=make).first().spans[1].type == "EMAIL_ADDRESS"


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_properties_and_html():
    package = files.write_docx("HEADING\na < b")
    marked = files.with_properties(files.with_properties(package, {"session_id": "s1"}), {"session_id": "s2", "source_hash": "sha256:x"})
    assert files.custom_properties(package) == {} and files.custom_properties(marked) == {"session_id": "s2", "source_hash": "sha256:x"}
    assert files.docx_text(marked) == files.docx_text(package) and files.docx_html(package) == "<h1>HEADING</h1><p>a &lt; b</p>"


def test_store(spark, tmp_path):
    from veilspark.api import Store

    store = Store(spark, str(tmp_path / "store"))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id string, ord long, text string")
    sid, out = store.anonymize(frame([("a", 0, BATCH[0])]), "sess_1")
    assert "<ORG_1>" in out.first().anonymized_text
    store.anonymize(frame([("b", 1, BATCH[1]), ("c", 2, BATCH[2])]), sid)
    texts = {r.doc_id: r.anonymized_text for r in store.documents(sid).collect()}
    assert set(texts) == {"a", "b", "c"} and "<ORG_1a>" in texts["b"] and "<US_SSN_1>" in texts["c"]
    assert {r.restored_text for r in store.deanonymize(store.documents(sid)).collect()} == set(BATCH)
    assert store.verify(sid).count() == 0 and store.latest() == sid and store.resolve("sess") == ("found", sid)
    assert store.sessions().first().documents == 3 and store.show(sid).count() == 3 and store.expired().count() == 0
    overrides = spark.createDataFrame([("a", ([0], [("John Smith", "PERSON", None, None)]))], f"doc_id string, overrides {review.OVERRIDES}")
    fixed = {r.doc_id: r for r in store.apply_review(sid, overrides).collect()}
    assert fixed["a"].anonymized_text == "<PERSON_1> works at Acme Corp. His email is <EMAIL_1> and SSN <US_SSN_1>." and fixed["a"].approved and not fixed["b"].approved
    other = Store(spark, str(tmp_path / "other"))
    assert other.import_(store.export(sid, "secret"), "secret") == sid
    assert other.mapping(sid).count() == store.mapping(sid).count() and "raw" not in other.mapping(sid).columns


def test_family_roots_against_a_plain_loop():
    import random

    from veilspark.operators.review import family_roots

    def plain(forms):
        roots, owners = [], []
        for form in forms:
            owner = None
            for k, root in enumerate(roots):
                size = min(len(form), len(root)) >= 0.5 * max(len(form), len(root))
                word = form.split()[0] == root.split()[0] and len(form.split()[0]) >= 4
                if len(form) >= 4 and len(root) >= 4 and size and (form in root or root in form or word):
                    owner = k
                    break
            if owner is None:
                owner = len(roots)
                roots.append(form)
            elif len(form) < len(roots[owner]):
                roots[owner] = form
            owners.append(owner)
        return [roots[k] for k in owners]

    draw = random.Random(5)
    words = ["acme", "zar", "zarvo", "trading", "ltd", "acme1", "lund", "x"]
    for _ in range(200):
        forms = list(dict.fromkeys(" ".join(draw.choice(words) for _ in range(draw.randint(1, 3))) for _ in range(25)))
        assert family_roots(forms) == plain(forms)


def test_exact_pool_over_many_ranges(spark):
    from pyspark.sql import functions as F

    spans = spark.range(5000).select(F.concat(F.lit("s"), F.col("id") % 2).alias("session_id"), (5000 - F.col("id")).alias("ord"), F.lit(0).alias("start"), F.lit("EMAIL_ADDRESS").alias("type"), F.concat(F.lit("u"), F.col("id") % 700).alias("text"))
    first = {}
    for r in spans.orderBy("session_id", "ord").collect():
        seen = first.setdefault(r.session_id, {})
        seen.setdefault(r.text, len(seen) + 1)
    got = pool.exact_pool(spans).collect()
    assert {(r.session_id, r.norm): r.family for r in got} == {(s, t): n for s, seen in first.items() for t, n in seen.items()}
    assert all(r.placeholder == f"<EMAIL_{r.family}>" for r in got)
    assert pool.exact_pool(spans.limit(0)).count() == 0


def test_texts_over_paragraphs_are_replaced():
    package = files.write_docx("by Cannor\nLimited of Lund\nX Cannor\nLimited\nLimited")
    hidden = files.rewrite_docx(package, {"CANNOR\nLimited": "<ORG_1>"})
    assert files.docx_text(hidden) == "by <ORG_1>\n of Lund\nX <ORG_1>\n\nLimited"
    three = files.rewrite_docx(files.write_docx("a one\ntwo\nthree b"), {"one\ntwo\nthree": "<LOCATION_1>"})
    assert files.docx_text(three) == "a <LOCATION_1>\n\n b"


def test_tracked_changes_settle_both_ways():
    package = files.write_docx("Marta met Marta Brandt\nplain\nBrandt")
    marked = files.track_changes(package, [("Marta", "Edith"), ("Marta Brandt", "Jonas Okafor"), ("plain", "")])
    assert files.docx_text(files.resolve_changes(marked, False)) == files.docx_text(package)
    assert files.docx_text(files.resolve_changes(marked, True)) == "Edith met Jonas Okafor\n\nBrandt"
    assert files.docx_text(marked) == "Edith met Jonas Okafor\n\nBrandt"
    again = files.track_changes(marked, [("met Jonas", "saw Jonas")])
    assert files.docx_text(files.resolve_changes(again, True)) == "Edith saw Jonas Okafor\n\nBrandt"
    ids = [x.get(f"{files.W}id") for x in files.parts(again)["word/document.xml"].iter() if x.tag in (f"{files.W}ins", f"{files.W}del")]
    assert len(ids) == len(set(ids))
