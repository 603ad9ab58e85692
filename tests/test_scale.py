"""What made queries slow or wrong on larger tables."""

import random
import re

from pyspark.sql import functions as F

from veilspark.functions import registry
from veilspark.functions import text as one
from veilspark.operators import detect, pool, redact, review
from veilspark.plans import queries


def test_a_made_text_is_made_once(spark):
    """The text's own expression stood once at every look at it, in a filter that Spark put below the recognizers."""
    df = spark.range(3).select("id", F.expr("concat('BE0', lpad(cast(id as string), 9, '0'), ' FI', lpad(cast(id as string), 8, '0'))").alias("text"))
    rows = detect.spans_table(detect.scan(df, ["vat_be", "vat_fi"]), "id")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("lpad(") == 2
    assert sorted((r.id, r.start, r.text) for r in rows.collect()) == [x for k in range(3) for x in ((k, 0, f"BE0{k:09}"), (k, 13, f"FI{k:08}"))]


def test_marks_in_a_text(spark):
    df = spark.createDataFrame([("a\x01b http://x.y/\x01z\x02 \x01 http://q.r",)], "text string")
    assert [(s.start, s.text) for s in detect.scan(df, ["url"]).first().spans] == [(4, "http://x.y/\x01z\x02"), (21, "http://q.r")]


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(1000).selectExpr("id", "concat('mail a', id, '@b.example') text").coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    for found in (detect.scan(df, ["email"]), detect.detect(df)):
        held = detect.spans_table(found, "id").groupBy(F.spark_partition_id()).count().collect()
        assert len(held) >= 2 * spark.sparkContext.defaultParallelism and sum(r["count"] for r in held) == 1000


def test_texts_compile_no_expressions(monkeypatch):
    """Each term that was looked for again in its text had an expression of its own."""
    text = "Witness: Marta Lindqvist{0}\nlater MARTA LINDQVIST{0} of 8 Harbour Road, Leeds LS8 4AB came to Zarvo{0} Trading GmbH"
    one.detect(text.format("a"))
    made = []
    compiled = re._compiler.compile
    monkeypatch.setattr(re._compiler, "compile", lambda *a, **k: made.append(a) or compiled(*a, **k))
    for k in range(20):
        assert len(one.detect(text.format(chr(98 + k) * 3))) >= 3
    assert not made


def test_first_looks_lose_nothing():
    """Patterns, labels and terms found behind the first looks are those found without them."""
    rnd = random.Random(7)
    bits = [*"abAB19:-_\n @.,()+&é﻿K", "name", "by", "SIGNED BY", " Ltd", "4111", "555 123", "Witness:", "contact  person", "of", "Co.", "INC", "Agency ", "DE123456789", "12345678", "10.1.2.3", "a@b.cd", "https://"]
    hits = 0
    for _ in range(3000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 40)))
        zones = one.digit_zones(text)[0]
        for p in registry.PATTERNS:
            if p.name == "reg_linebreak":
                continue
            plain = [(a + m.start(), a + m.end()) for a, b in (zones if p.digits else [(0, len(text))]) for m in one.rx(p.regex).finditer(text[a:b])]
            if plain:
                hits += 1
                kept = [x for x in plain if one.guarded(text, *x, p.kind)]
                assert [(s.start, s.end) for s in one.regex_spans(text, [p])] == kept
        assert list(one.labels(text)) == [m.end() for m in one.rx(one.PERSON_LABEL, "im").finditer(text)]
        term = text[3:5] or "a"
        assert list(one.occurrences(text, term)) == [m.span() for m in re.finditer(rf"(?<!\w){re.escape(term)}(?!\w)", text, re.IGNORECASE)]
    assert hits > 500


FORMS = [
    "mail a.b@c.org and A.B@C.ORG, a.b@c.org",
    "call +1 (499)\n555-6503 or +1 (499) 555-6503 <EMAIL_1> x@y.org <PHONE_7><EMAIL_1>",
    "host 192.168.100.7 <IP_1> <IP_1>",
    "<EMAIL_1> alone",
    "A.B@c.org",
    "none",
    "",
    None,
]


def test_restored_texts_are_exact(spark, tmp_path):
    """Later forms of an entity, and what looked like a placeholder before, came back as the first form of the pool's entity."""
    spark.createDataFrame([(k, t) for k, t in enumerate(FORMS)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    back = {r.doc_id: r.restored_text for r in queries.restore_text(spark, str(tmp_path)).collect()}
    assert back == dict(enumerate(FORMS))
    assert queries.roundtrip_ok(spark, str(tmp_path)).first() == (len(FORMS), len(FORMS))


def test_the_whole_chain_is_restored_exactly(spark):
    texts = [*FORMS, "Anglo  Trading\nHoldings Ltd met ANGLO TRADING and Anglo Trading Holdings Ltd"]
    docs = spark.createDataFrame([("s", k, k, t) for k, t in enumerate(texts)], "session_id string, doc_id long, ord long, text string")
    out, _, entities = redact.anonymize(docs, forms=True)
    back = redact.restore(out, pool.mapping(entities), forms="forms")
    assert {r.doc_id: r.restored_text for r in back.collect()} == dict(enumerate(texts))


def test_families_of_many_sessions(spark):
    """Each session and type had a frame of its own; now groups are read one after another, null keys and large groups too."""
    rows = [(f"s{s}" if s else None, 0, k, kind, text) for s in range(300) for kind in ("ORGANIZATION", "PERSON") for k, text in enumerate(["Zarvo Trading", " zarvo", "ZARVO", "Marta Brandt", "Marta"])]
    rows += [("wide", k, 0, "PERSON", f"Name{k % 300} Brandt") for k in range(1_000)]
    spans = spark.createDataFrame(rows, "session_id string, ord int, start int, type string, text string")
    got: dict = {}
    for r in review.families(spans).collect():
        got.setdefault((r.session_id, r.type), {})[r.form] = (r.n, r.root)
    want: dict = {}
    for s, _, _, kind, text in rows:
        forms = want.setdefault((s, kind), {})
        forms[text.lower().strip()] = forms.get(text.lower().strip(), 0) + 1
    assert got == {key: {f: (n, root) for (f, n), root in zip(forms.items(), review.family_roots(list(forms)))} for key, forms in want.items()}
    assert "FlatMapGroups" not in review.families(spans)._jdf.queryExecution().toString()
