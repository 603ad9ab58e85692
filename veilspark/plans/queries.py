"""One registered query for each operator, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import registry
from veilspark.functions import text as one
from veilspark.operators import detect as det
from veilspark.operators import pool as pools
from veilspark.operators import redact, review, sessions
from veilspark.operators.stored import stored
from veilspark.plans import carriers, oracle
from veilspark.sources import audit

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The patterns that occur in ordinary documents, cheap enough for one projection.
COMMON = ["email", "phone_intl", "phone_us_paren", "ipv4", "cc_visa", "reg_number"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- recognizers, one query a type


def carrier(spark: SparkSession, sf_dir: str, expression: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(expression).alias("text"))


def flat(df: DataFrame, key: str = "doc_id") -> DataFrame:
    rows = det.spans_table(df, key)
    return rows.select(key, "type", "reason", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.round("score", 2).alias("score"), F.col("text").alias("hit"))


FLAT_SQL = 'SELECT doc_id, type, reason, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", round(score, 2) AS score, hit FROM ({})'


def add_scan(kind: str) -> None:
    names = [p.name for p in registry.PATTERNS if p.kind == kind and p.name not in ("org_caps_suffix",)]
    if kind == "EU_VAT":
        names = ["vat_de", "vat_el", "vat_pt", "vat_gb"]
    expression = carriers.text_of(kind)

    def run(spark, sf_dir):
        return flat(det.scan(carrier(spark, sf_dir, expression), names))

    source = f"SELECT c_custkey AS doc_id, {expression} AS text FROM customer"
    query(FLAT_SQL.format(oracle.spans(source, names)), f"scan_{kind.lower()}")(run)


for _kind in registry.KINDS:
    add_scan(_kind)


def add_vat(names: list[str], shapes: dict[str, str]) -> None:
    expression = carriers.cat("'codes '", *[carriers.cat(shape, "' '") for shape in shapes.values()])

    def run(spark, sf_dir):
        return flat(det.scan(carrier(spark, sf_dir, expression), names))

    query(FLAT_SQL.format(oracle.spans(f"SELECT c_custkey AS doc_id, {expression} AS text FROM customer", names)), "scan_eu_vat_all")(run)


_n = carriers.num
_k = carriers.K
add_vat(
    [p.name for p in registry.PATTERNS if p.kind == "EU_VAT"],
    {c: carriers.cat(f"'{head}'", _n(_k, size), f"'{tail}'") for c, (head, size, tail) in {
        "at": ("ATU", 8, ""), "be": ("BE0", 9, ""), "bg": ("BG", 10, ""), "cy": ("CY", 8, "L"), "cz": ("CZ", 9, ""), "de": ("DE", 9, ""), "dk": ("DK", 8, ""), "ee": ("EE", 9, ""),
        "es": ("ESB", 7, "9"), "fi": ("FI", 8, ""), "fr": ("FRXX", 9, ""), "el": ("EL", 9, ""), "hr": ("HR", 11, ""), "hu": ("HU", 8, ""), "ie": ("IE1T", 5, "W"), "it": ("IT", 11, ""),
        "lt": ("LT", 12, ""), "lu": ("LU", 8, ""), "lv": ("LV", 11, ""), "mt": ("MT", 8, ""), "nl": ("NL", 9, "B01"), "pl": ("PL", 10, ""), "pt": ("PT", 9, ""), "ro": ("RO", 6, ""),
        "se": ("SE", 12, ""), "si": ("SI", 8, ""), "sk": ("SK", 10, ""), "gb": ("GB", 9, ""), "ch": ("CHE", 9, ""),
    }.items()},
)

DOCS_SQL = "SELECT doc_id, text FROM documents"


@query(FLAT_SQL.format(oracle.spans(DOCS_SQL, COMMON)))
def scan_documents(spark, sf_dir):
    return flat(det.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), COMMON))


@query(FLAT_SQL.format(oracle.spans("SELECT page_id AS doc_id, html AS text FROM pages", [*COMMON, "uk_nhs"])))
def scan_pages(spark, sf_dir):
    return flat(det.scan(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")), [*COMMON, "uk_nhs"]))


GUARDS = {
    "guard_ip": ("ipv4", "concat(case c_custkey % 4 when 0 then 'see clause ' when 1 then 'section 2. ' when 2 then 'host ' else '' end, cast(c_custkey % 14 as string), '.', cast(c_custkey % 60 as string), '.7.', cast(c_custkey % 55 as string))"),
    "guard_nhs": ("uk_nhs", "concat(case c_custkey % 5 when 0 then 'order no ' when 1 then 'phone: ' when 2 then 'copyright ' when 3 then 'nhs ' else 'is ' end, lpad(cast(c_custkey as string), 3, '0'), ' 555 ', lpad(cast(c_custkey as string), 4, '0'))"),
    "guard_iban": ("iban", "concat(case c_custkey % 3 when 0 then 'trade mark ' when 1 then 'class 9 ' else 'pay to ' end, 'UK00 0034 5678 ', lpad(cast(c_custkey as string), 4, '0'))"),
    "guard_org": ("org_mixed_suffix", "concat('see ', case c_custkey % 5 when 0 then 'Such But Not Limited' when 1 then 'Zarvo EXPRESS Trading Ltd' when 2 then 'A Partnership, An LLC' when 3 then 'Lund, Brandt Corporation' else concat('Norvex', cast(c_custkey as string), ' Trading Ltd') end, ' there')"),
    "context_boost": ("reg_number", "concat(case c_custkey % 3 when 0 then 'sort   code ' when 1 then 'routing ' else 'plain ' end, repeat('w ', cast(c_custkey % 120 as int)), lpad(cast(c_custkey as string), 6, '1'))"),
}


def add_guard(name: str, pattern: str, expression: str) -> None:
    def run(spark, sf_dir):
        return flat(det.scan(carrier(spark, sf_dir, expression), [pattern]))

    query(FLAT_SQL.format(oracle.spans(f"SELECT c_custkey AS doc_id, {expression} AS text FROM customer", [pattern])), name)(run)


for _name, (_pattern, _expression) in GUARDS.items():
    add_guard(_name, _pattern, _expression)

# ---------------------------------------------------------------- overlaps, counts, numbering, rewriting

KEPT_SQL = oracle.without_overlaps(oracle.spans(DOCS_SQL, COMMON))
SPANS_SQL = f"SELECT doc_id, x.type, x.s, x.e, x.score, x.hit FROM (SELECT doc_id, unnest(kept) AS x FROM ({KEPT_SQL}))"


def session_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.lit("s1").alias("session_id"), "doc_id", F.col("doc_id").alias("ord"), "text")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = det.scan(session_texts(spark, sf_dir), COMMON)
    return scanned.withColumn("spans", det.without_overlaps(F.col("spans")))


def found_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.spans_table(found(spark, sf_dir).drop("text"), "session_id", "doc_id", "ord")


@query(f'SELECT doc_id, type, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", round(score, 2) AS score, hit FROM ({SPANS_SQL})')
def dedup_spans(spark, sf_dir):
    return flat(found(spark, sf_dir).select("doc_id", "spans")).drop("reason")


@query(f"SELECT type, count(*) AS n FROM ({SPANS_SQL}) GROUP BY type")
def type_counts(spark, sf_dir):
    return det.type_counts(found_rows(spark, sf_dir))


@query(f"SELECT doc_id, count(*) AS n FROM ({SPANS_SQL}) GROUP BY doc_id ORDER BY n DESC, doc_id LIMIT 25")
def scan_report(spark, sf_dir):
    """The report's feature is its limit: the 25 documents with most findings."""
    return found_rows(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "doc_id").limit(25)


@query(f"""SELECT d.doc_id, length(d.text) AS chars, coalesce(n, 0) AS entities, coalesce(by_type, '') AS by_type, coalesce(sample, '') AS sample FROM documents d
  LEFT JOIN (SELECT doc_id, sum(n) AS n, string_agg(type || ' ' || CAST(n AS VARCHAR), ', ' ORDER BY n DESC, type) AS by_type FROM (SELECT doc_id, type, count(*) AS n FROM ({SPANS_SQL}) GROUP BY ALL) GROUP BY doc_id) USING (doc_id)
  LEFT JOIN (SELECT doc_id, string_agg('[' || type || '] ' || CASE WHEN length(hit) > 50 THEN substr(hit, 1, 47) || '...' ELSE hit END || ' (score=' || printf('%.2f', score) || ')', chr(10) ORDER BY s) AS sample
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS k FROM ({SPANS_SQL})) WHERE k <= 25 GROUP BY doc_id) USING (doc_id)""")
def scan_summary(spark, sf_dir):
    """What a scan prints of each document: counts by type, and its first 25 spans, which is the report's own limit."""
    found_in = det.report(found(spark, sf_dir), "doc_id")
    return found_in.withColumns({c: F.col(c).cast("long") for c in ("chars", "entities")})


NORM = r"regexp_replace(regexp_replace(trim(lower(hit)), '[.,;:]+$', ''), '\s+', ' ', 'g')"
TAG_CASE = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in registry.TAGS.items()) + " ELSE type END"
POOL_SQL = f"""SELECT *, '<' || {TAG_CASE} || '_' || CAST(family AS VARCHAR) || '>' AS placeholder FROM (
  SELECT *, row_number() OVER (PARTITION BY type ORDER BY first_ord, first_start, norm) AS family FROM (
    SELECT type, norm, min(doc_id) AS first_ord, arg_min(s, struct_pack(doc_id := doc_id, s := s)) AS first_start, arg_min(hit, struct_pack(doc_id := doc_id, s := s)) AS raw
    FROM (SELECT *, {NORM} AS norm FROM ({SPANS_SQL})) GROUP BY type, norm))"""


@query(f"SELECT type, norm, CAST(family AS BIGINT) AS family, placeholder, raw, CAST(first_ord AS BIGINT) AS first_ord, CAST(first_start AS BIGINT) AS first_start FROM ({POOL_SQL})")
def placeholder_exact(spark, sf_dir):
    pool = pools.exact_pool(found_rows(spark, sf_dir))
    return pool.select("type", "norm", "family", "placeholder", "raw", "first_ord", F.col("first_start").cast("long").alias("first_start"))


ASSIGNED_SQL = f"SELECT a.*, p.placeholder, p.raw FROM (SELECT *, {NORM} AS norm FROM ({SPANS_SQL})) a JOIN ({POOL_SQL}) p USING (type, norm)"
REDACTED_SQL = f"""SELECT d.doc_id, coalesce(r.head || substr(d.text, r.till + 1), d.text) AS anonymized_text FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(piece, '' ORDER BY s) AS head, max(e) AS till FROM (
    SELECT a.doc_id, a.s, a.e, substr(d.text, CAST(coalesce(lag(a.e) OVER w, 0) AS BIGINT) + 1, CAST(a.s - coalesce(lag(a.e) OVER w, 0) AS BIGINT)) || a.placeholder AS piece
    FROM ({ASSIGNED_SQL}) a JOIN documents d USING (doc_id) WINDOW w AS (PARTITION BY a.doc_id ORDER BY a.s)) GROUP BY doc_id) r USING (doc_id)"""


def redacted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    spans = stored(found_rows(spark, sf_dir), "spans")
    pool = pools.exact_pool(spans)
    grouped = pools.assign(spans, pool, "raw").groupBy("session_id", "doc_id").agg(F.collect_list(F.struct("start", "end", "placeholder", "raw")).alias("replaced"))
    joined = session_texts(spark, sf_dir).join(grouped, ["session_id", "doc_id"], "left")
    text = F.when(F.col("replaced").isNull(), F.col("text")).otherwise(redact.spliced(F.col("text"), F.col("replaced")))
    forms = redact.other_forms(F.col("text"), F.col("replaced"))
    return joined.withColumn("anonymized_text", text).withColumn("forms", forms).drop("replaced"), pool


@query(REDACTED_SQL)
def redact_text(spark, sf_dir):
    return redacted(spark, sf_dir)[0].select("doc_id", "anonymized_text")


@query("SELECT doc_id, text AS restored_text FROM documents")
def restore_text(spark, sf_dir):
    docs, pool = redacted(spark, sf_dir)
    return redact.restore(docs, pools.mapping(pool), forms="forms").select("doc_id", "restored_text")


@query("SELECT count(*) AS documents, count(*) AS exact FROM documents")
def roundtrip_ok(spark, sf_dir):
    docs, pool = redacted(spark, sf_dir)
    back = redact.restore(docs, pools.mapping(pool), forms="forms")
    return back.agg(F.count("*").alias("documents"), F.count_if(F.col("restored_text").eqNullSafe(F.col("text"))).alias("exact"))


@query(f"SELECT placeholder, substr(placeholder, 2, length(placeholder) - 2 - length(CAST(family AS VARCHAR)) - 1) AS tag, type FROM ({POOL_SQL})")
def safe_mapping(spark, sf_dir):
    return pools.safe_mapping(pools.mapping(pools.exact_pool(found_rows(spark, sf_dir)))).select("placeholder", "tag", "type")


@query(f"SELECT type, CAST(max(family) AS BIGINT) AS counter FROM ({POOL_SQL}) GROUP BY type")
def reconstruct_counters(spark, sf_dir):
    return pools.counters(pools.reconstruct(pools.mapping(pools.exact_pool(found_rows(spark, sf_dir))))).drop("session_id")


@query(f"SELECT type, norm, placeholder, raw FROM ({POOL_SQL})")
def state_serde(spark, sf_dir):
    back = pools.from_state_json(pools.state_json(pools.exact_pool(found_rows(spark, sf_dir))))
    return back.select("type", "norm", "placeholder", "raw")


@query("SELECT CAST(0 AS BIGINT) AS leaks")
def verify_clean(spark, sf_dir):
    """Nothing of the scanned types is left in rewritten documents."""
    docs = redacted(spark, sf_dir)[0].select("doc_id", F.col("anonymized_text").alias("text"))
    return det.spans_table(det.scan(docs, COMMON), "doc_id").agg(F.count("*").alias("leaks"))


@query("SELECT c_custkey AS doc_id, 'EMAIL_ADDRESS' AS type, 'leak.' || CAST(c_custkey AS VARCHAR) || '@mail.example.com' AS leak FROM customer")
def verify_leaks(spark, sf_dir):
    planted = carrier(spark, sf_dir, "concat('<EMAIL_1> and leak.', cast(c_custkey as string), '@mail.example.com of <ORG_2a>')").withColumn("session_id", F.lit("s1"))
    return redact.verify(planted.withColumnRenamed("text", "anonymized_text")).select("doc_id", "type", "leak")


@query(f"SELECT doc_id, regexp_matches(anonymized_text, '<(?:D\\d+_)?[A-Z][A-Z_]*_\\d+[a-z]*>') AS twice FROM ({REDACTED_SQL})")
def double_anonymization(spark, sf_dir):
    return redacted(spark, sf_dir)[0].select("doc_id", redact.already_anonymized(F.col("anonymized_text")).alias("twice"))


# ---------------------------------------------------------------- the whole chain


@query()
def detect_documents(spark, sf_dir):
    return flat(det.detect(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans"))


@query()
def detect_pages(spark, sf_dir):
    return flat(det.detect(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))).select("doc_id", "spans"))


@query()
def anonymize_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit("s1").alias("session_id"), "doc_id", F.col("doc_id").alias("ord"), "text")
    return redact.anonymize(docs)[0].select("doc_id", "anonymized_text")


def chain(name: str, expression: str, sql: str, keep: str = "true") -> None:
    """A query that runs the whole chain over carrier texts; sql gives what must be found."""

    def run(spark, sf_dir):
        df = det.detect(carrier(spark, sf_dir, expression))
        return flat(df.select("doc_id", "spans")).where(keep).drop("reason")

    query(f'SELECT doc_id, type, CAST(start AS BIGINT) AS start, CAST(start + length(hit) AS BIGINT) AS "end", CAST(score AS DOUBLE) AS score, hit FROM ({sql})', name)(run)


FIRST = "case c_custkey % 4 when 0 then 'Marta' when 1 then 'Jonas' when 2 then 'Edith' else 'Pavel' end"
LAST = "case c_custkey % 5 when 0 then 'Lindqvist' when 1 then 'Okafor' when 2 then 'Brandt' when 3 then 'Moreau' else 'Silva' end"
NAME = f"concat({FIRST}, ' ', {LAST})"
LABEL = "case c_custkey % 3 when 0 then 'Full Legal Name: ' when 1 then 'CEO / Authorized Signatory: ' else 'Witness: ' end"
ACT = "case c_custkey % 3 when 0 then 'Signed by ' when 1 then 'Prepared by ' else 'Attested by ' end"
STREET = "concat(cast(1 + c_custkey % 98 as string), ' Harbour Road, Leeds LS', cast(1 + c_custkey % 9 as string), ' 4AB')"
PLACE = "case c_custkey % 3 when 0 then 'Registered address: ' when 1 then 'Mailing address: ' else 'Head office: ' end"

chain("labeled_person", f"concat({LABEL}, {NAME}, ', Chief Engineer (acting)')", f"SELECT c_custkey AS doc_id, 'PERSON' AS type, length({LABEL}) AS start, 0.8 AS score, {NAME} AS hit FROM customer")
chain("labeled_person_by", f"concat({ACT}, {NAME}, ' in Room ', chr(65))", f"SELECT c_custkey AS doc_id, 'PERSON' AS type, length({ACT}) AS start, 0.75 AS score, {NAME} AS hit FROM customer")
chain("labeled_address", f"concat('x. ', {PLACE}, {STREET}, chr(10), 'Next label: none')", f"SELECT c_custkey AS doc_id, 'LOCATION' AS type, 3 + length({PLACE}) AS start, 0.75 AS score, {STREET} AS hit FROM customer")
chain("address_at", f"concat('having its registered office at ', {STREET}, '; and')", f"SELECT c_custkey AS doc_id, 'LOCATION' AS type, 32 AS start, 0.7 AS score, {STREET} AS hit FROM customer")
chain("address_of", f"concat('the holder, of ', {STREET}, ') agreed')", f"SELECT c_custkey AS doc_id, 'LOCATION' AS type, 15 AS start, 0.65 AS score, {STREET} AS hit FROM customer")
chain("postcode_address", f"concat('deliver goods to ', {STREET}, ' soon')", f"SELECT c_custkey AS doc_id, 'LOCATION' AS type, 17 AS start, 0.65 AS score, {STREET} AS hit FROM customer")
chain("defined_party", f"concat({NAME}, ' (the \"', case c_custkey % 2 when 0 then 'Employee' else 'Supplier' end, '\") accepts')", f"SELECT c_custkey AS doc_id, CASE c_custkey % 2 WHEN 0 THEN 'PERSON' ELSE 'ORGANIZATION' END AS type, 0 AS start, 0.7 AS score, {NAME} AS hit FROM customer")
chain("propagate", f"concat('Witness: ', {NAME}, chr(10), 'later ', upper({NAME}), ' came')", f"SELECT c_custkey AS doc_id, 'PERSON' AS type, 9 AS start, 0.8 AS score, {NAME} AS hit FROM customer UNION ALL SELECT c_custkey, 'PERSON', 16 + length({NAME}), 0.8, upper({NAME}) FROM customer")
chain("trim_organization", "concat('and Shares In Zarvo', cast(c_custkey as string), ' Trading GmbH there')", "SELECT c_custkey AS doc_id, 'ORGANIZATION' AS type, 14 AS start, 0.35 AS score, concat('Zarvo', CAST(c_custkey AS VARCHAR), ' Trading GmbH') AS hit FROM customer")
chain("frequency_filter", f"concat(repeat(concat('Witness: ', {NAME}, chr(10)), 1 + cast(c_custkey % 12 as int)), 'x')", f"SELECT c_custkey AS doc_id, 'PERSON' AS type, i * (10 + length({NAME})) + 9 AS start, 0.8 AS score, {NAME} AS hit FROM customer, unnest(range(0, 1 + c_custkey % 12)) t(i) WHERE c_custkey % 12 < 8")


def given(name: str, expression: str, spans: str, function: Callable, sql: str) -> None:
    """A query that applies one rule to carrier texts with given spans (type, start, text, score)."""

    def run(spark, sf_dir):
        df = table(spark, sf_dir, "customer").withColumn("text", F.expr(expression))
        df = df.select(F.col("c_custkey").alias("doc_id"), "text", F.expr(spans).alias("given"))

        def apply(body, rows):
            return function(body, [one.Span(r["start"], r["start"] + len(r["text"]), r["type"], r["score"], "ner", r["text"]) for r in rows])

        return flat(det.map_spans(df, apply, ["text", "given"]).select("doc_id", "spans")).select("doc_id", "type", "start", "end", "hit")

    query(f'SELECT doc_id, type, CAST(start AS BIGINT) AS start, CAST(start + length(hit) AS BIGINT) AS "end", hit FROM ({sql})', name)(run)


def one_span(kind: str, start: str, text: str, score: str = "0.6D") -> str:
    return f"array(named_struct('type', {kind}, 'start', cast({start} as int), 'text', {text}, 'score', {score}))"


TERMS = "case c_custkey % 6 when 0 then 'Sellers' when 1 then 'Franchisor' when 2 then concat('Tenant', chr(39), 's') when 3 then 'Companies' when 4 then 'Marta Brandt' else 'Zarvo Trading' end"
given("stoplist", TERMS, one_span("'ORGANIZATION'", "0", "text"), one.without_false, f"SELECT c_custkey AS doc_id, 'ORGANIZATION' AS type, 0 AS start, {TERMS} AS hit FROM customer WHERE c_custkey % 6 > 3")
TEMPLATES = "case c_custkey % 5 when 0 then '[insert name]' when 1 then '(City/State)' when 2 then '________' when 3 then 'State/Province' else 'Lund Harbour' end"
given("template_filter", TEMPLATES, one_span("'LOCATION'", "0", "text"), one.without_false, f"SELECT c_custkey AS doc_id, 'LOCATION' AS type, 0 AS start, {TEMPLATES} AS hit FROM customer WHERE c_custkey % 5 = 4")
LAW = "case c_custkey % 5 when 0 then 'governed by the laws of ' when 1 then 'incorporated in ' when 2 then 'seat of arbitration is ' when 3 then 'she lives in ' else 'born near ' end"
given("jurisdiction", f"concat({LAW}, 'Lund')", one_span("'LOCATION'", f"length({LAW})", "'Lund'"), one.outside_law_and_currency, f"SELECT c_custkey AS doc_id, 'LOCATION' AS type, length({LAW}) AS start, 'Lund' AS hit FROM customer WHERE c_custkey % 5 > 2")
MONEY = "case c_custkey % 4 when 0 then ' Rupees' when 1 then ' dollars each' when 2 then ' people' else ' tea' end"
given("currency", f"concat('paid Indian', {MONEY})", one_span("'LOCATION'", "5", "'Indian'"), one.outside_law_and_currency, "SELECT c_custkey AS doc_id, 'LOCATION' AS type, 5 AS start, 'Indian' AS hit FROM customer WHERE c_custkey % 4 > 1")
WIDE = "case c_custkey % 3 when 0 then 'New Zealand' when 1 then 'New Jersey' else 'New Lund' end"
given("expand_location", f"concat('in ', {WIDE}, ' now')", one_span("'LOCATION'", "3", "'New'"), one.expand_locations, f"SELECT c_custkey AS doc_id, 'LOCATION' AS type, 3 AS start, CASE c_custkey % 3 WHEN 2 THEN 'New' ELSE {WIDE} END AS hit FROM customer")
given("expand_organization", "concat('Zarvo', case c_custkey % 3 when 0 then ' AG' when 1 then ' Ltd.' else ' runs' end, ' today')", one_span("'ORGANIZATION'", "0", "'Zarvo'"), one.expand_organizations, "SELECT c_custkey AS doc_id, 'ORGANIZATION' AS type, 0 AS start, CASE c_custkey % 3 WHEN 0 THEN 'Zarvo AG' WHEN 1 THEN 'Zarvo Ltd.' ELSE 'Zarvo' END AS hit FROM customer")
given("promote_location", "concat('Lund Exchange', case c_custkey % 2 when 0 then ' Limited' else ' square' end, ' today')", one_span("'LOCATION'", "0", "'Lund'"), one.expand_organizations, "SELECT c_custkey AS doc_id, CASE c_custkey % 2 WHEN 0 THEN 'ORGANIZATION' ELSE 'LOCATION' END AS type, 0 AS start, CASE c_custkey % 2 WHEN 0 THEN 'Lund Exchange Limited' ELSE 'Lund' END AS hit FROM customer")
TWO = "array(named_struct('type', 'LOCATION', 'start', 0, 'text', 'Fort', 'score', 0.6D), named_struct('type', 'LOCATION', 'start', cast(4 + length({0}) as int), 'text', 'Mumbai', 'score', 0.7D))"
GAP = "case c_custkey % 3 when 0 then ', ' when 1 then ' 400001 ' else ' and then ' end"
given("merge_locations", f"concat('Fort', {GAP}, 'Mumbai')", TWO.format(GAP), one.merge_locations, f"SELECT c_custkey AS doc_id, 'LOCATION' AS type, 0 AS start, CASE WHEN c_custkey % 3 = 2 THEN 'Fort' ELSE concat('Fort', {GAP}, 'Mumbai') END AS hit FROM customer UNION ALL SELECT c_custkey, 'LOCATION', 4 + length({GAP}), 'Mumbai' FROM customer WHERE c_custkey % 3 = 2")
given("snap_boundaries", "concat('hi (Zarvo', cast(c_custkey as string), ') there')", one_span("'ORGANIZATION'", "3", "'(Zarv'"), one.snap, "SELECT c_custkey AS doc_id, 'ORGANIZATION' AS type, 4 AS start, concat('Zarvo', CAST(c_custkey AS VARCHAR)) AS hit FROM customer")
given("address_block", "concat('intro', chr(10), chr(10), 'Vagen ', cast(c_custkey as string), chr(10), 'SE-431 36 Molndal', chr(10), 'Sweden')", one_span("'LOCATION'", "length(text) - 6", "'Sweden'"), one.expand_address_blocks, "SELECT c_custkey AS doc_id, 'LOCATION' AS type, 7 AS start, concat('Vagen ', CAST(c_custkey AS VARCHAR), chr(10), 'SE-431 36 Molndal', chr(10), 'Sweden') AS hit FROM customer")
given("garbage_filter", "concat('xAgency shall', cast(c_custkey as string))", one_span("'ORGANIZATION'", "case when c_custkey % 2 = 0 then 1 else 0 end", "case when c_custkey % 2 = 0 then 'Agency' else 'xAgency' end"), one.without_garbage, "SELECT c_custkey AS doc_id, 'ORGANIZATION' AS type, 0 AS start, 'xAgency' AS hit FROM customer WHERE c_custkey % 2 = 1")


# A fold over a session's entities in order: each meets the heads (variant 0) before it.
NEAR_HEADS = "list_filter(a, lambda h: h.variant = 0 AND (contains(h.norm, b[1].norm) OR contains(b[1].norm, h.norm)) AND least(length(h.norm), length(b[1].norm)) >= 0.5 * greatest(length(h.norm), length(b[1].norm)))"
FAMILY = f"list_min(list_transform({NEAR_HEADS}, lambda h: h.family))"
JOINED = f"struct_pack(norm := b[1].norm, raw := b[1].raw, family := coalesce({FAMILY}, list_max(list_transform(a, lambda h: h.family)) + 1), variant := len(list_filter(a, lambda h: h.family = {FAMILY})))"


@query(f"""SELECT session_id, 'ORGANIZATION' AS type, x.norm AS norm, CAST(x.family AS BIGINT) AS family, CAST(x.variant AS INTEGER) AS variant, x.raw AS raw,
  '<ORG_' || CAST(x.family AS VARCHAR) || CASE WHEN x.variant = 0 THEN '' WHEN x.variant <= 26 THEN chr(CAST(96 + x.variant AS INTEGER)) ELSE chr(CAST(96 + (x.variant - 1) // 26 AS INTEGER)) || chr(CAST(97 + (x.variant - 1) % 26 AS INTEGER)) END || '>' AS placeholder
  FROM (SELECT session_id, unnest(list_reduce(list([struct_pack(norm := lower(raw), raw := raw, family := CAST(1 AS BIGINT), variant := CAST(0 AS BIGINT))] ORDER BY first), lambda a, b: list_concat(a, [{JOINED}]))) AS x
    FROM (SELECT 's' || CAST(c_custkey % 5 AS VARCHAR) AS session_id, 'Zarvo ' || CAST(c_custkey % 97 AS VARCHAR) || CASE WHEN c_custkey % 3 = 0 THEN ' Trading' ELSE '' END AS raw, min(c_custkey) AS first FROM customer GROUP BY ALL) GROUP BY session_id)""")
def placeholder_family(spark, sf_dir):
    """Families are numbered one after another; SQL folds each session's list."""
    spans = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("s"), (F.col("c_custkey") % 5).cast("string")).alias("session_id"), F.col("c_custkey").alias("ord"), F.lit(0).alias("start"), F.lit("ORGANIZATION").alias("type"),
        F.concat(F.lit("Zarvo "), (F.col("c_custkey") % 97).cast("string"), F.when(F.col("c_custkey") % 3 == 0, " Trading").otherwise("")).alias("text"),
    )
    return pools.build_pool(spans).select("session_id", "type", "norm", "family", "variant", "placeholder", "raw")


# ---------------------------------------------------------------- review

ITEMS = "array(named_struct('seq', 0, 'start', 0, 'end', 4, 'type', 'PERSON', 'score', 0.8D, 'verified', true, 'reason', 'x', 'text', 'Anna'), named_struct('seq', 1, 'start', 9, 'end', 14, 'type', 'LOCATION', 'score', 0.6D, 'verified', true, 'reason', 'x', 'text', 'Malmo'))"


def reviewed(spark, sf_dir, remove: str, add: str) -> DataFrame:
    df = carrier(spark, sf_dir, "concat('Anna and Malmo met Zarvo', cast(c_custkey as string), ', zarvo', cast(c_custkey as string), '.')")
    return df.withColumn("spans", F.expr(ITEMS)).withColumn("overrides", F.expr(f"named_struct('remove', {remove}, 'add', {add})"))


@query("SELECT c_custkey AS doc_id, 'LOCATION' AS type, 'Malmo' AS hit FROM customer UNION ALL SELECT c_custkey, 'PERSON', 'Anna' FROM customer WHERE c_custkey % 2 = 1")
def override_remove(spark, sf_dir):
    df = reviewed(spark, sf_dir, "case when doc_id % 2 = 0 then array(0) else array() end", "cast(array() as array<struct<text:string,type:string,start:int,end:int>>)")
    return flat(df.withColumn("spans", review.keep_unremoved(F.col("spans"), F.col("overrides.remove"))).select("doc_id", "spans")).select("doc_id", "type", "hit")


@query("SELECT c_custkey AS doc_id, 'PERSON' AS type, CAST(0 AS BIGINT) AS start, 'Anna' AS hit FROM customer UNION ALL SELECT c_custkey, 'LOCATION', 9, 'Malmo' FROM customer UNION ALL SELECT c_custkey, 'ORGANIZATION', 19, 'Zarvo' || CAST(c_custkey AS VARCHAR) FROM customer UNION ALL SELECT c_custkey, 'ORGANIZATION', 26 + length(CAST(c_custkey AS VARCHAR)), 'zarvo' || CAST(c_custkey AS VARCHAR) FROM customer")
def override_add(spark, sf_dir):
    df = reviewed(spark, sf_dir, "cast(array() as array<int>)", "array(named_struct('text', concat('Zarvo', cast(doc_id as string)), 'type', 'ORGANIZATION', 'start', cast(null as int), 'end', cast(null as int)))")
    return flat(review.apply_overrides(df).select("doc_id", "spans")).select("doc_id", "type", "start", "hit")


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'waiting_for_approval' WHEN c_custkey % 3 = 1 THEN 'approved_no_changes' ELSE 'success' END AS status FROM customer) GROUP BY status")
def review_status(spark, sf_dir):
    df = reviewed(spark, sf_dir, "case when doc_id % 3 = 2 then array(0) else array() end", "cast(array() as array<struct<text:string,type:string,start:int,end:int>>)").withColumn("approved", F.col("doc_id") % 3 > 0)
    return review.status(df).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT o.o_orderkey AS doc_id, s.o_orderkey AS sibling, 'add' AS action, o.o_orderpriority AS text FROM orders o JOIN orders s ON o.o_custkey = s.o_custkey AND o.o_orderkey <> s.o_orderkey WHERE o.o_orderkey % 20 = 0 AND s.o_orderstatus <> 'F'")
def sibling_propagation(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    reviews = orders.select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("doc_id"), (F.col("o_orderstatus") == "F").alias("approved"))
    # Every twentieth document has a correction: that is what this fixture's reviewers changed, not a sample.
    changes = orders.where("o_orderkey % 20 = 0").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("doc_id"), F.lit("add").alias("action"), F.lit("ORGANIZATION").alias("type"), F.col("o_orderpriority").alias("text"))
    return review.propagate_to_siblings(reviews, changes).select("doc_id", "sibling", "action", "text")


@query(f"""SELECT doc_id, CAST(p AS BIGINT) AS start, CAST(q AS BIGINT) AS "end", substr(text, CAST(p AS BIGINT) + 1, CAST(q - p AS BIGINT)) AS piece, covered FROM (
  SELECT doc_id, text, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS q,
    len(list_filter(kept, lambda x: x.s <= p AND x.e > p)) > 0 AS covered
  FROM (SELECT DISTINCT doc_id, text, kept, unnest(list_concat([0, len(text)], list_concat(list_transform(kept, lambda x: x.s), list_transform(kept, lambda x: x.e)))) AS p FROM ({KEPT_SQL}))) WHERE q IS NOT NULL""")
def ui_segments(spark, sf_dir):
    df = found(spark, sf_dir).where(F.size("spans") > 0)
    rows = df.select("doc_id", F.inline(review.segments(F.col("text"), F.col("spans"))))
    return rows.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("text").alias("piece"), "covered")


@query(f"SELECT grp, count(*) AS n FROM (SELECT CASE WHEN type IN ('EMAIL_ADDRESS', 'PHONE_NUMBER', 'URL') THEN 'contact' WHEN type = 'IP_ADDRESS' THEN 'network' WHEN type IN ('CREDIT_CARD', 'IBAN_CODE', 'CRYPTO') THEN 'financial' ELSE 'identity' END AS grp FROM ({SPANS_SQL})) GROUP BY grp")
def ui_groups(spark, sf_dir):
    return found_rows(spark, sf_dir).select(review.group_of(F.col("type")).alias("grp")).groupBy("grp").agg(F.count("*").alias("n"))


MEMBERS = {"' Trading'": 1, "''": 2, "' Trading Holdings'": 1, "' Mining'": 1}


@query("WITH f AS (SELECT CAST(c_custkey AS VARCHAR) AS k, 'zarvo' || CAST(c_custkey AS VARCHAR) AS base, c_custkey >= 100 AS wide FROM customer) " + " UNION ALL ".join(
    f"SELECT k AS session_id, base || lower({tail}) AS form, CAST({n} AS BIGINT) AS n, CASE WHEN wide THEN base || {lower_wide} ELSE base || {lower_narrow} END AS root FROM f"
    for (tail, n), lower_wide, lower_narrow in zip(MEMBERS.items(), ("''", "''", "' trading holdings'", "''"), ("' mining'", "''", "' mining'", "' mining'"))))
def ui_families(spark, sf_dir):
    """From three digits on the short form is half of the long one, so that it is the root; below, it stands alone."""
    forms = F.expr("array(" + ", ".join(f"concat('Zarvo', c_custkey, {tail})" for tail in MEMBERS) + ", concat(' ZARVO', c_custkey, ' '))")
    spans = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("session_id"), F.lit(0).alias("ord"), F.lit("ORGANIZATION").alias("type"), F.posexplode(forms).alias("start", "text"))
    return review.families(spans).select("session_id", "form", "n", "root")


# ---------------------------------------------------------------- sessions

SESSION = "concat('sess_', cast(o_custkey % 40 as string))"


def session_docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.expr(SESSION).alias("session_id"), F.col("o_orderkey").alias("doc_id"), (F.col("o_orderstatus") == "F").alias("approved"), F.col("o_orderdate").alias("added_at"),
        F.concat(F.lit("/in/"), F.col("o_orderpriority")).alias("source_path"), sessions.sha256_of(F.col("o_orderkey").cast("string").cast("binary")).alias("source_hash"),
    )


@query(f"SELECT d.session_id, d.documents, coalesce(e.entities, 0) AS entities, d.approved, d.changed FROM (SELECT {SESSION} AS session_id, count(*) AS documents, count(*) FILTER (o_orderstatus = 'F') AS approved, max(o_orderdate) AS changed FROM orders GROUP BY 1) d LEFT JOIN (SELECT {SESSION} AS session_id, count(*) AS entities FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) e USING (session_id)")
def sessions_list(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey")).select(F.expr(SESSION).alias("session_id"))
    return sessions.listing(session_docs(spark, sf_dir), lines)


@query(f"SELECT session_id, doc_id, added_at FROM (SELECT {SESSION} AS session_id, o_orderkey AS doc_id, o_orderdate AS added_at, row_number() OVER (PARTITION BY {SESSION} ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders WHERE o_orderpriority = '1-URGENT') WHERE k = 1")
def sessions_find(spark, sf_dir):
    return sessions.find_by_document(session_docs(spark, sf_dir), source_path="/in/1-URGENT").select("session_id", "doc_id", "added_at")


@query("SELECT 'sess_3' AS prefix, 'found' AS status, 'sess_3' AS session_id, CAST(11 AS BIGINT) AS n UNION ALL SELECT 'sess_', 'ambiguous', NULL, 40 UNION ALL SELECT 'none_', 'none', NULL, 0 UNION ALL SELECT 'sess_39', 'found', 'sess_39', 1")
def session_prefix(spark, sf_dir):
    held = session_docs(spark, sf_dir)
    out = None
    for prefix in ("sess_3", "sess_", "none_", "sess_39"):
        row = sessions.resolve_prefix(held, prefix)
        out = row if out is None else out.unionByName(row)
    return out


@query(f"SELECT max(struct_pack(changed := changed, session_id := session_id)).session_id AS session_id, max(changed) AS changed FROM (SELECT {SESSION} AS session_id, max(o_orderdate) AS changed FROM orders GROUP BY 1)")
def latest_session(spark, sf_dir):
    return sessions.latest(session_docs(spark, sf_dir).groupBy("session_id").agg(F.max("added_at").alias("changed")))


@query("SELECT 'c' || CAST(o_custkey AS VARCHAR) AS session_id, max(o_orderdate) AS changed FROM orders GROUP BY 1 HAVING max(o_orderdate) >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 7 DAY")
def ttl_cleanup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    held = orders.groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("session_id")).agg(F.max("o_orderdate").alias("changed"))
    return sessions.alive(held.crossJoin(F.broadcast(orders.agg(F.max("o_orderdate").alias("now")))), F.col("now")).drop("now")


@query("SELECT path, base || '_anonymized' || CASE WHEN k > 1 THEN '_' || CAST(k AS VARCHAR) ELSE '' END || '.txt' AS output FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY path) AS k FROM (SELECT '/d' || CAST(p_partkey AS VARCHAR) || '/' || p_brand || '.txt' AS path, p_brand AS base FROM part))")
def output_plan(spark, sf_dir):
    files = table(spark, sf_dir, "part").select(F.expr("concat('/d', cast(p_partkey as string), '/', p_brand, '.txt')").alias("path"))
    return sessions.planned_outputs(files)


@query("SELECT s_suppkey AS key, s_name || CASE WHEN s_suppkey % 2 = 0 THEN '!' ELSE '' END AS name FROM supplier")
def session_upsert(spark, sf_dir):
    old = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return sessions.upsert(old, old.where("key % 2 = 0").withColumn("name", F.concat("name", F.lit("!"))), "key")


@query("SELECT doc_id, 'sha256:' || sha256(text) AS source_hash FROM documents")
def hash_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sessions.sha256_of(F.col("text").cast("binary")).alias("source_hash"))


@query("""SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk, chunks[i] AS chunk_text FROM (SELECT doc_id, chunks, unnest(range(1, len(chunks) + 1)) AS i FROM (
  SELECT doc_id, list_reduce(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: [x]),
    lambda a, b: CASE WHEN length(a[len(a)]) + length(b[1]) + 2 <= 5000 THEN list_concat(a[1:len(a) - 1], [a[len(a)] || chr(10) || chr(10) || b[1]]) ELSE list_concat(a, b) END) AS chunks FROM documents))""")
def chunk_paragraphs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return det.paragraphs(docs).select("doc_id", "chunk", "chunk_text")


@query("""SELECT ts AS at, event_type AS tool, '{"text": "[' || CAST(length(props) AS VARCHAR) || ']", "id": ' || CAST(user_id AS VARCHAR) || '}' AS request, props AS response FROM events""")
def audit_events(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select(F.col("ts").alias("at"), F.col("event_type").alias("tool"), F.to_json(F.struct(F.col("props").alias("text"), F.col("user_id").alias("id"))).alias("request"), F.col("props").alias("response"))
    return audit.events(calls)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: documents rewritten with stable placeholders, with what was found in each."""
    docs = table(spark, sf_dir, "documents").select(F.lit("session").alias("session_id"), "doc_id", F.col("doc_id").alias("ord"), "text")
    rewritten, assigned, _ = redact.anonymize(docs)
    counts = assigned.groupBy("doc_id").agg(F.count("*").alias("entities"))
    return rewritten.join(counts, "doc_id", "left").select("doc_id", "anonymized_text", F.coalesce("entities", F.lit(0)).alias("entities"))
