"""Detection over DataFrames: the whole chain in one narrow stage, or single recognizers as columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions import registry
from veilspark.functions import text as one
from veilspark.functions.registry import BOOST, CONTEXT_CHARS, MIN_SCORE

SPAN = "struct<seq:int,start:int,end:int,type:string,score:double,verified:boolean,reason:string,text:string>"
SPANS = f"array<{SPAN}>"
ARROW_SPANS = pa.list_(
    pa.struct([("seq", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("score", pa.float64()), ("verified", pa.bool_()), ("reason", pa.string()), ("text", pa.string())])
)


def as_rows(spans: list[one.Span]) -> list[dict]:
    return [{"seq": k, "start": s.start, "end": s.end, "type": s.kind, "score": s.score, "verified": s.verified, "reason": s.reason, "text": s.text} for k, s in enumerate(spans)]


#: Bytes of input a task of detection is meant for, and tasks a core at least.
SHARE, TASKS = 8 << 20, 4


def dealt(df: DataFrame) -> DataFrame:
    """df over tasks of equal shares. Detection costs far more than a shuffle, and a table in one file or row group is read by one task, however many cores there are."""
    if df.isStreaming:
        return df
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    known = sum(x for x in sizes if x < 1 << 60)  # a table without a size counts as endless
    return df.repartition(max(TASKS * df.sparkSession.sparkContext.defaultParallelism, known // SHARE))


def map_spans(df: DataFrame, function: Callable[..., list[one.Span]], inputs: list[str], column: str = "spans") -> DataFrame:
    """df with function(*inputs) of each row as a column of spans; one Arrow stage over rows dealt out evenly."""

    def run(batches):
        for batch in batches:
            given = [batch.column(c) for c in inputs]
            made = pa.array([as_rows(function(*(c[k].as_py() for c in given))) for k in range(batch.num_rows)], ARROW_SPANS)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, column])

    return dealt(df).mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(column, T._parse_datatype_string(SPANS))]))


def detect(
    df: DataFrame,
    text: str = "text",
    make_model: Callable[[], Callable] | None = None,
    min_score: float = MIN_SCORE,
    stoplist: frozenset[str] = one.STOPLIST,
    most: int | None = 8,
    language: str | None = None,
) -> DataFrame:
    """Adds spans. make_model builds a named-entity model, once a worker: a function from a text of at most
    2500 characters to (start, end, type, score); without it, or if it fails, the patterns stand alone.

    language is accepted and has no effect: every recognizer is tried on every text."""
    held: list = []

    def run(body):
        if make_model and not held:
            held.append(make_model())

        def safe(part):
            try:
                return held[0](part)
            except Exception:  # noqa: BLE001  a failing model must not lose the patterns' findings
                return []

        return one.detect(body, safe if make_model else None, min_score, stoplist, most)

    return map_spans(df, run, [text])


def spans_table(df: DataFrame, *keys: str) -> DataFrame:
    """One row a span.

    An inner inline would have Spark filter on the size of spans first, and push that filter below them and the text:
    every mention of the text would become its whole expression, computed again at each step of each recognizer."""
    return df.select(*keys, F.inline_outer("spans")).where(F.col("seq").isNotNull())


# ---------------------------------------------------------------- recognizers as columns


#: A sign that every match of a pattern holds.
SIGNS = {"email": "@", "phone_intl": "+", "phone_us_paren": "("}


def may_match(text: Column, pattern: registry.Pattern) -> Column:
    """Whether a text holds what every match of a pattern does: a sign, its first letters or a digit, found without the pattern itself."""
    sign = SIGNS.get(pattern.name) or registry.head(pattern)
    held = text.contains(sign) if sign else F.lit(True)
    return held & text.rlike("[0-9]") if pattern.digits else held


#: Stands around matches; another control character, alike to every pattern, takes its place where a text holds it.
MARK, OTHER = "\x01", "\x02"


def matches(text: Column, pattern: registry.Pattern) -> Column:
    """Places of all matches of a pattern as array<struct<start,end,text>>, within generated code.

    Spark gives matches without places: they are marked, and the text is parted at the marks, which takes one pass
    of the pattern. Every second part is a match. Texts without the pattern's first look are never parted."""
    regex = registry.java(pattern)
    marked = F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(OTHER)), regex, f"{MARK}$0{MARK}")
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def step(state, part):
        end = state["at"] + F.length(part)
        found = F.struct(state["at"].alias("start"), end.alias("end"), F.substring(text, state["at"] + 1, F.length(part)).alias("text"))
        return F.struct(end.alias("at"), (~state["hit"]).alias("hit"), F.when(state["hit"], F.concat(state["out"], F.array(found))).otherwise(state["out"]).alias("out"))

    places = F.aggregate(F.split(marked, MARK, -1), start, step, lambda s: s["out"])
    return F.when(may_match(text, pattern) & text.rlike(regex), places).otherwise(F.array().cast("array<struct<start:int,end:int,text:string>>"))


def window(text: Column, start: Column, end: Column, before: int, after: int) -> Column:
    """Characters around a range, itself included."""
    left = F.greatest(start - before, F.lit(0))
    return F.substring(text, left + 1, end + after - left)


def boosted(text: Column, start: Column, end: Column, words: tuple[str, ...], score: float) -> Column:
    """The score, raised where a context word stands near. White space matters to words that hold some alone, and a word that holds another is found with it."""
    near = F.lower(window(text, start, end, CONTEXT_CHARS, CONTEXT_CHARS))
    known = one.context_words(words)
    least = [w for w in known if not any(v in w for v in known if v != w)]
    # An array of one binds the window, so that it is cut out once for all words.
    held = lambda at, some: F.exists(F.array(at), lambda n: reduce(lambda a, b: a | b, [n.contains(w) for w in some]))
    single, several = [w for w in least if " " not in w], [w for w in least if " " in w]
    looks = ([held(near, single)] if single else []) + ([held(F.regexp_replace(near, r"\s+", " "), several)] if several else [])
    return F.when(reduce(lambda a, b: a | b, looks), F.least(F.lit(1.0), F.lit(score) + F.lit(BOOST))).otherwise(F.lit(score))


def guard(kind: str, text: Column, start: Column, end: Column, body: Column) -> Column:
    """Whether a match of a type is to be kept; the guards that only look at a window."""
    if kind == "IBAN_CODE":
        return ~window(text, start, start, 120, 0).rlike(r"(?i)trade\s*mark|registration\s+(?:number|no\.?)|classes?\s+\d")
    if kind == "IP_ADDRESS":
        before = window(text, start, start, 30, 0)
        section = before.rlike(r"(?i)(?:§|section|clause|article|item|paragraph|part|sub[-\s]?(?:section|clause))\s*$") | before.rlike(r"\d+\.\s*$")
        octets = F.transform(F.split(body, r"\."), lambda x: x.try_cast("int"))
        small = (F.size(octets) == 4) & F.forall(octets, lambda x: x <= 50) & (F.get(octets, F.lit(0)) <= 9)
        return ~section & ~F.coalesce(small, F.lit(False))
    if kind == "UK_NHS":
        around = F.concat(window(text, start, start, 60, 0), window(text, end, end, 0, 60))
        refs = rf"(?i){registry.JAVA_BOUNDARY}(?:order[\s/]*no|document[\s/]*no|ref(?:erence)?[\s./]*no|license[\s/]*no|contract[\s/]*no|form[\s/]*no|page\s+\d)"
        return ~around.rlike(refs) & ~around.rlike(rf"(?i)©|copyright|{registry.JAVA_BOUNDARY}page{registry.JAVA_BOUNDARY}|{registry.JAVA_BOUNDARY}initial")
    if kind == "ORGANIZATION":
        word = lambda regex: f"{registry.JAVA_BOUNDARY}(?:{regex}){registry.JAVA_BOUNDARY}"
        clause = body.rlike("(?i)" + word(r"(?:NOT|BUT|OR|AND)\s+LIMITED")) | body.rlike(word("EXPRESS|IMPLIED|INCLUDING|WARRANTIES|MERCHANTABILITY|FITNESS"))
        listed = body.contains(",") & body.rlike("(?i)" + word(r"(?:A|An|The)\s+(?:Partnership|LLC|LLP|Corporation|Limited)"))
        return ~clause & ~listed
    return F.lit(True)


def relabelled(kind: str, text: Column, start: Column) -> Column:
    """Whether a match of the health number is a phone number by its label."""
    if kind != "UK_NHS":
        return F.lit(False)
    return window(text, start, start, 60, 0).rlike(rf"(?i){registry.JAVA_BOUNDARY}(?:tel|fax|phone|mobile|telephone)\s*:?\s*$")


def scan(df: DataFrame, names: list[str], text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """Adds spans of the named recognizers: matches, guards, context and least score, as columns alone.

    For audits of a few types over a large table; detect() runs the whole chain."""
    arrays = [found_by(F.col(text), order, registry.BY_NAME[name]) for order, name in enumerate(names)]
    return dealt(df).withColumn("spans", F.filter(F.concat(*arrays), lambda s: s["score"] >= min_score).cast(SPANS))


def found_by(body: Column, order: int, p: registry.Pattern) -> Column:
    """The spans of one recognizer."""

    def made(m):
        phone = relabelled(p.kind, body, m["start"])
        return F.struct(
            F.lit(order).cast("int").alias("seq"),
            m["start"].alias("start"),
            m["end"].alias("end"),
            F.when(phone, F.lit("PHONE_NUMBER")).otherwise(F.lit(p.kind)).alias("type"),
            F.when(phone, F.lit(0.75)).otherwise(boosted(body, m["start"], m["end"], p.context, p.score)).alias("score"),
            F.lit(True).alias("verified"),
            F.when(phone, F.lit("pattern:labeled_phone")).otherwise(F.lit(f"pattern:{p.name}")).alias("reason"),
            m["text"].alias("text"),
        )

    return F.transform(F.filter(matches(body, p), lambda m: guard(p.kind, body, m["start"], m["end"], m["text"])), made)


def without_overlaps(spans: Column) -> Column:
    """The overlap rule as a fold over the sorted array: each span meets the last that was kept."""
    ordered = F.array_sort(
        spans,
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["score"] > b["score"], F.lit(-1)).when(a["score"] < b["score"], F.lit(1)).otherwise(a["seq"] - b["seq"]),
    )

    def step(kept, s):
        last = F.get(kept, F.size(kept) - 1)
        shorter = (s["type"] == last["type"]) & (last["end"] - last["start"] > s["end"] - s["start"])
        wins = (s["score"] > last["score"]) & ~(shorter & ~((s["score"] >= 0.90) & (last["score"] < 0.80)))
        apart = (F.size(kept) == 0) | (s["start"] >= last["end"])
        return F.when(apart, F.concat(kept, F.array(s))).when(wins, F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(s))).otherwise(kept)

    return F.aggregate(ordered, F.array().cast(SPANS), step)


# ---------------------------------------------------------------- reports


def type_counts(spans: DataFrame) -> DataFrame:
    """Spans of each type, most frequent first."""
    return spans.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def report(df: DataFrame, *keys: str, text: str = "text", first: int = 25) -> DataFrame:
    """Of each text with spans: chars, entities, by_type (most frequent first) and sample, a line for each of the first spans."""
    kinds = F.array_distinct(F.transform("spans", lambda s: s["type"]))
    counted = F.transform(kinds, lambda t: F.struct((-F.size(F.filter("spans", lambda s: s["type"] == t))).alias("less"), t.alias("type")))
    by_type = F.array_join(F.transform(F.array_sort(counted), lambda x: F.concat(x["type"], F.lit(" "), (-x["less"]).cast("string"))), ", ")
    short = lambda s: F.when(F.length(s["text"]) > 50, F.concat(F.substring(s["text"], 1, 47), F.lit("..."))).otherwise(s["text"])
    line = lambda s: F.concat(F.lit("["), s["type"], F.lit("] "), short(s), F.lit(" (score="), F.format_number(s["score"], 2), F.lit(")"))
    return df.select(*keys, F.length(text).alias("chars"), F.size("spans").alias("entities"), by_type.alias("by_type"), F.array_join(F.transform(F.slice("spans", 1, first), line), "\n").alias("sample"))


def propagated(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds to spans every further occurrence of what they name."""
    revive = lambda body, spans: one.propagate(body, [one.Span(s["start"], s["end"], s["type"], s["score"], s["reason"], s["text"], s["verified"]) for s in spans or []])
    return map_spans(df, revive, [text, "spans"], "found").drop("spans").withColumnRenamed("found", "spans")


def paragraphs(df: DataFrame, text: str = "text", size: int = 5_000) -> DataFrame:
    """Chunks of whole paragraphs of at most `size` characters each, unless one paragraph is longer: chunk and chunk_text."""
    parts = F.split(F.col(text), "\n\n", -1)
    start = F.array().cast("array<string>")

    def step(chunks, part):
        last = F.get(chunks, F.size(chunks) - 1)
        fits = (F.size(chunks) > 0) & (F.length(last) + F.length(part) + 2 <= size)
        return F.when(fits, F.concat(F.slice(chunks, 1, F.size(chunks) - 1), F.array(F.concat(last, F.lit("\n\n"), part)))).otherwise(F.concat(chunks, F.array(part)))

    return df.select("*", F.posexplode(F.aggregate(parts, start, step)).alias("chunk", "chunk_text"))
