"""Rewriting texts with placeholders, restoring them and checking for leaks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.operators import detect as detection
from veilspark.operators import pool as pools
from veilspark.operators.stored import stored

#: What a placeholder looks like inside a text, prefixed ones included.
SHAPE = r"<(?:D\d+_)?[A-Z][A-Z_]*_\d+[a-z]*>"


def spliced(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its placeholder: a fold over the spans in order of place."""
    ordered = F.array_sort(spans, lambda a, b: a["start"] - b["start"])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, s):
        free = s["start"] >= state["at"]
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        return F.when(free, F.struct(s["end"].alias("at"), F.concat(state["out"], gap, s["placeholder"]).alias("out"))).otherwise(state)

    return F.aggregate(ordered, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


FORMS = "array<struct<place:int,raw:string>>"


def other_forms(text: Column, spans: Column) -> Column:
    """What a mapping alone would restore otherwise, by the number of the placeholder in the rewritten text: spans in another
    form than the pool's raw one, and what looked like a placeholder in the text before. spans: start, end and raw."""
    ordered = F.array_sort(spans, lambda a, b: a["start"] - b["start"])
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.array().cast(FORMS).alias("out"))
    own = lambda gap: F.regexp_extract_all(gap, F.lit(SHAPE), F.lit(0))
    kept = lambda state, gap: F.concat(state["out"], F.transform(own(gap), lambda p, i: F.struct((state["k"] + i).alias("place"), p.alias("raw"))))

    def step(state, s):
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        body = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        k = state["k"] + F.size(own(gap))
        form = F.when(body.eqNullSafe(s["raw"]), F.array().cast(FORMS)).otherwise(F.array(F.struct(k.alias("place"), body.alias("raw"))))
        return F.when(s["start"] >= state["at"], F.struct(s["end"].alias("at"), (k + 1).alias("k"), F.concat(kept(state, gap), form).alias("out"))).otherwise(state)

    spans_or_none = F.coalesce(ordered, F.array().cast("array<struct<start:int,end:int,placeholder:string,raw:string>>"))
    return F.aggregate(spans_or_none, start, step, lambda s: kept(s, F.substring(text, s["at"] + 1, F.length(text)))).cast(FORMS)


def anonymize(docs: DataFrame, pool: DataFrame | None = None, prefix: str = "", ratio: float = 0.5, spans: DataFrame | None = None, forms: bool = False, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rewritten docs, assigned spans, new pool) of docs(session_id, doc_id, ord, text).

    Detection is narrow; the pool takes one shuffle of distinct entities; placeholders come back to
    the spans by a join on the entity and to the texts by one on the document. spans: what to
    replace, if it was found (and perhaps corrected) before. forms adds the column of that name, for an exact restore."""
    if spans is None:
        # The pool and the placeholders both read the spans: they are found once.
        spans = stored(detection.spans_table(detection.detect(docs.select("session_id", "doc_id", "ord", "text"), **options), "session_id", "doc_id", "ord"), "spans")
    new = pools.build_pool(spans, pool, prefix, ratio)
    named = pools.assign(spans, new, "raw")
    assigned = named.drop("raw")
    grouped = named.groupBy("session_id", "doc_id").agg(F.collect_list(F.struct("start", "end", "placeholder", "raw")).alias("replaced"))
    out = docs.join(grouped, ["session_id", "doc_id"], "left")
    rewritten = F.when(F.col("replaced").isNull(), F.col("text")).otherwise(spliced(F.col("text"), F.col("replaced")))
    if forms:
        out = out.withColumn("forms", other_forms(F.col("text"), F.col("replaced")))
    return out.withColumn("anonymized_text", rewritten).drop("replaced"), assigned, new


def restore(docs: DataFrame, mapping: DataFrame, text: str = "anonymized_text", forms: str | None = None) -> DataFrame:
    """Adds restored_text: every placeholder of the document's session becomes its value; unknown ones stay.

    The text is parted at its placeholders, so that each is looked up once and no value is ever
    searched for placeholders again. A value is the first form that was seen, so a text comes back
    exactly but for later forms of one entity that differ in case, spaces or final marks, and for what
    looked like a placeholder before; with forms, the column that other_forms() made, it comes back exactly."""
    body = F.col(text)
    tokens = F.array_distinct(F.regexp_extract_all(body, F.lit(SHAPE), F.lit(0)))
    wanted = docs.select("session_id", "doc_id", F.explode(tokens).alias("placeholder"))
    known = wanted.join(mapping, ["session_id", "placeholder"]).groupBy("session_id", "doc_id").agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "raw"))).alias("values"))
    pieces, found = F.split(body, SHAPE, -1), F.regexp_extract_all(body, F.lit(SHAPE), F.lit(0))
    known_as = lambda p: F.coalesce(F.try_element_at("values", p), p)
    values = F.transform(found, known_as)
    if forms:
        by_place = F.map_from_entries(F.transform(forms, lambda x: F.struct(x["place"], x["raw"])))
        values = F.when(F.size(forms) > 0, F.transform(found, lambda p, k: F.coalesce(F.try_element_at(by_place, k), known_as(p)))).otherwise(values)
    joined = F.concat(F.array_join(F.transform(F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("gap"), values.alias("value")), lambda x: F.concat(x["gap"], x["value"])), ""), F.element_at(pieces, -1))
    out = docs.join(known, ["session_id", "doc_id"], "left")
    return out.withColumn("restored_text", F.when(F.col("values").isNull() & (F.size(forms) <= 0 if forms else F.lit(True)), body).otherwise(joined)).drop("values")


def verify(docs: DataFrame, mapping: DataFrame | None = None, text: str = "anonymized_text", **options) -> DataFrame:
    """Leaks of rewritten docs: what detection still finds, but for placeholders; with 30 characters around."""
    found = detection.detect(docs, text=text, **options)
    s = detection.spans_table(found, "session_id", "doc_id", text)
    core = F.trim(F.col("text"))
    leaks = s.where(~core.rlike(f"^{SHAPE}$") & ~core.rlike(r"^<?(?:D\d+_)?[A-Z][A-Z_]*_\d+[a-z]*>?$"))
    if mapping is not None:
        leaks = leaks.join(mapping.select("session_id", F.col("placeholder").alias("text")), ["session_id", "text"], "left_anti")
    around = detection.window(F.col(text), F.col("start"), F.col("end"), 30, 30)
    return leaks.select("session_id", "doc_id", "type", "start", "end", "score", F.col("text").alias("leak"), around.alias("context"))


def already_anonymized(text: Column) -> Column:
    """Whether a text holds placeholders, so that it would be rewritten twice."""
    return text.rlike(SHAPE)


def placeholder_like(value: str) -> bool:
    return bool(re.fullmatch(SHAPE, value))
