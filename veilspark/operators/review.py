"""Corrections by reviewers: overrides, and what a review screen shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import text as one
from veilspark.operators import detect as detection
from veilspark.operators.pool import lookup
from veilspark.operators.stored import map_sorted

# ---- fixed values: groups of a review screen ----
GROUPS = {
    "PERSON": "person",
    "NRP": "person",
    "ORGANIZATION": "organization",
    "LOCATION": "location",
    "EMAIL_ADDRESS": "contact",
    "PHONE_NUMBER": "contact",
    "URL": "contact",
    "IP_ADDRESS": "network",
    "CREDIT_CARD": "financial",
    "IBAN_CODE": "financial",
    "CRYPTO": "financial",
    "MEDICAL_LICENSE": "medical",
    "UK_NHS": "medical",
}
# ---- end of fixed values ----

OVERRIDES = "struct<remove:array<int>,add:array<struct<text:string,type:string,start:int,end:int>>>"


def keep_unremoved(spans: Column, remove: Column) -> Column:
    """Spans but for those at the given places."""
    return F.filter(spans, lambda s, i: ~F.coalesce(F.array_contains(remove, i), F.lit(False)))


def normalized_additions(add: Column, text: Column) -> Column:
    """Additions with places: where none is given, the first occurrence; what doesn't occur is dropped."""
    at = lambda a: F.coalesce(a["start"], F.position(a["text"], text) - 1)
    placed = F.transform(F.filter(add, lambda a: F.length(a["text"]) > 0), lambda a: F.struct(a["text"].alias("text"), a["type"].alias("type"), at(a).alias("start"), F.coalesce(a["end"], at(a) + F.length(a["text"])).alias("end")))
    return F.filter(placed, lambda a: a["start"] >= 0)


def apply_overrides(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs(text, spans, overrides) with corrected spans: removals by place, additions at every whole-word
    occurrence whatever the case, longer spans first, overlaps resolved."""

    def correct(body, spans, overrides):
        overrides = overrides or {}
        gone = set(overrides.get("remove") or ())
        kept = [one.Span(s["start"], s["end"], s["type"], 1.0 if s["score"] is None else s["score"], "hitl:kept", s["text"]) for k, s in enumerate(spans or ()) if k not in gone]
        for a in overrides.get("add") or ():
            if a["text"]:
                kept += [one.Span(b, e, a["type"], 1.0, "hitl:user_added", body[b:e]) for b, e in one.occurrences(body, a["text"])]
        return one.without_overlaps(sorted(kept, key=lambda s: (s.start, -s.end)))

    return detection.map_spans(docs, correct, [text, "spans", "overrides"], "corrected").drop("spans").withColumnRenamed("corrected", "spans")


def status(docs: DataFrame) -> DataFrame:
    """docs(approved, overrides) with the state of their review."""
    changes = F.size(F.coalesce(F.col("overrides.remove"), F.array())) + F.size(F.coalesce(F.col("overrides.add"), F.array()))
    return docs.withColumn("status", F.when(~F.coalesce(F.col("approved"), F.lit(False)), "waiting_for_approval").when(changes == 0, "approved_no_changes").otherwise("success"))


def propagate_to_siblings(reviews: DataFrame, changes: DataFrame) -> DataFrame:
    """What changes(session_id, doc_id, action, type, text) mean for the session's other documents that aren't approved:
    one row a document and change; the join is on the session."""
    open_ = reviews.where(~F.coalesce(F.col("approved"), F.lit(False))).select("session_id", F.col("doc_id").alias("sibling"))
    return changes.join(open_, "session_id").where("sibling <> doc_id").select("session_id", "doc_id", "sibling", "action", "type", "text")


def family_roots(forms: list[str]) -> list[str]:
    """The root of each form's family. A form joins the first family whose root contains it, is contained in it or shares
    its first word of four letters, if the shorter has four letters and at least half the length of the longer; the
    shorter is the root from then on. Families are indexed by the grams of four letters that any of these cases shares."""
    roots: list[str] = []
    by_gram: dict[str, dict[int, None]] = {}
    grams = lambda form: {form[k : k + 4] for k in range(len(form) - 3)}

    def related(form: str, root: str) -> bool:
        if min(len(form), len(root)) < 0.5 * max(len(form), len(root)):
            return False
        word, other = form.split()[0], root.split()[0]
        return form in root or root in form or (len(word) >= 4 and word == other)

    owners = []
    for form in forms:
        near = sorted({f for g in grams(form) for f in by_gram.get(g, ())})
        family = next((f for f in near if related(form, roots[f])), len(roots))
        if family == len(roots):
            roots.append(form)
        elif len(form) < len(roots[family]):
            roots[family] = form
        if roots[family] == form:
            for g in grams(form):
                by_gram.setdefault(g, {})[family] = None
        owners.append(family)
    return [roots[f] for f in owners]


def families(spans: DataFrame) -> DataFrame:
    """Entities of spans(session_id, ord, start, type, text) with the root that a review screen groups them under, in
    order of their first place. Families are greedy by definition, so a session's distinct forms of a type meet in one task."""
    form = F.lower(F.trim(F.col("text")))
    forms = spans.groupBy("session_id", "type", form.alias("form")).agg(F.count("*").alias("n"), F.min(F.struct("ord", "start")).alias("first"))

    def group(rows: list[tuple]) -> list[tuple]:
        """Of one session and type: (session_id, type, form, n) with the root of each."""
        return [(*row, root) for row, root in zip(rows, family_roots([row[2] for row in rows]))]

    flat = forms.select("session_id", "type", "form", "n", "first.ord", "first.start")
    dealt = flat.repartition("session_id", "type").sortWithinPartitions("session_id", "type", "ord", "start", "form").select("session_id", "type", "form", "n")
    return map_sorted(dealt, 2, group, "session_id string, type string, form string, n long, root string")


def segments(text: Column, spans: Column) -> Column:
    """The text cut at every start and end of a span: array<struct<start,end,text,covered>>."""
    points = F.array_sort(F.array_distinct(F.flatten(F.array(F.array(F.lit(0), F.length(text)), F.transform(spans, lambda s: s["start"]), F.transform(spans, lambda s: s["end"])))))
    ends = F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0)))
    pairs = F.arrays_zip(F.slice(points, 1, F.size(ends)).alias("start"), ends.alias("end"))
    return F.transform(
        pairs,
        lambda p: F.struct(
            p["start"].alias("start"),
            p["end"].alias("end"),
            F.substring(text, p["start"] + 1, p["end"] - p["start"]).alias("text"),
            F.exists(spans, lambda s: (s["start"] <= p["start"]) & (s["end"] >= p["end"])).alias("covered"),
        ),
    )


def group_of(kind: Column) -> Column:
    """The display group of a type; identity numbers otherwise."""
    return F.when(lookup(GROUPS, kind) == kind, F.lit("identity")).otherwise(lookup(GROUPS, kind))
