"""Placeholders: a session's pool of entities, numbered across documents.

A pool has one row per (session_id, type, norm): family, variant, placeholder, raw (the first form
seen), first_ord and first_start. It is a plain table, so a session is extended by handing its pool
in and writing the one that comes out.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions import registry
from veilspark.operators.stored import stored

POOL = "session_id string, type string, norm string, family long, variant int, placeholder string, raw string, first_ord long, first_start int"


def norm(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(text)), r"[.,;:]+$", ""), r"\s+", " ")


def lookup(table: dict[str, str], key: Column) -> Column:
    """A small table as a map literal; the key itself where it has no entry."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key), key)


def tag(kind: Column) -> Column:
    return lookup(registry.TAGS, kind)


def letters(k: int) -> str:
    """1 to 26 as a to z, then aa, ab and so on: variants never read as numbers."""
    out = ""
    while k > 0:
        k, rest = divmod(k - 1, 26)
        out = chr(97 + rest) + out
    return out


def number(variant: str) -> int:
    out = 0
    for c in variant:
        out = out * 26 + ord(c) - 96
    return out


def mentions(spans: DataFrame) -> DataFrame:
    """Distinct entities of (session_id, ord, start, type, text) rows with their first place and the form seen there."""
    first = spans.groupBy("session_id", "type", norm(F.col("text")).alias("norm")).agg(F.min(F.struct("ord", "start", "text")).alias("first"))
    return first.select("session_id", "type", "norm", F.col("first.ord").cast("long").alias("first_ord"), F.col("first.start").cast("int").alias("first_start"), F.col("first.text").alias("raw"))


def exact_pool(spans: DataFrame, prefix: str = "") -> DataFrame:
    """A new pool without families: entities are numbered by first appearance.

    They are dealt by ranges of that order, numbered within each range and moved up by what the
    ranges before hold of the session and type, so no task sees all entities of a type."""
    order = ["first_ord", "first_start", "norm"]
    found = stored(mentions(spans), "mentions")
    dealt = stored(found.repartitionByRange("session_id", "type", *order).withColumn("part", F.spark_partition_id()), "ranges")
    held = dealt.groupBy("part", "session_id", "type").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("session_id", "type").orderBy("part")) - F.col("n")
    before = held.select(F.col("part").alias("p"), F.col("session_id").alias("s"), F.col("type").alias("t"), earlier.alias("before"))
    own = F.row_number().over(Window.partitionBy("part", "session_id", "type").orderBy(*order))
    here = (F.col("part") == F.col("p")) & F.col("session_id").eqNullSafe(F.col("s")) & F.col("type").eqNullSafe(F.col("t"))
    numbered = dealt.withColumn("own", own).join(before, here).withColumn("family", (F.col("own") + F.col("before")).cast("long"))
    head = F.lit(f"<{prefix}_" if prefix else "<")
    return numbered.select("session_id", "type", "norm", "family", F.lit(0).alias("variant"), F.concat(head, tag(F.col("type")), F.lit("_"), F.col("family"), F.lit(">")).alias("placeholder"), "raw", "first_ord", "first_start")


class Families:
    """Which family a new entity belongs to: the earliest head of which one contains the other, if both have
    four characters and the shorter is at least `ratio` of the longer.

    Heads are indexed by their leading four characters and by length, so that an entity meets only
    heads that occur in it, or, through a text of all heads, those it occurs in."""

    def __init__(self, ratio: float):
        self.ratio, self.heads, self.by_gram = ratio, [], {}

    def add(self, head: str, family: int, used: int) -> None:
        place = len(self.heads)
        self.heads.append([head, family, used])
        for gram in {head[k : k + 4] for k in range(len(head) - 3)}:
            self.by_gram.setdefault(gram, []).append(place)

    def find(self, term: str) -> list | None:
        """A head within reach shares every gram of the shorter of the two, so the term's rarest gram or any head's first is enough."""
        if len(term) < 4:
            return None
        near = {p for k in range(len(term) - 3) for p in self.by_gram.get(term[k : k + 4], ())}
        for place in sorted(near):
            head = self.heads[place][0]
            if (term in head or head in term) and min(len(term), len(head)) >= self.ratio * max(len(term), len(head)):
                return self.heads[place]
        return None


def build_pool(spans: DataFrame, pool: DataFrame | None = None, prefix: str = "", ratio: float = 0.5) -> DataFrame:
    """The pool after a batch of spans (session_id, ord, start, type, text), with what was in it before.

    Entities already in the pool keep their placeholders. New ones join a family or found one, in
    order of (ord, start): this is the only step that looks across documents, one shuffle of
    distinct entities on (session_id, type). ratio=0 is the rule of chunked documents."""
    found = mentions(spans)
    old = pool if pool is not None else spans.sparkSession.createDataFrame([], POOL)
    fresh = found.join(old.select("session_id", "type", "norm"), ["session_id", "type", "norm"], "left_anti")
    empty = {"family": F.lit(None).cast("long"), "variant": F.lit(None).cast("int"), "placeholder": F.lit(None).cast("string")}
    columns = ["session_id", "type", "norm", "family", "variant", "placeholder", "raw", "first_ord", "first_start"]
    # Groups without anything new pass by.
    touched = fresh.select("session_id", "type").distinct()
    rows = old.join(touched, ["session_id", "type"], "left_semi").select(columns).unionByName(fresh.withColumns(empty).select(columns))

    def number_group(data: pd.DataFrame) -> pd.DataFrame:
        known = data[data.placeholder.notna()].sort_values(["family", "variant"])
        new = data[data.placeholder.isna()].sort_values(["first_ord", "first_start", "norm"])
        families, count = Families(ratio), int(known.family.max()) if len(known) else 0
        used: dict[int, int] = {}
        heads: dict[int, str] = {}
        known = known.astype({"family": "int64", "variant": "int32"})
        for r in known.itertuples():
            used[r.family] = max(used.get(r.family, 0), r.variant)
            heads.setdefault(r.family, r.norm)
        for family, head in heads.items():
            families.add(head, family, used[family])
        kind = data.type.iloc[0]
        begin = f"<{prefix}_" if prefix else "<"
        out = [tuple(r)[1:] for r in known[columns].itertuples()]
        for r in new.itertuples():
            have = families.find(r.norm)
            if have:
                have[2] += 1
                family, variant = have[1], have[2]
            else:
                count += 1
                family, variant = count, 0
                if len(r.norm) >= 4:
                    families.add(r.norm, family, 0)
            out.append((r.session_id, r.type, r.norm, family, variant, f"{begin}{registry.TAGS.get(kind, kind)}_{family}{letters(variant)}>", r.raw, r.first_ord, r.first_start))
        return pd.DataFrame(out, columns=columns)

    changed = rows.groupBy("session_id", "type").applyInPandas(number_group, POOL)
    return changed.unionByName(old.join(touched, ["session_id", "type"], "left_anti").select(columns))


def assign(spans: DataFrame, pool: DataFrame, *more: str) -> DataFrame:
    """Spans with their placeholders and more columns of the pool; the pool's side is merged or broadcast by its measured size."""
    keyed = spans.withColumn("norm", norm(F.col("text")))
    return keyed.join(pool.select("session_id", "type", "norm", "placeholder", *more), ["session_id", "type", "norm"], "left").drop("norm")


# ---------------------------------------------------------------- mappings and states


def mapping(pool: DataFrame) -> DataFrame:
    return pool.select("session_id", "placeholder", "raw")


PLACEHOLDER = r"^<(?:(D\d+)_)?([A-Z][A-Z_]*?)_(\d+)([a-z]*)>$"


def parsed(placeholder: Column) -> dict[str, Column]:
    """prefix, tag, family and variant letters of a placeholder, null where it is none."""
    part = lambda k: F.when(placeholder.rlike(PLACEHOLDER), F.regexp_extract(placeholder, PLACEHOLDER, k))
    return {"prefix": part(1), "tag": part(2), "family": part(3).cast("long"), "letters": part(4)}


def safe_mapping(mappings: DataFrame) -> DataFrame:
    """Placeholders with tags and types, without any raw value."""
    return mappings.select("session_id", "placeholder", parsed(F.col("placeholder"))["tag"].alias("tag")).withColumn("type", lookup(registry.TYPES, F.col("tag")))


def reconstruct(mappings: DataFrame) -> DataFrame:
    """A pool from (session_id, placeholder, raw) alone, for sessions whose pool was never kept.

    Families continue behind the highest number of each type; a variant without a head counts as head."""
    p = parsed(F.col("placeholder"))
    value = F.aggregate(F.transform(F.filter(F.split("letters", ""), lambda c: c != ""), lambda c: F.ascii(c) - 96), F.lit(0), lambda a, x: a * 26 + x)
    rows = mappings.withColumns(p).where("tag IS NOT NULL").withColumn("variant", value.cast("int"))
    kind = lookup(registry.TYPES, F.col("tag"))
    order = Window.partitionBy("session_id", "type", "norm").orderBy("variant", "placeholder")
    named = rows.select("session_id", kind.alias("type"), norm(F.col("raw")).alias("norm"), "family", "variant", "placeholder", "raw", F.lit(0).cast("long").alias("first_ord"), F.lit(0).alias("first_start"))
    return named.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def counters(pool: DataFrame) -> DataFrame:
    """The last family number of each type."""
    return pool.groupBy("session_id", "type").agg(F.max("family").alias("counter"))


def state_json(pool: DataFrame) -> DataFrame:
    """One row a session: its pool as JSON, for stores and archives."""
    entries = F.sort_array(F.collect_list(F.struct("type", "norm", "family", "variant", "placeholder", "raw", "first_ord", "first_start")))
    return pool.groupBy("session_id").agg(F.to_json(F.struct(F.lit(1).alias("schema_version"), entries.alias("entries"))).alias("state"))


def from_state_json(states: DataFrame) -> DataFrame:
    schema = "schema_version int, entries array<struct<type:string,norm:string,family:bigint,variant:int,placeholder:string,raw:string,first_ord:bigint,first_start:int>>"
    return states.select("session_id", F.inline(F.from_json("state", schema)["entries"]))


def dumps(rows: list[dict]) -> str:
    return json.dumps({"schema_version": 1, "entries": rows}, ensure_ascii=False)
