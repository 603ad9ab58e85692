"""DuckDB SQL for recognizers: places from the pieces between matches, guards, context, least score."""

from __future__ import annotations

from veilspark.functions import registry
from veilspark.functions.text import context_words


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def near(before: int, after: int, at: str = "s", to: str = "e") -> str:
    left = f"greatest({at} - {before}, 0)"
    return f"substr(text, {left} + 1, {to} + {after} - {left})"


def guard(kind: str) -> str:
    if kind == "IBAN_CODE":
        return rf"NOT regexp_matches({near(120, 0, 's', 's')}, '(?i)trade\s*mark|registration\s+(?:number|no\.?)|classes?\s+\d')"
    if kind == "IP_ADDRESS":
        before = near(30, 0, "s", "s")
        octets = "list_transform(string_split(hit, '.'), lambda x: try_cast(x AS INTEGER))"
        small = f"(len({octets}) = 4 AND {octets}[1] <= 9 AND list_bool_and(list_transform({octets}, lambda x: x <= 50)))"
        return rf"NOT regexp_matches({before}, '(?i)(?:§|section|clause|article|item|paragraph|part|sub[-\s]?(?:section|clause))\s*$') AND NOT regexp_matches({before}, '\d+\.\s*$') AND NOT coalesce({small}, false)"
    if kind == "UK_NHS":
        around = f"concat({near(60, 0, 's', 's')}, {near(0, 60, 'e', 'e')})"
        return rf"NOT regexp_matches({around}, '(?i)\b(?:order[\s/]*no|document[\s/]*no|ref(?:erence)?[\s./]*no|license[\s/]*no|contract[\s/]*no|form[\s/]*no|page\s+\d)|©|copyright|\bpage\b|\binitial')"
    if kind == "ORGANIZATION":
        clause = r"regexp_matches(hit, '(?i)\b(?:NOT|BUT|OR|AND)\s+LIMITED\b') OR regexp_matches(hit, '\b(?:EXPRESS|IMPLIED|INCLUDING|WARRANTIES|MERCHANTABILITY|FITNESS)\b')"
        return rf"NOT ({clause} OR contains(hit, ',') AND regexp_matches(hit, '(?i)\b(?:A|An|The)\s+(?:Partnership|LLC|LLP|Corporation|Limited)\b'))"
    return "true"


def spans(source: str, names: list[str]) -> str:
    """SELECT doc_id, seq, name, type, s, e, score, hit of the named patterns over source(doc_id, text)."""
    out = []
    for k, name in enumerate(names):
        p = registry.BY_NAME[name]
        regex = quoted(p.regex)
        words = " OR ".join(f"contains(near, {quoted(w)})" for w in context_words(p.context))
        phone = rf"regexp_matches({near(60, 0, 's', 's')}, '(?i)\b(?:tel|fax|phone|mobile|telephone)\s*:?\s*$')" if p.kind == "UK_NHS" else "false"
        out.append(
            f"""
SELECT doc_id, {k} AS seq, CASE WHEN phone THEN 'pattern:labeled_phone' ELSE 'pattern:{name}' END AS reason, CASE WHEN phone THEN 'PHONE_NUMBER' ELSE '{p.kind}' END AS type, s, e, hit, text,
  CASE WHEN phone THEN CAST(0.75 AS DOUBLE) WHEN {words} THEN least(CAST(1.0 AS DOUBLE), CAST({p.score} AS DOUBLE) + CAST(0.35 AS DOUBLE)) ELSE CAST({p.score} AS DOUBLE) END AS score
FROM (SELECT *, regexp_replace(lower({near(200, 200)}), '\\s+', ' ', 'g') AS near, {phone} AS phone
  FROM (SELECT *, s + len(hit) AS e
    FROM (SELECT doc_id, text, m[i] AS hit, CAST(list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS BIGINT) AS s
      FROM (SELECT doc_id, text, m, g, unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT doc_id, text, regexp_extract_all(text, {regex}) AS m, string_split_regex(text, {regex}) AS g FROM ({source}) WHERE regexp_matches(text, {regex})))))
  WHERE {guard(p.kind)})"""
        )
    return "SELECT * FROM (" + "\nUNION ALL".join(out) + f") WHERE score >= {registry.MIN_SCORE}"


def without_overlaps(inner: str) -> str:
    """doc_id and kept, the spans that the overlap rule leaves, of rows as spans() gives them."""
    last = "a[len(a)]"
    shorter = f"({last}.type = b[1].type AND {last}.e - {last}.s > b[1].e - b[1].s)"
    rule = f"""CASE WHEN b[1].s >= {last}.e THEN list_concat(a, b)
      WHEN b[1].score > {last}.score AND NOT ({shorter} AND NOT (b[1].score >= 0.90 AND {last}.score < 0.80)) THEN list_concat(a[1:len(a) - 1], b) ELSE a END"""
    entry = "struct_pack(s := s, e := e, type := type, score := score, hit := hit)"
    return f"SELECT doc_id, any_value(text) AS text, list_reduce(list([{entry}] ORDER BY s, score DESC, seq), lambda a, b: {rule}) AS kept FROM ({inner}) GROUP BY doc_id"
