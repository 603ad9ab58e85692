"""Repeated passages across a corpus: what the FM-index and the suffix-array operators share.

A window is `length` consecutive units (words or bytes) of one document. Its key is the least hash
of the `gram`-unit grams inside it, so equal windows have equal keys wherever they stand.
Consecutive windows of one key form a piece. Only pieces whose key occurs again can hold a repeat;
of those, equal pieces are one entry with its first place, and entries are dealt by key to shards.
A shard never meets a window that is also in another shard, so each is indexed on its own.

A key that would fill a shard is split: its windows are cut into classes by where in them the gram
begins, and the new key is a hash of the units that all windows of such a place have in common, which are
the more the narrower the classes are, up to the whole window. Equal windows stay together.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import INVERSE, ODD, Scratch, batched, keyed, mix, one_text, powers, text_blocks, unique_ids

#: Pieces are cut after so many windows of one key, so that monotonous text makes no unbounded piece.
LONGEST = 400
#: Classes that a class of places is cut into where its key is too frequent.
SPLIT = 4


@dataclass(frozen=True)
class Unit:
    """split: units of a text as bytes; hashes: of the units of texts in a row, and how many each has; cut: content of a range of units."""

    length: int
    gram: int
    split: Callable[[str], object]
    hashes: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    cut: Callable[[object, int, int], bytes]
    #: Whether a repeat within one document counts.
    inside: bool
    #: Target content of a shard in bytes.
    shard_bytes: int
    #: Units of one key's entries beyond which it is split.
    key_units: int


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each run of `width` values, by doubling."""
    out, have = x, 1
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    if have < width:
        rest = width - have
        out = pick(out[: len(out) - rest], out[rest:])
    return out


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n-grams, by doubling over powers of two and one overlap."""
    have, out = 1, h
    while have * 2 <= n:
        out = mix(out[:-have] * np.uint64(ODD) + out[have:])
        have *= 2
    if have < n:
        rest = n - have
        out = mix(out[: len(out) - rest] * np.uint64(ODD) + out[rest:])
    return out


def pieces(hashes: np.ndarray, sizes: np.ndarray, length: int, gram: int, inside: bool):
    """(key, owner, start, windows, content hash, again) of the pieces of several documents whose unit hashes stand in a row.

    again: the key's gram may stand at two places of the piece, so that its own windows may repeat
    (never missed where it is so; looked for only if `inside`)."""
    total, width = len(hashes), length - gram + 1
    if total < length:
        return None
    grams = gram_hashes(hashes, gram)
    low = sliding(grams, width, np.minimum)  # of each window
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(low)]
    valid = np.arange(len(low)) + length <= ends[owner]
    change = np.ones(len(low), bool)
    change[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])
    start = np.flatnonzero(change)
    count = np.diff(np.append(start, len(low)))
    keep = valid[start]
    start, count = start[keep], count[keep]
    if count.max(initial=0) > LONGEST:
        parts = -(-count // LONGEST)
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, count = np.repeat(start, parts) + inner * LONGEST, np.minimum(LONGEST, np.repeat(count, parts) - inner * LONGEST)
    key, who = low[start], owner[start]
    prefix = np.zeros(total + 1, np.uint64)
    np.cumsum(hashes * powers(ODD, total), out=prefix[1:])
    content = mix((prefix[start + count - 1 + length] - prefix[start]) * powers(INVERSE, total)[start])
    again = np.zeros(len(key), bool)
    if inside:
        edge = np.zeros(width - 1, np.uint64)
        chosen = np.flatnonzero(grams == sliding(np.concatenate([edge, low, edge]), width, np.maximum))
        chosen = chosen[np.lexsort((chosen, grams[chosen]))]
        near = (grams[chosen[1:]] == grams[chosen[:-1]]) & (chosen[1:] - chosen[:-1] < width + LONGEST)
        if near.any():
            again = np.isin(key, grams[chosen[1:]][near])
    return key, who, start - (ends - sizes)[who], count, content, again


def fingerprints(rows: DataFrame, unit: Unit, block: int = 1 << 18) -> DataFrame:
    """Every piece: key, doc, twin, start, windows, content, again. Texts are looked at by blocks of about so many bytes."""
    schema = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("twin", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("content", pa.int64()), ("again", pa.bool_())])

    def run(batches):
        for batch in batches:
            docs, twins, first = batch.column("doc").to_numpy(), batch.column("twin").to_numpy(), 0
            for data, bounds in text_blocks(batch.column("text"), block):
                hashes, sizes = unit.hashes(data, bounds)
                found = pieces(hashes, sizes, unit.length, unit.gram, unit.inside)
                if found is not None:
                    key, who, start, count, content, again = found
                    who = who + first
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), docs[who], twins[who], start.astype(np.int64), count.astype(np.int32), content.view(np.int64), again)], schema=schema)
                first += len(sizes)

    return rows.select("doc", "twin", "text").mapInArrow(run, "key long, doc long, twin long, start long, windows int, content long, again boolean")


def contents(texts: DataFrame, entries: DataFrame, unit: Unit) -> DataFrame:
    """Entries with the bytes of their first place. A document's entries are bounded by its own length."""
    wanted = entries.groupBy("doc", "twin").agg(F.collect_list(F.struct("key", "content", "windows", "start")).alias("wanted"))
    schema = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("windows", pa.int32()), ("doc", pa.int64()), ("start", pa.int64()), ("body", pa.binary())])

    def run(batches):
        def rows():
            for batch in batches:
                for doc, text, wanted in zip(batch.column("doc").to_pylist(), batch.column("text"), batch.column("wanted")):
                    split = unit.split(text.as_py())
                    for x in wanted.as_py():
                        yield x["key"], x["content"], x["windows"], doc, x["start"], unit.cut(split, x["start"], x["start"] + x["windows"] - 1 + unit.length)

        yield from batched(rows(), schema, 5_000)

    return texts.join(wanted.hint("merge"), ["doc", "twin"]).select("doc", "text", "wanted").mapInArrow(run, "key long, content long, windows int, doc long, start long, body binary")


def classes(hashes: np.ndarray, start: int, windows: int, unit: Unit, step: int):
    """(first window, windows, key, content hash) of the parts of a piece: its windows by where in them
    their gram first begins, in classes of `step` places. Units that all windows of such a place share make the key."""
    length, width = unit.length, unit.length - unit.gram + 1
    hashes = hashes[start : start + windows - 1 + length]
    total = len(hashes)
    grams = gram_hashes(hashes, unit.gram)
    first = np.arange(windows)
    place = np.flatnonzero(grams == grams[:width].min())
    at = place[np.searchsorted(place, first)]
    kind = (at - first) // step
    head = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (kind[1:] != kind[:-1])))
    count = np.diff(np.append(head, windows))
    low = kind[head] * step
    a = at[head] - low
    b = at[head] - np.minimum(low + step, width) + 1 + length
    prefix, back = np.zeros(total + 1, np.uint64), powers(INVERSE, total)
    np.cumsum(hashes * powers(ODD, total), out=prefix[1:])
    content = mix((prefix[head + count - 1 + length] - prefix[head]) * back[head])
    key = mix(mix((prefix[b] - prefix[a]) * back[a]) + (kind[head] * width + step).astype(np.uint64))
    return head, count, key, content


def cut_entries(texts: DataFrame, entries: DataFrame, unit: Unit, step: int) -> DataFrame:
    """The parts of each entry, by its first place: key, content, windows, and first, count, part_key, part_content."""
    wanted = entries.groupBy("doc", "twin").agg(F.collect_list(F.struct("key", "content", "windows", "start")).alias("wanted"))
    kinds = {"key": pa.int64(), "content": pa.int64(), "windows": pa.int32(), "first": pa.int64(), "count": pa.int32(), "part_key": pa.int64(), "part_content": pa.int64()}

    def run(batches):
        def rows():
            for batch in batches:
                for text, wanted in zip(batch.column("text"), batch.column("wanted")):
                    hashes, _ = unit.hashes(*one_text(text.as_py().encode("utf-8", "replace")))
                    for x in wanted.as_py():
                        head, count, key, content = classes(hashes, x["start"], x["windows"], unit, step)
                        for part in zip(head.tolist(), count.tolist(), key.view(np.int64).tolist(), content.view(np.int64).tolist()):
                            yield x["key"], x["content"], x["windows"], *part

        yield from batched(rows(), pa.schema(list(kinds.items())), 5_000)

    return texts.join(wanted.hint("merge"), ["doc", "twin"]).select("text", "wanted").mapInArrow(run, "key long, content long, windows int, first long, count int, part_key long, part_content long")


def entries_of(places: DataFrame) -> DataFrame:
    entries = places.groupBy("key", "content", "windows").agg(F.min(F.struct("doc", "start", "twin")).alias("first"))
    return entries.select("key", "content", "windows", "first.doc", "first.start", "first.twin")


def split_keys(texts: DataFrame, places: DataFrame, entries: DataFrame, unit: Unit, apart, scratch: Scratch) -> tuple[DataFrame, DataFrame, list[str]]:
    """Places and entries with every key of more than unit.key_units split, in narrower classes each time; at last in
    single windows, of which equal ones are one entry. Parts whose key doesn't occur again go. With the names of the tables written."""
    settled_places = settled_entries = None
    names = []
    step = unit.length - unit.gram + 1
    while step > 1:
        step = -(-step // SPLIT)
        often = F.sum(F.col("windows") - 1 + unit.length) > unit.key_units
        hot = scratch.save(entries.groupBy("key").agg(often.alias("often")).where("often").select("key"), f"hot-{step}")
        names.append(f"hot-{step}")
        if hot.isEmpty():
            break
        cut = scratch.save(cut_entries(texts, entries.join(hot, "key"), unit, step), f"cut-{step}")
        parts = places.join(hot, "key").join(cut, ["key", "content", "windows"]).select(F.col("part_key").alias("key"), "doc", "twin", (F.col("start") + F.col("first")).alias("start"), F.col("count").alias("windows"), F.col("part_content").alias("content"))
        parts = scratch.save(parts, f"parts-{step}")
        again = parts.groupBy("key").agg(apart.alias("apart")).where("apart").select("key")
        rest_places, rest_entries = places.join(hot, "key", "left_anti"), entries.join(hot, "key", "left_anti")
        settled_places = rest_places if settled_places is None else settled_places.unionByName(rest_places)
        settled_entries = rest_entries if settled_entries is None else settled_entries.unionByName(rest_entries)
        places = scratch.save(parts.join(again, "key"), f"places-{step}")
        scratch.drop(f"cut-{step}", f"parts-{step}")
        entries = scratch.save(entries_of(places), f"entries-{step}")
        names += [f"places-{step}", f"entries-{step}"]
    if settled_places is None:
        return places, entries, names
    return settled_places.unionByName(places), settled_entries.unionByName(entries), names


def covered(docs: DataFrame, unit: Unit, search: Callable, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows of docs as doc, twin, text, and (doc, twin, spans): the covered ranges of units of each document that has any.

    search(entries) gets one shard's entries as (body, windows, doc, start) lists and returns for
    each the ranges of units that are covered by a window that also starts earlier than its entry."""
    unique = unique_ids(docs)
    rows = keyed(docs, unique=unique)
    found = fingerprints(rows, unit)
    found = scratch.save(found, "pieces")
    apart = F.count("*") > 1 if unit.inside else F.min("doc") < F.max("doc")
    shared = found.groupBy("key").agg(apart.alias("apart"), F.max("again").alias("again")).where("apart OR again").select("key")
    places = scratch.save(found.drop("again").join(shared, "key"), "places")
    scratch.drop("pieces")
    entries = scratch.save(entries_of(places), "entries")
    texts = rows if unique else rows.dropDuplicates(["doc", "twin"])
    places, entries, split = split_keys(texts, places, entries, unit, apart, scratch)
    bodies = scratch.save(contents(texts, entries, unit), "bodies")
    total = bodies.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    shards = max(1, total // unit.shard_bytes)

    schema = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("windows", pa.int32()), ("doc", pa.int64()), ("start", pa.int64()), ("ranges", pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))])

    def index(data):
        column = {n: data.column(n).to_numpy() for n in ("key", "content", "windows", "doc", "start")}
        ranges = search(data.column("body").to_pylist(), column["windows"], column["doc"], column["start"])
        return pa.Table.from_arrays([*[pa.array(column[n]).cast(schema.field(n).type) for n in ("key", "content", "windows", "doc", "start")], pa.array([[{"from": a, "to": b} for a, b in x] for x in ranges], schema.field("ranges").type)], schema=schema)

    # So many tasks whatever the bytes: searching takes far longer than reading.
    tasks = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = bodies.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).repartition(tasks, "shard")
    judged = dealt.groupBy("shard").applyInArrow(index, "key long, content long, windows int, doc long, start long, ranges array<struct<from:int,to:int>>")
    judged = scratch.save(judged.withColumnsRenamed({"doc": "first_doc", "start": "first_start"}), "judged")
    scratch.drop("bodies", "entries")
    later = F.col("doc") > F.col("first_doc")
    if unit.inside:
        later |= (F.col("doc") == F.col("first_doc")) & (F.col("start") > F.col("first_start"))
    whole = F.array(F.struct(F.lit(0).alias("from"), (F.col("windows") - 1 + unit.length).cast("int").alias("to")))
    spans = places.join(judged, ["key", "content", "windows"]).select("doc", "twin", "start", F.explode(F.when(later, whole).otherwise(F.col("ranges"))).alias("r"))
    spans = spans.select("doc", "twin", (F.col("start") + F.col("r.from")).alias("a"), (F.col("start") + F.col("r.to")).alias("b")).distinct()
    spans = scratch.save(spans.groupBy("doc", "twin").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "spans")
    scratch.drop("places", "judged", *split)
    return rows, spans


def mask_of(size: int, spans) -> np.ndarray:
    """Which of `size` units a document's spans cover."""
    edge = np.zeros(size + 1, np.int32)
    if spans:
        a = np.array([s["a"] for s in spans])
        b = np.array([s["b"] for s in spans])
        np.add.at(edge, a, 1)
        np.add.at(edge, b, -1)
    return np.cumsum(edge)[:size] > 0
