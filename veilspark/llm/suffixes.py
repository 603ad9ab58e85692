"""Suffix-array deduplication of bytes by bucket-pointer refinement."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import CODES, Scratch, batched, real_id
from veilspark.llm.repeats import Unit, covered, mask_of

#: Bytes of a repeat, of the grams that key a window, and of the first sort. Shorter grams recur by chance, the more
#: the larger the corpus is; results are the same whatever their length.
LENGTH, GRAM, FIRST = 100, 32, 8


def split_bytes(text: str) -> bytes:
    return text.encode("utf-8", "replace")


def hash_bytes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return CODES[data], np.diff(bounds)


def cut_bytes(raw: bytes, a: int, b: int) -> bytes:
    return raw[a:b]


BYTES = Unit(
    length=LENGTH,
    gram=GRAM,
    split=split_bytes,
    hashes=hash_bytes,
    cut=cut_bytes,
    inside=True,
    shard_bytes=1 << 20,
    key_units=1 << 20,
)


def buckets(text: np.ndarray, depth: int, room: np.ndarray | None = None) -> np.ndarray:
    """Bucket pointer of each position: equal for suffixes with equal first `depth` bytes, and in their order.

    The first sort puts suffixes into buckets of equal q-grams; a bucket's pointer is the place of
    its first suffix. A bucket of several suffixes is refined by sorting it on the pointers of the
    positions that follow at the depth reached so far. Pointers are updated in place, so that each
    round uses what the last one found and doubles the depth. Past the end stands the least pointer.
    room: bytes from each position to where comparisons end; a position isn't refined beyond it."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(FIRST, np.uint8)]).astype(np.uint64)
    grams = np.zeros(n, np.uint64)
    for k in range(FIRST):
        grams = (grams << np.uint64(8)) | padded[k : k + n]
    order = np.argsort(grams)
    pointer = np.empty(n + depth, np.int64)
    pointer[n:] = -1
    ranked = grams[order]
    head = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    pointer[order] = np.repeat(head, np.diff(np.append(head, n)))
    reached = FIRST
    active = np.arange(n)  # places of the order that are still refined
    while reached < depth:
        step = min(reached, depth - reached)
        if room is not None:
            active = active[room[order[active]] >= reached + step]
        own = pointer[order[active]]
        size = np.diff(np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(own)))
        active = active[np.repeat(size > 1, size)]
        if not len(active):
            break
        at = order[active]
        key = pointer[at] * (n + 1) + pointer[at + step] + 1
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[active] = at
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        pointer[at] = np.repeat(active[head], np.diff(np.append(head, len(at))))
        reached += step
    return pointer[:n]


def search(bodies: list[bytes], windows: np.ndarray, doc: np.ndarray, start: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each entry the ranges of bytes in windows of which an earlier place exists in the shard."""
    given = np.lexsort((start, doc))
    bodies, windows, doc, start = [bodies[k] for k in given], windows[given], doc[given], start[given]
    sizes = np.array([len(b) for b in bodies])
    ends = np.cumsum(sizes)
    pointer = buckets(np.frombuffer(b"".join(bodies), np.uint8), LENGTH, np.repeat(ends, sizes) - np.arange(ends[-1]))
    count = windows.astype(np.int64)
    entry = np.repeat(np.arange(len(bodies)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    bucket = pointer[(ends - sizes)[entry] + offset]
    # One row per window. The windows of a document are apart, so that rows stand in order of place,
    # but for those of several texts under one doc_id.
    when, at = doc[entry], start[entry] + offset
    row = np.arange(len(bucket))
    if ((when[1:] == when[:-1]) & (at[1:] < at[:-1])).any():
        row = np.lexsort((at, when))
    least = np.empty(len(pointer), np.int64)
    least[bucket[row[::-1]]] = row[::-1]  # what is written last, the first row of its bucket, stays
    least = least[bucket]
    hit = (when[least] < when) | (at[least] < at)
    found = ranges(hit, entry, offset, len(bodies), LENGTH)
    out: list[list[tuple[int, int]]] = [[] for _ in bodies]
    for k, spans in zip(given.tolist(), found):
        out[k] = spans
    return out


def ranges(hit: np.ndarray, entry: np.ndarray, offset: np.ndarray, entries: int, length: int) -> list[list[tuple[int, int]]]:
    """Ranges of units that the hit windows of each entry cover; windows stand in order of entry and offset."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(entries)]
    place = np.flatnonzero(hit)
    if len(place):
        new = np.append(True, (entry[place][1:] != entry[place][:-1]) | (offset[place][1:] - offset[place][:-1] > length))
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(place)) - 1
        for e, a, b in zip(entry[place[head]].tolist(), offset[place[head]].tolist(), (offset[place[tail]] + length).tolist()):
            out[e].append((a, b))
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every row.

    A byte goes if a 100-byte string that covers it also starts earlier: in a smaller doc_id (null
    is the smallest) or before it in the same document. Rows that repeat a doc_id with the same text
    are one document, so that neither is earlier; with other texts they are one document's
    versions, compared by their starts. Null and empty texts have no bytes; texts of under 100 bytes
    lose nothing; an empty table gives no rows; other columns are ignored."""
    rows, spans = covered(docs, BYTES, search, Scratch(docs.sparkSession, "suffixes"))
    schema = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def run(batches):
        def made():
            for batch in batches:
                for doc, text, spans in zip(batch.column("doc").to_pylist(), batch.column("text"), batch.column("spans")):
                    raw = text.as_py().encode("utf-8", "replace")
                    if not spans.is_valid:
                        yield doc, len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw
                        continue
                    gone = mask_of(len(raw), spans.as_py())
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    yield doc, len(raw), int(gone.sum()), int((np.diff(np.append(0, gone.astype(np.int8))) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept

        yield from batched(made(), schema, 1_000)

    out = rows.join(spans.hint("merge"), ["doc", "twin"], "left").select("doc", "text", "spans").mapInArrow(run, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.select(real_id().alias("doc_id"), *[F.col(c) for c in out.columns if c != "doc"])
