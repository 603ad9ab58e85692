"""Benchmark decontamination: edit distance through random-walk embeddings and bit-sampling."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import FOLDED, INVERSE, ODD, Scratch, batched, grams, keyed, mix, one_text, powers, real_id, text_blocks, trim, word_hashes

#: An item is found in a window of its own length within EDITS[0] / EDITS[1] of its words in edits.
EDITS = (1, 5)
#: Items with fewer words are too common to count.
LEAST_WORDS = 5
#: Independent walks, samples of each, and places of a sample.
WALKS, SAMPLES, PLACES = 2, 16, 3
#: Items and their words that a pass over the documents holds at once: what is broadcast is bounded by these.
PASS_ITEMS, PASS_WORDS = 20_000, 2_000_000
PAD = np.uint64(0)

#: Bytes that a word is compared by: digits, letters in either case and whatever isn't ASCII.
KEPT = np.zeros(256, bool)
KEPT[48:58] = KEPT[65:91] = KEPT[97:123] = KEPT[128:] = True


def plain_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words of texts in a row without their ASCII marks, and how many each text has; a word of marks alone stays."""
    return word_hashes(data, bounds, FOLDED, KEPT)


def tokens(text: str | None) -> np.ndarray:
    return plain_words(*one_text((text or "").encode("utf-8", "replace")))[0]


class Codes:
    """Numbers of the words of a pass's items, from 2 on; 1 is any other word, which no item holds, and 0 parts documents."""

    #: Bits of a first look, which spares most words the search.
    LOOK = 18

    def __init__(self, items: list[np.ndarray]):
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *items]))
        self.may = np.zeros(1 << self.LOOK, bool)
        self.may[self.known & np.uint64((1 << self.LOOK) - 1)] = True

    def of(self, hashed: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashed), np.uint64)
        at = np.flatnonzero(self.may[hashed & np.uint64((1 << self.LOOK) - 1)])
        place = np.minimum(np.searchsorted(self.known, hashed[at]), max(0, len(self.known) - 1))
        same = self.known[place] == hashed[at] if len(self.known) else np.zeros(0, bool)
        out[at[same]] = place[same].astype(np.uint64) + np.uint64(2)
        return out

    def array(self, text: str | None) -> np.ndarray:
        return self.of(tokens(text))

    def arrays(self, texts: pa.Array) -> list[np.ndarray]:
        out = []
        for data, bounds in text_blocks(texts):
            hashed, counts = plain_words(data, bounds)
            out += np.split(self.of(hashed), np.cumsum(counts)[:-1])
        return out


def edits_allowed(n: int) -> int:
    return n * EDITS[0] // EDITS[1]


def embed(text: np.ndarray, starts: np.ndarray, length: int, walk: int) -> np.ndarray:
    """The embedding of the windows of `length` symbols at `starts`: 3 * length places each.

    A pointer walks along each window; at every step the symbol under it is written, and a random
    bit of (step, symbol) moves the pointer on or not. Equal windows walk alike; after an edit two
    walks meet again, so windows within few edits differ in few places. Past the end stands PAD."""
    out = np.empty((3 * length, len(starts)), np.uint64)
    at = np.zeros(len(starts), np.int64)
    turn = np.random.default_rng([7, walk]).integers(0, 2**63, 3 * length, np.uint64) * np.uint64(2) + np.uint64(1)
    for step in range(3 * length):
        symbol = np.where(at < length, text[starts + np.minimum(at, length - 1)], PAD)
        out[step] = symbol
        # The top bit of a product with an odd number of this step.
        at += ((symbol * turn[step]) >> np.uint64(63)).astype(np.int64)
    return out


def samples(length: int, walk: int) -> np.ndarray:
    """Which places of an embedding each sample looks at."""
    return np.random.default_rng([length, walk]).integers(0, 3 * length, (SAMPLES, PLACES))


def signatures(text: np.ndarray, starts: np.ndarray, length: int, walk: int) -> np.ndarray:
    """SAMPLES keys of each window; equal where the sampled places are."""
    embedded = embed(text, starts, length, walk)
    out = np.empty((SAMPLES, len(starts)), np.uint64)
    for k, places in enumerate(samples(length, walk)):
        key = np.full(len(starts), k + 1, np.uint64)
        for p in places:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + embedded[p])
        out[k] = key
    return out


def edit_distances(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Levenshtein distance of each row of a and the same row of b, or most + 1 where it is larger.

    All pairs go through the rows of their tables together; only the band of width most is filled,
    and pairs that are beyond it already leave."""
    count, n = a.shape
    m = b.shape[1]
    out = np.full(count, most + 1)
    if abs(n - m) > most:
        return out
    offsets = np.arange(-most, most + 1, dtype=np.int16)
    row = np.tile(np.where((offsets >= 0) & (offsets <= m), offsets, most + 1).astype(np.int16), (count, 1))
    live = np.arange(count)
    for i in range(1, n + 1):
        at = i + offsets
        inside = (at >= 1) & (at <= m)
        best = row + np.int16(1)
        best[:, inside] -= b[:, at[inside] - 1] == a[:, i - 1 : i]
        best[:, :-1] = np.minimum(best[:, :-1], row[:, 1:] + np.int16(1))
        best[:, ~((at >= 0) & (at <= m))] = most + 1
        best[:, at == 0] = i
        # Insertions within the row: the least of best[j] + distance to the right.
        row = np.minimum(np.minimum.accumulate(best - offsets, axis=1) + offsets, np.int16(most + 1))
        if i % 4 == 0 and len(live):
            near = row.min(1) <= most
            if not near.all():
                a, b, row, live = a[near], b[near], row[near], live[near]
    out[live] = row[:, m - n + most]
    return out


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    return int(edit_distances(np.asarray(a)[None, :], np.asarray(b)[None, :], most)[0])


@dataclass
class Index:
    """What one pass looks for: texts of items by length, with the sampled keys of each."""

    #: The item_id of each text.
    names: list[int]
    codes: Codes
    items: dict[int, np.ndarray]
    #: For each length the numbers of its texts and, row by row, their words.
    by_length: dict[int, tuple[np.ndarray, np.ndarray]]
    grams: dict[int, np.ndarray]
    keys: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]
    lengths: list[int]

    #: Windows whose embeddings are held at once, and pairs that are verified at once; words whose q-grams are.
    BLOCK, PART = 8_192, 1 << 16

    @classmethod
    def build(cls, found: list[tuple[int, np.ndarray]]) -> Index:
        """found: item_id and hashed words; an item_id may have several texts."""
        codes = Codes([words for _, words in found])
        items = [(k, codes.of(words)) for k, (_, words) in enumerate(found)]
        of = dict(items)
        seen = {q: np.unique(np.concatenate([grams(x, q) for _, x in items])) for q in (2, 3)}
        keys, by_length, lengths = {}, {}, sorted({len(x) for _, x in items})
        for length in lengths:
            ids = np.array([i for i, x in items if len(x) == length])
            text = np.concatenate([of[i] for i in ids])
            starts = np.arange(len(ids)) * length
            for walk in range(WALKS):
                flat, owner = signatures(text, starts, length, walk).ravel(), np.tile(np.arange(len(ids)), SAMPLES)
                order = np.argsort(flat, kind="stable")
                keys[length, walk] = flat[order], owner[order]
            by_length[length] = ids, text.reshape(len(ids), length)
        return cls([i for i, _ in found], codes, of, by_length, seen, keys, lengths)

    def windows(self, text: np.ndarray):
        """(length, starts) of windows with enough pairs and triples of neighbouring words that some item has.

        k edits break at most 2 k of a window's pairs and 3 k of its triples, so no window within the
        allowed edits is left out. No window runs over a 0, which parts documents."""
        if len(text) < LEAST_WORDS:
            return
        totals = {}
        for q, known in self.grams.items():
            own = grams(text, q)
            hit = np.zeros(len(own), bool)
            if len(known):
                # A first look by the low bits spares most of the searches.
                first = np.zeros(1 << 18, bool)
                first[known & np.uint64((1 << 18) - 1)] = True
                may = np.flatnonzero(first[own & np.uint64((1 << 18) - 1)])
                hit[may] = known[np.minimum(np.searchsorted(known, own[may]), len(known) - 1)] == own[may]
            totals[q] = np.concatenate([np.zeros(1, np.int32), np.cumsum(hit, dtype=np.int32)])
        parted = np.concatenate([np.zeros(1, np.int32), np.cumsum(text == 0, dtype=np.int32)])
        for length in self.lengths:
            if length > len(text):
                break
            many, most = len(text) - length + 1, edits_allowed(length)
            starts = None
            for q, total in sorted(totals.items(), reverse=True):  # the rarer first; the others only where it holds
                need = length - q + 1 - q * most
                if starts is None:
                    starts = np.flatnonzero(total[length - q + 1 : length - q + 1 + many] - total[:many] >= need)
                else:
                    starts = starts[total[starts + length - q + 1] - total[starts] >= need]
            starts = starts[parted[starts + length] == parted[starts]]
            if len(starts):
                yield length, starts

    def all_windows(self, text: np.ndarray):
        """windows() of documents in a row, looked for in parts that end where a document does; each length once."""
        found: dict[int, list[np.ndarray]] = {}
        ends, begin = np.flatnonzero(text == 0) + 1, 0
        while begin < len(text):
            end = int(ends[min(np.searchsorted(ends, begin + self.PART), len(ends) - 1)])
            for length, starts in self.windows(text[begin:end]):
                found.setdefault(length, []).append(starts + begin)
            begin = end
        for length in sorted(found):
            yield length, np.concatenate(found[length])

    def meetings(self, text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of by_length, place in starts) of items and windows that share a sampled key, each once."""
        out = []
        for walk in range(WALKS):
            known, owner = self.keys[length, walk]
            wanted = signatures(text, starts, length, walk)
            low, high = np.searchsorted(known, wanted, "left"), np.searchsorted(known, wanted, "right")
            size = (high - low).ravel()
            if size.any():
                first = np.repeat(low.ravel() - np.cumsum(size) + size, size)
                window = np.repeat(np.tile(np.arange(len(starts)), SAMPLES), size)
                out.append(owner[first + np.arange(size.sum())] * len(starts) + window)
        pairs = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
        return pairs // len(starts), pairs % len(starts)

    def search(self, texts: list[np.ndarray]) -> list[dict[int, tuple[int, int, int]]]:
        """For each document, item_id: (least distance, first word and length of such a window) of every item found in it."""
        found: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        if not texts:
            return found
        text = np.concatenate([part for x in texts for part in (x, np.zeros(1, np.uint64))])
        begin = np.cumsum([0] + [len(x) + 1 for x in texts[:-1]])
        odd, inverse = powers(ODD, len(text)), powers(INVERSE, len(text))
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(text * odd)])
        for length, windows in self.all_windows(text):
            most, span = edits_allowed(length), np.arange(length)
            # Equal windows, as monotonous texts are full of, are looked at once.
            _, first, like = np.unique((prefix[windows + length] - prefix[windows]) * inverse[windows], return_index=True, return_inverse=True)
            order = np.argsort(like, kind="stable")
            bounds = np.searchsorted(like[order], np.arange(len(first) + 1))
            for at in range(0, len(first), self.BLOCK):
                starts = windows[first[at : at + self.BLOCK]]
                rows, place = self.meetings(text, starts, length)
                for k in range(0, len(rows), self.BLOCK):
                    row, same = rows[k : k + self.BLOCK], place[k : k + self.BLOCK]
                    where = starts[same]
                    distance = edit_distances(self.by_length[length][1][row], text[where[:, None] + span], most)
                    for hit in np.flatnonzero(distance <= most):
                        item, group = self.names[self.by_length[length][0][row[hit]]], at + int(same[hit])
                        for start in windows[order[bounds[group] : bounds[group + 1]]].tolist():
                            doc = int(np.searchsorted(begin, start, "right")) - 1
                            new = int(distance[hit]), start - int(begin[doc]), length
                            found[doc][item] = min(found[doc].get(item, new), new)
        return found


def passes(benchmark: DataFrame):
    """Items in groups of bounded size, in order of item_id; the driver holds one group at a time. The texts of an item are in one group."""
    held, size, last = [], 0, None
    chosen = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    for row in chosen.orderBy("item_id", "text").toLocalIterator():
        words = tokens(row.text)
        if len(words) < LEAST_WORDS:
            continue
        if held and row.item_id != last and (len(held) >= PASS_ITEMS or size + len(words) > PASS_WORDS):
            yield Index.build(held)
            held, size = [], 0
        held.append((row.item_id, words))
        size, last = size + len(words), row.item_id
    if held:
        yield Index.build(held)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance, start and n_words (of the window) of every item found in a document.

    Words are lower-cased and freed of ASCII marks. An item counts as found where a window of as
    many words as it has is within a fifth of them in word edits. Windows are compared through WALKS
    embeddings with SAMPLES samples of PLACES places: at an embedded distance of one half a pair
    meets with probability 1 - (1 - 2^-3)^32 > 0.98; equal windows always meet. Every meeting is
    verified. Where several windows match, the closest and then the first counts.

    A benchmark of more than PASS_ITEMS items or PASS_WORDS words is searched in several passes, each
    a job of its own, so that executors hold one index at a time. Null and empty texts hold nothing;
    items without id, text or LEAST_WORDS words are never found; of several texts of an item the
    closest, then the first found counts; a null doc_id stays null; repeated rows are reported as
    often as they occur; without documents or items there are no rows; other columns are ignored."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    rows = keyed(docs).select("doc", "text")
    schema = pa.schema([("doc", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("n_words", pa.int32())])
    made = []
    for index in passes(benchmark):
        if made:
            made[-1] = scratch.save(made[-1], f"pass-{len(made)}")
            known.unpersist()
        known = spark.sparkContext.broadcast(index)

        def run(batches, known=known):
            def found():
                for batch in batches:
                    texts = known.value.codes.arrays(batch.column("text"))
                    for doc, hits in zip(batch.column("doc").to_pylist(), known.value.search(texts)):
                        for item, (distance, start, length) in sorted(hits.items()):
                            yield doc, item, distance, start, length
                    trim()

            yield from batched(found(), schema)

        made.append(rows.mapInArrow(run, "doc long, item_id long, distance int, start long, n_words int"))
    if not made:
        return spark.createDataFrame([], "doc_id long, item_id long, distance int, start long, n_words int")
    out = reduce(DataFrame.unionByName, made)
    return out.select(real_id().alias("doc_id"), "item_id", "distance", "start", "n_words")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no item is found, with all their columns; one scan a pass, nothing is joined.

    As contaminated() in every case; null and empty texts stay."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    known = None
    for turn, index in enumerate(passes(benchmark)):
        if known is not None:
            docs = scratch.save(docs, f"pass-{turn}")
            known.unpersist()
        known = spark.sparkContext.broadcast(index)

        def run(batches, known=known):
            for batch in batches:
                hits = known.value.search(known.value.codes.arrays(batch.column("text").cast(pa.string())))
                yield batch.filter(pa.array([not x for x in hits], pa.bool_()))
                trim()

        docs = docs.mapInArrow(run, docs.schema)
    return docs
