"""Substring deduplication by matching statistics over compressed FM-indexes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import Scratch, batched, real_id, word_hashes
from veilspark.llm.repeats import Unit, covered, mask_of

#: Words of a repeat and of the grams that key a window.
LENGTH, GRAM = 50, 8


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").split()


def cut_words(words: list[bytes], a: int, b: int) -> bytes:
    return b" ".join(words[a:b])


WORDS = Unit(
    length=LENGTH,
    gram=GRAM,
    split=split_words,
    hashes=word_hashes,
    cut=cut_words,
    inside=False,
    shard_bytes=1 << 20,
    key_units=1 << 17,
)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order, step = np.argsort(rank, kind="stable"), 1
    while step < n:
        later = np.full(n, -1, np.int64)
        later[: n - step] = rank[step:]
        key = rank * (n + 1) + later + 1
        order = np.argsort(key, kind="stable")
        new = np.append(0, np.cumsum(key[order][1:] != key[order][:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        step *= 2
    return order


class WaveletTree:
    """Ranks of symbols in a sequence, one bit a level and symbol: levels split the symbols by their
    bits from the top, zeros before ones. Words of 64 bits with their counts before them answer ranks."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = ((sequence >> level) & 1).astype(np.uint8)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)]).view(np.uint64)
            ones = np.bitwise_count(packed).astype(np.int64)
            self.bits.append(packed)
            self.before.append(np.cumsum(ones) - ones)
            self.zeros.append(int(len(bit) - bit.sum()))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])
        # Where each symbol's run begins below the last level.
        self.origin = self.walk(np.arange(symbols), np.zeros(symbols, np.int64))

    def walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.before[k][word] + np.bitwise_count(self.bits[k][word] & below)
            at = np.where((symbol >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        return self.walk(symbol, at) - self.origin[symbol]


class FMIndex:
    """Backward search over a text of integers from 1 on; a value for each suffix gives the least of any range."""

    def __init__(self, text: np.ndarray, value: np.ndarray, symbols: int):
        order = suffix_array(text)
        self.tree = WaveletTree(text[order - 1], symbols)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.n = len(text)
        self.least = [value[order]]
        while 2 ** len(self.least) <= self.n:
            have, half = self.least[-1], 2 ** (len(self.least) - 1)
            self.least.append(np.append(np.minimum(have[:-half], have[half:]), have[len(have) - half :]))
        self.least = np.stack(self.least)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges of symbol + pattern."""
        both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.tile(self.smaller[symbol], 2)
        return both[: len(symbol)], both[len(symbol) :]

    def minimum(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least value in each range that isn't empty."""
        level = np.frexp((high - low).astype(float))[1] - 1
        return np.minimum(self.least[level, low], self.least[level, high - (1 << level)])


def search(bodies: list[bytes], windows: np.ndarray, doc: np.ndarray, start: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each entry the ranges of words in windows that also stand in an entry of a smaller document.

    All entries are matched at once, one backward step each a round, against the index of them all.
    A match counts as long as some suffix of its range belongs to a smaller document, which only
    ends with growing length. From an end e, a match that stops after j < length words rules out every
    window that holds those j + 1 words, so the next end is e - j + length. After a full match
    the farthest end that may still join it is tried first and then nearer ones; what lies between
    two ends no farther apart than a window is covered by both."""
    names: dict[bytes, int] = {}
    split = [[names.setdefault(w, len(names) + 1) for w in b.split(b" ")] for b in bodies]
    sizes = np.array([len(x) for x in split])
    # Each entry ends with the separator 0, which no pattern holds.
    first = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int((sizes + 1).sum()), np.int64)
    for at, x in zip(first, split):
        text[at : at + len(x)] = x
    ranked = np.unique(doc, return_inverse=True)[1]
    fm = FMIndex(text, np.repeat(ranked, sizes + 1).astype(np.int32), len(names) + 1)

    out: list[list[tuple[int, int]]] = [[] for _ in bodies]
    n = len(bodies)
    end, matched = np.full(n, LENGTH), np.zeros(n, np.int64)
    low, high = np.zeros(n, np.int64), np.full(n, fm.n)
    joined, near = np.zeros(n, np.int64), np.zeros(n, bool)  # end of the last match; whether ends near it are tried
    live = np.flatnonzero(sizes >= LENGTH)
    while len(live):
        a, b = fm.extend(text[first[live] + end[live] - matched[live] - 1], low[live], high[live])
        good = a < b
        good[good] = fm.minimum(a[good], b[good]) < ranked[live[good]]
        low[live], high[live] = a, b
        matched[live[good]] += 1
        full, failed = live[good & (matched[live] == LENGTH)], live[~good]
        for k in full:
            out[k].append((int(end[k]) - LENGTH, int(end[k])))
        joined[full] = end[full]
        near[full] = True
        end[full] = np.minimum(joined[full] + LENGTH, sizes[full])
        done = np.zeros(n, bool)
        done[full[end[full] == joined[full]]] = True
        close, far = failed[near[failed]], failed[~near[failed]]
        end[close] -= 1
        over = close[end[close] == joined[close]]
        near[over] = False
        end[over] = joined[over] + LENGTH + 1
        end[far] += LENGTH - matched[far]
        again = np.concatenate([full, failed])
        matched[again], low[again], high[again] = 0, 0, fm.n
        done[again[end[again] > sizes[again]]] = True
        live = live[~done[live]]
    return [merged(x) for x in out]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the remaining words) of every row.

    A word goes if a window of 50 words that covers it also starts in a document of a smaller
    doc_id (null is the smallest). Rows that repeat a doc_id never take from one another. Null and
    empty texts have no words; texts of under 50 words lose nothing; an empty table gives no rows;
    other columns are ignored."""
    rows, spans = covered(docs, WORDS, search, Scratch(docs.sparkSession, "fmindex"))
    schema = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def run(batches):
        def made():
            for batch in batches:
                for doc, text, spans in zip(batch.column("doc").to_pylist(), batch.column("text"), batch.column("spans")):
                    words = WORDS.split(text.as_py())
                    n, kept = len(words), words
                    if spans.is_valid:
                        gone = mask_of(n, spans.as_py())
                        kept = [w for w, g in zip(words, gone.tolist()) if not g]
                    raw = b" ".join(kept)
                    yield doc, n, n - len(kept), hashlib.sha256(raw).hexdigest(), raw.decode()

        yield from batched(made(), schema, 1_000)

    out = rows.join(spans.hint("merge"), ["doc", "twin"], "left").select("doc", "text", "spans").mapInArrow(run, "doc long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out.select(real_id().alias("doc_id"), *[F.col(c) for c in out.columns if c != "doc"])
