"""Quality classifier: a factorisation machine over hashed words, structure and size."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import FOLDED, batched, one_text, small_batches, trim, using, word_hashes

#: Numbers of hash buckets for words, of structure features and of latent factors.
BUCKETS, STATS, FACTORS = 1 << 15, 18, 6
#: At most so many labelled documents are learnt from: those with the smallest hashes of doc_id.
SAMPLE = 6_000
THRESHOLD = 0.3

_ends = re.compile(r"[.!?]")


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of a document's features. The first STATS are structure and size, the rest hashed words."""
    raw = text.encode("utf-8", "replace")
    hashed, _ = word_hashes(*one_text(raw), FOLDED)
    lines = text.split("\n")
    n, size = len(hashed), max(1, len(text))
    codes = np.frombuffer(raw, np.uint8)
    upper = np.count_nonzero((codes >= 65) & (codes <= 90))
    lower = np.count_nonzero((codes >= 97) & (codes <= 122))
    digit = np.count_nonzero((codes >= 48) & (codes <= 57))
    wide = np.count_nonzero(codes >= 128)
    space = np.count_nonzero((codes <= 32))
    total = max(1, len(codes))
    marks = total - upper - lower - digit - wide - space
    sentence = len(_ends.findall(text))
    distinct, counts = np.unique(hashed, return_counts=True)
    values = np.zeros(STATS)
    values[:] = [
        1.0,
        math.log1p(len(text)) / 10,
        math.log1p(n) / 8,
        upper / total * 4,
        digit / total * 8,
        marks / total * 8,
        wide / total * 4,
        space / total * 4,
        upper / max(1, upper + lower) * 2,
        marks / max(1, n),
        sentence / max(1, n) * 4,
        len(distinct) / max(1, n),
        (counts.max() / n if n else 0) * 4,
        len(set(lines)) / len(lines),
        math.log1p(size / len(lines)) / 8,
        size / max(1, n) / 10,
        text.count("!") / max(1, n),
        1.0 if not n else 0.0,
    ]
    buckets = (distinct % np.uint64(BUCKETS)).astype(np.int64) + STATS
    weights = np.sqrt(counts)
    norm = math.sqrt(float((weights**2).sum())) or 1.0
    return np.concatenate([np.arange(STATS), buckets]), np.concatenate([np.clip(values, 0, 4), weights / norm])


@dataclass
class Machine:
    """bias + w.x + sum over factors of ((V.x)^2 - (V^2).(x^2)) / 2: the pairwise interactions in linear time."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, at: np.ndarray, x: np.ndarray) -> float:
        rows = self.v[at] * x[:, None]
        both = rows.sum(0)
        return float(self.bias + self.w[at] @ x + 0.5 * (both @ both - (rows * rows).sum()))

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.margin(*features(text or ""))))))


def fit(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, rate: float = 0.1, decay: float = 2e-5, batch: int = 64) -> Machine:
    """Adagrad on the logistic loss, in a fixed order of batches drawn from a fixed seed."""
    random = np.random.default_rng(7)
    size = BUCKETS + STATS
    w, v, bias = np.zeros(size), random.normal(0, 0.02, (size, FACTORS)), 0.0
    gw, gv, gb = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6), 1e-6
    for _ in range(epochs if len(examples) else 0):
        order = random.permutation(len(examples))
        for chosen in np.array_split(order, max(1, len(order) // batch)):
            at = np.concatenate([examples[k][0] for k in chosen])
            x = np.concatenate([examples[k][1] for k in chosen])
            cuts = np.cumsum([0] + [len(examples[k][0]) for k in chosen[:-1]])
            owner = np.repeat(np.arange(len(chosen)), [len(examples[k][0]) for k in chosen])
            rows = v[at] * x[:, None]
            both = np.add.reduceat(rows, cuts)
            margin = bias + np.add.reduceat(w[at] * x, cuts) + 0.5 * ((both**2).sum(1) - np.add.reduceat((rows * rows).sum(1), cuts))
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[chosen]) / len(chosen)
            each = error[owner] * x
            used, place = np.unique(at, return_inverse=True)
            dw = np.bincount(place, each, len(used)) + decay * w[used]
            inner = each[:, None] * (both[owner] - rows)
            dv = np.stack([np.bincount(place, inner[:, f], len(used)) for f in range(FACTORS)], 1) + decay * v[used]
            db = float(error.sum())
            gw[used] += dw**2
            gv[used] += dv**2
            gb += db**2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * dv / np.sqrt(gv[used])
            bias -= rate * db / math.sqrt(gb)
    return Machine(bias, w, v)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Learns from at most `sample` documents whose labels aren't held out; where a document's labels differ, the best counts."""
    small_batches(docs.sparkSession)
    usable = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out())
    chosen = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def extract(batches):
        using()

        def rows():
            for batch in batches:
                for text, quality in zip(batch.column("text"), batch.column("quality").to_pylist()):
                    at, x = features(text.as_py() or "")
                    yield at.astype("<i4").tobytes(), x.astype("<f4").tobytes(), quality

        yield from batched(rows(), pa.schema([("at", pa.binary()), ("x", pa.binary()), ("quality", pa.int32())]), 500)

    # At most `sample` rows of two numbers: broadcast, so that no text is moved for the join.
    once = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = once.join(F.broadcast(chosen), "doc_id").select("text", "quality").mapInArrow(extract, "at binary, x binary, quality int")
    rows = sorted((bytes(r.at), bytes(r.x), r.quality) for r in found.limit(2 * sample).collect())
    examples = [(np.frombuffer(at, "<i4").astype(np.int64), np.frombuffer(x, "<f4").astype(float)) for at, x, _ in rows]
    return fit(examples, np.array([q for *_, q in rows], float))


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted added."""
    known = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        using()
        for batch in batches:
            scores = np.array([known.value.score(x.as_py()) for x in batch.column("text")], float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])
        trim()

    return docs.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Null and empty texts are scored from their structure features; a null doc_id is never learnt
    from and not held out; repeated rows are scored alike; without any label the score is 0.5 or
    near it; an empty table gives no rows; other columns are ignored."""
    machine = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score(rows, machine).select("doc_id", held_out().alias("held_out"), "score", "predicted")
