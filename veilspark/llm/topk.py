"""Exact top-k inner products: aggregation of sorted lists without random access."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import Scratch, batched

#: Scores below this are exact in a double.
EXACT = 2**53
#: What a long holds; scores beyond count as its ends.
LEAST, MOST = -(2**63), 2**63 - 1
#: How far the lists are read before the bounds are looked at again.
DEPTHS = (1 / 8, 1 / 2, 0.65, 0.75, 0.85, 0.92, 0.96, 0.99)
#: Reading stops where no more than this part of a block, or 4 k, is in question.
FEW = 1 / 100


class Lists:
    """One list per dimension over a block of candidates, sorted by value; read from either end.

    read: entries read so far; asked: entries there were; resolved: candidates whose score was still in question in the end."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.n, self.d = rows.shape
        up = np.argsort(rows, axis=0, kind="stable").T
        values = np.take_along_axis(rows.T, up, 1).astype(np.float32)
        # Row 2 j is dimension j from the smallest value on, row 2 j + 1 from the largest; who: places in a table of dimensions by candidates.
        up = up + self.n * np.arange(self.d)[:, None]
        self.who = np.stack([up, up[:, ::-1]], 1).reshape(2 * self.d, self.n)
        self.values = np.stack([values, values[:, ::-1]], 1).reshape(2 * self.d, self.n)
        self.read = self.asked = self.resolved = 0

    def top(self, query: np.ndarray, own: int | None, k: int, floor: float = -np.inf) -> list[tuple[int, float]]:
        """(candidate's place, score) of everything that may be among the query's k best, of which the k-th is known to reach the floor.

        Each dimension's list is read in sequence from the end with the larger products. What was
        seen of a candidate adds up; of what wasn't, a product lies between the list's last and the
        one just read. That gives each candidate a lower and an upper bound of its score. Reading
        stops once no more than the k with the largest lower bounds and a FEW others can reach the
        k-th of these, or the floor, or at the last of DEPTHS, and the scores of those are resolved."""
        if not self.d or not self.n:
            return [(i, 0.0) for i in range(self.n) if own is None or self.ids[i] != own]
        lists = 2 * np.arange(self.d) + (query >= 0)
        others = np.ones(self.n, bool) if own is None else self.ids != own
        weights = query.astype(np.float32)
        worst = weights * self.values[lists, -1]
        # What each product that was seen lies above the list's last; 0 where nothing was seen.
        above, at, left = np.zeros((self.d, self.n), np.float32), 0, others
        slack = 1e-5 * (1 + float(np.abs(worst).sum() + np.abs(weights * self.values[lists, 0]).sum()))
        self.asked += self.n * self.d
        for depth in DEPTHS:
            to = max(at + 1, int(self.n * depth))
            if to >= self.n:
                break
            products = self.values[lists, at:to] * weights[:, None]
            above.reshape(-1)[self.who[lists, at:to].ravel()] = (products - worst[:, None]).ravel()
            self.read += products.size
            at = to
            lower = above.sum(0) + worst.sum()
            # A product that wasn't seen is at most the one just read.
            upper = lower + (products[:, -1] - worst) @ (above == 0).astype(np.float32)
            kth = max(floor, float(np.partition(lower[others], -k)[-k]) if others.sum() >= k else -np.inf)
            left = others & (upper >= kth - slack)
            if left.sum() <= max(4 * k, self.n * FEW):
                break
        place = np.flatnonzero(left)
        self.resolved += len(place)
        # In whole numbers, which bounds in single precision with their slack only select.
        scores = self.rows[place] @ query
        if len(place) > k:
            kth = np.partition(scores, -k)[-k]
            place, scores = place[scores >= kth], scores[scores >= kth]
        return [(int(i), s) for i, s in zip(place, scores)]


def exact_scores(rows: np.ndarray, query: np.ndarray) -> bool:
    return rows.size == 0 or float(np.abs(rows).max()) * float(np.abs(query).max(initial=0)) * len(query) < EXACT


def whole_scores(rows: np.ndarray, query: np.ndarray) -> list[int]:
    """Scores in whole numbers of any size, put to the ends of a long where they pass it."""
    whole = [int(v) for v in query]
    return [min(MOST, max(LEAST, sum(a * int(b) for a, b in zip(whole, row)))) for row in rows]


def packed(vectors: DataFrame, size: int, scale: float) -> DataFrame:
    """Blocks of at most `size` vectors of one length: ids and floor(scale * x) as doubles, put to the largest where it passes them."""
    schema = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary())])

    def run(batches):
        def rows():
            made, open_blocks = 0, {}
            task = TaskContext.get().partitionId()

            def close(d):
                nonlocal made
                ids, data = open_blocks.pop(d)
                made += 1
                return task * 2**32 + made, d, np.array(ids, "<i8").tobytes(), np.concatenate(data).tobytes() if data else b""

            for batch in batches:
                for vec, x in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
                    values = np.array(x.values.to_numpy(zero_copy_only=False), float)
                    ids, data = open_blocks.setdefault(len(values), ([], []))
                    ids.append(vec)
                    with np.errstate(over="ignore"):
                        data.append(np.nan_to_num(np.floor(scale * values)))
                    if len(ids) >= size:
                        yield close(len(values))
            for d in list(open_blocks):
                yield close(d)

        yield from batched(rows(), schema, 32)

    return vectors.mapInArrow(run, "block long, dim int, ids binary, rows binary")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, block: int = 4_096, queries: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every query, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by `every`. Candidates and queries are packed
    into blocks; the blocks of queries are dealt to the groups of candidate blocks, and each pair of
    blocks returns at most k rows and ties a query, so what is merged grows with queries and blocks.
    Within a task, the k-th score that a query has reached is the floor for the blocks that follow.

    Vectors that are null or hold a null or a non-finite number take no part, nor do rows without
    vec_id; vectors of different lengths are never compared; a repeated vec_id is one query a row
    and never a candidate of its own; equal (query, candidate, score) rows count once; scores beyond
    a long count as its largest or smallest number; an empty table gives no rows; other columns are
    ignored."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    x = F.col("embedding").cast("array<double>")
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    )
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    candidates = scratch.save(packed(usable, block, scale), "candidates").withColumn("part", F.pmod(F.xxhash64("block"), F.lit(groups)))
    asked = scratch.save(packed(usable.where(F.col("vec_id") % every == 0).coalesce(max(1, groups // 4)), queries, scale), "queries")
    asked = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("part"), "dim", F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"))
    pairs = candidates.join(asked.hint("shuffle_merge"), ["part", "dim"]).select("block", "dim", "ids", "rows", "q_ids", "q_rows")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(batches):
        def rows():
            known, lists = None, None
            # The best scores of distinct candidates that each query has met in this task; repeats are found by their id.
            best: dict[tuple[int, bytes], dict[int, int]] = {}
            for batch in batches:
                for r in range(batch.num_rows):
                    block, d, ids, data, q_ids, q_rows = (batch.column(c)[r].as_py() for c in range(6))
                    if block != known:
                        ids = np.frombuffer(ids, "<i8")
                        known, lists = block, Lists(ids, np.frombuffer(data, float).reshape(len(ids), d))
                        # Rows that repeat a vec_id may count once, so as many more are asked for.
                        more = len(ids) - len(np.unique(ids))
                    q_ids = np.frombuffer(q_ids, "<i8")
                    for q, query in zip(q_ids.tolist(), np.frombuffer(q_rows, float).reshape(len(q_ids), d)):
                        met = best.setdefault((q, query.tobytes()), {})
                        floor = min(met.values()) if len(met) == k else -np.inf
                        if not exact_scores(lists.rows, query):
                            found = [(s, int(i)) for i, s in zip(lists.ids, whole_scores(lists.rows, query)) if i != q]
                        else:
                            found = [(int(s), int(lists.ids[i])) for i, s in lists.top(query, q, k + more, floor)]
                        for s, i in sorted(set(found), key=lambda x: (-x[0], x[1]))[:k]:
                            yield q, i, s
                            met[i] = max(met.get(i, LEAST), s)
                        for i in sorted(met, key=lambda i: (-met[i], i))[k:]:
                            del met[i]

        yield from batched(rows(), schema)

    found = pairs.mapInArrow(search, "query_id long, vec_id long, score long").distinct()
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
