"""Shared plumbing of the training-data operators: scratch tables on the cluster's shared
folder, files written from tasks, document keys, word hashing and connected components."""

from __future__ import annotations

import ctypes
import gc
import posixpath
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where a null doc_id sorts: before every other document.
NULL_ID = -(2**63)


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset (tests, local mode) one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="veilspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Rows are whole documents here, so Arrow batches of fewer rows than the default keep workers and executors small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


class Scratch:
    """Written tables that cut lineage. Each name is a Parquet folder below one shared folder;
    a table that is no longer needed is dropped so that disk holds little more than the live ones."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        small_batches(spark)
        self.base = f"{shared_root(spark)}/veilspark-{label}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self.release()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Shuffle files of finished jobs go once the driver's references to them are collected."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def settle(spark: SparkSession) -> None:
    """Executors collect their garbage and give free heap back to the system: a heap grown in one stage
    would stay beside the Python workers of the next. One short task a core; an executor that
    none reaches keeps its heap, and nothing else differs."""
    n = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, n, 1, n).where("reflect('java.lang.System', 'gc') IS NOT NULL").count()


def task_filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """For code in a task: the file system of a shared folder, and the folder's path there."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def put_file(uri: str, name: str, data: bytes) -> None:
    """Write under a name of this attempt, then move: a lost or repeated task leaves whole files only."""
    system, folder = task_filesystem(uri)
    system.create_dir(folder, recursive=True)
    draft = posixpath.join(folder, f".{name}.{uuid.uuid4().hex}")
    with system.open_output_stream(draft) as out:
        out.write(data)
    system.move(draft, posixpath.join(folder, name))


def get_file(uri: str, name: str) -> bytes:
    system, folder = task_filesystem(uri)
    with system.open_input_stream(posixpath.join(folder, name)) as file:
        return file.read()


def unique_ids(docs: DataFrame) -> bool:
    """Whether no doc_id stands in two rows; reads that column only."""
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def keyed(docs: DataFrame, *more: str, unique: bool = False) -> DataFrame:
    """doc (doc_id, null first), twin (hash of the text; 0 if doc_ids are known to be unique) and text; null text is empty.

    Rows that repeat a doc_id with another text stay apart; rows that repeat both are one
    document with several rows, and each row gets that document's result."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"),
        (F.lit(0).cast("long") if unique else F.xxhash64(text)).alias("twin"),
        text.alias("text"),
        *more,
    )


def real_id(column: str = "doc"):
    return F.when(F.col(column) != NULL_ID, F.col(column))


_caches: list = []


def using(cache=None):
    """This cache, with all other operators' caches of the worker emptied: a worker serves one stage after another."""
    for other in _caches:
        if other is not cache and other:
            other.clear()
            trim()
    if cache is not None and not any(other is cache for other in _caches):
        _caches.append(cache)
    return cache


def trim() -> None:
    """Gives free memory back to the system: idle workers stay beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


ODD = 0x9E3779B97F4A7C15
INVERSE = pow(ODD, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        x = np.full(max(n, 1 << 16), base, np.uint64)
        x[0] = 1
        _powers[base] = np.cumprod(x)
    return _powers[base][:n]


#: A random number for each byte; in FOLDED capital letters have those of small ones.
CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(ODD))
FOLDED = CODES.copy()
FOLDED[65:91] = CODES[97:123]
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Longer words are hashed one by one: sums of powers could be made to collide there.
LONG_WORD = 64


def text_blocks(column: pa.Array, size: int = 1 << 18):
    """The texts of a column by groups of about `size` bytes, as (bytes in a row, where each text begins, and the end); null is empty."""
    using()
    if column.null_count:
        column = column.fill_null("")
    wide = "<i8" if pa.types.is_large_string(column.type) else "<i4"
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, wide, len(column) + 1, column.offset * int(wide[2])).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    k = 0
    while k < len(column):
        end = max(k + 1, int(np.searchsorted(bounds, bounds[k] + size, "right")) - 1)
        yield raw[bounds[k] : bounds[end]], bounds[k : end + 1] - bounds[k]
        k = end


def one_text(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(raw, np.uint8), np.array([0, len(raw)])


def word_hashes(data: np.ndarray, bounds: np.ndarray, codes: np.ndarray = CODES, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in a row, and the number of words of each text.

    Words are runs of other than ASCII white space; no word runs over a text's end. A word's hash is
    a sum over its bytes of their codes times powers, taken from sums over the whole row. kept: which
    bytes count; a word that has none of these is hashed whole."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds) - 1, np.int64)
    word = ~SPACE[data]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    begin, stop = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    begin[inner] = word[inner]
    stop[:-1] &= ~word[1:]
    stop[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    sums = np.zeros(n + 1, np.uint64)
    place = starts
    if kept is None:
        np.cumsum(codes[data] * powers(ODD, n), out=sums[1:])
    else:
        # Bytes that don't count have no place among the powers.
        counts = kept[data]
        before = np.zeros(n + 1, np.int64)
        np.cumsum(counts, out=before[1:])
        np.cumsum(np.where(counts, codes[data] * powers(ODD, n)[before[:n]], np.uint64(0)), out=sums[1:])
        place = before[starts]
    found = mix((sums[ends] - sums[starts]) * powers(INVERSE, n)[place])
    odd = ends - starts > LONG_WORD
    if kept is not None:
        odd |= before[ends] == before[starts]
    for k in np.flatnonzero(odd).tolist():
        own = data[starts[k] : ends[k]]
        if kept is not None and before[ends[k]] > before[starts[k]]:
            own = own[kept[own]]
        if kept is None or len(own) > LONG_WORD or not kept[own[0]]:
            found[k] = xxhash.xxh3_64_intdigest(codes[own].tobytes())
    return found, np.diff(np.searchsorted(starts, bounds))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of a sequence of hashes, order-sensitive."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:count].copy()
    for k in range(1, n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + count]
        total ^= total >> np.uint64(29)
    return mix(total + np.uint64(n))


def batched(rows, schema: pa.Schema, size: int = 20_000):
    """Record batches of tuples that a generator yields."""
    block = []
    for row in rows:
        block.append(row)
        if len(block) >= size:
            yield to_batch(block, schema)
            block = []
    if block:
        yield to_batch(block, schema)
    trim()


def to_batch(block: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), schema.types)], schema=schema)


def components(scratch: Scratch, edges: DataFrame, tag: str) -> DataFrame:
    """Smallest node reachable from every node of edges(a, b), as (node, root).

    Alternating large-star and small-star steps; each round is a written table, so lost executors
    cost one round. Nodes with one very frequent neighbour are split by adaptive joins: the
    minimum is aggregated first and joined back."""
    current = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{tag}-0")
    turn = 0
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = linked.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        turn += 1
        current = scratch.save(small, f"{tag}-{turn}")
        scratch.drop(f"{tag}-{turn - 1}")
        # Done once every edge ends in a node that begins none: all are stars around their smallest node.
        if current.join(current.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
