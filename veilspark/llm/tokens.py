"""Token ids of whole texts: files of separately compressed documents, and packing."""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import NULL_ID, Scratch, batched, put_file, real_id, trim, using

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
MAGIC = b"VTOKFIL1"
ENTRY = struct.Struct("<qQII")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Marks that may end a run after a word and form one piece of their own there.
TAIL = b",.;:!?*#$%&)]}\"-_/+="


class Encoder(dict):
    """Ids of texts as little-endian 32-bit bytes.

    The tokenizer's normaliser and splitter act within runs between white space and drop the white
    space itself, so a text's ids are those of its runs in order. Each distinct run of a block of
    texts is encoded once: a run of letters with marks after it is a word and a tail, and new words
    go to the tokenizer together, their ids parted at those that end a word. Frequent runs stay
    known: at LIMIT the later half, which is rarer, goes (about 100 MB)."""

    LIMIT = 300_000

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        size = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(size, bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.words: dict[bytes, bytes] = {b"": b""}
        trim()

    def encode(self, run: str) -> bytes:
        return np.array(self.tokenizer.encode(run, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, runs: set[bytes]) -> None:
        parted, stems, tails = [], [], []
        for run in runs:
            word = stem = run.rstrip(TAIL)
            if stem.isalpha():  # of bytes: ASCII letters only
                word = stem.lower()
            elif stem.isascii() or not ((text := stem.decode()).isalpha() and text.lower().isalpha()):
                self[run] = self.encode(run.decode())
                continue
            parted.append(run)
            stems.append(word)
            tails.append(run[len(stem) :])
        words = list(set(stems).difference(self.words))
        if words:
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(words):
                raw, at = ids.tobytes(), 0
                for word, stop in zip(words, (4 * stops).tolist()):
                    self.words[word] = raw[at:stop]
                    at = stop
            else:  # a vocabulary without word ends
                self.words.update((word, self.encode(word.decode())) for word in words)
        self.words.update((tail, self.encode(tail.decode())) for tail in set(tails).difference(self.words))
        known = self.words
        self.update(zip(parted, [known[word] + known[tail] for word, tail in zip(stems, tails)]))

    def clear(self) -> None:
        super().clear()
        self.words = {b"": b""}

    def batch(self, texts: list[str | None], block: int = 1024):
        """The ids of each text."""
        using(self)
        for at in range(0, len(texts), block):
            split = [(x or "").encode("utf-8", "replace").split() for x in texts[at : at + block]]
            self.learn(set().union(*split).difference(self))
            for runs in split:
                yield b"".join(map(self.__getitem__, runs))
            self.forget()

    def forget(self) -> None:
        for known in (self, self.words):
            if len(known) > self.LIMIT:
                for key in list(islice(known, self.LIMIT // 2, None)):
                    del known[key]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# ---------------------------------------------------------------- files


def train_dictionary(docs: DataFrame, tokenizer: str, sample_docs: int = 2_000, sample_ids: int = 4_096, size: int = 65_536) -> bytes:
    """A shared dictionary from the serialised ids of at most sample_docs documents (smallest hashes
    of doc_id and text), at most sample_ids ids of each: a bound of 16 MB. Empty when there is too
    little to learn from. The documents are chosen by their numbers alone, so that no other text moves."""
    end = np.array([END_ID], "<u4").tobytes()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("twin"), F.col("text").cast("string").alias("text"))
    chosen = rows.select("doc", "twin").orderBy(F.xxhash64("doc", "twin"), "doc", "twin").limit(sample_docs)
    # At most sample_docs rows of two numbers: broadcast, bounded by the parameter.
    picked = rows.join(F.broadcast(chosen.distinct()), ["doc", "twin"]).groupBy("doc", "twin").agg(F.first("text").alias("text")).orderBy("doc", "twin")

    def serialise(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            ids = [np.frombuffer(x + end, "<u4")[:sample_ids] for x in encode.batch(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([x.astype("<u2").tobytes() if x.max(initial=0) < 65536 else x.tobytes() for x in ids], pa.binary())], names=["ids"])

    samples = [bytes(r.ids) for r in picked.mapInArrow(serialise, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class TokenFile:
    """magic | u32 header length | JSON header | index | frames.

    Header: dictionary hash, id width, numbers of documents and ids. Index: for each document
    doc_id, frame offset, frame bytes, ids; so a short document is read by one seek."""

    def __init__(self, dictionary: bytes, level: int = 3):
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.hash = hashlib.sha256(dictionary).hexdigest()
        self.packer = zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=True)
        self.reset()

    def reset(self):
        self.index, self.frames, self.at, self.n_ids = [], [], 0, 0

    def add(self, doc: int, ids: np.ndarray) -> None:
        frame = self.packer.compress(b"\0" + ids.astype("<u2").tobytes() if ids.max(initial=0) < 65536 else b"\1" + ids.tobytes())
        self.index.append(ENTRY.pack(doc, self.at, len(frame), len(ids)))
        self.frames.append(frame)
        self.at += len(frame)
        self.n_ids += len(ids)

    def data(self) -> bytes:
        header = json.dumps({"dictionary": self.hash, "docs": len(self.index), "ids": self.n_ids}).encode()
        return b"".join([MAGIC, struct.pack("<I", len(header)), header, *self.index, *self.frames])


def read_file(data: bytes, dictionary: bytes, wanted: set[int] | None = None):
    """(doc_id, ids before it in the file, ids) of each document, or of the wanted ones only."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    (size,) = struct.unpack_from("<I", data, 8)
    header = json.loads(data[12 : 12 + size])
    if header["dictionary"] != hashlib.sha256(dictionary).hexdigest():
        raise ValueError("the file was written with another dictionary")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    first = 12 + size
    frames, before = first + header["docs"] * ENTRY.size, 0
    for k in range(header["docs"]):
        doc, at, length, n = ENTRY.unpack_from(data, first + k * ENTRY.size)
        if wanted is None or doc in wanted:
            raw = reader.decompress(data[frames + at : frames + at + length])
            yield doc, before, np.frombuffer(raw, "<u2" if raw[0] == 0 else "<u4", offset=1).astype("<u4")
        before += n


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, dictionary: bytes, file_bytes: int = 8 << 20, partitions: int | None = None) -> list[tuple[str, int]]:
    """Files in ascending doc_id order (null first; equal doc_ids by hash of the text); (name, ids) of each.

    Ranges of doc_id go to tasks; each writes whole files of about file_bytes. The names order the files."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64("text").alias("twin")]
    rows = docs.select(*order, F.col("text").cast("string").alias("text")).repartitionByRange(n, "doc", "twin").sortWithinPartitions("doc", "twin")

    def write(batches):
        encode, out, made = encoder(tokenizer), TokenFile(dictionary), 0
        end = np.array([END_ID], "<u4").tobytes()

        def flush():
            nonlocal made
            name = f"tokens-{TaskContext.get().partitionId():08d}-{made:05d}.vtok"
            put_file(folder, name, out.data())
            total, made = out.n_ids, made + 1
            out.reset()
            return pa.RecordBatch.from_pydict({"name": [name], "n": [total]}, schema=schema)

        for batch in batches:
            for doc, ids in zip(batch.column("doc").to_pylist(), encode.batch(batch.column("text").to_pylist())):
                out.add(doc, np.frombuffer(ids + end, "<u4"))
                if out.at >= file_bytes:
                    yield flush()
        if out.index:
            yield flush()

    schema = pa.schema([("name", pa.string()), ("n", pa.int64())])
    return sorted((r.name, r.n) for r in rows.mapInArrow(write, "name string, n long").collect())


def read_token_files(spark: SparkSession, folder: str, files: list[tuple[str, int]], dictionary: bytes) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids of each document. The prefix sums over the files' totals
    (one number a file) give each file's first position."""
    schema = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
    if not files:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    starts, total = {}, 0
    for name, n in files:
        starts[name], total = total, total + n
    known = spark.sparkContext.broadcast(starts)

    def parse(batches):
        using()  # nothing is encoded any more

        def rows():
            for batch in batches:
                for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                    first = known.value.get(path.rsplit("/", 1)[-1])
                    if first is None:  # left by an attempt that never finished
                        continue
                    for doc, before, ids in read_file(data.as_py(), dictionary):
                        raw = ids.tobytes()
                        yield doc, first + before, len(ids), zlib.crc32(raw), raw

        yield from batched(rows(), schema, 1_000)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.vtok").load(folder).select("path", "content")
    return found.mapInArrow(parse, "doc long, start long, n_tokens long, ids_crc32 long, ids binary").select(real_id().alias("doc_id"), "start", "n_tokens", "ids_crc32", "ids")


def token_output(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the documents' ids and read them back.

    Null text is empty (one id, the end id); a null doc_id sorts first and is returned as null;
    repeated rows are written as often as they occur; an empty table gives no rows; other
    columns, whatever their names, are ignored."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    tokenizer = tokenizer or tokenizer_path()
    dictionary = train_dictionary(docs, tokenizer)
    files = write_token_files(docs, scratch.path("files"), tokenizer, dictionary)
    scratch.release()
    return read_token_files(spark, scratch.path("files"), files, dictionary).drop("ids")


# ---------------------------------------------------------------- packing

TOKENISED = "doc long, task long, before long, n long, ids binary"


def tokenise(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Ids of each document with the end id, and the ids before it in its partition."""
    schema = pa.schema([("doc", pa.int64()), ("task", pa.int64()), ("before", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        encode, task = encoder(tokenizer), TaskContext.get().partitionId()

        def rows():
            before, shrink = 0, zstandard.ZstdCompressor(level=1)
            for batch in batches:
                for doc, raw in zip(batch.column("doc").to_pylist(), encode.batch(batch.column("text").to_pylist())):
                    raw += end
                    n = len(raw) // 4
                    ids = np.frombuffer(raw, "<u4")
                    yield doc, task, before, n, shrink.compress(b"\0" + ids.astype("<u2").tobytes() if ids.max() < 65536 else b"\1" + raw)
                    before += n

        yield from batched(rows(), schema, 1_000)

    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, TOKENISED)


def pack(docs: DataFrame, length: int = 4_096, tokenizer: str | None = None) -> DataFrame:
    """Concatenate and cut: one row per piece of a document.

    First pass: ids of each document, with the ids before it in its task; the totals of the tasks
    (one number a task) are summed up on the driver. Second pass: first position = task's offset +
    ids before, and windows of `length` are cut; a document over a boundary gives a record on
    either side (is_boundary). Only the last sequence is shorter.

    Null text is empty (the end id alone); null doc_id stays null; repeated rows are packed as
    often as they occur; an empty table gives no rows; other columns are ignored."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    tokens = scratch.save(tokenise(docs, tokenizer or tokenizer_path()), "ids")
    offsets, total = {}, 0
    for row in sorted(tokens.groupBy("task").agg(F.sum("n").alias("n")).collect()):
        offsets[row.task], total = total, total + row.n
    known = spark.sparkContext.broadcast(offsets)
    schema = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("is_boundary", pa.bool_()), ("ids", pa.binary())])

    def cut(batches):
        using()  # nothing is encoded any more

        def rows():
            grow = zstandard.ZstdDecompressor()
            for batch in batches:
                for doc, task, before, n, packed in zip(*(batch.column(k).to_pylist() for k in range(5))):
                    raw = grow.decompress(packed)
                    ids = np.frombuffer(raw, "<u2" if raw[0] == 0 else "<u4", offset=1).astype("<u4").tobytes()
                    at, start = known.value[task] + before, 0
                    many = at // length != (at + n - 1) // length
                    while start < n:
                        sequence, offset = divmod(at + start, length)
                        size = min(n - start, length - offset)
                        piece = ids[4 * start : 4 * (start + size)]
                        yield doc, start, size, zlib.crc32(piece), n, sequence, offset, many, piece
                        start += size

        yield from batched(rows(), schema, 1_000)

    pieces = tokens.mapInArrow(cut, "doc long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, is_boundary boolean, ids binary")
    return pieces.select(real_id().alias("doc_id"), *[c for c in pieces.columns if c != "doc"])
