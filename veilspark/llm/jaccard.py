"""N-gram Jaccard join by vertical partitioning of the global n-gram order."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import FOLDED, Scratch, batched, components, grams, keyed, mix, real_id, text_blocks, unique_ids, word_hashes

#: Words a shingle has, the least similarity as a fraction, fragments of the global order.
SHINGLE, SIMILAR, FRAGMENTS = 5, (80, 100), 8
#: Cells of the table of n-gram frequencies: 16 MB whatever the corpus, gathered in PARTS.
CELLS, PARTS = 1 << 22, 64
#: Bits of the filter of wanted documents: 4 MB whatever the corpus.
FILTER_BITS = 1 << 25
#: Rounds of stars before what is left is paired.
STARS = 2
#: An n-gram that surely stands in no more sets than this may be counted within one task.
COLD = 100_000
#: Prefix n-grams that a task holds before it deals them out.
HELD = 400_000
#: Buckets of more classes than WIDE are not held against each other within one task but in blocks of BLOCK by BLOCK.
WIDE, BLOCK = 256, 2_048
#: Bits of a fragment's sketch: at least as many as it has n-grams, within these bounds.
SKETCH = 6, 15


def shingle_sets(texts: pa.Array, size: int = SHINGLE):
    """For each text the sorted distinct 64-bit hashes of its shingles; with fewer words the whole sequence is one shingle."""
    for data, bounds in text_blocks(texts):
        hashed, counts = word_hashes(data, bounds, FOLDED)
        every = grams(hashed, size)
        first = 0
        for n in counts.tolist():
            if n >= size:
                own = np.sort(every[first : first + n - size + 1])
                yield own[np.append(True, own[1:] != own[:-1])]
            else:
                yield grams(hashed[first : first + n], n) if n else hashed[:0]
            first += n


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    return next(shingle_sets(pa.array([text or ""]), size))


def set_key(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


class Order:
    """A global order of n-grams: frequency class (rare first), then hash; the same for every document.

    The frequencies are counted over all documents in a table of fixed size; cells are shared, which
    moves an n-gram to a later class than its own but never changes that the order is one for all.
    pivots cut the order into fragments of about equal numbers of n-grams."""

    def __init__(self, counts: np.ndarray, fragments: int):
        self.classes = np.minimum(255, np.floor(4 * np.log2(1.0 + counts))).astype(np.uint8)
        self.hot = int(4 * np.log2(1.0 + COLD))  # from this class on
        mass = np.bincount(self.classes, counts.astype(float), 256)
        bounds = np.concatenate([[0], np.cumsum(mass)])
        pivots = []
        for k in range(1, fragments):
            goal = bounds[-1] * k / fragments
            c = int(np.searchsorted(bounds, goal, "right")) - 1
            inside = (goal - bounds[c]) / mass[c] if c < 256 and mass[c] else 0.0
            pivots.append((min(c, 255) << 56) | min(int(inside * 2**56), 2**56 - 1))
        self.pivots = np.array(pivots, np.uint64)

    def keys(self, found: np.ndarray) -> np.ndarray:
        return (self.classes[found & np.uint64(CELLS - 1)].astype(np.uint64) << np.uint64(56)) | (found >> np.uint64(8))

    def sort(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams in order, and the places where its fragments begin, with the end."""
        keys = self.keys(found)
        at = np.argsort(keys, kind="stable")  # found is sorted, so that equal keys stand by hash
        return found[at], np.concatenate([[0], np.searchsorted(keys[at], self.pivots, "left"), [len(found)]])


def prefix_length(n: int) -> int:
    """Two sets of similarity 0.8 share an n-gram among the first so many of either."""
    return n - (SIMILAR[0] * n + SIMILAR[1] - 1) // SIMILAR[1] + 1


# ---------------------------------------------------------------- tables of a fixed size


def gathered(tables: DataFrame, dtype, cells: int, add) -> np.ndarray:
    """One table of `cells` numbers from tasks' tables (part, data), packed part by part.

    Tasks add up what they read and stream what meets in a part, so each holds one table at most,
    and PARTS rows of a fixed size reach the driver."""
    schema = pa.schema([("part", pa.int64()), ("data", pa.binary())])

    def run(batches):
        held, grow = {}, zstandard.ZstdDecompressor()
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data")):
                more = np.frombuffer(grow.decompress(data.as_py()), dtype)
                held[part] = add(held[part], more) if part in held else more.copy()
        yield from packed(held, schema)

    once = tables.mapInArrow(run, "part long, data binary").repartition("part").mapInArrow(run, "part long, data binary")
    out, grow = np.zeros((PARTS, cells // PARTS), dtype), zstandard.ZstdDecompressor()
    for row in once.toLocalIterator():
        out[row.part] = np.frombuffer(grow.decompress(bytes(row.data)), dtype)
    return out.ravel()


def packed(parts: dict[int, np.ndarray], schema: pa.Schema):
    shrink = zstandard.ZstdCompressor(level=1)
    yield from batched(((k, shrink.compress(x.tobytes())) for k, x in parts.items()), schema, 8)


def add_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums that stay at the largest number."""
    total = a + b
    total[total < a] = np.iinfo(a.dtype).max
    return total


# ---------------------------------------------------------------- passes over the texts


def describe(rows: DataFrame) -> DataFrame:
    """One pass: kind 0, a row per document with set size and set key; kind 1, the task's n-gram counts by parts of the table."""
    schema = pa.schema([("kind", pa.int32()), ("doc", pa.int64()), ("twin", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        counts, shrink = np.zeros(CELLS, np.uint32), zstandard.ZstdCompressor(level=1)

        def found():
            some = False
            for batch in batches:
                for doc, twin, own in zip(batch.column("doc").to_pylist(), batch.column("twin").to_pylist(), shingle_sets(batch.column("text"))):
                    yield 0, doc, twin, len(own), set_key(own), None
                    np.add.at(counts, (own & np.uint64(CELLS - 1)).astype(np.int64), 1)
                    some = some or len(own) > 0
            if some:
                for k, part in enumerate(np.split(counts, PARTS)):
                    yield 1, k, 0, 0, None, shrink.compress(part.tobytes())

        yield from batched(found(), schema, 5_000)

    return rows.mapInArrow(run, "kind int, doc long, twin long, n long, key binary, counts binary")


def sketch(found: np.ndarray, cuts: np.ndarray) -> bytes:
    """For each fragment the number of its n-grams and a row of bits, each the parity of those that fall on it."""
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        log = min(SKETCH[1], max(SKETCH[0], (b - a - 1).bit_length()))
        bits = np.bincount(((found[a:b] >> np.uint64(24)) & np.uint64((1 << log) - 1)).astype(np.int64), minlength=1 << log) & 1
        out.append(struct.pack("<IB", b - a, log) + np.packbits(bits.astype(np.uint8), bitorder="little").tobytes())
    return b"".join(out)


def unsketched(data: bytes) -> list[tuple[int, int, int]]:
    """(n-grams, log of bits, bits as a number) of each fragment."""
    out, at = [], 0
    while at < len(data):
        n, log = struct.unpack_from("<IB", data, at)
        at += 5
        out.append((n, log, int.from_bytes(data[at : at + (1 << log) // 8], "little")))
        at += (1 << log) // 8
    return out


def folded(bits: int, log: int, to: int) -> int:
    """The sketch with fewer bits: its halves laid over each other."""
    while log > to:
        log -= 1
        bits = (bits >> (1 << log)) ^ (bits & ((1 << (1 << log)) - 1))
    return bits


def most_shared(left: list, right: list) -> int:
    """An upper bound of the overlap, fragment by fragment: n-grams that only one of the two has flip a bit each at most."""
    total = 0
    for (n, p, x), (m, q, y) in zip(left, right):
        if p != q:
            x, y = folded(x, p, q), folded(y, q, p)
        total += min(n, m, (n + m - (x ^ y).bit_count()) // 2)
    return total


def enough(shared, n, m):
    return shared * (SIMILAR[0] + SIMILAR[1]) >= (n + m) * SIMILAR[0]


CUT = "kind int, sid long, n long, doc long, gram long, at int, part int, key binary, sketch binary, block binary"


def cut_sets(rows: DataFrame, order, parts: int) -> DataFrame:
    """The second pass, narrow as the first. Of each set that is new to the task: kind 0, its sid,
    size, key, a document that has it and its sketch; kind 1, the first n-grams in the global order
    of many sets together, dealt by hash to `parts` and packed; kind 2, a row for each of these
    that may stand in more than COLD sets."""
    schema = pa.schema([("kind", pa.int32()), ("sid", pa.int64()), ("n", pa.int64()), ("doc", pa.int64()), ("gram", pa.int64()), ("at", pa.int32()), ("part", pa.int32()), ("key", pa.binary()), ("sketch", pa.binary()), ("block", pa.binary())])

    def run(batches):
        shrink, edges = zstandard.ZstdCompressor(level=1), np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)

        def deal(held):
            flat = np.concatenate([x for x, _ in held])
            at = np.concatenate([np.arange(len(x), dtype=np.uint32) for x, _ in held])
            sid = np.repeat(np.array([s for _, s in held]), [len(x) for x, _ in held])
            hot = order.value.classes[flat & np.uint64(CELLS - 1)] >= order.value.hot
            for g, s, a in zip(flat[hot].view(np.int64).tolist(), sid[hot].tolist(), at[hot].tolist()):
                yield 2, s, None, None, g, a, None, None, None, None
            flat, at, sid = flat[~hot], at[~hot], sid[~hot]
            by = np.argsort(flat)
            flat, at, sid = flat[by], at[by], sid[by]
            cuts = np.concatenate([[0], np.searchsorted(flat, edges, "left"), [len(flat)]])
            for part, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                if a < b:
                    yield 1, None, None, None, None, None, part, None, None, shrink.compress(pack_block(flat[a:b], sid[a:b], at[a:b]))

        def found():
            known, held, size, first = set(), [], 0, TaskContext.get().partitionId() << 32
            for batch in batches:
                for doc, own in zip(batch.column("doc").to_pylist(), shingle_sets(batch.column("text"))):
                    key = set_key(own)
                    if not len(own) or key in known:
                        continue
                    sid = first + len(known)
                    known.add(key)
                    own, cuts = order.value.sort(own)
                    yield 0, sid, len(own), doc, None, None, None, key, sketch(own, cuts), None
                    held.append((own[: prefix_length(len(own))].copy(), sid))
                    size += len(held[-1][0])
                    if size >= HELD:
                        yield from deal(held)
                        held, size = [], 0
            if held:
                yield from deal(held)

        yield from batched(found(), schema, 2_000)

    return rows.select("doc", "text").mapInArrow(run, CUT)


def pack_block(gram: np.ndarray, sid: np.ndarray, at: np.ndarray) -> bytes:
    """Sorted n-grams by their differences, byte by byte; the sets' numbers in the task and the places."""
    steps = np.diff(gram, prepend=np.uint64(0))
    head = struct.pack("<qI", int(sid[0]) >> 32, len(gram))
    return head + steps.view(np.uint8).reshape(-1, 8).T.tobytes() + (sid & 0xFFFFFFFF).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() + at.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack_block(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    task, n = struct.unpack_from("<qI", data)
    raw = np.frombuffer(data, np.uint8, offset=12)
    wide = lambda x, w: np.ascontiguousarray(x.reshape(w, n).T)
    gram = np.cumsum(wide(raw[: 8 * n], 8).view(np.uint64).ravel(), dtype=np.uint64)
    return gram, wide(raw[8 * n : 12 * n], 4).view("<u4").ravel().astype(np.int64) + (task << 32), wide(raw[12 * n :], 4).view("<u4").ravel().astype(np.int32)


def shared_grams(cut: DataFrame, parts: int) -> DataFrame:
    """(gram, sid, at) of the prefix n-grams that at least two sets have; a task gets the packed n-grams of one part."""
    schema = pa.schema([("gram", pa.int64()), ("sid", pa.int64()), ("at", pa.int32())])

    def run(batches):
        grow = zstandard.ZstdDecompressor()
        found = [unpack_block(grow.decompress(x.as_py())) for batch in batches for x in batch.column("block")]
        if not found:
            return
        gram, sid, at = (np.concatenate(x) for x in zip(*found))
        del found
        by = np.argsort(gram)
        same = gram[by][1:] == gram[by][:-1]
        by = by[np.append(same, False) | np.append(False, same)]
        for k in range(0, len(by), 50_000):
            some = by[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(gram[some].view(np.int64)), pa.array(sid[some]), pa.array(at[some])], schema=schema)

    return cut.where("kind = 1").select("part", "block").repartitionById(parts, F.col("part")).mapInArrow(run, "gram long, sid long, at int")


def filter_of(wanted: DataFrame) -> np.ndarray:
    """Bits of the documents in wanted(doc); others share them by chance, more where more is wanted."""
    schema = pa.schema([("part", pa.int64()), ("data", pa.binary())])

    def run(batches):
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            at = place_of(batch.column("doc").to_numpy())
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield from packed({k: x for k, x in enumerate(np.split(bits, PARTS)) if x.any()}, schema)

    return gathered(wanted.select("doc").mapInArrow(run, "part long, data binary"), np.uint8, FILTER_BITS // 8, np.bitwise_or)


def place_of(doc: np.ndarray) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def segments(rows: DataFrame, order, bits) -> DataFrame:
    """The sets of the documents in the filter, cut at the pivots: key and the n-grams of one fragment a row."""
    schema = pa.schema([("key", pa.binary()), ("fragment", pa.int32()), ("grams", pa.list_(pa.int64()))])

    def run(batches):
        def made():
            known = set()
            for batch in batches:
                at = place_of(batch.column("doc").to_numpy())
                chosen = batch.column("text").filter(pa.array((bits.value[at >> 3] >> (at & 7)) & 1).cast(pa.bool_()))
                for own in shingle_sets(chosen):
                    key = set_key(own)
                    if key in known:
                        continue
                    known.add(key)
                    own, cuts = order.value.sort(own)
                    for f, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                        if a < b:
                            yield key, f, np.sort(own[a:b].view(np.int64))

        yield from batched(made(), schema, 500)

    return rows.select("doc", "text").mapInArrow(run, "key binary, fragment int, grams array<long>")


# ---------------------------------------------------------------- pairs


def possible(n: str, m: str, i: str, j: str):
    """Whether sets of n and m n-grams that share the i-th and j-th of the order can be similar enough."""
    a, b = SIMILAR
    sizes = (F.least(n, m) * b >= F.greatest(n, m) * a)
    best = F.least(i, j) + 1 + F.least(F.col(n) - 1 - F.col(i), F.col(m) - 1 - F.col(j))
    return sizes & (best * (a + b) >= (F.col(n) + F.col(m)) * a)


def sketched(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose overlaps, bounded in each fragment apart and summed up, can be enough; with their sizes n and m."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("m", pa.int64())])

    def run(batches):
        for batch in batches:
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            best = np.array([most_shared(unsketched(x), unsketched(y)) for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist())], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(4)], schema=schema).filter(pa.array(enough(best, n, m), pa.bool_()))

    left = classes.select(F.col("sid").alias("a"), "n", F.col("sketch").alias("left"))
    right = classes.select(F.col("sid").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("right"))
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "n", "m", "left", "right").mapInArrow(run, "a long, b long, n long, m long")


def near_pairs(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, n, m) of the classes in one of the buckets (gram, sid, c, n, at) that are of different components and can
    be similar by sizes, places and sketches.

    A task reads buckets of at most WIDE rows one after another and holds their classes against each
    other, so that only pairs that pass the sketches are made as rows."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("m", pa.int64())])

    def run(batches):
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])]).combine_chunks()
            gram = rows.column("gram").to_numpy()
            whole = int(np.searchsorted(gram, gram[-1], "left")) if len(gram) else 0  # the last bucket may go on
            rest = rows.slice(whole)
            yield from meet(rows.slice(0, whole))
        if rest is not None:
            yield from meet(rest)

    def meet(rows):
        gram, sid, c, n, at = (rows.column(k).to_numpy().astype(np.int64) for k in ("gram", "sid", "c", "n", "at"))
        others = np.searchsorted(gram, gram, "right") - np.arange(len(gram)) - 1
        bounds = np.concatenate([[0], np.cumsum(others)])
        known: dict[int, list] = {}
        k = 0
        while k < len(gram):
            # So many rows that their pairs fit a block.
            end = max(k + 1, int(np.searchsorted(bounds, bounds[k] + 200_000, "right")) - 1)
            x = np.repeat(np.arange(k, end), others[k:end])
            y = x + 1 + np.arange(len(x)) - (bounds[x] - bounds[k])
            k = end
            best = np.minimum(at[x], at[y]) + 1 + np.minimum(n[x] - 1 - at[x], n[y] - 1 - at[y])
            sizes = np.minimum(n[x], n[y]) * SIMILAR[1] >= np.maximum(n[x], n[y]) * SIMILAR[0]
            fit = np.flatnonzero((c[x] != c[y]) & sizes & enough(best, n[x], n[y]))
            x, y = x[fit], y[fit]
            x, y = np.where(sid[x] < sid[y], x, y), np.where(sid[x] < sid[y], y, x)
            _, one = np.unique(np.stack([sid[x], sid[y]]), axis=1, return_index=True)
            x, y = x[one], y[one]
            if not len(x):
                continue
            # A first look with the least number of bits, all pairs at once.
            used, place = np.unique(np.concatenate([x, y]), return_inverse=True)
            for r, data in zip(used.tolist(), rows.column("sketch").take(pa.array(used)).to_pylist()):
                known[r] = unsketched(data)
            part = np.array([[f[0] for f in known[r]] for r in used.tolist()], np.int64)
            low = np.array([[folded(f[2], f[1], SKETCH[0]) for f in known[r]] for r in used.tolist()], np.uint64)
            left, right = place[: len(x)], place[len(x) :]
            apart = np.bitwise_count(low[left] ^ low[right]).astype(np.int64)
            best = np.minimum(np.minimum(part[left], part[right]), (part[left] + part[right] - apart) // 2).sum(1)
            near = [i for i in np.flatnonzero(enough(best, n[x], n[y])).tolist() if enough(most_shared(known[x[i]], known[y[i]]), int(n[x[i]]), int(n[y[i]]))]
            known.clear()
            x, y = x[near], y[near]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (sid[x], sid[y], n[x], n[y])], schema=schema)

    rows = buckets.select("gram", "sid", "c", "n", "at").join(classes.select("sid", "sketch").hint("merge"), "sid")
    return rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "a long, b long, n long, m long").distinct()


def verified(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (a, b, n, m) that are similar: partial overlaps are counted in each fragment apart and summed up."""
    left = parts.select(F.col("sid").alias("a"), "fragment", F.col("grams").alias("left"))
    right = parts.select(F.col("sid").alias("b"), "fragment", F.col("grams").alias("right"))
    partial = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), ["b", "fragment"]).select("a", "b", "n", "m", F.size(F.array_intersect("left", "right")).cast("long").alias("shared"))
    total = partial.groupBy("a", "b", "n", "m").agg(F.sum("shared").alias("shared"))
    return total.where(enough(F.col("shared"), F.col("n"), F.col("m"))).select("a", "b")


def dealt(wide: DataFrame) -> DataFrame:
    """The rows (gram, sid, c) of wide buckets as (gram, x, y, asks, sid, c): in each bucket the classes outside
    its largest component ask, in blocks y, and all classes are held against them, in blocks x.

    A task meets about BLOCK of either, however wide the bucket is; a class is copied once for each
    block of the other side, and those that ask are few once stars have joined the rest."""
    size = wide.groupBy("gram", "c").agg(F.count("*").alias("k"))
    largest = size.groupBy("gram").agg(F.max(F.struct("k", "c")).alias("main"), F.sum("k").alias("many"))
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK).cast("long"), F.lit(1).cast("long"))
    largest = largest.select("gram", F.col("main.c").alias("main"), blocks(F.col("many")).alias("xs"), blocks(F.col("many") - F.col("main.k")).alias("ys"))
    rows = wide.select("gram", "sid", "c").join(largest, "gram")
    all_ = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("sid"), F.col(n))
    members = rows.select("gram", own("xs").alias("x"), all_("ys").alias("y"), F.lit(False).alias("asks"), "sid", "c")
    strays = rows.where("c <> main").select("gram", all_("xs").alias("x"), own("ys").alias("y"), F.lit(True).alias("asks"), "sid", "c")
    return members.unionByName(strays)


def feasible(wide: DataFrame, classes: DataFrame) -> DataFrame:
    """(gram, sid) of the rows of wide buckets that have, by their sketches, a possible partner in another component there."""

    def meet(data):
        asks = data.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        sid, c, n = (data.column(k).to_numpy() for k in ("sid", "c", "n"))
        sketches = [unsketched(x) for x in data.column("sketch").to_pylist()]
        # A first look with the least number of bits, all members at once.
        sizes = np.array([[f[0] for f in s] for s in sketches], np.int64).reshape(len(sid), -1)
        low = np.array([[folded(f[2], f[1], SKETCH[0]) for f in s] for s in sketches], np.uint64).reshape(len(sid), -1)
        members, found = np.flatnonzero(~asks), set()
        for k in np.flatnonzero(asks) if len(members) else ():
            apart = np.bitwise_count(low[members] ^ low[k]).astype(np.int64)
            best = np.minimum(np.minimum(sizes[members], sizes[k]), (sizes[members] + sizes[k] - apart) // 2).sum(1)
            near = members[enough(best, n[members], n[k]) & (c[members] != c[k])]
            near = [r for r in near.tolist() if enough(most_shared(sketches[k], sketches[r]), int(n[k]), int(n[r]))]
            if near:
                found.update(near, [int(k)])
        rows = sorted(found)
        return pa.table({"gram": pa.array([data.column("gram")[r].as_py() for r in rows], pa.int64()), "sid": pa.array(sid[rows], pa.int64())})

    met = dealt(wide).join(classes.select("sid", "n", "sketch").hint("merge"), "sid")
    return met.groupBy("gram", "x", "y").applyInArrow(meet, "gram long, sid long").distinct()


def block_links(wide: DataFrame, parts: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the components of wide buckets (gram, sid, c).

    A task of dealt() counts the overlaps of its blocks in each fragment apart. It returns links
    that join two components it had not joined before, so that what comes out grows with the
    number of components, and no pairs are made as rows."""
    sets = parts.groupBy("sid").agg(F.collect_list(F.struct("fragment", "grams")).alias("cuts"))
    rows = dealt(wide).join(classes.select("sid", "n").hint("merge"), "sid").join(sets.hint("merge"), "sid")

    def link(data):
        asks = np.array(data.column("asks").to_pylist(), bool)
        sid, c, n = (data.column(k).to_numpy() for k in ("sid", "c", "n"))
        cuts = [{x["fragment"]: np.array(x["grams"], np.int64) for x in row} for row in data.column("cuts").to_pylist()]
        askers = np.flatnonzero(asks)
        index = {}
        for f in range(FRAGMENTS):
            held = [(k, cuts[r][f]) for k, r in enumerate(askers) if f in cuts[r]]
            if held:
                flat, owner = np.concatenate([g for _, g in held]), np.repeat([k for k, _ in held], [len(g) for _, g in held])
                order = np.argsort(flat, kind="stable")
                index[f] = flat[order], owner[order]
        root: dict[int, int] = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for r in np.flatnonzero(~asks) if len(askers) else ():
            shared = np.zeros(len(askers), np.int64)
            for f, own in cuts[r].items():
                if f in index:
                    flat, owner = index[f]
                    low, high = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
                    size = high - low
                    shared += np.bincount(owner[np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())], minlength=len(askers))
            near = (c[askers] != c[r]) & enough(shared, n[askers], n[r])
            for k in askers[near]:
                a, b = find(int(c[k])), find(int(c[r]))
                if a != b:
                    root[a] = b
                    out.append((int(min(sid[k], sid[r])), int(max(sid[k], sid[r]))))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return rows.groupBy("gram", "x", "y").applyInArrow(link, "a long, b long").distinct()


def similarity_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links of similarity >= 0.8) and text_hash of every row.

    Documents with equal sets are one class, represented once. A pair of classes is looked at only
    if they share a prefix n-gram and their sizes and places allow the similarity. Within such a
    bucket nothing is paired that is already linked: rounds of stars join each class to one hub of
    its bucket, components are taken, and only classes of different components are paired at last.
    Of every pair the overlap is first bounded in each fragment of the order by sketches and, where
    the sum allows it, counted in each fragment and summed up, so no link between components is lost.

    Texts are never shuffled: the passes over them are narrow, and sets travel only of classes that
    such a pair has, found again through a filter of fixed size.

    Null, empty and white-space texts have an empty set and link with nothing; a null doc_id is
    null in the result, counts as smaller than all others while links are followed and gives its
    partners a null component_id; rows that repeat a doc_id with another text are judged apart;
    repeated rows are returned as often as they occur; an empty table gives no rows; other columns
    are ignored."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    rows = keyed(docs)
    described = scratch.save(describe(rows), "described")
    order = spark.sparkContext.broadcast(Order(gathered(described.where("kind = 1").select(F.col("doc").alias("part"), F.col("counts").alias("data")), np.uint32, CELLS, add_counts), FRAGMENTS))
    members = scratch.save(described.where("kind = 0").select("doc", "twin", "n", "key"), "members")
    scratch.drop("described")

    # Buckets of a prefix n-gram that at least two sets share.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = scratch.save(cut_sets(rows, order, parts), "cut")
    sets = cut.where("kind = 0").select("sid", "n", "doc", "key", "sketch")
    classes = sets.groupBy("key").agg(F.min(F.struct("sid", "n", "doc", "sketch")).alias("first"))
    classes = scratch.save(classes.select("first.sid", "first.n", "first.doc", "key", "first.sketch"), "classes")
    # A set that several tasks met has one number from here on.
    named = sets.select(F.col("sid").alias("own"), "key").join(classes.select("key", "sid", "n").hint("merge"), "key").select("own", "sid", "n")
    hot = cut.where("kind = 2").select("gram", "sid", "at")
    often = hot.groupBy("gram").agg(F.count("*").alias("many")).where("many > 1").select("gram")
    both = scratch.save(shared_grams(cut, parts).unionByName(hot.join(often, "gram").select("gram", "sid", "at")), "shared")
    bucket = scratch.save(both.withColumnRenamed("sid", "own").join(named.hint("merge"), "own").select("gram", "sid", F.col("n").cast("int").alias("n"), "at"), "buckets")
    scratch.drop("cut", "shared")

    unique = unique_ids(members.select(F.col("doc").alias("doc_id")))

    def have(parts: DataFrame | None, sids: DataFrame, name: str) -> DataFrame:
        """parts with the segments of these classes too."""
        missing = sids if parts is None else sids.join(parts.select("sid"), "sid", "left_anti")
        wanted = scratch.save(missing.join(classes.select("sid", "doc", "key").hint("merge"), "sid"), f"{name}-wanted")
        if wanted.isEmpty():
            return wanted.select("sid", F.lit(0).alias("fragment"), F.array().cast("array<long>").alias("grams")) if parts is None else parts
        bits = spark.sparkContext.broadcast(filter_of(wanted))
        found = segments(rows, order, bits).join(wanted.select("sid", "key").hint("merge"), "key")
        # Where doc_ids repeat, several tasks may meet a set.
        more = scratch.save((found if unique else found.dropDuplicates(["sid", "fragment"])).select("sid", "fragment", "grams"), name)
        bits.unpersist()
        return more if parts is None else parts.unionByName(more)

    links = tested = roots = parts = None
    for turn in range(STARS + 1):
        if roots is None:
            placed = bucket.withColumn("c", F.col("sid"))
        else:
            # Only buckets that still hold several components go on.
            placed = bucket.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("c", F.coalesce("root", "sid")).drop("root")
            mixed = placed.groupBy("gram").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("gram")
            placed = bucket = scratch.save(placed.join(mixed, "gram"), f"placed-{turn}")
            bucket = bucket.drop("c")
        last = turn == STARS
        # Each bucket's hub is another one by chance, so that whoever shares many buckets meets many hubs; at first it is
        # the smallest, which all copies of a text have in common.
        chance = F.col("sid") if turn == 0 else F.xxhash64("sid", "gram", F.lit(turn))
        if not last:
            hubs = placed.groupBy("gram").agg(F.min(F.struct(chance.alias("chance"), "c", "sid", "n", "at")).alias("hub"))
            pairs = placed.join(hubs, "gram").where("c <> hub.c").select("sid", "n", "at", F.col("hub.sid").alias("other"), F.col("hub.n").alias("m"), F.col("hub.at").alias("on"))
        else:
            sized = placed.groupBy("gram").agg(F.count("*").alias("many"))
            wide = scratch.save(placed.join(sized.where(F.col("many") > WIDE), "gram").select("gram", "sid", "c").distinct(), "wide")
            if not wide.isEmpty():
                near = scratch.save(feasible(wide, classes), "feasible")
                wide = scratch.save(wide.join(near, ["gram", "sid"]), "wide-near")
                parts = have(parts, wide.select("sid").distinct(), "segments-wide")
                found = scratch.save(block_links(wide, parts, classes), "links-wide")
                links = found if links is None else links.unionByName(found)
            open_ = placed.join(sized.where(F.col("many") <= WIDE).select("gram"), "gram")
            pairs = near_pairs(open_, classes)
        if not last:
            pairs = pairs.where(possible("n", "m", "at", "on")).select(F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.save(pairs.select("a", "b", "n", "m") if last else sketched(pairs, classes), f"pairs-{turn}")
        parts = have(parts, pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), f"segments-{turn}")
        found = scratch.save(verified(pairs, parts), f"links-{turn}")
        links = found if links is None else links.unionByName(found)
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        # What is joined already goes on as one edge a class.
        roots = components(scratch, links, f"components-{turn}")
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    scratch.drop("buckets", "segments-wide", *(f"{x}-{k}" for k in range(STARS + 1) for x in ("segments", "placed", "pairs")))

    reached = classes.select("sid", "key").join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").select("key", F.coalesce("root", "sid").alias("root"))
    # The least document of each class is aggregated first, so that a group of copies moves as one row a task.
    least = members.where("n > 0").groupBy("key").agg(F.min("doc").alias("doc")).join(reached, "key")
    named = reached.join(least.groupBy("root").agg(F.min("doc").alias("component")), "root").select("key", "component")
    out = members.join(named, "key", "left").withColumn("component", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc")))
    return out.select(real_id().alias("doc_id"), F.col("n").alias("n_shingles"), real_id("component").alias("component_id"), F.col("twin").alias("text_hash"))
