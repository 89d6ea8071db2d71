"""Near-duplicates by SetSketch: truncated, exponentially spaced minima of shingle sets.

A register holds floor(1 - log_b(min of exponential hashes)), cut to 0..255: the register of a
union is the maximum of the registers, so sketches merge, and equal registers grow with the
overlap, so bands of registers find candidates. Candidates' overlap is then estimated from the
numbers of larger, equal and smaller registers by maximum likelihood, and those that the
estimate doesn't rule out are compared on their full sets.

Groups of alike texts are not multiplied out. Texts with equal sets count as one node. In each
band bucket every node is compared with the bucket's smallest and largest node; what that links
is one component, and only nodes of a bucket that are still apart are compared with each other,
if a finer signature of their sets, compared within the join, doesn't rule the pair out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, settle, without
from .components import components
from .shingles import shingle_sets

REGISTERS, ROWS = 160, 5
BASE, RATE = 1.1, 20.0
#: How far below the threshold an estimate may lie before a pair is ruled out; about six deviations.
MARGIN = 0.2
_MULTS = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 512
#: Bins of the fine signature, a power of two; deviations of its estimate below the threshold at which a pair is ruled out.
BINS, DEVIATIONS = 4096, 6.0
#: Sets of this size and less are compared in full within a bucket; larger ones by their fine signatures first.
SMALL = 512
#: Rows of a bucket that are compared with each other at a time.
CELL = 256


def sketch(x: np.ndarray) -> np.ndarray:
    """Per register the least hash of the set's values; exact minima, so independent of order."""
    low = np.full(REGISTERS, ~np.uint64(0))
    with np.errstate(over="ignore"):
        for k in range(0, len(x), _STEP):
            y = _MULTS[:, None] * x[None, k : k + _STEP]
            y ^= y >> np.uint64(32)
            np.minimum(low, (y * np.uint64(0x9E3779B97F4A7C15)).min(axis=1), out=low)
    return low


def registers(low: np.ndarray) -> np.ndarray:
    """SetSketch registers of least hashes."""
    u = (low.astype(np.float64) + 0.5) / 2.0**64
    e = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(e, 1e-300)) / np.log(BASE)), 0, 255).astype(np.uint8)


def fine(x: np.ndarray) -> np.ndarray:
    """Bits of a sorted set by the least value of each bin: whether there is one, and two bits of it, as longs.

    A value has one bin, so this costs one pass, and small sets are all but fully told by it.
    """
    bins = (x >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    planes = np.zeros((3, BINS), bool)
    with np.errstate(over="ignore"):
        low = x[first] * np.uint64(0x9E3779B97F4A7C15)
    planes[0, bins[first]] = True
    planes[1, bins[first]] = (low >> np.uint64(61)) & np.uint64(1)
    planes[2, bins[first]] = (low >> np.uint64(60)) & np.uint64(1)
    return np.packbits(planes, axis=1).reshape(-1).view(np.int64)


def fine_estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity of fine signatures, and how many bins it comes from: equal bins, less the quarter of unequal ones that agree by chance."""
    w = BINS // 64
    both = a[..., :w] & b[..., :w]
    agree = both & ~((a[..., w : 2 * w] ^ b[..., w : 2 * w]) | (a[..., 2 * w :] ^ b[..., 2 * w :]))
    either, both, agree = (np.bitwise_count(x).sum(axis=-1, dtype=np.int64) for x in (a[..., :w] | b[..., :w], both, agree))
    return (4 * agree - both) / (3 * np.maximum(either, 1)), either


def fine_near(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether fine signatures leave a similarity of `percent` possible: the fewer bins, the less they rule out."""
    estimate, bins = fine_estimate(a, b)
    t = percent / 100
    return estimate >= t - DEVIATIONS * 4 / 3 * np.sqrt(t * (1 - t) / np.maximum(bins, 1)) - 0.01


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def joint_estimate(n_a: np.ndarray, n_b: np.ndarray, more: np.ndarray, less: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Jaccard similarity of most likelihood, given the sizes and how many registers of a are more, less, equal."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)

    def likely(j: np.ndarray) -> np.ndarray:
        p, q = _p(u - v * j), _p(v - u * j)
        return more * np.log(np.maximum(p, 1e-12)) + less * np.log(np.maximum(q, 1e-12)) + equal * np.log(np.maximum(1 - p - q, 1e-12))

    for _ in range(40):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        rise = likely(a) < likely(b)
        lo, hi = np.where(rise, a, lo), np.where(rise, hi, b)
    return (lo + hi) / 2


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, regs): the size of the shingle set, a digest of the whole set, its registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, low = [], [], []
            for x in shingle_sets(batch.column("text").to_pylist(), k):
                n.append(len(x))
                keys.append(hashlib.md5(x.tobytes()).digest() if len(x) else None)
                low.append(sketch(x))
            regs = registers(np.stack(low)) if low else np.zeros((0, REGISTERS), np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary())],
                ["doc_id", "n_shingles", "set_key", "regs"],
            )

    return _slim(docs).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, regs binary")


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _bands(nodes: DataFrame) -> DataFrame:
    """(key, node, n), a row for each band; the key holds the band's number and registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_bands = REGISTERS // ROWS
        for batch in batches:
            if not batch.num_rows:
                continue
            r = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint8).reshape(-1, n_bands, ROWS).astype(np.int64)
            key = np.zeros(r.shape[:2], np.int64) + np.arange(n_bands)
            for i in range(ROWS):
                key = (key << 8) | r[:, :, i]
            cols = [np.repeat(batch.column(c).to_numpy(), n_bands) for c in ("node", "n")]
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *map(pa.array, cols)], ["key", "node", "n"])

    return nodes.select("node", "n", "regs").mapInArrow(run, "key long, node long, n long")


def _near_size(a: Column, b: Column, percent: int) -> Column:
    """Sets whose sizes differ more can't be similar enough."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _estimated(pairs: DataFrame, percent: int) -> DataFrame:
    """Of (u, v, nu, nv, ru, rv) the pairs (u, v) whose estimate doesn't rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("ru", "rv"))
            nu, nv = (batch.column(c).to_numpy().astype(float) for c in ("nu", "nv"))
            j = joint_estimate(nu, nv, (a > b).sum(axis=1), (a < b).sum(axis=1), (a == b).sum(axis=1))
            yield batch.select(["u", "v"]).filter(pa.array(j >= percent / 100 - MARGIN))

    return pairs.select("u", "v", "nu", "nv", "ru", "rv").mapInArrow(run, "u long, v long")


def _fine_rows(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, fine, small): small sets in full, larger ones as signatures; those near SMALL as both, as they meet either kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, small, none = [], [], np.zeros(0, np.int32)
            for x in shingle_sets(batch.column("text").to_pylist(), k):
                bits.append(fine(x) if 100 * len(x) >= percent * SMALL else np.zeros(3 * BINS // 64, np.int64))
                small.append(np.unique((x >> np.uint64(32)).astype(np.uint32)).view(np.int32) if percent * len(x) <= 100 * SMALL else none)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(bits, pa.list_(pa.int64())), pa.array(small, pa.list_(pa.int32()))], ["node", "fine", "small"]
            )

    return texts.select("doc_id", "text").mapInArrow(run, "node long, fine array<long>, small array<int>")


def _shared_bits(small: np.ndarray) -> np.ndarray:
    """Rows of bits, one for each value that two or more of the sets hold."""
    owner = np.repeat(np.arange(len(small)), [len(x) for x in small])
    if not len(owner):
        return np.zeros((len(small), 1), np.uint64)
    _, value, count = np.unique(np.concatenate(small), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    twice = count[value] > 1
    bits = np.zeros((len(small), (int(number[-1]) // 64 + 1) * 64), bool)
    bits[owner[twice], number[value[twice]]] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def _apart(rows: DataFrame, percent: int) -> DataFrame:
    """Of (key, parts, node, n, component, fine, regs, small) the pairs (u, v, nu, nv) of a bucket, of two components, that may be similar.

    A bucket is cut into parts, and each two of them meet in a cell of their own, so that no task
    holds a whole bucket. Cells lie together in a sorted partition; a few hundred rows are held at a time.
    """
    cells = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cells = cells.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "n", "component", "fine", "regs", "small")
    cells = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def compare(key: np.ndarray, part: np.ndarray, node: np.ndarray, n: np.ndarray, component: np.ndarray, bits: np.ndarray, regs: np.ndarray, small: np.ndarray) -> list[np.ndarray]:
        full = _shared_bits(small)
        lost = n - np.array([len(x) for x in small])
        whole = percent * n <= 100 * SMALL
        out, band = [], int(key[0]) >> 8 * ROWS
        for a in range(len(node) - 1):
            ok = (component[a + 1 :] != component[a]) & (100 * np.minimum(n[a + 1 :], n[a]) >= percent * np.maximum(n[a + 1 :], n[a]))
            if part[0] != part[-1] or (part != part[0]).any():
                ok &= part[a + 1 :] != part[a]
            to = a + 1 + np.flatnonzero(ok)
            if len(to):
                exact = whole[to] & whole[a]
                rough = to[~exact]
                rough = rough[fine_near(bits[rough], bits[a], percent)]
                to = to[exact]
                # values are cut to 32 bits: what a set lost by that bounds what the overlap lost
                both = np.bitwise_count(full[to] & full[a]).sum(axis=1, dtype=np.int64) + np.minimum(lost[to], lost[a])
                to = np.concatenate([to[100 * both >= percent * (n[to] + n[a] - both)], rough])
                # of the bands that a pair shares the first one yields it
                to = to[~(regs[to, :band] == regs[a, :band]).all(axis=2).any(axis=1)]
                lower = node[a] < node[to]
                pair = [np.full(len(to), node[a]), node[to], np.full(len(to), n[a]), n[to]]
                out.append(np.stack([np.where(lower, pair[k], pair[m]) for k, m in ((0, 1), (1, 0), (2, 3), (3, 2))]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        names = ["u", "v", "nu", "nv"]

        def pack(found: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(found, axis=1)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_numpy() for c in ("key", "i", "j", "part", "node", "n", "component")]
            now.append(batch.column("fine").flatten().to_numpy().reshape(batch.num_rows, -1))
            now.append(np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint8).reshape(batch.num_rows, -1, ROWS))
            lists = batch.column("small")
            small = np.empty(batch.num_rows, object)
            for i, x in enumerate(np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1])):
                small[i] = x
            now.append(small)
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            cut = np.flatnonzero((np.diff(now[0]) != 0) | (np.diff(now[1]) != 0) | (np.diff(now[2]) != 0)) + 1
            bounds = [0, *cut.tolist()]
            found = []
            for a, z in zip(bounds[:-1], bounds[1:], strict=True):
                found += compare(now[0][a:z], *[x[a:z] for x in now[3:]])
            held = [x[bounds[-1] :] for x in now]
            if found:
                yield pack(found)
        if held is not None and (found := compare(held[0], *held[3:])):
            yield pack(found)

    return cells.mapInArrow(run, "u long, v long, nu long, nv long")


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of the pairs (u, v) those whose full sets are similar enough."""
    left = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("tu"))
    right = texts.select(F.col("doc_id").alias("v"), F.col("text").alias("tv"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = shingle_sets(batch.column("tu").to_pylist(), k)
            b = shingle_sets(batch.column("tv").to_pylist(), k)
            keep = []
            for x, y in zip(a, b, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(len(x) and len(y) and 100 * both >= percent * (len(x) + len(y) - both)))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "u").join(right, "v").select("u", "v", "tu", "tv").mapInArrow(run, "u long, v long").distinct()


def link_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text).

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of k-word
    shingles; component_id is the smallest doc_id reachable. A null text is an empty one. Texts
    without words are linked with nothing. Rows that share an id are one document, linked by any
    of its texts. Rows without an id are linked with nothing: component_id is null, kept is true.
    """
    sig = settle(signatures(docs, k), "signatures")
    some = sig.where("n_shingles > 0 and doc_id is not null")
    nodes = settle(
        some.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs")), "nodes"
    )
    bands = _bands(nodes)
    pivots = bands.groupBy("key").agg(F.min(F.struct("node", "n")).alias("lo"), F.max(F.struct("node", "n")).alias("hi")).where("lo.node < hi.node")
    met = settle(bands.join(pivots, "key").select("key", "node", "n", "lo", "hi"), "met")
    texts = settle(_slim(docs).join(met.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi"), "texts")
    regs = nodes.select("node", "regs")

    to_pivot = met.select("node", "n", F.explode(F.array("lo", "hi")).alias("p")).where(F.col("p.node") != F.col("node")).where(_near_size(F.col("n"), F.col("p.n"), percent))
    first, second = F.col("node") < F.col("p.node"), F.col("p.node")
    star = to_pivot.select(
        F.when(first, F.col("node")).otherwise(second).alias("u"), F.when(first, second).otherwise(F.col("node")).alias("v"),
        F.when(first, F.col("n")).otherwise(F.col("p.n")).alias("nu"), F.when(first, F.col("p.n")).otherwise(F.col("n")).alias("nv"),
    ).distinct()
    star = star.join(regs.select(F.col("node").alias("u"), F.col("regs").alias("ru")), "u").join(regs.select(F.col("node").alias("v"), F.col("regs").alias("rv")), "v")
    links = settle(_confirmed(_estimated(star, percent), texts, k, percent), "links")
    found = settle(components(links), "components")

    # what is still apart within a bucket
    now = met.select("key", "node", "n").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = now.groupBy("key").agg(F.min("component").alias("c_lo"), F.max("component").alias("c_hi"), F.count(F.lit(1)).alias("size")).where("c_lo < c_hi")
    split = split.select("key", F.ceil(F.col("size") / CELL).alias("parts"))
    apart = settle(now.join(split, "key"), "apart")
    bits = _fine_rows(texts.join(apart.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi"), k, percent).join(regs, "node")
    rest = _apart(apart.join(bits, "node"), percent).distinct()
    rest = rest.join(regs.select(F.col("node").alias("u"), F.col("regs").alias("ru")), "u").join(regs.select(F.col("node").alias("v"), F.col("regs").alias("rv")), "v")
    more = settle(_confirmed(_estimated(rest, percent), texts, k, percent), "more")
    if more.limit(1).count():
        stars = found.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
        found = settle(components(stars.unionByName(more)), "components")

    by_key = nodes.select(F.col("set_key").alias("k"), "node").join(found, "node", "left").select("k", F.coalesce("component", "node").alias("c"))
    # a document with several texts reaches the least of their components
    out = sig.select("doc_id", "n_shingles", "set_key").join(by_key, F.col("set_key") == F.col("k"), "left")
    return out.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.least("doc_id", F.coalesce("c", "doc_id"))).alias("component_id"),
    ).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs but for near-duplicates: of each group the smallest id stays, in the columns of docs, whatever others are called.

    Rows that share an id, and rows without one, are told apart by their texts: only what these have
    in common links them. Of rows with the same id (or none) and text one stays, by a hash of all
    its columns; rows with neither stay. docs is read more than once.
    """
    key = F.col("doc_id").cast("long")
    if not docs.groupBy(key.alias("i")).agg(F.count(F.lit(1)).alias("n")).where("i is null or n > 1").limit(1).count():
        # what goes is less than what stays
        gone = link_components(docs, k, percent).where("not kept").select(F.col("doc_id").alias("k"))
        return without(docs, key, gone)
    rows = boxed(docs, key.alias("i"), F.sha2(F.col("text").cast("string"), 256).alias("t"), F.col("text").cast("string").alias("text"))
    some, none = rows.where("i is not null or t is not null"), rows.where("i is null and t is null").select("row")
    # numbers of distinct (id, text) in the order of the ids
    named = some.select("i", "t", "text").dropDuplicates(["i", "t"]).orderBy(F.col("i").asc_nulls_last(), "t")
    named = settle(named.select(F.monotonically_increasing_id().alias("doc_id"), "i", "t", "text"), "named")
    kept = link_components(named.select("doc_id", "text"), k, percent).where("kept").select("doc_id")
    won = named.join(kept, "doc_id", "left_semi").select(F.col("doc_id").alias("n"), F.col("i").alias("wi"), F.col("t").alias("wt"))
    found = some.join(won, F.col("i").eqNullSafe(F.col("wi")) & F.col("t").eqNullSafe(F.col("wt")))
    one = found.groupBy("n").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row")
    return one.union(none).select("row.*")
