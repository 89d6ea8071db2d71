"""Benchmark decontamination by spaced-seed hashing, native expressions only.

A mask such as 1110111 is laid over a text's tokens at every position; the tokens under its ones
are hashed, those under its zeros ignored, so a substituted token hides only the positions at
which a one lies on it. Hashes of benchmark and documents are joined, and each hit fixes an
alignment (document position minus item position). The aligned tokens around it are compared, and
the stretch with the most equal tokens that keeps the wanted identity is the overlap.

The three masks together meet every window of 13 to 25 tokens of which 8 in 10 are equal (the
tests enumerate them), and every overlap that the defaults accept has such a window, so nothing
is lost between the join and the comparison. Items under SHORT tokens are too short for these
masks. Of such an item n tokens an overlap has `need` or more, in n - need + 1 runs at most, so
runs of ceil(need / (n - need + 1)) tokens find every overlap that the comparison accepts; they
are laid over texts only if there are such items.

Documents are never shuffled before they have hit: positions meet the benchmark's hashes by a
broadcast whose size is counted first. A benchmark of more than MOST_SEEDS hashes is dealt into
groups, and each group has a pass of its own.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, settle, without

MASKS = ("1110111", "11001001011", "11000101011")
MIN_TOKENS = 13
IDENTITY = 0.8
#: Items with fewer tokens are found by runs instead of masks.
SHORT = 13
#: Hashes that are broadcast at once, some 60 bytes each.
MOST_SEEDS = 1 << 19
#: Shares of identity are compared as whole numbers.
_SCALE = 1_000_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _once(value: Column) -> Column:
    """A generator of one row: predicates aren't pushed through it, which would compute the value anew."""
    return F.explode(F.array(value))


def _run(n: int, min_tokens: int, identity: float) -> int:
    """Tokens in the longest run that any accepted overlap with an item of n tokens has at least."""
    need = max(1, ceil(min(min_tokens, identity * n) - 1e-9))
    return ceil(need / (n - need + 1))


def _seed(th: Column, pos: Column, mask: Column, masks: list[str]) -> Column:
    """The hash under the mask of that number at a position; null where it doesn't fit."""
    out = F.lit(None).cast("long")
    for m, shape in enumerate(masks):
        under = F.xxhash64(F.lit(m), *[F.get(th, pos + k) for k, bit in enumerate(shape) if bit == "1"])
        out = F.when((mask == m) & (pos >= 0) & (pos + len(shape) <= F.size(th)), under).otherwise(out)
    return out


def _items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cls, ih, n): distinct token sequences; (cls, item_id): the items that have them."""
    item = benchmark.select("item_id", F.transform(tokens(F.col("text")), lambda x: F.xxhash64(x)).alias("ih")).where(F.size("ih") > 0)
    item = settle(item.select("item_id", "ih", F.size("ih").alias("n"), F.xxhash64("ih").alias("cls")), "items")
    return item.select("cls", "ih", "n").dropDuplicates(["cls"]), item.select("cls", "item_id").distinct()


def _item_seeds(item: DataFrame, masks: list[str], fits: list[Column]) -> DataFrame:
    """(seed, mask, cls, item_pos, before): the hashes of items, each with the one at the position before it."""
    mask = F.explode(F.array(*[F.when(fit, F.lit(m)) for m, fit in enumerate(fits)])).alias("mask")
    at = item.select("cls", "ih", mask).where("mask is not null").select("cls", "ih", "mask", F.explode(F.sequence(F.lit(0), F.size("ih") - 1)).alias("item_pos"))
    pos, m = F.col("item_pos"), F.col("mask")
    return at.select(_seed(F.col("ih"), pos, m, masks).alias("seed"), "mask", "cls", "item_pos", _seed(F.col("ih"), pos - 1, m, masks).alias("before")).where("seed is not null")


def _stretch(first: Column, last: Column, wrong: Column, identity: float) -> Column:
    """(hits, from, to): of the stretches of first..last - 1 that keep the identity the one with the most equal tokens.

    `wrong` holds the unequal positions in order. A stretch begins after a wrong position (or at
    first) and ends before one (or at last). With gain for equal and loss for unequal tokens, it
    keeps the identity if the sum at its end isn't below that at its begin. So in the order of
    these sums, the best begin for an end is the smallest position seen so far.
    """
    gain, loss = round((1 - identity) * _SCALE), round(identity * _SCALE)
    gain, loss = gain // gcd(gain, loss), loss // gcd(gain, loss)

    def mark(end: int, pos: Column, hits: Column, misses: Column) -> Column:
        return F.struct((hits.cast("long") * gain - misses.cast("long") * loss).alias("sum"), F.lit(end).alias("end"), pos.alias("pos"), hits.alias("hits"))

    none = F.lit(None).cast("struct<sum:bigint,end:int,pos:int,hits:int>")
    n = F.size(wrong)
    hits = lambda w, j: w - first - j
    zero = F.lit(0)
    begins = F.transform(wrong, lambda w, j: F.when((w + 1 < last) & (F.coalesce(F.get(wrong, j + 1), F.lit(-1)) != w + 1), mark(0, w + 1, hits(w, j), j + 1)).otherwise(none))
    ends = F.transform(wrong, lambda w, j: F.when((w > first) & (F.coalesce(F.get(wrong, j - 1), F.lit(-1)) != w - 1), mark(1, w, hits(w, j), j)).otherwise(none))
    edges = F.array(
        F.when(F.coalesce(F.get(wrong, zero), F.lit(-1)) != first, mark(0, first, zero, zero)).otherwise(none),
        F.when(F.coalesce(F.get(wrong, n - 1), F.lit(-1)) != last - 1, mark(1, last, last - first - n, n)).otherwise(none),
    )
    marks = F.array_sort(F.filter(F.concat(begins, ends, edges), lambda x: x.isNotNull()))
    start = F.struct(F.lit(2**31 - 1).alias("low"), F.lit(0).alias("low_hits"), F.lit(0).alias("hits"), F.lit(0).alias("from"), F.lit(0).alias("to"))

    def step(a: Column, x: Column) -> Column:
        lower = (x["end"] == 0) & (x["pos"] < a["low"])
        better = (x["end"] == 1) & (x["pos"] > a["low"]) & (x["hits"] - a["low_hits"] > a["hits"])
        return F.struct(
            F.when(lower, x["pos"]).otherwise(a["low"]).alias("low"), F.when(lower, x["hits"]).otherwise(a["low_hits"]).alias("low_hits"),
            F.when(better, x["hits"] - a["low_hits"]).otherwise(a["hits"]).alias("hits"),
            F.when(better, a["low"]).otherwise(a["from"]).alias("from"), F.when(better, x["pos"]).otherwise(a["to"]).alias("to"),
        )

    return F.aggregate(marks, start, step, lambda a: F.struct(a["hits"], a["from"], a["to"]))


def _overlaps(d: DataFrame, item: DataFrame, seeds: DataFrame, masks: list[str], min_tokens: int, identity: float) -> DataFrame:
    """Of documents (doc_id, th) and a group of items the accepted overlaps (doc_id, cls, matched, overlap, doc_pos, item_pos)."""
    at = d.select("doc_id", "th", F.explode(F.when(F.size("th") > 0, F.sequence(F.lit(0), F.size("th") * len(masks) - 1))).alias("x"))
    at = at.select("doc_id", "th", F.expr(f"x div {len(masks)}").cast("int").alias("pos"), (F.col("x") % len(masks)).alias("m"))
    # never null, or a filter for nulls would compute it a second time
    hit = at.select("*", F.coalesce(_seed(F.col("th"), F.col("pos"), F.col("m"), masks), F.lit(0)).alias("seed")).join(seeds, "seed")
    # neighbouring hits of one alignment: the first stands for all of them
    hit = hit.where(F.col("before").isNull() | ~F.col("before").eqNullSafe(_seed(F.col("th"), F.col("pos") - 1, F.col("mask"), masks)))
    pair = hit.select("doc_id", "th", "cls", (F.col("pos") - F.col("item_pos")).alias("shift")).join(item, "cls")
    shift, size = F.col("shift"), F.size("ih")
    pair = pair.select("doc_id", "cls", "shift", "ih", "n", F.greatest(F.lit(0), -shift).alias("first"), F.least(size, F.size("th") - shift).alias("last"), F.slice("th", F.greatest(F.lit(1), shift + 1), size).alias("part"))
    first, last = F.col("first"), F.col("last")
    wrong = F.filter(F.sequence(first, last - 1), lambda i: F.get("ih", i) != F.get("part", i - first))
    pair = pair.select("doc_id", "cls", "shift", "n", "first", "last", _once(wrong).alias("wrong"))
    pair = pair.select("doc_id", "cls", "shift", "n", _once(_stretch(first, last, F.col("wrong"), identity)).alias("s"))
    found = pair.where(F.col("s.hits") >= F.least(F.lit(float(min_tokens)), F.lit(identity) * F.col("n") - 1e-9))
    return found.select("doc_id", "cls", F.col("s.hits").alias("matched"), (F.col("s.to") - F.col("s.from")).alias("overlap"), (F.col("s.from") + F.col("shift")).alias("doc_pos"), F.col("s.from").alias("item_pos"))


def matches(
    docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_tokens: int = MIN_TOKENS, identity: float = IDENTITY, most_seeds: int = MOST_SEEDS
) -> DataFrame:
    """Verified overlaps: one row per (doc_id, item_id) with the one that has the most equal tokens.

    doc_id, item_id, doc_pos, item_pos (token positions of the overlap), overlap (its tokens),
    matched (equal ones among them). An overlap counts if it has `identity` or more equal tokens
    and at least min(min_tokens, identity * item length) of them; with the defaults all are found.
    Null and empty texts, and items without tokens, match nothing; null ids are ids like others.
    Repeated rows count once, a text that several items share is compared once; rows that share an
    id are one document, with the best overlap of any of its texts. Empty tables give no rows, and
    other columns, whatever their names, are not looked at.
    """
    item, members = _items(benchmark)
    # under SHORT lengths, whatever the size of the benchmark
    short = sorted(r["n"] for r in item.where(F.col("n") < SHORT).select("n").distinct().collect())
    runs = {n: _run(n, min_tokens, identity) for n in short}
    kinds = sorted(set(runs.values()))
    shapes = [*masks, *("1" * r for r in kinds)]
    fits = [F.col("n") >= SHORT for _ in masks] + [F.col("n").isin(*[n for n in short if runs[n] == r]) for r in kinds]
    seeds = settle(_item_seeds(item, shapes, fits), "seeds")
    groups = max(1, -(-seeds.count() // most_seeds))
    # the largest group: beyond most_seeds by much only if a single item is; then the join is left to shuffle
    group = F.pmod(F.xxhash64("cls", F.lit(7)), F.lit(groups))
    sizes = {r["g"]: r["n"] for r in seeds.groupBy(group.alias("g")).agg(F.count(F.lit(1)).alias("n")).collect()} if groups > 1 else {0: 0}
    d = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.octet_length("text") > 0)
    d = d.select("doc_id", F.transform(tokens(F.col("text")), lambda x: F.xxhash64(x)).alias("th"))

    def part(g: int) -> DataFrame:
        send = F.broadcast if sizes.get(g, 0) <= 4 * most_seeds else lambda x: x
        mine, s = item.where(group == g), seeds.where(group == g)
        return _overlaps(d, send(mine.select("cls", "ih", "n")), send(s), shapes, min_tokens, identity)

    found = reduce(DataFrame.unionByName, [part(g) for g in range(groups)])
    best = found.groupBy("doc_id", "cls").agg(F.max(F.struct("matched", "overlap", (-F.col("doc_pos")).alias("d"), (-F.col("item_pos")).alias("i"))).alias("b"))
    named = best.join(members, "cls").groupBy("doc_id", "item_id").agg(F.max("b").alias("b"))
    return named.select("doc_id", "item_id", (-F.col("b.d")).alias("doc_pos"), (-F.col("b.i")).alias("item_pos"), F.col("b.overlap").alias("overlap"), F.col("b.matched").alias("matched"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs without a verified overlap, in the columns of docs, whatever others are called.

    All rows of an id go if one of its texts has an overlap; rows without an id go by their own
    texts. Null and empty texts stay. docs is read more than once.
    """
    key = F.when(F.col("doc_id").isNotNull(), F.concat(F.lit("i"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("t"), F.sha2("text", 256)))
    bad = matches(docs.select(key.alias("doc_id"), "text"), benchmark, **options).select(F.col("doc_id").alias("k")).distinct()
    return without(docs, key, bad)
