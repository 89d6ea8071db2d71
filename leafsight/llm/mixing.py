"""Mixing sources to target weights by Efraimidis-Spirakis sampling, native expressions only.

A source's target counts in words. Whole epochs of the source come first; the rest of the target
is drawn without replacement: each document has the key u^(1/w), u a hash of its identity and w
its quality weight, and the largest keys are taken until the words reach the rest. Keys are kept
as logarithms, ln(u) / w, as powers of small weights would all be 0.

Where a source's draw ends is found by histograms, each within the one bin of the histogram
before in which the words reach the rest, until that bin holds few rows; only these are sorted.
So each source comes down to the one row at which its draw ends, and whether a document is drawn
is told by comparing it with that row: texts are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, word_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_EPOCHS = 2
BINS = 1024
#: Rows of a source's last bin that are sorted at most, but for rows whose keys are equal.
SORTED = 100_000
#: Characters that prose has few of.
ODD = r"[0-9#{}<>|_=+*^~@$%&/\\\[\]]"


def quality(text: Column, size: Column) -> Column:
    """Weight in (0, 1] of a text of `size` words: prose has some six characters a word with its blank, few digits and signs, and more than a few words."""
    chars = F.coalesce(F.length(text), F.lit(0))
    mean = F.when(size > 0, chars / size).otherwise(F.lit(0.0))
    odd = F.when(chars > 0, F.regexp_count(text, F.lit(ODD)) / chars).otherwise(F.lit(0.0))
    long = F.least(F.lit(1.0), size / F.lit(50.0))
    return F.lit(1.0) / (F.lit(1.0) + F.abs(mean - F.lit(6.0)) / F.lit(6.0)) / (F.lit(1.0) + F.lit(4.0) * odd) * (F.lit(0.25) + F.lit(0.75) * long)


def draw(doc_id: Column, text_hash: Column, seed: int) -> Column:
    """Uniform in (0, 1), from a digest of the row's identity."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce(text_hash, F.lit("-"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """From (source, source_size): target by weight, none above `most` times its source's size.

    Raising one level L until the sum of min(cap, weight * L) is the total gives what resharing
    the excess by weight, again and again, ends at. Sources are ordered by cap / weight, so the
    capped ones are a prefix of that order. One row per source is all this sees: some hundred bytes
    each, sorted in one task, so a million sources are no trouble and a billion would be.
    """
    ws = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("__i", F.row_number().over(Window.orderBy(F.encode("source", "utf-8").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("__w", F.get(ws, (F.col("__i") % len(weights)).cast("int"))).withColumn("__cap", F.col("source_size") * float(most))
    everything = Window.partitionBy()
    ratio = F.col("__cap") / F.col("__w")
    order = Window.orderBy(ratio, "__i")
    ranked = (
        ranked.withColumn("__total", F.sum("source_size").over(everything) * float(share))
        .withColumn("__capped", F.coalesce(F.sum("__cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("__left", F.sum("__w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        # the level if this source and all behind it stay below their caps
        .withColumn("__level", (F.col("__total") - F.col("__capped")) / F.col("__left"))
        .withColumn("__open", F.col("__level") <= ratio)
        .withColumn("__final", F.min(F.when(F.col("__open"), F.struct(ratio.alias("r"), "__i", "__level"))).over(everything)["__level"])
    )
    target = F.least("__cap", F.when(F.col("__final").isNull(), F.col("__cap")).otherwise(F.col("__w") * F.col("__final")))
    return ranked.select("source", "source_size", target.alias("target"))


def _keyed(docs: DataFrame, seed: int, weight: Column | None, *more: Column) -> DataFrame:
    """(doc_id, source, text_hash, size, key) of every row, and what else is asked for."""
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.md5(F.col("text").cast("binary")).alias("text_hash"),
        word_count(F.col("text")).alias("size"),
        (quality(F.col("text"), word_count(F.col("text"))) if weight is None else weight.cast("double")).alias("weight"),
        *more,
    )
    return slim.withColumn("key", F.log(draw(F.col("doc_id"), F.col("text_hash"), seed)) / F.col("weight")).drop("weight")


def _ends(slim: DataFrame, weights: tuple[float, ...], share: float, most: int, bins: int, sort: int) -> DataFrame:
    """Per source (p_source): source_size, target, epochs, rest, and where its draw ends: key, (doc_id, text_hash), how many equal rows there are and how many of them are drawn."""
    spans = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("n"))
    targets = source_targets(spans.select("source", "source_size"), weights, share, most)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    targets = targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    spans = spans.select(F.col("source").alias("p_source"), "lo", "hi", "n", F.lit(0).cast("long").alias("before"))
    now = settle(targets.join(spans, F.col("source").eqNullSafe(F.col("p_source"))).drop("source"), "targets")
    inside = F.col("source").eqNullSafe(F.col("p_source")) & (F.col("key") >= F.col("lo")) & (F.col("key") <= F.col("hi"))
    names = now.columns
    wide = (F.col("rest") > 0) & (F.col("n") > sort) & (F.col("lo") < F.col("hi"))
    # each round leaves a bin of some n / bins rows, so ten to the ten rows take two or three
    while now.where(wide).limit(1).count():
        bin_ = F.least(F.lit(bins - 1), F.floor((F.col("hi") - F.col("key")) / (F.col("hi") - F.col("lo")) * bins).cast("int")).alias("bin")
        found = slim.join(now.where(wide).drop("n"), inside).select("p_source", bin_, "key", "size")
        found = found.groupBy("p_source", "bin").agg(F.sum("size").alias("words"), F.min("key").alias("b_lo"), F.max("key").alias("b_hi"), F.count(F.lit(1)).alias("b_n"))
        found = found.join(now.select(F.col("p_source").alias("o_source"), "rest", "before"), F.col("p_source").eqNullSafe(F.col("o_source")))
        up = Window.partitionBy("p_source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        found = found.withColumn("start", F.col("before") + F.coalesce(F.sum("words").over(up), F.lit(0))).where((F.col("start") < F.col("rest")) & (F.col("start") + F.col("words") >= F.col("rest")))
        found = found.select(F.col("p_source").alias("f_source"), "b_lo", "b_hi", "b_n", "start")
        next_ = now.join(found, F.col("p_source").eqNullSafe(F.col("f_source")), "left")
        for c, b in (("lo", "b_lo"), ("hi", "b_hi"), ("n", "b_n"), ("before", "start")):
            next_ = next_.withColumn(c, F.coalesce(b, c))
        now = settle(next_.select(*names), "spans")
    # equal rows count as one with its number
    tied = slim.join(now.where("rest > 0"), inside).groupBy("p_source", "key", "doc_id", "text_hash", "size").agg(F.count(F.lit(1)).alias("tied"), F.first("rest").alias("r"), F.first("before").alias("b"))
    along = Window.partitionBy("p_source").orderBy(F.desc("key"), "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    tied = tied.withColumn("start", F.col("b") + F.coalesce(F.sum(F.col("size") * F.col("tied")).over(along), F.lit(0))).where((F.col("start") < F.col("r")) & (F.col("start") + F.col("size") * F.col("tied") >= F.col("r")))
    # a document is drawn if that brings the words nearer to the rest than leaving it
    end = tied.select(
        F.col("p_source").alias("e_source"), F.col("key").alias("end_key"), F.struct(F.col("doc_id").alias("i"), F.col("text_hash").alias("h")).alias("end_row"),
        "tied", F.floor((F.col("r") - F.col("start")) / F.col("size") + 0.5).cast("long").alias("taken_of_tied"),
    )
    plan = now.join(end, F.col("p_source").eqNullSafe(F.col("e_source")), "left")
    return settle(plan.select("p_source", "source_size", "target", "epochs", "end_key", "end_row", "tied", "taken_of_tied"), "plan")


def _dealt(rows: DataFrame, plan: DataFrame, last: Column) -> DataFrame:
    """Rows with copies. Only where several equal rows stand at the end of a draw are they numbered, by `last`."""
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("p_source")))
    here = F.struct(F.col("doc_id").alias("i"), F.col("text_hash").alias("h"))
    level = F.coalesce(F.col("key") == F.col("end_key"), F.lit(False))
    above = F.coalesce(F.col("key") > F.col("end_key"), F.lit(False)) | (level & (here < F.col("end_row")))
    tie = level & (here == F.col("end_row"))
    several = tie & (F.col("tied") > 1)
    drawn = F.when(above, F.lit(1)).when(tie, F.col("taken_of_tied")).otherwise(F.lit(0))
    if not plan.where("tied > 1").limit(1).count():
        return rows.withColumn("copies", (F.col("epochs") + drawn).cast("long"))
    plain = rows.where(~several).withColumn("copies", (F.col("epochs") + drawn).cast("long"))
    number = F.row_number().over(Window.partitionBy("source", "doc_id", "text_hash").orderBy(last))
    tied = rows.where(several).withColumn("number", number).withColumn("copies", (F.col("epochs") + (F.col("number") <= F.col("taken_of_tied")).cast("int")).cast("long")).drop("number")
    return plain.unionByName(tied)


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_EPOCHS,
    seed: int = 17,
    bins: int = BINS,
    weight: Column | None = None,
    sort: int = SORTED,
) -> DataFrame:
    """Per row of (doc_id, source, text): doc_id, source, text_hash, size, source_size, target, copies, taken.

    `weight` is a document's quality, above 0; without one it is told from its text. Nulls: a null
    text has size 0, null sources form one source behind all others, null ids draw by their text.
    Rows of size 0 take no words, and go along with epochs and draws. Of equal rows at the end of
    a draw as many are taken as are needed. An empty table gives no rows. Other columns of docs
    are not looked at, unless `weight` does.
    """
    slim = settle(_keyed(docs, seed, weight), "mix")
    out = _dealt(slim, _ends(slim, weights, share, most, bins, sort), F.col("key"))
    return out.select("doc_id", "source", "text_hash", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, seed: int = 17, bins: int = BINS, weight: Column | None = None, sort: int = SORTED
) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, in the columns of docs, whatever others are called.

    Rows equal in id, text and source that stand at the end of a draw are taken in the order of a
    hash of all their columns. docs is read twice.
    """
    plan = _ends(settle(_keyed(docs, seed, weight), "mix"), weights, share, most, bins, sort)
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row")
    rows = _dealt(_keyed(docs, seed, weight, row), plan, F.xxhash64(F.to_json("row")))
    return rows.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
