"""Filter interaction audit: what each of five filters removes alone, after others, and over all orders of them.

Words are rows: texts are exploded, counted by (document, word) and then by document, which gives
totals and distinct words; the flags that need no words are joined to these, and the documents of
a part are counted by the set of filters they fail, in 32 conditional counts. All else follows
from these counts, whatever the number of documents.

Filters, by letter; a text fails
  A  with fewer than MIN_WORDS words,
  B  where distinct words are under DISTINCT_PERCENT of all,
  C  where A-Z are more than UPPER_PERCENT of the code points,
  D  with any character of ODD,
  E  if it is the same as that of a smaller doc_id, anywhere in the table.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, ODD = 50, 65, 5, "[#$%&*|]"
BLANKS = r"[\x20\x09-\x0D]+"
#: A row's id (0 where it has none), whether it has none, and a hash of its text.
KEY = ("id", "no_id", "h")
#: Parts into which the copies of a text are dealt.
SALTS = 64


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    return own.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), F.xxhash64("text").alias("h"), "part", "text")


def word_totals(rows: DataFrame) -> DataFrame:
    """(id, no_id, h, words, distinct) of texts with a word. Texts are shuffled once, repeated rows as one; both counts need no further shuffle."""
    texts = rows.groupBy(*KEY).agg(F.first("text").alias("text"))
    words = texts.select(*KEY, F.explode(F.split("text", BLANKS)).alias("word")).where("word <> ''")
    each = words.groupBy(*KEY, "word").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(*KEY).agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("distinct"))


def _least_ids(slim: DataFrame) -> DataFrame:
    """(sha, salt, least) of texts that several ids have: a row for each part of the copies, so that no task takes them all."""
    own = slim.where("not no_id").groupBy("sha", "salt").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    whole = own.groupBy("sha").agg(F.min("lo").alias("least"), F.max("hi").alias("most"), F.collect_set("salt").alias("salts"))
    return whole.where("most > least").select("sha", F.explode("salts").alias("salt"), "least")


def failures(docs: DataFrame) -> DataFrame:
    """(id, no_id, part, fails, n): documents by id, part and the set of filters they fail, a bit for each letter from A = 1."""
    rows = _rows(docs)
    upper = 100 * F.regexp_count("text", F.lit("[A-Z]")) > UPPER_PERCENT * F.length("text")
    flags = (F.when(upper, 4).otherwise(0) + F.when(F.rlike("text", F.lit(ODD)), 8).otherwise(0)).alias("flags")
    slim = rows.select(*KEY, "part", F.unhex(F.sha2("text", 256)).alias("sha"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"), flags)
    slim = slim.groupBy(*KEY, "part", "sha", "salt", "flags").agg(F.count(F.lit(1)).alias("n"))
    known = slim.join(word_totals(rows), list(KEY), "left").join(_least_ids(slim), ["sha", "salt"], "left")
    words, distinct = F.coalesce("words", F.lit(0)), F.coalesce("distinct", F.lit(0))
    fails = (
        F.when(words < MIN_WORDS, 1).otherwise(0) + F.when(100 * distinct < DISTINCT_PERCENT * words, 2).otherwise(0)
        + F.col("flags") + F.when(~F.col("no_id") & (F.col("id") > F.col("least")), 16).otherwise(0)
    )
    return known.select("id", "no_id", "part", fails.alias("fails"), "n").groupBy("id", "no_id", "part", "fails").agg(F.sum("n").alias("n"))


def set_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, every, good, toxic): arrays of documents by the set of filters they fail."""
    l = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("l_id"))
    l = l.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("bad"))
    both = failed.join(l, ~F.col("no_id") & (F.col("id") == F.col("l_id")), "left")
    which = {"every": F.lit(True), "good": F.col("good"), "toxic": F.col("bad")}
    sums = [F.sum(F.when((F.col("fails") == s) & on, F.col("n")).otherwise(0)).alias(f"{name}_{s}") for name, on in which.items() for s in range(SETS)]
    return both.groupBy("part").agg(*sums).select("part", *[F.array(*[f"{name}_{s}" for s in range(SETS)]).alias(name) for name in which])


def _over(counts: str, when: Column) -> Column:
    """The sum of an array's entries, those s for which `when` holds of the set x."""
    return F.expr(f"aggregate(sequence(0, {SETS - 1}), 0L, (a, x) -> a + if({when}, {counts}[x], 0L))")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), zeros included.

    Every row of docs is a document, repeated rows too. A null text is an empty one; a null source
    counts to the part of the empty string. A null doc_id has no label, is smaller than none and
    has none smaller. Of several labels of an id any that says 1 counts; other values are not 1.
    Without rows there are no parts. shapley is the sum over all orders: among those of k failed
    filters each comes first in 120 / k orders. Texts of one id are told apart by 64 bits of hash.
    """
    counts = set_counts(failures(docs), labels)
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])).alias("filter_order")
    steps = counts.select("*", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = F.expr(f"shiftleft(1, instr('{FILTERS}', substr(filter_order, step, 1)) - 1)")
    before = F.expr(" + ".join(f"if(instr(left(filter_order, step - 1), '{c}') > 0, {1 << i}, 0)" for i, c in enumerate(FILTERS)))
    steps = steps.select("*", bit.alias("own"), before.alias("earlier"))
    here, late = "(x & own) <> 0 and (x & earlier) = 0", "(x & own) <> 0 and (x & earlier) <> 0"
    share = F.expr(f"aggregate(sequence(0, {SETS - 1}), 0L, (a, x) -> a + if((x & own) <> 0, every[x] * (120 div bit_count(x)), 0L))")
    return steps.select(
        "part", "filter_order", "step",
        _over("every", "(x & (own | earlier)) = 0").alias("kept"), _over("every", here).alias("removed"), _over("every", late).alias("redundant"),
        _over("every", "x = own").alias("unique_fails"), _over("good", here).alias("good_lost"), _over("toxic", here).alias("toxic_lost"), share.alias("shapley"),
    )
