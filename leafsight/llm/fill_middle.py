"""Fill-in-middle: a document cut at two unit borders, its middle moved to the end.

Units are rows: matches of UNIT are exploded with their places, running sums of their lengths say
where they end, the two cuts asked for of a document meet the units by their ordinals, and the
offsets gathered per document cut its text. The running sums have two levels, over blocks of BLOCK
units and over the units of the blocks with a cut, so that no sort holds all units. Texts are
shuffled once, by document; all that follows keeps to that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of documents left as they are, and, of the others, those that begin with the suffix.
PLAIN_PERCENT, SUFFIX_FIRST_PERCENT = 10, 20
BLOCK = 64
#: A row's id (0 where it has none), whether it has none, and a hash of its text.
KEY = ("id", "no_id", "h")


def _draw(group: int) -> Column:
    """The group-th 8 hex digits of the document's digest as a number; a null id's is that of no digits."""
    seed = F.concat(F.lit("1:"), F.when(F.col("no_id"), F.lit("")).otherwise(F.col("id").cast("string")))
    return F.conv(F.substring(F.sha2(seed, 256), 8 * group + 1, 8), 16, 10).cast("long")


def _form() -> Column:
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (_draw(2) % 100 >= 100 - PLAIN_PERCENT)
    return F.when(plain, "plain").when(_draw(3) % 100 < SUFFIX_FIRST_PERCENT, "spm").otherwise("psm")


def _cuts() -> tuple[Column, Column]:
    """After how many of a text's n units its prefix and its middle end."""
    a, b = _draw(0) % (F.col("n") + 1), _draw(1) % (F.col("n") + 1)
    return F.least(a, b).alias("first"), F.greatest(a, b).alias("second")


def cut_requests(texts: DataFrame) -> DataFrame:
    """(id, no_id, h, n, form, first, second) of every text."""
    n = F.regexp_count("text", F.lit(UNIT)).cast("long")
    return texts.select(*KEY, n.alias("n"), _form().alias("form")).select(*KEY, "n", "form", *_cuts())


def _units(texts: DataFrame) -> DataFrame:
    return texts.where(_form() != "plain").select(*KEY, F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)).alias("units"))


def _of(cut: str) -> Column:
    """The block that the unit before a cut stands in."""
    return F.floor((F.col(cut) - 1) / BLOCK)


def block_starts(texts: DataFrame) -> DataFrame:
    """(id, no_id, h, block, start): the code points before each block of BLOCK units of the texts that are cut."""
    units = _units(texts).select(*KEY, F.posexplode("units").alias("pos", "unit"))
    sums = units.groupBy(*KEY, F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.sum(F.length("unit")).alias("size"))
    before = Window.partitionBy(*KEY).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*KEY, "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))


def unit_ends(texts: DataFrame) -> DataFrame:
    """(id, no_id, h, place, end) of the units in the blocks with a cut: the place from 1, and the code points from the block's start to the unit's end."""
    asked = _units(texts).select("*", F.size("units").cast("long").alias("n")).select(*KEY, "units", *_cuts())
    blocks = asked.select(*KEY, "units", F.explode(F.array_distinct(F.array(_of("first"), _of("second")))).alias("block")).where("block >= 0")
    units = blocks.select(*KEY, "block", F.posexplode(F.slice("units", (F.col("block") * BLOCK + 1).cast("int"), BLOCK)).alias("pos", "unit"))
    so_far = Window.partitionBy(*KEY, "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return units.select(*KEY, (F.col("block") * BLOCK + F.col("pos") + 1).alias("place"), F.sum(F.length("unit")).over(so_far).alias("end"))


def _meet(requests: DataFrame, rows: DataFrame, hit: Column) -> DataFrame:
    """Requests with the rows of their text for which `hit` holds; ordinals are no part of the join's key, so rows stay where the texts are."""
    other = rows.select(*[F.col(k).alias(f"r_{k}") for k in KEY], *[c for c in rows.columns if c not in KEY])
    return requests.join(other, (F.col("id") == F.col("r_id")) & (F.col("no_id") == F.col("r_no_id")) & (F.col("h") == F.col("r_h")) & hit, "left")


def _offsets(texts: DataFrame) -> DataFrame:
    """(id, no_id, h, n, form, a, b): code points of the prefix, and of prefix and middle. A cut after no unit meets none and is 0."""
    of = lambda value, hit: F.coalesce(F.max(F.when(hit, F.col(value))), F.lit(0))
    in_first, in_second = F.col("block") == _of("first"), F.col("block") == _of("second")
    own = [*KEY, "n", "form", "first", "second"]
    met = _meet(cut_requests(texts), block_starts(texts), in_first | in_second)
    starts = met.groupBy(*own).agg(of("start", in_first).alias("a0"), of("start", in_second).alias("b0"))
    at_first, at_second = F.col("place") == F.col("first"), F.col("place") == F.col("second")
    ends = _meet(starts, unit_ends(texts), at_first | at_second).groupBy(*own, "a0", "b0").agg(of("end", at_first).alias("a1"), of("end", at_second).alias("b1"))
    return ends.select(*KEY, "n", "form", (F.col("a0") + F.col("a1")).alias("a"), (F.col("b0") + F.col("b1")).alias("b"))


def transform(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of docs.

    plain: output is the text. psm: PREFIX prefix SUFFIX suffix MIDDLE middle. spm: the suffix with
    its mark comes first. Empty texts, texts with a mark and PLAIN_PERCENT of all others are plain;
    a null text is an empty one. Draws depend on doc_id alone; all null ids draw alike and stay
    null. Repeated rows give repeated results; texts of one id are told apart by 64 bits of hash.
    Other columns of docs are not looked at.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    own = own.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), F.xxhash64("text").alias("h"), "text")
    # repeated rows are one here; the filter keeps `copies` in all its uses, so that one shuffle serves them
    texts = own.groupBy(*KEY).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")).where("copies > 0")
    rows = texts.join(_offsets(texts), list(KEY))
    prefix, middle = F.expr("substring(text, 1, a)"), F.expr("substring(text, a + 1, b - a)")
    tail = F.expr("substring(text, b + 1)")
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), tail, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), tail, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    cut = F.col("form") != "plain"
    out = rows.select(
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "n", "form", F.when(cut, F.col("a")).cast("long").alias("prefix_chars"),
        F.when(cut, F.col("b") - F.col("a")).cast("long").alias("middle_chars"), output.alias("output"), "copies",
    )
    return out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copies", "copy")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Cut texts hold no mark, so an output of theirs holds each mark once."""
    head = lambda stop: F.substring(F.substring_index(output, stop, 1), 4, 2**31 - 1)
    part = lambda start, stop: F.substring_index(F.substring_index(output, start, -1), stop, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(head(SUFFIX), middle, part(SUFFIX, MIDDLE))
    spm = F.concat(part(PREFIX, MIDDLE), middle, head(PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
