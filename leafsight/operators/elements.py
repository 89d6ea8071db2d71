"""Layout elements (doc_id, idx, page, category, text): cleaning, titles, captions, routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import FIGURE_CAPTION, TABLE_CAPTION, boilerplate_key, rows_to_markdown, strip
from ..sources.store import written

KEPT = ("Table", "Image")


def detect_boilerplate(elements: DataFrame, ratio: float = 0.6, min_pages: int = 3, longest: int = 160) -> DataFrame:
    """(doc_id, key, pages, total_pages) of text that stands on many of a document's pages."""
    total = elements.where("page is not null").groupBy("doc_id").agg(F.count_distinct("page").alias("total_pages"))
    keyed = elements.where(~F.col("category").isin(*KEPT) & F.col("page").isNotNull()).select("doc_id", "page", boilerplate_key(F.col("text")).alias("key"))
    pages = keyed.where((F.col("key") != "") & (F.length("key") <= longest)).groupBy("doc_id", "key").agg(F.count_distinct("page").alias("pages"))
    found = pages.join(total, "doc_id").where(F.col("total_pages") >= min_pages)
    return found.where(F.col("pages") >= F.greatest(F.lit(float(min_pages)), F.lit(ratio) * F.col("total_pages")))


def repeating_keys(elements: DataFrame, ratio: float = 0.6, min_pages: int = 3, longest: int = 160) -> DataFrame:
    """(doc_id, keys) of the documents that have boilerplate: what detect_boilerplate finds, as a table of a row a document.

    Pages are counted for hashes of keys, so no text is moved; the texts under the hashes that are
    on enough pages are counted again, by themselves.
    """
    total = elements.where("page is not null").groupBy("doc_id").agg(F.count_distinct("page").alias("total_pages"))
    key = boilerplate_key(F.col("text"))
    enough = F.col("pages") >= F.greatest(F.lit(float(min_pages)), F.lit(ratio) * F.col("total_pages"))
    lines = elements.where(~F.col("category").isin(*KEPT) & F.col("page").isNotNull())
    # more letters than a key may have are told by a text's beginning, and no key is made
    short = ~F.coalesce(F.col("text"), F.lit("")).rlike(rf"^[^A-Za-z]*+(?:[A-Za-z][^A-Za-z]*+){{{longest + 1}}}")
    # what is no key has a null hash, left out when all are counted: a filter on hashes would go before them and make each key twice
    hashed = lines.select("doc_id", "page", F.when(short, F.when((key != "") & (F.length(key) <= longest), F.xxhash64(key))).alias("h"))
    counted = hashed.groupBy("doc_id", "h").agg(F.count_distinct("page").alias("pages")).where(F.col("pages") >= min_pages)
    likely = written(counted.join(total, "doc_id").where((F.col("total_pages") >= min_pages) & enough).drop("pages"), "likely").where("h is not null")
    again = lines.where(short).select("doc_id", "page", key.alias("key"), F.xxhash64(key).alias("h")).join(likely, ["doc_id", "h"])
    found = again.groupBy("doc_id", "key", "total_pages").agg(F.count_distinct("page").alias("pages")).where(enough)
    return written(found.groupBy("doc_id").agg(F.collect_set("key").alias("keys")), "repeating")


def without_keys(elements: DataFrame, found: DataFrame) -> DataFrame:
    """Elements without boilerplate, given as repeating_keys gives it; keys are only made for documents that have some."""
    gone = F.when(F.col("keys").isNotNull() & ~F.col("category").isin(*KEPT), F.array_contains("keys", boilerplate_key(F.col("text"))))
    return elements.join(found, "doc_id", "left").where(~F.coalesce(gone, F.lit(False))).drop("keys")


def only_for(elements: DataFrame, category: str) -> DataFrame:
    """Elements for the titles and captions of those of a category (Table or Image): no text where it can be none of these, so that little moves."""
    pattern, longest = {"Table": (TABLE_CAPTION, 400), "Image": (FIGURE_CAPTION, 300)}[category]
    # begins so before it is stripped, too
    begins = F.col("text").rlike("(?U)" + pattern.replace(r"^\s*", r"^[\s\x1c-\x1f]*"))
    said = F.col("category").isin("Title", category) | (((F.col("category") == "FigureCaption") | begins) & (F.length(strip(F.col("text"))) <= longest))
    return elements.withColumn("text", F.when(said, F.col("text")))


def strip_boilerplate(elements: DataFrame, boilerplate: DataFrame) -> DataFrame:
    """Elements without boilerplate; tables and images always stay."""
    keys = boilerplate.select(F.col("doc_id").alias("b_doc"), F.col("key").alias("b_key"))
    gone = (F.col("doc_id") == F.col("b_doc")) & (boilerplate_key(F.col("text")) == F.col("b_key")) & ~F.col("category").isin(*KEPT)
    return elements.join(keys, gone, "left_anti")


def running_titles(elements: DataFrame) -> DataFrame:
    """Each element with the last title at or before it."""
    own = F.when((F.col("category") == "Title") & (strip(F.col("text")) != ""), strip(F.col("text")))
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return elements.withColumn("running_title", F.coalesce(F.last(own, ignorenulls=True).over(w), F.lit("")))


def _caption(steps: tuple[int, ...], longest: int, pattern: str) -> Column:
    w = Window.partitionBy("doc_id").orderBy("idx")
    text = strip(F.col("text"))
    fits = (text != "") & (F.length(text) <= longest) & ((F.col("category") == "FigureCaption") | text.rlike(pattern))
    mine = F.struct(F.col("page").alias("page"), F.when(fits, text).alias("text"))

    def at(k: int) -> Column:
        near = F.lag(mine, -k).over(w) if k < 0 else F.lead(mine, k).over(w)
        return F.when(near["page"].eqNullSafe(F.col("page")), near["text"])

    return F.coalesce(*[at(k) for k in steps], F.lit(""))


def table_captions(elements: DataFrame) -> DataFrame:
    """Tables with the nearest caption of their page: before first, two elements at most."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    text = strip(F.col("text"))
    mine = F.struct("page", F.when((text != "") & (F.length(text) <= 400) & ((F.col("category") == "FigureCaption") | text.rlike(TABLE_CAPTION)), text).alias("t"))
    near = [(F.lag(mine, -k) if k < 0 else F.lead(mine, k)).over(w) for k in (-1, -2, 1, 2)]
    return elements.withColumn("caption", F.coalesce(*[F.when(x["page"].eqNullSafe(F.col("page")), x["t"]) for x in near], F.lit(""))).where("category = 'Table'")


def figure_captions(elements: DataFrame) -> DataFrame:
    """Images with the nearest caption of their page: after first, three elements at most."""
    return elements.withColumn("caption", _caption((1, 2, 3, -1, -2, -3), 300, FIGURE_CAPTION)).where("category = 'Image'")


def route(elements: DataFrame) -> dict[str, DataFrame]:
    kinds = {"table": F.col("category") == "Table", "image": F.col("category") == "Image"}
    return {k: elements.where(c) for k, c in kinds.items()} | {"text": elements.where(~reduce(lambda a, b: a | b, kinds.values()))}


def match_text_tables(elements: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables of the layout with the n-th table (doc_id, page, n, markdown) of their page's text layer, if any."""
    w = Window.partitionBy("doc_id", "page").orderBy("idx")
    mine = elements.where("category = 'Table'").withColumn("n", F.row_number().over(w) - 1)
    return mine.join(tables, ["doc_id", "page", "n"], "left")


def text_tables(tables: DataFrame, boilerplate: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, n, markdown) of a text layer's tables (doc_id, page, n, rows), numbered anew from 0 within a page.

    Tables of one row, those that are a repeating line as a whole, those of which every row is
    one, and empty ones are left out.
    """
    line = lambda r: boilerplate_key(F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " "))
    kept = tables.where(F.size("rows") >= 2)
    if boilerplate is not None:
        # a document's repeating lines: few, as each stands on most of its pages
        keys = boilerplate.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
        whole = line(F.flatten(F.transform("rows", lambda r: F.coalesce(r, F.array().cast("array<string>")))))
        known = F.coalesce(F.col("keys"), F.array().cast("array<string>"))
        kept = kept.join(keys, "doc_id", "left").where(~F.array_contains(known, whole) & ~F.forall("rows", lambda r: F.array_contains(known, line(r)))).drop("keys")
    kept = kept.select("doc_id", "page", "n", rows_to_markdown(F.col("rows")).alias("markdown")).where("markdown <> ''")
    return kept.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("n")) - 1)
