"""Batched hybrid search: chunks (collection, chunk_seq, title, text, embedding, ...) x queries (query_id, collection, text, qvec).

A chunk's number is its own within a collection only, so hits carry both. Scores cover a query's
whole collection, zeros included, as the normalisation needs its true minimum. Ties go to the
smaller chunk_seq; scores are compared at nine decimals, as the order in which a shuffle adds is
not fixed. Scores travel without texts: these are joined to what is left at the end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, shown_score, snippet, tokenize
from ..sources.store import written
from .blocks import DIGITS, all_scores, grid_best, k_best
from .pairs import CHUNK, K1, B, Pairs, Point, pairs

FLOOR = 0.25


#: Partitions of stored postings by the hash of their term, and chunk numbers that a block of them spans.
BUCKETS, SPAN = 32, 256
#: Queries up to which the ends of their scores, a row each, go to every task, and hits up to which they go to the chunks.
FEW = 100_000
#: Postings that a file of stored blocks holds, or a little more.
FILE = 1_000_000
#: Postings of its most telling terms that a query looks at for a first bound.
LEAD = 2000
#: Chunks that are scored in full for the bound, so many for each row that is asked for.
SEEDS = 4


@dataclass(frozen=True)
class Lexicon:
    """What lexical search needs of a corpus.

    postings (collection, chunk_seq, term, tf, dl), counts (collection, n), and from these terms
    (collection, term, df, idf) and stats (collection, n, avgdl).
    """

    postings: DataFrame
    counts: DataFrame

    @property
    def stats(self) -> DataFrame:
        length = self.postings.groupBy("collection").agg(F.sum("tf").alias("length"))
        return self.counts.join(length, "collection", "left").select("collection", "n", (F.coalesce("length", F.lit(0)) / F.col("n")).alias("avgdl"))

    @property
    def terms(self) -> DataFrame:
        return _idf(self.postings.groupBy("collection", "term").agg(F.count(F.lit(1)).alias("df")), self.counts)

    def save(self, path: str) -> StoredLexicon:
        """Write blocks, terms and stats below `path`; texts are tokenised once for all of them.

        A block holds the postings of a term within SPAN chunk numbers, weighted, under their
        greatest weight; blocks lie in BUCKETS partitions by the hash of their term.
        """
        flat = Lexicon(written(self.postings, "postings"), self.counts)
        flat.stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
        stats = F.broadcast(self.postings.sparkSession.read.parquet(f"{path}/stats").select("collection", "avgdl"))
        bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket")
        span = F.floor(F.col("chunk_seq") / SPAN).alias("span")
        weighed = flat.postings.join(stats, "collection").select(*CHUNK, "term", _weight().alias("w"), bucket, span)
        # one shuffle deals postings to files: those of a bucket to several, by their spans, so that a common term is nobody's alone
        parts = flat.postings.count() // (BUCKETS * FILE) + 1
        dealt = weighed.withColumn("part", F.pmod("span", F.lit(parts))).repartition("bucket", "part")
        blocks = dealt.groupBy("bucket", "part", "collection", "term", "span").agg(F.max("w").alias("top"), F.sort_array(F.collect_list(F.struct("chunk_seq", "w"))).alias("hits"))
        blocks.drop("part").sortWithinPartitions("bucket", "collection", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
        top = self.postings.sparkSession.read.parquet(f"{path}/blocks").groupBy("collection", "term").agg(F.max("top").alias("top"))
        flat.terms.join(top, ["collection", "term"]).select("*", bucket).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
        return StoredLexicon.load(self.postings.sparkSession, path)


@dataclass(frozen=True)
class StoredLexicon:
    """blocks (collection, term, span, top, hits, bucket), terms (collection, term, df, idf, top, bucket), stats (collection, n, avgdl)."""

    blocks: DataFrame
    terms: DataFrame
    stats: DataFrame

    @staticmethod
    def load(spark: SparkSession, path: str) -> StoredLexicon:
        return StoredLexicon(*[spark.read.parquet(f"{path}/{t}") for t in ("blocks", "terms", "stats")])

    def asked(self, queries: DataFrame) -> DataFrame:
        """(query_id, collection, term, bucket, df, weight, top) of the queries' terms that the corpus has; weight: how often it is asked for, by its idf."""
        words = _asked(queries).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
        known = _pruned(self.terms, words).join(words, ["collection", "term", "bucket"])
        return known.select("query_id", "collection", "term", "bucket", "df", (F.col("qtf") * F.col("idf")).alias("weight"), "top")

    def gains(self, asked: DataFrame, spans: DataFrame | None = None) -> DataFrame:
        """(query_id, collection, chunk_seq, gain) for each posting of the terms asked for, within spans (query_id, collection, span) if given."""
        hit = _pruned(self.blocks, asked).join(asked.select("query_id", "collection", "term", "weight"), ["collection", "term"])
        hit = hit if spans is None else hit.join(spans, ["query_id", "collection", "span"], "left_semi")
        return hit.select("query_id", "collection", "weight", F.explode("hits").alias("h")).select("query_id", "collection", "h.chunk_seq", (F.col("weight") * F.col("h.w")).alias("gain"))


def _pruned(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of the buckets that are asked for: BUCKETS numbers at most, as literals, so that other partitions aren't read."""
    return rows.where(F.col("bucket").isin([r["bucket"] for r in asked.select("bucket").distinct().collect()]))


def _asked(queries: DataFrame) -> DataFrame:
    words = queries.select("query_id", "collection", F.explode(tokenize(F.col("text"))).alias("term"))
    return words.groupBy("query_id", "collection", "term").agg(F.count(F.lit(1)).alias("qtf"))


def _weight() -> Column:
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def _words(chunks: DataFrame, text: Column | None) -> DataFrame:
    """(collection, chunk_seq, words)."""
    return chunks.select(*CHUNK, tokenize(text if text is not None else F.concat_ws(" ", F.coalesce("title", F.lit("")), "text")).alias("words"))


def postings(chunks: DataFrame, text: Column | None = None) -> DataFrame:
    """(collection, chunk_seq, term, tf)."""
    return _words(chunks, text).select(*CHUNK, F.explode("words").alias("term")).groupBy(*CHUNK, "term").agg(F.count(F.lit(1)).alias("tf"))


def statistics(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms (collection, term, df, idf; negative idf are a quarter of the mean) and stats (collection, n, avgdl)."""
    stats = words.groupBy("collection").agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("words")).alias("avgdl"))
    df = words.select("collection", F.explode(F.array_distinct("words")).alias("term")).groupBy("collection", "term").agg(F.count(F.lit(1)).alias("df"))
    return _idf(df, stats), stats


def _idf(df: DataFrame, stats: DataFrame) -> DataFrame:
    """(collection, term, df, idf)."""
    # a row for each collection
    raw = df.join(F.broadcast(stats.select("collection", "n")), "collection").withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy("collection").agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean), "collection").select("collection", "term", "df", F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def asked_weights(df: DataFrame, queries: DataFrame, counts: DataFrame) -> DataFrame:
    """(query_id, term, weight) of the queries' terms that chunks have: how often a term is asked for, by its idf. df: (collection, term, df) of all terms, counts: (collection, n)."""
    known = _asked(queries).join(_idf(df, counts), ["collection", "term"])
    return known.select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"))


def inverse_frequencies(chunks: DataFrame, text: Column | None = None) -> DataFrame:
    """(collection, term, df, idf)."""
    return statistics(_words(chunks, text))[0]


def lexicon(chunks: DataFrame, text: Column | None = None) -> Lexicon:
    # a chunk's text is shuffled once; its words are counted where it comes to
    each = _words(chunks.repartition(*CHUNK), text).select(*CHUNK, F.size("words").alias("dl"), F.explode("words").alias("term"))
    return Lexicon(each.groupBy(*CHUNK, "dl", "term").agg(F.count(F.lit(1)).alias("tf")), chunks.groupBy("collection").agg(F.count(F.lit(1)).alias("n")))


def bm25(chunks: DataFrame | Lexicon | StoredLexicon, queries: DataFrame, text: Column | None = None) -> DataFrame:
    """(query_id, collection, chunk_seq, bm25) of chunks that share a term with the query, of chunks or of a lexicon made before."""
    if isinstance(chunks, StoredLexicon):
        return chunks.gains(written(chunks.asked(queries), "asked")).groupBy("query_id", *CHUNK).agg(F.sum("gain").alias("bm25"))
    asked = _asked(queries)
    if isinstance(chunks, Lexicon):
        terms, stats = chunks.terms, chunks.stats
        hit = chunks.postings.join(asked, ["collection", "term"])
    else:
        words = _words(chunks, text)
        terms, stats = statistics(words)
        # only words that are asked for leave their rows
        each = words.select(*CHUNK, F.size("words").alias("dl"), F.explode("words").alias("term"))
        some = each.join(asked.select("collection", "term").distinct(), ["collection", "term"], "left_semi").groupBy(*CHUNK, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
        hit = some.join(asked, ["collection", "term"])
    hit = hit.join(terms.select("collection", "term", "idf"), ["collection", "term"]).join(F.broadcast(stats.select("collection", "avgdl")), "collection")
    return hit.groupBy("query_id", *CHUNK).agg(F.sum(F.col("qtf") * F.col("idf") * _weight()).alias("bm25"))


@dataclass(frozen=True)
class Bounded:
    """The steps of a bounded search: the terms that must be looked at in full, the others, and the chunks that may be among the best, with what they have so far."""

    essential: DataFrame
    others: DataFrame
    candidates: DataFrame


def bounded(words: StoredLexicon, queries: DataFrame, k: int) -> Bounded:
    """Which postings a search for the k best needs.

    A query's most telling terms, LEAD postings or a little more, give it SEEDS * k promising
    chunks; these are scored in full, and the k-th best of them is the bar. Terms that together can't lift a chunk over it are not
    essential: chunks that have no other term are never looked at, and of those that do, only those
    go on that could still reach the bar.
    """
    q = Window.partitionBy("query_id", "collection")
    queries = written(queries.select("query_id", "collection", "text"), "queries")
    bound = F.greatest(F.col("weight") * F.col("top"), F.lit(0.0))
    terms = words.asked(queries).withColumn("bound", bound).withColumn("loss", F.least(F.col("weight") * F.col("top"), F.lit(0.0)))
    by_size = q.orderBy(F.desc("bound"), "term")
    terms = terms.withColumn("before", F.coalesce(F.sum("df").over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    terms = written(terms.withColumn("up_to", F.sum("bound").over(by_size.rowsBetween(Window.currentRow, Window.unboundedFollowing))), "terms")
    first = words.gains(terms.where(F.col("before") < LEAD)).groupBy("query_id", *CHUNK).agg(F.sum("gain").alias("score"))
    seeds = written(top(first, SEEDS * k).select("query_id", *CHUNK), "seeds")
    whole = words.gains(terms, _spans(seeds)).join(seeds, ["query_id", *CHUNK], "left_semi").groupBy("query_id", *CHUNK).agg(F.sum("gain").alias("score"))
    kth = top(whole, k).where(F.col("rank") == k).select("query_id", "collection", (F.col("score") - 1e-9).alias("bar"))
    terms = written(terms.join(kth, ["query_id", "collection"], "left"), "bars")
    # without a bar all terms count, as do those that lower a score
    needed = F.coalesce(F.col("up_to") >= F.col("bar"), F.lit(True)) | (F.col("loss") < 0)
    essential, others = terms.where(needed), terms.where(~needed)
    rest = terms.groupBy("query_id", "collection").agg(F.min("bar").alias("bar"), F.sum(F.when(~needed, F.col("bound")).otherwise(0.0)).alias("rest"))
    have = words.gains(essential).groupBy("query_id", *CHUNK).agg(F.sum("gain").alias("score"))
    hopeful = have.join(rest, ["query_id", "collection"]).where(F.coalesce(F.col("score") + F.col("rest") >= F.col("bar"), F.lit(True)))
    return Bounded(essential, others, written(hopeful.select("query_id", *CHUNK, "score"), "candidates"))


def _spans(chunks: DataFrame) -> DataFrame:
    return chunks.select("query_id", "collection", F.floor(F.col("chunk_seq") / SPAN).alias("span")).distinct()


def other_gains(words: StoredLexicon, found: Bounded) -> DataFrame:
    """(query_id, collection, chunk_seq, gain) of candidates by terms that aren't essential; blocks without candidates are not opened."""
    some = words.gains(found.others, _spans(found.candidates))
    return some.join(found.candidates.select("query_id", *CHUNK), ["query_id", *CHUNK], "left_semi")


def best_bm25(words: StoredLexicon, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, collection, chunk_seq, score, rank) of the k best by BM25, as top of bm25 has them, from the postings that can matter."""
    found = bounded(words, queries, k)
    every = found.candidates.unionByName(other_gains(words, found).withColumnRenamed("gain", "score"))
    return top(every.groupBy("query_id", *CHUNK).agg(F.sum("score").alias("score")), k)


def _keyed(chunks: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    return chunks.select(F.col("collection").alias("key"), *CHUNK, "embedding"), queries.select(F.col("collection").alias("key"), "query_id", "qvec")


def dense(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, collection, chunk_seq, cos) of every chunk of the query's collection; vectors have length one.

    By matrix products, block by block, where the chunks lie. Vectors of unlike length have no row.
    """
    return all_scores(*_keyed(chunks, queries))


def minmax(scores: DataFrame, *columns: str, few: bool = False) -> DataFrame:
    """norm_<column>: from 0 to 1 within each query, 0 where all are alike. Of few queries the ends are broadcast, and the scores stay where they are."""
    ends = scores.groupBy("query_id").agg(*[f(c).alias(f"{n}_{c}") for c in columns for f, n in ((F.min, "lo"), (F.max, "hi"))])
    out = scores.join(F.broadcast(ends) if few else ends, "query_id")
    for c in columns:
        width = F.col(f"hi_{c}") - F.col(f"lo_{c}")
        out = out.withColumn(f"norm_{c}", F.when(width < 1e-12, F.lit(0.0)).otherwise((F.col(c) - F.col(f"lo_{c}")) / width))
    return out.drop(*[f"{n}_{c}" for c in columns for n in ("lo", "hi")])


def scored(chunks: DataFrame, queries: DataFrame, words: DataFrame | Lexicon | StoredLexicon | None = None) -> DataFrame:
    """(query_id, collection, chunk_seq, cos, bm25, norm_cos, norm_bm25) of every chunk of the query's collection.

    words: a lexicon made before, or the same chunks without their vectors, where texts and vectors lie apart.
    Only with a lexicon scores by words are rows that are joined to those by vectors.
    """
    if not isinstance(words, (Lexicon, StoredLexicon)):
        rows = pairs(chunks, queries, words).rows()
        return rows.select("query_id", *CHUNK, "cos", "bm25", "norm_cos", "norm_bm25")
    both = dense(chunks, queries).join(bm25(words, queries), ["query_id", *CHUNK], "left").fillna(0.0, ["bm25"])
    return minmax(both, "cos", "bm25", few=queries.count() <= FEW)


def described(hits: DataFrame, chunks: DataFrame, *columns: str, few: bool = False) -> DataFrame:
    """Hits with columns of their chunks. Few hits go to where the chunks lie."""
    return (F.broadcast(hits) if few else hits).join(chunks.select(*CHUNK, *columns), list(CHUNK))


def gathered(hits: DataFrame) -> tuple[DataFrame, bool]:
    """Hits as a table that was written, and whether there are few of them."""
    hits = written(hits, "hits")
    return hits, hits.count() <= FEW


def fuse(scores: DataFrame, alpha: float | Column = 0.6, mode: str = "hybrid") -> DataFrame:
    a = alpha if isinstance(alpha, Column) else F.lit(alpha)
    by = {"vector": F.col("norm_cos"), "bm25": F.col("norm_bm25"), "hybrid": a * F.col("norm_cos") + (1 - a) * F.col("norm_bm25")}
    return scores.withColumn("score", by[mode])


def mixed(alpha: float) -> Callable[[dict], object]:
    """What `fuse` makes of the scores of a pair, for `Point`."""
    return lambda s: alpha * s["cos"] + (1 - alpha) * s["bm25"]


def mode_score(mode: str, alpha: float = 0.6) -> Callable[[dict], object]:
    return {"vector": lambda s: s["cos"], "bm25": lambda s: s["bm25"], "hybrid": mixed(alpha)}[mode]


def best_of(found: Pairs, k: int, points: list[Point], grid: list[dict] | None = None, where: Column | None = None) -> DataFrame:
    """(a column for each of the grid's names, query_id, collection, chunk_seq, page, score, the channels' scores, rank): the k best chunks of each query, at each point if there is a grid."""
    rows = found.best(k, points, where=where)
    if grid is None:
        return top(rows.drop("at"), k)
    return _placed(top(rows, k, ("at", "query_id")), grid)


def best_pages(found: Pairs, k: int, points: list[Point], grid: list[dict]) -> DataFrame:
    """(a column for each of the grid's names, query_id, chunk_seq, page, score, ...): best chunks of pages, those of the k best pages of each query at each point among them."""
    return _placed(found.best(k, points, by_page=True), grid)


def _placed(rows: DataFrame, grid: list[dict]) -> DataFrame:
    values = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in p.items()]) for p in grid])
    return rows.withColumn("point", F.get(values, F.col("at"))).select("point.*", *[c for c in rows.columns if c != "at"])


def page_hits(found: Pairs, point: Point, k: int) -> DataFrame:
    """(query_id, collection, chunk_seq, page, score) of all chunks of each query's k best pages."""
    return found.of_pages(page_scores(found.best(k, [point], by_page=True), k), point)


def best_first(by: list[str], score: str = "score") -> Window:
    return Window.partitionBy(*by).orderBy(F.desc(F.round(score, 9)), "chunk_seq")


def top(hits: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The k best of each query, with their rank."""
    return hits.withColumn("rank", F.row_number().over(best_first(list(by)))).where(F.col("rank") <= k)


def search(
    chunks: DataFrame, queries: DataFrame, k: int = 5, alpha: float = 0.6, mode: str = "hybrid", types: list[str] | None = None, words: DataFrame | Lexicon | StoredLexicon | None = None
) -> DataFrame:
    """Ranked chunks; types are left out after scoring, so scores don't change with them."""
    columns = [c for c in chunks.columns if c not in (*CHUNK, "embedding")]
    if isinstance(words, (Lexicon, StoredLexicon)):
        hits = fuse(scored(chunks, queries, words), alpha, mode)
        if types:
            hits = hits.join(chunks.where(F.col("chunk_type").isin(types)).select(*CHUNK), list(CHUNK), "left_semi")
        return described(top(hits, k), chunks, *columns)
    where = F.col("chunk_type").isin(types) if types else None
    hits, few = gathered(best_of(pairs(chunks, queries, words), k, [Point(mode_score(mode, alpha))], where=where).drop("page"))
    return described(hits, chunks if words is None else words, *columns, few=few)


def nearest(chunks: DataFrame, queries: DataFrame, k: int = 5, chunk_type: str | None = None, page: int | None = None) -> DataFrame:
    """Dense search among the chunks of a type or page; these are left out before."""
    some = chunks
    if chunk_type is not None:
        some = some.where(F.col("chunk_type") == chunk_type)
    if page is not None:
        some = some.where(F.col("page") == page)
    return top(k_best(*_keyed(some, queries), k).withColumn("score", F.col("cos")), k)


def with_sections(hits: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Hits with the size and the best score of their section; chunks without a title are no section, of size 0."""
    name = F.trim(F.coalesce("title", F.lit("")))
    # untitled chunks are spread, not gathered as if they were one section
    group = Window.partitionBy(*by, "collection", name, F.when(name == "", F.col("chunk_seq")))
    size = F.when(name == "", F.lit(0)).otherwise(F.count(F.lit(1)).over(group))
    return hits.withColumns({"section_size": size, "section_best": F.max("score").over(group)})


def lifted(decay: float | Column, max_group: int | Column) -> Column:
    """The score of a hit with its section: in sections of 2..max_group chunks at least decay times the best."""
    d = decay if isinstance(decay, Column) else F.lit(decay)
    some = (d > 0) & (F.col("section_size") >= 2) & (F.col("section_size") <= max_group)
    return F.when(some, F.greatest(F.col("score"), d * F.col("section_best"))).otherwise(F.col("score"))


def lift_sections(hits: DataFrame, decay: float | Column = 0.5, max_group: int | Column = 4, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Chunks of a section of 2..max_group chunks score at least decay times its best. Chunks without a title are no section."""
    return with_sections(hits, by).withColumn("score", lifted(decay, max_group)).drop("section_size", "section_best")


def top_of_grid(hits: DataFrame, grid: list[dict], score: Callable[[dict], Column], k: int) -> DataFrame:
    """(a column for each of the grid's names, query_id, collection, chunk_seq, score, rank): the k best of each query at each point of a grid.

    `score` makes of a point, a value for each name, the score of a hit there. A hit stays one row
    with all its scores, and only what a task finds among its k best becomes a row of a point, so
    what is shuffled and sorted doesn't grow with hits times points. Scores are rounded as they are compared.
    """
    rows = hits.select("query_id", *CHUNK, F.array(*[F.round(score(p), DIGITS).cast("double") for p in grid]).alias("scores"))
    points = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in p.items()]) for p in grid])
    some = grid_best(rows, k).withColumn("point", F.get(points, F.col("at")))
    return top(some.select("point.*", "query_id", *CHUNK, "score"), k, (*grid[0], "query_id"))


def page_scores(hits: DataFrame, max_pages: int, cutoff: float = 0.0) -> DataFrame:
    """(query_id, page, score, page_rank): pages by their best chunk, as many as are asked for, none below the cutoff's share of the best."""
    # a page's best chunk, by partial maxima: chunks are not ranked among all of their query
    best = F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("chunk_seq")).alias("seq")))
    page = hits.groupBy("query_id", "page").agg(F.max("score").alias("score"), best.alias("first"))
    w = Window.partitionBy("query_id")
    page = page.withColumn("page_rank", F.row_number().over(w.orderBy(F.desc("first"), "page"))).where(F.col("page_rank") <= max_pages)
    page = page.withColumn("best", F.max("score").over(w))
    return page.where(F.col("score") >= cutoff * F.col("best")).select("query_id", "page", "score", "page_rank")


def pages(hits: DataFrame, chunks: DataFrame, max_pages: int = 8, cutoff: float = 0.55, as_shown: bool = False, few: bool = False) -> DataFrame:
    """Pages by their best chunk, with section headings and the three best chunks as evidence; scores as they are shown, if so asked.

    hits: (query_id, collection, chunk_seq, page, title, chunk_type, score) of all chunks. Only the
    pages that are kept gather their chunks, and only evidence meets its text, where the text lies if it is few.
    """
    kept = page_scores(hits, max_pages, cutoff)
    # null pages are a page like others
    k = kept.select(F.col("query_id").alias("k_query"), F.col("page").alias("k_page"), F.col("score").alias("page_score"), "page_rank")
    mine = hits.join(k, (F.col("query_id") == F.col("k_query")) & F.col("page").eqNullSafe(F.col("k_page"))).drop("k_query", "k_page")
    title = F.trim(F.coalesce("title", F.lit("")))
    mine = mine.withColumn("place", F.row_number().over(best_first(["query_id", "page"]))).withColumn("title", title)
    shown = described(mine.where("place <= 3"), chunks, "text", few=few).select("query_id", *CHUNK, snippet(F.col("text")).alias("snippet"))
    mine = mine.join(shown, ["query_id", *CHUNK], "left")
    one = F.struct("place", "title", "chunk_type", "snippet", "score")
    page = mine.groupBy("query_id", "page_rank", "page", "page_score").agg(F.array_sort(F.collect_list(one)).alias("all"))
    sections = F.array_distinct(F.filter(F.transform("all", lambda x: x["title"]), lambda t: t != ""))
    said = shown_score if as_shown else lambda c: c
    evidence = F.transform(F.slice("all", 1, 3), lambda x: F.struct(x["chunk_type"].alias("type"), x["title"].alias("title"), x["snippet"].alias("snippet"), said(x["score"]).alias("score")))
    return page.select("query_id", "page_rank", "page", said(F.col("page_score")).alias("score"), sections.alias("sections"), evidence.alias("evidence"))


def context(hits: DataFrame, budget: int = 4000) -> DataFrame:
    """(query_id, context): ranked chunks under their headings, cut at the budget; gaps don't count."""
    head = F.concat(F.lit("[page "), F.col("page").cast("string"), F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit(" - "), F.col("title"))).otherwise(F.lit("")), F.lit("]\n"))
    before = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    cut = hits.withColumn("piece", F.concat(head, collapse(F.col("text"))))
    cut = cut.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0))).where(F.col("start") < budget)
    cut = cut.withColumn("piece", F.left("piece", (F.lit(budget) - F.col("start")).cast("int")))
    return cut.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "piece"))), lambda x: x["piece"]), "\n\n").alias("context"))


def citations(hits: DataFrame) -> DataFrame:
    """(query_id, page, title, rank): the first chunk of each page."""
    first = hits.groupBy("query_id", "page").agg(F.min(F.struct("rank", "title")).alias("x"))
    return first.select("query_id", "page", F.col("x.title").alias("title"), F.col("x.rank").alias("rank"))


def answers(queries: DataFrame, hits: DataFrame, generate: Callable[[Column], Column], empty: str = "Nothing relevant was found.", budget: int = 4000) -> DataFrame:
    """(query_id, answer, citations): what `generate`, an expression or pandas UDF of a prompt, says from the hits' excerpts.

    A query without hits gets `empty`, and no citations.
    """
    cited = citations(hits).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "page", "title"))).alias("c"))
    cited = cited.select("query_id", F.transform("c", lambda x: F.struct(x["page"].alias("page"), x["title"].alias("title"))).alias("citations"))
    rows = queries.select("query_id", "text").join(context(hits, budget), "query_id", "left").join(cited, "query_id", "left")
    asked = rows.where(F.coalesce("context", F.lit("")) != "").withColumn("answer", F.trim(generate(answer_prompt(F.col("context"), F.col("text")))))
    other = rows.where(F.coalesce("context", F.lit("")) == "").withColumn("answer", F.lit(empty))
    return asked.unionByName(other).select("query_id", "answer", F.coalesce("citations", F.array().cast("array<struct<page:bigint,title:string>>")).alias("citations"))


INSTRUCTION = "Answer from the excerpts below and from nothing else. Name the page behind each statement, as in (p. 3). Say so if they hold no answer. Use at most three sentences."


def answer_prompt(context: Column, question: Column) -> Column:
    """The prompt of a grounded answer."""
    return F.concat(F.lit(f"{INSTRUCTION}\n\nExcerpts:\n\n"), context, F.lit("\n\nQuestion: "), question)


def blend(base: DataFrame, other: DataFrame, share: float | Column) -> DataFrame:
    """(1 - share) * base + share * other, both (query_id, collection, chunk_seq, score); a share of 0 leaves base."""
    if not isinstance(share, Column) and share <= 0:
        return base
    o = other.select("query_id", *CHUNK, F.col("score").alias("other_score"))
    return base.join(o, ["query_id", *CHUNK]).withColumn("score", (1 - share) * F.col("score") + share * F.col("other_score")).drop("other_score")


def rerank_pages(hits: DataFrame, scorer: Column, pool: int = 20, share: float | Column = 0.6, grid: DataFrame | None = None, chunks: DataFrame | None = None, few: bool = False) -> DataFrame:
    """The pool's pages by a second score, an expression or pandas UDF over a chunk's columns, blended with the first.

    `share` is the second score's; a column of `grid` (crossed with the few pages of the pools) gives
    the ranks of all its values at once. `chunks` gives columns that the scorer needs beside the hits'.
    """
    page = page_scores(hits, pool).withColumnRenamed("score", "first")
    mine = hits.join(page.select("query_id", "page"), ["query_id", "page"], "left_semi")
    if chunks is not None:
        mine = described(mine, chunks, *[c for c in chunks.columns if c not in (*CHUNK, *hits.columns, "embedding")], few=few)
    both = minmax(page.join(mine.groupBy("query_id", "page").agg(F.max(scorer).alias("second")), ["query_id", "page"]), "first", "second")
    extra = [] if grid is None else grid.columns
    both = both if grid is None else both.crossJoin(F.broadcast(grid))
    s = share if isinstance(share, Column) else F.lit(share)
    both = both.withColumn("score", (1 - s) * F.col("norm_first") + s * F.col("norm_second"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", *extra).orderBy(F.desc(F.round("score", 9)), "page_rank"))).select(*extra, "query_id", "page", "rank", "score")
