"""The registered queries, and for each the SQL that states the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, elements, evaluate, search, vector_index
from ..sources import store
from ..sources.store import written
from . import bindings as b
from . import oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
R6 = 6


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _docs(s: SparkSession, d: str) -> DataFrame:
    return b.table(s, d, "documents")


@query(oracle.TOKENIZE)
def f1_tokenize(s, d):
    return _docs(s, d).select("doc_id", F.array_join(T.tokenize(F.col("text")), " ").alias("terms"))


@query(oracle.BOILERPLATE_KEY)
def f3_boilerplate_key(s, d):
    return _docs(s, d).select("doc_id", T.boilerplate_key(F.col("text")).alias("key"))


@query(oracle.KEYWORDS)
def f5_keywords(s, d):
    return _docs(s, d).select("doc_id", F.array_join(T.keywords(F.col("text")), ", ").alias("words"))


@query(oracle.FIRST_SENTENCE)
def f6_first_sentence(s, d):
    return _docs(s, d).select("doc_id", T.first_sentence(F.col("text")).alias("sentence"))


@query(oracle.SNIPPET)
def f11_snippet(s, d):
    return _docs(s, d).select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query(oracle.DOC_INPUT)
def p3_doc_input(s, d):
    return b.corpus(s, d).select("chunk_seq", T.document_input(F.when(F.col("chunk_seq") % 5 == 0, " ").otherwise(F.col("title")), F.col("text")).alias("prompt"))


@query(oracle.QUERY_INPUT)
def p5_query_input(s, d):
    return b.queries(s, d).select("query_id", T.query_input(F.col("text")).alias("prompt"))


@query(oracle.KEYS)
def f21_keys(s, d):
    return b.corpus(s, d).select("chunk_seq", T.digest_id(F.col("chunk_seq").cast("string"), F.col("chunk_type"), F.col("text")).alias("chunk_id"))


@query(oracle.MARKDOWN)
def f8_markdown_table(s, d):
    row = F.array(F.concat_ws(" | ", "n_name", F.col("n_nationkey").cast("string")), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name")), F.lit("  a  b "))
    row = F.when(F.col("n_nationkey") % 3 == 0, F.slice(row, 1, 2)).otherwise(row)
    rows = b.table(s, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))).alias("x"))
    return rows.select("n_regionkey", T.rows_to_markdown(F.transform("x", lambda x: x["r"])).alias("markdown"))


def _part_tables(s, d):
    p = b.table(s, d, "part").withColumn("g", F.col("p_partkey") % 10)
    cells = F.array(F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_brand"), F.col("p_type"))
    rows = p.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("p_partkey", cells.alias("r")))).alias("x"))
    return rows.select(F.col("g").alias("table_id"), T.rows_to_markdown(F.transform("x", lambda x: x["r"])).alias("markdown"), F.concat(F.lit("Table "), F.col("g").cast("string")).alias("caption"))


@query(oracle.SPLIT)
def c3_split_table(s, d):
    return chunking.split_tables(_part_tables(s, d))


@query(oracle.HTML_TABLE)
def f9_html_markdown(s, d):
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    n = b.table(s, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.concat(F.lit("<tr>"), cell(F.col("n_name")), cell(F.col("n_nationkey").cast("string")), F.lit("</tr>")).alias("h")))).alias("x"))
    html = F.concat(F.lit("<p>x</p><table>"), F.array_join(F.transform("x", lambda x: x["h"]), ""), F.lit("</table>"))
    rows = n.select("n_regionkey", chunking.html_table_rows(html).alias("rows"))
    return rows.select("n_regionkey", T.rows_to_markdown(F.col("rows"), False).alias("markdown"))


@query(oracle.BOILERPLATE)
def a1_boilerplate(s, d):
    return elements.detect_boilerplate(b.elements(s, d), 0.1).select("doc_id", "key", "pages", "total_pages")


@query(oracle.BOILERPLATE_DEFAULT)
def a1_boilerplate_default(s, d):
    return elements.detect_boilerplate(b.elements(s, d)).select("doc_id", "key", "pages", "total_pages")


@query(oracle.STRIPPED)
def p1_strip(s, d):
    e = b.elements(s, d)
    return elements.strip_boilerplate(e, elements.detect_boilerplate(e, 0.1)).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"), F.sum("idx").alias("idx_sum"))


@query(oracle.RUNNING)
def w1_running_title(s, d):
    return elements.running_titles(b.elements(s, d)).select("doc_id", "idx", "running_title")


@query(oracle.TABLE_CAPTION)
def w3_table_caption(s, d):
    return elements.table_captions(b.elements(s, d)).select("doc_id", "idx", "caption")


@query(oracle.FIGURE_CAPTION)
def w4_figure_caption(s, d):
    return elements.figure_captions(b.elements(s, d)).select("doc_id", "idx", "caption")


@query(oracle.ROUTE)
def p2_route(s, d):
    parts = elements.route(b.elements(s, d))
    counts = [v.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "doc_id", "n") for k, v in parts.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(oracle.TEXT_TABLES)
def j4_text_layer_tables(s, d):
    e = b.elements(s, d)
    t = e.where("category = 'Table' and idx % 2 = 0").select("doc_id", "page", (F.col("idx") % 3).alias("n"), F.concat(F.lit("t"), F.col("idx").cast("string")).alias("markdown"))
    t = t.groupBy("doc_id", "page", "n").agg(F.min("markdown").alias("markdown"))
    return elements.match_text_tables(e, t).select("doc_id", "idx", F.coalesce(T.blank_to_null(F.col("markdown")), F.left("text", F.lit(20))).alias("table_text"))


def _overlap_input(s, d):
    c = b.corpus(s, d).select(F.col("page").alias("doc_id"), F.lit(1).alias("page"), "chunk_type", F.col("chunk_seq").alias("build_seq"), (F.col("chunk_seq") % 2 + 1).cast("int").alias("table_part"), "text")
    return chunking.reading_order(c)


@query(oracle.OVERLAP)
def w7_overlap(s, d):
    return chunking.cross_chunk_overlap(_overlap_input(s, d))


@query(oracle.READING_ORDER)
def w8_reading_order(s, d):
    return _overlap_input(s, d).select("doc_id", "build_seq", "chunk_seq")


@query(oracle.SECTION_CHUNKS)
def c1_section_chunks(s, d):
    return chunking.section_chunks(b.elements(s, d))


@query(oracle.IMAGE_BODY)
def f15_image_body(s, d):
    c = b.corpus(s, d)
    words = F.when(F.col("chunk_seq") % 2 == 0, T.keywords(F.col("text"), 5)).otherwise(F.array().cast("array<string>"))
    caption = F.when(F.col("chunk_seq") % 3 == 0, F.col("title")).otherwise(F.lit(""))
    return c.select("chunk_seq", chunking.image_body(caption, words, F.col("text"), F.when(F.col("chunk_seq") % 5 == 0, F.lit("")).otherwise(F.col("title"))).alias("body"))


@query(oracle.SUMMARY)
def a18_chunk_summary(s, d):
    return chunking.chunk_summary(b.corpus(s, d))


@query(oracle.UNION)
def u1_union(s, d):
    c = b.corpus(s, d).select("chunk_seq", "chunk_type")
    parts = [c.where(F.col("chunk_type") == k).withColumn(f"{k}_only", F.lit(1)) for k in ("text", "table", "image")]
    return parts[0].unionByName(parts[1], True).unionByName(parts[2], True)


@query(oracle.IDF)
def a7_idf(s, d):
    return search.inverse_frequencies(b.corpus(s, d)).select("term", "df", F.round("idf", R6).alias("idf"))


def _rounded(df: DataFrame, *keys: str, scores: tuple[str, ...] = ("score",)) -> DataFrame:
    return df.select(*keys, *[F.round(c, R6).alias(c) for c in scores])


@query(oracle.BM25)
def r1_bm25(s, d):
    hits = search.bm25(b.corpus(s, d), b.queries(s, d)).withColumn("score", F.col("bm25"))
    return _rounded(search.top(hits, 10), "query_id", "rank", "chunk_seq")


@query(oracle.BM25)
def r5_stored_lexicon(s, d):
    """As r1_bm25, from blocks of postings that are written first, those read that bounds leave."""
    path = store.scratch(s, "lexicon")
    search.lexicon(b.corpus(s, d)).save(path)
    return _rounded(search.best_bm25(search.StoredLexicon.load(s, path), b.queries(s, d), 10), "query_id", "rank", "chunk_seq")


@query(oracle.COLLECTIONS)
def r3_collections(s, d):
    c, q = b.collections(s, d)
    hits = search.lift_sections(search.described(search.fuse(search.scored(c, q)), c, "title"))
    return _rounded(search.top(hits, 10), "query_id", "collection", "rank", "chunk_seq", scores=("score", "cos", "bm25"))


@query(oracle.DENSE)
def r2_dense(s, d):
    return _rounded(search.nearest(b.chunks(s, d), b.queries(s, d), 10), "query_id", "rank", "chunk_seq")


@query(oracle.FILTERED)
def s8_filtered_knn(s, d):
    return _rounded(search.nearest(b.chunks(s, d), b.queries(s, d), 10, "table"), "query_id", "rank", "chunk_seq")


@query(oracle.FILTERED)
def s8_vector_index(s, d):
    """As s8_filtered_knn, from an index that is built and stored first: exact, by the lists' bounds."""
    index = vector_index.build(b.chunks(s, d).drop("text"), store.scratch(s, "vectors"))
    return _rounded(vector_index.nearest(index, b.queries(s, d), 10, "table", exact=True), "query_id", "rank", "chunk_seq")


@query(oracle.MINMAX)
def f2_minmax(s, d):
    return _rounded(search.scored(b.chunks(s, d), b.queries(s, d), b.lexical(s, d)), "query_id", "chunk_seq", scores=("cos", "bm25", "norm_cos", "norm_bm25"))


def _search(s, d, **kw):
    return _rounded(search.search(b.chunks(s, d), b.queries(s, d), 10, words=b.lexical(s, d), **kw), "query_id", "rank", "chunk_seq", "page", scores=("score", "cos", "bm25"))


@query(oracle.search("0.6 * norm_cos + 0.4 * norm_bm25"))
def r3_hybrid(s, d):
    return _search(s, d)


@query(oracle.search("norm_cos"))
def r3_vector(s, d):
    return _search(s, d, mode="vector")


@query(oracle.search("norm_bm25"))
def r3_bm25(s, d):
    return _search(s, d, mode="bm25")


@query(oracle.search("0.6 * norm_cos + 0.4 * norm_bm25", "WHERE chunk_type IN ('text', 'image')"))
def p7_post_filter(s, d):
    return _search(s, d, types=["text", "image"])


def _pairs(s, d, **kw) -> search.Pairs:
    return search.pairs(b.chunks(s, d), b.queries(s, d), b.lexical(s, d), **kw)


#: Hybrid scores with the lift of sections.
LIFTED = search.Point(search.mixed(0.6), (0.5, 4))


def _best_lifted(s, d, k: int) -> DataFrame:
    return search.best_of(_pairs(s, d, sections=4), k, [LIFTED])


def _page_hits(s, d, k: int) -> tuple[DataFrame, bool]:
    """The chunks of each query's k best pages with their lifted scores, and whether they are few."""
    hits, few = search.gathered(search.page_hits(_pairs(s, d, sections=4), LIFTED, k))
    return search.gathered(search.described(hits, b.lexical(s, d), "title", "chunk_type", few=few))


def _best_texts(s, d, k: int) -> DataFrame:
    hits, few = search.gathered(_best_lifted(s, d, k).drop("page"))
    return search.described(hits, b.lexical(s, d), "page", "title", "chunk_type", "text", few=few)


@query(oracle.SECTION)
def r6_section(s, d):
    return _rounded(_best_lifted(s, d, 20), "query_id", "rank", "chunk_seq")


@query(oracle.PAGES)
def r7_pages(s, d):
    hits, few = _page_hits(s, d, 8)
    return search.pages(hits, b.lexical(s, d), few=few).select(
        "query_id", "page_rank", "page", F.round("score", R6).alias("score"), F.array_join("sections", "|").alias("sections"),
        F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["type"], e["title"], e["snippet"])), "|").alias("evidence"),
    )


@query(oracle.TOP_CHUNKS)
def r8_top_chunks(s, d):
    return _best_texts(s, d, 6).select("query_id", "rank", "page", "title", "chunk_type", "text")


@query(oracle.CONTEXT)
def w9_context(s, d):
    return search.context(_best_texts(s, d, 6))


@query(oracle.CITATIONS)
def w10_citations(s, d):
    hits, few = search.gathered(_best_lifted(s, d, 6))
    return search.citations(search.described(hits, b.lexical(s, d), "title", few=few))


def _metadata(s, d) -> search.Pairs:
    """With a channel `meta` over what describes a chunk; vectors are those of the texts."""
    described = T.descriptor(F.col("title"), F.lit(""), F.lit(""), F.col("chunk_type"))
    q2 = b.queries(s, d).withColumn("text", F.concat(F.col("text"), F.lit(" src0 en table")))
    return _pairs(s, d, texts={"meta": (described, q2)})


def _with_metadata(share: float) -> search.Point:
    base, meta = search.mixed(0.6), search.mixed(0.6)
    return search.Point(lambda x: (1 - share) * base(x) + share * meta({"cos": x["cos"], "bm25": x["meta"]}))


def _passage(s, d) -> search.Pairs:
    """With a channel `passage` by another vector of each query; queries without one have no hits."""
    e = b.table(s, d, "embeddings").select((F.col("vec_id") - 1).alias("query_id"), F.col("embedding").alias("qvec"))
    return _pairs(s, d, vectors={"passage": b.queries(s, d).select("query_id").join(e, "query_id")})


def _with_passage(share: float) -> search.Point:
    base = search.mixed(0.6)
    return search.Point(lambda x: (1 - share) * base(x) + share * x["passage"])


@query(oracle.METADATA)
def r9_metadata(s, d):
    return _rounded(search.best_of(_metadata(s, d), 10, [_with_metadata(0.3)]), "query_id", "rank", "chunk_seq")


@query(oracle.PASSAGE)
def r10_passage(s, d):
    return _rounded(search.best_of(_passage(s, d), 10, [_with_passage(0.5)]), "query_id", "rank", "chunk_seq")


@query(oracle.RERANK)
def r11_rerank(s, d):
    hits, few = _page_hits(s, d, 20)
    return _rounded(search.rerank_pages(hits, F.length("text") % 97, chunks=b.lexical(s, d), few=few), "query_id", "page", "rank")


def _pool(s, d, k: int = 40) -> DataFrame:
    return evaluate.ranked_pages(search.search(b.chunks(s, d), b.queries(s, d), k, words=b.lexical(s, d)))


def _metrics(s, d) -> DataFrame:
    return evaluate.metrics(_pool(s, d), b.gold(s, d)).join(b.queries(s, d).select("query_id", "kind", "holdout"), "query_id")


ALL_MEASURES = (*[f"hit_{k}" for k in (1, 3, 5, 10)], *[f"recall_{k}" for k in (1, 3, 5, 10)], "ndcg")
MEASURES = ("hit_1", "hit_3", "recall_5", "recall_10", "ndcg")


@query(oracle.EVAL)
def e1_eval(s, d):
    return _rounded(_metrics(s, d), "query_id", "first_rank", scores=MEASURES)


@query(oracle.SPLITS)
def a14_splits(s, d):
    return _rounded(evaluate.by_split(_metrics(s, d)), "split", "queries", scores=MEASURES)


@query(oracle.KINDS)
def a15_by_kind(s, d):
    return _rounded(evaluate.averages(_metrics(s, d), "kind"), "kind", "queries", scores=MEASURES)


@query(oracle.MISSES)
def a16_missing(s, d):
    return evaluate.miss_report(_pool(s, d), b.gold(s, d))


@query(oracle.PAGE_MIX)
def a17_page_mix(s, d):
    return evaluate.page_composition(b.corpus(s, d))


@query(oracle.MISSED)
def j8_missed(s, d):
    return evaluate.missed(_pool(s, d), b.gold(s, d))


@query(oracle.WORST)
def t6_worst(s, d):
    return _rounded(_metrics(s, d).orderBy(F.round("ndcg", 9), "query_id").limit(10), "query_id", scores=("ndcg",))


@query(oracle.CHANGED)
def j10_changed(s, d):
    best, g = written(_modes(s, d, 40, ("vector", "hybrid")), "modes"), written(b.gold(s, d), "gold")
    ranks = [evaluate.metrics(evaluate.ranked_pages(best.where(F.col("mode") == m)), g).select("query_id", F.coalesce("first_rank", F.lit(99)).alias(m)) for m in ("vector", "hybrid")]
    return ranks[0].join(ranks[1], "query_id").withColumn("changed", F.col("vector") != F.col("hybrid"))


def _steps(name: str, steps: int) -> list[dict]:
    return [{name: i / steps} for i in range(steps + 1)]


def _by_alpha(c: DataFrame, q: DataFrame, texts: DataFrame) -> DataFrame:
    """The first 40 chunks at each share of the vectors, with their pages."""
    grid = _steps("alpha", 10)
    return search.best_of(search.pairs(c, q, texts), 40, [search.Point(search.mixed(p["alpha"])) for p in grid], grid)


@query(oracle.ALPHA)
def j11_alpha_sweep(s, d):
    by = ("alpha", "query_id")
    per = evaluate.metrics(evaluate.ranked_pages(_by_alpha(b.chunks(s, d), b.queries(s, d), b.lexical(s, d)), by), b.gold(s, d), by=by)
    return _rounded(evaluate.averages(per, "alpha"), "alpha", "queries", scores=MEASURES)


@query(oracle.SECTIONS_SWEEP)
def j11_decay_group_sweep(s, d):
    grid = [{"decay": x, "max_group": g} for x in (0.0, 0.3, 0.5, 0.7, 0.85, 1.0) for g in (2, 4, 8, 1000)]
    score = search.mixed(0.6)
    best = search.best_of(_pairs(s, d, sections=1000), 40, [search.Point(score, (p["decay"], p["max_group"])) for p in grid], grid)
    by = ("decay", "max_group", "query_id")
    per = evaluate.metrics(evaluate.ranked_pages(best, by), b.gold(s, d), by=by)
    return _rounded(evaluate.averages(per, "decay", "max_group"), "decay", "max_group", "queries", scores=MEASURES)


def _swept(s, d, hits: DataFrame, by: tuple[str, ...], pool: int | None = 40, ks: tuple[int, ...] = (1, 3, 5, 10), tuning: bool = False) -> DataFrame:
    """Averages by all of `by` but the query, over its first `pool` chunks, found already if hits have ranks (None: over pages, of which hits have the best chunks); of the tuning queries only, if so asked."""
    q = b.queries(s, d).select("query_id", "holdout")
    if tuning:
        hits = hits.join(F.broadcast(q.where("not holdout").select("query_id")), "query_id", "left_semi")
    best = hits if pool is None or "rank" in hits.columns else search.top(hits, pool, by)
    best = best if "page" in best.columns else search.described(best, b.chunks(s, d), "page")
    ranked = evaluate.all_pages(best, by) if pool is None else evaluate.ranked_pages(best, by)
    gold = b.gold(s, d).join(q.where("not holdout") if tuning else q, "query_id", "left_semi")
    per = evaluate.metrics(ranked, gold, ks, by=by)
    group = [c for c in by if c != "query_id"]
    measures = (*[f"hit_{k}" for k in ks], *[f"recall_{k}" for k in ks], "ndcg")
    return _rounded(evaluate.averages(per, *group, columns=measures), *group, "queries", scores=measures)


#: The most pages that `_swept` looks at in a whole ranking: what comes after changes no measure.
DEEP = (1, 3, 5, 10, 20)


def _by_gamma(s, d, steps: int) -> DataFrame:
    """The first pages, by their best chunks, at each share of the metadata."""
    grid = _steps("gamma", steps)
    return search.best_pages(_metadata(s, d), max(DEEP), [_with_metadata(p["gamma"]) for p in grid], grid)


def _by_beta(s, d, steps: int) -> DataFrame:
    """The first 40 chunks at each share of the passages."""
    grid = _steps("beta", steps)
    return search.best_of(_passage(s, d), 40, [_with_passage(p["beta"]) for p in grid], grid)


@query(oracle.SECTION_EVAL)
def e2_section_eval(s, d):
    """Without section lift, and with the strong setting, over all chunks."""
    grid, score = [{"decay": 0.0}, {"decay": 0.85}], search.mixed(0.6)
    best = search.best_pages(_pairs(s, d, sections=8), max(DEEP), [search.Point(score, (p["decay"], 8)) for p in grid], grid)
    return _swept(s, d, best, ("decay", "query_id"), None, DEEP)


@query(oracle.PASSAGE_EVAL)
def e3_passage_eval(s, d):
    return _swept(s, d, _by_beta(s, d, 2), ("beta", "query_id"))


@query(oracle.PASSAGE_SWEEP)
def j11_beta_sweep(s, d):
    return _swept(s, d, _by_beta(s, d, 5), ("beta", "query_id"), tuning=True)


@query(oracle.METADATA_EVAL)
def e4_metadata_eval(s, d):
    return _swept(s, d, _by_gamma(s, d, 2), ("gamma", "query_id"), None, DEEP)


@query(oracle.METADATA_SWEEP)
def j11_gamma_sweep(s, d):
    return _swept(s, d, _by_gamma(s, d, 10), ("gamma", "query_id"), None, DEEP, tuning=True)


def _reranked(s, d, shares: int) -> DataFrame:
    """(share, query_id, page, page_rank) for shares of the second score from 0 (retrieval only) to 1."""
    grid = s.range(shares + 1).select((F.col("id") / shares).alias("share"))
    hits, few = _page_hits(s, d, 20)
    ranked = search.rerank_pages(hits, F.length("text") % 97, share=F.col("share"), grid=grid, chunks=b.lexical(s, d), few=few)
    return ranked.select("share", "query_id", "page", F.col("rank").alias("page_rank"))


@query(oracle.RERANK_EVAL)
def e5_rerank_eval(s, d):
    per = evaluate.metrics(_reranked(s, d, 2), b.gold(s, d), by=("share", "query_id"))
    return _rounded(evaluate.averages(per, "share", columns=ALL_MEASURES), "share", "queries", scores=ALL_MEASURES)


@query(oracle.RERANK_SWEEP)
def j11_blend_sweep(s, d):
    q = b.queries(s, d).where("not holdout").select("query_id")
    per = evaluate.metrics(_reranked(s, d, 5).join(q, "query_id", "left_semi"), b.gold(s, d).join(q, "query_id", "left_semi"), by=("share", "query_id"))
    return _rounded(evaluate.averages(per, "share", columns=ALL_MEASURES), "share", "queries", scores=ALL_MEASURES)


@query(oracle.WORST_RERANKED)
def t7_worst_reranked(s, d):
    per = evaluate.metrics(_reranked(s, d, 1).where("share = 1").drop("share"), b.gold(s, d))
    return evaluate.worst_by_rank(per).select("query_id", F.coalesce("first_rank", F.lit(99)).alias("first_rank"))


def _modes(s, d, k: int, modes: tuple[str, ...] = ("vector", "bm25", "hybrid")) -> DataFrame:
    return search.best_of(_pairs(s, d), k, [search.Point(search.mode_score(m)) for m in modes], [{"mode": m} for m in modes])


@query(oracle.STRICT)
def e6_strict_recall(s, d):
    per = evaluate.strict_recall(_modes(s, d, 5), b.gold(s, d), by=("mode", "query_id"))
    return _rounded(evaluate.averages(per, "mode", columns=("recall_1", "recall_3", "recall_5")), "mode", "queries", scores=("recall_1", "recall_3", "recall_5"))


def _dense_only(s, d, types: list[str]) -> DataFrame:
    c = b.chunks(s, d).where(F.col("chunk_type").isin(types))
    return search.described(search.nearest(c, b.queries(s, d), 5), c, "page", "chunk_type")


@query(oracle.DENSE_EVAL)
def e7_dense_eval(s, d):
    per = evaluate.strict_recall(_dense_only(s, d, ["text", "table"]), b.gold(s, d))
    return per.select("query_id", "recall_1", "recall_3", "recall_5", F.coalesce("first_rank", F.lit(0)).alias("first_rank"))


@query(oracle.DENSE_TYPES)
def e7_dense_types(s, d):
    return evaluate.top_types(_dense_only(s, d, ["text", "table"]))


@query(oracle.TUNING_ALPHA)
def e8_alpha_tuning(s, d):
    return _swept(s, d, _by_alpha(b.chunks(s, d), b.queries(s, d).where("not holdout"), b.lexical(s, d)), ("alpha", "query_id"), tuning=True)


@query(oracle.PROFILE)
def j12_gold_profile(s, d):
    """Gold, and for each of its pages one that lies beyond the last page, against what the index has of them."""
    index = b.corpus(s, d)
    beyond = b.gold(s, d).crossJoin(F.broadcast(index.agg(F.max("page").alias("last")))).select("query_id", (F.col("page") + F.col("last") + 1).alias("page"), "grade")
    return evaluate.gold_profile(b.gold(s, d).unionByName(beyond), evaluate.page_composition(index)).select("query_id", "page", "grade", "composition")


@query(oracle.MISSES_BY_KIND)
def a16_misses_by_kind(s, d):
    return evaluate.misses_by(_pool(s, d), b.gold(s, d), b.queries(s, d), "kind")


@query(oracle.MOST_MISSED)
def a16_most_missed(s, d):
    return evaluate.most_missed(_pool(s, d), b.gold(s, d), evaluate.page_composition(b.corpus(s, d))).select("page", "missed", "composition")


@query(oracle.ROUNDED)
def f13_shown_score(s, d):
    """Scores of pages and of their first evidence, as they are shown."""
    hits, few = _page_hits(s, d, 8)
    p = search.pages(hits, b.lexical(s, d), as_shown=True, few=few)
    return p.select("query_id", "page_rank", "page", "score", F.col("evidence")[0]["score"].alias("first_score"))


@query(oracle.STOP_UNION)
def u2_stop_union(s, d):
    """Keywords of documents, without the words of two lists."""
    words = T.stop_union(T.KEYWORD_STOPWORDS, ("datasheet", "via", "which", "der", "die", "les", "los"))
    return _docs(s, d).select("doc_id", F.array_join(T.keywords(F.col("text"), stop=words), ", ").alias("words"))


@query(oracle.TOP_TYPE)
def a19_top_type(s, d):
    return evaluate.top_types(search.search(b.chunks(s, d), b.queries(s, d), 1, words=b.lexical(s, d)))


@query(oracle.SECTION_STATS)
def a20_section_stats(s, d):
    return evaluate.section_stats(b.corpus(s, d))


@query(oracle.MEDIAN)
def a21_median(s, d):
    return evaluate.median_by(_docs(s, d), "n_chars", "lang").withColumnRenamed("median_n_chars", "median_chars")


def _tables(s, d) -> DataFrame:
    """A text layer's tables: two rows for every other table of the layout."""
    e = b.elements(s, d).where("category = 'Table' and idx % 2 = 0")
    cells = F.array(F.array(F.lit("line"), F.lit("words")), F.array(F.left("text", F.lit(60)), F.size(F.split("text", " ")).cast("string")))
    n = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("idx")) - 1
    return e.select("doc_id", "page", n.alias("n"), cells.alias("rows"))


def _chunked(s, d) -> DataFrame:
    words = F.when(F.col("idx") % 2 == 0, F.col("text")).otherwise(F.lit(""))
    return chunking.chunk_documents(b.elements(s, d), _tables(s, d), captioner=F.lit("A figure. More of it."), ocr=words)


@query()
def c9_chunk_documents(s, d):
    return _chunked(s, d).select("doc_id", "chunk_seq", "chunk_type", "page", "title", "text", "char_count", "overlap_prefix_chars", "table_part", "table_source", "chunk_id")


@query(oracle.TABLE_SOURCES)
def c2_table_chunks(s, d):
    """The parts of all tables, with where they come from."""
    e = b.elements(s, d)
    titled = elements.running_titles(e)
    tables = elements.match_text_tables(elements.table_captions(titled), elements.text_tables(_tables(s, d)))
    return chunking.table_chunks(tables).select("doc_id", "idx", "page", "table_source", "table_caption", "table_part", "table_parts_total", "text")


@query()
def e10_verify(s, d):
    return chunking.verify_chunks(_chunked(s, d))


@query(oracle.LAYER)
def s3_text_layer(s, d):
    """Tables whose rows are all repeating lines are left out, others numbered anew."""
    e = b.elements(s, d)
    lines = e.where("category = 'FigureCaption'").select("doc_id", "page", (F.col("idx") % 100000).cast("int").alias("n"), F.array(F.array("text"), F.array(F.concat("text", F.when(F.col("idx") % 2 == 0, "").otherwise("!")))).alias("rows"))
    found = elements.detect_boilerplate(e, 0.1)
    return elements.text_tables(lines, found).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("tables"), F.max("n").alias("last"))


@query(oracle.DUPLICATES)
def s6_duplicate_guard(s, d):
    return store.duplicates(_docs(s, d).withColumn("chunk_id", F.sha2("text", 256)))


@query(oracle.REGISTER)
def s11_register(s, d):
    return store.register(b.corpus(s, d).withColumnRenamed("title", "doc_id"))
