"""SQL for the registered queries, in the dialect of the checking engine."""

from __future__ import annotations

from ..functions.text import STOPWORDS

# Fixed values, stated here on their own: words that keyword extraction leaves out.
KEYWORD_STOP = """
a about above after again all am an and any are as at be because been before being below between both but by can did do
does doing down during each few for from further had has have having he her here hers herself him himself his how i if
in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out
over own s same she should so some such t than that the their theirs them themselves then there these they this those
through to too under until up very was we were what when where which while who whom why will with you your yours
yourself yourselves
""".split()
_KEYWORD_STOP = "[" + ", ".join(f"'{w}'" for w in KEYWORD_STOP) + "]"
_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
_WS = r"[\x09-\x0D\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _collapse(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{_WS}', ' ', 'g'), ' ')"


def _strip(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '^{_WS}|{_WS}$', '', 'g')"


def _tokens(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower({c}), '[a-z0-9_]+'), lambda t: length(t) > 1 AND NOT list_contains({_STOP}, t))"


def _keywords(c: str, n: int, key: str, frm: str) -> str:
    """CTE words(key, words): the first n distinct keywords in order, joined."""
    raw = f"list_transform(regexp_extract_all({c}, '[A-Za-z][A-Za-z0-9\\-_/%.]*'), lambda w: lower(regexp_replace(w, '^[.\\-_/]+|[.\\-_/]+$', '', 'g')))"
    return f"""kept AS (SELECT {key}, list_filter({raw}, lambda w: length(w) >= 3 AND NOT list_contains({_KEYWORD_STOP}, w) AND regexp_matches(w, '[a-z]')) AS k FROM {frm}),
each AS (SELECT {key}, unnest(k) AS w, unnest(range(len(k))) AS i FROM kept), firsts AS (SELECT {key}, w, min(i) AS i FROM each GROUP BY ALL),
words AS (SELECT {key}, string_agg(w, ', ' ORDER BY i) AS words FROM (SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY i) <= {n}) GROUP BY {key})"""


def _sentence(c: str) -> str:
    flat, head = _collapse(c), f"split_part({_collapse(c)}, '. ', 1)"
    return f"CASE WHEN {flat} = '' THEN '' WHEN length({head}) > 200 THEN rtrim(left({head}, 200), ' ') || '.' ELSE regexp_replace({head}, '\\.+$', '') || '.' END"


CORPUS = """corpus AS (SELECT doc_id AS chunk_seq, doc_id // 10 AS page, CASE doc_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'table' ELSE 'image' END AS chunk_type,
  source || '/' || lang || '/' || (doc_id // 100) AS title, text FROM documents)"""
CHUNKS = CORPUS + ", chunks AS (SELECT c.*, embedding FROM corpus c JOIN embeddings ON vec_id = chunk_seq % (SELECT count(*) FROM embeddings))"
ASKED = """asked AS (SELECT item_id AS query_id, text, embedding AS qvec, CASE item_id % 3 WHEN 0 THEN 'word' WHEN 1 THEN 'symbol' ELSE 'table' END AS kind, item_id % 4 = 0 AS holdout
  FROM benchmark JOIN embeddings ON vec_id = item_id)"""
ELEMENTS = """lines AS (SELECT doc_id AS d, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
elements AS (SELECT d // 40 AS doc_id, CAST(d % 40 AS INT) AS page, (d % 40) * 100000 + pos AS idx, text,
  CASE WHEN pos = 0 THEN 'Title' WHEN (d + pos) % 11 = 3 THEN 'Table' WHEN (d + pos) % 13 = 5 THEN 'Image' WHEN (d + pos) % 7 = 0 THEN 'FigureCaption' ELSE 'NarrativeText' END AS category FROM lines)"""


def _bm25(p: str, text: str, asked: str = "text") -> str:
    """CTEs that end in {p}bm(query_id, chunk_seq, s)."""
    return f"""{p}tf AS (SELECT chunk_seq, term, count(*) AS tf FROM (SELECT chunk_seq, unnest({_tokens(text)}) AS term FROM chunks) GROUP BY ALL),
{p}dl AS (SELECT chunk_seq, coalesce(sum(tf), 0) AS dl FROM chunks LEFT JOIN {p}tf USING (chunk_seq) GROUP BY chunk_seq),
{p}st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {p}dl),
{p}raw AS (SELECT term, count(*) AS df, ln((SELECT n FROM {p}st) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM {p}tf GROUP BY term),
{p}idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM {p}raw) ELSE raw END AS idf FROM {p}raw),
{p}qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_tokens(asked)}) AS term FROM asked) GROUP BY ALL),
{p}bm AS (SELECT query_id, chunk_seq, sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (SELECT avgdl FROM {p}st)))) AS s
  FROM {p}qt JOIN {p}tf USING (term) JOIN {p}idf USING (term) JOIN {p}dl USING (chunk_seq) GROUP BY ALL)"""


_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"


def _norm(p: str) -> str:
    """CTE {p}norm over {p}bm and the vectors."""
    n = lambda c: f"CASE WHEN max({c}) OVER q - min({c}) OVER q < 1e-12 THEN 0 ELSE ({c} - min({c}) OVER q) / (max({c}) OVER q - min({c}) OVER q) END AS norm_{c}"
    return f"""{p}pair AS (SELECT query_id, chunk_seq, {_DOT.format(a="embedding", b="qvec")} AS cos, coalesce(s, 0) AS bm25
  FROM asked CROSS JOIN chunks LEFT JOIN {p}bm USING (query_id, chunk_seq)),
{p}norm AS (SELECT *, {n("cos")}, {n("bm25")} FROM {p}pair WINDOW q AS (PARTITION BY query_id))"""


BASE = f"WITH {CHUNKS}, {ASKED}, {_bm25('', chr(39) + chr(39) + ' || coalesce(title, ' + chr(39) + chr(39) + ') || ' + chr(39) + ' ' + chr(39) + ' || text')}, {_norm('')}"
HYBRID = BASE + ", fused AS (SELECT n.query_id, n.chunk_seq, page, title, chunk_type, text, 0.6 * norm_cos + 0.4 * norm_bm25 AS base FROM norm n JOIN chunks USING (chunk_seq))"
LIFTED = (
    HYBRID
    + """, lifted AS (SELECT *, CASE WHEN trim(title) <> '' AND count(*) OVER g BETWEEN 2 AND 4 THEN greatest(base, 0.5 * max(base) OVER g) ELSE base END AS score
  FROM fused WINDOW g AS (PARTITION BY query_id, trim(title))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_seq) AS rank FROM lifted)"""
)
ROUND = "round({0}, 6) AS {0}".format

TOKENIZE = f"SELECT doc_id, array_to_string({_tokens('text')}, ' ') AS terms FROM documents"
BOILERPLATE_KEY = f"SELECT doc_id, regexp_replace(lower({_collapse('text')}), '\\p{{Nd}}+', '#', 'g') AS key FROM documents"
KEYWORDS = f"WITH {_keywords('text', 40, 'doc_id', 'documents')} SELECT doc_id, coalesce(words, '') AS words FROM documents LEFT JOIN words USING (doc_id)"
FIRST_SENTENCE = f"SELECT doc_id, {_sentence('text')} AS sentence FROM documents"
SNIPPET = f"SELECT doc_id, left({_collapse('text')}, 400) AS snippet FROM documents"
DOC_INPUT = f"WITH {CORPUS} SELECT chunk_seq, 'title: ' || CASE WHEN chunk_seq % 5 = 0 THEN 'none' ELSE title END || ' | text: ' || text AS prompt FROM corpus"
QUERY_INPUT = f"WITH {ASKED} SELECT query_id, 'task: search result | query: ' || text AS prompt FROM asked"
KEYS = f"WITH {CORPUS} SELECT chunk_seq, left(sha256(chunk_seq || '|' || chunk_type || '|' || text), 16) AS chunk_id FROM corpus"
MARKDOWN = r"""
WITH r AS (SELECT n_regionkey, n_nationkey AS k, replace(n_name || ' | ' || n_nationkey, '|', '\|') AS a, CASE WHEN n_nationkey % 4 <> 0 THEN n_name ELSE '' END AS b,
  CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'a b' END AS c, n_nationkey % 3 <> 0 AS wide FROM nation),
w AS (SELECT *, bool_or(wide) OVER (PARTITION BY n_regionkey) AS any_wide, row_number() OVER (PARTITION BY n_regionkey ORDER BY k) AS i FROM r),
l AS (SELECT n_regionkey, i, '| ' || a || ' | ' || b || CASE WHEN any_wide THEN ' | ' || c ELSE '' END || ' |' ||
  CASE WHEN i = 1 THEN chr(10) || '| --- | --- ' || CASE WHEN any_wide THEN '| --- ' ELSE '' END || '|' ELSE '' END AS line FROM w)
SELECT n_regionkey, string_agg(line, chr(10) ORDER BY i) AS markdown FROM l GROUP BY n_regionkey
"""


def _boilerplate(ratio: float) -> str:
    return f"""WITH {ELEMENTS}, k AS (SELECT doc_id, page, regexp_replace(lower({_collapse("text")}), '\\p{{Nd}}+', '#', 'g') AS key FROM elements WHERE category NOT IN ('Table', 'Image')),
t AS (SELECT doc_id, count(DISTINCT page) AS total_pages FROM elements GROUP BY doc_id),
bp AS (SELECT doc_id, key, count(DISTINCT page) AS pages, any_value(total_pages) AS total_pages FROM k JOIN t USING (doc_id) WHERE key <> '' AND length(key) <= 160 AND total_pages >= 3
  GROUP BY doc_id, key HAVING count(DISTINCT page) >= greatest(3, {ratio} * any_value(total_pages)))"""


BOILERPLATE = _boilerplate(0.1) + " SELECT * FROM bp"
BOILERPLATE_DEFAULT = _boilerplate(0.6) + " SELECT * FROM bp"
STRIPPED = (
    _boilerplate(0.1)
    + f""" SELECT doc_id, page, count(*) AS n, CAST(sum(idx) AS BIGINT) AS idx_sum FROM elements e WHERE category IN ('Table', 'Image')
  OR NOT EXISTS (SELECT 1 FROM bp WHERE bp.doc_id = e.doc_id AND bp.key = regexp_replace(lower({_collapse("e.text")}), '\\p{{Nd}}+', '#', 'g')) GROUP BY doc_id, page"""
)
RUNNING = f"""WITH {ELEMENTS} SELECT doc_id, idx, coalesce(last_value(CASE WHEN category = 'Title' AND {_strip("text")} <> '' THEN {_strip("text")} END IGNORE NULLS)
  OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING), '') AS running_title FROM elements"""


def _caption(category: str, longest: int, words: str, steps: tuple[int, ...]) -> str:
    near = ", ".join(f"CASE WHEN lag(page, {-k}) OVER w IS NOT DISTINCT FROM page THEN lag(c, {-k}) OVER w END" for k in steps)
    return f"""WITH {ELEMENTS}, fit AS (SELECT *, CASE WHEN t <> '' AND length(t) <= {longest} AND (category = 'FigureCaption' OR regexp_matches(t, '(?i)^({words})')) THEN t END AS c
  FROM (SELECT *, {_strip("text")} AS t FROM elements)), near AS (SELECT doc_id, idx, category, coalesce({near}, '') AS caption FROM fit WINDOW w AS (PARTITION BY doc_id ORDER BY idx))
SELECT doc_id, idx, caption FROM near WHERE category = '{category}'"""


TABLE_CAPTION = _caption("Table", 400, "table|tbl|exhibit", (-1, -2, 1, 2))
FIGURE_CAPTION = _caption("Image", 300, "figure|fig", (1, 2, 3, -1, -2, -3))
ROUTE = f"WITH {ELEMENTS} SELECT CASE category WHEN 'Table' THEN 'table' WHEN 'Image' THEN 'image' ELSE 'text' END AS kind, doc_id, count(*) AS n FROM elements GROUP BY 1, 2"
TEXT_TABLES = f"""WITH {ELEMENTS}, t AS (SELECT doc_id, page, idx % 3 AS n, min('t' || idx) AS markdown FROM elements WHERE category = 'Table' AND idx % 2 = 0 GROUP BY ALL),
e AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY idx) - 1 AS n FROM elements WHERE category = 'Table')
SELECT doc_id, idx, coalesce(markdown, left(text, 20)) AS table_text FROM e LEFT JOIN t USING (doc_id, page, n)"""
READING_ORDER = f"""WITH {CORPUS} SELECT page AS doc_id, chunk_seq AS build_seq, CAST(row_number() OVER (PARTITION BY page ORDER BY CASE chunk_type WHEN 'text' THEN 1 WHEN 'table' THEN 2 ELSE 3 END, chunk_seq) - 1 AS INT) AS chunk_seq FROM corpus"""
IMAGE_BODY = f"""WITH {CORPUS}, {_keywords("text", 5, "chunk_seq", "corpus")}, p AS (SELECT chunk_seq, CASE WHEN chunk_seq % 3 = 0 THEN title END AS cap, CASE WHEN chunk_seq % 2 = 0 AND words <> '' THEN 'Keywords: ' || words END AS kw,
  CASE WHEN text <> '' THEN {_sentence("text")} END AS said, CASE WHEN chunk_seq % 5 = 0 THEN 'Figure.' ELSE 'Figure in section: ' || title END AS plain FROM corpus LEFT JOIN words USING (chunk_seq))
SELECT chunk_seq, CASE WHEN cap IS NULL AND kw IS NULL THEN plain ELSE concat_ws(chr(10) || chr(10), cap, kw, said) END AS body FROM p"""
SUMMARY = f"""WITH {CORPUS} SELECT chunk_type, count(*) AS chunks, CAST(min(length(text)) AS INT) AS shortest, CAST(max(length(text)) AS INT) AS longest,
  CAST(floor(sum(length(text)) / count(*)) AS BIGINT) AS mean_length, count(*) FILTER (length(text) > 5500) AS oversized FROM corpus GROUP BY chunk_type"""
UNION = f"WITH {CORPUS} SELECT chunk_seq, chunk_type, CASE WHEN chunk_type = 'text' THEN 1 END AS text_only, CASE WHEN chunk_type = 'table' THEN 1 END AS table_only, CASE WHEN chunk_type = 'image' THEN 1 END AS image_only FROM corpus"
_TEXT = "coalesce(title, '') || ' ' || text"
LEXICAL = f"WITH {CORPUS}, chunks AS (SELECT * FROM corpus), {ASKED}, {_bm25('', _TEXT)}"
IDF = LEXICAL + f" SELECT term, df, {ROUND('idf')} FROM idf"


def _top(frm: str, score: str, k: int, columns: str, where: str = "") -> str:
    return f"""SELECT {columns} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 9) DESC, chunk_seq) AS INT) AS rank, {score} AS score_ FROM {frm} {where}) WHERE rank <= {k}"""


_KEYS = "query_id, rank, chunk_seq, round(score_, 6) AS score"
BM25 = LEXICAL + " " + _top("bm", "s", 10, _KEYS)
DENSE = BASE + " " + _top("pair", "cos", 10, _KEYS)
FILTERED = BASE + " " + _top("pair JOIN chunks USING (chunk_seq)", "cos", 10, _KEYS, "WHERE chunk_type = 'table'")
MINMAX = BASE + f" SELECT query_id, chunk_seq, {ROUND('cos')}, {ROUND('bm25')}, {ROUND('norm_cos')}, {ROUND('norm_bm25')} FROM norm"


def search(score: str, where: str = "") -> str:
    return BASE + " " + _top("norm JOIN chunks USING (chunk_seq)", score, 10, f"{_KEYS}, page, {ROUND('cos')}, {ROUND('bm25')}", where)


SECTION = LIFTED + " SELECT query_id, CAST(rank AS INT) AS rank, chunk_seq, round(score, 6) AS score FROM ranked WHERE rank <= 20"
PAGES = (
    LIFTED
    + f""", pg AS (SELECT query_id, page, max(score) AS score, min(rank) AS first FROM ranked GROUP BY ALL),
cut AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first) AS INT) AS page_rank, max(score) OVER (PARTITION BY query_id) AS best FROM pg),
kept AS (SELECT * FROM cut WHERE page_rank <= 8 AND score >= 0.55 * best),
firsts AS (SELECT query_id, page, title, min(rank) AS r FROM ranked WHERE title <> '' GROUP BY ALL),
sec AS (SELECT query_id, page, string_agg(title, '|' ORDER BY r) AS sections FROM firsts GROUP BY ALL),
ev AS (SELECT query_id, page, string_agg(chunk_type || ':' || title || ':' || left({_collapse("text")}, 400), '|' ORDER BY rank) AS evidence
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, page ORDER BY rank) AS i FROM ranked) WHERE i <= 3 GROUP BY ALL)
SELECT query_id, page_rank, page, round(score, 6) AS score, sections, evidence FROM kept JOIN sec USING (query_id, page) JOIN ev USING (query_id, page)"""
)
TOP_CHUNKS = LIFTED + " SELECT query_id, CAST(rank AS INT) AS rank, page, title, chunk_type, text FROM ranked WHERE rank <= 6"
CONTEXT = (
    LIFTED
    + f""", piece AS (SELECT query_id, rank, '[page ' || page || ' - ' || title || ']' || chr(10) || {_collapse("text")} AS p FROM ranked WHERE rank <= 6),
run AS (SELECT *, coalesce(sum(length(p)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM piece)
SELECT query_id, string_agg(left(p, CAST(4000 - start AS BIGINT)), chr(10) || chr(10) ORDER BY rank) AS context FROM run WHERE start < 4000 GROUP BY query_id"""
)
CITATIONS = LIFTED + " SELECT query_id, page, arg_min(title, rank) AS title, CAST(min(rank) AS INT) AS rank FROM ranked WHERE rank <= 6 GROUP BY query_id, page"
METADATA = (
    BASE
    + f", {_bm25('m', 'trim(title || ' + chr(39) + ' ' + chr(39) + ' || chunk_type)', 'text || ' + chr(39) + ' src0 en table' + chr(39))}, {_norm('m')} "
    + _top("norm a JOIN (SELECT query_id, chunk_seq, norm_cos AS mc, norm_bm25 AS mb FROM mnorm) m USING (query_id, chunk_seq)", "(0.7 * (0.6 * norm_cos + 0.4 * norm_bm25) + 0.3 * (0.6 * mc + 0.4 * mb))", 10, _KEYS)
)
PASSAGE = (
    BASE
    + f""", h AS (SELECT a.query_id, c.chunk_seq, {_DOT.format(a="c.embedding", b="e.embedding")} AS hc FROM asked a JOIN embeddings e ON e.vec_id = a.query_id + 1 CROSS JOIN chunks c),
hn AS (SELECT *, (hc - min(hc) OVER q) / (max(hc) OVER q - min(hc) OVER q) AS nh FROM h WINDOW q AS (PARTITION BY query_id)) """
    + _top("norm JOIN hn USING (query_id, chunk_seq)", "(0.5 * (0.6 * norm_cos + 0.4 * norm_bm25) + 0.5 * nh)", 10, _KEYS)
)
RERANK = (
    LIFTED
    + """, pg AS (SELECT query_id, page, max(score) AS a, min(rank) AS r, CAST(max(length(text) % 97) AS DOUBLE) AS b FROM ranked GROUP BY ALL),
pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS i FROM pg QUALIFY i <= 20),
n AS (SELECT *, CASE WHEN max(a) OVER q - min(a) OVER q < 1e-12 THEN 0 ELSE (a - min(a) OVER q) / (max(a) OVER q - min(a) OVER q) END AS na,
  CASE WHEN max(b) OVER q - min(b) OVER q < 1e-12 THEN 0 ELSE (b - min(b) OVER q) / (max(b) OVER q - min(b) OVER q) END AS nb FROM pool WINDOW q AS (PARTITION BY query_id))
SELECT query_id, page, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(0.4 * na + 0.6 * nb, 9) DESC, i) AS INT) AS rank, round(0.4 * na + 0.6 * nb, 6) AS score FROM n"""
)
GOLD = """, hold AS (SELECT DISTINCT query_id, page FROM chunks c JOIN asked a ON contains(c.text, a.text)),
gold AS (SELECT query_id, page, max(grade) AS grade FROM (SELECT query_id, page, 2 AS grade FROM hold UNION ALL SELECT query_id, page + 1, 1 FROM hold) GROUP BY ALL)"""


def _evaluated(score: str, frm: str = "norm", by: str = "query_id", base: str = BASE, ks: tuple[int, ...] = (1, 3, 5, 10), pool: int = 40, tuning: bool = False, pages: str = "") -> str:
    """CTEs that end in per(by, measures, first_rank), from the `pool` best chunks, or from ranked pages."""
    rest = ", ".join(c for c in by.split(", ") if c != "query_id")
    some = "(SELECT gold.* FROM gold JOIN asked USING (query_id) WHERE NOT holdout)" if tuning else "gold"
    gold = f"(SELECT DISTINCT {by} FROM pages) k JOIN {some} USING (query_id)" if rest else some
    each = ", ".join(f"max(coalesce(CAST(page_rank <= {k} AS INT), 0)) AS hit_{k}, sum(coalesce(CAST(page_rank <= {k} AS INT), 0)) / count(*) AS recall_{k}" for k in ks)
    found = pages or f"""hits AS (SELECT {by}, page, row_number() OVER (PARTITION BY {by} ORDER BY round({score}, 9) DESC, chunk_seq) AS rank FROM {frm} JOIN (SELECT chunk_seq, page FROM chunks) USING (chunk_seq) QUALIFY rank <= {pool}),
pages AS (SELECT {by}, page, row_number() OVER (PARTITION BY {by} ORDER BY min(rank)) AS page_rank FROM hits GROUP BY {by}, page)"""
    return (
        base
        + GOLD
        + f""", {found},
met AS (SELECT {by}, page, grade, page_rank, row_number() OVER (PARTITION BY {by} ORDER BY grade DESC) AS ideal FROM {gold} LEFT JOIN pages USING ({by}, page)),
per AS (SELECT {by}, {each}, CASE WHEN sum(CASE WHEN ideal <= 5 THEN grade / log2(ideal + 1) ELSE 0 END) > 0 THEN
  sum(CASE WHEN page_rank <= 5 THEN grade / log2(page_rank + 1) ELSE 0 END) / sum(CASE WHEN ideal <= 5 THEN grade / log2(ideal + 1) ELSE 0 END) ELSE 0 END AS ndcg,
  CAST(min(page_rank) AS INT) AS first_rank FROM met GROUP BY {by})"""
    )


def _averaged(group: str, ks: tuple[int, ...] = (1, 3, 5, 10)) -> str:
    names = [*[f"hit_{k}" for k in ks], *[f"recall_{k}" for k in ks], "ndcg"]
    return f" SELECT {group}, count(*) AS queries, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in names) + f" FROM per GROUP BY {group}"


def _grid(name: str, steps: int) -> str:
    return f"(SELECT CAST(unnest(range({steps + 1})) AS DOUBLE) / {steps} AS {name})"


_HY = "0.6 * norm_cos + 0.4 * norm_bm25"
_MEASURES = ("hit_1", "hit_3", "recall_5", "recall_10", "ndcg")
_MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in _MEASURES)
EVAL = _evaluated(_HY) + " SELECT query_id, first_rank, " + ", ".join(ROUND(m) for m in _MEASURES) + " FROM per"
SPLITS = _evaluated(_HY) + f" SELECT CASE WHEN grouping(holdout) = 1 THEN 'ALL' WHEN holdout THEN 'HOLDOUT' ELSE 'TUNING' END AS split, count(*) AS queries, {_MEANS} FROM per JOIN asked USING (query_id) GROUP BY GROUPING SETS ((holdout), ())"
KINDS = _evaluated(_HY) + f" SELECT kind, count(*) AS queries, {_MEANS} FROM per JOIN asked USING (query_id) GROUP BY kind"
MISSES = (
    _evaluated(_HY)
    + """ SELECT grade, count(*) AS gold, count(*) FILTER (page_rank <= 5) AS found, count(*) FILTER (coalesce(page_rank, 99) > 5) AS missed, count(*) FILTER (page_rank BETWEEN 6 AND 10) AS recovered FROM met GROUP BY grade"""
)
PAGE_MIX = f"""WITH {CORPUS}, n AS (SELECT page, chunk_type, left(chunk_type, 3) || count(*) AS s FROM corpus GROUP BY page, chunk_type)
SELECT page, string_agg(s, '/' ORDER BY chunk_type) AS composition FROM n GROUP BY page"""
MISSED = _evaluated(_HY) + " SELECT query_id, page, grade FROM met WHERE coalesce(page_rank, 99) > 5"
WORST = _evaluated(_HY) + " SELECT query_id, round(ndcg, 6) AS ndcg FROM per ORDER BY round(per.ndcg, 9), query_id LIMIT 10"
CHANGED = (
    _evaluated(_HY)
    + """, vh AS (SELECT query_id, page, row_number() OVER (PARTITION BY query_id ORDER BY round(norm_cos, 9) DESC, chunk_seq) AS rank FROM norm JOIN (SELECT chunk_seq, page FROM chunks) USING (chunk_seq) QUALIFY rank <= 40),
vp AS (SELECT query_id, page, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS page_rank FROM vh GROUP BY query_id, page),
v AS (SELECT query_id, CAST(coalesce(min(page_rank), 99) AS INT) AS vector FROM gold LEFT JOIN vp USING (query_id, page) GROUP BY query_id)
SELECT query_id, vector, coalesce(first_rank, 99) AS hybrid, vector <> coalesce(first_rank, 99) AS changed FROM per JOIN v USING (query_id)"""
)
ALPHA = _evaluated("alpha * norm_cos + (1 - alpha) * norm_bm25", "norm CROSS JOIN (SELECT CAST(unnest(range(11)) AS DOUBLE) / 10 AS alpha)", "alpha, query_id") + f" SELECT alpha, count(*) AS queries, {_MEANS} FROM per GROUP BY alpha"
SECTIONS_SWEEP = (
    _evaluated(
        "score", "swept", "decay, max_group, query_id",
        HYBRID + """, swept AS (SELECT query_id, chunk_seq, CAST(decay AS DOUBLE) AS decay, max_group, CASE WHEN decay > 0 AND trim(title) <> '' AND count(*) OVER g BETWEEN 2 AND max_group THEN greatest(base, decay * max(base) OVER g) ELSE base END AS score
  FROM fused CROSS JOIN (SELECT unnest([0.0, 0.3, 0.5, 0.7, 0.85, 1.0]::DOUBLE[]) AS decay) CROSS JOIN (SELECT unnest([2, 4, 8, 1000]) AS max_group) WINDOW g AS (PARTITION BY query_id, trim(title), decay, max_group))""",
    )
    + f" SELECT decay, max_group, count(*) AS queries, {_MEANS} FROM per GROUP BY decay, max_group"
)
TOP_TYPE = BASE + " SELECT chunk_type, count(*) AS n FROM (" + _top("norm JOIN chunks USING (chunk_seq)", _HY, 1, "chunk_type") + ") GROUP BY chunk_type"
SECTION_STATS = f"WITH {CORPUS}, s AS (SELECT title, count(*) AS n FROM corpus WHERE trim(title) <> '' GROUP BY title) SELECT count(*) AS titles, count(*) FILTER (n > 1) AS spanning FROM s"
MEDIAN = "SELECT lang, CAST(median(n_chars) AS DOUBLE) AS median_chars FROM documents GROUP BY lang"
DUPLICATES = "SELECT sha256(text) AS chunk_id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1"
REGISTER = f"WITH {CORPUS} SELECT title AS doc_id, max(page) AS pages, count(*) AS chunks FROM corpus GROUP BY title"
DEEP = (1, 3, 5, 10, 20)
#: No cut: the pool is the whole index.
WHOLE = 1 << 62
SECTION_EVAL = _evaluated(
    "score", "swept", "decay, query_id",
    HYBRID + """, swept AS (SELECT query_id, chunk_seq, CAST(decay AS DOUBLE) AS decay, CASE WHEN decay > 0 AND trim(title) <> '' AND count(*) OVER g BETWEEN 2 AND 8 THEN greatest(base, decay * max(base) OVER g) ELSE base END AS score
  FROM fused CROSS JOIN (SELECT unnest([0.0, 0.85]::DOUBLE[]) AS decay) WINDOW g AS (PARTITION BY query_id, trim(title), decay))""",
    DEEP, WHOLE,
) + _averaged("decay", DEEP)
_PASSAGE = PASSAGE[: PASSAGE.index(" SELECT query_id, rank")]
_METADATA = METADATA[: METADATA.index(" SELECT query_id, rank")]


def _second(base: str, pairs: str, other: str, name: str, steps: int, ks: tuple[int, ...], pool: int, tuning: bool) -> str:
    frm = f"(SELECT * FROM {pairs} CROSS JOIN {_grid(name, steps)})"
    return _evaluated(f"((1 - {name}) * ({_HY}) + {name} * {other})", frm, f"{name}, query_id", base, ks, pool, tuning) + _averaged(name, ks)


_P = (_PASSAGE, "norm JOIN hn USING (query_id, chunk_seq)", "nh", "beta")
PASSAGE_EVAL = _second(*_P, 2, (1, 3, 5, 10), 40, False)
PASSAGE_SWEEP = _second(*_P, 5, (1, 3, 5, 10), 40, True)
_M = (_METADATA, "norm JOIN (SELECT query_id, chunk_seq, 0.6 * norm_cos + 0.4 * norm_bm25 AS mh FROM mnorm) m USING (query_id, chunk_seq)", "mh", "gamma")
METADATA_EVAL = _second(*_M, 2, DEEP, WHOLE, False)
METADATA_SWEEP = _second(*_M, 10, DEEP, WHOLE, True)
_RERANKED = RERANK[: RERANK.index("SELECT query_id, page, CAST(row_number()")].rstrip()


def _rerank(steps: int, tuning: bool = False, where: str = "") -> str:
    pages = f"""pages AS (SELECT share, query_id, page, row_number() OVER (PARTITION BY share, query_id ORDER BY round((1 - share) * na + share * nb, 9) DESC, i) AS page_rank
  FROM n CROSS JOIN {_grid("share", steps)} {where})"""
    return _evaluated("", by="share, query_id", base=_RERANKED, tuning=tuning, pages=pages)


RERANK_EVAL = _rerank(2) + _averaged("share")
RERANK_SWEEP = _rerank(5, True) + _averaged("share")
WORST_RERANKED = _rerank(1, where="WHERE share = 1") + " SELECT query_id, coalesce(first_rank, 99) AS first_rank FROM per ORDER BY coalesce(first_rank, 99) DESC, query_id LIMIT 8"


def _strict(hits: str, base: str = BASE, by: str = "query_id") -> str:
    ks = ", ".join(f"CAST(coalesce(first_rank <= {k}, FALSE) AS INT) AS recall_{k}" for k in (1, 3, 5))
    rest = by.replace(", query_id", "") if ", " in by else ""
    asked = f"(SELECT DISTINCT {by} FROM hits) JOIN (SELECT DISTINCT query_id FROM gold) USING (query_id)" if rest else "(SELECT DISTINCT query_id FROM gold)"
    return base + GOLD + f""", hits AS ({hits}), firsts AS (SELECT {by}, CAST(min(rank) AS INT) AS first_rank FROM hits JOIN gold USING (query_id, page) GROUP BY {by}),
per AS (SELECT {by}, {ks}, first_rank FROM {asked} LEFT JOIN firsts USING ({by}))"""


_EACH_MODE = " UNION ALL ".join(f"SELECT '{m}' AS mode, query_id, chunk_seq, {x} AS score FROM norm" for m, x in (("vector", "norm_cos"), ("bm25", "norm_bm25"), ("hybrid", _HY)))
STRICT = _strict(f"SELECT mode, query_id, page, row_number() OVER (PARTITION BY mode, query_id ORDER BY round(score, 9) DESC, chunk_seq) AS rank FROM ({_EACH_MODE}) JOIN (SELECT chunk_seq, page FROM chunks) USING (chunk_seq) QUALIFY rank <= 5", by="mode, query_id")
STRICT += " SELECT mode, count(*) AS queries, round(avg(recall_1), 6) AS recall_1, round(avg(recall_3), 6) AS recall_3, round(avg(recall_5), 6) AS recall_5 FROM per GROUP BY mode"
_DENSE_ONLY = "SELECT query_id, page, chunk_type, row_number() OVER (PARTITION BY query_id ORDER BY round(cos, 9) DESC, chunk_seq) AS rank FROM pair JOIN (SELECT chunk_seq, page, chunk_type FROM chunks) USING (chunk_seq) WHERE chunk_type IN ('text', 'table') QUALIFY rank <= 5"
DENSE_EVAL = _strict(_DENSE_ONLY) + " SELECT query_id, recall_1, recall_3, recall_5, coalesce(first_rank, 0) AS first_rank FROM per"
DENSE_TYPES = BASE + f" SELECT chunk_type, count(*) AS n FROM ({_DENSE_ONLY}) WHERE rank = 1 GROUP BY chunk_type"
TUNING_ALPHA = _evaluated("alpha * norm_cos + (1 - alpha) * norm_bm25", f"norm CROSS JOIN {_grid('alpha', 10)}", "alpha, query_id", tuning=True) + _averaged("alpha")
_MIX = "n AS (SELECT page, chunk_type, left(chunk_type, 3) || count(*) AS s FROM corpus {0} GROUP BY page, chunk_type), mix AS (SELECT page, string_agg(s, '/' ORDER BY chunk_type) AS composition FROM n GROUP BY page)"
PROFILE = f"WITH {CHUNKS}, {ASKED}{GOLD}, " + _MIX.format("") + """, far AS (SELECT * FROM gold UNION ALL SELECT query_id, page + (SELECT max(page) FROM corpus) + 1, grade FROM gold)
SELECT query_id, page, grade, coalesce(composition, 'NOT INDEXED') AS composition FROM far LEFT JOIN mix USING (page)"""
MISSES_BY_KIND = _evaluated(_HY) + " SELECT kind, count(*) AS missed FROM met JOIN asked USING (query_id) WHERE coalesce(page_rank, 99) > 5 GROUP BY kind"
MOST_MISSED = (
    _evaluated(_HY) + ", " + _MIX.format("")
    + ", top AS (SELECT page, count(*) AS missed FROM met WHERE coalesce(page_rank, 99) > 5 GROUP BY page ORDER BY missed DESC, page LIMIT 10) SELECT page, missed, coalesce(composition, 'NOT INDEXED') AS composition FROM top LEFT JOIN mix USING (page)"
)
ROUNDED = PAGES[: PAGES.index(",\nfirsts AS")] + " SELECT query_id, page_rank, page, round(score, 4) AS score, round(score, 4) AS first_score FROM kept"
STOP_UNION = KEYWORDS.replace(_KEYWORD_STOP, f"list_concat({_KEYWORD_STOP}, ['datasheet', 'via', 'der', 'die', 'les', 'los'])")
COLLECTIONS = f"""WITH {CHUNKS.replace(", chunks AS (", ", every AS (")}, chunks AS (SELECT chunk_seq % 3 + 1 AS collection, chunk_seq // 3 AS chunk_seq, title, text, embedding FROM every), {ASKED},
q AS (SELECT *, query_id % 3 + 1 AS collection FROM asked),
tf AS (SELECT collection, chunk_seq, term, count(*) AS tf FROM (SELECT collection, chunk_seq, unnest({_tokens("coalesce(title, '') || ' ' || text")}) AS term FROM chunks) GROUP BY ALL),
dl AS (SELECT collection, chunk_seq, coalesce(sum(tf), 0) AS dl FROM chunks LEFT JOIN tf USING (collection, chunk_seq) GROUP BY ALL),
st AS (SELECT collection, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY collection),
raw AS (SELECT collection, term, ln(any_value(n) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM tf JOIN st USING (collection) GROUP BY collection, term),
idf AS (SELECT collection, term, CASE WHEN raw < 0 THEN 0.25::DOUBLE * avg(raw) OVER (PARTITION BY collection) ELSE raw END AS idf FROM raw),
qt AS (SELECT query_id, collection, term, count(*) AS qtf FROM (SELECT query_id, collection, unnest({_tokens("text")}) AS term FROM q) GROUP BY ALL),
bm AS (SELECT query_id, collection, chunk_seq, sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS s
  FROM qt JOIN tf USING (collection, term) JOIN idf USING (collection, term) JOIN dl USING (collection, chunk_seq) JOIN st USING (collection) GROUP BY ALL),
pair AS (SELECT query_id, c.collection, c.chunk_seq, title, {_DOT.format(a="embedding", b="qvec")} AS cos, coalesce(s, 0) AS bm25
  FROM q JOIN chunks c USING (collection) LEFT JOIN bm USING (query_id, collection, chunk_seq)),
norm AS (SELECT *, 0.6 * CASE WHEN max(cos) OVER w - min(cos) OVER w < 1e-12 THEN 0 ELSE (cos - min(cos) OVER w) / (max(cos) OVER w - min(cos) OVER w) END
  + 0.4 * CASE WHEN max(bm25) OVER w - min(bm25) OVER w < 1e-12 THEN 0 ELSE (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w) END AS base FROM pair WINDOW w AS (PARTITION BY query_id)),
lifted AS (SELECT *, CASE WHEN trim(title) <> '' AND count(*) OVER g BETWEEN 2 AND 4 THEN greatest(base, 0.5 * max(base) OVER g) ELSE base END AS score FROM norm WINDOW g AS (PARTITION BY query_id, trim(title)))
SELECT query_id, CAST(collection AS INT) AS collection, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_seq) AS INT) AS rank, chunk_seq, round(score, 6) AS score, round(cos, 6) AS cos, round(bm25, 6) AS bm25
FROM lifted QUALIFY rank <= 10"""
HTML_TABLE = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation)
SELECT n_regionkey, string_agg('| ' || n_name || ' | ' || n_nationkey || ' |' || CASE WHEN i = 1 THEN chr(10) || '| --- | --- |' ELSE '' END, chr(10) ORDER BY i) AS markdown FROM r GROUP BY n_regionkey"""
# parts are looked up in the running sums of row lengths; a row of the recursion is a part
SPLIT = r"""
WITH RECURSIVE p AS (SELECT p_partkey % 10 AS g, p_partkey AS k, replace(CAST(p_partkey AS VARCHAR), '|', '\|') || ' | ' || p_name || ' | ' || p_brand || ' | ' || p_type AS cells FROM part),
rows_ AS (SELECT g, '| ' || cells || ' |' AS r, row_number() OVER (PARTITION BY g ORDER BY k) AS i FROM p),
t AS (SELECT g, 'Table ' || g AS caption, max(CASE WHEN i = 1 THEN r END) || chr(10) || '| --- | --- | --- | --- |' || chr(10) AS head,
  coalesce(list(r ORDER BY i) FILTER (i > 1), []) AS body FROM rows_ GROUP BY g),
u AS (SELECT *, list_concat([0], list_transform(range(1, len(body) + 1), lambda x: list_sum(list_transform(body[1:x], lambda r: length(r) + 1)))) AS sums, 5000 - length(caption) - 2 - length(head) AS room FROM t),
cut AS (SELECT g, 0 AS a, least(len(body), greatest(1, len(list_filter(sums, lambda x: x <= room + 1)) - 1)) AS z, 1 AS part FROM u WHERE length(caption) + 2 + length(head) + list_last(sums) - 1 > 5000 AND len(body) > 0
UNION ALL SELECT g, b.a, greatest(c.z + 1, len(list_filter(sums, lambda x: x <= u.sums[b.a + 1] + room + 1)) - 1), part + 1
FROM cut c JOIN u USING (g), LATERAL (SELECT greatest(c.a, least(c.z - 1, len(list_filter(u.sums, lambda x: x < u.sums[c.z + 1] - 500)))) AS a) b WHERE c.z < len(u.body)),
n AS (SELECT g, count(*) AS parts FROM cut GROUP BY g)
SELECT g AS table_id, CAST(part AS INT) AS part, CAST(parts AS INT) AS parts, caption || ' (part ' || part || '/' || parts || ')' || chr(10) || chr(10) || head || array_to_string(body[a + 1 : z], chr(10)) AS text FROM cut JOIN n USING (g) JOIN u USING (g)
UNION ALL SELECT g, 1, 1, caption || chr(10) || chr(10) || head || array_to_string(body, chr(10)) FROM u WHERE g NOT IN (SELECT g FROM cut)
"""
OVERLAP = f"""
WITH RECURSIVE {CORPUS}, o AS (SELECT page AS doc_id, chunk_type, chunk_seq % 2 + 1 AS part, text, row_number() OVER (PARTITION BY page ORDER BY CASE chunk_type WHEN 'text' THEN 1 WHEN 'table' THEN 2 ELSE 3 END, chunk_seq) - 1 AS i FROM corpus),
f AS (SELECT doc_id, i, chunk_type, text, CAST(NULL AS VARCHAR) AS core_text, 0 AS n FROM o WHERE i = 0
UNION ALL SELECT o.doc_id, o.i, o.chunk_type, CASE WHEN b.borrows THEN tail || chr(10) || chr(10) || o.text ELSE o.text END, CASE WHEN b.borrows THEN o.text END, CASE WHEN b.borrows THEN CAST(length(tail) AS INT) ELSE 0 END
FROM f JOIN o ON o.doc_id = f.doc_id AND o.i = f.i + 1, LATERAL (SELECT {_strip("right(f.text, 500)")} AS tail) t, LATERAL (SELECT tail <> '' AND (o.chunk_type = 'image' OR (o.chunk_type = 'table' AND o.part = 1)) AS borrows) b)
SELECT doc_id, CAST(i AS INT) AS chunk_seq, chunk_type, text, core_text, n AS overlap_prefix_chars, CAST(length(text) AS INT) AS char_count FROM f
"""
def _greedy(name: str, rows: str, limit: int) -> str:
    """CTE name(doc_id, i, run): rows (doc_id, i, n, opens) taken one after the other, `run` being the i of a run's first."""
    takes = f"NOT r.opens AND x.size < {limit} AND x.size + 2 + r.n <= 5000"
    return f"""{name} AS (SELECT doc_id, i, i AS run, n AS size FROM {rows} WHERE i = 1
UNION ALL SELECT r.doc_id, r.i, CASE WHEN {takes} THEN x.run ELSE r.i END, CASE WHEN {takes} THEN x.size + 2 + r.n ELSE r.n END FROM {name} AS x JOIN {rows} AS r ON r.doc_id = x.doc_id AND r.i = x.i + 1)"""


_BLANK = "strpos(reverse(left(rest, 5001)), ' ')"
_AT = f"CASE WHEN length(rest) <= 5000 THEN length(rest) WHEN {_BLANK} BETWEEN 1 AND 5000 THEN 5001 - {_BLANK} ELSE 5000 END"
SECTION_CHUNKS = f"""WITH RECURSIVE {ELEMENTS},
whole AS (SELECT doc_id, idx, page, category, {_strip("text")} AS rest FROM elements WHERE category NOT IN ('Table', 'Image')),
cut AS (SELECT doc_id, idx, page, category, -1 AS k, '' AS piece, rest FROM whole
UNION ALL SELECT doc_id, idx, page, category, k + 1, regexp_replace(left(rest, {_AT}), '{_WS}$', ''), regexp_replace(substr(rest, {_AT} + 1), '^{_WS}', '') FROM cut WHERE rest <> ''),
pieces AS MATERIALIZED (SELECT doc_id, page, piece, length(piece) AS n, category = 'Title' AS opens, row_number() OVER (PARTITION BY doc_id ORDER BY idx, k) AS i FROM cut WHERE k >= 0),
{_greedy("sectioned", "pieces", 3000)},
sections AS MATERIALIZED (SELECT doc_id, run AS first, sum(n) + 2 * (count(*) - 1) AS n, false AS opens, row_number() OVER (PARTITION BY doc_id ORDER BY run) AS i FROM sectioned JOIN pieces USING (doc_id, i) GROUP BY doc_id, run),
{_greedy("chunked", "sections", 1000)},
owned AS (SELECT p.*, c.run FROM pieces AS p JOIN sectioned AS s USING (doc_id, i) JOIN sections AS t ON t.doc_id = p.doc_id AND t.first = s.run JOIN chunked AS c ON c.doc_id = p.doc_id AND c.i = t.i),
chunks AS (SELECT doc_id, run, string_agg(piece, chr(10) || chr(10) ORDER BY i) AS core, arg_min(page, i) AS page, arg_min(piece, i) FILTER (WHERE opens) AS own FROM owned GROUP BY doc_id, run),
seeds AS (SELECT doc_id, arg_min(rest, idx) AS seed FROM whole WHERE category = 'Title' GROUP BY doc_id),
full_texts AS (SELECT doc_id, row_number() OVER w - 1 AS seq, page, coalesce(last_value(own IGNORE NULLS) OVER w, seed, '') AS title, coalesce(right(lag(core) OVER w, 500) || ' ', '') || core AS text
FROM chunks LEFT JOIN seeds USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY run))
SELECT doc_id, seq::INTEGER AS seq, page::INTEGER AS page, title, text, length(text)::INTEGER AS char_count FROM full_texts"""
TABLE_SOURCES = f"""WITH {ELEMENTS}, fit AS (SELECT *, CASE WHEN t <> '' AND length(t) <= 400 AND (category = 'FigureCaption' OR regexp_matches(t, '(?i)^(table|tbl|exhibit)')) THEN t END AS c FROM (SELECT *, {_strip("text")} AS t FROM elements)),
near AS (SELECT *, coalesce({", ".join(f"CASE WHEN lag(page, {-k}) OVER w IS NOT DISTINCT FROM page THEN lag(c, {-k}) OVER w END" for k in (-1, -2, 1, 2))}, '') AS caption FROM fit WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
e AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY idx) AS n, count(*) FILTER (idx % 2 = 0) OVER (PARTITION BY doc_id, page) AS layer FROM near WHERE category = 'Table'),
c AS (SELECT *, replace({_collapse("left(text, 60)")}, '|', '\\|') AS a, len(string_split(text, ' ')) AS b FROM e),
l AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY idx) AS n, '| line | words |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || a || ' | ' || b || ' |' AS m FROM c WHERE idx % 2 = 0)
SELECT doc_id, idx, page, CASE WHEN n <= layer THEN 'text_layer' ELSE 'ocr_html' END AS table_source, caption AS table_caption, 1 AS table_part, 1 AS table_parts_total,
  CASE WHEN n <= layer THEN CASE WHEN caption <> '' THEN caption || chr(10) || chr(10) ELSE '' END || m ELSE {_strip("caption || chr(10) || chr(10) || text")} END AS text
FROM e LEFT JOIN l USING (doc_id, page, n) WHERE n <= layer OR t <> ''"""
LAYER = _boilerplate(0.1) + f""", l AS (SELECT doc_id, page, idx, text, CASE WHEN idx % 2 = 0 THEN text ELSE text || '!' END AS other FROM elements WHERE category = 'FigureCaption'),
lk AS (SELECT doc_id, page, {_collapse("text")} || {_collapse("other")} AS any_cell, [regexp_replace(lower({_collapse("x")}), '\\p{{Nd}}+', '#', 'g') FOR x IN [text || ' ' || other, text, other]] AS keys FROM l),
s AS (SELECT doc_id, list(key) AS bad FROM bp GROUP BY doc_id),
j AS (SELECT lk.*, coalesce(bad, []) AS bad FROM lk LEFT JOIN s USING (doc_id))
SELECT doc_id, page, count(*) AS tables, CAST(count(*) - 1 AS INT) AS last FROM j WHERE NOT list_contains(bad, keys[1]) AND NOT (list_contains(bad, keys[2]) AND list_contains(bad, keys[3])) AND any_cell <> '' GROUP BY doc_id, page"""
