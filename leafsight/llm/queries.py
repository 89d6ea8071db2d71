"""Queries over the corpus tables, one per operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fill_middle, filter_audit, html, langid, lattice, mixing, multi_index, setsketch, sharding, suffix_repeats, toxicity, warc
from .common import read_table, shared_path


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.link_components(read_table(spark, sf_dir, "documents"), 2, 80)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(read_table(spark, sf_dir, "embeddings"))


def op6_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(read_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    return warc.read(warc.write(read_table(spark, sf_dir, "pages"), folder), folder)


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_repeats.strip_repeats(read_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read_table(spark, sf_dir, "pages"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs), reject=False)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.transform(read_table(spark, sf_dir, "documents"))
    digests = [F.sha2(c, 256).alias(n) for c, n in ((F.col("output"), "output_sha256"), (fill_middle.restored(F.col("output"), F.col("form")), "restored_sha256"))]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_toxicity, op3_near_duplicates, op4_mixing, op5_nearest, op6_lattice, op7_warc, op8_repeats, op9_html_text, op10_sharding,
        op11_language_id, op12_filter_audit, op13_fill_middle,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_near_duplicates": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS sh FROM d
), x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(a, b) AS (SELECT u, v FROM both_ways UNION SELECT r.a, e.v FROM reach r JOIN both_ways e ON r.b = e.u),
least_reached AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM s LEFT JOIN least_reached ON doc_id = a
""",
    "op4_mixing": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(md5(text), '-') AS h, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, coalesce(length(text), 0) AS chars,
    coalesce(len(regexp_extract_all(text, '[0-9#{}<>|_=+*^~@$%&/\\\[\]]')), 0) AS odd FROM documents
), k AS (
  SELECT *, ln((CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || h), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE)
    / (1.0::DOUBLE / (1.0::DOUBLE + abs((CASE WHEN size > 0 THEN chars / size ELSE 0 END) - 6.0::DOUBLE) / 6.0::DOUBLE)
      / (1.0::DOUBLE + 4.0::DOUBLE * (CASE WHEN chars > 0 THEN odd / chars ELSE 0 END)) * (0.25::DOUBLE + 0.75::DOUBLE * least(1.0::DOUBLE, size / 50.0::DOUBLE))) AS key FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM k GROUP BY source
), c AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, (SELECT sum(source_size) FROM s) * 1.5::DOUBLE AS total FROM s
), l AS (
  SELECT a.source, (a.total - coalesce(sum(b.cap) FILTER (b.cap / b.w < a.cap / a.w), 0)) / sum(b.w) FILTER (b.cap / b.w >= a.cap / a.w) AS level, a.cap / a.w AS ratio
  FROM c a CROSS JOIN c b GROUP BY a.source, a.total, a.cap, a.w
), f AS (SELECT arg_min(level, ratio) AS level FROM l WHERE level <= ratio),
t AS (SELECT source, source_size, least(cap, coalesce(w * level, cap)) AS target FROM c, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
r AS (
  SELECT k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    sum(size) OVER (PARTITION BY k.source ORDER BY key DESC, doc_id, h ROWS UNBOUNDED PRECEDING) AS until
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, CAST((epochs + CASE WHEN rest > 0 AND until - size / 2 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM r
""",
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > f THEN f END AS refers_to
FROM q
""",
    "op8_repeats": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n FROM d),
b AS (SELECT doc_id, n, unnest(range(n)) AS i, h FROM n),
c AS (SELECT doc_id, n, i, substr(h, 2 * i + 1, 2) AS byte, CASE WHEN i + 50 <= n THEN substr(h, 2 * i + 1, 100) END AS g FROM b),
m AS (SELECT doc_id, n, i, byte, CASE WHEN g IS NOT NULL AND min(doc_id) OVER (PARTITION BY g) < doc_id THEN i END AS hit FROM c),
v AS (SELECT doc_id, n, i, byte, coalesce(i - max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) < 50, FALSE) AS gone FROM m),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS opens FROM v),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, coalesce(string_agg(byte, '' ORDER BY i) FILTER (NOT gone), '') AS k FROM e GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256
FROM n LEFT JOIN g USING (doc_id)
""",
    "op12_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (
  SELECT doc_id, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > least, FALSE) AS e FROM w
), l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
k AS (
  SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS bad FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS v),
o AS (
  SELECT p.v || q.v || r.v || s.v || t.v AS filter_order FROM x p, x q, x r, x s, x t
  WHERE p.v NOT IN (q.v, r.v, s.v, t.v) AND q.v NOT IN (r.v, s.v, t.v) AND r.v NOT IN (s.v, t.v) AND s.v <> t.v
), g AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
j AS (
  SELECT k.*, filter_order, step, fails[instr('ABCDE', filter_order[step])] AS own,
    list_bool_or([FALSE] || list_transform(range(1, step), lambda i: fails[instr('ABCDE', filter_order[i])])) AS earlier FROM k, g
), r AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS f,
    CAST(coalesce(sum(n) FILTER (NOT own AND NOT earlier), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (own AND NOT earlier), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (own AND earlier), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (own AND len(list_filter(fails, lambda z: z)) = 1), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (own AND NOT earlier), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(bad) FILTER (own AND NOT earlier), 0) AS BIGINT) AS toxic_lost
  FROM j GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
""",
    "op13_fill_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS r FROM d),
c AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, least(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) AS p, greatest(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) AS q,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
), s AS (
  SELECT *, coalesce(array_to_string(u[1:p], ''), '') AS prefix, coalesce(array_to_string(u[p + 1:q], ''), '') AS middle, coalesce(array_to_string(u[q + 1:], ''), '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM s
""",
}
