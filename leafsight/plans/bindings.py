"""The driver's tables as chunks, queries, gold grades and layout elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks without vectors."""
    d = table(spark, sf_dir, "documents")
    kind = F.get(F.array(*map(F.lit, ("text", "table", "image"))), (F.col("doc_id") % 3).cast("int"))
    title = F.concat_ws("/", "source", "lang", F.expr("doc_id div 100").cast("string"))
    return d.select(F.lit(1).alias("collection"), F.col("doc_id").alias("chunk_seq"), F.expr("doc_id div 10").alias("page"), kind.alias("chunk_type"), title.alias("title"), "text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as chunks; there are fewer vectors than documents, so these take them in turn."""
    return _turns(corpus(spark, sf_dir), table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _turns(chunks: DataFrame, vectors: DataFrame, how: str = "inner") -> DataFrame:
    n = vectors.count()
    return chunks.withColumn("vec_id", F.col("chunk_seq") % n if n else F.lit(None).cast("long")).join(vectors, "vec_id", how).drop("vec_id")


def lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of chunks. Where vectors are numbered without gaps each document has one, and no text is moved to meet it."""
    ids = table(spark, sf_dir, "embeddings").select("vec_id")
    n, kinds, first, last = ids.agg(F.count("*"), F.countDistinct("vec_id"), F.min("vec_id"), F.max("vec_id")).first()
    return corpus(spark, sf_dir) if n and kinds == n and first == 0 and last == n - 1 else _turns(corpus(spark, sf_dir), ids)


def collections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """chunks and queries dealt to three collections, in which chunk numbers begin anew."""
    c = chunks(spark, sf_dir).withColumn("collection", (F.col("chunk_seq") % 3 + 1).cast("int")).withColumn("chunk_seq", F.expr("chunk_seq div 3"))
    return c, queries(spark, sf_dir).withColumn("collection", (F.col("query_id") % 3 + 1).cast("int"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("qvec"))
    b = table(spark, sf_dir, "benchmark").join(e, "item_id")
    kind = F.get(F.array(*map(F.lit, ("word", "symbol", "table"))), (F.col("item_id") % 3).cast("int"))
    return b.select(F.col("item_id").alias("query_id"), F.lit(1).alias("collection"), "text", "qvec", kind.alias("kind"), (F.col("item_id") % 4 == 0).alias("holdout"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that hold the query's text have grade 2, the next ones 1."""
    found = evaluate.chunks_holding(corpus(spark, sf_dir), queries(spark, sf_dir))
    # texts stay where they are; what is found has to have a vector, as chunks have
    found = _turns(found, table(spark, sf_dir, "embeddings").select("vec_id"), "left_semi").select("query_id", "page").distinct()
    graded = found.select("query_id", F.explode(F.array(F.struct("page", F.lit(2).alias("grade")), F.struct((F.col("page") + 1).alias("page"), F.lit(1).alias("grade")))).alias("g"))
    return graded.groupBy("query_id", "g.page").agg(F.max("g.grade").alias("grade"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents, forty documents a file, a page each."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    kind = (
        F.when(F.col("pos") == 0, "Title").when((F.col("d") + F.col("pos")) % 11 == 3, "Table").when((F.col("d") + F.col("pos")) % 13 == 5, "Image")
        .when((F.col("d") + F.col("pos")) % 7 == 0, "FigureCaption").otherwise("NarrativeText")
    )
    page = (F.col("d") % 40).cast("int")
    return lines.select(F.expr("d div 40").alias("doc_id"), (page * 100000 + F.col("pos")).cast("long").alias("idx"), page.alias("page"), kind.alias("category"), "text")
