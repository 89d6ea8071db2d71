"""A stored index of vectors: coarse lists as partitions, probed by distance bounds, with filters.

Vectors go to the list of their nearest centroid; a list is a partition of the stored table, so a
search reads the files of the lists it asks for and no others. By the triangle inequality the
inner product of a query with a vector of a list is at most query . centroid + |query| * radius.
Lists are probed round by round, the most promising first; filters hold within the lists, and a
query goes on to further lists until it has found k rows (`exact`: and no list left can hold a
better one, or one as good). Centroids are fitted on at most about SAMPLE vectors; every vector
with finite numbers is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import written
from .blocks import DIGITS, k_best
from .search import CHUNK, top

SAMPLE, MOST_LISTS, SEED = 20_000, 4096, 11
#: Lists that a query is sent to in the first round; each further round takes twice as many.
PROBES = 4


@dataclass(frozen=True)
class VectorIndex:
    """rows (chunk columns, list) partitioned by list, and lists (list, centroid, radius, n)."""

    rows: DataFrame
    lists: DataFrame

    @staticmethod
    def load(spark: SparkSession, path: str) -> VectorIndex:
        return VectorIndex(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/lists"))


def _nearest_centroid(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (vectors @ centroids.T - (centroids**2).sum(axis=1) / 2).argmax(axis=1)


def _fit(chunks: DataFrame, lists: int, usable: int) -> np.ndarray:
    """Centroids by a few rounds of k-means over vectors chosen by the hashes of their numbers, in one task."""
    chosen = F.pmod(F.xxhash64(*CHUNK, F.lit(SEED)), F.lit(1 << 30)) / (1 << 30) * usable < SAMPLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((r["h"], r["embedding"]) for b in batches for r in b.to_pylist())
        if not found:
            return
        x = np.array([v for _, v in found], np.float64)
        rng = np.random.default_rng(SEED)
        centroids = x[np.sort(rng.choice(len(x), min(lists, len(x)), replace=False))]
        for _ in range(8):
            near = np.concatenate([_nearest_centroid(x[i : i + 4096], centroids) for i in range(0, len(x), 4096)])
            n = np.bincount(near, minlength=len(centroids))
            sums = np.zeros_like(centroids)
            np.add.at(sums, near, x)
            centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
        yield pa.RecordBatch.from_arrays([pa.array(centroids.tolist(), pa.list_(pa.float64()))], ["centroid"])

    picked = chunks.where(chosen).select(F.xxhash64(*CHUNK, F.lit(SEED + 1)).alias("h"), "embedding")
    return np.array([r["centroid"] for r in picked.coalesce(1).mapInArrow(run, "centroid array<double>").collect()])


def build(chunks: DataFrame, path: str, lists: int | None = None) -> VectorIndex:
    """Write the index of chunks (collection, chunk_seq, embedding, and any columns to filter by) below `path`.

    `lists`: their number, by default about the square root of that of the vectors, at most
    MOST_LISTS. Rows whose vector is null, holds a null or a number that isn't finite, or is of
    another length than most, are not in the index. Nothing to index gives an empty one.
    """
    spark = chunks.sparkSession
    finite = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    usable = chunks.where(finite & (F.size("embedding") > 0))
    sizes = usable.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    dim, n = (sizes["dim"], sizes["n"]) if sizes else (0, 0)
    usable = usable.where(F.size("embedding") == dim)
    centroids = _fit(usable, min(MOST_LISTS, max(1, lists if lists is not None else int(n**0.5))), n) if n else np.zeros((0, 0))
    sent = spark.sparkContext.broadcast(centroids)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in usable.schema) + ", list int, apart double"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for b in batches:
            x = np.asarray(b.column("embedding").flatten().cast(pa.float64())).reshape(b.num_rows, -1)
            near = _nearest_centroid(x, c) if b.num_rows else np.zeros(0, np.int64)
            apart = np.sqrt(((x - c[near]) ** 2).sum(axis=1)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(apart)], [*b.schema.names, "list", "apart"])

    # a large list is dealt to several files, small ones don't share their files
    usable.mapInArrow(assign, schema).hint("rebalance", "list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>")
    known.join(rows.groupBy("list").agg(F.max("apart").alias("radius"), F.count(F.lit(1)).alias("n")), "list").coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")
    return VectorIndex(rows, spark.read.parquet(f"{path}/lists"))


def _ordered(queries: DataFrame, lists: list, exact: bool) -> DataFrame:
    """Queries with `order` (list, bound): all lists, the best first: by their bounds if `exact`, else by their centroids."""
    sent = queries.sparkSession.sparkContext.broadcast(
        (np.array([r["list"] for r in lists], np.int32), np.array([r["centroid"] for r in lists], np.float64), np.array([r["radius"] for r in lists]))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, centroids, radius = sent.value
        kind = pa.list_(pa.struct([("list", pa.int32()), ("bound", pa.float64())]))
        for b in batches:
            out = []
            for v in b.column("qvec").to_pylist():
                q = np.array(v, np.float64)
                near = centroids @ q
                bound = near + np.linalg.norm(q) * radius
                out.append([{"list": int(number[i]), "bound": float(bound[i])} for i in np.lexsort((number, -(bound if exact else near)))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], [*b.schema.names, "order"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema) + ", `order` array<struct<list:int,bound:double>>"
    return queries.mapInArrow(run, schema)


def probe(index: VectorIndex, asked: DataFrame, k: int, chunk_type: str | None = None, page: int | None = None) -> DataFrame:
    """(query_id, collection, chunk_seq, cos) of the k best in the lists that are asked for: asked (query_id, collection, qvec, list)."""
    # at most MOST_LISTS numbers; as literals they choose the partitions that are read
    wanted = [r["list"] for r in asked.select("list").distinct().collect()]
    rows = index.rows.where(F.col("list").isin(wanted))
    rows = rows if chunk_type is None else rows.where(F.col("chunk_type") == chunk_type)
    rows = rows if page is None else rows.where(F.col("page") == page)
    key = lambda df: F.concat_ws(":", df["list"].cast("string"), df["collection"].cast("string"))
    return k_best(rows.select(key(rows).alias("key"), *CHUNK, "embedding"), asked.select(key(asked).alias("key"), "query_id", "qvec"), k)


def nearest(
    index: VectorIndex, queries: DataFrame, k: int = 5, chunk_type: str | None = None, page: int | None = None, exact: bool = False, probes: int = PROBES,
) -> DataFrame:
    """(query_id, collection, chunk_seq, cos, score, rank): the k best of each query's collection, of a chunk type or page if so asked.

    A query (query_id, collection, qvec) is answered when it has k rows after the first round, or
    after further ones in which it found them, or when no list is left; with `exact`, not before
    the rest can't change its rows. Queries without a vector, or with one of another length than
    the index's, have no rows.
    """
    spark, lists = queries.sparkSession, index.lists.collect()
    dim = len(lists[0]["centroid"]) if lists else 0
    own = queries.select("query_id", "collection", "qvec").where(F.col("qvec").isNotNull() & (F.size("qvec") == dim))
    open_ = written(_ordered(own, lists, exact), "asked") if lists else None
    found, done, step = None, 0, probes
    while open_ is not None and done < len(lists):
        # the last round takes what is left
        step = len(lists) - done if step * 4 >= len(lists) - done and done else step
        asked = open_.select("query_id", "collection", "qvec", F.explode(F.transform(F.slice("order", done + 1, step), lambda x: x["list"])).alias("list"))
        new = probe(index, asked, k, chunk_type, page).select("query_id", *CHUNK, "cos")
        both = new if found is None else found.unionByName(new)
        found = written(top(both.withColumn("score", F.col("cos")), k).select("query_id", *CHUNK, "cos"), "found")
        done, step = done + step, step * 2
        have = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("cos").alias("least"))
        ahead = F.array_max(F.transform(F.slice("order", done + 1, MOST_LISTS), lambda x: x["bound"]))
        more = F.coalesce(F.col("n"), F.lit(0)) < k
        if exact:
            more = more | (ahead >= F.col("least") - 10.0**-DIGITS)
        open_ = written(open_.join(have, "query_id", "left").where(more).drop("n", "least"), "asked")
        if open_.isEmpty():
            break
    if found is None:
        found = spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, collection {queries.schema['collection'].dataType.simpleString()}, chunk_seq long, cos double")
    return top(found.withColumn("score", F.col("cos")), k)
