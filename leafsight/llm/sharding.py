"""Sharding by a Feistel permutation of global row numbers.

Every row gets a global number; a keyed Feistel network over an (a x b) grid, walked along its
cycles until the value falls below the row count, permutes those numbers. Position p of the
permuted order sits in shard p mod S at slot p div S, so both can be computed from the row
number alone, shard counts differ by one at most and slots have no gaps.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import boxed, settle

ROUNDS = 6
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _round(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * _MULT
        x ^= x >> np.uint64(29)
        x *= _MIX
        return x ^ (x >> np.uint64(32))


def permute(rows: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The image of each row number in 0..n-1 under the keyed permutation of 0..n-1."""
    if n <= 1 or not len(rows):
        return np.zeros(len(rows), np.int64)
    a = isqrt(n - 1) + 1
    b = -(-n // a)
    ua, ub = np.uint64(a), np.uint64(b)
    out, todo = np.array(rows, np.uint64), np.arange(len(rows))
    while len(todo):
        left, right = out[todo] // ub, out[todo] % ub
        for k in range(ROUNDS):
            key = (seed * 1_000_003 + k + 1) * 0x100000001B3 % 2**63
            if k % 2:
                left = (left + _round(right, key) % ua) % ua
            else:
                right = (right + _round(left, key) % ub) % ub
        out[todo] = left * ub + right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


#: Rows of a bucket, and of equal rows that are numbered by one task; buckets at least.
BUCKET_ROWS, BUCKETS = 1 << 16, 4096


def shard_rows(df: DataFrame, shards: int, order: list[str], seed: int = 0, reread: bool = False, bucket_rows: int = BUCKET_ROWS, buckets: int = BUCKETS) -> DataFrame:
    """df with shard int and slot long; `order` names the columns that tell rows apart.

    Rows are numbered bucket by bucket, and within one by hashes of `order` and of the whole row,
    so content alone decides. Buckets grow in number with the rows. Rows equal in `order` that
    would crowd a bucket are split by the partition that they are read from; which of them gets
    which slot is then of no effect only if they are equal throughout. For that, partitions must
    be the same whenever they are read: df is written first, unless `reread` says that it is a
    plain read of files. Nulls in `order` are values like any other. An empty table gives an empty
    result. Columns named shard or slot in df are replaced; other names can't clash.
    """
    df = df.drop("shard", "slot")
    fields, whole = df.schema.fields, F.xxhash64("row")
    if "map<" in df.schema.simpleString():
        whole = F.xxhash64(F.to_json("row"))
    rows = boxed(df, F.xxhash64(*[F.col(f"`{c}`") for c in order]).alias("k"))
    rows = rows if reread else settle(rows, "rows")
    n = rows.count()
    buckets = max(buckets, -(-n // bucket_rows))
    bucket = F.pmod(F.col("k"), F.lit(buckets).cast("long")).alias("bucket")
    sizes = settle(rows.select(bucket).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "buckets")
    crowded = sizes.where(F.col("n") > 4 * bucket_rows).select("bucket")
    hot = None
    if crowded.limit(1).count():
        keys = rows.select("k", bucket).join(crowded, "bucket").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        # n / bucket_rows keys at most
        hot = settle(keys.where(F.col("n") > bucket_rows).select(F.col("k").alias("hot"), F.ceil(F.col("n") / bucket_rows).cast("int").alias("parts")), "hot")
        rows = rows.withColumn("pid", F.spark_partition_id()).join(F.broadcast(hot), F.col("k") == F.col("hot"), "left")
        rows = rows.select("row", "k", bucket, "hot", F.when(F.col("hot").isNotNull(), F.pmod("pid", "parts")).otherwise(F.lit(0)).alias("part"))
        sizes = settle(rows.groupBy("bucket", "hot", "part").agg(F.count(F.lit(1)).alias("n")), "cells")
    else:
        rows = rows.select("row", "k", bucket, F.lit(None).cast("long").alias("hot"), F.lit(0).alias("part"))
        sizes = sizes.select("bucket", F.lit(None).cast("long").alias("hot"), F.lit(0).alias("part"), "n")
    # a row for each bucket, and for each part of hot rows: some 2 * n / bucket_rows, or BUCKETS
    in_order = Window.orderBy("bucket", F.col("hot").asc_nulls_first(), "part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("bucket").alias("b"), F.col("hot").alias("h"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("before"))
    same = (F.col("bucket") == F.col("b")) & F.col("hot").eqNullSafe(F.col("h")) & (F.col("part") == F.col("p"))
    numbered = rows.join(F.broadcast(before), same)
    number = F.col("before") + F.row_number().over(Window.partitionBy("bucket", "hot", "part").orderBy("k", whole)) - 1
    numbered = numbered.select("row", number.alias("number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = permute(batch.column("number").to_numpy(), n, seed)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array((at % shards).astype(np.int32)), pa.array(at // shards)], ["row", "shard", "slot"])

    schema = T.StructType([T.StructField("row", T.StructType(fields)), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return numbered.mapInArrow(place, schema).select("row.*", "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `rows`. A null text has the size 8 and the check sum of no bytes, a null id is a
    value like others, repeated rows get slots of their own; grown_shard is null, as it belongs to
    the law `key`. Other columns of docs are not looked at.
    """
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    placed = shard_rows(slim, shards, ["doc_id", "text_crc32", "size"], seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
