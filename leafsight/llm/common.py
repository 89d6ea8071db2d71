"""What the corpus operators share: the shared folder, cut lineage, small native expressions."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of bytes other than the blank and the five ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Words of 64 bits that a filter of keys has at most: 2**17 (1 MB).
MOST_WORDS = 1 << 17


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where driver and executors are one process, as in tests, one is set here."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="leafsight-")
        atexit.register(shutil.rmtree, own, True)
        root = "file://" + own
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/leafsight-{tag}-{uuid.uuid4().hex}"


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends in files that outlive executors."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the given fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def boxed(docs: DataFrame, *more: Column) -> DataFrame:
    """The columns of docs as one struct `row`, beside others under names of their own: no name in docs can clash, and row.* gives docs back."""
    return docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row"), *more)


def _spots(key: Column, words: int) -> list[tuple[Column, Column]]:
    """Two places in a filter of `words` words, a power of two: (word, bit)."""
    h = F.xxhash64(key)
    return [(F.shiftrightunsigned(h, s).bitwiseAND(F.lit(words - 1)).cast("int"), F.shiftrightunsigned(h, s - 6).bitwiseAND(F.lit(63)).cast("int")) for s in (16, 44)]


def _filter_words(keys: DataFrame, words: int) -> DataFrame:
    """One row with the filter of the column k as an array of `words` longs."""
    spots = keys.select(F.explode(F.array(*[F.struct(w.alias("w"), b.alias("b")) for w, b in _spots(F.col("k"), words)])).alias("s"))
    ones = spots.groupBy("s.w").agg(F.expr("bit_or(shiftleft(1L, s.b))").alias("bits"))
    every = keys.sparkSession.range(words).select(F.col("id").cast("int").alias("w"))
    dense = every.join(ones, "w", "left").select("w", F.coalesce("bits", F.lit(0)).alias("bits"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "bits"))), lambda x: x["bits"]).alias("f"))


def without(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """The rows of docs whose key is not among gone (k); rows with a null key stay.

    A filter of 16 bits a key, MOST_WORDS words at most, tells most rows apart where they are read;
    only those that it lets through are shuffled to meet the keys. Full or not, it loses nothing.
    """
    gone = settle(gone.where("k is not null"), "gone")
    n = gone.count()
    if not n:
        return docs
    words = min(MOST_WORDS, 1 << max(4, (n // 4).bit_length()))
    look = settle(_filter_words(gone, words), "filter").scalar()
    hit = [F.getbit(F.get(look, w), b) == 1 for w, b in _spots(F.col("k"), words)]
    maybe = F.col("k").isNotNull() & hit[0] & hit[1]
    rows = boxed(docs, key.alias("k"))
    return rows.where(~maybe).select("row.*").union(rows.where(maybe).join(gone, "k", "left_anti").select("row.*"))
