"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

Vectors are rotated (principal axes, then the rotation that loses least in taking signs, fitted
on a bounded sample) and their signs are codes. Codes are cut into substrings of eight bits, each
indexed on its own. Two codes within Hamming radius R agree to within R // substrings in at least
one substring, so probing every substring's index that far retrieves every code within R; those
are ranked by their float vectors. R is learned too: the radius that holds RECALL of the true
neighbours within the sample, which are farther apart than in the whole table. Queries that find
fewer than they should within R are searched again over all codes, so no cap loses rows.

The stated queries meet the whole table in blocks: a cell has one block of queries and one of
vectors, and gives each query's best of that block. Equal vectors are searched once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

SAMPLE = 4096
RECALL = 0.98
BLOCK, QUERIES = 8192, 1024
SUB = 8
_DIST = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


@dataclass(frozen=True)
class Coder:
    mean: np.ndarray
    turn: np.ndarray
    radius: int

    @property
    def bits(self) -> int:
        return self.turn.shape[1]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """One row of bytes per vector; bits beyond the last axis are 0."""
        return np.packbits((x - self.mean) @ self.turn > 0, axis=1)


def fit(x: np.ndarray, k: int, rounds: int = 40, recall: float = RECALL) -> Coder:
    """Rotation and radius from sample vectors."""
    mean = x.mean(axis=0)
    y = x - mean
    bits = max(SUB, min(64, y.shape[1] // SUB * SUB)) if y.shape[1] >= SUB else y.shape[1]
    _, _, axes = np.linalg.svd(y.T @ y)
    axes = axes[:bits].T
    v = y @ axes
    turn = np.linalg.qr(np.random.default_rng(5).normal(size=(axes.shape[1], axes.shape[1])))[0]
    for _ in range(rounds):
        a, _, b = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
        turn = (a @ b).T
    coder = Coder(mean, axes @ turn, 0)
    codes = coder.codes(x)
    probe = np.arange(0, len(x), max(1, len(x) // 400))
    found = []
    for i in probe:
        near = np.argsort(-(x @ x[i]), kind="stable")[: k + 1]
        found.append(np.bitwise_count(codes[near[near != i]] ^ codes[i]).sum(axis=1))
    found = np.concatenate(found) if found else np.zeros(0)
    return Coder(mean, coder.turn, int(np.ceil(np.quantile(found, recall))) if len(found) else bits)


class MultiIndex:
    """The substrings' indexes of one block of vectors."""

    def __init__(self, coder: Coder, x: np.ndarray):
        self.x, self.codes = x, coder.codes(x)
        self.order = np.argsort(self.codes, axis=0, kind="stable")
        self.start = np.stack([np.searchsorted(np.sort(c), np.arange(257)) for c in self.codes.T])
        self.balls: dict[tuple[int, int, int], np.ndarray] = {}

    def ball(self, s: int, key: int, radius: int) -> np.ndarray:
        """Rows whose substring s is within the radius of key."""
        got = self.balls.get((s, key, radius))
        if got is None:
            got = np.concatenate([self.order[self.start[s, j] : self.start[s, j + 1], s] for j in np.flatnonzero(_DIST[key] <= radius)])
            self.balls[s, key, radius] = got
        return got

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code is within the radius."""
        hit = np.zeros(len(self.codes), bool)
        for s, key in enumerate(code.tolist()):
            hit[self.ball(s, key, radius // len(code))] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1) <= radius]


def _search(queries: DataFrame, classes: DataFrame, coder: Coder, radius: int, k: int, blocks: int, q_blocks: int) -> DataFrame:
    """(q, cls, score): per query class the best k + 1 of each block within the radius."""

    def cell(_: tuple, q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"q": [], "cls": [], "score": []}).astype({"q": "int64", "cls": "int64", "score": "float64"})
        v = v.sort_values("cls")
        ids, x = v["cls"].to_numpy(), np.stack(v["embedding"].to_numpy()).astype(np.float64)
        index = MultiIndex(coder, x)
        y = np.stack(q["embedding"].to_numpy()).astype(np.float64)
        codes, out = coder.codes(y), []
        for i, name in enumerate(q["q"].to_numpy()):
            rows = index.within(codes[i], radius)
            if len(rows) > 4 * (k + 1):
                rough = x[rows] @ y[i]
                rows = rows[rough >= np.partition(rough, -(k + 1))[-(k + 1)] - 1e-9 * (1 + np.abs(rough).max())]
            score = (x[rows] * y[i]).sum(axis=1)
            best = np.lexsort((ids[rows], -score))[: k + 1]
            out.append(pd.DataFrame({"q": name, "cls": ids[rows[best]], "score": score[best]}))
        return pd.concat(out)

    qs = queries.select("q", "embedding", F.pmod(F.xxhash64("q"), F.lit(q_blocks)).alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("vb"))
    vs = classes.select("cls", "embedding", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))).alias("qb"), F.pmod(F.xxhash64("cls"), F.lit(blocks)).alias("vb"))
    return qs.groupBy("qb", "vb").cogroup(vs.groupBy("qb", "vb")).applyInPandas(cell, "q long, cls long, score double")


def _best(df: DataFrame, by: str, k: int, *then: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("score"), *then)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def nearest(vectors: DataFrame, step: int = 20, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `step` its k nearest others.

    Nearness is the inner product in double precision, ties go to the smaller vec_id. Rows without
    an id, and vectors that are null, empty, zero or hold null or non-finite components, take no
    part. Vectors of unlike lengths have no inner product, so each length is searched by itself,
    with an index of its own. Rows that share an id and a vector count once. A table without
    queries or candidates gives no rows; other columns are not looked at.
    """
    e = F.col("embedding")
    ok = F.size(e) > 0
    ok &= F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & e.isNotNull() & ok)
    rows = settle(rows.dropDuplicates(["vec_id", "embedding"]), "vectors")
    # a table has vectors of one length, or of a few
    lengths = sorted(r["d"] for r in rows.where(F.col("vec_id") % step == 0).select(F.size("embedding").alias("d")).distinct().collect())
    if not lengths:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, [_alike(rows.where(F.size("embedding") == d), step, k) for d in lengths])


def _alike(rows: DataFrame, step: int, k: int) -> DataFrame:
    """`nearest` among distinct (vec_id, embedding) of one length."""
    # a class per distinct vector, with the members that can be among anybody's nearest
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    classes = settle(few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("members")).withColumn("cls", F.get("members", 0)), "classes")
    asked = settle(
        rows.where(F.col("vec_id") % step == 0).join(classes.select("embedding", F.col("cls").alias("q")), "embedding").select(F.col("vec_id").alias("query_id"), "q"), "asked"
    )
    n = classes.count()
    # SAMPLE vectors at most
    sample = classes.orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE).select("cls", "embedding").toPandas().sort_values("cls")
    coder = fit(np.stack(sample["embedding"].to_numpy()), k)
    queries = settle(classes.join(asked.select(F.col("q")).distinct(), F.col("cls") == F.col("q"), "left_semi").select(F.col("cls").alias("q"), "embedding"), "queries")
    blocks, q_blocks = -(-n // BLOCK), max(1, -(-queries.count() // QUERIES))
    found = settle(_best(_search(queries, classes, coder, coder.radius, k, blocks, q_blocks), "q", k + 1, "cls"), "found")
    done = found.groupBy("q").count().where(F.col("count") >= min(k + 1, n)).select("q")
    short = settle(queries.join(done, "q", "left_anti"), "short")
    left = short.count()
    if left:
        again = _best(_search(short, classes, coder, coder.bits, k, blocks, max(1, -(-left // QUERIES))), "q", k + 1, "cls")
        found = found.join(done, "q", "left_semi").unionByName(again)
    members = found.join(classes.select("cls", "members"), "cls").select("q", "score", F.explode("members").alias("vec_id"))
    lists = _best(members, "q", k + 1, "vec_id").groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "score"))).alias("l"))
    out = asked.join(lists, "q").select("query_id", F.posexplode(F.slice(F.filter("l", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
