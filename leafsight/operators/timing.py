"""How long the stages of a search and an encoder take: medians over rounds, after a warm-up."""

from __future__ import annotations

import time
from collections.abc import Callable
from statistics import median

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from . import search


def run(df: DataFrame) -> tuple[float, int]:
    """(seconds, rows) of computing all of df; rows are counted on the way."""
    seen = Observation()
    start = time.perf_counter()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start, seen.get["rows"]


def encoder_rate(texts: DataFrame, encode: Callable[[Column], Column], rounds: int = 3) -> dict[str, float]:
    """load_s (the first round, which loads the model, beyond the median of the later ones), ms_per_chunk and chunks_per_s of `encode` over texts (text)."""
    encoded = texts.select(encode(F.col("text")).alias("v"))
    first, rows = run(encoded)
    later = median(run(encoded)[0] for _ in range(rounds))
    return {"load_s": max(0.0, first - later), "ms_per_chunk": 1000 * later / max(1, rows), "chunks_per_s": rows / later}


def stage_medians(chunks: DataFrame, queries: DataFrame, words: search.StoredLexicon | None = None, asked: int = 8) -> dict[str, float]:
    """Median seconds of dense, bm25, fusion and total over each of `asked` queries by itself (those of the smallest ids), after one that warms up."""
    ids = [r["query_id"] for r in queries.select("query_id").orderBy("query_id").limit(asked).collect()]
    took: dict[str, list[float]] = {"dense": [], "bm25": [], "total": []}
    for i in ids[:1] + ids:
        q = queries.where(F.col("query_id") == i)
        took["dense"].append(run(search.dense(chunks, q))[0])
        took["bm25"].append(run(search.bm25(words or chunks, q))[0])
        took["total"].append(run(search.search(chunks, q, 5, words=words))[0])
    out = {k: median(v[1:]) for k, v in took.items() if len(v) > 1}
    return out | ({"fusion": max(0.0, out["total"] - out["dense"] - out["bm25"])} if out else {})
