"""Vectors against queries, block by block: an Arrow batch of vectors meets all its queries in one matrix product.

Rows are matched to queries by a key (a collection, a list of an index). Query vectors go to every
task, at most MOST_SENT bytes at a time: more of them are taken in groups of that size, each with a
pass over the vectors. A task keeps the k best rows of each query over all its batches, so that
what is merged afterwards are k rows per query and task, whatever the number of vectors. Sums are
in double precision; rows whose vector is null, of another length than the query's or without
finite sums are not among the best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of query vectors that a task holds, and of the scores of one product.
MOST_SENT, MOST_SCORES = 64 << 20, 32 << 20
#: Scores are compared at so many decimals.
DIGITS = 9
#: Rows with the scores of a grid that a task gathers before it keeps the best.
HELD = 200_000
Asked = dict[object, tuple[list, np.ndarray]]


def _dealt(queries: DataFrame) -> Iterator[Asked]:
    """Queries (key, query_id, qvec) by key, in groups of about MOST_SENT bytes: (ids, matrix) of each key and vector length."""
    size = queries.agg(F.sum(F.size("qvec") * 8).alias("bytes")).first()["bytes"] or 0
    groups = -(-size // MOST_SENT)
    for g in range(groups):
        mine = queries if groups == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g)
        found: dict[object, tuple[list, list]] = {}
        for key, query_id, vec in mine.where("qvec is not null").select("key", "query_id", "qvec").collect():
            ids, vectors = found.setdefault((key, len(vec)), ([], []))
            ids.append(query_id)
            vectors.append(vec)
        yield {k: (ids, np.array(v, np.float64)) for k, (ids, v) in found.items()}


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
    """(key, rows, their vectors) for each key and vector length of a batch (key, chunk_seq, embedding, ...)."""
    vectors = batch.column("embedding")
    values = np.asarray(vectors.flatten().cast(pa.float64()).fill_null(np.nan))
    sizes = np.asarray(vectors.value_lengths().fill_null(-1))
    ends = np.cumsum(np.maximum(sizes, 0))
    encoded = batch.column("key").dictionary_encode()
    names, codes = encoded.dictionary.to_pylist(), np.asarray(encoded.indices.fill_null(-1))
    for size in np.unique(sizes[sizes > 0]):
        for code in np.unique(codes[sizes == size]):
            if code >= 0:
                rows = np.flatnonzero((sizes == size) & (codes == code))
                yield (names[code], int(size)), rows, values[(ends[rows] - size)[:, None] + np.arange(size)]


def _slices(n: int, queries: int) -> Iterator[slice]:
    step = max(1, MOST_SCORES // 8 // max(1, queries))
    return (slice(i, i + step) for i in range(0, n, step))


def _over(rows: DataFrame, queries: DataFrame, work: Callable[[Asked, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    spark, parts = rows.sparkSession, []
    for asked in _dealt(queries):
        sent = spark.sparkContext.broadcast(asked)
        parts.append(rows.mapInArrow(lambda batches, sent=sent: work(sent.value, batches), schema))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def _schema(rows: DataFrame, queries: DataFrame) -> tuple[str, list[pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [queries.schema["query_id"].dataType, rows.schema["collection"].dataType, rows.schema["chunk_seq"].dataType]
    names = ("query_id", "collection", "chunk_seq")
    return ", ".join(f"{n} {k.simpleString()}" for n, k in zip(names, kinds, strict=True)) + ", cos double", [*map(to_arrow_type, kinds), pa.float64()]


_NAMES = ["query_id", "collection", "chunk_seq", "cos"]


def all_scores(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, collection, chunk_seq, cos) of every row (key, collection, chunk_seq, embedding) and query (key, query_id, qvec) of its key."""
    schema, kinds = _schema(rows, queries)

    def work(asked: Asked, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, at, vectors in _blocks(batch):
                ids, matrix = asked.get(key, ((), None))
                if not ids:
                    continue
                known = pa.array(ids, kinds[0])
                for s in _slices(len(at), len(ids)):
                    mine = pa.array(np.repeat(at[s], len(ids)))
                    cos = (vectors[s] @ matrix.T).ravel()
                    query = known.take(pa.array(np.tile(np.arange(len(ids)), len(at[s]))))
                    yield pa.RecordBatch.from_arrays([query, batch.column("collection").take(mine), batch.column("chunk_seq").take(mine), pa.array(cos, mask=np.isnan(cos))], _NAMES)

    return _over(rows, queries, work, schema)


def _best(query: np.ndarray, seq: np.ndarray, cos: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the k best of their query: larger scores first, then smaller numbers."""
    order = np.lexsort((seq, -np.round(cos, DIGITS), query))
    first = np.searchsorted(query[order], query[order])
    return order[np.arange(len(order)) - first < k]


def k_best(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """As all_scores, but of each query only rows among which are its k best: k per task at most."""
    schema, kinds = _schema(rows, queries)

    def work(asked: Asked, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        for batch in batches:
            numbers = np.asarray(batch.column("chunk_seq"))
            for key, at, vectors in _blocks(batch):
                ids, matrix = asked.get(key, ((), None))
                for s in _slices(len(at), len(ids)) if ids else ():
                    cos = matrix @ vectors[s].T
                    cos[~np.isfinite(cos)] = -np.inf
                    least = np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k] if cos.shape[1] > k else np.full(len(ids), -np.inf)
                    query, row = np.nonzero((cos >= least[:, None] - 10.0**-DIGITS) & (cos > -np.inf))
                    where = batch.column("collection").take(pa.array(at[s][row])).to_pylist()
                    # one collection a key, as a rule; rows keep theirs
                    new = (query, numbers[at[s][row]], cos[query, row], np.array(where, object))
                    old = held.get(key)
                    both = new if old is None else tuple(np.concatenate(x) for x in zip(old, new, strict=True))
                    kept = _best(*both[:3], k)
                    held[key] = tuple(x[kept] for x in both)
        for key, (query, seq, cos, where) in held.items():
            ids = asked[key][0]
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in query], kinds[0]), pa.array(where.tolist(), kinds[1]), pa.array(seq, kinds[2]), pa.array(cos)], _NAMES)

    return _over(rows, queries, work, schema)


def _picks(table: pa.Table, scores: np.ndarray, k: int) -> list[np.ndarray]:
    """For each column of scores, which rows are among the k best of their query: larger scores first, then smaller numbers."""
    query = np.asarray(table.column("query_id").combine_chunks().dictionary_encode().indices)
    base = np.lexsort((np.asarray(table.column("chunk_seq")), query))
    out = []
    for column in scores.T:
        order = base[np.lexsort((-column[base], query[base]))]
        first = np.searchsorted(query[order], query[order])
        out.append(order[np.arange(len(order)) - first < k])
    return out


def grid_best(rows: DataFrame, k: int, held: int = HELD) -> DataFrame:
    """(at, query_id, collection, chunk_seq, score): the k best of each query at each place of `scores`, and perhaps others.

    rows: (query_id, collection, chunk_seq, scores array<double>), as many scores in each row as there
    are points in a grid; null scores come last, NaN first. A task keeps the rows that are among its k best anywhere,
    so a row is never repeated for each point. It holds some `held` rows at most: if more than
    half of these are among the best, it hands them on and begins anew.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    names = ("query_id", "collection", "chunk_seq")
    types = [rows.schema[n].dataType for n in names]
    fields = ["at", *names, "score"]
    schema = "at int, " + ", ".join(f"{n} {t.simpleString()}" for n, t in zip(names, types, strict=True)) + ", score double"
    kinds = [pa.int32(), *map(to_arrow_type, types), pa.float64()]

    def matrix(table: pa.Table) -> np.ndarray:
        flat = np.asarray(table.column("scores").combine_chunks().flatten().fill_null(-np.inf))
        return np.where(np.isnan(flat), np.inf, flat).reshape(table.num_rows, -1)

    def best(table: pa.Table, scores: np.ndarray, picks: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for at, some in enumerate(picks):
            mine = table.take(pa.array(some))
            columns = [mine.column(n).combine_chunks().cast(t) for n, t in zip(names, kinds[1:4], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), at, np.int32)), *columns, pa.array(scores[some, at])], fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            parts.append(batch)
            count += batch.num_rows
            if count < held:
                continue
            table = pa.Table.from_batches(parts)
            scores = matrix(table)
            picks = _picks(table, scores, k)
            kept = np.unique(np.concatenate(picks))
            if len(kept) > held // 2:
                yield from best(table, scores, picks)
                parts, count = [], 0
            else:
                parts, count = table.take(pa.array(kept)).combine_chunks().to_batches(), len(kept)
        if count:
            table = pa.Table.from_batches(parts)
            scores = matrix(table)
            yield from best(table, scores, _picks(table, scores, k))

    return rows.select(*names, "scores").mapInArrow(work, schema)
