import numpy as np
import pytest
from pyspark.sql import functions as F

from leafsight.operators import blocks, search, vector_index

N, DIM, K = 4000, 24, 10


def rows_of(kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(N, DIM))
    if kind == "clusters":
        x = rng.normal(size=(40, DIM))[rng.integers(0, 40, N)] * 3 + x * 0.7
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    q = x[::80] + rng.normal(size=(N // 80, DIM)) * 0.05
    return x, q / np.linalg.norm(q, axis=1, keepdims=True)


def frames(spark, x, q):
    c = spark.createDataFrame([(i % 2, i, ("text", "table", "image")[i % 3], i // 100, v.tolist()) for i, v in enumerate(x)], "collection int, chunk_seq long, chunk_type string, page int, embedding array<float>")
    return c, spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(q)], "query_id long, collection int, qvec array<double>")


def truth(x, q, keep=lambda i: True):
    out = {}
    for j, v in enumerate(q):
        mine = [i for i in range(len(x)) if i % 2 == j % 2 and keep(i)]
        cos = x[mine].astype(float) @ v
        out[j] = [mine[i] for i in np.lexsort((mine, -np.round(cos, 9)))[:K]]
    return out


def ranked(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["chunk_seq"])
    return out


def files_read(df, path):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "list#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    return {f.rsplit("list=", 1)[1].split("/")[0] for f in df.select(F.input_file_name().alias("f")).distinct().toPandas()["f"] if "list=" in f}


@pytest.fixture(scope="module", params=["clusters", "uniform"])
def made(request, spark, tmp_path_factory):
    x, q = rows_of(request.param)
    c, queries = frames(spark, x, q)
    path = str(tmp_path_factory.mktemp("index"))
    vector_index.build(c, path)
    return request.param, x, q, c, queries, path, vector_index.VectorIndex.load(spark, path)


def test_recall_and_exact_search(made):
    kind, x, q, c, queries, path, index = made
    assert index.rows.count() == N and 30 < index.lists.count() <= 63 and index.lists.agg(F.sum("n")).first()[0] == N
    want = truth(x, q)
    got = ranked(vector_index.nearest(index, queries, K, probes=4 if kind == "clusters" else 32))
    assert np.mean([len(set(got[j]) & set(want[j])) / K for j in want]) >= 0.95
    assert ranked(vector_index.nearest(index, queries, K, exact=True)) == want == ranked(search.nearest(c, queries, K))


def test_filters_widen_the_search(made):
    kind, x, q, c, queries, path, index = made
    want = truth(x, q, lambda i: i % 3 == 1)
    got = ranked(vector_index.nearest(index, queries, K, "table", probes=6 if kind == "clusters" else 40))
    assert np.mean([len(set(got[j]) & set(want[j])) / K for j in want]) >= 0.95 and all(len(v) == K for v in got.values())
    assert ranked(vector_index.nearest(index, queries, K, "table", exact=True)) == want
    # a page of a hundred chunks, fifty of a collection, in whatever lists they are
    assert ranked(vector_index.nearest(index, queries, K, page=7, probes=1, exact=True)) == truth(x, q, lambda i: i // 100 == 7)
    assert all(len(v) == K for v in ranked(vector_index.nearest(index, queries, K, page=7, probes=1)).values())


def test_a_search_reads_the_lists_it_asks_for(made, spark):
    kind, x, q, c, queries, path, index = made
    lists = index.lists.collect()
    ordered = vector_index._ordered(queries.where("query_id < 3"), lists, False)
    asked = ordered.select("query_id", "collection", "qvec", F.explode(F.transform(F.slice("order", 1, 2), lambda o: o["list"])).alias("list")).cache()
    wanted = {str(r["list"]) for r in asked.collect()}
    plan = vector_index.probe(index, asked, K, "table")._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert 0 < len(wanted) <= 6 < len(lists) and "list#" in filters and "EqualTo(chunk_type,table)" in plan
    assert files_read(index.rows.where(F.col("list").isin([int(w) for w in wanted])), path) == wanted


def test_edges(spark, tmp_path):
    rows = [(1, 1, [1.0, 0.0]), (1, 2, [1.0, 0.0]), (1, 3, None), (1, 4, [float("nan"), 1.0]), (1, 5, [1.0, 2.0, 3.0]), (1, 6, []), (1, 7, [0.0, 0.0]), (2, 1, [0.0, 1.0]), (1, 8, [None, 1.0])]
    c = spark.createDataFrame(rows, "collection int, chunk_seq long, embedding array<float>")
    q = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 2, [1.0, 0.0]), (3, 1, None), (4, 1, [1.0]), (5, 9, [1.0, 0.0])], "query_id long, collection int, qvec array<float>")
    index = vector_index.build(c, str(tmp_path / "a"))
    for exact in (False, True):
        assert ranked(vector_index.nearest(index, q, 2, exact=exact)) == {1: [1, 2], 2: [1]}
    assert ranked(vector_index.nearest(index, q, 9)) == {1: [1, 2, 7], 2: [1]}
    none = vector_index.build(c.limit(0), str(tmp_path / "b"))
    assert vector_index.nearest(none, q).count() == 0 and vector_index.nearest(index, q.limit(0)).count() == 0


def test_blocks_by_hand(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x, q = rng.integers(-3, 4, (300, 5)).astype(float), rng.integers(-3, 4, (23, 5)).astype(float)
    rows = [(i % 3, i, v.tolist()) for i, v in enumerate(x)] + [(0, 900, None), (0, 901, [1.0]), (0, 902, [None, 1.0, 1.0, 1.0, 1.0])]
    c = spark.createDataFrame(rows, "collection int, chunk_seq long, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(f"q{i}", i % 3, v.tolist()) for i, v in enumerate(q)], "query_id string, collection int, qvec array<double>")
    want = {(f"q{j}", j % 3, i): x[i] @ q[j] for j in range(23) for i in range(300) if i % 3 == j % 3}
    # few bytes at a time: groups of queries and slices of rows
    for sent, scores in ((64 << 20, 32 << 20), (400, 200)):
        monkeypatch.setattr(blocks, "MOST_SENT", sent)
        monkeypatch.setattr(blocks, "MOST_SCORES", scores)
        got = {(r["query_id"], r["collection"], r["chunk_seq"]): r["cos"] for r in search.dense(c, queries).collect()}
        assert {k: v for k, v in got.items() if k[2] < 300} == want and all(v is None for k, v in got.items() if k[2] > 300)
        top = {(r["query_id"], r["rank"]): r["chunk_seq"] for r in search.nearest(c, queries, 4).collect()}
        for j in range(23):
            mine = sorted((-s, i) for (a, _, i), s in want.items() if a == f"q{j}")[:4]
            assert [top[f"q{j}", k] for k in (1, 2, 3, 4)] == [i for _, i in mine]
