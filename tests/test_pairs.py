"""Scores made where they are looked at, against the join of all pairs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from leafsight.operators import evaluate, pairs, search


def _tables(spark, parts=3):
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    chunk = lambda i: (
        i % 2, i // 2, None if i % 17 == 3 else i // 7, None if i % 19 == 4 else f" s{i // 9}" if i % 5 else "s", " ".join(r.choices(words, k=r.randint(0, 30))),
        None if i == 8 else [1.0] if i == 9 else [round(r.gauss(0, 1), 2) for _ in range(3)], "text" if i % 3 else "table",
    )
    c = spark.createDataFrame([chunk(i) for i in range(240)], "collection int, chunk_seq long, page int, title string, text string, embedding array<float>, chunk_type string")
    ask = lambda i: (i, i % 2, " ".join(r.choices([*words[:8], *words, "unknown"], k=5)) if i else "", [round(r.gauss(0, 1), 2) for _ in range(3)])
    q = spark.createDataFrame([ask(i) for i in range(9)] + [(20, 7, "w1", [1.0, 0.0, 0.0]), (21, 0, "w1 w2", None), (22, 0, "w1 w2", [2.0])], "query_id long, collection int, text string, qvec array<float>")
    # written, so that its rows and random numbers are the same each time
    return c.repartition(parts).localCheckpoint(), q.localCheckpoint()


def _joined(c, q):
    both = search.dense(c, q).join(search.bm25(c, q), ["query_id", *search.CHUNK], "left").fillna(0.0, ["bm25"])
    return search.minmax(both, "cos", "bm25")


def _set(rows, *columns):
    return sorted(tuple(round(x, 8) if isinstance(x, float) else str(x) for x in r) for r in rows.select(*columns).collect())


@pytest.fixture(scope="module", params=[1 << 30, 2000], ids=["one group", "groups and small blocks"])
def tables(request, spark):
    old = pairs.MOST_SENT, pairs.MOST_CELLS, pairs.MOST_QUERIES, pairs.MOST_WEIGHTS
    if request.param == 2000:
        pairs.MOST_SENT, pairs.MOST_CELLS, pairs.MOST_QUERIES, pairs.MOST_WEIGHTS = 2000, 64, 2, 4
    yield _tables(spark)
    pairs.MOST_SENT, pairs.MOST_CELLS, pairs.MOST_QUERIES, pairs.MOST_WEIGHTS = old


def test_texts_are_read_for_their_words_once(spark, monkeypatch):
    c, q = _tables(spark)
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    texts = c.drop("embedding")
    found = pairs.pairs(c, q, texts.select("collection", "chunk_seq", "title", "text").mapInArrow(seen, "collection int, chunk_seq long, title string, text string"))
    # once more by the count of chunks
    assert reads.value <= 2 * 240
    monkeypatch.setattr(pairs, "MOST_TERMS", 20)
    assert _set(pairs.pairs(c, q, texts).rows(), "query_id", "chunk_seq", "bm25") == _set(found.rows(), "query_id", "chunk_seq", "bm25")


def test_all_pairs(tables):
    c, q = tables
    names = ("query_id", "collection", "chunk_seq", "cos", "bm25", "norm_cos", "norm_bm25")
    got = _set(search.scored(c, q), *names)
    assert got == _set(_joined(c, q), *names) and len(got) == 9 * 120 - 5 - 4
    assert _set(search.scored(c, q, c.drop("embedding")), *names) == got


def test_best_chunks_and_pages_with_sections(tables):
    c, q = tables
    hits = search.described(search.fuse(_joined(c, q)), c, "page", "title", "chunk_type").localCheckpoint()
    grid = [{"decay": d, "group": g} for d in (0.0, 0.5, 0.9) for g in (2, 5, 9)]
    score = search.mixed(0.6)
    points = [search.Point(score, (p["decay"], p["group"])) for p in grid]
    found = search.pairs(c, q, c.drop("embedding"), sections=9)
    got = search.best_of(found, 6, points, grid).localCheckpoint()
    paged = evaluate.all_pages(search.best_pages(found, 5, points, grid), ("decay", "group", "query_id")).where("page_rank <= 5").localCheckpoint()
    for p in grid:
        lifted = search.lift_sections(hits, p["decay"], p["group"]).localCheckpoint()
        mine = lambda rows: rows.where((F.col("decay") == p["decay"]) & (F.col("group") == p["group"]))  # noqa: B023, E731
        assert _set(mine(got), "query_id", "rank", "chunk_seq", "score") == _set(search.top(lifted, 6), "query_id", "rank", "chunk_seq", "score")
        assert _set(mine(paged), "query_id", "page", "page_rank") == _set(evaluate.all_pages(lifted).where("page_rank <= 5"), "query_id", "page", "page_rank")
    lifted = search.lift_sections(hits, 0.5, 5).localCheckpoint()
    mine = search.described(search.page_hits(found, search.Point(score, (0.5, 5)), 4), c, "title", "chunk_type")
    for keep in (4, 2):
        a, z = (_set(search.pages(x, c, keep, 0.3).withColumn("evidence", F.expr("transform(evidence, e -> concat_ws(':', e.type, e.title, e.snippet, round(e.score, 6)))")), "query_id", "page_rank", "page", "score", "sections", "evidence") for x in (mine, lifted))
        assert a == z and a


def test_types_modes_and_further_channels(tables):
    c, q = tables
    scores = search.described(_joined(c, q), c, "chunk_type").localCheckpoint()
    for mode in ("vector", "bm25", "hybrid"):
        want = search.top(search.fuse(scores, mode=mode).where("chunk_type = 'table' and cos is not null"), 7)
        got = search.search(c, q, 7, mode=mode, types=["table"], words=c.drop("embedding"))
        assert _set(got, "query_id", "rank", "chunk_seq", "score", "cos", "norm_bm25") == _set(want, "query_id", "rank", "chunk_seq", "score", "cos", "norm_bm25")
    q2, q3 = q.withColumn("text", F.lit("s s1 table")), q.where("query_id != 4").withColumn("qvec", F.reverse("qvec"))
    text = F.concat_ws(" ", "title", "chunk_type")
    meta = search.bm25(c, q2, text).withColumnRenamed("bm25", "meta")
    want = scores.join(meta, ["query_id", *search.CHUNK], "left").fillna(0.0, ["meta"]).join(search.dense(c, q3).withColumnRenamed("cos", "other"), ["query_id", *search.CHUNK])
    want = search.minmax(want, "meta", "other").withColumn("score", F.expr("0.5 * norm_cos + 0.2 * norm_meta + 0.3 * norm_other"))
    found = search.pairs(c, q, texts={"meta": (text, q2)}, vectors={"other": q3})
    got = search.best_of(found, 8, [search.Point(lambda s: 0.5 * s["cos"] + 0.2 * s["meta"] + 0.3 * s["other"])])
    assert _set(got, "query_id", "rank", "chunk_seq", "score") == _set(search.top(want, 8), "query_id", "rank", "chunk_seq", "score")


def test_what_is_handed_on_doesnt_grow_with_chunks(spark):
    c, q = _tables(spark)
    more = c.crossJoin(spark.range(20)).withColumn("chunk_seq", F.col("chunk_seq") + 1000 * F.col("id")).drop("id")
    found = search.pairs(more, q.where("query_id < 9"))
    tasks = found.groups[0][0].rdd.getNumPartitions()
    assert found.best(4, [search.Point(search.mixed(0.6))]).count() <= 4 * 9 * tasks < more.count() * 9 / 2
    assert "Exchange" not in found.rows()._jdf.queryExecution().executedPlan().toString()


def test_long_tables_take_time_in_proportion(spark):
    from leafsight.functions import text as T

    # some 1.6 thousand million looks at cells if the width were worked out for each row
    rows = F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda i: F.array(i.cast("string"), F.lit("x")))
    began = time.monotonic()
    got = spark.range(1).select(T.rows_to_markdown(F.when(F.col("id") == 0, rows)).alias("m")).first()["m"].split("\n")
    assert time.monotonic() - began < 60
    assert got[:3] == ["| 1 | x |", "| --- | --- |", "| 2 | x |"] and len(got) == 40_001
    one = spark.range(1).select(T.rows_to_markdown(F.array(F.array(F.lit("a"), F.lit("b")))).alias("m")).first()["m"]
    assert one == "| a | b |\n| --- | --- |"


def test_words_cut_in_tasks_are_those_of_tokenize(spark):
    r = random.Random(3)
    texts = ["".join(r.choices("abZ019_ .-\t\néß中\U0001f600İK", k=r.choice([0, 1, 2, 5, 40]))) + r.choice(["", " the of", "And", " x"]) for _ in range(400)] + ["", "ab", "cd", "", "e", "fg_"]
    rows = spark.createDataFrame([(i, None if i % 23 == 5 else t) for i, t in enumerate(texts)], "i int, t string").select("i", F.lower("t").alias("low"), search.tokenize(F.col("t")).alias("words"))
    table = rows.orderBy("i").toArrow().combine_chunks()
    low, want = table.column("low").combine_chunks(), table.column("words").to_pylist()
    for begin in (0, 1, 397, len(want)):
        row, words = pairs._words(low.slice(begin))
        got = [[] for _ in want[begin:]]
        for i, w in zip(row, words.to_pylist(), strict=True):
            got[i].append(w)
        assert got == want[begin:]


def test_rows_move_once_to_their_sections(spark, monkeypatch):
    monkeypatch.setattr(pairs, "MOST_NAMED", 10)
    names = ["big"] * 50 + ["three"] * 3 + ["five"] * 5 + [""] * 20 + ["7"] * 2 + ["one"]
    rows = spark.createDataFrame([(i, n, [1.0]) for i, n in enumerate(names)], "chunk_seq long, name string, embedding array<float>").localCheckpoint()
    # a constant, as in one collection
    rows = rows.withColumn("collection", F.lit(1))
    found = pairs._sectioned(rows, rows.drop("name"), rows.select("collection", "name"), 4)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # rows, and counts of names
    got = {r["chunk_seq"]: (r["section"], r["section_size"]) for r in found.collect()}
    assert got == {i: (n, names.count(n)) if n in ("three", "7") else (None, None) for i, n in enumerate(names)}
    # a section's rows are in one task, next to each other
    runs = [[k for i, k in enumerate(t) if k and (not i or t[i - 1] != k)] for t in found.select("section").rdd.map(lambda r: r[0]).glom().collect()]
    assert sorted(k for t in runs for k in t) == ["7", "three"]
