import math
import random
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from leafsight.functions import hooks
from leafsight.functions import text as T
from leafsight.functions import vectors
from leafsight.operators import evaluate, search, timing
from leafsight.sources import store
from leafsight.streaming.ingest import ingest

DOCS = [(0, 1, "s", "alpha beta beta", [1.0, 0.0], "text"), (1, 1, "s", "beta gamma", [0.6, 0.8], "table"), (2, 2, "", "delta", [0.0, 1.0], "image"), (3, None, "s2", "alpha", [0.0, 1.0], "text")]


@pytest.fixture(scope="module")
def data(spark):
    c = spark.createDataFrame([(1, *d) for d in DOCS], "collection int, chunk_seq long, page int, title string, text string, embedding array<float>, chunk_type string")
    q = spark.createDataFrame([(1, 1, "alpha beta gamma", [1.0, 0.0]), (2, 1, "nothing known", [0.0, 1.0])], "query_id long, collection int, text string, qvec array<float>")
    return c, q


def okapi(query):
    toks = [[t for t in f"{d[2]} {d[3]}".split() if len(t) > 1] for d in DOCS]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)
    df = Counter(t for x in toks for t in set(x))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in idf.items()}
    return [sum(idf.get(t, 0) * x.count(t) * 2.5 / (x.count(t) + 1.5 * (0.25 + 0.75 * len(x) / avg)) for t in query.split()) for x in toks]


def test_bm25_and_fusion(data):
    rows = {r["chunk_seq"]: r for r in search.fuse(search.scored(*data)).where("query_id = 1").collect()}
    want = okapi("alpha beta gamma")
    lo, hi = min(want), max(want)
    for i, w in enumerate(want):
        assert rows[i]["bm25"] == pytest.approx(w)
        assert rows[i]["score"] == pytest.approx(0.6 * rows[i]["norm_cos"] + 0.4 * (w - lo) / (hi - lo))
    none = search.scored(*data).where("query_id = 2").agg(F.max("norm_bm25")).first()[0]
    assert none == 0


def test_types_are_left_out_after_scoring(data):
    every = {(r["query_id"], r["chunk_seq"]): r["score"] for r in search.search(*data, k=9).collect()}
    some = search.search(*data, k=9, types=["text"]).collect()
    assert {r["chunk_seq"] for r in some} == {0, 3} and all(every[r["query_id"], r["chunk_seq"]] == r["score"] for r in some)


def test_lift_and_pages(data):
    c, q = data
    hits = search.described(search.fuse(search.scored(c, q)), c, "page", "title", "chunk_type", "text")
    base = {(r["query_id"], r["chunk_seq"]): r["score"] for r in hits.collect()}
    for r in search.lift_sections(hits).collect():
        want = max(base[r["query_id"], r["chunk_seq"]], 0.5 * max(base[r["query_id"], i] for i in (0, 1))) if r["title"] == "s" else base[r["query_id"], r["chunk_seq"]]
        assert r["score"] == pytest.approx(want)
    got = search.pages(search.lift_sections(hits.drop('text')), c).where("query_id = 1").orderBy("page_rank").collect()
    assert got[0]["page"] == 1 and got[0]["sections"] == ["s"] and len(got[0]["evidence"]) == 2
    assert search.context(search.top(hits, 2), 10).count() == 2 and search.citations(search.top(hits, 4)).count() > 0


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (1, 7, 3), (2, 1, 1)], "query_id long, page int, page_rank int")
    gold = spark.createDataFrame([(1, 6, 2), (1, 9, 1), (2, 3, 2)], "query_id long, page int, grade int")
    r = {x["query_id"]: x for x in evaluate.metrics(ranked, gold).collect()}
    assert (r[1]["hit_1"], r[1]["hit_3"], r[1]["recall_5"], r[1]["first_rank"]) == (0, 1, 0.5, 2)
    assert r[1]["ndcg"] == pytest.approx((2 / math.log2(3)) / (2 + 1 / math.log2(3)))
    assert r[2]["ndcg"] == 0 and r[2]["first_rank"] is None


def test_store_and_stream(spark, tmp_path):
    rows = [("d1", "c1", "text", "some words here", {"title": " ", "page_number": 0}), ("d2", "c2", "image", "more", {"title": "t", "page_number": 3})]
    df = spark.createDataFrame([(d, i, k, t, {**{"page_number": None}, **m}) for d, i, k, t, m in rows], "doc_id string, chunk_id string, chunk_type string, text string, metadata struct<page_number:int,title:string>")
    df.write.json(str(tmp_path / "in"))
    encode = lambda c: vectors.hashed_encoder(T.tokenize(c))
    for _ in range(2):
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "index"), str(tmp_path / "state"), encode).awaitTermination()
    got = {r["chunk_id"]: r for r in store.scan_index(spark, str(tmp_path / "index")).collect()}
    assert got["c1"]["page"] == -1 and got["c2"]["page"] == 3 and len(got["c1"]["embedding"]) == 64
    with pytest.raises(store.StoreError):
        store.write_index(store.scan_index(spark, str(tmp_path / "index")).unionByName(store.scan_index(spark, str(tmp_path / "index"))), str(tmp_path / "x"), "d")
    with pytest.raises(store.BadRequest):
        store.accept_upload("x.txt", 3)


def test_collections_are_apart(spark, data):
    c, q = data
    both = c.unionByName(c.withColumn("collection", F.lit(2)).withColumn("text", F.concat("text", F.lit(" omega"))))
    asked = q.unionByName(spark.createDataFrame([(3, 2, "alpha beta gamma", [1.0, 0.0])], q.schema))
    got = search.search(both, asked, 9).collect()
    assert len(got) == 3 * len(DOCS) and all(r["collection"] == (2 if r["query_id"] == 3 else 1) for r in got)
    alone = {(r["query_id"], r["chunk_seq"]): (r["score"], r["rank"]) for r in search.search(c, q, 9).collect()}
    assert alone == {(r["query_id"], r["chunk_seq"]): (r["score"], r["rank"]) for r in got if r["query_id"] < 3}
    assert {(r["query_id"], r["page"]) for r in search.pages(search.described(search.fuse(search.scored(both, asked)), both, "page", "title", "chunk_type"), both).collect()} >= {(1, 1), (3, 1)}


def test_stored_lexicon(spark, data, tmp_path):
    c, q = data
    search.lexicon(c).save(str(tmp_path))
    stored = search.StoredLexicon.load(spark, str(tmp_path))
    one, two, three = ({(r["query_id"], r["chunk_seq"]): r["bm25"] for r in search.bm25(x, q).collect()} for x in (c, stored, search.lexicon(c)))
    assert one == pytest.approx(two) and one == pytest.approx(three) and one
    best = {(r["query_id"], r["chunk_seq"]): r["score"] for r in search.best_bm25(stored, q, 9).collect()}
    assert one == pytest.approx(best)


def test_bounded_search_has_the_same_rows_from_fewer_postings(spark, tmp_path, monkeypatch):
    r = random.Random(4)
    words = [f"w{int(r.paretovariate(0.7)) % 3000}" for _ in range(60_000)]
    rows = [(i % 2, i // 2, None, " ".join(r.choices(words, k=r.randint(5, 60)))) for i in range(3000)] + [(0, 5000, None, ""), (1, 5000, None, None)]
    c = spark.createDataFrame(rows, "collection int, chunk_seq long, title string, text string")
    # common words beside telling ones, as people ask
    ask = lambda: " ".join([*r.choices([w for w in words if len(w) > 3], k=4), *r.choices([f"w{i}" for i in range(1, 12)], k=4), "unknown"])
    q = spark.createDataFrame([(i, i % 2, ask()) for i in range(40)] + [(50, 0, ""), (51, 7, "w1"), (52, 1, "w1 w1 w1")], "query_id long, collection int, text string")
    stored = search.lexicon(c).save(str(tmp_path / "lexicon"))
    want = {(x["query_id"], x["rank"]): (x["chunk_seq"], round(x["bm25"], 9)) for x in search.top(search.bm25(c, q).withColumn("score", F.col("bm25")), 10).collect()}
    for lead in (2000, 1):
        monkeypatch.setattr(search, "LEAD", lead)
        got = {(x["query_id"], x["rank"]): (x["chunk_seq"], round(x["score"], 9)) for x in search.best_bm25(stored, q, 10).collect()}
        assert got == want
    monkeypatch.setattr(search, "LEAD", 500)
    found = search.bounded(stored, q, 10)
    every, scored = stored.gains(stored.asked(q)).count(), stored.gains(found.essential).count() + search.other_gains(stored, found).count()
    assert scored < 0.8 * every and found.others.count() > 0
    one = stored.asked(q.where("query_id = 52"))
    plan = stored.gains(one)._jdf.queryExecution().executedPlan().toString()
    asked = [x["bucket"] for x in one.select("bucket").distinct().collect()]
    assert len(asked) == 1 and any(f"bucket#" in p and str(asked[0]) in p for p in [x.split("]")[0] for x in plan.split("PartitionFilters: [")[1:]])


@pytest.mark.parametrize("held", [10, 70, 100_000])
def test_best_of_a_grid(spark, held):
    draw = random.Random(held)
    rows = [(q, 1, i, draw.choice([0.0, 0.5, draw.random()]), draw.choice([None, 0.25, draw.random()])) for q in range(5) for i in range(150)]
    hits = spark.createDataFrame(draw.sample(rows, len(rows)), "query_id long, collection int, chunk_seq long, a double, b double").repartition(3)
    grid = [{"share": i / 4} for i in range(5)]
    score = lambda p: (1 - F.lit(p["share"])) * F.col("a") + F.lit(p["share"]) * F.col("b")
    each = hits.crossJoin(F.broadcast(spark.createDataFrame([(p["share"],) for p in grid], "share double")))
    each = each.withColumn("score", (1 - F.col("share")) * F.col("a") + F.col("share") * F.col("b"))
    want = search.top(each.fillna(float("-inf"), ["score"]), 7, ("share", "query_id"))
    name = ("share", "query_id", "chunk_seq", "rank")
    assert sorted(tuple(r) for r in search.top_of_grid(hits, grid, score, 7).select(*name).collect()) == sorted(tuple(r) for r in want.select(*name).collect())
    scores = hits.select("query_id", "collection", "chunk_seq", F.array("a", "b").alias("scores"))
    some = search.grid_best(scores, 7, held)
    best = search.top(some, 7, ("at", "query_id")).select("at", "query_id", "chunk_seq", "rank")
    flat = scores.select("*", F.posexplode(F.transform("scores", lambda x: F.coalesce(x, F.lit(float("-inf"))))).alias("at", "score"))
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, search.top(flat, 7, ("at", "query_id")).select("at", "query_id", "chunk_seq", "rank").collect()))
    # what a task hands on are its best at each point, unless it can't hold them
    assert held < 100_000 or some.count() <= 3 * 5 * 7 * 2
    assert search.top_of_grid(hits.limit(0), grid, score, 7).count() == 0


def test_chunks_that_hold_a_text(spark):
    draw = random.Random(5)
    words = ["a", "b", "ab", "ba", "é"]
    some = lambda n: "".join(draw.choice(words) + draw.choice([" ", "  ", "\n", ""]) for _ in range(n))
    texts = [(draw.randint(1, 2), i, i // 3, some(40)) for i in range(120)] + [(1, 120, 40, None), (1, 121, 41, "")]
    cut = [(draw.choice(texts[:120])[3][(k := draw.randint(0, 20)) : k + draw.randint(0, 15)]) for _ in range(60)]
    asked = [(i, draw.randint(1, 2), t) for i, t in enumerate([*cut, "", " ", None, "zz zz zz", " a b ", "\u00a0a b c"])]
    c = spark.createDataFrame(texts, "collection int, chunk_seq long, page int, text string")
    q = spark.createDataFrame(asked, "query_id long, collection int, text string")
    want = {(i, n, m, p) for i, k, t in asked for n, m, p, x in texts if n == k and t is not None and x is not None and t in x}
    got = [tuple(r) for r in evaluate.chunks_holding(c, q).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_texts_and_their_words_stay_where_they_are(spark, monkeypatch):
    c = spark.range(400).selectExpr("1 as collection", "id as chunk_seq", "id div 10 as page", "concat_ws(' ', transform(sequence(0, 60), i -> concat('w', (i * id) % 97))) as text")
    q = c.where("chunk_seq % 50 = 3").selectExpr("chunk_seq as query_id", "collection", "substr(text, 3, 90) as text")
    plans = []
    keep = evaluate.written
    monkeypatch.setattr(evaluate, "written", lambda rows, tag: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or keep(rows, tag))
    assert {r["query_id"] for r in evaluate.chunks_holding(c, q).where("query_id = chunk_seq").collect()} == set(range(3, 400, 50))
    assert plans and not any(word in p for p in plans for word in ("Exchange", "Generate"))


def test_untitled_chunks_are_no_section(spark):
    rows = [(1, 1, i, None if i % 2 else " ", i / 10) for i in range(6)]
    hits = spark.createDataFrame(rows, "query_id long, collection int, chunk_seq long, title string, score double")
    assert all(r["score"] == r["chunk_seq"] / 10 for r in search.lift_sections(hits, 0.9, 100).collect())


def test_answers(spark, data):
    c, q = data
    none = spark.createDataFrame([(9, 1, "x", [1.0, 0.0])], q.schema)
    hits = search.search(c, q, 3)
    got = {r["query_id"]: r for r in search.answers(q.unionByName(none), hits, lambda p: F.concat(F.lit(" says "), F.length(p).cast("string")), "nothing").collect()}
    assert got[9]["answer"] == "nothing" and got[9]["citations"] == [] and got[1]["answer"].startswith("says ") and got[1]["citations"][0]["page"] == 1
    text = search.context(hits.where("query_id = 1")).first()["context"]
    assert text.startswith("[page 1 - s]\nbeta gamma") and "[page 2]" in search.context(search.search(c, q, 9).where("query_id = 2")).first()["context"]


def test_strict_recall_and_profiles(spark):
    hits = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 7)], "query_id long, rank int, page int")
    gold = spark.createDataFrame([(1, 6, 2), (2, 9, 1), (3, 9, 1)], "query_id long, page int, grade int")
    r = {x["query_id"]: x for x in evaluate.strict_recall(hits, gold).collect()}
    assert (r[1]["recall_1"], r[1]["recall_3"], r[1]["first_rank"]) == (0, 1, 2) and r[2]["recall_5"] == r[3]["recall_5"] == 0
    mix = evaluate.page_composition(spark.createDataFrame([(6, "text"), (6, "image"), (6, "image")], "page int, chunk_type string"))
    assert {(x["page"], x["composition"]) for x in evaluate.gold_profile(gold, mix).collect()} == {(6, "ima2/tex1"), (9, "NOT INDEXED")}
    ranked = spark.createDataFrame([(1, 6, 1), (2, 5, 1)], "query_id long, page int, page_rank int")
    assert [(x["page"], x["missed"]) for x in evaluate.most_missed(ranked, gold, mix).collect()] == [(9, 2)]


CHUNK = {"page_number": 2, "title": "t", "char_count": 4, "ocr_keywords": ["a", "b"], "image_base64": "QUJD"}


@pytest.mark.parametrize("array", [False, True])
def test_chunk_files_round_trip(spark, tmp_path, array):
    rows = [(f"c{i}", "text", f'line one\n[two] "{i}" é', {**dict.fromkeys(["table_part", "core_text"]), **CHUNK}) for i in range(10)]
    df = spark.createDataFrame([(a, b, c, {k: m.get(k) for k in [f.split(":")[0] for f in store.CHUNK_SCHEMA.split("struct<")[1][:-1].replace("array<string>", "array").split(",")]}) for a, b, c, m in rows], store.CHUNK_SCHEMA)
    store.write_chunks(df, str(tmp_path / "x"), array=array)
    back = store.read_chunks(spark, str(tmp_path / "x"))
    assert sorted(back.collect()) == sorted(df.collect())
    store.write_chunks(df, str(tmp_path / "y"), keep_images=False, array=array)
    assert store.read_chunks(spark, str(tmp_path / "y")).where("metadata.image_base64 is null").count() == 10


def test_registry_and_states(spark, tmp_path):
    reg = str(tmp_path / "registry")
    assert store.load_registry(spark, reg).count() == 0
    assert store.register_sample(spark, reg, str(tmp_path / "no.pdf"), str(tmp_path / "no"), "col", "Sample") is None
    (tmp_path / "a.pdf").write_bytes(b"pdf")
    (tmp_path / "chunks.json").write_text('[{"chunk_id": "1", "metadata": {"page_number": 3}}, {"chunk_id": "2", "metadata": {}}]')
    for _ in range(2):
        entry = store.register_sample(spark, reg, str(tmp_path / "a.pdf"), str(tmp_path / "chunks.json"), "col", "Sample")
        assert (entry["pages"], entry["chunks"], entry["is_sample"]) == (3, 2, True)
    rows = spark.createDataFrame([("c1", "text", "some words", None)], store.CHUNK_SCHEMA)
    encode = lambda c: vectors.hashed_encoder(T.tokenize(c))
    store.put_entry(spark, reg, doc_id="d1", name="d", created=2.0, status="indexing")
    with pytest.raises(store.NotReady):
        store.ready(store.load_registry(spark, reg), "d1")
    assert store.index_document(spark, reg, "d1", str(tmp_path / "index"), lambda: rows, encode) == "ready"
    assert store.index_document(spark, reg, "d2", str(tmp_path / "index"), lambda: rows.unionByName(rows), encode) == "error"
    got = {r["doc_id"]: r for r in store.load_registry(spark, reg).collect()}
    assert got["d1"]["status"] == "ready" and got["d1"]["chunks"] == 1 and got["d2"]["status"] == "error" and "c1" in got["d2"]["message"] and len(got) == 3
    assert [r["doc_id"] for r in store.listed(store.load_registry(spark, reg)).collect()][0] == "sample"


def test_registry_is_a_log_of_events(spark, tmp_path):
    reg = str(tmp_path / "registry")
    # two writers that have read the same state: each changes fields of its own, nothing is lost
    store.put_entry(spark, reg, doc_id="a", name="A", status="indexing")
    one = spark.createDataFrame([("a", "ready")], "doc_id string, status string")
    two = spark.createDataFrame([("a", 7), ("b", 3)], "doc_id string, pages int")
    store.put_entries(one, reg)
    store.put_entries(two, reg)
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda i: store.put_entries(spark.createDataFrame([(f"d{i}", i), ("a", i)], "doc_id string, chunks int"), reg), range(8)))
    got = {r["doc_id"]: r for r in store.load_registry(spark, reg).collect()}
    assert (got["a"]["name"], got["a"]["status"], got["a"]["pages"]) == ("A", "ready", 7) and got["b"]["pages"] == 3
    assert {got[f"d{i}"]["chunks"] for i in range(8)} == set(range(8)) and got["a"]["chunks"] in range(8)
    before = spark.read.parquet(reg).count()
    store.compact_registry(spark, reg, str(tmp_path / "small"))
    assert spark.read.parquet(str(tmp_path / "small")).count() == len(got) == 10 < before
    assert sorted(store.load_registry(spark, str(tmp_path / "small")).collect()) == sorted(store.load_registry(spark, reg).collect())


def test_uploads_get_entries(spark, tmp_path):
    folder, reg = tmp_path / "in", str(tmp_path / "registry")
    folder.mkdir()
    for name, data in {"a.pdf": b"one\ftwo", "copy.PDF": b"one\ftwo", "c.txt": b"x"}.items():
        (folder / name).write_bytes(data)
    pages = lambda c: F.size(F.split(F.decode(c, "UTF-8"), "\f"))
    files = store.binary_files(spark, str(folder), "*")
    # Spark's reader passes over empty files; an upload comes as a row
    files = files.unionByName(files.limit(1).withColumns({"path": F.lit("/up/b.pdf"), "length": F.lit(0).cast("long"), "content": F.lit("").cast("binary")}))
    got = {r["doc_id"]: r for r in store.add_uploads(spark, reg, files, pages).collect()}
    kept = {r["doc_id"]: r for r in store.load_registry(spark, reg).collect()}
    assert len(got) == len(kept) == 3 and sorted(r["status"] for r in kept.values()) == ["error", "error", "indexing"]
    assert [(r["pages"], r["chunks"]) for r in kept.values() if r["status"] == "indexing"] == [(2, 0)]
    assert {r["message"] for r in kept.values()} == {"", "the file is empty", "only PDF files are taken"}
    store.add_uploads(spark, reg, files, pages)
    assert store.load_registry(spark, reg).count() == 3


def test_stage_medians(spark, data):
    got = timing.stage_medians(*data, asked=1)
    assert set(got) == {"dense", "bm25", "total", "fusion"} and got["total"] > 0
    rate = timing.encoder_rate(data[0], lambda c: vectors.hashed_encoder(T.tokenize(c)), 1)
    assert rate["ms_per_chunk"] > 0 and rate["chunks_per_s"] > 0 and rate["load_s"] >= 0


def test_files_are_parsed_once(spark, tmp_path):
    folder, cache = tmp_path / "in", str(tmp_path / "cache")
    folder.mkdir()
    (folder / "a.pdf").write_bytes(b"Title one\nbody")
    (folder / "b.pdf").write_bytes(b"bad")
    (folder / "c.txt").write_bytes(b"no")

    def parser(data):
        if data == b"bad":
            raise ValueError("unreadable")
        return [{"page": 1, "category": "Title" if i == 0 else "NarrativeText", "text": t} for i, t in enumerate(data.decode().split("\n"))]

    for _ in range(2):
        got = store.parsed(spark, str(folder), cache, parser).orderBy("idx").collect()
        assert [(r["idx"], r["category"], r["text"]) for r in got] == [(0, "Title", "Title one"), (1, "NarrativeText", "body")]
    assert spark.read.parquet(cache).where("parse_error like 'ValueError%'").count() >= 1 and spark.read.parquet(cache).where("idx = 0").count() == 1


def test_model_hooks(spark):
    def load():
        return lambda x: str(10 // x)

    df = spark.createDataFrame([(5,), (0,)], "x int")
    assert [r["y"] for r in df.select(hooks.per_worker(load, F.col("x")).alias("y")).collect()] == ["2", ""]
    assert [r["y"] for r in df.select(hooks.per_worker(lambda: 1 / 0, F.col("x")).alias("y")).collect()] == ["", ""]
    unit = spark.createDataFrame([("ab",), ("c",)], "t string").select(hooks.encoder(lambda: lambda ts: [[len(t), 0.0, 3.0] for t in ts], F.col("t")).alias("v")).collect()
    assert all(math.isclose(sum(x * x for x in r["v"]), 1, rel_tol=1e-6) for r in unit)


def test_entry_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
