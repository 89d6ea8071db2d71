"""Every operator and stage over nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import random
import time
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from leafsight.llm import decontaminate, html, lattice, mixing, multi_index, setsketch, sharding, stages, suffix_repeats, toxicity, warc
from leafsight.llm.common import shared_path, without

CLASHES = ("toxic", "copies", "p_n", "__id", "__n", "__hash", "__before", "__bucket", "__bad", "row", "k", "t", "number", "gone", "a.b", "pid")
VOCAB = "red blue green stone river cloud iron glass paper light night wind salt road leaf moon".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) + str(r.randrange(40)) for _ in range(n))


ROWS = [(i, prose(i, 40), ("a", "b", None)[i % 3]) for i in range(30)]
ROWS += [(None, None, None), (None, None, None), (None, "", "a"), (40, None, "a"), (41, "", "b"), (42, " \n", None), (43, "one", "a")]
ROWS += [(None, prose(1, 40), "a"), (None, prose(90, 40), "b"), (None, prose(90, 40), "b"), (2, prose(2, 40), "c"), (2, prose(2, 40), "c"), (3, prose(91, 40), "c")]
ROWS += [(50, "x" * 300_000, "a"), (51, prose(92, 30_000), "b"), (52, "éİ\U0001f600 " * 50, "a")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).withColumn("n_chars", F.lit(1).cast("long"))
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(30)] + [(None, 1, 1), (7, None, None), (8, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, prose(5, 40)), (1, prose(5, 40)), (2, prose(5, 40)), (None, prose(6, 40)), (3, None), (4, ""), (5, "one"), (6, prose(90, 40))]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("doc_id", F.lit(5).cast("long"))


def multiset(rows):
    return Counter((r["doc_id"], r["text"], r["source"]) for r in rows)


EVERY = Counter(ROWS)


def test_toxicity(docs, labels):
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    empties = {r["score"] for r in got if r["doc_id"] in (40, 41)}
    assert len(empties) == 1
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in got)
    for d, lab in ((docs.limit(0), labels), (docs, labels.limit(0)), (docs.limit(0), labels.limit(0)), (docs, labels.where("toxic = 0"))):
        some = toxicity.train(d, lab)
        assert toxicity.score(d, some).count() == toxicity.keep_clean(d, some).count() == d.count()


def test_near_duplicates(docs):
    got = setsketch.link_components(docs, 2, 80).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in ROWS)
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    kept = setsketch.keep_one(docs)
    rows = multiset(kept.collect())
    assert kept.columns == docs.columns and not rows - EVERY
    assert rows[None, None, None] == 2 and rows[None, prose(90, 40), "b"] == 1 and rows[2, prose(2, 40), "c"] + rows[2, prose(2, 40), None] == rows[3, prose(91, 40), "c"] == 1 and not rows[None, prose(1, 40), "a"]
    plain = docs.where("doc_id < 30").dropDuplicates(["doc_id"])
    assert setsketch.keep_one(plain).columns == docs.columns and setsketch.keep_one(plain).count() == 30
    assert setsketch.keep_one(docs.limit(0)).count() == setsketch.link_components(docs.limit(0)).count() == 0


def test_decontamination(docs, benchmark):
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, benchmark).collect()}
    assert found == {(5, 1), (5, 2), (6, None), (43, 5), (None, 6)}
    left = decontaminate.clean_documents(docs, benchmark)
    want = Counter({r: n for r, n in EVERY.items() if r[0] not in (5, 6, 43) and r[1] != prose(90, 40)})
    assert left.columns == docs.columns and multiset(left.collect()) == want
    for d, b in ((docs.limit(0), benchmark), (docs, benchmark.limit(0)), (docs.limit(0), benchmark.limit(0))):
        assert decontaminate.matches(d, b).count() == 0 and decontaminate.clean_documents(d, b).count() == d.count()


def test_masks_meet_every_window():
    """Windows of 13 to 25 tokens of which 8 in 10 are equal: any longer stretch that is accepted holds one of these."""
    masks = [[i for i, c in enumerate(m) if c == "1"] for m in decontaminate.MASKS]
    for n in range(13, 26):
        if n % 5 and n > 16:
            continue  # holds one of the shorter ones with as many tokens unequal
        full = (1 << n) - 1
        windows = np.array([full & ~sum(1 << i for i in gone) for gone in combinations(range(n), n // 5)], np.int64)
        met = np.zeros(len(windows), bool)
        for m in masks:
            b = sum(1 << i for i in m)
            for at in range(n - max(m)):
                met |= ((windows >> at) & b) == b
        assert met.all(), n


def test_overlap_with_scattered_substitutions(spark):
    item = prose(300, 40).split()
    part = item[10:25]
    part[5] = part[11] = "other"
    docs = spark.createDataFrame([(1, "a b c " + " ".join(part) + " d e")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    (r,) = decontaminate.matches(docs, bench).collect()
    assert (r["matched"], r["overlap"], r["doc_pos"], r["item_pos"]) == (13, 15, 3, 10)


def test_decontamination_in_groups(spark):
    items = [(i, prose(400 + i, 20 + i)) for i in range(12)]
    docs = spark.createDataFrame([(i, prose(500 + i, 20) + " " + t) for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole, parts = ({(r["doc_id"], r["item_id"], r["matched"]) for r in decontaminate.matches(docs, bench, most_seeds=n).collect()} for n in (1 << 19, 100))
    assert whole == parts == {(i, i, 20 + i) for i, _ in items}


def drawn(docs, weights=(5, 2, 1)):
    """Which rows a mix draws, row by row: keys sorted, words summed."""
    by = {}
    for r in docs:
        by.setdefault(r["source"], []).append(r)
    return by


def test_mixing(docs):
    got = mixing.mix(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in ROWS)
    by = drawn(got)
    assert sum(v[0]["target"] for v in by.values()) == pytest.approx(1.5 * sum(r["size"] for r in got))
    for v in by.values():
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= max(r["size"] for r in v) and all(0 <= r["copies"] <= 2 for r in v)
    want = Counter()
    for r in got:
        want[r["doc_id"], r["source"], r["text_hash"]] += r["copies"]
    mixed = mixing.mixed_documents(docs)
    have = Counter((r["doc_id"], r["source"], r["h"]) for r in mixed.withColumn("h", F.md5(F.col("text").cast("binary"))).collect())
    assert mixed.columns == docs.columns and have == +want
    assert mixing.mix(docs.limit(0)).count() == mixing.mixed_documents(docs.limit(0)).count() == 0


def test_mixing_by_brute_force_and_narrow_histograms(spark):
    """Few rows may be sorted and bins are few, so a draw's end takes several histograms."""
    r = random.Random(8)
    rows = [(i, " ".join("w" * r.randrange(1, 9) for _ in range(r.randrange(0, 60))), "ab"[i % 2]) for i in range(500)] + [(900, "same words here", "a")] * 150
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keyed = [x.asDict() for x in mixing._keyed(docs, 17, None).collect()]
    for sort, bins in ((100_000, 1024), (5, 3)):
        got = drawn(mixing.mix(docs, sort=sort, bins=bins).collect())
        for source, v in got.items():
            mine = sorted((x for x in keyed if x["source"] == source), key=lambda x: (-x["key"], x["doc_id"], x["text_hash"]))
            size = sum(x["size"] for x in mine)
            epochs, until, want = int(v[0]["target"] // size), 0, Counter()
            rest = v[0]["target"] - epochs * size
            for x in mine:
                until += x["size"]
                want[x["doc_id"], (epochs + (until - x["size"] / 2 <= rest)) * x["size"]] += 1
            assert Counter((x["doc_id"], x["taken"]) for x in v) == want


def test_long_words_are_drawn_by_chance(spark):
    """Weights near 0 once made all keys 0, and draws followed the ids."""
    docs = spark.createDataFrame([(i, ("%05d" % i) * 500, "a") for i in range(200)], "doc_id long, text string, source string")
    got = mixing.mix(docs, share=0.8).orderBy("doc_id").collect()
    parts = [sum(r["copies"] for r in got[k : k + 50]) for k in range(0, 200, 50)]
    assert sum(parts) == 160 and max(parts) < 49


def test_sharding_by_brute_force(spark, docs):
    slim = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("crc")).collect()

    def chain(values, seed=42):
        for v in values:
            seed = seed if v is None else xxhash.xxh64((v % 2**64).to_bytes(8, "little"), seed=seed).intdigest()
        return seed - 2**64 if seed >= 2**63 else seed

    keys = sorted((chain([i, c, n + 8]) % sharding.BUCKETS, chain([i, c, n + 8]), chain([i, n + 8, c]), (-1 if i is None else i, n + 8, c)) for i, n, c in slim)
    places = [[int(x) for x in range(len(keys))]]
    at = sharding.permute(np.array(places[0]), len(keys))
    want = Counter((row, int(p) % 24, int(p) // 24) for (*_, row), p in zip(keys, at, strict=True))
    got = Counter(((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"]), r["shard"], r["slot"]) for r in sharding.shard_documents(docs).collect())
    assert got == want


def test_sharding(spark, docs):
    for options in ({}, {"bucket_rows": 2, "buckets": 3}):
        out = sharding.shard_rows(docs, 5, ["doc_id", "text"], **options)
        rows = out.collect()
        assert out.columns == [*docs.columns, "shard", "slot"] and multiset(rows) == EVERY
        slots = {}
        for r in rows:
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    same = spark.createDataFrame([(1, "a")] * 300 + [(2, "b")] * 10, "doc_id long, text string").repartition(7)
    rows = sharding.shard_rows(same, 4, ["doc_id", "text"], bucket_rows=20, buckets=2).collect()
    assert len({(r["shard"], r["slot"]) for r in rows}) == 310
    assert sharding.shard_rows(docs.limit(0), 5, ["doc_id"]).count() == sharding.shard_documents(docs.limit(0)).count() == 0


def test_lattice_by_brute_force(spark, docs):
    weights = {b" ": -2.0, b"a": -1.5, b"b": -1.0, b" a": -2.5, b"ab": -0.7, b"ba": -3.0, b" ab": -2.2, b"aba": -4.0}
    model = lattice.Lattice(weights)

    def total(text):
        return 1.0 if not text else sum(np.exp(w) * total(text[len(p) :]) for p, w in weights.items() if text.startswith(p))

    for n in range(1, 8):
        for letters in combinations("abababab", n):
            word = "".join(letters).encode()
            assert 10 ** model.log10(word) == pytest.approx(total(b" " + word))
    got = lattice.score(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in ROWS) and len({r["score"] for r in got if r["doc_id"] in (40, 41, 42)}) == 1
    same = [r["score"] for r in got if r["doc_id"] == 2]
    assert len(same) == 3 and max(same) - min(same) < 1e-9
    assert lattice.score(docs.limit(0)).count() == 0


def test_warc_and_repeats(spark, docs):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), "toxic", "a.b" if False else "row")
    folder = shared_path(spark, "edges")
    got = warc.read(warc.write(pages, folder), folder).collect()
    assert Counter(r["page_id"] for r in got) == Counter(r[0] for r in ROWS)
    folder = shared_path(spark, "edges")
    assert warc.read(warc.write(pages.limit(0), folder), folder).count() == 0
    out = suffix_repeats.strip_repeats(docs).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in ROWS)
    assert all(not r["spans"] for r in out if r["doc_id"] is None or r["doc_id"] < 30 and r["doc_id"] != 2)


def test_html(spark, docs):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), "text")
    got = html.extract(pages).collect()
    assert Counter(r["page_id"] for r in got) == Counter(r[0] for r in ROWS) and {r["text"] for r in got if r["page_id"] == 40} == {""}
    assert html.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<div>" * 30_000, "<a " * 60_000, "<ul><li>x" * 10_000, "<table><tr><td>x" * 8_000, "<p><b>" * 20_000, "<table>" + "<tr><td colspan=1000>a<td rowspan=65000>b" * 400, "<b>" * 20_000 + "</i>" * 20_000])
def test_html_takes_linear_time(page):
    began = time.time()
    html.render(page)
    once = time.time() - began
    began = time.time()
    html.render(page * 2)
    assert time.time() - began < 4 * once + 1


def test_html_tables_and_fields():
    say = html.render
    assert say("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>") == "a  b\n   c"
    assert say("<table><tr><td colspan=2>a<td>b<tr><td>c<td>d<td>e</table>") == "a     b\nc  d  e"
    assert say("<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</tbody><tbody><tr><td>e</tbody></table>") == "a  b\n   c\n   d\ne"
    assert say("Name <input value='Ann'> <input type=submit value=Go><input type=hidden value=x><input type=password value=y><input placeholder=mail>") == "Name Ann Go mail"
    assert say("<div>" * 3000 + "<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>33<td>4</table>") == "- a\n- b\n\n1   2\n33  4"
    assert say("<table><tr><td>" * 40 + "deep") == "deep"
    assert say('a <a href="x>y">link</a> b <a href="z>c</a> d') == "a link b c d"


def test_nearest_of_unlike_lengths(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=8 if i % 2 else 12).tolist()) for i in range(120)] + [(20, None), (None, [1.0] * 8), (40, [0.0] * 8), (121, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("query_id", F.lit(1)).withColumn("score", F.lit(2))
    got = multi_index.nearest(df, step=3, k=5).collect()
    vectors = {i: np.array(v, np.float32).astype(float) for i, v in rows[:120]}
    assert {x["query_id"] for x in got} == set(range(0, 120, 3)) and all(len(vectors[x["query_id"]]) == len(vectors[x["vec_id"]]) for x in got)
    assert all(x["score"] == pytest.approx(vectors[x["query_id"]] @ vectors[x["vec_id"]]) for x in got) and len(got) == 40 * 5
    assert multi_index.nearest(df.limit(0)).count() == 0


def test_estimates_keep_similar_pairs():
    """Pairs at the threshold, by set size: none may be ruled out before full sets are compared."""
    r = np.random.default_rng(9)
    for size in (40, 200, 600, 3000, 20_000):
        for _ in range(40):
            both, only = (r.integers(0, 2**64, n, np.uint64) for n in (size, 2 * (size // 8)))
            x, y = np.unique(np.concatenate([both, only[: size // 8]])), np.unique(np.concatenate([both, only[size // 8 :]]))
            # smaller sets are compared in full
            assert 100 * len(x) < 80 * setsketch.SMALL or setsketch.fine_near(setsketch.fine(x), setsketch.fine(y), 80)
            p, q = (setsketch.registers(setsketch.sketch(s)) for s in (x, y))
            j = setsketch.joint_estimate(*[np.array([v], float) for v in (len(x), len(y), (p > q).sum(), (p < q).sum(), (p == q).sum())])[0]
            assert j >= 0.8 - setsketch.MARGIN


def test_without(spark):
    docs = spark.createDataFrame([(i if i % 7 else None, "t") for i in range(2000)], "k long, row string")
    gone = spark.createDataFrame([(i,) for i in range(0, 2000, 3)] + [(None,)], "k long")
    left = without(docs, F.col("k"), gone)
    assert left.columns == docs.columns and sorted(r["k"] or -1 for r in left.collect()) == sorted(i if i % 7 else -1 for i in range(2000) if i % 7 == 0 or i % 3)


def test_stages_keep_columns_whatever_their_names(spark, docs, labels, benchmark, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for stage in (stages.non_toxic, stages.near_deduplicated, stages.decontaminated, stages.mixed):
        at = f"{tmp_path}/{stage.__name__}"
        stage(spark, now, str(tmp_path)).write.parquet(at)
        now = spark.read.parquet(at)
        assert now.columns == docs.columns
    assert stages.sharded(spark, now, str(tmp_path)).count() == now.count()
