import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafsight.llm import decontaminate, html, lattice, mixing, multi_index, setsketch, sharding, stages, suffix_repeats, toxicity, warc
from leafsight.llm.common import shared_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = "red blue green stone river cloud iron glass paper light night wind salt road leaf moon".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = [prose(i, 60) for i in range(12)]
    out = [(i, t) for i, t in enumerate(base)]
    out += [(20, base[0]), (21, base[0]), (22, base[1] + " tail"), (23, base[2].replace("red", "RED", 1))]
    out += [(30, None), (31, ""), (32, " \n\t"), (33, "one"), (34, "one"), (35, "two words"), (36, prose(99, 9000)), (37, "x" * 40_000)]
    out += [(40, base[3] + " ... " + base[4][:200]), (41, "é" * 60), (42, "é" * 60)]
    return [(i, t, "en", [None, "a", "b"][i % 3], 0) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash")).withColumn("key", F.lit(1))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_duplicates(docs, rows, empty):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()

    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["doc_id"]: r for r in setsketch.link_components(docs, 2, 80).collect()}
    assert {i: got[i]["component_id"] for i in sets} == {i: find(i) for i in sets}
    assert all(got[i]["n_shingles"] == len(sets[i]) and got[i]["kept"] == (got[i]["component_id"] == i) for i in sets)
    assert setsketch.link_components(empty, 2, 80).count() == 0


def test_sketch_estimates_and_merges():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 2**63, 900).astype(np.uint64), r.integers(0, 2**63, 100).astype(np.uint64)
    x, y = np.unique(a), np.unique(np.concatenate([a[:850], b]))
    p, q = (setsketch.registers(setsketch.sketch(s)) for s in (x, y))
    assert (setsketch.merge(p, q) == setsketch.registers(setsketch.sketch(np.union1d(x, y)))).all()
    j = setsketch.joint_estimate(*[np.array([v], float) for v in (len(x), len(y), (p > q).sum(), (p < q).sum(), (p == q).sum())])[0]
    assert abs(j - len(np.intersect1d(x, y)) / len(np.union1d(x, y))) < 0.15


def test_repeats(docs, rows, empty):
    seen, want = set(), {}
    for i, t in sorted((r[0], r[1]) for r in rows):
        b = (t or "").encode()
        gone, new = np.zeros(len(b), bool), set()
        for s in range(len(b) - 49):
            (gone.__setitem__(slice(s, s + 50), True) if b[s : s + 50] in seen else new.add(b[s : s + 50]))
        seen |= new
        want[i] = bytes(np.frombuffer(b, np.uint8)[~gone])
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_repeats.strip_repeats(docs).collect()}
    assert got == want
    for crowd in (0, 1):
        assert {r["doc_id"]: bytes(r["kept"]) for r in suffix_repeats.strip_repeats(docs, crowd=crowd).collect()} == want
    assert suffix_repeats.strip_repeats(empty).count() == 0
    # anchors, but none shared
    alone = suffix_repeats.strip_repeats(docs.where("doc_id = 5")).collect()
    assert len(alone) == 1 and bytes(alone[0]["kept"]) == want[5]


def test_maximal_repeats_by_brute_force():
    r = random.Random(3)
    texts = list({bytes(r.choice(b"ab") for _ in range(r.randrange(4, 16))) for _ in range(12)})
    at = defaultdict(set)
    for k, t in enumerate(texts):
        for i in range(len(t)):
            for j in range(i + 3, len(t) + 1):
                at[t[i:j]].add((k, i))
    want = set()
    for s, places in at.items():
        left = {texts[k][i - 1] if i else (k, i) for k, i in places}
        right = {texts[k][i + len(s)] if i + len(s) < len(texts[k]) else (k, i) for k, i in places}
        if len(places) > 1 and len(left) > 1 and len(right) > 1:
            want.add((len(s), frozenset(places)))
    got = {(n, frozenset(zip(o.tolist(), p.tolist()))) for n, o, p in suffix_repeats.maximal_repeats(texts, 3)}
    assert got == want


def test_decontamination(spark, docs, rows, empty):
    bench = spark.createDataFrame([(1, prose(3, 60)), (2, prose(500, 40)), (3, None), (4, "short one")], "item_id long, text string")
    words = prose(500, 40).split()
    words[10] = words[25] = "CHANGED"
    more = spark.createDataFrame([(90, "before " + " ".join(words) + " after", "en", "a", 0), (90, "before " + " ".join(words) + " after", "en", "a", 0)], SCHEMA)
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.matches(docs.select(*more.columns).unionByName(more), bench).collect()}
    assert set(got) == {(3, 1), (40, 1), (90, 2)} and got[90, 2]["matched"] == 38 and got[90, 2]["doc_pos"] == 1
    assert decontaminate.matches(empty, bench).count() == 0
    left = {r["doc_id"] for r in decontaminate.clean_documents(docs, bench).collect()}
    assert left == {r[0] for r in rows} - {3, 40}


def test_decontamination_of_short_items(spark):
    item = {n: [f"w{n}x{i}" for i in range(n)] for n in (3, 5, 9, 12)}
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in item.items()], "item_id long, text string")
    few = {3: 0, 5: 1, 9: 1, 12: 2}
    data, want = [], set()
    for n, w in item.items():
        for k in range(few[n] + 2):
            for at in combinations(range(n), k):
                if k <= few[n]:
                    want.add((len(data), n))
                data.append((len(data), "a " * (len(data) % 30) + " ".join("other" if i in at else x for i, x in enumerate(w)) + " z" * (len(data) % 7)))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = decontaminate.matches(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert all(r["matched"] >= 0.8 * r["item_id"] and r["doc_pos"] - r["item_pos"] == r["doc_id"] % 30 for r in got)


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    total = sum(r["size"] for r in got)
    assert sum(v[0]["target"] for v in by.values()) == pytest.approx(1.5 * total)
    for v in by.values():
        assert v[0]["target"] <= 2 * v[0]["source_size"] + 1e-6
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= max(r["size"] for r in v)
        assert all(r["taken"] <= 2 * r["size"] for r in v)
    assert mixing.mix(empty).count() == 0
    twice = mixing.mixed_documents(docs)
    assert twice.columns == docs.columns and twice.count() == sum(r["copies"] for r in got)


def test_sharding(docs, rows, empty):
    for n in (1, 2, 10, 1000, 4097):
        assert sorted(sharding.permute(np.arange(n), n).tolist()) == list(range(n))
    got = sharding.shard_documents(docs, 5).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    crc = {r[0]: zlib.crc32((r[1] or "").encode()) for r in rows}
    assert all(r["text_crc32"] == crc[r["doc_id"]] for r in got) and sharding.shard_documents(empty).count() == 0


def test_nearest(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 16)).astype(np.float32)
    x[100:160] = x[7]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (920, [0.0] * 16), (940, [float("nan")] * 16), (960, [])]
    got = defaultdict(list)
    for q in multi_index.nearest(spark.createDataFrame(data, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect():
        got[q["query_id"]].append(q["vec_id"])
    hit = 0
    for i in range(0, 400, 20):
        s = x.astype(float) @ x[i].astype(float)
        want = [k for k in np.lexsort((np.arange(400), -np.round(s, 9))) if k != i][:20]
        assert len(got[i]) == 20
        hit += len(set(want) & set(got[i]))
    assert set(got) == set(range(0, 400, 20)) and hit >= 0.9 * 400


def test_lattice(spark, docs, rows):
    m = lattice.Lattice({b" ": np.log(0.1), b"a": np.log(0.2), b"b": np.log(0.2), b" a": np.log(0.1), b"ab": np.log(0.3)})
    assert 10 ** m.log10(b"ab") == pytest.approx(0.1 * 0.2 * 0.2 + 0.1 * 0.3 + 0.1 * 0.2)
    got = {r["doc_id"]: r for r in lattice.score(docs, head=5).collect()}
    train = Counter(w for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2 for w in [*lattice.words(r[1]), b" "])
    n, v = sum(train.values()), len(train)
    for r in rows:
        tokens = [*lattice.words(r[1]), b" "]
        g = got[r[0]]
        assert g["base_score"] == pytest.approx(sum(np.log10((train[w] + 1) / (n + v + 1)) for w in tokens))
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(tokens), sum(train[w] > 0 for w in tokens), n) and g["score"] < 0


def test_warc(spark):
    big = "<p>" + "y" * 300
    data = [(1, "http://a", big), (2, None, big), (3, "u\r\nv", None), (4, "", "short"), (5, "x", "short"), (6, "z", "é\n\r\n\r\n" * 40)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    folder = shared_path(spark, "warc-test")
    index = warc.write(pages, folder)
    got = {r["page_id"]: r for r in warc.read(index, folder, payloads=True).collect()}
    for i, _, h in data:
        b = (h or "").encode()
        assert got[i]["payload_digest"] == hashlib.sha256(b).hexdigest() and got[i]["payload_bytes"] == len(b)
        assert got[i]["payload"] is None if i == 2 else bytes(got[i]["payload"]) == b
    assert (got[2]["record_type"], got[2]["refers_to"]) == ("revisit", 1) and got[5]["record_type"] == "response"
    assert warc.read(index.where("page_id in (1, 6)"), folder).count() == 2


def test_html():
    page = "<html><head><title>no</title><style>p{}</style></head><body><script>var a='</p>'</script><p>One<p>Two <b>bold</b><br>next<ul><li>a<li>b<ol><li>c</ol></ul><div hidden>x</div><table><tr><td>1<td>long<tr><td>333<td>4</table>&amp;"
    assert html.render(page) == "One\n\nTwo bold\nnext\n\n- a\n- b\n  1. c\n\n1    long\n333  4\n\n&"
    assert html.render(None) == html.render("") == html.render("<!-- x") == ""
    assert "deep" in html.render("<div>" * 5000 + "deep")


def test_rows_without_an_id_of_their_own(spark):
    one, two, three = prose(1, 50), prose(2, 50), prose(3, 50)
    rows = [(1, one), (1, two), (1, None), (2, one), (2, three), (None, two), (None, None), (None, prose(4, 50)), (None, prose(4, 50)), (3, three)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [tuple(r) for r in setsketch.keep_one(docs).collect()]
    assert sorted(left, key=str) == sorted([(1, one), (1, two), (1, None), (2, three), (None, None), (None, prose(4, 50))], key=str)
    bench = spark.createDataFrame([(1, prose(4, 50)), (2, three)], "item_id long, text string")
    left = [tuple(r) for r in decontaminate.clean_documents(docs, bench).collect()]
    assert sorted(left, key=str) == sorted([(1, one), (1, two), (1, None), (None, two), (None, None)], key=str)


def test_html_shows_what_browsers_show():
    say = html.render
    assert say("<div style='backface-visibility: hidden'>card</div>") == "card"
    assert say("<p style='background:url(\"a;display:none\")'>a</p><p style='display:none!important;display:block'>b</p><p style='DISPLAY : none'>c</p><p style='display:none;display:block'>d</p>") == "a\n\nd"
    assert say("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b>c</div><ul style='visibility:collapse'><li>d</ul>") == "b"
    assert say("<p>where <math><mi>x</mi><mo>=</mo><mspace/><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>x</annotation></math> is") == "where x=1 2 is"
    assert say("<svg><title>no</title><g>no<path/></g><desc>no</desc><text>Jan<tspan>uary</tspan></text><text>1 <![CDATA[<2]]></text></svg><svg/>after<svg><g><p>out") == "January\n1 <2\nafter\n\nout"
    assert say("<p>Size <select><option disabled>-<option>S<option selected>M<option>L</select> of") == "Size M of"
    assert say("<select><option disabled>-<option>S<option>M</select>") == "S" and say("<select multiple><option>S<option hidden>M<option>L</select>") == "S\nL"
    assert say("<textarea>\na  b\n&lt;c</textarea>") == "a  b\n<c"


def test_html_columns_with_a_wide_cell_stay_aligned():
    page = f"<table><tr><td>a<td>1<tr><td>bbb<td>2<tr><td>{'w' * 81}<td>3</table>"
    assert html.render(page) == f"a    1\nbbb  2\n{'w' * 81}  3"


def test_html_raw_elements_end_where_they_do():
    dots = "\u0130" * 20
    assert html.render(f"{dots}<SCRIPT>x</scripty></Script>text<p>more</p><style>y</style >end") == f"{dots}text\n\nmore\n\nend"
    assert html.render(f"{dots}<script>a</script><script>b('</p>')</script>c") == f"{dots}c"


def test_toxicity(spark):
    r = random.Random(5)
    data, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = prose(i, 50).split()
        if bad:
            words[r.randrange(50)] = "vequ" + r.choice(["an", "ot", "il"])
        data.append((i, " ".join(words), "fr", "a", 0))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame([*data, (700, None, "en", "a", 0), (701, "", "en", "a", 0)], SCHEMA)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {x["doc_id"]: x for x in toxicity.score(docs, model).collect()}
    out = [i for i in range(600) if got[i]["held_out"]]
    assert out and sum(got[i]["predicted"] == (i % 4 == 0) for i in out) >= 0.97 * len(out)
    assert got[700]["predicted"] == got[701]["predicted"] == 0
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(x["predicted"] == 0 for x in got.values())


def test_stages_keep_columns(spark, docs):
    one = stages.near_deduplicated(spark, docs, "")
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} >= {0, 30, 33} and one.where("doc_id in (20, 21)").count() == 0
    assert {"shard", "slot"} <= set(stages.sharded(spark, docs, "").columns)
