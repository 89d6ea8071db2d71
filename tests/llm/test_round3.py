"""Language ID, filter audit and fill-in-middle against brute force; pages, archives and small label sets."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafsight.llm import fill_middle, filter_audit, html, langid, toxicity, warc
from leafsight.llm.common import read_table, shared_path

SF = "/root/testdata/sf0.001"
SYLLABLES = {"xx": "ba da ga la ma".split(), "yy": "ori uri eri ati".split(), "zz": "sch tz pf ck".split()}


def words(lang, seed, n):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


LONG = " ".join(f"{'abc'[i % 3]}{i % 700}" for i in range(60_000))
ROWS = [(i, words(k, i, 60), k, f"s{i % 3}") for i in range(90) for k in [("xx", "yy", "zz")[i % 3]]]
ROWS += [(None, None, "xx", None), (None, None, "xx", None), (None, words("xx", 5, 70), None, ""), (100, None, "yy", "s1"), (101, "", None, "s1"), (102, " \n\t", "yy", None)]
ROWS += [(103, "one", None, "s0"), (3, words("xx", 3, 60), "xx", "s0"), (3, words("xx", 3, 60), "xx", "s9"), (4, words("xx", 3, 60), "yy", "s0"), (None, words("xx", 3, 60), "xx", "s0")]
ROWS += [(110, LONG, "xx", "s2"), (111, "x" * 200_000, "xx", "s2"), (112, "éİ\U0001f600 Ab" * 50, "zz", "s2"), (113, "a<P>b c" * 20, "xx", "s2"), (114, "12 34 $%", "xx", "s2"), (115, "AB CD " * 60, "xx", "s1")]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return d.withColumns({c: F.lit("other") for c in ("id", "no_id", "h", "part", "sha", "n", "form", "place", "block", "first", "score", "held_out", "words", "fails", "copies", "`a.b`".strip("`"))})


def audit_by_hand(rows, labels):
    least = {}
    for i, t, _, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good = {i for i, q, _ in labels if i is not None and q == 1}
    bad = {i for i, _, x in labels if i is not None and x == 1}
    fails = []
    for i, t, _, source in rows:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        fails.append((source or "", {k for k, v in f.items() if v}, i in good and i is not None, i in bad and i is not None))
    out = set()
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        removed = defaultdict(int)
        lines = []
        for p in permutations("ABCDE"):
            for s, c in enumerate(p):
                before = set(p[:s])
                here = [f for f in mine if c in f[1] and not f[1] & before]
                removed[c] += len(here)
                lines.append(["".join(p), s + 1, c, sum(not f[1] & (before | {c}) for f in mine), len(here), sum(c in f[1] and bool(f[1] & before) for f in mine), sum(f[1] == {c} for f in mine), sum(f[2] for f in here), sum(f[3] for f in here)])
        out |= {(part, o, s, k, r, d, u, g, t, removed[c]) for o, s, c, k, r, d, u, g, t in lines}
    return out


def test_filter_audit_by_hand(spark, docs):
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 116, 3)] + [(None, 1, 1), (3, 0, 1), (4, None, None), (999, 1, 1)]
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("fails", F.lit(1)).withColumn("good", F.lit(True))
    got = filter_audit.audit(docs, l)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == audit_by_hand(ROWS, labels)
    assert filter_audit.audit(docs.limit(0), l).count() == 0
    assert sum(r["removed"] for r in filter_audit.audit(docs, l.limit(0)).where("filter_order = 'ABCDE'").collect()) == sum(r[4] for r in rows if r[1] == "ABCDE")


def middle_by_hand(i, t):
    t = t or ""
    u = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (i, len(u), "plain", None, None, t)
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h4 % 100 < 20:
        return (i, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (i, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_middle_by_hand(spark, docs):
    got = fill_middle.transform(docs)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert Counter(tuple(r) for r in got.collect()) == Counter(middle_by_hand(i, t) for i, t, _, _ in ROWS)
    back = got.select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert Counter(tuple(r) for r in back) == Counter((i, t or "") for i, t, _, _ in ROWS)
    assert fill_middle.transform(docs.limit(0)).count() == 0


def test_fill_middle_over_many_forms(spark):
    r = random.Random(3)
    rows = [(i, "".join(r.choice("ab <PSM>\né\U0001f600") for _ in range(r.randrange(400)))) for i in range(400)]
    got = fill_middle.transform(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(tuple(r) for r in got.collect()) == Counter(middle_by_hand(*r) for r in rows)
    assert {r["form"] for r in got.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    assert got.where(fill_middle.restored(F.col("output"), F.col("form")) != F.col("output")).count() > 100
    assert got.join(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").where(fill_middle.restored(F.col("output"), F.col("form")) != F.col("text")).count() == 0


def test_language_id(spark, docs):
    model = langid.train(docs)
    assert model.langs == ("xx", "yy", "zz") and 0 <= model.least <= 1
    got = langid.identify(docs, model, reject=False).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in ROWS)
    want = {i: k for i, _, k, _ in ROWS[:90]}
    assert np.mean([r["lang_pred"] == want[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in want]) > 0.9
    by = {r["doc_id"]: r for r in got}
    assert all((by[i]["lang_pred"], by[i]["score"], by[i]["rejected"]) == ("und", 0.0, True) for i in (100, 101, 102, 114)) and by[110]["lang_pred"] in model.langs
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    again = langid.identify(docs.repartition(3), langid.train(docs.repartition(5)), reject=False).collect()
    assert sorted((r["doc_id"] or -1, r["lang_pred"], round(r["score"], 9)) for r in again) == sorted((r["doc_id"] or -1, r["lang_pred"], round(r["score"], 9)) for r in got)
    none = langid.train(docs.limit(0))
    assert none.langs == () and {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"} and langid.identify(docs.limit(0), model).count() == 0
    only = langid.train(docs.where("lang = 'xx'"))
    assert only.langs == ("xx",) and langid.identify(docs.where("doc_id = 1"), only, False).first()["lang_pred"] == "xx"


def buckets_by_hand(text):
    runs = re.split("\0+", "".join(c if c.isalpha() else "\0" for c in text.lower()))
    out, m = Counter(), 0xFFFFFFFF
    for w in filter(None, runs):
        p = [0, *map(ord, w), 0]
        for n in langid.ORDERS:
            for k in range(len(p) - n + 1):
                h = p[k] * 0x9E3779B1 & m
                for x in p[k + 1 : k + n]:
                    h = x * 0x9E3779B1 + ((h ^ h >> 15) * 0x01000193) & m
                out[((h ^ n * 0x51ED27) * 0x85EBCA6B & m) >> 32 - langid.BITS] += 1
    return out


def test_language_features_by_hand(monkeypatch):
    texts = ["Ab, c-d  é\n", None, "", "12", "zz" * 40, "one two three " * 30, "İx \U0001f600 y"]
    columns = np.random.default_rng(1).uniform(-1, 1, (3, (1 << langid.BITS) + 1))
    columns[:, -1] = 0
    for piece in (1 << 20, 50, 7):
        monkeypatch.setattr(langid, "PIECE", piece)
        sums, n = langid._sums(texts, columns)
        for i, t in enumerate(texts):
            want = buckets_by_hand(t or "")
            assert n[i] == sum(want.values()) and np.allclose(sums[:, i], sum((c * columns[:, b] for b, c in want.items()), np.zeros(3)))
            bucket, count = langid._counts(t or "")
            assert dict(zip(bucket.tolist(), count.tolist())) == want


def test_rejection_is_calibrated():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 4000)
    z = rng.normal(0, 1, (4000, 3)) * 4
    z[np.arange(4000), y] += 4
    t, least = langid._calibrated(z, y)
    p = langid._softmax(z / t)
    sure = p.max(axis=1) >= least
    assert 0 < least < 1 and np.mean(p.argmax(axis=1)[sure] != y[sure]) <= langid.ERRORS and abs(p.max(axis=1).mean() - np.mean(p.argmax(axis=1) == y)) < 0.05


def test_language_on_given_documents(spark):
    d = read_table(spark, SF, "documents")
    got = langid.identify(d, langid.train(d), False).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count()


def test_cells_and_strays_of_rows():
    say = html.render
    assert say("<table><tr><form><td>Name</td><td>Age</td></form></tr></table>") == "Name  Age" and say("<table><tr><center><td>a<td>b</center></table>") == "a  b"
    assert say("<table><tr>stray<td>a</table>") == "stray\na" and say("<table><tr><a>link</a><td>a</table>") == "link\na" and say("<table><tr><input value=v><td>a</table>") == "v\na"
    assert say("<table><tr><table><tr><td>in</table><td>a</table>") == "in\n\na" and say("<table><form><tr><td>a<td>b</tr></form><tr><td>c<td>d</table>") == "a  b\nc  d"
    assert say('<span style="display:block">a</span><span style="display:block">b</span>') == "a\nb" and say('<div>a</div><div style="display:inline">b</div>c') == "a\nbc"
    assert say('<div style="display:flex"><span>a</span><span>b</span></div>') == "a\nb" and say('<span style="display:table-cell">a</span><span style="display:table-cell">b</span>') == "a b"
    assert say("<details><summary>s</summary>hidden</details>x") == "s\nx" and say("<details open><summary>s</summary>body</details>") == "s\nbody"
    assert say("<ul><div><li>a<li>b</div></ul>") == "- a\n- b" and say("<ol><li value=5>a<li>b</ol><ol reversed><li>x<li>y</ol>") == "5. a\n6. b\n\n2. x\n1. y"


TAGS = "div p span b ul ol li table tr td form center a section details dl dd blockquote h2 tbody".split()


@settings(max_examples=300, deadline=None)
@given(st.recursive(st.sampled_from(["text", "br"]), lambda kids: st.tuples(st.sampled_from(TAGS), st.sampled_from(["", "", " hidden", " style='display:none'", " style='display:block'", " open"]), st.lists(kids, max_size=4)), max_leaves=25))
def test_no_visible_text_is_lost(tree):
    n, shown = 0, []

    def write(x, seen):
        nonlocal n
        if x == "br":
            return "<br>"
        if x == "text":
            n += 1
            shown.extend([f"w{n}x"] if seen else [])
            return f" w{n}x "
        tag, attrs, kids = x
        # closed details show their summary alone
        seen = seen and not ("hidden" in attrs or "none" in attrs) and (tag != "details" or "open" in attrs)
        return f"<{tag}{attrs}>" + "".join(write(k, seen) for k in kids) + f"</{tag}>"

    page = write(tree, True)
    # tags that end one another would move text out of what hides it: such trees are left to the fixed cases
    implied = re.search(r"hidden|none|<details>", page)
    got = re.findall(r"w\d+x", html.render(page))
    if implied:
        assert len(got) == len(set(got))
    else:
        assert sorted(got) == sorted(shown)


def test_archives_keep_every_payload(spark):
    a, b, c = ("<p>" + x * 200 for x in "abc")
    rows = [(1, "u", a), (5, "u", a), (5, "u", b), (6, "u", a), (6, "u", c), (7, "u", c), (None, "u", a), (None, "u", a), (1, "u", a), (8, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({k: F.lit(1) for k in ("k", "digest", "bytes", "refers_to")})
    folder = shared_path(spark, "warc")
    got = warc.read(warc.write(pages, folder), folder, payloads=True).collect()
    found = Counter((r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(1, a, None), (1, a, None), (5, a, 1), (5, b, None), (6, a, 1), (6, c, None), (7, c, 6), (None, a, None), (None, a, None), (8, None, None)]
    assert found == Counter((i, sha(t), "revisit" if f else "response", f) for i, t, f in want)
    assert {bytes(r["payload"]).decode() for r in got if r["payload"] is not None} == {a, b, c, ""} and all(r["payload_bytes"] == (203 if r["page_id"] != 8 else 0) for r in got)


def test_few_labels_are_enough(spark):
    rows = [(i, f"nasty words {words('xx', i, 8)}" if i % 2 else f"kind words {words('xx', i, 8)}") for i in range(18)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i in range(18)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert len(model.buckets) and min(v for i, v in got.items() if i % 2) > 0.5 > max(v for i, v in got.items() if not i % 2)


def test_classifier_is_the_fit_by_brute_force(spark):
    """A dense refit of the same loss, by plain gradient descent on all scaled columns."""
    r = random.Random(8)
    rows = [(i, f"{words('xx', i, 12)} {r.choice(['vile rot', 'fine day']) if r.random() < 0.2 else 'vile rot' if i % 3 == 0 else 'fine day'}", int(i % 3 == 0)) for i in range(240)]
    docs, labels = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    learns = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 5]
    has = [set() for _ in learns]
    for at, bucket in toxicity._present([x[1] for x in learns]):
        for i, b in zip(at.tolist(), bucket.tolist()):
            has[i].add(b)
    y = np.array([x[2] for x in learns])
    x = np.array([[b in h for b in model.buckets.tolist()] for h in has], float)
    p, q = (x[y == 1].sum(axis=0) + 1) / (y.sum() + 2), (x[y == 0].sum(axis=0) + 1) / ((1 - y).sum() + 2)
    ratio = np.log(p / q)
    x *= ratio

    def loss(w, bias):
        return np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ w + bias)).sum() + toxicity.L2 / 2 * w @ w

    w, bias = np.zeros(x.shape[1]), 0.0
    step = 1 / (np.linalg.norm(np.column_stack([x, np.ones(len(y))]), 2) ** 2 / 4 + toxicity.L2)
    for _ in range(20_000):
        off = 1 / (1 + np.exp(-(x @ w + bias))) - y
        w, bias = w - step * (x.T @ off + toxicity.L2 * w), bias - step * off.sum()
    got = toxicity._rated([t for _, t, _ in learns], model.table(), model.bias)
    assert np.allclose(got, x @ (model.coef / ratio) + model.bias)
    assert loss(model.coef / ratio, model.bias) <= 1.01 * loss(w, bias) and np.mean((got > 0) == (x @ w + bias > 0)) > 0.97
