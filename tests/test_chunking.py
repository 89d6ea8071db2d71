import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from leafsight.functions import text as T
from leafsight.functions import vectors
from leafsight.operators import chunking, elements, search
from leafsight.sources import store

HEAD = "| a | b |\n| --- | --- |"
BIG = HEAD + "\n" + "\n".join(f"| {i} | {'x' * 120} |" for i in range(200))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_markdown_escapes_and_pads(spark):
    rows = F.array(F.array(F.lit("a|b"), F.lit("c")), F.array(F.lit(" d  e ")), F.array(F.lit(None).cast("string"), F.lit("")))
    assert one(spark, T.rows_to_markdown(rows)) == "| a\\|b | c |\n| --- | --- |\n| d e |  |"
    assert one(spark, T.rows_to_markdown(F.array().cast("array<array<string>>"))) == ""


def test_html_rows():
    got = chunking.html_rows("<p>no</p><table><tr><th>A</th><th>B</th></tr><tr></tr><tr><td>1<td>2</tr></table><table><tr><td>z</table>")
    assert got == [["A", "B"], ["1", "2"]]


def test_parts_repeat_header_and_share_rows():
    parts = chunking.split_markdown_table(BIG, "Table 1")
    assert len(parts) > 1 and all(len(p) <= 5000 + len(" (part 99/99)") for p in parts)
    assert all(f"(part {i}/{len(parts)})" in p and HEAD in p for i, p in enumerate(parts, 1))
    for a, b in zip(parts, parts[1:]):
        rows = b.split("\n")[4:]
        shared = [r for r in rows if r in a.split("\n")]
        assert shared and sum(len(r) + 1 for r in shared) <= 500


def by_rows(markdown, caption, hard, overlap):
    """Parts taken row by row, for comparison."""
    head, rows = "\n".join(markdown.split("\n")[:2]) + "\n", markdown.split("\n")[2:]
    lead = (caption + "\n\n" if caption else "") + head
    if len(lead) + len("\n".join(rows)) <= hard:
        return [rows]
    out, now, new = [], [], 0
    for r in rows:
        if new and len(lead) + len("\n".join([*now, r])) > hard:
            out.append(now)
            k = len(now) - 1
            while k > 0 and sum(len(x) + 1 for x in now[k - 1 :]) <= overlap:
                k -= 1
            now, new = now[k:], 0
        now, new = [*now, r], new + 1
    return [*out, now] if new else out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 120), max_size=40), st.integers(20, 300), st.integers(0, 200), st.sampled_from(["", "T", " Table 1 "]))
def test_parts_are_those_taken_row_by_row(lengths, hard, overlap, caption):
    markdown = "\n".join(["| h |", "| --- |", *("x" * n for n in lengths)])
    got = chunking.split_markdown_table(markdown, caption, hard, overlap)
    want = by_rows(markdown, caption.strip(), hard, overlap)
    assert [p.split("\n")[4 if caption else 2 :] for p in got] == (want if lengths else [[""]] if hard >= len(markdown) + 1 + (len(caption.strip()) + 2 if caption else 0) else [p.split("\n")[4 if caption else 2 :] for p in got])


def test_a_table_at_the_limit_is_one_part():
    rows = HEAD + "\n" + "x" * (5000 - len(HEAD) - 1)
    assert chunking.split_markdown_table(rows) == [rows] and chunking.split_markdown_table("one line", " T ") == ["T\n\none line"]


def test_documents_are_chunked_whole(spark):
    rows, n = [], 0

    def add(doc, page, category, text, html=None, image=None):
        nonlocal n
        rows.append((doc, n, page, category, text, html, image, None))
        n += 1

    names = ["", "Intro", "Power", "Timing", "Package", "Orders"]
    for doc in ("a", "b"):
        for page in range(1, 6):
            add(doc, page, "Header", f"Page {page} of the manual")
            add(doc, page, "Title", names[page])
            add(doc, page, "NarrativeText", f"word{page} " * 200)
            add(doc, page, "NarrativeText", f"Table of {names[page]}")
            add(doc, page, "Table", "raw cells", "<table><tr><td>A<td>B</tr><tr><td>1<td>2</tr></table>" if page != 2 else None)
            add(doc, page, "Image", None, None, "QUJD" if page != 3 else "not base64!")
            add(doc, page, "FigureCaption", f"Figure of {names[page]}. Shape")
    spark_rows = spark.createDataFrame(rows, "doc_id string, idx int, page int, category string, text string, text_as_html string, image_base64 string, image_mime_type string")
    layer = [("a", 1, 0, [["Page 1 of the", "manual"], ["page 9 of the manual"]]), ("a", 1, 1, [["X", "Y"], ["3", None]]), ("a", 2, 0, [["only one row"]])]
    tables = spark.createDataFrame(layer, "doc_id string, page int, n int, rows array<array<string>>")
    got = chunking.chunk_documents(spark_rows, tables, captioner=F.lit("A drawing. It has lines."), ocr=F.lit("Vcc pin the")).orderBy("doc_id", "chunk_seq").collect()
    by = {k: [r for r in got if r["doc_id"] == "a" and r["chunk_type"] == k] for k in ("text", "table", "image")}
    assert [r["chunk_seq"] for r in got if r["doc_id"] == "a"] == list(range(sum(map(len, by.values())))) and len({r["chunk_id"] for r in got}) == len(got)
    assert not any("of the manual" in r["text"] for r in by["text"]) and by["text"][0]["title"] == "Intro"
    first, second = by["table"][:2]
    assert first["table_source"] == "text_layer" and (first["core_text"] or first["text"]).endswith("| X | Y |\n| --- | --- |\n| 3 |  |") and first["table_caption"] == "Table of Intro"
    assert second["table_source"] == "ocr_html" and (second["core_text"] or second["text"]).endswith("raw cells")
    assert len(by["image"]) == 4 and by["image"][0]["core_text"] == "Figure of Intro. Shape\n\nKeywords: vcc, pin\n\nA drawing." and by["image"][0]["ocr_keywords"] == ["vcc", "pin"]
    for a, b in zip(got, got[1:]):
        if b["core_text"]:
            tail = a["text"][-500:].strip()
            assert b["text"] == f"{tail}\n\n{b['core_text']}" and b["overlap_prefix_chars"] == len(tail)
    checked = {r["rule"]: r for r in chunking.verify_chunks(chunking.chunk_documents(spark_rows, tables)).collect()}
    assert all(r["broken"] == 0 for k, r in checked.items() if k != "text_not_short") and checked["core_text"]["checked"] > 0
    assert chunking.chunk_documents(spark_rows, skip_images=True, strip_repeating=False, tables_from="html").where("chunk_type = 'image' or table_source = 'text_layer'").count() == 0


def test_small_table_stays_whole():
    assert chunking.split_markdown_table(HEAD + "\n| 1 | 2 |", "Table 1") == ["Table 1\n\n" + HEAD + "\n| 1 | 2 |"]
    assert chunking.split_markdown_table("", "x") == []
    assert chunking.split_markdown_table(BIG)[0].startswith("| a | b |")


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("abc|", max_size=300), min_size=1, max_size=60), st.integers(100, 900), st.integers(0, 300))
def test_every_row_is_in_some_part(cells, hard, overlap):
    rows = [f"| {c} |" for c in cells]
    parts = chunking.split_markdown_table("\n".join(["| h |", "| --- |", *rows]), "", hard, overlap)
    seen = []
    for p in parts:
        for r in p.split("\n")[2:]:
            seen.append(r)
    assert set(rows) == set(seen)


def test_keys_keywords_sentences(spark):
    assert one(spark, T.boilerplate_key(F.lit(" Page 12  of 40"))) == one(spark, T.boilerplate_key(F.lit("page 3 of 40 ")))
    assert one(spark, T.keywords(F.lit("The VBUS pin, -vbus- and a 3.3V rail: x1 of")), ) == ["vbus", "pin", "rail"]
    assert one(spark, T.first_sentence(F.lit("One two. Three."))) == "One two."
    assert one(spark, T.first_sentence(F.lit(""))) == ""
    assert len(one(spark, T.first_sentence(F.lit("a" * 300)))) == 201


def fold(rows, n):
    out, before = [], None
    for kind, part, text in rows:
        tail = (before or "")[-n:].strip()
        now = text if before is None or kind == "text" or (kind == "table" and part > 1) or not tail else f"{tail}\n\n{text}"
        out.append(now)
        before = now
    return out


def test_overlap_is_a_fold(spark):
    rows = [("text", None, "t" * 30), ("image", None, "img"), ("image", None, "i2"), ("table", 1, "p1"), ("table", 2, "p2"), ("text", None, " "), ("image", None, "z")]
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "doc_id long, chunk_seq int, chunk_type string, table_part int, text string")
    got = [r["text"] for r in chunking.cross_chunk_overlap(df, 6).orderBy("chunk_seq").collect()]
    assert got == fold(rows, 6)


def test_sections(spark):
    rows = [(1, "Title", "Intro"), (1, "NarrativeText", "a" * 1200), (2, "Title", "Next"), (2, "NarrativeText", ("w" * 9 + " ") * 900)]
    got = chunking.section_texts(rows)
    assert [t for _, t, _ in got][:2] == ["Intro", "Next"] and all(len(x) <= 5000 for _, _, x in got)
    assert got[0][0] == 1 and got[-1][1] == "Next"
    assert isinstance(chunking.section_texts([]), list) and pd is not None


TITLES = ["", "Intro", "Power", "Timing", "Package"]
PAGES = [
    (d, 10 * p + k, p, category, text, image)
    for d in ("a", "b")
    for p in range(1, 5)
    for k, (category, text, image) in enumerate([("Title", TITLES[p], None), ("NarrativeText", f"volt{p} rail " * 120, None), ("Image", None, ("QUJD", "REVG")[p % 2]), ("Image", None, "no base64!" if p == 2 else "QUJD")])
]
ELEMENTS = "doc_id string, idx int, page int, category string, text string, image_base64 string"


def test_models_are_asked_once_for_a_payload(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def model(answer):
        def ask(payload):
            @F.pandas_udf("string")
            def said(x: pd.Series) -> pd.Series:
                calls.add(len(x))
                return x.map(lambda v: None if answer is None else f"{answer} {v}")

            return said(payload)

        return ask

    e = spark.createDataFrame(PAGES, ELEMENTS)
    run = lambda caption="shows.", **kw: chunking.chunk_documents(e, captioner=model(caption), ocr=model("reads"), **kw).where("chunk_type = 'image'").orderBy("doc_id", "chunk_seq").collect()
    first = run(cache=str(tmp_path / "c"))
    assert calls.value == 4 and len(first) == 14 and {r["caption"] for r in first} == {"shows. QUJD", "shows. REVG"} and all(r["ocr_keywords"][0] == "reads" for r in first)
    assert run(cache=str(tmp_path / "c")) == first and calls.value == 4
    # another version asks anew; a model that fails is asked again the next time; without a cache each run asks, once
    assert run(cache=str(tmp_path / "c"), version="2") == first and calls.value == 8
    assert {r["caption"] for r in run(None, cache=str(tmp_path / "d"))} == {""} and calls.value == 12
    assert run(cache=str(tmp_path / "d")) == first and calls.value == 14
    assert run() == first and calls.value == 18
    assert run(None) != first and calls.value == 22


def test_expressions_are_evaluated_once_an_image(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def said(x: pd.Series) -> pd.Series:
        calls.add(len(x))
        return x.map(lambda v: f"says {v}")

    got = chunking.chunk_documents(spark.createDataFrame(PAGES, ELEMENTS), captioner=said(F.col("image_base64")))
    assert got.where("caption like 'says%'").count() == 14 == calls.value


def test_from_elements_to_a_search(spark, tmp_path):
    e = spark.createDataFrame(PAGES, ELEMENTS)
    records = store.written(chunking.chunk_records(chunking.chunk_documents(e, captioner=F.lit("A plot."), ocr=F.lit("Vcc"))), "records")
    encode = lambda c: vectors.hashed_encoder(T.tokenize(c))
    store.write_chunks(records, str(tmp_path / "chunks"))
    back = store.read_chunks(spark, str(tmp_path / "chunks"))
    assert sorted(back.collect()) == sorted(records.select(*back.columns).collect()) and records.where("metadata.overlap_prefix_chars = 0").count() == 0
    assert records.where("metadata.page_number is null or metadata.title = '' or metadata.char_count <> length(text)").count() == 0
    store.write_index(store.index_rows(records, encode), str(tmp_path / "index"))
    index = store.scan_index(spark, str(tmp_path / "index")).withColumn("collection", F.col("doc_id").cast("string"))
    q = spark.createDataFrame([(1, "a", "volt3"), (2, "b", "volt1 rail")], "query_id long, collection string, text string").withColumn("qvec", encode(F.col("text")))
    top = {r["query_id"]: r for r in search.search(index, q, 1).collect()}
    assert (top[1]["collection"], top[1]["page"], top[1]["title"]) == ("a", 3, "Timing") and (top[2]["collection"], top[2]["page"]) == ("b", 1)
    assert {r["page"] for r in search.search(index, q, 9, types=["image"]).collect()} == {1, 2, 3, 4}
    registry = str(tmp_path / "registry")
    assert store.index_document(spark, registry, "a", str(tmp_path / "other"), lambda: records.where("doc_id = 'a'").drop("doc_id"), encode) == "ready"


def moved(spark, run):
    """Bytes of shuffles that `run` wrote."""
    sums = lambda: sum(x.shuffleWriteBytes() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)))
    before = sums()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sums() - before


def hex_elements(spark, lines=200):
    """Documents of lines that don't compress well: a title a page, now and then a table, an image or a caption, and a running line."""
    e = spark.range(8 * lines).select((F.col("id") % 8).alias("doc_id"), F.expr("id div 8").alias("idx"), F.expr("cast(id div 80 as int)").alias("page"))
    kind = F.expr("case idx % 10 when 0 then 'Title' when 4 then 'Table' when 7 then 'Image' when 8 then 'FigureCaption' when 9 then 'Footer' else 'NarrativeText' end")
    long = F.concat_ws(" ", *[F.sha2(F.concat_ws("-", "doc_id", "idx", F.lit(i)), 512) for i in range(6)])
    text = F.expr("case idx % 10 when 0 then concat('Part ', page) when 8 then concat(' Figure ', idx) when 9 then concat('Page ', page, ' of it') end")
    return e.withColumn("category", kind).withColumn("text", F.coalesce(text, long))


def test_texts_move_twice_on_their_way_to_chunks(spark):
    e = store.written(hex_elements(spark), "hex")
    size = e.agg(F.sum(F.length("text"))).first()[0]
    run = lambda: chunking.chunk_documents(e, captioner=F.lit("Drawn."), ocr=F.col("text")).write.format("noop").mode("overwrite").save()
    assert moved(spark, run) < 3.5 * size


def test_repeating_keys_are_those_detected(spark):
    rows = [(d, p, c, t) for d in (1, 2, None) for p in (*range(1, 6), None) for c, t in [("Header", f"Page {p} of 9"), ("Header", f" page  {p} OF 8"), ("Table", "same"), (None, "nil"), ("NarrativeText", f"own {'x' * (p or 9)}"), ("Footer", "w" * 160), ("Footer", "w" * 161), ("Footer", "9" * 400 + "w" * 159), ("Footer", None), ("Footer", "é" * 200)]]
    df = spark.createDataFrame([(d, i, p, c, t) for i, (d, p, c, t) in enumerate(rows) if d != 2 or p in (1, 2, None)], "doc_id long, idx long, page int, category string, text string")
    found = elements.repeating_keys(df)
    got = sorted((r["doc_id"], k) for r in found.collect() for k in r["keys"])
    assert got == sorted((r["doc_id"], r["key"]) for r in elements.detect_boilerplate(df).collect()) == [(1, "#" + "w" * 159), (1, "page # of #"), (1, "w" * 160)]
    left = lambda x: sorted(x.select("idx").collect())
    assert left(elements.without_keys(df, found)) == left(elements.strip_boilerplate(df, elements.detect_boilerplate(df)))


def test_captions_need_no_other_texts(spark):
    texts = [("Table", "t"), (None, "\u00a0\x1c Table 1"), ("NarrativeText", "see table"), ("FigureCaption", "c" * 301), ("FigureCaption", " " + "c" * 300 + " "), ("Image", None), ("NarrativeText", " FIG 2"), ("Title", " T "), ("Image", "i"), ("NarrativeText", "exhibit " + "e" * 393), ("Table", "Fig. in a table"), ("FigureCaption", None), ("Image", "x")]
    df = spark.createDataFrame([(1, i, 1, c, t) for i, (c, t) in enumerate(texts)], "doc_id long, idx long, page int, category string, text string")
    for kind, of in (("Table", elements.table_captions), ("Image", elements.figure_captions)):
        few = elements.only_for(df, kind)
        assert sorted(of(elements.running_titles(few)).collect()) == sorted(of(elements.running_titles(df)).collect()) and few.where("text = 'see table'").count() == 0


def test_a_fold_over_batches_is_cross_chunk_overlap(spark):
    kinds = [("text", None), ("image", None), ("image", None), ("table", 1), ("table", 2), ("image", None)]
    rows = [(d, i, *kinds[i * i % 6], ("ab " * (i % 5) + "\u00e9" * (i % 3 + 1))[: i % 9 + 1], f"of {i}") for d in ("a", "b", None) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id string, build_seq int, chunk_type string, table_part int, text string, other string").withColumn("page", F.expr("build_seq div 7"))
    ordered = chunking.reading_order(df)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = chunking.overlapped(ordered, 6)
        fields = ["doc_id", "chunk_seq", "chunk_type", "text", "core_text", "overlap_prefix_chars", "char_count"]
        key = lambda r: (r["doc_id"] or "", r["chunk_seq"])
        want = sorted(chunking.cross_chunk_overlap(ordered, 6).select(fields).collect(), key=key)
        assert sorted(got.select(fields).collect(), key=key) == want
        # a filter on the result is no filter on what is folded
        assert sorted(got.where("chunk_type = 'image'").select(fields).collect(), key=key) == [r for r in want if r["chunk_type"] == "image"]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_chunks_are_verified_where_their_texts_are(spark):
    text = F.concat_ws(" ", *[F.sha2(F.concat_ws("-", "id", F.lit(i)), 512) for i in range(20)])
    x = spark.range(400).select((F.col("id") % 4).alias("doc_id"), F.expr("cast(id div 4 as int)").alias("chunk_seq"), text.alias("own"), F.lit(1).alias("page"), F.lit("T").alias("title"))
    tail = F.right(F.lag("own").over(Window.partitionBy("doc_id").orderBy("chunk_seq")), F.lit(500))
    lapped = (F.col("chunk_seq") % 2 == 1)
    tail = F.when(F.col("chunk_seq") == 7, F.concat(F.lit("!"), F.substr(tail, F.lit(2)))).otherwise(tail)
    x = x.withColumn("text", F.when(lapped, F.concat(tail, F.lit("\n\n"), "own")).otherwise(F.col("own"))).withColumn("core_text", F.when(lapped, F.col("own"))).withColumn("overlap_prefix_chars", F.when(lapped, 500).otherwise(0))
    chunks = store.written(x.withColumn("chunk_type", F.when(lapped, "image").otherwise("text")).drop("own"), "verified")
    got = {}
    size = chunks.agg(F.sum(F.length("text"))).first()[0]
    assert moved(spark, lambda: got.update({r["rule"]: (r["checked"], r["broken"]) for r in chunking.verify_chunks(chunks).collect()})) < size / 10
    assert list(got.items()) == [("size", (400, 0)), ("text_not_short", (200, 0)), ("prefix_is_tail", (200, 4)), ("core_text", (200, 0)), ("table_is_rectangular", (0, 0)), ("has_page", (400, 0)), ("has_title", (400, 0))]
