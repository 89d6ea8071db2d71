import json
import os
import random

from leafsight.operators import chunking
from leafsight.sources import layout, store


def records(n, seed=1):
    rnd = random.Random(seed)
    odd = ['{"a": [1}', "} ] , {", 'q " q', "back\\", '\\"', "[[[", "", "ünï\n{"]
    return [{"chunk_id": str(i), "chunk_type": "text", "text": "".join(rnd.choices(odd, k=rnd.randint(0, 6))), "metadata": {"title": rnd.choice(odd), "ocr_keywords": ["}", "b"][: i % 3]}} for i in range(n)]


def test_arrays_are_split_among_tasks(spark, tmp_path):
    kinds = {"a": {"indent": 2}, "b": {"separators": (",", ":")}, "c": {"ensure_ascii": False}, "d e": {"indent": "\t"}}
    want = []
    for i, (name, how) in enumerate(kinds.items()):
        rows = records(60, i)
        want += [(r["chunk_id"], r["text"], r["metadata"]["title"], r["metadata"]["ocr_keywords"]) for r in rows]
        (tmp_path / f"{name}.json").write_text(" \n"[: i] + json.dumps(rows, **how) + "\n", encoding="utf8")
    lines = records(60, 9)
    want += [(r["chunk_id"], r["text"], r["metadata"]["title"], r["metadata"]["ocr_keywords"]) for r in lines]
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, lines)))
    (tmp_path / "none.json").write_text("[]")
    (tmp_path / "empty.json").write_text("")
    for size in ("300", "100000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            got = store.read_chunks(spark, str(tmp_path)).select("chunk_id", "text", "metadata.title", "metadata.ocr_keywords")
            assert sorted(map(tuple, got.collect())) == sorted(want)
            big = spark.read.text(str(tmp_path / "a.json"), lineSep="}")
            assert (big.rdd.getNumPartitions() > 8) == (size == "300")
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def parse(content, upper="no"):
    lines = content.decode().split("\n")
    if lines[0] == "bad":
        raise ValueError("not a file of ours")
    elements = [{"page": i + 1, "category": "Title" if i == 0 else "NarrativeText", "text": t.upper() if upper == "yes" else t} for i, t in enumerate(lines)]
    return elements, [{"page": 2, "rows": [["a", "b"], ["1", t]]} for t in lines[1:]]


def test_layout_source_reads_batches(spark, tmp_path):
    layout.register_layout(spark, parse)
    for i in range(6):
        (tmp_path / f"{i}.pdf").write_text(f"Title {i}\nbody {i}\nmore")
    (tmp_path / "x.pdf").write_text("bad")
    (tmp_path / "y.txt").write_text("other")
    rows = spark.read.format("layout").option("taskBytes", "50").option("upper", "yes").load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == 3
    elements, tables = layout.elements_of(rows), layout.tables_of(rows)
    assert elements.count() == 18 and tables.count() == 12 and {r["text"] for r in elements.where("idx = 0").collect()} == {f"TITLE {i}" for i in range(6)}
    errors = rows.where("record = 'error'").collect()
    assert [(os.path.basename(r["path"]), r["parse_error"]) for r in errors] == [("x.pdf", "ValueError: not a file of ours")]
    chunks = chunking.chunk_documents(elements, tables, strip_repeating=False)
    assert chunks.select("doc_id").distinct().count() == 6
    assert spark.read.format("layout").load(str(tmp_path / "nowhere")).count() == 0


def test_layout_source_streams_each_file_once(spark, tmp_path):
    layout.register_layout(spark, parse)
    folder = tmp_path / "in"
    folder.mkdir()

    def run():
        rows = spark.readStream.format("layout").option("log", str(tmp_path / "log")).load(str(folder))
        q = layout.elements_of(rows).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
        q.processAllAvailable()
        q.stop()
        return sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "out")).where("idx = 0").collect())

    (folder / "a.pdf").write_text("A\nx")
    assert run() == ["A"]
    (folder / "b.pdf").write_text("B\nx")
    os.utime(folder / "b.pdf", (1, 1))
    assert run() == ["A", "B"]
    assert run() == ["A", "B"]
    (folder / "a.pdf").write_text("A again\nx")
    assert run() == ["A", "A again", "B"]
