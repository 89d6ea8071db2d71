import random

from pyspark.sql import functions as F

from leafsight.operators import chunking
from leafsight.operators.runs import runs


def folded(rows, limit, hard):
    """The runs of (doc, at, n, opens), row by row."""
    out, doc, run, length = [], None, None, 0
    for d, at, n, opens in rows:
        if d == doc and not opens and length < limit and length + 2 + n <= hard:
            length += 2 + n
        else:
            doc, run, length = d, at, n
        out.append((at, run))
    return out


def test_runs_over_blocks_are_those_of_a_fold(spark):
    rnd = random.Random(5)
    for limit, hard, block, doc_every, open_every, most in ((30, 50, 3, 40, 9, 20), (30, 50, 1, 4000, 4000, 8), (12, 90, 7, 300, 10**6, 95), (40, 40, 5, 300, 60, 3)):
        rows = [(f"d{i // doc_every}", (i // 100 << 33) + i % 100, rnd.randint(1, most), rnd.randint(1, open_every) == 1) for i in range(900)]
        df = spark.createDataFrame(rows, "doc string, at long, n int, opens boolean")
        assert sorted(map(tuple, runs(df, limit, hard, block).select("at", "run").collect())) == folded(rows, limit, hard)


def test_section_chunks_are_those_of_a_fold(spark):
    rnd = random.Random(6)
    word = lambda: rnd.choice("abcdefghij") * rnd.randint(1, 9)
    docs = {None: 3, 0: 0, 1: 1, 2: 400, 3: 150, 4: 40}
    rows = []
    for d, n in docs.items():
        for i in range(n):
            category = rnd.choices(["Title", "NarrativeText", "Table"], [0 if d == 2 else 1, 8, 1])[0]
            text = None if rnd.random() < 0.03 else " ".join(word() for _ in range(rnd.choice([0, 1, 5, 5, 40]))) + rnd.choice(["", " ", "x" * 130])
            rows.append((d, i * 3, rnd.choice([None, i // 10]), category, text))
    df = spark.createDataFrame(rows, "doc_id long, idx int, page int, category string, text string")
    want = []
    for d in docs:
        mine = [(p, c, t) for doc, _, p, c, t in rows if doc == d and c != "Table"]
        seed = next(((t or "").strip() for _, c, t in mine if c == "Title"), "")
        before = None
        for i, (page, title, text) in enumerate(chunking.section_texts(mine, 40, 80, 120, seed)):
            full = text if before is None else before[-25:] + " " + text
            want.append((d, i, page, title, full, len(full)))
            before = text
    key = lambda r: (str(r[0]), r[1])
    # in groups, all by blocks, some by blocks
    for spread, whole, block in ((1, 10**6, 1), (3, 0, 7), (2, 3000, 100_000)):
        got = chunking.section_chunks(df.repartition(spread), 40, 80, 120, 25, whole, block)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert chunking.section_chunks(df.where("false")).count() == 0


def test_overlaps_are_cut_where_nothing_carries(spark):
    rnd = random.Random(7)
    rows = []
    for d in range(12):
        for i in range(60):
            kind = rnd.choices(["text", "image", "table"], [1, 6, 3])[0]
            text = "".join(rnd.choice("ab \n") for _ in range(rnd.choice([0, 1, 3, 8, 9, 10, 11, 30])))
            rows.append((d, i, kind, rnd.choice([1, 2]) if kind == "table" else None, text))
    df = spark.createDataFrame(rows, "doc_id long, chunk_seq int, chunk_type string, table_part int, text string")
    want, before, doc = [], None, None
    for d, i, kind, part, text in rows:
        before = before if d == doc else None
        tail = (before or "")[-10:].strip()
        borrows = before is not None and kind != "text" and not (kind == "table" and part > 1) and tail
        before, doc = f"{tail}\n\n{text}" if borrows else text, d
        want.append((d, i, before, text if borrows else None, len(tail) if borrows else 0))
    for block in (1, 7, 4096):
        got = chunking.cross_chunk_overlap(df.orderBy(F.rand(1)), 10, block)
        assert sorted(map(tuple, got.select("doc_id", "chunk_seq", "text", "core_text", "overlap_prefix_chars").collect())) == want
