"""The pipeline's stages, each against a brute-force version over its own input."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = "red blue green stone river cloud iron glass paper light night wind salt road leaf moon".split()


def prose(seed, n=60):
    r = random.Random(seed)
    return [r.choice(VOCAB) + str(r.randrange(40)) for _ in range(n)]


ITEMS = {1: prose(7001, 24), 2: prose(7002, 40), 3: ["too", "short"]}


def corpus():
    rows, toxic = [], set()

    def add(words, source):
        rows.append((len(rows), words if words is None else " ".join(words), "en", source, 0))
        return rows[-1][0]

    r = random.Random(11)
    for i in range(320):
        words = prose(i)
        source = ("a", "b", "b", "c", None)[i % 5]
        if i % 4 == 0:
            for k in r.sample(range(60), 6):
                words[k] = "vequ" + r.choice(["an", "ot", "il"])
            toxic.add(add(words, source))
        else:
            add(words, source)
    for i in (1, 2, 3, 5, 6, 7, 9):
        words = prose(i)
        add(words, "a")
        for spots in ((30,), (10, 50), (2, 30, 57)):
            near = list(words)
            for k in spots:
                near[k] = "changed"
            add(near, "b")
    for n in (5, 12, 13, 24):
        add(prose(900 + n, 30) + ITEMS[1][:n] + prose(950 + n, 30), "c")
    substituted = list(ITEMS[2])
    substituted[12] = substituted[29] = "other"
    add(prose(990, 30) + substituted, "a")
    for text in (None, [], ["one"], prose(991, 6000)):
        add(text, None)
    return rows, toxic


def linked(texts):
    """Smallest id of each document's group, from all pairs."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def leaked(text):
    """Whether some stretch of an alignment with an item has enough equal tokens, 8 in 10 of them."""
    t = (text or "").lower().split()
    for item in ITEMS.values():
        if len(item) < 9:
            continue
        need = min(13, 0.8 * len(item))
        for shift in range(-len(item) + 1, len(t)):
            same = [t[k + shift] == item[k] for k in range(max(0, -shift), min(len(item), len(t) - shift))]
            for a in range(len(same)) if sum(same) >= need else ():
                hits = 0
                for n, x in enumerate(same[a:], 1):
                    hits += x
                    if hits >= need and hits >= 0.8 * n:
                        return True
    return False


def targets(sizes):
    """Target of each source by resharing what is above the caps until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped, total = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        left, w = total - sum(capped.values()), sum(weight[s] for s in free)
        now = {s: left * weight[s] / w for s in free}
        over = [s for s in free if now[s] > 2 * sizes[s]]
        if not over:
            return capped | now
        capped |= {s: 2 * sizes[s] for s in over}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("pipeline"))
    rows, toxic = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    labels = [(r[0], 1, int(r[0] in toxic)) for r in rows[:320] if r[0] % 10 < 8]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    items = [*((k, " ".join(v)) for k, v in ITEMS.items()), (4, None), (5, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_each_stage_against_brute_force(spark, folder):
    rows, toxic = corpus()
    text, source = {r[0]: r[1] for r in rows}, {r[0]: r[3] for r in rows}
    frames, docs = {}, spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        at = f"{folder}/stage-{name}"
        stage(spark, docs, folder).write.parquet(at)
        docs = spark.read.parquet(at)
        assert docs.columns[: len(columns)] == columns and (name == "sharding" or docs.columns == columns)
        frames[name] = docs.collect()

    ids = {name: sorted(r["doc_id"] for r in found) for name, found in frames.items()}
    assert all(r["text"] == text[r["doc_id"]] and r["source"] == source[r["doc_id"]] for found in frames.values() for r in found)
    clean = sorted(set(text) - toxic)
    assert ids["toxicity"] == clean
    group = linked({i: text[i] for i in clean})
    assert ids["near_dedup"] == [i for i in clean if group[i] == i] != clean
    assert ids["decontamination"] == [i for i in ids["near_dedup"] if not leaked(text[i])] != ids["near_dedup"]

    size = {i: len((text[i] or "").split()) for i in ids["decontamination"]}
    by_source = Counter()
    for i, n in size.items():
        by_source[source[i]] += n
    want, copies = targets(by_source), Counter(ids["mixing"])
    taken, least = Counter(), defaultdict(lambda: 9)
    for i, n in size.items():
        taken[source[i]] += copies[i] * n
        least[source[i]] = min(least[source[i]], copies[i])
        assert copies[i] <= 2
    assert set(copies) <= set(size)
    for s in by_source:
        assert least[s] >= int(want[s] / by_source[s])
        assert abs(taken[s] - want[s]) <= max(n for i, n in size.items() if source[i] == s)

    assert ids["sharding"] == ids["mixing"]
    slots = defaultdict(list)
    for r in frames["sharding"]:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(24)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_run_is_its_stages_and_repeats(spark, folder):
    first, again = (sorted((r["doc_id"], r["shard"], r["slot"]) for r in corpus_pipeline.run(spark, folder).collect()) for _ in range(2))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert first == again == sorted((r["doc_id"], r["shard"], r["slot"]) for r in docs.collect())


def test_run_over_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
