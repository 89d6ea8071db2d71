"""Exact repeats across documents by enhanced suffix arrays.

What repeats is found by maximal repeats: suffixes are sorted, the lengths of the common prefixes
of neighbours form a tree of intervals, which one scan with a stack walks; an interval whose
suffixes differ in the byte to their left can't be extended on either side, and is a maximal
repeat with all its occurrences.

One suffix array can't hold a corpus, so suffixes that can match are brought together first.
Every string of LEAST bytes has an anchor, the leftmost of its GRAM-byte strings with the
smallest hash, and equal strings have equal anchors. A stretch of positions whose strings share
an anchor is a segment. Anchors that occur once are dropped; the segments of the others go,
by anchor, to the suffix arrays, distinct ones only and each with its smallest document.
Segments of an anchor that more than CROWD of them share go as their single strings of LEAST
bytes, by those strings instead, so what meets at an anchor is bounded by CROWD, and a string
that is common counts once per block.

Documents travel as blocks: about BLOCK bytes of texts in one compressed row, so that the
shuffles carry few rows and an anchor or segment counts once per block however often it repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .shingles import mix

LEAST, GRAM = 50, 24
BLOCK = 1 << 20
CHUNK = 1 << 22
SHARD_BYTES = 8 << 20
BATCH_BYTES = 1 << 20
#: Distinct segments of one anchor, counted per block, from which on they are dealt by their strings.
CROWD = 4096
_BASE = np.uint64(0x9E3779B97F4A7C55)
_BYTE = np.random.Generator(np.random.PCG64(99)).integers(1, 1 << 63, 256, np.uint64)
_POS = np.uint64((1 << 24) - 1)


def _pack(data: bytes | np.ndarray) -> bytes:
    """Length and compressed bytes."""
    raw = data.tobytes() if isinstance(data, np.ndarray) else bytes(data)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def _unpack(data: bytes) -> bytes:
    n = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], decompressed_size=n, codec="zstd", asbytes=True) if n else b""


def gram_hashes(b: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the `gram` (a multiple of 8) bytes at every position."""
    with np.errstate(over="ignore"):
        h, power, eight = _BYTE[b], _BASE, None
        for n in (1, 2, 4):
            h = h[:-n] * power + h[n:]
            power = power * power
        eight = h
        for k in range(8, gram, 8):
            h = h[: len(eight) - k] * power + eight[k:]
    return mix(h)


def anchors(b: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the anchor of the `least` bytes at every position."""
    n, span = len(b) - least + 1, least - gram + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, hashes = [], []
    for a in range(0, n, CHUNK):
        h = gram_hashes(b[a : min(n, a + CHUNK) + least - 1], gram)
        key = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < span:
            key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
        pos = (key & _POS).astype(np.int64)
        at.append(pos + a)
        hashes.append(h[pos])
    return np.concatenate(at), np.concatenate(hashes)


class Runs:
    """The segments of a block: first position, number of positions, document and anchor of each."""

    def __init__(self, data: bytes, lengths: np.ndarray, least: int):
        b = np.frombuffer(data, np.uint8)
        ends = np.cumsum(lengths)
        pos, h = anchors(b, least)
        doc = np.searchsorted(ends, np.arange(len(pos)), side="right")
        inside = np.arange(len(pos)) + least <= ends[doc] if len(pos) else np.zeros(0, bool)
        new = np.ones(len(pos), bool)
        if len(pos):
            new[1:] = (pos[1:] != pos[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(pos)))
        keep = inside[first] if len(first) else np.zeros(0, bool)
        self.first, self.size = first[keep], size[keep]
        self.doc, self.hash = doc[self.first], h[self.first]
        self.unique, self.inverse, self.count = np.unique(self.hash, return_inverse=True, return_counts=True)


def _string_hashes(b: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A hash of the first bytes, a multiple of 8, of the strings of some length at the positions."""
    out = np.zeros(len(at), np.uint64)
    if len(at):
        words = np.lib.stride_tricks.sliding_window_view(b, length // 8 * 8)[at].view(np.uint64)
        with np.errstate(over="ignore"):
            for k in range(words.shape[1]):
                out = mix((out ^ words[:, k]) * _BASE)
    return out


def _distinct(b: np.ndarray, runs: Runs, least: int) -> np.ndarray:
    """How many different segments each anchor has in the block, by hashes of both ends; at most 65,535."""
    count = np.ones(len(runs.unique), np.int64)
    several = np.flatnonzero(runs.count[runs.inverse] > 1) if len(runs.first) else np.zeros(0, np.int64)
    if len(several):
        first, size = runs.first[several], runs.size[several]
        with np.errstate(over="ignore"):
            ends = _string_hashes(b, first, least) * _BASE ^ _string_hashes(b, first + size - 1, least) ^ size.astype(np.uint64)
        order = np.lexsort((ends, runs.inverse[several]))
        anchor, ends = runs.inverse[several][order], ends[order]
        new = np.ones(len(order), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (ends[1:] != ends[:-1])
        count = np.maximum(count, np.bincount(anchor[new], minlength=len(count)))
    return np.minimum(count, 65535).astype(np.uint16)


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h & np.uint64(0xFFFFFFFF)) % np.uint64(shards)).astype(np.int64)


def _by_shard(h: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, numbers of its hashes), in a fixed order."""
    s = _shard(h, shards)
    order = np.argsort(s, kind="stable")
    cuts = np.flatnonzero(np.diff(s[order], prepend=-1))
    for a, z in zip(cuts, [*cuts[1:], len(order)], strict=True):
        yield int(s[order[a]]), order[a:z]


def maximal_repeats(texts: list[bytes], least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Maximal repeats of `least` bytes or more in distinct texts: (length, text numbers, positions), all occurrences.

    A repeat is left out if every occurrence has the same byte to its left; occurrences at the
    start of a text have none, and differ from all.
    """
    if not texts:
        return
    sizes = np.array([len(t) for t in texts], np.int64)
    width = int(sizes.max())
    flat = np.frombuffer(b"".join(texts) + b"\0" * width, np.uint8)
    starts = np.cumsum(sizes) - sizes
    n = np.maximum(sizes - least + 1, 0)
    owner = np.repeat(np.arange(len(texts)), n)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    if len(owner) < 2:
        return
    left_bytes = sizes[owner] - offset
    rows = np.lib.stride_tricks.sliding_window_view(flat, width)[starts[owner] + offset]
    rows = np.where(np.arange(width)[None, :] < left_bytes[:, None], rows, 0).astype(np.uint8)
    order = np.argsort(rows.view(f"S{width}").ravel(), kind="stable")
    rows, owner, offset, left_bytes = rows[order], owner[order], offset[order], left_bytes[order]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common = np.minimum(common, np.minimum(left_bytes[1:], left_bytes[:-1]))
    before = np.where(offset > 0, flat[np.maximum(starts[owner] + offset - 1, 0)].astype(np.int64), -1 - np.arange(len(owner)))
    # only where neighbours share enough are there intervals; each such run is scanned by itself
    deep = common >= least
    edge = np.diff(np.concatenate([[False], deep, [False]]).astype(np.int8))
    for a, z in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        lengths = common[a:z].tolist()
        lefts = before[a : z + 1].tolist()
        # intervals that are open: (common length, first suffix, byte to the left of all so far or None if they differ)
        stack: list[list] = []
        for i, length in enumerate([*lengths, 0]):
            first, left = i, lefts[i]
            while stack and stack[-1][0] > length:
                size, first, inner = stack.pop()
                if inner != left:
                    inner = None
                left = inner
                if inner is None:
                    yield size, owner[a + first : a + i + 1], offset[a + first : a + i + 1]
            if length == 0:
                break
            if stack and stack[-1][0] == length:
                if stack[-1][2] != left:
                    stack[-1][2] = None
            else:
                stack.append([length, first, left])


def _least_documents(texts: list[bytes], docs: np.ndarray, least: int) -> list[np.ndarray]:
    """For each distinct text and each position in it the smallest document that has the `least` bytes there."""
    out = [np.full(max(0, len(t) - least + 1), d, np.int64) for t, d in zip(texts, docs, strict=True)]
    for length, owners, offsets in maximal_repeats(texts, least):
        low = docs[owners].min()
        for t, o in zip(owners.tolist(), offsets.tolist(), strict=True):
            if docs[t] > low:
                part = out[t][o : o + length - least + 1]
                np.minimum(part, low, out=part)
    return out


BLOCKS = "block long, ids binary, lengths binary, data binary, n_bytes long"


def blocks(docs: DataFrame) -> DataFrame:
    """Rows of about BLOCK bytes of texts: ids (the smallest long for none), lengths, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        texts: list[bytes] = []
        size = 0

        def row() -> pa.RecordBatch:
            lengths = np.array([len(t) for t in texts], np.int64)
            cols = [[(part << 32) + number], [np.array(ids, np.int64).tobytes()], [lengths.tobytes()], [_pack(b"".join(texts))], [size]]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["block", "ids", "lengths", "data", "n_bytes"])

        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = (t or "").encode("utf-8", "surrogatepass")
                if texts and size + len(data) > BLOCK:
                    yield row()
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(NO_ID if i is None else i)
                texts.append(data)
                size += len(data)
        if texts:
            yield row()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, BLOCKS)


NO_ID = -(2**63)


def _read(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    ids = np.frombuffer(batch.column("ids")[i].as_py(), np.int64)
    lengths = np.frombuffer(batch.column("lengths")[i].as_py(), np.int64)
    return ids, lengths, _unpack(batch.column("data")[i].as_py())


def _rows(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _shared(table: DataFrame, shards: int, least: int, most: int) -> DataFrame:
    """(block, marks): per block which of its anchors occur elsewhere too, and which are crowded (no bits: none), as (shard, bits, crowd)."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, lengths, data = _read(batch, i)
                runs = Runs(data, lengths, least)
                block, out = batch.column("block")[i].as_py(), []
                kinds = _distinct(np.frombuffer(data, np.uint8), runs, least)
                for s, at in _by_shard(runs.unique, shards):
                    six = np.ascontiguousarray((runs.unique[at] >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6])
                    out.append((s, block, six.tobytes(), np.packbits(runs.count[at] > 1).tobytes(), kinds[at].tobytes()))
                yield _rows(["shard", "block", "six", "twice", "kinds"], [pa.int64(), pa.int64(), *[pa.binary()] * 3], out)

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        sizes = [len(x) // 6 for x in group["six"]]
        wide = np.zeros((sum(sizes), 8), np.uint8)
        wide[:, :6] = np.frombuffer(b"".join(group["six"]), np.uint8).reshape(-1, 6)
        _, inverse, count = np.unique(wide.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
        twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8))[:n] for t, n in zip(group["twice"], sizes, strict=True)])
        mine = np.split((count[inverse] > 1) | (twice > 0), np.cumsum(sizes)[:-1])
        kinds = np.bincount(inverse, weights=np.frombuffer(b"".join(group["kinds"]), np.uint16), minlength=len(count))
        crowded = np.split((kinds > most)[inverse], np.cumsum(sizes)[:-1])
        bits, crowd = [np.packbits(m).tobytes() for m in mine], [np.packbits(m).tobytes() if m.any() else b"" for m in crowded]
        return pd.DataFrame({"block": group["block"], "shard": group["shard"], "bits": bits, "crowd": crowd})

    asked = table.select("block", "ids", "lengths", "data").mapInArrow(ask, "shard long, block long, six binary, twice binary, kinds binary")
    answers = asked.groupBy("shard").applyInPandas(answer, "block long, shard long, bits binary, crowd binary")
    return answers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("shard", "bits", "crowd"))).alias("marks"))


def _segments(batch: pa.RecordBatch, i: int, shards: int, least: int) -> tuple[np.ndarray, np.ndarray, bytes, dict[int, dict[bytes, int]], tuple[np.ndarray, ...], dict[int, list[int]], dict[int, list[int]]]:
    """The shared segments of a block, or their strings if crowded, distinct ones numbered per shard; also the first position, positions, document, shard and number of each."""
    ids, lengths, data = _read(batch, i)
    runs = Runs(data, lengths, least)
    shared = np.zeros(len(runs.unique), bool)
    crowded = np.zeros(len(runs.unique), bool)
    marks = {m["shard"]: m for m in batch.column("marks")[i].as_py() or []}
    for s, at in _by_shard(runs.unique, shards):
        shared[at] = np.unpackbits(np.frombuffer(marks[s]["bits"], np.uint8))[: len(at)] > 0
        if marks[s]["crowd"]:
            crowded[at] = np.unpackbits(np.frombuffer(marks[s]["crowd"], np.uint8))[: len(at)] > 0
    use = np.flatnonzero(shared[runs.inverse] & (ids[runs.doc] != NO_ID)) if len(runs.first) else np.zeros(0, np.int64)
    many = crowded[runs.inverse[use]]
    whole, split = use[~many], use[many]
    n = runs.size[split]
    single = np.repeat(runs.first[split], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    key = np.concatenate([runs.hash[whole], _string_hashes(np.frombuffer(data, np.uint8), single, least)])
    begin, length = np.concatenate([runs.first[whole], single]), np.concatenate([runs.size[whole], np.ones(len(single), np.int64)])
    owner = ids[np.concatenate([runs.doc[whole], np.repeat(runs.doc[split], n)])]
    where = _shard(key, shards)
    home, sub = where.tolist(), ((key >> np.uint64(40)) & np.uint64(0xFF)).tolist()
    first, size, doc = begin.tolist(), length.tolist(), owner.tolist()
    number: dict[int, dict[bytes, int]] = {}
    low: dict[int, list[int]] = {}
    subs: dict[int, list[int]] = {}
    places = []
    for s, u, f, n, d in zip(home, sub, first, size, doc, strict=True):
        known = number.setdefault(s, {})
        text = data[f : f + n + least - 1]
        k = known.setdefault(text, len(known))
        docs = low.setdefault(s, [])
        if k == len(docs):
            docs.append(d)
            subs.setdefault(s, []).append(u)
        elif d < docs[k]:
            docs[k] = d
        places.append(k)
    return ids, lengths, data, number, (begin, length, owner, where, np.array(places, np.int64)), low, subs


def _verdicts(marked: DataFrame, shards: int, least: int) -> DataFrame:
    """(block, lows): for the block's distinct segments, per shard, the smallest document at each position."""

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, _, _, number, _, low, subs = _segments(batch, i, shards, least)
                block, out = batch.column("block")[i].as_py(), []
                for s, known in number.items():
                    sizes = np.array([len(t) for t in known], np.uint16)
                    out.append((s, block, _pack(b"".join(known)), _pack(sizes), _pack(np.array(low[s], np.int64)), np.array(subs[s], np.uint8).tobytes()))
                yield _rows(["shard", "block", "texts", "sizes", "low", "subs"], [pa.int64(), pa.int64(), *[pa.binary()] * 4], out)

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        number: list[dict[bytes, int]] = [{} for _ in range(256)]
        low: list[list[int]] = [[] for _ in range(256)]
        places = []
        for texts, sizes, lows, subs in zip(group["texts"], group["sizes"], group["low"], group["subs"], strict=True):
            flat, at, mine = _unpack(texts), 0, []
            for n, d, u in zip(np.frombuffer(_unpack(sizes), np.uint16).tolist(), np.frombuffer(_unpack(lows), np.int64).tolist(), subs, strict=True):
                known, docs = number[u], low[u]
                k = known.setdefault(flat[at : at + n], len(known))
                if k == len(docs):
                    docs.append(d)
                elif d < docs[k]:
                    docs[k] = d
                at += n
                mine.append((u, k))
            places.append(mine)
        # equal strings have equal anchors and, if those are crowded, equal hashes, so each of the 256 kinds is complete by itself
        found: list[list[np.ndarray]] = [[] for _ in range(256)]
        held: list[int] = []
        size = 0
        for u in range(257):
            add = sum(map(len, number[u])) if u < 256 else 0
            if held and (u == 256 or size + add > BATCH_BYTES):
                texts = [t for x in held for t in number[x]]
                lows = _least_documents(texts, np.array([d for x in held for d in low[x]], np.int64), least)
                at = 0
                for x in held:
                    found[x] = lows[at : at + len(low[x])]
                    at += len(low[x])
                held, size = [], 0
            if u < 256:
                held.append(u)
                size += add
        blobs = [_pack(np.concatenate([found[u][k] for u, k in mine])) for mine in places]
        return pd.DataFrame({"block": group["block"], "shard": group["shard"], "low": blobs})

    shipped = marked.mapInArrow(ship, "shard long, block long, texts binary, sizes binary, low binary, subs binary")
    judged = shipped.groupBy("shard").applyInPandas(judge, "block long, shard long, low binary")
    return judged.groupBy("block").agg(F.collect_list(F.struct("shard", "low")).alias("lows"))


def strip_repeats(docs: DataFrame, least: int = LEAST, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): per row of docs the bytes removed, as array<struct<start, length>>, and those that stay.

    A byte goes if it lies in a string of `least` bytes that also starts in a document with a
    smaller doc_id. Texts are UTF-8 bytes, a null text is empty. Rows that share an id don't
    remove each other's bytes; rows without an id neither lose bytes nor cost others any. Strings
    are judged on the input, so the result doesn't depend on any order, nor on crowd, which only
    says from how many segments on an anchor is split.
    """
    table = settle(blocks(docs), "blocks")
    total = table.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    shards = max(32, -(-total // SHARD_BYTES))
    # the small side is what is written; blocks themselves are written once
    marks = settle(_shared(table, shards, least, crowd), "marks")
    marked = table.join(marks, "block").select("block", "ids", "lengths", "data", "marks")
    answers = marks.join(settle(_verdicts(marked, shards, least), "verdicts"), "block", "left")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, lengths, data, number, places, _, _ = _segments(batch, i, shards, least)
                got = {x["shard"]: x["low"] for x in batch.column("lows")[i].as_py() or []}
                starts = np.zeros(len(data) + 1, np.int32)
                first, n, owner, home, place = places
                if len(first):
                    # the answers one after another, and where each shard's and each segment's begin
                    # a few thousand shards at most have something of this block, however many there are
                    lows, mine, base, begin = [], sorted(number), [], 0
                    within: list[np.ndarray] = []
                    total = 0
                    for s in mine:
                        known = number[s]
                        sizes = np.array([len(t) - least + 1 for t in known], np.int64)
                        lows.append(np.frombuffer(_unpack(got[s]), np.int64))
                        within.append(total + np.cumsum(sizes) - sizes)
                        base.append(begin)
                        begin, total = begin + len(sizes), total + int(sizes.sum())
                    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    low = np.concatenate(lows)[np.repeat(np.concatenate(within)[np.array(base)[np.searchsorted(mine, home)] + place], n) + step]
                    where = np.repeat(first, n) + step
                    starts[where[low < np.repeat(owner, n)]] = 1
                sums = np.cumsum(starts[:-1])
                covered = sums.copy()
                covered[least:] -= sums[:-least]
                covered = covered > 0
                edge = np.cumsum(lengths)
                out = []
                for d, z, n in zip(ids.tolist(), edge.tolist(), lengths.tolist(), strict=True):
                    mine = covered[z - n : z]
                    flips = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]])))
                    spans = [{"start": a, "length": b - a} for a, b in zip(flips[::2].tolist(), flips[1::2].tolist(), strict=True)]
                    kept = np.frombuffer(data, np.uint8)[z - n : z][~mine].tobytes() if spans else data[z - n : z]
                    out.append((None if d == NO_ID else d, n, spans, kept))
                span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
                yield _rows(["doc_id", "n_bytes", "spans", "kept"], [pa.int64(), pa.int64(), span, pa.binary()], out)

    final = table.join(answers, "block", "left").select("block", "ids", "lengths", "data", "marks", "lows")
    return final.mapInArrow(remove, "doc_id long, n_bytes long, spans array<struct<start:long,length:long>>, kept binary")
