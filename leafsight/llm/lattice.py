"""Language-model scores by subword lattices: the probability of a text over all its segmentations.

The pieces are those of an existing vocabulary. A piece's weight is its share among the pieces
into which the existing segmentation cuts the training words, smoothed by the vocabulary's own
ranking, so pieces that training never used keep the order that the vocabulary gives them. A
word's probability is the sum over all ways to spell it in pieces, by a forward recursion in log
space; a text is its words and one end.

Beside it stands the base: add-one smoothed frequencies of whole words over the training texts.

Both need figures of every distinct word. The most frequent words (HEAD of them at most) are
looked up where a text is read; the others meet their figures in a join, a row for each text and
word. So nothing that grows with the corpus is ever held by one task.
"""

from __future__ import annotations

import math
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, settle

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FOLDS, FOLD = 7, 2
HEAD = 100_000
PRIOR = 1000.0
FLUSH = 250_000
END = b" "
_MARK = "▁"


class Lattice:
    """Log weights of pieces as bytes; a word starts with a blank, which no word holds."""

    def __init__(self, weights: dict[bytes, float]):
        self.weights = weights
        self.known: dict[bytes, float | None] = {p[:n]: None for p in weights for n in range(1, len(p))} | weights

    def log10(self, word: bytes) -> float:
        """Log probability of a word, summed over its segmentations."""
        w, known, exp, log = b" " + word, self.known, math.exp, math.log
        n = len(w)
        into: list[list[float]] = [[] for _ in range(n + 1)]
        into[0].append(0.0)
        for i in range(n):
            arcs = into[i]
            if len(arcs) == 1:
                a = arcs[0]
            else:
                m = max(arcs)
                a = m + log(sum([exp(x - m) for x in arcs]))
            into[i] = None
            for j in range(i + 1, n + 1):
                p = known.get(w[i:j], 0.0)
                if p is None:
                    continue
                if p == 0.0:
                    break
                into[j].append(a + p)
        m = max(into[n])
        return (m + log(sum([exp(x - m) for x in into[n]]))) / math.log(10)


def pieces(model: bytes) -> tuple[list[bytes | None], np.ndarray]:
    """The vocabulary's pieces as bytes (None: not used in words) and their prior shares, by its ranking."""
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    out: list[bytes | None] = []
    rank = np.zeros(len(sp))
    for i in range(len(sp)):
        text = sp.id_to_piece(i)
        rank[i] = -sp.get_score(i)
        if sp.is_byte(i):
            out.append(bytes([int(text[3:5], 16)]))
            rank[i] = len(sp)
        elif sp.is_control(i) or sp.is_unknown(i) or _MARK in text[1:]:
            out.append(None)
        else:
            out.append((" " + text[1:] if text[0] == _MARK else text).encode())
    prior = np.array([0.0 if p is None else 1 / (r + 10) for p, r in zip(out, np.maximum(rank, 0), strict=True)])
    return out, prior / prior.sum()


def weigh(model: bytes, counts: np.ndarray, ends: int) -> tuple[Lattice, float]:
    """The lattice for counts of pieces, and log10 of the end's share. All shares sum to 1."""
    names, prior = pieces(model)
    used = np.array([p is not None for p in names])
    counts = np.where(used, counts, 0) + PRIOR * prior
    end = ends + 1.0
    total = counts.sum() + end
    shares: dict[bytes, float] = {}
    for p, c in zip(names, counts, strict=True):
        if p is not None:
            shares[p] = shares.get(p, 0.0) + c / total
    return Lattice({p: math.log(s) for p, s in shares.items()}), math.log10(end / total)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), F.col("text").cast("string").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): how often each word of any text stands in training texts; 0 for words of others only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c.keys()), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "c"])

        total: Counter = Counter()
        for batch in batches:
            for out, text in zip(batch.column("held_out").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if out:
                    for w in words(text):
                        total[w] += 0
                else:
                    total.update(words(text))
                if len(total) > FLUSH:
                    yield rows(total)
                    total = Counter()
        yield rows(total)

    return docs.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def score(docs: DataFrame, vocabulary: str = VOCABULARY, head: int = HEAD) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null text is empty: its only token is the end. Rows without an id count as training rows.
    Rows that repeat are scored, and learned from, each. Without training texts train_tokens is 0
    and all words are unknown. An empty table gives no rows.
    """
    with open(vocabulary, "rb") as f:
        model = f.read()
    slim = _slim(docs)
    counts = settle(word_counts(slim), "words")
    n_words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    ends = slim.where("not held_out").count()
    total, kinds = n_words + ends, distinct + (ends > 0)
    divisor = total + kinds + 1.0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        found = np.zeros(len(sp))
        for batch in batches:
            texts = [w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()]
            times = batch.column("c").to_numpy()
            for k in range(0, len(texts), 5000):
                ids = sp.encode(texts[k : k + 5000])
                flat = np.array([i for x in ids for i in x], np.int64)
                found += np.bincount(flat, np.repeat(times[k : k + 5000], [len(x) for x in ids]), len(sp))
        seen = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(found[seen])], ["piece", "n"])

    cuts = counts.where("c > 0").mapInArrow(cut, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
    by_piece = np.zeros(len(sentencepiece.SentencePieceProcessor(model_proto=model)))
    by_piece[cuts["piece"].to_numpy(int)] = cuts["n"].to_numpy()

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, _ = weigh(model, by_piece, ends)
        for batch in batches:
            logs = [lattice.log10(w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(logs, pa.float64())], ["word", "c", "logp"])

    rated = settle(counts.mapInArrow(rate, "word binary, c long, logp double"), "rated")
    # `head` rows at most
    top = rated.orderBy(F.desc("c"), "word").limit(head).toPandas()
    known = spark_broadcast(docs, {bytes(w): (c, lp) for w, c, lp in zip(top["word"], top["c"].tolist(), top["logp"].tolist(), strict=True)})
    _, end_log = weigh(model, by_piece, ends)
    end_base = math.log10((ends + 1) / divisor)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {w: (math.log10((c + 1) / divisor), c > 0, lp) for w, (c, lp) in known.value.items()}
        for batch in batches:
            rid, word, tf, heads = [], [], [], []
            cols = [batch.column(c).to_pylist() for c in ("rid", "doc_id", "held_out", "text")]
            for r, doc_id, out, text in zip(*cols, strict=True):
                tokens = words(text)
                base, seen, lp = end_base, int(ends > 0), end_log
                for w, n in Counter(tokens).items():
                    got = table.get(w)
                    if got is None:
                        rid.append(r)
                        word.append(w)
                        tf.append(n)
                        heads.append(None)
                    else:
                        base += n * got[0]
                        seen += n * got[1]
                        lp += n * got[2]
                rid.append(r)
                # no word holds a blank, so this meets no word in the join, and rows spread by it
                word.append(END + struct.pack("<q", r))
                tf.append(0)
                heads.append({"doc_id": doc_id, "held_out": out, "n_tokens": len(tokens) + 1, "n_known": seen, "base": base, "lp": lp})
                if len(rid) > 50_000:
                    yield pack(rid, word, tf, heads)
                    rid, word, tf, heads = [], [], [], []
            yield pack(rid, word, tf, heads)

    def pack(rid: list, word: list, tf: list, heads: list) -> pa.RecordBatch:
        kind = pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("lp", pa.float64())])
        return pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(word, pa.binary()), pa.array(tf, pa.int32()), pa.array(heads, kind)], ["rid", "word", "tf", "h"])

    schema = "rid long, word binary, tf int, h struct<doc_id:long,held_out:boolean,n_tokens:long,n_known:long,base:double,lp:double>"
    rows = slim.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(read, schema)
    rare = rated.select("word", "c", "logp")
    met = rows.join(rare, "word", "left")
    tail = met.select(
        "rid", "h",
        F.coalesce(F.col("tf") * F.log10((F.col("c") + 1) / F.lit(divisor)), F.lit(0.0)).alias("base"),
        F.when(F.col("c") > 0, F.col("tf")).otherwise(F.lit(0)).cast("long").alias("known"),
        F.coalesce(F.col("tf") * F.col("logp"), F.lit(0.0)).alias("lp"),
    )
    h = F.col("h")
    # the order in which a shuffle adds is not fixed, so reruns may differ in the last digits
    flat = tail.select("rid", h["doc_id"].alias("doc_id"), h["held_out"].alias("held_out"), h["n_tokens"].alias("n_tokens"), (F.col("known") + F.coalesce(h["n_known"], F.lit(0))).alias("known"), (F.col("base") + F.coalesce(h["base"], F.lit(0.0))).alias("base"), (F.col("lp") + F.coalesce(h["lp"], F.lit(0.0))).alias("lp"))
    out = flat.groupBy("rid").agg(*[F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens")], F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("lp").alias("score"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def spark_broadcast(df: DataFrame, value):
    return df.sparkSession.sparkContext.broadcast(value)
