"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of hashed character n-grams of a whole text, those whose shares among
toxic and other training texts differ by more than SURE standard deviations (of n training texts
no feature can show more than sqrt(n); with fewer than 64, half of that is enough), however many
these are: noise among the others costs more than it brings. For each feature the ratio r = log((p / |p|) / (q / |q|)) of its smoothed document counts
among toxic and other training texts scales its column; a logistic regression is then fitted on
the scaled columns. The training texts stay on the executors: a step of the fit sends the weights
of the features out and gets the sums of the gradient back.

Training reads at most MAX_TRAIN labelled texts (those whose ids have the smallest hashes), a
bound that doesn't change with the size of the corpus; scoring reads every text in full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, held_out, settle

ORDERS = (3, 4, 5)
BITS = 20
MAX_TRAIN = 8000
#: Tasks that add up over the training texts.
TASKS = 4
#: Deviations by which a feature's shares in the two classes differ at least.
SURE = 4.0
L2 = 0.1
#: Steps of the fit at most, and the gradient's share of its first length at which it ends.
STEPS, ENOUGH = 60, 1e-3
#: Code points of texts that are hashed at a time: a task holds some hundred bytes for each.
PIECE = 1 << 18
#: So many text numbers fit beside a bucket into 32 bits.
MOST_TEXTS = (1 << 32 - BITS) - 1
FOLDS, FOLD = 5, 0


@dataclass(frozen=True)
class ToxicityModel:
    """The buckets that count and what each adds, and the sum that every text starts from."""

    buckets: np.ndarray
    coef: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        """What every bucket adds."""
        adds = np.zeros(1 << BITS)
        adds[self.buckets] = self.coef
        return adds


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int, bool]]:
    """Code points of lower-cased texts with blanks between them, in pieces of about PIECE, MOST_TEXTS texts at most.

    (code points, text number of each, first text, whether its text goes on in the next piece). A
    longer text has pieces of its own, which overlap as far as an n-gram reaches.
    """
    pad = "\0" * (max(ORDERS) - 1)
    first, size, held = 0, 0, []
    for i, t in enumerate([*texts, None]):
        low = (t or "").lower()
        if held and (i == len(texts) or size + len(low) > PIECE or len(held) == MOST_TEXTS):
            joined = pad + "".join(x + pad for x in held)
            owner = np.repeat(np.arange(len(held), dtype=np.int32), [len(x) + len(pad) for x in held])
            for at in range(0, len(joined) - len(pad), 2 * PIECE):
                part = joined[at : at + 2 * PIECE + len(pad)]
                points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
                yield points, owner[at : at + 2 * PIECE], first, at + 2 * PIECE < len(joined) - len(pad)
            first, size, held = i, 0, []
        held.append(low)
        size += len(low)


def _ngrams(points: np.ndarray) -> Iterator[np.ndarray]:
    """Bucket of the n-gram that ends at each position from max(ORDERS) - 1 on, for every order."""
    mult, skip = np.uint32(0x01000193), max(ORDERS) - 1
    h = points.copy()
    h *= np.uint32(0x9E3779B1)
    base = h.copy()
    for n in range(2, max(ORDERS) + 1):
        # h[i] becomes the hash of the n points that end at i
        nxt = base.copy()
        nxt[1:] += (h[:-1] ^ (h[:-1] >> np.uint32(15))) * mult
        h = nxt
        if n in ORDERS:
            yield (((h ^ np.uint32(n * 0x51ED27)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS))[skip:]


def _present(texts: list[str | None], used: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket), each pair once, of all buckets or of those used; a text lies within one of the parts."""
    skip, seen = max(ORDERS) - 1, None
    for points, owner, first, more in _pieces(texts):
        if more or seen is not None:
            # a long text, piece by piece
            seen = np.zeros(1 << BITS, bool) if seen is None else seen
            for b in _ngrams(points):
                seen[b] = True
            if not more:
                bucket = np.flatnonzero(seen if used is None else seen & used)
                seen = None
                yield np.full(len(bucket), first, np.int64), bucket
            continue
        at = owner.astype(np.uint32) << np.uint32(BITS)
        found = []
        for b in _ngrams(points):
            hit = slice(None) if used is None else np.flatnonzero(used[b])
            found.append(at[hit] | b[hit])
        pairs = np.concatenate(found)
        if not len(pairs):
            continue
        pairs.sort()
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])]
        yield first + (pairs >> np.uint32(BITS)).astype(np.int64), pairs & np.uint32((1 << BITS) - 1)


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> DataFrame:
    """(text, toxic) of at most `limit` labelled documents outside the held-out fold."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, FOLD))
    known = known.groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("l_id"), "l_id").limit(limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("d_id"), F.col("text").cast("string").alias("text"))
    # `limit` rows of two numbers
    return texts.join(F.broadcast(known), F.col("d_id") == F.col("l_id")).select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> ToxicityModel:
    """Fit on labelled documents. Without both classes among them the model gives their share to every text, without any it calls none toxic.

    Few labels tell few n-grams apart: with ten of a class, only what stands in most of their texts
    and in few others counts. Columns of docs and labels other than doc_id, text and toxic are not
    looked at, whatever their names.
    """

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_pylist()
            for at, bucket in _present(batch.column("text").to_pylist()):
                first, last = int(at[0]) if len(at) else 0, int(at[-1]) + 1 if len(at) else 0
                cuts = np.searchsorted(at, np.arange(first, last + 1))
                has = [bucket[a:z].astype(np.int32).tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(toxic[first:last], pa.int32()), pa.array(has, pa.binary())], ["toxic", "has"])

    # texts without any n-gram teach nothing but the share of their class
    rows = settle(settle(training_rows(docs, labels, limit), "train").mapInArrow(columns, "toxic int, has binary"), "features")
    n_by = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = n_by.get(1, 0), n_by.get(0, 0)
    if not pos or not neg:
        return ToxicityModel(np.zeros(0, np.int32), np.zeros(0), float(np.log((pos + 0.5) / (neg + 1))))

    def sums(rows: DataFrame, size: int, kind: type, weigh: Callable[[np.ndarray, list[np.ndarray]], tuple[np.ndarray, float]]) -> tuple[np.ndarray, float, float]:
        """Over all training texts the sums of `weigh`'s weights by feature, of the weights, and of the loss: TASKS rows of `size` numbers."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, plain, loss = np.zeros(size), 0.0, 0.0
            for batch in batches:
                has = [np.frombuffer(x, np.int32) for x in batch.column("has").to_pylist()]
                weight, more = weigh(batch.column("toxic").to_numpy(), has)
                plain, loss = plain + weight.sum(), loss + more
                for k in range(0, len(has), 128):
                    total += np.bincount(np.concatenate(has[k : k + 128]), np.repeat(weight[k : k + 128], [len(x) for x in has[k : k + 128]]), size)
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(kind).tobytes()], pa.binary()), pa.array([float(plain)]), pa.array([float(loss)])], ["total", "plain", "loss"])

        total, plain, loss = np.zeros(size), 0.0, 0.0
        # each task sends `size` numbers, so their number is fixed, however many files there are
        for r in rows.coalesce(TASKS).mapInArrow(run, "total binary, plain double, loss double").collect():
            total += np.frombuffer(r["total"], kind)
            plain, loss = plain + r["plain"], loss + r["loss"]
        return total, plain, loss

    # counts are `limit` at most
    others, toxics = (sums(rows, 1 << BITS, np.uint16 if limit < 1 << 16 else np.uint32, lambda toxic, has, c=c: ((toxic == c).astype(float), 0.0))[0] for c in (0, 1))
    both = (others + toxics) / (pos + neg)
    chosen = np.flatnonzero(np.abs(toxics / pos - others / neg) > min(SURE, np.sqrt(pos + neg) / 2) * np.sqrt(both * (1 - both) * (1 / pos + 1 / neg))).astype(np.int32)
    ratio = np.log(((toxics[chosen] + 1) / (pos + 2)) / ((others[chosen] + 1) / (neg + 2)))
    del others, toxics, both
    spark, n, size = docs.sparkSession, pos + neg, len(chosen)
    known = spark.sparkContext.broadcast(chosen)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has = [np.searchsorted(known.value, np.intersect1d(np.frombuffer(x, np.int32), known.value, True)).astype(np.int32).tobytes() for x in batch.column("has").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(has, pa.binary())], ["toxic", "has"])

    few = settle(rows.mapInArrow(narrow, "toxic int, has binary"), "chosen")

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        """The penalised loss and its gradient, at weights and a bias behind them."""
        sent, bias = spark.sparkContext.broadcast(x[:-1] * ratio), float(x[-1])

        def weigh(toxic: np.ndarray, has: list[np.ndarray]) -> tuple[np.ndarray, float]:
            coef = sent.value
            z = np.clip(bias + np.array([coef[h].sum() for h in has]), -500, 500)
            return 1 / (1 + np.exp(-z)) - toxic, float(np.logaddexp(0, np.where(toxic == 1, -z, z)).sum())

        total, plain, loss = sums(few, size, np.float64, weigh)
        sent.destroy()
        g = np.append(total * ratio + L2 * x[:-1], plain) / n
        return (loss + L2 / 2 * float(x[:-1] @ x[:-1])) / n, g

    x = _minimum(value, np.append(np.zeros(size), np.log((pos + 0.5) / (neg + 0.5))))
    return ToxicityModel(chosen, x[:-1] * ratio, float(x[-1]))


def _minimum(value: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, held: int = 6) -> np.ndarray:
    """Where a smooth convex function is least, by steps that learn its curvature from the last few gradients."""
    f, g = value(x)
    first, past, step = float(np.linalg.norm(g)), [], 1.0
    for _ in range(STEPS):
        if np.linalg.norm(g) <= ENOUGH * first:
            break
        d, back = -g, []
        for s, y in reversed(past):
            a = float(s @ d) / float(s @ y)
            d = d - a * y
            back.append(a)
        if past:
            s, y = past[-1]
            d = d * (float(s @ y) / float(y @ y))
        else:
            d = d / max(first, 1e-12)
        for (s, y), a in zip(past, reversed(back), strict=True):
            d = d + s * (a - float(y @ d) / float(s @ y))
        slope, step = float(g @ d), 1.0
        while True:
            f_new, g_new = value(x + step * d)
            if f_new <= f + 1e-4 * step * slope or step < 1e-6:
                break
            step *= 0.4
        s, y = step * d, g_new - g
        if float(s @ y) > 1e-14:
            past = [*past, (s, y)][-held:]
        x, f, g = x + s, f_new, g_new
    return x


def _rated(texts: list[str | None], coef: np.ndarray, bias: float) -> np.ndarray:
    """What the model adds up to for each text."""
    total = np.full(len(texts), bias)
    for at, bucket in _present(texts, coef != 0):
        total += np.bincount(at, coef[bucket], minlength=len(texts))
    return total


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; a null text scores as an empty one, null ids stay null."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coef, bias = sent.value.table(), sent.value.bias
        for batch in batches:
            s = 1 / (1 + np.exp(-np.clip(_rated(batch.column("text").to_pylist(), coef, bias), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(rate, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of docs that the model doesn't call toxic, in the columns of docs, whatever others are called."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coef, bias = sent.value.table(), sent.value.bias
        for batch in batches:
            # texts are looked at where they lie; a few hundred at a time are held besides
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                yield part.filter(pa.array(_rated(part.column("row").flatten()[text].to_pylist(), coef, bias) < 0))

    text = docs.columns.index("text")
    rows = boxed(docs)
    return rows.mapInArrow(rate, rows.schema).select("row.*")
