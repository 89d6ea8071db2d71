"""Language ID: averaged hashed subword embeddings, a linear softmax, and a calibrated rejection.

A text is lower-cased, every run of other characters than letters becomes a border, and the
n-grams of letters and borders within a word are hashed to buckets. A text's vector is the mean of
its n-grams' embeddings over the whole text; embeddings and softmax are learned together by
stochastic gradient descent. A part of the training texts is kept from the descent: on it the
temperature of the softmax is fitted, so that a score is the share of right answers at such a
score, and the least score at which at most ERRORS of the answers are wrong; what scores lower is
rejected.

Training reads about PER_LANG distinct texts a language (chosen by their hashes) of at most
MOST_LANGS languages, bounds that don't change with the corpus; every text is scored in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, settle

ORDERS = (2, 3, 4)
BITS, DIM = 16, 16
PER_LANG, MOST_LANGS = 1000, 500
EPOCHS, RATE, SEED = 8, 4.0, 7
#: Of RATE, for embeddings and for the bias.
VECTOR_RATE, BIAS_RATE = 0.05, 0.01
#: One in so many training texts calibrates; the share of wrong answers among those not rejected.
CALIBRATES, ERRORS = 5, 0.01
PIECE = 1 << 20
FOLDS, FOLD = 5, 0
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    """Languages, what each bucket adds to their logits on average, the bias, the temperature and the least score that is not rejected."""

    langs: tuple[str, ...]
    vectors: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def probabilities(self, means: np.ndarray) -> np.ndarray:
        """Calibrated, of each text a row, from the means of its n-grams' embeddings."""
        return _softmax((means @ self.softmax.T + self.bias) / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Letters' code points with borders (0) in place of other runs, in pieces of about PIECE: (points, first point of each text, its number).

    A long text has pieces of its own, which overlap by what an n-gram reaches back.
    """
    held, numbers, size = [], [], 0
    for i, t in enumerate([*texts, None]):
        points = np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        if held and (i == len(texts) or size + len(points) > PIECE):
            yield np.concatenate(held), np.cumsum([0, *[len(x) for x in held[:-1]]]), np.array(numbers)
            held, numbers, size = [], [], 0
        if i == len(texts):
            return
        letter = _letters()[np.minimum(points, 0x10FFFF)]
        clean = np.zeros(len(points) + 2, np.uint32)
        clean[1:-1] = np.where(letter, points, 0)
        # one border for each run of other characters
        clean = clean[np.append(True, (clean[1:] != 0) | (clean[:-1] != 0))]
        if len(clean) < 3:
            continue
        back = max(ORDERS) - 1
        for at in range(0, len(clean), PIECE) if len(clean) > PIECE else (0,):
            part = clean[max(0, at - back) : at + PIECE] if len(clean) > PIECE else clean
            if len(clean) > PIECE:
                if held:
                    yield np.concatenate(held), np.cumsum([0, *[len(x) for x in held[:-1]]]), np.array(numbers)
                    held, numbers, size = [], [], 0
                yield part, np.array([-min(at, back)]), np.array([i])
            else:
                held.append(part)
                numbers.append(i)
                size += len(part)


def _ngrams(points: np.ndarray, fresh: int) -> Iterator[np.ndarray]:
    """For each order the bucket of the n-gram that ends at each point from `fresh` on, 2**BITS where none does: borders are within a word's ends only."""
    mult = np.uint32(0x01000193)
    edge = points == 0
    base = points * np.uint32(0x9E3779B1)
    h, inner = base.copy(), np.zeros(len(points), bool)
    for n in range(2, max(ORDERS) + 1):
        nxt = base.copy()
        nxt[1:] += (h[:-1] ^ (h[:-1] >> np.uint32(15))) * mult
        h = nxt
        if n > 2:
            # a border between the n-gram's first and last point
            inner[n - 2 :] |= edge[: len(points) - n + 2]
        if n in ORDERS:
            b = (((h ^ np.uint32(n * 0x51ED27)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)).astype(np.int32)
            b[: n - 1] = 1 << BITS
            if n == 2:
                # the end of a text and the beginning of the next
                b[1:][edge[1:] & edge[:-1]] = 1 << BITS
            b[inner] = 1 << BITS
            yield b[fresh:]


def _sums(texts: list[str | None], columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the sums of `columns` (columns x buckets, the last bucket 0) over its n-grams, and their number."""
    total, n = np.zeros((len(columns), len(texts))), np.zeros(len(texts))
    for points, first, number in _pieces(texts):
        fresh = -int(min(first[0], 0))
        first = np.maximum(first, 0)
        for b in _ngrams(points, fresh):
            n[number] += np.add.reduceat((b < 1 << BITS).astype(np.int64), first)
            for k, column in enumerate(columns):
                total[k, number] += np.add.reduceat(column[b], first)
    return total, n


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of a text's n-grams."""
    found = np.zeros((1 << BITS) + 1, np.int64)
    for points, first, _ in _pieces([text]):
        for b in _ngrams(points, -int(min(first[0], 0))):
            found += np.bincount(b, minlength=len(found))
    bucket = np.flatnonzero(found[:-1])
    return bucket, found[bucket]


def training_rows(docs: DataFrame, per_lang: int = PER_LANG, most_langs: int = MOST_LANGS) -> DataFrame:
    """(lang, h, text): about per_lang distinct texts of each of the most_langs most frequent languages, chosen by the texts' hashes h."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), held_out(F.col("doc_id"), FOLDS, FOLD).alias("kept"))
    rows = rows.where("not kept and lang is not null and text is not null").select("lang", F.xxhash64("text").alias("h"), "text")
    counts = rows.select("lang", "h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs)
    # most_langs rows of a name and a number
    near = rows.join(F.broadcast(counts), "lang").where(F.pmod(F.xxhash64("h", F.lit(SEED)), F.lit(1 << 30)) / (1 << 30) * F.col("n") < per_lang)
    return near.groupBy("lang", "h").agg(F.first("text").alias("text"))


def _descend(y: np.ndarray, has: list[np.ndarray], share: list[np.ndarray], classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, softmax, bias) after EPOCHS rounds over the texts in shuffled order, at a rate that falls to nothing."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, ((1 << BITS) + 1, DIM))
    softmax, bias = np.zeros((classes, DIM)), np.zeros(classes)
    steps, done = max(1, EPOCHS * len(y)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            rate = RATE * (1 - done / steps)
            done += 1
            mean = share[i] @ vectors[has[i]]
            off = _softmax(softmax @ mean + bias)
            off[y[i]] -= 1
            back = off @ softmax
            softmax -= rate * np.outer(off, mean)
            bias -= BIAS_RATE * rate * off
            # a bucket's gradient is as small as its share of a long text; steps are in proportion to the largest
            vectors[has[i]] -= VECTOR_RATE * rate * np.outer(share[i] / share[i].max(), back)
    vectors[-1] = 0
    return vectors, softmax, bias


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The temperature at which the right answers are likeliest, and the least score at which at most ERRORS of the answers are wrong."""
    if not len(y):
        return 1.0, 0.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 241))
    # half an answer of each kind more keeps the score below 1 where all are right
    loss = [float(-np.log(np.clip(_softmax(z / t)[np.arange(len(y)), y], 1e-12, 1)).sum() - 0.5 * np.log(np.clip(1 - _softmax(z / t).max(axis=1).mean(), 1e-12, 1))) for t in grid]
    t = float(grid[int(np.argmin(loss))])
    p = _softmax(z / t)
    best = np.argsort(-p.max(axis=1), kind="stable")
    wrong = np.cumsum(p.argmax(axis=1)[best] != y[best])
    fine = np.flatnonzero(wrong <= ERRORS * np.arange(1, len(y) + 1))
    return t, 1.0 if not len(fine) else 0.0 if fine[-1] == len(y) - 1 else float(p.max(axis=1)[best][fine[-1]])


def train(docs: DataFrame, per_lang: int = PER_LANG, most_langs: int = MOST_LANGS) -> LanguageModel:
    """Fit on the texts and non-null languages of docs outside the held-out fold. Without any, the model knows no language.

    Equal texts of a language teach once. Null ids are never held out. The result depends on the
    rows alone, not on their order.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_counts(t) for t in batch.column("text").to_pylist()]
            cols = [pa.array([x[k].astype(np.int32).tobytes() for x in found], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), *cols], ["lang", "h", "bucket", "n"])

    rows = settle(training_rows(docs, per_lang, most_langs).mapInArrow(features, "lang string, h long, bucket binary, n binary"), "languages")
    langs = tuple(sorted(r["lang"] for r in rows.where("length(bucket) > 0").select("lang").distinct().collect()))
    if not langs:
        return LanguageModel((), np.zeros(((1 << BITS) + 1, DIM)), np.zeros((0, DIM)), np.zeros(0), 1.0, 0.0)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = []
        for batch in batches:
            known += [(r["h"], r["lang"], np.frombuffer(r["bucket"], np.int32), np.frombuffer(r["n"], np.int32)) for r in batch.to_pylist() if r["bucket"]]
        known.sort(key=lambda r: r[:2])
        y = np.array([langs.index(r[1]) for r in known])
        has, share = [r[2] for r in known], [r[3] / r[3].sum() for r in known]
        # of each language every CALIBRATES-th text, in the order of their hashes
        place, seen = np.zeros(len(y), int), np.zeros(len(langs), int)
        for i, k in enumerate(y):
            place[i], seen[k] = seen[k], seen[k] + 1
        learns = np.flatnonzero(place % CALIBRATES != CALIBRATES - 1)
        checks = np.flatnonzero(place % CALIBRATES == CALIBRATES - 1)
        vectors, softmax, bias = _descend(y[learns], [has[i] for i in learns], [share[i] for i in learns], len(langs))
        z = np.array([softmax @ (share[i] @ vectors[has[i]]) + bias for i in checks]).reshape(len(checks), len(langs))
        t, least = _calibrated(z, y[checks])
        parts = [pa.array([x.astype(np.float64).tobytes()], pa.binary()) for x in (vectors, softmax, bias)]
        yield pa.RecordBatch.from_arrays([*parts, pa.array([t]), pa.array([least])], ["vectors", "softmax", "bias", "t", "least"])

    # a bounded number of texts, each as its buckets
    got = rows.coalesce(1).mapInArrow(fit, "vectors binary, softmax binary, bias binary, t double, least double").first()
    vectors, softmax = np.frombuffer(got["vectors"]).reshape(-1, DIM), np.frombuffer(got["softmax"]).reshape(len(langs), DIM)
    return LanguageModel(langs, vectors, softmax, np.frombuffer(got["bias"]), got["t"], got["least"])


def identify(docs: DataFrame, model: LanguageModel, reject: bool = True) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row of docs.

    lang_pred is UNKNOWN, with a score of 0, where a text is null or has no letter or the model
    knows no language, and, with `reject`, where the score is below the model's least one; without
    it such answers are kept and only marked as rejected. Null ids stay null; repeated rows give
    repeated results; other columns of docs are not looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        # with fewer languages than dimensions the logits add up as well as the vectors, at less cost
        folded = len(m.langs) < DIM
        columns = np.ascontiguousarray(m.softmax @ m.vectors.T if folded else m.vectors.T)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sums, n = _sums(texts, columns)
            means = (sums / np.maximum(n, 1)).T
            known = (n > 0) & (len(m.langs) > 0)
            lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if known.any():
                p = _softmax((means[known] + m.bias) / m.temperature) if folded else m.probabilities(means[known])
                lang[known], score[known] = np.array(m.langs, object)[p.argmax(axis=1)], p.max(axis=1)
            low = ~known | (score < m.least)
            lang = np.where(low & reject, UNKNOWN, lang)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(low)],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(rate, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
