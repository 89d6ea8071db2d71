"""Runs of rows, taken greedily by their lengths, for sequences of any size.

What a run takes depends on all before it in its document, so one worker would have to hold the
document. Here the rows are cut into blocks that know nothing of each other. A block first tells,
for every length that an open run may have when it reaches the block, which run is open behind it;
these are few, as runs from different places soon begin at the same rows. One pass over the
blocks' answers, a short row each, gives the run that reaches each block, and blocks then mark
their own rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 100_000
_LOW = (1 << 33) - 1
_ANSWER = "part long, b long, first_doc string, last_doc string, low array<long>, start array<long>, length array<long>"
_REACH = "part long, b long, doc string, start long, length long"


class _Block:
    """Rows in order: their lengths, and which of them open a run in any case."""

    def __init__(self, pdf: pd.DataFrame, limit: int, hard: int) -> None:
        pdf = pdf.sort_values("at")
        self.at, self.doc, self.limit, self.hard = pdf["at"].to_numpy(), pdf["doc"].to_numpy(), limit, hard
        self.n, self.each = len(self.at), pdf["n"].to_numpy().astype("int64")
        self.sums = np.concatenate([[0], np.cumsum(self.each + 2)])
        opens = pdf["opens"].to_numpy().astype(bool)
        opens[1:] |= self.doc[1:] != self.doc[:-1]
        #: the first row from each one on that opens a run
        self.opener = np.minimum.accumulate(np.where(opens, np.arange(self.n), self.n)[::-1])[::-1]
        s = np.arange(self.n)
        self.next = np.minimum(np.append(self.opener, self.n)[s + 1], self._full(self.sums[:-1] + 2, s + 1))

    def _full(self, base: np.ndarray, least: np.ndarray | int) -> np.ndarray:
        """The first row that a run doesn't take, by lengths, if the sums are `base` above what it holds."""
        enough = np.searchsorted(self.sums, self.limit + base, "left")
        over = np.searchsorted(self.sums, self.hard + base, "right") - 1
        return np.maximum(np.minimum(np.minimum(enough, over), self.n), least)

    def taken(self, lengths: np.ndarray) -> np.ndarray:
        """How many of the block's rows open runs of these lengths take."""
        return np.minimum(self.opener[0], self._full(-lengths, 0))

    def answer(self) -> tuple[list[int], list[int], list[int]]:
        """By ranges of the open run's length (from `low` on; the last range: no run reaches the block) the run that is
        open behind it: where it starts and how long it is, or -1 and what the open run takes."""
        last = np.arange(self.n)
        for i in range(self.n - 1, -1, -1):
            if self.next[i] < self.n:
                last[i] = last[self.next[i]]
        lengths = np.arange(1, self.limit + 1)
        to = self.taken(lengths)
        to[-1] = 0
        start = np.where(to < self.n, last[np.minimum(to, self.n - 1)], -1)
        keep = np.append(True, start[1:] != start[:-1])
        keep[-1] = True
        start = start[keep]
        length = np.where(start < 0, self.sums[-1], self.sums[-1] - self.sums[start] - 2)
        return lengths[keep].tolist(), np.where(start < 0, -1, self.at[start]).tolist(), length.tolist()

    def starts(self, reached: tuple[str, int, int] | None) -> np.ndarray:
        """Each row's run, by the `at` of its first row."""
        out = np.full(self.n, -1, "int64")
        i = 0
        if reached is not None and reached[0] == self.doc[0]:
            i = int(self.taken(np.array([reached[2]]))[0])
            out[:i] = reached[1]
        while i < self.n:
            to = int(self.next[i])
            out[i:to] = self.at[i]
            i = to
        return out


def runs(rows: DataFrame, limit: int, hard: int, block: int = BLOCK) -> DataFrame:
    """(doc, at, n, run) of rows (doc, at, n, opens): the `at` of the first row of the run that each row is in.

    A run takes the next row of its document if the row doesn't open one, the run is shorter than
    `limit`, and both together, with two characters between them, are not over `hard`. `at` is
    unique, orders the rows, and is made of a partition number above a row number of 33 bits, as
    monotonically_increasing_id() makes it; `n` is at least 1, no column is null. The rows are read
    twice, so they should be a table. One task reads a short row for each block of `block` rows.
    """
    cut = rows.select(F.expr("shiftright(at, 33)").alias("part"), F.expr(f"(at & {_LOW}) div {block}").alias("b"), "doc", "at", "n", "opens")

    def answer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = _Block(pdf, limit, hard)
        return pd.DataFrame([(*key, x.doc[0], x.doc[-1], *x.answer())], columns=["part", "b", "first_doc", "last_doc", "low", "start", "length"])

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, start, length = None, -1, 0
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                out.append((r.part, r.b, doc, start, length))
                i = bisect_right(list(r.low), length) - 1 if r.first_doc == doc else len(r.low) - 1
                went_on = r.start[i] < 0
                doc, start, length = r.last_doc, start if went_on else r.start[i], (length if went_on else 0) + r.length[i]
            yield pd.DataFrame(out, columns=["part", "b", "doc", "start", "length"])

    def mark(pdf: pd.DataFrame, reached: pd.DataFrame) -> pd.DataFrame:
        x = _Block(pdf, limit, hard)
        r = next(reached.itertuples(index=False))
        return pd.DataFrame({"doc": x.doc, "at": x.at, "n": x.each, "run": x.starts((r.doc, r.start, r.length) if r.doc is not None else None)})

    answers = cut.groupBy("part", "b").applyInPandas(answer, _ANSWER)
    reached = answers.repartition(1).sortWithinPartitions("part", "b").mapInPandas(reach, _REACH)
    return cut.groupBy("part", "b").cogroup(reached.groupBy("part", "b")).applyInPandas(mark, "doc string, at long, n long, run long")
