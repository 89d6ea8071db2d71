"""Models as pandas UDFs: loaded once a worker, asked batch by batch, silent when they fail."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def per_worker(load: Callable[[], Callable[[Any], Any]], *inputs: Column, returns: str = "string", failed: Any = "") -> Column:
    """`load()` gives a model, a function of one input value (or a tuple of several); its result for each row.

    The model is loaded when a worker meets its first batch and kept for the rest of the task. A
    row that it fails on, or all if it can't be loaded, gets `failed`.
    """

    @F.pandas_udf(returns)
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        model = None
        for batch in batches:
            if model is None:
                try:
                    model = load()
                except Exception:
                    model = _fails
            yield pd.Series([_asked(model, row if len(row) > 1 else row[0], failed) for row in batch.itertuples(index=False, name=None)], dtype=object)

    return ask(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(inputs)]))


def _fails(_: Any) -> Any:
    raise RuntimeError("the model could not be loaded")


def _asked(model: Callable[[Any], Any], value: Any, failed: Any) -> Any:
    try:
        return model(value)
    except Exception:
        return failed


def encoder(load: Callable[[], Callable[[list[str]], Any]], text: Column, batch: int = 8) -> Column:
    """Vectors of length one by a model that takes lists of `batch` texts; it may not fail."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        model = load()
        for texts in batches:
            rows = [v for k in range(0, len(texts), batch) for v in model(texts.iloc[k : k + batch].tolist())]
            unit = [np.asarray(v, np.float64) / (np.linalg.norm(v) or 1.0) for v in rows]
            yield pd.Series([v.astype(np.float32) for v in unit], dtype=object)

    return encode(text)
