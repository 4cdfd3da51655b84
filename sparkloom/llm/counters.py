"""Fixed-size arrays of counters, counted by every task and summed block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Counters that travel in one row.
BLOCK = 2048
SCHEMA = "model int, block int, counts binary"


def rows_of(total: np.ndarray) -> pd.DataFrame:
    """The blocks of total (model, counter) that hold any count."""
    blocks = total.reshape(len(total), -1, BLOCK)
    model, block = np.nonzero(blocks.any(axis=2))
    return pd.DataFrame({"model": model.astype(np.int32), "block": block.astype(np.int32), "counts": [blocks[m, b].tobytes() for m, b in zip(model, block, strict=True)]})


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of rows sorted by (model, block), one block in memory at a time."""
    key, total = None, None
    for pdf in batches:
        for model, block, counts in zip(pdf["model"], pdf["block"], pdf["counts"], strict=True):
            if (model, block) != key:
                if key is not None:
                    yield pd.DataFrame({"model": [key[0]], "block": [key[1]], "counts": [total.tobytes()]})
                key, total = (model, block), np.zeros(BLOCK, np.int64)
            total += np.frombuffer(counts, np.int64)
    if key is not None:
        yield pd.DataFrame({"model": [key[0]], "block": [key[1]], "counts": [total.tobytes()]})


def collected(rows: DataFrame, models: int, size: int) -> np.ndarray:
    """The sums (models, size) of all tasks' rows; the driver gets models * size counters at most."""
    sums = rows.repartition("model", "block").sortWithinPartitions("model", "block").mapInPandas(_summed, SCHEMA)
    out = np.zeros((models, size // BLOCK, BLOCK), np.int64)
    for r in sums.collect():
        out[r["model"], r["block"]] = np.frombuffer(r["counts"], np.int64)
    return out.reshape(models, size)
