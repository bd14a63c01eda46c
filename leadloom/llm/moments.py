"""Sums of outer products over distributed rows: one small matrix a task, added by Spark.

A matrix travels as rows of ``BLOCK`` numbers, so that the sums of many tasks are
reduced before and after the shuffle and the driver gets one matrix for each key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.shared import in_arrow

BLOCK = 32
SCHEMA = "key int, i int, block int, " + ", ".join(f"s{k} double" for k in range(BLOCK))


def _rows(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for key, matrix in sums.items():
        height, width = matrix.shape
        blocks = -(-width // BLOCK)
        padded = np.zeros((height, blocks * BLOCK))
        padded[:, :width] = matrix
        flat = padded.reshape(height * blocks, BLOCK)
        lead = [np.full(len(flat), key, np.int32), np.repeat(np.arange(height, dtype=np.int32), blocks), np.tile(np.arange(blocks, dtype=np.int32), height)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in [*lead, *flat.T]], ["key", "i", "block", *(f"s{k}" for k in range(BLOCK))])


def matrices(rows: DataFrame, of: Callable[[pa.RecordBatch], Iterable[tuple[int, np.ndarray]]], width: int) -> dict[int, np.ndarray]:
    """The sum of the matrices ``of`` gives for each batch, by its whole-number key; all have ``width`` columns."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, matrix in of(batch):
                sums[key] = sums[key] + matrix if key in sums else matrix
        yield from _rows(sums)

    added = in_arrow(rows, run, SCHEMA).groupBy("key", "i", "block").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(BLOCK)))
    out: dict[int, dict[int, dict[int, list[float]]]] = {}
    for r in added.collect():
        out.setdefault(r["key"], {}).setdefault(r["i"], {})[r["block"]] = list(r[3:])
    return {
        key: np.array([np.concatenate([by[b] for b in sorted(by)])[:width] for _, by in sorted(matrix.items())]) for key, matrix in out.items()
    }


def doubles(column: pa.ListArray, width: int) -> np.ndarray:
    """Lists of ``width`` numbers as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def covariance(rows: DataFrame, column: str, width: int, n: int) -> np.ndarray:
    """The covariance (divisor ``n``) of lists of doubles, centred before they are multiplied."""
    if not width:
        return np.zeros((0, 0))
    mean = matrices(rows, lambda b: [(0, doubles(b.column(column), width).sum(axis=0, keepdims=True))], width)[0][0] / n

    def products(batch):
        c = doubles(batch.column(column), width) - mean
        return [(0, c.T @ c)]

    return matrices(rows, products, width)[0] / n
