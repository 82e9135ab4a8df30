"""Vectors as rows of integers: checked and scaled once, then read as matrices; exact sums over all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persisted

SCALE = 1024
#: Bytes of stored rows for one task of a pass.
TASK_BYTES = 64 << 20


def integer_vectors(rows: DataFrame, *, shift: int = 0, limit: int, dims: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id long, x array<int>) with x = floor(1024 * component as double) + shift, from -limit + shift to limit + shift.

    Dropped are null vectors, those with null, NaN or infinite entries, and, with dims, those of another length.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            lengths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null entry becomes NaN
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            ends = np.cumsum(np.maximum(lengths, 0))
            keep = (lengths >= 0) & (bad[ends] == bad[ends - np.maximum(lengths, 0)])
            if dims is not None:
                keep &= lengths == dims
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.clip(np.floor(flat[np.repeat(keep, np.maximum(lengths, 0))] * SCALE), -limit, limit)
            offsets = np.concatenate([[0], np.cumsum(lengths[keep])]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int64) + shift, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), values], ["vec_id", "x"])

    picked = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return picked.mapInArrow(work, "vec_id long, x array<int>")


def stored_rows(rows: DataFrame, total: int, width: int, purpose: str) -> DataFrame:
    """The rows written in files of about TASK_BYTES, at least as many as tasks run at a time; they outlive scratch()."""
    files = max(rows.sparkSession.sparkContext.defaultParallelism, -(-total * width // TASK_BYTES))
    return persisted(rows.coalesce(files), purpose, keep=True)


def matrix(lists: pa.ListArray, dims: int, fill: int) -> np.ndarray:
    """A row for each list, as longs; shorter lists are filled up."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) == len(lists) * dims:
        return flat.reshape(len(lists), dims)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.full((len(lists), dims), fill, np.int64)
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def summed(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], width: int, exact: bool = False) -> list:
    """The sum over all rows of what part() gives for a batch: `width` numbers, each task's added before the shuffle.

    exact: whole numbers that fit in 64 bits within a task and are added without a limit after that.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64 if exact else np.float64)
        for batch in batches:
            total += part(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], ["i", "v"])

    value = F.col("v").cast("decimal(38,0)") if exact else F.col("v")
    found = rows.mapInArrow(work, f"i int, v {'long' if exact else 'double'}").groupBy("i").agg(F.sum(value).alias("v")).collect()
    out = [0] * width
    for r in found:
        out[r["i"]] = int(r["v"]) if exact else r["v"]
    return out
