"""Vectors as rows of a table: which ones take part, and packing them for Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship


def vectors_of(df: DataFrame, *columns: str) -> DataFrame:
    """vec_id, v (array<double>) and the named columns, of the rows whose vector has components and only finite ones."""
    ship(df.sparkSession)
    v = df["embedding"].cast("array<double>")
    rows = df.select(df["vec_id"].cast("long").alias("vec_id"), v.alias("v"), *[df[c] for c in columns])
    return rows.where(finite("v"))


def finite(name: str) -> Column:
    return F.expr(f"{name} is not null and size({name}) > 0 and forall({name}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")


def matrices(batch: pa.RecordBatch, column: int):
    """(rows, matrix) of the vectors of each length in a batch."""
    arrays = batch.column(column)
    flat = arrays.flatten().to_numpy(zero_copy_only=False)
    offsets = arrays.offsets.to_numpy()
    start, size = offsets[:-1] - offsets[0], np.diff(offsets)
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        yield rows, flat[start[rows][:, None] + np.arange(n)]
