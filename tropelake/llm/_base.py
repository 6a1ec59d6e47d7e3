"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace wherever the project's data speaks of blanks.
BLANKS = " \t\n\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(column: Column) -> Column:
    """A label without outer blanks and case."""
    return F.lower(F.btrim(column, F.lit(BLANKS)))


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of ``df`` in the shared checkpoint folder, with the lineage cut.

    The folder is the session's ``spark.checkpoint.dir``.  Only where that is unset, and all tasks run in this process as in
    tests, a temporary folder is set; on a cluster its lack is an error, as other machines could not read such a folder.
    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` the files go when the rows are no longer referred to.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def vectors_of(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and float32 rows of the usable vectors: ``dim`` finite values, not all of them zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    start, length = offsets[:-1], np.diff(offsets)
    fits = (length == dim) & ~column.is_null().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(fits)
    if not len(at):
        return at, np.zeros((0, dim), np.float32)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    if len(at) == len(fits) and start[-1] - start[0] == dim * (len(at) - 1):
        rows = values[start[0] : start[0] + dim * len(at)].reshape(-1, dim)
    else:
        rows = values[start[at][:, None] + np.arange(dim)]
    good = np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)
    return at[good], rows[good]


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; the largest entry is taken out first, so that no square overflows."""
    wide = rows.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]
