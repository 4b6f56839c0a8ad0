"""What the operators of this folder share: cutting lineage, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..lineage import cut, discard, shared_dir
from ..operators.components import components
from ..workers import python_ready

__all__ = ["chars_before", "components", "cut", "discard", "documents", "fresh", "local_roots", "python_ready", "shared_dir", "slices", "string_array", "texts_of"]


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """A table of the input folder. Vectored Parquet reads are off: they keep a direct buffer of a
    column chunk's size for each reading thread, outside the heap."""
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while stem.lower() in have:
        stem += "_"
    return stem


def texts_of(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and len + 1 offsets into them; a null is empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = array.cast(pa.large_string()).fill_null("")
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64, len(array) + 1, array.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def string_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string column over ready bytes and offsets, without a copy of them."""
    return pa.LargeStringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))
    )


def chars_before(data: np.ndarray) -> np.ndarray:
    """Code points that begin before each byte place (one more entry than bytes)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows [i, j) of at most so many bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def local_roots(groups: np.ndarray, members: np.ndarray, n: int) -> np.ndarray:
    """Smallest member reachable for each of n members; two are linked if a group holds both.

    groups: ascending group numbers; members: who is in them. Label passing with pointer jumping.
    """
    label = np.arange(n)
    if not len(groups):
        return label
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[starts, len(groups)])
    while True:
        least = np.repeat(np.minimum.reduceat(label[members], starts), sizes)
        new = label.copy()
        np.minimum.at(new, members, least)
        np.minimum.at(new, label[members], least)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new
