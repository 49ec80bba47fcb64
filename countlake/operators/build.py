"""Ways to make a PatternFrame, and ``patterns``, which picks one by the type of its argument."""

from __future__ import annotations

import os
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countlake.operators.frame import PatternFrame
from countlake.schema import ROWS, PatternMeta, SparsePattern
from countlake.sources.paths import InnerPath


def filled(spark: SparkSession, num_data: int, num_pix: int, value: int = 0) -> PatternFrame:
    """Every count is ``value`` (0, 1, or more; negative ones are refused)."""
    if value < 0 or num_data < 0 or num_pix < 0:
        raise ValueError("counts and shapes are not negative")
    empty = F.array().cast("array<int>")
    every = F.sequence(F.lit(0), F.lit(num_pix - 1)) if num_pix else empty
    counts = F.array_repeat(F.lit(value), num_pix).cast("array<int>")
    ids = spark.range(num_data).select(F.col("id").alias("pattern_id"))
    rows = ids.select("pattern_id", (every if value == 1 else empty).alias("place_ones"), (every if value > 1 else empty).alias("place_multi"), (counts if value > 1 else empty).alias("count_multi"))
    return PatternFrame(PatternMeta(num_data, num_pix), rows=rows)


def no_patterns(spark: SparkSession, num_pix: int) -> PatternFrame:
    return PatternFrame(PatternMeta(0, num_pix), rows=spark.createDataFrame([], ROWS))


def from_triplets(triplets: DataFrame, num_data: int, num_pix: int, dim: DataFrame | None = None) -> PatternFrame:
    """From (pattern_id, pixel_id, cnt): repeated coordinates are summed first, zeros then dropped.

    A negative sum and a null or coordinate outside the shape are errors when the frame is computed. ``dim``
    may give the pattern ids (0 .. num_data - 1) that exist, else all of them do.
    """
    at = (F.col("pattern_id") >= 0) & (F.col("pattern_id") < num_data) & (F.col("pixel_id") >= 0) & (F.col("pixel_id") < num_pix)
    checked = triplets.select(
        F.col("pattern_id").cast("long").alias("pattern_id"),
        F.col("pixel_id").cast("int").alias("pixel_id"),
        F.when(F.coalesce(at, F.lit(False)), F.col("cnt").cast("long")).otherwise(F.raise_error(F.lit("coordinate outside the matrix")).cast("long")).alias("cnt"),
    )
    sums = checked.groupBy("pattern_id", "pixel_id").agg(F.sum("cnt").alias("cnt"))
    sums = sums.where("cnt <> 0").withColumn("cnt", F.when(F.col("cnt") > 0, F.col("cnt")).otherwise(F.raise_error(F.lit("negative count")).cast("long")))
    return PatternFrame(PatternMeta(num_data, num_pix), entries=sums, dim=dim)


def from_dense_rows(dense: DataFrame, num_data: int, num_pix: int) -> PatternFrame:
    """From (pattern_id, values): one array of num_pix counts per pattern; shorter or longer ones are errors.

    A null value counts 0. A row's compact form depends on that row only, so nothing is shuffled.
    """
    fail = lambda text: F.raise_error(F.lit(text)).cast("array<int>")
    good = F.when(F.size("values") != num_pix, fail(f"a pattern needs {num_pix} values")).when(F.exists("values", lambda v: v < 0), fail("negative count")).otherwise(F.col("values").cast("array<int>"))
    rows = dense.select("pattern_id", good.alias("values"))
    place = lambda test: F.array_compact(F.transform("values", lambda v, i: F.when(test(v), i)))
    rows = rows.select("pattern_id", place(lambda v: v == 1).alias("place_ones"), place(lambda v: v > 1).alias("place_multi"), F.filter("values", lambda v: v > 1).alias("count_multi"))
    return PatternFrame(PatternMeta(num_data, num_pix), rows=rows)


def from_array(spark: SparkSession, array: np.ndarray) -> PatternFrame:
    """From a dense integer matrix on the driver."""
    array = np.asarray(array)
    if array.ndim != 2 or not (np.issubdtype(array.dtype, np.integer) or array.dtype == bool):
        raise ValueError("a matrix of integers is needed")
    if array.size and array.min() < 0:
        raise ValueError("negative count")
    n, p = array.shape
    i, j = np.nonzero(array)
    return from_rows(spark, _split(i, j, array[i, j].astype(np.int64), n), p)


def _split(i: np.ndarray, j: np.ndarray, v: np.ndarray, n: int) -> list[SparsePattern]:
    cuts = np.searchsorted(i, np.arange(n + 1))
    out = []
    for a, b in zip(cuts, cuts[1:]):
        one = v[a:b] == 1
        out.append(SparsePattern(0, j[a:b][one].tolist(), j[a:b][~one].tolist(), v[a:b][~one].tolist()))
    return out


def from_rows(spark: SparkSession, rows: Sequence[SparsePattern], num_pix: int | None = None) -> PatternFrame:
    """From sparse patterns on the driver; they must agree in num_pix unless it is given."""
    if num_pix is None:
        widths = {r.num_pix for r in rows}
        if len(widths) != 1:
            raise ValueError("patterns differ in their number of pixels, or there are none")
        num_pix = widths.pop()
    lists = lambda k: pa.array([list(map(int, r[k])) for r in rows], pa.list_(pa.int32()))
    table = pa.table({"pattern_id": pa.array(range(len(rows)), pa.int64()), "place_ones": lists(1), "place_multi": lists(2), "count_multi": lists(3)})
    return PatternFrame(PatternMeta(len(rows), num_pix), rows=spark.createDataFrame(table))


def from_coo(spark: SparkSession, coo) -> PatternFrame:
    """From any sparse matrix with ``tocoo``; repeated coordinates are summed."""
    coo = coo.tocoo()
    table = pa.table({"pattern_id": pa.array(np.asarray(coo.row, np.int64)), "pixel_id": pa.array(np.asarray(coo.col, np.int32)), "cnt": pa.array(np.asarray(coo.data, np.int64))})
    return from_triplets(spark.createDataFrame(table), *map(int, coo.shape))


def patterns(spark: SparkSession, src, /, *, start: int | None = None, end: int | None = None) -> PatternFrame:
    """A PatternFrame from bytes of a count file, a path (or glob, or list of paths), another frame, a
    number of pixels, ((n, p), value), a dense integer array, a sparse matrix, or a list of sparse patterns.

    start and end select patterns by Python's slice rules, whatever the source.
    """
    from countlake.sources.countsource import parse_image, read_counts

    if isinstance(src, PatternFrame):
        out = src
    elif isinstance(src, (bytes, bytearray, memoryview)) or hasattr(src, "getvalue"):
        out = parse_image(spark, src.getvalue() if hasattr(src, "getvalue") else bytes(src))
    elif isinstance(src, (str, os.PathLike, InnerPath)):
        out = read_counts(spark, src)
    elif isinstance(src, (int, np.integer)) and not isinstance(src, bool):
        out = no_patterns(spark, int(src))
    elif isinstance(src, tuple) and len(src) == 2 and isinstance(src[0], tuple):
        (n, p), value = src
        out = filled(spark, n, p, value)
    elif isinstance(src, np.ndarray):
        out = from_array(spark, src)
    elif hasattr(src, "tocoo"):
        out = from_coo(spark, src)
    elif isinstance(src, list) and src and all(isinstance(r, SparsePattern) for r in src):
        out = from_rows(spark, src)
    elif isinstance(src, list) and src and all(isinstance(r, (str, os.PathLike, InnerPath)) for r in src):
        out = read_counts(spark, src)
    else:
        raise TypeError(f"no patterns can be made from {type(src).__name__}")
    return out if start is None and end is None else out.slice(start, end)
