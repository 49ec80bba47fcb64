"""Plain arrays in .npy, raw (.bin, .emc) and HDF5 files.

An array of the driver is read and written whole. A column is written and a file is scanned by tasks, each its own
range of the file, in a folder that all executors share; the driver sees headers only.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructField, StructType

from countlake.session import fresh_path
from countlake.sources import hdf5
from countlake.sources.paths import InnerPath, has_inner

RAW = (".bin", ".emc")
#: Elements that a task reads or writes at once.
BLOCK = 1 << 16


def read_array(path, /, *, dtype=np.float64) -> np.ndarray:
    """dtype is that of raw files; the others state their own."""
    if isinstance(path, InnerPath) or has_inner(path):
        return hdf5.read_array(path)
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    suffix = Path(path).suffix
    if suffix == ".npy":
        return np.load(path)
    if suffix in RAW:
        return np.fromfile(path, dtype)
    raise ValueError(f"{path}: the suffix is not .npy, .bin, .emc or .h5")


def write_array(path, array: np.ndarray, /, *, overwrite: bool = False, compression: str | None = None, compression_opts=None) -> None:
    if isinstance(path, InnerPath) or has_inner(path):
        hdf5.write_array(path, array, overwrite, compression, compression_opts)
        return
    suffix = Path(path).suffix
    if suffix not in (".npy", *RAW):
        raise ValueError(f"{path}: the suffix is not .npy, .bin, .emc or .h5")
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    np.save(path, array) if suffix == ".npy" else np.asarray(array).tofile(path)


def array_table(spark: SparkSession, array: np.ndarray) -> DataFrame:
    """(i0, i1, .., value): one row per element; the array goes through a file, not through the JVM of the driver."""
    path = fresh_path(spark, "array").removeprefix("file://") + ".npy"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    write_array(path, np.asarray(array))
    return scan_array(spark, path)


def scan_array(spark: SparkSession, path, /, *, dtype=np.float64) -> DataFrame:
    """(i0, i1, .., value) of a .npy or raw file, read by tasks; dtype is that of raw files."""
    path = os.fspath(path)
    suffix = Path(path).suffix
    if suffix not in (".npy", *RAW):
        raise ValueError(f"{path}: the suffix is not .npy, .bin or .emc")
    if not os.path.exists(path):
        raise FileNotFoundError(path)

    def view() -> np.ndarray:
        if suffix == ".npy":
            return np.load(path, mmap_mode="r")
        n = os.path.getsize(path) // np.dtype(dtype).itemsize
        return np.memmap(path, dtype, "r", shape=(n,)) if n else np.empty(0, dtype)

    shape, kind = view().shape, view().dtype.newbyteorder("=")
    n = int(np.prod(shape, dtype=np.int64))
    names = [*(f"i{k}" for k in range(len(shape))), "value"]

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = view()
        for batch in batches:
            for b in batch.column("id").to_pylist():
                index = np.unravel_index(np.arange(b * BLOCK, min((b + 1) * BLOCK, n)), shape) if shape else ()
                value = np.atleast_1d(array[index]).astype(kind, copy=False)
                yield pa.RecordBatch.from_arrays([*(pa.array(i.astype(np.int64)) for i in index), pa.array(value)], names=names)

    types = [*[pa.int64()] * len(shape), pa.array(np.empty(0, kind)).type]
    schema = StructType([StructField(c, from_arrow_type(t)) for c, t in zip(names, types)])
    blocks = -(-n // BLOCK)
    return spark.range(0, blocks, 1, max(1, min(blocks, spark.sparkContext.defaultParallelism * 4))).mapInArrow(elements, schema)


def write_column(path, rows: DataFrame, /, *, overwrite: bool = False) -> None:
    """One array of rows (pos, value), pos 0 .. n - 1, to a .npy or raw file by tasks; the type is that of the column."""
    path = os.fspath(path)
    suffix = Path(path).suffix
    if suffix not in (".npy", *RAW):
        raise ValueError(f"{path}: the suffix is not .npy, .bin or .emc")
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    kind = np.dtype({"double": "f8", "float": "f4", "bigint": "i8", "int": "i4", "smallint": "i2", "tinyint": "i1"}[dict(rows.dtypes)["value"]])
    n = rows.count()
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        if suffix == ".npy":
            np.lib.format.write_array_header_1_0(f, {"descr": np.lib.format.dtype_to_descr(kind), "fortran_order": False, "shape": (n,)})
        base = f.tell()
        f.truncate(base + n * kind.itemsize)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        with open(part, "r+b") as f:
            for batch in batches:
                done += batch.num_rows
                pos, value = np.asarray(batch.column("pos")), np.asarray(batch.column("value")).astype(kind)
                ends = np.nonzero(np.diff(pos) != 1)[0] + 1
                for a, b in zip([0, *ends], [*ends, len(pos)]):
                    if a < b:
                        f.seek(base + int(pos[a]) * kind.itemsize)
                        f.write(value[a:b].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["n"])

    blocks = rows.select("pos", "value").repartition(F.floor(F.col("pos") / F.lit(BLOCK))).sortWithinPartitions("pos")
    try:
        written = blocks.mapInArrow(store, "n long").agg(F.sum("n").alias("n")).first().n or 0
        if written != n:
            raise RuntimeError(f"{written} of {n} elements were written")
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)
