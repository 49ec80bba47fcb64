"""Spark data source "countfile": scan and export of binary count files.

Scan: one scan reads a list of files as one matrix. A manifest holds each file's number of patterns (headers of many
files are read by tasks), so pattern_id runs through all of them. The driver picks the files that a selection
touches and packs them into partitions of about equal bytes; it opens none of them but those larger than a partition, whose row
lengths (8 bytes a pattern) it needs to cut them. A task opens each of its files once, seeks to the ranges it
needs and yields Arrow batches. Comparisons and lists of ids on pattern_id are pushed. The option ``columns`` leaves
out sections ("ones,multi" touches only the row lengths).

Export: sections lie one after the other, so tasks cannot append. The offsets of every block of patterns are
known beforehand from prefix sums; each task writes its blocks' five regions into a file of final size, which
is renamed when all are done. Regions are disjoint and fixed, so a repeated task writes the same bytes.
"""

from __future__ import annotations

import glob
import json
import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from countlake.operators.frame import PatternFrame, concat_rows
from countlake.schema import PatternMeta
from countlake.session import fresh_path
from countlake.sources import countfile, hdf5
from countlake.sources.countfile import HEADER_BYTES, ITEM, DamagedFile
from countlake.sources.paths import InnerPath, has_inner, inner_path

COLUMNS = {"ones": "int", "multi": "int", "place_ones": "array<int>", "place_multi": "array<int>", "count_multi": "array<int>"}
#: Bytes of sections a scan partition has at most, unless one pattern alone has more.
PARTITION_BYTES = 64 << 20
BATCH_ROWS = 8192
#: Headers of up to so many files are read by the driver.
DRIVER_HEADERS = 64


def read_header(path: str) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(num_data, num_pix, ones, multi) of a file whose size has been checked."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        head = f.read(8)
        if len(head) < 8:
            raise DamagedFile(f"{path}: shorter than a header")
        n, num_pix = (int(x) for x in np.frombuffer(head, ITEM))
        if n < 0 or num_pix < 0 or size < countfile.expected_size(n, 0, 0):
            raise DamagedFile(f"{path}: header and size disagree")
        f.seek(HEADER_BYTES)
        lengths = np.fromfile(f, ITEM, 2 * n)
    ones, multi = lengths[:n], lengths[n:]
    if n and lengths.min() < 0 or size != countfile.expected_size(n, int(ones.sum(dtype=np.int64)), int(multi.sum(dtype=np.int64))):
        raise DamagedFile(f"{path}: size is not what the row lengths demand")
    return n, num_pix, ones, multi


def _head(path: str) -> tuple[int, int, int]:
    """(num_data, num_pix, bytes) as the header and the file system say."""
    with open(path, "rb") as f:
        head = f.read(8)
    if len(head) < 8 or min(np.frombuffer(head, ITEM)) < 0:
        raise DamagedFile(f"{path}: no header")
    n, num_pix = (int(x) for x in np.frombuffer(head, ITEM))
    return n, num_pix, os.path.getsize(path)


@dataclass
class Piece:
    """Patterns first .. past - 1 of a file, or those of ``rows``; start is the pattern_id of the file's first one."""

    path: str
    start: int
    first: int
    past: int
    rows: tuple[int, ...] | None = None


@dataclass
class Pieces(InputPartition):
    pieces: list[Piece]


class CountFileReader(DataSourceReader):
    """files: (path, num_data, bytes) in order."""

    def __init__(self, files: list[tuple[str, int, int]], columns: list[str], partition_bytes: int):
        self.files, self.columns, self.partition_bytes = files, columns, partition_bytes
        self.starts = np.r_[0, np.cumsum([n for _, n, _ in files], dtype=np.int64)]
        self.low, self.high, self.ids = 0, None, None

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) == ("pattern_id",):
                v = getattr(f, "value", None)
                if isinstance(f, In) and all(isinstance(x, int) for x in v):
                    self.ids = set(v) if self.ids is None else self.ids & set(v)
                    continue
                if isinstance(v, int) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                    if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                        self.low = max(self.low, v + isinstance(f, GreaterThan))
                    if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                        past = v + (not isinstance(f, LessThan))
                        self.high = past if self.high is None else min(self.high, past)
                    continue
            yield f

    def _pieces(self) -> Iterator[tuple[Piece, int]]:
        """What the selection touches, file by file, and about how many bytes it is."""
        total = int(self.starts[-1])
        low, high = max(0, self.low), total if self.high is None else max(0, min(self.high, total))
        if self.ids is not None:
            ids = np.array(sorted(i for i in self.ids if low <= i < high), np.int64)
            owner = np.searchsorted(self.starts, ids, "right") - 1
            for k in np.unique(owner):
                path, n, size = self.files[k]
                rows = ids[owner == k] - self.starts[k]
                yield Piece(path, int(self.starts[k]), int(rows[0]), int(rows[-1]) + 1, tuple(rows.tolist())), 8 * n + size * len(rows) // max(n, 1)
            return
        first, last = np.searchsorted(self.starts, low, "right") - 1, np.searchsorted(self.starts, high, "left")
        for k in range(max(int(first), 0), min(int(last), len(self.files))):
            path, n, size = self.files[k]
            start = int(self.starts[k])
            a, b = max(low - start, 0), min(high - start, n)
            if a >= b:
                continue
            if size <= self.partition_bytes:
                yield Piece(path, start, a, b), 8 * n + size * (b - a) // n
                continue
            _, _, ones, multi = read_header(path)
            weight = np.r_[0, np.cumsum(8 + 4 * ones.astype(np.int64) + 8 * multi.astype(np.int64))]
            while a < b:
                past = int(np.searchsorted(weight, weight[a] + self.partition_bytes, "right")) - 1
                past = min(b, max(a + 1, past))
                yield Piece(path, start, a, past), int(weight[past] - weight[a])
                a = past

    def partitions(self) -> Sequence[Pieces]:
        out, held, size = [], [], 0
        for piece, weight in self._pieces():
            if held and size + weight > self.partition_bytes:
                out.append(Pieces(held))
                held, size = [], 0
            held.append(piece)
            size += weight
        return [*out, Pieces(held)] if held or not out else out

    def read(self, part: Pieces) -> Iterator[pa.RecordBatch]:
        for piece in part.pieces:
            yield from self._read(piece)

    def _read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        with open(piece.path, "rb") as f:

            def items(at: int, count: int) -> np.ndarray:
                f.seek(at)
                return np.fromfile(f, ITEM, count)

            n = int(items(0, 1)[0])
            if set(self.columns) <= {"ones", "multi"}:
                lengths = None
                s1 = sm = 0
            else:
                lengths = items(HEADER_BYTES, 2 * n)
                s1, sm = int(lengths[:n].sum(dtype=np.int64)), int(lengths[n:].sum(dtype=np.int64))
                if len(lengths) != 2 * n or n and lengths.min() < 0 or os.fstat(f.fileno()).st_size != countfile.expected_size(n, s1, sm):
                    raise DamagedFile(f"{piece.path}: size is not what the row lengths demand")
                o, m = np.r_[0, np.cumsum(lengths[:n], dtype=np.int64)], np.r_[0, np.cumsum(lengths[n:], dtype=np.int64)]
            base = HEADER_BYTES + 8 * n
            rows = np.arange(piece.first, piece.past) if piece.rows is None else np.asarray(piece.rows)
            # runs of successive patterns are read at once
            for run in np.split(rows, np.nonzero(np.diff(rows) != 1)[0] + 1):
                for a in range(int(run[0]), int(run[-1]) + 1, BATCH_ROWS):
                    b = min(a + BATCH_ROWS, int(run[-1]) + 1)
                    if lengths is None:
                        ones, multi = items(HEADER_BYTES + 4 * a, b - a), items(HEADER_BYTES + 4 * (n + a), b - a)
                        made = {"ones": pa.array(ones), "multi": pa.array(multi)}
                    else:
                        ragged = lambda ends, at: pa.ListArray.from_arrays(pa.array((ends[a : b + 1] - ends[a]).astype(np.int32)), pa.array(items(base + 4 * (at + int(ends[a])), int(ends[b] - ends[a]))))  # noqa: B023, E731
                        sections = {"place_ones": (o, 0), "place_multi": (m, s1), "count_multi": (m, s1 + sm)}
                        made = {c: ragged(*sections[c]) for c in self.columns if c in sections} | {"ones": pa.array(lengths[a:b]), "multi": pa.array(lengths[n + a : n + b])}
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(piece.start + a, piece.start + b)), *(made[c] for c in self.columns)], names=["pattern_id", *self.columns])


class CountFileSource(DataSource):
    """spark.read.format("countfile").option("columns", "place_ones,...").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "countfile"

    def _columns(self) -> list[str]:
        asked = [c.strip() for c in self.options.get("columns", "place_ones,place_multi,count_multi").split(",") if c.strip()]
        if unknown := set(asked) - set(COLUMNS):
            raise ValueError(f"no such section: {sorted(unknown)}")
        return asked

    def schema(self) -> str:
        return ", ".join(["pattern_id long", *(f"{c} {COLUMNS[c]}" for c in self._columns())])

    def reader(self, schema) -> CountFileReader:
        if "manifest" in self.options:
            with open(self.options["manifest"]) as f:
                files = [tuple(x) for x in json.load(f)]
        else:
            path = self.options["path"].removeprefix("file://")
            n, _, size = _head(path)
            files = [(path, n, size)]
        return CountFileReader(files, self._columns(), int(self.options.get("partitionBytes", PARTITION_BYTES)))


def scan(spark: SparkSession, path: str | list[tuple[str, int, int]], columns: str | None = None) -> DataFrame:
    """One scan of a file, or of a list of files (path, num_data, bytes) as one matrix."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CountFileSource)
    reader = spark.read.format("countfile")
    reader = reader.option("columns", columns) if columns else reader
    if isinstance(path, str):
        return reader.load(path)
    at = fresh_path(spark, "manifest").removeprefix("file://") + ".json"
    os.makedirs(os.path.dirname(at), exist_ok=True)
    with open(at, "w") as f:
        json.dump(path, f)
    return reader.option("manifest", at).load()


def manifest(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int, int]]:
    """(path, num_data, num_pix, bytes) of files in order; headers of many files are read by tasks."""
    if len(paths) <= DRIVER_HEADERS:
        return [(p, *_head(p)) for p in paths]

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*(_head(p) for p in batch.column("path").to_pylist()))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in cols)], names=["at", "path", "n", "p", "size"])

    table = pa.table({"at": pa.array(range(len(paths)), pa.int64()), "path": pa.array(paths)})
    rows = spark.createDataFrame(table).repartition(max(1, len(paths) // 1000)).mapInArrow(heads, "at long, path string, n long, p long, size long").orderBy("at").collect()
    return [(r.path, r.n, r.p, r.size) for r in rows]


def _from_sections(spark: SparkSession, num_pix: int, sections: list[np.ndarray]) -> PatternFrame:
    ones, multi, po, pm, cm = (np.asarray(s, np.int32) for s in sections)
    ragged = lambda sizes, flat: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat))
    table = pa.table({"pattern_id": pa.array(np.arange(len(ones))), "place_ones": ragged(ones, po), "place_multi": ragged(multi, pm), "count_multi": ragged(multi, cm)})
    return PatternFrame(PatternMeta(len(ones), num_pix), rows=spark.createDataFrame(table))


def parse_image(spark: SparkSession, data: bytes) -> PatternFrame:
    """A count file held in memory."""
    f = countfile.parse(data)
    return _from_sections(spark, f.num_pix, [f.ones, f.multi, f.place_ones, f.place_multi, f.count_multi])


def _read_one(spark: SparkSession, path) -> PatternFrame:
    if isinstance(path, InnerPath) or has_inner(path):
        num_pix, sections = hdf5.read_pattern_arrays(path)
        return _from_sections(spark, num_pix, sections)
    return _scanned(spark, [os.fspath(path)])


def _scanned(spark: SparkSession, paths: list[str], num_data: int | None = None, num_pix: int | None = None) -> PatternFrame:
    if num_data is not None and num_pix is not None and len(paths) == 1:
        return PatternFrame.scanned(PatternMeta(num_data, num_pix), scan(spark, paths[0]))
    files = manifest(spark, paths)
    if len({p for _, _, p, _ in files}) > 1:
        raise ValueError("files differ in their number of pixels")
    if len(files) == 1:
        read_header(paths[0])  # a damaged file is found at once
    return PatternFrame.scanned(PatternMeta(sum(n for _, n, _, _ in files), files[0][2]), scan(spark, paths[0] if len(files) == 1 else [(p, n, size) for p, n, _, size in files]))


def read_counts(spark: SparkSession, src, num_data: int | None = None, num_pix: int | None = None) -> PatternFrame:
    """A file, a glob (members in sorted order) or a list of files as one frame; the format is told from
    the content. Globs may name inner groups as ``*.h5::group``.

    Binary files of a list are one scan, which opens only those that a selection touches. With num_data and num_pix
    given, the header of a single file is not read beforehand.
    """
    if isinstance(src, (list, tuple)):
        members = list(src)
    elif isinstance(src, (str, os.PathLike)) and any(c in os.fspath(src) for c in "*?["):
        pattern, sep, name = os.fspath(src).partition("::")
        members = [inner_path(m, name) if sep else m for m in sorted(glob.glob(pattern))]
    elif num_data is not None and num_pix is not None:
        return _scanned(spark, [os.fspath(src)], num_data, num_pix)
    else:
        return _read_one(spark, src)
    if not members:
        raise ValueError("Empty pattern list")
    if not any(isinstance(m, InnerPath) or os.fspath(m).endswith(".h5") or "::" in os.fspath(m) for m in members):
        return _scanned(spark, [os.fspath(m) for m in members])
    return concat_rows([_read_one(spark, m) for m in members])


def to_image(frame: PatternFrame) -> bytes:
    """The count file of a frame as bytes on the driver; for small ones."""
    return countfile.assemble(frame.num_pix, _sections(frame))


def _sections(frame: PatternFrame) -> list[np.ndarray]:
    t = frame.rows.orderBy("pattern_id").toArrow()
    size = lambda c: np.asarray(pc.list_value_length(t[c])).astype(np.int32)
    flat = lambda c: np.asarray(pc.list_flatten(t[c])).astype(np.int32)
    return [size("place_ones"), size("place_multi"), flat("place_ones"), flat("place_multi"), flat("count_multi")]


def write_counts(frame: PatternFrame, path, *, version: str = "2", overwrite: bool = False, compression: str | None = None, block: int = 8192) -> None:
    """Write a frame as .emc/.bin (distributed), HDF5 (driver, needs h5py) or into a binary stream.

    A distributed export needs a folder that all executors share.
    """
    if hasattr(path, "write"):
        path.write(to_image(frame))
        return
    if isinstance(path, InnerPath) or has_inner(path):
        hdf5.write_pattern_arrays(path, frame.num_pix, _sections(frame), version, overwrite, compression)
        return
    path = os.fspath(path)
    if Path(path).suffix not in (".emc", ".bin"):
        raise ValueError(f"{path}: the suffix is not .emc, .bin or .h5")
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    part = f"{path}.{uuid.uuid4().hex}.part"
    s = frame.sizes().first()
    with open(part, "wb") as f:
        f.write(countfile.header(s.num_data, frame.num_pix))
        f.truncate(countfile.expected_size(s.num_data, s.s1, s.sm))
    n, s1, sm = s.num_data, s.s1, s.sm

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        with open(part, "r+b") as f:
            for batch in batches:
                done += batch.num_rows
                ids = np.asarray(batch.column("pattern_id"))
                ends = np.nonzero(np.diff(ids) != 1)[0] + 1
                for a, b in zip([0, *ends], [*ends, len(ids)]):
                    if a == b:
                        continue
                    run = batch.slice(a, b - a)
                    o, m = run.column("ones_at")[0].as_py(), run.column("multi_at")[0].as_py()
                    po, pm, cm = (run.column(c) for c in ("place_ones", "place_multi", "count_multi"))
                    base = HEADER_BYTES + 8 * n
                    for at, x in (
                        (HEADER_BYTES + 4 * ids[a], po.value_lengths()), (HEADER_BYTES + 4 * (n + ids[a]), pm.value_lengths()),
                        (base + 4 * o, po.flatten()), (base + 4 * (s1 + m), pm.flatten()), (base + 4 * (s1 + sm + m), cm.flatten()),
                    ):
                        f.seek(int(at))
                        f.write(np.asarray(x).astype(ITEM).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["n"])

    rows = frame.rows.join(frame.offsets(), "pattern_id").withColumn("block", F.floor(F.col("pattern_id") / F.lit(block)))
    rows = rows.repartition("block").sortWithinPartitions("pattern_id").drop("block")
    try:
        written = rows.mapInArrow(store, "n long").agg(F.sum("n").alias("n")).first().n or 0
        if written != n:
            raise RuntimeError(f"{written} of {n} patterns were written")
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)
