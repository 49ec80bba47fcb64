"""Checkpointed streaming compaction of many tiny count files into few of good size.

The catalogue of files is read as a stream: the checkpoint remembers which of its parts have been
seen, each available part is processed in one micro-batch, and a batch writes its records under its
own number, replacing whatever an interrupted attempt left there. The records then carry where they
came from, so a record delivered twice, in whatever batches, is kept once: that of the smallest file_id.

``compact`` writes the new files of the lists that batches since its last run have touched, under the number of the
last batch as their version; a list's files are those of its latest version. Lists without news are not read again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countlake.session import cut, fresh_path, small, stream_path
from countlake.sources.countfile import DamagedFile, assemble, parse

RECORD = "list_id long, exposure_no long, file_id long, row_no long, num_pix int, place_ones array<int>, place_multi array<int>, count_multi array<int>"
FILE = "list_id long, num_pix int, part_no long, num_data long, nbytes long, exposure_nos array<bigint>, payload binary"
#: Bytes a compacted file should have at most; a group being assembled is about as large in memory.
TARGET_BYTES = 64 << 20


def _lists(values: list[np.ndarray], sizes: np.ndarray) -> pa.Array:
    flat = np.concatenate(values) if values else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat.astype(np.int32)))


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        file_ids, list_ids = batch.column("file_id").to_pylist(), batch.column("list_id").to_pylist()
        exposures, payloads = batch.column("exposure_nos"), batch.column("payload")
        keys, parts, sizes = [], ([], [], []), ([], [])
        for i in range(batch.num_rows):
            try:
                f = parse(payloads[i].as_buffer() if payloads[i].is_valid else None)
            except DamagedFile:
                continue
            if not f.num_data:
                continue
            names = exposures[i].as_py() or []
            names = (names + [None] * f.num_data)[: f.num_data]
            keys += [(list_ids[i], x, file_ids[i], r, f.num_pix) for r, x in enumerate(names)]
            sizes[0].append(f.ones)
            sizes[1].append(f.multi)
            for to, part in zip(parts, (f.place_ones, f.place_multi, f.count_multi)):
                to.append(part)
        if not keys:
            continue
        ones, multi = np.concatenate(sizes[0]), np.concatenate(sizes[1])
        cols = list(zip(*keys))
        out = [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.int32()])]
        out += [_lists(parts[0], ones), _lists(parts[1], multi), _lists(parts[2], multi)]
        yield pa.RecordBatch.from_arrays(out, names=["list_id", "exposure_no", "file_id", "row_no", "num_pix", "place_ones", "place_multi", "count_multi"])


def decode_files(files: DataFrame) -> DataFrame:
    """One row per record of every readable file, with the file and 0-based row it comes from.

    The payload alone decides: damaged ones, null ones and files without rows give nothing, the
    catalogue's num_data is ignored. A record without an exposure number (null, or the file names
    fewer than it has rows) cannot be told from others and is left out, as are files without an id or list.
    """
    cols = [F.col("file_id").cast("long").alias("file_id"), F.col("list_id").cast("long").alias("list_id"), F.col("exposure_nos").cast("array<bigint>").alias("exposure_nos"), F.col("payload").cast("binary").alias("payload")]
    rows = files.select(*cols).where("file_id is not null and list_id is not null")
    return rows.mapInArrow(_decode, RECORD).where("exposure_no is not null")


@dataclass
class StreamingCompactor:
    """source: path of the catalogue table. state: folder of checkpoint and records; a run with the
    same state takes up where the last one ended. max_batch_bytes bounds a micro-batch's input."""

    spark: SparkSession
    source: str
    state: str
    max_batch_bytes: int = 1 << 30

    @classmethod
    def fresh(cls, spark: SparkSession, source: str, **kw) -> StreamingCompactor:
        return cls(spark, source, fresh_path(spark, "compact"), **kw)

    def _process(self, batch: DataFrame, batch_id: int) -> None:
        # a catalogue row that is repeated within the batch is decoded once; of differing ones that with the smallest hash,
        # so that a retry takes the same
        first = batch.groupBy("file_id", "list_id").agg(F.min(F.struct(F.xxhash64("payload", "exposure_nos").alias("h"), "payload", "exposure_nos")).alias("f"))
        decode_files(first.select("file_id", "list_id", "f.exposure_nos", "f.payload")).write.mode("overwrite").parquet(f"{self.state}/records/batch={batch_id:09d}")

    def advance(self) -> StreamingCompactor:
        """Process everything that is available and not yet processed."""
        schema = self.spark.read.parquet(self.source).schema
        stream = self.spark.readStream.schema(schema).option("maxBytesPerTrigger", str(self.max_batch_bytes)).parquet(stream_path(self.spark, self.source))
        query = stream.select("file_id", "list_id", "exposure_nos", "payload").writeStream.foreachBatch(self._process).option("checkpointLocation", f"{self.state}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return self

    def _numbers(self, folder: str, label: str) -> list[int]:
        """The numbers of a folder's finished parts, label=number each."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.state}/{folder}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        parts = [s.getPath() for s in fs.listStatus(path)]
        done = lambda p: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(int(p.getName().split("=")[1]) for p in parts if p.getName().startswith(f"{label}=") and done(p))

    def records(self) -> DataFrame:
        """All deliveries of records so far; a file seen by two batches has them twice."""
        if not self._numbers("records", "batch"):
            return self.spark.createDataFrame([], RECORD)
        return self.spark.read.schema(RECORD).parquet(f"{self.state}/records/batch=*")

    def compact(self, target_bytes: int = TARGET_BYTES) -> StreamingCompactor:
        """Write the files of all lists that have news. An interrupted run leaves no finished version and is done again
        under the same number."""
        batches, versions = self._numbers("records", "batch"), self._numbers("files", "version")
        news = [b for b in batches if not versions or b > versions[-1]]
        if news:
            fresh = self.spark.read.schema(RECORD).parquet(*(f"{self.state}/records/batch={b:09d}" for b in news))
            touched = cut(fresh.select("list_id").distinct(), "touched-lists")
            self.compacted(target_bytes, touched if versions else None).write.mode("overwrite").parquet(f"{self.state}/files/version={news[-1]:09d}")
        return self

    def files(self) -> DataFrame:
        """(list_id, num_pix, part_no, num_data, nbytes, exposure_nos, payload, version): the written files, each list by its latest version."""
        schema = f"{FILE}, version long"
        if not (versions := self._numbers("files", "version")):
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.state}/files/version={v:09d}" for v in versions]
        every = self.spark.read.schema(schema).option("basePath", f"{self.state}/files").parquet(*paths)
        if len(versions) == 1:
            return every
        latest = every.groupBy("list_id").agg(F.max("version").alias("version"))
        return every.join(small(latest), ["list_id", "version"], "left_semi")

    def repeated(self) -> DataFrame:
        """Distinct (file_id, row_no) of deliveries whose record is in a readable file of smaller id.

        The smallest file of each record is an aggregate with partial sums, so a record delivered
        very often is no hot group.
        """
        keys = self.records().select("list_id", "exposure_no", "file_id", "row_no")
        first = keys.groupBy("list_id", "exposure_no").agg(F.min("file_id").alias("first"), F.max("file_id").alias("last")).where("last > first").drop("last")
        return keys.join(first, ["list_id", "exposure_no"]).where("file_id > first").select("file_id", "row_no").distinct()

    def unique(self, lists: DataFrame | None = None) -> DataFrame:
        """Each record of each list (or of those in ``lists``) once: that of the smallest (file_id, row_no)."""
        r = self.records() if lists is None else self.records().join(small(lists), "list_id", "left_semi")
        rest = [c for c in r.columns if c not in ("list_id", "exposure_no", "file_id", "row_no")]
        first = r.groupBy("list_id", "exposure_no").agg(F.min(F.struct("file_id", "row_no")).alias("k")).select("list_id", "exposure_no", "k.file_id", "k.row_no")
        return r.join(first, ["list_id", "exposure_no", "file_id", "row_no"], "left_semi").dropDuplicates(["list_id", "exposure_no", "file_id", "row_no"]).select("list_id", "exposure_no", *rest)

    def compacted(self, target_bytes: int = TARGET_BYTES, lists: DataFrame | None = None) -> DataFrame:
        """(list_id, num_pix, part_no, num_data, nbytes, exposure_nos, payload): the new files.

        A list gets as many files as its bytes demand, at least one; a large list is spread over
        its files by a hash of the exposure number. Within a file records are in order of exposure number.
        """
        rows = self.unique(lists).withColumn("bytes", (F.lit(8) + 4 * F.size("place_ones") + 8 * F.size("place_multi")).cast("long"))
        parts = rows.groupBy("list_id", "num_pix").agg(F.ceil(F.sum("bytes") / F.lit(target_bytes)).cast("long").alias("parts"))
        placed = rows.join(parts, ["list_id", "num_pix"]).withColumn("part_no", F.pmod(F.xxhash64("exposure_no"), F.greatest("parts", F.lit(1).cast("long"))))
        key = ["list_id", "num_pix", "part_no"]
        ready = placed.select(*key, "exposure_no", "place_ones", "place_multi", "count_multi").repartition(*key).sortWithinPartitions(*key, "exposure_no")
        return ready.mapInArrow(_assemble, FILE)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["list_id", "num_pix", "part_no", "num_data", "nbytes", "exposure_nos", "payload"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    held: list[pa.Table] = []
    key = None

    def close() -> pa.RecordBatch:
        t = pa.concat_tables(held).combine_chunks()
        size = lambda c: np.asarray(pc.list_value_length(t.column(c))).astype(np.int32)
        flat = lambda c: np.asarray(pc.list_flatten(t.column(c)))
        data = assemble(key[1], [size("place_ones"), size("place_multi"), flat("place_ones"), flat("place_multi"), flat("count_multi")])
        row = [key[0], key[1], key[2], t.num_rows, len(data), t.column("exposure_no").to_pylist(), data]
        return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, types)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        k = np.stack([np.asarray(table.column(c)) for c in ("list_id", "num_pix", "part_no")], 1)
        edges = [0, *(np.nonzero((k[1:] != k[:-1]).any(1))[0] + 1), len(k)]
        for a, b in zip(edges, edges[1:]):
            now = tuple(int(x) for x in k[a])
            if key is not None and now != key:
                yield close()
                held = []
            key = now
            held.append(table.slice(a, b - a))
    if held:
        yield close()


def export_files(compacted: DataFrame, folder: str) -> DataFrame:
    """Write the files into a folder all executors share; (list_id, part_no, file_path, nbytes).

    folder: a path or the URI of a file system that Arrow knows (file, hdfs, s3, gs). Names are determined by list,
    pixel count and part, and a file appears by moving a finished one into place, so a task that runs again replaces
    its own output.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                name = f"list-{r['list_id']}-{r['num_pix']}-{r['part_no']:06d}.emc"
                part = f"{root}/{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as f:
                    f.write(r["payload"])
                system.move(part, f"{root}/{name}")
                out.append((r["list_id"], r["part_no"], f"{folder}/{name}", r["nbytes"]))
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.string(), pa.int64()])], names=["list_id", "part_no", "file_path", "nbytes"])

    return compacted.mapInArrow(run, "list_id long, part_no long, file_path string, nbytes long")
