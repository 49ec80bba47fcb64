"""BAD pixels per source, for vectorised lookups in Arrow kernels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bit of the pixel mask that says BAD; only the low eight bits of a mask count.
BAD = 2
NUM_PIX = 4096
#: Up to this many (source, BAD pixel) entries travel with the kernel; the number is measured first.
#: More than that are joined to the rows instead.
CARRIED = 2_000_000


def bad_by_source(sources: DataFrame, pixels: DataFrame) -> DataFrame:
    """(source_id, bad): the sorted pixel ids that are BAD for the detector of each source.

    Repeated pixel rows count once, a null mask is not BAD, any other bits are ignored. A source
    whose detector has no pixels, or no detector, gets an empty array; a repeated source_id keeps
    its smallest detector. Null source_ids are dropped. The result has one row per source.
    """
    bad = (
        pixels.where(F.col("mask").bitwiseAND(BAD) == BAD)
        .groupBy("detector_id")
        .agg(F.array_sort(F.collect_set(F.col("pixel_id").cast("int"))).alias("bad"))
    )
    src = sources.where("source_id is not null").groupBy("source_id").agg(F.min("detector_id").alias("detector_id"))
    empty = F.array().cast("array<int>")
    return src.join(bad, "detector_id", "left").select("source_id", F.coalesce("bad", empty).alias("bad"))


class BadLookup:
    """Says which (row, pixel) entries of an Arrow batch are on BAD pixels of the row's source."""

    def __init__(self, sources: DataFrame, pixels: DataFrame, num_pix: int = NUM_PIX):
        self.num_pix = num_pix
        self.table = bad_by_source(sources, pixels)
        size = self.table.agg(F.coalesce(F.sum(F.size("bad") + 1), F.lit(0))).first()[0]
        self.carried = size <= CARRIED
        self.known = {r.source_id: r.bad for r in self.table.collect()} if self.carried else None

    def attach(self, rows: DataFrame) -> DataFrame:
        """rows with what ``flags`` needs; they must have source_id."""
        return rows if self.carried else rows.join(self.table.withColumnRenamed("bad", "__bad"), "source_id", "left")

    def kernel(self):
        """A function (batch, owner, pixel) -> bool array; pixel values must be in 0..num_pix-1."""
        known, num_pix = self.known, self.num_pix

        def flags(batch: pa.RecordBatch, owner: np.ndarray, pixel: np.ndarray) -> np.ndarray:
            src = batch.column("source_id")
            codes = pc.dictionary_encode(src, null_encoding="encode")
            code = np.asarray(codes.indices)
            names = codes.dictionary.to_pylist()
            mask = np.zeros((len(names), num_pix), bool)
            if known is not None:
                lists = [known.get(s, ()) for s in names]
            else:
                first = np.unique(code, return_index=True)[1]
                lists = [batch.column("__bad")[int(i)].as_py() or () for i in first]
            for i, bad in enumerate(lists):
                at = np.asarray([b for b in bad if 0 <= b < num_pix], np.int64)
                mask[i, at] = True
            return mask[code[owner], pixel]

        return flags
