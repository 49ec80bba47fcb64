"""Collecting dense images into a PatternFrame, on the driver or from a stream."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countlake.functions.misc import html_card
from countlake.operators.build import from_array, from_dense_rows
from countlake.operators.frame import PatternFrame, concat_rows
from countlake.session import fresh_path


class PatternCollector:
    """Images are buffered and turned into sparse parts of at least ``max_buffer_size`` patterns."""

    def __init__(self, spark: SparkSession, max_buffer_size: int = 128):
        self.spark, self.max_buffer_size = spark, max_buffer_size
        self._parts: list[PatternFrame] = []
        self._buffer: list[np.ndarray] = []

    @property
    def num_pix(self) -> int | None:
        if self._parts:
            return self._parts[0].num_pix
        return len(self._buffer[0]) if self._buffer else None

    def _accept(self, image: np.ndarray) -> np.ndarray:
        image = np.asarray(image).ravel()
        if self.num_pix is not None and len(image) != self.num_pix:
            raise ValueError(f"an image of {len(image)} pixels, not {self.num_pix}")
        if not np.issubdtype(image.dtype, np.integer):
            raise ValueError("counts are integers")
        return image

    def _flush(self) -> None:
        if self._buffer:
            self._parts.append(from_array(self.spark, np.stack(self._buffer)))
            self._buffer = []

    def append(self, image: np.ndarray) -> None:
        self._buffer.append(self._accept(image))
        if len(self._buffer) >= self.max_buffer_size:
            self._flush()

    def extend(self, images) -> None:
        """A list or matrix of images, or a PatternFrame, which is appended whole."""
        if isinstance(images, PatternFrame):
            if self.num_pix is not None and images.num_pix != self.num_pix:
                raise ValueError(f"patterns of {images.num_pix} pixels, not {self.num_pix}")
            self._flush()
            self._parts.append(images)
        elif isinstance(images, (list, np.ndarray)):
            for image in images:
                self.append(image)
        else:
            raise TypeError(f"cannot collect {type(images).__name__}")

    def pattern_list(self) -> list[PatternFrame]:
        self._flush()
        return self._parts

    def patterns(self) -> PatternFrame:
        if not self.pattern_list():
            raise ValueError("nothing has been collected")
        return concat_rows(self._parts)

    def write(self, path, *, version: str = "2", overwrite: bool = False, compression: str | None = None) -> None:
        from countlake.sources.countsource import write_counts

        write_counts(self.patterns(), path, version=version, overwrite=overwrite, compression=compression)

    def __repr__(self) -> str:
        return f"PatternCollector({sum(map(len, self._parts)) + len(self._buffer)} patterns of {self.num_pix} pixels)"

    def _repr_html_(self) -> str:
        return html_card("PatternCollector", {"Patterns": sum(map(len, self._parts)) + len(self._buffer), "Pixels": self.num_pix})


def collect_stream(stream: DataFrame, num_pix: int, state: str | None = None) -> DataFrame:
    """(pattern_id, place_ones, place_multi, count_multi) of a finished stream of (pattern_id, values).

    Each micro-batch is written under its own number and replaces an earlier attempt, so a restart
    with the same ``state`` folder neither loses nor repeats patterns. A row of another size than num_pix is an error.
    """
    spark = stream.sparkSession
    state = state or fresh_path(spark, "collect")

    def store(batch: DataFrame, batch_id: int) -> None:
        from_dense_rows(batch, 0, num_pix).rows.write.mode("overwrite").parquet(f"{state}/rows/batch={batch_id:09d}")

    query = stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{state}/rows/batch=*").select("pattern_id", "place_ones", "place_multi", "count_multi")


def long_counts(rows: DataFrame) -> DataFrame:
    """(pattern_id, pixel_id, cnt) of compact rows."""
    ones = F.transform("place_ones", lambda x: F.struct(x.alias("pixel_id"), F.lit(1).cast("long").alias("cnt")))
    many = F.transform(F.arrays_zip("place_multi", "count_multi"), lambda x: F.struct(x["place_multi"].alias("pixel_id"), x["count_multi"].cast("long").alias("cnt")))
    return rows.select("pattern_id", F.inline(F.concat(ones, many)))
