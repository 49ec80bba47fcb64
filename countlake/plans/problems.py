"""Queries of the general data problems: small files (p1) and implausible readings (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countlake.operators.outliers import implausible_entries, residual_spikes
from countlake.session import table
from countlake.streaming.compactor import StreamingCompactor


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, row_no): deliveries of records that a readable file of smaller id holds as well."""
    return StreamingCompactor.fresh(spark, f"{d}/frame_files.parquet").advance().repeated()


def p1_files(spark: SparkSession, d: str) -> DataFrame:
    """The compacted files of every list as written, one row per file."""
    return StreamingCompactor.fresh(spark, f"{d}/frame_files.parquet").advance().compact().files()


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    """(list_id, records, exposures): what the written files hold of each list, counted after reading them back."""
    files = StreamingCompactor.fresh(spark, f"{d}/frame_files.parquet").advance().compact().files()
    return files.groupBy("list_id").agg(F.sum("num_data").alias("records"), F.sum(F.aggregate("exposure_nos", F.lit(0).cast("long"), lambda a, x: a + x)).alias("exposures"))


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    return implausible_entries(table(spark, d, "pattern_rows"), table(spark, d, "sources"), table(spark, d, "pixels"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """(pattern_id, pixel_id): entries that cannot be true readings."""
    return _flagged(spark, d).select("pattern_id", F.col("pixel_id").cast("long").alias("pixel_id")).distinct()


def p5_flags(spark: SparkSession, d: str) -> DataFrame:
    """The same entries with their count and what is wrong with them."""
    return _flagged(spark, d)


def p5_residuals(spark: SparkSession, d: str) -> DataFrame:
    """Entries that stand out of their source's autoregression, with their robust residual."""
    return residual_spikes(table(spark, d, "pattern_rows"), table(spark, d, "sources"), table(spark, d, "pixels"))


def queries() -> dict:
    return {"p1_found": p1_found, "p1_files": p1_files, "p1_records": p1_records, "p5_residuals": p5_residuals, "p5_found": p5_found, "p5_flags": p5_flags}


_P5 = """WITH pr AS (SELECT pattern_id, source_id, max({'p': place_multi, 'c': count_multi}) AS e FROM pattern_rows WHERE pattern_id IS NOT NULL AND source_id IS NOT NULL GROUP BY 1, 2),
sq AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY pattern_id) AS seq FROM pr),
bad AS (SELECT DISTINCT s.source_id, p.pixel_id FROM sources s JOIN pixels p USING (detector_id) WHERE (p.mask & 2) = 2),
al AS (SELECT pattern_id, source_id, seq, unnest(e.p) AS px, unnest(e.c) AS c FROM sq),
en AS (SELECT al.* FROM al LEFT JOIN bad ON bad.source_id = al.source_id AND bad.pixel_id = al.px WHERE bad.pixel_id IS NULL),
md AS (SELECT source_id, median(c) AS m FROM en WHERE px BETWEEN 0 AND 4095 GROUP BY 1),
sp AS (SELECT pattern_id, px, c FROM en JOIN md USING (source_id) WHERE px BETWEEN 0 AND 4095 AND c > 16 * m),
im AS (SELECT pattern_id, px, c FROM en WHERE px < 0 OR px > 4095 OR c < 1),
ru AS (SELECT *, seq - row_number() OVER (PARTITION BY source_id, px, c ORDER BY seq) AS g FROM en),
rn AS (SELECT *, count(*) OVER (PARTITION BY source_id, px, c, g) AS n FROM ru),
st AS (SELECT pattern_id, px, c FROM rn WHERE n >= 6),
al2 AS (SELECT *, 1 AS k FROM sp UNION ALL SELECT *, 2 FROM st UNION ALL SELECT *, 3 FROM im)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": f"{_P5} SELECT DISTINCT pattern_id, CAST(px AS BIGINT) AS pixel_id FROM al2",
        "p5_flags": f"{_P5} SELECT pattern_id, px AS pixel_id, c AS cnt, bool_or(k = 1) AS spike, bool_or(k = 2) AS stuck, bool_or(k = 3) AS impossible FROM al2 GROUP BY 1, 2, 3",
    }
