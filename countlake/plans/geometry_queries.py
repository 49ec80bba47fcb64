"""Queries of the detector operators, each with its SQL.

The part detector: part p is the pixel (p % 50, p div 50) on a sphere of radius 2000, its factor is the
retail price, and small and large sizes mark BAD and CORNER pixels.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countlake.operators import detector as dt
from countlake.operators.detector import DetectorFrame
from countlake.schema import DetectorMeta, PixelType
from countlake.session import fresh_path, table

R = 2000.0
XY = "(p_partkey % 50) - 24.5::DOUBLE AS qx, CAST(p_partkey // 50 AS DOUBLE) - 20.0::DOUBLE AS qy"
PIX = f"""pix AS (SELECT CAST(p_partkey AS INTEGER) AS pixel_id, qx, qy, sqrt({R}::DOUBLE * {R}::DOUBLE - qx * qx - qy * qy) - {R}::DOUBLE AS qz, p_retailprice AS factor,
CASE WHEN p_size < 5 THEN 2 WHEN p_size > 45 THEN 1 ELSE 0 END AS mask, p_size AS v FROM (SELECT *, {XY} FROM part))"""

ORACLE: dict[str, str] = {}
QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def part_detector(spark: SparkSession, d: str) -> DetectorFrame:
    part = table(spark, d, "part")
    flat = part.select("*", ((F.col("p_partkey") % 50) - 24.5).alias("qx"), (F.floor(F.col("p_partkey") / 50) - 20.0).cast("double").alias("qy"))
    z = F.sqrt(F.lit(R * R) - F.col("qx") * F.col("qx") - F.col("qy") * F.col("qy")) - R
    mask = F.when(F.col("p_size") < 5, 2).when(F.col("p_size") > 45, 1).otherwise(0)
    pixels = flat.select(F.col("p_partkey").cast("int").alias("pixel_id"), "qx", "qy", z.alias("qz"), F.col("p_retailprice").alias("factor"), mask.alias("mask"))
    return DetectorFrame(pixels, DetectorMeta(part.count(), R, R))


def _rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    # adding 0 turns a negative zero into zero
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in cols})


@query(f"WITH {PIX} SELECT mask, count(*) AS n FROM pix GROUP BY mask")
def mask_counts(spark, d):
    return part_detector(spark, d).mask_counts()


@query(f"WITH {PIX} SELECT CAST(row_number() OVER (ORDER BY pixel_id) - 1 AS INTEGER) AS pixel_id, round(factor, 6) AS factor, mask FROM pix WHERE mask IN (0, 1)")
def good_pixels(spark, d):
    return _rounded(part_detector(spark, d)[[PixelType.GOOD, PixelType.CORNER]].pixels.select("pixel_id", "factor", "mask"), "factor")


@query(f"WITH {PIX} SELECT pixel_id, CASE WHEN pixel_id % 2 = 0 THEN (mask & 253) | 2 ELSE mask END AS mask FROM pix")
def bitmask_set(spark, d):
    det = part_detector(spark, d)
    return det.mask_set([1], 2, range(0, det.num_pix, 2)).pixels.select("pixel_id", "mask")


@query(f"WITH {PIX} SELECT pixel_id, xor(mask, 3) AS mask FROM pix")
def bitmask_flip(spark, d):
    return part_detector(spark, d).mask_flip(3).pixels.select("pixel_id", "mask")


@query(f"WITH {PIX} SELECT pixel_id, (mask & 2) = 2 AS selected FROM pix")
def bitmask_select(spark, d):
    det = part_detector(spark, d)
    return det.pixels.select("pixel_id", det.mask_select([1], [1]).alias("selected"))


@query("""SELECT CAST(i AS INTEGER) AS pixel_id, round(x / l * 300.0::DOUBLE, 6) + 0 AS qx, round(y / l * 300.0::DOUBLE, 6) + 0 AS qy, round((300.0::DOUBLE / l - 1.0::DOUBLE) * 300.0::DOUBLE, 6) + 0 AS qz,
round((1.0::DOUBLE - (x * x + y * y) / (2.0::DOUBLE * l * l)) * 300.0::DOUBLE / (l * l * l), 12) AS factor, 0 AS mask
FROM (SELECT *, sqrt(x * x + y * y + 90000.0::DOUBLE) AS l FROM (SELECT i, (i // 50) - 29.5::DOUBLE AS x, (i % 50) - 24.5::DOUBLE AS y FROM range(3000) AS t(i)))""")
def simple_detector(spark, d):
    det = dt.simple_detector(spark, (60, 50), 300.0).pixels
    return _rounded(_rounded(det, "qx", "qy", "qz"), "factor", digits=12)


@query(f"WITH {PIX} SELECT pixel_id, round(factor / (SELECT avg(factor) FROM pix), 6) AS factor FROM pix")
def detector_norm(spark, d):
    return _rounded(part_detector(spark, d).norm().pixels.select("pixel_id", "factor"), "factor")


@query(f"WITH {PIX} SELECT pixel_id, round(qx * {R}::DOUBLE / ({R}::DOUBLE + qz), 6) + 0 AS qx, round(qy * {R}::DOUBLE / ({R}::DOUBLE + qz), 6) + 0 AS qy FROM pix")
def project_cxy(spark, d):
    return _rounded(part_detector(spark, d).flat().pixels.select("pixel_id", "qx", "qy"), "qx", "qy")


@query(f"WITH {PIX}, s AS (SELECT *, 1.0::DOUBLE / sqrt(1.0::DOUBLE + (qx / {R}::DOUBLE) * (qx / {R}::DOUBLE) + (qy / {R}::DOUBLE) * (qy / {R}::DOUBLE)) AS k FROM pix) SELECT pixel_id, round(qx * k, 6) + 0 AS x, round(qy * k, 6) + 0 AS y, round({R}::DOUBLE * (k - 1.0::DOUBLE), 6) + 0 AS z FROM s")
def unproject_xyz(spark, d):
    x, y, z = dt.to_sphere(F.col("qx"), F.col("qy"), R, 1)
    return _rounded(part_detector(spark, d).pixels.select("pixel_id", x.alias("x"), y.alias("y"), z.alias("z")), "x", "y", "z")


@query(f"WITH {PIX} SELECT round(max(sqrt(qx * qx + qy * qy + qz * qz)), 6) AS q_max, round(min(sqrt(qx * qx + qy * qy + qz * qz)), 6) AS q_min, round(avg(factor), 6) AS mean_factor, CAST(2 * floor(max(sqrt(qx * qx + qy * qy + qz * qz))) + 3 AS BIGINT) AS den_size FROM pix")
def detector_stats(spark, d):
    return _rounded(part_detector(spark, d).stats(), "q_max", "q_min", "mean_factor")


@query(f"SELECT 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, {-R}::DOUBLE AS z, 1 AS curved, true AS fits")
def ewald_fit(spark, d):
    """Centre of the sphere through the pixels, from the sums of the normal equations."""
    det = part_detector(spark, d)
    centre, curved = det.fit_sphere()
    clean = [round(float(c), 3) + 0.0 for c in centre]
    return spark.createDataFrame([(*clean, curved, det.check_ewald_rad())], "x double, y double, z double, curved int, fits boolean")


@query(f"""WITH {PIX}, p AS (SELECT qx * {R}::DOUBLE / ({R}::DOUBLE + qz) AS cx, qy * {R}::DOUBLE / ({R}::DOUBLE + qz) AS cy, mask = 2 AS bad, v FROM pix),
g AS (SELECT CAST(round_even(cx - (SELECT min(cx) FROM p), 0) AS INTEGER) AS fx, CAST(round_even(cy - (SELECT min(cy) FROM p), 0) AS INTEGER) AS fy, bad, v FROM p),
cell AS (SELECT fx, fy, sum(v) AS s, count(*) AS n, max(CAST(bad AS INTEGER)) AS m FROM g GROUP BY 1, 2),
mean AS (SELECT sum(CASE WHEN m = 0 THEN n ELSE 0 END)::DOUBLE / ((max(fx) + 1) * (max(fy) + 1) - sum(m)) AS mean_n FROM cell)
SELECT fx, fy, round(s::DOUBLE / (n::DOUBLE / mean_n), 6) AS val FROM cell, mean WHERE m = 0""")
def render_frame(spark, d):
    values = table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("pixel_id"), F.col("p_size").alias("v"))
    return _rounded(dt.det_render(part_detector(spark, d)).render(values), "val")


RADIAL = """r AS (SELECT sqrt(qx * qx + qy * qy) AS r, factor AS f FROM pix), e AS (SELECT min(r) AS lo, max(r) AS hi, CAST(floor(max(r) - min(r)) + 1 AS INTEGER) AS nb FROM r),
b AS (SELECT CAST(least(floor((r - lo) * nb / (hi - lo)), nb - 1) AS INTEGER) AS k, avg(f) AS y FROM r, e GROUP BY 1)"""


@query(f"WITH {PIX}, {RADIAL} SELECT k, round(y, 6) AS y FROM b")
def radial_rebin(spark, d):
    src = part_detector(spark, d).pixels.select(F.sqrt(F.col("qx") * F.col("qx") + F.col("qy") * F.col("qy")).alias("r"), F.col("factor").alias("f"))
    return _rounded(dt.radial_bins(src)[0], "y")


@query(f"""WITH {PIX}, {RADIAL}, l AS (SELECT k, y, lead(k) OVER (ORDER BY k) AS k1, lead(y) OVER (ORDER BY k) AS y1 FROM b), ends AS (SELECT min(k) AS a, max(k) AS z, max(y) AS top, min(y) AS bottom FROM b),
t0 AS (SELECT i, (i // 30) - 19.5::DOUBLE AS gx, (i % 30) - 14.5::DOUBLE AS gy FROM range(1200) AS t(i)),
t1 AS (SELECT i, gx, gy, 1.0::DOUBLE / sqrt(1.0::DOUBLE + (gx / {R}::DOUBLE) * (gx / {R}::DOUBLE) + (gy / {R}::DOUBLE) * (gy / {R}::DOUBLE)) AS c FROM t0),
t2 AS (SELECT i, sqrt(gx * c * gx * c + gy * c * gy * c) AS r FROM t1), t3 AS (SELECT i, r, (r - lo) * nb / (hi - lo) - 0.5::DOUBLE AS t, lo, hi, a, z, top, bottom FROM t2, e, ends)
SELECT CAST(i AS INTEGER) AS pixel_id, round(CASE WHEN t < a THEN top WHEN t > z THEN bottom ELSE y + coalesce((y1 - y) * (t - k) / (k1 - k), 0) END, 6) AS factor, CASE WHEN r < lo OR r > hi THEN 2 ELSE 0 END AS mask
FROM t3 ASOF LEFT JOIN l ON greatest(t, a) >= l.k""")
def resample(spark, d):
    return _rounded(dt.resample((40, 30), part_detector(spark, d)).pixels.select("pixel_id", "factor", "mask"), "factor")


@query(f"WITH {PIX}, n AS (SELECT count(*) AS n FROM pix) SELECT pixel_id, mask FROM pix UNION ALL SELECT CAST(n + pixel_id AS INTEGER), mask FROM pix, n")
def detector_concat(spark, d):
    det = part_detector(spark, d)
    return dt.concat_detectors([det, det]).pixels.select("pixel_id", "mask")


@query("SELECT true AS same, false AS other, true AS near")
def detector_close(spark, d):
    det = part_detector(spark, d)
    tiny = det._with(det.pixels.withColumn("factor", F.col("factor") * (1 + 1e-8)))
    return spark.createDataFrame([(det.is_close(det), det.is_close(det.mask_flip(1)), det.is_close(tiny))], "same boolean, other boolean, near boolean")


@query("""SELECT detector_id, CAST(pixel_id AS INTEGER) AS pixel_id, max(CASE WHEN (mask & 2) = 2 THEN 1 ELSE 0 END) AS bad FROM pixels GROUP BY 1, 2""")
def domain_bad_pixels(spark, d):
    """BAD pixels of the two detectors, repeated rows and stray bits taken care of."""
    bad = (F.coalesce(F.col("mask"), F.lit(0)).bitwiseAND(2) == 2).cast("int")
    return table(spark, d, "pixels").groupBy("detector_id", F.col("pixel_id").cast("int").alias("pixel_id")).agg(F.max(bad).alias("bad"))


@query("SELECT CAST(detector_id AS INTEGER) AS detector_id, CASE WHEN isinf(ewald_rad) THEN 2 ELSE 3 END AS ndim FROM detectors")
def domain_dimensions(spark, d):
    rows = table(spark, d, "detectors").collect()  # the table of detectors, not of pixels
    made = [(r.detector_id, DetectorFrame(spark.createDataFrame([], "pixel_id int, qx double, qy double, qz double, factor double, mask int"), DetectorMeta(r.num_pix, r.detd, math.inf if math.isinf(r.ewald_rad) else r.ewald_rad)).ndim) for r in rows]
    return spark.createDataFrame(made, "detector_id int, ndim int")


@query(f"WITH {PIX} SELECT pixel_id, round(qx, 6) + 0 AS qx, round(qz, 6) + 0 AS qz, round(factor, 6) AS factor, mask FROM pix")
def text_detector_roundtrip(spark, d):
    """Written to a text file and read again."""
    path = fresh_path(spark, "detector").removeprefix("file://") + ".dat"
    part_detector(spark, d).write(path)
    return _rounded(dt.read_detector(spark, path).pixels.select("pixel_id", "qx", "qz", "factor", "mask"), "qx", "qz", "factor")


@query(f"""WITH {PIX}, p AS (SELECT qx * {R}::DOUBLE / ({R}::DOUBLE + qz) AS cx, qy * {R}::DOUBLE / ({R}::DOUBLE + qz) AS cy FROM pix),
e AS (SELECT min(cx) AS x0, min(cy) AS y0, CAST(round_even(max(cx) - min(cx), 0) AS INTEGER) + 1 AS w, CAST(round_even(max(cy) - min(cy), 0) AS INTEGER) + 1 AS h FROM p)
SELECT CAST(i AS INTEGER) AS fx, CAST(j AS INTEGER) AS fy, round(x0 + i * (w::DOUBLE / (w - 1)), 6) + 0 AS x, round(y0 + j * (h::DOUBLE / (h - 1)), 6) + 0 AS y FROM e, unnest(range(e.w)) AS a(i), unnest(range(e.h)) AS b(j)""")
def frame_pixels(spark, d):
    """Coordinates of the image's cells."""
    return _rounded(dt.det_render(part_detector(spark, d)).frame_pixels(), "x", "y")


@query(f"WITH {PIX} SELECT CAST(pos AS INTEGER) AS pixel_id, round(factor, 6) AS factor FROM pix JOIN (VALUES (0, 9), (1, 4), (2, 4), (3, 150)) AS t(pos, id) ON pixel_id = id")
def pixel_pick(spark, d):
    """Pixels in a given order, one of them twice."""
    return _rounded(part_detector(spark, d)[[9, 4, 4, 150]].pixels.select("pixel_id", "factor"), "factor")
