"""Queries of sources, sinks, constructors, lists of files, paths, the collector and helpers, each with its SQL."""

from __future__ import annotations

import json
import os
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countlake.functions.misc import bit_flags, divide_range, html_card, pretty_size
from countlake.operators import detector as dt
from countlake.operators.build import filled, from_array, from_coo, from_rows, patterns
from countlake.operators.frame import PatternFrame, concatenate, number
from countlake.plans.geometry_queries import PIX as PIXELS
from countlake.plans.geometry_queries import _rounded, part_detector
from countlake.plans.matrix_queries import COO, matrix
from countlake.schema import SparsePattern
from countlake.session import cut, fresh_path, table
from countlake.sources import arrays, objects
from countlake.sources.countsource import read_counts, scan, to_image, write_counts
from countlake.sources.paths import has_inner, inner_path, make_path, split_path
from countlake.streaming.collector import PatternCollector

EMBEDDED = "emb AS (SELECT vec_id AS pattern_id, CAST(i - 1 AS INTEGER) AS pixel_id, CAST(floor(abs(CAST(embedding[i] AS DOUBLE)) * 20.0::DOUBLE) AS BIGINT) AS cnt FROM embeddings, (SELECT unnest(range(1, 65)) AS i) WHERE floor(abs(CAST(embedding[i] AS DOUBLE)) * 20.0::DOUBLE) > 0)"
BOUNDS = (400, 1000)

ORACLE: dict[str, str] = {}
QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _file(spark: SparkSession, label: str, suffix: str) -> str:
    path = fresh_path(spark, label).removeprefix("file://") + suffix
    os.makedirs(os.path.dirname(path), exist_ok=True)
    return path


def _members(spark: SparkSession, d: str) -> str:
    """The order-part matrix as three count files; returns their glob."""
    m = matrix(spark, d)
    folder = fresh_path(spark, "members").removeprefix("file://")
    os.makedirs(folder)
    for k, (a, b) in enumerate(zip((0, *BOUNDS), (*BOUNDS, None))):
        write_counts(m[a:b], f"{folder}/part{k}.emc")
    return f"{folder}/part*.emc"


def _images(spark: SparkSession, d: str) -> np.ndarray:
    """Embeddings as one dense integer matrix, in order of vec_id, on the driver."""
    rows = table(spark, d, "embeddings").orderBy("vec_id").toArrow()
    return np.floor(np.abs(np.stack(rows["embedding"].to_numpy(zero_copy_only=False)).astype(float)) * 20.0).astype(int)


# lists of files ----------------------------------------------------------------------------------
@query(f"WITH {COO} SELECT pattern_id, pixel_id, cnt FROM coo")
def list_scan(spark, d):
    """Files of a glob as one scan."""
    return read_counts(spark, _members(spark, d)).entries


@query(f"WITH {COO} SELECT CAST(p_partkey AS INTEGER) AS pixel_id, CAST(coalesce(cnt, 0) AS BIGINT) AS cnt FROM part LEFT JOIN coo ON pixel_id = p_partkey AND pattern_id = 1001")
def list_int(spark, d):
    """One pattern of a list of files."""
    row = read_counts(spark, _members(spark, d))[1001]
    return spark.createDataFrame([(i, int(v)) for i, v in enumerate(row)], "pixel_id int, cnt bigint")


@query(f"WITH {COO} SELECT (pattern_id - 390) // 2 AS pattern_id, pixel_id, cnt FROM coo WHERE pattern_id >= 390 AND pattern_id < 1010 AND (pattern_id - 390) % 2 = 0")
def list_slice(spark, d):
    """A slice across three files, of a slice."""
    return read_counts(spark, _members(spark, d))[90:][300:920:2].entries


@query(f"WITH {COO}, kept AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders WHERE o_orderkey % 7 = 3) SELECT pos AS pattern_id, pixel_id, cnt FROM coo JOIN kept ON pattern_id = o_orderkey")
def list_mask(spark, d):
    m = read_counts(spark, _members(spark, d))
    return m[np.arange(len(m)) % 7 == 3].entries


@query(f"WITH {COO}, idx(pos, id) AS (VALUES (0, 1002), (1, 400), (2, 1002), (3, 399), (4, 0), (5, 1000)) SELECT CAST(pos AS BIGINT) AS pattern_id, pixel_id, cnt FROM coo JOIN idx ON pattern_id = id")
def list_ids(spark, d):
    return read_counts(spark, _members(spark, d))[[1002, 400, 1002, 399, 0, 1000]].entries


@query(f"WITH {COO} SELECT o_orderkey // 64 AS chunk_id, CAST(coalesce(sum(cnt), 0) AS BIGINT) AS total FROM orders LEFT JOIN coo ON pattern_id = o_orderkey GROUP BY 1")
def list_sums(spark, d):
    return read_counts(spark, _members(spark, d)).chunk_sums(64)


@query(f"WITH {COO} SELECT pattern_id, pixel_id, cnt FROM coo")
def list_write(spark, d):
    """A list of files written as one."""
    path = _file(spark, "joined", ".bin")
    write_counts(read_counts(spark, _members(spark, d)), path)
    return read_counts(spark, path).entries


@query(f"WITH {COO} SELECT o_orderkey AS pattern_id, CAST(count(*) FILTER (WHERE cnt = 1) AS INTEGER) AS ones, CAST(count(*) FILTER (WHERE cnt > 1) AS INTEGER) AS multi FROM orders LEFT JOIN coo ON pattern_id = o_orderkey GROUP BY 1")
def file_lengths(spark, d):
    """Only the row lengths of a file."""
    path = _file(spark, "lengths", ".emc")
    write_counts(matrix(spark, d), path)
    return scan(spark, path, "ones,multi").select("pattern_id", "ones", "multi")


# constructors ------------------------------------------------------------------------------------
@query(f"WITH {COO} SELECT pattern_id, pixel_id, cnt FROM coo WHERE pattern_id < 300")
def bytes_roundtrip(spark, d):
    """A count file in memory, by way of a byte stream."""
    import io

    stream = io.BytesIO()
    write_counts(matrix(spark, d)[:300], stream)
    return patterns(spark, stream).entries


@query(f"WITH {EMBEDDED} SELECT pattern_id, pixel_id, cnt FROM emb")
def dense_array(spark, d):
    """A dense matrix of the driver, by the dispatching constructor."""
    return patterns(spark, _images(spark, d)).entries


@query(f"WITH {EMBEDDED} SELECT pattern_id, pixel_id, cnt FROM emb")
def sparse_rows(spark, d):
    """A list of sparse patterns."""
    rows = [SparsePattern(len(x), np.flatnonzero(x == 1).tolist(), np.flatnonzero(x > 1).tolist(), x[x > 1].tolist()) for x in _images(spark, d)]
    return from_rows(spark, rows).entries


class _Coo:
    def __init__(self, array: np.ndarray):
        self.row, self.col = np.nonzero(array)
        self.data, self.shape = array[self.row, self.col], array.shape

    def tocoo(self):
        return self


@query(f"WITH {EMBEDDED} SELECT pattern_id, pixel_id, 2 * cnt AS cnt FROM emb")
def coo_input(spark, d):
    """A sparse matrix whose coordinates all stand twice."""
    coo = _Coo(_images(spark, d))
    coo.row, coo.col, coo.data = np.r_[coo.row, coo.row], np.r_[coo.col, coo.col], np.r_[coo.data, coo.data]
    return from_coo(spark, coo).entries


@query("SELECT o_orderkey AS pattern_id, CAST(0 AS BIGINT) AS ones, CAST(0 AS BIGINT) AS multi, CAST(0 AS BIGINT) AS total FROM orders")
def zeros(spark, d):
    """As many empty patterns as there are orders, from a pair of shape and value."""
    return patterns(spark, ((table(spark, d, "orders").count(), 50), 0)).row_stats()


@query("SELECT CAST(count(*) AS BIGINT) AS num_pix, CAST(0 AS BIGINT) AS num_data, CAST(0 AS BIGINT) AS total FROM part")
def empty_matrix(spark, d):
    m = patterns(spark, table(spark, d, "part").count())
    return m.sum().select(F.lit(m.num_pix).cast("long").alias("num_pix"), F.lit(len(m)).cast("long").alias("num_data"), "total")


def _refused(f, kind) -> bool:
    try:
        f()
    except kind:
        return True
    return False


@query("SELECT * FROM (VALUES ('axis', true), ('index', true), ('kind', true), ('negative', true), ('overwrite', true), ('pixel', true), ('power', true), ('suffix', true), ('width', true)) AS t(what, refused)")
def refusals(spark, d):
    """What is an error: kinds, indices, shapes, files."""
    m, path, det = matrix(spark, d)[:50], _file(spark, "refused", ".emc"), part_detector(spark, d)
    write_counts(m, path)
    tests = {
        "kind": (lambda: patterns(spark, {"a": 1}), TypeError), "index": (lambda: m[50], IndexError), "pixel": (lambda: det[[det.num_pix]], IndexError), "axis": (lambda: m.sum(axis=2), ValueError), "power": (lambda: m**0.5, TypeError),
        "negative": (lambda: from_array(spark, np.array([[-1]])), ValueError), "overwrite": (lambda: write_counts(m, path), FileExistsError), "suffix": (lambda: write_counts(m, path + ".txt"), ValueError), "width": (lambda: concatenate([m, m[:, :5]]), ValueError),
    }
    return spark.createDataFrame([(k, _refused(f, kind)) for k, (f, kind) in tests.items()], "what string, refused boolean")


# facts, order, concatenation ---------------------------------------------------------------------
@query(f"WITH {COO} SELECT o_orderkey AS pattern_id, 0 AS pixel_id, CAST(coalesce(sum(cnt), 0) AS BIGINT) AS total FROM orders LEFT JOIN coo ON pattern_id = o_orderkey GROUP BY 1")
def keepdims_sum(spark, d):
    return matrix(spark, d).sum(axis=1, keepdims=True)


@query("SELECT (SELECT count(*) FROM orders) AS num_data, (SELECT count(*) FROM part) AS num_pix, CAST(2 AS BIGINT) AS ndim, (SELECT count(*) FROM orders) AS len")
def shape_facts(spark, d):
    m = matrix(spark, d)
    return spark.createDataFrame([(*m.shape, m.ndim, len(m))], "num_data long, num_pix long, ndim long, len long")


@query(f"WITH {COO} SELECT cnt = 1 AS one, pixel_id, cnt FROM coo WHERE pattern_id = 33")
def single_row_sparse(spark, d):
    p = matrix(spark, d).pattern(33)
    rows = [(True, i, 1) for i in p.place_ones] + [(False, i, c) for i, c in zip(p.place_multi, p.count_multi)]
    return spark.createDataFrame(rows, "one boolean, pixel_id int, cnt bigint")


@query("""WITH p AS (SELECT pattern_id, min(place_ones) AS o, min(place_multi) AS m FROM pattern_rows WHERE pattern_id IS NOT NULL AND place_ones IS NOT NULL GROUP BY 1)
SELECT pattern_id, to_json(list_sort(o))::VARCHAR AS ones, to_json(list_sort(m))::VARCHAR AS multi FROM p""")
def ordered_rows(spark, d):
    """Recorded patterns with their places in order; repeated deliveries hold the same."""
    rows = table(spark, d, "pattern_rows").where("pattern_id is not null and place_ones is not null")
    rows = rows.groupBy("pattern_id").agg(F.min(F.struct("place_ones", "place_multi", "count_multi")).alias("r")).select("pattern_id", "r.*")
    m = PatternFrame(patterns(spark, 4096).meta, rows=rows).ordered()
    return m.rows.select("pattern_id", F.to_json("place_ones").alias("ones"), F.to_json("place_multi").alias("multi"))


@query(f"WITH {COO}, n AS (SELECT count(*) AS n FROM orders) SELECT pattern_id, pixel_id, cnt FROM coo WHERE pattern_id < 200 UNION ALL SELECT pattern_id + 200, pixel_id, cnt FROM coo WHERE pattern_id < 90")
def numpy_concatenate(spark, d):
    """np.concatenate of frames, checked."""
    m = matrix(spark, d)
    return np.concatenate((m[:200], m[:90])).entries


@query(f"WITH {COO} SELECT pattern_id, pixel_id, cnt FROM coo WHERE pattern_id < 500 UNION ALL SELECT pattern_id + 500, pixel_id, cnt FROM coo WHERE pattern_id < 400")
def concatenate_destroy(spark, d):
    m = matrix(spark, d)
    return concatenate([m[:500], m[:400]], casting="destroy").entries


@query(f"""WITH {COO}, s AS (SELECT o_orderkey AS pattern_id, count(cnt) AS n, list(pixel_id ORDER BY pixel_id) FILTER (WHERE cnt IS NOT NULL) AS p, list(cnt ORDER BY pixel_id) FILTER (WHERE cnt IS NOT NULL) AS c FROM orders LEFT JOIN coo ON pattern_id = o_orderkey GROUP BY 1)
SELECT pattern_id, CAST(sum(n) OVER (ORDER BY pattern_id) - n AS BIGINT) AS start, CAST(sum(n) OVER (ORDER BY pattern_id) AS BIGINT) AS past, to_json(coalesce(p, []))::VARCHAR AS pixel_ids, to_json(coalesce(c, []))::VARCHAR AS counts FROM s""")
def row_pointers(spark, d):
    """The compressed row form: row pointers, pixels and counts."""
    return matrix(spark, d).tocsr().select("pattern_id", "start", "past", F.to_json("pixel_ids").alias("pixel_ids"), F.to_json("counts").alias("counts"))


@query(f"""WITH {COO} SELECT o_orderkey AS pattern_id, j, CAST(coalesce(s, 0) AS BIGINT) AS value FROM (SELECT o_orderkey, j FROM orders, (VALUES (0), (1), (2), (3)) AS t(j)) LEFT JOIN (SELECT pattern_id, 2 AS jj, sum(cnt) AS s FROM coo WHERE pixel_id % 5 = 0 GROUP BY 1) ON pattern_id = o_orderkey AND jj = j""")
def matmul_zero_columns(spark, d):
    """Columns of the right matrix without a weight are columns of the product."""
    w = table(spark, d, "part").where("p_partkey % 5 = 0").select(F.col("p_partkey").cast("int").alias("pixel_id"), F.lit(2).alias("j"), F.lit(1).alias("w"))
    return matrix(spark, d).matmul(w, columns=4).withColumn("value", F.col("value").cast("long"))


@query(f"WITH {COO} SELECT pattern_id, pixel_id, 1 AS cnt FROM coo WHERE cnt = 1")
def one_entries(spark, d):
    return matrix(spark, d).one_entries().withColumn("cnt", F.col("cnt").cast("int"))


@query(f"WITH {COO} SELECT (SELECT count(*) FROM orders) AS patterns, (SELECT count(*) FROM part) AS pixels, count(*) AS entries FROM coo")
def described(spark, d):
    """The numbers of a frame's text card."""
    facts = dict(re.findall(r"(\w+): (\S+)", matrix(spark, d).describe()))
    return spark.createDataFrame([tuple(int(facts[k]) for k in ("Patterns", "Pixels", "Entries"))], "patterns long, pixels long, entries long")


# collector ---------------------------------------------------------------------------------------
@query(f"WITH {EMBEDDED}, n AS (SELECT count(*) AS n FROM embeddings) SELECT pattern_id, pixel_id, cnt FROM emb UNION ALL SELECT pattern_id + n, pixel_id, cnt FROM emb, n")
def collected(spark, d):
    """Images one by one and as a matrix, then a whole frame, through the buffer and a file."""
    images = _images(spark, d)
    c = PatternCollector(spark, max_buffer_size=len(images) // 3 + 1)
    for image in images[:40]:
        c.append(image)
    c.extend(images[40:])
    c.extend(from_array(spark, images))
    path = _file(spark, "collected", ".emc")
    c.write(path)
    return read_counts(spark, path).entries


# arrays, objects, paths, helpers -----------------------------------------------------------------
def _numbers(spark: SparkSession, d: str) -> DataFrame:
    """(pos, value): the retail prices in order of the key."""
    return number(table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("value")), "p_partkey").select("pos", "value")


@query("SELECT suffix, p_partkey AS i0, p_retailprice AS value FROM part, (VALUES ('.bin'), ('.emc'), ('.npy')) AS t(suffix)")
def array_files(spark, d):
    """A plain array through each kind of file."""
    numbers, out = cut(_numbers(spark, d), "numbers"), None
    for suffix in (".npy", ".bin", ".emc"):
        path = _file(spark, "array", suffix)
        arrays.write_column(path, numbers)
        part = arrays.scan_array(spark, path).withColumn("suffix", F.lit(suffix))
        out = part if out is None else out.unionByName(part)
    return out.select("suffix", "i0", "value")


@query("SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS nation, CAST(n_regionkey AS BIGINT) AS region FROM nation")
def object_files(spark, d):
    """A nested object stored, merged into, and read again."""
    rows = table(spark, d, "nation").collect()
    path = _file(spark, "object", ".nodes")
    objects.write_object(spark, path, {r.n_name: {"nation": int(r.n_nationkey)} for r in rows})
    objects.write_object(spark, path, {r.n_name: {"region": int(r.n_regionkey)} for r in rows}, overwrite=True)
    tree = objects.read_object(spark, path)
    return spark.createDataFrame([(k, v["nation"], v["region"]) for k, v in tree.items()], "name string, nation bigint, region bigint")


@query("""SELECT source_id, s AS text, split_part(s, '::', 1) AS file, CASE WHEN group_path IS NULL THEN '/' ELSE group_path END AS name, rtrim(CASE WHEN group_path IS NULL THEN '/' ELSE group_path END, '/') || '/x' AS child
FROM (SELECT source_id, group_path, 'run' || source_id || '.h5::' || coalesce(group_path, '') AS s FROM sources WHERE source_id IS NOT NULL)""")
def path_parts(spark, d):
    """Files and inner names of the sources' paths, and the path of a child node."""
    out = []
    for r in table(spark, d, "sources").where("source_id is not null").collect():  # the table of sources: fixed, small
        text = f"run{r.source_id}.h5::{r.group_path or ''}"
        file, name = split_path(text)
        path = inner_path(text)
        if not has_inner(text) or make_path(text) != path or tuple(path) != (file, name):
            raise AssertionError(text)
        out.append((r.source_id, text, str(file), name, (path / "x").name))
    return spark.createDataFrame(out, "source_id int, text string, file string, name string, child string")


@query("SELECT p_partkey AS id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.2f KB', b / 1024.0::DOUBLE) ELSE printf('%.2f MB', b / 1048576.0::DOUBLE) END AS size FROM (SELECT p_partkey, p_partkey * p_size * 100 AS b FROM part)")
def pretty_sizes(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_size").collect()  # a fixed helper of single numbers
    return spark.createDataFrame([(r.p_partkey, pretty_size(r.p_partkey * r.p_size * 100)) for r in rows], "id bigint, size string")


@query("WITH n AS (SELECT count(*) AS n FROM orders), k AS (SELECT n, n // 7 AS e, n % 7 AS m, i FROM n, range(7) AS t(i)) SELECT i * e + least(i, m) AS first, (i + 1) * e + least(i + 1, m) AS past FROM k")
def divided_range(spark, d):
    return spark.createDataFrame(divide_range(0, table(spark, d, "orders").count(), 7), "first bigint, past bigint")


@query("SELECT CAST(p_size AS INTEGER) AS id, (1 << (p_size % 8)) | (1 << ((p_size + 3) % 8)) AS flags FROM (SELECT DISTINCT p_size FROM part)")
def flag_values(spark, d):
    sizes = [r.p_size for r in table(spark, d, "part").select("p_size").distinct().collect()]
    return spark.createDataFrame([(s, bit_flags([s % 8, (s + 3) % 8])) for s in sizes], "id int, flags int")


@query("SELECT r_name AS title, CAST(r_regionkey AS BIGINT) AS value FROM region")
def cards(spark, d):
    """Facts read out of HTML cards."""
    out = []
    for r in table(spark, d, "region").collect():
        card = html_card(r.r_name, {"key": int(r.r_regionkey)})
        out.append((re.search(r"<strong>(.*?)</strong>", card)[1], int(re.search(r"<td>(\d+)</td>", card)[1])))
    return spark.createDataFrame(out, "title string, value bigint")


# detectors ---------------------------------------------------------------------------------------
@query(f"WITH {PIXELS} SELECT pixel_id, round(qx, 6) + 0 AS qx, round(qy, 6) + 0 AS qy, round(qz, 6) + 0 AS qz, round(factor / (SELECT avg(factor) FROM pix), 6) AS factor, mask FROM pix")
def detector_arrays(spark, d):
    """To arrays of the driver and back, normalised and checked by the dispatching constructor."""
    a = np.asarray(part_detector(spark, d))
    det = dt.detector(spark, coor=np.c_[a["qx"], a["qy"], a["qz"]], factor=a["factor"], mask=a["mask"], detd=2000.0, ewald_rad=2000.0)
    return _rounded(det.pixels, "qx", "qy", "qz", "factor")


@query(f"WITH {PIXELS} SELECT pixel_id, round(factor * 2, 6) AS factor, 0 AS mask FROM pix")
def detector_overrides(spark, d):
    """Another detector with some of its parts replaced."""
    det = part_detector(spark, d)
    a = np.asarray(det)
    return _rounded(dt.detector(spark, det, factor=2 * a["factor"], mask=np.zeros(len(a), int), norm_flag=False).pixels.select("pixel_id", "factor", "mask"), "factor")


@query(f"WITH {PIXELS} SELECT pixel_id, round(qx, 6) + 0 AS qx, round(qy, 6) + 0 AS qy, round(qz, 6) + 0 AS qz, round(factor, 6) AS factor FROM pix")
def coordinates_and_factors(spark, d):
    return _rounded(part_detector(spark, d).coor_factor(), "qx", "qy", "qz", "factor")


@query(f"WITH {PIXELS} SELECT abs(avg(factor) - 1) <= 1e-8 + 1e-5 AS as_given, true AS normalised FROM pix")
def norm_flags(spark, d):
    det = part_detector(spark, d)
    return spark.createDataFrame([(det.norm_flag, det.norm().norm_flag)], "as_given boolean, normalised boolean")


@query(f"""WITH {PIXELS}, p AS (SELECT qx * 2000.0::DOUBLE / (2000.0::DOUBLE + qz) AS cx, qy * 2000.0::DOUBLE / (2000.0::DOUBLE + qz) AS cy FROM pix)
SELECT round(min(cx), 6) + 0 AS x0, round(min(cx) + round_even(max(cx) - min(cx), 0) + 1, 6) + 0 AS x1, round(min(cy), 6) + 0 AS y0, round(min(cy) + round_even(max(cy) - min(cy), 0) + 1, 6) + 0 AS y1 FROM p""")
def image_extent(spark, d):
    extent = dt.det_render(part_detector(spark, d)).frame_extent()
    return _rounded(spark.createDataFrame([tuple(map(float, extent))], "x0 double, x1 double, y0 double, y1 double"), "x0", "x1", "y0", "y1")


@query(f"WITH {PIXELS} SELECT pixel_id, round(qx, 4) + 0 AS x, round(qy, 4) + 0 AS y, round(qz, 4) + 0 AS z FROM pix")
def plane_and_back(spark, d):
    """The renderer's projections undo one another."""
    return _rounded(dt.det_render(part_detector(spark, d)).back(), "x", "y", "z", digits=4)


@query(f"WITH {PIXELS}, n AS (SELECT count(*) AS n FROM pix) SELECT pixel_id, mask FROM pix UNION ALL SELECT CAST(n + pixel_id AS INTEGER), xor(mask, 1) FROM pix, n")
def numpy_concatenate_detectors(spark, d):
    det = part_detector(spark, d)
    return np.concatenate((det, det.mask_flip(1))).pixels.select("pixel_id", "mask")
