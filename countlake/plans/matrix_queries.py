"""Queries of the matrix operators, each with its SQL.

The order-part matrix: orders are patterns, parts are pixels, a count is the quantity of a part in an order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countlake.operators import frame as pf
from countlake.operators.build import filled, from_dense_rows, from_triplets
from countlake.operators.frame import PatternFrame
from countlake.session import fresh_path, stream_path, table
from countlake.streaming.collector import collect_stream, long_counts

COO = "coo AS (SELECT l_orderkey AS pattern_id, CAST(l_partkey AS INTEGER) AS pixel_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS cnt FROM lineitem GROUP BY 1, 2)"
DIM = "dim AS (SELECT o_orderkey AS pattern_id FROM orders)"
IDS = [7, 3, 1200, 3, 0, 77]
PIX = [5, 150, 5, 0, 42]


def matrix(spark: SparkSession, d: str) -> PatternFrame:
    orders, part = table(spark, d, "orders"), table(spark, d, "part")
    triplets = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pattern_id"), F.col("l_partkey").cast("int").alias("pixel_id"), F.col("l_quantity").cast("long").alias("cnt"))
    return from_triplets(triplets, orders.count(), part.count(), orders.select(F.col("o_orderkey").alias("pattern_id")))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as dense rows of counts."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("pattern_id"), _embedded().alias("values"))


def _embedded():
    return F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 20.0).cast("int"))


ORACLE: dict[str, str] = {}
QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"WITH {COO} SELECT o_orderkey AS pattern_id, count(*) FILTER (WHERE cnt = 1) AS ones, count(*) FILTER (WHERE cnt > 1) AS multi, CAST(coalesce(sum(cnt), 0) AS BIGINT) AS total FROM orders LEFT JOIN coo ON pattern_id = o_orderkey GROUP BY 1")
def row_stats(spark, d):
    """Ones, multi and total of every pattern, empty ones included."""
    return matrix(spark, d).row_stats()


@query(f"WITH {COO} SELECT pattern_id, total FROM (SELECT o_orderkey AS pattern_id, CAST(coalesce(sum(cnt), 0) AS BIGINT) AS total FROM orders LEFT JOIN coo ON pattern_id = o_orderkey GROUP BY 1)")
def row_sum(spark, d):
    return matrix(spark, d).sum(axis=1)


@query(f"WITH {COO} SELECT CAST(p_partkey AS INTEGER) AS pixel_id, CAST(coalesce(sum(cnt), 0) AS BIGINT) AS total FROM part LEFT JOIN coo ON pixel_id = p_partkey GROUP BY 1")
def pixel_sum(spark, d):
    return matrix(spark, d).sum(axis=0)


@query(f"WITH {COO} SELECT CAST(sum(cnt) AS BIGINT) AS total FROM coo")
def total_sum(spark, d):
    return matrix(spark, d).sum()


@query(f"WITH {COO} SELECT round((SELECT sum(cnt) FROM coo)::DOUBLE / (SELECT count(*) FROM orders), 6) AS mean_count")
def mean_count(spark, d):
    return spark.createDataFrame([(round(matrix(spark, d).get_mean_count(), 6),)], "mean_count double")


@query(f"""WITH {COO} SELECT n AS num_data, s1, sm, 4 * (2 * n + s1 + 2 * sm) AS nbytes, round((4 * (2 * n + s1 + 2 * sm))::DOUBLE / (4.0::DOUBLE * n * p), 9) AS sparsity
FROM (SELECT (SELECT count(*) FROM orders) AS n, (SELECT count(*) FROM part) AS p, (SELECT count(*) FROM coo WHERE cnt = 1) AS s1, (SELECT count(*) FROM coo WHERE cnt > 1) AS sm)""")
def nbytes_sparsity(spark, d):
    return matrix(spark, d).sizes().withColumn("sparsity", F.round("sparsity", 9))


@query(f"WITH {COO} SELECT pattern_id - 100 AS pattern_id, pixel_id, cnt FROM coo WHERE pattern_id >= 100 AND pattern_id < 900")
def row_slice(spark, d):
    return matrix(spark, d)[100:900].entries


@query(f"WITH {COO} SELECT (pattern_id - 1) // 3 AS pattern_id, pixel_id, cnt FROM coo WHERE pattern_id >= 1 AND pattern_id % 3 = 1")
def row_stride(spark, d):
    return matrix(spark, d)[1::3].entries


@query(f"WITH {COO}, n AS (SELECT count(*) AS n FROM orders) SELECT n - 1 - pattern_id AS pattern_id, pixel_id, cnt FROM coo CROSS JOIN n")
def row_reverse(spark, d):
    return matrix(spark, d)[::-1].entries


@query(f"WITH {COO}, kept AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders WHERE o_orderstatus = 'F') SELECT pos AS pattern_id, pixel_id, cnt FROM coo JOIN kept ON pattern_id = o_orderkey")
def row_mask(spark, d):
    wanted = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("pattern_id"))
    return matrix(spark, d).where_ids(wanted).entries


@query(f"WITH {COO}, idx(pos, id) AS (VALUES {', '.join(f'({k}, {i})' for k, i in enumerate(IDS))}) SELECT CAST(pos AS BIGINT) AS pattern_id, pixel_id, cnt FROM coo JOIN idx ON pattern_id = id")
def row_gather(spark, d):
    """Order and repetitions of the ids are kept."""
    return matrix(spark, d).take(IDS).entries


@query(f"WITH {COO}, idx(pos, id) AS (VALUES {', '.join(f'({k}, {i})' for k, i in enumerate(PIX))}) SELECT pattern_id, CAST(pos AS INTEGER) AS pixel_id, cnt FROM coo JOIN idx ON pixel_id = id")
def pixel_gather(spark, d):
    return matrix(spark, d)[:, PIX].entries


@query(f"WITH {COO}, a(ap, ai) AS (VALUES {', '.join(f'({k}, {i})' for k, i in enumerate(IDS))}), b(bp, bi) AS (VALUES {', '.join(f'({k}, {i})' for k, i in enumerate(range(0, 200, 2)))}) SELECT CAST(ap AS BIGINT) AS pattern_id, CAST(bp AS INTEGER) AS pixel_id, cnt FROM coo JOIN a ON pattern_id = ai JOIN b ON pixel_id = bi")
def outer_select(spark, d):
    return matrix(spark, d)[IDS, slice(0, 200, 2)].entries


@query(f"WITH {COO} SELECT CAST(p_partkey AS INTEGER) AS pixel_id, CAST(coalesce(cnt, 0) AS BIGINT) AS cnt FROM part LEFT JOIN coo ON pixel_id = p_partkey AND pattern_id = 33")
def single_row_dense(spark, d):
    import pandas as pd

    row = matrix(spark, d)[33]
    return spark.createDataFrame(pd.DataFrame({"pixel_id": np.arange(len(row)), "cnt": row}), "pixel_id int, cnt bigint")


@query(f"WITH {COO} SELECT o_orderkey // 128 AS chunk_id, CAST(coalesce(sum(cnt), 0) AS BIGINT) AS total FROM orders LEFT JOIN coo ON pattern_id = o_orderkey GROUP BY 1")
def chunk_sums(spark, d):
    return matrix(spark, d).chunk_sums(128)


@query(f"""WITH {COO}, s AS (SELECT o_orderkey AS pattern_id, count(*) FILTER (WHERE cnt = 1) AS ones, count(*) FILTER (WHERE cnt > 1) AS multi FROM orders LEFT JOIN coo ON pattern_id = o_orderkey GROUP BY 1)
SELECT pattern_id, ones, multi, CAST(sum(ones) OVER (ORDER BY pattern_id) - ones AS BIGINT) AS ones_at, CAST(sum(multi) OVER (ORDER BY pattern_id) - multi AS BIGINT) AS multi_at FROM s""")
def prefix_offsets(spark, d):
    return matrix(spark, d).offsets()


@query(f"WITH {COO}, n AS (SELECT count(*) AS n FROM orders) SELECT pattern_id, pixel_id, cnt FROM coo WHERE pattern_id < 500 UNION ALL SELECT pattern_id - (n - 700) + 500, pixel_id, cnt FROM coo, n WHERE pattern_id >= n - 700")
def concat_rows(spark, d):
    m = matrix(spark, d)
    return pf.concat_rows([m[:500], m[-700:]]).entries


@query(f"WITH {COO}, p AS (SELECT count(*) AS p FROM part) SELECT pattern_id, pixel_id, cnt FROM coo UNION ALL SELECT pattern_id, CAST(p + pixel_id AS INTEGER), cnt * cnt FROM coo, p")
def concat_cols(spark, d):
    m = matrix(spark, d)
    return pf.concat_pixels([m, m**2]).entries


@query(f"WITH {COO} SELECT CASE WHEN pattern_id < 400 THEN 0 WHEN pattern_id < 1000 THEN 1 ELSE 2 END AS source_id, pattern_id - CASE WHEN pattern_id < 400 THEN 0 WHEN pattern_id < 1000 THEN 400 ELSE 1000 END AS source_row, pattern_id, pixel_id, cnt FROM coo")
def list_gather(spark, d):
    """All members of a virtual list of three, with the member and row each entry comes from."""
    m = matrix(spark, d)
    members = pf.source_list([m[:400], m[400:1000], m[1000:]])
    long = long_counts(members)
    return members.select("source_id", "source_row", "pattern_id").join(long, "pattern_id").select("source_id", "source_row", "pattern_id", "pixel_id", "cnt")


@query(f"WITH {COO} SELECT pattern_id, pixel_id, cnt FROM coo EXCEPT ALL SELECT pattern_id, pixel_id, CASE WHEN pattern_id % 5 = 0 THEN cnt + 1 ELSE cnt END FROM coo")
def set_diff(spark, d):
    m = matrix(spark, d)
    other = PatternFrame(m.meta, entries=m.entries.withColumn("cnt", F.when(F.col("pattern_id") % 5 == 0, F.col("cnt") + 1).otherwise(F.col("cnt"))), dim=m.dim)
    return m.difference(other)


@query("""WITH v AS (SELECT DISTINCT user_id, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) // 3600 AS hour FROM events),
g AS (SELECT user_id, hour, hour - row_number() OVER (PARTITION BY user_id ORDER BY hour) AS g FROM v)
SELECT user_id, min(hour) AS first, max(hour) + 1 AS past FROM g GROUP BY user_id, g""")
def coalesce_runs(spark, d):
    hours = table(spark, d, "events").select("user_id", F.expr("unix_timestamp(date_trunc('hour', ts)) div 3600").alias("hour")).distinct()
    return pf.coalesce_runs(hours, "hour", "hour", ["user_id"]).select("user_id", "first", "past")


@query(f"WITH {COO} SELECT o_orderkey AS pattern_id, 0 AS j, CAST(coalesce(sum(cnt * (pixel_id % 7)), 0) AS BIGINT) AS value FROM orders LEFT JOIN coo ON pattern_id = o_orderkey GROUP BY 1")
def matmul_k1(spark, d):
    w = table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("pixel_id"), F.lit(0).alias("j"), (F.col("p_partkey") % 7).alias("w"))
    return (matrix(spark, d) @ w).withColumn("value", F.col("value").cast("long"))


@query(f"""WITH {COO}, w AS (SELECT CAST(p_partkey AS INTEGER) AS px, j, (p_partkey * (j + 1)) % 11 AS w FROM part, (VALUES (0), (1), (2)) AS t(j))
SELECT o_orderkey AS pattern_id, j, CAST(coalesce(sum(s), 0) AS BIGINT) AS value FROM (SELECT o_orderkey, j FROM orders, (VALUES (0), (1), (2)) AS t(j)) LEFT JOIN (SELECT pattern_id, j AS jj, sum(cnt * w) AS s FROM coo JOIN w ON px = pixel_id GROUP BY 1, 2) ON pattern_id = o_orderkey AND jj = j GROUP BY 1, 2""")
def matmul_k3(spark, d):
    j = spark.range(3).select(F.col("id").cast("int").alias("j"))
    w = table(spark, d, "part").crossJoin(F.broadcast(j)).select(F.col("p_partkey").cast("int").alias("pixel_id"), "j", (F.col("p_partkey") * (F.col("j") + 1) % 11).alias("w"))
    return (matrix(spark, d) @ w).withColumn("value", F.col("value").cast("long"))


@query(f"WITH {COO} SELECT pattern_id, pixel_id, cnt * cnt AS cnt FROM coo")
def pow2(spark, d):
    return (matrix(spark, d) ** 2).entries


@query("SELECT o_orderkey AS pattern_id, p AS ones, CAST(0 AS BIGINT) AS multi, p AS total FROM orders, (SELECT count(*) AS p FROM part)")
def pow0(spark, d):
    """A matrix to the power 0 is all ones; totals need no single entry."""
    return (matrix(spark, d) ** 0).row_stats()


@query("SELECT vec_id AS pattern_id, CAST(i - 1 AS INTEGER) AS pixel_id, CAST(floor(abs(CAST(embedding[i] AS DOUBLE)) * 20.0::DOUBLE) AS BIGINT) AS cnt FROM embeddings, (SELECT unnest(range(1, 65)) AS i) WHERE floor(abs(CAST(embedding[i] AS DOUBLE)) * 20.0::DOUBLE) > 0")
def dense_to_sparse(spark, d):
    rows = _counts(spark, d)
    return from_dense_rows(rows, rows.count(), 64).entries


@query("SELECT vec_id AS pattern_id, CAST(sum(CAST(floor(abs(CAST(embedding[i] AS DOUBLE)) * 20.0::DOUBLE) AS BIGINT) * i) AS BIGINT) AS weighted FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1")
def densify(spark, d):
    """Sparse to dense arrays; their weighted sum tells every place."""
    rows = _counts(spark, d)
    dense = from_dense_rows(rows, rows.count(), 64).todense()
    return dense.select("pattern_id", F.aggregate(F.transform("values", lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x).alias("weighted"))


@query("SELECT CAST(i AS BIGINT) AS pattern_id, CAST(p AS INTEGER) AS pixel_id, CAST(2 AS BIGINT) AS cnt FROM range(40) AS a(i), range(25) AS b(p)")
def fill_value(spark, d):
    return filled(spark, 40, 25, 2).entries


@query("SELECT o_orderkey AS pattern_id, o_orderkey % 2 = 0 OR o_orderkey % 3 < 2 AS in_order FROM orders")
def order_check(spark, d):
    """Whether places ascend: rows are made with the last two places swapped where id is odd and id % 3 = 2."""
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("pattern_id"))
    swap = (F.col("pattern_id") % 2 == 1) & (F.col("pattern_id") % 3 == 2)
    rows = ids.select("pattern_id", F.when(swap, F.array(F.lit(1), F.lit(9), F.lit(4))).otherwise(F.array(F.lit(1), F.lit(4), F.lit(9))).alias("place_ones"), F.array(F.lit(2)).alias("place_multi"), F.array(F.lit(5)).alias("count_multi"))
    return PatternFrame(pf.PatternMeta(0, 16), rows=rows).order_flags()


@query(f"WITH {COO} SELECT pattern_id, pixel_id, cnt FROM coo WHERE cnt > 1")
def multi_entries(spark, d):
    return matrix(spark, d).multi_entries()


@query(f"WITH {COO} SELECT pattern_id, pixel_id, cnt FROM coo")
def compact_roundtrip(spark, d):
    """Long to compact and back."""
    m = matrix(spark, d)
    return PatternFrame(m.meta, rows=m.rows).entries


@query(f"WITH {COO} SELECT pattern_id, pixel_id, cnt FROM coo")
def count_file_roundtrip(spark, d):
    """Written to a binary count file and scanned again."""
    from countlake.sources.countsource import read_counts, write_counts

    path = fresh_path(spark, "counts").removeprefix("file://") + ".emc"
    write_counts(matrix(spark, d), path)
    return read_counts(spark, path).entries


@query(f"WITH {COO} SELECT pattern_id - 300 AS pattern_id, pixel_id, cnt FROM coo WHERE pattern_id >= 300 AND pattern_id < 420")
def count_file_slice(spark, d):
    """A slice of a file: the range reaches the scan."""
    from countlake.sources.countsource import read_counts, write_counts

    path = fresh_path(spark, "counts").removeprefix("file://") + ".emc"
    write_counts(matrix(spark, d), path)
    return read_counts(spark, path)[300:420].entries


@query("SELECT vec_id AS pattern_id, CAST(i - 1 AS INTEGER) AS pixel_id, CAST(floor(abs(CAST(embedding[i] AS DOUBLE)) * 20.0::DOUBLE) AS BIGINT) AS cnt FROM embeddings, (SELECT unnest(range(1, 65)) AS i) WHERE floor(abs(CAST(embedding[i] AS DOUBLE)) * 20.0::DOUBLE) > 0")
def collect_images(spark, d):
    """A stream of dense images, collected."""
    path = f"{d}/embeddings.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(stream_path(spark, path))
    return long_counts(collect_stream(stream.select(F.col("vec_id").alias("pattern_id"), _embedded().alias("values")), 64))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def object_tree(spark, d):
    """A node of nested objects, held as VARIANT."""
    return table(spark, d, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "long").alias("k"))


@query("""WITH p AS (SELECT DISTINCT ON (pattern_id) * FROM pattern_rows WHERE place_ones IS NOT NULL)
SELECT pattern_id, 'count below 2' AS problem FROM p WHERE list_min(count_multi) < 2
UNION ALL SELECT pattern_id, 'no such pixel' FROM p WHERE list_min(place_multi) < 0 OR list_max(place_multi) > 4095 OR list_min(place_ones) < 0 OR list_max(place_ones) > 4095""")
def violations(spark, d):
    """Patterns that break the layout's invariants."""
    rows = table(spark, d, "pattern_rows").where("place_ones is not null").dropDuplicates(["pattern_id"]).select("pattern_id", "place_ones", "place_multi", "count_multi")
    return PatternFrame(pf.PatternMeta(0, 4096), rows=rows).violations()


@query("""WITH p AS (SELECT DISTINCT ON (pattern_id) * FROM pattern_rows WHERE place_ones IS NOT NULL)
SELECT source_id, count(*) AS patterns, CAST(sum(len(place_ones)) AS BIGINT) AS s1, CAST(sum(len(place_multi)) AS BIGINT) AS sm, CAST(4 * (2 * count(*) + sum(len(place_ones)) + 2 * sum(len(place_multi))) AS BIGINT) AS nbytes FROM p GROUP BY source_id""")
def source_sizes(spark, d):
    """Sizes of the members of a list of sources, repeated deliveries counted once."""
    rows = table(spark, d, "pattern_rows").where("place_ones is not null").dropDuplicates(["pattern_id"])
    m = PatternFrame(pf.PatternMeta(0, 4096), rows=rows.select("pattern_id", "place_ones", "place_multi", "count_multi"))
    s = m.row_stats().join(rows.select("pattern_id", "source_id"), "pattern_id").groupBy("source_id")
    s = s.agg(F.count("*").alias("patterns"), F.sum("ones").alias("s1"), F.sum("multi").alias("sm"))
    return s.withColumn("nbytes", 4 * (2 * F.col("patterns") + F.col("s1") + 2 * F.col("sm")))


@query("SELECT * FROM (VALUES ('age', 'attr', '3'), ('name', 'attr', '\"n\"'), ('new', 'attr', '1.5')) AS t(path, kind, body)")
def object_merge(spark, d):
    """An object tree with another merged into it: what the second does not name survives."""
    from countlake.sources.objects import merge, to_nodes

    both = merge(to_nodes(spark, {"name": "n", "age": 2}), to_nodes(spark, {"age": 3, "new": 1.5}), overwrite=True)
    return both.where("kind = 'attr'").select(F.expr("substring(path, 2)").alias("path"), "kind", F.to_json("value").alias("body"))
