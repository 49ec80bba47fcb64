"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countlake.llm import hnsw, leakage, mcl, quantiles, residue, tokenizer
from countlake.llm.vectors import pattern_vectors
from countlake.session import cut, table


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return cut(pattern_vectors(table(spark, d, "pattern_rows"), table(spark, d, "sources"), table(spark, d, "pixels")), "vectors", release=True)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of patterns of the same Markov cluster."""
    return mcl.cluster_pairs(mcl.pattern_clusters(_vectors(spark, d)))


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Every cluster with its size and its three most typical patterns."""
    return mcl.describe_clusters(mcl.pattern_clusters(_vectors(spark, d)))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a pattern that has five neighbours at cosine 0.6 or more with one of its five nearest."""
    return hnsw.case_pairs(hnsw.nearest_vectors(_vectors(spark, d), k=5, floor=mcl.THRESHOLD), 5)


def p2_source(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of ones, multi and count_multi per source, combined from the days."""
    return quantiles.read_quantiles(quantiles.source_sketches(cut(quantiles.day_sketches(table(spark, d, "pattern_rows")), "days")), ["source_id", "measure"], quantiles.QS)


def p2_source_day(spark: SparkSession, d: str) -> DataFrame:
    """The same per source and day of taken_at (as text, null where it is unknown)."""
    days = quantiles.read_quantiles(quantiles.day_sketches(table(spark, d, "pattern_rows")), ["source_id", "day", "measure"], quantiles.QS)
    return days.withColumn("day", F.col("day").cast("string"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, ids): every text by byte_bpe_50k."""
    return tokenizer.encode_texts(table(spark, d, "documents"))


def p6_text(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text): every text encoded and decoded again; null texts come back empty."""
    return tokenizer.decode_ids(tokenizer.encode_texts(table(spark, d, "documents")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, item_id): documents with a passage of an evaluation item."""
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id): documents with text the publishing system left in them."""
    return residue.residue(table(spark, d, "documents")).select("doc_id").distinct()


def p8_kinds(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, kind, route): the same with what was found, and by which route."""
    return residue.residue(table(spark, d, "documents"))


def queries() -> dict:
    return {"p2_source": p2_source, "p2_source_day": p2_source_day, "p6_ids": p6_ids, "p6_text": p6_text, "p7_found": p7_found, "p8_found": p8_found, "p8_kinds": p8_kinds, "p3_found": p3_found, "p3_clusters": p3_clusters, "p4_found": p4_found}


_PAIRS = """WITH bad AS (SELECT DISTINCT s.source_id, p.pixel_id FROM sources s JOIN pixels p USING (detector_id) WHERE (p.mask & 2) = 2),
pr AS (SELECT DISTINCT ON (pattern_id) pattern_id, source_id, place_ones, place_multi, count_multi FROM pattern_rows),
al AS (SELECT pattern_id, source_id, unnest(place_ones) AS px, 1 AS c FROM pr UNION ALL SELECT pattern_id, source_id, unnest(place_multi), unnest(count_multi) FROM pr),
en AS (SELECT pattern_id, px, CAST(least(c, 4) AS BIGINT) AS c FROM al WHERE c >= 1 AND px BETWEEN 0 AND 4095 AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source_id = al.source_id AND bad.pixel_id = al.px)),
nm AS (SELECT pattern_id, sum(c * c) AS n2 FROM en GROUP BY 1 HAVING count(*) >= 50),
ok AS (SELECT en.*, n2 FROM en JOIN nm USING (pattern_id)),
pa AS (SELECT a.pattern_id AS id_a, b.pattern_id AS id_b, round(sum(a.c * b.c) / sqrt((any_value(a.n2) * any_value(b.n2))::DOUBLE), 12) AS cos FROM ok a JOIN ok b ON a.px = b.px AND a.pattern_id < b.pattern_id GROUP BY 1, 2 HAVING cos >= 0.6)"""
_MEASURES = """WITH pr AS (SELECT pattern_id, source_id, min(CAST(taken_at AS DATE)) AS day, min(coalesce(len(place_ones), ones)) AS o, min(coalesce(len(place_multi), multi)) AS m, min(count_multi) AS c FROM pattern_rows WHERE pattern_id IS NOT NULL AND source_id IS NOT NULL GROUP BY 1, 2),
v AS (SELECT source_id, day, 'ones' AS measure, o AS v FROM pr UNION ALL SELECT source_id, day, 'multi', m FROM pr UNION ALL SELECT source_id, day, 'count_multi', unnest(c) FROM pr),
g AS (SELECT source_id, day, measure, list_sort(list(v)) AS l, count(*) AS n FROM v WHERE v IS NOT NULL GROUP BY 1, 2, 3)"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the same: exact percentiles of groups too small to be collapsed, and cosines
    of all pairs. The others are tested against brute force."""
    ranks = ", ".join(f"CAST(l[CAST(greatest(ceil({q}::DOUBLE * n), 1) AS BIGINT)] AS DOUBLE) AS p{q * 100:g}" for q in quantiles.QS)
    return {
        "p2_source_day": f"{_MEASURES} SELECT source_id, CAST(day AS VARCHAR) AS day, measure, n, CAST(0 AS BIGINT) AS rank_error, {ranks} FROM g",
        "p6_text": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p3_found": f"{_PAIRS} SELECT id_a, id_b FROM pa",
        "p4_found": f"""{_PAIRS}, bo AS (SELECT id_a AS q, id_b AS o, cos FROM pa UNION ALL SELECT id_b, id_a, cos FROM pa),
rk AS (SELECT q, o, row_number() OVER (PARTITION BY q ORDER BY cos DESC, o) AS r, count(*) OVER (PARTITION BY q) AS n FROM bo)
SELECT DISTINCT least(q, o) AS id_a, greatest(q, o) AS id_b FROM rk WHERE n >= 5 AND r <= 5""",
    }
