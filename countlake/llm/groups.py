"""Linked groups of vectors: the components of a graph of links, and exact cosines inside them.

A group is compared as a whole, whatever its size: small ones are packed into batches of about PACK_ROWS rows, one of
more than GROUP_ROWS rows is cut into blocks and every pair of blocks is multiplied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countlake.llm.vectors import NUM_PIX, binary_parts, unpack
from countlake.session import cut, small

#: A group of more rows is cut into blocks of so many rows.
GROUP_ROWS, BLOCK_ROWS = 128, 2048
#: Rows of small groups that are multiplied at once, and rows a task of them should have.
PACK_ROWS, TASK_ROWS, LEAST_ROWS = 192, 50_000, 1_000

#: (ids of the rows, ids of the columns, cosines, whether rows and columns are the same) to (a, b, cos); what is not to be compared is -inf.
Solve = Callable[[np.ndarray, np.ndarray, np.ndarray, bool], tuple[np.ndarray, np.ndarray, np.ndarray]]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of (id_a, id_b): root is the smallest id of its component.

    Large and small stars alternate until they change nothing, so the rounds are as many as it takes (about the logarithm of the longest
    path). Aggregates have partial sums; no component is collected.
    """
    stars = edges.select(F.greatest("id_a", "id_b").alias("u"), F.least("id_a", "id_b").alias("v")).where("u <> v")
    last = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        turned = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        stars = cut(turned.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        state = stars.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 7))")).first()
        if state == last:
            break
        last = state
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _side(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = rows.combine_chunks()
    owner, pixel, count = unpack(*binary_parts(rows.column("vec").chunk(0)))
    dense = np.zeros((rows.num_rows, NUM_PIX), np.float32)
    dense[owner, pixel] = count
    return np.asarray(rows.column("pattern_id")), dense, np.asarray(rows.column("norm2")).astype(np.float64)


def exact_cosines(a: np.ndarray, norm2_a: np.ndarray, b: np.ndarray, norm2_b: np.ndarray) -> np.ndarray:
    """Cosines to 12 digits of rows of counts; whole numbers below 2 ** 24 are exact in float32."""
    return np.round((a @ b.T).astype(np.float64) / np.sqrt(norm2_a[:, None] * norm2_b), 12)


def _packed(solve: Solve, names: list[str], pack: int):
    def one(rows: pa.Table) -> pa.RecordBatch:
        ids, dense, norm2 = _side(rows)
        cos, cell = exact_cosines(dense, norm2, dense, norm2), np.asarray(rows.column("cell"))
        cos[cell[:, None] != cell] = -np.inf
        np.fill_diagonal(cos, -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in solve(ids, ids, cos, True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                part = pa.Table.from_batches([batch])
                held = part if held is None else pa.concat_tables([held, part])
            if held is None or (batch is not None and not batch.num_rows):
                continue
            cell = np.asarray(held.column("cell"))
            ends = np.nonzero(cell[1:] != cell[:-1])[0] + 1
            if batch is None:
                ends = np.r_[ends, len(cell)]
            at = 0
            while len(ends) and at < ends[-1]:
                i = int(np.searchsorted(ends, at + pack))
                if i == len(ends) and batch is not None:
                    break  # more rows are to come
                end = int(ends[min(i, len(ends) - 1)])
                yield one(held.slice(at, end - at))
                at = end
            held = held.slice(at) if at < len(cell) else None

    return run


def _block_pairs(solve: Solve, names: list[str]):
    def one(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        """One pair of blocks of a cell, or a block with itself."""
        blocks = [rows.filter(pc.equal(rows.column("block"), x)) for x in dict.fromkeys(k.as_py() for k in key[1:])]
        if not all(b.num_rows for b in blocks):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        sides = [_side(b) for b in blocks]
        (ids, dense, norm2), (others, dense2, norm2_2) = sides[0], sides[-1]
        cos = exact_cosines(dense, norm2, dense2, norm2_2)
        if len(sides) == 1:
            np.fill_diagonal(cos, -np.inf)
        return pa.table([pa.array(x) for x in solve(ids, others, cos, len(sides) == 1)], names=names)

    return one


def in_blocks(rows: DataFrame, blocks: DataFrame, solve: Solve, names: list[str], parts: int) -> DataFrame:
    """Every row of a cell with every other, by pairs of blocks. rows: (cell, pattern_id, vec, norm2); blocks: (cell, blocks)."""
    own = rows.join(small(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("pattern_id"), F.col("blocks")))
    # a row goes to every pair of blocks that its own takes part in
    own = own.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    own = own.select("cell", F.least("block", "with").alias("a"), F.greatest("block", "with").alias("b"), "block", "pattern_id", "vec", "norm2")
    pairs = own.repartition(max(parts, 4 * rows.sparkSession.sparkContext.defaultParallelism), "cell", "a", "b").groupBy("cell", "a", "b")
    return pairs.applyInArrow(_block_pairs(solve, names), f"{names[0]} long, {names[1]} long, {names[2]} double")


def compare_groups(vectors: DataFrame, groups: DataFrame, solve: Solve, names: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """What ``solve`` makes of the exact cosines of all pairs of each group. groups: (node, root), as by ``components``."""
    rows = vectors.join(groups.select(F.col("node").alias("pattern_id"), F.col("root").alias("cell")), "pattern_id").select("cell", "pattern_id", "vec", "norm2")
    large = cut(groups.groupBy(F.col("root").alias("cell")).count().where(F.col("count") > GROUP_ROWS).select("cell", F.ceil(F.col("count") / block_rows).alias("blocks")), "large-groups")
    n, cores = groups.count(), vectors.sparkSession.sparkContext.defaultParallelism
    parts = max(min(cores, -(-n // LEAST_ROWS)), -(-n // TASK_ROWS), 1)
    packed = rows.join(small(large), "cell", "left_anti").repartition(parts, "cell").sortWithinPartitions("cell", "pattern_id")
    found = packed.mapInArrow(_packed(solve, names, PACK_ROWS), f"{names[0]} long, {names[1]} long, {names[2]} double")
    return found if large.isEmpty() else found.unionByName(in_blocks(rows, large, solve, names, parts))
