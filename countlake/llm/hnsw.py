"""k nearest vectors: linked groups compared in full, or without a cosine floor a small-world graph per shard.

With a floor from THRESHOLD on, the links of ``mcl.links`` make groups, and every group is compared exactly, whatever its size.

Without one, a vector goes to TABLES shards, in each table next to the vectors whose MinHash cell it shares, so a
query is answered by the shards that hold its likely neighbours instead of by all. Shards are whole
cells, consecutive in a global range sort, of about SHARD_ROWS rows. A cell of more than
CELL_ROWS rows is compared as a whole: it is cut into blocks, every pair of blocks is multiplied exactly,
and the k best of each are merged, so a vector meets all rows of its cells whatever their number.

Within a shard the graph is kept as flat neighbour arrays, one per level. Its working distances come
from a signed hashing of the pixels to WORK_DIM values; the nodes the search settles on are ranked
again by the exact cosine. Shard results are merged per query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countlake.llm.groups import compare_groups, in_blocks
from countlake.llm.mcl import THRESHOLD, links
from countlake.llm.vectors import NUM_PIX, band_key, binary_parts, copy_groups, unpack
from countlake.session import cut, small

TABLES, WIDTH = 5, 2
TABLE_BITS = 12 * WIDTH
SHARD_ROWS, SHARD_MAX, OVERLAP = 384, 768, 0
WORK_DIM, SEED = 512, 20260202
#: A cell of more rows is compared as a whole, in blocks of so many rows.
CELL_ROWS, BLOCK_ROWS = 128, 2048
#: Rows a task of the search should have, and the least it gets while there are idle cores.
TASK_ROWS, LEAST_ROWS = 200_000, 4_000


@dataclass(frozen=True)
class Graph:
    """levels[0] holds all nodes: an array nodes x links, -1 where there is no link."""

    levels: list[np.ndarray]
    entry: int


def signed_hash(dim: int = WORK_DIM, num_pix: int = NUM_PIX, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, dim, num_pix), rng.choice([-1.0, 1.0], num_pix).astype(np.float32)


def node_levels(ids: np.ndarray, m: int) -> np.ndarray:
    """Level of each node, geometric with ratio 1/m, from a hash of its id: a rerun gives the same."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    u = ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return np.minimum((-np.log(u) / np.log(m)).astype(np.int64), 6)


def _choose(sims: np.ndarray, members: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(links of members to earlier members, diversified): node and target arrays.

    Nodes are inserted in the order of ``members``. Of its 2m most similar predecessors a node
    keeps those that are more similar to it than to any kept one, then fills up to m in order.
    """
    n = len(members)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = sims[np.ix_(members, members)]
    s = np.where(np.tri(n, k=-1, dtype=bool), s, -np.inf)
    width = min(2 * m, n - 1)
    cand = np.argpartition(-s, width - 1, axis=1)[:, :width]
    val = np.take_along_axis(s, cand, 1)
    order = np.argsort(-val, axis=1, kind="stable")
    cand, val = np.take_along_axis(cand, order, 1), np.take_along_axis(val, order, 1)
    valid = val > -np.inf
    real = members[cand]
    kept = np.zeros_like(valid)
    taken = np.zeros(n, np.int64)
    for c in range(width):
        near = np.where(kept[:, :c], sims[real[:, c, None], real[:, :c]], -np.inf).max(1, initial=-np.inf)
        kept[:, c] = valid[:, c] & (near < val[:, c]) & (taken < m)
        taken += kept[:, c]
    for c in range(width):
        fill = valid[:, c] & ~kept[:, c] & (taken < m)
        kept[:, c] |= fill
        taken += fill
    row, col = np.nonzero(kept)
    return members[row], real[row, col]


def _flat(node: np.ndarray, target: np.ndarray, sims: np.ndarray, n: int, cap: int) -> np.ndarray:
    """Both directions of the links as an n x cap array, the most similar first."""
    a, b = np.r_[node, target], np.r_[target, node]
    key = np.unique(a * n + b)
    a, b = key // n, key % n
    order = np.lexsort((-sims[a, b], a))
    a, b = a[order], b[order]
    start = np.searchsorted(a, np.arange(n))
    rank = np.arange(len(a)) - start[a]
    out = np.full((n, cap), -1, np.int64)
    ok = rank < cap
    out[a[ok], rank[ok]] = b[ok]
    return out


def build(sims: np.ndarray, ids: np.ndarray, m: int = 8) -> Graph:
    """The graph over the rows of a similarity matrix; rows are inserted in a hashed order of ids."""
    n, level = len(ids), node_levels(ids, m)
    # the highest first, as its nodes are the way in; the rest in hashed order
    order = np.lexsort(((ids * 2654435761) % 4294967291, -level))
    levels = []
    for at in range(int(level.max()) + 1):
        members = order[level[order] >= at]
        node, target = _choose(sims, members, m)
        levels.append(_flat(node, target, sims, n, 2 * m if at == 0 else m))
    return Graph(levels, int(order[0]))


def search(graph: Graph, sims: np.ndarray, ef: int = 24, expand: int = 4, radius: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities), rows x ef, of every row's search; -1 pads. The row itself is left out.

    All rows descend together: greedy steps on the upper levels, then a beam of width ef on level 0
    that starts at the entry found and at the row's own links and expands the best open nodes. With a
    radius, nodes less similar than it are expanded in the first step only: they are found, but lead no further.
    """
    n = len(sims)
    rows = np.arange(n)
    at = np.full(n, graph.entry)
    for links in reversed(graph.levels[1:]):
        active = rows
        while len(active):
            near = links[at[active]]
            val = np.where(near >= 0, sims[active[:, None], near], -np.inf)
            best = val.argmax(1)
            top = val[np.arange(len(active)), best]
            better = top > sims[active, at[active]]
            at[active[better]] = near[np.arange(len(active)), best][better]
            active = active[better]
    base = graph.levels[0]
    flat, width = sims.reshape(-1), base.shape[1] * expand
    seen = np.zeros(n * n, bool)
    seen[rows * n + rows] = True
    slot = np.zeros(n * n, np.int16)
    # a beam entry is 2 * node + (1 if expanded); -1 pads
    beam, score = np.full((n, ef), -1, np.int32), np.full((n, ef), -np.inf, np.float32)
    fresh, who, hops = np.c_[at, base], rows, 0
    while len(who):
        ok = fresh >= 0
        key = np.where(ok, fresh, 0) + (who * n)[:, None]
        ok &= ~seen.take(key)
        # the same node may stand twice in a row of fresh: the place written last keeps it
        place = np.broadcast_to(np.arange(fresh.shape[1], dtype=np.int16), fresh.shape)
        slot[key[ok]] = place[ok]
        ok &= slot.take(key) == place
        seen[key[ok]] = True
        both = np.concatenate([score[who], np.where(ok, flat.take(key), -np.inf)], axis=1)
        code = np.concatenate([beam[who], np.where(ok, 2 * fresh, -1).astype(np.int32)], axis=1)
        top = np.argpartition(both, both.shape[1] - ef, axis=1)[:, -ef:]
        top += (np.arange(len(who)) * both.shape[1])[:, None]
        both, code = both.reshape(-1).take(top), code.reshape(-1).take(top)
        open_ = np.where((code & 1) == 1, -np.inf, both)
        if hops:
            open_[open_ < radius] = -np.inf
        hops += 1
        pick = np.argpartition(open_, ef - expand, axis=1)[:, -expand:]
        pick += (np.arange(len(who)) * ef)[:, None]
        go = open_.reshape(-1).take(pick) > -np.inf
        node = np.where(go, code.reshape(-1).take(pick) >> 1, 0)
        code.reshape(-1)[pick[go]] |= 1
        beam[who], score[who] = code, both
        fresh = np.where(go[:, :, None], base[node], -1).reshape(len(who), width)
        live = go.any(1)
        who, fresh = who[live], fresh[live]
    return np.where(beam >= 0, beam >> 1, -1), score


def shard_neighbours(owner, pixel, count, norm2, ids, k: int, floor: float | None, ef: int, m: int, hashed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, neighbour row, exact cosine) of one shard: at most k for each row."""
    n = len(ids)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    bucket, sign = hashed
    dim = int(bucket.max()) + 1
    norm = np.sqrt(norm2.astype(np.float64))
    work = np.bincount(owner * dim + bucket[pixel], weights=sign[pixel] * count, minlength=n * dim).reshape(n, dim)
    work = (work / norm[:, None]).astype(np.float32)
    sims = work @ work.T
    # five standard deviations of the hashed similarity
    radius = -np.inf if floor is None else floor - 5.0 / np.sqrt(dim)
    beam, score = search(build(sims, ids, m), sims, ef, radius=radius)
    ok = (beam >= 0) & (score >= radius)
    row, col = np.nonzero(ok)
    if not len(row):
        return row, row, np.zeros(0)
    other = beam[row, col]
    dense = np.zeros((n, NUM_PIX), np.uint8)
    dense[owner, pixel] = count
    size = np.bincount(owner, minlength=n)
    start = np.r_[0, np.cumsum(size)[:-1]]
    reps = size[row]
    first = np.r_[0, np.cumsum(reps)[:-1]]
    entry = np.arange(int(reps.sum())) - np.repeat(first - start[row], reps)
    prod = dense[np.repeat(other, reps), pixel[entry]].astype(np.int64) * count[entry]
    cos = np.add.reduceat(prod, first) / (norm[row] * norm[other])
    if floor is not None:
        keep = cos >= floor
        row, other, cos = row[keep], other[keep], cos[keep]
    return _first(row, other, cos, ids, k)


def _first(row: np.ndarray, other: np.ndarray, cos: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row; ids are those of the others."""
    order = np.lexsort((ids[other], -np.round(cos, 12), row))
    row, other, cos = row[order], other[order], cos[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], other[rank < k], cos[rank < k]


def exact_neighbours(cos: np.ndarray, ids: np.ndarray, k: int, floor: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, cosine) of the k largest of each row of a matrix of exact cosines; ids are those of the columns."""
    width = min(k, cos.shape[1])
    least = np.partition(cos, cos.shape[1] - width, axis=1)[:, cos.shape[1] - width]
    # all that tie with the last one, so that the ids decide
    row, col = np.nonzero((cos >= least[:, None] - 1e-11) & (cos >= (-1.0 if floor is None else floor)))
    return _first(row, col, cos[row, col], ids, k)


def _nearest(k: int, floor: float | None):
    """The k best of each row in both directions, as ``groups.Solve``."""

    def solve(ids: np.ndarray, others: np.ndarray, cos: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, c = exact_neighbours(cos, others, k, floor)
        if same:
            return ids[a], others[b], c
        b2, a2, c2 = exact_neighbours(cos.T, ids, k, floor)
        return np.r_[ids[a], others[b2]], np.r_[others[b], ids[a2]], np.r_[c, c2]

    return solve


def _shards(k: int, floor: float | None, ef: int, m: int, shard_rows: int, shard_max: int):
    hashed = signed_hash()

    def solve(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        ids = np.asarray(rows.column("pattern_id"))
        parts = unpack(*binary_parts(rows.column("vec").chunk(0)))
        a, b, cos = shard_neighbours(*parts, np.asarray(rows.column("norm2")), ids, k, floor, ef, m, hashed)
        return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(cos)], names=["query_id", "neighbour_id", "cos"])

    def cut_at(cell: np.ndarray, final: bool) -> int | None:
        """Rows of the next shard, or None if more rows are needed first. No cell is larger than shard_max."""
        turn = np.nonzero(cell[1:] >> TABLE_BITS != cell[:-1] >> TABLE_BITS)[0] + 1
        if len(turn) and turn[0] <= shard_max:
            return int(turn[0])  # a shard is of one table, so it has each vector once
        if len(cell) <= shard_max:
            return len(cell) if final and len(cell) else None
        ends = np.nonzero(cell[1 : shard_max + 1] != cell[:shard_max])[0] + 1
        enough = ends[ends >= min(shard_rows, shard_max)]
        return int(enough[0] if len(enough) else ends[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                part = pa.Table.from_batches([batch])
                held = part if held is None else pa.concat_tables([held, part])
            if held is None:
                continue
            cell = np.asarray(held.column("cell"))
            at = 0
            while size := cut_at(cell[at:], batch is None):
                yield solve(held.slice(at, size))
                at += size
            held = held.slice(at)

    return run


def _cell_neighbours(distinct: DataFrame, k: int, floor: float | None, tables: int, ef: int, m: int, shard_rows: int, shard_max: int) -> DataFrame:
    cells = F.array(*[band_key(t, WIDTH) for t in range(tables)])
    rows = distinct.select("pattern_id", "vec", "norm2", F.explode(cells).alias("cell")).select("cell", "pattern_id", "vec", "norm2")
    large = cut(rows.groupBy("cell").count().where(F.col("count") > min(CELL_ROWS, shard_max)).select("cell", F.ceil(F.col("count") / BLOCK_ROWS).alias("blocks")), "large-cells")
    # tasks of about TASK_ROWS rows at any size
    n = distinct.count() * tables
    parts = max(min(distinct.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_ROWS)), -(-n // TASK_ROWS), 1)
    sharded = rows.join(small(large), "cell", "left_anti").repartitionByRange(parts, "cell").sortWithinPartitions("cell", "pattern_id")
    found = sharded.mapInArrow(_shards(k, floor, ef, m, shard_rows, shard_max), "query_id long, neighbour_id long, cos double")
    return found.unionByName(in_blocks(rows, large, _nearest(k, floor), ["query_id", "neighbour_id", "cos"], parts))


def nearest_vectors(
    vectors: DataFrame, k: int = 5, floor: float | None = None, tables: int = TABLES, ef: int = 24, m: int = 8, shard_rows: int = SHARD_ROWS, shard_max: int = SHARD_MAX, overlap: int = OVERLAP
) -> DataFrame:
    """(query_id, neighbour_id, cos, rank): the k most similar others of every vector.

    vectors: the columns of ``pattern_vectors``, pattern_id unique, best as a written table. cos is exact
    and rounded to 12 digits, ties go to the smaller neighbour_id. With ``floor`` only neighbours of at
    least that cosine count. Equal vectors are searched once, as the smallest id of their copies; they are
    each other's neighbours at cosine 1. A vector alone in the table has no row; an empty table gives none.
    From THRESHOLD on, ``links`` find the groups and each group is compared in full, so only a group that no link joins is
    missed. Below it or without a floor the shards are searched, which may miss neighbours; see the tests for the recall
    measured against brute force. Cells of more than CELL_ROWS or shard_max rows are compared in full, at the square of
    their rows; overlap has no effect, as no cell is parted.
    """
    copies = cut(copy_groups(vectors).select("pattern_id", "head"), "copies", release=True)
    distinct = vectors.join(copies.where("pattern_id <> head"), "pattern_id", "left_anti")
    if floor is not None and floor >= THRESHOLD:
        found = compare_groups(*links(distinct, floor), _nearest(k, floor), ["query_id", "neighbour_id", "cos"], BLOCK_ROWS)
    else:
        found = _cell_neighbours(distinct, k, floor, tables, ef, m, shard_rows, shard_max)
    found = found.select("query_id", "neighbour_id", F.round("cos", 12).alias("cos"))
    best = _best(found.groupBy("query_id", "neighbour_id").agg(F.max("cos").alias("cos")), k).drop("rank")
    best = cut(best, "neighbours", release=True)
    # the k + 1 smallest ids of each group of copies stand for all: first per salted part, then overall
    salted = copies.withColumn("salt", F.pmod(F.xxhash64("pattern_id"), F.lit(64)))
    some = salted.withColumn("r", F.row_number().over(Window.partitionBy("head", "salt").orderBy("pattern_id"))).where(F.col("r") <= k + 1).drop("salt", "r")
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("head").orderBy("pattern_id"))).where(F.col("r") <= k + 1).drop("r")
    stand = some.select(F.col("head").alias("neighbour_id"), F.col("pattern_id").alias("copy"))
    wide = best.join(stand, "neighbour_id", "left").select("query_id", F.coalesce("copy", "neighbour_id").alias("neighbour_id"), "cos")
    wide = _best(wide, k).drop("rank")
    asked = copies.select(F.col("head").alias("query_id"), F.col("pattern_id").alias("member"))
    wide = wide.join(asked, "query_id", "left").select(F.coalesce("member", "query_id").alias("query_id"), "neighbour_id", "cos")
    twins = copies.join(some.select("head", F.col("pattern_id").alias("neighbour_id")), "head").where("pattern_id <> neighbour_id").select(F.col("pattern_id").alias("query_id"), "neighbour_id", F.lit(1.0).alias("cos"))
    return _best(wide.unionByName(twins), k)


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("cos").desc(), "neighbour_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def case_pairs(neighbours: DataFrame, k: int = 5) -> DataFrame:
    """Distinct (id_a, id_b), id_a < id_b, of queries that have all k neighbours."""
    full = neighbours.withColumn("n", F.count("*").over(Window.partitionBy("query_id"))).where(F.col("n") == k)
    return full.select(F.least("query_id", "neighbour_id").alias("id_a"), F.greatest("query_id", "neighbour_id").alias("id_b")).distinct()
