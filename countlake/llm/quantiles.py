"""Mergeable percentiles with a deterministic error bound, by collapsing equal-size sorted buffers.

A sketch holds, per level, buffers of K sorted values that stand for FAN**level values each, and fewer
than K loose values of weight 1. When FAN buffers of a level are full they collapse into one of the next:
the K values at evenly spaced, centred positions of their merged order. A collapse into weight w
moves no rank by more than ceil(w / 2), so the sum of these over all collapses bounds every rank error;
the tree (FAN buffers to one, level by level) keeps that sum near n * log_FAN(n / K) / (2 K).
Collapsing depends on the order of arrival only in which buffers meet, never on chance.

A sketch travels as bytes: int64 n, error, levels, number of loose values, number of buffers per
level, then the values as float64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, FAN = 1024, 8


class Sketch:
    __slots__ = ("n", "error", "loose", "levels")

    def __init__(self):
        self.n, self.error, self.loose, self.levels = 0, 0, np.zeros(0), []

    def add(self, values: np.ndarray) -> Sketch:
        self.n += len(values)
        self._take(values)
        return self

    def _take(self, values: np.ndarray) -> None:
        both = np.concatenate([self.loose, values]) if len(self.loose) else values
        whole = len(both) // K * K
        if whole:
            self._push(0, list(np.sort(both[:whole].reshape(-1, K), axis=1)))
        self.loose = both[whole:]

    def _push(self, level: int, buffers: list[np.ndarray]) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        have = self.levels[level] = self.levels[level] + buffers
        whole = len(have) // FAN * FAN
        if whole:
            # sorted runs of FAN buffers of the same weight: every FAN-th value, from the middle of the first step
            merged = np.sort(np.stack(have[:whole]).reshape(-1, FAN * K), axis=1)
            self.levels[level] = have[whole:]
            self.error += (whole // FAN) * -(-(FAN ** (level + 1)) // 2)
            self._push(level + 1, list(merged[:, FAN // 2 :: FAN]))

    def merge(self, other: Sketch) -> Sketch:
        self.n += other.n
        self.error += other.error
        self._take(other.loose)
        for level, buffers in enumerate(other.levels):
            if buffers:
                self._push(level, buffers)
        return self

    def weighted(self) -> tuple[np.ndarray, np.ndarray]:
        parts = [(self.loose, 1)] + [(b, FAN**i) for i, bs in enumerate(self.levels) for b in bs]
        values = np.concatenate([p for p, _ in parts])
        weights = np.concatenate([np.full(len(p), w, np.int64) for p, w in parts])
        order = np.argsort(values, kind="stable")
        return values[order], weights[order]

    def quantiles(self, qs: list[float]) -> list[float]:
        """The values whose rank is that of each q, within ``rank_error``; ranks are 1 .. n, as ceil(q n)."""
        values, weights = self.weighted()
        upto = np.cumsum(weights)
        rank = np.clip(np.ceil(np.asarray(qs) * self.n), 1, self.n)
        return values[np.minimum(np.searchsorted(upto, rank), len(values) - 1)].tolist()

    @property
    def rank_error(self) -> int:
        """No returned value is more ranks than this away from the rank asked for."""
        return self.error

    def dump(self) -> bytes:
        head = [self.n, self.error, len(self.levels), len(self.loose), *(len(x) for x in self.levels)]
        return np.asarray(head, np.int64).tobytes() + np.concatenate([self.loose, *(b for bs in self.levels for b in bs)]).astype(np.float64).tobytes()

    @classmethod
    def load(cls, data: bytes) -> Sketch:
        s = cls()
        n, error, levels, loose = (int(x) for x in np.frombuffer(data, np.int64, 4))
        counts = np.frombuffer(data, np.int64, levels, 32)
        values = np.frombuffer(data, np.float64, offset=32 + 8 * levels)
        s.n, s.error, s.loose, at = n, error, values[:loose], loose
        for c in counts:
            s.levels.append(list(values[at : at + c * K].reshape(-1, K)))
            at += int(c) * K
        return s


def _held(groups: dict, keys: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*groups)) or [()] * len(keys)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)] + [pa.array([s.dump() for s in groups.values()], pa.binary())], names=[*keys, "sketch"])


def _kinds(df: DataFrame, keys: list[str]) -> tuple[list[pa.DataType], str]:
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [df.schema[k] for k in keys]
    return [to_arrow_type(f.dataType) for f in fields], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sketch binary"


#: Sketches held by a task at once; beyond it they are sent on as they are and merged later.
HELD = 20_000


def sketch_lists(rows: DataFrame, keys: list[str], values: str) -> DataFrame:
    """(keys, sketch): per-task sketches of an array<double> column; a task may send several per key.

    Nothing is shuffled: this is the partial aggregation. Null arrays, elements and NaN count nothing.
    """
    types, schema = _kinds(rows, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = pa.Table.from_batches([batch.select(keys)])
            distinct = codes.group_by(keys, use_threads=False).aggregate([])
            names = list(zip(*(distinct.column(k).to_pylist() for k in keys)))
            lookup = {x: i for i, x in enumerate(names)}
            owner = np.fromiter((lookup[x] for x in zip(*(codes.column(k).to_pylist() for k in keys))), np.int64, batch.num_rows)
            lists = batch.column(values)
            n = np.asarray(lists.value_lengths().fill_null(0))
            flat = np.asarray(lists.flatten().cast(pa.float64()).fill_null(np.nan))
            own = np.repeat(owner, n)
            ok = ~np.isnan(flat)
            own, flat = own[ok], flat[ok]
            order = np.argsort(own, kind="stable")
            own, flat = own[order], flat[order]
            cuts = np.searchsorted(own, np.arange(len(names) + 1))
            for i, name in enumerate(names):
                if cuts[i + 1] > cuts[i]:
                    groups.setdefault(name, Sketch()).add(flat[cuts[i] : cuts[i + 1]])
            if len(groups) > HELD:
                yield _held(groups, keys, types)
                groups = {}
        yield _held(groups, keys, types)

    return rows.select(*keys, values).mapInArrow(run, schema)


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sketch): one sketch per key. Days, slices or tasks combine this way, in any grouping.

    A key's sketches are merged one after another from a sorted partition, and first within salted
    parts of the key, so no task holds more than one sketch of a key at a time.
    """
    types, schema = _kinds(sketches, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, done = None, None, {}
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in keys]
            for key, data in zip(zip(*cols), batch.column("sketch").to_pylist()):
                if held is not None and key == name:
                    held.merge(Sketch.load(data))
                    continue
                if held is not None:
                    done[name] = held
                    if len(done) >= 500:
                        yield _held(done, keys, types)
                        done = {}
                name, held = key, Sketch.load(data)
        if held is not None:
            done[name] = held
        yield _held(done, keys, types)

    salted = sketches.select(*keys, "sketch", F.pmod(F.xxhash64("sketch"), F.lit(16)).alias("__salt"))
    part = salted.repartition(*keys, "__salt").sortWithinPartitions(*keys, "__salt", F.xxhash64("sketch")).select(*keys, "sketch").mapInArrow(run, schema)
    return part.repartition(*keys).sortWithinPartitions(*keys, F.xxhash64("sketch")).mapInArrow(run, schema)


def read_quantiles(sketches: DataFrame, keys: list[str], qs: list[float]) -> DataFrame:
    """(keys, n, rank_error, q..): the percentiles of each sketch; q0.5 becomes the column p50.

    rank_error bounds how many ranks a value may be away from the rank asked for.
    """
    names = [f"p{q * 100:g}".replace(".", "_") for q in qs]
    types, schema = _kinds(sketches, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            loaded = [Sketch.load(x) for x in batch.column("sketch").to_pylist()]
            answers = [s.quantiles(qs) for s in loaded]
            cols = [batch.column(k) for k in keys]
            cols += [pa.array([s.n for s in loaded], pa.int64()), pa.array([s.rank_error for s in loaded], pa.int64())]
            cols += [pa.array([a[i] for a in answers], pa.float64()) for i in range(len(qs))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, "n", "rank_error", *names])

    out = schema.rpartition(",")[0] + ", n long, rank_error long, " + ", ".join(f"{x} double" for x in names)
    return sketches.select(*keys, "sketch").mapInArrow(run, out)


def pattern_measures(patterns: DataFrame) -> DataFrame:
    """(source_id, day, measure, vals): the values of each pattern, every pattern once.

    ones and multi are the lengths of place_ones and place_multi; where the entries were lost, the
    recorded number counts, and where both are null nothing does. A pattern delivered again counts once:
    of its deliveries the smallest non-null value of each column. day is null where taken_at is.
    Patterns without an id or a source are left out.
    """
    once = (
        patterns.where("pattern_id is not null and source_id is not null")
        .select(
            "pattern_id", "source_id", F.to_date("taken_at").alias("day"), F.coalesce(F.when(F.col("place_ones").isNotNull(), F.size("place_ones")), F.col("ones")).alias("ones"),
            F.coalesce(F.when(F.col("place_multi").isNotNull(), F.size("place_multi")), F.col("multi")).alias("multi"), "count_multi",
        )
        .groupBy("pattern_id", "source_id")
        .agg(F.min("day").alias("day"), F.min("ones").alias("ones"), F.min("multi").alias("multi"), F.min("count_multi").alias("count_multi"))
    )
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(F.col(c).cast("double")))
    kinds = [F.struct(F.lit("ones").alias("measure"), one("ones").alias("vals")), F.struct(F.lit("multi").alias("measure"), one("multi").alias("vals")), F.struct(F.lit("count_multi").alias("measure"), F.col("count_multi").cast("array<double>").alias("vals"))]
    return once.select("source_id", "day", F.explode(F.array(*kinds)).alias("m")).select("source_id", "day", "m.measure", "m.vals").where("vals is not null")


QS = [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def day_sketches(patterns: DataFrame) -> DataFrame:
    """(source_id, day, measure, sketch): one sketch for each source, day and measure."""
    keys = ["source_id", "day", "measure"]
    return merge_sketches(sketch_lists(pattern_measures(patterns), keys, "vals"), keys)


def source_sketches(days: DataFrame) -> DataFrame:
    """(source_id, measure, sketch): the days of each source combined."""
    return merge_sketches(days.select("source_id", "measure", "sketch"), ["source_id", "measure"])
