"""PatternFrame: an N x P matrix of small counts as a Spark DataFrame.

Two layouts hold the same matrix, and either is derived from the other when an operation needs it:
``rows`` has one row per pattern with the places of ones and the places and counts above one;
``entries`` has one row per non-zero count. Patterns without entries are rows as well, so next to
``entries`` there is ``dim``, the ids 0 .. N-1.

What needs no other pattern (totals, sizes, powers, sorting) works on ``rows`` without a shuffle; what
goes by pixel works on ``entries`` with partial sums. Ids are renumbered by arithmetic or by a join, never
by the order in which Spark happens to hold rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from countlake.functions.misc import html_card, pretty_size
from countlake.schema import ENTRIES, ROWS, PatternMeta, SparsePattern
from countlake.session import small

#: Values up to which a dense result is built without a warning.
DENSE_WARNING = 50_000_000
#: Entries of a long product or id list that may be broadcast (measured or known on the driver).
BLOCK = 4096
#: Ids of a list that are pushed into a scan one by one.
PUSHED_IDS = 10_000
#: Dense values in one Arrow batch.
DENSE_BATCH = 1 << 24


class PatternFrame:
    def __init__(self, meta: PatternMeta, rows: DataFrame | None = None, entries: DataFrame | None = None, dim: DataFrame | None = None):
        if rows is None and entries is None:
            raise ValueError("rows or entries are needed")
        self.meta, self._rows, self._entries, self._dim = meta, rows, entries, dim
        #: Of a scan: its rows and which of its pattern_ids these are, in order.
        self._scan: tuple[DataFrame, range] | None = None

    @classmethod
    def scanned(cls, meta: PatternMeta, rows: DataFrame, span: range | None = None) -> PatternFrame:
        """A frame over a source that prunes by pattern_id: selections are predicates on the source's own ids."""
        span = range(meta.num_data) if span is None else span
        step = span.step if span else 1
        col = F.col("pattern_id")
        kept = rows
        if span != range(meta.num_data):
            low, high = (min(span[0], span[-1]), max(span[0], span[-1])) if span else (0, -1)
            keep = (col >= low) & (col <= high)
            keep = keep & (F.pmod(col - F.lit(span[0]), F.lit(abs(step))) == 0) if abs(step) != 1 else keep
            new = F.expr(f"(pattern_id - {span.start}) div {step}").alias("pattern_id")
            kept = rows.where(keep).select(new, *[c for c in rows.columns if c != "pattern_id"])
        out = cls(PatternMeta(len(span), meta.num_pix), rows=kept)
        out._scan = (rows, span)
        return out

    # layouts ------------------------------------------------------------------------------------
    @property
    def spark(self) -> SparkSession:
        return (self._rows if self._rows is not None else self._entries).sparkSession

    @property
    def rows(self) -> DataFrame:
        """Compact layout; within a row places ascend."""
        if self._rows is None:
            pair = F.struct("pixel_id", F.col("cnt").cast("int").alias("cnt"))
            grouped = self._entries.groupBy("pattern_id").agg(F.array_sort(F.collect_list(pair)).alias("e"))
            one, many = F.filter("e", lambda x: x["cnt"] == 1), F.filter("e", lambda x: x["cnt"] != 1)
            empty = F.array().cast("array<int>")
            grouped = self.dim.join(grouped, "pattern_id", "left")
            self._rows = grouped.select(
                "pattern_id",
                F.coalesce(F.transform(one, lambda x: x["pixel_id"]), empty).alias("place_ones"),
                F.coalesce(F.transform(many, lambda x: x["pixel_id"]), empty).alias("place_multi"),
                F.coalesce(F.transform(many, lambda x: x["cnt"]), empty).alias("count_multi"),
            )
        return self._rows

    @property
    def entries(self) -> DataFrame:
        """Long layout: (pattern_id, pixel_id, cnt)."""
        if self._entries is None:
            ones = F.transform("place_ones", lambda x: F.struct(x.alias("pixel_id"), F.lit(1).cast("long").alias("cnt")))
            many = F.transform(F.arrays_zip("place_multi", "count_multi"), lambda x: F.struct(x["place_multi"].alias("pixel_id"), x["count_multi"].cast("long").alias("cnt")))
            self._entries = self._rows.select("pattern_id", F.inline(F.concat(ones, many)))
        return self._entries

    @property
    def dim(self) -> DataFrame:
        if self._dim is None:
            self._dim = self._rows.select("pattern_id") if self._rows is not None else self.spark.range(self.num_data).select(F.col("id").alias("pattern_id"))
        return self._dim

    # facts --------------------------------------------------------------------------------------
    @property
    def num_data(self) -> int:
        return self.meta.num_data

    @property
    def num_pix(self) -> int:
        return self.meta.num_pix

    @property
    def shape(self) -> tuple[int, int]:
        return self.num_data, self.num_pix

    ndim = 2

    def __len__(self) -> int:
        return self.num_data

    def _like(self, num_data: int | None = None, num_pix: int | None = None, **layout) -> PatternFrame:
        meta = PatternMeta(self.num_data if num_data is None else num_data, self.num_pix if num_pix is None else num_pix)
        return PatternFrame(meta, **layout)

    # selection ----------------------------------------------------------------------------------
    def __getitem__(self, index):
        """int: a dense row. slice, boolean mask, list or array of ids, DataFrame: patterns. A tuple
        selects patterns and then pixels (outer, not pointwise)."""
        if isinstance(index, tuple):
            if len(index) != 2:
                raise IndexError("at most two indices")
            out = self if isinstance(index[0], slice) and index[0] == slice(None) else self[index[0]]
            if isinstance(out, np.ndarray):
                return out[index[1]]
            return out.take_pixels(index[1])
        if isinstance(index, (int, np.integer)):
            return self.pattern(int(index)).dense()
        if isinstance(index, slice):
            return self.slice(index.start, index.stop, index.step)
        if isinstance(index, DataFrame):
            return self.where_ids(index)
        index = np.asarray(index)
        if index.dtype == bool:
            if index.shape != (self.num_data,):
                raise IndexError(f"a mask needs {self.num_data} values")
            return self.take(np.flatnonzero(index))
        if index.size == 0:
            return self.slice(0, 0)
        if index.ndim != 1 or not np.issubdtype(index.dtype, np.integer):
            raise IndexError("an index is an integer, a slice, a mask or a list of integers")
        return self.take(index)

    def _norm(self, i: int) -> int:
        if not -self.num_data <= i < self.num_data:
            raise IndexError(f"{i} is not a pattern of {self.num_data}")
        return i % self.num_data

    def pattern(self, i: int) -> SparsePattern:
        """One pattern; negative ids count from the end."""
        at = self._norm(i)
        rows, at = (self.rows, at) if self._scan is None else (self._scan[0], self._scan[1][at])
        row = rows.where(F.col("pattern_id") == at).first()
        if row is None:
            return SparsePattern(self.num_pix, [], [], [])
        return SparsePattern(self.num_pix, row.place_ones, row.place_multi, row.count_multi)

    def slice(self, start: int | None = None, stop: int | None = None, step: int | None = None) -> PatternFrame:
        """Python's slice rules; a range predicate on pattern_id that reaches the scan."""
        a, b, c = slice(start, stop, step).indices(self.num_data)
        if self._scan is not None:
            rows, span = self._scan
            return PatternFrame.scanned(self.meta, rows, span[slice(start, stop, step)])
        n = len(range(a, b, c))
        col = F.col("pattern_id")
        if c > 0:
            keep = (col >= a) & (col < b)
        else:
            keep = (col <= a) & (col > b)
        if abs(c) != 1:
            keep = keep & (F.pmod(col - F.lit(a), F.lit(abs(c))) == 0)
        new = F.expr(f"(pattern_id - {a}) div {c}").alias("pattern_id")
        move = lambda df: df.where(keep).select(new, *[x for x in df.columns if x != "pattern_id"])
        if self._rows is not None:
            return self._like(num_data=n, rows=move(self._rows))
        return self._like(num_data=n, entries=move(self._entries), dim=move(self.dim))

    def take(self, ids: Sequence[int] | DataFrame, num_data: int | None = None) -> PatternFrame:
        """Patterns in the order of ``ids``, repeated as often as they stand there.

        ids: integers, or a DataFrame (out_pos, pattern_id) with out_pos 0 .. n-1 and n in num_data.
        """
        if not isinstance(ids, DataFrame):
            ids = [self._norm(int(i)) for i in ids]
            num_data = len(ids)
            if self._scan is not None:
                return self._scan_take(ids)
            table = pa.table({"out_pos": pa.array(range(num_data), pa.int64()), "pattern_id": pa.array(ids, pa.int64())})
            ids = self.spark.createDataFrame(table)
        elif num_data is None:
            num_data = ids.count()
        ids = small(ids.select("out_pos", "pattern_id"))
        move = lambda df: df.join(ids, "pattern_id").select(F.col("out_pos").alias("pattern_id"), *[x for x in df.columns if x != "pattern_id"])
        if self._rows is not None:
            return self._like(num_data=num_data, rows=move(self._rows))
        return self._like(num_data=num_data, entries=move(self._entries), dim=move(self.dim))

    def _scan_take(self, ids: list[int]) -> PatternFrame:
        """A list of ids reaches the source: as the list itself up to PUSHED_IDS of them, else as their extent."""
        rows, span = self._scan
        own = [span[i] for i in ids]
        some = sorted(set(own))
        kept = rows.where(F.col("pattern_id").isin(some) if len(some) <= PUSHED_IDS else F.col("pattern_id").between(some[0], some[-1]))
        table = pa.table({"out_pos": pa.array(range(len(own)), pa.int64()), "pattern_id": pa.array(own, pa.int64())})
        moved = kept.join(small(self.spark.createDataFrame(table)), "pattern_id").select(F.col("out_pos").alias("pattern_id"), *[c for c in rows.columns if c != "pattern_id"])
        return self._like(num_data=len(own), rows=moved)

    def where_ids(self, ids: DataFrame) -> PatternFrame:
        """The patterns named in a DataFrame (pattern_id), in ascending order and once each."""
        kept = self.dim.join(ids.select("pattern_id").distinct(), "pattern_id", "left_semi")
        numbered = number(kept, "pattern_id")
        return self.take(numbered.select(F.col("pos").alias("out_pos"), "pattern_id"))

    def take_pixels(self, index) -> PatternFrame:
        """Columns by slice, mask or list of pixel ids; order and repetitions are kept."""
        if isinstance(index, slice):
            pixels = np.arange(self.num_pix)[index]
        else:
            pixels = np.asarray(index)
            if pixels.dtype == bool:
                if pixels.shape != (self.num_pix,):
                    raise IndexError(f"a mask needs {self.num_pix} values")
                pixels = np.flatnonzero(pixels)
            pixels = pixels.astype(np.int64)
            if len(pixels) and not ((pixels >= -self.num_pix) & (pixels < self.num_pix)).all():
                raise IndexError("no such pixel")
            pixels = pixels % max(self.num_pix, 1)
        table = pa.table({"pixel_id": pa.array(pixels, pa.int32()), "new_pixel": pa.array(np.arange(len(pixels)), pa.int32())})
        colmap = small(self.spark.createDataFrame(table))
        moved = self.entries.join(colmap, "pixel_id").select("pattern_id", F.col("new_pixel").alias("pixel_id"), "cnt")
        return self._like(num_pix=len(pixels), entries=moved, dim=self.dim)

    # aggregates ---------------------------------------------------------------------------------
    def row_stats(self) -> DataFrame:
        """(pattern_id, ones, multi, total) of every pattern, empty ones included."""
        if self._rows is not None:
            total = F.size("place_ones").cast("long") + F.aggregate("count_multi", F.lit(0).cast("long"), lambda a, x: a + x)
            return self._rows.select("pattern_id", F.size("place_ones").cast("long").alias("ones"), F.size("place_multi").cast("long").alias("multi"), total.alias("total"))
        g = self._entries.groupBy("pattern_id").agg(F.count_if(F.col("cnt") == 1).alias("ones"), F.count_if(F.col("cnt") != 1).alias("multi"), F.sum("cnt").alias("total"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        return self.dim.join(g, "pattern_id", "left").select("pattern_id", zero("ones"), zero("multi"), zero("total"))

    def sum(self, axis: int | None = None, keepdims: bool = False) -> DataFrame:
        """None: one row (total). 1: (pattern_id, total). 0: (pixel_id, total), pixels without counts
        included. BIGINT sums; overflow is an error. keepdims adds the index 0 of the axis summed over."""
        if axis is None:
            if self._rows is not None:
                out = self.row_stats().agg(F.coalesce(F.sum("total"), F.lit(0)).cast("long").alias("total"))
            else:
                out = self._entries.agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("total"))
            return out.select(F.lit(0).cast("long").alias("pattern_id"), F.lit(0).alias("pixel_id"), "total") if keepdims else out
        if axis in (1, -1):
            out = self.row_stats().select("pattern_id", "total")
            return out.withColumn("pixel_id", F.lit(0)) if keepdims else out
        if axis in (0, -2):
            sums = self.entries.groupBy("pixel_id").agg(F.sum("cnt").alias("total"))
            pixels = self.spark.range(self.num_pix).select(F.col("id").cast("int").alias("pixel_id"))
            out = pixels.join(sums, "pixel_id", "left").select("pixel_id", F.coalesce("total", F.lit(0)).cast("long").alias("total"))
            return out.withColumn("pattern_id", F.lit(0).cast("long")) if keepdims else out
        raise ValueError(f"axis {axis} is not None, 0 or 1")

    def chunk_sums(self, chunk: int) -> DataFrame:
        """(chunk_id, total) of successive chunks of patterns."""
        return self.row_stats().groupBy(F.expr(f"pattern_id div {int(chunk)}").alias("chunk_id")).agg(F.sum("total").cast("long").alias("total"))

    def get_mean_count(self) -> float:
        """Mean total of a pattern; 0 without patterns."""
        return self.sum().first().total / self.num_data if self.num_data else 0.0

    def sizes(self) -> DataFrame:
        """One row (num_data, s1, sm, nbytes, sparsity): sparsity is bytes over those of a dense int32 matrix, null if that is 0."""
        s = self.row_stats().agg(F.count("*").alias("num_data"), F.coalesce(F.sum("ones"), F.lit(0)).cast("long").alias("s1"), F.coalesce(F.sum("multi"), F.lit(0)).cast("long").alias("sm"))
        s = s.withColumn("nbytes", 4 * (2 * F.col("num_data") + F.col("s1") + 2 * F.col("sm")))
        return s.withColumn("sparsity", F.try_divide(F.col("nbytes").cast("double"), 4.0 * F.col("num_data") * F.lit(self.num_pix)))

    @property
    def nbytes(self) -> int:
        return self.sizes().first().nbytes

    def sparsity(self) -> float | None:
        return self.sizes().first().sparsity

    def offsets(self) -> DataFrame:
        """(pattern_id, ones_at, multi_at): entries of all earlier patterns, of both classes.

        Prefix sums in two levels: within blocks of BLOCK ids, and over the blocks' totals.
        """
        return prefix_sums(self.row_stats().select("pattern_id", "ones", "multi"), "pattern_id", {"ones": "ones_at", "multi": "multi_at"})

    # algebra ------------------------------------------------------------------------------------
    def __matmul__(self, other) -> DataFrame:
        """(pattern_id, j, value): the product with a P x K matrix; see ``matmul``."""
        return self.matmul(other)

    def matmul(self, other, columns: int | None = None) -> DataFrame:
        """(pattern_id, j, value): the product with a P x K matrix, all N x K values with their zeros.

        other: array, sparse array, or a DataFrame (pixel_id, j, w) with K in columns (else the largest j and
        one more). Only non-zero weights are joined. The N x K result is dense by definition: K decides its size.
        """
        if isinstance(other, DataFrame):
            right = other
        else:
            coo = other.tocoo() if hasattr(other, "tocoo") else None
            if coo is None:
                dense = np.asarray(other)
                dense = dense[:, None] if dense.ndim == 1 else dense
                if dense.shape[0] != self.num_pix:
                    raise ValueError(f"{self.shape} @ {dense.shape}")
                i, j = np.nonzero(dense)
                w, k = dense[i, j], dense.shape[1]
            else:
                i, j, w, k = coo.row, coo.col, coo.data, coo.shape[1]
            right = self.spark.createDataFrame(pa.table({"pixel_id": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "w": pa.array(np.asarray(w, np.float64))}))
            columns = k
        if columns is None:
            columns = right.agg(F.coalesce(F.max("j") + 1, F.lit(0)).alias("k")).first().k
        columns = self.spark.range(columns).select(F.col("id").cast("int").alias("j"))
        prod = self.entries.join(small(right), "pixel_id").groupBy("pattern_id", "j").agg(F.sum(F.col("cnt") * F.col("w")).alias("value"))
        grid = self.dim.crossJoin(small(columns))
        return grid.join(prod, ["pattern_id", "j"], "left").select("pattern_id", "j", F.coalesce("value", F.lit(0)).alias("value"))

    def __pow__(self, n: int) -> PatternFrame:
        """Every count to the power n, in BIGINT; zeros stay zeros except for n = 0, which gives ones everywhere."""
        if not isinstance(n, (int, np.integer)) or isinstance(n, bool):
            raise TypeError("the power must be an integer")
        if n == 0:
            if self.num_data * self.num_pix > DENSE_WARNING:
                warnings.warn("a matrix to the power 0 has no zeros left", stacklevel=2)
            from countlake.operators.build import filled

            return filled(self.spark, self.num_data, self.num_pix, 1)
        if n < 0:
            raise ValueError("negative powers are not counts")
        value = F.lit(1).cast("long")
        for _ in range(int(n)):
            value = value * F.col("cnt")
        return self._like(entries=self.entries.select("pattern_id", "pixel_id", value.alias("cnt")), dim=self.dim)

    def todense(self) -> DataFrame:
        """(pattern_id, values): every pattern as an array of num_pix counts."""
        if self.num_data * self.num_pix > DENSE_WARNING:
            warnings.warn(f"{self.num_data} x {self.num_pix} dense values", stacklevel=2)
        num_pix, step = self.num_pix, max(1, DENSE_BATCH // max(self.num_pix, 1))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (whole.slice(a, step) for whole in batches for a in range(0, whole.num_rows, step)):
                n = batch.num_rows
                out = np.zeros((n, num_pix), np.int32)
                for places, counts in (("place_ones", None), ("place_multi", "count_multi")):
                    col = batch.column(places)
                    owner = np.repeat(np.arange(n), np.asarray(col.value_lengths()))
                    out[owner, np.asarray(col.flatten())] = 1 if counts is None else np.asarray(batch.column(counts).flatten())
                values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * num_pix), pa.array(out.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("pattern_id"), values], names=["pattern_id", "values"])

        return self.rows.mapInArrow(run, "pattern_id long, values array<int>")

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        """The whole matrix on the driver; for small ones only."""
        out = np.zeros(self.shape, np.int64)
        for r in self.entries.toLocalIterator():
            out[r.pattern_id, r.pixel_id] = r.cnt
        return out if dtype is None else out.astype(dtype)

    def __array_function__(self, func, types, args, kwargs):
        """np.concatenate((a, b, ..), axis=0, casting="safe")."""
        if func is not np.concatenate:
            return NotImplemented
        return concatenate(*args, **kwargs)

    def tocsr(self) -> DataFrame:
        """(pattern_id, start, past, pixel_ids, counts): a row per pattern, its entries in order of pixel and their range
        among all entries (start is the row pointer)."""
        rows = self.ordered().rows
        pairs = F.array_sort(F.concat(F.transform("place_ones", lambda x: F.struct(x.alias("p"), F.lit(1).cast("long").alias("c"))), F.transform(F.arrays_zip("place_multi", "count_multi"), lambda x: F.struct(x["place_multi"].alias("p"), x["count_multi"].cast("long").alias("c")))))
        rows = rows.select("pattern_id", pairs.alias("e"), F.size(pairs).cast("long").alias("n"))
        at = prefix_sums(rows, "pattern_id", {"n": "start"})
        return at.select("pattern_id", "start", (F.col("start") + F.col("n")).alias("past"), F.transform("e", lambda x: x["p"]).alias("pixel_ids"), F.transform("e", lambda x: x["c"]).alias("counts"))

    def one_entries(self) -> DataFrame:
        return self.entries.where("cnt = 1")

    def multi_entries(self) -> DataFrame:
        return self.entries.where("cnt <> 1")

    # order, checks, equality --------------------------------------------------------------------
    def ordered(self) -> PatternFrame:
        """The same with places ascending within each row."""
        pairs = F.array_sort(F.arrays_zip("place_multi", "count_multi"))
        rows = self.rows.select("pattern_id", F.array_sort("place_ones").alias("place_ones"), pairs.alias("p"))
        return self._like(rows=rows.select("pattern_id", "place_ones", F.transform("p", lambda x: x["place_multi"]).alias("place_multi"), F.transform("p", lambda x: x["count_multi"]).alias("count_multi")))

    def order_flags(self) -> DataFrame:
        """(pattern_id, in_order): whether both classes are strictly ascending."""
        strict = lambda c: F.col(c) == F.array_sort(F.array_distinct(c))
        return self.rows.select("pattern_id", (strict("place_ones") & strict("place_multi")).alias("in_order"))

    def is_ordered(self) -> bool:
        return self.order_flags().agg(F.coalesce(F.bool_and("in_order"), F.lit(True)).alias("ok")).first().ok

    def violations(self) -> DataFrame:
        """(pattern_id, problem): rows that break an invariant of the layout."""
        p = self.num_pix
        outside = lambda c: F.exists(c, lambda x: x.isNull() | (x < 0) | (x >= p))
        tests = {
            "lengths differ": F.size("place_multi") != F.size("count_multi"),
            "no such pixel": outside("place_ones") | outside("place_multi"),
            "count below 2": F.exists("count_multi", lambda x: x.isNull() | (x < 2)),
            "pixel in both classes": F.arrays_overlap("place_ones", "place_multi"),
            "pixel repeated": (F.size(F.array_distinct("place_ones")) != F.size("place_ones")) | (F.size(F.array_distinct("place_multi")) != F.size("place_multi")),
            "null array": F.col("place_ones").isNull() | F.col("place_multi").isNull() | F.col("count_multi").isNull(),
        }
        found = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items()]))
        return self.rows.select("pattern_id", F.explode(found).alias("problem"))

    def check(self) -> PatternFrame:
        """self; ValueError if a row breaks an invariant or the ids are not 0 .. num_data - 1."""
        bad = self.violations().first()
        if bad is not None:
            raise ValueError(f"pattern {bad.pattern_id}: {bad.problem}")
        r = self.rows.agg(F.count("*").alias("n"), F.countDistinct("pattern_id").alias("d"), F.min("pattern_id").alias("a"), F.max("pattern_id").alias("b")).first()
        if (r.n, r.d) != (self.num_data, self.num_data) or r.n and (r.a, r.b) != (0, self.num_data - 1):
            raise ValueError("pattern ids are not 0 .. num_data - 1, each once")
        return self

    def difference(self, other: PatternFrame) -> DataFrame:
        """Entries of self that other does not have with the same count."""
        return self.entries.exceptAll(other.entries)

    def equals(self, other) -> bool:
        """Same shape and counts; how places are ordered within a row does not matter."""
        if not isinstance(other, PatternFrame) or self.shape != other.shape:
            return False
        a, b = self.entries.select("pattern_id", "pixel_id", F.col("cnt").cast("long")), other.entries.select("pattern_id", "pixel_id", F.col("cnt").cast("long"))
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    # display ------------------------------------------------------------------------------------
    def _facts(self) -> dict[str, object]:
        s = self.sizes().first()
        return {"Patterns": self.num_data, "Pixels": self.num_pix, "Entries": s.s1 + s.sm, "Size": pretty_size(s.nbytes), "Sparsity": s.sparsity}

    def __repr__(self) -> str:
        return f"PatternFrame({self.num_data} x {self.num_pix})"

    def describe(self) -> str:
        return "\n".join([repr(self), *(f"  {k}: {v}" for k, v in self._facts().items())])

    def _repr_html_(self) -> str:
        f = self._facts()
        return html_card("PatternFrame", f, bars=[("size against dense", 100 * (f["Sparsity"] or 0.0))])


# helpers ----------------------------------------------------------------------------------------
def number(df: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """df with ``pos``: 0-based rank of an integer key, in two levels (no task holds all rows)."""
    one = df.withColumn("__n", F.lit(1).cast("long"))
    return prefix_sums(one, key, {"__n": "pos"}, block).drop("__n")


def prefix_sums(df: DataFrame, key: str, sums: dict[str, str], block: int = BLOCK) -> DataFrame:
    """df with, for each column of ``sums``, the sum over all rows of smaller key.

    First within blocks of ``block`` key values, then over one row per block: the window over
    all rows that would put them into one task is never needed. Keys must be distinct integers.
    """
    b = df.withColumn("__block", F.floor(F.col(key) / F.lit(block)).cast("long"))
    inside = Window.partitionBy("__block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = b.groupBy("__block").agg(*(F.sum(c).alias(f"__t_{c}") for c in sums))
    starts = totals.select("__block", *(F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__s_{c}") for c in sums))
    out = b.join(small(starts), "__block")
    out = out.select(*df.columns, *((F.col(f"__s_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).cast("long").alias(to) for c, to in sums.items()))
    return out


def concat_rows(frames: Sequence[PatternFrame]) -> PatternFrame:
    """One below the other; ids of later frames are shifted."""
    if not frames:
        raise ValueError("nothing to concatenate")
    if len({f.num_pix for f in frames}) > 1:
        raise ValueError("frames differ in their number of pixels")
    start, parts = 0, []
    for f in frames:
        parts.append(f.rows.select((F.col("pattern_id") + F.lit(start)).alias("pattern_id"), "place_ones", "place_multi", "count_multi"))
        start += f.num_data
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return PatternFrame(PatternMeta(start, frames[0].num_pix), rows=rows)


def concat_pixels(frames: Sequence[PatternFrame]) -> PatternFrame:
    """Side by side; pixel ids of later frames are shifted. All need the same number of patterns."""
    if not frames:
        raise ValueError("nothing to concatenate")
    if len({f.num_data for f in frames}) > 1:
        raise ValueError("frames differ in their number of patterns")
    start, entries = 0, None
    for f in frames:
        part = f.entries.select("pattern_id", (F.col("pixel_id") + F.lit(start)).cast("int").alias("pixel_id"), "cnt")
        entries = part if entries is None else entries.unionByName(part)
        start += f.num_pix
    return PatternFrame(PatternMeta(frames[0].num_data, start), entries=entries, dim=frames[0].dim)


def concatenate(frames: Sequence[PatternFrame], axis: int = 0, casting: str = "safe") -> PatternFrame:
    """axis 0: rows, checked if casting is "safe"; "destroy" is accepted and means no check. axis 1: pixels."""
    if casting not in ("safe", "destroy"):
        raise ValueError(f"casting {casting!r} is not safe or destroy")
    if axis == 0:
        out = concat_rows(frames)
        return out.check() if casting == "safe" else out
    if axis == 1:
        return concat_pixels(frames)
    raise ValueError(f"axis {axis} is not 0 or 1")


def source_list(frames: Sequence[PatternFrame]) -> DataFrame:
    """(source_id, source_row, pattern_id) + arrays of a virtual list. source_id is a literal per member,
    so a filter on it removes the other members from the plan."""
    if not frames:
        raise ValueError("Empty pattern list")
    if len({f.num_pix for f in frames}) > 1:
        raise ValueError("members differ in their number of pixels")
    start, out = 0, None
    for i, f in enumerate(frames):
        part = f.rows.select(F.lit(i).alias("source_id"), F.col("pattern_id").alias("source_row"), (F.col("pattern_id") + F.lit(start)).alias("pattern_id"), "place_ones", "place_multi", "count_multi")
        out = part if out is None else out.unionByName(part)
        start += f.num_data
    return out


def coalesce_runs(values: DataFrame, value: str = "value", order: str = "pos", group: Iterable[str] = ()) -> DataFrame:
    """(group, first, past): maximal runs of successive integers in the given order, half open.

    A value that does not continue the one before it begins a new run, even if it is smaller. Give a
    ``group`` for large inputs: without one, the order of all rows is one window.
    """
    group = list(group)
    w = Window.partitionBy(*group).orderBy(order)
    flagged = values.withColumn("__f", F.when(F.col(value) - F.lag(value).over(w) == 1, 0).otherwise(1))
    run = flagged.withColumn("__r", F.sum("__f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*group, "__r").agg(F.min(value).alias("first"), (F.max(value) + 1).alias("past"), F.min(order).alias("at")).drop("__r")


__all__ = ["ENTRIES", "ROWS", "PatternFrame", "concatenate", "concat_rows", "concat_pixels", "source_list", "coalesce_runs", "number", "prefix_sums"]
