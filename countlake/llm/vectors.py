"""Patterns as capped count vectors, packed into bytes, with MinHash signatures of their support.

A vector is packed as ascending steps of one byte each: the low two bits hold count - 1 (counts are
capped at 4), the high six bits the distance to the previous pixel, 1..63. The byte 0 skips 63
pixels. An average pattern takes a little over one byte per pixel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countlake.operators.badpixels import BadLookup

NUM_PIX = 4096
CAP = 4
MIN_PIXELS = 50
#: MinHash values per vector. Each is a rank below NUM_PIX, so four of them fit a 48-bit key exactly.
HASHES = 64
SEED = 20260101


def rank_tables(hashes: int = HASHES, num_pix: int = NUM_PIX, seed: int = SEED) -> np.ndarray:
    """hashes x num_pix: a random permutation of the pixels for each hash."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(num_pix) for _ in range(hashes)]).astype(np.uint16)


def pack(owner: np.ndarray, pixel: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of n vectors and their n + 1 offsets; entries sorted by (owner, pixel), pixels distinct."""
    first = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.zeros(0, bool)
    step = np.where(first, pixel + 1, pixel - np.r_[0, pixel[:-1]]) if len(owner) else pixel
    skips = (step - 1) // 63
    width = skips + 1
    end = np.cumsum(width)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    out[end - 1] = ((step - 63 * skips) << 2 | (count - 1)).astype(np.uint8)
    sizes = np.bincount(owner, weights=width, minlength=n).astype(np.int64) if len(owner) else np.zeros(n, np.int64)
    return out, np.r_[0, np.cumsum(sizes)]


def unpack(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, pixel, count) of packed vectors; inverse of pack."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    gap = np.where(data == 0, 63, data >> 2).astype(np.int64)
    total = np.cumsum(gap)
    before = np.r_[0, total][offsets[:-1]]
    real = data != 0
    pixel = total - before[owner] - 1
    return owner[real], pixel[real], (data[real] & 3).astype(np.int64) + 1


def binary_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary Arrow column without nulls."""
    col = col.cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) of a list<int32> column; null lists are empty, null elements dropped."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = np.asarray(pc.fill_null(pc.list_value_length(col), 0))
    owner, flat = np.repeat(np.arange(len(col)), n), col.flatten()
    if flat.null_count:
        keep = np.asarray(flat.is_valid())
        owner, flat = owner[keep], flat.drop_null()
    return owner, np.asarray(flat).astype(np.int64)


def _vectorise(min_pixels: int, is_bad):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            ones = _lists(batch.column("place_ones"))
            # places and counts are zipped by Spark, so their lengths agree
            multi, count = _lists(batch.column("place_multi")), _lists(batch.column("count_multi"))
            owner = np.r_[ones[0], multi[0]]
            pixel = np.r_[ones[1], multi[1]]
            value = np.r_[np.ones(len(ones[1]), np.int64), count[1]]
            ok = (pixel >= 0) & (pixel < NUM_PIX) & (value >= 1)
            key, value = owner[ok] * NUM_PIX + pixel[ok], np.minimum(value[ok], CAP)
            if len(key):
                good = ~is_bad(batch, key // NUM_PIX, key % NUM_PIX)
                key, value = key[good], value[good]
                order = np.lexsort((-value, key))
                key, value = key[order], value[order]
                fresh = np.r_[True, key[1:] != key[:-1]][: len(key)]
                key, value = key[fresh], value[fresh]
            owner, pixel = key // NUM_PIX, key % NUM_PIX
            size = np.bincount(owner, minlength=n)
            keep = size >= min_pixels
            if not keep.any():
                continue
            sel = keep[owner]
            place = np.cumsum(keep) - 1
            owner, pixel, value, m = place[owner[sel]], pixel[sel], value[sel], int(keep.sum())
            data, offsets = pack(owner, pixel, value, m)
            vec = pa.Array.from_buffers(pa.large_binary(), m, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("pattern_id").filter(pa.array(keep)), vec], names=["pattern_id", "vec"])

    return run


def _sign(tables: np.ndarray, bits: np.ndarray):
    """Packed vectors to the same with norm2, sketch and mins, which all follow from them."""
    hashes = len(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            owner, pixel, value = unpack(*binary_parts(batch.column("vec")))
            starts = np.searchsorted(owner, np.arange(m))
            mins = np.empty((m, hashes), np.uint16)
            for h in range(hashes):
                mins[:, h] = np.minimum.reduceat(tables[h][pixel], starts)
            sketch = np.zeros(m, np.uint64)
            for h in range(hashes):
                sketch |= bits[h][mins[:, h]] << np.uint64(h)
            norm2 = np.bincount(owner, weights=value * value, minlength=m).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("pattern_id"),
                    batch.column("vec"),
                    pa.array(norm2),
                    pa.array(sketch.view(np.int64)),
                    pa.FixedSizeListArray.from_arrays(pa.array(mins.reshape(-1).astype(np.int16)), hashes).cast(pa.list_(pa.int16())),
                ],
                names=["pattern_id", "vec", "norm2", "sketch", "mins"],
            )

    return run


def pattern_vectors(patterns: DataFrame, sources: DataFrame, pixels: DataFrame, min_pixels: int = MIN_PIXELS) -> DataFrame:
    """(pattern_id, vec, norm2, sketch, mins): one row per pattern with enough pixels.

    place_ones counts 1, count_multi is capped at 4; BAD pixels of the source's detector, places
    outside 0..4095 and counts below 1 are left out. A place listed twice keeps its largest count.
    Null arrays are empty; null elements and null pattern_ids are dropped; place_multi and
    count_multi of different lengths are read up to the shorter. A pattern of an unknown or null source has
    no BAD pixels. Rows repeated with the same pattern_id give one row (of differing deliveries
    the smallest packed vector). mins are MinHash ranks of the support, sketch one bit of each.
    """
    lookup = BadLookup(sources, pixels, NUM_PIX)
    n = F.least(F.size("place_multi"), F.size("count_multi"))
    cutoff = lambda c: F.when(F.size("place_multi") == F.size("count_multi"), F.col(c)).otherwise(F.slice(c, 1, F.greatest(n, F.lit(0))))
    rows = patterns.where("pattern_id is not null").select(
        F.col("pattern_id").cast("long").alias("pattern_id"),
        F.col("source_id"),
        F.col("place_ones").cast("array<int>").alias("place_ones"),
        F.coalesce(cutoff("place_multi"), F.array()).cast("array<int>").alias("place_multi"),
        F.coalesce(cutoff("count_multi"), F.array()).cast("array<int>").alias("count_multi"),
    )
    # a null place or count makes its partner meaningless as well: both become impossible values
    rows = rows.withColumns({
        "place_multi": F.when(F.exists("place_multi", F.isnull), F.transform("place_multi", lambda x: F.coalesce(x, F.lit(-1)))).otherwise(F.col("place_multi")),
        "count_multi": F.when(F.exists("count_multi", F.isnull), F.transform("count_multi", lambda x: F.coalesce(x, F.lit(0)))).otherwise(F.col("count_multi")),
    })
    rows = lookup.attach(rows)
    rng = np.random.default_rng(SEED + 1)
    bits = rng.integers(0, 2, (HASHES, NUM_PIX)).astype(np.uint64)
    # only the packed bytes travel to find repeated rows; the signatures, as long again, are made behind that
    packed = rows.mapInArrow(_vectorise(min_pixels, lookup.kernel()), "pattern_id long, vec binary")
    once = packed.groupBy("pattern_id").agg(F.min("vec").alias("vec"))
    return once.mapInArrow(_sign(rank_tables(), bits), "pattern_id long, vec binary, norm2 long, sketch long, mins array<smallint>")


def band_key(band: int, width: int):
    """Column: the MinHash values of one band as a long that names them exactly (width up to 4)."""
    key = F.lit(band).cast("long")
    for i in range(band * width, band * width + width):
        key = F.shiftleft(key, 12).bitwiseOR(F.element_at("mins", i + 1).cast("long"))
    return key


def copy_groups(vectors: DataFrame) -> DataFrame:
    """(pattern_id, head, copies) of vectors that are not alone: head is the smallest id of the equal ones.

    Equality is told by two independent 64-bit values and the norm. Groups are counted with partial sums and never collected.
    """
    v = vectors.select("pattern_id", F.xxhash64("vec").alias("h"), "sketch", "norm2")
    groups = v.groupBy("h", "sketch", "norm2").agg(F.min("pattern_id").alias("head"), F.count("*").alias("copies")).where("copies > 1")
    return v.join(groups, ["h", "sketch", "norm2"]).select("pattern_id", "head", "copies")
