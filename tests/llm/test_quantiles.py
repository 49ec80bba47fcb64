"""Percentile sketches: the bound holds, in any order of merging."""

import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from countlake.llm import quantiles as q


def rank_off(values, answer, p):
    v = np.sort(values)
    want = max(1, np.ceil(p * len(v)))
    return max(0, np.searchsorted(v, answer, "left") + 1 - want, want - np.searchsorted(v, answer, "right"))


@pytest.mark.parametrize("n", [1, 5, 1023, 1024, 9000, 200_000])
@pytest.mark.parametrize("shape", ["random", "ascending", "ties", "blocks"])
def test_bound(n, shape):
    rng = np.random.default_rng(n)
    x = {"random": rng.normal(size=n), "ascending": np.arange(n, dtype=float), "ties": rng.integers(0, 3, n).astype(float), "blocks": np.repeat(rng.normal(size=n // 100 + 1), 100)[:n]}[shape]
    s = q.Sketch()
    for part in np.array_split(x, 7):
        s.add(part)
    assert s.n == n
    for p, v in zip(q.QS, s.quantiles(q.QS)):
        assert rank_off(x, v, p) <= s.rank_error
    if n <= q.K * q.FAN - 1:
        assert s.rank_error == 0
    assert s.rank_error <= 0.01 * n and len(s.dump()) < 8 * q.K * q.FAN * 8


@settings(max_examples=25, deadline=None)
@given(sizes=st.lists(st.integers(0, 6000), min_size=1, max_size=9), seed=st.integers(0, 99))
def test_any_merge_order(sizes, seed):
    rng = np.random.default_rng(seed)
    parts = [rng.gamma(2.0, size=n) for n in sizes]
    sketches = [q.Sketch.load(q.Sketch().add(p).dump()) for p in parts]
    while len(sketches) > 1:
        i, j = sorted(rng.choice(len(sketches), 2, replace=False))
        b = sketches.pop(j)
        sketches[i] = sketches[i].merge(b)
    x, s = np.concatenate(parts), sketches[0]
    assert s.n == len(x) and sum(w for w in s.weighted()[1]) == len(x)
    if len(x):
        assert all(rank_off(x, v, p) <= s.rank_error for p, v in zip(q.QS, s.quantiles(q.QS)))


def test_patterns(spark):
    """Days combine to sources; repeats count once; nulls and lost entries have their defined place."""
    rng = np.random.default_rng(1)
    day = lambda d: datetime.datetime(2020, 9, 14 + d, 12)
    rows, ones, counts = [], {1: [], 2: []}, {1: [], 2: []}
    for i in range(400):
        s = 1 if i % 3 else 2
        o, c = int(rng.integers(0, 9)), [int(v) for v in rng.integers(2, 50, rng.integers(0, 60))]
        rows.append((i, s, day(i % 4) if i % 50 else None, None if i % 7 == 0 else o, len(c), list(range(o)), list(range(len(c))), c, "day", "x"))
        ones[s].append(o)
        counts[s] += c
    rows.append((900, 1, day(0), 5, None, None, None, None, "d", "x"))
    ones[1].append(5)
    rows += [rows[3], rows[3], rows[8], (None, 1, day(0), 1, 1, [1], [], [], "d", "x"), (901, None, day(0), 1, 1, [1], [], [], "d", "x"), (902, 1, day(1), None, None, None, None, None, "d", "x")]
    df = spark.createDataFrame(rows, "pattern_id long, source_id int, taken_at timestamp, ones int, multi int, place_ones array<int>, place_multi array<int>, count_multi array<int>, measure string, sketch string")
    days = q.day_sketches(df)
    got = {(r.source_id, r.measure): r for r in q.read_quantiles(q.source_sketches(days), ["source_id", "measure"], q.QS).collect()}
    for s in (1, 2):
        for name, x in (("ones", ones[s]), ("count_multi", counts[s])):
            r = got[s, name]
            assert r.n == len(x) and all(rank_off(np.array(x), r[c], p) <= r.rank_error for c, p in zip(("p5", "p25", "p50", "p75", "p95", "p99"), q.QS))
    per_day = q.read_quantiles(days, ["source_id", "day", "measure"], [0.5]).collect()
    assert any(r.day is None for r in per_day) and sum(r.n for r in per_day if r.measure == "ones") == 401
    assert len({(r.source_id, r.day, r.measure) for r in per_day}) == len(per_day)


def test_hot_source(spark):
    """One key holds nearly everything, in many tasks; the merge holds two sketches at a time."""
    df = spark.range(120_000).repartition(9).selectExpr("'a' as k", "array(cast(id as double), cast(id as double) / 2) as vals")
    s = q.merge_sketches(q.sketch_lists(df, ["k"], "vals"), ["k"])
    r = q.read_quantiles(s, ["k"], [0.5]).collect()
    x = np.r_[np.arange(120_000.0), np.arange(120_000.0) / 2]
    assert len(r) == 1 and r[0].n == 240_000 and rank_off(x, r[0].p50, 0.5) <= r[0].rank_error < 2400


def test_empty(spark):
    df = spark.createDataFrame([], "k string, vals array<double>")
    assert q.merge_sketches(q.sketch_lists(df, ["k"], "vals"), ["k"]).count() == 0
    nothing = spark.createDataFrame([("a", None), ("b", [None, float("nan")])], "k string, vals array<double>")
    assert q.sketch_lists(nothing, ["k"], "vals").count() == 0
