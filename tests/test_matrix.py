"""The matrix operators against dense NumPy."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp

from countlake.operators import frame as pf
from countlake.operators.build import filled, from_array, from_rows, from_triplets, patterns
from countlake.operators.frame import PatternFrame
from countlake.schema import PatternMeta, PatternSource, SparsePattern


def gen_dense(n, p):
    state = np.random.get_state()
    np.random.seed(123)
    out = (10 * np.random.rand(n, p) ** 5).astype(int)
    np.random.set_state(state)
    return out


SMALL = gen_dense(32, 4)


@pytest.fixture(scope="module")
def small(spark):
    m = from_array(spark, SMALL)
    m._rows = m.rows.cache()
    return m


def column(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_golden_small(small):
    stats = small.row_stats().collect()
    assert [r.total for r in sorted(stats)] == [1, 11, 2, 2, 0, 6, 1, 1, 0, 12, 0, 13, 3, 0, 6, 2, 6, 5, 1, 1, 1, 10, 10, 3, 0, 1, 5, 4, 3, 9, 6, 14]
    assert column(small.sum(axis=0), "pixel_id", "total") == {0: 34, 1: 33, 2: 29, 3: 43}
    s = small.sizes().first()
    assert (s.num_data, s.s1, s.sm, s.nbytes) == (32, 17, 24, 516)
    assert s.sparsity == pytest.approx(1.0078125) and small.get_mean_count() == 4.34375
    assert small.sum().first().total == 139 and small.nbytes == 516


def test_golden_big(spark):
    """1000 x 4096 from the recipe, as triplets."""
    dense = gen_dense(1000, 4096)
    m = from_array(spark, dense)
    s = m.sizes().first()
    assert (s.s1, s.sm, s.nbytes, round(s.sparsity, 6)) == (384720, 1127291, 10565208, 0.644849)
    assert m.sum().first().total == 5672431
    assert column(m.sum(axis=0), "pixel_id", "total")[0] == 1522
    rows = column(m.sum(axis=1), "pattern_id", "total")
    assert (rows[0], rows[3], max(rows.values())) == (5620, 5923, 6239)


def test_bad_axis(small):
    with pytest.raises(ValueError):
        small.sum(axis=2)


def test_keepdims(small):
    assert set(small.sum(axis=1, keepdims=True).columns) == {"pattern_id", "pixel_id", "total"}
    assert small.sum(keepdims=True).first().asDict() == {"pattern_id": 0, "pixel_id": 0, "total": 139}


@pytest.mark.parametrize("index", [slice(5, 20), slice(None, None, 3), slice(1, None, 3), slice(None, None, -1), slice(-9, -2), slice(20, 5), slice(0, 999), [3, 1, 3, 31, -1], np.array([7]), np.arange(32) % 3 == 0, []])
def test_row_selection(small, index):
    got = small[index]
    want = SMALL[index] if not isinstance(index, list) or index else SMALL[:0]
    assert got.shape == want.shape
    assert (np.asarray(got) == want).all()


def test_long_layout_selection(spark, small):
    m = PatternFrame(small.meta, entries=small.entries)
    assert (np.asarray(m[4:30:5]) == SMALL[4:30:5]).all()
    assert (np.asarray(m[[9, 9, 2]]) == SMALL[[9, 9, 2]]).all()
    assert (np.asarray(PatternFrame(m.meta, rows=m.rows)) == SMALL).all()


def test_single_rows(small):
    assert (small[3] == SMALL[3]).all() and (small[-1] == SMALL[-1]).all() and (small[4] == 0).all()
    for bad in (32, -33):
        with pytest.raises(IndexError):
            small[bad]
    with pytest.raises(IndexError):
        small[np.zeros(5, bool)]
    with pytest.raises(IndexError):
        small[[99]]


@pytest.mark.parametrize("index", [slice(1, 3), [3, 0, 0], np.array([True, False, True, True]), slice(None, None, -1)])
def test_pixel_selection(small, index):
    assert (np.asarray(small[:, index]) == SMALL[:, index]).all()
    assert (np.asarray(small[2:9, index]) == SMALL[2:9][:, index]).all()


def test_unsorted_then_sorted(small):
    m = small[:, [3, 1, 2, 0]]
    m = PatternFrame(m.meta, rows=m.rows.withColumn("place_multi", m.rows.place_multi))
    flipped = small.rows.selectExpr("pattern_id", "reverse(place_ones) place_ones", "reverse(place_multi) place_multi", "reverse(count_multi) count_multi")
    f = PatternFrame(small.meta, rows=flipped)
    assert not f.is_ordered() and f.ordered().is_ordered() and f.equals(small) and small.is_ordered()


def test_concat(small):
    parts = [small[:7], small[7:7], small[7:]]
    assert pf.concatenate(parts).equals(small)
    assert pf.concatenate(parts, casting="destroy").equals(small)
    side = pf.concatenate([small, small[:, :2]], axis=1)
    assert (np.asarray(side) == np.c_[SMALL, SMALL[:, :2]]).all()
    for call in (lambda: pf.concatenate([small, small[:, :2]]), lambda: pf.concatenate([small, small[:3]], axis=1), lambda: pf.concatenate([small], axis=2), lambda: pf.concatenate([small], casting="x"), lambda: pf.concatenate([])):
        with pytest.raises(ValueError):
            call()


def test_source_list(small):
    rows = pf.source_list([small[:10], small[10:]])
    got = {(r.source_id, r.source_row): r.pattern_id for r in rows.collect()}
    assert got[(1, 3)] == 13 and len(got) == 32
    with pytest.raises(ValueError):
        pf.source_list([])
    plan = rows.where("source_id = 0")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_power(small, n):
    assert (np.asarray(small**n) == SMALL**n).all()


def test_power_errors(small):
    with pytest.raises(TypeError):
        small**1.5
    with pytest.raises(ValueError):
        small**-1


def test_matmul(small):
    w = np.random.default_rng(0).random((4, 3))
    w[2] = 0
    got = np.zeros((32, 3))
    for r in (small @ w).collect():
        got[r.pattern_id, r.j] = r.value
    assert np.allclose(got, SMALL @ w)
    with pytest.raises(ValueError):
        small @ np.ones((5, 2))


def test_dense_and_split(small):
    got = {r.pattern_id: r["values"] for r in small.todense().collect()}
    assert all((np.array(got[i]) == SMALL[i]).all() for i in range(32))
    assert small.one_entries().count() == 17 and small.multi_entries().count() == 24


def test_offsets_cross_blocks(spark, small):
    ones = (SMALL == 1).sum(1)
    want = np.r_[0, np.cumsum(ones)[:-1]]
    got = pf.prefix_sums(small.row_stats(), "pattern_id", {"ones": "at"}, block=5).collect()
    assert all(r.at == want[r.pattern_id] for r in got)


def test_equality(small):
    assert not small.equals(small[:31]) and not small.equals(small[:, :3]) and not small.equals(3)
    other = SMALL.copy()
    other[3, 1] += 1
    assert not small.equals(from_array(small.spark, other))


def test_fills(spark):
    for v in (0, 1, 2):
        assert (np.asarray(filled(spark, 10, 3, v)) == np.full((10, 3), v)).all()
        assert filled(spark, 10, 0, v).row_stats().count() == 10
    with pytest.raises(ValueError):
        filled(spark, 2, 2, -1)


def test_constructor(spark, small):
    assert patterns(spark, SMALL).equals(small) and patterns(spark, small, start=3, end=9).equals(small[3:9])
    assert patterns(spark, SMALL, start=-4).equals(small[-4:])
    assert patterns(spark, 32).shape == (0, 32) and patterns(spark, ((4, 3), 1)).sum().first().total == 12
    rows = [SparsePattern(4, [0], [2], [5]), SparsePattern(4, [], [], [])]
    assert np.asarray(patterns(spark, rows)).tolist() == [[1, 0, 5, 0], [0, 0, 0, 0]]
    for bad, error in ((object(), TypeError), (SMALL * 1.5, ValueError), (-SMALL, ValueError), ("/no/such.emc", OSError)):
        with pytest.raises(error):
            patterns(spark, bad)
    with pytest.raises(ValueError):
        from_rows(spark, [SparsePattern(4, [], [], []), SparsePattern(5, [], [], [])])
    assert isinstance(small, PatternSource)


def test_sparse_matrix_protocol(spark, small):
    class Coo:
        row, col = np.nonzero(SMALL)
        data, shape = SMALL[row, col], SMALL.shape

        def tocoo(self):
            return self

    assert patterns(spark, Coo()).equals(small)


def test_triplets(spark):
    t = spark.createDataFrame([(0, 1, 1), (0, 1, 1), (2, 0, 3), (1, 1, 0)], "pattern_id long, pixel_id int, cnt long")
    m = from_triplets(t, 3, 2)
    assert np.asarray(m).tolist() == [[0, 2], [0, 0], [3, 0]]
    for bad in ((0, 5, 1), (9, 0, 1), (0, 0, -2), (None, 0, 1)):
        with pytest.raises(Exception, match="matrix|negative"):
            from_triplets(spark.createDataFrame([bad], "pattern_id long, pixel_id int, cnt long"), 3, 2).entries.collect()


def test_checks(spark):
    def rows(*r):
        return PatternFrame(PatternMeta(len(r), 4), rows=spark.createDataFrame([(i, *x) for i, x in enumerate(r)], "pattern_id long, place_ones array<int>, place_multi array<int>, count_multi array<int>"))

    assert rows(([0], [1], [2])).check()
    for bad in (([0], [1], []), ([4], [], []), ([], [1], [1]), ([1], [1], [2]), ([1, 1], [], []), (None, [], [])):
        with pytest.raises(ValueError):
            rows(bad).check()


def test_empty(spark):
    m = patterns(spark, 5)
    assert m.sum().first().total == 0 and m.get_mean_count() == 0 and m.sparsity() is None
    assert m.sum(axis=1).count() == 0 and m.sum(axis=0).count() == 5 and m.is_ordered() and m.check() is m
    assert m[:].shape == (0, 5) and pf.concatenate([m, m]).shape == (0, 5)


@pytest.mark.parametrize("values,runs", [([1, 2, 3, 2, 5, 6, 7, 8], [(1, 4), (2, 3), (5, 9)]), ([], []), ([0], [(0, 1)]), (list(range(20)), [(0, 20)]), ([*range(5, 10), *range(20)], [(5, 10), (0, 20)])])
def test_runs(spark, values, runs):
    df = spark.createDataFrame(list(enumerate(values)), "pos int, value int")
    got = pf.coalesce_runs(df).orderBy("at").collect()
    assert [(r["first"], r.past) for r in got] == runs


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=hnp.arrays(np.int64, st.tuples(st.integers(1, 6), st.integers(1, 6)), elements=st.integers(0, 4)), k=st.integers(0, 6))
def test_laws(spark, a, k):
    m = from_array(spark, a)
    assert (np.asarray(PatternFrame(m.meta, entries=m.entries, dim=m.dim)) == a).all()
    assert pf.concat_rows([m[:k], m[k:]]).equals(m)
    assert sum(r.total for r in m.sum(axis=0).collect()) == m.sum().first().total == a.sum()


def test_display(small):
    assert "32 x 4" in repr(small) and "516 B" in small.describe() and "<section>" in small._repr_html_()


def test_product_keeps_columns_without_weights(spark):
    m = from_array(spark, np.array([[1, 2], [0, 0]]))
    w = spark.createDataFrame([(0, 0, 1), (1, 2, 5)], "pixel_id int, j int, w int")
    assert sorted(map(tuple, m.matmul(w).collect())) == [(0, 0, 1), (0, 1, 0), (0, 2, 10), (1, 0, 0), (1, 1, 0), (1, 2, 0)]
    assert m.matmul(w, columns=5).count() == 10


def test_dense_batches_are_bounded(spark, monkeypatch):
    import countlake.operators.frame as fr

    monkeypatch.setattr(fr, "DENSE_BATCH", 40)
    a = np.arange(300).reshape(20, 15) % 4
    got = {r.pattern_id: r["values"] for r in from_array(spark, a).todense().collect()}
    assert all(got[i] == a[i].tolist() for i in range(20))


def test_dense_rows_need_no_shuffle(spark):
    from countlake.operators.build import from_dense_rows

    df = spark.createDataFrame([(0, [0, 1, 5]), (1, [0, 0, 0]), (2, [None, 2, 1])], "pattern_id long, values array<int>")
    m = from_dense_rows(df, 3, 3)
    assert "Exchange" not in m.rows._jdf.queryExecution().executedPlan().toString()
    assert np.asarray(m).tolist() == [[0, 1, 5], [0, 0, 0], [0, 2, 1]]
    for bad in ([1, 2], [0, -1, 2]):
        with pytest.raises(Exception, match="needs 3 values|negative"):
            from_dense_rows(spark.createDataFrame([(0, bad)], "pattern_id long, values array<int>"), 1, 3).rows.collect()


def test_numpy_concatenate(spark):
    a, b = np.array([[1, 0], [0, 3]]), np.array([[2, 2], [1, 1]])
    m, n = from_array(spark, a), from_array(spark, b)
    assert (np.asarray(np.concatenate((m, n))) == np.concatenate((a, b))).all() and (np.asarray(np.concatenate([m, n], axis=1)) == np.concatenate([a, b], axis=1)).all()
    assert [tuple(r)[:3] for r in m.tocsr().orderBy("pattern_id").collect()] == [(0, 0, 1), (1, 1, 2)]
