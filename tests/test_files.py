"""Files, paths, arrays, objects and helpers."""

import io
from pathlib import Path

import numpy as np
import pytest

from countlake.functions.misc import bit_flags, divide_range, html_card, pretty_size
from countlake.operators.build import from_array, patterns
from countlake.sources import arrays, countfile, countsource, hdf5, objects
from countlake.sources.countsource import read_counts, scan, to_image, write_counts
from countlake.sources.paths import InnerPath, has_inner, inner_path, make_path, split_path
from tests.test_matrix import SMALL, gen_dense

try:
    import h5py  # noqa: F401
except ImportError:
    h5py = None


def test_bytes_by_hand(spark):
    image = to_image(from_array(spark, np.array([[0, 1, 3, 0], [0, 0, 0, 0]])))
    assert len(image) == 1052 and np.frombuffer(image, "<i4")[:3].tolist() == [2, 4, 0]
    assert np.frombuffer(image, "<i4", offset=1024).tolist() == [1, 0, 1, 0, 1, 2, 3]
    assert np.asarray(patterns(spark, image)).tolist() == [[0, 1, 3, 0], [0, 0, 0, 0]]


@pytest.mark.parametrize("damage", [lambda b: b[:-1], lambda b: b + b"\0\0\0\0", lambda b: b[:100], lambda b: b"\xff" * 8 + b[8:], lambda b: b"", lambda b: b[:1024]])
def test_damaged(spark, damage, tmp_path):
    bad = damage(to_image(from_array(spark, SMALL)))
    with pytest.raises(countfile.DamagedFile):
        countfile.parse(bad)
    (tmp_path / "x.emc").write_bytes(bad)
    with pytest.raises(countfile.DamagedFile):
        read_counts(spark, tmp_path / "x.emc")


def test_round_trip(spark, tmp_path):
    dense = gen_dense(300, 64)
    m = from_array(spark, dense)
    path = tmp_path / "a.emc"
    write_counts(m, path, block=37)
    assert path.stat().st_size == 1024 + m.nbytes and path.read_bytes() == to_image(m)
    with pytest.raises(FileExistsError):
        write_counts(m, path)
    write_counts(m[:5], path, overwrite=True)
    assert len(read_counts(spark, path)) == 5
    with pytest.raises(ValueError):
        write_counts(m, tmp_path / "a.txt")
    stream = io.BytesIO()
    write_counts(m, stream)
    assert patterns(spark, stream).equals(m)
    assert not [p for p in tmp_path.iterdir() if "part" in p.name]


def test_scan_slices_and_sections(spark, tmp_path):
    dense = gen_dense(200, 64)
    path = str(tmp_path / "a.emc")
    write_counts(from_array(spark, dense), path)
    f = read_counts(spark, path)
    for s in (slice(66, 132), slice(-5, None), slice(10, 100, 7), slice(190, 999)):
        assert (np.asarray(f[s]) == dense[s]).all()
    assert (f[-1] == dense[-1]).all() and (np.asarray(f[[150, 3, 150]]) == dense[[150, 3, 150]]).all()
    sizes = scan(spark, path, "ones,multi")
    assert sizes.columns == ["pattern_id", "ones", "multi"] and sizes.agg({"multi": "sum"}).first()[0] == (dense > 1).sum()
    many = spark.read.format("countfile").option("partitionBytes", "2000").load(path)
    assert many.rdd.getNumPartitions() > 5 and many.count() == 200
    with pytest.raises(Exception, match="section"):
        scan(spark, path, "nothing").count()


def test_glob_and_list(spark, tmp_path):
    a, b = from_array(spark, SMALL[:10]), from_array(spark, SMALL[10:])
    write_counts(a, tmp_path / "2.emc")
    write_counts(b, tmp_path / "1.emc")
    assert (np.asarray(patterns(spark, str(tmp_path / "*.emc"))) == np.r_[SMALL[10:], SMALL[:10]]).all()
    assert (np.asarray(patterns(spark, [tmp_path / "2.emc", tmp_path / "1.emc"])) == SMALL).all()
    with pytest.raises(ValueError, match="Empty"):
        read_counts(spark, str(tmp_path / "none*.emc"))


def test_empty_file(spark, tmp_path):
    write_counts(patterns(spark, 32), tmp_path / "e.emc")
    f = read_counts(spark, tmp_path / "e.emc")
    assert f.shape == (0, 32) and f.rows.count() == 0


@pytest.mark.parametrize("text,want", [("/tmp/tmpl6ppiovx.h5::inten", ("/tmp/tmpl6ppiovx.h5", "inten")), ("few.h5", ("few.h5", "/")), ("few.h5::", ("few.h5", "/")), ("few.h5::/", ("few.h5", "/")), ("few.txt::", ("few.txt", "/"))])
def test_split_path(text, want):
    assert split_path(text) == (Path(want[0]), want[1])


@pytest.mark.parametrize("text", ["fwef.txt", "fewf.txt::32::33"])
def test_split_path_errors(text):
    with pytest.raises(ValueError):
        split_path(text)


def test_inner_paths(tmp_path):
    assert make_path("/tmp/vx.h5::inten") == InnerPath(Path("/tmp/vx.h5"), "inten") and make_path("/tmp/vx.h5") == InnerPath(Path("/tmp/vx.h5"))
    assert make_path("/tmp/vx.txt") == Path("/tmp/vx.txt")
    p = inner_path("a.h5::x") / "y"
    assert str(p) == "a.h5::x/y" and tuple(p) == (Path("a.h5"), "x/y") and not p.exists() and p != "a.h5::x/y"
    with pytest.raises(TypeError):
        inner_path(p, "z")
    with pytest.raises(TypeError):
        inner_path(3)
    (tmp_path / "odd").write_bytes(b"\x89HDF\r\n\x1a\n.....")
    assert has_inner(tmp_path / "odd") and not has_inner(tmp_path / "none") and "InnerPath" in p._repr_html_()


@pytest.mark.skipif(h5py is not None, reason="h5py is here")
def test_hdf5_says_what_is_missing():
    with pytest.raises(RuntimeError, match="h5py"):
        hdf5.library()


@pytest.mark.skipif(h5py is None, reason="h5py is not installed: the HDF5 connector is not verified")
@pytest.mark.parametrize("version", ["1", "2"])
def test_hdf5_round_trip(spark, tmp_path, version):
    m = from_array(spark, SMALL)
    write_counts(m, f"{tmp_path}/a.h5::p", version=version)
    assert read_counts(spark, f"{tmp_path}/a.h5::p").equals(m)


def test_arrays(spark, tmp_path):
    x = np.random.default_rng(1).random(10)
    arrays.write_array(tmp_path / "x.npy", x)
    arrays.write_array(tmp_path / "x.bin", x)
    assert (arrays.read_array(tmp_path / "x.npy") == x).all() and (arrays.read_array(tmp_path / "x.bin") == x).all()
    with pytest.raises(FileNotFoundError):
        arrays.read_array(tmp_path / "none.npy")
    with pytest.raises(FileExistsError):
        arrays.write_array(tmp_path / "x.npy", x)
    with pytest.raises(ValueError):
        arrays.write_array(tmp_path / "x.csv", x)
    t = arrays.array_table(spark, np.arange(6).reshape(2, 3)).collect()
    assert {(r.i0, r.i1): r.value for r in t}[(1, 2)] == 5


def test_columns_do_not_pass_the_driver(spark, tmp_path):
    """Written and scanned by tasks, over several blocks and in any order of rows; the files are those of NumPy."""
    n = 3 * arrays.BLOCK + 17
    x = np.random.default_rng(3).random(n)
    rows = spark.range(n).selectExpr(f"(id * 7919) % {n} as pos").selectExpr("pos", "pos * 0.5D as value")
    for name in ("x.npy", "x.bin", "x.emc"):
        arrays.write_column(tmp_path / name, rows)
        assert (arrays.read_array(tmp_path / name) == np.arange(n) * 0.5).all()
        with pytest.raises(FileExistsError):
            arrays.write_column(tmp_path / name, rows)
    with pytest.raises(ValueError):
        arrays.write_column(tmp_path / "x.csv", rows)
    arrays.write_array(tmp_path / "y.bin", x)
    t = arrays.scan_array(spark, tmp_path / "y.bin").orderBy("i0").toPandas()
    assert (t.i0 == np.arange(n)).all() and (t.value == x).all()
    t = arrays.array_table(spark, x)
    assert "LocalTableScan" not in t._jdf.queryExecution().executedPlan().toString() and t.count() == n
    assert arrays.array_table(spark, np.zeros((0, 3))).count() == 0
    assert [r.value for r in arrays.array_table(spark, np.array(5.0)).collect()] == [5.0]


def same(a, b):
    if isinstance(a, dict):
        return isinstance(b, dict) and a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    return bool(np.array_equal(a, b)) if isinstance(a, np.ndarray) else a == b


def test_objects(spark, tmp_path):
    obj = {"name": "n", "age": 3, "data": {"test": np.random.default_rng(2).random((3, 5))}, "datatype": np.dtype([("a", int), ("b", float)])}
    path = str(tmp_path / "tree")
    objects.write_object(spark, path, obj)
    assert same(objects.read_object(spark, path), obj)
    with pytest.raises(FileExistsError):
        objects.write_object(spark, path, obj)
    objects.write_object(spark, path, {"age": 4, "more": {"x": 1.5}}, overwrite=True)
    assert same(objects.read_object(spark, path), obj | {"age": 4, "more": {"x": 1.5}})
    dotted = {"d": {"name": "n", ".": np.ones((3, 5))}}
    objects.write_object(spark, str(tmp_path / "dot"), dotted)
    assert same(objects.read_object(spark, str(tmp_path / "dot")), dotted)


def test_helpers():
    assert [pretty_size(s) for s in (500, 1024, 1234567)] == ["500 B", "1.00 KB", "1.18 MB"]
    assert divide_range(0, 10, 3) == [(0, 4), (4, 7), (7, 10)] and divide_range(0, 2, 5) == [(0, 1), (1, 2)] and divide_range(0, 10, 5)[-1] == (8, 10)
    with pytest.raises(ValueError):
        divide_range(0, 1, 0)
    assert bit_flags(2) == 2 and bit_flags([0, 1]) == 3
    with pytest.raises(ValueError):
        bit_flags(256)
    assert "&lt;" in html_card("<", {"a": 1.5}, details={"b": None}, bars=[("c", 200)])


def _members(spark, tmp_path, sizes=(5, 7, 0, 11, 4), num_pix=20):
    rng = np.random.default_rng(8)
    arrays = [rng.integers(0, 4, (n, num_pix)) for n in sizes]
    for k, a in enumerate(arrays):
        (tmp_path / f"m{k:02d}.emc").write_bytes(countsource.to_image(from_array(spark, a)))
    return np.concatenate(arrays), sorted(map(str, tmp_path.glob("*.emc")))


def test_many_files_are_one_scan(spark, tmp_path):
    want, paths = _members(spark, tmp_path)
    m = countsource.read_counts(spark, f"{tmp_path}/*.emc")
    assert m.shape == want.shape and (np.asarray(m) == want).all() and (np.asarray(countsource.read_counts(spark, paths[::-1])) == np.concatenate([np.asarray(countsource.read_counts(spark, p)) for p in paths[::-1]])).all()
    assert (np.asarray(m[3:20][2:9]) == want[3:20][2:9]).all() and (np.asarray(m[::-3][1:4]) == want[::-3][1:4]).all() and len(m[9:9]) == 0
    assert (np.asarray(m[[26, 0, 26, 12, -1]]) == want[[26, 0, 26, 12, -1]]).all() and (m[-2] == want[-2]).all() and (np.asarray(m[5:][[1, 0]]) == want[5:][[1, 0]]).all()
    mask = want.sum(1) % 2 == 0
    assert (np.asarray(m[mask]) == want[mask]).all()
    plan = m[3:20].rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 1
    (tmp_path / "z.emc").write_bytes(countsource.to_image(from_array(spark, want[:1, :3])))
    with pytest.raises(ValueError):
        countsource.read_counts(spark, f"{tmp_path}/*.emc")


def test_a_selection_opens_only_its_files(spark, tmp_path, monkeypatch):
    """10,000 files: partitions name only those that are touched, and the driver opens none."""
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

    files = [(f"{tmp_path}/none{k}.emc", 10, 2000) for k in range(10_000)]
    touched = lambda r: [p for part in r.partitions() for p in part.pieces]

    def reader(*filters):
        r = countsource.CountFileReader(files, ["ones"], 1 << 20)
        assert list(r.pushFilters(filters)) == []
        return r

    got = touched(reader(GreaterThanOrEqual(("pattern_id",), 1205), LessThan(("pattern_id",), 1225)))
    assert [(p.path[-11:], p.first, p.past) for p in got] == [("none120.emc", 5, 10), ("none121.emc", 0, 10), ("none122.emc", 0, 5)]
    got = touched(reader(In(("pattern_id",), (7, 99_999, 3))))
    assert [(p.start, p.rows) for p in got] == [(0, (3, 7)), (99_990, (9,))]
    assert [p.start for p in touched(reader(EqualTo(("pattern_id",), 55)))] == [50] and touched(reader(LessThan(("pattern_id",), 0))) == []
    whole = reader()
    assert len(whole.partitions()) == 20 and len(touched(whole)) == 10_000


def test_headers_of_many_files_are_read_by_tasks(spark, tmp_path, monkeypatch):
    want, paths = _members(spark, tmp_path)
    monkeypatch.setattr(countsource, "DRIVER_HEADERS", 2)
    assert (np.asarray(countsource.read_counts(spark, paths)[4:15]) == want[4:15]).all()
    assert countsource.read_counts(spark, "/nowhere.emc", num_data=3, num_pix=5).shape == (3, 5)


def test_ids_are_pushed_into_the_scan(spark, tmp_path):
    _, paths = _members(spark, tmp_path)
    m = countsource.read_counts(spark, paths)
    plan = m[[3, 17]].rows._jdf.queryExecution().executedPlan().toString()
    assert "pattern_id" in plan and "IN" in plan.upper()
    # a missing member matters only if it is touched
    import os

    os.remove(paths[-1])
    assert len(np.asarray(m[0:5])) == 5 and len(np.asarray(m[[1, 2]])) == 2
