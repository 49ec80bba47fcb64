"""Collector and streaming compactor."""

import numpy as np
import pytest

from countlake.operators.build import from_array
from countlake.session import fresh_path
from countlake.sources.countfile import assemble, parse
from countlake.sources.countsource import read_counts
from countlake.streaming.collector import PatternCollector
from countlake.streaming.compactor import StreamingCompactor, export_files

FILES = "file_id long, list_id long, exposure_nos array<long>, payload binary, num_data int, batch int, exposure_no string"


def test_collector(spark, tmp_path):
    rng = np.random.default_rng(4)
    images = rng.integers(0, 32, (120, 34))
    c = PatternCollector(spark, 16)
    assert c.num_pix is None
    with pytest.raises(ValueError):
        c.patterns()
    for x in images[:30]:
        c.append(x)
    for bad in (np.zeros(35, int), np.zeros(34)):
        with pytest.raises(ValueError):
            c.append(bad)
    c.extend(list(images[30:60]))
    c.extend(images[60:90])
    c.extend(from_array(spark, images[90:]))
    with pytest.raises(ValueError):
        c.extend([np.zeros(35, int)])
    with pytest.raises(TypeError):
        c.extend((1, 2))
    assert len(c.pattern_list()) == 7 and c.num_pix == 34 and "120" in repr(c)
    assert (np.asarray(c.patterns()) == images).all()
    c.write(tmp_path / "c.emc")
    assert (np.asarray(read_counts(spark, tmp_path / "c.emc")) == images).all()


def payload(rows, num_pix=8):
    ones = [[p for p, v in enumerate(r) if v == 1] for r in rows]
    multi = [[(p, v) for p, v in enumerate(r) if v > 1] for r in rows]
    flat = lambda x: np.array([p for r in x for p in r], np.int32)
    return assemble(num_pix, [np.array([len(r) for r in ones]), np.array([len(r) for r in multi]), flat(ones), np.array([p for r in multi for p, _ in r]), np.array([v for r in multi for _, v in r])])


def records(df):
    out = []
    for r in df.collect():
        f = parse(bytes(r.payload))
        o, m = np.r_[0, np.cumsum(f.ones)], np.r_[0, np.cumsum(f.multi)]
        assert len(r.exposure_nos) == f.num_data == r.num_data and r.nbytes == len(r.payload)
        for i, e in enumerate(r.exposure_nos):
            x = np.zeros(f.num_pix, int)
            x[f.place_ones[o[i] : o[i + 1]]] = 1
            x[f.place_multi[m[i] : m[i + 1]]] = f.count_multi[m[i] : m[i + 1]]
            out.append((r.list_id, e, tuple(x)))
    return out


def write(spark, path, rows, mode="append"):
    spark.createDataFrame(rows, FILES).coalesce(1).write.mode(mode).parquet(path)


@pytest.fixture()
def table(spark):
    return fresh_path(spark, "files")


def test_compaction(spark, table, tmp_path):
    rng = np.random.default_rng(9)
    img = rng.integers(0, 4, (40, 8)).tolist()
    f = lambda i, lst, exp, **k: (i, lst, exp, payload([img[e] for e in exp]), 99, 1, "x")
    first = [f(5, 1, [1, 2, 3]), f(5, 1, [1, 2, 3]), f(2, 1, [3, 4]), f(7, 2, [1, 2]), (8, 1, [10], payload([img[10]])[:-4], 1, 1, "x"), (9, 1, [], payload([]), None, 1, "x"), (10, 1, [11], None, 1, 1, "x"), (None, 1, [12], payload([img[12]]), 1, 1, "x"), (11, 3, None, payload([img[13]]), 1, 1, "x")]
    write(spark, table, first)
    c = StreamingCompactor.fresh(spark, table, max_batch_bytes=1).advance()
    assert {tuple(r) for r in c.repeated().collect()} == {(5, 2)}
    # files that arrive late, among them one of smaller id that holds what is known already
    write(spark, table, [f(1, 1, [2, 20]), f(5, 1, [1, 2, 3]), f(30, 1, [21, 21])])
    c.advance()
    assert {tuple(r) for r in c.repeated().collect()} == {(5, 1), (5, 2)}
    want = {(1, e, tuple(img[e])) for e in (1, 2, 3, 4, 20, 21)} | {(2, e, tuple(img[e])) for e in (1, 2)}
    got = records(c.compacted())
    assert len(got) == len(want) and set(got) == want and c.compacted().count() == 2
    # as many files as the target demands, nothing lost or doubled
    parts = c.compacted(target_bytes=40)
    assert parts.count() > 2 and sorted(records(parts)) == sorted(want)
    # nothing new: nothing changes; a fresh run over everything agrees
    assert set(records(c.advance().compacted())) == want
    assert set(records(StreamingCompactor.fresh(spark, table).advance().compacted())) == want
    out = export_files(c.compacted(), str(tmp_path / "new")).collect()
    assert len(out) == 2 and all(len(read_counts(spark, r.file_path)) > 0 for r in out)


def test_retried_batch_replaces(spark, table):
    img = [[1, 2, 0, 0, 0, 0, 0, 3]]
    rows = [(1, 1, [1], payload(img), 1, 1, "x")]
    write(spark, table, rows)
    c = StreamingCompactor.fresh(spark, table).advance()
    c._process(spark.createDataFrame(rows, FILES), 0)
    c._process(spark.createDataFrame(rows, FILES), 0)
    assert c.records().count() == 1


def test_hot_list(spark, table):
    """One list holds all files, and one record is in each of them."""
    img = [[0, 1, 5, 0, 0, 0, 0, 0], [2, 0, 0, 0, 0, 0, 0, 1]]
    write(spark, table, [(i, 7, [0, i + 1], payload(img), 2, 1, "x") for i in range(300)])
    c = StreamingCompactor.fresh(spark, table).advance()
    assert c.repeated().count() == 299
    assert c.compacted().count() == 1 and c.compacted().first().num_data == 301


def test_empty_catalogue(spark, table):
    write(spark, table, [])
    c = StreamingCompactor.fresh(spark, table).advance()
    assert c.records().count() == 0 and c.repeated().count() == 0 and c.compacted().count() == 0


def test_only_touched_lists_are_written_again(spark, table, tmp_path):
    img = [[0, 1, 5, 0, 0, 0, 0, 0], [2, 0, 0, 0, 0, 0, 0, 1], [1, 1, 1, 0, 0, 0, 0, 0]]
    f = lambda i, lst, exp: (i, lst, exp, payload([img[e] for e in exp]), 1, 1, "x")
    write(spark, table, [f(1, 1, [0, 1]), f(2, 2, [0]), f(3, 3, [2])])
    c = StreamingCompactor.fresh(spark, table).advance().compact()
    assert sorted(records(c.files())) == sorted([(1, 0, tuple(img[0])), (1, 1, tuple(img[1])), (2, 0, tuple(img[0])), (3, 2, tuple(img[2]))])
    first = {r.version for r in c.files().select("version").collect()}
    write(spark, table, [f(4, 2, [1]), f(5, 2, [0])])
    c.advance().compact()
    versions = {r.list_id: r.version for r in c.files().collect()}
    assert {versions[1], versions[3]} == first and versions[2] > max(first)
    # the new version holds the touched list alone, and nothing is lost or doubled
    assert {r.list_id for r in spark.read.parquet(f"{c.state}/files/version={versions[2]:09d}").collect()} == {2}
    want = sorted([(1, 0, tuple(img[0])), (1, 1, tuple(img[1])), (2, 0, tuple(img[0])), (2, 1, tuple(img[1])), (3, 2, tuple(img[2]))])
    assert sorted(records(c.files())) == want
    # nothing new: nothing is written
    assert c.advance().compact()._numbers("files", "version") == sorted({*first, versions[2]})
    # an interrupted run leaves an unfinished version, which is not read and is written again
    write(spark, table, [f(6, 3, [1])])
    c.advance()
    (last,) = set(c._numbers("records", "batch")) - {*first, versions[2]}
    spark.createDataFrame([(9, 8, 0, 1, 1, [7], b"x")], "list_id long, num_pix int, part_no long, num_data long, nbytes long, exposure_nos array<bigint>, payload binary").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{c.state}/files/version={last:09d}")
    assert sorted(records(c.files())) == want
    assert sorted(records(c.compact().files())) == sorted([*want, (3, 1, tuple(img[1]))])
    out = export_files(c.files(), (tmp_path / "uri").as_uri()).collect()
    assert len(out) == 3 and all(r.file_path.startswith("file:") for r in out)
    assert len(list((tmp_path / "uri").iterdir())) == 3
