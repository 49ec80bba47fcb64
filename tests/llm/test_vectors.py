"""Packed vectors, clusters and nearest vectors against brute force."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from countlake.llm import groups, hnsw, mcl
from countlake.llm.vectors import NUM_PIX, copy_groups, pack, pattern_vectors, unpack
from countlake.session import CLEANUP, cut

ROWS = "pattern_id long, source_id int, place_ones array<int>, place_multi array<int>, count_multi array<int>, vec string, mins int, cell long"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, NUM_PIX - 1), max_size=40), min_size=1, max_size=6))
def test_pack_round_trip(sets):
    owner = np.array([i for i, s in enumerate(sets) for _ in s], np.int64)
    pixel = np.array([p for s in sets for p in sorted(s)], np.int64)
    count = (pixel + owner) % 4 + 1
    data, offsets = pack(owner, pixel, count, len(sets))
    o, p, c = unpack(data, offsets)
    assert (o == owner).all() and (p == pixel).all() and (c == count).all()


def noisy(rng, base, keep=0.9):
    """A pattern that sees nearly the same: some pixels gone, some counts changed."""
    out = base.copy()
    on = np.flatnonzero(out)
    out[rng.choice(on, int(len(on) * (1 - keep)), replace=False)] = 0
    out[rng.choice(NUM_PIX, 6, replace=False)] = 1
    change = rng.choice(np.flatnonzero(out), 10, replace=False)
    out[change] = np.maximum(1, out[change] + rng.integers(-1, 2, 10))
    return out


def base(rng, n=110):
    x = np.zeros(NUM_PIX, int)
    x[rng.choice(NUM_PIX, n, replace=False)] = rng.choice([1, 1, 1, 2, 3, 9], n)
    return x


def row(i, x, source=1):
    multi = np.flatnonzero(x > 1)
    return (i, source, np.flatnonzero(x == 1).tolist(), multi.tolist(), x[multi].tolist(), "x", 1, 2)


def truth(rows, bad=(), cap=4, least=50):
    """Capped vectors of the distinct patterns that take part."""
    out = {}
    for i, _, ones, places, counts, *_ in rows:
        if i is None:
            continue
        v = np.zeros(NUM_PIX)
        for p in ones or ():
            if p is not None and 0 <= p < NUM_PIX:
                v[p] = max(v[p], 1)
        for p, c in zip(places or (), counts or ()):
            if p is not None and c is not None and 0 <= p < NUM_PIX and c >= 1:
                v[p] = max(v[p], min(c, cap))
        v[list(bad)] = 0
        if (v > 0).sum() >= least:
            out[i] = v
    return out


def cosines(vectors):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return ids, np.round(x @ x.T, 12)


def make(spark, rows, bad=()):
    p = spark.createDataFrame(rows, ROWS)
    sources = spark.createDataFrame([(1, 1), (2, 2)], "source_id int, detector_id int")
    pixels = spark.createDataFrame([(1, b, 2) for b in bad] + [(1, 0, 0)], "detector_id int, pixel_id int, mask int")
    return cut(pattern_vectors(p, sources, pixels), "test-vectors")


@pytest.fixture(scope="module")
def world():
    """Clusters of several sizes, singles, repeated rows, copies, dirt."""
    rng = np.random.default_rng(17)
    rows, at = [], 0
    for size in (1, 1, 2, 3, 6, 7, 12, 45):
        b = base(rng)
        for _ in range(size):
            rows.append(row(at * 3 + 1, noisy(rng, b)))
            at += 1
    rows += [row(5000 + i, base(rng)) for i in range(60)]
    copy = noisy(rng, base(rng))
    rows += [row(7000 + i, copy) for i in range(30)] + [row(7100 + i, noisy(rng, copy)) for i in range(4)]
    rows += [rows[5], rows[20], rows[20]]
    i, s, ones, places, counts, *rest = row(8000, noisy(rng, copy))
    rows.append((8000, s, [*ones, -3, 4096, None], [*places, 9999, 17], [*counts, 5, -1], *rest))
    rows += [(8001, 1, None, None, None, "x", 1, 2), (8002, 1, [], [], [], "x", 1, 2), (None, 1, ones, places, counts, *rest), (8003, None, ones, places, counts, *rest), (8004, 77, ones, places, counts[:-1], *rest), row(8005, np.pad(np.ones(49, int), (0, NUM_PIX - 49)))]
    return rows


def test_vectors(spark, world):
    bad = sorted({p for r in world for p in (r[2] or ())[:1]} - {None, -3})[:20]
    rows = [r for r in world if r[1] == 1]
    got = {r.pattern_id: r for r in make(spark, rows, bad).collect()}
    want = truth(rows, bad)
    assert got.keys() == want.keys() and 8000 in got and 8005 not in got
    for i, r in got.items():
        o, p, c = unpack(np.frombuffer(r.vec, np.uint8), np.array([0, len(r.vec)]))
        v = np.zeros(NUM_PIX)
        v[p] = c
        assert (v == want[i]).all() and r.norm2 == (v * v).sum() and len(r.mins) == 64


def test_clusters(spark, world):
    v = make(spark, world)
    members = cut(mcl.pattern_clusters(v), "test-members")
    ids, cos = cosines(truth(world))
    want = {(a, b) for x, a in enumerate(ids) for y, b in enumerate(ids) if a < b and cos[x, y] >= 0.6}
    pairs = mcl.cluster_pairs(members).collect()
    assert {tuple(p) for p in pairs} == want and len(pairs) == len(want)
    got = {r.cluster_id: r for r in mcl.describe_clusters(members).collect()}
    assert sum(r["size"] for r in got.values()) == len(ids)
    assert all(k in {i for i in ids} and len(r.typical_ids) == min(3, r["size"]) for k, r in got.items())
    assert max(r["size"] for r in got.values()) == 45


def test_typical_members_are_central(spark):
    """The member that is nearest to all others comes first."""
    edges = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.9), (1, 4, 0.9), (2, 3, 0.7), (2, 4, 0.7), (3, 4, 0.7)], "id_a long, id_b long, cos double")
    top = mcl.describe_clusters(mcl.markov_clusters(edges)).collect()
    assert len(top) == 1 and top[0].typical_ids[0] == 1 and top[0]["size"] == 4 and top[0].cluster_id == 1


def dense_mcl(a, inflation=2.0, rounds=60):
    m = a / a.sum(0)
    for _ in range(rounds):
        m = (m @ m) ** inflation
        m /= m.sum(0)
    return m


def test_against_dense_markov(spark):
    """Two groups with a weak bridge: the process, not connectivity, decides."""
    groups = [range(0, 6), range(10, 16)]
    e = [(a, b, 0.8) for g in groups for a in g for b in g if a < b] + [(5, 10, 0.65)]
    got = {r.pattern_id: r.cluster_id for r in mcl.markov_clusters(spark.createDataFrame(e, "id_a long, id_b long, cos double")).collect()}
    names = sorted(got)
    a = np.eye(len(names))
    for x, y, _ in e:
        a[names.index(x), names.index(y)] = a[names.index(y), names.index(x)] = 1
    flow = dense_mcl(a)
    same = [[set(np.flatnonzero(flow[:, i] > 1e-3)) == set(np.flatnonzero(flow[:, j] > 1e-3)) for j in range(len(names))] for i in range(len(names))]
    assert all((got[p] == got[q]) == same[i][j] for i, p in enumerate(names) for j, q in enumerate(names))
    assert set(got.values()) == {0, 10}


def test_coarsening_keeps_clusters(spark):
    """Hot groups: more links than squaring should see."""
    e = [(a, b, 0.8) for s in (0, 100) for a in range(s, s + 40) for b in range(s, s + 40) if a < b and (a * b) % 7]
    df = spark.createDataFrame(e, "id_a long, id_b long, cos double")
    arcs = df.selectExpr("id_a node", "id_b other", "cos").union(df.selectExpr("id_b node", "id_a other", "cos"))
    coarse, moved = mcl.coarsen(arcs, max_degree=8)
    assert moved.count() > 40 and coarse.count() < arcs.count()
    assert all(r.node // 100 == r.root // 100 for r in moved.collect()) and moved.select("node").distinct().count() == moved.count()


def test_large_group_of_near_copies(spark):
    """A third of all rows alike, and as many exact copies: whole clusters, linear candidates."""
    rng = np.random.default_rng(3)
    b, c = base(rng), base(rng)
    rows = [row(i, noisy(rng, b, 0.95)) for i in range(300)] + [row(1000 + i, c) for i in range(300)] + [row(2000 + i, base(rng)) for i in range(300)]
    v = make(spark, rows)
    assert copy_groups(v).count() == 300
    assert mcl.link_candidates(v, window=4).count() < 300 * 4 * 16 + 1000
    sizes = sorted(r["size"] for r in mcl.describe_clusters(mcl.pattern_clusters(v)).collect())
    assert sizes[-2:] == [300, 300] and len(sizes) == 302


def test_no_patterns(spark):
    v = make(spark, [(1, 1, [1, 2], [], [], "x", 1, 2)])
    assert v.count() == 0 and mcl.pattern_clusters(v).count() == 0 and mcl.cluster_pairs(mcl.pattern_clusters(v)).count() == 0
    assert hnsw.nearest_vectors(v).count() == 0


def brute_neighbours(vectors, k, floor=None):
    ids, cos = cosines(vectors)
    out = {}
    for x, i in enumerate(ids):
        near = sorted((-cos[x, y], j) for y, j in enumerate(ids) if y != x and (floor is None or cos[x, y] >= floor))[:k]
        out[i] = [(j, -c) for c, j in near]
    return out


def test_nearest(spark, world):
    want = brute_neighbours(truth(world), 5, 0.6)
    rows = hnsw.nearest_vectors(make(spark, world), 5, floor=0.6).collect()
    got = {i: [] for i in want}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.neighbour_id, r.cos))
    assert len(rows) == len({(r.query_id, r.neighbour_id) for r in rows})
    hits = sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want)
    total = sum(map(len, want.values()))
    assert total > 300 and hits / total >= 0.98
    copies = [i for i in want if 7000 <= i < 7030]
    assert all([j for j, _ in got[i]] == [j for j, _ in want[i]] for i in copies)
    exact = {(i, j): c for i in want for j, c in want[i]}
    assert all(abs(exact[i, j] - c) < 1e-9 for i in got for j, c in got[i] if (i, j) in exact)


def test_recall_without_floor(spark):
    """The graph alone, one shard per table: recall of the 5 nearest of unrelated vectors as well."""
    rng = np.random.default_rng(6)
    bases = [base(rng) for _ in range(40)]
    rows = [row(i, noisy(rng, bases[i % 40], 0.6)) for i in range(480)]
    want = brute_neighbours(truth(rows), 5)
    got = {}
    for r in hnsw.nearest_vectors(make(spark, rows), 5, ef=48).collect():
        got.setdefault(r.query_id, set()).add(r.neighbour_id)
    recall = np.mean([len(got.get(i, set()) & {j for j, _ in w}) / 5 for i, w in want.items()])
    assert recall >= 0.9


def test_graph_shape(spark):
    """Levels nest, links have no loops, the search finds what a scan finds."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = x @ x.T
    ids = np.arange(600) * 7
    g = hnsw.build(sims, ids, 8)
    used = [set(np.flatnonzero((links >= 0).any(1))) for links in g.levels]
    assert all(b <= a for a, b in zip(used, used[1:])) and len(g.levels) > 1
    assert all(i not in row for links in g.levels for i, row in enumerate(links.tolist()))
    beam, score = hnsw.search(g, sims, 48)
    s = sims.copy()
    np.fill_diagonal(s, -9)
    top = np.argsort(-s, 1)[:, :5]
    assert np.mean([len(set(top[i]) & set(beam[i])) / 5 for i in range(600)]) > 0.9
    assert all(abs(score[i, k] - sims[i, beam[i, k]]) < 1e-6 for i in range(0, 600, 50) for k in range(48) if beam[i, k] >= 0)


def test_cell_larger_than_a_shard(spark):
    """Near copies fill many shards; results stay bounded and every row is answered."""
    rng = np.random.default_rng(4)
    b = base(rng)
    rows = [row(i, noisy(rng, b, 0.97)) for i in range(260)]
    got = hnsw.nearest_vectors(make(spark, rows), 5, floor=0.6, shard_rows=40, shard_max=60, overlap=10).groupBy("query_id").count().collect()
    assert len(got) == 260 and all(r["count"] == 5 for r in got)


@pytest.mark.parametrize("n", [600, 2600])
def test_recall_in_a_large_group(spark, monkeypatch, n):
    """Near copies that share their cells: recall against brute force does not fall with their number."""
    monkeypatch.setattr(hnsw, "BLOCK_ROWS", 700)
    rng = np.random.default_rng(4)
    b = base(rng)
    rows = [row(i, noisy(rng, b, 0.9)) for i in range(n)]
    got = {}
    for r in hnsw.nearest_vectors(make(spark, rows), 5, floor=0.6).collect():
        got.setdefault(r.query_id, set()).add(r.neighbour_id)
    ids, cos = cosines(truth(rows))
    some = range(0, len(ids), 13)
    want = {ids[x]: sorted((-cos[x, y], j) for y, j in enumerate(ids) if y != x)[:5] for x in some}
    assert np.mean([len(got.get(i, set()) & {j for _, j in w}) / 5 for i, w in want.items()]) >= 0.97


def test_shards_hold_whole_cells():
    """No cell is parted, though none of the first ends lies within reach of a shard's usual size."""
    import pyarrow as pa

    seen = []
    run = hnsw._shards(5, None, 24, 8, 40, 60)
    data, offsets = pack(np.repeat(np.arange(75), 2), np.tile([3, 900], 75), np.ones(150, np.int64), 75)
    vec = pa.array([data[a:b].tobytes() for a, b in zip(offsets, offsets[1:])], pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array([1] * 30 + [2] * 45), pa.array(range(75)), vec, pa.array([2] * 75)], names=["cell", "pattern_id", "vec", "norm2"])
    for out in run(iter([batch])):
        seen.append(set(out.column("query_id").to_pylist()))
    assert seen == [set(range(30)), set(range(30, 75))]


def test_case_pairs(spark):
    n = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.8), (2, 1, 0.9)], "query_id long, neighbour_id long, cos double")
    assert {tuple(r) for r in hnsw.case_pairs(n, 2).collect()} == {(1, 2), (1, 3)}


def test_nearest_are_whole(spark):
    """Groups about cosine 0.7, many of whose pairs share no MinHash cell: the same rows as brute force, none
    missing, however small the shards of the search without groups are."""
    rng = np.random.default_rng(12)
    rows = []
    for size in [8] * 20 + [1] * 100:
        b = base(rng)
        rows += [row(len(rows) + i, noisy(rng, b, 0.78)) for i in range(size)]
    want = brute_neighbours(truth(rows), 5, 0.6)
    got = {}
    for r in hnsw.nearest_vectors(make(spark, rows), 5, floor=0.6, shard_rows=8, shard_max=60).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.neighbour_id, r.cos)
    assert {i: [x for _, x in sorted(n.items())] for i, n in got.items()} == {i: [(j, round(c, 12)) for j, c in n] for i, n in want.items() if n}


def test_unrelated_rows_of_a_hot_cell_are_not_multiplied(spark, monkeypatch):
    """All rows share a cell of two MinHash values; only linked rows are compared, so the work does not grow with the square of the cell."""
    rng = np.random.default_rng(5)
    rows = [row(i, base(rng)) for i in range(400)]
    b = base(rng)
    rows += [row(1000 + i, noisy(rng, b)) for i in range(7)]
    v = make(spark, rows)
    v = cut(v.selectExpr("pattern_id", "vec", "norm2", "sketch", "concat(array(7S, 7S), slice(mins, 3, 62)) mins"), "hot")
    seen = []
    compare = hnsw.compare_groups
    monkeypatch.setattr(hnsw, "compare_groups", lambda vectors, found, *rest: (seen.append(found.count()), compare(vectors, found, *rest))[1])
    got = {r.query_id for r in hnsw.nearest_vectors(v, 5, floor=0.6).collect()}
    assert got == set(range(1000, 1007)) and seen == [7]


def test_components(spark):
    """A long path, a star, a clique and random links against a search; no number of rounds is too many."""
    rng = np.random.default_rng(1)
    path = rng.permutation(200) + 1000
    e = [*zip(path, path[1:]), *((5, i) for i in range(6, 40)), *((a, b) for a in range(50, 60) for b in range(a + 1, 60)), *rng.integers(100, 400, (150, 2))]
    e = sorted({(int(min(p)), int(max(p))) for p in e if p[0] != p[1]})
    root = {x: x for p in e for x in p}
    for _ in range(250):
        for a, b in e:
            root[a] = root[b] = min(root[a], root[b])
    found = groups.components(spark.createDataFrame(e, "id_a long, id_b long")).collect()
    assert len(found) == len(root) and {r.node: r.root for r in found} == root


def test_alike_rows_far_apart_in_a_run(spark):
    """Two alike rows that share one band only, with 300 unrelated rows of that run between them, beyond any window."""
    rng = np.random.default_rng(9)
    b = base(rng)
    rows = [row(i, base(rng)) for i in range(300)] + [row(1000, noisy(rng, b)), row(1001, noisy(rng, b))]
    v = make(spark, rows)
    # the run's order is the sketch: the two differ in its first bit, and in every other band
    v = v.selectExpr("pattern_id", "vec", "norm2", "if(pattern_id < 1000, sketch, if(pattern_id = 1000, 0, shiftleft(1L, 63))) sketch",
                     "transform(mins, (x, i) -> if(i < 4, 7S, cast(pattern_id * 64 % 4000 + i as smallint))) mins")
    v = cut(v, "far")
    near = {tuple(r) for r in mcl.link_candidates(v).collect()}
    assert (1000, 1001) not in near
    found = {r.pattern_id: r.cluster_id for r in mcl.pattern_clusters(v).collect()}
    assert found[1000] == found[1001] == 1000 and len(set(found.values())) == 301
    assert {(r.query_id, r.neighbour_id) for r in hnsw.nearest_vectors(v, 5, floor=0.6).collect()} == {(1000, 1001), (1001, 1000)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=12), st.integers(1, 4), st.integers(1, 7), st.integers(1, 40))
def test_no_pair_of_a_run_is_left_out(runs, window, batch, edge):
    """Whatever the batches and partitions, two rows of a run meet in the window or are both handed on."""
    import pyarrow as pa

    key = np.repeat(np.arange(len(runs)), runs)
    ids = np.arange(len(key))
    near, far = set(), set()
    for part in (slice(0, edge), slice(edge, None)):
        k, i = key[part], ids[part]
        cuts = range(0, len(k), batch)
        batches = (pa.RecordBatch.from_arrays([pa.array(k[c : c + batch]), pa.array(np.zeros(len(k[c : c + batch]), np.int64)), pa.array(i[c : c + batch])], names=["key", "sketch", "pattern_id"]) for c in cuts)
        for out in mcl._walk(window, 24)(batches):
            for r in out.to_pylist():
                (far.add((r["id_a"], r["key"])) if r["id_b"] is None else near.add((r["id_a"], r["id_b"])))
    same = {(a, b) for a in ids for b in ids if a < b and key[a] == key[b]}
    assert near <= same and all(k == key[i] for i, k in far)
    assert all((a, b) in near or {(a, key[a]), (b, key[b])} <= far for a, b in same)


def test_graph_has_all_pairs_of_a_group(spark, monkeypatch):
    """A group larger than a block: every pair at 0.6 or more is an edge, though the window is 24."""
    monkeypatch.setattr(mcl, "compare_groups", lambda *a: groups.compare_groups(*a, block_rows=60))
    seen = []
    monkeypatch.setattr(mcl, "markov_clusters", lambda edges, real=mcl.markov_clusters: (seen.extend(tuple(r)[:2] for r in edges.collect()), real(edges))[1])
    rng = np.random.default_rng(8)
    b = base(rng)
    rows = [row(i, noisy(rng, b, 0.93)) for i in range(160)] + [row(500 + i, base(rng)) for i in range(20)]
    sizes = {r["size"] for r in mcl.describe_clusters(mcl.pattern_clusters(make(spark, rows))).collect()}
    assert sorted(seen) == [(a, b) for a in range(160) for b in range(a + 1, 160)] and sizes == {1, 160}


@pytest.fixture
def shuffled(spark):
    """Bytes that a function shuffles, with no join broadcast for its size."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    total = lambda: spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    def run(f):
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        begun = total()
        f()
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        return total() - begun

    for n in names:
        spark.conf.set(n, "-1")
    yield run
    for n in names:
        spark.conf.unset(n)


def test_whole_vectors_are_picked_out_once(spark, monkeypatch):
    """Only rows with a candidate take part in the comparisons: four alike ones and those at the edges of partitions."""
    rng = np.random.default_rng(21)
    x = base(rng)
    rows = [row(i, base(rng)) for i in range(600)] + [row(1000 + i, noisy(rng, x)) for i in range(4)]
    v, taken = make(spark, rows), []
    for name in ("similarity_graph", "compare_groups"):
        monkeypatch.setattr(mcl, name, lambda vectors, *rest, real=getattr(mcl, name): (taken.append(vectors.count()), real(vectors, *rest))[1])
    sizes = sorted(r["size"] for r in mcl.describe_clusters(mcl.pattern_clusters(v)).collect())
    assert sizes == [1] * 600 + [4] and len(taken) == 3 and 4 <= taken[0] < 150 and max(taken) < 150


def test_signatures_are_not_shuffled(spark, shuffled):
    """Repeated rows are found by the packed bytes alone."""
    rng = np.random.default_rng(22)
    rows = [row(i % 900, base(rng, 60)) for i in range(1000)]
    found = []
    moved = shuffled(lambda: found.extend(make(spark, rows).collect()))
    assert len(found) == 900 and moved < sum(len(r.vec) for r in found) * 1000 / 900 + 40 * 1000
    least = {}
    for i, *x in rows:
        o = make_packed(x)
        least[i] = min(least.get(i, o), o)
    assert {r.pattern_id: bytes(r.vec) for r in found} == least


def make_packed(x):
    _, ones, places, counts, *_ = x
    at = np.array(sorted([(p, 1) for p in ones] + [(p, min(c, 4)) for p, c in zip(places, counts)]))
    return pack(np.zeros(len(at), np.int64), at[:, 0], at[:, 1], 1)[0].tobytes()


def test_cut_releases_shuffle_files(spark):
    files = lambda: {n for n in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in n}
    df = spark.range(1000).repartition(3, "id")
    before = files()
    cut(df, "kept")
    kept = files()
    assert kept - before
    table = cut(df, "freed", release=True)
    until = time.time() + 20
    while files() - kept and time.time() < until:
        time.sleep(0.2)
    assert not files() - kept and sorted(r.id for r in table.collect()) == list(range(1000))
    assert spark.conf.get(CLEANUP, "false") == "false"
