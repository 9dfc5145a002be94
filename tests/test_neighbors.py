import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vicinity import PointSet
from vicinity.functions.distance import distances, within
from vicinity.operators.pivots import PivotTree
from vicinity.operators.voronoi import farthest_centers
from vicinity.plans.neighbors import neighbors

METHODS = ("bf", "ct", "ctrma", "cvor", "gvor")


def points(spark, rows):
    return PointSet.of(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id long, v array<float>"), "id", "v")


def brute(rows, r):
    a = np.array(rows, np.float32)
    d = distances(a, a) <= np.float32(r)
    return {(i, j) for i, j in zip(*np.nonzero(d), strict=True) if i != j}


def edges(graph):
    got = [(e.src, e.dst) for e in graph.edges().collect()]
    assert len(got) == len(set(got))
    return set(got)


CASES = {
    "one point": ([[1, 2]], 5),
    "all identical": ([[3, 3]] * 7, 0),
    "two identical and a far one": ([[0, 0], [0, 0], [9, 9]], 1),
    "an outlier's neighbour in another cell": ([[0, 0], [1, 0], [2, 0], [10, 0], [11.5, 0]], 2),
    "one dimension": ([[x] for x in (0, 1, 1, 2.5, 4)], 1.5),
    "exactly at the radius": ([[0, 0], [3, 4]], 5),
}


@pytest.mark.parametrize("method", METHODS)
@pytest.mark.parametrize("case", CASES)
def test_small_sets(spark, method, case):
    rows, r = CASES[case]
    assert edges(points(spark, rows).neighbors(r, method, num_centers=4)) == brute(rows, r)


@pytest.mark.parametrize("method", METHODS)
def test_tiles_and_parameters(spark, method):
    rng = np.random.default_rng(5)
    rows = np.round(rng.normal(size=(300, 3)) * 3).tolist()
    p = points(spark, rows)
    graph = p.neighbors(2.0, method, num_centers=7, seed_id=11, leaf_size=3, cover=1.3, queries_per_tree=17, chunk=40)
    want = brute(rows, 2.0)
    assert edges(graph) == want and all((b, a) in want for a, b in want)
    assert graph.num_edges() == len(want) + 300
    assert {r["src"]: r["neighbors"] for r in graph.adjacency().collect()} == {i: sorted(b for a, b in want if a == i) for i, _ in want}
    assert edges(p.neighbors(1.0, method, num_centers=3)) <= want


def test_empty_set(spark):
    empty = PointSet(spark.createDataFrame([], "id long, v array<float>"))
    for m in METHODS:
        assert empty.neighbors(1, m).edges().count() == 0


def test_shuffled_tiles_agree_with_shared(spark):
    from vicinity.operators.tiles import against_shared, all_pairs

    rows = np.random.default_rng(2).normal(size=(200, 5)).tolist()
    p = points(spark, rows)
    tiled = {(e.src, e.dst) for e in all_pairs(p.df, 1.5, within, 200, chunk=32).collect()}
    shared = {(e.src, e.dst) for e in against_shared(p.df, 1.5, within, 3).collect()}
    assert tiled == shared == brute(rows, 1.5)


def test_farthest_centers_in_rounds_and_here(spark):
    rows = np.random.default_rng(3).normal(size=(120, 4)).tolist()
    p = points(spark, rows)
    far, here = farthest_centers(p, 20, local=False), farthest_centers(p, 20)
    assert far.ids == here.ids and far.separation == here.separation


def test_stops_at_distinct_points(spark):
    assert farthest_centers(points(spark, [[0], [0], [1]]), 9).ids == [0, 2]


def test_rejects(spark):
    p = points(spark, [[0, 0], [1, 1]])
    for bad in ({"radius": -1}, {"radius": None}, {"radius": 1, "method": "vor"}, {"radius": 1, "assignment": "x"}, {"radius": 1, "balancing": "x"}):
        with pytest.raises(ValueError):
            neighbors(p, **bad)
    with pytest.raises(Exception, match="non-finite"):
        points(spark, [[0, 0], [float("nan"), 1]]).neighbors(1, "bf").edges().count()


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 60), st.integers(1, 4), st.floats(0, 4), st.integers(1, 12), st.floats(1.05, 3), st.integers(0, 999))
def test_pivot_tree_finds_the_same(n, d, r, leaf, cover, seed):
    rng = np.random.default_rng(seed)
    a = np.round(rng.normal(size=(n, d)) * 2).astype(np.float32)
    q = rng.normal(size=(9, d)).astype(np.float32)
    want = {(i, j) for i, j in zip(*np.nonzero(distances(q, a) <= np.float32(r)), strict=True)}
    got = list(zip(*PivotTree(a, cover, leaf).query(q, r), strict=True))
    assert len(got) == len(set(got)) and set(got) == want
    assert set(zip(*within(q, a, r), strict=True)) == want


@pytest.mark.parametrize("method", METHODS)
def test_run_record_of_a_run(spark, tmp_path, method):
    import json

    rows = np.random.default_rng(4).normal(size=(150, 3)).tolist()
    graph = points(spark, rows).neighbors(0.5, method, num_centers=5, chunk=32, shared=False)
    graph.write_run_record(path := f"file://{tmp_path}/run.json")
    record = json.loads(open(path.removeprefix("file://")).read())
    assert record["num_points"] == 150 and record["num_edges"] == 150 + len(brute(rows, 0.5)) and record["runtime"] > 0
    assert len(record["dist_comps"]) == len(record["comp_times"]) == len(record["points_read"]) == record["num_procs"]
    work = graph.metrics().agg({"dist_comps": "sum", "points_read": "sum"}).first()
    assert sum(record["dist_comps"]) == work["sum(dist_comps)"] > 0 and sum(record["points_read"]) == work["sum(points_read)"] >= 150
    if method == "bf":  # each unordered pair of chunks once, chunks by themselves whole
        assert 150 * 150 / 2 < sum(record["dist_comps"]) < 150 * 150
    assert graph.written() is graph and edges(graph) == brute(rows, 0.5)


def test_warns_of_cells_in_many_dimensions(spark, caplog):
    p = points(spark, np.random.default_rng(6).normal(size=(100, 20)).tolist())
    graph = p.neighbors(3.0, "cvor", num_centers=30)
    assert "bf would do less" in caplog.text and edges(graph) == edges(p.neighbors(3.0, "bf"))


@pytest.mark.parametrize("d", (1, 2, 3, 8, 9))
def test_rotation(d):
    from vicinity.sources.synth import rotation

    turn = rotation(d, np.random.default_rng(d))
    assert np.allclose(turn @ turn.T, np.eye(d)) and np.linalg.det(turn) == pytest.approx(1)


def test_pairs_a_rounding_from_the_radius_are_those_of_sql(spark):
    import duckdb

    v = np.random.default_rng(8).normal(size=(60, 64)).astype(np.float32)
    con = duckdb.connect()
    con.execute("CREATE TABLE p AS SELECT unnest(range(60)) AS id, unnest($1::FLOAT[][]) AS v", [v.tolist()])
    of = {(a, b): np.float32(d) for a, b, d in con.execute("SELECT a.id, b.id, list_distance(a.v, b.v) FROM p a JOIN p b ON a.id <> b.id").fetchall()}
    assert all(d == distances(v[a : a + 1], v[b : b + 1])[0, 0] for (a, b), d in of.items())
    two = v[:, None] - v[None]
    twice = np.sqrt(np.add.accumulate(two * two, axis=2, dtype=np.float32)[:, :, -1])  # squares rounded by themselves
    a, b = next(x for x in of if twice[x] != of[x])
    r = float(min(twice[a, b], of[a, b]))
    want = {x for x, d in of.items() if d <= np.float32(r)}
    assert ((a, b) in want) != bool(twice[a, b] <= np.float32(r))
    for method, shared in (("bf", True), ("bf", False), ("ct", False)):
        assert edges(points(spark, v.tolist()).neighbors(r, method, chunk=16, shared=shared)) == want


@pytest.mark.parametrize(("method", "options"), (("auto", {}), ("cvor", {}), ("gvor", {"balancing": "steal", "queries_per_tree": 64})))
def test_copies_go_through_cells_once(spark, method, options):
    rng = np.random.default_rng(9)
    rows = np.round(rng.normal(size=(40, 2)) * 9).tolist()
    rows = rng.permutation(rows * 20 + [[-0.0, 0.0], [0.0, 0.0]]).tolist()
    graph = points(spark, rows).neighbors(2.5, method, num_centers=4, chunk=32, **options)
    want = brute(rows, 2.5)
    assert edges(graph) == want and graph.num_edges() == len(want) + len(rows)
    assert 0 < graph.metrics().agg({"dist_comps": "sum"}).first()[0] < 4 * len({tuple(r) for r in rows}) ** 2


@pytest.mark.parametrize("method", ("cvor", "gvor"))
def test_edges_of_copies_are_dealt_over_the_tasks(spark, method):
    """A few points of many copies: few bytes before their edges are spread, so tasks must not be counted by bytes."""
    from pyspark.sql import functions as F

    rows = np.random.default_rng(10).permutation([[x, 0] for x in range(12)] * 60).tolist()
    found = points(spark, rows).neighbors(1.0, method, num_centers=3, balancing="steal", queries_per_tree=64).edges()
    tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == len(brute(rows, 1.0)) and max(tasks) < 0.2 * sum(tasks)
