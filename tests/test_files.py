import json

import numpy as np
import pytest

from vicinity import PointSet
from vicinity.cli import main
from vicinity.sources.reports import read_records, read_summary, run_summary, scaling, write_summary
from vicinity.sources.synth import blobs
from vicinity.sources.vecfile import catalog, convert, read_points, write_points


def values(points):
    return {r["id"]: list(r["v"]) for r in points.df.collect()}


@pytest.fixture
def sample(spark):
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 256, (50, 6)).astype(float)
    return PointSet.of(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id long, v array<float>"), "id", "v")


@pytest.mark.parametrize("ext", (".fvecs", ".fbin", ".u8bin"))
def test_round_trip_slices_and_conversion(spark, sample, tmp_path, ext):
    path = f"{tmp_path}/a{ext}"
    assert write_points(sample, path) == 50
    want = values(sample)
    assert values(read_points(spark, path)) == want
    assert values(read_points(spark, path, 45, 100, partitions=3)) == {i: want[i] for i in range(45, 50)}
    assert values(read_points(spark, path, 60)) == {}
    for other in (".fvecs", ".fbin", ".u8bin"):
        target = f"{tmp_path}/b{other}"
        assert convert(spark, path, target, 10, 5) == 5
        assert values(read_points(spark, target)) == {i: want[i + 10] for i in range(5)}
    info = catalog(spark, [path, f"{tmp_path}/x.hdf5"]).collect()
    assert [(r["num"], r["dim"]) for r in info] == [(50, 6)]


@pytest.mark.parametrize("ext", (".fvecs", ".fbin", ".u8bin"))
def test_other_stores(spark, sample, tmp_path, ext):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    store = "store" + ext[1:]
    conf.set(f"fs.viewfs.mounttable.{store}.link./d", f"file://{tmp_path}")
    write_points(sample, f"{tmp_path}/a{ext}")
    want = values(sample)
    assert values(read_points(spark, f"viewfs://{store}/d/a{ext}", 3, 9)) == {i: want[i] for i in range(3, 12)}


def test_wrong_files(spark, sample, tmp_path):
    (tmp_path / "a.fvecs").write_bytes(b"\x02\0\0\0" + bytes(7))
    with pytest.raises(Exception, match="whole number"):
        read_points(spark, f"{tmp_path}/a.fvecs").df.count()
    with pytest.raises(ValueError, match="extension"):
        write_points(sample, f"{tmp_path}/a.txt")
    low = PointSet(sample.df.selectExpr("id", "transform(v, x -> cast(x - 300 as float)) v"))
    with pytest.raises(Exception, match="fit a byte"):
        write_points(low, f"{tmp_path}/a.u8bin")


def test_blobs_depend_on_the_seed_alone(spark):
    a, b = blobs(spark, 40, 3, 5, 4, seed=2), blobs(spark, 40, 3, 5, 4, seed=2)
    assert values(a) == values(PointSet(b.df.repartition(3))) != values(blobs(spark, 40, 3, 5, 4, seed=3))
    assert np.linalg.matrix_rank(np.array(list(values(a).values())), tol=1e-3) == 3


def test_command_line_and_reports(spark, sample, tmp_path):
    write_points(sample, f"{tmp_path}/a.fvecs")
    for method, procs in (("bf", 1), ("gvor", 2)):
        assert main(["-i", f"{tmp_path}/a.fvecs", "-r", "120", "-M", method, "-m", "2", "-o", f"{tmp_path}/{method}.txt", "-j", f"{tmp_path}/run_{method}.json"], spark) == 0
    lines = (tmp_path / "bf.txt").read_text().splitlines()
    assert sorted(lines) == sorted((tmp_path / "gvor.txt").read_text().splitlines())
    assert lines[0] == f"% 50 50 {len(lines) - 1}" and {f"{i} {i}" for i in range(1, 51)} <= set(lines)
    record = json.loads((tmp_path / "run_bf.json").read_text())
    assert record["num_points"] == 50 and record["num_edges"] == len(lines) - 1
    summary = run_summary(read_records(spark, f"file://{tmp_path}/run_*.json"))
    write_summary(summary, f"file://{tmp_path}/table")
    back = read_summary(spark, f"file://{tmp_path}/table")
    assert {r["infile"] for r in back.collect()} == {"a.fvecs"} and scaling(back).count() == 2
