"""python -m vicinity.cli -i points.fvecs -r 0.15: the neighbour graph of a vector file."""

from __future__ import annotations

import argparse
import logging
import sys
import time

from pyspark.sql import SparkSession

from .sources.vecfile import read_points


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vicinity")
    p.add_argument("-i", "--input", required=True, help="points (.fvecs, .fbin, .u8bin)")
    p.add_argument("-r", "--radius", type=float, required=True)
    p.add_argument("-c", "--cover", type=float, default=1.55, help="ratio of ball radii from level to level")
    p.add_argument("-l", "--leaf-size", type=int, default=10)
    p.add_argument("-m", "--centers", type=int, default=10, help="centers per core; with -F in all")
    p.add_argument("-q", "--queries-per-tree", type=int, default=-1, help="queries in a slice (-1: all)")
    p.add_argument("-A", "--assignment", choices=("static", "multiway"), default="multiway")
    p.add_argument("-B", "--balancing", choices=("static", "steal"), default="static")
    p.add_argument("-M", "--method", choices=("auto", "bf", "ct", "ctrma", "cvor", "gvor"), default="cvor")
    p.add_argument("-o", "--output", help="edge file")
    p.add_argument("-j", "--json", help="run record")
    p.add_argument("-F", "--fixed", action="store_true", help="the number of centers is the total")
    p.add_argument("-v", "--verbosity", type=int, choices=range(4), default=1, help="0: warnings; 1: the result; 2: what is run; 3: all")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    if not a.radius >= 0:
        parser().error("the radius must be 0 or more")
    logging.basicConfig(level=logging.WARNING, format="%(name)s: %(message)s")
    logging.getLogger("vicinity").setLevel((logging.WARNING, logging.WARNING, logging.INFO, logging.DEBUG)[a.verbosity])
    spark = spark or SparkSession.builder.appName("vicinity").getOrCreate()
    began = time.time()
    points = read_points(spark, a.input)
    centers = a.centers * (1 if a.fixed else spark.sparkContext.defaultParallelism)
    graph = points.neighbors(
        a.radius, a.method, num_centers=centers, leaf_size=a.leaf_size, cover=a.cover, assignment=a.assignment, balancing=a.balancing, queries_per_tree=a.queries_per_tree
    ).written()
    graph.parameters["infile"] = a.input
    graph.runtime = time.time() - began
    if a.verbosity:
        s = graph.summary().first()
        print(f"points={s['num_points']} edges={s['num_edges']} density={s['density']:.3f} time={graph.runtime:.3f}")
    if a.output:
        graph.write_edge_file(a.output)
    if a.json:
        graph.write_run_record(a.json)
    return 0


if __name__ == "__main__":
    sys.exit(main())
