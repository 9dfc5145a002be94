import random

from pyspark.sql import functions as F

from vicinity.functions.fmt import fixed, format_bytes, format_large_number


def test_decimals_are_those_of_c(spark):
    rng = random.Random(1)
    values = [0.0, 0.05, 0.15, 0.25, 0.35, 0.45, 0.95, 0.995, 612.15, 813.25, 999.95, 1023.95, 1e9 + 0.25, -0.04, -2.5, -0.25, 1 / 3, 2.675, 1.005, 123456.125]
    values += [rng.randrange(10**6) / 10 ** rng.randrange(1, 5) for _ in range(3000)] + [rng.uniform(0, 1100) for _ in range(1000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", fixed(F.col("v"), 1).alias("one"), fixed(F.col("v"), 2).alias("two")).collect()
    for r in rows:
        assert (r["one"], r["two"]) == (f"{r['v']:.1f}", f"{r['v']:.2f}")


def test_units(spark):
    cases = [(0, "0.0", "0.0B"), (612150, "612.1K", "597.8KB"), (832768, "832.8K", "813.2KB"), (10**6, "1.0M", "976.6KB"), (-1500, "-1.5K", "-1.5KB"), (3e18, "3.00E", "2.6EB"), (None, None, None)]
    rows = spark.createDataFrame([(float(n) if n is not None else None,) for n, *_ in cases], "v double").select(format_large_number(F.col("v")), format_bytes(F.col("v"))).collect()
    assert [tuple(r) for r in rows] == [c[1:] for c in cases]
