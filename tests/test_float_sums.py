"""Sums and averages of doubles: as of exact sums, whatever the order of rows."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from siftql import Engine
from siftql.plans import catalog_queries
from tests.conftest import SF

_rng = random.Random(7)
GROUPS = {
    "tenths": [0.1] * 10,
    "prices": [_rng.randrange(90_000, 10_500_000) / 100 * _rng.randrange(11) / 100 for _ in range(20_000)],
    "mixed": [_rng.uniform(-1, 1) * 2.0 ** _rng.randrange(-40, 60) for _ in range(20_000)],
    "cancelled": [x * s for x in (_rng.uniform(0, 1e9) for _ in range(5_000)) for s in (1, -1)] + [0.25],
}


@pytest.mark.parametrize("parts", [1, 7])
def test_sums_do_not_hang_on_order(spark, parts):
    rows = [(g, x) for g, xs in GROUPS.items() for x in xs]
    random.Random(parts).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double").repartition(parts)
    got = Engine(spark).register("t", df).sql("SELECT g, sum(x) AS s, avg(x) AS a FROM t GROUP BY g").collect()
    assert {r.g: (r.s, r.a) for r in got} == {g: (math.fsum(xs), math.fsum(xs) / len(xs)) for g, xs in GROUPS.items()}


def test_sums_of_odd_values(spark):
    inf, nan = math.inf, math.nan
    groups = {"null": [None, None], "some": [None, 1.5], "inf": [1.0, inf], "less": [-inf, 3.0], "both": [inf, -inf], "nan": [nan, 1.0], "huge": [1.7e308, -1.0e300], "over": [1.7e308, 1.7e308], "tiny": [5e-324, 5e-324], "large": [1e22, 1.0, -1e22]}
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g string, x double").coalesce(1)
    e = Engine(spark).register("t", df)
    got = {r.g: (r.s, r.a) for r in e.sql("SELECT g, sum(x) AS s, avg(x) AS a FROM t GROUP BY g").collect()}
    assert got.pop("null") == (None, None) and got.pop("some") == (1.5, 1.5)
    assert all(math.isnan(x) for g in ("both", "nan") for x in got.pop(g))
    assert got == {"inf": (inf, inf), "less": (-inf, -inf), "huge": (1.7e308 - 1e300, (1.7e308 - 1e300) / 2), "over": (inf, inf), "tiny": (1e-323, 5e-324), "large": (1.0, 1 / 3)}
    assert tuple(e.sql("SELECT sum(x) AS s, avg(x) AS a FROM t WHERE g = \"none\"").first()) == (None, None)


def test_agg_float_of_large_sums(spark, tmp_path):
    """As many digits as at 1 GB: doubles added one by one are off by some cents."""
    for t in catalog_queries.TABLES:
        if t != "lineitem":
            os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    n = 300_000
    cents, hundredths = F.col("id") * 7_919_999 % 2_000_000_011, F.col("id") * 31 % 11
    flag = F.element_at(F.array(*map(F.lit, "ANR")), (F.col("id") % 3 + 1).cast("int"))
    spark.range(n).select(flag.alias("l_returnflag"), (cents / 100).alias("l_extendedprice"), (hundredths / 100).alias("l_discount")).write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {}
    for k, f in enumerate("ANR"):
        pairs = [(i * 7_919_999 % 2_000_000_011, i * 31 % 11) for i in range(k, n, 3)]
        want[f] = (sum(c for c, _ in pairs), sum(h for _, h in pairs) * 10_000 // len(pairs), sum(c * h for c, h in pairs))
    got = catalog_queries.QUERIES["agg_float"](spark, str(tmp_path)).collect()
    assert {r.l_returnflag: (r.cents, r.a, r.d) for r in got} == want
