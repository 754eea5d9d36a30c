"""Quantiles of groups against NumPy, with bounds so small that every pass has work."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricetide.operators import quantiles as Q

WANTED = {"p0": 0.0, "p10": 0.1, "median": 0.5, "p99": 0.99, "p100": 1.0}


def close(a, b):
    return a is b is None or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-300)


@pytest.mark.parametrize(("small", "listed", "broadcast"), [(100_000, 4096, 50_000), (20, 4, 1), (0, 20, 50_000)])
def test_against_numpy(spark, monkeypatch, small, listed, broadcast):
    monkeypatch.setattr(Q, "SMALL", small)
    monkeypatch.setattr(Q, "LISTED", listed)
    monkeypatch.setattr(Q, "BROADCAST_CELLS", broadcast)
    monkeypatch.setattr(Q, "CELLS", 32)
    r = random.Random(1)
    groups = {
        ("a", 1): [r.gauss(0, 1) for _ in range(300)],
        ("a", None): [r.lognormvariate(0, 30) * r.choice([-1, 1]) for _ in range(200)],
        (None, 2): [5.0] * 90 + [6.0],
        ("b", 2): [r.choice([1.0, 2.0, 2.0000000000000004]) for _ in range(100)],
        ("c", 3): [1.5, None, float("nan"), float("inf")],
        ("d", 4): [None],
        ("e", 5): [-1e308, 1e308, 0.0, -0.0, 5e-324] * 9,
    }
    rows = [(*k, v) for k, vs in groups.items() for v in vs]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, j int, x double").repartition(3)
    got = {(g.k, g.j): g for g in Q.quantiles(df, ["k", "j"], F.col("x"), WANTED).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        v = [x for x in vs if x is not None and math.isfinite(x)]
        g = got[k]
        assert (g.n, g.min, g.max) == (len(v), min(v, default=None), max(v, default=None))
        for name, q in WANTED.items():
            h = (len(v) - 1) * q
            lo, hi = (sorted(v)[math.floor(h)], sorted(v)[math.ceil(h)]) if v else (None, None)
            want = None if not v else lo if math.floor(h) == math.ceil(h) else (math.ceil(h) - h) * lo + (h - math.floor(h)) * hi
            assert close(g[name], want), (k, name)


def test_ten_million_values_in_one_group(spark, monkeypatch):
    sizes = []
    real = F.collect_list
    monkeypatch.setattr(Q, "SMALL", 50_000)
    monkeypatch.setattr(Q.F, "percentile", lambda *a: sizes.append(a) or F.max(F.lit(0.0)))  # it may only see groups of few values
    monkeypatch.setattr(Q.F, "collect_list", lambda c: real(c))
    n = 10_000_000
    df = spark.range(n).select(F.lit("all").alias("k"), ((F.col("id") * 7_368_787) % n / F.lit(3.0) + 1).alias("x"))
    got = Q.quantiles(df, ["k"], F.col("x"), {"median": 0.5, "p25": 0.25}).first()
    assert got.n == n
    assert close(got.median, (n - 1) / 2 / 3 + 1) and close(got.p25, (n - 1) / 4 / 3 + 1)


def test_lists_stay_short(spark, monkeypatch):
    """What is put in order together never holds more than LISTED values."""
    monkeypatch.setattr(Q, "LISTED", 50)
    held = []
    real = Q.cut
    monkeypatch.setattr(Q, "cut", lambda df: held.append(real(df)) or held[-1])
    v = np.random.default_rng(4).normal(size=30_000)
    df = spark.createDataFrame([("g", float(x)) for x in v], "g string, v double").select(F.struct("g").alias(Q.G), "v")
    ranks = df.limit(1).select(Q.G).crossJoin(spark.createDataFrame([(0,), (15_000,), (29_999,)], "rank bigint"))
    got = {r["rank"]: r.v for r in Q.selected(df, ranks).collect()}
    assert got == {k: float(np.sort(v)[k]) for k in (0, 15_000, 29_999)}
    for df in held:
        if "held" in df.columns:
            assert df.where("held <= 50").groupBy(Q.G, "from").count().agg(F.max("count")).first()[0] in (None, *range(51))


def test_no_rows(spark):
    assert Q.quantiles(spark.createDataFrame([], "k int, x double"), ["k"], F.col("x"), WANTED).count() == 0
