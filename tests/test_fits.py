"""Fits, predictions and totals against numpy and plain loops."""

import glob
import hashlib
import math
import os
import random

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidemark.operators import fits


def plain_fit(o, x, s, n, precision, bounded):
    """Projected Newton steps with halving until nothing moves."""
    b = np.zeros(x.shape[1])
    loss = lambda v: (n * np.logaddexp(0, o + x @ v) - s * (o + x @ v)).sum() + 0.5 * precision @ v**2
    for _ in range(300):
        p = 1 / (1 + np.exp(-(o + x @ b)))
        g, h = x.T @ (n * p - s) + precision * b, x.T @ ((n * p * (1 - p))[:, None] * x) + np.diag(precision)
        free = ~(bounded & (b <= 0) & (g > 0))
        d = np.zeros(len(b))
        d[free] = -np.linalg.solve(h[np.ix_(free, free)], g[free])
        t = 1.0
        while t > 1e-14 and loss(np.where(bounded, np.maximum(b + t * d, 0), b + t * d)) > loss(b):
            t /= 2
        b = np.where(bounded, np.maximum(b + t * d, 0), b + t * d)
    return b, g, free, h


def test_active_bound_with_correlated_features(spark):
    rng = np.random.default_rng(5)
    rows, data = [], {}
    for k, pull in ((None, -1.5), ("in", 1.2), ("out", -0.8)):
        z = rng.normal(size=400)
        x = np.c_[z, 0.9 * z + 0.4 * rng.normal(size=400)]
        base = rng.uniform(0.05, 0.95, 400)
        n = rng.integers(1, 40, 400).astype(float)
        s = rng.binomial(n.astype(int), 1 / (1 + np.exp(-(np.log(base / (1 - base)) + pull * x[:, 0] + 0.6 * x[:, 1])))).astype(float)
        data[k] = (np.log(base / (1 - base)), x, s, n)
        rows += [(k, float(q), float(a), float(b), float(u), float(v)) for q, (a, b), u, v in zip(base, x, s, n, strict=True)]
    rows += [("in", 0.5, None, 1.0, 1.0, 1.0), ("in", 0.5, 1.0, 1.0, None, 1.0), ("in", None, 1.0, 1.0, 1.0, 1.0)]
    model = fits.Offset(("a", "b"), floors=("a",), prior={"a": 2.0, "b": 0.7})
    df = spark.createDataFrame(rows, "k string, base double, a double, b double, s double, n double").repartition(5)
    got = {r.k: r for r in fits.offset_fit(df, ["k"], "base", model, "s", "n").collect()}
    assert set(got) == set(data)
    for k, r in got.items():
        b, g, free, h = plain_fit(*data[k], model.precision, model.bounded)
        assert np.allclose([r.a, r.b], b, atol=1e-7) and r.settled and r.gradient < 1e-6 and r.rows == 400
        o, x, s, n = data[k]
        p = 1 / (1 + np.exp(-(o + x @ b)))
        dispersion = max(1.0, ((n * p - s) ** 2 / (n * p * (1 - p))).sum() / 398)
        assert np.allclose(np.array(r.covariance).reshape(2, 2), np.linalg.inv(h) * dispersion, rtol=1e-6)
    assert got[None].a == 0.0 and got["in"].a > 0.5
    assert fits.offset_fit(df.limit(0), ["k"], "base", model, "s", "n").count() == 0
    # predictions: any partitioning gives the same, unknown cohorts and null rows have nulls
    fitted = spark.createDataFrame([tuple(r) for r in got.values()], fits.offset_fit(df, ["k"], "base", model, "s", "n").schema)
    ask = spark.createDataFrame([(i, k, 0.3, i / 50 - 1, 0.4) for i, k in enumerate([None, "in", "out", "new"] * 30)] + [(900, "in", None, 1.0, 1.0), (901, "in", 0.5, None, 1.0)], "i int, k string, base double, a double, b double")
    one, two = ({r.i: r for r in fits.predict(ask.repartition(m), fitted, ["k"], "base", model, together=t).collect()} for m, t in ((1, 512), (7, 3)))
    assert one == two and len(one) == 122
    for i, r in one.items():
        assert (r.middle is None) == (r.k == "new" or i >= 900)
    near = [r for r in one.values() if r.k == "out"]
    assert all(r.low <= r.middle <= r.high and 0 <= r.positive <= 1 for r in near)
    # draws respect the bound, also where nearly none does
    for mean in (0.5, -0.2, -60.0):
        drawn = fits.posterior_draws(np.array([mean, 1.0]), np.array([[1.0, 0.3], [0.3, 2.0]]), np.array([True, False]), 500, [1, 2])
        assert drawn.shape == (500, 2) and (drawn[:, 0] >= 0).all()
    assert abs(np.cov(fits.posterior_draws(np.array([50.0, 1.0]), np.array([[1.0, 0.3], [0.3, 2.0]]), np.array([True, False]), 40_000, [1])[:, 1]) - 2) < 0.1


def test_singular_curvature():
    m = np.array([[4.0, 4.0], [4.0, 4.0]])
    inverse = fits.stable_inverse(m)
    assert np.isfinite(inverse).all() and np.allclose(m @ inverse @ m, m, atol=1e-5)


def plain_allocation(weights, capacities, total):
    """Shares by weight, in rounds, full ones leaving."""
    out, active = {k: 0.0 for k in weights}, {k for k, c in capacities.items() if c > 0}
    while total > 1e-13 and active:
        whole, given = sum(max(weights[k], 1e-9) for k in active), 0.0
        for k in active:
            more = min(total * max(weights[k], 1e-9) / whole, capacities[k] - out[k])
            out[k] += more
            given += more
        total -= given
        active = {k for k in active if capacities[k] - out[k] > 1e-13}
    return out, total


def test_allocation(spark):
    rng = random.Random(4)
    groups = {g: [(f"m{i}", rng.choice([0.0, rng.random() * 5]), rng.choice([0.0, -1.0, rng.random() * 3])) for i in range(rng.randint(1, 9))] for g in range(60)}
    totals = {g: rng.choice([0.0, 1.0, 4.0, 30.0]) for g in groups}
    df = spark.createDataFrame([(g, m, w, c, totals[g]) for g, rows in groups.items() for m, w, c in rows], "g int, m string, w double, c double, t double")
    got = {(r.g, r.m): (r.share, r.missing) for r in fits.allocate(df, ["g"], "w", "c", F.col("t"), "m").collect()}
    for g, rows in groups.items():
        wanted, left = plain_allocation({m: w for m, w, _ in rows}, {m: max(c, 0.0) for m, _, c in rows}, totals[g])
        for m, _, c in rows:
            assert abs(got[g, m][0] - wanted[m]) < 1e-9 and got[g, m][0] <= max(c, 0) + 1e-12 and abs(got[g, m][1] - left) < 1e-9


def test_calibrated_totals(spark):
    rng = random.Random(9)
    rows = [(s, k, rng.random()) for s in ("x", None) for k, n in (("QB", 6), ("RB", 9), ("TE", 3)) for _ in range(n)]
    rows += [("right", "QB", 0.25)] * 4 + [("right", "RB", 0.5)] * 6 + [("right", "TE", 0.5)] * 4  # 1 + 3 + 2, as many as places
    rows += [("short", "QB", 0.5), ("other", "QB", 0.5), ("other", "QB", 0.2), ("other", "K", 0.9)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, slate string, kind string, p double")
    slots = spark.createDataFrame([("QB", 1.0, False), ("RB", 2.0, True), ("TE", 1.0, True)], "kind string, places double, flexible boolean")
    got = fits.calibrated_totals(df, ["slate"], "kind", "p", slots, F.lit(2), "i").collect()
    total = lambda s, k=None: math.fsum(r.calibrated for r in got if r.slate == s and k in (None, r.kind))
    for s in ("x", None):
        assert abs(total(s) - 6) < 1e-8 and abs(total(s, "QB") - 1) < 1e-8 and 2 <= total(s, "RB") and 1 <= total(s, "TE") <= 3 + 1e-8
        assert all(r.met for r in got if r.slate == s)
        mass = {k: sum(p for t, kind, p in rows if t == s and kind == k) for k in ("RB", "TE")}
        wanted, _ = plain_allocation(mass, {"RB": 7.0, "TE": 2.0}, 2.0)
        assert abs(total(s, "RB") - 2 - wanted["RB"]) < 1e-8
    assert all(abs(r.calibrated - r.p) < 1e-8 for r in got if r.slate == "right")
    assert total("short") > 1 - 1e-9 and total("other", "K") < 1e-8 and abs(total("other", "QB") - 1) < 1e-8 and len(got) == len(rows)


def _pieces(folder, name):
    """How many files with rows the newest table of this name has in the shared folder."""
    newest = max(glob.glob(f"{folder}/tidemark/{name}-*"), key=os.path.getmtime)
    return sum(pq.read_metadata(f).num_rows > 0 for f in glob.glob(f"{newest}/*.parquet"))


def test_rows_read_in_one_part_are_dealt(spark):
    """A table of one row group is one task's to read, but not to fit."""
    rng = np.random.default_rng(8)
    n = 200_000
    frame = pd.DataFrame({"i": np.arange(n), "k": "all", "base": rng.uniform(0.1, 0.9, n), "a": rng.normal(size=n), "b": rng.normal(size=n), "s": rng.integers(0, 2, n).astype(float), "n": 1.0})
    df = spark.createDataFrame(frame).coalesce(1)
    model = fits.Offset(("a",), ("b",), amplitude=1.5)
    (r,) = fits.offset_fit(df, ["k"], "base", model, "s", "n").collect()
    assert r.settled and r.rows == n
    assert _pieces(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"), "offset-rows") > 1
    fitted = spark.createDataFrame([tuple(r)], fits.offset_fit(df.limit(0), ["k"], "base", model, "s", "n").schema)
    got = fits.predict(df.drop("s", "n"), fitted, ["k"], "base", model).withColumn("part", F.spark_partition_id())
    assert got.agg(F.count("*"), F.count("middle"), F.countDistinct("i")).first()[:] == (n, n, n) and got.select("part").distinct().count() > 1


def test_quantiles_are_those_of_all_probabilities(spark):
    """Predictions against numpy's quantiles over all draws; odd numbers of draws, and one."""
    rng = np.random.default_rng(3)
    rows = [(i, "x", float(q), float(a), float(b)) for i, (q, a, b) in enumerate(zip(rng.uniform(0, 1, 40), rng.normal(size=40), rng.normal(size=40), strict=True))]
    mean, covariance = [0.4, -0.2], [0.09, 0.02, 0.02, 0.04]
    fitted = spark.createDataFrame([("x", *mean, covariance)], "k string, a double, b double, covariance array<double>")
    ask = spark.createDataFrame(rows, "i int, k string, base double, a double, b double")
    for amplitude in (None, 0.7):
        model = fits.Offset(("a",), ("b",), floors=("a",), amplitude=amplitude)
        for draws in (1000, 33, 1):
            seed = [7, int.from_bytes(hashlib.sha256(b'{"k":"x"}').digest()[:8], "little")]
            drawn = fits.posterior_draws(np.array(mean), np.array(covariance).reshape(2, 2), model.bounded, draws, seed)
            for r in fits.predict(ask, fitted, ["k"], "base", model, draws).collect():
                raw = r.a * drawn[:, 0]
                bent = raw if amplitude is None else amplitude * np.tanh(raw / amplitude)
                p = 1 / (1 + np.exp(-(math.log(r.base / (1 - r.base)) + bent + r.b * drawn[:, 1])))
                assert np.allclose([r.low, r.middle, r.high], np.quantile(p, [0.1, 0.5, 0.9]), rtol=1e-12, atol=0)
                assert math.isclose(r.delta, r.middle - r.base, abs_tol=1e-15) and r.positive == (p > r.base).mean()
