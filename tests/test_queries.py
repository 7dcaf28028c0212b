import math

import numpy as np
import pytest

from conftest import SF, same_rows
from tidemark.plans.catalogue import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_are_those_of_the_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df())


def test_beta_intervals(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").toPandas()
    x = (np.arange(400_000) + 0.5) / 400_000
    got = QUERIES["beta_intervals"](spark, SF).collect()
    assert {r.user_id for r in got} == set(events["user_id"])
    for r in got:
        own = events[events["user_id"] == r.user_id]["event_type"]
        a, b = (own == "error").sum() + 1, (own != "error").sum() + 1
        density = np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
        total = np.cumsum(density) / len(x)
        assert math.isclose(r.mean, a / (a + b)) and abs(total[int(r.low * len(x))] - 0.05) < 1e-4 and abs(total[int(r.high * len(x))] - 0.95) < 1e-4


def test_distribution_scores(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").toPandas()
    got = {r.event_id: r for r in QUERIES["distribution_scores"](spark, SF).collect()}
    assert set(got) == set(events["event_id"])
    phi = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
    for _, own in events.groupby("event_type"):
        v = own["value"][own["value"] > 0]
        low, high = np.quantile(v, [0.1, 0.9])
        shape = math.log(high / low) / (2 * 1.2815515655446004)
        scale, active = v.mean() * math.exp(-shape * shape / 2), len(v) / (len(own) + 1)
        grid = np.r_[0, np.geomspace(1e-4, 1e5, 200_001)]
        cdf = 1 - active + active * np.array([phi(math.log(max(g, 1e-300) / scale) / shape) for g in grid[::50]])
        for r in own.head(5).itertuples():
            wanted = 1 - active + active * phi(math.log(r.value / scale) / shape) if r.value > 0 else 1 - active
            assert abs(got[r.event_id].cdf - wanted) < 2e-6
            crps = np.trapezoid((cdf - (grid[::50] >= r.value)) ** 2, grid[::50])
            assert abs(got[r.event_id].crps - crps) < 0.02 * max(1, crps)


def _eta(b, x, model):
    raw = x[:, :2] @ b[:2]
    return math.log(0.3 / 0.7) + model.amplitude * np.tanh(raw / model.amplitude) + x[:, 2] * b[2]


def _trials():
    import pandas as pd

    events = pd.read_parquet(f"{SF}/events.parquet")
    us = events["ts"].astype("datetime64[us]").astype("int64").to_numpy()
    x = np.c_[np.abs(us % 86_400_000_000 / 86_400_000_000 - 0.5), events["user_id"] % 2, np.ones(len(events))]
    return events, x, (np.round(events["value"].to_numpy() * 100) > 1500).astype(float)


def test_fitted_offsets(spark):
    from tidemark.plans.queries import OFFSETS

    got = {r.event_type: r for r in QUERIES["fitted_offsets"](spark, SF).collect()}
    events, x, y = _trials()
    assert set(got) == set(events["event_type"])

    def loss(b, own):
        eta = _eta(b, x[own], OFFSETS)
        return np.logaddexp(0, eta).sum() - y[own] @ eta + 0.5 * (OFFSETS.precision @ b**2)

    for kind, r in got.items():
        own = (events["event_type"] == kind).to_numpy()
        b, near = np.array([r.noon, r.even, r.every]), 1e-4 * np.eye(3)
        slope = np.array([(loss(b + d, own) - loss(b - d, own)) / 2e-4 for d in near])
        free = ~((b <= 0) & (slope > 0) & OFFSETS.bounded)
        assert r.settled and r.gradient < 1e-6 and np.abs(slope[free]).max() < 1e-4 and b[0] >= 0 and math.isclose(r.objective, loss(b, own), rel_tol=1e-9)
        curve = np.array([[(loss(b + d + e, own) - loss(b + d - e, own) - loss(b - d + e, own) + loss(b - d - e, own)) / 4e-8 for e in near] for d in near])
        p = 1 / (1 + np.exp(-_eta(b, x[own], OFFSETS)))
        dispersion = max(1.0, ((y[own] - p) ** 2 / (p * (1 - p))).sum() / (own.sum() - 3))
        assert math.isclose(r.dispersion, dispersion, rel_tol=1e-9) and np.allclose(np.array(r.covariance).reshape(3, 3), np.linalg.inv(curve) * dispersion, rtol=1e-3, atol=1e-5)


def test_predicted_rates(spark):
    from tidemark.plans.queries import OFFSETS

    fitted = {r.event_type: r for r in QUERIES["fitted_offsets"](spark, SF).collect()}
    events, x, _ = _trials()
    got = {r.event_id: r for r in QUERIES["predicted_rates"](spark, SF).collect()}
    assert set(got) == set(events["event_id"])
    rng = np.random.default_rng(1)
    for kind, r in fitted.items():
        b = rng.multivariate_normal([r.noon, r.even, r.every], np.array(r.covariance).reshape(3, 3), 60_000)
        b = b[b[:, 0] >= 0]
        for at in np.flatnonzero((events["event_type"] == kind).to_numpy())[:8]:
            raw = b[:, :2] @ x[at, :2]
            p = 1 / (1 + np.exp(-(math.log(0.3 / 0.7) + OFFSETS.amplitude * np.tanh(raw / OFFSETS.amplitude) + b[:, 2])))
            row, spread = got[int(events["event_id"][at])], p.std()
            assert np.abs(np.array([row.low, row.middle, row.high]) - np.quantile(p, [0.1, 0.5, 0.9])).max() < 0.25 * spread
            assert math.isclose(row.delta, row.middle - 0.3) and abs(row.positive - (p > 0.3).mean()) < 0.05


def test_matched_names(spark):
    got = QUERIES["matched_names"](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/part.parquet").count() and sum(r.stage > 0 for r in got) > 0.3 * len(got)


def test_page_text(spark):
    got = QUERIES["visible_page_text"](spark, SF).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert all("<" not in r.text and len(r.text) < len(pages[r.page_id]) for r in got) and sum(bool(r.text) for r in got) == len(got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
