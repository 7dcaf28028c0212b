"""Logistic models fitted per cohort, draws from their posterior, and totals that probabilities are made to meet.

A step of a fit is one aggregation of all rows per cohort, made where they are;
only a row a cohort, with coefficients and sums, goes round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.scratch import beside, cut, few


@dataclass(frozen=True)
class Offset:
    """A model of successes in trials: logit(base) + amplitude * tanh(slopes / amplitude) + intercepts.

    slopes: features whose sum is bounded by ``amplitude`` (None: not at all); intercepts: features that aren't.
    floors: features whose coefficient is 0 at least.  prior: standard deviation of the normal priors, for all or by feature.
    """

    slopes: tuple[str, ...]
    intercepts: tuple[str, ...] = ()
    floors: tuple[str, ...] = ()
    prior: float | dict[str, float] = 1.0
    amplitude: float | None = None
    least: float = 1e-9

    @property
    def features(self) -> tuple[str, ...]:
        return (*self.slopes, *self.intercepts)

    @property
    def precision(self) -> np.ndarray:
        """Of the priors, by feature."""
        return np.array([1.0 / (self.prior[f] if isinstance(self.prior, dict) else self.prior) ** 2 for f in self.features])

    @property
    def bounded(self) -> np.ndarray:
        return np.array([f in self.floors for f in self.features])


def _logit(p: Column, least: float) -> Column:
    """Of probabilities cut at ``least``; null for null, which greatest and least pass over."""
    q = F.greatest(F.least(p, F.lit(1 - least)), F.lit(least))
    return F.when(p.isNotNull(), F.log(q / (1 - q)))


def _softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def _with_predictor(rows: DataFrame, model: Offset) -> DataFrame:
    """Rows (o, s, n; a column x a feature, one b a coefficient) get eta and p, off and w (slope and curvature of the loss by eta), a column j a feature (what a coefficient's small change adds to eta), and bend, the second change of the slopes' part.

    Plain columns, no arrays: a pass over the rows is compiled as a whole.
    """
    dot = lambda low, high: sum((F.col(f"__x{i}") * F.col(f"__b{i}") for i in range(low, high)), F.lit(0.0))
    cut_at, k = len(model.slopes), len(model.features)
    raw, rest = dot(0, cut_at), dot(cut_at, k)
    if model.amplitude is None:
        z = rows.withColumns({"eta": F.col("o") + raw + rest, "bend": F.lit(0.0), **{f"__j{i}": F.col(f"__x{i}") for i in range(k)}})
    else:
        a = F.lit(float(model.amplitude))
        z = rows.withColumns({"tangent": F.tanh(raw / a), "rest": rest}).withColumn("first", 1 - F.col("tangent") * F.col("tangent"))
        j = {f"__j{i}": F.col(f"__x{i}") * (F.col("first") if i < cut_at else F.lit(1.0)) for i in range(k)}
        z = z.withColumns({"eta": F.col("o") + a * F.col("tangent") + F.col("rest"), "bend": -2 / a * F.col("first") * F.col("tangent"), **j})
    z = z.withColumn("p", 1 / (1 + F.exp(-F.col("eta"))))
    return z.withColumns({"off": F.col("n") * F.col("p") - F.col("s"), "w": F.col("n") * F.col("p") * (1 - F.col("p"))})


def _square(cell: Callable[[int, int], Column], k: int) -> Column:
    """The sums of a symmetric matrix' cells, row by row; each is computed once."""
    sums = {(a, b): F.sum(cell(a, b)) for a in range(k) for b in range(a, k)}
    return F.array(*(sums[min(a, b), max(a, b)] for a in range(k) for b in range(k)))


def offset_fit(df: DataFrame, keys: list[str], base: str, model: Offset, successes: str, trials: str, steps: int = 200, close: float = 1e-7) -> DataFrame:
    """Per cohort the most likely coefficients, and a normal approximation around them.

    Columns: keys; one coefficient a feature; objective (negative log posterior),
    gradient (its largest free entry), settled (that is below ``close``, or a
    step changes no digit any more), rows,
    dispersion and covariance (k * k numbers).  Steps are Newton's in the
    coefficients that are free; one at its floor is held there while the
    gradient pushes it down (an active set), so that the others settle at their
    own optimum.  A step that doesn't lower the objective is halved.  The
    covariance is the inverse of the full curvature, eigenvalues kept above
    1e-10 of the largest, times the dispersion: the mean squared residual, 1 at
    least.  Null keys are a cohort; rows with null features, trials or successes
    are not counted.  An empty table gives an empty result.
    """
    k, precision, bounded = len(model.features), model.precision, model.bounded
    x = [f"__x{i}" for i in range(k)]
    given = df.select(*keys, _logit(F.col(base), model.least).alias("o"), *(F.col(f).cast("double").alias(c) for f, c in zip(model.features, x, strict=True)), F.col(successes).cast("double").alias("s"), F.col(trials).cast("double").alias("n"))
    # every pass reads these rows: they are dealt evenly, however few parts the table was read in
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ("o", "s", "n", *x)])
    rows = cut(given.where(whole).hint("rebalance"), "offset-rows")
    numbers = "b array<double>, direction array<double>, part double, objective double, gradient double, settled boolean"
    zero = [0.0] * k
    start = {"b": F.array(*map(F.lit, zero)), "direction": F.array(*map(F.lit, zero)), "part": F.lit(0.0), "objective": F.lit(float("inf")), "gradient": F.lit(float("inf")), "settled": F.lit(False)}
    now = cut(rows.select(*keys).distinct().withColumns(start), "offset")
    kinds = T.StructType([*(f for f in df.select(*keys).schema.fields), *T.StructType.fromDDL(numbers).fields])

    def sums(open_: DataFrame) -> DataFrame:
        at = [F.get("b", F.lit(i)) + F.col("part") * F.get("direction", F.lit(i)) for i in range(k)]
        trial = open_.select(*keys, *((F.greatest(v, F.lit(0.0)) if f else v).alias(f"__b{i}") for i, (v, f) in enumerate(zip(at, bounded.tolist(), strict=True))))
        z = _with_predictor(beside(rows, few(trial, trial), keys), model)
        grad = F.array(*(F.sum(F.col("off") * F.col(f"__j{i}")) for i in range(k)))
        curve = _square(lambda a, b: F.col("w") * F.col(f"__j{a}") * F.col(f"__j{b}"), k)
        loss = F.sum(F.col("n") * _softplus(F.col("eta")) - F.col("s") * F.col("eta"))
        return z.groupBy(*keys).agg(grad.alias("g"), curve.alias("h"), loss.alias("f"))

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                tried = np.array(r.b) + r.part * np.array(r.direction)
                tried[bounded] = np.maximum(tried[bounded], 0.0)
                g, h = np.array(r.g) + precision * tried, np.array(r.h).reshape(k, k) + np.diag(precision)
                f = r.f + 0.5 * float(precision @ tried**2)
                if not f <= r.objective + 1e-12 * max(1.0, abs(r.objective)) and r.part > 1e-12:
                    out.append((r.b, r.direction, r.part / 2, r.objective, r.gradient, False))
                    continue
                free = ~(bounded & (tried <= 0) & (g > 0))
                direction = np.zeros(k)
                if free.any():
                    direction[free] = -np.linalg.solve(h[np.ix_(free, free)], g[free])
                most = float(np.abs(g[free]).max(initial=0.0))
                stuck = r.part <= 1e-12 and np.isfinite(r.objective)
                near = most < close or float(np.abs(direction).max()) < 1e-12 * max(1.0, float(np.abs(tried).max()))
                out.append((tried.tolist(), direction.tolist(), 0.0 if stuck else 1.0, f, most, near))
            made = pd.DataFrame(out, columns=kinds.names[len(keys) :], index=frame.index)
            yield pd.concat([frame[keys], made], axis=1)

    closed = None
    for _ in range(steps):
        found = beside(now, sums(now), keys)
        new = cut(found.select(*keys, "b", "direction", "part", "objective", "gradient", "g", "h", "f").mapInPandas(step, kinds), "offset")
        done = new.where("settled OR part = 0")
        closed = done if closed is None else closed.unionByName(done)
        now = new.where("NOT settled AND part > 0")
        if now.isEmpty():
            break
    fitted = closed.unionByName(now) if closed is not None else now
    final = cut(fitted.select(*keys, "b", "objective", "gradient", "settled"), "offset")
    return _approximated(rows, final, keys, model)


def _approximated(rows: DataFrame, fitted: DataFrame, keys: list[str], model: Offset) -> DataFrame:
    """The fits with rows, dispersion and covariance, from one more pass over the rows."""
    k, slopes, precision = len(model.features), len(model.slopes), model.precision
    at = fitted.select(*keys, *(F.get("b", F.lit(i)).alias(f"__b{i}") for i in range(k)))
    z = _with_predictor(beside(rows, few(at, at), keys), model)
    x, j = (lambda i: F.col(f"__x{i}")), (lambda i: F.col(f"__j{i}"))
    cell = lambda a, b: F.col("w") * j(a) * j(b) + (F.col("off") * F.col("bend") * x(a) * x(b) if max(a, b) < slopes else F.lit(0.0))
    sums = z.groupBy(*keys).agg(F.count("*").alias("rows"), _square(cell, k).alias("h"), F.sum(F.col("off") * F.col("off") / F.greatest(F.col("w"), F.lit(1e-12))).alias("pearson"))
    kinds = T.StructType([*fitted.select(*keys).schema.fields, *(T.StructField(f, T.DoubleType()) for f in model.features), *T.StructType.fromDDL("objective double, gradient double, settled boolean, rows long, dispersion double, covariance array<double>").fields])

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                spare = r.rows - k
                dispersion = max(1.0, r.pearson / spare) if spare > 0 else 1.0
                out.append((*r.b, r.objective, r.gradient, r.settled, r.rows, dispersion, (stable_inverse(np.array(r.h).reshape(k, k) + np.diag(precision)) * dispersion).reshape(-1).tolist()))
            yield pd.concat([frame[keys], pd.DataFrame(out, columns=kinds.names[len(keys) :], index=frame.index)], axis=1)

    return beside(fitted, sums, keys).select(*keys, "b", "objective", "gradient", "settled", "rows", "h", "pearson").mapInPandas(finish, kinds)


def stable_inverse(matrix: np.ndarray) -> np.ndarray:
    """Inverse of a symmetric matrix whose eigenvalues are kept above 1e-10 of the largest, and above 1e-10."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    return (vectors / np.maximum(values, max(float(values.max()) * 1e-10, 1e-10))) @ vectors.T


def posterior_draws(mean: np.ndarray, covariance: np.ndarray, bounded: np.ndarray, draws: int, seed: Sequence[int]) -> np.ndarray:
    """Seeded draws of coefficients, a row each, of which bounded ones are 0 at least.

    Draws below a bound are rejected; after twenty rounds what is lacking is
    filled with draws whose bounded coefficients have their sign turned.
    """
    rng = np.random.default_rng(seed)
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    root = vectors * np.sqrt(np.maximum(values, 0))
    kept, lacking = [], draws
    for turn in range(21):
        some = mean + rng.standard_normal((max(2 * lacking, 64) if turn < 20 else lacking, len(mean))) @ root.T
        if turn < 20:
            some = some[(some[:, bounded] >= 0).all(axis=1)]
        else:
            some[:, bounded] = np.abs(some[:, bounded])
        kept.append(some[:lacking])
        lacking -= len(kept[-1])
        if not lacking:
            break
    return np.concatenate(kept)


def predict(df: DataFrame, fitted: DataFrame, keys: list[str], base: str, model: Offset, draws: int = 1000, seed: int = 7, together: int = 512) -> DataFrame:
    """The rows with low, middle and high (10, 50 and 90 % quantiles of the probability over the posterior), delta (middle less base) and positive (how likely it is above the base).

    A cohort's draws are made anew from its mean and covariance wherever its
    rows are, seeded by ``seed`` and the cohort's key, so any partitioning gives
    the same; ``together`` rows meet the draws at once.  Rows of a cohort without
    a fit have nulls, as have rows with nulls in base or features.
    """
    k, bounded, slopes = len(model.features), model.bounded, len(model.slopes)
    own = fitted.select(*keys, F.array(*(F.col(f) for f in model.features)).alias("__mean"), F.col("covariance").alias("__covariance"), F.to_json(F.struct(*keys)).alias("__cohort"))
    given = beside(df.hint("rebalance"), few(own, own), keys, "left")  # however few parts the table was read in
    given = given.withColumns({"__x": F.array(*(F.col(f).cast("double") for f in model.features)), "__base": F.col(base).cast("double")})
    names, columns = ["low", "middle", "high", "delta", "positive"], df.columns
    place = (draws - 1) * np.array([0.1, 0.5, 0.9])
    around, between = np.array([np.floor(place), np.ceil(place)], int), place - np.floor(place)
    kinds = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])

    def quantiles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for frame in frames:
            out = np.full((len(frame), len(names)), np.nan)
            x, p = np.array([[np.nan] * k if v is None else v for v in frame["__x"]], float).reshape(len(frame), k), frame["__base"].to_numpy(float)
            whole = np.isfinite(x).all(axis=1) & np.isfinite(p)
            for cohort, at in frame.groupby("__cohort", sort=False).indices.items():
                if cohort not in held:
                    if len(held) > 64:
                        held.clear()
                    first = frame.iloc[at[0]]
                    digest = hashlib.sha256(cohort.encode()).digest()
                    held[cohort] = posterior_draws(np.array(first["__mean"]), np.array(first["__covariance"]).reshape(k, k), bounded, draws, [seed, int.from_bytes(digest[:8], "little")])
                drawn = held[cohort]
                at = at[whole[at]]
                for some in np.array_split(at, -(-len(at) // together)) if len(at) else []:
                    raw = x[some, :slopes] @ drawn[:, :slopes].T
                    bent = raw if model.amplitude is None else model.amplitude * np.tanh(raw / model.amplitude)
                    q = np.clip(p[some], model.least, 1 - model.least)
                    moved = bent + x[some, slopes:] @ drawn[:, slopes:].T
                    above = (moved > 0).mean(axis=1)
                    moved.sort(axis=1)  # probabilities have the order of their logits: only those beside a quantile are needed
                    ends = 1 / (1 + np.exp(-((np.log(q) - np.log1p(-q))[:, None, None] + moved[:, around])))
                    low, middle, high = (ends[:, 0] + between * (ends[:, 1] - ends[:, 0])).T
                    out[some] = np.c_[low, middle, high, middle - p[some], above]
            made = pd.DataFrame(out, columns=names, index=frame.index)
            yield pd.concat([frame[columns], made], axis=1)

    nulled = given.mapInPandas(quantiles, kinds)
    return nulled.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})


def allocate(df: DataFrame, keys: list[str], weight: str, capacity: str, total: Column, unique: str, name: str = "share") -> DataFrame:
    """Each row's part of its group's ``total``, by weight, but no more than its capacity; what is over goes to the others by weight.

    Rows are filled in the order of capacity by weight: all up to some row are
    full, and those after it share the rest.  Weights count as 1e-9 at least,
    rows without capacity get nothing.  ``missing`` is what no row has room for.
    """
    w, c = F.greatest(F.col(weight), F.lit(1e-9)), F.greatest(F.coalesce(capacity, F.lit(0.0)), F.lit(0.0))
    rows = df.withColumns({"__w": w, "__c": c, "__t": total}).withColumn("__r", F.col("__c") / F.col("__w"))
    order = W.partitionBy(*keys).orderBy("__r", unique)
    before = F.coalesce(F.sum("__c").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("__w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    rows = rows.withColumn("__level", (F.col("__t") - before) / rest).withColumn("__full", F.col("__c") <= F.col("__level") * F.col("__w"))
    level = F.max(F.when(~F.col("__full"), F.col("__level"))).over(W.partitionBy(*keys))
    room = F.sum("__c").over(W.partitionBy(*keys))
    out = rows.withColumns({name: F.when(F.col("__full"), F.col("__c")).otherwise(F.greatest(level, F.lit(0.0)) * F.col("__w")), "missing": F.greatest(F.col("__t") - room, F.lit(0.0))})
    return out.drop("__w", "__c", "__t", "__r", "__level", "__full")


def shift_to_total(df: DataFrame, keys: list[str], p: str, target: Column, bound: float = 5.0, least: float = 1e-12, steps: int = 200) -> DataFrame:
    """Per group one shift of the logits, within the bound, so that the probabilities add up to the group's target; settled: whether they do, or the bound holds it.

    The first pass finds groups whose target lies beyond the bound.  For the
    others Newton's steps are taken, and halvings where one leaves the bracket; a
    pass sums the rows of groups that are still open, where they are.
    Probabilities are cut at ``least``; null ones aren't counted.  Null keys are
    a group.
    """
    given = df.select(*keys, _logit(F.col(p), least).alias("__x"), target.alias("__t")).where("__x IS NOT NULL")
    rows = cut(given, "shift-rows")
    at = lambda x: 1 / (1 + F.exp(-(F.col("__x") + x)))
    first = rows.groupBy(*keys).agg(F.max("__t").alias("t"), F.sum(at(F.lit(-bound))).alias("least"), F.sum(at(F.lit(bound))).alias("most"))
    fixed = F.when(F.col("t") <= F.col("least"), -bound).when(F.col("t") >= F.col("most"), bound)
    now = cut(first.select(*keys, "t", F.lit(-bound).alias("low"), F.lit(bound).alias("high"), F.coalesce(fixed, F.lit(0.0)).alias("shift"), (fixed.isNotNull() | F.col("t").isNull()).alias("settled")), "shift")
    closed, now = now.where("settled"), now.where("NOT settled")
    for _ in range(steps):
        if now.isEmpty():
            break
        z = beside(rows.drop("__t"), few(now, now), keys).withColumn("__q", at(F.col("shift")))
        sums = z.groupBy(*keys, "t", "low", "high", "shift").agg(F.sum("__q").alias("s"), F.sum(F.col("__q") * (1 - F.col("__q"))).alias("d"))
        low = F.when(F.col("s") < F.col("t"), F.col("shift")).otherwise(F.col("low"))
        high = F.when(F.col("s") < F.col("t"), F.col("high")).otherwise(F.col("shift"))
        step = (F.col("t") - F.col("s")) / F.greatest(F.col("d"), F.lit(1e-300))
        sums = sums.withColumns({"low": low, "high": high, "next": F.col("shift") + step, "close": F.abs(step) < 1e-10})
        inside = (F.col("next") > F.col("low")) & (F.col("next") < F.col("high"))
        moved = sums.select(*keys, "t", "low", "high", F.when(F.col("close") | inside, F.col("next")).otherwise((F.col("low") + F.col("high")) / 2).alias("shift"), (F.col("close") | (F.col("high") - F.col("low") < 1e-12)).alias("settled"))
        moved = cut(moved, "shift")
        closed, now = closed.unionByName(moved.where("settled")), moved.where("NOT settled")
    return closed.unionByName(now).select(*keys, "shift", "settled")


def calibrated_totals(df: DataFrame, keys: list[str], kind: str, p: str, slots: DataFrame, free: Column, unique: str) -> DataFrame:
    """The rows with ``calibrated``: probabilities shifted by kind so that each group's add up to its places.

    ``slots`` (kind, places, flexible) has each kind's fixed places, and whether
    it may take free ones; ``free`` is how many of these a group has.  Free
    places are shared by the kinds' probabilities, up to what a kind's rows can
    hold, unless the probabilities have the right total already, above each
    kind's fixed places: then each kind keeps its own.  Kinds
    without an entry have no places and get 0; more places than rows give 1.
    ``met``: the kind's total was reached.
    """
    of = df.groupBy(*keys, kind).agg(F.count("*").alias("__rows"), F.sum(F.coalesce(p, F.lit(0.0))).alias("__mass"), F.max(free).alias("__free"))
    known = beside(of, few(slots, slots), [kind], "left").na.fill({"places": 0.0, "flexible": False})
    by = W.partitionBy(*keys)
    flexible = lambda c: F.sum(F.when(F.col("flexible"), c)).over(by)
    right = F.abs(flexible(F.col("__mass")) - flexible(F.col("places")) - F.col("__free")) <= 1e-8
    above = F.min(F.when(F.col("flexible"), F.col("__mass") - F.col("places"))).over(by) >= -1e-8
    known = known.withColumns({"__room": F.when(F.col("flexible"), F.greatest(F.col("__rows") - F.col("places"), F.lit(0.0))).otherwise(0.0), "__right": F.coalesce(right & above, F.lit(False))})
    shared = allocate(known, keys, "__mass", "__room", F.col("__free").cast("double"), kind, "__more")
    total = F.col("places") + F.when(~F.col("flexible"), 0.0).when(F.col("__right"), F.col("__mass") - F.col("places")).otherwise(F.col("__more"))
    totals = cut(shared.select(*keys, kind, F.least(total, F.col("__rows").cast("double")).alias("__total"), (total <= F.col("__rows") + 1e-12).alias("__fits")), "totals")
    rows = beside(df, few(totals, totals), [*keys, kind], "left")
    shifts = shift_to_total(rows, [*keys, kind], p, F.col("__total"), 50.0)
    out = beside(rows, few(shifts, shifts), [*keys, kind], "left")
    x = _logit(F.col(p), 1e-12) + F.col("shift")
    return out.select(*df.columns, (1 / (1 + F.exp(-x))).alias("calibrated"), (F.col("__fits") & F.col("settled")).alias("met"))
