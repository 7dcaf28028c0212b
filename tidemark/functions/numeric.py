"""Numbers: logits, bounded responses, heat, prices, distributions."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import DoubleType

_NORMAL = NormalDist()


def logit(p: Column, least: float = 1e-12) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - least)), F.lit(least))
    return F.log(q / (1 - q))


def expit(x: Column) -> Column:
    """Stable at both ends."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def bounded(x: Column, limit: float = 0.75) -> tuple[Column, Column, Column]:
    """limit * tanh(x / limit), its first and its second derivative."""
    t = F.tanh(x / limit)
    return limit * t, 1 - t * t, -2 / limit * t * (1 - t * t)


def heat(direction: Column, quality: Column, specificity: Column, novelty: Column, independence: Column, reach: Column, age: Column, half_life: float, least: float = 0.15) -> Column:
    """Direction times factors, log of reach and decay; soft factors are lifted to ``least``, novelty and direction are not."""
    soft = lambda c: least + (1 - least) * c
    return direction * soft(quality) * soft(specificity) * novelty * soft(independence) * F.log1p(reach) * F.pow(F.lit(2.0), -age / half_life)


def ratio(a: Column, b: Column) -> Column:
    """a by b, null where b is 0."""
    return a / F.when(b != 0, b)


def null_if_any_null(total: Column, value: Column) -> Column:
    """A sum that is null when one of its terms is."""
    return F.when(F.count(value) == F.count("*"), total)


def lognormal(mean: Column, low: Column, high: Column, p_low: float = 0.1, p_high: float = 0.9) -> tuple[Column, Column, Column]:
    """Scale, shape and the largest relative error of a log-normal with this mean and these two quantiles."""
    z_low, z_high = _NORMAL.inv_cdf(p_low), _NORMAL.inv_cdf(p_high)
    shape = (F.log(high) - F.log(low)) / (z_high - z_low)
    scale = mean * F.exp(-shape * shape / 2)
    off = lambda z, q: F.abs(scale * F.exp(shape * z) / q - 1)
    return scale, shape, F.greatest(off(z_low, low), off(z_high, high))


def _phi(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(z / math.sqrt(2)))


@pandas_udf(DoubleType())
def mixture_cdf(x: pd.Series, active: pd.Series, scale: pd.Series, shape: pd.Series) -> pd.Series:
    """Distribution function of a point mass at 0 and a log-normal part of weight ``active``."""
    z = np.log(np.maximum(x, 1e-300) / scale) / shape
    return pd.Series(np.where(x < 0, 0.0, np.where(x == 0, 1 - active, 1 - active + active * _phi(z.to_numpy()))))


def mixture_left_cdf(x: Column, active: Column, scale: Column, shape: Column) -> Column:
    """What lies strictly below x: the mass at 0 counts from above 0 on."""
    return F.when(x <= 0, 0.0).otherwise(mixture_cdf(x, active, scale, shape))


def active_log_density(x: Column, scale: Column, shape: Column) -> Column:
    """Log of the log-normal part's density; minus infinity where it has none."""
    z = F.log(F.when(x > 0, x) / scale) / shape
    return F.when(x > 0, -F.log(F.when(x > 0, x)) - F.log(shape) - math.log(2 * math.pi) / 2 - z * z / 2).otherwise(F.lit(float("-inf")))


def mixture_mean(active: Column, scale: Column, shape: Column) -> Column:
    """The mean of both parts; that of the log-normal part with 1 for ``active``."""
    return active * scale * F.exp(shape * shape / 2)


@pandas_udf(DoubleType())
def mixture_quantile(p: pd.Series, active: pd.Series, scale: pd.Series, shape: pd.Series) -> pd.Series:
    inside = np.clip((p - (1 - active)) / np.maximum(active, 1e-300), 1e-15, 1 - 1e-15)
    z = np.array([_NORMAL.inv_cdf(q) for q in inside])
    return pd.Series(np.where(p <= 1 - active, 0.0, scale * np.exp(shape * z)))


@pandas_udf(DoubleType())
def mixture_crps(y: pd.Series, active: pd.Series, scale: pd.Series, shape: pd.Series) -> pd.Series:
    """Continuous ranked probability score in closed form, the point mass at 0 included."""
    y, a, m, s = (v.to_numpy(float) for v in (y, active, scale, shape))
    mean = m * np.exp(s * s / 2)
    z = np.log(np.maximum(y, 1e-300) / m) / s
    inside = np.where(y > 0, y * (2 * _phi(z) - 1) + mean * (1 - 2 * _phi(z - s)), mean - y)
    pair = 2 * mean * (2 * _phi(s / math.sqrt(2)) - 1)
    return pd.Series((1 - a) * np.abs(y) + a * inside - 0.5 * (2 * a * (1 - a) * mean + a * a * pair))


def mixture_log_score(y: Column, active: Column, scale: Column, shape: Column) -> Column:
    """Minus the log of the mass at 0 or the density above; infinite outside."""
    z = F.log(y / scale) / shape
    density = F.log(active) - F.log(y * shape * math.sqrt(2 * math.pi)) - z * z / 2
    return F.when(y == 0, -F.log(1 - active)).when(y > 0, -density).otherwise(F.lit(float("inf")))
