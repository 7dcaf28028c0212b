"""Seeded draws of correlated outcomes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal(*parts: Column) -> Column:
    """A standard normal number that is a function of the parts alone: two hashes and the Box-Muller transform."""
    u = lambda salt: (F.shiftrightunsigned(F.xxhash64(F.lit(salt), *parts), 11).cast("double") + 0.5) / float(1 << 53)
    return F.sqrt(-2 * F.log(u("a"))) * F.cos(2 * math.pi * u("b"))


def factor_draws(members: DataFrame, draws: int, seed: int, loadings: dict[str, float], member: str) -> DataFrame:
    """(draw, member, z): standard normals that share a factor with all of the same group, for each grouping column.

    ``loadings`` are the groups' parts of the variance, the rest is the member's
    own.  Numbers are hashes of seed, draw and group, so nothing is exchanged
    and any partitioning gives the same draws.
    """
    own = 1 - sum(loadings.values())
    if own < 0:
        raise ValueError("loadings add up to more than 1")
    rows = members.hint("rebalance").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    z = math.sqrt(own) * normal(F.lit(seed), F.lit("own"), F.col("draw"), F.col(member).cast("string"))
    for column, part in loadings.items():
        z = z + math.sqrt(part) * normal(F.lit(seed), F.lit(column), F.col("draw"), F.col(column).cast("string"))
    return rows.select("draw", *members.columns, z.alias("z"))


def lognormal_outcomes(drawn: DataFrame, active: Column, scale: Column, shape: Column) -> DataFrame:
    """Outcomes of drawn normals: 0 in the lowest part of weight 1 - active, log-normal above."""

    def quantile(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inverse = np.vectorize(NormalDist().inv_cdf, otypes=[float])
        phi = np.vectorize(lambda x: 0.5 * math.erfc(-x / math.sqrt(2)), otypes=[float])
        for f in frames:
            p = phi(f["z"].to_numpy())
            a = f["__a"].to_numpy()
            inside = np.clip((p - (1 - a)) / np.maximum(a, 1e-12), 1e-12, 1 - 1e-12)
            value = np.where(p <= 1 - a, 0.0, f["__m"] * np.exp(f["__s"] * inverse(inside))) if len(f) else p
            yield f.drop(columns=["__a", "__m", "__s"]).assign(value=value)

    given = drawn.withColumns({"__a": active, "__m": scale, "__s": shape})
    schema = T.StructType([*drawn.schema.fields, T.StructField("value", T.DoubleType())])
    return given.mapInPandas(quantile, schema)
