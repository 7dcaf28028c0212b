"""Grouped measures: shares, scores, entropy, decay, errors, calibration, ranks and samples."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import DoubleType

from tidemark.scratch import beside, cut, discard, few


def share_of_total(df: DataFrame, keys: list[str], value: str) -> Column:
    """A row's part of its group's total, six places; null if the total is 0."""
    total = F.sum(value).over(W.partitionBy(*keys))
    return F.round(F.col(value) / F.when(total != 0, total), 6)


def winsorized(df: DataFrame, keys: list[str], value: str, name: str, limit: float = 4.0) -> DataFrame:
    """The rows with their distance from the group's mean in population standard deviations, cut at the limit; 0 where all are equal.

    Means come from an aggregation that each task begins for its rows, and are
    joined back, so that no group's rows meet in one task.
    """
    of = df.groupBy(*keys).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s")).withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    z = F.when(F.col("__s") > 0, (F.col(value) - F.col("__m")) / F.when(F.col("__s") > 0, F.col("__s"))).otherwise(0.0)
    return df.join(of, same, "left").withColumn(name, F.greatest(F.least(z, F.lit(limit)), F.lit(-limit))).select(*df.columns, name)


def entropy(df: DataFrame, keys: list[str], kind: str, kinds: int | None = None) -> DataFrame:
    """Shannon entropy (natural) of a column's values per group; by the logarithm of ``kinds`` and at most 1 if that is given."""
    counts = df.groupBy(*keys, kind).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(W.partitionBy(*keys))
    h = -F.sum(F.col("p") * F.log("p"))
    h = F.least(h / math.log(kinds), F.lit(1.0)) if kinds else h
    return counts.withColumn("p", p).groupBy(*keys).agg(F.count("*").alias("kinds"), F.round(h, 6).alias("entropy"))


def decayed_sum(value: Column, age: Column, half_life: float) -> Column:
    """Sum of values that halve with each half-life of age; ages below 0 count as 0."""
    return F.sum(value * F.pow(F.lit(0.5), F.greatest(age, F.lit(0.0)) / half_life))


def errors(predicted: Column, actual: Column, least: int = 1) -> list[Column]:
    """n, bias, mae and rmse; null measures below ``least`` rows."""
    e = predicted - actual
    n = F.count(e)
    cut = lambda c: F.round(F.when(n >= least, c), 6)
    return [n.alias("n"), cut(F.avg(e)).alias("bias"), cut(F.avg(F.abs(e))).alias("mae"), cut(F.sqrt(F.avg(e * e))).alias("rmse")]


def probability_scores(p: Column, y: Column) -> list[Column]:
    """Brier score, and log score with probabilities cut at 1e-12."""
    q = F.greatest(F.least(p, F.lit(1 - 1e-12)), F.lit(1e-12))
    return [F.round(F.avg((p - y) * (p - y)), 6).alias("brier"), F.round(-F.avg(y * F.log(q) + (1 - y) * F.log(1 - q)), 6).alias("log_score")]


def classification(predicted: Column, actual: Column) -> list[Column]:
    """Counts of the four outcomes, precision, recall and F1; 0 of 0 is 1."""
    tp, fp, fn, tn = (F.count_if(x) for x in (predicted & actual, predicted & ~actual, ~predicted & actual, ~predicted & ~actual))
    part = lambda a, b: F.round(F.when(b == 0, 1.0).otherwise(a / F.when(b != 0, b)), 6)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), part(tp, tp + fp).alias("precision"), part(tp, tp + fn).alias("recall"), part(2 * tp, 2 * tp + fp + fn).alias("f1")]


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The rows with the mean of the places that equal values take in their group; null for nulls."""
    counts = running_counts(df, keys, value)
    place = counts.select(*keys, value, (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).alias(name))
    return beside(df, few(place, place), [*keys, value], "left")


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation per group; null where a side is constant."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("__u"), F.col(y).alias("__v"))
    ranked = average_ranks(average_ranks(both, keys, "__u", "__x"), keys, "__v", "__y")
    constant = (F.min("__x") == F.max("__x")) | (F.min("__y") == F.max("__y"))
    # sums of ranks are exact; the correlation follows from them
    n, sx, sy = F.count("*"), F.sum("__x"), F.sum("__y")
    top = n * F.sum(F.col("__x") * F.col("__y")) - sx * sy
    bottom = F.sqrt(n * F.sum(F.col("__x") * F.col("__x")) - sx * sx) * F.sqrt(n * F.sum(F.col("__y") * F.col("__y")) - sy * sy)
    return ranked.groupBy(*keys).agg(n.alias("n"), F.round(F.when(~constant, top / F.when(~constant, bottom)), 6).alias("spearman"))


def pit_histogram(df: DataFrame, keys: list[str], value: Column, bins: int) -> DataFrame:
    """Counts of values in [0, 1] per bin, empty bins too, with each bin's part of the chi-squared against an even spread."""
    groups = df.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    counts = df.withColumn("bin", F.least(F.floor(value * bins), F.lit(bins - 1)).cast("int")).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    full = groups.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    even = F.sum("n").over(W.partitionBy(*keys)) / bins
    return full.withColumn("chi2", F.round((F.col("n") - even) ** 2 / even, 6))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group in an order that ends in a unique id."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def stratified_sample(df: DataFrame, stratum: str, unique: str, version: str, n: int) -> DataFrame:
    """n rows, strata in turn, each in the order of a hash of version, stratum and id."""
    digest = F.sha2(F.concat_ws(":", F.lit(version), F.col(stratum), F.col(unique).cast("string")), 256)
    turn = F.row_number().over(W.partitionBy(stratum).orderBy(digest, unique))
    return df.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", stratum).limit(n)


def frequencies(df: DataFrame, value: str) -> DataFrame:
    """Each value's count and part of all rows."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))
    return counts.join(F.broadcast(total)).withColumn("share", F.round(F.col("n") / F.col("__total"), 6)).drop("__total")  # one row


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Distribution function of beta distributions inside (0, 1), by a continued fraction; ``whole`` is the log of 1 / B(a, b)."""
    flip = x > (a + 1) / (a + b + 2)  # from the side where it converges fast
    x, a, b = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    front = np.exp(a * np.log(x) + b * np.log1p(-x) + whole) / a
    c, d = np.ones_like(x), 1 / np.maximum(1 - (a + b) * x / (a + 1), 1e-300)
    h = d.copy()
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + term * d), 1 + term / c
            h *= c * d
        if (np.abs(c * d - 1) < 1e-14).all():
            break
    return np.where(flip, 1 - front * h, front * h)


@pandas_udf(DoubleType())
def beta_quantile(p: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """Quantile of a beta distribution, by bisection of its distribution function; a batch of rows at once."""
    p, a, b = (v.to_numpy(float) for v in (p, a, b))
    whole = _lgamma(a + b) - _lgamma(a) - _lgamma(b) if len(p) else p
    low, high = np.zeros(len(p)), np.ones(len(p))
    for _ in range(60 if len(p) else 0):
        mid = (low + high) / 2
        under = _beta_cdf(mid, a, b, whole) < p
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return pd.Series((low + high) / 2)


def calibration_line(df: DataFrame, keys: list[str], p: str, y: str, steps: int = 25) -> DataFrame:
    """Slope and intercept of a logistic regression of y on logit(p) per group, by Newton steps; settled: whether the last step moved neither.

    Where a group's outcomes are all alike, or told apart by p, no line is most
    likely: its step goes on to the end, and it isn't settled.  Each step is one
    aggregation of all rows per group, so groups of any size are spread over
    the cluster; only the coefficients, a row a group, go round.  Null keys are
    a group; rows with a null p or y aren't counted.
    """
    q = F.greatest(F.least(F.col(p), F.lit(1 - 1e-6)), F.lit(1e-6))
    rows = cut(df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).select(*keys, F.log(q / (1 - q)).alias("x"), F.col(y).cast("double").alias("y")), "calibration-rows")
    now = cut(rows.select(*keys).distinct().withColumns({"a": F.lit(0.0), "b": F.lit(1.0), "moved": F.lit(1.0)}), "calibration")
    for _ in range(steps):
        at = now.select(*keys, "a", "b")
        z = beside(rows, few(at, at), keys).withColumn("m", 1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("x"))))).withColumn("w", F.col("m") * (1 - F.col("m")))
        sums = z.groupBy(*keys, "a", "b").agg(*(F.sum(e).alias(k) for k, e in {"g0": F.col("y") - F.col("m"), "g1": (F.col("y") - F.col("m")) * F.col("x"), "h0": F.col("w"), "h1": F.col("w") * F.col("x"), "h2": F.col("w") * F.col("x") * F.col("x")}.items()))
        det = F.col("h0") * F.col("h2") - F.col("h1") * F.col("h1") + 1e-12
        da, db = (F.col("h2") * F.col("g0") - F.col("h1") * F.col("g1")) / det, (F.col("h0") * F.col("g1") - F.col("h1") * F.col("g0")) / det
        far = F.greatest(F.lit(1.0), F.abs(da), F.abs(db))  # a step goes no further than 1, which keeps steep groups from swinging away
        new = cut(sums.select(*keys, (F.col("a") + da / far).alias("a"), (F.col("b") + db / far).alias("b"), F.greatest(F.abs(da), F.abs(db)).alias("moved")), "calibration")
        discard(now)
        now = new
        if now.where("moved >= 1e-9").isEmpty():
            break
    return now.select(*keys, F.round("a", 5).alias("intercept"), F.round("b", 5).alias("slope"), (F.col("moved") < 1e-9).alias("settled"))


def settle(scores: DataFrame, draw: list[str], score: str, prizes: DataFrame) -> DataFrame:
    """Competition rank and prize of each entry of a draw: entries that tie share the sum of the prizes of the places they take.

    ``prizes`` has rank_from, rank_to and prize; the first band that holds a place
    wins, other places have 0.  Entries without a score take no place: they have
    no rank and win 0.  A null draw is a draw.  Per draw the distinct scores and
    their counts are ranked, not the entries, in ranges of the scores so that no
    draw is one task's; a tie's sum comes from the bands' running sums.
    """
    counts = running_counts(scores, draw, score)
    tied = counts.select(*draw, score, F.col("n").alias("tied"), (F.col("total") - F.col("upto") + 1).alias("rank"))
    each = prizes.select(F.explode(F.sequence("rank_from", "rank_to")).alias("place"), "prize", "rank_from")
    paid = each.groupBy("place").agg(F.min_by("prize", "rank_from").alias("prize"))
    places = paid.agg(F.max("place").alias("last")).where("last IS NOT NULL").select(F.explode(F.sequence(F.lit(1), "last")).alias("place"))
    each = places.join(paid, "place", "left").na.fill(0.0, ["prize"])
    upto = each.select("place", F.sum("prize").over(W.partitionBy(F.lit(0)).orderBy("place")).alias("upto"))  # a row a paid place
    last = upto.agg(F.max("place").alias("last"), F.max("upto").alias("all"))
    # nearly all ranks come after the last paid place: these get keys of their own that no place has, so that a join doesn't gather them
    at = lambda place: F.when(F.col("rank") <= F.col("last"), place).otherwise(-F.col("rank"))
    t = tied.join(F.broadcast(last)).withColumn("top", at(F.least(F.col("rank") + F.col("tied") - 1, F.col("last")))).withColumn("under", at(F.col("rank") - 1))
    upto = few(upto, upto)
    t = t.join(upto.withColumnsRenamed({"place": "top", "upto": "u1"}), "top", "left").join(upto.withColumnsRenamed({"place": "under", "upto": "u0"}), "under", "left")
    share = (F.coalesce("u1", F.lit(0.0)) - F.coalesce("u0", F.lit(0.0))) / F.col("tied")
    return beside(scores, t.select(*draw, score, "rank", "tied", F.round(share, 6).alias("won")), [*draw, score], "left").na.fill(0.0, ["won"])


def running_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, n, upto and total: each value's rows in its group, those up to it, and all; nulls aren't counted.

    Values are range-partitioned by group and value, and a group's partitions
    told how many rows come before them, so no group's values meet in one task.
    Null keys are a group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    order = [*keys, value]
    placed = cut(counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "counts")
    parts = placed.groupBy(*keys, "__part").agg(F.sum("n").alias("__n"))  # a row a group and partition
    upto = F.sum("__n").over(W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, W.currentRow))
    parts = cut(parts.select(*keys, "__part", (upto - F.col("__n")).alias("__before"), F.sum("__n").over(W.partitionBy(*keys)).alias("total")), "parts")
    inside = F.sum("n").over(W.partitionBy(*keys, "__part").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow))
    return beside(placed.withColumn("upto", inside), few(parts, parts), [*keys, "__part"]).select(*keys, value, "n", (F.col("upto") + F.col("__before")).alias("upto"), "total")


def quantiles(df: DataFrame, keys: list[str], value: str, parts: list[float]) -> DataFrame:
    """Per group the interpolated quantiles (p10 ...) and the lower ones (lower_10 ...), which are values of the group; exact, from running counts."""
    counts = running_counts(df, keys, value)
    found, out = [], []
    for p in parts:
        place, name = (F.col("total") - 1) * F.lit(p), f"{int(p * 100)}"
        at = lambda where, c: F.min(F.when(where, F.col(c)))
        found += [at(F.col("upto") > F.floor(place), value).alias(f"a{name}"), at(F.col("upto") > F.ceil(place), value).alias(f"b{name}"), at(F.col("upto") >= F.col("total") * F.lit(p) - 1e-9, value).alias(f"lower_{name}"), F.max(place - F.floor(place)).alias(f"f{name}")]
        out.append((F.col(f"a{name}") + F.col(f"f{name}") * (F.col(f"b{name}") - F.col(f"a{name}"))).alias(f"p{name}"))
    return counts.groupBy(*keys).agg(*found).select(*keys, *out, *(f"lower_{int(p * 100)}" for p in parts))
