"""Point-in-time reads, latest versions, as-of joins, changes, intervals and sessions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.scratch import beside, cut, few


def visible(as_of: Column, ingested: bool = True, observed_at: str = "observed_at", ingested_at: str = "ingested_at", valid_from: str = "valid_from", valid_to: str = "valid_to") -> Column:
    """Whether a row was known and valid at an instant: knowledge bounds inclusive, validity half open.

    ``ingested=False`` leaves out the bound on ingestion, as evaluation reports do.
    """
    known = (F.col(observed_at) <= as_of) & (F.col(valid_from) <= as_of)
    known &= F.col(valid_to).isNull() | (F.col(valid_to) > as_of)
    return known & (F.col(ingested_at) <= as_of) if ingested else known


class PitTable:
    """A table that is read only as of an instant."""

    def __init__(self, df: DataFrame) -> None:
        self._df = df

    def as_of(self, instant: Column | None, **columns: str) -> DataFrame:
        if instant is None:
            raise ValueError("a point-in-time read needs an instant")
        return self._df.where(visible(instant, **columns))


#: Rows from which a key is taken in parts instead of in one pass, by as-of joins and sessions; changes the work and no result.
LARGE_KEY = 2_000_000


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, which should end in a unique id.

    A grouped minimum of structs would move less, but needs columns that compare
    in descending order; the window keeps any order and any columns.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def latest_blend(df: DataFrame, keys: list[str], source: str, order: list[Column], values: list[str]) -> DataFrame:
    """The newest row of each key and source, then for each key the mean over sources; nulls don't count in their mean."""
    newest = latest_per_key(df, [*keys, source], order)
    return newest.groupBy(*keys).agg(F.count("*").alias("sources"), *(F.avg(v).alias(v) for v in values))


def latest_batch(df: DataFrame, keys: list[str], instant: str) -> DataFrame:
    """The rows of each key's newest instant, all or nothing."""
    return df.join(df.groupBy(*keys).agg(F.max(instant).alias(instant)), [*keys, instant], "left_semi")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], order: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Each left row with ``values`` of the newest right row at or before its time (before, if ``strict``).

    Ties in time go to the row that is last in ``order``.  Both sides are put
    into one stream per key and the last right row is carried on, so that a key
    costs a sort of its rows and not their product.  Where a key has many rows,
    the stream is cut in ranges of key and time, and a range told what the ranges
    before it carry on, so that no key passes through one task.  Left rows
    without a match have nulls.
    """
    ties = order or []
    carried = F.struct(*(F.col(v).alias(v) for v in values))
    r = right.select(*keys, F.col(right_time).alias("__t"), F.lit(1 if strict else 0).alias("__side"), F.struct(*ties).alias("__o") if ties else F.struct(F.lit(0).alias("z")).alias("__o"), carried.alias("__r"))
    whole = F.struct(*left.columns)
    l = left.select(*keys, F.col(left_time).alias("__t"), F.lit(0 if strict else 1).alias("__side"), whole.alias("__l"))  # noqa: E741
    both = r.unionByName(l, allowMissingColumns=True)
    order = ["__t", "__side", "__o"]
    counts = left.select(*keys).unionByName(right.select(*keys)).groupBy(*keys).agg(F.count("*").alias("__n"))
    if counts.where(F.col("__n") > LARGE_KEY).isEmpty():
        upto = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        found = both.withColumn("__m", F.last("__r", ignorenulls=True).over(upto)).where("__l IS NOT NULL")
    else:
        placed = both.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__part", F.spark_partition_id())
        placed = cut(placed, "asof")
        last = F.max_by("__r", F.when(F.col("__r").isNotNull(), F.struct(*order)))
        parts = placed.groupBy(*keys, "__part").agg(last.alias("__last"))  # a row a key and range
        before = F.last("__last", ignorenulls=True).over(W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
        parts = cut(parts.select(*keys, "__part", before.alias("__before")), "asof-ranges")
        inside = W.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        near = beside(placed, few(parts, parts), [*keys, "__part"])
        found = near.withColumn("__m", F.coalesce(F.last("__r", ignorenulls=True).over(inside), "__before")).where("__l IS NOT NULL")
    return found.select("__l.*", *(F.col(f"__m.{v}").alias(v) for v in values))


def changes(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The rows whose value differs from the row before, nulls being equal to each other; a key's first row counts."""
    w = W.partitionBy(*keys).orderBy(*order)
    seen = F.row_number().over(w)
    return df.withColumn("__was", F.lag(value).over(w)).withColumn("__n", seen).where((F.col("__n") == 1) | ~F.col(value).eqNullSafe(F.col("__was"))).drop("__was", "__n")


def intervals(df: DataFrame, keys: list[str], order: list[str], value: str, start: str) -> DataFrame:
    """Each state with the time at which the next one begins; the open one ends in null."""
    kept = changes(df, keys, order, value)
    return kept.withColumn("valid_to", F.lead(start).over(W.partitionBy(*keys).orderBy(*order)))


def sessions(df: DataFrame, keys: list[str], instant: str, unique: str, gap: int, span: int) -> DataFrame:
    """``session`` for each row, from 0 within its key: a new one begins when more than ``gap`` passed since the row before, or more than ``span`` since the session's first.

    ``instant`` is a number, in the unit of the limits.  Rows of most keys pass
    through one task in order, of which only the current session's first instant
    is held.  Keys with many rows are found first and cut in stretches of time
    (see _large_sessions), so that none passes through one task.  Null keys are a
    key; rows without an instant have no session.
    """
    rows = df.where(F.col(instant).isNotNull())
    large = cut(rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > LARGE_KEY).drop("__n"), "large-keys")
    lost = df.where(F.col(instant).isNull()).withColumn("session", F.lit(None).cast("long"))
    if large.isEmpty():
        return _walked_sessions(rows, keys, instant, unique, gap, span).unionByName(lost)
    there = few(large.withColumn("__large", F.lit(True)), large)
    split = beside(rows, there, keys, "left")
    small = split.where("__large IS NULL").drop("__large")
    return _walked_sessions(small, keys, instant, unique, gap, span).unionByName(_large_sessions(split.where("__large").drop("__large"), keys, instant, gap, span)).unionByName(lost)


def _walked_sessions(df: DataFrame, keys: list[str], instant: str, unique: str, gap: int, span: int) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField("session", T.LongType())])

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, first, before, number = None, 0, 0, 0
        for frame in frames:
            t, n = frame[instant].to_numpy(np.int64), len(frame)
            if not n:
                continue
            codes = [pd.factorize(frame[k], use_na_sentinel=False)[0] for k in keys]
            fresh = np.r_[True, np.any([np.diff(c) != 0 for c in codes], axis=0)] if keys else np.r_[True, np.zeros(n - 1, bool)]
            own = [tuple(None if v != v or v is None else v for v in frame[keys].iloc[i]) for i in (0, n - 1)]
            goes_on = own[0] == held
            fresh[0] = not goes_on
            breaks = fresh | (np.diff(t, prepend=before if goes_on else t[0]) > gap)
            starts = breaks.copy()
            heads = np.flatnonzero(breaks | (np.arange(n) == 0))
            for at, end in zip(heads.tolist(), [*heads[1:].tolist(), n], strict=True):  # a run without gaps at a time
                since = int(t[at]) if breaks[at] else first
                while (at := at + int(np.searchsorted(t[at:end], since + span, "right"))) < end:
                    starts[at], since = True, int(t[at])
            count = np.cumsum(starts)
            at_key = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
            session = np.where(at_key >= 0, count - count[at_key], number + count)
            held, before, number = own[1], int(t[-1]), int(session[-1])
            first = int(t[np.flatnonzero(starts)[-1]]) if starts.any() else first
            yield frame.assign(session=session)

    ordered = df.repartition(*keys).sortWithinPartitions(*keys, instant, unique)
    return ordered.mapInPandas(walk, schema)


def _large_sessions(df: DataFrame, keys: list[str], instant: str, gap: int, span: int) -> DataFrame:
    """Sessions of keys of any size.

    Instants of a key, each once, are dealt by stretches of time an eighth of the
    span long; a stretch is told the last instant before it and the first one
    after it by a row a stretch.  Runs between gaps that are no longer than the
    span are sessions.  In longer runs each instant has a successor, the first
    one beyond its span; a session begins at each instant that the run's first
    leads to over successors.  These are found by doubling: every round adds the
    successors of all found so far, and makes the successors of successors, so
    rounds grow with the logarithm of a run's sessions.
    """
    width = max(1, span // 8)
    key = F.to_json(F.struct(*keys))  # never null
    t = df.select(key.alias("__key"), F.col(instant).cast("long").alias("t")).distinct().withColumn("part", F.floor(F.col("t") / width))
    t = cut(t, "instants")
    inside, over = W.partitionBy("__key", "part").orderBy("t"), W.partitionBy("__key").orderBy("part")
    upto = lambda w: w.rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = t.groupBy("__key", "part").agg(F.min("t").alias("low"), F.max("t").alias("high"))  # a row a stretch
    parts = cut(parts.select("__key", "part", F.lag("high").over(over).alias("was"), F.lead("low").over(over).alias("next")), "stretches")
    marked = t.join(parts.drop("next"), ["__key", "part"]).withColumn("before", F.coalesce(F.lag("t").over(inside), "was"))
    marked = marked.withColumn("head", F.when(F.col("before").isNull() | (F.col("t") - F.col("before") > gap), F.col("t")))
    marked = cut(marked.select("__key", "part", "t", "head"), "marked")
    heads = marked.groupBy("__key", "part").agg(F.max("head").alias("last"))
    earlier = F.last("last", ignorenulls=True).over(over.rowsBetween(W.unboundedPreceding, -1))
    heads = heads.select("__key", "part", earlier.alias("earlier"))
    runs = marked.join(heads, ["__key", "part"]).select("__key", "part", "t", F.coalesce(F.last("head", ignorenulls=True).over(upto(inside)), "earlier").alias("run"))
    runs = cut(runs, "runs")
    long_ = runs.groupBy("__key", "run").agg(F.max("t").alias("end")).where(F.col("end") - F.col("run") > span).drop("end")
    within = cut(runs.join(long_, ["__key", "run"]), "long-runs")
    starts = runs.where("t = run").select("__key", "t")
    if not within.isEmpty():
        # the first instant beyond t + span: in its stretch, or the first of the next one that has any
        asked = within.select("__key", F.floor((F.col("t") + span) / width).alias("part"), (F.col("t") + span).alias("place"), F.lit(1).alias("side"), "t", "run")
        there = within.select("__key", "part", F.col("t").alias("place"), F.lit(0).alias("side"), F.col("t").alias("found"))
        back = W.partitionBy("__key", "part").orderBy(F.desc("place"), F.desc("side")).rowsBetween(W.unboundedPreceding, W.currentRow)
        both = asked.unionByName(there, allowMissingColumns=True).withColumn("found", F.last("found", ignorenulls=True).over(back)).where("side = 1")
        missing = both.where("found IS NULL")
        bounds = parts.select("__key", F.col("part").alias("p"), F.col("next"))
        after = asof_join(missing.drop("found", "side"), bounds, ["__key"], "part", "p", ["next"]).select("__key", "t", "run", F.col("next").alias("found"))
        links = both.where("found IS NOT NULL").select("__key", "t", "run", "found").unionByName(after.where("found IS NOT NULL"))
        own = within.select("__key", F.col("t").alias("found"), F.col("run").alias("of"))
        links = links.join(own, ["__key", "found"]).where("of = run").select("__key", "t", F.col("found").alias("to"))
        links = cut(links, "links")
        reached = cut(within.where("t = run").select("__key", "t"), "reached")
        while not links.isEmpty():
            further = reached.join(links, ["__key", "t"]).select("__key", F.col("to").alias("t"))
            reached = cut(reached.unionByName(further).distinct(), "reached")
            on = links.select("__key", F.col("t").alias("to"), F.col("to").alias("then"))
            links = cut(links.join(on, ["__key", "to"]).select("__key", "t", F.col("then").alias("to")), "links")
        starts = starts.unionByName(reached).distinct()
    begun = starts.withColumn("begins", F.lit(1))
    counted = runs.select("__key", "part", "t").join(begun, ["__key", "t"], "left")
    sums = counted.groupBy("__key", "part").agg(F.coalesce(F.sum("begins"), F.lit(0)).alias("n"))
    sums = sums.select("__key", "part", (F.sum("n").over(upto(over)) - F.col("n")).alias("earlier"))
    numbered = counted.join(sums, ["__key", "part"]).select("__key", "t", (F.col("earlier") + F.coalesce(F.sum("begins").over(upto(inside)), F.lit(0)) - 1).alias("session"))
    numbered = cut(numbered, "sessions")
    rows = df.withColumn("__key", key).withColumn("__t", F.col(instant).cast("long"))
    return rows.join(numbered.withColumnRenamed("t", "__t"), ["__key", "__t"]).select(*df.columns, "session")


def finite_differences(df: DataFrame, keys: list[str], instant: str, value: Column, at: int, step: int) -> DataFrame:
    """Totals up to an instant, their rise over one step, and the rise of the rise."""
    upto = [F.coalesce(F.sum(F.when(F.col(instant) <= at - k * step, value)), F.lit(0)) for k in range(3)]
    now, one, two = upto
    return df.groupBy(*keys).agg(now.alias("level"), (now - one).alias("velocity"), (now - 2 * one + two).alias("acceleration"))


def trailing_mean(df: DataFrame, keys: list[str], order: list[str], value: str, rows: int) -> Column:
    """The mean of up to ``rows`` rows before the current one; null if there is none."""
    return F.round(F.avg(value).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(-rows, -1)), 6)


def forward_folds(df: DataFrame, keys: list[str], fold: str, value: str) -> DataFrame:
    """For each fold: the mean of all strictly earlier folds, and the error of that mean as a prediction.

    Running sums over the folds' own totals, so that no row is read once a fold.
    """
    totals = df.groupBy(*keys, fold).agg(F.count(value).alias("n"), F.sum(value).alias("s"))
    past = W.partitionBy(*keys).orderBy(fold).rowsBetween(W.unboundedPreceding, -1)
    out = totals.withColumn("train_n", F.coalesce(F.sum("n").over(past), F.lit(0))).withColumn("train_s", F.sum("s").over(past))
    return out.select(*keys, fold, "n", "train_n", (F.col("train_s") / F.col("train_n")).alias("predicted"), (F.col("s") / F.col("n")).alias("actual"))
