"""Captures of files loaded into a point-in-time history: pinned by hash, resolved to entities, appended on change only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.temporal import latest_per_key
from tidemark.scratch import beside, cut, few
from tidemark.sources.files import verify_manifest
from tidemark.sources.formats import read_format
from tidemark.sources.store import content_digest


@dataclass
class Load:
    """What a load found: rows read, rejected (with reasons), groups held (with why), rows appended and those that were known."""

    seen: int
    rejected: DataFrame
    held: DataFrame
    appended: int
    unchanged: int


def require_pinned(spark: SparkSession, folder: str, manifest: DataFrame) -> None:
    """Refuse unless every file of the manifest (path, size, sha256) is there with its content; other files are refused too."""
    bad = verify_manifest(spark, folder, manifest).where("state <> 'ok'").take(5)
    if bad:
        raise ValueError(f"files differ from the manifest: {[(r['path'], r['state']) for r in bad]}")


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A history's rows; None where nothing has been written."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def append_changed(history: DataFrame | None, offered: DataFrame, path: str, keys: list[str], content: list[str], instant: str) -> tuple[int, int]:
    """Append the offered rows whose content differs from their key's newest; how many, and how many were known.

    A row that is older than its key's newest is appended if it differs from
    what was known at its own instant, and leaves the newest as it is.  Of equal
    offered rows one counts; of a key's offered rows at one instant the one with
    the smallest digest.  For a single writer at a time.
    """
    new = latest_per_key(offered.withColumn("digest", content_digest(content)), [*keys, instant], [F.asc("digest")])
    new = cut(new.withColumn("__new", F.lit(1)), "offered")
    every = new.unionByName(history.select(*[c for c in new.columns if c != "__new"]).withColumn("__new", F.lit(0))) if history is not None else new
    order = W.partitionBy(*keys).orderBy(instant, "__new")  # a key's versions
    marked = every.withColumn("__was", F.lag("digest").over(order)).where("__new = 1")
    marked = cut(marked.withColumn("__differs", ~F.col("digest").eqNullSafe(F.col("__was"))), "versions")
    fresh = marked.where("__differs").drop("__new", "__was", "__differs")
    count = fresh.count()
    if count:
        fresh.write.mode("append").parquet(path)
    return count, marked.count() - count


def load_capture(spark: SparkSession, folder: str, manifest: DataFrame, form: str, path: str, group: Column, external: str, crosswalk: DataFrame, content: list[str], observed_at: object) -> Load:
    """Read a capture's files in a declared format and append what changed to the history at ``path``.

    The files must be those of the manifest.  ``group`` names the set that a row
    belongs to (a slate); ``crosswalk`` (external, entity) resolves rows.  A row
    whose external id is unknown, or stands for several entities, holds its whole
    group, and so do two rows of a group for one entity: nothing of it is
    written.  The history has group, entity, the content, its digest and
    observed_at.  Loading the same capture again writes nothing.
    """
    require_pinned(spark, folder, manifest)
    rows = cut(read_format(spark, form, folder).withColumn("group", group), "capture")
    rejected, good = rows.where(F.size("_reasons") > 0), rows.where(F.size("_reasons") == 0)
    known = crosswalk.groupBy("external").agg(F.min("entity").alias("entity"), F.countDistinct("entity").alias("__entities"))
    known = cut(known, "crosswalk")
    met = good.join(few(known, known), good[external] == known["external"], "left")
    met = cut(met.withColumn("__why", F.when(F.col("entity").isNull(), F.lit("unknown id")).when(F.col("__entities") > 1, "several entities")), "resolved")
    twice = met.where("entity IS NOT NULL").groupBy("group", "entity").agg(F.count("*").alias("n")).where("n > 1").select("group", F.lit("an entity twice").alias("why"))
    held = cut(met.where("__why IS NOT NULL").select("group", F.col("__why").alias("why")).unionByName(twice).distinct(), "held")
    groups = held.select("group").distinct().withColumn("__held", F.lit(True))
    free = beside(met, few(groups, groups), ["group"], "left").where("__held IS NULL").select("group", "entity", *content)
    offered = free.withColumn("observed_at", F.lit(observed_at).cast("timestamp"))
    appended, unchanged = append_changed(stored(spark, path), offered, path, ["group", "entity"], content, "observed_at")
    return Load(rows.count(), rejected, held, appended, unchanged)
