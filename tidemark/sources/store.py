"""Parameters stored by their content: equal ones once, read back by their digest, refused if the content is another."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.scratch import cut


def content_digest(columns: list[str]) -> Column:
    """The digest of the values of the columns, by name; numbers with all their digits, nulls told apart."""
    return F.sha2(F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in sorted(columns))), {"ignoreNullFields": "false"}), 256)


def put(df: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """The rows with ``digest``, that of their content; contents that the store hasn't are written.  For a single writer at a time."""
    spark, marked = df.sparkSession, cut(df.withColumn("digest", content_digest(columns)), "marked")
    new = marked.select("digest", *columns).dropDuplicates(["digest"])
    try:
        new = new.join(spark.read.parquet(path).select("digest"), "digest", "left_anti")
    except AnalysisException:  # nothing is stored yet
        pass
    cut(new, "new").write.mode("append").parquet(path)
    return marked


def get(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The stored contents of the wanted digests (column digest); refuses if one is missing, or isn't what its digest says."""
    stored = spark.read.parquet(path)
    columns = [c for c in stored.columns if c != "digest"]
    held = cut(wanted.select("digest").distinct().join(stored.withColumn("__now", content_digest(columns)), "digest", "left"), "held")
    bad = held.where(F.col("__now").isNull() | (F.col("__now") != F.col("digest"))).take(3)
    if bad:
        raise ValueError(f"missing or changed: {[r['digest'] for r in bad]}")
    return held.drop("__now")
