"""Writers: append-only facts with conflicts told apart, canonical JSON with digests, retention."""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.matching import write_outcome
from tidemark.scratch import cut


def append_new(stored: DataFrame | None, offered: DataFrame, path: str, keys: list[str], content: list[str]) -> dict[str, int]:
    """Append the offered rows whose key is new; counts of inserted, duplicate and conflict.  For a single writer at a time.

    Any conflict refuses the whole write.  Existing rows are never changed.
    """
    spark = offered.sparkSession
    stored = stored if stored is not None else spark.createDataFrame([], offered.schema)
    outcome = cut(write_outcome(stored, offered.dropDuplicates([*keys, *content]), keys, content), "outcome")
    counts = {r["outcome"]: r["count"] for r in outcome.groupBy("outcome").count().collect()}
    twice = outcome.groupBy(*keys).count().where("count > 1")
    if counts.get("conflict") or not twice.isEmpty():
        raise ValueError(f"the same key with other content: {counts}")
    new = offered.dropDuplicates(keys).join(outcome.where("outcome = 'inserted'").select(*keys), keys, "left_semi")
    new.write.mode("append").parquet(path)
    return {k: counts.get(k, 0) for k in ("inserted", "duplicate", "conflict")}


def canonical_json(value: object) -> bytes:
    """Compact JSON with sorted keys; instants as UTC with microseconds, naive ones refused."""

    def plain(x: object) -> object:
        if isinstance(x, datetime):
            if x.tzinfo is None:
                raise ValueError("an instant without a zone")
            return x.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
        raise TypeError(type(x).__name__)

    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False, default=plain).encode()


def sha256_json(value: object) -> str:
    return hashlib.sha256(canonical_json(value)).hexdigest()


def frozen_digest(df: DataFrame) -> str:
    """A digest of all rows whatever their order: counts and sums of row hashes, made where the rows are."""
    row = F.sha2(F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")
    sums = df.select(row.alias("h")).agg(F.count("*").alias("n"), *(F.coalesce(F.sum(part(i)), F.lit(0)).alias(f"s{i}") for i in range(4))).first()
    return hashlib.sha256(":".join(str(x) for x in sums).encode()).hexdigest()


def purge(items: DataFrame, policies: DataFrame, as_of: object) -> tuple[DataFrame, DataFrame]:
    """Items with content emptied where the strictest of their own and their source's retention has passed, and the tombstones."""
    days = F.least(F.col("retention_days"), F.coalesce("policy_days", "retention_days"))
    marked = items.join(policies.select("source_id", F.col("retention_days").alias("policy_days")), "source_id", "left")
    gone = F.date_add(F.to_date("captured_at"), days.cast("int")) <= F.to_date(F.lit(as_of))
    marked = marked.withColumn("expired", F.coalesce(gone, F.lit(False)))
    kept = marked.withColumn("content", F.when(~F.col("expired"), F.col("content"))).drop("expired", "policy_days")
    stones = marked.where("expired").select("item_id", "source_id", F.sha2("content", 256).alias("content_sha256"), F.lit("retention").alias("reason"))
    return kept, stones
