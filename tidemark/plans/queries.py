"""Queries over the given tables, each with SQL that gives the same rows where SQL can.

Events are read as point-in-time facts: observed at their time, ingested some
hours later, some of them valid for ten days.  Instants are microseconds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import numeric, text
from tidemark.operators import fits, matching, metrics, temporal
from tidemark.scratch import cut

HOUR, DAY = 3_600_000_000, 86_400_000_000
#: 20 January 2024, UTC.
AS_OF = 1_705_708_800_000_000
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    """Microseconds since 1970 of a time without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})")


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("long")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = micros("ts")
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", at.alias("observed_at"), (at + F.col("event_id") % 7 * HOUR).alias("ingested_at"), at.alias("valid_from"),
        F.when(F.col("event_id") % 5 == 0, at + 10 * DAY).alias("valid_to"), cents("value").alias("cents"), "props",
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", cents("o_totalprice").alias("cents"), micros("o_orderdate").alias("placed"))


E = f"""e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS observed_at, epoch_us(ts) + event_id % 7 * {HOUR} AS ingested_at,
  epoch_us(ts) AS valid_from, CASE WHEN event_id % 5 = 0 THEN epoch_us(ts) + {10 * DAY} END AS valid_to,
  CAST(round(value * 100) AS BIGINT) AS cents, props FROM events)"""
O = """o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
  epoch_us(o_orderdate) AS placed FROM orders)"""  # noqa: E741
SEEN = f"observed_at <= {AS_OF} AND ingested_at <= {AS_OF} AND valid_from <= {AS_OF} AND (valid_to IS NULL OR valid_to > {AS_OF})"
NEWEST = "ORDER BY observed_at DESC, ingested_at DESC, event_id DESC"


def newest() -> list[Column]:
    return [F.desc("observed_at"), F.desc("ingested_at"), F.desc("event_id")]


@query(f"""WITH {E}, l AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type {NEWEST}) AS r FROM e WHERE {SEEN})
SELECT l.event_id, l.user_id, l.event_type, l.cents, c_mktsegment, n_name, r_name FROM l
LEFT JOIN customer ON c_custkey = user_id LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey WHERE r = 1""")
def pit_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: newest visible fact of each key with its dimensions."""
    seen = temporal.PitTable(facts(spark, sf_dir)).as_of(F.lit(AS_OF))
    last = temporal.latest_per_key(seen, ["user_id", "event_type"], newest()).select("event_id", "user_id", "event_type", "cents")
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = last.join(c, last["user_id"] == c["c_custkey"], "left").join(n, F.col("c_nationkey") == n["n_nationkey"], "left").join(r, F.col("n_regionkey") == r["r_regionkey"], "left")
    return joined.select("event_id", "user_id", "event_type", "cents", "c_mktsegment", "n_name", "r_name")


@query(f"""WITH {E}, l AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type {NEWEST}) AS r FROM e WHERE {SEEN})
SELECT user_id, count(*) AS sources, avg(cents) AS cents FROM l WHERE r = 1 GROUP BY user_id""")
def pit_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.latest_blend(facts(spark, sf_dir).where(temporal.visible(F.lit(AS_OF))), ["user_id"], "event_type", newest(), ["cents"])


@query(f"""WITH {E}, d AS (SELECT *, observed_at // {DAY} AS batch FROM e WHERE {SEEN})
SELECT event_id, event_type, batch FROM (SELECT *, max(batch) OVER (PARTITION BY event_type) AS m FROM d) WHERE batch = m""")
def pit_newest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir).where(temporal.visible(F.lit(AS_OF))).withColumn("batch", F.floor(F.col("observed_at") / DAY))
    return temporal.latest_batch(rows, ["event_type"], "batch").select("event_id", "event_type", "batch")


@query(f"""WITH {E} SELECT event_type, count(*) AS total, count(*) FILTER (WHERE {SEEN}) AS visible,
count(*) FILTER (WHERE {SEEN.replace(f'ingested_at <= {AS_OF} AND ', '')}) AS without_ingestion,
max(observed_at) FILTER (WHERE {SEEN}) AS newest, count(*) FILTER (WHERE valid_to <= {AS_OF}) AS expired FROM e GROUP BY event_type""")
def pit_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts under both forms of the predicate, and freshness."""
    seen, eval_seen = temporal.visible(F.lit(AS_OF)), temporal.visible(F.lit(AS_OF), ingested=False)
    return facts(spark, sf_dir).groupBy("event_type").agg(
        F.count("*").alias("total"), F.count_if(seen).alias("visible"), F.count_if(eval_seen).alias("without_ingestion"),
        F.max(F.when(seen, F.col("observed_at"))).alias("newest"), F.count_if(F.col("valid_to") <= AS_OF).alias("expired"),
    )


@query(f"""WITH {E}, r AS (SELECT user_id, observed_at, max(event_id) AS view_id, max_by(cents, event_id) AS view_cents FROM e WHERE event_type = 'view' GROUP BY ALL)
SELECT l.event_id, l.user_id, r.view_id, r.view_cents FROM (SELECT * FROM e WHERE event_type <> 'view') l
ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.observed_at >= r.observed_at""")
def asof_per_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the same user's newest view at or before its own instant."""
    e = facts(spark, sf_dir)
    views = e.where("event_type = 'view'").select("user_id", "observed_at", F.col("event_id").alias("view_id"), F.col("cents").alias("view_cents"))
    left = e.where("event_type <> 'view'").select("event_id", "user_id", "observed_at")
    return temporal.asof_join(left, views, ["user_id"], "observed_at", "observed_at", ["view_id", "view_cents"], ["view_id"]).drop("observed_at")


@query(f"""WITH {E}, r AS (SELECT user_id, observed_at, max(event_id) AS before_id FROM e GROUP BY ALL)
SELECT l.event_id, r.before_id FROM e l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.observed_at > r.observed_at""")
def asof_strictly_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = facts(spark, sf_dir)
    right = e.select("user_id", "observed_at", F.col("event_id").alias("before_id"))
    return temporal.asof_join(e.select("event_id", "user_id", "observed_at"), right, ["user_id"], "observed_at", "observed_at", ["before_id"], ["before_id"], strict=True).select("event_id", "before_id")


@query(f"""WITH {E}, n AS (SELECT user_id, event_type, max_by(cents, observed_at) FILTER (WHERE observed_at <= {AS_OF}) AS now,
max_by(cents, observed_at) FILTER (WHERE observed_at <= {AS_OF - 6 * HOUR}) AS was FROM (SELECT * FROM e ORDER BY event_id) GROUP BY ALL)
SELECT user_id, event_type, now, was, now - was AS moved FROM n""")
def previous_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest value at an instant and six hours before it, of the same source."""
    at = lambda t: F.max_by("cents", F.when(F.col("observed_at") <= t, F.col("observed_at")))
    out = facts(spark, sf_dir).groupBy("user_id", "event_type").agg(at(AS_OF).alias("now"), at(AS_OF - 6 * HOUR).alias("was"))
    return out.withColumn("moved", F.col("now") - F.col("was"))


@query(f"""WITH {O}, w AS (SELECT *, lag(o_orderstatus) OVER p AS was, row_number() OVER p AS n FROM o WINDOW p AS (PARTITION BY o_custkey ORDER BY placed, o_orderkey)),
c AS (SELECT * FROM w WHERE n = 1 OR o_orderstatus IS DISTINCT FROM was)
SELECT o_orderkey, o_custkey, o_orderstatus, placed, lead(placed) OVER (PARTITION BY o_custkey ORDER BY placed, o_orderkey) AS valid_to FROM c""")
def status_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of a customer's order status as half-open intervals."""
    return temporal.intervals(orders(spark, sf_dir), ["o_custkey"], ["placed", "o_orderkey"], "o_orderstatus", "placed").select("o_orderkey", "o_custkey", "o_orderstatus", "placed", "valid_to")


SESSIONS = f"""WITH RECURSIVE {E}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY observed_at, event_id) AS r FROM e),
w AS (SELECT user_id, r, event_id, event_type, observed_at, observed_at AS first, CAST(0 AS BIGINT) AS session FROM n WHERE r = 1
UNION ALL SELECT n.user_id, n.r, n.event_id, n.event_type, n.observed_at,
CASE WHEN n.observed_at - w.observed_at > {12 * HOUR} OR n.observed_at - w.first > {48 * HOUR} THEN n.observed_at ELSE w.first END,
w.session + CASE WHEN n.observed_at - w.observed_at > {12 * HOUR} OR n.observed_at - w.first > {48 * HOUR} THEN 1 ELSE 0 END
FROM w JOIN n ON n.user_id = w.user_id AND n.r = w.r + 1)"""


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir).select("event_id", "user_id", "event_type", "observed_at")
    return temporal.sessions(rows, ["user_id"], "observed_at", "event_id", 12 * HOUR, 48 * HOUR)


@query(SESSIONS + " SELECT event_id, user_id, session FROM w")
def sessions_by_gap_and_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_sessions(spark, sf_dir).select("event_id", "user_id", "session")


@query(SESSIONS + f""", s AS (SELECT user_id, session, min(observed_at) AS opened, max(observed_at) AS closed, count(*) AS items, count(DISTINCT event_type) AS kinds,
min_by(event_id, (observed_at, event_id)) AS origin FROM w GROUP BY ALL)
SELECT *, round(1 - CAST(kinds AS DOUBLE) / items, 6) AS overlap, round(items / greatest((closed - opened) / {6.0 * HOUR}, 1.0), 6) AS velocity FROM s""")
def session_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = user_sessions(spark, sf_dir).groupBy("user_id", "session").agg(
        F.min("observed_at").alias("opened"), F.max("observed_at").alias("closed"), F.count("*").alias("items"), F.countDistinct("event_type").alias("kinds"), F.min_by("event_id", F.struct("observed_at", "event_id")).alias("origin")
    )
    velocity = F.col("items") / F.greatest((F.col("closed") - F.col("opened")) / (6.0 * HOUR), F.lit(1.0))
    return s.withColumns({"overlap": F.round(1 - F.col("kinds") / F.col("items"), 6), "velocity": F.round(velocity, 6)})


@query(f"""WITH {E}, t AS (SELECT user_id, CAST(coalesce(sum(cents) FILTER (WHERE observed_at <= {AS_OF}), 0) AS BIGINT) AS a, CAST(coalesce(sum(cents) FILTER (WHERE observed_at <= {AS_OF - 6 * HOUR}), 0) AS BIGINT) AS b,
CAST(coalesce(sum(cents) FILTER (WHERE observed_at <= {AS_OF - 12 * HOUR}), 0) AS BIGINT) AS c FROM e GROUP BY user_id) SELECT user_id, a AS level, a - b AS velocity, a - 2 * b + c AS acceleration FROM t""")
def finite_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.finite_differences(facts(spark, sf_dir), ["user_id"], "observed_at", F.col("cents"), AS_OF, 6 * HOUR)


@query(f"""WITH {O} SELECT o_orderkey, round(avg(cents) OVER (PARTITION BY o_custkey ORDER BY placed, o_orderkey ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 6) AS baseline FROM o""")
def trailing_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).select("o_orderkey", temporal.trailing_mean(None, ["o_custkey"], ["placed", "o_orderkey"], "cents", 4).alias("baseline"))


@query(f"""WITH {E}, d AS (SELECT event_type, observed_at // {7 * DAY} AS week, count(*) AS n, sum(cents) AS s FROM e GROUP BY ALL)
SELECT event_type, week, n, CAST(coalesce(sum(n) OVER p, 0) AS BIGINT) AS train_n, CAST(sum(s) OVER p AS DOUBLE) / CAST(sum(n) OVER p AS DOUBLE) AS predicted, CAST(s AS DOUBLE) / n AS actual
FROM d WINDOW p AS (PARTITION BY event_type ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.forward_folds(facts(spark, sf_dir).withColumn("week", F.floor(F.col("observed_at") / (7 * DAY))), ["event_type"], "week", "cents")


BANDS = [(0, 4_999_999, "small"), (5_000_000, 19_999_999, "middle"), (15_000_000, 29_999_999, "large"), (40_000_000, 90_000_000, "huge")]
BANDS_SQL = "b(low, high, name) AS (VALUES " + ", ".join(f"({a}, {b}, '{c}')" for a, b, c in BANDS) + ")"


@query(f"""WITH {O}, {BANDS_SQL}, m AS (SELECT o_orderkey, cents, name, row_number() OVER (PARTITION BY o_orderkey ORDER BY low NULLS LAST) AS r FROM o LEFT JOIN b ON cents BETWEEN low AND high)
SELECT o_orderkey, coalesce(name, 'none') AS name FROM m WHERE r = 1""")
def price_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band join; where bands overlap the first wins, where none holds a default stands."""
    bands = spark.createDataFrame(BANDS, "low long, high long, name string")
    return matching.band_join(orders(spark, sf_dir), bands, "cents", "low", "high", 5_000_000, {"name": F.lit("none")}).select("o_orderkey", "name")


@query(f"""WITH {O}, i AS (SELECT o_custkey, o_orderkey, placed AS low, placed + (o_orderkey % 40) * {DAY} AS high FROM o),
r AS (SELECT *, max(high) OVER (PARTITION BY o_custkey ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i)
SELECT o_custkey, count(*) AS overlaps, max(reach - low) AS longest FROM r WHERE reach >= low GROUP BY o_custkey""")
def overlapping_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = orders(spark, sf_dir).select("o_custkey", "o_orderkey", F.col("placed").alias("low"), (F.col("placed") + F.col("o_orderkey") % 40 * DAY).alias("high"))
    return matching.overlapping(i, ["o_custkey"], "low", "high").groupBy("o_custkey").agg(F.count("*").alias("overlaps"), F.max(F.col("reach") - F.col("low")).alias("longest"))


@query("""SELECT coalesce(c_custkey, u) AS key, CASE WHEN c_custkey IS NULL THEN 'right_only' WHEN u IS NULL THEN 'left_only' ELSE 'both' END AS side
FROM customer FULL JOIN (SELECT DISTINCT user_id AS u FROM events) ON c_custkey = u""")
def sides_of_a_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), table(spark, sf_dir, "events").select(F.col("user_id").alias("key"))
    return matching.compare(left, right, ["key"])


@query("""WITH m AS (SELECT c_mktsegment, c_custkey, EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey) AS has FROM customer),
g AS (SELECT c_mktsegment, count(*) AS eligible, count(*) FILTER (WHERE has) AS covered, list(c_custkey ORDER BY c_custkey) FILTER (WHERE NOT has) AS m FROM m GROUP BY 1)
SELECT c_mktsegment, eligible, covered, eligible - covered AS missing,
array_to_string(m[1:5], ',') || CASE WHEN len(m) > 5 THEN ' +' || (len(m) - 5) || ' more' ELSE '' END AS first_missing FROM g""")
def coverage_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts_ = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"))
    return matching.coverage(table(spark, sf_dir, "customer"), facts_, "c_custkey", ["c_mktsegment"])


@query("""SELECT 'orders.o_custkey not null' AS "constraint", count(*) FILTER (WHERE o_custkey IS NULL) AS broken FROM orders
UNION ALL SELECT 'orders check price', count(*) FILTER (WHERE NOT (o_totalprice > 0)) FROM orders
UNION ALL SELECT 'orders unique o_orderkey', count(*) - count(DISTINCT o_orderkey) FROM orders
UNION ALL SELECT 'orders.o_custkey references c_custkey', count(*) FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.violations(table(spark, sf_dir, "orders"), "orders", ["o_custkey"], [["o_orderkey"]], {"price": F.col("o_totalprice") > 0}, {"o_custkey": (table(spark, sf_dir, "customer"), "c_custkey")})


@query("""WITH s AS (SELECT p_partkey, p_brand, p_size FROM part WHERE p_partkey % 3 > 0), n AS (SELECT p_partkey, p_brand, p_size + CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS p_size FROM part)
SELECT n.p_partkey, CASE WHEN s.p_partkey IS NULL THEN 'inserted' WHEN s.p_brand = n.p_brand AND s.p_size = n.p_size THEN 'duplicate' ELSE 'conflict' END AS outcome FROM n LEFT JOIN s USING (p_partkey)""")
def write_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert-only writes: stored are two thirds of the parts, offered all, a quarter of them changed."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    offered = part.withColumn("p_size", F.col("p_size") + F.when(F.col("p_partkey") % 4 == 0, 1).otherwise(0))
    return matching.write_outcome(part.where("p_partkey % 3 > 0"), offered, ["p_partkey"], ["p_brand", "p_size"])


@query("""WITH RECURSIVE c AS (SELECT p_partkey AS root, p_partkey AS node, 0 AS depth FROM part UNION ALL SELECT root, node // 3, depth + 1 FROM c WHERE node > 0) SELECT * FROM c""")
def ancestor_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    edges = part.where("p_partkey > 0").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 3").alias("parent"))
    return matching.closure(edges, part.select(F.col("p_partkey").alias("root")))


@query(f"""WITH {E} SELECT event_id, round(cents / CAST(nullif(sum(cents) OVER (PARTITION BY user_id, observed_at // {DAY}), 0) AS DOUBLE), 6) AS share FROM e""")
def share_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir).withColumn("day", F.floor(F.col("observed_at") / DAY))
    return rows.select("event_id", metrics.share_of_total(rows, ["user_id", "day"], "cents").alias("share"))


@query("""WITH z AS (SELECT o_orderkey, o_totalprice AS v, avg(o_totalprice) OVER w AS m, stddev_pop(o_totalprice) OVER w AS s FROM orders WINDOW w AS (PARTITION BY o_orderpriority))
SELECT o_orderkey, round(CASE WHEN s > 0 THEN greatest(least((v - m) / s, 4.0), -4.0) ELSE 0 END, 5) AS z FROM z""")
def winsorized_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return metrics.winsorized(rows, ["o_orderpriority"], "o_totalprice", "z").select("o_orderkey", F.round("z", 5).alias("z"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c)
SELECT user_id, count(*) AS kinds, round(least(-sum(p * ln(p)) / ln(5), 1.0), 6) AS entropy FROM p GROUP BY user_id""")
def entropy_of_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.entropy(table(spark, sf_dir, "events"), ["user_id"], "event_type", 5)


@query(f"""WITH {E} SELECT user_id, round(sum(cents * pow(0.5, greatest(({AS_OF} - observed_at) / {float(HOUR)}, 0.0) / 18.0)), 3) AS heat FROM e WHERE observed_at <= {AS_OF} GROUP BY user_id""")
def decayed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = (AS_OF - F.col("observed_at")) / float(HOUR)
    return facts(spark, sf_dir).where(F.col("observed_at") <= AS_OF).groupBy("user_id").agg(F.round(metrics.decayed_sum(F.col("cents"), age, 18.0), 3).alias("heat"))


@query(f"""WITH {E}, s AS (SELECT user_id, CASE WHEN event_id % 3 = 0 THEN -cents ELSE cents END AS h, event_type FROM e)
SELECT user_id, CAST(sum(h) AS BIGINT) AS signed, CAST(sum(abs(h)) AS BIGINT) AS absolute, CAST(coalesce(sum(h) FILTER (WHERE event_type = 'click'), 0) AS BIGINT) AS clicks,
round(CAST(abs(sum(h)) AS DOUBLE) / CAST(nullif(sum(abs(h)), 0) AS DOUBLE), 6) AS consensus FROM s GROUP BY user_id""")
def signed_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = facts(spark, sf_dir).withColumn("h", F.when(F.col("event_id") % 3 == 0, -F.col("cents")).otherwise(F.col("cents")))
    total, size = F.sum("h"), F.sum(F.abs("h"))
    return s.groupBy("user_id").agg(
        total.alias("signed"), size.alias("absolute"), F.coalesce(F.sum(F.when(F.col("event_type") == "click", F.col("h"))), F.lit(0)).alias("clicks"),
        F.round(numeric.ratio(F.abs(total), size), 6).alias("consensus"),
    )


@query("""WITH d AS (SELECT l_suppkey, l_discount * 100 AS p, l_tax * 100 AS a FROM lineitem)
SELECT l_suppkey, count(*) AS n, round(avg(p - a), 6) AS bias, round(avg(abs(p - a)), 6) AS mae, round(sqrt(avg((p - a) * (p - a))), 6) AS rmse,
round(avg(CASE WHEN abs(p - a) > 2 THEN CASE WHEN (p > 5) = (a > 4) THEN 1.0 ELSE 0.0 END END), 6) AS direction FROM d GROUP BY l_suppkey""")
def prediction_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, a = F.col("l_discount") * 100, F.col("l_tax") * 100
    same = F.avg(F.when(F.abs(p - a) > 2, F.when((p > 5) == (a > 4), 1.0).otherwise(0.0)))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(*metrics.errors(p, a), F.round(same, 6).alias("direction"))


@query("""WITH d AS (SELECT lang, quality = 1 AS y, n_chars > 1500 AS p, least(n_chars / 4000.0, 1.0) AS q FROM documents JOIN labels USING (doc_id)),
c AS (SELECT lang, count(*) FILTER (WHERE p AND y) AS tp, count(*) FILTER (WHERE p AND NOT y) AS fp, count(*) FILTER (WHERE NOT p AND y) AS fn, count(*) FILTER (WHERE NOT p AND NOT y) AS tn,
round(avg((q - y::INT) * (q - y::INT)), 6) AS brier FROM d GROUP BY lang)
SELECT *, round(CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END, 6) AS recall,
round(CASE WHEN 2 * tp + fp + fn = 0 THEN 1.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM c""")
def label_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length as a predictor of the quality label."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    y, q = F.col("quality") == 1, F.least(F.col("n_chars") / 4000.0, F.lit(1.0))
    return d.groupBy("lang").agg(*metrics.classification(F.col("n_chars") > 1500, y), metrics.probability_scores(q, y.cast("double"))[0])


@query("""WITH r AS (SELECT l_suppkey, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2 AS x,
rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_suppkey, l_extendedprice) - 1) / 2 AS y FROM lineitem)
SELECT l_suppkey, count(*) AS n, round(corr(x, y), 6) AS spearman FROM r GROUP BY l_suppkey""")
def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.spearman(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")


@query("""WITH v AS (SELECT event_type, least(CAST(floor(least(value / 40.0, 1.0) * 10) AS INT), 9) AS bin FROM events), g AS (SELECT DISTINCT event_type, unnest(range(10))::INT AS bin FROM events),
n AS (SELECT g.event_type, g.bin, count(v.bin) AS n FROM g LEFT JOIN v USING (event_type, bin) GROUP BY ALL)
SELECT *, round((n - sum(n) OVER w / 10) * (n - sum(n) OVER w / 10) / (sum(n) OVER w / 10), 6) AS chi2 FROM n WINDOW w AS (PARTITION BY event_type)""")
def pit_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pit_histogram(table(spark, sf_dir, "events"), ["event_type"], F.least(F.col("value") / 40.0, F.lit(1.0)), 10)


@query(f"""WITH {E} SELECT event_type, round(quantile_cont(cents, 0.1), 6) AS p10, round(quantile_cont(cents, 0.5), 6) AS p50, round(quantile_cont(cents, 0.9), 6) AS p90,
CAST(quantile_disc(cents, 0.1) AS DOUBLE) AS lower_10, CAST(quantile_disc(cents, 0.5) AS DOUBLE) AS lower_50, CAST(quantile_disc(cents, 0.9) AS DOUBLE) AS lower_90 FROM e GROUP BY event_type""")
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = facts(spark, sf_dir).select("event_type", F.col("cents").cast("double").alias("cents"))
    found = metrics.quantiles(e, ["event_type"], "cents", [0.1, 0.5, 0.9])
    return found.select("event_type", *(F.round(c, 6).alias(c) if c.startswith("p") else c for c in found.columns[1:]))


@query("SELECT o_orderstatus, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY o_orderstatus")
def status_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.frequencies(table(spark, sf_dir, "orders"), "o_orderstatus")


@query(f"""WITH {E}, d AS (SELECT user_id, event_type, CAST(sum(cents) AS DOUBLE) AS s FROM e GROUP BY ALL)
SELECT a.event_type AS x, b.event_type AS y, count(*) AS n, round(coalesce(corr(a.s, b.s), 0), 6) AS correlation FROM d a JOIN d b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY ALL""")
def type_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = facts(spark, sf_dir).groupBy("user_id", "event_type").agg(F.sum("cents").cast("double").alias("s"))
    b = d.select("user_id", F.col("event_type").alias("y"), F.col("s").alias("t"))
    met = d.withColumnRenamed("event_type", "x").join(b, "user_id").where("x < y")
    return met.groupBy("x", "y").agg(F.count("*").alias("n"), F.round(F.coalesce(F.corr("s", "t"), F.lit(0.0)), 6).alias("correlation"))


@query(f"""WITH {O}, r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY cents DESC, o_orderkey) AS rank FROM o) SELECT o_orderpriority, o_orderkey, cents, rank FROM r WHERE rank <= 20""")
def top_twenty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top_per_group(orders(spark, sf_dir), ["o_orderpriority"], [F.desc("cents"), F.asc("o_orderkey")], 20).select("o_orderpriority", "o_orderkey", "cents", "rank")


@query("""WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY sha256('v1:' || event_type || ':' || event_id), event_id) AS turn FROM events)
SELECT * FROM r ORDER BY turn, event_type LIMIT 200""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: 200 events, types in turn."""
    return metrics.stratified_sample(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id", "v1", 200)


PRIZES = [(1, 1, 1000.0), (2, 3, 400.0), (4, 10, 90.0)]
PRIZES_SQL = "p AS (SELECT unnest(range(a, b + 1)) AS place, v FROM (VALUES " + ", ".join(f"({a}, {b}, {v})" for a, b, v in PRIZES) + ") t(a, b, v))"


@query(f"""WITH {E}, s AS (SELECT event_id, event_type, observed_at // {DAY} AS day, cents // 500 AS score FROM e), {PRIZES_SQL},
r AS (SELECT *, rank() OVER (PARTITION BY event_type, day ORDER BY score DESC) AS rank, row_number() OVER (PARTITION BY event_type, day ORDER BY score DESC, event_id) AS place,
count(*) OVER (PARTITION BY event_type, day, score) AS tied FROM s)
SELECT event_id, r.rank, tied, round(sum(coalesce(v, 0)) OVER (PARTITION BY event_type, day, score) / tied, 6) AS won FROM r LEFT JOIN p USING (place)""")
def contest_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day and type is a draw; entries that tie share the prizes of their places."""
    s = facts(spark, sf_dir).select("event_id", "event_type", F.floor(F.col("observed_at") / DAY).alias("day"), F.floor(F.col("cents") / 500).alias("score"))
    prizes = spark.createDataFrame(PRIZES, "rank_from int, rank_to int, prize double")
    return metrics.settle(s, ["event_type", "day"], "score", prizes).select("event_id", "rank", "tied", "won")


@query("""WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM conversations),
p AS (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS v FROM t),
j AS (SELECT conv_id, turn, CASE WHEN v IS NULL THEN NULL WHEN len(w) = 0 OR len(v) = 0 THEN 0.0 ELSE len(list_intersect(w, v)) / len(list_distinct(list_concat(w, v))) END AS j FROM p)
SELECT conv_id, turn, round(j, 6) AS similarity, CASE WHEN j >= 0.8 THEN 'derivative' WHEN j >= 0.35 THEN 'linked' WHEN j IS NULL THEN 'origin' ELSE 'independent' END AS relation FROM j""")
def turn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-set Jaccard of each turn with the one before it."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.token_set(F.col("text")).alias("w"))
    j = t.withColumn("v", F.lag("w").over(W.partitionBy("conv_id").orderBy("turn"))).withColumn("j", F.when(F.col("v").isNotNull(), text.jaccard(F.col("w"), F.col("v"))))
    relation = F.when(F.col("j") >= 0.8, "derivative").when(F.col("j") >= 0.35, "linked").when(F.col("j").isNull(), "origin").otherwise("independent")
    return j.select("conv_id", "turn", F.round("j", 6).alias("similarity"), relation.alias("relation"))


@query("""WITH d AS (SELECT doc_id, source, sha256(regexp_replace(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '[\\x20\\t\\n\\r]+', ' ', 'g')) AS content FROM documents)
SELECT source, content, min(doc_id) AS doc_id, count(*) AS copies FROM d GROUP BY source, content""")
def content_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First document of each content in each source."""
    content = F.sha2(F.regexp_replace(F.trim(F.col("text"), F.lit(" \t\n\r")), r"[\x20\t\n\r]+", " "), 256)
    return table(spark, sf_dir, "documents").groupBy("source", content.alias("content")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


PATTERNS = [r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r"[Tt]oken", r"http", r"\bthe\b"]


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN {i}" for i, p in enumerate(PATTERNS)) + " END AS pattern, instr(lower(text), 'license') > 0 AS has_word FROM documents")
def pattern_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of a bank of patterns, and a search that ignores case."""
    return table(spark, sf_dir, "documents").select("doc_id", text.first_pattern(F.col("text"), PATTERNS).alias("pattern"), (F.instr(F.lower("text"), "license") > 0).alias("has_word"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, sha256(user_id || '|' || event_type || '|' || event_id) AS stable_id, round_even(value, 0) AS rounded,
epoch_us(date_trunc('hour', ts)) AS hour, (epoch_us(ts) - 7200000000) // 21600000000 * 21600000000 AS cycle, round(ln((value + 1) / 100 / (1 - (value + 1) / 100)), 6) AS odds
FROM (SELECT event_id, props, user_id, event_type, ts, least(value, 98.0) AS value FROM events)""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values from JSON, stable ids, half-even rounding, floors of time, logits."""
    e = table(spark, sf_dir, "events").withColumn("value", F.least("value", F.lit(98.0)))
    at = micros("ts")
    return e.select(
        "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.col("event_id").cast("string")), 256).alias("stable_id"),
        text.half_even(F.col("value")).alias("rounded"), (at - F.pmod(at, F.lit(HOUR))).alias("hour"), ((at - 2 * HOUR) - F.pmod(at - 2 * HOUR, F.lit(6 * HOUR))).alias("cycle"),
        F.round(numeric.logit((F.col("value") + 1) / 100), 6).alias("odds"),
    )


@query(f"""WITH {E}, f AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS bad FROM e GROUP BY user_id),
p AS (SELECT *, 0.75 * tanh((n - bad * 3) / 40.0 / 0.75) AS response FROM f)
SELECT user_id, round(response, 6) AS response, round(greatest(least(response, 0.3), -0.3), 6) AS capped, round((n - bad) / CAST(nullif(bad, 0) AS DOUBLE) - 1, 6) AS roi FROM p""")
def bounded_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"))
    response = numeric.bounded((F.col("n") - F.col("bad") * 3) / 40.0)[0]
    return f.select("user_id", F.round(response, 6).alias("response"), F.round(F.greatest(F.least(response, F.lit(0.3)), F.lit(-0.3)), 6).alias("capped"), F.round(numeric.ratio(F.col("n") - F.col("bad"), F.col("bad")) - 1, 6).alias("roi"))


@query("""WITH c AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0), o AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'), e AS (SELECT user_id AS k FROM events),
u AS (SELECT k FROM c UNION SELECT k FROM o), m AS (SELECT k FROM u EXCEPT SELECT k FROM e), i AS (SELECT k FROM c INTERSECT SELECT k FROM o)
SELECT 'union' AS operation, k FROM u UNION ALL SELECT 'minus', k FROM m UNION ALL SELECT 'both', k FROM i""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("k"))
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"))
    u = c.union(o).distinct()
    named = lambda n, df: df.select(F.lit(n).alias("operation"), "k")
    return named("union", u).unionByName(named("minus", u.subtract(e))).unionByName(named("both", c.intersect(o)))


@query("""WITH s AS (SELECT source, count(*) AS items, count(DISTINCT lang) AS langs FROM documents GROUP BY source), l AS (SELECT source, count(*) AS labelled, CAST(sum(toxic) AS BIGINT) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT source, items, langs, coalesce(labelled, 0) AS labelled, coalesce(toxic, 0) AS toxic, items - coalesce(labelled, 0) AS waiting, coalesce(labelled, 0) >= 3 AS enough FROM s LEFT JOIN l USING (source)""")
def source_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yield and backlog of each source."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    s = d.groupBy("source").agg(F.count("*").alias("items"), F.countDistinct("lang").alias("langs"))
    n = d.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("labelled"), F.sum("toxic").alias("toxic"))
    out = s.join(n, "source", "left").na.fill(0, ["labelled", "toxic"])
    return out.withColumns({"waiting": F.col("items") - F.col("labelled"), "enough": F.col("labelled") >= 3})


@query(f"""WITH {O}, w AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total, CAST(sum(CASE WHEN o_orderpriority LIKE '1%' THEN cents * 3 ELSE cents END) AS BIGINT) AS weighted,
min(cents) FILTER (WHERE cents > 10000000) AS least, max_by(o_orderkey, (placed, o_orderkey)) AS last_key, min_by(o_orderkey, (placed, o_orderkey)) AS first_key FROM o GROUP BY ALL)
SELECT *, CASE WHEN n >= 30 THEN round(total / CAST(n AS DOUBLE), 4) END AS mean FROM w""")
def cell_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional sums, first and last by order, means withheld where rows are few."""
    order = F.struct("placed", "o_orderkey")
    w = orders(spark, sf_dir).groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count("*").alias("n"), F.sum("cents").alias("total"), F.sum(F.when(F.col("o_orderpriority").startswith("1"), F.col("cents") * 3).otherwise(F.col("cents"))).alias("weighted"),
        F.min(F.when(F.col("cents") > 10_000_000, F.col("cents"))).alias("least"), F.max_by("o_orderkey", order).alias("last_key"), F.min_by("o_orderkey", order).alias("first_key"),
    )
    return w.withColumn("mean", F.when(F.col("n") >= 30, F.round(F.col("total") / F.col("n").cast("double"), 4)))


@query("""WITH f AS (SELECT l_orderkey, list(DISTINCT l_partkey ORDER BY l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, len(parts) AS n_parts, array_to_string(parts[1:5], ',') AS listed, greatest(len(parts) - 5, 0) AS more, suppliers FROM f""")
def nested_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))
    size = F.size("parts").cast("long")
    return f.select("l_orderkey", size.alias("n_parts"), F.concat_ws(",", F.transform(F.slice("parts", 1, 5), lambda x: x.cast("string"))).alias("listed"), F.greatest(size - 5, F.lit(0)).alias("more"), "suppliers")


@query("""WITH f AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), p AS (SELECT a.l_orderkey AS x, b.l_orderkey AS y, count(*) AS shared FROM f a JOIN f b ON a.l_partkey = b.l_partkey AND a.l_orderkey < b.l_orderkey GROUP BY ALL)
SELECT * FROM p WHERE shared >= 2""")
def order_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of orders that share two parts at least."""
    return matching.overlapping_sets(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", 2)


@query("""WITH f AS (SELECT c.c_custkey, c.c_acctbal, e.n FROM customer c LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) e ON e.user_id = c.c_custkey)
SELECT c_custkey, CASE WHEN n IS NULL THEN 'ungradable' WHEN c_acctbal < 0 THEN 'indeterminate' WHEN n >= 60 THEN 'correct' ELSE 'incorrect' END AS verdict,
CASE WHEN n IS NULL THEN 'no facts' WHEN c_acctbal < 0 THEN 'negative balance' ELSE 'counted' END AS reason FROM f""")
def graded_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts with reasons, the first rule that holds."""
    n = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("n"))
    c = table(spark, sf_dir, "customer").join(n, "c_custkey", "left")
    verdict = F.when(F.col("n").isNull(), "ungradable").when(F.col("c_acctbal") < 0, "indeterminate").when(F.col("n") >= 60, "correct").otherwise("incorrect")
    reason = F.when(F.col("n").isNull(), "no facts").when(F.col("c_acctbal") < 0, "negative balance").otherwise("counted")
    return c.select("c_custkey", verdict.alias("verdict"), reason.alias("reason"))


@query()
def visible_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.visible_text("html").alias("text"))


@query("""SELECT p_partkey, concat_ws(' ', p_name, CASE WHEN p_size % 3 <> 0 THEN p_type END, CASE WHEN p_size % 5 <> 0 THEN p_brand END, 'end') AS text FROM part""")
def built_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of pages built from parts: items without end tags, some of them hidden, and a hidden block with an open one in it."""
    hide = lambda n, how: F.when(F.col("p_size") % n == 0, how).otherwise("")
    page = F.concat(F.lit("<ul><li>"), "p_name", F.lit("<li "), hide(3, "hidden"), F.lit(">"), "p_type", F.lit("</ul><div hidden><p>gone</div><table><tr><td "), hide(5, "style='display:none'"), F.lit(">"), "p_brand", F.lit("</table>end"))
    return table(spark, sf_dir, "part").select("p_partkey", text.visible_text(page).alias("text"))


@query()
def matched_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names, misspelt, matched to the brands' parts in stages."""
    part = table(spark, sf_dir, "part")
    pool = part.groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("entity_id")).select("entity_id", F.concat(F.lit("x"), F.col("entity_id").cast("string")).alias("external_id"), text.normal_name(F.col("p_name")).alias("name"), F.col("p_brand").alias("scope"))
    wrong = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_name"), F.lit(" Jr."))).when(F.col("p_partkey") % 3 == 1, F.regexp_replace("p_name", "e", "")).otherwise(F.col("p_name"))
    inputs = part.select(F.col("p_partkey").alias("input_id"), F.lit(None).cast("string").alias("external_id"), text.normal_name(wrong).alias("name"), F.col("p_brand").alias("scope"))
    return matching.staged_match(inputs, pool, "scope")


@query()
def beta_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior mean and 90 % interval of each user's part of errors."""
    g = table(spark, sf_dir, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") == "error") + 1.0).alias("a"), (F.count_if(F.col("event_type") != "error") + 1.0).alias("b"))
    q = lambda p: F.round(metrics.beta_quantile(F.lit(p), F.col("a"), F.col("b")), 6)
    return g.select("user_id", (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"), q(0.05).alias("low"), q(0.95).alias("high"))


@query("""WITH RECURSIVE d AS (SELECT lang, ln(q / (1 - q)) AS x, quality AS y FROM (SELECT lang, quality, greatest(least(n_chars / 8000.0, 0.99), 1e-6)::DOUBLE AS q FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL)),
n AS (SELECT DISTINCT lang, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b, 1.0::DOUBLE AS moved, 0 AS i FROM d UNION ALL
SELECT lang, a + da / greatest(1.0, abs(da), abs(db)), b + db / greatest(1.0, abs(da), abs(db)), greatest(abs(da), abs(db)), i + 1 FROM (
SELECT lang, a, b, i, (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1 + 1e-12) AS da, (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1 + 1e-12) AS db FROM (
SELECT lang, a, b, i, sum(y - m) AS g0, sum((y - m) * x) AS g1, sum(m * (1 - m)) AS h0, sum(m * (1 - m) * x) AS h1, sum(m * (1 - m) * x * x) AS h2
FROM (SELECT n.lang, a, b, i, x, y, 1 / (1 + exp(-(a + b * x))) AS m FROM n JOIN d ON n.lang IS NOT DISTINCT FROM d.lang WHERE i < 25) GROUP BY lang, a, b, i)))
SELECT lang, round(a, 5) AS intercept, round(b, 5) AS slope, moved < 1e-9 AS settled FROM n WHERE i = 25""")
def calibration_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return metrics.calibration_line(d.withColumn("p", F.least(F.col("n_chars") / 8000.0, F.lit(0.99))), ["lang"], "p", "quality")


@query(f"""WITH RECURSIVE {E}, d AS (SELECT observed_at // {DAY} AS day, greatest(least(cents / 10000.0, 0.95), 0.01)::DOUBLE AS p FROM e),
t AS (SELECT day, count(*) / 10 AS t FROM d GROUP BY day), x AS (SELECT day, ln(p / (1 - p)) AS x FROM d),
b AS (SELECT day, -5.0::DOUBLE AS low, 5.0::DOUBLE AS high, 0 AS i FROM t UNION ALL
SELECT day, CASE WHEN s < t THEN mid ELSE low END, CASE WHEN s < t THEN high ELSE mid END, i + 1 FROM (
SELECT b.day, low, high, i, t, (low + high) / 2 AS mid, sum(1 / (1 + exp(-(x + (low + high) / 2)))) AS s FROM b JOIN x ON x.day IS NOT DISTINCT FROM b.day JOIN t ON t.day IS NOT DISTINCT FROM b.day WHERE i < 45 GROUP BY ALL))
SELECT day, round((low + high) / 2, 6) AS shift, true AS settled FROM b WHERE i = 45""")
def shifted_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shift of logits per day so that the day's probabilities add up to a tenth of its events."""
    e = facts(spark, sf_dir).withColumns({"day": F.floor(F.col("observed_at") / DAY), "p": F.greatest(F.least(F.col("cents") / 10000.0, F.lit(0.95)), F.lit(0.01))})
    n = e.groupBy("day").agg((F.count("*") / 10).alias("target"))
    found = fits.shift_to_total(e.join(n, "day"), ["day"], "p", F.col("target"))
    return found.withColumn("shift", F.round("shift", 6))


#: Fixed places and flexibility of each event type, and a day's free places.
PLACES, FREE = [("click", 3.0, True), ("view", 1.0, True), ("purchase", 2.0, False), ("error", 0.0, True)], 4
PLACES_SQL = "places AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {n}::DOUBLE, {f})" for k, n, f in PLACES) + ") v(event_type, places, flexible))"
TOTALS_SQL = f"""{E}, d AS (SELECT event_id, user_id % 40 AS slate, event_type, least(greatest(cents / 20000.0, 0.0), 1.0)::DOUBLE AS p FROM e), {PLACES_SQL},
k AS (SELECT slate, event_type, count(*) AS n, sum(p) AS mass FROM d GROUP BY ALL),
w AS (SELECT k.*, coalesce(places, 0) AS places, coalesce(flexible, false) AS flexible, greatest(mass, 1e-9) AS weight,
CASE WHEN coalesce(flexible, false) THEN greatest(n - places, 0) ELSE 0 END AS room FROM k LEFT JOIN places USING (event_type)),
l AS (SELECT *, ({FREE} - coalesce(sum(room) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
FROM w WINDOW o AS (PARTITION BY slate ORDER BY room / weight, event_type)),
s AS (SELECT *, CASE WHEN room <= level * weight THEN room ELSE greatest(coalesce(max(CASE WHEN room > level * weight THEN level END) OVER (PARTITION BY slate), 0), 0) * weight END AS share FROM l)"""


@query(f"WITH {TOTALS_SQL} SELECT slate, event_type, round(share, 6) AS share FROM s")
def allocated_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free places of slates of users, shared by the event types that may take them, up to what these can hold."""
    d = _slates(spark, sf_dir).groupBy("slate", "event_type").agg(F.count("*").alias("n"), F.sum("p").alias("mass"))
    slots = spark.createDataFrame(PLACES, "event_type string, places double, flexible boolean")
    rows = d.join(F.broadcast(slots), "event_type", "left").na.fill({"places": 0.0, "flexible": False})  # four rows
    room = F.when(F.col("flexible"), F.greatest(F.col("n") - F.col("places"), F.lit(0.0))).otherwise(0.0)
    shared = fits.allocate(rows.withColumn("room", room), ["slate"], "mass", "room", F.lit(float(FREE)), "event_type")
    return shared.select("slate", "event_type", F.round("share", 6).alias("share"))


def _slates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the probability that they are chosen, in slates by user."""
    p = F.least(F.greatest(F.col("cents") / 20000.0, F.lit(0.0)), F.lit(1.0))
    return facts(spark, sf_dir).select("event_id", F.pmod("user_id", F.lit(40)).alias("slate"), "event_type", p.alias("p"))


@query(f"""WITH RECURSIVE {TOTALS_SQL}, t AS (SELECT slate, event_type, n, least(places + share, n) AS total, places + share <= n + 1e-12 AS met FROM s),
x AS (SELECT event_id, d.slate, d.event_type, ln(q / (1 - q)) AS x FROM (SELECT *, least(greatest(p, 1e-12), 1 - 1e-12) AS q FROM d) d),
b AS (SELECT slate, event_type, -50.0::DOUBLE AS low, 50.0::DOUBLE AS high, 0 AS i FROM t UNION ALL
SELECT slate, event_type, CASE WHEN s < total THEN mid ELSE low END, CASE WHEN s < total THEN high ELSE mid END, i + 1 FROM (
SELECT slate, event_type, low, high, i, total, (low + high) / 2 AS mid, sum(1 / (1 + exp(-(x + (low + high) / 2)))) AS s FROM b JOIN x USING (slate, event_type) JOIN t USING (slate, event_type) WHERE i < 60 GROUP BY ALL)),
f AS (SELECT slate, event_type, met, CASE WHEN total <= 0 THEN -50 WHEN total >= n THEN 50 ELSE (low + high) / 2 END AS shift FROM b JOIN t USING (slate, event_type) WHERE i = 60)
SELECT event_id, round(1 / (1 + exp(-(x + shift))), 6) AS calibrated, met FROM x JOIN f USING (slate, event_type)""")
def calibrated_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities shifted by slate and type so that a slate's add up to its places."""
    slots = spark.createDataFrame(PLACES, "event_type string, places double, flexible boolean")
    found = fits.calibrated_totals(_slates(spark, sf_dir), ["slate"], "event_type", "p", slots, F.lit(FREE), "event_id")
    return found.select("event_id", F.round("calibrated", 6).alias("calibrated"), "met")


@query("""WITH f AS (SELECT event_type, avg(value) AS m, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi, count(*) AS n FROM events WHERE value > 0 GROUP BY event_type),
t AS (SELECT event_type, count(*) AS every FROM events GROUP BY event_type), z AS (SELECT *, 1.2815515655446004 AS z FROM f JOIN t USING (event_type)),
s AS (SELECT *, ln(hi / lo) / (2 * z) AS shape FROM z), d AS (SELECT *, m * exp(-shape * shape / 2) AS scale, n / (every + 1) AS active FROM s)
SELECT event_id, round(CASE WHEN value = 0 THEN -ln(1 - active) WHEN value > 0 THEN -(ln(active) - ln(value * shape * sqrt(2 * pi())) - pow(ln(value / scale) / shape, 2) / 2) ELSE 'inf'::DOUBLE END, 5) AS log_score,
round(greatest(abs(scale * exp(-shape * z) / lo - 1), abs(scale * exp(shape * z) / hi - 1)), 6) AS off FROM events JOIN d USING (event_type)""")
def density_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log score of each event's value under its type's log-normal, and how far that is off its quantiles."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    d = _fitted(e)
    score = numeric.mixture_log_score(F.col("value"), *(F.col(c) for c in ("active", "scale", "shape")))
    return e.join(d, "event_type").select("event_id", F.round(score, 5).alias("log_score"), F.round("off", 6).alias("off"))


def _fitted(e: DataFrame) -> DataFrame:
    """A log-normal for each event type from its mean and quantiles; a row a type.

    Means are of values to twelve places, whose sum is exact: one of doubles depends on the order of rows.  Where values are too large for that it is one of doubles.
    """
    above = e.where("value > 0")
    ends = metrics.quantiles(above, ["event_type"], "value", [0.1, 0.9]).select("event_type", F.col("p10").alias("lo"), F.col("p90").alias("hi"))
    mean = F.when(F.max("value") < 1e15, F.sum(F.col("value").try_cast("decimal(28,12)")).cast("double") / F.count("*")).otherwise(F.avg("value"))
    fit = above.groupBy("event_type").agg(mean.alias("m"), F.count("*").alias("n")).join(ends, "event_type")
    total = e.groupBy("event_type").agg(F.count("*").alias("all"))
    scale, shape, off = numeric.lognormal(F.col("m"), F.col("lo"), F.col("hi"))
    return fit.join(total, "event_type").select("event_type", scale.alias("scale"), shape.alias("shape"), off.alias("off"), (F.col("n") / (F.col("all") + 1)).alias("active"))


@query("""WITH f AS (SELECT event_type, CASE WHEN max(value) < 1e15 THEN sum(TRY_CAST(value AS DECIMAL(28, 12)))::DOUBLE / count(*) ELSE avg(value) END AS m, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi, count(*) AS n FROM events WHERE value > 0 GROUP BY event_type),
t AS (SELECT event_type, count(*) AS every FROM events GROUP BY event_type), s AS (SELECT *, ln(hi / lo) / (2 * 1.2815515655446004) AS shape FROM f JOIN t USING (event_type)),
d AS (SELECT *, m * exp(-shape * shape / 2) AS scale, n / (every + 1) AS active FROM s)
SELECT event_id, round(CASE WHEN value > 0 THEN -ln(value * shape * sqrt(2 * pi())) - pow(ln(value / scale) / shape, 2) / 2 ELSE '-inf'::DOUBLE END, 5) AS log_density,
round(active * scale * exp(shape * shape / 2), 5) AS mean, round(scale * exp(shape * shape / 2), 5) AS active_mean, value <= 0 AS nothing_below FROM events JOIN d USING (event_type)""")
def density_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The density of each event's value under its type's log-normal, and the means of this and of the mixture."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    a, m, s = (F.col(c) for c in ("active", "scale", "shape"))
    return e.join(_fitted(e), "event_type").select(
        "event_id", F.round(numeric.active_log_density(F.col("value"), m, s), 5).alias("log_density"), F.round(numeric.mixture_mean(a, m, s), 5).alias("mean"),
        F.round(numeric.mixture_mean(F.lit(1.0), m, s), 5).alias("active_mean"), (numeric.mixture_left_cdf(F.col("value"), a, m, s) == 0).alias("nothing_below"),
    )


@query()
def distribution_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log-normal for each event type from its mean and quantiles, and scores of each event's value under it."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    d = _fitted(e)
    args = [F.col(c) for c in ("active", "scale", "shape")]
    return e.join(d, "event_type").select("event_id", F.round(numeric.mixture_cdf(F.col("value"), *args), 6).alias("cdf"), F.round(numeric.mixture_crps(F.col("value"), *args), 6).alias("crps"), F.round(numeric.mixture_log_score(F.col("value"), *args), 6).alias("log_score"), F.round("off", 6).alias("off"))


@query()
def simulated_contest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty seeded draws of every customer's outcome, correlated within nation and segment, settled per draw; return and chance of a prize."""
    from tidemark.operators.simulation import factor_draws, lognormal_outcomes

    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.greatest(F.col("c_acctbal"), F.lit(1.0)).alias("scale"))
    z = factor_draws(c, 20, 7, {"c_nationkey": 0.3, "c_mktsegment": 0.2}, "c_custkey")
    scores = lognormal_outcomes(z, F.lit(0.9), F.col("scale"), F.lit(0.5)).withColumn("score", F.round("value", 2))
    won = metrics.settle(scores, ["draw"], "score", spark.createDataFrame(PRIZES, "rank_from int, rank_to int, prize double"))
    return won.groupBy("c_custkey").agg(F.round(F.avg("won"), 6).alias("expected"), F.round(F.avg((F.col("won") > 0).cast("double")), 6).alias("cash_rate"), F.round(F.avg("won") / 25.0 - 1, 6).alias("roi"))


#: Effect of the hour's distance from noon, which may not be negative, and of even users, on the rate of large values.
OFFSETS = fits.Offset(("noon", "even"), ("every",), ("noon",), {"noon": 1.0, "even": 1.0, "every": 0.5}, amplitude=1.5)


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    noon = F.abs(F.pmod(F.col("observed_at"), F.lit(DAY)) / DAY - 0.5)
    return facts(spark, sf_dir).withColumns({"noon": noon, "even": (F.col("user_id") % 2).cast("double"), "every": F.lit(1.0), "large": (F.col("cents") > 1500).cast("int"), "one": F.lit(1), "base": F.lit(0.3)})


@query()
def fitted_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event type the most likely effects beside a base rate, with dispersion and covariance."""
    return fits.offset_fit(_trials(spark, sf_dir), ["event_type"], "base", OFFSETS, "large", "one")


@query()
def predicted_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of each event's rate over the posterior of its type's effects."""
    e = _trials(spark, sf_dir)
    fitted = cut(fits.offset_fit(e, ["event_type"], "base", OFFSETS, "large", "one"), "fitted")
    return fits.predict(e.select("event_id", "event_type", "base", *OFFSETS.features), fitted, ["event_type"], "base", OFFSETS).drop("base", *OFFSETS.features)
