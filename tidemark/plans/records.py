"""Queries over records and decisions: upserts, rules of record, provenance, validation, grading, parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import numeric, parsing, text
from tidemark.operators import metrics, records, replay, temporal
from tidemark.plans.queries import DAY, HOUR, E, O, cents, facts, orders, query, table
from tidemark.scratch import beside, cut, scratch_path
from tidemark.sources import captures, formats, store


@query("""WITH s AS (SELECT p_partkey, p_brand, p_size, 1 AS v FROM part WHERE p_partkey % 3 > 0),
o AS (SELECT p_partkey, p_brand || '+' AS p_brand, p_size + 1 AS p_size, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 2 END AS v FROM part WHERE p_partkey % 2 = 0),
b AS (SELECT *, 0 AS new FROM s UNION ALL SELECT *, 1 FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY v DESC, new DESC) AS r FROM b)
SELECT p_partkey, p_brand, p_size, v FROM r WHERE r = 1""")
def upserted_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the parts are stored; half are offered changed, some of these too late."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    late = F.when(F.col("p_partkey") % 5 == 0, 0).otherwise(2)
    offered = part.where("p_partkey % 2 = 0").select("p_partkey", F.concat("p_brand", F.lit("+")).alias("p_brand"), (F.col("p_size") + 1).alias("p_size"), late.alias("v"))
    return records.upsert(part.where("p_partkey % 3 > 0").withColumn("v", F.lit(1)), offered, ["p_partkey"], "v")


@query("""WITH d AS (SELECT doc_id, source, sha256(text) AS h FROM documents)
SELECT doc_id, source FROM d WHERE (source, h) IN (SELECT source, h FROM d JOIN labels USING (doc_id) WHERE quality = 1)""")
def allowed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose source and digest are those of a document labelled good."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    good = d.join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id")
    return records.allowed(d, good, ["source", "h"]).select("doc_id", "source")


@query(f"""WITH {O}, a AS (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0))),
r AS (SELECT o_custkey, o_orderkey, placed, row_number() OVER (PARTITION BY o_custkey ORDER BY placed DESC, o_orderkey DESC) AS r FROM o JOIN a ON l_orderkey = o_orderkey)
SELECT o_custkey, o_orderkey, placed FROM r WHERE r = 1""")
def newest_wholly_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's newest order of which every supplier is allowed."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("s_suppkey"))
    fit = records.all_allowed(lines, ["l_orderkey"], "s_suppkey", table(spark, sf_dir, "supplier").where("s_acctbal > 0"))
    own = orders(spark, sf_dir).join(fit, F.col("l_orderkey") == F.col("o_orderkey"))
    return temporal.latest_per_key(own, ["o_custkey"], [F.desc("placed"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "placed")


@query("SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey OR o_orderkey = c_custkey")
def either_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and customers that agree in one of two keys."""
    met = records.either_join(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), [("o_custkey", "c_custkey"), ("o_orderkey", "c_custkey")])
    return met.select("o_orderkey", "c_custkey")


@query("""SELECT l_orderkey, string_agg(p_brand, '>' ORDER BY l_linenumber, l_partkey) AS brands, count(*) AS refs
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey""")
def provenance_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's parts as a JSON array of keys, resolved in the array's order."""
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    listed = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.transform(rows, lambda r: r["l_partkey"])).alias("parts"))
    found = records.provenance(listed, "l_orderkey", "parts", table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "ref"), "ref", ["p_brand"])
    return found.select("l_orderkey", F.array_join(F.transform("evidence", lambda e: e["p_brand"]), ">").alias("brands"), F.size("evidence").cast("long").alias("refs"))


@query(f"""WITH {E}, m AS (SELECT user_id, event_type, CAST(sum(cents) AS BIGINT) AS total FROM e GROUP BY ALL)
SELECT event_id, m.total FROM e LEFT JOIN m ON m.user_id = e.user_id AND m.event_type = CASE WHEN e.event_type = 'purchase' THEN 'click' WHEN e.event_type = 'signup' THEN 'view' ELSE e.event_type END""")
def mapped_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its user's total of the type that its own stands for."""
    e = facts(spark, sf_dir).select("event_id", "user_id", "event_type", "cents")
    totals = e.groupBy("user_id", "event_type").agg(F.sum("cents").alias("total"))
    return records.mapped_join(e, totals, ["user_id"], "event_type", {"purchase": "click", "signup": "view"}).select("event_id", "total")


@query(f"""WITH {E}, r AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type, row_number() OVER (
PARTITION BY CAST(json_extract(props, '$.k') AS BIGINT), event_type ORDER BY observed_at DESC, event_id DESC) AS r FROM e) SELECT k, event_type, event_id FROM r WHERE r = 1""")
def newest_per_json_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest run of each key that stands inside a JSON column."""
    rows = facts(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return temporal.latest_per_key(rows, ["k", "event_type"], [F.desc("observed_at"), F.desc("event_id")]).select("k", "event_type", "event_id")


@query(f"""WITH {O}, r AS (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, placed, row_number() OVER (
PARTITION BY l_partkey, l_suppkey ORDER BY placed DESC, l_orderkey DESC, l_linenumber DESC) AS r FROM lineitem JOIN o ON o_orderkey = l_orderkey)
SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM r WHERE r = 1""")
def assignment_of_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part and supplier the line of the newest order: the assignment of record."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    dated = lines.join(orders(spark, sf_dir).select("o_orderkey", "placed"), F.col("o_orderkey") == F.col("l_orderkey"))
    newest = [F.desc("placed"), F.desc("l_orderkey"), F.desc("l_linenumber")]
    return temporal.latest_per_key(dated, ["l_partkey", "l_suppkey"], newest).select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")


@query("""WITH d AS (SELECT doc_id, sha256(text) AS h, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY (quality IS NULL)::INT + (toxic IS NULL)::INT, doc_id) AS r FROM d) SELECT doc_id, h, quality FROM r WHERE r = 1""")
def one_grade_per_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document of each content, whichever source it came by: labelled ones first."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return records.one_per_target(d, ["h"], ["quality", "toxic"], "doc_id").select("doc_id", "h", "quality")


@query(f"""WITH {O}, k AS (SELECT DISTINCT o_custkey, placed // {30 * DAY} AS month, o_orderstatus FROM o)
SELECT o_custkey, month, count(*) AS kinds FROM k GROUP BY ALL HAVING count(*) > 1""")
def mixed_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and months with orders of several statuses."""
    rows = orders(spark, sf_dir).withColumn("month", F.floor(F.col("placed") / (30 * DAY)))
    return records.mixed_cohorts(rows, ["o_custkey", "month"], ["o_orderstatus"])


@query(f"""WITH {O}, {E}, n AS (SELECT user_id, max_by(event_type, (observed_at, event_id)) AS last FROM e GROUP BY user_id)
SELECT o_orderkey, CASE WHEN last = 'error' THEN true WHEN last = 'signup' THEN false ELSE coalesce(upper(o_orderstatus) IN ('O', 'OUT', 'INACTIVE', 'IR', 'PUP', 'SUSPENDED'), false) END AS out
FROM o LEFT JOIN n ON user_id = o_custkey""")
def inactive_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status that counts as out, unless the newest official word says otherwise."""
    last = facts(spark, sf_dir).groupBy(F.col("user_id").alias("o_custkey")).agg(F.max_by("event_type", F.struct("observed_at", "event_id")).alias("last"))
    official = F.when(F.col("last") == "error", "unavailable").when(F.col("last") == "signup", "available")
    return orders(spark, sf_dir).join(last, "o_custkey", "left").select("o_orderkey", parsing.inactive(F.col("o_orderstatus"), official).alias("out"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS at, coalesce(nullif(event_type, 'view'), 'default') AS kind,
CAST(coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS BIGINT) AS k FROM events""")
def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns with defaults and canonical texts."""
    kind = F.coalesce(F.when(F.col("event_type") != "view", F.col("event_type")), F.lit("default"))
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return table(spark, sf_dir, "events").select("event_id", at.alias("at"), kind.alias("kind"), F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("k"))


@query("""SELECT event_id, epoch_us(timezone('America/New_York', date_trunc('minute', ts))) AS at FROM events""")
def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local times as text, read in their zone."""
    text = F.date_format("ts", "MM/dd/yyyy hh:mma")
    return table(spark, sf_dir, "events").select("event_id", parsing.local_instant(text, "America/New_York").alias("at"))


@query(f"""WITH {E} SELECT event_type, count(*) AS n, min(observed_at) AS first FROM e
WHERE observed_at >= epoch_us(timezone('Asia/Tokyo', timestamp '2024-01-01')) AND observed_at < epoch_us(timezone('Asia/Tokyo', timestamp '2024-02-01')) GROUP BY event_type""")
def events_of_local_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = parsing.month_window(2024, 1, "Asia/Tokyo")
    inside = facts(spark, sf_dir).where((F.col("observed_at") >= low) & (F.col("observed_at") < high))
    return inside.groupBy("event_type").agg(F.count("*").alias("n"), F.min("observed_at").alias("first"))


@query("""WITH j AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '["' || o_orderstatus || '", "' || o_orderpriority || '"]' WHEN 1 THEN '["' || o_orderstatus || '", 7]'
WHEN 2 THEN '{"a": "' || o_orderstatus || '"}' ELSE '[]' END AS j FROM orders)
SELECT o_orderkey, json_type(j) = 'ARRAY' AND len(list_filter(CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') ELSE [] END, lambda x: json_type(x) <> 'VARCHAR')) = 0 AS ok,
CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority END AS second FROM j JOIN orders USING (o_orderkey)""")
def checked_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON that must be an array of texts, some of it not."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 4
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    json = (
        F.when(k == 0, F.concat(F.lit("["), quoted(F.col("o_orderstatus")), F.lit(", "), quoted(F.col("o_orderpriority")), F.lit("]")))
        .when(k == 1, F.concat(F.lit("["), quoted(F.col("o_orderstatus")), F.lit(", 7]")))
        .when(k == 2, F.concat(F.lit('{"a": '), quoted(F.col("o_orderstatus")), F.lit("}"))).otherwise("[]")
    )
    found = parsing.text_array(json)
    return o.select("o_orderkey", found.isNotNull().alias("ok"), F.get(found, F.lit(1)).alias("second"))


@query("""WITH s AS (SELECT event_id, [CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false END,
CASE event_type WHEN 'error' THEN false WHEN 'purchase' THEN true END] AS s FROM events), d AS (SELECT event_id, list_distinct(list_filter(s, lambda x: x IS NOT NULL)) AS s FROM s)
SELECT event_id, CASE WHEN len(s) > 1 THEN 'conflict' WHEN len(s) = 0 THEN 'unknown' WHEN s[1] THEN 'yes' ELSE 'no' END AS played FROM d""")
def played_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What JSON objects say, with conflicts told apart."""
    three, five = F.col("event_id") % 3, F.col("event_id") % 5
    status = F.when(F.col("event_type") == "error", "out").when(F.col("event_type") == "purchase", "active").otherwise(F.col("event_type"))
    said = F.struct(F.when(three == 0, True).when(three == 1, False).alias("active"), F.when(five == 0, True).when(five == 1, False).alias("played"), status.alias("status"))
    return table(spark, sf_dir, "events").select("event_id", parsing.played(F.to_json(said)).alias("played"))


@query("""SELECT doc_id, CASE upper(lang) WHEN 'EN' THEN 'eng' WHEN 'DE' THEN 'deu' WHEN 'FR' THEN 'fra' END AS code,
CASE WHEN n_chars % 7 = 0 THEN true ELSE false END AS made_up FROM documents""")
def aliased_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes by a map of aliases, and sources marked as made up."""
    name = F.when(F.col("n_chars") % 7 == 0, F.concat(F.lit("unit-TEST-"), F.col("lang"))).otherwise(F.concat(F.lit("latest"), F.col("lang")))
    return table(spark, sf_dir, "documents").select("doc_id", parsing.alias(F.col("lang"), {"EN": "eng", "DE": "deu", "FR": "fra"}).alias("code"), parsing.synthetic(name).alias("made_up"))


@query("""WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations), d AS (SELECT conv_id, turn, list_filter(w, lambda x, i: list_position(w, x) = i) AS w FROM w)
SELECT conv_id, turn, len(w) AS n, array_to_string(w[1:4], ' ') AS first FROM d""")
def ordered_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of each turn in the order in which they come."""
    w = F.array_distinct(F.split("text", " "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(w).cast("long").alias("n"), F.array_join(F.slice(w, 1, 4), " ").alias("first"))


@query("""SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN ', ' || p_brand ELSE '' END AS cleaned, CASE WHEN p_partkey % 3 = 0 THEN 2 END AS slots,
CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS second, CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN p_type ELSE 'PROMO' END AS place FROM part""")
def pasted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pasted names, lineups as text, and positions."""
    k = F.col("p_partkey") % 3
    line = F.concat(F.when(k == 0, " - ").when(k == 1, "12. ").otherwise(""), F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" ("), F.col("p_brand"), F.lit(")"))).otherwise(""), F.when(k == 2, " - Questionable").otherwise(""))
    text = F.concat(F.when(k == 0, "").otherwise("x "), F.lit("QB "), F.col("p_name"), F.lit(" RB "), F.col("p_brand"))
    found = parsing.lineup(text, ["QB", "RB"])
    place = parsing.position(F.col("p_type"), F.array(F.lit("UTIL"), F.lit("PROMO")), ["PROMO", "ECONOMY"])
    return table(spark, sf_dir, "part").select(
        "p_partkey", parsing.pasted_line(line).alias("cleaned"), F.size(F.when(found.isNotNull(), found)).alias("slots"), F.get(found, F.lit(1))["name"].alias("second"), place.alias("place"),
    ).withColumn("slots", F.when(F.col("slots") > 0, F.col("slots")))


@query("""SELECT o_orderkey FROM orders ORDER BY sha256('s7:' || o_orderkey), o_orderkey LIMIT 250""")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: 250 orders without replacement."""
    return records.seeded_sample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "s7", 250)


@query("""SELECT lang, count(*) AS items, count(DISTINCT source) AS sources, count(DISTINCT sha256(text)) AS contents, count(*) - count(DISTINCT sha256(text)) AS duplicates FROM documents GROUP BY lang""")
def episode_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", "source", F.sha2("text", 256).alias("h"))
    out = d.groupBy("lang").agg(F.count("*").alias("items"), F.countDistinct("source").alias("sources"), F.countDistinct("h").alias("contents"))
    return out.withColumn("duplicates", F.col("items") - F.col("contents"))


@query(f"""WITH {O}, r AS (SELECT placed // {7 * DAY} AS week, max(o_orderkey) AS run FROM o GROUP BY 1)
SELECT week, run, l_linenumber, l_partkey FROM r JOIN lineitem ON l_orderkey = run""")
def newest_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each week's newest run, then all its rows."""
    runs = orders(spark, sf_dir).groupBy(F.floor(F.col("placed") / (7 * DAY)).alias("week")).agg(F.max("o_orderkey").alias("run"))
    return runs.join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("run")).select("week", "run", "l_linenumber", "l_partkey")


@query(f"""WITH {O}, {E}, b AS (SELECT *, lag(cents) OVER (PARTITION BY o_custkey ORDER BY placed, o_orderkey) AS baseline FROM o),
v AS (SELECT user_id, count(*) AS n, CAST(sum(cents) AS BIGINT) AS s FROM e WHERE event_type = 'view' GROUP BY user_id),
t AS (SELECT o_orderkey, o_orderpriority, cents, baseline, s FROM b LEFT JOIN v ON user_id = o_custkey)
SELECT o_orderpriority, count(*) AS rows, count(*) FILTER (WHERE baseline IS NOT NULL AND s IS NOT NULL) AS usable, count(*) FILTER (WHERE baseline IS NULL) AS no_baseline,
count(*) FILTER (WHERE s IS NULL) AS no_feature, CAST(coalesce(sum(cents - baseline) FILTER (WHERE s IS NOT NULL), 0) AS BIGINT) AS label FROM t GROUP BY o_orderpriority""")
def training_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows: a label, the baseline before it and a feature; what is missing is counted, not imputed."""
    before = F.lag("cents").over(W.partitionBy("o_custkey").orderBy("placed", "o_orderkey"))
    views = facts(spark, sf_dir).where("event_type = 'view'").groupBy(F.col("user_id").alias("o_custkey")).agg(F.sum("cents").alias("s"))
    t = orders(spark, sf_dir).withColumn("baseline", before).join(views, "o_custkey", "left")
    return t.groupBy("o_orderpriority").agg(
        F.count("*").alias("rows"), F.count_if(F.col("baseline").isNotNull() & F.col("s").isNotNull()).alias("usable"), F.count_if(F.col("baseline").isNull()).alias("no_baseline"),
        F.count_if(F.col("s").isNull()).alias("no_feature"), F.coalesce(F.sum(F.when(F.col("s").isNotNull(), F.col("cents") - F.col("baseline"))), F.lit(0)).alias("label"),
    )


@query(f"""WITH {E}, i AS (SELECT user_id, observed_at // {DAY} AS item, avg(cents) AS m, count(*) AS n FROM e WHERE event_type <> 'error' GROUP BY ALL),
r AS (SELECT user_id, count(DISTINCT event_type) AS reach FROM e GROUP BY user_id), f AS (SELECT user_id, avg(m) AS mean, count(*) AS items FROM i GROUP BY user_id)
SELECT r.user_id, round(mean, 8) AS mean, coalesce(items, 0) AS items, reach FROM r LEFT JOIN f USING (user_id)""")
def two_level_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means within items, then over items, derivatives left out; reach counts all sources and everyone is listed."""
    e = facts(spark, sf_dir)
    items = e.where("event_type <> 'error'").groupBy("user_id", F.floor(F.col("observed_at") / DAY).alias("item")).agg(F.avg("cents").alias("m"))
    means = items.groupBy("user_id").agg(F.round(F.avg("m"), 8).alias("mean"), F.count("*").alias("items"))
    reach = e.groupBy("user_id").agg(F.countDistinct("event_type").alias("reach"))
    return reach.join(means, "user_id", "left").na.fill(0, ["items"]).select("user_id", "mean", "items", "reach")


@query("""WITH d AS (SELECT l_suppkey, abs(l_discount * 100 - l_tax * 100) AS m, abs(5.0 - l_tax * 100) AS b, l_quantity IS NOT NULL AS c, l_linenumber < 8 AND l_suppkey % 5 > 0 AS s FROM lineitem),
g AS (SELECT l_suppkey, avg(m) AS model, avg(b) AS baseline, bool_and(c) AS c, bool_and(s) AS s FROM d GROUP BY l_suppkey)
SELECT l_suppkey, round(model, 6) AS model, round(baseline, 6) AS baseline,
CASE WHEN NOT c THEN 'not covered' WHEN NOT s THEN 'other configuration' WHEN model >= baseline THEN 'no better' ELSE 'applied' END AS decision FROM g""")
def routing_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a model beats its baseline, of one configuration and whole coverage, it is applied."""
    model, base = F.abs(F.col("l_discount") * 100 - F.col("l_tax") * 100), F.abs(5.0 - F.col("l_tax") * 100)
    same = (F.col("l_linenumber") < 8) & (F.col("l_suppkey") % 5 > 0)
    return records.routed(table(spark, sf_dir, "lineitem"), ["l_suppkey"], model, base, F.col("l_quantity").isNotNull(), same)


@query("""WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM lineitem), w AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_partkey) AS d, sum(l_extendedprice) AS c FROM l GROUP BY l_orderkey)
SELECT l_orderkey AS lineup, 'size' AS issue FROM w WHERE NOT n BETWEEN 2 AND 6 UNION ALL SELECT l_orderkey, 'duplicate' FROM w WHERE d < n UNION ALL SELECT l_orderkey, 'cost' FROM w WHERE c > 250000
UNION ALL SELECT DISTINCT l_orderkey, 'group' FROM (SELECT l_orderkey FROM l GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1)""")
def lineup_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lineups of parts, checked by rules of size, duplicates, cost and groups."""
    found = records.lineup_issues(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", "l_extendedprice", 250_000, (2, 6), "l_suppkey", 1)
    return found.select(F.col("l_orderkey").alias("lineup"), "issue")


POLICY = [("AUTOMOBILE", 3, 0.2), ("BUILDING", 5, 0.3), ("MACHINERY", 8, 0.5)]


@query(f"""WITH {O}, p(segment, most, cap) AS (VALUES {", ".join(map(str, POLICY))}), n AS (SELECT c_custkey, c_mktsegment, count(o_orderkey) AS n FROM customer LEFT JOIN o ON o_custkey = c_custkey GROUP BY ALL)
SELECT c_custkey, n, CAST(coalesce(most, 4) AS BIGINT) AS most, CAST(coalesce(cap, 0.25) AS DOUBLE) AS cap, n > coalesce(most, 4) AS over_limit FROM n LEFT JOIN p ON segment = c_mktsegment""")
def applied_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders under the policy of the segment, with a default."""
    policy = spark.createDataFrame(POLICY, "c_mktsegment string, most long, cap double")  # a row a segment
    n = orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    c = table(spark, sf_dir, "customer").join(n, "c_custkey", "left").join(F.broadcast(policy), "c_mktsegment", "left").na.fill({"n": 0, "most": 4, "cap": 0.25})
    return c.select("c_custkey", "n", "most", "cap", (F.col("n") > F.col("most")).alias("over_limit"))


@query(f"""WITH {E}, {O}, s AS (SELECT user_id AS k, CAST(sum(cents) AS BIGINT) AS x FROM e WHERE event_type = 'purchase' GROUP BY 1), r AS (SELECT o_custkey AS k, CAST(sum(cents) AS BIGINT) AS y FROM o WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT coalesce(s.k, r.k) AS k, x AS expected, y AS realised, coalesce(y, 0) - coalesce(x, 0) AS delta, CASE WHEN x IS NULL THEN 'unforeseen' WHEN y IS NULL THEN 'absent' ELSE 'both' END AS side
FROM s FULL JOIN r ON s.k = r.k""")
def expected_and_realised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was expected of each key beside what came, either side kept."""
    s = facts(spark, sf_dir).where("event_type = 'purchase'").groupBy(F.col("user_id").alias("k")).agg(F.sum("cents").alias("expected"))
    r = orders(spark, sf_dir).where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.sum("cents").alias("realised"))
    zero = F.lit(0)
    side = F.when(F.col("expected").isNull(), "unforeseen").when(F.col("realised").isNull(), "absent").otherwise("both")
    return s.join(r, "k", "full").select("k", "expected", "realised", (F.coalesce("realised", zero) - F.coalesce("expected", zero)).alias("delta"), side.alias("side"))


@query(f"""WITH {O}, r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY placed DESC, o_orderkey DESC) AS r FROM o), l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_custkey, string_agg(o_orderkey || ':' || o_orderstatus || ':' || coalesce(n, 0), ' ' ORDER BY r) AS trail, count(*) AS shown FROM r LEFT JOIN l ON l_orderkey = o_orderkey WHERE r <= 3 GROUP BY o_custkey""")
def customer_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest three orders of each customer with how many lines they have, as a trail."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    last = metrics.top_per_group(orders(spark, sf_dir), ["o_custkey"], [F.desc("placed"), F.desc("o_orderkey")], 3).join(n, "o_orderkey", "left")
    entry = F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus", F.coalesce("n", F.lit(0)).cast("string"))
    trail = F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry"))))  # three entries
    return last.groupBy("o_custkey").agg(F.array_join(F.transform(trail, lambda t: t["entry"]), " ").alias("trail"), F.count("*").alias("shown"))


@query(f"""WITH {E}, s AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN -cents ELSE cents END AS h FROM e), t AS (SELECT user_id, CAST(sum(h) AS BIGINT) AS total FROM s GROUP BY user_id ORDER BY abs(sum(h)) DESC, user_id LIMIT 20),
r AS (SELECT s.user_id, event_id, h, row_number() OVER (PARTITION BY s.user_id ORDER BY abs(h) DESC, event_id) AS r FROM s JOIN t USING (user_id) WHERE sign(h) = -sign(total))
SELECT t.user_id, total, event_id AS against, h AS weight FROM t LEFT JOIN r ON r.user_id = t.user_id AND r = 1""")
def counter_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the strongest row against each of the twenty largest totals."""
    s = facts(spark, sf_dir).select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, -F.col("cents")).otherwise(F.col("cents")).alias("h"))
    return records.counter_evidence(s, "user_id", "h", "event_id", 20)


@query(f"""WITH {O}, gone AS (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0), a AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM gone))
SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM a) THEN 'rebuild' ELSE 'pinned' END AS state FROM o WHERE o_orderstatus = 'O'""")
def affected_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers fall out: open orders that hold one are rebuilt, the others stay pinned."""
    gone = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    hit = table(spark, sf_dir, "lineitem").join(gone, "l_suppkey", "left_semi").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("hit", F.lit(True))
    state = F.when(F.col("hit"), "rebuild").otherwise("pinned")
    return orders(spark, sf_dir).where("o_orderstatus = 'O'").join(hit, "o_orderkey", "left").select("o_orderkey", state.alias("state"))


@query("""SELECT c_custkey, stat, value FROM (SELECT c_custkey, c_acctbal AS balance, CAST(c_nationkey AS DOUBLE) AS nation, CASE WHEN c_custkey % 2 = 0 THEN 1.0 END AS even FROM customer)
UNPIVOT (value FOR stat IN (balance, nation, even))""")
def unpivoted_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"), F.when(F.col("c_custkey") % 2 == 0, 1.0).alias("even"))
    return records.long_form(c, ["c_custkey"], ["balance", "nation", "even"])


@query("""WITH n AS (SELECT n_nationkey, n_name, n_regionkey FROM nation), r AS (SELECT p_brand, count(*) AS n, min(p_partkey) AS k FROM part WHERE p_size > 25 GROUP BY p_brand)
SELECT p_partkey, CASE WHEN n = 1 THEN k END AS k, CASE WHEN n IS NULL THEN 'no match' WHEN n > 1 THEN 'ambiguous' END AS held FROM part LEFT JOIN r USING (p_brand)""")
def held_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with the one large part of their brand; none or several hold the row."""
    part = table(spark, sf_dir, "part")
    large = part.where("p_size > 25").select("p_brand", F.col("p_partkey").alias("k"))
    return records.matched_or_held(part.select("p_partkey", "p_brand"), large, ["p_brand"], ["k"]).select("p_partkey", "k", "held")


@query("""WITH r AS (SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 1 THEN 'flex' ELSE 'captain' END AS role, l_quantity AS v FROM lineitem WHERE l_linenumber <= 3),
g AS (SELECT l_orderkey, count(*) FILTER (WHERE role = 'flex') AS b, count(*) FILTER (WHERE role = 'captain') AS s, min(v) FILTER (WHERE role = 'flex') AS value, min(v) FILTER (WHERE role = 'captain') AS c FROM r GROUP BY 1)
SELECT l_orderkey, value, CASE WHEN b = 0 THEN 'no base row' WHEN b > 1 OR s > 1 THEN 'several rows' WHEN abs(c - 1.5 * value) > 5 THEN 'not in proportion' END AS issue FROM g""")
def merged_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's first lines as one player's rows in two roles."""
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3").select("l_orderkey", F.when(F.col("l_linenumber") % 2 == 1, "flex").otherwise("captain").alias("role"), "l_quantity")
    return records.merge_roles(rows, ["l_orderkey"], "role", "flex", "captain", "l_quantity", 1.5, 5.0)


@query("""SELECT l_orderkey, l_orderkey || ',' || string_agg(l_partkey || ' (' || l_linenumber || ')', ',' ORDER BY l_linenumber, l_partkey) AS line,
sha256(l_orderkey || ',' || string_agg(l_partkey || ' (' || l_linenumber || ')', ',' ORDER BY l_linenumber, l_partkey)) AS digest FROM lineitem GROUP BY l_orderkey""")
def exported_lineups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of an upload for each order, slots in fixed order, with a digest to check a replay by."""
    cell = F.concat(F.col("l_partkey").cast("string"), F.lit(" ("), F.col("l_linenumber").cast("string"), F.lit(")"))
    slots = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", cell.alias("cell"))))
    line = F.concat(F.col("l_orderkey").cast("string"), F.lit(","), F.array_join(F.transform(slots, lambda s: s["cell"]), ","))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(line.alias("line")).withColumn("digest", F.sha2("line", 256))


@query("""WITH f AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) SELECT source, lang, n, CASE WHEN n % 3 = 0 THEN 'hash' ELSE 'ok' END AS state FROM f""")
def verified_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each source and language stored, those of some groups of other texts, and read back to check the rows."""
    d = table(spark, sf_dir, "documents").select("source", "lang", "text")

    def digests(rows: DataFrame) -> DataFrame:
        # an order-free sum of digests stands for the rows: no group has to be in one place
        part = F.conv(F.substring(F.sha2("text", 256), 1, 15), 16, 10).cast("decimal(38,0)")
        return rows.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum(part).alias("digest"))

    now = digests(d)
    other = beside(d, now.select("source", "lang", "n"), ["source", "lang"]).select("source", "lang", F.when(F.col("n") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    frozen = cut(digests(other), "frozen").withColumnRenamed("digest", "frozen").drop("n")
    return beside(now, frozen, ["source", "lang"]).select("source", "lang", "n", F.when(F.col("digest") == F.col("frozen"), "ok").otherwise("hash").alias("state"))


@query("""WITH d AS (SELECT o_orderkey FROM orders) SELECT o_orderkey AS key, 'changed' AS state FROM d WHERE o_orderkey % 97 = 0 AND o_orderkey % 89 <> 0
UNION ALL SELECT o_orderkey, 'lost' FROM d WHERE o_orderkey % 89 = 0 UNION ALL SELECT o_orderkey + 1000000000, 'added' FROM d WHERE o_orderkey % 83 = 0""")
def replayed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders frozen with a tree of digests, and replayed with some of them changed, lost and added."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey", "o_totalprice")
    path = scratch_path(spark, "frozen")
    replay.freeze(o, ["key"], path)
    now = o.where("key % 89 <> 0").withColumn("o_custkey", F.when(F.col("key") % 97 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    now = now.unionByName(o.where("key % 83 = 0").withColumn("key", F.col("key") + 1_000_000_000))
    return replay.replay(now, path).differences.select("key", "state")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS size, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_retailprice END AS price,
concat_ws('; ', CASE WHEN p_partkey % 7 = 0 THEN 'size is no whole' END, CASE WHEN p_partkey % 11 = 0 THEN 'price is empty' END) AS reasons, 'parts' AS vendor FROM part""")
def vendor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts landed as a vendor's files, some cells spoilt, and read as a declared format in ranges of bytes."""
    part = table(spark, sf_dir, "part")
    path = scratch_path(spark, "landed")
    size, price = F.when(F.col("p_partkey") % 7 == 0, "x").otherwise(F.col("p_size").cast("string")), F.when(F.col("p_partkey") % 11 == 0, "").otherwise(F.col("p_retailprice").cast("string"))
    part.select(F.col("p_partkey").alias("Id"), F.col("p_name").alias("Name"), size.alias("Size"), price.alias("Price")).write.option("header", True).option("emptyValue", "").csv(path)
    fields = (formats.Field("Id", "p_partkey", "whole", True), formats.Field("Name", "name"), formats.Field("Size", "size", "whole"), formats.Field("Price", "price", "number", True, 0.0))
    formats.declare(formats.Format("parts", fields, (("vendor", "parts"),)))
    found = formats.read_format(spark, "parts", path, 16_384)
    return found.select("p_partkey", "size", "price", F.array_join("_reasons", "; ").alias("reasons"), "vendor")


@query("""WITH c AS (SELECT p_partkey, p_brand, CAST(round(p_retailprice * 100) AS BIGINT) AS cents, p_partkey % 5 = 0 AS moves FROM part),
h AS (SELECT DISTINCT p_brand FROM c WHERE p_partkey % 101 = 7)
SELECT p_brand AS slate, p_partkey AS entity, cents, 1 AS capture FROM c WHERE p_brand NOT IN (SELECT p_brand FROM h)
UNION ALL SELECT p_brand, p_partkey, cents + 25, 2 FROM c WHERE moves AND p_brand NOT IN (SELECT p_brand FROM h)
UNION ALL SELECT p_brand, p_partkey, cents + CASE WHEN moves THEN 25 ELSE 0 END, 3 FROM c WHERE p_brand IN (SELECT p_brand FROM h)""")
def loaded_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three captures of parts' prices loaded one after the other: groups with ambiguous ids wait for the last, after which they are known."""
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("x"), F.col("p_partkey").cast("string")).alias("Ext"), F.col("p_brand").alias("Brand"), cents("p_retailprice").alias("cents"), "p_partkey")
    formats.declare(formats.Format("prices", (formats.Field("Ext", "ext", required=True), formats.Field("Brand", "brand"), formats.Field("Cents", "cents", "whole", True))))
    path, sure = scratch_path(spark, "history"), part.select(F.col("Ext").alias("external"), F.col("p_partkey").alias("entity"))
    unsure = sure.unionByName(sure.where("entity % 101 = 7").withColumn("entity", F.col("entity") + 1))
    for n in (1, 2, 3):
        folder = scratch_path(spark, f"capture-{n}")
        moved = F.col("cents") + F.when((F.col("p_partkey") % 5 == 0) & F.lit(n > 1), 25).otherwise(0)
        part.select("Ext", "Brand", moved.alias("Cents")).write.option("header", True).csv(folder)
        files = spark.read.format("binaryFile").load(folder).select(F.substring_index("path", "/", -1).alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
        captures.load_capture(spark, folder, cut(files, "manifest"), "prices", path, F.col("brand"), "ext", sure if n == 3 else unsure, ["cents"], f"2024-01-0{n}")
    return spark.read.parquet(path).select(F.col("group").alias("slate"), "entity", "cents", F.dayofmonth("observed_at").alias("capture"))


@query()
def nearest_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a spoilt quote of each conversation's turn stands in it."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    quote = F.regexp_replace(F.substring(F.col("text"), 11, 40), "[ao]", "")
    found = text.nearest(F.col("text"), quote)
    return c.select("conv_id", "turn", found.alias("p")).select("conv_id", "turn", "p.begin", "p.end", F.round("p.similarity", 6).alias("similarity"))


@query(f"""WITH {E}, w AS (SELECT event_type, unnest([observed_at // {6 * HOUR} * {6 * HOUR}, (observed_at // {6 * HOUR} - 1) * {6 * HOUR}]) AS start, cents FROM e)
SELECT event_type, start, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM w GROUP BY ALL""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of twelve hours every six hours, the batch form of the streaming one."""
    rows = facts(spark, sf_dir).withColumn("at", F.timestamp_micros("observed_at"))
    w = F.window("at", "12 hours", "6 hours")
    return rows.groupBy("event_type", w).agg(F.count("*").alias("n"), F.sum("cents").alias("total")).select("event_type", F.unix_micros("window.start").alias("start"), "n", "total")


@query("""WITH g AS (SELECT event_type, count(*) FILTER (WHERE value > 50) AS hits, count(*) AS n, avg(value) AS m FROM events GROUP BY event_type)
SELECT event_type, hits, n, round((hits + 1.0) / (n + 2.0), 6) AS mean, round(sqrt((hits + 1.0) * (n - hits + 1.0) / ((n + 2.0) * (n + 2.0) * (n + 3.0))), 6) AS sd, sha256('v1:' || event_type || ':' || hits || ':' || n) AS config FROM g""")
def stored_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of a posterior with the digest of what they were made from, stored by their content and read back by its digest."""
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("hits"), F.count("*").alias("n"))
    a, b = F.col("hits") + 1.0, F.col("n") - F.col("hits") + 1.0
    config = F.sha2(F.concat_ws(":", F.lit("v1"), "event_type", F.col("hits").cast("string"), F.col("n").cast("string")), 256)
    made = g.select("event_type", "hits", "n", (a / (a + b)).alias("mean"), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("sd"), config.alias("config"))
    path = scratch_path(spark, "distributions")
    kept = store.put(made, path, made.columns)
    store.put(made.where("n % 2 = 0"), path, made.columns)  # known already, so nothing is written
    return store.get(spark, path, kept).select("event_type", "hits", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "config")


@query("""WITH n AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS bad FROM events GROUP BY user_id),
c AS (SELECT c_custkey, c_mktsegment, n, bad FROM customer LEFT JOIN n ON user_id = c_custkey),
g AS (SELECT c_custkey, 'availability' AS rule, CASE WHEN n IS NULL THEN 'ungradable' WHEN n >= 60 THEN 'correct' ELSE 'incorrect' END AS verdict FROM c WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING')
UNION ALL SELECT c_custkey, 'usage', CASE WHEN n IS NULL THEN 'ungradable' WHEN bad * 5 <= n THEN 'correct' ELSE 'incorrect' END FROM c WHERE c_mktsegment = 'MACHINERY'
UNION ALL SELECT c_custkey, 'ownership', CASE WHEN n IS NULL THEN 'ungradable' WHEN bad = 0 THEN 'correct' ELSE 'indeterminate' END FROM c WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY'))
SELECT rule, verdict, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY rule), 6) AS share FROM g GROUP BY rule, verdict""")
def grading_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims routed to three rules, graded, and tallied."""
    n = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"))
    c = table(spark, sf_dir, "customer").join(n, "c_custkey", "left")
    rule = F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING"), "availability").when(F.col("c_mktsegment") == "MACHINERY", "usage").otherwise("ownership")
    word = lambda ok, no: F.when(F.col("n").isNull(), "ungradable").when(ok, "correct").otherwise(no)
    verdict = F.when(rule == "availability", word(F.col("n") >= 60, "incorrect")).when(rule == "usage", word(F.col("bad") * 5 <= F.col("n"), "incorrect")).otherwise(word(F.col("bad") == 0, "indeterminate"))
    g = c.where("c_mktsegment IS NOT NULL").groupBy(rule.alias("rule"), verdict.alias("verdict")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(numeric.ratio(F.col("n"), F.sum("n").over(W.partitionBy("rule"))), 6))


@query("""WITH n AS (SELECT o_orderkey AS claim, CASE WHEN o_orderkey % 4 = 0 THEN 'Nobody' ELSE c_name END AS ref FROM orders JOIN customer ON c_custkey = o_custkey
UNION SELECT o_orderkey, (SELECT c_name FROM customer WHERE c_custkey = o_custkey % 7) FROM orders WHERE o_orderkey % 3 = 0),
p AS (SELECT c_name, min(c_custkey::VARCHAR) AS name, min(c_mktsegment) AS team FROM customer GROUP BY c_name HAVING count(DISTINCT c_custkey) = 1),
m AS (SELECT DISTINCT claim, name, team FROM n JOIN p ON c_name = ref)
SELECT claim, name AS subject FROM m UNION SELECT claim, min(team) FROM m GROUP BY claim HAVING count(DISTINCT team) = 1""")
def claim_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as claims that name customers, some of them unknown: the customers that names stand for, and their segment where it is one."""
    c = table(spark, sf_dir, "customer")
    names = c.select(F.col("c_name").alias("ref"), F.col("c_custkey").cast("string").alias("name"), F.col("c_mktsegment").alias("team"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim"), "o_custkey")
    own = o.join(c, F.col("c_custkey") == F.col("o_custkey")).select("claim", F.when(F.col("claim") % 4 == 0, "Nobody").otherwise(F.col("c_name")).alias("ref"))
    other = o.where("claim % 3 = 0").join(c, F.col("c_custkey") == F.col("o_custkey") % 7).select("claim", F.col("c_name").alias("ref"))
    return records.subjects(own.unionByName(other).distinct(), "claim", "ref", names, "team").select("claim", "subject")


@query(f"""WITH {O}, w AS (SELECT *, placed // {30 * DAY} AS month FROM o), t AS (SELECT o_custkey, max(month) AS month FROM w GROUP BY o_custkey), n AS (SELECT w.* FROM w JOIN t USING (o_custkey, month))
SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS o_orderstatus, max_by(o_orderpriority, o_orderkey) AS o_orderpriority, count(DISTINCT (o_orderstatus, o_orderpriority)) > 1 AS conflict FROM n GROUP BY o_custkey""")
def roster_of_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's status and priority of the newest month, with conflicts inside that month."""
    rows = orders(spark, sf_dir).withColumn("month", F.floor(F.col("placed") / (30 * DAY)))
    return records.roster(rows, "o_custkey", ["month", "o_orderkey"], ["o_orderstatus", "o_orderpriority"])
