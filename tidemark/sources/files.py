"""Readers of landed files: exact headers, rejected rows with reasons, stacked sections, feeds, captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Readers by the name that a manifest gives a file.
READERS: dict[str, callable] = {}


def register(name: str, reader: callable) -> None:
    """Add a reader; a name is taken once."""
    if name in READERS:
        raise ValueError(f"reader {name} is registered already")
    READERS[name] = reader


def read(spark: SparkSession, name: str, path: str) -> DataFrame:
    if name not in READERS:
        raise ValueError(f"no reader {name}")
    return READERS[name](spark, path)


def csv_exact(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> DataFrame:
    """A CSV whose header must be exactly the schema's names; rows that don't fit have their text in ``_rejected``.

    The first file is looked at right away; every other one is refused by the
    task that reads it, if its header is another.
    """
    head = spark.read.option("header", False).options(**options).csv(path).first()
    found = [str(x or "").lstrip("﻿") for x in head] if head else []
    if found != schema.names:
        missing, more = sorted(set(schema.names) - set(found)), sorted(set(found) - set(schema.names))
        raise ValueError(f"header differs: missing {missing}, unexpected {more}" if missing or more else f"header order differs: {found}")
    with_reject = T.StructType([*schema.fields, T.StructField("_rejected", T.StringType())])
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_rejected").option("enforceSchema", False).options(**options)
    return reader.schema(with_reject).csv(path)


def accepted(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with ``reasons``."""
    reasons = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda r: r.isNotNull())
    marked = df.withColumn("reasons", reasons)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def stacked_sections(spark: SparkSession, path: str, starts: list[str]) -> list[DataFrame]:
    """(line_no, line) of each section of text files of which a section begins with a line that starts so; blank lines are left out.

    A file is one value here, as its sections have no other mark than their order.
    """
    lines = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line")).where("trim(line) <> ''")
    began = F.coalesce(*(F.when(F.col("line").startswith(s), F.lit(i)) for i, s in enumerate(starts)))
    section = F.last(began, ignorenulls=True).over(W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))
    marked = lines.withColumns({"__s": section, "__head": began})
    return [marked.where((F.col("__s") == i) & F.col("__head").isNull()).select("line_no", "line") for i in range(len(starts))]


def feed_items(spark: SparkSession, path: str, tag: str = "item") -> DataFrame:
    """Items of RSS (tag item) or Atom (tag entry) files: guid, title, link, published, content, content_sha256."""
    schema = "guid string, id string, title string, link string, pubDate string, updated string, description string, content string, summary string"
    raw = spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).schema(schema).load(path)
    from tidemark.functions.text import canonical, visible_text

    content = F.coalesce("content", "description", "summary", F.lit(""))
    shown = canonical(visible_text(F.concat_ws("\n", F.coalesce("title", F.lit("")), content)))
    items = raw.select(F.coalesce("guid", "id", "link").alias("guid"), "title", "link", F.coalesce("pubDate", "updated").alias("published"), shown.alias("content"))
    return items.where("content <> ''").withColumn("content_sha256", F.sha2("content", 256))


def odds_quotes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Quotes of an odds capture, a row per event and bookmaker, and those refused with reasons.

    A bookmaker needs exactly one spreads and one totals market, of one instant,
    with opposite spreads, equal totals and prices of 100 at least.
    """
    outcome = "outcomes array<struct<name string, price double, point double>>"
    schema = f"id string, commence_time string, home_team string, away_team string, bookmakers array<struct<key string, markets array<struct<key string, last_update string, {outcome}>>>>"
    events = spark.read.option("multiLine", True).schema(schema).json(path)
    b = events.select("id", "commence_time", "home_team", "away_team", F.explode("bookmakers").alias("b"))
    market = lambda k: F.filter("b.markets", lambda m: m["key"] == k)
    q = b.select("id", "commence_time", "home_team", "away_team", F.col("b.key").alias("bookmaker"), market("spreads").alias("s"), market("totals").alias("t"))
    point = lambda side: F.get(F.filter(F.get("s", F.lit(0))["outcomes"], lambda o: o["name"] == F.col(side)), F.lit(0))["point"]
    totals = F.get("t", F.lit(0))["outcomes"]
    q = q.withColumns({"home_spread": point("home_team"), "away_spread": point("away_team"), "total": F.get(totals, F.lit(0))["point"]})
    prices = F.concat(F.coalesce(F.get("s", F.lit(0))["outcomes"], F.array()), F.coalesce(totals, F.array()))
    rules = {
        "one spreads market": F.size("s") == 1, "one totals market": F.size("t") == 1,
        "one instant": F.get("s", F.lit(0))["last_update"] == F.get("t", F.lit(0))["last_update"],
        "opposite spreads": F.col("home_spread") == -F.col("away_spread"),
        "equal totals": F.size(F.array_distinct(F.transform(totals, lambda o: o["point"]))) == 1,
        "prices": F.forall(prices, lambda o: F.abs(o["price"]) >= 100),
    }
    good, bad = accepted(q, rules)
    return good.drop("s", "t"), bad.drop("s", "t")


def hourly_weather(spark: SparkSession, path: str, kickoff: Column) -> DataFrame:
    """The hour of parallel arrays that holds the kickoff; percent as fractions, what is missing stays null."""
    schema = "latitude double, longitude double, hourly struct<time array<string>, temperature_2m array<double>, precipitation_probability array<double>, wind_speed_10m array<double>>"
    w = spark.read.option("multiLine", True).schema(schema).json(path)
    hours = w.select("latitude", "longitude", F.explode(F.arrays_zip("hourly.time", "hourly.temperature_2m", "hourly.precipitation_probability", "hourly.wind_speed_10m")).alias("h"))
    at = F.to_timestamp("h.time", "yyyy-MM-dd'T'HH:mm")
    return hours.where(at == F.date_trunc("hour", kickoff)).select("latitude", "longitude", at.alias("hour"), F.col("h.temperature_2m").alias("temperature"), (F.col("h.precipitation_probability") / 100).alias("rain"), F.col("h.wind_speed_10m").alias("wind"))


def verify_manifest(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(path, state) of every file in the folder or the manifest (path below the folder, size, sha256): ok, missing, unmanifested, size or hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    top = "/" + folder.partition("://")[2].partition("/")[2] if "://" in folder else folder
    name = F.substring_index("path", f"{top.rstrip('/')}/", -1)
    there = files.select(name.alias("path"), F.col("length").alias("__n"), F.sha2("content", 256).alias("__h"))
    state = F.when(F.col("__h").isNull(), "missing").when(F.col("sha256").isNull(), "unmanifested").when(F.col("__n") != F.col("size"), "size").when(F.col("__h") != F.col("sha256"), "hash").otherwise("ok")
    return manifest.join(there, "path", "full").select("path", state.alias("state"))
