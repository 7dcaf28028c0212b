import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import files, sinks
from tidemark.streaming import continuous


def test_csv_header_and_rejects(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("a,b\n1,x\nbad,y\n")
    from pyspark.sql.types import IntegerType, StringType, StructType

    schema = StructType().add("a", IntegerType()).add("b", StringType())
    rows = files.csv_exact(spark, str(path), schema).collect()
    assert [r.a for r in rows] == [1, None] and rows[1]._rejected == "bad,y"
    with pytest.raises(ValueError, match="missing"):
        files.csv_exact(spark, str(path), StructType().add("a", IntegerType()).add("c", StringType()))


def test_stacked_sections(spark, tmp_path):
    (tmp_path / "s.txt").write_text("Rank,Id\n1,a\n2,b\n\nPlayer,Pts\nx,3\n")
    one, two = files.stacked_sections(spark, str(tmp_path / "s.txt"), ["Rank,", "Player,"])
    assert [r.line for r in one.orderBy("line_no").collect()] == ["1,a", "2,b"]
    assert [r.line for r in two.collect()] == ["x,3"]


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><guid>1</guid><title>T</title><description>&lt;p&gt;a &lt;script&gt;x&lt;/script&gt;b&lt;/p&gt;</description></item></channel></rss>")
    got = files.feed_items(spark, str(tmp_path / "f.xml")).collect()
    assert got[0].guid == "1" and got[0].content == "T a b"


def test_odds(spark, tmp_path):
    def book(key, spread, total):
        side = lambda name, point: '{"name":"%s","price":-110,"point":%s}' % (name, point)
        return '{"key":"%s","markets":[{"key":"spreads","last_update":"u","outcomes":[%s,%s]},{"key":"totals","last_update":"u","outcomes":[%s,%s]}]}' % (key, side("H", spread), side("A", -3), side("Over", total), side("Under", 44))

    (tmp_path / "o.json").write_text('[{"id":"1","home_team":"H","away_team":"A","bookmakers":[%s,%s]}]' % (book("good", 3, 44), book("bad", 2.5, 45)))
    good, bad = files.odds_quotes(spark, str(tmp_path / "o.json"))
    assert [r.bookmaker for r in good.collect()] == ["good"]
    assert bad.first().reasons == ["opposite spreads", "equal totals"]


def test_manifest(spark, tmp_path):
    import hashlib

    (tmp_path / "a").write_text("x")
    (tmp_path / "b").write_text("y")
    m = spark.createDataFrame([("a", 1, hashlib.sha256(b"x").hexdigest()), ("c", 1, "h")], "path string, size long, sha256 string")
    assert {r.path: r.state for r in files.verify_manifest(spark, str(tmp_path), m).collect()} == {"a": "ok", "b": "unmanifested", "c": "missing"}


def test_append_refuses_conflicts(spark, tmp_path):
    out = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    assert sinks.append_new(None, rows((1, "a"), (2, "b")), out, ["k"], ["v"])["inserted"] == 2
    assert sinks.append_new(spark.read.parquet(out), rows((1, "a"), (3, "c")), out, ["k"], ["v"]) == {"inserted": 1, "duplicate": 1, "conflict": 0}
    with pytest.raises(ValueError):
        sinks.append_new(spark.read.parquet(out), rows((1, "z")), out, ["k"], ["v"])
    assert spark.read.parquet(out).count() == 3


def test_canonical_json_and_digest(spark):
    at = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    assert sinks.canonical_json({"b": at, "a": 1}) == b'{"a":1,"b":"2024-01-01T00:00:00.000000Z"}'
    with pytest.raises(ValueError):
        sinks.canonical_json({"a": datetime.datetime(2024, 1, 1)})
    df = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    assert sinks.frozen_digest(df) == sinks.frozen_digest(df.orderBy(F.desc("a")).repartition(3)) != sinks.frozen_digest(df.limit(1))


def test_stream_sessions_and_newest(spark, tmp_path):
    t = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    df = spark.createDataFrame([(1, t(0), 1), (1, t(5), 2), (1, t(60), 3), (2, t(0), 4), (9, t(9000), 5)], "k int, ts timestamp, id int")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(frame, name, mode):
        q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    new = run(continuous.newest(stream, ["k"], "ts", "id", []), "newest", "complete")
    assert {r.k: r.id for r in new} == {1: 3, 2: 4, 9: 5}
    done = run(continuous.sessions(stream, "k", "ts", 30, 50, "1 second"), "sessions", "append")
    assert {(r.k, r["items"]) for r in done} >= {(1, 2)}


def test_late_rows_widen_their_session(spark, tmp_path):
    t = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    schema = "k int, ts timestamp"
    batches = [[(1, t(1000)), (1, t(1010))], [(1, t(1005)), (1, t(985)), (1, t(900))], [(1, t(1030)), (2, t(1100))], [(9, t(9000))], [(9, t(9001))]]
    us = lambda s: int((t(s) - datetime.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    zone = spark.conf.get("spark.sql.session.timeZone")
    for name in ("UTC", "Asia/Tokyo"):
        folder = tmp_path / name.replace("/", "-")
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"in/b={k}"))
        spark.conf.set("spark.sql.session.timeZone", name)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder / "in"))
        out = continuous.sessions(stream, "k", "ts", 30, 500, "1 hour")
        q = out.writeStream.foreachBatch(continuous.batch_once(str(folder / "out"))).outputMode("append").option("checkpointLocation", str(folder / "c")).start()
        q.processAllAvailable()
        q.stop()
        got = {(r.k, r.opened, r.closed, r["items"]) for r in spark.read.option("mergeSchema", True).parquet(str(folder / "out")).collect()}
        assert (1, us(900), us(900), 1) in got and (1, us(985), us(1030), 5) in got and (2, us(1100), us(1100), 1) in got
    spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_streamed_sessions_are_those_of_the_batch(spark, tmp_path, seed):
    """Rows in any order within the watermark, split into batches anyhow."""
    from tidemark.operators import temporal

    rng = random.Random(seed)
    origin = datetime.datetime(2024, 1, 1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.randint(0, 3000), int(rng.gauss(1500, 60))])) for _ in range(300)]
    late = 600
    rows.sort(key=lambda r: r[1] + rng.randint(0, late - 1))  # none comes after one that is later by more
    cuts = sorted(rng.sample(range(1, len(rows)), rng.choice([3, 9]))) + [len(rows)]
    schema = "k string, ts timestamp"
    batches = [rows[a:b] for a, b in zip([0, *cuts], cuts, strict=False)] + [[("end", 50_000)], [("end", 100_000)]]
    for n, part in enumerate(batches):
        spark.createDataFrame([(k, origin + datetime.timedelta(seconds=t)) for k, t in part], schema).coalesce(1).write.parquet(str(tmp_path / f"in/b={n:03d}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = continuous.sessions(stream, "k", "ts", 20, 90, f"{late} seconds")
    q = out.writeStream.foreachBatch(continuous.batch_once(str(tmp_path / "out"))).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = [(r.k, r.opened, r.closed, r["items"]) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.k != "end"]
    base = int((origin - datetime.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    frame = spark.createDataFrame([(i, k, base + t * 1_000_000) for i, (k, t) in enumerate(rows)], "i int, k string, us long")
    s = temporal.sessions(frame, ["k"], "us", "i", 20_000_000, 90_000_000)
    wanted = s.groupBy("k", "session").agg(F.min("us").alias("opened"), F.max("us").alias("closed"), F.count("*").alias("items")).collect()
    assert sorted(map(repr, got)) == sorted(repr((r.k, r.opened, r.closed, r["items"])) for r in wanted)


def test_a_batch_that_comes_again_counts_once(spark, tmp_path):
    write = continuous.batch_once(str(tmp_path / "out"))
    for number, rows in ((0, 5), (1, 7), (1, 7)):
        write(spark.range(rows), number)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12


def test_stream_windows_and_first_contents(spark, tmp_path):
    t = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [("a", t(0), 1), ("a", t(59), 2), ("b", t(61), 4), ("a", t(61), 4), ("a", t(61), 4)]
    spark.createDataFrame(rows, "k string, ts timestamp, v int").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp, v int").parquet(str(tmp_path / "in"))

    def run(frame, name, mode):
        q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    tumbling = run(continuous.windowed(stream, "ts", "1 minute", "1 hour", "k", "v"), "tumbling", "complete")
    assert {(r.start, r.k, r.n, r.total) for r in tumbling} == {(t(0), "a", 2, 3), (t(60), "a", 2, 8), (t(60), "b", 1, 4)}
    sliding = run(continuous.windowed(stream, "ts", "1 minute", "1 hour", "k", "v", "30 seconds"), "sliding", "complete")
    assert {(r.start, r.n) for r in sliding if r.k == "a"} == {(t(-30), 1), (t(0), 2), (t(30), 3), (t(60), 2)}
    assert len(run(continuous.first_contents(stream, ["k", "v"], "ts"), "contents", "append")) == 4


def test_retention(spark):
    items = spark.createDataFrame([(1, "s", datetime.datetime(2024, 1, 1), 10, "x"), (2, "s", datetime.datetime(2024, 1, 9), 10, "y"), (3, "t", datetime.datetime(2024, 1, 1), 10, "z")], "item_id int, source_id string, captured_at timestamp, retention_days int, content string")
    policies = spark.createDataFrame([("s", 5)], "source_id string, retention_days int")
    kept, stones = sinks.purge(items, policies, datetime.date(2024, 1, 8))
    assert {r.item_id: r.content for r in kept.collect()} == {1: None, 2: "y", 3: "z"}
    assert [(r.item_id, r.reason) for r in stones.collect()] == [(1, "retention")]


def test_every_header_is_compared(spark, tmp_path):
    from pyspark.sql.types import IntegerType, StringType, StructType

    schema = StructType().add("a", IntegerType()).add("b", StringType())
    (tmp_path / "1.csv").write_text("a,b\n1,x\n")
    (tmp_path / "2.csv").write_text("a,b\n2,y\n")
    assert sorted((r.a, r.b) for r in files.csv_exact(spark, str(tmp_path), schema).collect()) == [(1, "x"), (2, "y")]
    (tmp_path / "3.csv").write_text("b,a\n20,10\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.csv_exact(spark, str(tmp_path), schema).collect()
