"""Declared formats, frozen results, stored parameters and nearest passages against plain versions."""

import datetime
import random
import shutil

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import replay
from tidemark.sources import formats, store

FORM = formats.Format(
    "players",
    (formats.Field("Id", "id", "whole", True), formats.Field("Name", "name"), formats.Field("Own %", "own", "number", False, 0.0, 100.0), formats.Field("At", "at", "instant")),
    (("site", "x"),),
)


@pytest.mark.parametrize("split", [1 << 20, 64, 7])
def test_a_file_is_read_in_ranges(spark, tmp_path, split):
    formats.declare(FORM)
    rng = random.Random(split)
    lines, wanted = ["﻿Id,Name,Own %,At\r\n"], []
    for i in range(300):
        name = rng.choice(["Ann", '"Smith, Jo"', "Zoë", "", '"a ""b"""'])
        plain = {"": None, '"Smith, Jo"': "Smith, Jo", '"a ""b"""': 'a "b"'}.get(name, name)
        kind = rng.randint(0, 9)
        own, why = {0: ("x", "own is no number"), 1: ("101", "own is out of bounds"), 2: ("nan", "own is out of bounds")}.get(kind, ("12.5", None))
        lines.append(f"{i},{name},{own},2024-01-02T03:04:05\r\n" if kind != 3 else f"{i},{name}\n")
        wanted.append((i, plain, None if why else 12.5, (why,) if why else ()) if kind != 3 else (None, None, None, ("2 columns",)))
        lines += ["\n"] if kind == 4 else []
    lines += [",late,1,\n", "7,q,1,yesterday\n", '8,"open,1,\n', "9,end,,"]
    wanted += [(None, "late", 1.0, ("id is empty",)), (7, "q", 1.0, ("at is no instant",)), (None, None, None, ("not readable: Error",)), (9, "end", None, ())]
    (tmp_path / "a.csv").write_bytes("".join(lines).encode())
    (tmp_path / "b.csv").write_text("Id,Name,Own %,At\n")
    (tmp_path / "_c").write_text("other")
    got = formats.read_format(spark, "players", str(tmp_path), split).collect()
    assert sorted(map(repr, ((r.id, r.name, r.own, tuple(r._reasons)) for r in got))) == sorted(map(repr, wanted))
    assert len({r._offset for r in got}) == len(got) and {r.site for r in got} == {"x"}
    assert {r["at"] for r in got} <= {None, datetime.datetime(2024, 1, 2, 3, 4, 5)}
    if split == 64:
        assert formats.read_format(spark, "players", str(tmp_path), split).rdd.getNumPartitions() > 50
    for head, why in (("Name,Id,Own %,At", "order"), ("Id,Name,Own,At", "missing"), ("", "missing")):
        (tmp_path / "d.csv").write_text(head + "\n1,a,2,\n")
        with pytest.raises(Exception, match=why):
            formats.read_format(spark, "players", str(tmp_path), split).collect()
    with pytest.raises(ValueError):
        formats.declare(formats.Format("players", FORM.fields))


def test_files_that_come_are_streamed_once(spark, tmp_path):
    formats.declare(FORM)
    head, seen = "Id,Name,Own %,At\n", []
    (tmp_path / "in").mkdir()
    query = None
    for n in range(3):
        (tmp_path / f"in/{n}.csv").write_text(head + f"{n},a,1,\n{n + 10},b,x,\n")
        stream = formats.stream_format(spark, "players", str(tmp_path / "in"), 16)
        query = stream.select("id", F.size("_reasons").alias("why")).writeStream.foreachBatch(lambda df, _: seen.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
        query.processAllAvailable()
        query.stop()
    assert sorted(seen) == sorted((i, w) for n in range(3) for i, w in ((n, 0), (n + 10, 1)))


@pytest.mark.parametrize("rows", [4096, 3])
def test_replay_names_what_differs(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(replay, "RANGE_ROWS", rows)
    base = [(i, "k" if i % 3 else None, i * 0.5, None if i % 7 == 0 else f"v{i}") for i in range(900)] + [(5, "k", 9.0, "twice")]
    df = spark.createDataFrame(base, "a int, b string, x double, y string")
    path = str(tmp_path / "frozen")
    root = replay.freeze(df, ["a", "b"], path)
    same = replay.replay(df.repartition(7).select("y", "x", "b", "a"), path)
    assert same.reproduced and same.now == root and same.differences.count() == 0 and same.first_range() is None
    for now, wanted in (
        ([r for r in base if r[0] != 44], {(44, "k", "lost")}),
        ([*base, (5000, None, 1.0, None)], {(5000, None, "added")}),
        ([(r[0], r[1], r[2] + (r[0] == 7), r[3]) for r in base], {(7, "k", "changed")}),
        ([r for r in base if r[3] != "twice"], {(5, "k", "changed")}),
        ([(r[0], r[1], r[2], "" if r[3] is None and r[0] == 14 else r[3]) for r in base], {(14, "k", "changed")}),
        ([(r[0], "z" if r[0] == 3 else r[1], r[2], r[3]) for r in base], {(3, None, "lost"), (3, "z", "added")}),
        ([], {(r[0], r[1], "lost") for r in base}),
    ):
        found = replay.replay(spark.createDataFrame(now, df.schema), path)
        assert {(r.a, r.b, r.state) for r in found.differences.collect()} == wanted and not found.reproduced
        assert found.first_range() == min(r.range for r in found.differences.collect())
    with pytest.raises(ValueError, match="columns"):
        replay.replay(df.drop("y"), path)
    # a store that was changed is refused
    other = str(tmp_path / "other")
    shutil.copytree(path, other)
    shutil.rmtree(f"{other}/rows")
    spark.read.parquet(f"{path}/rows").where("a <> 9").write.parquet(f"{other}/rows")
    with pytest.raises(ValueError, match="frozen"):
        replay.replay(df, other)
    empty = str(tmp_path / "empty")
    replay.freeze(df.limit(0), ["a", "b"], empty)
    assert replay.replay(df.limit(0), empty).reproduced and replay.replay(df, empty).differences.where("state = 'added'").count() == 900


def test_parameters_are_stored_once(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([("a", 1.5, None), ("b", 1.5, "x"), ("c", 0.1 + 0.2, "x"), ("d", 0.1 + 0.2, "x")], "who string, p double, q string")
    kept = store.put(df, path, ["p", "q"])
    assert kept.count() == 4 and spark.read.parquet(path).count() == 3
    store.put(df, path, ["p", "q"])
    assert spark.read.parquet(path).count() == 3
    found = kept.join(store.get(spark, path, kept).withColumnRenamed("p", "p2"), "digest")
    assert found.where("p = p2").count() == 4
    with pytest.raises(ValueError):
        store.get(spark, path, spark.createDataFrame([("0" * 64,)], "digest string"))
    other = str(tmp_path / "tampered")
    spark.read.parquet(path).withColumn("p", F.when(F.col("q").isNull(), 9.0).otherwise(F.col("p"))).write.parquet(other)
    with pytest.raises(ValueError, match="changed"):
        store.get(spark, other, kept)
    assert store.get(spark, other, kept.where("q = 'x'")).count() == 2


def test_captures_append_what_changed(spark, tmp_path):
    import hashlib

    from tidemark.sources import captures

    formats.declare(formats.Format("salaries", (formats.Field("Id", "ext", required=True), formats.Field("Slate", "slate"), formats.Field("Pay", "pay", "whole", True, 1))))
    cross, path = [("a", 1), ("b", 2), ("c", 3), ("d", 4), ("d", 5)], str(tmp_path / "history")

    def load(n, rows, day, crosswalk=cross, spoil=False):
        folder = tmp_path / f"capture{n}"
        folder.mkdir()
        (folder / "s.csv").write_text("Id,Slate,Pay\n" + "".join(f"{i},{s},{p}\n" for i, s, p in rows))
        data = (folder / "s.csv").read_bytes()
        manifest = spark.createDataFrame([("s.csv", len(data), hashlib.sha256(data).hexdigest())], "path string, size long, sha256 string")
        if spoil:
            (folder / "s.csv").write_text("Id,Slate,Pay\n")
        given = spark.createDataFrame(crosswalk, "external string, entity int")
        return captures.load_capture(spark, str(folder), manifest, "salaries", path, F.col("slate"), "ext", given, ["pay"], f"2024-01-{day:02d}")

    history = lambda: sorted((r.group, r.entity, r.pay, r.observed_at.day) for r in spark.read.parquet(path).collect())
    first = [("a", "main", 10), ("b", "main", 20), ("c", "late", 30), ("a", "late", 5), ("d", "odd", 1), ("b", "odd", 2), ("a", "main", 0)]
    found = load(1, first, 5)
    assert (found.seen, found.rejected.count(), found.appended, found.unchanged) == (7, 1, 4, 0)
    assert [tuple(r) for r in found.held.collect()] == [("odd", "several entities")]
    once = history()
    assert once == [("late", 1, 5, 5), ("late", 3, 30, 5), ("main", 1, 10, 5), ("main", 2, 20, 5)]
    again = load(2, first, 5)
    assert (again.appended, again.unchanged) == (0, 4) and history() == once
    later = load(3, first, 6)
    assert (later.appended, later.unchanged) == (0, 4) and history() == once
    moved = load(4, [("a", "main", 11), ("b", "main", 20)], 7)
    assert (moved.appended, moved.unchanged) == (1, 1) and history() == sorted([*once, ("main", 1, 11, 7)])
    back = load(5, [("a", "main", 10)], 8)  # to what it was before: a change too
    assert back.appended == 1 and load(6, [("a", "main", 12)], 6).appended == 1  # an earlier one that was not known
    assert sorted(load(7, [("zz", "main", 9), ("a", "main", 9), ("a", "dup", 1), ("a", "dup", 2), ("c", None, 4)], 9).held.collect()) == [("dup", "an entity twice"), ("main", "unknown id")]
    assert load(8, [("d", "odd", 1), ("b", "odd", 2)], 9, [("d", 4), ("b", 2)]).appended == 2
    with pytest.raises(ValueError, match="manifest"):
        load(9, first, 10, spoil=True)


def test_nearest_passage_is_that_of_all_windows():
    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
        return row[-1]

    def plain(t, q):
        n, m = len(t), len(q)
        if not n or not m:
            return 0, 0, float(n == m)
        k = min(n, m)
        windows = {(a, a + k) for a in range(n - k + 1)} | {(0, e) for e in range(1, k)} | {(a, n) for a in range(n - k + 1, n)}
        return max(((2 * common(q, t[a:b]) / (b - a + m), -a, b - a, b) for a, b in windows), key=lambda w: w[:3])

    rng = random.Random(3)
    for _ in range(500):
        t = "".join(rng.choice("abcé 𝒳") for _ in range(rng.randint(0, 40)))
        q = "".join(rng.choice("abcé 𝒳") for _ in range(rng.randint(0, 14))) if rng.random() < 0.5 else t[3:15].replace("a", "")
        begin, end, similarity = text.nearest_passage(t, q)
        wanted = plain(t, q)
        assert (similarity, begin, end) == ((wanted[0], -wanted[1], wanted[3]) if len(wanted) == 4 else (wanted[2], 0, 0))
    long = "the quick brown fox jumps over the lazy dog. " * 2000 + "a singular remark about zebras" + " and so on" * 3000
    begin, end, similarity = text.nearest_passage(long, "a singlar remark abot zebras")
    assert similarity > 0.9 and "remark about zeb" in long[begin:end]


def test_nearest_turns(spark):
    from conftest import SF
    from tidemark.plans.catalogue import QUERIES

    texts = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    got = QUERIES["nearest_turns"](spark, SF).collect()
    assert {(r.conv_id, r.turn) for r in got} == set(texts)
    for r in got[:60]:
        t = texts[r.conv_id, r.turn]
        if t is not None:
            q = t[10:50].replace("a", "").replace("o", "")
            assert (r.begin, r.end, r.similarity) == (*(w := text.nearest_passage(t, q))[:2], round(w[2], 6))
    nothing = spark.createDataFrame([(None, "a"), ("a", None), ("", "")], "t string, q string").select(text.nearest(F.col("t"), F.col("q")).alias("p")).collect()
    assert [r.p.similarity for r in nothing] == [None, None, 1.0]
