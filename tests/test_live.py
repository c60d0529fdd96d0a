import datetime as dt
import glob
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators import places
from brindle.streaming import keyed, limits, live


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


EVENTS = [(1, 7, at(0)), (2, 7, at(1)), (3, 7, at(2)), (4, 7, at(11)), (5, 8, at(0)), (6, 7, at(11))]


def test_rate_limit(spark):
    df = spark.createDataFrame(EVENTS, "event_id long, user_id long, ts timestamp")
    got = {r["event_id"]: r["allowed"] for r in limits.sliding_limit(df, "user_id", "ts", 2, 10).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True, 6: True}


def test_rate_limit_stream(spark, tmp_path):
    spark.createDataFrame(EVENTS, "event_id long, user_id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, user_id long, ts timestamp").parquet(str(tmp_path / "in"))
    q = limits.limit_stream(stream, "user_id", "ts", 2, 10).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r["event_id"]: r["allowed"] for r in spark.table("limited").collect()} == {1: True, 2: True, 3: False, 4: True, 5: True, 6: True}


def in_batches(spark, tmp_path, batches, schema, change):
    """Rows out, and the number of keys with state after each micro-batch."""
    path, states, out = str(tmp_path / "in"), [], str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        q = change(spark.readStream.schema(schema).parquet(path)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        states.append(sum(o["numRowsTotal"] for o in json.loads(q.lastProgress.json)["stateOperators"]))
        q.stop()
    return spark.read.parquet(out), states


def test_limits_on_a_stream_equal_those_on_a_table_and_forget(spark, tmp_path):
    rng, t, rows = random.Random(6), 0, []
    for i in range(300):
        t += rng.choice([0, 1, 3])
        rows.append((i, rng.randrange(5), at(t), "x"))
    rows += [(1000, 99, at(t + 10_000), "x")]
    schema = "event_id long, user_id long, ts timestamp, other string"
    got, states = in_batches(spark, tmp_path, [rows[:100], rows[100:220], rows[220:300], rows[300:]], schema, lambda s: limits.limit_stream(s, "user_id", "ts", 2, 10))
    want = limits.sliding_limit(spark.createDataFrame(rows, schema), "user_id", "ts", 2, 10)
    assert sorted(r[:] for r in got.select(*want.columns).collect()) == sorted(r[:] for r in want.collect())
    assert {r["allowed"] for r in got.collect()} == {True, False}
    assert states[2] > states[3]  # five keys have fallen silent


def test_meter_on_a_stream_equals_the_one_on_a_table_and_forgets(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.randrange(4), i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i), rng.randrange(1, 5)) for i in range(200)]
    rows += [(99, 1000, dt.datetime(2025, 1, 1), 1)]
    schema = "user_id long, seq long, ts timestamp, calls long"
    got, states = in_batches(spark, tmp_path, [rows[:90], rows[90:200], rows[200:]], schema, lambda s: limits.meter_stream(s, 7, 60))
    want = limits.metered(spark.createDataFrame(rows, schema).withColumn("day", F.to_date("ts")), 7, 60).drop("day")
    assert sorted(r[:] for r in got.select(*want.columns).collect()) == sorted(r[:] for r in want.collect())
    assert {r["charged"] for r in got.collect()} == {True, False} and states[1] > states[2]


def test_meter(spark):
    rows = [(1, 1, dt.date(2024, 1, 1), 3), (1, 2, dt.date(2024, 1, 1), 3), (1, 3, dt.date(2024, 1, 1), 2), (1, 4, dt.date(2024, 1, 2), 4), (1, 5, dt.date(2024, 2, 1), 5)]
    got = {r["seq"]: r["charged"] for r in limits.metered(spark.createDataFrame(rows, "user_id long, seq long, day date, calls long"), 5, 8).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True}


def changed(spark, path, before):
    """Files of the table that were not there before."""
    return {f for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)} - before


def test_keyed_table_from_a_stream(spark, tmp_path):
    schema, new, path = "k string, o long, v string", [], str(tmp_path / "table")
    batches = [[("a", 1, "x"), ("b", 1, "y"), (None, 1, "n")], [("b", 2, "z"), ("c", 2, "w"), ("b", 1, "late")], [("b", 0, "newer batch")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = keyed.keep_current(stream, path, "k", "o", str(tmp_path / "cp"), lambda df: new.append(sorted(map(str, (r["k"] for r in df.collect())))), "0 seconds", buckets=4)
        q.processAllAvailable()
        q.stop()
    table = keyed.KeyedTable(spark, path, "k", "o")
    assert sorted((r[:] for r in table.read().collect()), key=str) == [("a", 1, "x"), ("b", 0, "newer batch"), ("c", 2, "w"), (None, 1, "n")]
    assert new == [["None", "a", "b"], ["c"], []] and table.version == 3
    assert sorted(r["v"] for r in table.read(2).collect()) == ["n", "w", "x", "z"]


def test_keyed_table_touches_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = T._parse_datatype_string("k long, o long, v long")
    table = keyed.KeyedTable(spark, path, "k", "o", schema, buckets=8, most=3, keep=2)
    want = {}
    for n in range(9):
        rows = [(k, n, n * 1000 + k) for k in (range(200) if n == 0 else [5, 1000 + n])]
        before = set(glob.glob(f"{path}/data/**/*.parquet", recursive=True))
        assert table.apply(spark.createDataFrame(rows, schema), n)
        want |= {k: v for k, _, v in rows}
        if n:
            files = table._state()["files"]
            hit = {str(r[0]) for r in spark.createDataFrame([(5,), (1000 + n,)], "k long").select(table._bucket(8)).collect()}
            assert {f.split("_bucket=")[1].split("/")[0] for f in changed(spark, path, before)} <= hit
            assert max(map(len, files.values())) <= 3
    assert {r["k"]: r["v"] for r in table.read().collect()} == want and table.read().count() == len(want)
    base = [f for f in table._state()["files"].values() if len(f) == 1 and "step=000000000001-" in f[0]]
    assert base  # buckets that no later batch touched still stand on the first batch's files


def test_keyed_table_takes_a_batch_once(spark, tmp_path):
    path, schema = str(tmp_path / "t"), T._parse_datatype_string("k long, o long")
    table = keyed.KeyedTable(spark, path, "k", "o", schema, buckets=2)
    assert table.read().count() == 0
    assert table.apply(spark.createDataFrame([(1, 1)], schema), 0) and table.apply(spark.createDataFrame([(1, 2)], schema), 1)
    files = sorted(glob.glob(f"{path}/**/*", recursive=True))
    assert not table.apply(spark.createDataFrame([(1, 1), (2, 9)], schema), 0) and not table.apply(spark.createDataFrame([(1, 2)], schema), 1)
    assert sorted(glob.glob(f"{path}/**/*", recursive=True)) == files and [r[:] for r in table.read().collect()] == [(1, 2)]
    assert table.apply(spark.createDataFrame([], schema), 2) and table.read().count() == 1
    with pytest.raises(ValueError, match="kept by"):
        keyed.KeyedTable(spark, path, "o", "k")
    with pytest.raises(ValueError, match="no table"):
        keyed.KeyedTable(spark, str(tmp_path / "none"), "k", "o")


def test_keyed_table_after_a_write_that_failed(spark, tmp_path):
    path, schema = str(tmp_path / "t"), T._parse_datatype_string("k long, o long")
    table = keyed.KeyedTable(spark, path, "k", "o", schema, buckets=2)
    table.apply(spark.createDataFrame([(1, 1)], schema), 0)

    def lost(df):
        raise RuntimeError("lost before the commit")

    with pytest.raises(RuntimeError):
        table.apply(spark.createDataFrame([(1, 5), (2, 5)], schema), 1, lost)
    assert [r[:] for r in table.read().collect()] == [(1, 1)]
    assert table.apply(spark.createDataFrame([(1, 5), (2, 5)], schema), 1)
    assert sorted(r[:] for r in table.read().collect()) == [(1, 5), (2, 5)] and len(glob.glob(f"{path}/data/*")) == 2


def test_replay(spark):
    df = spark.createDataFrame([("j", 1, "run"), ("j", 2, "done"), ("j", 3, "run"), ("i", 1, "run"), ("i", 2, "run")], "k string, o int, s string")
    assert {r["k"]: r["s"] for r in live.final_status(df, "k", "o", "s", ["done"]).collect()} == {"j": "done", "i": "run"}
    assert live.without_repeats(df, "k", "o", "s").count() == 4
    thin = spark.createDataFrame([([0.0, 1.0, 2.0, 3.5, 20.0],)], "t array<double>").select(live.thinned(F.col("t"), 2.0)).first()[0]
    assert thin == [0.0, 2.0, 20.0]


def test_places(spark):
    area = spark.createDataFrame([("a", 0.0, 0.0, 0.2, 0.2)], "area string, low_lat double, low_lng double, high_lat double, high_lng double")
    assert places.tiles(area, 12).count() == 4
    r = spark.range(1).select(places.trust_score(F.lit("x.gov.in"), F.lit(0.5)).alias("a"), places.trust_score(F.lit("blog.x.com"), F.lit(0.5)).alias("b"), places.equal_weights(F.array(F.lit("A"), F.lit("a"), F.lit("b"))).alias("w")).first()
    assert (round(r["a"], 2), round(r["b"], 2)) == (0.65, 0.2) and [(x["tag"], x["weight"]) for x in r["w"]] == [("a", 0.5), ("b", 0.5)]


def test_thinned_rows_and_the_gate(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate([0.0, 1.0, 2.0, 3.5, 20.0, 20.5])] + [(2, 9, 5.0)], "k int, i int, t double")
    got = {(r["k"], r["i"]) for r in live.thinned_rows(df, "k", "t", "i", 2.0).filter("shown").collect()}
    assert got == {(1, 0), (1, 2), (1, 4), (1, 5), (2, 9)}
    rows = [
        (1, "begin", None, "a"), (2, "frame", None, None), (3, "begin", None, "b"), (4, "finish", 1, "a"), (5, "frame", None, None), (6, "finish", 2, "b"),  # the first snapshot was overtaken; the second takes both frames
        (7, "frame", None, None), (8, "begin", None, "a"), (9, "finish", 3, "b"), (10, "frame", None, None),  # the view has changed: what was buffered is forgotten
        (11, "begin", None, "b"), (12, "reset", None, None), (13, "finish", 4, "b"), (14, "frame", None, None), (15, "begin", None, "c"), (16, "frame", None, None), (17, "finish", 6, "c"), (18, "frame", None, None),
    ]
    gate = live.gated(spark.createDataFrame([("u", *r) for r in rows], "who string, n int, kind string, gen int, view string"), "who", "n", "kind", "gen", "view")
    assert {r["n"]: r["accepted"] for r in gate.filter("kind = 'finish'").collect()} == {4: False, 6: True, 9: False, 13: False, 17: True}
    assert sorted((r["n"], r["published_by"]) for r in live.published(gate, "who", "n", "kind").collect()) == [(2, 6), (5, 6), (14, 17), (16, 17)]
