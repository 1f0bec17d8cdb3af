"""Streams fed in several files: shares held in state, sliding windows, sessions with late events, restarts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from textloom.sources import readers
from textloom.streaming import streams as ST

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"
BEGIN = datetime(2024, 1, 1)


def feed(spark, folder, rows, number):
    """One more file of events; files are read in the order of their times."""
    import os

    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    for name in os.listdir(folder):
        path = os.path.join(folder, name)
        if name.startswith("part-") and path not in feed.seen:
            feed.seen.add(path)
            os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))


feed.seen = set()


def source(spark, folder):
    schema = spark.createDataFrame([], SCHEMA).schema
    return ST.read_files(spark, folder, schema)


def event(i, minutes, user=1, kind="a"):
    return (i, BEGIN + timedelta(minutes=minutes), user, kind)


def test_shares_hold_across_batches_and_restarts(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    rnd = random.Random(1)
    rows = [event(i, i, i, rnd.choice("aaaab")) for i in range(230)]
    at = 0
    with ST.state_store(spark):
        for number, size in enumerate((3, 40, 1, 100, 86)):
            feed(spark, folder, rows[at : at + size], number)
            at += size
            if number in (1, 2, 4):  # the stream is started anew from its checkpoint
                got = ST.run_to_table(ST.split_stream(source(spark, folder), "event_type", "0.3"), "split", out)
                assert got.count() == at and got.select("event_id").distinct().count() == at
                for r in got.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "dev").alias("dev")).collect():
                    assert r["dev"] == r["n"] * 3 // 10
        lanes = ST.run_to_table(ST.split_stream(source(spark, folder), "event_type", 0.3, "event_id", lanes=3), "lanes", out)
        for r in lanes.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "dev").alias("dev")).collect():
            assert r["n"] * 0.3 - 3 <= r["dev"] <= r["n"] * 0.3
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "x").find("RocksDB") < 0


def test_sessions_with_late_events(spark, tmp_path):
    folder = str(tmp_path / "in")
    feed(spark, folder, [event(1, 0), event(2, 10), event(3, 60), event(4, 0, 2)], 1)
    feed(spark, folder, [event(5, 35), event(6, 90, 2)], 2)  # 35 joins the sessions of minutes 0-10 and 60
    feed(spark, folder, [event(7, 400)], 3)
    feed(spark, folder, [event(9, 900)], 4)
    feed(spark, folder, [event(8, 20, 2)], 5)  # beyond the watermark, which a batch takes from the ones before the last
    feed(spark, folder, [event(10, 901)], 6)
    got = ST.run_to_table(ST.sessions(source(spark, folder), "ts", "user_id", "30 minutes", "1 hour"), "sessions", str(tmp_path / "out"))
    minutes = lambda t: int((t - BEGIN).total_seconds() // 60)
    found = sorted((r["user_id"], minutes(r["s_start"]), minutes(r["s_end"]), r["n"]) for r in got.collect())
    assert found == [(1, 0, 90, 4), (1, 400, 430, 1), (2, 0, 30, 1), (2, 90, 120, 1)]


def test_sliding_windows_with_late_events(spark, tmp_path):
    folder = str(tmp_path / "in")
    rnd = random.Random(2)
    rows = [event(i, rnd.randrange(600), 1, rnd.choice("ab")) for i in range(200)]
    rows.sort(key=lambda r: r[1] + timedelta(minutes=rnd.randrange(60)))  # up to an hour late
    for k in range(5):
        feed(spark, folder, rows[40 * k : 40 * k + 40], k + 1)
    feed(spark, folder, [event(900, 5000, 1, "c")], 6)
    feed(spark, folder, [event(901, 5001, 1, "c")], 7)
    feed(spark, folder, [event(902, 3, 1, "a")], 8)  # beyond the watermark
    got = ST.run_to_table(ST.sliding(source(spark, folder), "ts", "2 hours", "30 minutes", ["event_type"], "70 minutes"), "sliding", str(tmp_path / "out"))
    want = {}
    for _, ts, _, kind in rows:
        first = BEGIN + timedelta(minutes=30 * ((ts - BEGIN) // timedelta(minutes=30)))
        for k in range(4):
            at = first - timedelta(minutes=30 * k)
            want[at, at + timedelta(hours=2), kind] = want.get((at, at + timedelta(hours=2), kind), 0) + 1
    assert {(r["w_start"], r["w_end"], r["event_type"]): r["n"] for r in got.collect()} == want


def test_first_seen_drops_repeats(spark, tmp_path):
    folder = str(tmp_path / "in")
    feed(spark, folder, [event(1, 0), event(2, 1), event(1, 2)], 1)
    feed(spark, folder, [event(2, 3), event(3, 4)], 2)
    got = ST.run_to_table(ST.first_seen(source(spark, folder), "ts", ["event_id"], "1 day"), "dedup", str(tmp_path / "out"))
    assert sorted(r["event_id"] for r in got.collect()) == [1, 2, 3]


def test_small_batches_are_passed_over(spark, tmp_path):
    folder = str(tmp_path / "in")
    feed(spark, folder, [event(i, i) for i in range(9)], 1)
    feed(spark, folder, [event(10, 10)], 2)
    ST.in_micro_batches(ST.prepare(source(spark, folder), lambda df: df.withColumn("x", F.col("event_id") * 2)), lambda b: b.orderBy("event_id"), str(tmp_path / "out"), str(tmp_path / "state"), least_rows=2)
    assert sorted(r["x"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2 * i for i in range(9)]


@pytest.mark.parametrize("split", [40, 128, 10_000])
def test_groups_over_many_splits_of_a_file(spark, tmp_path, split):
    rnd = random.Random(3)
    docs = [[f"s{i} {j} " + "x" * rnd.randrange(30) for j in range(rnd.randrange(1, 5))] for i in range(30)]
    docs[7] = ["long " * 100]
    (tmp_path / "docs.txt").write_text("\n\n".join("\n".join(s) for s in docs) + "\n")
    (tmp_path / "tags.txt").write_text("-DOCSTART- O\n\n# note\n" + "\n\n".join("\n".join(f"{w} T{j}" for j, w in enumerate(s[0].split())) for s in docs) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        found = readers.read_documents(spark, str(tmp_path / "docs.txt"))
        got = [r["sentences"] for r in sorted(found.collect(), key=lambda r: r["doc"])]
        tagged = [(r["tokens"], r["tags"]) for r in sorted(readers.read_tagged(spark, str(tmp_path / "tags.txt")).collect(), key=lambda r: r["sentence"])]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert got == [[s.strip() for s in d] for d in docs]
    assert tagged == [(d[0].split(), [f"T{j}" for j in range(len(d[0].split()))]) for d in docs]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "file" in plan
