"""Steps of papers from a stream in any order against a whole table, restarts, late rows, sessions and stage times."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmine.sources.sinks import STEPS
from quillmine.streaming import status

CHANGES = "id long, ts timestamp, status string"
T0 = datetime.datetime(2024, 1, 1)
STUCK = 3600


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def drawn(seed=1, papers=12, n=900):
    rng = random.Random(seed)
    kinds = ["pending", "processing", "processing", "processing", "completed", "failed", "other"]
    out = [(rng.randrange(papers), at(rng.randrange(40_000) // 7 * 7), rng.choice(kinds)) for _ in range(n)]
    return out + out[:60]  # repeated


def plain(changes, until):
    out = []
    for i in {c[0] for c in changes}:
        now, last = "pending", None
        own = sorted((t, s) for j, t, s in changes if j == i)
        for t, s in [*own, (None, None)]:
            end = t or until + datetime.timedelta(microseconds=1)
            if now == "processing" and (end - last).total_seconds() > STUCK:
                out.append((i, last + datetime.timedelta(seconds=STUCK), now, "failed"))
                now = "failed"
            if t and s in STEPS.get(now, ()):
                out.append((i, t, now, s))
                now = s
            last = t or last
    return sorted(out)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("block", [500_000, 40, 5])
def test_steps_of_a_table(spark, block):
    """Blocks of few changes cut every paper; the log is the same."""
    changes = drawn()
    df = spark.createDataFrame(changes, CHANGES).repartition(5)
    assert rows(status.transitions(df, STUCK, block=block)) == plain(changes, max(c[1] for c in changes))
    assert rows(status.transitions(df, STUCK, until=at(90_000), block=block)) == plain(changes, at(90_000))


def test_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, None, "processing"), (None, T0, "processing"), (1, T0, None), (2, T0, "processing")], CHANGES)
    assert rows(status.transitions(df, STUCK)) == [(2, T0, "pending", "processing")]
    assert rows(status.transitions(df.limit(0), STUCK)) == []
    last = status.last_steps(status.transitions(df, STUCK, until=at(9999))).collect()
    assert [tuple(r) for r in last] == [(2, "failed", at(3600))]


def run(spark, folder, step, tmp, schema=CHANGES):
    """All files that are there, one a batch; each batch's rows go to a folder of its number, so a batch that comes again counts once."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{tmp}/out/batch={number}")
    q = step(source).writeStream.outputMode("append").option("checkpointLocation", f"{tmp}/ck").foreachBatch(write).start()
    q.processAllAvailable()
    q.stop()


def put(spark, folder, number, some, schema=CHANGES):
    spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{folder}/n={number:04d}")
    import glob
    import os
    import time

    for f in glob.glob(f"{folder}/n={number:04d}/*.parquet"):
        os.utime(f, (time.time() + number, time.time() + number))


def test_stream_is_the_table(spark, tmp_path):
    """Changes come out of order, some twice, in nine files; the stream stops after the fifth and goes on from its checkpoint."""
    changes = drawn(2, 8, 400)
    rng = random.Random(3)
    order = sorted(changes, key=lambda c: c[1] + datetime.timedelta(seconds=rng.randrange(5000)))
    step = lambda s: status.transition_stream(s, STUCK, "2 hours")
    size = -(-len(order) // 7)
    files = [order[i : i + size] for i in range(0, len(order), size)]
    for i, f in enumerate(files[:5]):
        put(spark, tmp_path / "in", i, f)
    run(spark, tmp_path / "in", step, tmp_path)
    half = spark.read.parquet(f"{tmp_path}/out").count()
    for i, f in enumerate([*files[5:], [(99, at(200_000), "other")], [(99, at(200_001), "other"), (1, at(5), "processing")]], 5):  # the last is too late
        put(spark, tmp_path / "in", i, f)
    run(spark, tmp_path / "in", step, tmp_path)
    got = rows(spark.read.parquet(f"{tmp_path}/out").drop("batch"))
    assert 0 < half < len(got) and got == plain(changes, at(190_000))


def test_sessions(spark, tmp_path):
    rng = random.Random(4)
    events = [(rng.randrange(3), at(rng.randrange(200_000))) for _ in range(120)]
    df = spark.createDataFrame([*events, (7, None)], "key long, ts timestamp")
    want = []
    for k in range(3):
        times = sorted(t for j, t in events if j == k)
        start, n, before = times[0], 0, times[0]
        for t in [*times, at(10**7)]:
            if (t - before).total_seconds() >= 7200:
                want.append((k, start, before + datetime.timedelta(hours=2), n))
                start, n = t, 0
            n, before = n + 1, t
    assert rows(status.sessions(df)) == sorted(want)
    ordered = sorted(events, key=lambda e: e[1] + datetime.timedelta(seconds=rng.randrange(3000)))
    for i in range(3):
        put(spark, tmp_path / "in", i, ordered[40 * i : 40 * i + 40], "key long, ts timestamp")
    put(spark, tmp_path / "in", 3, [(50, at(10**6))], "key long, ts timestamp")
    put(spark, tmp_path / "in", 4, [(50, at(10**6 + 1)), (0, at(100))], "key long, ts timestamp")  # one is late
    run(spark, tmp_path / "in", lambda s: status.sessions(s), tmp_path, "key long, ts timestamp")
    assert rows(spark.read.parquet(f"{tmp_path}/out").drop("batch")) == sorted(want)


def test_stage_times_of_streams(spark, tmp_path):
    rng = random.Random(5)
    a = [(i, rng.randrange(5), at(rng.randrange(50_000))) for i in range(60)]
    b = [(100 + i, rng.randrange(5), at(rng.randrange(50_000))) for i in range(60)]
    starts, ends = "start_id long, key long, ts timestamp", "end_id long, key long, ts timestamp"
    whole = status.stage_times(spark.createDataFrame(a, starts), spark.createDataFrame(b, ends))
    want = []
    for i, k, t in a:
        hit = [(i, k, t, j, (u - t).total_seconds()) for j, m, u in b if m == k and 0 <= (u - t).total_seconds() <= 3600]
        want += hit or [(i, k, t, None, None)]
    key = lambda r: repr(r)
    assert sorted(map(tuple, whole.collect()), key=key) == sorted(want, key=key)
    for name, some, schema in (("a", a, starts), ("b", b, ends)):
        ordered = sorted(some, key=lambda e: e[2])
        for i in range(2):
            put(spark, tmp_path / name, i, ordered[30 * i : 30 * i + 30], schema)
        put(spark, tmp_path / name, 2, [(1000, 77, at(10**6))], schema)
        put(spark, tmp_path / name, 3, [(1001, 78, at(2 * 10**6))], schema)
    second = spark.readStream.schema(ends).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "b"))
    run(spark, tmp_path / "a", lambda s: status.stage_times(s, second), tmp_path, starts)
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").drop("batch").collect() if r["start_id"] < 1000]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_fold_is_small():
    assert status._fold("pending", None, iter([(0, "processing"), (5, "completed"), (6, "completed")]), 10, taken := []) == ("completed", 6)
    assert [t[0] for t in taken] == [0, 5]
    assert status._log(3, []).empty and isinstance(status._log(3, taken), pd.DataFrame)


def test_plan_has_no_cross_join(spark):
    df = spark.createDataFrame(drawn(), CHANGES)
    plan = status.transitions(df, STUCK, block=50)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert status.sessions(df.select(F.col("id").alias("key"), "ts")).columns == ["key", "start", "end", "n"]
