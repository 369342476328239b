"""Status of papers as a log of steps, from a stream of changes that come late, twice or in any order, or from a whole table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillmine.sources.sinks import STEPS

#: Where a paper begins, and the step that is taken when nothing is heard of it for long.
FIRST, BUSY, STUCK = "pending", "processing", "failed"
#: Changes of one paper that one task folds; papers with more are cut into blocks of time.
BLOCK = 500_000

LOG = "id long, ts timestamp, before string, after string"
_STATE = "now string, last long, times array<long>, statuses array<string>"


def _fold(now: str, last: int | None, changes: Iterator[tuple[int, str]], stuck: int, taken: list | None) -> tuple[str, int | None]:
    """(status, time of the last change) after changes in order; steps go to taken as (time, before, after).

    A paper in processing of which nothing is heard for longer than `stuck` microseconds has failed by then. A change that the status doesn't
    allow, a repeated one among them, is heard but changes nothing.
    """
    for at, status in changes:
        if now == BUSY and last is not None and at - last > stuck:
            if taken is not None:
                taken.append((last + stuck, now, STUCK))
            now = STUCK
        if status in STEPS.get(now, ()):
            if taken is not None:
                taken.append((at, now, status))
            now = status
        last = at
    return now, last


def _log(key: int, taken: list) -> pd.DataFrame:
    t = pd.DataFrame(taken, columns=["ts", "before", "after"])
    return pd.DataFrame({"id": pd.Series([key] * len(t), dtype="int64"), "ts": pd.to_datetime(t["ts"].astype("int64"), unit="us"), "before": t["before"].astype(object), "after": t["after"].astype(object)})


def _whole(changes: DataFrame) -> DataFrame:
    """id, ts, status of the changes that have all three; a time without a zone is taken in the session's."""
    return changes.where("id is not null and ts is not null and status is not null").withColumn("ts", F.col("ts").cast("timestamp"))


def _runs(frames: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple[tuple, list[pd.DataFrame]]]:
    """Runs of rows with equal columns, from sorted rows: key and the frames it stands in."""
    key, held = None, []
    for f in frames:
        for k, g in f.groupby(columns, sort=False):
            if k != key and held:
                yield key, held
                held = []
            key = k
            held.append(g)
    if held:
        yield key, held


def _changes(held: list[pd.DataFrame]) -> Iterator[tuple[int, str]]:
    for g in held:
        yield from zip(g["us"].tolist(), g["status"].tolist(), strict=True)


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """rows with qm_block: 0, or for papers of more than block rows the range of time, among ranges cut at quantiles of theirs."""
    hot = rows.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > block)
    most = hot.agg(F.sum("n")).first()[0]
    if not most:
        return rows.withColumn("qm_block", F.lit(0))
    # A block-th of the rows are hot papers at most.
    marked = rows.join(F.broadcast(hot.select("id", F.lit(True).alias("qm_hot"))), "id", "left")
    n = 2 * -(-most // block)
    cuts = sorted(set(marked.where("qm_hot").approxQuantile("us", [i / n for i in range(1, n)], 1 / (4 * n))))
    place = F.size(F.filter(F.array(*[F.lit(int(c)) for c in cuts]), lambda c: c < F.col("us")))
    return marked.withColumn("qm_block", F.when(F.col("qm_hot"), place).otherwise(0)).drop("qm_hot")


def transitions(changes: DataFrame, stuck_seconds: int, until=None, block: int = BLOCK) -> DataFrame:
    """id, ts, before, after: every step of every paper, from changes (id, ts, status) in any order; equal times go by status.

    until (a timestamp) is when a silent paper is last looked at; without it, the time of the last change of all. Changes
    without id, time or status are left out. Rows of one paper and block are streamed in order of time. What a block makes of
    each status it may begin with comes first, so the blocks of a paper with very many changes are folded side by side.
    """
    spark, stuck = changes.sparkSession, stuck_seconds * 1_000_000
    rows = _whole(changes).select(F.col("id").cast("long").alias("id"), F.unix_micros("ts").alias("us"), "status")
    if until is None:
        until = rows.agg(F.max("us")).first()[0] or 0
    else:
        until = spark.range(1).select(F.unix_micros(F.lit(until).cast("timestamp"))).first()[0]
    cut = _blocks(rows, block)
    ordered = lambda df: df.repartition("id", "qm_block").sortWithinPartitions("id", "qm_block", "us", "status")
    begins = sorted(STEPS)

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (key, at), held in _runs(frames, ["id", "qm_block"]):
            own = list(_changes(held))
            ends = [_fold(s, None, iter(own), stuck, None)[0] for s in begins]
            yield pd.DataFrame([(key, at, own[0][0], own[-1][0], ends)], columns=["id", "qm_block", "first", "last", "ends"])

    def chained(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        now, last, out = FIRST, None, []
        for at, first, end, ends in blocks.sort_values("qm_block")[["qm_block", "first", "last", "ends"]].itertuples(index=False):
            out.append((key[0], at, now, last, False))
            now, _ = _fold(now, last, iter([(first, "")]), stuck, None)
            now, last = ends[begins.index(now)], end
        out[-1] = (*out[-1][:4], True)
        t = pd.DataFrame(out, columns=["id", "qm_block", "now", "before_us", "final"])
        return t.astype({"before_us": "Int64"})

    many = cut.join(F.broadcast(cut.where("qm_block > 0").select("id").distinct()), "id", "left_semi")
    parts = ordered(many).mapInPandas(summed, "id long, qm_block int, first long, last long, ends array<string>")
    starts = parts.groupBy("id").applyInPandas(chained, "id long, qm_block int, now string, before_us long, final boolean")
    whole = cut.join(starts, ["id", "qm_block"], "left")

    def told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (key, _), held in _runs(frames, ["id", "qm_block"]):
            begin = held[0].iloc[0]
            known = isinstance(begin["now"], str)
            last = int(begin["before_us"]) if known and not pd.isna(begin["before_us"]) else None
            taken: list = []
            now, last = _fold(begin["now"] if known else FIRST, last, _changes(held), stuck, taken)
            if (not known or begin["final"]) and now == BUSY and last + stuck <= until:
                taken.append((last + stuck, now, STUCK))
            yield _log(key, taken)

    return ordered(whole).mapInPandas(told, LOG)


def transition_stream(changes: DataFrame, stuck_seconds: int, late: str) -> DataFrame:
    """The same of a stream of changes, with a step told as soon as the watermark, `late` behind the newest change, has passed it.

    State per paper: its status, when it was last heard of, and the changes that the watermark hasn't passed, so they are folded in the
    order of their times whatever order they come in. Changes older than the watermark come too late and are dropped. A timer
    in event time fails a paper that stays silent.
    """
    stuck = stuck_seconds * 1_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, last, times, statuses = state.get if state.exists else (FIRST, None, [], [])
        waiting = list(zip(map(int, times), statuses, strict=True))
        if not state.hasTimedOut:
            for f in frames:
                waiting += _changes([f])
        passed = state.getCurrentWatermarkMs() * 1000
        waiting.sort()
        ready = [x for x in waiting if x[0] <= passed]
        waiting = waiting[len(ready) :]
        taken: list = []
        last = None if last is None or pd.isna(last) else int(last)
        now, last = _fold(now, last, iter(ready), stuck, taken)
        if now == BUSY and last + stuck <= passed:
            taken.append((last + stuck, now, STUCK))
            now = STUCK
        state.update((now, last, [t for t, _ in waiting], [s for _, s in waiting]))
        wake = [t for t, _ in waiting[:1]] + ([last + stuck] if now == BUSY else [])
        if wake:
            state.setTimeoutTimestamp(max(-(-min(wake) // 1000), state.getCurrentWatermarkMs() + 1))
        yield _log(key[0], taken)

    rows = _whole(changes).withWatermark("ts", late).select(F.col("id").cast("long").alias("id"), "ts", F.unix_micros("ts").alias("us"), "status")
    return rows.groupBy("id").applyInPandasWithState(step, LOG, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """key, start, end, n: runs of a key's events (key, ts) with less than gap between them; on a stream, told when the watermark has passed them."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    s = events.where("ts is not null").groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stage_times(starts: DataFrame, ends: DataFrame, within: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """start_id, key, start, end_id, seconds: each start (start_id, key, ts) with every end (end_id, key, ts) of its key at most `within` later,
    or with nulls. On streams both sides are kept only as long as the watermarks leave a match open."""
    if starts.isStreaming:
        starts, ends = starts.withWatermark("ts", late), ends.withWatermark("ts", late)
    a = starts.select("start_id", "key", F.col("ts").alias("start"))
    b = ends.select("end_id", F.col("key").alias("end_key"), F.col("ts").alias("end"))
    on = (F.col("key") == F.col("end_key")) & (F.col("end") >= F.col("start")) & (F.col("end") <= F.col("start") + F.expr(f"interval {within}"))
    seconds = F.timestamp_diff("MICROSECOND", F.col("start"), F.col("end")) / F.lit(1e6)
    return a.join(b, on, "left").select("start_id", "key", "start", "end_id", seconds.alias("seconds"))


def last_steps(log: DataFrame) -> DataFrame:
    """id, processing_status, ts: each paper's last step. A paper fails and goes on at one time only in that order."""
    order = Window.partitionBy("id").orderBy(F.desc("ts"), F.when(F.col("after") == STUCK, 1).otherwise(0))
    return log.withColumn("k", F.row_number().over(order)).where("k = 1").select("id", F.col("after").alias("processing_status"), "ts")
