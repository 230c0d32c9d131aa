"""Jobs, retexture rounds and verdicts as event-time streams, with the same results as their batch forms.

A deadline is one of event time, a timer's or that of a session's end: it is reached when the watermark has passed it, and by then
everything that happened before has been seen, in whatever order it came. So a decision never depends on how a stream was cut into batches. What comes later than the
watermark allows is dropped by Spark, and a row that a decision has been made about leaves no state behind.

A log that ends holds back what waits for its watermark. ``heartbeat`` rows, which have a time and no key, move it on.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

from weftline.session import remove, shared_folder

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a run to the end sets. Rows of the state are not counted, which would ask the store for each row before it is written.
_STORE = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false"}
JOB_EVENTS = "job long, kind string, at timestamp, message string"
BEGUN = "begun"
VERDICTS = "sig long, pid long, verb string, arg string, answered boolean"
_VERDICT = "asked long, at long, ord long, verb string, arg string, timer long, told boolean"


def watched(rows: DataFrame, key: str, late: str, at: str = "at") -> DataFrame:
    """rows with a watermark on at, and without the heartbeats that have moved it.

    They are told apart by a mark, not by their missing key, and asked for it together with their time: else Spark would leave them
    out before the watermark sees them, be it since a filter can go first, or since a join infers that keys are not null.
    """
    marked = rows.withColumns({"_beat": F.col(key).isNull(), key: F.coalesce(F.col(key), F.lit(0))})
    return marked.withWatermark(at, late).filter(F.when(F.col(at).isNotNull(), ~F.col("_beat"))).drop("_beat")


def _ms(us: int) -> int:
    """The first whole millisecond that is not before."""
    return -(-us // 1000)


def stream_job_outcomes(events: DataFrame, budget_seconds: int, queue: int = 4, late: str = "1 hour") -> DataFrame:
    """(job, outcome, micros) of a stream (job, kind, at, message) of submitted, started and receipt rows: what ``review.job_outcomes`` says of the same rows.

    A started job has its budget from then, one that waits has queue times as long. A job's rows are one session, which ends when nothing has
    come for longer than a job can last; what comes before its job waits for it as long. late: how far rows may be out of order.
    """
    budget, c, at = budget_seconds * 1_000_000, F.col, F.unix_micros("at")
    first = lambda kind, what: F.min(F.when(F.col("kind") == kind, what))
    receipt = F.struct(at.alias("done"), F.coalesce("message", F.lit("")).alias("message"))
    life = F.session_window("at", f"{(queue + 1) * budget_seconds + 1} seconds")
    one = watched(events, "job", late).groupBy("job", life).agg(first("submitted", at).alias("ts"), first("started", at).alias("started"), first("receipt", receipt).alias("r"))
    waits = c("ts") + queue * budget
    begun = c("started").isNotNull() & (c("started") <= waits)
    in_time = c("r.done") <= F.when(begun, c("started") + budget).otherwise(waits)
    fine = F.when(c("r.message").startswith("ok"), "ok").otherwise("failed")
    outcome = F.when(in_time, fine).when(begun, "compute_timeout").otherwise("queue_timeout")
    return one.filter(c("ts").isNotNull()).select("job", outcome.alias("outcome"), F.when(in_time, c("r.done") - c("ts")).alias("micros"))


class _Memo(StatefulProcessor):
    """A candidate that a signature was asked about, with its verdict. A hot signature is as many keys as it has candidates."""

    def __init__(self, wait_us: int, ttl_ms: int | None):
        self.wait, self.ttl = wait_us, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getValueState("told", _VERDICT)

    def _answered(self, asked: int | None, at: int | None) -> bool:
        return at is not None and (asked is None or at <= asked + self.wait)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        asked, at, order, verb, arg, timer, told = self.told.get() if self.told.exists() else (None,) * 6 + (False,)
        for row in rows:
            if row.kind == "question":
                asked = row.at_us if asked is None else min(asked, row.at_us)
            elif at is None or (row.at_us, row.ord) < (at, order):
                at, order, verb, arg = row.at_us, row.ord, row.verb, row.arg
        if told:
            return iter(())  # it is remembered, and not asked again
        due = max(_ms(at if self._answered(asked, at) else asked + self.wait), timerValues.getCurrentWatermarkInMs() + 1)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.told.update((asked, at, order, verb, arg, due, False))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        asked, at, order, verb, arg, due, told = self.told.get()
        if told:
            self.told.clear()  # its time to live is over: it may be asked about again
            return
        answered = self._answered(asked, at)
        self.told.update((asked, at, order, verb, arg, due, True))
        if self.ttl is not None:
            self.handle.registerTimer(due + self.ttl)
        yield Row(sig=key[0], pid=key[1], verb=(verb if answered else None) or "skip", arg=arg if answered else None, answered=answered)

    def close(self) -> None:
        pass


def stream_verdicts(log: DataFrame, wait_seconds: int = 1200, ttl_seconds: int | None = None, late: str = "1 hour") -> DataFrame:
    """(sig, pid, verb, arg, answered) of a stream (sig, pid, kind, at, ord, verb, arg) of questions and answers, once for each signature and candidate.

    The first answer counts, by at, then ord, and is remembered, so nothing is asked twice while it lives. A question that has no answer
    for so long is a skip; an answer that nobody asked for counts. Sides are as they were said; ``annotate.sided`` mends them.
    """
    rows = watched(log, "sig", late).withColumn("at_us", F.unix_micros("at"))
    return rows.groupBy("sig", "pid").transformWithState(_Memo(wait_seconds * 1_000_000, ttl_seconds and ttl_seconds * 1000), VERDICTS, "append", "eventTime")


def stream_retexture_legs(rounds: DataFrame, legs: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(job, ts, render, restyle, texture: microseconds) of streams of rounds (job, at, rendered) and of ends of legs (job, leg, at): what ``rounds_told`` says of both.

    late: how far rows of either may be out of order.
    """
    begun = watched(rounds, "job", late).select("job", F.lit(BEGUN).alias("leg"), "at", "rendered")
    return rounds_told(begun.unionByName(watched(legs, "job", late).select("job", "leg", "at", F.lit(None).cast("boolean").alias("rendered"))), within)


def rounds_told(log: DataFrame, within: str = "1 hour", every_seconds: int = 21_600) -> DataFrame:
    """(job, ts, render, restyle, texture: microseconds) of a stream (job, leg, at, rendered) that has a watermark on at: rounds, whose leg is ``BEGUN``, and ends of legs.

    An end counts within so long of its round's begin, the first of several; one that doesn't come is null. A render that is there ends as its round begins.
    The few rows of a job in a window are one group, which is told when the watermark has passed the window. Windows start every so many seconds
    and last longer by what an end can take: a round meets its ends in the window that it begins in, and only ends near a start are in two.
    """
    c, every, us = F.col, every_seconds * 1_000_000, F.unix_micros
    dealt = log.select("job", "leg", "rendered", us("at").alias("us"), F.window("at", f"{every_seconds} seconds {within}", f"{every_seconds} seconds"))
    here = (c("leg") != BEGUN) | (c("us") - us("window.start") < every)
    groups = dealt.filter(here).groupBy("job", "window").agg(F.collect_list(F.struct("leg", "us", "rendered")).alias("rows"))
    told = groups.select("job", "window", "rows", F.explode(F.filter("rows", lambda r: r["leg"] == BEGUN)).alias("round"))
    ts = c("round.us")
    last = ts + us("window.end") - us("window.start") - every

    def end(leg: str) -> Column:
        return F.array_min(F.transform(F.filter("rows", lambda r: (r["leg"] == leg) & r["us"].between(ts, last)), lambda r: r["us"]))

    render = F.when(c("round.rendered"), ts).otherwise(end("render"))
    return told.select("job", F.timestamp_micros(ts).alias("ts"), render.alias("render"), *[end(leg).alias(leg) for leg in ("restyle", "texture")])


def legs_told(rows: DataFrame) -> DataFrame:
    """(job, t_render, t_restyle, t_texture, missing) of what ``stream_retexture_legs`` gives, in microseconds, as ``review.retexture_legs`` tells it."""
    c = F.col
    have = c("render").isNotNull()
    both = have & c("restyle").isNotNull()
    missing = F.when(~have, "render").when(c("restyle").isNull(), "restyle").when(c("texture").isNull(), "texture")
    took = [c("render") - F.unix_micros("ts"), F.when(have, c("restyle") - c("render")), F.when(both, c("texture") - c("restyle"))]
    return rows.select("job", *[t.alias(f"t_{leg}") for t, leg in zip(took, ("render", "restyle", "texture"), strict=True)], missing.alias("missing"))


class Heartbeat:
    """A stream of like's columns from a folder of its own, silent until ``beat`` gives it a row of that time and else nulls."""

    def __init__(self, spark: SparkSession, folder: str, like: DataFrame, at: str = "at"):
        self.spark, self.folder, self.at = spark, folder, at
        self.schema = StructType([StructField(f.name, f.dataType) for f in like.schema])
        spark.createDataFrame([], self.schema).write.parquet(folder)
        self.stream = spark.readStream.schema(self.schema).parquet(folder)

    def beat(self, at: str) -> None:
        one = self.spark.range(1).select(*[F.lit(at if f.name == self.at else None).cast(f.dataType).alias(f.name) for f in self.schema])
        one.write.mode("append").parquet(self.folder)


def to_end(spark: SparkSession, folder: str, streamed: DataFrame, beats: tuple[Heartbeat, ...], at: str) -> DataFrame:
    """The rows that a stream gives until there is no more to read, as a checkpointed table. folder: one of ours that goes afterwards.

    It runs until all is read; then the heartbeats move its watermarks on to at, it is started again where it stopped, and ends what waits.
    """
    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        for last in (False, True):
            for b in beats if last else ():
                b.beat(at)
            made = streamed.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
            made.start(f"{folder}/out").awaitTermination()
        return spark.read.parquet(f"{folder}/out").checkpoint()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
        remove(spark, folder)


def own_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
