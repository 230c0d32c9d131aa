"""Queries of review sessions, with the events of a user as commands on a chain."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.registry import query
from weftline.session import remove, shared_folder, table
from weftline.streaming import review


@query(
    """SELECT a.event_id AS job, min(epoch_us(b.ts) - epoch_us(a.ts)) AS latency_us FROM (SELECT * FROM events WHERE event_type = 'view') a
    LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR GROUP BY a.event_id"""
)
def job_receipt_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as jobs, the purchases of the same user within an hour as their receipts: the batch form of the stream join."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    hour = F.floor(F.unix_micros("ts") / 3_600_000_000)
    jobs = events.filter("event_type = 'view'").select(F.col("user_id").alias("job"), hour.alias("hour"), "ts", "event_id")
    receipts = events.filter("event_type = 'purchase'").select(F.col("user_id").alias("job"), F.explode(F.array(hour, hour - 1)).alias("hour"), F.col("ts").alias("done"))
    within = F.expr("b.job = a.job AND b.hour = a.hour AND b.done >= a.ts AND b.done <= a.ts + interval 1 hour")
    both = jobs.alias("a").join(receipts.alias("b"), within, "left")
    return both.groupBy(F.col("event_id").alias("job")).agg(F.min(F.unix_micros("b.done") - F.unix_micros("a.ts")).alias("latency_us"))


@query(
    """WITH g AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
      SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events))
    SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) + 3600000000 AS end_us, count(*) AS n FROM g GROUP BY user_id, s"""
)
def idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = review.idle_sessions(events, ["user_id"])
    return found.select("user_id", F.unix_micros("start").alias("first_us"), F.unix_micros("end").alias("end_us"), "n")


_COMMANDS = {"click": "ok", "error": "veto", "view": "invisible", "signup": "unveto", "purchase": "yaw"}


def commands(events: DataFrame) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for pair in _COMMANDS.items() for x in pair])
    return events.select(
        F.col("user_id").alias("chain"), F.col("event_id").alias("at"), kinds[F.col("event_type")].alias("command"), F.get_json_object("props", "$.k").cast("long").alias("candidate")
    )


@query()
def stream_review_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state machine run over the events as a file stream, to its end; decisions are read back from its sink."""
    schema = table(spark, sf_dir, "events").schema
    folder = f"{shared_folder(spark)}/review-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    made = review.review_decisions(commands(stream)).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    made.start(f"{folder}/out").awaitTermination()
    decided = spark.read.parquet(f"{folder}/out").checkpoint()
    remove(spark, folder)
    return decided


@query("SELECT user_id, count(DISTINCT event_type) AS asked, count(DISTINCT event_type) FILTER (WHERE value > 50) AS answered, count(DISTINCT event_type) = count(DISTINCT event_type) FILTER (WHERE value > 50) AS complete FROM events GROUP BY user_id")
def probe_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("slot"), F.when(F.col("value") > 50, "disc").otherwise(" ").alias("answer"))
    return review.complete_answers(events, events, ["user_id"])
