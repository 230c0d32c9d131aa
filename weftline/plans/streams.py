"""Queries that run a stream over the events to its end. Each has the SQL of its batch form, since both must tell the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import annotate
from weftline.plans.registry import query
from weftline.session import table
from weftline.streaming import jobs

_K = "cast(json_extract(props, '$.k') AS BIGINT)"
_END = "2100-01-01"


def _events(spark: SparkSession, sf_dir: str, folder: str) -> tuple[DataFrame, jobs.Heartbeat]:
    """The events as a file stream, with a heartbeat beside them."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern, for a file as for a folder of files
    beat = jobs.Heartbeat(spark, f"{folder}/beat", stream, "ts")
    return stream.unionByName(beat.stream), beat


def _cents():
    return F.floor(F.col("value") * 100 + 0.5).cast("long")


def _k():
    return F.get_json_object("props", "$.k").cast("long")


def _later(us):
    """The time of an event so many microseconds on; a heartbeat's own."""
    return F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.coalesce(us, F.lit(0)).cast("long")).alias("at")


_LOG = f"""log AS (SELECT event_id AS job, epoch_us(ts) AS ts, CASE WHEN value > 20 THEN epoch_us(ts) + {_K} * 240000000 END AS started,
  CASE WHEN {_K} % 4 <> 0 THEN epoch_us(ts) + {_K} * 240000000 + cast(floor(value * 100 + 0.5) AS BIGINT) * 600000 END AS done, CASE WHEN event_type = 'error' THEN 'broken' ELSE 'ok' END AS message FROM events)"""


@query(
    f"""WITH {_LOG}, due AS (SELECT *, started IS NOT NULL AND started <= ts + 14400000000 AS begun, CASE WHEN started IS NOT NULL AND started <= ts + 14400000000 THEN started + 3600000000 ELSE ts + 14400000000 END AS last FROM log)
    SELECT job, CASE WHEN done <= last THEN CASE WHEN message = 'ok' THEN 'ok' ELSE 'failed' END WHEN begun THEN 'compute_timeout' ELSE 'queue_timeout' END AS outcome, CASE WHEN done <= last THEN done - ts END AS micros FROM due"""
)
def stream_job_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as jobs: most are started some minutes later, most get a receipt. Budget one hour from the start, four in the queue."""
    folder = jobs.own_folder(spark, "jobs")
    events, beat = _events(spark, sf_dir, folder)
    began = _k() * 240_000_000
    kinds = [("submitted", F.lit(True), F.lit(0)), ("started", F.col("value") > 20, began), ("receipt", _k() % 4 != 0, began + _cents() * 600_000)]
    message = F.when(F.col("event_type") == "error", "broken").otherwise("ok").alias("message")
    rows = [F.when(F.coalesce(there, F.lit(True)), F.struct(F.col("event_id").alias("job"), F.lit(kind).alias("kind"), _later(us), message)) for kind, there, us in kinds]
    log = events.select(F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r")).select("r.*")
    found = jobs.stream_job_outcomes(log, 3600, late="1 day")
    return jobs.to_end(spark, folder, found, (beat,), _END)


@query(
    f"""WITH ends AS (SELECT event_id AS job, epoch_us(ts) AS ts, cast(floor(value * 100 + 0.5) AS BIGINT) * 10000 AS v, {_K} AS k, event_type, value FROM events),
    t AS (SELECT job, ts, CASE WHEN event_type = 'view' THEN ts WHEN k % 5 <> 0 THEN ts + v END AS a, CASE WHEN value > 10 THEN ts + v + 100000000 END AS b, CASE WHEN k % 7 <> 0 THEN ts + v + 300000000 END AS c FROM ends)
    SELECT job, a - ts AS t_render, CASE WHEN a IS NOT NULL THEN b - a END AS t_restyle, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN c - b END AS t_texture,
      CASE WHEN a IS NULL THEN 'render' WHEN b IS NULL THEN 'restyle' WHEN c IS NULL THEN 'texture' END AS missing FROM t"""
)
def stream_retexture_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rounds of three legs; views have their render already."""
    folder = jobs.own_folder(spark, "legs")
    events, beat = _events(spark, sf_dir, folder)
    took, none = _cents() * 10_000, F.lit(None).cast("boolean")
    kinds = [(jobs.BEGUN, F.lit(True), F.lit(0), F.col("event_type") == "view"), ("render", _k() % 5 != 0, took, none), ("restyle", F.col("value") > 10, took + 100_000_000, none), ("texture", _k() % 7 != 0, took + 300_000_000, none)]
    beats = F.col("event_id").isNull()  # an event without a number or a value has no ends; a heartbeat keeps its rows
    rows = [F.when(beats | (there & us.isNotNull()), F.struct(F.col("event_id").alias("job"), F.lit(leg).alias("leg"), _later(us), rendered.alias("rendered"))) for leg, there, us, rendered in kinds]
    log = events.select(F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r")).select("r.*")
    told = jobs.to_end(spark, folder, jobs.rounds_told(jobs.watched(log, "job", "1 hour")), (beat,), _END)
    return jobs.legs_told(told)


@query(
    f"""WITH log AS (SELECT user_id % 10 AS sig, {_K} AS pid, epoch_us(ts) AS us, event_id, event_type AS e FROM events),
    q AS (SELECT sig, pid, min(us) AS asked FROM log WHERE e = 'view' GROUP BY ALL),
    a AS (SELECT sig, pid, min(us) AS us, arg_min(e, (us, event_id)) AS e FROM log WHERE e <> 'view' GROUP BY ALL),
    v AS (SELECT sig, pid, coalesce(a.us <= q.asked + 1200000000, a.us IS NOT NULL AND q.asked IS NULL, false) AS told, a.e FROM q FULL JOIN a USING (sig, pid)),
    s AS (SELECT DISTINCT user_id AS slot, user_id % 10 AS sig FROM events)
    SELECT s.slot, v.pid, CASE WHEN told AND e <> 'error' THEN 'fit' ELSE 'skip' END AS verb, CASE WHEN NOT told THEN NULL WHEN e = 'error' THEN 'why' WHEN e = 'click' THEN 'top' ELSE 'bottom' END AS arg, told AS answered
    FROM v JOIN s ON s.sig = v.sig"""
)
def stream_verdict_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as slots of ten signatures: views ask about a number, other events answer. Twenty minutes without an answer are a skip."""
    folder = jobs.own_folder(spark, "memo")
    events, beat = _events(spark, sf_dir, folder)
    e = F.col("event_type")
    log = events.select(
        (F.col("user_id") % 10).alias("sig"), _k().alias("pid"), F.when(e == "view", "question").otherwise("answer").alias("kind"), _later(F.lit(0)), F.col("event_id").alias("ord"),
        F.when(e == "error", "skip").otherwise("fit").alias("verb"), F.when(e == "error", "why").when(e == "click", "top").otherwise("odd").alias("arg"),
    )
    told = jobs.to_end(spark, folder, jobs.stream_verdicts(log), (beat,), _END)
    verdicts = told.select("sig", "pid", "verb", F.when(F.col("answered"), annotate.sided(F.col("verb"), F.col("arg"))).alias("arg"), "answered")
    slots = table(spark, sf_dir, "events").select(F.col("user_id").alias("slot"), (F.col("user_id") % 10).alias("sig")).distinct()
    return annotate.paired(verdicts, slots).select("slot", "pid", "verb", "arg", "answered")
