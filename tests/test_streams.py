"""Streams in several batches, out of order and started again, against the batch forms of the same rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from weftline.streaming import jobs, review

ZERO = dt.datetime(2024, 1, 1)


def at(seconds):
    return ZERO + dt.timedelta(seconds=seconds)


def streamed(spark, rows, schema, folder, files=4, mixed=300):
    """A stream of files, one a batch; rows are dealt in order, and mixed within about one file."""
    rng = random.Random(1)
    times = [i for i, c in enumerate(schema.split(", ")) if c.startswith("at ")]
    rows = sorted(rows, key=lambda r: r[times[0]].timestamp() + rng.random() * mixed)
    size = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    frame = spark.read.parquet(f"{folder}/in")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    beat = jobs.Heartbeat(spark, f"{folder}/beat", stream)
    return stream.unionByName(beat.stream), beat


END = "2100-01-01"


def test_job_outcomes_are_those_of_the_batch(spark):
    rng = random.Random(4)
    rows = []
    for job in range(1, 120):
        t = rng.uniform(0, 3000)
        rows.append((job, "submitted", at(t), None))
        if rng.random() < 0.1:
            rows.append((job, "submitted", at(t + 5), None))  # the first counts
        if rng.random() < 0.7:
            rows += [(job, "started", at(t + rng.uniform(0, 300)), None) for _ in range(rng.choice([1, 1, 2]))]
        if rng.random() < 0.8:
            rows += [(job, "receipt", at(t + rng.uniform(0, 400)), rng.choice(["ok 1", "broken", None])) for _ in range(rng.choice([1, 1, 2]))]
    rows.append((500, "receipt", at(100), "ok"))  # of no job
    folder = jobs.own_folder(spark, "test")
    stream, beat = streamed(spark, rows, jobs.JOB_EVENTS, folder)
    got = jobs.to_end(spark, folder, jobs.stream_job_outcomes(stream, 60, late="20 minutes"), (beat,), END).collect()
    frame = spark.createDataFrame([(j, k, (t - ZERO) / dt.timedelta(microseconds=1), m) for j, k, t, m in rows], "job long, kind string, t double, message string")
    submitted = frame.filter("kind = 'submitted'").groupBy("job").agg((F.min("t") / 1e6).alias("ts"))
    starts = frame.filter("kind = 'started'").select("job", (F.col("t") / 1e6).alias("started"))
    receipts = frame.filter("kind = 'receipt'").select("job", (F.col("t") / 1e6).alias("done"), F.coalesce("message", F.lit("")).alias("message"))
    want = review.job_outcomes(submitted, starts, receipts, 60).collect()
    assert {r.job: (r.outcome, None if r.micros is None else r.micros / 1e6) for r in got} == {r.job: (r.outcome, r.seconds and pytest.approx(r.seconds)) for r in want}
    assert {r.outcome for r in got} == {"ok", "failed", "compute_timeout", "queue_timeout"} and len(got) == 119


def test_job_outcomes_are_told_without_python(spark):
    folder = jobs.own_folder(spark, "test")
    stream, _ = streamed(spark, [(1, "submitted", at(0), None)], jobs.JOB_EVENTS, folder, files=1)
    plan = jobs.stream_job_outcomes(stream, 60)._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan and "session_window" in plan


def test_rounds_of_three_legs_are_those_of_the_batch(spark):
    rng = random.Random(5)
    rounds, legs = [], []
    for job in range(1, 60):
        t = rng.uniform(0, 2000)
        rounds.append((job, at(t), rng.random() < 0.3))
        for leg in review.LEGS:
            t += rng.uniform(1, 100)
            if rng.random() < 0.8:
                legs.append((job, leg, at(t)))
    folder = jobs.own_folder(spark, "test")
    a, beat_a = streamed(spark, rounds, "job long, at timestamp, rendered boolean", f"{folder}/rounds", 2)
    b, beat_b = streamed(spark, legs, "job long, leg string, at timestamp", f"{folder}/legs", 3)
    got = jobs.legs_told(jobs.to_end(spark, folder, jobs.stream_retexture_legs(a, b, late="30 minutes"), (beat_a, beat_b), END)).collect()
    us = lambda t: (t - ZERO) // dt.timedelta(microseconds=1)
    want = review.retexture_legs(
        spark.createDataFrame([(j, us(t), r) for j, t, r in rounds], "job long, ts long, rendered boolean"), spark.createDataFrame([(j, leg, us(t)) for j, leg, t in legs], "job long, leg string, done long")
    )
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.select("job", "t_render", "t_restyle", "t_texture", "missing").collect()), key=lambda r: r[0])
    assert {r.missing for r in got} == {None, *review.LEGS}


def test_rounds_of_legs_are_told_once_by_one_aggregate(spark):
    """Rounds of a job over days, near and across the starts of windows; ends that are repeated, too early, just in time and too late."""
    rng = random.Random(7)
    rounds, legs, want = [], [], []
    for job in range(40):
        for day in range(3):
            t = day * 86_400 + (21_600 - rng.randrange(1, 3600) if job % 2 else rng.randrange(0, 80_000))
            rounds += [(job, at(t), job % 5 == 0)] * (2 if job == 7 else 1)
            ends = {leg: [t + s for s in rng.sample([-5, 0, 1, 900, 1800, 3599, 3600, 3601, 3700], rng.randrange(4))] for leg in review.LEGS}
            legs += [(job, leg, at(e)) for leg, es in ends.items() for e in es]
            first = {leg: min((e * 1_000_000 for e in es if 0 <= e - t <= 3600), default=None) for leg, es in ends.items()}
            want += [(job, t * 1_000_000, t * 1_000_000 if job % 5 == 0 else first["render"], first["restyle"], first["texture"])] * (2 if job == 7 else 1)
    folder = jobs.own_folder(spark, "test")
    a, beat_a = streamed(spark, rounds, "job long, at timestamp, rendered boolean", f"{folder}/rounds", 4, mixed=0)
    b, beat_b = streamed(spark, legs, "job long, leg string, at timestamp", f"{folder}/legs", 4, mixed=0)
    stream = jobs.stream_retexture_legs(a, b, late="1 minute")
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1
    got = jobs.to_end(spark, folder, stream, (beat_a, beat_b), END).collect()
    zero = ZERO.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000
    us = lambda x: x if x is None else int(x - zero)
    assert sorted(((r.job, (r.ts - ZERO) // dt.timedelta(microseconds=1), us(r.render), us(r.restyle), us(r.texture)) for r in got), key=str) == sorted(want, key=str)


def test_events_without_number_or_value_have_no_ends(spark, tmp_path):
    from weftline.plans.streams import stream_retexture_legs

    rows = [(1, at(0), "view", 20.0, '{"k": 1}'), (2, at(5), "click", 20.0, '{"k": 1}'), (3, at(9), "click", 20.0, None), (4, at(9), "view", None, '{"k": 1}'), (5, at(9), "click", None, '{"k": 1}'), (6, at(9), "view", 20.0, "{}"), (7, at(9), None, 20.0, '{"k": 1}')]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    told = {r.job: tuple(r)[1:] for r in stream_retexture_legs(spark, str(tmp_path)).collect()}
    s = 1_000_000
    whole = (20 * s, 100 * s, 200 * s, None)
    assert told == {1: (0, 120 * s, 200 * s, None), 2: whole, 3: (None, None, None, "render"), 4: (0, None, None, "restyle"), 5: (None, None, None, "render"), 6: (0, 120 * s, None, "texture"), 7: whole}


MEMO = "sig long, pid long, kind string, at timestamp, ord long, verb string, arg string"


def plain_memo(rows, wait):
    out = {}
    for sig, pid in {r[:2] for r in rows}:
        own = [r for r in rows if r[:2] == (sig, pid)]
        asked = min((r[3] for r in own if r[2] == "question"), default=None)
        first = min((r for r in own if r[2] == "answer"), key=lambda r: r[3:5], default=None)
        fine = first is not None and (asked is None or first[3] <= asked + dt.timedelta(seconds=wait))
        out[sig, pid] = (first[5] or "skip", first[6], True) if fine else ("skip", None, False)
    return out


def test_first_answers_are_remembered_and_unanswered_questions_are_skips(spark):
    rng = random.Random(6)
    rows = []
    for k in range(200):
        sig, pid, t = rng.randrange(4), rng.randrange(20), rng.uniform(0, 3000)
        rows.append((sig, pid, "question", at(t), k, None, None) if rng.random() < 0.4 else (sig, pid, "answer", at(t), k, rng.choice(["fit", "skip", None]), rng.choice(["top", "odd"])))
    rows += [(9, 1, "question", at(50), 300, None, None), (9, 2, "answer", at(60), 301, "fit", "top"), (9, 3, "question", at(0), 302, None, None), (9, 3, "answer", at(601), 303, "fit", "top")]
    folder = jobs.own_folder(spark, "test")
    stream, beat = streamed(spark, rows, MEMO, folder)
    got = jobs.to_end(spark, folder, jobs.stream_verdicts(stream, wait_seconds=600, late="20 minutes"), (beat,), END).collect()
    assert {(r.sig, r.pid): (r.verb, r.arg, r.answered) for r in got} == plain_memo(rows, 600)
    assert len(got) == len({r[:2] for r in rows})  # each once


def test_a_verdict_is_forgotten_after_its_time(spark):
    rows = [(1, 1, "question", at(0), 0, None, None), (1, 1, "answer", at(5), 1, "fit", "top"), *[(2, k, "answer", at(3000 + k), 2, "fit", "x") for k in range(4)], (1, 1, "question", at(3600), 3, None, None), (1, 1, "answer", at(3610), 4, "skip", "no"), (3, 3, "answer", at(9000), 5, "fit", "x")]
    folder = jobs.own_folder(spark, "test")
    stream, beat = streamed(spark, rows, MEMO, folder, files=9, mixed=0)
    got = jobs.to_end(spark, folder, jobs.stream_verdicts(stream, 60, ttl_seconds=600, late="1 second"), (beat,), END)
    assert sorted((r.verb, r.arg) for r in got.filter("sig = 1").collect()) == [("fit", "top"), ("skip", "no")]




def test_a_bad_command_is_asked_again_and_only_pins_are_vetoed_unseen():
    session = review.Session()
    said = [("hello", 5, True), ("ok now", 5, True), ("yaw x", 5, True), ("ok", 5, False), ("veto", 5, False), ("unveto", 5, False), ("yaw", 5, False), ("yaw 30", 6, True), ("veto", 7, False), ("veto", 7, False), ("veto", 8, True), ("unveto", 8, True), ("ok", 9, True), ("stop", 9, True), ("ok", 9, True)]
    got = [d for _, _, _, d, *_ in review.fold([(1, k, *x) for k, x in enumerate(said)], session)]
    assert got == ["unknown_cmd", "unknown_cmd", "unknown_cmd", "cannot_ok", "cannot_veto", "cannot_unveto", "cannot_yaw", "yaw", "veto", "cannot_veto", "veto", "unveto", "ok", "stopped_by_reviewer", "after_stop"]
    assert session.vetoes == [6] and session.turn == 2 and session.pinned is None
