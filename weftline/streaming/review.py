"""Review sessions and jobs as streams: the event log, the reviewer's state machine, jobs with their receipts, idle sessions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

AUTO_VETOES = 5
LOG = "event string, turn int, ts double, chain string, payload string"
DECISIONS = "chain {chain}, at long, command string, decision string, turn int, vetoes int"
_STATE = "turn int, attempts int, stopped boolean, pinned long, vetoes array<long>"


def event_log(spark: SparkSession, folder: str, schema: str = LOG) -> DataFrame:
    """An append-only folder of JSON lines as a stream; lines that can't be read are null throughout and dropped."""
    return spark.readStream.schema(schema).json(folder).filter("event is not null")


@dataclass
class Session:
    """What is known of a chain between two commands. pinned: the candidate that a yaw holds on to."""

    turn: int = 1
    attempts: int = 0
    stopped: bool = False
    pinned: int | None = None
    vetoes: list[int] = field(default_factory=list)

    def step(self, command: str, candidate: int, ran: bool = True) -> str:
        """The decision on a command about the candidate of this turn. ran: whether the turn could be put together; if not, it shows no candidate.

        ok goes on to the next turn; veto adds to the list of vetoes, unveto takes the latest back; yaw pins the candidate;
        invisible is the visibility gate's own veto, of which a turn has a limited number before the reviewer is asked. What can't be
        read (unknown_cmd), and what needs a candidate where there is none (cannot_), changes nothing: the reviewer is asked again. Only a
        pinned candidate can be vetoed unseen, since it is known which one is meant.
        """
        if self.stopped:
            return "after_stop"
        command = command or ""
        verb, *rest = command.split(None, 1) or [""]
        if command == "stop":
            self.stopped = True
            return "stopped_by_reviewer"
        if verb == "yaw" and rest and not _number(rest[0]) or verb != "yaw" and rest:
            return "unknown_cmd"
        if not ran and verb in ("ok", "yaw", "unveto"):
            return f"cannot_{verb}"
        if verb == "ok":
            self.turn, self.attempts, self.pinned = self.turn + 1, 0, None
            return "ok"
        if verb == "yaw":
            self.pinned = candidate
            return "yaw"
        if verb == "unveto":
            return "unveto" if self.vetoes and self.vetoes.pop() is not None else "unveto_nothing"
        if verb == "invisible" and self.attempts >= AUTO_VETOES:
            return "ready"
        if verb in ("veto", "invisible"):
            meant = candidate if ran else self.pinned
            if meant is None:
                return "cannot_veto"
            self.attempts += verb == "invisible"
            self.vetoes.append(meant)
            self.pinned = None
            return "veto" if verb == "veto" else "auto_veto_invisible"
        return "unknown_cmd"


def _number(text: str) -> bool:
    try:
        return float(text) == float(text)
    except ValueError:
        return False


def fold(rows: Iterable[tuple], session: Session) -> Iterator[tuple]:
    """Decisions on rows (chain, at, command, candidate and, if told, ran), in order."""
    for chain, at, command, candidate, *ran in rows:
        decision = session.step(command, int(candidate), all(ran))
        yield chain, at, command, decision, session.turn, len(session.vetoes)


def review_decisions(commands: DataFrame, idle: str | None = None) -> DataFrame:
    """Decisions on a stream of commands (chain, at, command, candidate and, if there is one, ran); the state of a chain is kept between batches.

    Commands of a batch are taken in order of at. With idle (a number of milliseconds), a chain that is silent so long is stopped.
    """
    kind = dict(commands.dtypes)["chain"]
    told = ["chain", "at", "command", "candidate", *(["ran"] if "ran" in commands.columns else [])]

    def step(key, frames, state: GroupState):
        import pandas as pd

        names = [c.split()[0] for c in DECISIONS.format(chain=kind).split(", ")]
        if state.hasTimedOut:
            turn, *_, vetoes = state.get
            state.remove()
            yield pd.DataFrame([(key[0], -1, "", "idle", turn, len(vetoes))], columns=names)
            return
        session = Session(*[list(x) if isinstance(x, list | tuple) else x for x in state.get]) if state.exists else Session()
        rows = pd.concat(list(frames)).sort_values("at")
        out = list(fold(rows[told].itertuples(index=False, name=None), session))
        state.update((session.turn, session.attempts, session.stopped, None if session.pinned is None else int(session.pinned), [int(v) for v in session.vetoes]))
        if idle:
            state.setTimeoutDuration(int(idle))
        yield pd.DataFrame(out, columns=names)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return commands.groupBy("chain").applyInPandasWithState(step, DECISIONS.format(chain=kind), _STATE, "append", timeout)


def job_receipts(jobs: DataFrame, receipts: DataFrame, budget: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Each job (job, ts) with its receipts (job, done) within budget; jobs whose budget has run out come with a null."""
    a = jobs.withWatermark("ts", late).alias("a")
    b = receipts.withWatermark("done", late).alias("b")
    within = F.expr(f"b.job = a.job AND b.done >= a.ts AND b.done <= a.ts + interval {budget}")
    return a.join(b, within, "left_outer").select("a.job", "a.ts", "b.done")


def idle_sessions(log: DataFrame, keys: list[str], ts: str = "ts", gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Sessions of a log: a silence of gap ends one. Streams need the watermark, tables ignore it."""
    rows = log.withWatermark(ts, late) if log.isStreaming else log
    return rows.groupBy(*keys, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n")).select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def complete_answers(questions: DataFrame, answers: DataFrame, keys: list[str], slot: str = "slot") -> DataFrame:
    """Whether all slots that were asked about are answered; empty answers don't count."""
    told = answers.filter(F.trim("answer") != "").select(*keys, slot).distinct().withColumn("_told", F.lit(1))
    both = questions.select(*keys, slot).distinct().join(told, [*keys, slot], "left")
    return both.groupBy(*keys).agg(F.count("*").alias("asked"), F.count("_told").alias("answered")).withColumn("complete", F.col("asked") == F.col("answered"))


def changed_pieces(before: DataFrame, after: DataFrame, keys: list[str], fingerprint: str = "fingerprint") -> tuple[DataFrame, DataFrame]:
    """Keys to work out again (new, or changed in fingerprint), and keys whose results stay."""
    same = after.join(before.select(*keys, fingerprint), [*keys, fingerprint], "left_semi").select(*keys)
    return after.select(*keys).join(same, keys, "left_anti"), same


def job_outcomes(jobs: DataFrame, starts: DataFrame, receipts: DataFrame, budget: float, queue: float = 4.0) -> DataFrame:
    """(job, outcome, seconds) of jobs (job, ts): a job that was started (job, started) has its budget from then, one that waits has queue times as long.

    A receipt (job, done, message) within that is ok, or failed if its message does not begin so; else the job timed out while it
    was computed, or in the queue. Times are seconds; of repeated stamps and receipts, the first counts.
    """
    first = starts.groupBy("job").agg(F.min("started").alias("started"))
    told = receipts.groupBy("job").agg(F.min(F.struct("done", "message")).alias("r"))
    both = jobs.join(first, "job", "left").join(told, "job", "left")
    begun = F.col("started").isNotNull() & (F.col("started") <= F.col("ts") + queue * budget)
    last = F.when(begun, F.col("started") + budget).otherwise(F.col("ts") + queue * budget)
    in_time = F.col("r.done") <= last
    fine = F.when(F.col("r.message").startswith("ok"), "ok").otherwise("failed")
    outcome = F.when(in_time, fine).when(begun, "compute_timeout").otherwise("queue_timeout")
    return both.select("job", outcome.alias("outcome"), F.when(in_time, F.col("r.done") - F.col("ts")).alias("seconds"))


LEGS = ("render", "restyle", "texture")


def retexture_legs(rounds: DataFrame, legs: DataFrame) -> DataFrame:
    """(job, t_render, t_restyle, t_texture, missing) of rounds (job, ts, rendered): each leg (job, leg, done) is timed from the end of the one before.

    A render that is already there takes no time. missing names the first leg without an end; what follows it has no time.
    Times are seconds. The three ends of a job are one grouping, and one join by the job.
    """
    ends = legs.groupBy("job").agg(*[F.min(F.when(F.col("leg") == leg, F.col("done"))).alias(f"_{leg}") for leg in LEGS])
    out = rounds.join(ends, "job", "left").withColumns({"end": F.col("ts"), "missing": F.lit(None).cast("string")})
    for leg in LEGS:
        done = F.when(F.col("rendered"), F.col("ts")).otherwise(F.col(f"_{leg}")) if leg == LEGS[0] else F.col(f"_{leg}")
        out = out.withColumn("missing", F.coalesce("missing", F.when(done.isNull(), leg)))
        reached = F.when(F.col("missing").isNull(), done)
        out = out.withColumn(f"t_{leg}", reached - F.col("end")).withColumn("end", reached)
    return out.select("job", *[f"t_{leg}" for leg in LEGS], "missing")


def stale_faces(faces: DataFrame, before: DataFrame, after: DataFrame, chain: str = "chain") -> DataFrame:
    """(chain, piece): the pieces whose faces must be probed again, among those there are after an edit.

    before and after: (chain, piece, fingerprint, lo, hi). A piece goes stale if it is new or its fingerprint changed; if a
    blocker of one of its faces (chain, piece, blockers, lo, hi) changed; or if a face's box touches the box around all that
    changed, before and after. A face without a box is probed again.
    """
    old, new = (df.select(chain, "piece", *[F.col(c).alias(f"{c}_{side}") for c in ("fingerprint", "lo", "hi")]) for df, side in ((before, "old"), (after, "new")))
    both = old.join(new, [chain, "piece"], "full_outer").filter(~F.col("fingerprint_old").eqNullSafe(F.col("fingerprint_new")))
    edge = lambda c, f, k: f(F.least(F.col(f"{c}_old")[k], F.col(f"{c}_new")[k]) if c == "lo" else F.greatest(F.col(f"{c}_old")[k], F.col(f"{c}_new")[k]))
    region = both.groupBy(chain).agg(
        F.collect_set("piece").alias("changed"), F.array(*[edge("lo", F.min, k) for k in range(3)]).alias("r_lo"), F.array(*[edge("hi", F.max, k) for k in range(3)]).alias("r_hi")
    )  # of one edit, a few pieces
    touch = [(F.col("lo")[k] <= F.col("r_hi")[k]) & (F.col("r_lo")[k] <= F.col("hi")[k]) for k in range(3)]
    hit = F.col("lo").isNull() | F.col("hi").isNull() | F.arrays_overlap("blockers", "changed") | (touch[0] & touch[1] & touch[2])
    stale = faces.join(region, chain).filter(F.coalesce(hit, F.lit(False))).select(chain, "piece").union(both.select(chain, "piece"))
    return stale.distinct().join(after.select(chain, "piece"), [chain, "piece"], "left_semi")
