"""The gate cascade of candidates, failure counters of slots, and visibility gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of the gates, in the order in which they apply.
MOST_BYTES, MOST_FACES, MOST_DEBRIS = 120 << 20, 400_000, 0.02
LEAST_SCALE, MOST_SCALE, MOST_GAP, MOST_RATIO = 0.2501, 3.999, 0.01, 2.5
VISIBLE, CLEARLY_VISIBLE, AUTO_VETOES = 0.10, 0.30, 5
#: Reasons that are the candidate's own and say nothing about the slot.
OWN = ("GLB limit", "face count limit", "has debris", "pre-judge skip", "scale at boundary")


def gate_reason() -> Column:
    """Why a candidate (bytes, faces, debris, verdict, contact, scale, snapped, gap, virtual_gap, ratio, connected) is refused; null: it is placed."""
    c = F.col
    return (
        F.when(c("bytes") > MOST_BYTES, "GLB limit")
        .when(c("faces") > MOST_FACES, "face count limit")
        .when(c("debris") > MOST_DEBRIS, "has debris")
        .when(c("verdict") == "skip", "pre-judge skip")
        .when(~c("contact"), "no contact surface")
        .when((c("scale") <= LEAST_SCALE) | (c("scale") >= MOST_SCALE), "scale at boundary")
        .when(c("virtual_gap").isNull() & ~c("snapped"), "snap refused")
        .when(c("gap") > MOST_GAP + F.coalesce(c("virtual_gap"), F.lit(0.0)), "gap")
        .when(c("ratio") > MOST_RATIO, "too large")
        .when(~c("connected"), "disassembles")
    )


def first_survivor(tried: DataFrame, batch: list[str], order: str) -> DataFrame:
    """Of each batch the first candidate without a reason, with the number of those refused before it."""
    window = Window.partitionBy(*batch).orderBy(order)
    counted = tried.withColumn("refused", F.count("reason").over(window))
    return counted.filter("reason is null").withColumn("_r", F.row_number().over(window)).filter("_r = 1").drop("_r", "reason")


def least_recent(pool: DataFrame, chain: list[str], last: str) -> DataFrame:
    """Slots that were used no later than one turn after the one least recently used."""
    return pool.withColumn("_least", F.min(last).over(Window.partitionBy(*chain))).filter(F.col(last) <= F.col("_least") + 1).drop("_least")


def retired(batches: DataFrame, slot: list[str], order: str, failures: int = 3, skips: int = 5) -> DataFrame:
    """Slots and the batch at which they retire, from batches (outcome: ok, fail, skip).

    Failures count from the last success, skips from the last outcome that isn't one; a skip leaves failures as they are.
    """
    so_far = Window.partitionBy(*slot).orderBy(order)
    marked = batches.withColumns(
        {
            "_ok": F.sum((F.col("outcome") == "ok").cast("int")).over(so_far),
            "_run": F.sum((F.col("outcome") != "skip").cast("int")).over(so_far),
        }
    )
    counted = marked.withColumns(
        {
            "dead": F.sum((F.col("outcome") == "fail").cast("int")).over(Window.partitionBy(*slot, "_ok").orderBy(order)),
            "skipped": F.sum((F.col("outcome") == "skip").cast("int")).over(Window.partitionBy(*slot, "_run").orderBy(order)),
        }
    )
    done = counted.filter((F.col("dead") >= failures) | (F.col("skipped") >= skips))
    return done.groupBy(*slot).agg(F.min(order).alias("retired_at"))


def visibility_action(turns: DataFrame, keys: list[str], order: str) -> DataFrame:
    """What the gate does with each attempt (op, metric): veto a replacement that changes too little, up to a number of times a turn, flag other ops, and label the rest."""
    low = F.col("metric") < VISIBLE
    window = Window.partitionBy(*keys).orderBy(order)
    replaced = low & (F.col("op") == "replace")
    nth = F.sum(replaced.cast("int")).over(window)
    return turns.withColumn(
        "action",
        F.when(F.col("metric").isNull(), "unmeasured")
        .when(low & (F.col("op") != "replace"), "flag")
        .when(replaced & (nth <= AUTO_VETOES), "veto")
        .when(low, "review")
        .when(F.col("metric") < CLEARLY_VISIBLE, "faint")
        .otherwise("visible"),
    )
