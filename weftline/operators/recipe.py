"""Edit chains: the fold of an ordered edit log into the state after each turn, and what checks and reports are made of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def state_fold(edits: DataFrame, chain: Sequence[str] = ("chain",), node: str = "node", turn: str = "turn", seq: str = "seq", version: str = "version") -> DataFrame:
    """The state after each turn: (chain, turn, node, version) for each node that is there then.

    The last writer of a node wins; a null version takes it away. A version lives from its turn to the turn before the next
    write of its node. Turns are numbered densely, and each life is laid out over the numbers of its own turns, so that the work is
    that of the rows that come out. Ties of turn and seq fall to the largest version.
    """
    last = Window.partitionBy(*chain, node, turn).orderBy(F.desc(seq), F.desc(version))
    turns = edits.select(*chain, turn).distinct().withColumn("_n", F.row_number().over(Window.partitionBy(*chain).orderBy(turn)))
    writes = edits.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r").join(turns, [*chain, turn])
    ends = turns.groupBy(*chain).agg((F.max("_n") + 1).alias("_end"))
    following = F.lead("_n").over(Window.partitionBy(*chain, node).orderBy("_n"))
    lives = writes.withColumn("_until", following).filter(F.col(version).isNotNull()).join(ends, list(chain))
    alive = F.explode(F.sequence("_n", F.coalesce("_until", "_end") - 1))
    return lives.select(*chain, node, version, alive.alias("_n")).join(turns, [*chain, "_n"]).select(*chain, turn, node, version)


def last_records(edits: DataFrame, chain: Sequence[str], turn: str, seq: str) -> DataFrame:
    """The last record of each turn."""
    window = Window.partitionBy(*chain, turn).orderBy(F.desc(seq))
    return edits.withColumn("_r", F.row_number().over(window)).filter("_r = 1").drop("_r")


def running_present(edits: DataFrame, chain: Sequence[str], turn: str, added: str) -> DataFrame:
    """edits with already_present: what earlier turns of the chain added, in order."""
    before = Window.partitionBy(*chain).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    return edits.withColumn("already_present", F.flatten(F.collect_list(added).over(before)))


def state_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], exact: Sequence[str], near: dict[str, float]) -> DataFrame:
    """Rows of two states that differ: a full outer join, with the first reason. Nulls are equal to each other."""
    a, b = left.withColumn("_l", F.lit(True)).alias("a"), right.withColumn("_r", F.lit(True)).alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    reason = F.when(F.col("_l").isNull(), "extra").when(F.col("_r").isNull(), "missing")
    for c in exact:
        reason = reason.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c)
    for c, most in near.items():
        apart = F.coalesce(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) > most, ~F.col(f"a.{c}").isNull().eqNullSafe(F.col(f"b.{c}").isNull()))
        reason = reason.when(apart, c)
    both = a.join(b, on, "full_outer")
    return both.select(*[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys], reason.alias("reason")).filter("reason is not null")


def provenance(uses: DataFrame, chain: Sequence[str] = ("chain",)) -> DataFrame:
    """A row for each asset of a chain (asset, role, turn, part, ord): its first role, its turns in order, its parts once each; hosts first."""
    rows = uses.groupBy(*chain, "asset").agg(
        F.min_by("role", "ord").alias("role"), F.array_sort(F.collect_list("turn")).alias("turns"), F.array_sort(F.collect_set("part")).alias("parts")
    )
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*chain).orderBy(F.when(F.col("role") == "host", 0).otherwise(1), "asset")))


def edits_from_plan(plan: DataFrame) -> DataFrame:
    """One add for each part of a plan's steps (oid, step, name, pids): turns in order of steps, records in order of parts."""
    parts = plan.select("oid", F.col("step").alias("turn"), "name", F.posexplode("pids").alias("seq", "pid"))
    return parts.select(F.concat(F.lit("A/"), F.substring("oid", 1, 8), F.lit("_s0")).alias("chain"), "turn", "seq", F.lit("add").alias("op"), "pid", "name")


def start_state(nodes: DataFrame, meshes: DataFrame) -> DataFrame:
    """Vertices of each start node: its override, or those of its parts one after the other."""
    parts = nodes.select("chain", "node", "override", F.posexplode_outer("pids").alias("place", "pid"))
    joined = parts.join(meshes.select("pid", "vertices"), "pid", "left")
    rows = joined.groupBy("chain", "node").agg(F.first("override", True).alias("override"), F.array_sort(F.collect_list(F.struct("place", "vertices"))).alias("v"))
    whole = F.flatten(F.filter(F.transform("v", lambda x: x["vertices"]), lambda v: v.isNotNull()))
    return rows.select("chain", "node", F.coalesce("override", whole).alias("vertices"))


def plan_faults(steps: DataFrame, parts: DataFrame) -> DataFrame:
    """(oid, fault, pid): parts that a plan (oid, step, pid) misses, does not know or has twice, and plans of under two steps."""
    counted = steps.groupBy("oid", "pid").agg(F.count("*").alias("n"))
    missing = parts.select("oid", "pid").distinct().join(counted, ["oid", "pid"], "left_anti").join(steps.select("oid").distinct(), "oid", "left_semi").select("oid", F.lit("missing").alias("fault"), "pid")
    unknown = counted.join(parts.select("oid", "pid").distinct(), ["oid", "pid"], "left_anti").select("oid", F.lit("unknown").alias("fault"), "pid")
    twice = counted.filter("n > 1").select("oid", F.lit("duplicated").alias("fault"), "pid")
    pid = steps.schema["pid"].dataType
    short = steps.groupBy("oid").agg(F.countDistinct("step").alias("n")).filter("n < 2").select("oid", F.lit("short").alias("fault"), F.lit(None).cast(pid).alias("pid"))
    return missing.union(unknown).union(twice).union(short)


def cycle_slot(slots: Column, turn: Column) -> Column:
    return F.element_at(slots, (turn % F.size(slots)).cast("int") + 1)


def kept_chains(turns: DataFrame, wanted: int, share: float = 0.8) -> DataFrame:
    """Chains of which so large a share of turns succeeded."""
    return turns.groupBy("chain").agg(F.count_if("ok").alias("done")).filter(F.col("done") >= share * wanted)
