"""Queries of planned chains: orders as hosts, their lines as slots, and the parts of a slot's own brand and size as candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import planner
from weftline.plans.registry import query
from weftline.session import table

TURNS = 10
_KIND = "p_brand || '/' || (p_size % 10)"


@query(
    f"""WITH RECURSIVE slots AS (SELECT l_orderkey AS oid, cast(l_linenumber AS BIGINT) AS slot, max(l_partkey) AS occupant FROM lineitem GROUP BY l_orderkey, l_linenumber),
    lib AS (SELECT {_KIND} AS kind, p_partkey, row_number() OVER (PARTITION BY {_KIND} ORDER BY p_retailprice, p_partkey) AS r FROM part),
    lists AS (SELECT kind, list(p_partkey ORDER BY r) AS cands FROM lib WHERE r <= {TURNS + 1} GROUP BY kind),
    hosts AS (SELECT s.oid, list(s.slot ORDER BY s.slot) AS slots, list(s.occupant ORDER BY s.slot) AS held, list(coalesce(l.cands, []) ORDER BY s.slot) AS cands
      FROM slots s JOIN part p ON p.p_partkey = s.occupant LEFT JOIN lists l ON l.kind = {_KIND} GROUP BY s.oid HAVING count(*) >= 2),
    fold AS (SELECT oid, slots, cands, 0 AS turn, held, cast([] AS BIGINT[]) AS used, cast(NULL AS BIGINT) AS slot, cast(NULL AS BIGINT) AS removed, cast(NULL AS BIGINT) AS added, cast(NULL AS BIGINT) AS refused FROM hosts
      UNION ALL SELECT oid, slots, cands, turn + 1, CASE WHEN pick IS NULL THEN held ELSE list_concat(list_append(held[1:i - 1], pick), held[i + 1:]) END, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END,
        slots[i], held[i], pick, list_position(cands[i], pick) - 1 FROM (SELECT *, list_filter(cands[i], lambda c: NOT list_contains(used, c) AND c <> held[i])[1] AS pick FROM (
          SELECT *, turn % len(slots) + 1 AS i FROM fold WHERE turn < {TURNS}))),
    made AS (SELECT *, count(*) OVER (PARTITION BY oid) AS n FROM fold WHERE added IS NOT NULL)
    SELECT oid, turn, slot, removed, added, cast(refused AS INT) AS refused FROM made WHERE n >= {TURNS * planner.KEPT}"""
)
def planned_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten turns for every order of two lines and more; the cheapest parts of a brand and size come first."""
    slots = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("oid"), F.col("l_linenumber").cast("long").alias("slot")).agg(F.max("l_partkey").alias("occupant"))
    kind = F.concat_ws("/", "p_brand", F.col("p_size") % 10).alias("kind")
    parts = table(spark, sf_dir, "part").select(kind, F.col("p_partkey").alias("candidate"), "p_retailprice")
    typed = slots.join(parts.select("kind", F.col("candidate").alias("occupant")), "occupant")
    candidates = parts.select("kind", F.col("p_retailprice").alias("rank"), "candidate")
    return planner.planned_chains(typed.select("oid", "slot", F.col("slot").alias("ord"), "occupant", "kind"), candidates, TURNS, by=("kind",))
