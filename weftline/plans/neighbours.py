"""Queries of neighbours: the lines of a supplier as the points of an object, of the part that their number names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import neighbours
from weftline.plans.graphs import TAU, points
from weftline.plans.registry import query, rounded, rounded_sql
from weftline.session import table

_CLOUD = """cloud AS (SELECT l_suppkey AS oid, cast(l_linenumber AS BIGINT) AS part, min(l_orderkey * 10 + l_linenumber) AS pid, l_extendedprice / 100000 AS x, l_quantity / 50 AS y, l_discount * 10 AS z
  FROM lineitem GROUP BY ALL)"""
_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of suppliers, one for each part and place."""
    lines = table(spark, sf_dir, "lineitem")
    p = F.array(F.col("l_extendedprice") / 100000, F.col("l_quantity") / 50, F.col("l_discount") * 10)
    rows = lines.select(F.col("l_suppkey").alias("oid"), F.col("l_linenumber").cast("long").alias("part"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pid"), p.alias("p"))
    return rows.groupBy("oid", "part", "p").agg(F.min("pid").alias("pid"))


@query(
    f"""WITH {_CLOUD}, told AS (SELECT a.oid, a.part, a.pid, min((({_D2}), b.part, b.pid)) AS m FROM cloud a JOIN cloud b ON a.oid = b.oid AND a.part <> b.part GROUP BY ALL)
    SELECT oid, part, pid, m[2] AS to_part, m[3] AS to_pid, {rounded_sql('sqrt(m[1])', 9)} AS distance FROM told"""
)
def nearest_other_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.nearest(cloud(spark, sf_dir))
    return found.select("oid", "part", "pid", "to_part", "to_pid", rounded(F.col("distance"), 9).alias("distance"))


@query(
    f"""WITH {_CLOUD}, told AS (SELECT a.oid, a.part, a.pid, b.part AS to_part, b.pid AS to_pid, {_D2} AS d2, row_number() OVER (PARTITION BY a.oid, a.part, a.pid ORDER BY {_D2}, b.part, b.pid) AS rank
      FROM cloud a JOIN cloud b ON a.oid = b.oid AND a.pid <> b.pid)
    SELECT oid, part, pid, cast(rank AS INT) AS rank, to_part, to_pid, {rounded_sql('sqrt(d2)', 9)} AS distance FROM told WHERE rank <= 4"""
)
def nearest_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.nearest(cloud(spark, sf_dir), k=4, other=False)
    return found.withColumn("distance", rounded(F.col("distance"), 9))


@query(
    f"""WITH {_CLOUD}, told AS (SELECT a.oid, a.part, a.pid, sqrt(min({_D2})) AS d FROM cloud a JOIN cloud b ON a.oid = b.oid AND a.part <> b.part GROUP BY ALL)
    SELECT oid, part, {rounded_sql('min(d)', 9)} AS gap, {rounded_sql('avg(CASE WHEN d < 0.02 THEN 1.0 ELSE 0.0 END)', 6)} AS share FROM told GROUP BY ALL"""
)
def part_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each part is from the others of its object, and the share of its points that lie within two hundredths."""
    found = neighbours.part_gaps(cloud(spark, sf_dir))
    return found.select("oid", "part", rounded(F.col("gap"), 9).alias("gap"), rounded(F.col("share"), 6).alias("share"))


@query()
def anchoring_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as objects, their first lines as anchors: the edges that hang on them what touches nothing."""
    nodes = points(spark, sf_dir)
    found = neighbours.virtual_edges(nodes, TAU, nodes.filter("part = 1").select("oid", "part"))
    return found.withColumn("gap", rounded(F.col("gap"), 9))
