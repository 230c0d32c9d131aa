"""Queries of meshes: the lines of an order as the vertices of a fan of triangles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import shapes
from weftline.operators import geometry
from weftline.plans.registry import query, rounded, rounded_sql
from weftline.session import table


def meshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(oid, vertices, faces); a vertex for each line, in order of number, price and part."""
    place = F.struct("l_linenumber", "l_extendedprice", "l_partkey", F.array(F.col("l_extendedprice") / 100000, F.col("l_quantity") / 50, F.col("l_discount") * 10).alias("v"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("oid")).agg(F.array_sort(F.collect_list(place)).alias("r"))
    fan = F.when(F.size("r") >= 3, F.transform(F.sequence(F.lit(1), F.size("r") - 2), lambda i: F.array(F.lit(0), i, i + 1))).otherwise(F.expr("cast(array() as array<array<int>>)"))
    return rows.select("oid", F.transform("r", lambda x: x["v"]).alias("vertices"), fan.alias("faces"))


@query()
def mesh_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = geometry.measured_meshes(meshes(spark, sf_dir), ["oid"])
    return told.select("oid", "components", rounded(F.col("isolation")).alias("isolation"), "patches", rounded(F.col("slender")).alias("slender"))


@query(
    f"""WITH b AS (SELECT l_orderkey AS oid, min(l_extendedprice / 100000) AS x0, max(l_extendedprice / 100000) AS x1, min(l_quantity / 50) AS y0, max(l_quantity / 50) AS y1,
      min(l_discount * 10) AS z0, max(l_discount * 10) AS z1 FROM lineitem GROUP BY l_orderkey)
    SELECT oid, {rounded_sql("sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) + (z1 - z0) * (z1 - z0))")} AS diagonal, {rounded_sql("2 * x0 + 1")} AS moved_x FROM b"""
)
def mesh_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagonals of bounding boxes, and the lower end of the box after doubling the mesh and moving it by 1 along x."""
    double = F.array(*[F.lit(float(x)) for x in (2, 0, 0, 1, 0, 2, 0, 0, 0, 0, 2, 0, 0, 0, 0, 1)])
    boxed = meshes(spark, sf_dir).select("oid", shapes.bounds(F.col("vertices")).alias("b"), shapes.bounds(shapes.moved(F.col("vertices"), double)).alias("m"))
    return boxed.select("oid", rounded(shapes.norm(shapes.extents(F.col("b.lo"), F.col("b.hi")))).alias("diagonal"), rounded(F.col("m.lo")[0]).alias("moved_x"))
