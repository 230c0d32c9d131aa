"""Queries of solids: the lines of an order as boxes, each a closed mesh of twelve triangles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import solids
from weftline.plans.faces import _BOX, boxes
from weftline.plans.geometry import meshes
from weftline.plans.registry import query, rounded, rounded_sql

PITCH = 0.0237
#: Corners are numbered by their bits x, y, z from the highest on; each side is two triangles.
SIDES = [[0, 1, 3], [0, 3, 2], [4, 6, 7], [4, 7, 5], [0, 4, 5], [0, 5, 1], [2, 3, 7], [2, 7, 6], [0, 2, 6], [0, 6, 4], [1, 5, 7], [1, 7, 3]]


def box_meshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    corners = F.array(*[F.array(*[F.col("hi" if k >> (2 - d) & 1 else "lo")[d] for d in range(3)]) for k in range(8)])
    sides = F.array(*[F.array(*[F.lit(v) for v in side]) for side in SIDES])
    return boxes(spark, sf_dir).select("oid", F.col("piece").alias("part"), corners.alias("vertices"), sides.alias("faces"))


def _cells(side: str) -> str:
    """Cells with their middles between the ends of a box along an axis."""
    return f"cast(ceil({side}1 / {PITCH} - 0.5) AS BIGINT)", f"cast(ceil({side}0 / {PITCH} - 0.5) AS BIGINT)"


_SPANS = ", ".join(f"{_cells(s)[1]} AS {s}a, {_cells(s)[0]} AS {s}b" for s in "xyz")


@query(
    f"""WITH s AS (SELECT oid, piece, {_SPANS} FROM ({_BOX})), n AS (SELECT *, (xb - xa) * (yb - ya) * (zb - za) AS cells FROM s),
    m AS (SELECT a.oid, a.piece AS a, b.piece AS b, a.cells, greatest(least(a.xb, b.xb) - greatest(a.xa, b.xa), 0) * greatest(least(a.yb, b.yb) - greatest(a.ya, b.ya), 0) * greatest(least(a.zb, b.zb) - greatest(a.za, b.za), 0) AS shared
      FROM n a JOIN n b ON a.oid = b.oid AND a.piece <> b.piece)
    SELECT oid, a, b, cells, shared, {rounded_sql('cast(shared AS DOUBLE) / cells', 6)} AS share FROM m WHERE shared > 0"""
)
def solid_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the boxes of an order that go through each other, how many cells they share; the SQL has it in closed form."""
    found = solids.overlaps(box_meshes(spark, sf_dir), PITCH, grouped=True)
    return found.withColumn("share", rounded(F.col("share"), 6))


@query()
def enclosing_spheres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest sphere around the lines of each order."""
    found = solids.enclosing_spheres(meshes(spark, sf_dir).select("oid", "vertices"), ["oid"])
    return found.select("oid", *[rounded(F.col("centre")[d], 6).alias(c) for d, c in enumerate("xyz")], rounded(F.col("radius"), 6).alias("radius"))
