"""Queries of visible change: vectors as frames of 8 by 8 pixels, four in a row as the views of a turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import vision
from weftline.plans.registry import query, rounded, rounded_sql
from weftline.session import table

_PAIRS = """frames AS (SELECT vec_id // 4 AS turn, vec_id % 4 AS view, vec_id, embedding AS e FROM embeddings),
pixels AS (SELECT turn, view, unnest(range(0, 64)) AS i, e FROM frames),
pairs AS (SELECT a.turn, a.view, a.i, 128 + 400 * cast(a.e[a.i + 1] AS DOUBLE) AS r1, 128 + 400 * cast(b.e[b.i + 1] AS DOUBLE) AS r2
  FROM pixels a JOIN pixels b ON b.turn = a.turn - 1 AND b.view = a.view AND b.i = a.i)"""
_METRIC = f"""{_PAIRS}, per AS (SELECT turn, view, cast(count(*) FILTER (WHERE abs(r1 - r2) > 14) AS DOUBLE) / greatest(count(*) FILTER (WHERE r1 > 8 OR r2 > 8), 1) AS share FROM pairs GROUP BY turn, view),
metrics AS (SELECT turn, CASE WHEN count(*) = 4 THEN max(share) END AS metric FROM per GROUP BY turn)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 4").alias("turn"), (F.col("vec_id") % 4).alias("view"), F.posexplode("embedding").alias("i", "v"))
    return frames.select("turn", "view", "i", (128 + 400 * F.col("v").cast("double")).alias("r"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = pixels(spark, sf_dir)
    before = now.select((F.col("turn") + 1).alias("turn"), "view", "i", F.col("r").alias("r2"))
    both = now.withColumnRenamed("r", "r1").join(before, ["turn", "view", "i"])
    for k in "12":
        both = both.withColumns({f"{c}{k}": F.col(f"r{k}") for c in "gba"})
    return both


@query(f"WITH {_METRIC} SELECT turn, {rounded_sql('metric')} AS metric FROM metrics")
def change_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vision.change_fraction(pairs(spark, sf_dir), ["turn"]).select("turn", rounded(F.col("metric")).alias("metric"))


_AT = (0.0, 0.05, 0.1, 0.25, 0.5, 0.9)


@query(f"WITH {_METRIC} " + " UNION ALL ".join(f"SELECT cast({p} AS DOUBLE) AS p, {rounded_sql(f'quantile_cont(metric, {p})')} AS value FROM metrics" for p in _AT))
def change_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = vision.change_fraction(pairs(spark, sf_dir), ["turn"])
    return vision.change_percentiles(metrics).select("p", rounded(F.col("value")).alias("value"))


@query(f"WITH {_METRIC} SELECT turn, {rounded_sql('metric')} AS metric FROM metrics WHERE metric IS NOT NULL ORDER BY metrics.metric, turn LIMIT 14")
def change_lowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourteen turns that changed least; the limit is the feature."""
    metrics = vision.change_fraction(pairs(spark, sf_dir), ["turn"]).select("turn", "metric")
    return vision.lowest(metrics).select("turn", rounded(F.col("metric")).alias("metric"))


@query(
    f"""WITH {_PAIRS}, hit AS (SELECT turn, view, i % 8 AS x, i // 8 AS y FROM pairs WHERE abs(r1 - r2) > 64)
    SELECT turn, view, greatest(min(x) - 1, 0) AS x0, greatest(min(y) - 1, 0) AS y0, least(max(x) + 2, 8) AS x1, least(max(y) + 2, 8) AS y1 FROM hit GROUP BY turn, view"""
)
def changed_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    apart = F.abs(F.col("r1") - F.col("r2"))
    placed = pairs(spark, sf_dir).select("turn", "view", F.expr("cast(i as long) % 8").alias("x"), F.expr("cast(i as long) div 8").alias("y"), apart.alias("d_alpha"), apart.alias("d_rgb"))
    box = vision.changed_region(placed, ["turn", "view"], 8, 8, margin=1)
    return box.select("turn", "view", *[F.col(c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")])


_MASK = "mask AS (SELECT l_suppkey % 40 - 2 AS part, l_linenumber AS view FROM lineitem), areas AS (SELECT part, view, count(*) AS area FROM mask WHERE part BETWEEN 0 AND 34 GROUP BY part, view)"


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as pixels of a mask: suppliers as parts, line numbers as views."""
    mask = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40 - 2).alias("part"), F.col("l_linenumber").alias("view"))
    return vision.mask_areas(mask, 35)


@query(f"WITH {_MASK} SELECT part, view, area, CASE WHEN area < 400 THEN 'tiny' ELSE 'visible' END AS seen FROM areas")
def mask_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return areas(spark, sf_dir).withColumn("seen", vision.part_visibility(F.col("area")))


@query(f"WITH {_MASK} SELECT part, view, area FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY area DESC, view) AS r FROM areas) WHERE r = 1")
def best_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vision.best_view(areas(spark, sf_dir), ["part"])


@query(
    f"""WITH {_MASK}, r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY area DESC, view) AS r FROM areas)
    SELECT a.part, a.view AS first, coalesce(b.view, a.view) AS second FROM r a LEFT JOIN r b ON a.part = b.part AND b.r = 2 WHERE a.r = 1"""
)
def two_best_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = vision.two_best_views(areas(spark, sf_dir), ["part"])
    return views.select("part", F.col("views")[0].alias("first"), F.col("views")[1].alias("second"))


@query(
    """SELECT l_orderkey AS oid, count(*) - count(DISTINCT list_sort([l_partkey % 3, l_suppkey % 3, cast(l_linenumber % 3 AS BIGINT)])) AS duplicated FROM lineitem GROUP BY l_orderkey"""
)
def duplicated_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    corners = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("oid"), (F.col("l_partkey") % 3).alias("a"), (F.col("l_suppkey") % 3).alias("b"), (F.col("l_linenumber").cast("long") % 3).alias("c"))
    return vision.duplicated_faces(corners, ["oid"])
