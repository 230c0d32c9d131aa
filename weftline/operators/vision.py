"""Visible change, regions and masks on tables of pixels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import shared_folder

# Fixed values.
CHANGED, OPAQUE, VIEWS, LEAST_BYTES = 14, 8, 4, 1024


def over_white(colour: Column, alpha: Column) -> Column:
    return colour * alpha / 255.0 + 255.0 - alpha


def complete_frames(files: DataFrame, keys: list[str]) -> DataFrame:
    """Frames with a file of some size for each view (view, length)."""
    return files.groupBy(*keys).agg(F.count_if(F.col("length") >= LEAST_BYTES).alias("n")).filter(F.col("n") == VIEWS).drop("n")


def change_fraction(pairs: DataFrame, keys: list[str], views: int = VIEWS) -> DataFrame:
    """The largest share of changed pixels over all views, and the share of each; null metric if a view is missing.

    pairs: (view, and r, g, b, a of both frames as r1 ... a2), colours over white. Pixels opaque in either frame count.
    """
    apart = F.greatest(*[F.abs(F.col(f"{c}1") - F.col(f"{c}2")) for c in "rgb"])
    per = pairs.groupBy(*keys, "view").agg(
        (F.count_if(apart > CHANGED) / F.greatest(F.count_if((F.col("a1") > OPAQUE) | (F.col("a2") > OPAQUE)), F.lit(1))).alias("share")
    )
    rows = per.groupBy(*keys).agg(F.max("share").alias("metric"), F.array_sort(F.collect_list(F.struct("view", "share"))).alias("per"), F.count("*").alias("n"))
    return rows.withColumn("metric", F.when(F.col("n") == views, F.col("metric"))).withColumn("per", F.transform("per", lambda x: x["share"])).drop("n")


def previous_frame(own_previous: Column, turn_before: Column) -> Column:
    """The frame of the turn before under this turn's camera, or, where there is none, its own."""
    return F.coalesce(own_previous, turn_before)


def change_percentiles(metrics: DataFrame, column: str = "metric", at: tuple[float, ...] = (0.0, 0.05, 0.1, 0.25, 0.5, 0.9)) -> DataFrame:
    """(p, value): exact percentiles, between two values in proportion; null where there are no values.

    Values are dealt by ranges; their numbers tell in which few ranges the wanted ranks are, and only those are ranked.
    """
    spark = metrics.sparkSession
    shared_folder(spark)
    values = metrics.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    held = values.repartitionByRange("v").withColumn("range", F.spark_partition_id()).checkpoint()
    many = [(r["range"], r["n"]) for r in held.groupBy("range").agg(F.count("*").alias("n"), F.min("v").alias("low")).orderBy("low").collect()]  # one for each range
    starts, total = {}, 0
    for part, n in many:
        starts[part] = (total, n)
        total += n
    places = [p * (total - 1) for p in at] if total else []
    wanted = {r for x in places for r in (math.floor(x), math.ceil(x))}
    cells = [(part, r - first) for part, (first, n) in starts.items() for r in wanted if first <= r < first + n]
    told = spark.createDataFrame([(part, k + 1) for part, k in cells] or [(-1, 0)], "range int, k int")
    ranked = held.join(F.broadcast(told.select("range").distinct()), "range").withColumn("k", F.row_number().over(Window.partitionBy("range").orderBy("v")))
    found = {starts[r["range"]][0] + r["k"] - 1: r["v"] for r in ranked.join(F.broadcast(told), ["range", "k"]).collect()}  # two for each of at
    made = [(p, found[math.floor(x)] + (found[math.ceil(x)] - found[math.floor(x)]) * (x - math.floor(x))) for p, x in zip(at, places)] or [(p, None) for p in at]
    return spark.createDataFrame(made, "p double, value double")


def lowest(metrics: DataFrame, column: str = "metric", many: int = 14) -> DataFrame:
    """The rows that changed least, the limit being the feature; nulls are not among them."""
    return metrics.filter(F.col(column).isNotNull()).orderBy(column, *[c for c in metrics.columns if c != column]).limit(many)


def changed_region(pixels: DataFrame, keys: list[str], width: int, height: int, margin: int = 6) -> DataFrame:
    """The box around pixels that changed in alpha (d_alpha > 64) or colour (d_rgb > 96), with a margin, within the frame."""
    hit = pixels.filter((F.col("d_alpha") > 64) | (F.col("d_rgb") > 96))
    return hit.groupBy(*keys).agg(
        F.greatest(F.min("x") - margin, F.lit(0)).alias("x0"), F.greatest(F.min("y") - margin, F.lit(0)).alias("y0"),
        F.least(F.max("x") + margin + 1, F.lit(width)).alias("x1"), F.least(F.max("y") + margin + 1, F.lit(height)).alias("y1"),
    )


def mask_areas(mask: DataFrame, parts: int) -> DataFrame:
    """(part, view, area): pixels of each part in each view; ids of no part are left out."""
    return mask.filter(F.col("part").between(0, parts - 1)).groupBy("part", "view").agg(F.count("*").alias("area"))


def best_view(areas: DataFrame, keys: list[str]) -> DataFrame:
    """The view that shows most of a part, the first of equals."""
    return areas.groupBy(*keys).agg(F.max(F.struct("area", (-F.col("view")).alias("back"))).alias("m")).select(*keys, (-F.col("m.back")).alias("view"), F.col("m.area").alias("area"))


def two_best_views(areas: DataFrame, keys: list[str]) -> DataFrame:
    """The two views that show most of a part; the one there is, twice, if only one shows it."""
    ranked = areas.filter("area > 0").withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("area"), "view"))).filter("_r <= 2")
    both = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_r", "view"))).alias("v"))
    views = F.transform("v", lambda x: x["view"])
    return both.select(*keys, F.when(F.size(views) == 1, F.concat(views, views)).otherwise(views).alias("views"))


def part_visibility(area: Column, least: int = 400) -> Column:
    return F.when(area <= 0, "invisible").when(area < least, "tiny").otherwise("visible")


def duplicated_faces(faces: DataFrame, keys: list[str]) -> DataFrame:
    """How many faces an object repeats, whatever the order of their corners (a, b, c)."""
    return faces.groupBy(*keys).agg((F.count("*") - F.countDistinct(F.array_sort(F.array("a", "b", "c")))).alias("duplicated"))
