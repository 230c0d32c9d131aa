"""The part library: admission, ranks, bounding boxes, query texts, slot registry, host selection."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import shapes, text
from weftline.operators.keyed import first_by

# The categories of hosts, the first that matches wins, and the words that tell them.
CATEGORIES: dict[str, tuple[str, ...]] = {
    "vehicle": (
        "car", "truck", "bus", "van", "jeep", "tractor", "tank", "vehicle", "motorcycle", "bike", "bicycle", "scooter", "cart", "wagon",
        "train", "locomotive", "plane", "aircraft", "airplane", "helicopter", "drone", "boat", "ship", "submarine", "rocket", "spaceship",
        "spacecraft", "forklift", "excavator",
    ),
    "character": (
        "character", "man", "woman", "girl", "boy", "knight", "warrior", "soldier", "figure", "figurine", "humanoid", "person", "doll",
        "mascot", "wizard", "pirate", "ninja", "astronaut", "elf", "dwarf", "zombie", "hero", "king", "queen", "princess",
    ),
    "animal": (
        "animal", "dog", "cat", "bird", "fish", "rabbit", "bunny", "dragon", "dinosaur", "horse", "cow", "pig", "bear", "fox", "wolf",
        "lion", "tiger", "elephant", "frog", "turtle", "owl", "duck", "chicken", "penguin", "monkey", "deer", "sheep", "goat", "crab",
        "octopus", "whale", "shark", "snake", "insect", "bee", "butterfly", "creature", "monster",
    ),
    "robot": ("robot", "mech", "mecha", "droid", "android", "cyborg", "machine"),
    "furniture": (
        "chair", "table", "desk", "sofa", "couch", "bed", "shelf", "cabinet", "drawer", "stool", "bench", "wardrobe", "dresser",
        "bookcase", "lamp", "furniture",
    ),
    "building": (
        "house", "building", "cabin", "hut", "tower", "castle", "temple", "shop", "store", "barn", "windmill", "lighthouse", "shrine",
        "tent", "bridge", "room", "kitchen", "scene",
    ),
    "weapon": ("sword", "gun", "rifle", "pistol", "cannon", "bow", "axe", "hammer", "spear", "shield", "weapon", "blaster", "turret"),
    "plant": ("tree", "plant", "flower", "cactus", "mushroom", "bush", "bonsai", "palm", "grass", "pot"),
    "food": ("food", "burger", "cake", "pizza", "fruit", "apple", "ice cream", "sushi", "bread", "drink", "bottle", "cup", "mug", "coffee"),
    "appliance": (
        "camera", "phone", "computer", "monitor", "keyboard", "microphone", "speaker", "radio", "television", "tv", "console", "printer",
        "clock", "watch", "fan", "oven", "stove", "fridge", "washing", "toaster", "kettle", "blender", "drill",
    ),
    "instrument": ("guitar", "piano", "drum", "violin", "trumpet", "instrument", "keyboard"),
    "toy": ("toy", "lego", "block", "puzzle", "game", "chess"),
}


def category_pattern(words: Sequence[str]) -> str:
    return f"(^|[^A-Za-z0-9_])({'|'.join(words)})($|[^A-Za-z0-9_])"


def category(caption: Column, categories: dict[str, tuple[str, ...]] = CATEGORIES) -> Column:
    """The first category that a caption has a word of, in any case, else other. A caption is split into words once, for all categories."""
    low, rank = F.lower(caption), {}
    for at, words in enumerate(categories.values(), 1):
        for w in words:
            rank.setdefault(w, at)
    plain = {w: at for w, at in rank.items() if re.fullmatch("[A-Za-z0-9_]+", w)}
    ranks = F.create_map(*[F.lit(x) for pair in plain.items() for x in pair])
    found = F.array_intersect(F.split(low, "[^A-Za-z0-9_]+"), F.array(*[F.lit(w) for w in plain]))
    first = [F.array_min(F.transform(found, lambda w: ranks[w])) if plain else F.lit(None).cast("int"), F.lit(None).cast("int")]
    for w, at in rank.items():
        if w not in plain:  # of several words: looked for where its letters stand
            first.append(F.when(low.contains(w) & low.rlike(category_pattern([w])), at))
    return F.coalesce(F.get(F.array(*[F.lit(name) for name in categories]), F.least(*first) - 1), F.lit("other"))


def admitted_parts(captions: DataFrame, ranks: DataFrame, files: DataFrame) -> DataFrame:
    """captions (oid, pid, cap) that are admitted, with the bounding box of their rank (oid, pid, rank, n_boxes, lo, hi), and whose file (oid, pid) is there."""
    fit = captions.filter(text.is_admitted(F.col("cap")))
    boxed = ranks.filter(F.col("rank").isNotNull() & (F.col("rank") < F.col("n_boxes")))
    sizes = shapes.extents(F.col("lo"), F.col("hi"))
    parts = fit.join(boxed, ["oid", "pid"]).join(files.select("oid", "pid").distinct(), ["oid", "pid"], "left_semi")
    return parts.withColumns({"sig": shapes.shape_signature(sizes), "sym": shapes.axisymmetry(sizes), "cap": text.head_clause(F.col("cap"))})


def annotation_ranks(annotations: DataFrame) -> DataFrame:
    """(oid, pid, rank, n_boxes, lo, hi) from annotations with labels and boxes in parallel arrays (oid, labels, boxes of lo and hi)."""
    rows = annotations.select("oid", F.size("boxes").alias("n_boxes"), F.posexplode(F.arrays_zip("labels", "boxes")).alias("rank", "x"))
    return rows.select("oid", F.col("x.labels").alias("pid"), "rank", "n_boxes", F.col("x.boxes.lo").alias("lo"), F.col("x.boxes.hi").alias("hi"))


def query_texts(roles: DataFrame, rejects: Sequence[str] = ("rejects",)) -> DataFrame:
    """The distinct texts that need a vector, sorted: queries as they are, rejects as phrases."""
    asked = roles.select(F.explode("queries").alias("text"))
    for column in rejects:
        asked = asked.union(roles.select(F.explode(column).alias("text")).select(text.as_phrase(F.col("text"))))
    return asked.distinct().orderBy("text")


def missing_texts(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    return wanted.join(cache.select("text"), "text", "left_anti")


def coarsest_division(registry: DataFrame, granularity: str | None = None) -> DataFrame:
    """Of each oid the verified division with fewest groups (or the one asked for); of equals, the first put."""
    rows = registry.filter("verified")
    rows = rows.filter(F.col("granularity") == granularity) if granularity else rows
    return first_by(rows, ["oid"], [F.col("n_slots"), F.col("ord")])


def registry_from_manifest(nodes: DataFrame) -> DataFrame:
    """A division for each host from its start nodes (oid, node, pids): slots by node, named without the prefix."""
    slot = F.regexp_replace("node", "^slot_", "")
    return nodes.groupBy("oid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(slot.alias("slot"), "pids")))).alias("groups"))


def first_division_with_slot(manifest: DataFrame, registry: DataFrame) -> DataFrame:
    """For each slot of a host (oid, slot) the parts in the first division that has it; without one, the part of that name."""
    known = registry.select("oid", "ord", F.explode("groups").alias("slot", "pids"))
    first = known.groupBy("oid", "slot").agg(F.min_by("pids", "ord").alias("pids"))
    return manifest.join(first, ["oid", "slot"], "left").withColumn("pids", F.coalesce("pids", F.array("slot")))


def screened_hosts(
    parts: DataFrame, used: DataFrame, captioned: DataFrame, low: int = 8, high: int = 25, faces: int = 600_000, largest: float = 0.6, files: DataFrame | None = None, most_bytes: int = 60_000_000
) -> DataFrame:
    """Hosts by counts of their parts (oid, area, faces, component): in number, weight and connection fit for edits, captioned and unused.

    files (oid, bytes): hosts whose file is too large, or isn't there, are left out.
    """
    stats = parts.groupBy("oid").agg(
        F.count("*").alias("n"),
        F.countDistinct("component").alias("components"),
        F.coalesce(F.try_divide(F.max("area"), F.sum("area")), F.lit(0.0)).alias("largest"),
        F.sum("faces").alias("faces"),
    )
    fit = stats.filter(F.col("n").between(low, high) & (F.col("components") == 1) & (F.col("largest") < largest) & (F.col("faces") <= faces))
    if files is not None:
        fit = fit.join(files.filter(F.col("bytes") <= most_bytes).select("oid").distinct(), "oid", "left_semi")
    return fit.join(used.select("oid").distinct(), "oid", "left_anti").join(captioned.select("oid").distinct(), "oid", "left_semi")


def colourful(hosts: DataFrame, stats: DataFrame, least: float = 0.02) -> DataFrame:
    """Hosts without colour statistics, and those with textures of some saturation."""
    both = hosts.join(stats, "oid", "left")
    return both.filter(F.col("textured").isNull() | ((F.col("textured") > 0) & (F.col("saturation") >= least)))


def texture_stats(textures: DataFrame) -> DataFrame:
    """Mean saturation and brightness of a host's textures (oid, saturation, brightness; null where a part has none)."""
    return textures.groupBy("oid").agg(
        F.count("*").alias("parts"),
        F.count("saturation").alias("textured"),
        F.coalesce(F.avg("saturation"), F.lit(0.0)).alias("saturation"),
        F.coalesce(F.avg("brightness"), F.lit(1.0)).alias("brightness"),
    )


def round_robin(hosts: DataFrame, bucket: str, order: Sequence[Column], key: Column, limit: int) -> DataFrame:
    """Picks in turn from buckets, the largest bucket first, each in order, without keys that were picked before.

    A key counts in the first place that it has in the round. Turns are by rank within a bucket, so a repeated key uses up its
    bucket's turn. The limit is the feature.
    """
    ranked = hosts.withColumn("_turn", F.row_number().over(Window.partitionBy(bucket).orderBy(*order))).withColumn("_key", key)
    sizes = hosts.groupBy(bucket).agg(F.count("*").alias("_size"))
    placed = ranked.join(sizes, bucket)
    place = [F.col("_turn"), F.desc("_size"), F.col(bucket)]
    once = placed.withColumn("_seen", F.row_number().over(Window.partitionBy("_key").orderBy(*place))).filter("_seen = 1")
    return once.orderBy(*place).limit(limit).drop("_turn", "_key", "_size", "_seen")


def selected_hosts(screened: DataFrame, textures: DataFrame, captions: DataFrame, limit: int) -> DataFrame:
    """The hosts to edit, in one flow: screened ones (oid, n) whose textures have colour, taken in turn from the categories of their captions (oid, cap).

    In a category, those of most parts come first; a caption that begins like an earlier one is passed over. The limit is the feature.
    """
    told = colourful(screened, texture_stats(textures)).join(captions, "oid").withColumn("category", category(F.col("cap")))
    key = F.lower(F.substring("cap", 1, 40))
    return round_robin(told, "category", [F.desc("n"), F.col("oid")], key, limit).select("category", "oid", "n")


def installed_on(candidates: DataFrame, placements: DataFrame) -> DataFrame:
    """candidates (chain, oid, pid) with installed: where in the chain each is placed (chain, slot, turn, oid, pid), as slot(tN), sorted; empty for most."""
    placed = placements.select("chain", "oid", "pid", F.concat(F.coalesce("slot", F.lit("?")), F.lit("(t"), F.col("turn").cast("string"), F.lit(")")).alias("at"))
    known = placed.groupBy("chain", "oid", "pid").agg(F.array_sort(F.collect_set("at")).alias("installed"))
    both = candidates.join(known, ["chain", "oid", "pid"], "left")
    return both.withColumn("installed", F.coalesce("installed", F.expr("cast(array() as array<string>)")))


def to_build(hosts: DataFrame, plans: DataFrame, renders: DataFrame) -> DataFrame:
    """Hosts (oid) that have a plan and no render yet."""
    return hosts.join(plans.select("oid").distinct(), "oid", "left_semi").join(renders.select("oid").distinct(), "oid", "left_anti")


def is_contained(path: Column, root: Column) -> Column:
    """Whether a path, relative to a root or absolute, lies inside the root once its dots are followed; links aren't seen. Null is not."""
    base = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    inner = F.when(path.startswith("/"), F.when(path.startswith(base), F.substring(path, F.length(base) + 1, F.length(path)))).otherwise(path)
    steps = F.transform(F.split(inner, "/"), lambda x: F.when(x.isin("", "."), 0).when(x == "..", -1).otherwise(1))
    zero = F.struct(F.lit(0).alias("deep"), F.lit(0).alias("least"))
    walked = F.aggregate(steps, zero, lambda a, s: F.struct((a["deep"] + s).alias("deep"), F.least(a["least"], a["deep"] + s).alias("least")))
    return F.coalesce((walked["least"] >= 0) & (walked["deep"] > 0), F.lit(False))


def asset_faults(assets: DataFrame, files: DataFrame, root: Column) -> DataFrame:
    """(asset, fault) of derived assets (asset, path, sha256) that may not be used: outside the root, missing among files (path, content), or changed."""
    told = assets.join(files.select("path", F.sha2(F.col("content"), 256).alias("now")), "path", "left")
    fault = F.when(~is_contained(F.col("path"), root), "outside").when(F.col("now").isNull(), "missing").when(~F.lower("sha256").eqNullSafe(F.col("now")), "changed")
    return told.select("asset", fault.alias("fault")).filter("fault is not null")


def throughput(log: DataFrame) -> DataFrame:
    """(kind, parts, seconds, per_part) of a log of parts (kind, seconds), a row for each kind (done, tiny, invisible, or how it failed) and one for all (null)."""
    return log.rollup("kind").agg(F.count("*").alias("parts"), F.sum("seconds").alias("seconds"), F.avg("seconds").alias("per_part"))
