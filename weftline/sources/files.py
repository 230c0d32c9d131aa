"""Reading and writing the formats around a part library, so that bad input is counted and set aside rather than fatal."""

from __future__ import annotations

import json
import struct
import time
import uuid
from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import remove


def json_documents(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """Whole JSON documents from the first of some places that there is; none gives no rows."""
    for path in paths:
        try:
            return spark.read.schema(schema).option("multiLine", True).json(path)
        except AnalysisException:
            continue
    return spark.createDataFrame([], schema)


def json_lines(spark: SparkSession, glob: str, schema: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines, the last of each key in the order of files and lines; and the lines that can't be read (path, line).

    Large files are read in splits; the order of lines is that of splits, and of lines within each.
    """
    lines = spark.read.text(glob).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line")
    )
    parsed = lines.filter(F.trim("line") != "").withColumn("row", F.from_json("line", schema))
    good = F.col("row").isNotNull()
    for key in keys:
        good = good & F.col(f"row.{key}").isNotNull()
    at = ["path", "block", "place"]
    rows = parsed.filter(good).select(*at, "row.*")
    names = [c for c in rows.columns if c not in (*at, *keys)]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct(*at)).alias("r")) if names else rows.select(*keys).distinct()
    return (last.select(*keys, "r.*") if names else last), parsed.filter(~good).select("path", "line")


def tolerant_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Documents that can be read, one a file, and the corrupt ones (path, document), to be put in quarantine; a missing path gives neither.

    A document may be written with an indent, over many lines; one verdict is given for each file. A file without a byte is to Spark
    like a missing one; one of blanks is corrupt.
    """
    fields = [f.name for f in spark.createDataFrame([], schema).schema]
    try:
        files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document"))
    except AnalysisException:
        files = spark.createDataFrame([], "path string, document string")
    read = files.withColumn("d", F.from_json("document", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    good = F.coalesce(F.col("d").isNotNull() & F.col("d._corrupt_record").isNull() & (F.trim("document") != ""), F.lit(False))
    return read.filter(good).select(*[F.col(f"d.{c}") for c in fields]), read.filter(~good).select("path", "document")


def caption_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(oid, object, parts) of one caption file for each object, and the files (oid) that can't be read; objects without parts are left out."""
    files = spark.read.text(f"{folder}/*.json", wholetext=True)
    oid = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)
    told = files.select(oid.alias("oid"), F.from_json("value", "object array<string>, parts map<string,array<string>>").alias("d"))
    whole = F.coalesce(F.size("d.parts") > 0, F.lit(False))
    return told.filter(whole).select("oid", "d.object", "d.parts"), told.filter("d is null or (d.object is null and d.parts is null)").select("oid")


def split_captions(captions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Part captions (oid, pid, brief, detailed) and object captions (oid, brief, detailed)."""
    parts = captions.select("oid", F.explode("parts").alias("pid", "c")).select("oid", "pid", F.get("c", F.lit(0)).alias("brief"), F.get("c", F.lit(1)).alias("detailed"))
    return parts, captions.select("oid", F.get("object", F.lit(0)).alias("brief"), F.get("object", F.lit(1)).alias("detailed"))


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions of a keyed table that were written to their end."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(place)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def keyed_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The last whole version of a keyed table; None if there is none."""
    versions = _versions(spark, path)
    return spark.read.parquet(f"{path}/v{versions[-1]}") if versions else None


def keyed_overwrite(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], lapse_seconds: int = 6 * 3600) -> None:
    """Rows of new in place of those under their keys, as the next version of the table at path.

    Readers see the last whole version, whatever becomes of a writer. The number is claimed by a file that only one writer can
    make; the other one gets an error and may try again. The claim of a writer that died lapses after so long; if it was only slow,
    it finds its number taken and fails, since a version appears whole, by a rename. Versions before the last two are removed.
    """
    from weftline.operators.keyed import overwritten

    versions = _versions(spark, path)
    number = versions[-1] + 1 if versions else 1
    of = spark._jvm.org.apache.hadoop.fs.Path
    place, made, written = of(f"{path}/v{number}.claim"), of(f"{path}/v{number}"), f"{path}/_making-{uuid.uuid4().hex}"
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(place) and fs.getFileStatus(place).getModificationTime() < (time.time() - lapse_seconds) * 1000:
        fs.delete(place, False)
    fs.create(place, False).close()
    try:
        old = keyed_table(spark, path)
        (new if old is None else overwritten(old, new, keys)).write.parquet(written)
        if fs.exists(made) and not fs.exists(of(f"{path}/v{number}/_SUCCESS")):
            fs.delete(made, True)  # left by a writer that wrote in place
        if fs.exists(made) or not fs.rename(of(written), made):
            raise FileExistsError(f"version {number} of {path} was written by another writer")
    finally:
        fs.delete(of(written), True)
        fs.delete(place, False)
    for n in versions[:-1]:
        remove(spark, f"{path}/v{n}")


def remaining(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What an interrupted run still has to do."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def chain_id(oid: Column) -> Column:
    return F.concat(F.lit("A/"), F.substring(oid, 1, 8), F.lit("_s0"))


def _matrix(node: dict) -> np.ndarray:
    """A node's own transform: its matrix, which is written by columns, or turn, scale and shift."""
    if "matrix" in node:
        return np.array(node["matrix"], float).reshape(4, 4, order="F")
    *axis, w = node.get("rotation", (0.0, 0.0, 0.0, 1.0))
    cross = np.cross(np.eye(3), axis)  # cross @ v is the product of axis and v
    out = np.eye(4)
    out[:3, :3] = (np.eye(3) + 2 * w * cross + 2 * cross @ cross) * np.array(node.get("scale", (1.0, 1.0, 1.0)))
    out[:3, 3] = node.get("translation", (0.0, 0.0, 0.0))
    return out


def binary_scene_boxes(header: bytes) -> list[tuple[str, list[float], list[float], int]]:
    """(mesh, lo, hi, faces) of each mesh of a binary glTF scene, from the bounds in its header alone, where its first node places it.

    A mesh that no node places stays as it is; one without a name is mesh_ and its number. Not such a file: a ValueError.
    """
    if len(header) < 20 or header[:4] != b"glTF" or header[16:20] != b"JSON":
        raise ValueError("no binary scene")
    scene = json.loads(header[20 : 20 + struct.unpack_from("<I", header, 12)[0]])
    nodes, accessors = scene.get("nodes", []), scene.get("accessors", [])
    inner = {c for n in nodes for c in n.get("children", ())}
    world: dict[int, np.ndarray] = {}
    todo = [(i, np.eye(4)) for i in range(len(nodes)) if i not in inner]
    while todo:
        at, above = todo.pop()
        world[at] = above @ _matrix(nodes[at])
        todo += [(c, world[at]) for c in nodes[at].get("children", ())]
    placed: dict[int, np.ndarray] = {}
    for i, node in enumerate(nodes):
        if "mesh" in node:
            placed.setdefault(node["mesh"], world.get(i, np.eye(4)))
    out = []
    for k, mesh in enumerate(scene.get("meshes", [])):
        here, corners, faces = placed.get(k, np.eye(4)), [], 0
        for part in mesh.get("primitives", ()):
            if "POSITION" in (told := part.get("attributes", {})):
                box = accessors[told["POSITION"]]
                sides = zip(box["min"], box["max"], strict=True)
                corners += [here[:3, :3] @ np.array(c, float) + here[:3, 3] for c in product(*sides)]
                faces += (accessors[part["indices"]] if "indices" in part else box)["count"] // 3
        if corners:
            out.append((mesh.get("name", f"mesh_{k}"), np.min(corners, 0).tolist(), np.max(corners, 0).tolist(), int(faces)))
    return out


def scene_boxes(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    """(path, mesh, lo, hi, faces) for binary glTF files, and the files that can't be read (path, why). Headers alone go to Python."""

    def read(frames: Iterator) -> Iterator:
        import pandas as pd

        for pdf in frames:
            rows = []
            for path, header in zip(pdf["path"], pdf["header"], strict=True):
                try:
                    rows += [(path, *box, None) for box in binary_scene_boxes(bytes(header))]
                except (ValueError, KeyError, IndexError, struct.error) as wrong:
                    rows.append((path, None, None, None, None, repr(wrong)))
            yield pd.DataFrame(rows, columns=["path", "mesh", "lo", "hi", "faces", "why"]).astype({"faces": "Int64"})

    size = F.conv(F.hex(F.concat(*[F.substring("content", 16 - k, 1) for k in range(4)])), 16, 10).cast("long")
    files = spark.read.format("binaryFile").load(glob)
    header = F.substring(F.col("content"), F.lit(1), F.least(F.coalesce(size, F.lit(0)), F.lit(1 << 30)).cast("int") + 20)
    told = files.select("path", header.alias("header")).mapInPandas(read, "path string, mesh string, lo array<double>, hi array<double>, faces long, why string")
    return told.filter("why is null").drop("why"), told.filter("why is not null").select("path", "why")
