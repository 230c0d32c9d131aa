"""Meshes of binary glTF scenes, read by byte ranges: the header of a file, then of each mesh the ranges that its accessors name.

A file is listed by its path and length alone; what is in it is read where its row is, a mesh at a time, so neither a file nor a header has to fit
a cell, and files of any size can be read. Paths must be of a store that pyarrow can open (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.files import _matrix

#: Fixed values of the format: numpy's names of component types, and how many components an element has.
COMPONENTS = {5120: "<i1", 5121: "<u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}
ELEMENTS = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4}
TRIANGLES = 4
_ROW = "path string, mesh string, vertices array<array<double>>, faces array<array<int>>, bytes_read long, why string"


class Ranges:
    """A file that is read by ranges, and how many bytes of it were."""

    def __init__(self, path: str):
        from pyarrow import fs

        store, inside = fs.FileSystem.from_uri(path)
        self.file, self.read_bytes = store.open_input_file(inside), 0

    def __call__(self, start: int, size: int) -> bytes:
        out = self.file.read_at(size, start)
        if len(out) < size:
            raise ValueError(f"the file ends before {start + size}")
        self.read_bytes += size
        return out

    def close(self) -> None:
        self.file.close()


def read_header(read: Ranges) -> tuple[dict, int]:
    """The scene of a file, and where its buffer begins."""
    magic, _, _, size, kind = struct.unpack("<4sIII4s", read(0, 20))
    if magic != b"glTF" or kind != b"JSON":
        raise ValueError("no binary scene")
    return json.loads(read(20, size)), 20 + size + 8


def _accessor(read: Ranges, scene: dict, base: int, number: int) -> np.ndarray:
    """The elements of an accessor, from the range of its view that they take."""
    told = scene["accessors"][number]
    view = scene["bufferViews"][told["bufferView"]]
    if view.get("buffer", 0) != 0 or "uri" in scene["buffers"][0] or "sparse" in told:
        raise ValueError("only what is in the file itself can be read")
    kind, width, n = np.dtype(COMPONENTS[told["componentType"]]), ELEMENTS[told["type"]], told["count"]
    step = view.get("byteStride", kind.itemsize * width)
    start = base + view.get("byteOffset", 0) + told.get("byteOffset", 0)
    raw = read(start, step * (n - 1) + kind.itemsize * width) if n else b""
    return np.ndarray((n, width), kind, raw, strides=(step, kind.itemsize)) if n else np.zeros((0, width), kind)


def meshes_of(read: Ranges) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(mesh, vertices, faces) of each mesh, its parts one behind the other, where the first node that has it places it."""
    scene, base = read_header(read)
    nodes = scene.get("nodes", [])
    inner = {c for n in nodes for c in n.get("children", ())}
    todo = [(i, np.eye(4)) for i in range(len(nodes)) if i not in inner]
    placed: dict[int, tuple[int, np.ndarray]] = {}
    while todo:
        at, above = todo.pop()
        here = above @ _matrix(nodes[at])
        if (mesh := nodes[at].get("mesh")) is not None and (mesh not in placed or at < placed[mesh][0]):
            placed[mesh] = (at, here)
        todo += [(c, here) for c in nodes[at].get("children", ())]
    for k, mesh in enumerate(scene.get("meshes", [])):
        here = placed.get(k, (0, np.eye(4)))[1]
        vertices, faces, before = [], [], 0
        for part in mesh.get("primitives", ()):
            if "POSITION" not in part.get("attributes", {}) or part.get("mode", TRIANGLES) != TRIANGLES:
                continue
            v = _accessor(read, scene, base, part["attributes"]["POSITION"]).astype(float)
            f = _accessor(read, scene, base, part["indices"]).astype(np.int64).ravel() if "indices" in part else np.arange(len(v))
            vertices.append(v @ here[:3, :3].T + here[:3, 3])
            faces.append(f[: len(f) // 3 * 3].reshape(-1, 3) + before)
            before += len(v)
        if vertices:
            yield mesh.get("name", f"mesh_{k}"), np.concatenate(vertices), np.concatenate(faces)


def scene_meshes(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    """(path, mesh, vertices, faces, bytes_read) of the files, and those that can't be read to their end (path, why). bytes_read: of the file, up to and with the mesh."""

    def load(frames: Iterator) -> Iterator:
        import pandas as pd

        names = [c.split()[0] for c in _ROW.split(", ")]
        for pdf in frames:
            for path in pdf["path"]:
                read = None
                try:
                    read = Ranges(path)
                    for name, v, f in meshes_of(read):
                        yield pd.DataFrame([(path, name, v.tolist(), f.tolist(), read.read_bytes, None)], columns=names)
                except (ValueError, KeyError, IndexError, TypeError, struct.error, OSError) as wrong:
                    yield pd.DataFrame([(path, None, None, None, None, repr(wrong))], columns=names).astype({"bytes_read": "Int64"})
                finally:
                    if read:
                        read.close()

    files = spark.read.format("binaryFile").load(glob).select("path", "length")  # their contents are not read
    told = files.repartition("path").select("path").mapInPandas(load, _ROW)
    return told.filter("why is null").drop("why"), told.filter("why is not null").select("path", "why")


def grouped_pieces(parts: DataFrame, groups: DataFrame) -> DataFrame:
    """(oid, slot, vertices, faces, pids) of each group: its parts (oid, pid, vertices, faces) one behind the other, in the order of groups (oid, slot, ord, pid)."""
    rows = groups.join(parts, ["oid", "pid"]).groupBy("oid", "slot").agg(F.array_sort(F.collect_list(F.struct("ord", "pid", "vertices", "faces"))).alias("r"))
    before = lambda i: F.aggregate(F.slice("r", F.lit(1), i), F.lit(0), lambda n, x: n + F.size(x["vertices"]))
    moved = F.flatten(F.transform("r", lambda x, i: F.transform(x["faces"], lambda f: F.transform(f, lambda v: v + before(i)))))
    return rows.select("oid", "slot", F.flatten(F.transform("r", lambda x: x["vertices"])).alias("vertices"), moved.alias("faces"), F.transform("r", lambda x: x["pid"]).alias("pids"))
