from __future__ import annotations

import json
import os
import struct

import numpy as np
from weftline.sources import scenes


def glb(meshes, nodes=None, junk=0, stride=0):
    """A binary scene of (name, vertices, faces); junk: bytes of a texture that nobody asks for."""
    views, accessors, told, data = [], [], [], b"\0" * junk
    for name, v, f in meshes:
        raw = np.asarray(v, "<f4")
        body = raw.tobytes() if not stride else b"".join(r.tobytes() + b"\xff" * (stride - 12) for r in raw)
        views.append({"buffer": 0, "byteOffset": len(data), "byteLength": len(body)} | ({"byteStride": stride} if stride else {}))
        accessors.append({"bufferView": len(views) - 1, "componentType": 5126, "count": len(raw), "type": "VEC3"})
        data += body
        attributes = {"attributes": {"POSITION": len(accessors) - 1}}
        if f is not None:
            views.append({"buffer": 0, "byteOffset": len(data), "byteLength": 2 * np.size(f)})
            accessors.append({"bufferView": len(views) - 1, "componentType": 5123, "count": int(np.size(f)), "type": "SCALAR"})
            attributes["indices"] = len(accessors) - 1
            data += np.asarray(f, "<u2").tobytes()
        data += b"\0" * (-len(data) % 4)
        told.append({"name": name, "primitives": [attributes]} if name else {"primitives": [attributes]})
    head = {"asset": {"version": "2.0"}, "buffers": [{"byteLength": len(data)}], "bufferViews": views, "accessors": accessors, "meshes": told, "nodes": nodes if nodes is not None else [{"mesh": k} for k in range(len(told))]}
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 4)
    return struct.pack("<4sIII4s", b"glTF", 2, 28 + len(text) + len(data), len(text), b"JSON") + text + struct.pack("<I4s", len(data), b"BIN\0") + data


V = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1.5]])
FACES = [[0, 1, 2], [0, 2, 3]]


def test_meshes_of_scenes(spark, tmp_path):
    (tmp_path / "a.glb").write_bytes(glb([("p", V, FACES), (None, V + 1, None)], junk=1 << 20))
    (tmp_path / "b.glb").write_bytes(glb([("q", V, FACES)], [{"children": [1], "translation": [1, 2, 3]}, {"mesh": 0, "scale": [2, 2, 2]}], stride=20))
    (tmp_path / "c.glb").write_bytes(glb([("r", V, FACES)])[:-20])
    (tmp_path / "d.glb").write_bytes(b"no scene at all, but long enough")
    good, bad = scenes.scene_meshes(spark, f"{tmp_path}/*.glb")
    rows = {(os.path.basename(r.path), r.mesh): r for r in good.collect()}
    assert set(rows) == {("a.glb", "p"), ("a.glb", "mesh_1"), ("b.glb", "q")}
    assert np.allclose(rows["a.glb", "p"].vertices, V) and rows["a.glb", "p"].faces == FACES
    assert np.allclose(rows["a.glb", "mesh_1"].vertices, V + 1) and rows["a.glb", "mesh_1"].faces == [[0, 1, 2]]
    assert np.allclose(rows["b.glb", "q"].vertices, V * 2 + [1, 2, 3]) and rows["b.glb", "q"].faces == FACES
    assert max(r.bytes_read for r in rows.values()) < 3000  # of a file of more than a megabyte
    assert sorted(os.path.basename(r.path) for r in bad.collect()) == ["c.glb", "d.glb"]


def test_pieces_are_parts_in_order(spark):
    rows = "oid long, pid string, vertices array<array<double>>, faces array<array<int>>"
    parts = spark.createDataFrame([(1, "a", V.tolist(), FACES), (1, "b", (V + 1).tolist(), [[0, 1, 3]]), (1, "c", (V + 2).tolist(), []), (2, "a", V.tolist(), FACES)], rows)
    groups = spark.createDataFrame([(1, "s", 2, "a"), (1, "s", 1, "b"), (1, "t", 1, "c"), (2, "s", 1, "a"), (2, "s", 2, "gone")], "oid long, slot string, ord int, pid string")
    got = {(r.oid, r.slot): r for r in scenes.grouped_pieces(parts, groups).collect()}
    assert got[1, "s"].pids == ["b", "a"] and np.allclose(got[1, "s"].vertices, np.concatenate([V + 1, V]))
    assert got[1, "s"].faces == [[0, 1, 3], [4, 5, 6], [4, 6, 7]]
    assert got[1, "t"].faces == [] and got[2, "s"].pids == ["a"]
