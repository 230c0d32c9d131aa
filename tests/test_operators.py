from __future__ import annotations

import itertools
import json
import struct

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from weftline.functions import shapes
from weftline.operators import annotate, gates, geometry, graph, keyed, recipe, retrieve, vision
from weftline.operators import library as part_library
from weftline.sources import files
from weftline.streaming import review


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# ---- edit chains


def test_state_fold_by_hand(spark):
    log = [("c", 1, 0, "a", "a1"), ("c", 1, 1, "b", "b1"), ("c", 2, 0, "a", None), ("c", 3, 0, "b", "b2"), ("c", 3, 1, "b", "b3"), ("c", 4, 0, "a", "a2"), ("d", 1, 0, "a", None)]
    state = recipe.state_fold(spark.createDataFrame(log, "chain string, turn int, seq int, node string, version string"))
    assert rows(state, "chain", "turn", "node") == [("c", 1, "a", "a1"), ("c", 1, "b", "b1"), ("c", 2, "b", "b1"), ("c", 3, "b", "b3"), ("c", 4, "a", "a2"), ("c", 4, "b", "b3")]


def test_state_diff_reasons(spark):
    schema = "node string, nv int, vs double, bc string"
    old = spark.createDataFrame([("a", 1, 1.0, None), ("b", 2, 1.0, "x"), ("c", 3, 1.0, "x"), ("d", 4, 1.0, None), ("e", 5, 1.0, "x")], schema)
    new = spark.createDataFrame([("a", 1, 1.005, None), ("b", 9, 1.0, "x"), ("c", 3, 1.5, "x"), ("d", 4, 1.0, "y"), ("f", 5, 1.0, "x")], schema)
    assert rows(recipe.state_diff(old, new, ["node"], ["nv", "bc"], {"vs": 1e-2}), "node") == [("b", "nv"), ("c", "vs"), ("d", "bc"), ("e", "missing"), ("f", "extra")]


def test_plan_faults(spark):
    steps = spark.createDataFrame([("h", 1, "1"), ("h", 2, "1"), ("h", 2, "9"), ("i", 1, "1")], "oid string, step int, pid string")
    parts = spark.createDataFrame([("h", "1"), ("h", "2"), ("i", "1")], "oid string, pid string")
    assert rows(recipe.plan_faults(steps, parts), "oid", "fault") == [("h", "duplicated", "1"), ("h", "missing", "2"), ("h", "unknown", "9"), ("i", "short", None)]
    plan = spark.createDataFrame([("0123456789ab", 1, "base", ["3", "4"]), ("0123456789ab", 2, "top", ["5"])], "oid string, step int, name string, pids array<string>")
    assert [(r.chain, r.turn, r.seq, r.pid) for r in recipe.edits_from_plan(plan).orderBy("turn", "seq").collect()] == [("A/01234567_s0", 1, 0, "3"), ("A/01234567_s0", 1, 1, "4"), ("A/01234567_s0", 2, 0, "5")]


def test_start_state_joins_parts_in_order(spark):
    nodes = spark.createDataFrame([("c", "a", None, ["2", "1"]), ("c", "b", [[9.0]], [])], "chain string, node string, override array<array<double>>, pids array<string>")
    meshes = spark.createDataFrame([("1", [[1.0]]), ("2", [[2.0], [3.0]])], "pid string, vertices array<array<double>>")
    assert rows(recipe.start_state(nodes, meshes), "node") == [("c", "a", [[2.0], [3.0], [1.0]]), ("c", "b", [[9.0]])]


# ---- gates


def test_gate_reasons_one_row_each(spark):
    base = {"bytes": 1, "faces": 1, "debris": 0.0, "verdict": "fit", "contact": True, "scale": 1.0, "snapped": True, "gap": 0.0, "virtual_gap": None, "ratio": 1.0, "connected": True}
    bad = [("bytes", 121 << 20), ("faces", 400001), ("debris", 0.021), ("verdict", "skip"), ("contact", False), ("scale", 0.25), ("snapped", False), ("gap", 0.02), ("ratio", 2.6), ("connected", False)]
    made = [base] + [base | {k: v} for k, v in bad] + [base | {"gap": 0.02, "virtual_gap": 0.02, "snapped": False}]
    schema = "bytes long, faces int, debris double, verdict string, contact boolean, scale double, snapped boolean, gap double, virtual_gap double, ratio double, connected boolean"
    found = [r.reason for r in spark.createDataFrame(made, schema).withColumn("reason", gates.gate_reason()).collect()]
    assert found == [None, "GLB limit", "face count limit", "has debris", "pre-judge skip", "no contact surface", "scale at boundary", "snap refused", "gap", "too large", "disassembles", None]


def retire_one_by_one(outcomes):
    dead = skipped = 0
    for i, o in enumerate(outcomes):
        dead, skipped = (0, 0) if o == "ok" else (dead + 1, 0) if o == "fail" else (dead, skipped + 1)
        if dead >= 3 or skipped >= 5:
            return i
    return None


def test_retired_slots_against_one_by_one(spark):
    made = [(k, list(p)) for k, p in enumerate(itertools.product(["ok", "fail", "skip"], repeat=6))]
    log = spark.createDataFrame([(k, i, o) for k, p in made for i, o in enumerate(p)], "slot int, n int, outcome string")
    found = {r.slot: r.retired_at for r in gates.retired(log, ["slot"], "n").collect()}
    assert found == {k: at for k, p in made if (at := retire_one_by_one(p)) is not None}


# ---- retrieval


def library(spark, n=60):
    rng = np.random.default_rng(4)
    vecs = rng.normal(size=(n, 8))
    vecs /= np.linalg.norm(vecs, axis=1)[:, None]
    made = [(i, i // 3, v.tolist(), float(s), 0.0, 0.0) for i, (v, s) in enumerate(zip(vecs, rng.random(n)))]
    return spark.createDataFrame(made, "pid int, oid int, vec array<double>, score double, d_sig double, d_sym double"), vecs


def test_both_forms_of_similarity(spark):
    frame, vecs = library(spark)
    asked = spark.createDataFrame([(vecs[i].tolist(),) for i in (3, 7, 8)], "vec array<double>")
    native = {r.pid: r.s for r in retrieve.similarity(frame, asked, "s").collect()}
    matrix = {r.pid: r.s for r in retrieve.similarity_matrix(frame, vecs[[3, 7, 8]], "s").collect()}
    assert all(abs(native[k] - matrix[k]) < 1e-12 for k in native) and abs(native[7] - 1) < 1e-12


def test_diversified_picks(spark):
    frame, vecs = library(spark)
    limits = retrieve.Limits(duplicate=0.5, top=6)
    picks = retrieve.diversified(frame.withColumn("g", F.lit(1)), ["g"], limits).orderBy("pick").collect()
    assert len({p.oid for p in picks}) == len(picks) <= 6 and picks[0].score == max(r.score for r in frame.collect())
    for a, b in itertools.combinations(picks, 2):
        assert vecs[a.pid] @ vecs[b.pid] < 0.5


def test_softmax_order_prefers_high_scores_and_ignores_partitions(spark):
    frame, _ = library(spark)
    draws = [rows(retrieve.softmax_order(f, F.col("pid").cast("string"), seed=3).select("pid", "draw"), "pid") for f in (frame, frame.repartition(7))]
    assert draws[0] == draws[1]
    cold = retrieve.softmax_order(frame, F.col("pid").cast("string"), temperature=0.0).orderBy(F.desc("draw")).first()
    assert cold.score == max(r.score for r in frame.collect())


def test_literal_rejects(spark):
    frame = spark.createDataFrame([("a dog head",), ("a hotdog",), ("C++ sign",)], "cap string")
    assert [r[0] for r in frame.select(retrieve.literally_rejected(F.col("cap"), ["dog", "c++"])).collect()] == [True, False, True]


# ---- graphs


def brute_cuts(g):
    base = len(graph.components(g))
    return {n for n in g if g[n] and len(graph.components(g, without=n)) > base}, {frozenset((a, b)) for a in g for b in g[a] if len(graph.components(g, cut=frozenset((a, b)))) > base}


@settings(max_examples=200, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 8), st.integers(0, 8)).filter(lambda e: e[0] < e[1])))
def test_low_links_against_removal(edges):
    g = graph.graph_of(range(9), [(a, b, 1.0) for a, b in edges])
    assert graph.low_links(g) == brute_cuts(g)


def test_subassemblies_of_a_barbell():
    g = graph.graph_of(range(7), [(0, 1, 1), (1, 2, 1), (0, 2, 1), (2, 3, 1), (3, 4, 1), (4, 5, 1), (3, 5, 1)])
    assert graph.isolated(g) == {6} and graph.subassemblies(g)[0] == (2, [3, 4, 5], 3 / 7)
    assert graph.orphans(g, 3, {0}) == [4, 5, 6]
    assert graph.virtual_edges(g, {0}, lambda a, b: abs(a - b)) == [(6, 5, 1)]


def test_contact_edges_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    p = rng.random((300, 3))
    made = [(i % 2, i % 7, i, p[i].tolist()) for i in range(300)]
    points = spark.createDataFrame(made, "oid int, part int, pid int, p array<double>")
    found, by_object = (rows(graph.contact_edges(points, 0.12, few=few), "oid", "a", "b") for few in (0, 1000))
    want = {}
    for (o, a, _, x), (q, b, j, y) in itertools.product(made, made):
        if o == q and a < b and np.linalg.norm(np.array(x) - y) < 0.12:
            want.setdefault((o, a, b), set()).add(j)
    assert found == by_object == [(*k, len(v)) for k, v in sorted(want.items())]


# ---- tables and annotations


def test_keyed_tables(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert rows(keyed.overwritten(old, new, ["k"]), "k") == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(keyed.appended(old, new, ["k"]), "k") == [(1, "a"), (2, "b"), (3, "d")]
    assert rows(keyed.preferred_union([old, new], ["k"]), "k") == [(1, "a"), (2, "c"), (3, "d")]
    found, missing = keyed.matched(old, new.select("k"), ["k"])
    assert rows(found) == [(2, "b")] and rows(missing) == [(1, "a")]


def test_standing_vetoes_against_a_stack(spark):
    made = [(k, list(p)) for k, p in enumerate(itertools.product(["veto", "unveto"], repeat=6))]
    log = spark.createDataFrame([(k, i, e) for k, p in made for i, e in enumerate(p)], "slot int, n int, event string")
    want = set()
    for k, p in made:
        stack = []
        for i, e in enumerate(p):
            stack.append(i) if e == "veto" else stack and stack.pop()
        want |= {(k, i) for i in stack}
    assert {(r.slot, r.n) for r in annotate.standing_vetoes(log, ["slot"], "n").collect()} == want


def test_commands(spark):
    lines = ['add #3 "a red hat" size=0.8 spot=2', "add 3 hat", "add x hat", "remove slot_a", "retexture s brass", "stop", "fly", "", None]
    found = [r.c for r in spark.createDataFrame([(x,) for x in lines], "v string").select(annotate.parsed_command(F.col("v")).alias("c")).collect()]
    assert (found[0].face, found[0].query, found[0].size, found[0].spot) == (3, "a red hat", 0.8, 2) and found[1].query == "hat"
    assert [c and c.kind for c in found] == ["add", "add", None, "remove", "retexture", "stop", None, None, None]


def test_side_audit(spark):
    made = [("put it on the left", "+z", [0.5], [0.0]), ("put it on the left", "-z", [0.5], [0.0]), ("left and right", "+z", [0.5], [0.0]), ("LEFT side", "+z", [0.5, -0.5], [0.0, 0.0]), ("right", None, [0.5], [0.0])]
    found = annotate.side_audit(spark.createDataFrame(made, "text string, front string, xs array<double>, zs array<double>")).collect()
    assert [(r.says, r.lies, r.wrong) for r in found] == [("left", "left", False), ("left", "right", True), (None, "left", None), ("left", None, None), ("right", None, None)]


# ---- geometry


def box():
    v = np.array(list(itertools.product((0.0, 1.0), (0.0, 1.0), (0.0, 2.0))))
    f = np.array([[0, 1, 3], [0, 3, 2], [4, 6, 7], [4, 7, 5], [0, 4, 5], [0, 5, 1], [2, 3, 7], [2, 7, 6], [0, 2, 6], [0, 6, 4], [1, 5, 7], [1, 7, 3]])
    return v, f


def test_kernels_on_a_box():
    v, f = box()
    points = geometry.surface_points(v, f, 4000)
    assert np.array_equal(points, geometry.surface_points(v, f, 4000)) and (geometry.nearest(points, points)[0] < 1e-6).all()
    assert np.allclose(geometry.principal_axes(points)[1][0], [0, 0, 1], atol=0.05)
    assert len(np.unique(geometry.face_patches(v, f))) == 6 and len(np.unique(geometry.mesh_components(8, f))) == 1
    two, both = np.concatenate([v, v + [5, 0, 0]]), np.concatenate([f, f + 8])
    assert len(np.unique(geometry.mesh_components(16, both))) == 2 and abs(geometry.largest_isolation(two, both) - 4) < 1e-6
    frame = geometry.contact_frame(points, points - [0, 0, 2], 2.4)
    assert frame["out"][2] > 0.9 and geometry.penetration_share(points, points + [9, 0, 0], 2.4) == 0
    pose, scale = geometry.posed_on(points, frame)
    assert geometry.is_valid_transform(pose) and 0.25 <= scale <= 4


def test_rotations_and_fits():
    rng = np.random.default_rng(0)
    for a, b in [*rng.normal(size=(20, 2, 3)), ([1, 0, 0], [-1, 0, 0]), ([0, 1, 0], [0, 1, 0])]:
        r = geometry.rotation_between(a, b)
        assert np.allclose(r @ (np.array(a) / np.linalg.norm(a)), np.array(b) / np.linalg.norm(b)) and np.linalg.det(r) > 0
    x = rng.normal(size=(50, 3))
    t = geometry.affine(1.7 * geometry.rotation_about([1, 2, 3], 0.8), [4, 5, 6])
    assert np.allclose(geometry.similarity_fit(x, x @ t[:3, :3].T + t[:3, 3]), t, atol=1e-6)
    assert not geometry.is_valid_transform(np.diag([1, 1, -1, 1.0])) and not geometry.is_valid_transform(np.zeros((4, 4)))


def test_transform_predicates_agree_with_kernels(spark):
    rng = np.random.default_rng(1)
    made = [geometry.affine(s * geometry.rotation_about(rng.normal(size=3), a), rng.normal(size=3)) for s, a in ((1, 1), (3, 2), (0.1, 0.5))]
    made += [np.diag([1, 2, 3, 1.0]), np.diag([1, 1, -1, 1.0]), np.diag([1, 1, 1, 2.0])]
    frame = spark.createDataFrame([(m.flatten().tolist(),) for m in made], "t array<double>")
    found = frame.select(shapes.is_transform(F.col("t")), shapes.is_similarity(F.col("t"))).collect()
    assert [r[0] for r in found] == [geometry.is_valid_transform(m) for m in made] and [r[1] for r in found] == [True, True, True, False, False, False]


def test_spots_and_faces():
    grid = np.ones((24, 24), bool)
    grid[:, 12] = False
    spots = geometry.landing_spots(grid)
    assert len(spots) >= 2 and {c < 12 for _, c, _ in spots[:2]} == {True, False} and all(grid[r, c] for r, c, _ in spots)
    ranked = geometry.ranked_faces([{"kind": "side", "area": 9, "free": 1}, {"kind": "top", "area": 1, "free": 0.3}, {"kind": "side", "area": 99, "free": 0.2}])
    assert [(f["id"], f["kind"]) for f in ranked] == [(1, "top"), (2, "side")]
    assert geometry.voxel_overlap(np.array([[0.1, 0, 0], [1.1, 0, 0]]), np.array([[0.2, 0, 0]]), 1.0) == 0.5


# ---- files and streams


def test_json_lines_last_wins_and_bad_ones_are_set_aside(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"oid": "o", "pid": "1", "cap": "old"}\n{broken\n{"oid": "o", "pid": "1", "cap": "new"}\n\n')
    (tmp_path / "b.jsonl").write_text('{"oid": "o", "pid": "2", "cap": "x"}\n{"cap": "no key"}\n')
    good, bad = files.json_lines(spark, f"{tmp_path}/*.jsonl", "oid string, pid string, cap string", ["oid", "pid"])
    assert rows(good, "pid") == [("o", "1", "new"), ("o", "2", "x")] and bad.count() == 2


def test_caption_folders(spark, tmp_path):
    (tmp_path / "o1.json").write_text(json.dumps({"object": ["b", "d"], "parts": {"1": ["pb", "pd"], "2": ["only"]}}))
    (tmp_path / "o2.json").write_text("{")
    (tmp_path / "o3.json").write_text(json.dumps({"object": ["b"], "parts": {}}))
    good, bad = files.caption_folder(spark, str(tmp_path))
    parts, objects = files.split_captions(good)
    assert rows(parts, "pid") == [("o1", "1", "pb", "pd"), ("o1", "2", "only", None)] and rows(objects) == [("o1", "b", "d")] and [r.oid for r in bad.collect()] == ["o2"]
    assert files.json_documents(spark, [f"{tmp_path}/none.json"], "a int").count() == 0


def test_keyed_overwrite(spark, tmp_path):
    path = f"{tmp_path}/t"
    files.keyed_overwrite(spark, path, spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), ["k"])
    files.keyed_overwrite(spark, path, spark.createDataFrame([(2, "c")], "k int, v string"), ["k"])
    assert rows(files.keyed_table(spark, path), "k") == [(1, "a"), (2, "c")]
    (tmp_path / "t" / "v3").mkdir()  # a writer that was lost
    assert rows(files.keyed_table(spark, path), "k") == [(1, "a"), (2, "c")]
    files.keyed_overwrite(spark, path, spark.createDataFrame([(3, "d")], "k int, v string"), ["k"])
    assert rows(files.keyed_table(spark, path), "k") == [(1, "a"), (2, "c"), (3, "d")]
    (tmp_path / "t" / "v4.claim").touch()  # another writer is at work
    with pytest.raises(Exception, match="claim"):
        files.keyed_overwrite(spark, path, spark.createDataFrame([(4, "e")], "k int, v string"), ["k"])
    assert files.keyed_table(spark, f"{tmp_path}/none") is None


def test_scene_boxes(spark, tmp_path):
    """Meshes by their own names, each where its first node places it; one is turned a quarter about z, one is placed by no node."""
    half = 0.5**0.5
    scene = {
        "nodes": [{"children": [1, 2], "translation": [10, 0, 0]}, {"mesh": 0, "name": "node", "scale": [2, 1, 1]}, {"mesh": 0}, {"mesh": 1, "rotation": [0, 0, half, half]}],
        "meshes": [{"name": "part", "primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}, {"primitives": [{"attributes": {"POSITION": 0}}]}, {"name": "loose", "primitives": [{"attributes": {"POSITION": 0}}, {"attributes": {}}]}],
        "accessors": [{"min": [0, 0, 0], "max": [1, 2, 3], "count": 9}, {"count": 36}],
    }
    text = json.dumps(scene).encode()
    text += b" " * (-len(text) % 4)
    (tmp_path / "a.glb").write_bytes(struct.pack("<4sII", b"glTF", 2, 20 + len(text)) + struct.pack("<I4s", len(text), b"JSON") + text + b"buffers" * 1000)
    (tmp_path / "bad.glb").write_bytes(b"glTF")
    boxes, unreadable = files.scene_boxes(spark, f"{tmp_path}/*.glb")
    found = {r.mesh: (np.round(r.lo, 9).tolist(), np.round(r.hi, 9).tolist(), r.faces) for r in boxes.collect()}
    assert found == {"part": ([10.0, 0.0, 0.0], [12.0, 2.0, 3.0], 12), "mesh_1": ([-2.0, 0.0, 0.0], [0.0, 1.0, 3.0], 3), "loose": ([0.0, 0.0, 0.0], [1.0, 2.0, 3.0], 3)}
    assert [r.path[-7:] for r in unreadable.collect()] == ["bad.glb"]


def test_review_stream_equals_the_fold(spark, tmp_path):
    from weftline.plans.review import commands, stream_review_state
    from weftline.session import table

    sf = "/root/testdata/sf0.001"
    batch = commands(table(spark, sf, "events")).orderBy("chain", "at").collect()
    want = []
    for _, group in itertools.groupby(batch, key=lambda r: r.chain):
        want += review.fold([(r.chain, r.at, r.command, r.candidate) for r in group], review.Session())
    assert sorted(map(tuple, stream_review_state(spark, sf).collect())) == sorted(want)


def test_job_receipts_stream(spark, tmp_path):
    out = f"{tmp_path}/out"
    jobs = [("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:10:00"), ("late", "2024-01-02 00:00:00")]
    done = [("a", "2024-01-01 00:30:00"), ("b", "2024-01-01 05:00:00"), ("late", "2024-01-02 09:00:00")]
    for name, made, at in (("jobs", jobs, "ts"), ("done", done, "done")):
        spark.createDataFrame(made, f"job string, t string").selectExpr("job", f"cast(t as timestamp) as {at}").write.parquet(f"{tmp_path}/{name}")
    read = lambda name, at: spark.readStream.schema(f"job string, {at} timestamp").parquet(f"{tmp_path}/{name}")
    q = review.job_receipts(read("jobs", "ts"), read("done", "done")).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(out)
    q.awaitTermination()
    found = {r.job: r.done for r in spark.read.parquet(out).collect()}
    assert found["a"] is not None and found.get("b", 0) is None


# ---- what was quadratic or wrong


def test_sheared_transforms(spark):
    """Columns of length about 1 and a positive determinant, yet nearly flat; against a singular value decomposition."""
    from weftline.operators.geometry import is_valid_transform

    rng = np.random.default_rng(3)
    made = [np.array([[1, 1, 0], [0, 1e-6, 0], [0, 0, 1]]), np.array([[1, 1, 0], [0, 1e-4, 0], [0, 0, 1]]), 1.1e-5 * np.eye(3), 0.9e-5 * np.eye(3), 9.9e3 * np.eye(3), 1.1e4 * np.eye(3), -np.eye(3), np.zeros((3, 3))]
    for _ in range(300):
        u, v = (np.linalg.qr(rng.normal(size=(3, 3)))[0] for _ in "uv")
        made.append(u @ np.diag(10 ** rng.uniform(-6, 5, 3)) @ v)
    whole = []
    for m in made:
        t = np.eye(4)
        t[:3, :3] = m
        whole.append(t)
    frame = spark.createDataFrame([(i, t.reshape(-1).tolist()) for i, t in enumerate(whole)], "i int, t array<double>")
    found = {r.i: r.ok for r in frame.select("i", shapes.is_transform(F.col("t")).alias("ok")).collect()}
    assert not found[0] and found[1] and found[2] and not found[3] and found[4] and not found[5]
    values = [np.maximum(np.linalg.svd(t[:3, :3], compute_uv=False), 1e-300) for t in whole]
    clear = [i for i, s in enumerate(values) if np.abs(np.log(s[[0, 2]] / [1e4, 1e-5])).min() > 1e-3]
    assert [found[i] for i in clear] == [is_valid_transform(whole[i]) for i in clear]


def test_percentiles_against_numpy(spark):
    values = [float(v) for v in np.random.default_rng(4).normal(size=501)] + [0.25] * 40
    at = (0.0, 0.05, 0.1, 0.25, 0.5, 0.9, 1.0)
    found = {r.p: r.value for r in vision.change_percentiles(spark.createDataFrame([(v,) for v in [*values, None]], "metric double"), at=at).collect()}
    assert [found[p] for p in at] == pytest.approx(np.quantile(values, at).tolist())
    assert [r.value for r in vision.change_percentiles(spark.createDataFrame([], "metric double"), at=(0.5,)).collect()] == [None]
    low = vision.lowest(spark.createDataFrame([(v, i) for i, v in enumerate([*values, None])], "metric double, turn int"))
    assert [r.metric for r in low.collect()] == sorted(values)[:14]


def test_mmr_recomputed(spark):
    """The registered query against a greedy choice written down plainly."""
    from weftline.plans import retrieval

    sf = "/root/testdata/sf0.01"
    limits = retrieval.FIXTURE
    pool = {}
    for r in retrieve.scored(retrieval.candidates(spark, sf), limits).collect():
        pool.setdefault(r.label, []).append((r.score, r.pid, r.oid, [float(x) for x in r.vec]))
    want = []
    for label, rows_ in pool.items():
        left, chosen = sorted(rows_, key=lambda r: (-r[0], r[1])), []
        dot = lambda x, y: sum(a * b for a, b in zip(x[3], y[3]))
        while left and len(chosen) < limits.top:
            best = max(left, key=lambda r: r[0] - limits.diversity * max([0.0, *(dot(r, c) for c in chosen)]))
            chosen.append(best)
            left = [r for r in left if r is not best and r[2] != best[2] and dot(r, best) < limits.duplicate]
        want += [(label, i + 1, c[1]) for i, c in enumerate(chosen)]
    found = [(r.label, r.pick, r.pid) for r in retrieval.retrieve_mmr(spark, sf).collect()]
    assert sorted(found) == sorted(want) and len(want) > 20


def test_slots_exclude_and_reject(spark):
    """A slot's own source, what it excludes, and what lies nearer to a reject stay out; blocks of few rows lose nothing."""
    rng = np.random.default_rng(6)
    vecs = rng.normal(size=(120, 8))
    vecs /= np.linalg.norm(vecs, axis=1)[:, None]
    library = spark.createDataFrame([(i, i // 6, vecs[i].tolist(), [1.0, 0.5, 0.3], 0.9) for i in range(120)], "pid long, oid long, vec array<double>, sig array<double>, sym double")
    slots_ = [(k, k // 6, [1.0, 0.5, 0.3], 0.9, vecs[k + 1 : k + 3].tolist(), vecs[k + 3 : k + 4].tolist(), [k + 20]) for k in range(0, 110, 7)]
    slots = spark.createDataFrame(slots_, "slot long, oid long, sig array<double>, sym double, asked array<array<double>>, rejected array<array<double>>, without array<long>")
    limits = retrieve.Limits(floor=0.1, saturation=0.4, reject=0.6)
    want = set()
    for slot, own, _, _, asked, rejected, without in slots_:
        acc, rej = (vecs @ np.array(asked).T).max(1), (vecs @ np.array(rejected).T).max(1)
        ok = [i for i in range(120) if i // 6 != own and i not in without and acc[i] >= 0.1 and rej[i] < 0.6 and acc[i] > rej[i]]
        first = {}
        for i in sorted(ok, key=lambda i: (-(min(acc[i], 0.4) + 0.25 * max(acc[i] - 0.4, 0)), i)):
            first.setdefault(i // 6, i)
        want |= {(slot, i) for i in list(first.values())[:8]}
    rows_, asked_ = retrieve.ROWS, retrieve.ASKED
    try:
        retrieve.ROWS, retrieve.ASKED = 17, 5
        found = {(r.slot, r.pid) for r in retrieve.for_slots(library, slots, limits, rejects=True).collect()}
    finally:
        retrieve.ROWS, retrieve.ASKED = rows_, asked_
    assert found == want


# ---- assets, jobs and pieces


def test_paths_stay_inside(spark):
    paths = {"a/b": True, "/r/a": True, "/r": False, "/r/": False, "/r/../x": False, "a/../b": True, "a/../../b": False, "../r/a": False, "./a": True, "/root/a": False, "": False, "..": False, "/r/a/..": False, None: False}
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r.ok for r in frame.select(part_library.is_contained(F.col("path"), F.lit("/r/")).alias("ok")).collect()] == list(paths.values())


def test_job_outcomes_by_hand(spark):
    jobs = [("ok", 0.0), ("fail", 0.0), ("slow", 0.0), ("queued", 0.0), ("late start", 0.0), ("long queue", 0.0), ("lost", 0.0)]
    starts = [("ok", 30.0), ("fail", 1.0), ("slow", 5.0), ("late start", 41.0), ("long queue", 39.0)]
    receipts = [("ok", 39.0, "ok"), ("fail", 2.0, "no memory"), ("slow", 16.0, "ok"), ("queued", 39.0, "ok here"), ("late start", 42.0, "ok"), ("long queue", 48.0, "ok"), ("ok", 99.0, "again")]
    frames = [spark.createDataFrame(rows_, schema) for rows_, schema in ((jobs, "job string, ts double"), (starts, "job string, started double"), (receipts, "job string, done double, message string"))]
    found = {r.job: (r.outcome, r.seconds) for r in review.job_outcomes(*frames, budget=10.0).collect()}
    assert found == {"ok": ("ok", 39.0), "fail": ("failed", 2.0), "slow": ("compute_timeout", None), "queued": ("ok", 39.0), "late start": ("queue_timeout", None), "long queue": ("ok", 48.0), "lost": ("queue_timeout", None)}


def test_retexture_legs_by_hand(spark):
    rounds = spark.createDataFrame([(1, 10.0, False), (2, 10.0, True), (3, 10.0, False), (4, 0.0, False)], "job int, ts double, rendered boolean")
    legs = spark.createDataFrame([(1, "render", 12.0), (1, "restyle", 15.0), (1, "texture", 21.0), (2, "restyle", 11.0), (2, "texture", 12.0), (3, "restyle", 30.0), (3, "texture", 31.0), (4, "render", 1.0), (4, "texture", 9.0)], "job int, leg string, done double")
    assert rows(review.retexture_legs(rounds, legs), "job") == [(1, 2.0, 3.0, 6.0, None), (2, 0.0, 1.0, 1.0, None), (3, None, None, None, "render"), (4, 1.0, None, None, "restyle")]


def test_jobs_of_a_table_are_dealt_once_a_side(spark):
    from weftline.plans.ledger import retexture_legs

    plan = retexture_legs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and plan.count("Join") == 1


def test_stale_faces_by_hand(spark):
    """One piece moved, one is new, one gone; far away, one is blocked by the moved one, one lies alone, one has no box."""
    box = lambda x: ([float(x), 0.0, 0.0], [x + 1.0, 1.0, 1.0])
    pieces = "chain int, piece string, fingerprint int, lo array<double>, hi array<double>"
    before = spark.createDataFrame([(1, "moved", 1, *box(0)), (1, "gone", 1, *box(2)), (1, "blocked", 1, *box(50)), (1, "alone", 1, *box(70)), (1, "bare", 1, *box(90)), (1, "near", 1, *box(4))], pieces)
    after = spark.createDataFrame([(1, "moved", 2, *box(1)), (1, "new", 1, *box(3)), (1, "blocked", 1, *box(50)), (1, "alone", 1, *box(70)), (1, "bare", 1, *box(90)), (1, "near", 1, *box(4))], pieces)
    faces = spark.createDataFrame([(1, "blocked", ["moved"], *box(50)), (1, "alone", ["blocked"], *box(70)), (1, "bare", [], None, None), (1, "near", [], *box(4)), (1, "gone", [], *box(2))], "chain int, piece string, blockers array<string>, lo array<double>, hi array<double>")
    assert rows(review.stale_faces(faces, before, after), "piece") == [(1, "bare"), (1, "blocked"), (1, "moved"), (1, "near"), (1, "new")]
    assert review.stale_faces(faces, after, after).count() == 0


def test_places_in_commands(spark):
    lines = ['add #2 "hat" at=0.5,-0.25 size=2', 'add 2 hat', "remove slot_1"]
    found = [r.c for r in spark.createDataFrame([(x,) for x in lines], "v string").select(annotate.parsed_command(F.col("v")).alias("c")).collect()]
    assert [c["at"] for c in found] == [[0.5, -0.25], [0.0, 0.0], None] and found[0].size == 2.0


def test_virtual_frame():
    part = np.array([[x, 5.0, 0.0] for x in np.linspace(0, 10, 101)])
    frame = geometry.virtual_frame(part, {"far": np.array([[0.0, 50.0, 0.0]]), "near": np.array([[12.0, 5.0, 0.0]]), "none": np.empty((0, 3))}, 20.0)
    assert frame["neighbour"] == "near" and abs(frame["gap"] - 0.1) < 1e-9 and frame["hits"] == 6 and np.allclose(frame["out"], [-1, 0, 0]) and np.allclose(frame["centre"], [9.75, 5, 0])
    assert geometry.virtual_frame(part, {}, 20.0) is None and geometry.virtual_frame(part[:0], {"near": part}, 20.0) is None


# ---- placement


def box_points(lo, hi, n=4000, seed=0):
    """Points on the surface of a box."""
    rng = np.random.default_rng(seed)
    p = rng.uniform(lo, hi, (n, 3))
    k, top = rng.integers(0, 3, n), rng.integers(0, 2, n)
    p[np.arange(n), k] = np.where(top, np.array(hi)[k], np.array(lo)[k])
    return p


def test_mount_directions():
    nail = np.concatenate([box_points((0, 0, 0), (0.2, 4, 0.2)), box_points((-1, 4, -1), (1.2, 4.5, 1.2))])
    assert geometry.mount_direction("zneg", nail).tolist() == [0, 0, -1] and geometry.mount_direction("top", nail)[1] == 1 and geometry.mount_direction("rim", nail)[1] == -1
    assert geometry.mount_direction("end", nail) @ [0, -1, 0] > 0.99
    handle = np.concatenate([box_points((-1, 0, -1), (1, 1, 1)), box_points((1, 0.4, -0.1), (4, 0.6, 0.1))])
    assert geometry.mount_direction("side", handle) @ [-1, 0, 0] > 0.95


def test_a_seat_on_a_plane():
    """A long box lying across a plate, turned and off centre, goes to its middle, along it and as large as fits."""
    plate = box_points((-4, -1, -2), (4, 0, 2), 20000)
    old = box_points((-3.5, 0, -1.5), (3.5, 1, 1.5), seed=1)
    turn = geometry.rotation_about([0, 1, 0], 0.7)
    new = box_points((-1, 0, -3), (1, 2, 3), seed=2) @ turn.T + [9.0, 5.0, -7.0]
    made = geometry.posed_on_plane(new, old, plate, np.zeros(3), np.array([0.0, 1.0, 0.0]), 10.0)
    moved = new @ made["pose"][:3, :3].T + made["pose"][:3, 3]
    assert abs(moved[:, 1].min() + 0.02) < 1e-6 and np.abs(moved.mean(0)[[0, 2]]).max() < 0.2
    long, across = np.ptp(moved[:, 0]), np.ptp(moved[:, 2])
    assert abs(long / across - 3) < 0.4 and long <= made["outline"][0] + 0.1 and across <= made["outline"][1] + 0.1
    held = geometry.posed_on_plane(new, old, plate, np.zeros(3), np.array([0.0, 1.0, 0.0]), 10.0, slot=2.0)
    whole = np.linalg.norm(np.ptp((new - new.mean(0)) @ held["pose"][:3, :3].T, axis=0))
    assert 1.49 < whole < 2.51
    assert geometry.posed_on_plane(new, old, plate - [0, 5, 0], np.zeros(3), np.array([0.0, 1.0, 0.0]), 10.0) is None


def test_a_part_added_to_a_face():
    face = {"normal": np.array([1.0, 0, 0]), "basis": np.array([[0, 0, 1.0], [0, -1.0, 0]]), "centre": np.array([2.0, 0, 0]), "free_centre": np.array([2.0, 0, 0]), "lengths": (8.0, 4.0), "free_lengths": (8.0, 4.0)}
    assert np.allclose(np.cross(*face["basis"]), face["normal"])
    new = box_points((0, 0, 0), (2, 1, 6), seed=3)
    made = geometry.posed_on_face(new, face, 10.0, size=0.5, at=(0.5, 0.0))
    moved = new @ made["pose"][:3, :3].T + made["pose"][:3, 3]
    assert abs(moved[:, 0].min() - 1.98) < 1e-6 and abs(max(made["footprint"]) - 2.0) < 1e-6
    assert abs(moved[:, 2].mean() - 2.0) < 0.05 and abs(moved[:, 1].mean()) < 0.05 and np.ptp(moved[:, 2]) > np.ptp(moved[:, 1])
    assert abs(max(geometry.posed_on_face(new, face, 10.0, size=0.5, clear=0.5)["footprint"]) - 0.5) < 1e-6


def test_planks_are_one_patch():
    """Three planks side by side with small gaps, one far off, one lower and one that looks the other way."""
    def plank(x, y=0.0, flip=False):
        v = np.array([[x, y, 0], [x + 1, y, 0], [x + 1, y, 4], [x, y, 4]], float)
        f = np.array([[0, 2, 1], [0, 3, 2]])
        return v, f[:, ::-1] if flip else f

    made = [plank(0), plank(1.1), plank(2.2), plank(9), plank(3.3, -1.0), plank(3.3, 0.0, True)]
    vertices = np.concatenate([v for v, _ in made])
    faces = np.concatenate([f + 4 * k for k, (_, f) in enumerate(made)])
    labels = geometry.face_patches(vertices, faces)
    assert len(set(labels)) == 6
    merged = geometry.merged_patches(vertices, faces, labels, gap=0.15)
    assert len(set(merged)) == 4 and len(set(merged[:6])) == 1 and len(set(merged[6:])) == 3
    assert len(set(geometry.merged_patches(vertices, faces, labels, gap=0.05))) == 6 and not len(geometry.merged_patches(vertices, faces[:0], labels[:0]))


def test_face_markers():
    face = {"normal": [0, 1, 0], "basis": [[1, 0, 0], [0, 0, -1]], "free_centre": [1, 2, 3], "free_lengths": (4.0, 0.1), "spots": [{"point": [1, 2, 3], "clear": c} for c in (2.0, 0.1, 1.0, 1.0, 1.0, 1.0)]}
    made = geometry.face_marker(face, 10.0)
    assert [m["kind"] for m in made] == ["plate"] + ["ball"] * 7 and made[0]["size"] == (4.0, 0.2, 0.04)
    assert np.allclose(made[1]["centre"], [3, 2.1, 3]) and np.allclose(made[2]["centre"], [1, 2.1, 2.9])
    assert [m["size"] for m in made[3:6]] == [0.6, 0.12, 0.5] and made[4]["colour"] == (214, 134, 0)


def test_clusters_name_their_shared_folder(spark):
    from types import SimpleNamespace

    from weftline.session import shared_folder

    named = {}
    context = SimpleNamespace(getCheckpointDir=lambda: named.get("at"), setCheckpointDir=lambda path: named.update(at=path), master="local-cluster[3,2,1024]")
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: named.get(key, default)))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session)
    named["spark.checkpoint.dir"] = "hdfs://shared"
    assert shared_folder(session) == "hdfs://shared"


def test_sides_that_are_sent_and_sides_in_blocks_give_the_same(spark, monkeypatch):
    from weftline.plans import retrieval

    sf = "/root/testdata/sf0.01"
    library = retrieval.parts_library(spark, sf).cache()
    slots = retrieval.slots(spark, sf).cache()
    told = []
    for most in (1 << 20, 0):
        monkeypatch.setattr(retrieve, "MOST_VALUES", most)
        top = retrieve.for_slots(library, slots, retrieval.FIXTURE)
        best = retrieve.similarity_blocks(library.select("pid", "vec"), library.filter("pid % 50 = 0").select("pid", "vec"), "s")
        told.append((sorted((r.slot, r.pid, round(r.score, 9)) for r in top.collect()), sorted((r.pid, round(r.s, 9)) for r in best.collect())))
    assert told[0] == told[1] and all(told[0])


def test_vetoes_stand_for_all_slots_of_a_signature(spark):
    """All users of one remainder share a signature, so each is told the same vetoes."""
    from weftline.plans.ledger import veto_slots

    by_slot = {}
    for r in veto_slots(spark, "/root/testdata/sf0.001").collect():
        by_slot.setdefault(r.slot, set()).add((r.event_id, r.pid))
    assert len(by_slot) > 6 and all(told == by_slot[min(s for s in by_slot if s % 6 == slot % 6)] for slot, told in by_slot.items())


def test_pairs_in_blocks_are_all_pairs_and_are_spread(spark):
    """More rows than a block on either side, rows without a partner, null values and keys; few signatures are many tasks, and no pair is shuffled."""
    verdicts = spark.range(1800).selectExpr("CASE WHEN id % 3 < 2 THEN id % 3 WHEN id % 2 = 0 THEN 7 END AS sig", "id AS event_id", "nullif(id % 5, 4) AS pid")
    slots = spark.range(1500).selectExpr("CASE WHEN id % 2 = 0 THEN 0 WHEN id % 5 = 0 THEN 1 WHEN id % 5 = 1 THEN 8 END AS sig", "nullif(id, 10) AS slot")
    got = annotate.paired_in_blocks(verdicts, slots)
    told = lambda df: df.select(F.count("*"), F.sum(F.xxhash64("event_id", "pid", "slot").cast("decimal(38,0)")), F.countDistinct("event_id", "slot")).first()
    assert told(got) == told(annotate.paired(verdicts, slots)) and got.count() == 600 * 750 + 600 * 150
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate inline(_asked") < plan.index("Generate inline(_told") < plan.index("Join") < plan.index("Exchange")
    assert got.groupBy(F.spark_partition_id()).count().count() >= 3


def test_transforms_near_a_bound_are_told_as_in_the_sql(spark, tmp_path):
    """Where least singular values are within a hundredth of 1e-5, rounding decides, and it must do so alike."""
    from weftline import catalog

    rows = [(1, 1, 34.0, 2696.58, 0.01, 0.08), (1, 3, 46.0, 3660.69, 0.08, 0.08), (2, 5, 28.0, 1656.59, 0.01, 0.06), (2, 1, 43.0, 1666.76, 0.01, 0.04), (3, 3, 33.0, 1615.36, 0.07, 0.05), (3, 2, 5.0, 1000.0, 0.0, 0.05), (4, 1, 5.0, 1000.0, None, 0.05)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_tax double, l_discount double")
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(f"SELECT l_orderkey, l_linenumber, valid, \"similar\", det FROM ({catalog.oracle_sql()['transform_checks']})").fetchall()
    got = catalog.queries()["transform_checks"](spark, str(tmp_path)).select("l_orderkey", "l_linenumber", "valid", "similar", "det").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_categories_by_words(spark):
    """As the patterns tell them, without a pattern for each category."""
    captions = ["A red CAR.", "carpet", "ice cream", "ice  cream", "nice cream", "an ice cream van", "keyboard", "my_car", "car-table", "", None, "the pot\n", "\u00e9cat", "Ice Cream", "1 dog2 fox"]
    frame = spark.createDataFrame([(c,) for c in captions], "cap string")
    low, want = F.lower("cap"), None
    for name, words in part_library.CATEGORIES.items():
        test = low.rlike(part_library.category_pattern(words))
        want = F.when(test, name) if want is None else want.when(test, name)
    told = frame.select(part_library.category(F.col("cap")).alias("got"))
    both = frame.select(part_library.category(F.col("cap")).alias("got"), want.otherwise("other").alias("want")).collect()
    assert [r.got for r in both] == [r.want for r in both]
    assert told._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == 1


def test_a_side_that_is_sent_meets_in_parts(spark, monkeypatch):
    """What a task holds of the pairs is bounded, as it is in blocks."""
    import pandas as pd

    monkeypatch.setattr(retrieve, "ROWS", 4)
    monkeypatch.setattr(retrieve, "ASKED", 3)
    met = retrieve._met(spark.range(20).coalesce(1), spark.range(10), ("id", "id"), lambda a, b: pd.DataFrame({"n": [len(a) * len(b)]}), "n long", F.lit(1))
    n = [r.n for r in met.collect()]
    assert max(n) == 12 and sum(n) == 200
