from __future__ import annotations

import math
import random

from weftline.operators import graph, neighbours

POINTS = "oid long, part long, pid long, p array<double>"


def plain(rows, k, other):
    out = []
    for oid, part, pid, p in rows:
        far = sorted((sum((a - b) * (a - b) for a, b in zip(p, q)), tp, ti) for o, tp, ti, q in rows if o == oid and ti != pid and (tp != part or not other))
        out += [(oid, part, pid, r, tp, ti, round(math.sqrt(d), 9)) for r, (d, tp, ti) in enumerate(far[:k], 1)]
    return sorted(out)


def found(frame, **options):
    return sorted((*tuple(r)[:-1], round(r.distance, 9)) for r in neighbours.nearest(frame, **options).collect())


def cloud(seed, n, objects, parts, dims=3, grid=None):
    rng = random.Random(seed)
    place = (lambda: float(rng.randrange(grid))) if grid else rng.random
    return [(rng.randrange(objects), rng.randrange(parts), i, [place() for _ in range(dims)]) for i in range(n)]


def test_nearest_of_another_part_and_any(spark):
    rows = cloud(1, 500, 3, 4)
    frame = spark.createDataFrame(rows, POINTS)
    assert found(frame, leaf=6) == plain(rows, 1, True)
    assert found(frame, k=5, other=False, leaf=9) == plain(rows, 5, False)
    flat = cloud(2, 200, 2, 3, dims=2)
    assert found(spark.createDataFrame(flat, POINTS), k=3, dims=2, other=False, leaf=4) == plain(flat, 3, False)


def test_ties_and_equal_places(spark):
    rows = cloud(3, 200, 2, 3, grid=3)
    frame = spark.createDataFrame(rows, POINTS)
    assert found(frame, leaf=4) == plain(rows, 1, True)
    assert found(frame, k=4, other=False, leaf=4) == plain(rows, 4, False)


def test_a_dense_part_far_from_others(spark):
    rng = random.Random(4)
    rows = [(0, 1, i, [rng.random() * 1e-3 for _ in range(3)]) for i in range(400)] + [(0, 2, 400, [5.0, 5.0, 5.0]), (1, 1, 401, [0.0, 0.0, 0.0]), (2, 1, 402, [1.0, 0.0, 0.0]), (2, 1, 403, [1.0, 0.0, 0.0])]
    assert found(spark.createDataFrame(rows, POINTS), leaf=8) == plain(rows, 1, True)  # objects of one part have no rows
    assert found(spark.createDataFrame([], POINTS)) == []


def test_gaps(spark):
    rows = [(0, 1, 1, [0.0, 0.0, 0.0]), (0, 1, 2, [0.01, 0.0, 0.0]), (0, 2, 3, [0.025, 0.0, 0.0]), (0, 3, 4, [1.0, 0.0, 0.0])]
    got = {r.part: (round(r.gap, 6), r.share) for r in neighbours.part_gaps(spark.createDataFrame(rows, POINTS)).collect()}
    assert got == {1: (0.015, 0.5), 2: (0.015, 1.0), 3: (0.975, 0.0)}


def grown(rows, edges, anchors):
    """Prim's growth: the tree takes the nearest island, again and again."""
    out = []
    for oid in {r[0] for r in rows}:
        parts = {r[1] for r in rows if r[0] == oid}
        linked = graph.graph_of(parts, [(a, b, 1) for o, a, b in edges if o == oid])
        own = {p for o, p in anchors if o == oid} & parts or {min(parts)}
        pieces = [set(c) for c in graph.components(linked)]
        tree = set().union(*[c for c in pieces if c & own])
        gap = lambda a, b, oid=oid: min(math.dist(p, q) for o, x, _, p in rows for v, y, _, q in rows if o == v == oid and x == a and y == b)
        while islands := [c for c in pieces if not c & tree]:
            d, a, b = min((gap(a, b), a, b) for c in islands for a in c for b in tree)
            out.append((oid, min(a, b), max(a, b), round(d, 9)))
            tree |= next(c for c in islands if a in c)
    return sorted(out)


def test_anchoring_is_that_of_nearest_first_growth(spark):
    rows = cloud(7, 160, 4, 9)
    edges = [(0, 1, 2), (1, 3, 4), (1, 4, 5), (2, 0, 8)]
    anchors = [(0, 1), (1, 7), (1, 3), (3, 99)]
    frame = spark.createDataFrame(rows, POINTS)
    got = neighbours.virtual_edges(frame, spark.createDataFrame(edges, "oid long, a long, b long"), spark.createDataFrame(anchors, "oid long, part long"), leaf=7)
    assert sorted((r.oid, r.a, r.b, round(r.gap, 9)) for r in got.collect()) == grown(rows, edges, anchors)


def test_anchoring_of_a_whole_table(spark):
    from weftline.plans.graphs import TAU, points
    from weftline.plans.neighbours import anchoring_edges

    sf = "/root/testdata/sf0.001"
    nodes = points(spark, sf)
    rows = [(r.oid, r.part, r.pid, list(r.p)) for r in nodes.collect()]
    edges = [(r.oid, r.a, r.b) for r in graph.contact_edges(nodes, TAU).collect()]
    by_oid = {}
    for r in rows:
        by_oid.setdefault(r[0], []).append(r)
    want = sorted(e for oid, own in by_oid.items() for e in grown(own, [x for x in edges if x[0] == oid], [(oid, 1)]))
    got = sorted((r.oid, r.a, r.b, round(r.gap, 9)) for r in anchoring_edges(spark, sf).collect())
    assert [g[:1] + g[3:] for g in got] == [w[:1] + w[3:] for w in want] and len(got) > 100
    assert sum(g != w for g, w in zip(got, want)) <= len(got) // 100  # of equal gaps, either edge


def test_objects_of_few_points_are_compared_in_place(spark):
    rows = cloud(11, 700, 40, 3, grid=5) + [(o + 100, pt, i + 700, p) for o, pt, i, p in cloud(12, 300, 2, 3)]
    frame = spark.createDataFrame(rows, POINTS)
    for k, other in ((1, True), (4, False)):
        want = plain(rows, k, other)
        assert found(frame, k=k, other=other) == want == found(frame, k=k, other=other, few=100, leaf=16)
    plan = neighbours.nearest(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # points are dealt once, and nothing else is


def test_places_of_one_point_are_one_query(spark):
    rows = [(0, 1, 1, [0.0, 0.0, 0.0]), (0, 1, 1, [1.0, 0.0, 0.0]), (0, 2, 2, [1.5, 0.0, 0.0]), (0, 3, 3, [-1.0, 0.0, 0.0]), (0, 3, 4, [9.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, POINTS)
    assert found(frame) == found(frame, few=0) == [(0, 1, 1, 1, 2, 2, 0.5), (0, 2, 2, 1, 1, 1, 0.5), (0, 3, 3, 1, 1, 1, 1.0), (0, 3, 4, 1, 2, 2, 7.5)]
    assert [r for r in found(frame, k=2, other=False) if r[2] == 1] == [(0, 1, 1, 1, 2, 2, 0.5), (0, 1, 1, 2, 3, 3, 1.0)]


def test_islands_of_few_points_are_hung_up_in_place(spark):
    rows = cloud(21, 200, 14, 12)
    anchors = [(o, 3) for o in range(0, 14, 2)]
    edges = [(o, 1, 11) for o in range(0, 14, 3)] + [(5, 2, 99), (400, 1, 2)]  # of parts and objects that are not there, too
    frame = spark.createDataFrame(rows, POINTS)
    there = {r[:2] for r in rows}
    held, links = spark.createDataFrame([*anchors, (300, 1)], "oid long, part long"), spark.createDataFrame(edges, "oid long, a long, b long")
    tell = lambda contacts, **few: sorted((r.oid, r.a, r.b, round(r.gap, 9)) for r in neighbours.virtual_edges(frame, contacts, held, **few).collect())
    assert tell(links) == tell(links, few=15, leaf=7) == grown(rows, [e for e in edges if {(e[0], e[1]), (e[0], e[2])} <= there], anchors)
    near = [(o, a, b) for o, a, _, p in rows for v, b, _, q in rows if o == v and a < b and math.dist(p, q) < 0.1]
    assert tell(0.1) == grown(rows, near, anchors)
    plan = neighbours.virtual_edges(frame, 0.1, held)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # points and anchors are dealt once, and nothing else is
    assert neighbours.virtual_edges(frame.limit(0), 0.1, held).collect() == []
