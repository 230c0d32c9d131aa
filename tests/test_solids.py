from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest
from weftline.operators import solids
from weftline.plans.solids import SIDES

CUBE = np.array([[x, y, z] for x in (0, 1) for y in (0, 1) for z in (0, 1)], float)
SIDES = np.array(SIDES)
MESHES = "oid long, part long, vertices array<array<double>>, faces array<array<int>>"


def cells(runs):
    return {(i, j, k) for j, k, first, last in runs for i in range(first, last + 1)}


def test_a_box_is_filled():
    got = cells(solids.solid_runs(CUBE * [0.5, 0.3, 0.4] + [0.1, -0.2, 0.05], SIDES, 0.1))
    assert got == {(i, j, k) for i in range(1, 6) for j in range(-2, 1) for k in range(0, 4)} or len(got) == 5 * 3 * 4
    assert solids.solid_runs(CUBE, np.zeros((0, 3), int), 0.1) == []


def test_a_hollow_and_a_slanted_solid():
    shell = np.concatenate([CUBE, CUBE * 0.5 + 0.25])  # the inner surface is crossed, too
    got = cells(solids.solid_runs(shell, np.concatenate([SIDES, SIDES + 8]), 0.05))
    assert len(got) == 20**3 - 10**3 and (10, 10, 10) not in got
    corner = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1.0]])
    got = cells(solids.solid_runs(corner, np.array([[0, 2, 1], [0, 1, 3], [0, 3, 2], [1, 2, 3]]), 0.04))
    want = {(i, j, k) for i in range(25) for j in range(25) for k in range(25) if (i + j + k + 1.5) * 0.04 < 1}
    assert len(got ^ want) <= len(want) // 20 and abs(len(got) * 0.04**3 - 1 / 6) < 0.01


def test_overlap(spark):
    rows = [(1, p, (CUBE * size + at).tolist(), SIDES.tolist()) for p, size, at in ((1, 1.0, 0.0), (2, 1.0, 0.5), (3, 0.3, 0.6), (4, 1.0, 5.0))]
    got = {(r.a, r.b): (r.cells, r.shared) for r in solids.solid_overlap(solids.solids(spark.createDataFrame(rows, MESHES), 0.1)).collect()}
    assert got == {(1, 2): (1000, 125), (2, 1): (1000, 125), (1, 3): (1000, 27), (3, 1): (27, 27), (2, 3): (1000, 27), (3, 2): (27, 27)}


def test_overlap_in_memory_is_that_of_the_join(spark):
    rng = np.random.default_rng(3)
    shell = np.concatenate([CUBE, CUBE * 0.5 + 0.25]), np.concatenate([SIDES, SIDES + 8])  # hollow: two runs on a line
    rows = [(int(o), p, (shell[0] * rng.uniform(0.2, 1.5) + rng.uniform(-1, 1, 3)).tolist(), shell[1].tolist()) for o in range(12) for p in range(o)] + [(20, 1, [], []), (20, 2, CUBE.tolist(), SIDES.tolist())]
    meshes = spark.createDataFrame(rows, MESHES)
    tell = lambda df: sorted(map(tuple, df.collect()))
    want = tell(solids.solid_overlap(solids.solids(meshes, 0.1)))
    assert len(want) > 100 and tell(solids.overlaps(meshes, 0.1)) == want == tell(solids.overlaps(meshes, 0.1, few=150))
    plan = solids.overlaps(meshes, 0.1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan  # meshes are dealt once, not their runs


def plain_radius(points):
    """The smallest of the spheres through two, three or four points that hold all."""
    best = np.inf
    for n in (1, 2, 3, 4):
        for some in combinations(points, n):
            ball = solids._through(np.array(some))
            if ball and (np.linalg.norm(points - ball[0], axis=1) <= np.sqrt(ball[1]) + 1e-9).all():
                best = min(best, np.sqrt(ball[1]))
    return best


@pytest.mark.parametrize("seed", range(12))
def test_the_smallest_sphere(seed):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(3 + seed, 3)) * [1, 0.2, 5]
    if seed % 3 == 0:
        points[:, 2] = 1.0  # in a plane
    centre, radius = solids.enclosing_sphere(points)
    assert (np.linalg.norm(points - centre, axis=1) <= radius * (1 + 1e-9) + 1e-12).all()
    assert radius == pytest.approx(plain_radius(points), rel=1e-7)


def test_spheres_of_few_and_equal_points():
    assert solids.enclosing_sphere(np.zeros((0, 3)))[1] == 0 and solids.enclosing_sphere(np.ones((5, 3)))[1] == 0
    centre, radius = solids.enclosing_sphere(np.array([[0, 0, 0], [1, 0, 0], [4, 0, 0.0]]))  # on a line
    assert np.allclose(centre, [2, 0, 0]) and radius == pytest.approx(2)
    assert solids.enclosing_sphere(CUBE)[1] == pytest.approx(np.sqrt(3) / 2)
    many = np.random.default_rng(1).normal(size=(3000, 3))
    centre, radius = solids.enclosing_sphere(many)
    assert (np.linalg.norm(many - centre, axis=1) <= radius * (1 + 1e-9)).all()


def test_spheres_of_a_whole_table(spark):
    from weftline.plans.geometry import meshes
    from weftline.plans.solids import enclosing_spheres

    sf = "/root/testdata/sf0.001"
    got = {r.oid: r.radius for r in enclosing_spheres(spark, sf).collect()}
    for r in meshes(spark, sf).limit(200).collect():
        assert got[r.oid] == pytest.approx(plain_radius(np.array([list(v) for v in r.vertices])), abs=2e-6)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9])
def test_many_spheres_at_once(n):
    rng = np.random.default_rng(n)
    clouds = rng.normal(size=(300, n, 3)) * [1, 0.2, 5]
    clouds[:40, :, 2] = 1.0  # in a plane
    clouds[40:60, :, 1:] = 0.0  # on a line
    clouds[60:70] = clouds[60:70, :1]  # at one place
    clouds[70:80, n // 2 :] = clouds[70:80, :1]  # some of them equal
    centres, radii = solids.enclosing_spheres_of(clouds)
    for points, centre, radius in zip(clouds, centres, radii, strict=True):
        assert (np.linalg.norm(points - centre, axis=1) <= radius * (1 + 1e-8) + 1e-7).all()
        assert radius == pytest.approx(solids.enclosing_sphere(points)[1], rel=1e-6, abs=1e-7)
