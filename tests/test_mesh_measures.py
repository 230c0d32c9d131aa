"""The mesh measures of a whole table against plain versions of each."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pytest
from weftline.operators import geometry
from weftline.plans.geometry import mesh_measures, meshes

SF = "/root/testdata/sf0.001"


def groups(n, pairs):
    """Sets of what pairs lead to, by flooding."""
    near = {i: set() for i in range(n)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    out, seen = [], set()
    for i in range(n):
        if i not in seen:
            own, stack = {i}, [i]
            while stack:
                new = near[stack.pop()] - own
                own |= new
                stack += new
            seen |= own
            out.append(own)
    return out


def plain(v, f):
    diagonal = math.dist(v.min(0), v.max(0))
    used = sorted({i for t in f for i in t}) or list(range(len(v)))
    pieces = [g & set(used) for g in groups(len(v), [p for t in f for p in combinations(t, 2)]) if g & set(used)]
    lonely = 0.0
    if len(pieces) > 1:
        lonely = max(min(math.dist(v[i], v[j]) for i in own for j in used if j not in own) for own in pieces) / max(diagonal, 1e-9)

    def normal(t):
        n = np.cross(v[t[1]] - v[t[0]], v[t[2]] - v[t[0]])
        return n / max(np.linalg.norm(n), 1e-12)

    flat = []
    for a, b in combinations(range(len(f)), 2):
        if len(set(f[a]) & set(f[b])) >= 2 and normal(f[a]) @ normal(f[b]) >= math.cos(math.radians(10)) and abs((v[f[b][0]] - v[f[a][0]]) @ normal(f[a])) <= 0.015 * diagonal:
            flat.append((a, b))
    spread = (v - v.mean(0)) @ np.linalg.svd(v - v.mean(0))[2][0]
    return len(pieces), lonely, len(groups(len(f), flat)), (spread.max() - spread.min()) / max(diagonal, 1e-9)


def test_measures_of_all_meshes(spark):
    got = {r.oid: tuple(r)[1:] for r in mesh_measures(spark, SF).collect()}
    rows = meshes(spark, SF).collect()
    assert len(rows) == len(got) > 1000
    for r in rows:
        v = np.array([list(x) for x in r.vertices])
        parts, lonely, patches, slender = plain(v, [list(t) for t in r.faces])
        assert got[r.oid][0] == parts and got[r.oid][2] == patches, r.oid
        assert got[r.oid][1] == pytest.approx(lonely, abs=2e-4) and got[r.oid][3] == pytest.approx(slender, abs=2e-4), r.oid


def test_many_meshes_are_measured_as_one_by_one():
    rng = np.random.default_rng(3)
    clouds = [rng.random((n, 3)) for n in (0, 1, 2, 3, 5, 9, 4, 6)]
    sides = [np.array([[0, i, i + 1] for i in range(1, len(v) - 1)], int).reshape(-1, 3) for v in clouds]
    sides[6], sides[7] = np.zeros((0, 3), int), np.array([[0, 1, 2], [3, 4, 5]])
    told = geometry.mesh_measures_of(np.concatenate(clouds), np.array([len(v) for v in clouds]), np.concatenate(sides), np.array([len(f) for f in sides]))
    for got, v, f in zip(zip(*told, strict=True), clouds, sides, strict=True):
        assert np.allclose(got, geometry.mesh_measures(v, f))
