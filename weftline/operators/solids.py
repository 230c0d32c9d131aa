"""Solids of closed meshes as runs of cells, how far they go through each other, and the smallest spheres around points.

A solid is filled along scan lines: a line through the middles of a row of cells is inside between its first and second crossing of
the surface, between its third and fourth, and so on. What is inside is kept as runs (j, k, first, last), not as cells, and two
solids share what their runs on the same line share. Runs meet on their line, so no pair of cells is made: in memory, whole objects at a time, or
where an object is large by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.keyed import dealt, whole_objects
from weftline.session import shared_folder

LINES = 1 << 20  # triangles are looked at together until they cross so many lines
FEW = 1 << 16  # triangles of an object up to which its runs meet in memory
PAIRS = 1 << 20  # of runs that are looked at together
_OFF = (1.37e-7, 2.71e-7)  # of a cell: lines keep off edges and corners that lie on the middles of cells


def runs_of(corners: np.ndarray, owner: np.ndarray, pitch: float) -> np.ndarray:
    """Rows (owner, j, k, first, last) of closed meshes, all at once: corners (n, 3, 3) of their triangles, owner (n) the mesh of each."""
    tri = corners / pitch
    flat = tri[:, :, 1:]
    one, two = flat[:, 1] - flat[:, 0], flat[:, 2] - flat[:, 0]
    turn = one[:, 0] * two[:, 1] - one[:, 1] * two[:, 0]
    across = turn != 0  # the others lie along the lines
    tri, flat, one, two, turn, owner = (x[across] for x in (tri, flat, one, two, turn, owner))
    least, most = flat.min(1) - 0.5 - _OFF, flat.max(1) - 0.5 - _OFF
    low, high = (np.ceil(least - 1e-6 - 1e-12 * np.abs(least)).astype(np.int64), np.floor(most + 1e-6 + 1e-12 * np.abs(most)).astype(np.int64) + 1)  # lines that may cross
    span = high - low
    many = span.prod(1)
    until = np.cumsum(many)
    found: list[np.ndarray] = []
    begin = 0
    while begin < len(tri):
        end = max(begin + 1, int(np.searchsorted(until, (until[begin - 1] if begin else 0) + LINES, "right")))
        at = np.repeat(np.arange(begin, end), many[begin:end])
        step = np.arange(len(at)) - np.repeat(until[begin:end] - many[begin:end] - (until[begin - 1] if begin else 0), many[begin:end])
        j, k = low[at, 0] + step // span[at, 1], low[at, 1] + step % span[at, 1]
        y, z = j + 0.5 + _OFF[0] - flat[at, 0, 0], k + 0.5 + _OFF[1] - flat[at, 0, 1]
        v, w = (y * two[at, 1] - z * two[at, 0]) / turn[at], (one[at, 0] * z - one[at, 1] * y) / turn[at]
        hit = (v >= 0) & (w >= 0) & (v + w <= 1)
        at = at[hit]
        x = tri[at, 0, 0] + v[hit] * (tri[at, 1, 0] - tri[at, 0, 0]) + w[hit] * (tri[at, 2, 0] - tri[at, 0, 0])
        found.append(np.stack([owner[at].astype(float), j[hit].astype(float), k[hit].astype(float), x], 1))
        begin = end
    if not found:
        return np.zeros((0, 5), np.int64)
    met = np.concatenate(found)
    least, most = (f(met[:, :3], axis=0, initial=0).astype(np.int64) for f in (np.min, np.max))
    of, j, k = (most - least + 1).tolist()
    if of * j * k < 1 << 62:  # a line is a number
        line = met[:, :3].astype(np.int64) @ np.array([j * k, k, 1])
        order = np.lexsort((met[:, 3], line))
        met, line = met[order], line[order]
        new = np.append(True, line[1:] != line[:-1]) if len(met) else np.zeros(0, bool)
    else:
        met = met[np.lexsort(met.T[::-1])]
        new = np.append(True, (met[1:, :3] != met[:-1, :3]).any(1))
    place = np.arange(len(met)) - np.maximum.accumulate(np.where(new, np.arange(len(met)), 0))
    enters = np.flatnonzero((place[:-1] % 2 == 0) & ~new[1:]) if len(met) else np.zeros(0, int)
    first, last = np.ceil(met[enters, 3] - 0.5), np.ceil(met[enters + 1, 3] - 0.5) - 1
    out = np.column_stack([met[enters, :3], first, last]).astype(np.int64)
    return out[out[:, 3] <= out[:, 4]]


def solid_runs(vertices: np.ndarray, faces: np.ndarray, pitch: float) -> list[tuple[int, int, int, int]]:
    """(j, k, first, last) of a closed mesh: on the line of cells (j, k) along x, the cells from first to last have their middles inside."""
    if not len(faces):
        return []
    return [tuple(r) for r in runs_of(np.asarray(vertices, float)[faces], np.zeros(len(faces), np.int64), pitch)[:, 1:].tolist()]


def _rows(nested, width: int, kind: type) -> np.ndarray:
    return np.array([list(x) for x in nested], kind).reshape(-1, width)


def solids(meshes: DataFrame, pitch: float) -> DataFrame:
    """(oid, part, j, k, first, last) of a table of closed meshes (oid, part, vertices, faces), a batch of rows at a time."""
    kinds = dict(meshes.dtypes)

    def read(frames: Iterator) -> Iterator:
        import pandas as pd

        for pdf in frames:
            corners = [_rows(v, 3, float)[_rows(f, 3, int)] for v, f in zip(pdf["vertices"], pdf["faces"], strict=True)]
            owner = np.repeat(np.arange(len(pdf)), [len(c) for c in corners])
            runs = runs_of(np.concatenate(corners) if corners else np.zeros((0, 3, 3)), owner, pitch)
            of = pdf[["oid", "part"]].iloc[runs[:, 0]].reset_index(drop=True)
            yield of.join(pd.DataFrame(runs[:, 1:], columns=["j", "k", "first", "last"]))

    return meshes.select("oid", "part", "vertices", "faces").mapInPandas(read, f"oid {kinds['oid']}, part {kinds['part']}, j int, k int, first int, last int")


def solid_overlap(runs: DataFrame) -> DataFrame:
    """(oid, a, b, cells, shared, share) for the parts a, b of an object that share cells: how many a has, how many b has of them, too."""
    size = runs.groupBy("oid", F.col("part").alias("a")).agg(F.sum(F.col("last") - F.col("first") + 1).alias("cells"))
    x, y = runs.alias("x"), runs.alias("y")
    met = x.join(y, (F.col("x.oid") == F.col("y.oid")) & (F.col("x.j") == F.col("y.j")) & (F.col("x.k") == F.col("y.k")) & (F.col("x.part") != F.col("y.part")) & (F.col("x.first") <= F.col("y.last")) & (F.col("y.first") <= F.col("x.last")))
    common = (F.least("x.last", "y.last") - F.greatest("x.first", "y.first") + 1).cast("long")
    shared = met.groupBy(F.col("x.oid").alias("oid"), F.col("x.part").alias("a"), F.col("y.part").alias("b")).agg(F.sum(common).alias("shared"))
    return shared.join(size, ["oid", "a"]).select("oid", "a", "b", "cells", "shared", (F.col("shared") / F.col("cells")).alias("share"))


def shared_cells(obj: np.ndarray, part: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(a, b, shared) of parts a < b that share cells. obj and part: of each run (j, k, first, last), parts numbered so that each is of one object."""
    none = (np.zeros(0, np.int64),) * 3
    if not len(runs):
        return none
    order = np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0], obj))
    obj, part, runs = obj[order], part[order], runs[order]
    line = np.cumsum(np.append(True, (obj[1:] != obj[:-1]) | (runs[1:, :2] != runs[:-1, :2]).any(1)))
    first, last = runs[:, 2] - runs[:, 2].min(), runs[:, 3] - runs[:, 2].min()
    width = int(last.max()) + 1
    many = np.searchsorted(line * width + first, line * width + last, "right") - np.arange(len(runs)) - 1  # those that follow on the line and begin before it ends
    until = np.cumsum(many)
    found: list[np.ndarray] = []
    begin = 0
    while begin < len(runs):
        end = max(begin + 1, int(np.searchsorted(until, (until[begin - 1] if begin else 0) + PAIRS, "right")))
        x = np.repeat(np.arange(begin, end), many[begin:end])
        y = x + 1 + np.arange(len(x)) - np.repeat(until[begin:end] - many[begin:end] - (until[begin - 1] if begin else 0), many[begin:end])
        begin = end
        other = part[x] != part[y]
        x, y = x[other], y[other]
        if len(x):
            found.append(_summed(np.stack([np.minimum(part[x], part[y]), np.maximum(part[x], part[y]), np.minimum(last[x], last[y]) - np.maximum(first[x], first[y]) + 1], 1)))
    return tuple(_summed(np.concatenate(found)).T) if found else none


def _summed(rows: np.ndarray) -> np.ndarray:
    """Rows (a, b, n), those of the same a and b as one."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    new = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1)))
    return np.column_stack([rows[new, :2], np.add.reduceat(rows[:, 2], new)])


def overlaps(meshes: DataFrame, pitch: float, few: int = FEW, grouped: bool = False) -> DataFrame:
    """``solid_overlap`` of a table of closed meshes (oid, part, vertices, faces), each part once: they are dealt by object, and runs of whole objects meet in memory.

    few: objects of more triangles have their runs joined on the line. grouped: meshes come from a grouping that has dealt them by oid.
    """
    kinds = dict(meshes.dtypes)
    shared_folder(meshes.sparkSession)
    large = meshes.groupBy("oid").agg(F.sum(F.size("faces")).alias("n")).filter(F.col("n") > few).select("oid").checkpoint(eager=True)

    def told(table):
        import pyarrow as pa

        oid = table["oid"].to_numpy()
        obj = np.cumsum(np.append(True, oid[1:] != oid[:-1])) - 1
        points, sides = (table[c].combine_chunks() for c in ("vertices", "faces"))
        count, triangles = (c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for c in (points, sides))
        place = points.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
        corner = sides.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
        corners = place[corner + np.repeat(np.cumsum(count) - count, triangles)[:, None]]
        runs = runs_of(corners, np.repeat(np.arange(len(oid)), triangles), pitch)
        a, b, shared = shared_cells(obj[runs[:, 0]], runs[:, 0], runs[:, 1:])
        cells = np.zeros(len(oid), np.int64)
        np.add.at(cells, runs[:, 0], runs[:, 4] - runs[:, 3] + 1)
        one, two = np.append(a, b), np.append(b, a)
        both, part = np.append(shared, shared), table["part"]
        return pa.table({"oid": table["oid"].take(pa.array(one)), "a": part.take(pa.array(one)), "b": part.take(pa.array(two)), "cells": pa.array(cells[one]), "shared": pa.array(both), "share": pa.array(both / cells[one])})

    def in_memory(of: DataFrame, grouped: bool = False) -> DataFrame:
        schema = f"oid {kinds['oid']}, a {kinds['part']}, b {kinds['part']}, cells long, shared long, share double"
        rows = of.select("oid", "part", "vertices", "faces")
        return (rows.repartition("oid").sortWithinPartitions("oid") if grouped else dealt(rows)).mapInArrow(whole_objects(told), schema)

    if large.isEmpty():
        return in_memory(meshes, grouped)
    return in_memory(meshes.join(large, "oid", "left_anti")).union(solid_overlap(solids(meshes.join(large, "oid", "left_semi"), pitch)))


def _through(points: np.ndarray) -> tuple[np.ndarray, float] | None:
    """The smallest sphere with all of at most four points on it; None where there is none, as with three on a line."""
    first, rest = points[0], points[1:] - points[0]
    if not len(rest):
        return first, 0.0
    gram = rest @ rest.T
    if np.linalg.matrix_rank(gram, tol=1e-12 * max(float(np.trace(gram)), 1e-300)) < len(rest):
        return None
    off = np.linalg.solve(2 * gram, np.diag(gram)) @ rest
    return first + off, float(off @ off)


def enclosing_sphere(points: np.ndarray, seed: int = 0) -> tuple[np.ndarray, float]:
    """Centre and radius of the smallest sphere around points, from at most four of them; points that can't be told apart give the sphere around their box.

    Points are taken in mixed order. One that is outside is on the sphere of those before it, which is found anew with that one held; it moves
    to the front, since it is likely to matter again.
    """
    if not len(points):
        return np.zeros(3), 0.0
    middle = (points.min(0) + points.max(0)) / 2
    scale = max(float(np.abs(points - middle).max()), 1e-300)
    order = [p for p in np.random.default_rng(seed).permutation(np.unique((points - middle) / scale, axis=0))]

    def around(upto: int, held: list[np.ndarray]) -> tuple[np.ndarray, float] | None:
        ball = _through(np.array(held)) if held else (order[0], 0.0)
        if ball is None or len(held) == 4:
            return ball
        k = 0
        while k < upto:
            p = order[k]
            if float((p - ball[0]) @ (p - ball[0])) > ball[1] * (1 + 1e-10) + 1e-14:
                found = around(k, [*held, p])
                if found is None:
                    return None
                ball = found
                order.insert(0, order.pop(k))
            k += 1
        return ball

    ball = around(len(order), [])
    if ball is None:
        return middle, float(np.sqrt(((points - middle) ** 2).sum(1).max()))
    return ball[0] * scale + middle, float(np.sqrt(ball[1])) * scale


def _all_through(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_through of many sets (n, m, 3) of at most four points: centres, squared radii, and where there is such a sphere."""
    first, rest = points[:, 0], points[:, 1:] - points[:, :1]
    n, m = rest.shape[:2]
    if not m:
        return first, np.zeros(n), np.ones(n, bool)
    gram = np.einsum("nid,njd->nij", rest, rest)
    own = np.einsum("nii->ni", gram)
    there = np.linalg.det(gram) > 1e-12 * np.maximum(own.sum(1), 1e-300) ** m
    weights = np.linalg.solve(2 * np.where(there[:, None, None], gram, np.eye(m)), own[:, :, None])[:, :, 0]
    off = np.einsum("ni,nid->nd", weights, rest)
    return first + off, (off * off).sum(1), there


def enclosing_spheres_of(points: np.ndarray, most_rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Centres and radii of the smallest spheres around each of many clouds (n, m, 3) of as many points, all at once.

    The point furthest out of a sphere joins those it rests on; the smallest sphere around these few rests on it, and on at most three of
    them. Spheres only grow, so this ends. Clouds that are too flat to tell go to ``enclosing_sphere``.
    """
    n = len(points)
    middle = (points.min(1) + points.max(1)) / 2
    scale = np.maximum(np.abs(points - middle[:, None]).max((1, 2)), 1e-300)
    unit = (points - middle[:, None]) / scale[:, None, None]
    centre, square, held = unit[:, 0].copy(), np.zeros(n), np.repeat(unit[:, :1], 4, axis=1)
    left = np.arange(n)
    for _ in range(most_rounds):
        far = ((unit[left] - centre[left, None]) ** 2).sum(2)
        at = far.argmax(1)
        out = far[np.arange(len(left)), at] > square[left] * (1 + 1e-10) + 1e-14
        left, at = left[out], at[out]
        if not len(left):
            break
        new = unit[left, at][:, None]
        few = np.concatenate([new, held[left]], 1)
        best = np.full(len(left), np.inf)
        for size in range(4):
            for some in combinations(range(1, 5), size):
                own = few[:, (0, *some)]
                c, r, there = _all_through(own)
                fits = there & (r < best) & (((few - c[:, None]) ** 2).sum(2) <= (r * (1 + 1e-10) + 1e-13)[:, None]).all(1)
                best[fits] = r[fits]
                centre[left[fits]], square[left[fits]] = c[fits], r[fits]
                held[left[fits]] = np.concatenate([own, np.repeat(new, 3 - size, axis=1)], 1)[fits]
        lost = left[best == np.inf]
        square[lost] = np.nan
        left = left[best < np.inf]
    square[left] = np.nan
    centre, radius = centre * scale[:, None] + middle, np.sqrt(square) * scale
    for i in np.flatnonzero(np.isnan(square)):
        centre[i], radius[i] = enclosing_sphere(points[i])
    return centre, radius


TOGETHER = 64  # points of a cloud up to which clouds of as many points are looked at together


def enclosing_spheres(clouds: DataFrame, keys: list[str], column: str = "vertices") -> DataFrame:
    """keys, centre and radius of the smallest sphere around each row's points, a batch of rows at a time."""
    kinds = dict(clouds.dtypes)

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            cloud = batch.column(batch.schema.get_field_index(column))
            many, points = cloud.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), cloud.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
            begin = np.cumsum(many) - many
            centre, radius = np.zeros((len(many), 3)), np.zeros(len(many))
            for n in np.unique(many):
                at = np.flatnonzero(many == n)
                if 0 < n <= TOGETHER:
                    centre[at], radius[at] = enclosing_spheres_of(points[begin[at, None] + np.arange(n)])
                else:
                    for i in at:
                        centre[i], radius[i] = enclosing_sphere(points[begin[i] : begin[i] + n])
            ends = pa.array(np.arange(0, 3 * len(many) + 1, 3, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(k)) for k in keys], pa.ListArray.from_arrays(ends, pa.array(centre.ravel())), pa.array(radius)], names=[*keys, "centre", "radius"])

    return clouds.select(*keys, column).mapInArrow(read, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", centre array<double>, radius double")
