"""Bounding boxes, signatures and transforms as column expressions; arrays are of doubles, transforms of 16 in row order."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def extents(lo: Column, hi: Column) -> Column:
    return F.zip_with(hi, lo, lambda a, b: F.abs(a - b))


def falling(sizes: Column) -> Column:
    return F.reverse(F.array_sort(sizes))


def shape_signature(sizes: Column) -> Column:
    d = falling(sizes)
    longest = F.greatest(d[0], F.lit(1e-9))
    return F.array(F.lit(1.0), d[1] / longest, d[2] / longest)


def axisymmetry(sizes: Column) -> Column:
    d = falling(sizes)
    return F.least(d[1], d[2]) / F.greatest(d[1], d[2], F.lit(1e-9))


def aspect(sizes: Column) -> Column:
    d = falling(sizes)
    return d[0] / F.greatest(d[2], F.lit(1e-6))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    size = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x / size)


def signature_gap(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v)


def linear_part(t: Column) -> list[list[Column]]:
    return [[F.element_at(t, 4 * r + c + 1) for c in range(3)] for r in range(3)]


def determinant(t: Column) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = linear_part(t)
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def singular_values(t: Column) -> Column:
    """(most, least): the largest and the smallest singular value of the linear part.

    Their squares are roots of the Gram matrix's characteristic polynomial. Its largest root comes by cosines; the two others
    from what is left, whose coefficients are sums of squares of minors, so that the smallest root keeps its digits.
    """
    m, pairs = linear_part(t), [(0, 1), (0, 2), (1, 2)]
    gram = {f"g{i}{j}": sum((m[k][i] * m[k][j] for k in range(3)), F.lit(0.0)) for i in range(3) for j in range(i, 3)}
    minors = sum(((m[i][k] * m[j][n] - m[i][n] * m[j][k]) * (m[i][k] * m[j][n] - m[i][n] * m[j][k]) for i, j in pairs for k, n in pairs), F.lit(0.0))
    told = F.struct(*[v.alias(k) for k, v in gram.items()], minors.alias("minors"), (determinant(t) * determinant(t)).alias("volume"))

    def by_cosine(g: Column) -> Column:
        third = (g["g00"] + g["g11"] + g["g22"]) / 3
        squares = sum(((g[f"g{i}{i}"] - third) * (g[f"g{i}{i}"] - third) for i in range(3)), F.lit(0.0))
        beside = g["g01"] * g["g01"] + g["g02"] * g["g02"] + g["g12"] * g["g12"]
        middle = F.struct(third.alias("third"), F.sqrt((squares + 2 * beside) / 6).alias("spread"))

        def first(c: Column) -> Column:
            x, y, z = (g[f"g{i}{i}"] - c["third"] for i in range(3))
            whole = x * (y * z - g["g12"] * g["g12"]) - g["g01"] * (g["g01"] * z - g["g12"] * g["g02"]) + g["g02"] * (g["g01"] * g["g12"] - y * g["g02"])
            half = whole / (2 * c["spread"] * c["spread"] * c["spread"])
            turned = c["third"] + 2 * c["spread"] * F.cos(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half))) / 3)
            return F.when(c["spread"] > c["third"] * 1e-14, turned).otherwise(c["third"])

        def rest(most: Column) -> Column:
            product = g["volume"] / most
            ends = F.struct(product.alias("product"), ((g["minors"] - product) / most).alias("both"))
            return _let(ends, lambda e: 2 * e["product"] / (e["both"] + F.sqrt(F.greatest(e["both"] * e["both"] - 4 * e["product"], F.lit(0.0)))))

        return _let(_let(middle, first), lambda most: F.struct(F.sqrt(most).alias("most"), F.sqrt(rest(most)).alias("least")))

    return _let(told, by_cosine)


def is_transform(t: Column) -> Column:
    """16 finite numbers, an affine last row, a positive determinant, and singular values between 1e-5 and 1e4."""
    finite = F.forall(t, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e300))
    last = F.slice(t, 13, 4) == F.array(*[F.lit(float(x)) for x in (0, 0, 0, 1)])
    sized = _let(singular_values(t), lambda s: (s["least"] >= 1e-5 * (1 - 1e-12)) & (s["most"] <= 1e4 * (1 + 1e-12)))
    return F.coalesce((F.size(t) == 16) & finite & last & F.when(determinant(t) > 0, sized), F.lit(False))


def gram(t: Column) -> list[list[Column]]:
    """Products of the columns of the linear part."""
    m = linear_part(t)
    return [[sum((m[k][i] * m[k][j] for k in range(3)), F.lit(0.0)) for j in range(3)] for i in range(3)]


def _definite(g: list[list[Column]]) -> Column:
    """That a symmetric matrix is positive definite, by its leading minors."""
    (a, b, c), (_, d, e), (_, _, f) = g
    return (a > 0) & (a * d - b * b > 0) & (a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) > 0)


def is_bounded(t: Column, least: float = 1e-10, most: float = 1e8) -> Column:
    """A positive determinant, and squared singular values between least and most, told by definite matrices; null where a number is.

    There are no roots in it, so every engine tells the same, step by step. ``is_transform`` keeps its digits where singular values lie far
    apart; here rounding decides those that are within about a hundredth of a bound.
    """
    g = gram(t)
    shifted = lambda sign, at: [[sign * g[i][j] if i != j else at(g[i][i]) for j in range(3)] for i in range(3)]
    return (determinant(t) > 0) & _definite(shifted(1.0, lambda x: x - least)) & _definite(shifted(-1.0, lambda x: most - x))


def is_even(t: Column, absolute: float = 1e-9, relative: float = 1e-7) -> Column:
    """That the columns of the linear part are orthogonal and of one length; null where a number is."""
    g = gram(t)
    whole = g[0][0] + g[1][1] + g[2][2]
    near = [F.abs(g[i][j] - whole / 3 if i == j else g[i][j]) <= absolute + relative * whole / 3 for i in range(3) for j in range(i, 3)]
    return reduce(lambda a, b: a & b, near)


def is_similarity(t: Column, absolute: float = 1e-9, relative: float = 1e-7) -> Column:
    """A transform whose linear part is a rotation times one scale."""
    m = linear_part(t)
    gram = [[sum((m[k][i] * m[k][j] for k in range(3)), F.lit(0.0)) for j in range(3)] for i in range(3)]
    scale = (gram[0][0] + gram[1][1] + gram[2][2]) / 3
    near = [F.abs(gram[i][j] - (scale if i == j else F.lit(0.0))) <= absolute + relative * scale for i in range(3) for j in range(3)]
    out = is_transform(t)
    for test in near:
        out = out & test
    return F.coalesce(out, F.lit(False))


def moved(vertices: Column, t: Column) -> Column:
    """Vertices (arrays of three) under a transform."""
    row = lambda v, r: sum((F.element_at(t, 4 * r + c + 1) * v[c] for c in range(3)), F.element_at(t, 4 * r + 4))
    return F.transform(vertices, lambda v: F.array(*[row(v, r) for r in range(3)]))


def bounds(vertices: Column) -> Column:
    def along(k: int) -> Column:
        return F.transform(vertices, lambda v: v[k])

    side = lambda f: F.array(*[f(along(k)) for k in range(3)])
    return F.struct(side(F.array_min).alias("lo"), side(F.array_max).alias("hi"))


def focus(lo: Column, hi: Column, scene_lo: Column, scene_hi: Column) -> Column:
    """Centre relative to the scene and its largest extent, y up to z up, and the part's diagonal by the same scale."""
    centre = lambda a, b: F.zip_with(a, b, lambda x, y: (x + y) / 2)
    scale = F.greatest(F.array_max(extents(scene_lo, scene_hi)), F.lit(1e-9))
    away = F.zip_with(centre(lo, hi), centre(scene_lo, scene_hi), lambda x, y: (x - y) / scale)
    return F.struct(F.array(away[0], -away[2], away[1]).alias("center"), (norm(extents(lo, hi)) / scale).alias("diag"))


def checksum(values: Column, digits: int = 4) -> Column:
    """(nv, vs): how many values, and the sum of their sizes."""
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + F.abs(v.cast("double")))
    return F.struct(F.size(values).alias("nv"), F.round(total, digits).alias("vs"))


def sphere(vertices: Column) -> Column:
    """The ball around the middle of the bounding box that holds all vertices."""
    box = bounds(vertices)
    middle = F.zip_with(box["lo"], box["hi"], lambda a, b: (a + b) / 2)
    reach = F.array_max(F.transform(vertices, lambda v: norm(F.zip_with(v, middle, lambda a, b: a - b))))
    return F.struct(middle.alias("center"), reach.alias("radius"))


def canonical_triangle(a: Column, b: Column, c: Column) -> Column:
    """The same for any order of a triangle's corners."""
    return F.array_sort(F.array(a, b, c))


def payload_hash(*parts: Column) -> Column:
    """SHA-256 over named, length-marked parts; null parts are marked as such."""
    fed = [F.when(p.isNull(), F.lit("-")).otherwise(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string"))) for p in parts]
    return F.sha2(F.concat_ws("|", *fed), 256)


def hashed_uniform(*keys: Column | str, seed: int = 0) -> Column:
    """A uniform number in (0, 1) that depends on its keys alone, not on how rows are dealt."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k) if isinstance(k, str) else k for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
