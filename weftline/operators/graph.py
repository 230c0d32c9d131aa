"""Contact graphs: edges from points by a bucketed distance join, and what is told of each object's graph.

An object has tens of parts, so its graph is small whatever the number of objects; graphs are read in one group for each object.
Points are many: they meet by grid cell, never by pairs of an object.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Graph = dict[Hashable, dict[Hashable, float]]


#: Points of an object up to which all its pairs are compared; beyond, points meet by grid cell.
FEW = 64


def contact_edges(points: DataFrame, tau: float, dims: int = 3, few: int = FEW) -> DataFrame:
    """(oid, a, b, weight) for a < b: how many points of b lie nearer than tau to some point of a.

    points: (oid, part, pid and p, an array of coordinates, in units of the object's diagonal). Points of small objects meet by
    object; those of others by cells of width tau.
    """
    sized = points.join(points.groupBy("oid").agg(F.count("*").alias("many")), "oid")
    small = sized.filter(F.col("many") <= few).select("oid", "part", "pid", "p")
    x, y = small.alias("x"), small.alias("y")
    by_object = x.join(y, F.col("x.oid") == F.col("y.oid")).filter(F.col("x.part") < F.col("y.part"))
    pairs = [by_object, _by_cell(sized.filter(F.col("many") > few).drop("many"), tau, dims)]
    near = F.aggregate(F.zip_with("x.p", "y.p", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v) < tau * tau
    met = [p.filter(near).select("x.oid", F.least("x.part", "y.part").alias("a"), F.greatest("x.part", "y.part").alias("b"), F.when(F.col("x.part") < F.col("y.part"), F.col("y.pid")).otherwise(F.col("x.pid")).alias("pid")) for p in pairs]
    return met[0].union(met[1]).groupBy("oid", "a", "b").agg(F.countDistinct("pid").alias("weight"))


def _by_cell(points: DataFrame, tau: float, dims: int) -> DataFrame:
    """Pairs x, y of points of different parts whose cells touch, each once: a point goes to its own cell, and as a partner to half of the cells around it."""
    cells = [f"c{d}" for d in range(dims)]
    placed = points.select("*", *[F.floor(F.col("p")[d] / tau).alias(c) for d, c in enumerate(cells)])
    steps = [[(k // 3**d) % 3 - 1 for d in range(dims)] for k in range(3**dims // 2, 3**dims)]  # the first is the own cell
    moves = F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for v, c in zip(step, cells, strict=True)]) for step in steps])
    around = placed.withColumn("m", F.explode(moves)).select("oid", "part", "pid", "p", *[(F.col(c) + F.col(f"m.{c}")).alias(c) for c in cells], F.expr(" and ".join(f"m.{c} = 0" for c in cells)).alias("own"))
    x, y = around.alias("x"), placed.alias("y")
    same = F.col("x.oid") == F.col("y.oid")
    for c in cells:
        same &= F.col(f"x.{c}") == F.col(f"y.{c}")
    return x.join(y, same).filter((F.col("x.part") < F.col("y.part")) | (F.col("x.part") > F.col("y.part")) & ~F.col("x.own"))


def graph_of(nodes: Iterable, edges: Iterable[tuple]) -> Graph:
    out: Graph = {n: {} for n in nodes}
    for a, b, w in edges:
        out.setdefault(a, {})[b] = w
        out.setdefault(b, {})[a] = w
    return out


def components(graph: Graph, without: Hashable = None, cut: frozenset = frozenset()) -> list[list]:
    """Components in order of their first node, without one node or one edge."""
    left, out = {n for n in graph if n != without}, []
    for root in sorted(left):
        if root not in left:
            continue
        left.discard(root)
        found, stack = [root], [root]
        while stack:
            at = stack.pop()
            for near in graph[at]:
                if near in left and frozenset((at, near)) != cut:
                    left.discard(near)
                    found.append(near)
                    stack.append(near)
        out.append(sorted(found))
    return out


def low_links(graph: Graph) -> tuple[set, set[frozenset]]:
    """Articulation points and bridges, by one depth-first walk with low links, without recursion."""
    order, low, cuts, bridges = {}, {}, set(), set()
    for root in sorted(graph):
        if root in order:
            continue
        order[root] = low[root] = len(order)
        children, stack = 0, [(root, None, iter(sorted(graph[root])))]
        while stack:
            at, parent, near = stack[-1]
            step = next(near, None)
            if step is None:
                stack.pop()
                if stack:
                    above = stack[-1][0]
                    low[above] = min(low[above], low[at])
                    if low[at] > order[above]:
                        bridges.add(frozenset((above, at)))
                    if above != root and low[at] >= order[above]:
                        cuts.add(above)
            elif step in order:
                if step != parent:
                    low[at] = min(low[at], order[step])
            else:
                order[step] = low[step] = len(order)
                children += at == root
                stack.append((step, at, iter(sorted(graph[step]))))
        if children > 1:
            cuts.add(root)
    return cuts, bridges


def isolated(graph: Graph) -> set:
    return {n for n, near in graph.items() if not near}


def subassemblies(graph: Graph, size: dict | None = None, low: float = 0.05, high: float = 0.45) -> list[tuple]:
    """(mount, parts, share): the sides of bridges that hold a share of all weight between low and high, each once, the largest first."""
    weight = {n: 1.0 if size is None else float(size.get(n, 0.0)) for n in graph}
    total, out, seen = sum(weight.values()) or 1.0, [], set()
    for edge in sorted(map(sorted, low_links(graph)[1])):
        for mount, root in (edge, edge[::-1]):
            side = next(c for c in components(graph, cut=frozenset(edge)) if root in c)
            share = sum(weight[n] for n in side) / total
            if low <= share <= high and len(side) < len(graph) and tuple(side) not in seen:
                seen.add(tuple(side))
                out.append((mount, side, share))
    return sorted(out, key=lambda x: -x[2])


def orphans(graph: Graph, slot: Hashable, anchors: set) -> list:
    """Parts that hang on no anchor any more once a slot is gone."""
    return sorted(n for c in components(graph, without=slot) if not anchors & set(c) for n in c)


def virtual_edges(graph: Graph, anchors: set, gap: Callable[[Hashable, Hashable], float]) -> list[tuple]:
    """(part, neighbour, gap): edges that hang what has no way to an anchor on the nearest part that has one, the nearest first."""
    tree = {n for c in components(graph) if anchors & set(c) for n in c} or set(sorted(anchors & set(graph))[:1])
    out = []
    while tree and (islands := [c for c in components(graph) if not tree & set(c)]):
        best = min((gap(a, b), a, b) for c in islands for a in c for b in tree)
        out.append((best[1], best[2], best[0]))
        tree |= next(set(c) for c in islands if best[1] in c)
    return out


def per_object(nodes: DataFrame, edges: DataFrame, told: Callable[[Graph], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows that told makes of each object's graph. nodes: (oid, part); edges: (oid, a, b, weight).

    An object's few parts and edges are put into one row; rows go to Python many at a time.
    """
    parts = nodes.groupBy("oid").agg(F.collect_set(F.col("part").cast("long")).alias("parts"))
    linked = edges.groupBy("oid").agg(F.collect_list(F.struct(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("weight").cast("double").alias("w"))).alias("edges"))
    rows = parts.join(linked, "oid", "left").select("oid", "parts", "edges")
    full = f"oid {dict(nodes.dtypes)['oid']}, {schema}"

    def read(frames: Iterator) -> Iterator:
        import pandas as pd

        names = [c.split()[0] for c in full.split(", ")]
        for pdf in frames:
            out = []
            for oid, own, links in zip(pdf["oid"], pdf["parts"], pdf["edges"], strict=True):
                made = graph_of(map(int, own), [(e["a"], e["b"], e["w"]) for e in links] if links is not None else [])
                out += [(oid, *row) for row in told(made)]
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(read, full)


def told_components(graph: Graph):
    return [(n, i) for i, c in enumerate(components(graph)) for n in c]


def told_connected(graph: Graph):
    """Whether a graph is in one piece, and in how many it is."""
    found = len(components(graph))
    return [(found == 1, found)]


def told_roles(graph: Graph):
    """part, role: articulation, isolated, or free (it may be replaced alone)."""
    cuts, alone = low_links(graph)[0], isolated(graph)
    return [(n, "isolated" if n in alone else "articulation" if n in cuts else "free") for n in sorted(graph)]


def told_bridges(graph: Graph):
    return [tuple(e) for e in sorted(map(sorted, low_links(graph)[1]))]


def told_subassemblies(graph: Graph):
    return [(mount, ",".join(map(str, side)), round(share, 6)) for mount, side, share in subassemblies(graph)]


def told_orphans(graph: Graph):
    anchors = {min(graph)}
    return [(n, ",".join(map(str, orphans(graph, n, anchors)))) for n in sorted(graph) if n not in anchors]
