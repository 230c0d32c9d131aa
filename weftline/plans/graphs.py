"""Queries of contact graphs: lines of an order as its parts, placed on a small grid by price, quantity and discount."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import graph
from weftline.plans.registry import query
from weftline.session import table

TAU = 0.25
_POINTS = """points AS (SELECT l_orderkey AS oid, cast(l_linenumber AS BIGINT) AS part, cast(l_linenumber AS BIGINT) AS pid,
  l_extendedprice / 100000 AS x, l_quantity / 50 AS y, l_discount * 10 AS z FROM lineitem)"""
_EDGES = f"""{_POINTS}, edges AS (SELECT a.oid, a.part AS a, b.part AS b, count(DISTINCT b.pid) AS weight FROM points a JOIN points b ON a.oid = b.oid AND a.part < b.part
  AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 0.0625 GROUP BY ALL)"""
_REACH = f"""WITH RECURSIVE {_EDGES}, ways AS (SELECT oid, a, b FROM edges UNION ALL SELECT oid, b, a FROM edges),
  reach AS (SELECT oid, part, part AS other FROM points UNION SELECT r.oid, r.part, e.b FROM reach r JOIN ways e ON e.oid = r.oid AND e.a = r.other),
  roots AS (SELECT oid, part, min(other) AS root FROM reach GROUP BY oid, part)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.array(F.col("l_extendedprice") / 100000, F.col("l_quantity") / 50, F.col("l_discount") * 10)
    number = F.col("l_linenumber").cast("long")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("oid"), number.alias("part"), number.alias("pid"), p.alias("p"))


def _told(spark: SparkSession, sf_dir: str, told, schema: str) -> DataFrame:
    nodes = points(spark, sf_dir)
    return graph.per_object(nodes.select("oid", "part"), graph.contact_edges(nodes, TAU), told, schema)


@query(f"WITH {_EDGES} SELECT oid, a, b, weight FROM edges")
def contact_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.contact_edges(points(spark, sf_dir), TAU)


@query(f"{_REACH} SELECT oid, part, dense_rank() OVER (PARTITION BY oid ORDER BY root) - 1 AS component FROM roots")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(spark, sf_dir, graph.told_components, "part long, component long")


@query(f"{_REACH} SELECT oid, count(DISTINCT root) = 1 AS connected, count(DISTINCT root) AS pieces FROM roots GROUP BY oid")
def graph_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(spark, sf_dir, graph.told_connected, "connected boolean, pieces long")


@query(
    f"""WITH RECURSIVE {_EDGES}, ways AS (SELECT oid, a, b FROM edges UNION ALL SELECT oid, b, a FROM edges),
    cases AS (SELECT p.oid, q.part AS gone, p.part FROM points p JOIN points q ON p.oid = q.oid AND p.part <> q.part),
    reach AS (SELECT oid, gone, part, part AS other FROM cases UNION SELECT r.oid, r.gone, r.part, e.b FROM reach r JOIN ways e ON e.oid = r.oid AND e.a = r.other AND e.b <> r.gone),
    without AS (SELECT oid, gone, count(DISTINCT root) AS n FROM (SELECT oid, gone, part, min(other) AS root FROM reach GROUP BY ALL) GROUP BY oid, gone),
    whole AS (SELECT oid, gone, part, part AS other FROM (SELECT oid, -1 AS gone, part FROM points)
      UNION SELECT r.oid, r.gone, r.part, e.b FROM whole r JOIN ways e ON e.oid = r.oid AND e.a = r.other),
    base AS (SELECT oid, count(DISTINCT root) AS n FROM (SELECT oid, part, min(other) AS root FROM whole GROUP BY ALL) GROUP BY oid)
    SELECT DISTINCT p.oid, p.part, CASE WHEN NOT EXISTS (SELECT 1 FROM ways e WHERE e.oid = p.oid AND e.a = p.part) THEN 'isolated' WHEN w.n > base.n THEN 'articulation' ELSE 'free' END AS role
    FROM points p JOIN base ON base.oid = p.oid LEFT JOIN without w ON w.oid = p.oid AND w.gone = p.part"""
)
def graph_articulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(spark, sf_dir, graph.told_roles, "part long, role string")


#: From an end of each edge, all that is reached without that edge.
_WITHOUT_EDGE = f"""{_EDGES}, ways AS (SELECT oid, a, b FROM edges UNION ALL SELECT oid, b, a FROM edges),
  side AS (SELECT oid, a AS mount, b AS root, b AS part FROM ways
    UNION SELECT s.oid, s.mount, s.root, e.b FROM side s JOIN ways e ON e.oid = s.oid AND e.a = s.part AND NOT (e.a = s.root AND e.b = s.mount OR e.a = s.mount AND e.b = s.root)),
  bridges AS (SELECT oid, mount, root FROM side GROUP BY ALL HAVING count(*) FILTER (WHERE part = mount) = 0)"""


@query(f"WITH RECURSIVE {_WITHOUT_EDGE} SELECT oid, mount AS a, root AS b FROM bridges WHERE mount < root")
def graph_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(spark, sf_dir, graph.told_bridges, "a long, b long")


@query(
    f"""WITH RECURSIVE {_WITHOUT_EDGE}, whole AS (SELECT oid, count(DISTINCT part) AS n FROM points GROUP BY oid),
    sides AS (SELECT s.oid, s.mount, s.root, string_agg(part, ',' ORDER BY part) AS parts, count(*) AS n
      FROM side s JOIN bridges b ON b.oid = s.oid AND b.mount = s.mount AND b.root = s.root GROUP BY ALL)
    SELECT s.oid, s.mount, s.parts, round(s.n / w.n, 6) AS share FROM sides s JOIN whole w ON w.oid = s.oid WHERE s.n / w.n BETWEEN 0.05 AND 0.45"""
)
def graph_subassemblies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(spark, sf_dir, graph.told_subassemblies, "mount long, parts string, share double")


@query(
    f"""WITH RECURSIVE {_EDGES}, ways AS (SELECT oid, a, b FROM edges UNION ALL SELECT oid, b, a FROM edges),
    nodes AS (SELECT DISTINCT oid, part FROM points), anchor AS (SELECT oid, min(part) AS part FROM nodes GROUP BY oid),
    slots AS (SELECT p.oid, p.part AS slot, n.part AS anchor FROM nodes p JOIN anchor n ON n.oid = p.oid AND p.part <> n.part),
    held AS (SELECT oid, slot, anchor AS part FROM slots
      UNION SELECT h.oid, h.slot, e.b FROM held h JOIN ways e ON e.oid = h.oid AND e.a = h.part AND e.b <> h.slot)
    SELECT s.oid, s.slot, coalesce(string_agg(p.part, ',' ORDER BY p.part) FILTER (WHERE p.part <> s.slot AND h.part IS NULL), '') AS orphans
    FROM slots s JOIN nodes p ON p.oid = s.oid LEFT JOIN held h ON h.oid = s.oid AND h.slot = s.slot AND h.part = p.part GROUP BY s.oid, s.slot"""
)
def graph_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(spark, sf_dir, graph.told_orphans, "slot long, orphans string")
