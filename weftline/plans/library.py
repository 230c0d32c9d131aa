"""Queries of the part library, its registry and its hosts, over stand-ins among the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import keyed, library
from weftline.plans.registry import query
from weftline.session import table


@query(
    """SELECT ds, lang, count(*) AS n, count(text) AS n_text FROM (
      SELECT 'first' AS ds, lang, text FROM documents UNION ALL SELECT 'second', NULL, text FROM conversations) GROUP BY ds, lang"""
)
def library_union_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    both = keyed.tagged_union({"first": docs, "second": table(spark, sf_dir, "conversations").select("text")})
    return both.groupBy("ds", "lang").agg(F.count("*").alias("n"), F.count("text").alias("n_text"))


@query(
    """SELECT doc_id, 'old' AS state FROM documents WHERE lang = 'en'
    UNION ALL SELECT doc_id, 'new' FROM documents d WHERE lang <> 'en' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0)"""
)
def library_incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    old = docs.filter("lang = 'en'").select("doc_id", F.lit("old").alias("state"))
    failed = table(spark, sf_dir, "labels").filter("quality = 0")
    return keyed.appended(old, docs.select("doc_id", F.lit("new").alias("state")), ["doc_id"], failed)


@query(
    """SELECT o.c_custkey, o.seg, o.total FROM (SELECT c_custkey, c_mktsegment AS seg, c_acctbal AS total FROM customer) o
      WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = o.c_custkey)
    UNION ALL SELECT o_custkey, o_orderpriority, o_totalprice FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1"""
)
def registry_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as registry rows, overwritten by their latest order."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("seg"), F.col("o_totalprice").alias("total"), "o_orderdate", "o_orderkey")
    latest = keyed.first_by(orders, ["c_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).drop("o_orderdate", "o_orderkey")
    old = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("total"))
    return keyed.overwritten(old, latest, ["c_custkey"])


@query(
    """WITH n AS (SELECT l_orderkey, count(*) AS n_slots FROM lineitem GROUP BY l_orderkey)
    SELECT oid, ord, granularity, n_slots FROM (
      SELECT o_custkey AS oid, o_orderkey AS ord, o_orderpriority AS granularity, n_slots,
             row_number() OVER (PARTITION BY o_custkey ORDER BY n_slots, o_orderkey) AS r
      FROM orders JOIN n ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P') WHERE r = 1"""
)
def registry_coarsest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as divisions of customers: the one with fewest lines."""
    slots = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("ord")).agg(F.count("*").alias("n_slots"))
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("oid"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("granularity"), (F.col("o_orderstatus") != "P").alias("verified")
    )
    return library.coarsest_division(orders.join(slots, "ord")).select("oid", "ord", "granularity", "n_slots")


@query(
    """SELECT DISTINCT text FROM (SELECT text FROM conversations WHERE role = 'user'
      UNION ALL SELECT CASE WHEN instr(text, ' ') > 0 THEN text ELSE 'a ' || text END FROM conversations WHERE role = 'system') WHERE text IS NOT NULL"""
)
def query_text_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").filter("text is not null")
    none = F.expr("cast(array() as array<string>)")
    roles = said.select(F.when(F.col("role") == "user", F.array("text")).otherwise(none).alias("queries"), F.when(F.col("role") == "system", F.array("text")).otherwise(none).alias("rejects"))
    return library.query_texts(roles)


_SCREEN = """WITH stats AS (
  SELECT l_orderkey AS oid, count(*) AS n, count(DISTINCT l_returnflag) AS components,
         max(l_extendedprice) / sum(l_extendedprice) AS largest, cast(sum(l_quantity) AS BIGINT) AS faces FROM lineitem GROUP BY l_orderkey
) SELECT oid, n, faces, round(largest, 4) AS largest FROM stats
  WHERE n BETWEEN 2 AND 25 AND components = 1 AND largest < 0.6 AND faces <= 600000
    AND oid NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') AND oid IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW')"""


@query(_SCREEN)
def host_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as hosts, their lines as parts."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("oid"), F.col("l_extendedprice").alias("area"), F.col("l_quantity").cast("long").alias("faces"), F.col("l_returnflag").alias("component")
    )
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "oid")
    fit = library.screened_hosts(lines, orders.filter("o_orderstatus = 'P'"), orders.filter("o_orderpriority <> '5-LOW'"), low=2)
    return fit.select("oid", "n", "faces", F.round("largest", 4).alias("largest"))


_CASES = " ".join(f"WHEN regexp_matches(lower(cap), '{library.category_pattern(w)}') THEN '{n}'" for n, w in library.CATEGORIES.items())
_CAPS = "(SELECT p_partkey AS oid, p_size AS n, p_name AS cap FROM part)"


@query(
    f"""SELECT category, count(*) AS hosts, sum(n) AS parts FROM (SELECT n, CASE {_CASES} ELSE 'other' END AS category FROM (
      SELECT oid, n, cap FROM {_CAPS} UNION ALL SELECT doc_id, n_chars, text FROM documents)) GROUP BY category"""
)
def host_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("n"), F.col("p_name").alias("cap"))
    docs = table(spark, sf_dir, "documents").select(F.col("n_chars").alias("n"), F.col("text").alias("cap"))
    told = parts.union(docs).withColumn("category", library.category(F.col("cap")))
    return told.groupBy("category").agg(F.count("*").alias("hosts"), F.sum("n").alias("parts"))


@query(
    """WITH ranked AS (SELECT p_partkey, p_type AS bucket, substr(lower(p_name || ' ' || p_brand), 1, 40) AS key, count(*) OVER (PARTITION BY p_type) AS size,
        row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey DESC) AS turn FROM part
    ), once AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn, size DESC, bucket) AS seen FROM ranked)
    SELECT bucket, p_partkey FROM once WHERE seen = 1 ORDER BY turn, size DESC, bucket LIMIT 150"""
)
def host_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumnRenamed("p_type", "bucket")
    key = F.substring(F.lower(F.concat_ws(" ", "p_name", "p_brand")), 1, 40)
    return library.round_robin(parts, "bucket", [F.desc("p_size"), F.desc("p_partkey")], key, 150).select("bucket", "p_partkey")


@query(
    """WITH s AS (SELECT s_suppkey AS oid, l_discount AS sat, l_tax AS bri FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_discount > 0.05)
    SELECT oid, count(*) AS parts, count(sat) AS textured, round(coalesce(avg(sat), 0.0), 6) AS saturation, round(coalesce(avg(bri), 1.0), 6) AS brightness FROM s GROUP BY oid
    HAVING count(sat) > 0 AND coalesce(avg(sat), 0.0) >= 0.02"""
)
def host_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("oid"))
    lines = table(spark, sf_dir, "lineitem").filter("l_discount > 0.05").select(F.col("l_suppkey").alias("oid"), F.col("l_discount").alias("saturation"), F.col("l_tax").alias("brightness"))
    stats = library.texture_stats(hosts.join(lines, "oid", "left"))
    rounded = stats.withColumns({c: F.round(c, 6) for c in ("saturation", "brightness")})
    return library.colourful(hosts, rounded)


@query(
    """SELECT v.vec_id, v.label, p.p_name FROM embeddings v LEFT JOIN part p ON p.p_partkey = v.vec_id * 3"""
)
def pool_with_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pool rows found in the library, and those that are missing there."""
    pool = table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("vec_id") * 3).alias("p_partkey"))
    found, missing = keyed.matched(pool, table(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_partkey"])
    return found.select("vec_id", "label", "p_name").unionByName(missing.select("vec_id", "label"), allowMissingColumns=True)


@query("SELECT user_id, max(event_id) + 1 AS next_turn FROM events WHERE event_type <> 'error' GROUP BY user_id")
def resume_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "events").filter("event_type <> 'error'").select("user_id", F.col("event_id").alias("turn"))
    return keyed.resume_point(kept, ["user_id"])


@query(
    f"""WITH screened AS ({_SCREEN.replace("WITH stats AS", "SELECT oid, n FROM (WITH stats AS", 1)})),
    colour AS (SELECT l_orderkey AS oid, count(*) FILTER (WHERE l_discount > 0.05) AS textured, avg(l_discount) FILTER (WHERE l_discount > 0.05) AS saturation FROM lineitem GROUP BY l_orderkey),
    caps AS (SELECT l_orderkey AS oid, min(p_name || ' ' || p_brand) AS cap FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey),
    told AS (SELECT s.oid, s.n, cap, CASE {_CASES} ELSE 'other' END AS category FROM screened s JOIN caps USING (oid) LEFT JOIN colour c ON c.oid = s.oid
      WHERE c.textured IS NULL OR c.textured > 0 AND coalesce(c.saturation, 0.0) >= 0.02),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, oid) AS turn, count(*) OVER (PARTITION BY category) AS size, lower(substr(cap, 1, 40)) AS key FROM told),
    once AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn, size DESC, category) AS seen FROM ranked)
    SELECT category, oid, n FROM once WHERE seen = 1 ORDER BY turn, size DESC, category LIMIT 60"""
)
def host_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screening, colour, categories and turns as one flow; the limit is the feature."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "oid")
    parts = lines.select("oid", F.col("l_extendedprice").alias("area"), F.col("l_quantity").cast("long").alias("faces"), F.col("l_returnflag").alias("component"))
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "oid")
    screened = library.screened_hosts(parts, orders.filter("o_orderstatus = 'P'"), orders.filter("o_orderpriority <> '5-LOW'"), low=2)
    textures = lines.select("oid", F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("saturation"), F.col("l_tax").alias("brightness"))
    names = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    caps = names.groupBy("oid").agg(F.min(F.concat_ws(" ", "p_name", "p_brand")).alias("cap"))
    return library.selected_hosts(screened.select("oid", "n"), textures, caps, 60)
