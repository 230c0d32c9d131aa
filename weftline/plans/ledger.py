"""Queries of assets, plans, jobs and what is left to do, over stand-ins among the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import annotate, keyed, library, recipe
from weftline.plans import chains
from weftline.plans.captions import admission_sql, captions
from weftline.plans.registry import query, rounded, rounded_sql
from weftline.session import table
from weftline.sources import files
from weftline.streaming import review


@query(
    """SELECT o_custkey AS oid, o_orderkey AS ord FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A')
      AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber >= 5)"""
)
def hosts_to_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as hosts; returned lines as plans, long orders as those that are rendered."""
    hosts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("oid"), "o_custkey")
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "oid")
    left = library.to_build(hosts, lines.filter("l_returnflag = 'A'"), lines.filter("l_linenumber >= 5"))
    return left.select(F.col("o_custkey").alias("oid"), F.col("oid").alias("ord"))


@query(
    f"""WITH {chains._EVENTS}, last AS (SELECT chain, k % 8 AS node, event_type, event_id, row_number() OVER (PARTITION BY chain, k % 8 ORDER BY turn DESC) AS r FROM ev)
    SELECT e.chain, e.turns, e.last_event, coalesce(n.live, 0) AS live FROM (SELECT chain, max(turn) AS turns, max_by(event_id, turn) AS last_event FROM ev GROUP BY chain) e
    LEFT JOIN (SELECT chain, count(*) AS live FROM last WHERE r = 1 AND event_type <> 'error' GROUP BY chain) n ON n.chain = e.chain"""
)
def chain_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chain folded to its end in one job: its turns, its last record, and how many nodes it has."""
    edits = chains.events(spark, sf_dir).withColumn("node", F.col("k") % 8)
    last = keyed.first_by(edits, ["chain", "node"], [F.desc("turn")])
    ends = edits.groupBy("chain").agg(F.max("turn").alias("turns"), F.max_by("event_id", "turn").alias("last_event"))
    live = last.groupBy("chain").agg(F.count_if(F.col("event_type") != "error").alias("live"))
    return ends.join(live, "chain")


@query(
    """SELECT c.l_orderkey AS chain, c.l_linenumber AS line, coalesce(string_agg(DISTINCT p.l_returnflag || '(t' || p.l_linenumber || ')', ',' ORDER BY p.l_returnflag || '(t' || p.l_linenumber || ')'), '') AS installed
    FROM lineitem c LEFT JOIN lineitem p ON p.l_orderkey = c.l_orderkey AND p.l_partkey % 5 = c.l_partkey % 5 AND p.l_suppkey % 3 = c.l_suppkey % 3 AND p.l_linestatus = 'F'
    GROUP BY c.l_orderkey, c.l_linenumber, c.l_partkey, c.l_suppkey, c.l_extendedprice"""
)
def installed_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as candidates, shipped lines of the order as placements of what they are."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("chain"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 5).alias("oid"), (F.col("l_suppkey") % 3).alias("pid"), "l_linestatus", "l_returnflag", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    placed = lines.filter("l_linestatus = 'F'").select("chain", "oid", "pid", F.col("l_returnflag").alias("slot"), F.col("line").alias("turn"))
    found = library.installed_on(lines.drop("l_linestatus", "l_returnflag").distinct(), placed)
    return found.select("chain", "line", F.array_join("installed", ",").alias("installed"))


_PATHS = "['/lib/a/' || doc_id, '/lib/a/../b/' || doc_id, '/lib/../etc/' || doc_id, 'a/./' || doc_id, '../' || doc_id, '/library/' || doc_id][doc_id % 6 + 1]"


@query(
    f"""WITH a AS (SELECT doc_id, {_PATHS} AS path, CASE WHEN doc_id % 7 = 0 THEN 'ff' ELSE upper(sha256(coalesce(text, ''))) END AS sha FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 6 IN (2, 4, 5) THEN 'outside' WHEN doc_id % 5 = 0 THEN 'missing' ELSE 'changed' END AS fault FROM a
    WHERE doc_id % 6 IN (2, 4, 5) OR doc_id % 5 = 0 OR doc_id % 7 = 0"""
)
def asset_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as assets of a library, some of them outside it, missing or changed."""
    docs, id_ = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    paths = F.array(*[F.concat(F.lit(p), id_) for p in ("/lib/a/", "/lib/a/../b/", "/lib/../etc/", "a/./", "../", "/library/")])
    content = F.coalesce("text", F.lit(""))
    named = docs.select("doc_id", paths[(F.col("doc_id") % 6).cast("int")].alias("path"), content.alias("content"))
    sha = F.when(F.col("doc_id") % 7 == 0, "ff").otherwise(F.upper(F.sha2("content", 256)))
    there = named.filter("doc_id % 5 <> 0").select("path", "content")
    return library.asset_faults(named.select(F.col("doc_id").alias("asset"), "path", sha.alias("sha256")), there, F.lit("/lib")).withColumnRenamed("asset", "doc_id")


@query(
    f"""SELECT event_type AS kind, count(*) AS parts, {rounded_sql('sum(value)', 2)} AS seconds, {rounded_sql('avg(value)', 2)} AS per_part FROM events GROUP BY ROLLUP (event_type)"""
)
def caption_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = library.throughput(table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("value").alias("seconds")))
    return told.select("kind", "parts", *[rounded(F.col(c), 2).alias(c) for c in ("seconds", "per_part")])


_JOBS = """jobs AS (SELECT l_orderkey * 10 + l_linenumber AS job, cast(l_orderkey % 1000 AS DOUBLE) AS ts, l_quantity AS q, l_discount AS d, l_tax AS t, l_returnflag AS f, l_linestatus AS s
  FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey))"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as jobs, one for each number of an order."""
    c = F.col
    lines = table(spark, sf_dir, "lineitem").withColumn("job", c("l_orderkey") * 10 + c("l_linenumber")).repartition("job")  # dealt once: all that follows is of a job
    one = keyed.first_by(lines, ["job", "l_orderkey", "l_linenumber"], [F.col("l_partkey"), F.col("l_suppkey")])
    return one.select("job", (c("l_orderkey") % 1000).cast("double").alias("ts"), *[c(f"l_{n}").alias(a) for n, a in (("quantity", "q"), ("discount", "d"), ("tax", "t"), ("returnflag", "f"), ("linestatus", "s"))])


@query(
    f"""WITH {_JOBS}, told AS (SELECT *, CASE WHEN q > 10 THEN ts + 4 * q END AS started, CASE WHEN d > 0.01 THEN ts + 4 * q + 1000 * t END AS done, CASE WHEN f = 'R' THEN 'broken' ELSE 'ok' END AS message FROM jobs),
    due AS (SELECT *, started IS NOT NULL AND started <= ts + 160 AS begun, CASE WHEN started IS NOT NULL AND started <= ts + 160 THEN started + 40 ELSE ts + 160 END AS last FROM told)
    SELECT job, CASE WHEN done <= last THEN CASE WHEN message = 'ok' THEN 'ok' ELSE 'failed' END WHEN begun THEN 'compute_timeout' ELSE 'queue_timeout' END AS outcome,
      CASE WHEN done <= last THEN {rounded_sql('done - ts')} END AS seconds FROM due"""
)
def job_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = jobs(spark, sf_dir)
    starts = told.filter("q > 10").select("job", F.expr("ts + 4 * q").alias("started"))
    receipts = told.filter("d > 0.01").select("job", F.expr("ts + 4 * q + 1000 * t").alias("done"), F.when(F.col("f") == "R", "broken").otherwise("ok").alias("message"))
    found = review.job_outcomes(told.select("job", "ts"), starts, receipts, budget=40)
    return found.withColumn("seconds", rounded(F.col("seconds")))


@query(
    f"""WITH {_JOBS}, ends AS (SELECT job, ts, CASE WHEN s = 'F' THEN ts WHEN d > 0.01 THEN ts + q END AS a, CASE WHEN t > 0.01 THEN ts + q + 100 END AS b, CASE WHEN f <> 'R' THEN ts + q + 300 END AS c FROM jobs)
    SELECT job, {rounded_sql('a - ts')} AS t_render, CASE WHEN a IS NOT NULL THEN {rounded_sql('b - a')} END AS t_restyle, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN {rounded_sql('c - b')} END AS t_texture,
      CASE WHEN a IS NULL THEN 'render' WHEN b IS NULL THEN 'restyle' WHEN c IS NULL THEN 'texture' END AS missing FROM ends"""
)
def retexture_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of three legs; shipped lines have their render already."""
    told = jobs(spark, sf_dir)
    legs = [("render", "d > 0.01", "ts + q"), ("restyle", "t > 0.01", "ts + q + 100"), ("texture", "f <> 'R'", "ts + q + 300")]
    rows = F.array(*[F.when(F.expr(there), F.struct(F.lit(leg).alias("leg"), F.expr(done).alias("done"))) for leg, there, done in legs])
    ends = told.select("job", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("job", "r.*")
    found = review.retexture_legs(told.select("job", "ts", (F.col("s") == "F").alias("rendered")), ends)
    return found.select("job", *[rounded(F.col(f"t_{leg}")).alias(f"t_{leg}") for leg in review.LEGS], "missing")


_PIECES = """pieces AS (SELECT l_orderkey AS chain, cast(l_linenumber AS BIGINT) AS piece, max(l_partkey) AS fp, max(l_quantity) AS x, max(l_discount) * 100 AS y, max(l_tax) * 100 AS z,
    max(l_suppkey) % 4 AS moved FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


@query(
    f"""WITH {_PIECES}, region AS (SELECT chain, list(piece) AS changed, min(x) AS x0, max(x) + 2 AS x1, min(y) AS y0, max(y) + 2 AS y1, min(z) AS z0, max(z) + 2 AS z1
      FROM pieces WHERE moved = 0 GROUP BY chain)
    SELECT p.chain, p.piece FROM pieces p JOIN region r ON r.chain = p.chain
    WHERE p.moved = 0 OR list_contains(r.changed, p.piece - 1) OR (p.x - 1 <= r.x1 AND r.x0 <= p.x + 2 AND p.y - 1 <= r.y1 AND r.y0 <= p.y + 2 AND p.z - 1 <= r.z1 AND r.z0 <= p.z + 2)"""
)
def stale_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as pieces, a quarter of them changed; each blocks the face of the next, and probes reach out by one."""
    one = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("chain"), F.col("l_linenumber").cast("long").alias("piece")).agg(
        F.max("l_partkey").alias("fp"), F.max("l_quantity").alias("x"), (F.max("l_discount") * 100).alias("y"), (F.max("l_tax") * 100).alias("z"), (F.max("l_suppkey") % 4).alias("moved")
    )
    box = lambda by: F.array(*[F.col(c) + by for c in "xyz"])
    before = one.select("chain", "piece", F.col("fp").alias("fingerprint"), box(0).alias("lo"), box(2).alias("hi"))
    after = one.select("chain", "piece", F.when(F.col("moved") == 0, -F.col("fp") - 1).otherwise(F.col("fp")).alias("fingerprint"), box(0).alias("lo"), box(2).alias("hi"))
    faces = one.select("chain", "piece", F.array(F.col("piece") - 1).alias("blockers"), box(-1).alias("lo"), box(2).alias("hi"))
    return review.stale_faces(faces, before, after)


_GROUPS = """groups AS (SELECT o_custkey AS oid, o_orderkey AS ord, l_returnflag AS slot, list_sort(list(l_partkey)) AS pids FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as divisions of customers: parts by the flag of their line."""
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    slots = both.groupBy(F.col("o_custkey").alias("oid"), F.col("o_orderkey").alias("ord"), F.col("l_returnflag").alias("slot")).agg(F.array_sort(F.collect_list(F.col("l_partkey").cast("string"))).alias("pids"))
    return slots.groupBy("oid", "ord").agg(F.map_from_entries(F.collect_list(F.struct("slot", "pids"))).alias("groups"))


@query(
    f"""WITH {_GROUPS}, first AS (SELECT oid, slot, min_by(pids, ord) AS pids FROM groups GROUP BY oid, slot)
    SELECT c.c_custkey AS oid, s.slot, coalesce(array_to_string(list_sort(list_transform(f.pids, lambda p: cast(p AS VARCHAR))), ','), s.slot) AS pids
    FROM customer c CROSS JOIN (VALUES ('A'), ('N'), ('R'), ('Q')) s(slot) LEFT JOIN first f ON f.oid = c.c_custkey AND f.slot = s.slot"""
)
def slot_divisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("oid"), F.explode(F.array(*map(F.lit, "ANRQ"))).alias("slot"))
    found = library.first_division_with_slot(manifest, registry(spark, sf_dir))
    return found.select("oid", "slot", F.array_join("pids", ",").alias("pids"))


@query("SELECT l_orderkey AS oid, count(DISTINCT l_linenumber) AS slots, min(cast(l_linenumber AS VARCHAR)) AS first FROM lineitem GROUP BY l_orderkey")
def registry_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start nodes registered as the slots of their host."""
    number = F.col("l_linenumber").cast("string")
    nodes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("oid"), F.concat(F.lit("slot_"), number).alias("node"), F.array(number).alias("pids")).distinct()
    made = library.registry_from_manifest(nodes).withColumn("keys", F.map_keys("groups"))
    return made.select("oid", F.size("keys").cast("long").alias("slots"), F.array_min("keys").alias("first"))


@query(
    """SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, CASE WHEN b.doc_id IS NOT NULL THEN 'labels' ELSE 'documents' END AS origin, coalesce(b.v, a.v) AS v
    FROM (SELECT doc_id, n_chars AS v FROM documents) a FULL JOIN (SELECT doc_id, max(cast(quality AS BIGINT)) AS v FROM labels GROUP BY doc_id) b ON a.doc_id = b.doc_id"""
)
def cache_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two caches as one; what the later one has wins."""
    old = table(spark, sf_dir, "documents").select("doc_id", F.lit("documents").alias("origin"), F.col("n_chars").alias("v"))
    new = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.lit("labels").alias("origin"), F.max(F.col("quality").cast("long")).alias("v"))
    return keyed.preferred_union([old, new], ["doc_id"])


@query("SELECT doc_id, 'A/' || substr(lang || doc_id, 1, 8) || '_s0' AS chain FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def remaining_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an interrupted run still has to do, by the names of its chains."""
    left = files.remaining(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return left.select("doc_id", files.chain_id(F.concat("lang", F.col("doc_id").cast("string"))).alias("chain"))


@query(
    """SELECT 'A/' || substr(cast(l_orderkey AS VARCHAR), 1, 8) || '_s0' AS chain, l_linenumber AS turn, cast(x.seq AS BIGINT) AS seq, 'add' AS op, CASE x.seq WHEN 0 THEN l_partkey ELSE l_suppkey END AS pid, l_returnflag AS name
    FROM lineitem CROSS JOIN (VALUES (0), (1)) x(seq)"""
)
def recipe_from_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as steps of a plan, each of two parts."""
    plan = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("oid"), F.col("l_linenumber").alias("step"), F.col("l_returnflag").alias("name"), F.array("l_partkey", "l_suppkey").alias("pids"))
    return recipe.edits_from_plan(plan).withColumn("seq", F.col("seq").cast("long"))


@query("SELECT user_id AS chain, count(*) FILTER (WHERE event_type <> 'error') AS done FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_type <> 'error') >= 0.8 * 12")
def kept_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "events").select(F.col("user_id").alias("chain"), (F.col("event_type") != "error").alias("ok"))
    return recipe.kept_chains(turns, wanted=12)


@query(
    """SELECT p_partkey, 'used' AS state FROM part WHERE p_size % 3 = 0
    UNION ALL SELECT l_partkey, 'new' FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R') WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size % 3 = 0)"""
)
def used_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a failed run used stays used: a keyed table that only grows."""
    old = table(spark, sf_dir, "part").filter("p_size % 3 = 0").select("p_partkey", F.lit("used").alias("state"))
    new = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"), F.lit("new").alias("state")).distinct()
    return keyed.appended(old, new, ["p_partkey"])


@query(
    f"""WITH fit AS ({admission_sql()}), ranks AS (SELECT doc_id AS id, n_chars % 10 AS rank, 7 AS n_boxes, [1.0 + n_chars % 9, 5.0, 2.0 + doc_id % 4] AS size FROM documents)
    SELECT f.id, r.rank, {rounded_sql("list_sort(size, 'DESC')[2] / list_sort(size, 'DESC')[1]")} AS sig1 FROM (SELECT id FROM fit WHERE src = 'd') f
    JOIN ranks r ON r.id = f.id AND r.rank < r.n_boxes WHERE EXISTS (SELECT 1 FROM labels WHERE doc_id = f.id) OR f.id % 3 = 0"""
)
def library_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions, ranks and boxes, and files as one query: documents as captions, of which those that are labelled, and every third, have a file."""
    docs = table(spark, sf_dir, "documents")
    caps = captions(spark, sf_dir).filter("src = 'd'").select(F.lit(0).alias("oid"), F.col("id").alias("pid"), "cap")
    zero = F.array(*[F.lit(0.0)] * 3)
    ranks = docs.select(
        F.lit(0).alias("oid"), F.col("doc_id").alias("pid"), (F.col("n_chars") % 10).alias("rank"), F.lit(7).alias("n_boxes"), zero.alias("lo"), F.array(1.0 + F.col("n_chars") % 9, F.lit(5.0), 2.0 + F.col("doc_id") % 4).alias("hi")
    )
    there = table(spark, sf_dir, "labels").select("doc_id").union(docs.filter("doc_id % 3 = 0").select("doc_id")).select(F.lit(0).alias("oid"), F.col("doc_id").alias("pid"))
    return library.admitted_parts(caps, ranks, there).select(F.col("pid").alias("id"), "rank", rounded(F.col("sig")[1]).alias("sig1"))


@query(
    """WITH log AS (SELECT user_id % 6 AS sig, event_id, cast(json_extract(props, '$.k') AS BIGINT) AS pid, CASE WHEN event_type IN ('click', 'view', 'signup') THEN 1 ELSE -1 END AS s FROM events),
    raw AS (SELECT *, sum(s) OVER (PARTITION BY sig ORDER BY event_id) AS raw FROM log),
    deep AS (SELECT *, raw - least(min(raw) OVER (PARTITION BY sig ORDER BY event_id), 0) AS depth FROM raw),
    low AS (SELECT *, min(depth) OVER (PARTITION BY sig ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS low FROM deep)
    SELECT u.user_id AS slot, l.event_id, l.pid FROM (SELECT DISTINCT user_id, user_id % 6 AS sig FROM events) u JOIN low l ON l.sig = u.sig WHERE l.s = 1 AND (l.low IS NULL OR l.low >= l.depth)"""
)
def veto_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vetoes of a signature's log stand for all slots that share the signature."""
    events = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("click", "view", "signup"), "veto").otherwise("unveto")
    log = events.select((F.col("user_id") % 6).alias("sig"), "event_id", F.get_json_object("props", "$.k").cast("long").alias("pid"), kind.alias("event"))
    slots = events.select(F.col("user_id").alias("slot"), (F.col("user_id") % 6).alias("sig")).distinct()
    return annotate.paired_in_blocks(annotate.standing_vetoes(log, ["sig"], "event_id").drop("event"), slots).select("slot", "event_id", "pid")
