"""Retrieval queries: vectors as parts, ten to a source, with shapes by way of part rows. The slot is part 0, its queries are parts 1 to 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import shapes
from weftline.operators import retrieve
from weftline.plans.registry import query, rounded, rounded_sql
from weftline.session import table

#: Thresholds for the driver's vectors, which are unit and all but random.
FIXTURE = retrieve.Limits(floor=0.05, saturation=0.20, reject=0.25, duplicate=0.30)
QUERIES, REJECTS = (1, 2, 3), (4, 5)


def parts_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, oid, label, vec, name, sig, sym): vectors, each with the shape of a part row."""
    vectors, parts = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "part")
    many = F.broadcast(parts.agg(F.count("*").alias("many")))  # one row
    sizes = F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 50, 2.0 * F.length("p_name"))
    shaped = parts.select("p_partkey", F.col("p_name").alias("name"), shapes.shape_signature(sizes).alias("sig"), shapes.axisymmetry(sizes).alias("sym"))
    keyed = vectors.crossJoin(many).select(F.col("vec_id").alias("pid"), F.expr("vec_id div 10").alias("oid"), "label", F.col("embedding").alias("vec"), (F.col("vec_id") % F.col("many")).alias("p_partkey"))
    return keyed.join(shaped, "p_partkey").drop("p_partkey")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of other sources that pass the gates of the slot, with their similarity to its queries."""
    library = parts_library(spark, sf_dir)
    slot = F.broadcast(library.filter("pid = 0").select(F.col("sig").alias("slot_sig"), F.col("sym").alias("slot_sym")))  # one row
    open_ = retrieve.gated(library.filter("oid <> 0").crossJoin(slot), F.col("slot_sig"), F.col("slot_sym"), FIXTURE).drop("slot_sig", "slot_sym")
    asked = library.filter(F.col("pid").isin(*QUERIES)).select("vec")
    return retrieve.similarity(open_, asked, "s_acc")


_DOT = "list_sum(list_transform(range(1, 65), lambda i: cast(v.vec[i] AS DOUBLE) * cast({q}.vec[i] AS DOUBLE)))"
_LIBRARY = """library AS (
  SELECT vec_id AS pid, vec_id // 10 AS oid, label, embedding AS vec, name, [1.0, d[2] / d[1], d[3] / d[1]] AS sig, least(d[2], d[3]) / greatest(d[2], d[3], 1e-9) AS sym
  FROM embeddings JOIN (SELECT p_partkey, p_name AS name, list_sort([cast(p_size AS DOUBLE), p_retailprice / 50, 2.0 * length(p_name)], 'DESC') AS d FROM part)
    ON p_partkey = vec_id % (SELECT count(*) FROM part)
), gated AS (
  SELECT l.*, abs(l.sig[2] - s.sig[2]) + abs(l.sig[3] - s.sig[3]) AS d_sig, abs(l.sym - s.sym) AS d_sym
  FROM library l, (SELECT sig, sym FROM library WHERE pid = 0) s
  WHERE l.oid <> 0 AND abs(l.sig[2] - s.sig[2]) + abs(l.sig[3] - s.sig[3]) <= 0.6 AND abs(l.sym - s.sym) <= 0.4
)"""
_ACC = f"(SELECT max({_DOT.format(q='q')}) FROM library q WHERE q.pid IN (1, 2, 3))"
_REJ = f"(SELECT max({_DOT.format(q='q')}) FROM library q WHERE q.pid IN (4, 5))"
_SCORED = f"""WITH {_LIBRARY}, told AS (SELECT v.*, {_ACC} AS s_acc, {_REJ} AS s_rej FROM gated v
), scored AS (
  SELECT *, 10.0 * (least(s_acc, 0.20) + 0.25 * greatest(s_acc - 0.20, 0.0)) - 1.5 * d_sym - d_sig AS score FROM told WHERE s_acc >= 0.05
), firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY oid ORDER BY score DESC, pid) AS r FROM scored) WHERE r = 1
)"""


@query(f"{_SCORED} SELECT pid, oid, {rounded_sql('score')} AS score FROM firsts ORDER BY firsts.score DESC, pid LIMIT 8")
def retrieve_gated_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the best parts for a slot, one from a source. The limit is the feature."""
    best = retrieve.one_per_source(retrieve.scored(candidates(spark, sf_dir), FIXTURE))
    return best.orderBy(F.desc("score"), "pid").limit(FIXTURE.top).select("pid", "oid", rounded(F.col("score")).alias("score"))


@query(f"{_SCORED} SELECT pid, {rounded_sql('s_acc')} AS s_acc, {rounded_sql('s_rej')} AS s_rej, {rounded_sql('score')} AS score FROM scored WHERE s_rej < 0.25 AND s_acc > s_rej")
def retrieve_reject_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejects = parts_library(spark, sf_dir).filter(F.col("pid").isin(*REJECTS)).select("vec")
    both = retrieve.similarity(candidates(spark, sf_dir), rejects, "s_rej")
    kept = retrieve.scored(both, FIXTURE, rejects=True)
    return kept.select("pid", *[rounded(F.col(c)).alias(c) for c in ("s_acc", "s_rej", "score")])


@query(f"{_SCORED} SELECT oid, pid, {rounded_sql('score')} AS score FROM firsts")
def retrieve_one_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.one_per_source(retrieve.scored(candidates(spark, sf_dir), FIXTURE)).select("oid", "pid", rounded(F.col("score")).alias("score"))


@query(f"WITH {_LIBRARY} SELECT v.pid, {rounded_sql('max(' + _DOT.format(q='q') + ')')} AS s_acc FROM library v, library q WHERE q.pid % 50 = 0 GROUP BY v.pid")
def retrieve_many_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth part as a query against all, block by block."""
    library = parts_library(spark, sf_dir).select("pid", "vec")
    return retrieve.similarity_blocks(library, library.filter("pid % 50 = 0"), "s").select("pid", rounded(F.col("s")).alias("s_acc"))


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth part as a slot; the three after it ask, the two after these are rejected, and what is seven before or behind it is excluded."""
    library = parts_library(spark, sf_dir)
    own = library.filter("pid % 50 = 0").select(F.col("pid").alias("slot"), "oid", "sig", "sym")
    near = library.filter("pid % 50 between 1 and 5").select((F.col("pid") - F.col("pid") % 50).alias("slot"), (F.col("pid") % 50).alias("k"), F.col("vec").cast("array<double>").alias("vec"))
    vecs = near.groupBy("slot").agg(*[F.collect_list(F.when(F.col("k").isin(*ks), F.col("vec"))).alias(c) for c, ks in (("asked", (1, 2, 3)), ("rejected", (4, 5)))])
    told = own.join(vecs, "slot", "left")
    empty = F.expr("cast(array() as array<array<double>>)")
    return told.select("slot", "oid", "sig", "sym", F.coalesce("asked", empty).alias("asked"), F.coalesce("rejected", empty).alias("rejected"), F.array(F.col("slot") - 7, F.col("slot") + 57).alias("without"))


_SLOTS = f"""WITH {_LIBRARY.split("), gated AS")[0]}), met AS (
  SELECT s.pid AS slot, v.*, abs(v.sig[2] - s.sig[2]) + abs(v.sig[3] - s.sig[3]) AS d_sig, abs(v.sym - s.sym) AS d_sym
  FROM library s JOIN library v ON v.oid <> s.oid AND v.pid <> s.pid - 7 AND v.pid <> s.pid + 57 WHERE s.pid % 50 = 0
), told AS (
  SELECT v.slot, v.pid, v.oid, v.d_sig, v.d_sym, max({_DOT.format(q='q')}) FILTER (WHERE q.pid % 50 <= 3) AS s_acc, max({_DOT.format(q='q')}) FILTER (WHERE q.pid % 50 >= 4) AS s_rej
  FROM met v JOIN library q ON q.pid BETWEEN v.slot + 1 AND v.slot + 5 WHERE v.d_sig <= 0.6 AND v.d_sym <= 0.4 GROUP BY ALL
), scored AS (
  SELECT *, 10.0 * (least(s_acc, 0.20) + 0.25 * greatest(s_acc - 0.20, 0.0)) - 1.5 * d_sym - d_sig AS score FROM told WHERE s_acc >= 0.05
)"""


@query(
    f"""{_SLOTS}, firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slot, oid ORDER BY score DESC, pid) AS r FROM scored) WHERE r = 1)
    SELECT slot, pid, oid, {rounded_sql('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY score DESC, pid) AS place FROM firsts) WHERE place <= 8"""
)
def retrieve_slots_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best parts for every slot, one from a source, in one plan."""
    best = retrieve.for_slots(parts_library(spark, sf_dir), slots(spark, sf_dir), FIXTURE)
    return best.select("slot", "pid", "oid", rounded(F.col("score")).alias("score"))


@query(f"{_SLOTS} SELECT slot, pid, {rounded_sql('s_acc')} AS s_acc, {rounded_sql('s_rej')} AS s_rej, {rounded_sql('score')} AS score FROM scored WHERE s_rej < 0.25 AND s_acc > s_rej")
def retrieve_slots_reject_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = retrieve.for_slots(parts_library(spark, sf_dir), slots(spark, sf_dir), FIXTURE, rejects=True, top=False)
    return kept.select("slot", "pid", *[rounded(F.col(c)).alias(c) for c in ("s_acc", "s_rej", "score")])


_U = "(cast(('0x' || substr(md5('7:' || pid), 1, 8)) AS BIGINT) + 0.5) / 4294967296.0"


@query(f"{_SCORED} SELECT pid, {rounded_sql(f'score / 0.35 - ln(-ln({_U}))', 3)} AS draw FROM scored")
def retrieve_softmax_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = retrieve.softmax_order(retrieve.scored(candidates(spark, sf_dir), FIXTURE), F.col("pid").cast("string"), seed=7)
    return drawn.select("pid", rounded(F.col("draw"), 3).alias("draw"))


@query(
    f"""WITH {_LIBRARY}, worded AS (SELECT *, list_distinct(string_split(name, ' ')) AS kws FROM gated), hit AS (
      SELECT *, len(list_intersect(kws, ['small', 'ring', 'steel'])) AS hits FROM worded)
    SELECT pid, hits, {rounded_sql("6.0 * least(hits, 2) - 1.5 * d_sym - d_sig + 0.3 * len(list_intersect(kws, ['small', 'ring']))")} AS score FROM hit WHERE hits >= 1"""
)
def retrieve_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    worded = candidates(spark, sf_dir).withColumn("kws", F.array_distinct(F.split("name", " ")))
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    found = retrieve.lexical_score(worded, words("small", "ring", "steel"), words("small", "ring"))
    return found.select("pid", F.col("hits").cast("long").alias("hits"), rounded(F.col("score")).alias("score"))


@query(f"SELECT label, pid FROM (SELECT label, pid, row_number() OVER (PARTITION BY label ORDER BY {_U}, pid) AS r FROM (SELECT label, vec_id AS pid FROM embeddings WHERE vec_id // 10 <> 0)) WHERE r <= 5")
def retrieve_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five of each label's pool, in seeded order."""
    from pyspark.sql import Window

    pool = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("pid")).filter("pid div 10 <> 0")
    drawn = retrieve.pool_order(pool, F.col("pid").cast("string"), seed=7)
    ranked = drawn.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("draw", "pid")))
    return ranked.filter("r <= 5").select("label", "pid")


@query()
def retrieve_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best of each label, unlike each other."""
    picks = retrieve.diversified(retrieve.scored(candidates(spark, sf_dir), FIXTURE), ["label"], FIXTURE)
    return picks.select("label", "pick", "pid", "oid", rounded(F.col("score")).alias("score"))
