"""Queries of edit chains: folds, verification, provenance, gates and slots, with users or conversations as chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import shapes, text
from weftline.operators import gates, recipe
from weftline.plans.registry import query, rounded, rounded_sql
from weftline.session import table

_EVENTS = """ev AS (SELECT user_id AS chain, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, event_id, event_type,
  cast(json_extract(props, '$.k') AS INT) AS k, value FROM events)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as turns of their user's chain; k is the number in their properties."""
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("chain"), turn.cast("long").alias("turn"), "event_id", "event_type", k.alias("k"), "value")


@query(
    f"""WITH {_EVENTS}, w AS (SELECT chain, turn, k % 8 AS node, CASE WHEN event_type <> 'error' THEN event_id END AS version FROM ev),
    lives AS (SELECT *, lead(turn) OVER (PARTITION BY chain, node ORDER BY turn) AS until FROM w)
    SELECT t.chain, t.turn, l.node, l.version FROM (SELECT DISTINCT chain, turn FROM w) t JOIN lives l
      ON l.chain = t.chain AND l.turn <= t.turn AND (l.until IS NULL OR t.turn < l.until) WHERE l.version IS NOT NULL"""
)
def edit_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of eight nodes after every turn; errors take a node away."""
    edits = events(spark, sf_dir).select("chain", "turn", (F.col("k") % 8).alias("node"), F.lit(0).alias("seq"), F.when(F.col("event_type") != "error", F.col("event_id")).alias("version"))
    return recipe.state_fold(edits)


@query("SELECT conv_id, turn // 2 AS pair, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn // 2 ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1")
def edit_last_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.expr("turn div 2").alias("pair"), "turn", "role")
    return recipe.last_records(turns, ["conv_id"], "pair", "turn")


@query(
    """WITH n AS (SELECT conv_id, turn, role || ':' || length(text) AS added FROM conversations)
    SELECT conv_id, turn, coalesce(string_agg(added, ',') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS already_present FROM n"""
)
def running_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = F.array(F.concat_ws(":", "role", F.length("text").cast("string")))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", added.alias("added"))
    return recipe.running_present(turns, ["conv_id"], "turn", "added").select("conv_id", "turn", F.array_join("already_present", ",").alias("already_present"))


@query(
    """WITH a AS (SELECT l_orderkey AS k, count(*) AS nv, max(l_linestatus) AS bc, sum(l_extendedprice) AS vs FROM lineitem GROUP BY l_orderkey),
    b AS (SELECT o_orderkey AS k, 4 AS nv, o_orderstatus AS bc, o_totalprice AS vs FROM orders WHERE o_orderkey % 7 <> 0)
    SELECT k, reason FROM (SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'extra' WHEN b.k IS NULL THEN 'missing' WHEN a.nv IS DISTINCT FROM b.nv THEN 'nv'
      WHEN a.bc IS DISTINCT FROM b.bc THEN 'bc' WHEN abs(a.vs - b.vs) > 1000 THEN 'vs' END AS reason FROM a FULL JOIN b ON a.k = b.k) WHERE reason IS NOT NULL"""
)
def state_verify_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rebuilt states (sums of lines) against golden ones (orders)."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("nv"), F.max("l_linestatus").alias("bc"), F.sum("l_extendedprice").alias("vs"))
    golden = table(spark, sf_dir, "orders").filter("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("k"), F.lit(4).cast("long").alias("nv"), F.col("o_orderstatus").alias("bc"), F.col("o_totalprice").alias("vs"))
    return recipe.state_diff(lines, golden, ["k"], ["nv", "bc"], {"vs": 1000.0})


@query(
    """WITH g AS (SELECT l_orderkey AS chain, l_suppkey AS asset, min_by(CASE WHEN l_linenumber = 1 THEN 'host' ELSE 'donor' END, l_linenumber) AS role,
      array_to_string(list(l_linenumber ORDER BY l_linenumber), ',') AS turns, array_to_string(list(DISTINCT l_partkey ORDER BY l_partkey), ',') AS parts
      FROM (SELECT * FROM lineitem) GROUP BY l_orderkey, l_suppkey)
    SELECT chain, asset, role, turns, parts, row_number() OVER (PARTITION BY chain ORDER BY CASE WHEN role = 'host' THEN 0 ELSE 1 END, asset) AS place FROM g"""
)
def provenance_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as the assets of orders."""
    uses = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("chain"), F.col("l_suppkey").alias("asset"), F.when(F.col("l_linenumber") == 1, "host").otherwise("donor").alias("role"),
        F.col("l_linenumber").alias("turn"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("ord"),
    )
    rows = recipe.provenance(uses)
    joined = [F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(c) for c in ("turns", "parts")]
    return rows.select("chain", "asset", "role", *joined, F.col("place").cast("long").alias("place"))


@query(f"SELECT vec_id, cast(len(embedding) AS BIGINT) AS nv, {rounded_sql('list_sum(list_transform(embedding, lambda x: abs(cast(x AS DOUBLE))))', 3)} AS vs FROM embeddings")
def node_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "embeddings").select("vec_id", shapes.checksum(F.col("embedding"), 12).alias("c"))
    return sums.select("vec_id", F.col("c.nv").cast("long").alias("nv"), rounded(F.col("c.vs"), 3).alias("vs"))


@query(
    """WITH m AS (SELECT o_orderkey AS oid, o_custkey % 9 + 1 AS n FROM orders),
    steps AS (SELECT l_orderkey AS oid, l_returnflag AS step, l_linenumber AS pid FROM lineitem),
    parts AS (SELECT oid, unnest(range(1, n + 1)) AS pid FROM m), c AS (SELECT oid, pid, count(*) AS n FROM steps GROUP BY oid, pid)
    SELECT oid, 'missing' AS fault, pid FROM parts p WHERE oid IN (SELECT oid FROM steps) AND NOT EXISTS (SELECT 1 FROM c WHERE c.oid = p.oid AND c.pid = p.pid)
    UNION ALL SELECT oid, 'unknown', pid FROM c WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE c.oid = p.oid AND c.pid = p.pid)
    UNION ALL SELECT oid, 'duplicated', pid FROM c WHERE n > 1
    UNION ALL SELECT oid, 'short', NULL FROM steps GROUP BY oid HAVING count(DISTINCT step) < 2"""
)
def plan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as parts of plans, return flags as steps; how many parts a host has follows from its customer."""
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("oid"), F.col("l_returnflag").alias("step"), F.col("l_linenumber").cast("long").alias("pid"))
    parts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("oid"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("o_custkey") % 9 + 1)).alias("pid"))
    return recipe.plan_faults(steps, parts)


_MEASURES = """m AS (SELECT l_orderkey AS oid, l_linenumber AS n, l_partkey * 100000 AS bytes, l_suppkey * 5000 AS faces, l_tax / 3 AS debris,
  CASE WHEN l_returnflag = 'A' THEN 'skip' ELSE 'fit' END AS verdict, l_linestatus = 'O' AS contact, l_quantity / 10 AS scale, l_partkey % 5 <> 0 AS snapped,
  l_discount / 6 AS gap, CASE WHEN l_suppkey % 3 = 0 THEN 0.005 END AS virtual_gap, l_quantity / 15 AS ratio, l_partkey % 7 <> 0 AS connected FROM lineitem),
  told AS (SELECT *, CASE WHEN bytes > 125829120 THEN 'GLB limit' WHEN faces > 400000 THEN 'face count limit' WHEN debris > 0.02 THEN 'has debris' WHEN verdict = 'skip' THEN 'pre-judge skip'
  WHEN NOT contact THEN 'no contact surface' WHEN scale <= 0.2501 OR scale >= 3.999 THEN 'scale at boundary' WHEN virtual_gap IS NULL AND NOT snapped THEN 'snap refused'
  WHEN gap > 0.01 + coalesce(virtual_gap, 0.0) THEN 'gap' WHEN ratio > 2.5 THEN 'too large' WHEN NOT connected THEN 'disassembles' END AS reason FROM m)"""


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as candidates of their order, in order of their number, with stand-ins for what is measured."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("oid"), c("l_linenumber").alias("n"), (c("l_partkey") * 100000).alias("bytes"), (c("l_suppkey") * 5000).alias("faces"), (c("l_tax") / 3).alias("debris"),
        F.when(c("l_returnflag") == "A", "skip").otherwise("fit").alias("verdict"), (c("l_linestatus") == "O").alias("contact"), (c("l_quantity") / 10).alias("scale"),
        (c("l_partkey") % 5 != 0).alias("snapped"), (c("l_discount") / 6).alias("gap"), F.when(c("l_suppkey") % 3 == 0, 0.005).alias("virtual_gap"),
        (c("l_quantity") / 15).alias("ratio"), (c("l_partkey") % 7 != 0).alias("connected"),
    )


@query(f"WITH {_MEASURES} SELECT coalesce(reason, 'placed') AS reason, count(*) AS n FROM told GROUP BY 1")
def gate_cascade_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = measures(spark, sf_dir).withColumn("reason", F.coalesce(gates.gate_reason(), F.lit("placed")))
    return told.groupBy("reason").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_MEASURES} SELECT oid, n, refused FROM (SELECT oid, n, reason, count(reason) OVER (PARTITION BY oid ORDER BY n) AS refused,
      row_number() OVER (PARTITION BY oid ORDER BY CASE WHEN reason IS NULL THEN 0 ELSE 1 END, n) AS r FROM told) WHERE r = 1 AND reason IS NULL"""
)
def gate_first_survivor(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = measures(spark, sf_dir).withColumn("reason", gates.gate_reason())
    return gates.first_survivor(told, ["oid"], "n").select("oid", "n", "refused")


@query(
    """WITH p AS (SELECT user_id AS chain, event_type AS slot, max(event_id) AS last FROM events GROUP BY 1, 2), s AS (
      SELECT chain, slot, dense_rank() OVER (PARTITION BY chain ORDER BY last) AS last FROM p)
    SELECT chain, slot, last FROM (SELECT *, min(last) OVER (PARTITION BY chain) AS least FROM s) WHERE last <= least + 1"""
)
def lru_slot_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as the slots of a user's chain."""
    used = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("chain"), F.col("event_type").alias("slot")).agg(F.max("event_id").alias("last"))
    ranked = used.withColumn("last", F.dense_rank().over(Window.partitionBy("chain").orderBy("last")).cast("long"))
    return gates.least_recent(ranked, ["chain"], "last")


@query(
    f"""WITH {_EVENTS}, o AS (SELECT chain, k % 4 AS slot, turn, CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'fail' ELSE 'skip' END AS outcome FROM ev),
    m AS (SELECT *, sum(CASE WHEN outcome = 'ok' THEN 1 ELSE 0 END) OVER w AS a, sum(CASE WHEN outcome <> 'skip' THEN 1 ELSE 0 END) OVER w AS b FROM o WINDOW w AS (PARTITION BY chain, slot ORDER BY turn)),
    c AS (SELECT *, sum(CASE WHEN outcome = 'fail' THEN 1 ELSE 0 END) OVER (PARTITION BY chain, slot, a ORDER BY turn) AS dead,
      sum(CASE WHEN outcome = 'skip' THEN 1 ELSE 0 END) OVER (PARTITION BY chain, slot, b ORDER BY turn) AS skipped FROM m)
    SELECT chain, slot, min(turn) AS retired_at FROM c WHERE dead >= 3 OR skipped >= 5 GROUP BY chain, slot"""
)
def retire_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    outcome = F.when(kind == "purchase", "ok").when(kind.isin("error", "signup"), "fail").otherwise("skip")
    batches = events(spark, sf_dir).select("chain", (F.col("k") % 4).alias("slot"), "turn", outcome.alias("outcome"))
    return gates.retired(batches, ["chain", "slot"], "turn")


@query(
    f"""WITH {_EVENTS}, a AS (SELECT event_id, chain, k % 5 AS turn, CASE event_type WHEN 'error' THEN 'add' WHEN 'signup' THEN 'remove' ELSE 'replace' END AS op,
      CASE WHEN event_type <> 'view' OR k % 3 > 0 THEN value / 100 END AS metric FROM ev),
    n AS (SELECT *, sum(CASE WHEN metric < 0.1 AND op = 'replace' THEN 1 ELSE 0 END) OVER (PARTITION BY chain, turn ORDER BY event_id) AS nth FROM a)
    SELECT event_id, CASE WHEN metric IS NULL THEN 'unmeasured' WHEN metric < 0.1 AND op <> 'replace' THEN 'flag' WHEN metric < 0.1 AND nth <= 5 THEN 'veto' WHEN metric < 0.1 THEN 'review'
      WHEN metric < 0.3 THEN 'faint' ELSE 'visible' END AS action FROM n"""
)
def visibility_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    tried = events(spark, sf_dir).select(
        "event_id", "chain", (F.col("k") % 5).alias("turn"), F.when(kind == "error", "add").when(kind == "signup", "remove").otherwise("replace").alias("op"),
        F.when((kind != "view") | (F.col("k") % 3 > 0), F.col("value") / 100).alias("metric"),
    )
    return gates.visibility_action(tried, ["chain", "turn"], "event_id").select("event_id", "action")


@query(
    f"""WITH {_EVENTS} SELECT chain, turn, CASE event_type WHEN 'click' THEN 'Add a ring to the top.' WHEN 'error' THEN 'Remove the part ' || k || '.'
      WHEN 'view' THEN 'Change the material of the part ' || k || ' to a ring.' ELSE 'Replace the part ' || k || ' with a ring.' END AS instruction FROM ev"""
)
def edit_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    op = F.when(kind == "click", "add").when(kind == "error", "remove").when(kind == "view", "retexture").otherwise("replace")
    old = F.concat(F.lit("the part "), F.col("k").cast("string"))
    return events(spark, sf_dir).select("chain", "turn", text.edit_sentence(op, old, F.lit("a ring"), F.lit("the top")).alias("instruction"))


@query(f"WITH {_EVENTS} SELECT chain, turn, ['body', 'head', 'tail'][turn % 3 + 1] AS slot FROM ev")
def cycled_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = F.array(*[F.lit(s) for s in ("body", "head", "tail")])
    return events(spark, sf_dir).select("chain", "turn", recipe.cycle_slot(slots, F.col("turn")).alias("slot"))
