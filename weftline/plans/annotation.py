"""Queries of instructions and reviews, with turns of conversations as instructions and events as a reviewer's log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import annotate
from weftline.plans.registry import query
from weftline.session import table

_TURNS = """turns AS (SELECT doc_id, n_chars, 'the ' || CASE doc_id % 3 WHEN 0 THEN 'left ' WHEN 1 THEN 'right ' ELSE '' END || coalesce(text, '') AS text,
  ['+z', '-z', '+x', '-x'][doc_id % 4 + 1] AS front, (n_chars % 21 - 10) / 20.0 AS x, (n_chars % 17 - 8) / 16.0 AS z FROM documents)"""
_AUDIT = f"""{_TURNS}, told AS (SELECT *, regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])left($|[^A-Za-z0-9_])') AS l, regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])right($|[^A-Za-z0-9_])') AS r,
  CASE front WHEN '+z' THEN x WHEN '-z' THEN -x WHEN '+x' THEN -z ELSE z END AS c FROM turns),
  audited AS (SELECT *, CASE WHEN l AND NOT r THEN 'left' WHEN r AND NOT l THEN 'right' END AS says, CASE WHEN c > 0.04 THEN 'left' WHEN c < -0.04 THEN 'right' END AS lies FROM told)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as instructions that name a side, with a front and one added part whose place follows from their length."""
    c = F.col
    side = F.when(c("doc_id") % 3 == 0, "left ").when(c("doc_id") % 3 == 1, "right ").otherwise("")
    fronts = F.array(*[F.lit(f) for f in ("+z", "-z", "+x", "-x")])
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("the "), side, F.coalesce("text", F.lit(""))).alias("text"),
        fronts[(c("doc_id") % 4).cast("int")].alias("front"),
        F.array((c("n_chars") % 21 - 10) / 20.0).alias("xs"),
        F.array((c("n_chars") % 17 - 8) / 16.0).alias("zs"),
    )


@query(f"WITH {_AUDIT} SELECT doc_id, says, lies, CASE WHEN says <> lies THEN 'wrong' WHEN says = lies THEN 'right' ELSE 'none' END AS verdict FROM audited")
def lr_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("wrong"), "wrong").when(~F.col("wrong"), "right").otherwise("none")
    return annotate.side_audit(turns(spark, sf_dir)).select("doc_id", "says", "lies", verdict.alias("verdict"))


@query(
    f"""WITH {_AUDIT} SELECT doc_id, fixed, sha256(CASE WHEN fixed THEN replace(replace(replace(replace(t1, chr(1), 'right'), chr(2), 'left'), chr(3), 'Right'), chr(4), 'Left') ELSE text END) AS text FROM (
      SELECT *, coalesce(says <> lies, false) AND doc_id % 5 <> 0 AS fixed,
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\bleft\\b', chr(1), 'g'), '\\bright\\b', chr(2), 'g'), '\\bLeft\\b', chr(3), 'g'), '\\bRight\\b', chr(4), 'g') AS t1 FROM audited)"""
)
def lr_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth chain has fronts that disagree, and is left as it is."""
    fixed = annotate.side_fix(annotate.side_audit(turns(spark, sf_dir)), F.col("doc_id") % 5 != 0)
    return fixed.select("doc_id", "fixed", F.sha2("text", 256).alias("text"))


@query(f"WITH {_AUDIT} SELECT front AS version, count(*) FILTER (WHERE says IS NOT NULL AND lies IS NOT NULL) AS checked, count(*) FILTER (WHERE says <> lies) AS wrong FROM audited GROUP BY front")
def lr_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.audit_totals(annotate.side_audit(turns(spark, sf_dir)), "front").withColumnRenamed("front", "version")


_SAID = """said AS (SELECT user_id, event_id, CASE cast(json_extract(props, '$.k') AS INT) % 6 WHEN 0 THEN 'It faces the +z axis' WHEN 1 THEN 'pointing toward negative x' WHEN 2 THEN 'no intrinsic front, +x'
  WHEN 3 THEN 'Towards the direction of the minus Z-axis' WHEN 4 THEN 'front is -x here' ELSE 'unknown' END AS s FROM events)"""


@query(
    f"""WITH {_SAID} SELECT event_id, CASE cast(json_extract(props, '$.k') AS INT) % 6 WHEN 0 THEN '+z' WHEN 1 THEN '-x' WHEN 3 THEN '-z' WHEN 4 THEN '-x' END AS front FROM events"""
)
def front_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.array(*[F.lit(s) for s in ("It faces the +z axis", "pointing toward negative x", "no intrinsic front, +x", "Towards the direction of the minus Z-axis", "front is -x here", "unknown")])
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("event_id", text.front_axis(said[k % 6]).alias("front"))


@query(
    """SELECT c.conv_id, c.turn, coalesce(d.text, f.text, c.text) AS instruction FROM conversations c
    LEFT JOIN (SELECT conv_id, turn, 'final ' || role AS text FROM conversations WHERE turn % 2 = 0) f ON f.conv_id = c.conv_id AND f.turn = c.turn
    LEFT JOIN (SELECT conv_id, turn, 'decided ' || role AS text FROM conversations WHERE turn % 3 = 0) d ON d.conv_id = c.conv_id AND d.turn = c.turn"""
)
def apply_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations")
    final = said.filter("turn % 2 = 0").select("conv_id", "turn", F.concat(F.lit("final "), "role").alias("text"))
    decided = said.filter("turn % 3 = 0").select("conv_id", "turn", F.concat(F.lit("decided "), "role").alias("text"))
    edits = said.select("conv_id", "turn", F.col("text").alias("instruction"))
    return annotate.with_decisions(edits, final, decided, ["conv_id", "turn"])


_K = "cast(json_extract(props, '$.k') AS INT)"


@query(
    f"""WITH first AS (SELECT user_id % 10 AS sig, {_K} AS pid, min_by(event_type, event_id) AS e FROM events GROUP BY 1, 2),
    v AS (SELECT sig, pid, CASE WHEN e = 'error' THEN 'skip' ELSE 'fit' END AS verb, CASE e WHEN 'error' THEN 'why' WHEN 'click' THEN 'top' ELSE 'bottom' END AS arg FROM first)
    SELECT s.slot, v.pid, v.verb, v.arg FROM (SELECT DISTINCT user_id AS slot, user_id % 10 AS sig FROM events) s JOIN v ON v.sig = s.sig"""
)
def verdict_memo_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as slots, ten signatures among them; the first event on a number is the verdict."""
    log = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).alias("sig"), F.get_json_object("props", "$.k").cast("int").alias("pid"), "event_id", F.when(F.col("event_type") != "error", "fit").alias("verb"),
        F.when(F.col("event_type") == "error", "why").when(F.col("event_type") == "click", "top").when(F.col("event_type") == "view", "odd").alias("arg"),
    )
    verdicts = annotate.first_verdicts(log, ["sig", "pid"], "event_id")
    slots = table(spark, sf_dir, "events").select(F.col("user_id").alias("slot"), (F.col("user_id") % 10).alias("sig")).distinct()
    return annotate.paired(verdicts, slots).select("slot", "pid", "verb", "arg")


@query(
    """WITH log AS (SELECT user_id, event_id, CASE WHEN event_type IN ('click', 'view', 'signup') THEN 1 ELSE -1 END AS s FROM events),
    raw AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id) AS raw FROM log),
    deep AS (SELECT *, raw - least(min(raw) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS depth FROM raw)
    SELECT user_id, event_id FROM deep d WHERE s = 1 AND NOT EXISTS (SELECT 1 FROM deep e WHERE e.user_id = d.user_id AND e.event_id > d.event_id AND e.depth < d.depth)"""
)
def veto_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and purchases take vetoes back, other events make one."""
    kind = F.when(F.col("event_type").isin("click", "view", "signup"), "veto").otherwise("unveto")
    log = table(spark, sf_dir, "events").select("user_id", "event_id", kind.alias("event"))
    return annotate.standing_vetoes(log, ["user_id"], "event_id").select("user_id", "event_id")


@query(
    f"""SELECT event_id, CASE {_K} % 5 WHEN 0 THEN 'add' WHEN 1 THEN 'remove' WHEN 2 THEN 'retexture' WHEN 3 THEN 'replace' END AS kind,
      CASE WHEN {_K} % 5 IN (1, 2) THEN 'slot_' || user_id END AS slot, CASE WHEN {_K} % 5 = 0 THEN cast(user_id AS INT) END AS face,
      CASE {_K} % 5 WHEN 0 THEN 'a red hat' WHEN 2 THEN 'brass' END AS query, CASE WHEN {_K} % 5 = 0 THEN 0.75 END AS size FROM events"""
)
def command_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, user = F.get_json_object("props", "$.k").cast("int") % 5, F.col("user_id").cast("string")
    line = (
        F.when(k == 0, F.concat(F.lit("add #"), user, F.lit(' "a red hat" size=0.75')))
        .when(k == 1, F.concat(F.lit("remove slot_"), user))
        .when(k == 2, F.concat(F.lit("Retexture slot_"), user, F.lit(" brass")))
        .when(k == 3, F.lit("replace"))
        .otherwise(F.lit("add nothing"))
    )
    told = table(spark, sf_dir, "events").select("event_id", annotate.parsed_command(line).alias("c"))
    return told.select("event_id", "c.kind", "c.slot", "c.face", "c.query", F.col("c.size").cast("double").alias("size"))
