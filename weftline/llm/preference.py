"""Chat formatting for preference training, in DataFrame expressions alone.

A pair is two conversations, one chosen and one rejected. Their longest common prefix of turns is rendered once, as the prompt;
what each has beyond it is rendered as its completion, with a mask of the character ranges that a model is to learn: what
assistants say, with the mark that ends their turn. A turn is rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``.

Turns count in the order of their number; those that repeat a number, in the order of role and text. Turns are equal when role
and text are. A null role renders as user, a null text as empty; both stay different from the real ones in comparing turns. Turns without a conversation id
belong to no conversation and are left out. A conversation without a partner keeps its row: all of it is completion, and
paired is false. All turns of a conversation meet in its row, as they must in the text that the row holds. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import running

START, END = "<|im_start|>", "<|im_end|>\n"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(turn["role"], F.lit("user")), F.lit("\n"))


def _said(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(END))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _said(t))), "")


def learned(turns: Column) -> Column:
    """start:end of each assistant turn in the rendered turns, comma-joined; code points, end exclusive."""

    def step(at: Column, t: Column) -> tuple[Column, Column]:
        start = at + F.length(_head(t))
        end = start + F.length(_said(t))
        return end, F.when(t["role"] == "assistant", F.concat_ws(":", start.cast("string"), end.cast("string")))

    return F.array_join(running(turns, F.lit(0).cast("long"), "string", step), ",")  # which leaves out nulls


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    same = F.zip_with(a, b, lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def format_preferences(turns: DataFrame, pair: Column, is_chosen: Column) -> DataFrame:
    """A row for each pair of turns (conv_id, turn, role, text): pair_id, chosen_id, rejected_id, paired, n_prompt_turns, prompt, and
    text, mask and number of turns of both completions. pair and is_chosen tell a turn's pair and side by its conversation.
    """
    told = turns.filter(F.col("conv_id").isNotNull()).select(
        pair.alias("pair_id"), is_chosen.alias("side"), F.col("conv_id").alias("conv_id"), F.struct("turn", "role", "text").alias("said")
    )
    sides = told.groupBy("pair_id").agg(
        F.max(F.when(F.col("side"), F.col("conv_id"))).alias("chosen_id"),
        F.max(F.when(~F.col("side"), F.col("conv_id"))).alias("rejected_id"),
        F.array_sort(F.collect_list(F.when(F.col("side"), F.col("said")))).alias("c"),
        F.array_sort(F.collect_list(F.when(~F.col("side"), F.col("said")))).alias("r"),
    )
    cut = sides.withColumn("n", common_turns(F.col("c"), F.col("r")))
    for side in "cr":
        cut = cut.withColumn(f"{side}_rest", F.slice(side, F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0))))
    return cut.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        (F.col("chosen_id").isNotNull() & F.col("rejected_id").isNotNull()).alias("paired"),
        F.col("n").cast("long").alias("n_prompt_turns"),
        rendered(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
        rendered(F.col("c_rest")).alias("chosen"),
        learned(F.col("c_rest")).alias("chosen_mask"),
        F.size("c_rest").cast("long").alias("n_chosen_turns"),
        rendered(F.col("r_rest")).alias("rejected"),
        learned(F.col("r_rest")).alias("rejected_mask"),
        F.size("r_rest").cast("long").alias("n_rejected_turns"),
    )


def neighbours(turns: DataFrame) -> DataFrame:
    """Pairs conversation 2k, as the chosen one, with 2k + 1: the table names no preferences of its own."""
    return format_preferences(turns, F.shiftright(F.col("conv_id").cast("long"), 1), F.col("conv_id") % 2 == 0)


def _oracle_side(side: str) -> str:
    head = "'<|im_start|>' || coalesce(t.role, 'user') || chr(10)"
    said = "coalesce(t.text, '') || '<|im_end|>' || chr(10)"
    return f"""
  list_transform({side}, lambda t: {head} || {said}) AS {side}_text,
  list_transform({side}, lambda t: length({head})) AS {side}_head,
  list_transform({side}, lambda t: length({head} || {said})) AS {side}_size"""


def _oracle_mask(side: str) -> str:
    return f"""array_to_string(list_transform(list_filter(range(n + 1, len({side}) + 1), lambda i: coalesce({side}[i].role, '') = 'assistant'),
    lambda i: cast(coalesce(list_sum({side}_size[n + 1:i - 1]), 0) + {side}_head[i] AS BIGINT) || ':' || cast(list_sum({side}_size[n + 1:i]) AS BIGINT)), ',')"""


ORACLE_SQL = f"""
WITH told AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS side, conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
), sides AS (
  SELECT pair_id, max(conv_id) FILTER (WHERE side) AS chosen_id, max(conv_id) FILTER (WHERE NOT side) AS rejected_id,
         coalesce(list({{'role': role, 'text': text}} ORDER BY turn, role, text) FILTER (WHERE side), []) AS c,
         coalesce(list({{'role': role, 'text': text}} ORDER BY turn, role, text) FILTER (WHERE NOT side), []) AS r
  FROM told GROUP BY pair_id
), prefix AS (
  SELECT *, coalesce(list_min(list_filter(range(1, greatest(len(c), len(r)) + 1),
           lambda i: i > len(c) OR i > len(r) OR c[i].role IS DISTINCT FROM r[i].role OR c[i].text IS DISTINCT FROM r[i].text)) - 1, len(c)) AS n
  FROM sides
), shown AS (
  SELECT *, {_oracle_side("c")}, {_oracle_side("r")} FROM prefix
)
SELECT pair_id, chosen_id, rejected_id, chosen_id IS NOT NULL AND rejected_id IS NOT NULL AS paired, cast(n AS BIGINT) AS n_prompt_turns,
       array_to_string(c_text[1:n], '') AS prompt,
       array_to_string(c_text[n + 1:], '') AS chosen, {_oracle_mask("c")} AS chosen_mask, cast(len(c) - n AS BIGINT) AS n_chosen_turns,
       array_to_string(r_text[n + 1:], '') AS rejected, {_oracle_mask("r")} AS rejected_mask, cast(len(r) - n AS BIGINT) AS n_rejected_turns
FROM shown
"""
