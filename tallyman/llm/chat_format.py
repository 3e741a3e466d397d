"""Chat formatting of preference pairs.

A pair is a chosen and a rejected conversation. The turns at which both are equal, up to the first at which they differ,
are the prompt and are rendered once; the turns from there on are the two completions, in which the assistant's turns
are marked for the loss. The result has one row for each rendered turn, so that a conversation of any length never
has to fit one task; ordered by part and turn, its texts make up the sample.

Everything is made of built-in column functions. Equal turns meet in one aggregation; the first difference of each
pair is joined back by a join that survives pairs with a large share of all rows.

Definitions: repeated rows count once. A turn number with several different messages is one turn, equal on both sides if
it has the same messages on both. Null turn numbers come first, null roles are ``unknown``, null texts empty. The markers'
opening ``<|`` inside a text is set apart. Rows without a pair are left out. Equal conversations are all prompt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lookup_join

FIRST_TURN = -(2**63)


def rendered(role: Column, text: Column) -> Column:
    safe = F.replace(text, F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), safe, F.lit("<|end|>\n"))


def neighbours(conversations: DataFrame) -> DataFrame:
    """Conversations paired by id: an even id is chosen over the odd id that follows it."""
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"),
        (F.pmod("conv_id", F.lit(2)) == 0).alias("chosen"),
        "turn",
        "role",
        "text",
    )


def preference_samples(turns: DataFrame) -> DataFrame:
    """Rendered turns of all pairs that have both sides.

    ``turns`` has ``pair_id``, ``chosen`` (boolean), ``turn``, ``role`` and ``text``. Columns of the result: ``pair_id``,
    ``part`` (prompt, chosen or rejected), ``turn``, ``role``, ``rendered``, ``loss_mask``.
    """
    messages = (
        turns.filter(F.col("pair_id").isNotNull() & F.col("chosen").isNotNull())
        .groupBy(
            "pair_id",
            F.coalesce(F.col("turn").cast("long"), F.lit(FIRST_TURN)).alias("turn"),
            F.coalesce("role", F.lit("unknown")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        .agg(F.max("chosen").alias("in_chosen"), F.max(~F.col("chosen")).alias("in_rejected"))
    )
    differs = F.col("in_chosen") != F.col("in_rejected")
    pairs = messages.groupBy("pair_id").agg(
        F.min(F.when(differs, F.col("turn"))).alias("split_turn"),
        F.max("in_chosen").alias("has_chosen"),
        F.max("in_rejected").alias("has_rejected"),
        F.count("*").alias("n_rows"),
    )
    whole = pairs.filter("has_chosen AND has_rejected").select("pair_id", "split_turn", "n_rows")
    total = pairs.agg(F.sum("n_rows")).first()[0] or 1
    placed = lookup_join(messages, whole, "pair_id", total)
    shared = F.col("split_turn").isNull() | (F.col("turn") < F.col("split_turn"))
    parts = F.when(shared, F.array(F.lit("prompt"))).otherwise(
        F.array_compact(F.array(F.when(F.col("in_chosen"), F.lit("chosen")), F.when(F.col("in_rejected"), F.lit("rejected"))))
    )
    rows = placed.select("pair_id", F.explode(parts).alias("part"), "turn", "role", "text")
    mask = F.when((F.col("part") != "prompt") & (F.col("role") == "assistant"), 1).otherwise(0)
    return rows.select(
        "pair_id", "part", "turn", "role", rendered(F.col("role"), F.col("text")).alias("rendered"), mask.alias("loss_mask")
    )


ORACLE = """
WITH messages AS (
  SELECT conv_id // 2 AS pair_id, coalesce(turn, -9223372036854775808) AS turn, coalesce(role, 'unknown') AS role,
         coalesce(text, '') AS text, bool_or(conv_id % 2 = 0) AS in_chosen, bool_or(conv_id % 2 <> 0) AS in_rejected
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1, 2, 3, 4
), pairs AS (
  SELECT pair_id, min(turn) FILTER (in_chosen <> in_rejected) AS split_turn
  FROM messages GROUP BY 1 HAVING bool_or(in_chosen) AND bool_or(in_rejected)
), parts AS (
  SELECT m.*, 'prompt' AS part FROM messages m JOIN pairs p USING (pair_id) WHERE split_turn IS NULL OR turn < split_turn
  UNION ALL
  SELECT m.*, 'chosen' FROM messages m JOIN pairs p USING (pair_id) WHERE turn >= split_turn AND in_chosen
  UNION ALL
  SELECT m.*, 'rejected' FROM messages m JOIN pairs p USING (pair_id) WHERE turn >= split_turn AND in_rejected
)
SELECT pair_id, part, turn, role, '<|' || role || '|>' || chr(10) || replace(text, '<|', '< |') || '<|end|>' || chr(10) AS rendered,
       CASE WHEN part <> 'prompt' AND role = 'assistant' THEN 1 ELSE 0 END AS loss_mask
FROM parts
"""
