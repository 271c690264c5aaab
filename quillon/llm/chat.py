"""Chat formatting by cumulative-snapshot collapse, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

#: The marks of a turn.
OPEN, CLOSE, MARK, BROKEN_MARK = "<|im_start|>", "<|im_end|>", "<|im_", "<| im_"


def _plain(c: str) -> Column:
    """The text with the marks of the format broken, so that no turn can close itself or open another."""
    return F.replace(F.coalesce(F.col(c), F.lit("")), F.lit(MARK), F.lit(BROKEN_MARK))


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), text (the turn as rendered), p1 and p2 (of turns 1 to pos), last.

    p1 and p2 are running xors of two hashes of (place, turn): two conversations have the same at a place if they
    have the same turns so far. Turns are in order of turn, then role and text, so ties and repeated rows have one order.
    """
    rows = turns.select("conv_id", "turn", _plain("role").alias("role"), _plain("text").alias("said"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "said")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("pos", F.row_number().over(order))
    rows = rows.withColumn("a", F.xxhash64("pos", "role", "said")).withColumn("b", F.xxhash64(F.lit("b"), "said", "pos", "role"))
    text = F.concat(F.lit(OPEN), "role", F.lit("\n"), "said", F.lit(CLOSE + "\n"))
    return rows.select("conv_id", "pos", text.alias("text"), F.bit_xor("a").over(so_far).alias("p1"), F.bit_xor("b").over(so_far).alias("p2"), F.lead("pos").over(order).isNull().alias("last"))


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """The conversations that no other one continues, as text: conv_id, n_turns, n_copies, rendered.

    turns: conv_id, turn, role, text; other columns are ignored. A conversation whose turns are the first turns of a
    longer one goes; of conversations with the same turns the smallest conv_id stays and n_copies counts them. A missing role or
    text is empty, rows without conv_id are one conversation, rows without turn come first. An empty table gives no row. The
    mark of the format in a role or a text is broken: "<|im_" is rendered as "<| im_", so that no turn can close itself.
    The hashes are deduplicated before they are joined, so a first turn that a third of all conversations share is one row.
    """
    rows = turn_prefixes(turns)
    whole = rows.where("last").groupBy("pos", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    begun = rows.where("NOT last").select("pos", "p1", "p2").distinct()
    kept = whole.join(begun, ["pos", "p1", "p2"], "left_anti").select(F.col("conv_id").alias("kept_id"), F.col("pos").cast("long").alias("n_turns"), "n_copies")
    shown = rows.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id")))
    in_turn = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return shown.groupBy("conv_id", "n_turns", "n_copies").agg(F.concat_ws("", F.transform(in_turn, lambda x: x["text"])).alias("rendered"))


def op7_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_and_render(table(spark, sf_dir, "conversations"))


_SAID = "replace(coalesce({0}, ''), '<|im_', '<| im_')"
ORACLE = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_SAID.format('role')}, {_SAID.format('text')}) AS pos,
         [{_SAID.format('role')}, {_SAID.format('text')}] AS said, '<|im_start|>' || {_SAID.format('role')} || chr(10) || {_SAID.format('text')} || '<|im_end|>' || chr(10) AS r
  FROM conversations),
p AS (
  SELECT conv_id, pos, list(said) OVER w AS pre, string_agg(r, '') OVER w AS rendered, max(pos) OVER (PARTITION BY conv_id) AS n FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
w AS (SELECT pre, n, min(conv_id) AS conv_id, count(*) AS n_copies, min(rendered) AS rendered FROM p WHERE pos = n GROUP BY pre, n)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, n_copies, rendered FROM w
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n AND p.pos = w.n AND p.pre = w.pre)
"""
