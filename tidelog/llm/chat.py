"""Chat formatting: snapshots of a growing conversation collapse to the longest before rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns that one part of a rendered conversation holds; longer ones go on in further parts.
PART_TURNS = 1024


def _turn_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("_tl_rank"), F.coalesce("role", F.lit("")), F.col("role").isNull(), F.coalesce("text", F.lit("")), F.col("text").isNull())


def ranked_turns(conversations: DataFrame) -> DataFrame:
    """Turns with _tl_rank (from 1 in each conversation) and the rolling hash _tl_a, _tl_b of the turns up to each.

    The hash of a turn covers its rank, so that the exclusive or of the hashes up to a
    rank stands for the ordered prefix; two of 64 bits make collisions negligible. A
    conversation's turns are sorted in one partition, with spill to disk, and never held together.
    A conversation's key is _tl_none (its id is null) and _tl_id (its id, else any value), which are never null.
    """
    key = ["_tl_none", "_tl_id"]
    kind = conversations.schema["conv_id"].dataType
    named = conversations.select("turn", "role", "text", F.col("conv_id").isNull().alias("_tl_none"), F.coalesce("conv_id", F.lit(0).cast(kind)).alias("_tl_id"))
    order = Window.partitionBy(*key).orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    ranked = named.withColumn("_tl_rank", F.row_number().over(order).cast("long"))
    hashed = ranked.withColumns({"_tl_x": _turn_hash(1), "_tl_y": _turn_hash(2)})
    return hashed.withColumns({"_tl_a": F.bit_xor("_tl_x").over(upto), "_tl_b": F.bit_xor("_tl_y").over(upto), "_tl_n": F.count(F.lit(1)).over(Window.partitionBy(*key))}).drop("_tl_x", "_tl_y")


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(_tl_none, _tl_id, n_turns) of conversations that are no proper prefix of another; of equal ones the smallest conv_id.

    Both sides of the anti-join hold a key once: equal prefixes are merged before the shuffle.
    """
    key = ["_tl_rank", "_tl_a", "_tl_b"]
    first = F.min(F.struct("_tl_none", "_tl_id")).alias("_tl_first")
    whole = turns.where("_tl_rank = _tl_n").groupBy(*key).agg(first)
    prefixes = turns.where("_tl_rank < _tl_n").select(*key).distinct()
    return whole.join(prefixes, key, "left_anti").select("_tl_first._tl_none", "_tl_first._tl_id", F.col("_tl_rank").alias("n_turns"))


def rendered_turn() -> Column:
    """One turn in the chat template; a null role or text is written as an empty one."""
    return F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))


def format_chats(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, part, n_turns, n_roles, text): the retained conversations, rendered in the order of their turns.

    Texts are shuffled once. Conversations that begin longer ones are dropped, and of equal ones only the
    smallest conv_id stays. A conversation of over `part_turns` turns is rendered in
    parts that follow each other, so that no row gathers more. Rows with a null
    conv_id form one conversation. Turns with equal numbers are ordered by role and text, nulls last;
    repeated rows are turns of their own, long texts are rendered whole, other columns are left out. An empty table gives no rows.
    """
    turns = ranked_turns(conversations)
    # one shuffle of the texts serves both sides; the conversations that stay meet it by the key it is dealt by
    of_kept = turns.join(maximal_conversations(turns), ["_tl_none", "_tl_id"]).withColumn("part", F.floor((F.col("_tl_rank") - 1) / part_turns).cast("long"))
    parts = of_kept.groupBy("_tl_none", "_tl_id", "part", "n_turns").agg(F.sort_array(F.collect_list(F.struct("_tl_rank", rendered_turn().alias("t")))).alias("_tl_turns"), F.count_distinct("role").alias("n_roles"))
    return parts.select(F.when(~F.col("_tl_none"), F.col("_tl_id")).alias("conv_id"), "part", "n_turns", "n_roles", F.array_join(F.transform("_tl_turns", lambda x: x["t"]), "").alias("text"))


def oracle_sql(part_turns: int = PART_TURNS) -> str:
    """The query's rows in DuckDB's SQL: prefixes as whole texts instead of hashes."""
    return f"""
WITH ranked AS (
  SELECT conv_id, role, text, row_number() OVER w AS rank, count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST)
), turns AS (
  SELECT *, string_agg(coalesce(length(role)::VARCHAR, 'n') || ':' || coalesce(role, '') || coalesce(length(text)::VARCHAR, 'n') || ':' || coalesce(text, ''), chr(0))
    OVER (PARTITION BY conv_id ORDER BY rank) AS prefix FROM ranked
), whole AS (SELECT prefix, rank AS n_turns, min(conv_id) AS conv_id FROM turns WHERE rank = n GROUP BY ALL
), kept AS (SELECT conv_id, n_turns FROM whole WHERE prefix NOT IN (SELECT prefix FROM turns WHERE rank < n))
SELECT t.conv_id, CAST((rank - 1) // {part_turns} AS BIGINT) AS part, CAST(n_turns AS BIGINT) AS n_turns, count(DISTINCT role) AS n_roles,
  string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY rank) AS text
FROM turns t JOIN kept k ON t.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY ALL"""
