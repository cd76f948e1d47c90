"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, global_prefix_sum

#: Rows of a source that one task sorts; the first hex digits of the shuffle key split larger sources.
ROWS_A_TASK = 100_000


def code_point_weights(docs: DataFrame, cycle: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """(source, weight): the sources by code point, null last, take the weights of `cycle` in turn."""
    sources = docs.select("source").distinct().withColumn("_tl_null", F.col("source").isNull().cast("int")).withColumn("_tl_one", F.lit(1).cast("long"))
    ranked = global_prefix_sum(sources, ["_tl_null", "source"], "_tl_one", "_tl_rank")
    return ranked.select("source", F.element_at(F.array(*map(F.lit, cycle)), (F.col("_tl_rank") % len(cycle) + 1).cast("int")).cast("double").alias("weight"))


def source_targets(sizes: DataFrame, weights: DataFrame, budget: float, max_epochs: int) -> tuple[DataFrame, float]:
    """(source, source_size, weight, target) and the virtual time at which the budget is spent.

    A target is weight times that time, and at most max_epochs times the source's size.
    Each round sums over all sources and brings one row to the driver; sources that
    reach their cap pass on what they can't take, until none is above.
    """
    sources = checkpointed(
        sizes.alias("s").join(weights.alias("w"), F.col("s.source").eqNullSafe(F.col("w.source")), "left").select("s.source", "source_size", F.coalesce("weight", F.lit(0.0)).cast("double").alias("weight"), (F.col("source_size") * max_epochs).cast("double").alias("cap"))
    )
    total = budget * float(sources.agg(F.sum("source_size")).first()[0] or 0)
    time = 0.0
    while True:
        full = F.col("cap") <= F.col("weight") * time
        capped, rest = sources.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not rest:
            time = math.inf
            break
        later = (total - (capped or 0.0)) / rest
        if later <= time:
            break
        time = later
    target = F.col("cap") if math.isinf(time) else F.least("cap", F.col("weight") * F.lit(time))
    return sources.select("source", "source_size", "weight", F.when(F.col("weight") > 0, target).otherwise(0.0).alias("target")), total


def mix_sources(docs: DataFrame, weights: DataFrame, budget: float = 1.5, max_epochs: int = 2, seed: str = "mix") -> DataFrame:
    """docs with source_size (long), target (double) and taken (long): words of the row that the mix takes.

    docs needs doc_id, source and size (long, words). Each source queues its documents
    in an order drawn by hash, max_epochs times over. A document's virtual finish time
    is the words of its source up to and with it, divided by the source's weight. All
    queue entries are range-sorted by finish time, and the mix is what comes before
    the total budget, `budget` times all words, is spent. Whole documents are taken,
    so taken is a multiple of size, and a source ends within about a document of its target.

    A null source is a source of its own. Sources without a row in weights weigh
    nothing and are not taken. Null sizes count as 0. Repeated rows queue separately,
    in an order that does not matter as they are equal. An empty table gives no rows.
    """
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    text = [F.md5(F.col("text").cast("binary"))] if "text" in docs.columns else [F.col("text_md5")] if "text_md5" in docs.columns else []
    rows = docs.count()
    digits = max(1, math.ceil(math.log(max(1, rows / ROWS_A_TASK), 16)))
    keyed = (
        docs.drop("source_size", "target", "taken")
        .withColumn("size", F.coalesce("size", F.lit(0)).cast("long"))
        .withColumn("_tl_key", F.md5(F.concat_ws("|", F.lit(seed), as_text("doc_id"), *text).cast("binary")))
        .withColumn("_tl_part", F.substring("_tl_key", 1, digits))
    )
    parts = checkpointed(keyed.groupBy("source", "_tl_part").agg(F.sum("size").alias("_tl_sum")))
    sources, total = source_targets(parts.groupBy("source").agg(F.sum("_tl_sum").alias("source_size")), weights, budget, max_epochs)
    before = Window.partitionBy("source").orderBy("_tl_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        parts.withColumn("_tl_start", F.coalesce(F.sum("_tl_sum").over(before), F.lit(0)))
        .alias("p")
        .join(sources.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")))
        .select(F.col("p.source").alias("_tl_source"), F.col("_tl_part").alias("_tl_start_part"), "_tl_start", "source_size", "weight", "target")
    )
    inside = Window.partitionBy("source", "_tl_part").orderBy("_tl_key").rowsBetween(Window.unboundedPreceding, 0)
    queued = (
        keyed.join(starts, F.col("source").eqNullSafe(F.col("_tl_source")) & (F.col("_tl_part") == F.col("_tl_start_part")))
        .withColumn("_tl_upto", F.col("_tl_start") + F.sum("size").over(inside))
        .drop("_tl_source", "_tl_start_part", "_tl_start", "_tl_part")
    )
    if "text" not in docs.columns:  # narrow rows: keep them instead of reading the texts again
        queued = checkpointed(queued)
    finish = lambda epoch: (F.col("_tl_upto") + epoch * F.col("source_size")) / F.nullif("weight", F.lit(0.0))
    entries = (
        queued.where("weight > 0")
        .select("size", "_tl_key", "_tl_upto", "source_size", "weight", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch"))
        .select("size", "_tl_key", "epoch", finish(F.col("epoch")).alias("finish"))
    )
    order = ["finish", "_tl_key", "epoch"]
    spent = global_prefix_sum(entries, order, "size", "_tl_before")
    cut = spent.where(F.col("_tl_before") + F.col("size") <= F.lit(total)).agg(F.max(F.struct(*order))).first()[0]
    if cut is None:
        taken = F.lit(0)
    else:
        last = F.struct(F.lit(cut["finish"]).alias("finish"), F.lit(cut["_tl_key"]).alias("_tl_key"), F.lit(cut["epoch"]).alias("epoch"))
        goes = lambda e: F.struct(finish(F.lit(e)).alias("finish"), F.col("_tl_key").alias("_tl_key"), F.lit(e).alias("epoch")) <= last
        taken = sum((F.when((F.col("weight") > 0) & goes(e), 1).otherwise(0) for e in range(max_epochs)), F.lit(0))
    return queued.withColumn("_tl_copies", taken).withColumn("taken", F.col("size") * F.col("_tl_copies")).drop("_tl_key", "_tl_upto", "weight")


def mixed_documents(docs: DataFrame, weights: DataFrame, budget: float, max_epochs: int, size, seed: str = "mix") -> DataFrame:
    """The mix itself, with the columns of docs: a document taken twice is there twice. Documents without words go."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    sized = docs.select(F.col("doc_id"), F.col("source"), F.struct(*columns).alias("_tl_row"), F.col("text"), size.alias("size"))
    taken = mix_sources(sized, weights, budget, max_epochs, seed)
    return taken.where("_tl_copies > 0 AND size > 0").select("_tl_row", F.explode(F.sequence(F.lit(1), F.col("_tl_copies")))).select("_tl_row.*")


def oracle_sql(budget: float = 1.5, max_epochs: int = 2, seed: str = "mix") -> str:
    """The rows of op1_mix_sources in DuckDB's SQL: one queue, sorted and summed whole."""
    return rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || coalesce('|' || md5(text), '')) AS key FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM sized GROUP BY source
), capped AS (SELECT *, CAST(source_size * {max_epochs} AS DOUBLE) AS cap, {budget} * sum(source_size) OVER () AS total FROM sources
), steps AS (
  SELECT *, (total - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t
  FROM capped WINDOW w AS (ORDER BY cap / weight, source)
), level AS (SELECT first(t ORDER BY cap / weight, source) FILTER (WHERE t < cap / weight) AS t FROM steps
), targets AS (SELECT source, source_size, weight, total, CASE WHEN level.t IS NULL THEN cap ELSE least(cap, weight * level.t) END AS target FROM capped, level
), queued AS (
  SELECT d.doc_id, d.source, d.size, d.key, t.*  EXCLUDE (source), sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key) AS upto
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), entries AS (SELECT key, size, total, e AS epoch, (CAST(upto AS DOUBLE) + e * source_size) / weight AS finish FROM queued, unnest(range({max_epochs})) AS u(e)
), spent AS (SELECT key, size, total, sum(size) OVER (ORDER BY finish, key, epoch ROWS UNBOUNDED PRECEDING) AS upto FROM entries
), copies AS (SELECT key, count(*) FILTER (WHERE upto <= total) AS n FROM spent GROUP BY key)
SELECT doc_id, size, source_size, target, CAST(size * n AS BIGINT) AS taken FROM queued q JOIN copies c ON q.key = c.key"""
