"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed

#: numpy draws from populations below this.
NUMPY_MOST = 10**9


def block_sizes(rows: int, shards: int, blocks: int) -> np.ndarray:
    """Rows of each of shards x blocks blocks: shards at most one row apart, blocks of a shard as well."""
    shard = np.full(shards, rows // shards, np.int64)
    shard[: rows % shards] += 1
    out = np.repeat(shard[:, None] // blocks, blocks, 1)
    out += np.arange(blocks)[None, :] < (shard % blocks)[:, None]
    return out.ravel()


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` rows, drawn from good + bad without replacement, are good."""
    if good + bad < NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, draws))
    low, high = max(0, draws - bad), min(good, draws)
    mean = draws * good / (good + bad)
    wide = 12 * math.sqrt(mean * (bad / (good + bad)) * ((good + bad - draws) / (good + bad))) + 12
    k = np.arange(max(low, int(mean - wide)), min(high, int(mean + wide)) + 1)
    # Up to a constant, log P(k); ratios of successive terms, so that large factorials don't cancel.
    step = np.log((good - k[:-1]) / (k[:-1] + 1.0)) + np.log((draws - k[:-1]) / (bad - draws + k[:-1] + 1.0))
    log_p = np.concatenate([[0.0], np.cumsum(step)])
    p = np.cumsum(np.exp(log_p - log_p.max()))
    return int(k[np.searchsorted(p, rng.random() * p[-1])])


def split(rng: np.random.Generator, sizes: np.ndarray, draws: int) -> np.ndarray:
    """How many of `draws` rows come from each block: a multivariate hypergeometric draw."""
    if sizes.sum() < NUMPY_MOST:
        return rng.multivariate_hypergeometric(sizes, draws, method="marginals")
    out, rest = np.zeros_like(sizes), int(sizes.sum())
    for i, size in enumerate(sizes.tolist()):
        rest -= size
        out[i] = hypergeometric(rng, size, rest, draws) if draws else 0
        draws -= int(out[i])
    return out


def matrix_row(counts: np.ndarray, sizes: np.ndarray, index: int, seed: int) -> np.ndarray:
    """Row `index` of the communication matrix: rows that the partition sends to each block.

    The partitions are halved again and again; each half draws its share of the blocks
    from a generator seeded by the range, so that every task finds the same matrix
    from the partitions' counts alone and none holds more of it than a row.
    """
    low, high, have = 0, len(counts), sizes
    while high - low > 1:
        middle = (low + high) // 2
        left = split(np.random.default_rng([seed, low, high]), have, int(counts[low:middle].sum()))
        low, high, have = (low, middle, left) if index < middle else (middle, high, have - left)
    return have


def shard_documents(docs: DataFrame, shards: int, seed: int = 7, block_rows: int = 1 << 20) -> DataFrame:
    """docs with shard (int, from 0), slot (long, gapless from 0 in each shard).

    Shards differ by one row at most, and every order of the rows is as likely as any
    other: the partitions' counts fix how many rows each sends to each block, each
    partition deals its rows out in an order drawn by hash, and each block orders what it
    got by another. A shard is one or more blocks of at most `block_rows` rows.

    The rows are kept in the shared folder first, so that what is counted is what is dealt, also
    after a lost executor. Nulls are values like others; rows equal in all columns are dealt in any order, long
    texts as any. Columns named shard or slot go. An empty table gives no rows; with fewer rows than shards the last shards stay empty.
    """
    docs = checkpointed(docs.drop("shard", "slot"))
    pid = F.spark_partition_id()
    counted = {r["p"]: r["n"] for r in docs.groupBy(pid.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = np.array([counted.get(p, 0) for p in range(max(counted, default=0) + 1)], np.int64)
    rows = int(counts.sum())
    blocks = max(1, -(-rows // (shards * block_rows)))
    sizes = block_sizes(rows, shards, blocks)
    plain = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    schema = T.StructType([*docs.schema, T.StructField("_tl_block", T.LongType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, done = TaskContext.get().partitionId(), 0
        expected = int(counts[index]) if index < len(counts) else 0
        ends = np.cumsum(matrix_row(counts, sizes, index, seed)) if expected else np.zeros(1, np.int64)
        for batch in batches:
            block = np.searchsorted(ends, np.arange(done, done := done + batch.num_rows), side="right")
            names = [n for n in batch.schema.names if n != "_tl_draw"]
            yield batch.select(names).append_column("_tl_block", pa.array(block, pa.int64()))
        if done != expected:
            raise ValueError(f"partition {index} has {done} rows, {expected} were counted")

    drawn = docs.withColumn("_tl_draw", F.xxhash64(F.lit(seed), *plain)).sortWithinPartitions("_tl_draw")
    dealt = drawn.mapInArrow(deal, schema)
    again = Window.partitionBy("_tl_block").orderBy("_tl_second", "_tl_third")
    whole, part = F.lit(rows // shards), F.lit(rows % shards)
    shard = F.expr(f"_tl_block div {blocks}")
    own = whole + F.when(shard < part, 1).otherwise(0)
    at = F.col("_tl_block") % blocks
    start = at * F.floor(own / F.lit(blocks)) + F.least(at, own % blocks)
    return (
        dealt.withColumns({"_tl_second": F.xxhash64(F.lit(seed + 1), *plain), "_tl_third": F.xxhash64(F.lit(seed + 2), *plain)})
        .withColumn("slot", (start + F.row_number().over(again) - 1).cast("long"))
        .withColumn("shard", shard.cast("int"))
        .drop("_tl_second", "_tl_third", "_tl_block")
    )
