"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

The input is dealt over blocks. How many rows of each block go to each shard is drawn, on the driver, from the
multivariate hypergeometric law that a uniform permutation implies (blocks x shards numbers); each block permutes its
rows and deals them out by those counts; every shard permutes what it got. All data moves by DataFrame functions.

Law: ``rows``, shard counts differ by one at most. Rows are placed one by one, also those with equal texts: exact sizes
and a uniform choice leave no room for groups. Rows are told apart by their place in the staged input, so repeated rows
and null ids are placed like any others; null texts count 0 bytes (plus 1). A shard's inner permutation is cut into
random pieces, so neither a block nor a shard is ever one task's work. An empty table gives an empty result.
"""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curbstream.llm.common import input_rows, shuffle_width, stage

ROWS_PER_PIECE = 1_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Number of good ones in ``n`` draws without replacement; beyond numpy's range by inversion around the mode."""
    if good == 0 or n == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    mean = n * good / total
    sd = math.sqrt(mean * (bad / total) * max((total - n) / max(total - 1, 1), 0.0)) + 1
    lo, hi = max(0, n - bad, math.floor(mean - 12 * sd)), min(n, good, math.ceil(mean + 12 * sd))
    k = np.arange(lo, hi, dtype=np.float64)
    logs = np.concatenate([[0.0], np.cumsum(np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1))])
    p = np.cumsum(np.exp(logs - logs.max()))
    return lo + int(np.searchsorted(p, rng.random() * p[-1]))


def draw_matrix(block_rows: list[int], shard_rows: list[int], seed: int) -> np.ndarray:
    """Counts by block and shard with the given row and column sums, as a uniform permutation would have them."""
    rng, left = np.random.default_rng(seed), list(shard_rows)
    out = np.zeros((len(block_rows), len(shard_rows)), np.int64)
    for b, n in enumerate(block_rows):
        rest = sum(left)
        for s in range(len(left)):
            if n == 0:
                break
            x = hypergeometric(rng, left[s], rest - left[s], n)
            rest -= left[s]
            out[b, s], left[s], n = x, left[s] - x, n - x
    return out


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    d = input_rows(docs, doc_id, text)
    empty = F.coalesce("text", F.lit(""))
    # Written once: the place of a row in this table is its identity from here on, whoever reads it again.
    rows = stage(d.select("doc_id", (F.octet_length(empty).cast("bigint") + 1).alias("size"), F.crc32(F.encode(empty, "utf-8")).alias("text_crc32"), F.monotonically_increasing_id().alias("at")), "shard-rows")
    blocks = shuffle_width(spark)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("at", F.lit(seed)), F.lit(blocks)).cast("int"))
    counts = [0] * blocks
    for r in rows.groupBy("block").count().collect():  # one number per block
        counts[r["block"]] = r["count"]
    total = sum(counts)
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = draw_matrix(counts, sizes, seed)
    upto = np.cumsum(matrix, axis=1)
    plan = spark.createDataFrame([(b, [int(x) for x in upto[b]]) for b in range(blocks)], "block int, upto array<bigint>")
    nth = F.row_number().over(W.partitionBy("block").orderBy(F.xxhash64("at", F.lit(seed + 1)), "at"))
    dealt = rows.withColumn("nth", nth).join(F.broadcast(plan), "block")  # blocks x shards numbers
    # The shard is the number of column ends before the row's turn.
    shard = sum(((F.col("nth") > F.col("upto")[s]).cast("int") for s in range(shards - 1)), F.lit(0))
    dealt = stage(dealt.select("doc_id", "size", "text_crc32", "at", shard.alias("shard")), "shard-dealt")
    pieces = max(1, math.ceil(total / shards / ROWS_PER_PIECE), -(-blocks // shards))
    dealt = dealt.withColumn("piece", F.pmod(F.xxhash64("at", F.lit(seed + 2)), F.lit(pieces)).cast("int"))
    ends = W.partitionBy("shard").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "piece").count().select("shard", "piece", F.coalesce(F.sum("count").over(ends), F.lit(0)).alias("from"))
    inner = F.row_number().over(W.partitionBy("shard", "piece").orderBy(F.xxhash64("at", F.lit(seed + 3)), "at"))
    out = dealt.withColumn("inner", inner).join(starts, ["shard", "piece"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("from") + F.col("inner") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 7, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes the documents under ``path/shard=N``, each file sorted by slot; ids must be distinct."""
    at = shard_rows(docs, shards, seed, doc_id, text).select(F.col("doc_id").alias("_id"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    out = docs.join(at, docs[doc_id].eqNullSafe(at["_id"])).drop("_id").withColumnsRenamed({"_shard": "shard", "_slot": "slot"})
    out.repartitionByRange(shuffle_width(docs.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
