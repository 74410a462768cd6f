"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows get a stable row id once (a written table), and are dealt into source blocks by a hash of that id, so that blocks
are even whatever the data hold. How many rows each block sends to each shard is drawn exactly: block by block from the
multivariate hypergeometric law, so that row and column sums hold. Each block permutes its rows and cuts the permuted
list by its row of the matrix (first local permutation); rows are exchanged; each shard orders what it received by a
second random key (second local permutation), in small sub-ranges of that key with known offsets, so no task sorts a
whole shard. Every permutation of the rows over all slots is equally likely, up to the quality of the hash.

Law `rows`: shard sizes differ by at most one. Defined results: a null text has size 1 and crc32 0; equal rows are
distinct members of the shuffle (equal texts go to shards independently of each other); an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.llm.common import fresh, partitions_for, read, staged

#: Most source blocks, and so most rows of the matrix on the driver: 4096 x shards integers.
MOST_BLOCKS = 4096


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Exact draw (to double rounding) of the good ones among draws without replacement, at any population size: inversion
    over the mode plus and minus 14 standard deviations, with the probability ratios of neighbours."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    sd = (draws * (good / total) * (bad / total) * ((total - draws) / max(1, total - 1))) ** 0.5
    reach = int(14 * sd) + 40
    a, b = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(a, b, dtype=np.float64)
    step = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logp = np.concatenate([[0.0], np.cumsum(step)])
    p = np.cumsum(np.exp(logp - logp.max()))
    return a + int(np.searchsorted(p, rng.random() * p[-1], side="right"))


def communication_matrix(counts: list[int], shards: list[int], seed: int) -> np.ndarray:
    """matrix[i][j]: rows that block i sends to shard j; rows sum to counts, columns to shards."""
    if sum(counts) != sum(shards):
        raise ValueError("block counts and shard sizes differ in sum")
    rng, left, out = np.random.default_rng(seed), list(shards), np.zeros((len(counts), len(shards)), np.int64)
    for i, n in enumerate(counts):
        pool = sum(left)
        for j, size in enumerate(left):
            out[i, j] = got = hypergeometric(rng, size, pool - size, n)
            pool, n = pool - size, n - got
        left = [x - int(y) for x, y in zip(left, out[i], strict=True)]
    return out


def shuffle_into_shards(df: DataFrame, n_shards: int, seed: int = 1, rows_per_block: int = 100_000) -> DataFrame:
    """df with columns shard (0 to n_shards - 1) and slot (0 to size of the shard - 1) added, as _shard and _slot where df has
    such columns."""
    spark = df.sparkSession
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    shard, slot, rid, blk, n, at, sub, key = fresh(df, "shard", "slot", "rid", "blk", "n", "at", "sub", "key")
    rows = staged(df.withColumn(rid, F.monotonically_increasing_id()), "shard-rows")
    total = rows.count()
    blocks = partitions_for(total, rows_per_block, MOST_BLOCKS)
    blocked = rows.withColumn(blk, F.pmod(F.xxhash64(rid, F.lit(seed)), F.lit(blocks)).cast("int"))
    counts = [0] * blocks
    for r in blocked.groupBy(blk).count().collect():  # at most MOST_BLOCKS rows
        counts[r[0]] = r[1]
    sizes = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    matrix = communication_matrix(counts, sizes, seed)
    ends = spark.createDataFrame([(i, [int(x) for x in np.cumsum(matrix[i])]) for i in range(blocks)], T.StructType([T.StructField(blk, T.IntegerType()), T.StructField(at, T.ArrayType(T.LongType()))]))
    place = f"row_number() over (partition by `{blk}` order by xxhash64(`{rid}`, {seed + 1}), `{rid}`)"
    sent = blocked.withColumn(n, F.expr(place).cast("long")).join(F.broadcast(ends), blk)  # at most MOST_BLOCKS rows
    sent = sent.withColumn(shard, F.size(F.filter(at, lambda e: e < F.col(n))).cast("int"))
    pieces = partitions_for(-(-total // n_shards), rows_per_block, MOST_BLOCKS)
    sent = sent.withColumn(key, F.xxhash64(rid, F.lit(seed + 2))).withColumn(sub, F.floor((F.shiftrightunsigned(key, 1) / F.lit(2.0**63)) * pieces).cast("int"))
    sent = staged(sent.drop(blk, n, at), "shard-sent")
    starts = sent.groupBy(shard, sub).agg(F.count("*").alias(n)).selectExpr(f"`{shard}`", f"`{sub}`", f"sum(`{n}`) over (partition by `{shard}` order by `{sub}`) - `{n}` as `{at}`")
    starts = staged(starts, "shard-starts")
    place = F.expr(f"row_number() over (partition by `{shard}`, `{sub}` order by `{key}`, `{rid}`)")
    return sent.withColumn(n, place).join(starts, [shard, sub]).withColumn(slot, F.col(at) + F.col(n) - 1).select(*df.columns, shard, slot)


def write_shards(df: DataFrame, path: str, n_shards: int, seed: int = 1) -> None:
    """The shuffled rows as Parquet, one folder for each shard, with their slot."""
    shuffle_into_shards(df, n_shards, seed).write.partitionBy("shard").parquet(path)


def op3_hypergeometric_sharding(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    slim = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    return shuffle_into_shards(slim, 8).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
