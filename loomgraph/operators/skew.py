"""Joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomgraph.runtime import cut, local, partitions, release

#: A key with fewer rows than this is never heavy, whatever its share.
LEAST_HEAVY = 1000
#: Up to so many partitions candidates come to the driver by a top-k; beyond, they are written down first, as every task would send as many.
TOP_K_PARTS = 500


class Heavy(list):
    """Heavy keys, with `rows` (rows of each) and `total` (rows of all keys).

    A heavy key holds more than half a partition's fair share of the rows, so there are fewer than two for each partition.
    """

    rows: list[int]
    total: int

    def __init__(self, keys=(), rows=(), total: int = 0):
        super().__init__(keys)
        self.rows, self.total = list(rows), total


def bound(total: int, parts: int) -> float:
    """More rows than this make a key heavy."""
    return max(LEAST_HEAVY, total / (2 * parts))


def heavy_keys(df: DataFrame, key: str, parts: int | None = None) -> Heavy:
    """Keys of more than half a partition's fair share of the rows. The counts are exact and combined before the shuffle; null is no key."""
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
    seen, parts = Observation(), parts or partitions(df.sparkSession)
    large = counts.observe(seen, F.sum("n").alias("total")).where(F.col("n") > LEAST_HEAVY)
    if parts > TOP_K_PARTS:
        large = cut(large, "heavy")
        heavy = most_rows(large, seen.get.get("total") or 0, parts)
        release(large)
        return heavy
    # fewer than 2 * parts keys can be heavy, so the first so many are all of them
    top = large.orderBy(F.desc("n"), "k").limit(2 * parts).collect()
    total = seen.get.get("total") or 0
    top = [r for r in top if r.n > bound(total, parts)]
    return Heavy([r.k for r in top], [r.n for r in top], total)


def most_rows(counts: DataFrame, total: int, parts: int) -> Heavy:
    """Heavy keys of a table of counts (k, n)."""
    top = counts.where(F.col("n") > bound(total, parts)).orderBy(F.desc("n"), "k").collect()
    return Heavy([r[0] for r in top], [r.n for r in top], total)


def _murmur(value: np.ndarray, seed: int) -> np.ndarray:
    """Murmur3 of 32-bit integers after a hash `seed`: how Spark goes on hashing a row with an int column."""
    with np.errstate(over="ignore"):
        u = np.uint32
        k = value.astype(u) * u(0xCC9E2D51)
        k = ((k << u(15)) | (k >> u(17))) * u(0x1B873593)
        h = u(seed & 0xFFFFFFFF) ^ k
        h = ((h << u(13)) | (h >> u(19))) * u(5) + u(0xE6546B64)
        h ^= u(4)
        h = (h ^ (h >> u(16))) * u(0x85EBCA6B)
        h = (h ^ (h >> u(13))) * u(0xC2B2AE35)
        return (h ^ (h >> u(16))).astype(np.int32)


def places(seed: int, wanted: int, parts: int) -> list[int]:
    """Salts that put a key of hash `seed` on `wanted` different partitions (all, if it wants as many), one salt each."""
    wanted, salts = min(wanted, parts), np.zeros(0, dtype=np.int64)
    tries = 2 * wanted + 8
    while len(salts) < wanted:
        found = np.arange(tries, dtype=np.int64)
        _, first = np.unique(np.mod(_murmur(found, seed).astype(np.int64), parts), return_index=True)
        salts, tries = np.sort(first), tries * 2
    return salts[:wanted].tolist()


def shuffle_parts(spark: SparkSession) -> int:
    """The number of partitions a shuffle is planned with; adaptive execution may merge neighbours later."""
    first = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    merging = all(spark.conf.get(c, "true") == "true" for c in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.coalescePartitions.enabled"))
    return int(first) if first and merging else partitions(spark)


def slots(spark: SparkSession, heavy: Heavy, key_type, key: str) -> DataFrame:
    """(`key`, __slots): for each heavy key the salts of the partitions it is spread over, four for each fair share it holds.

    Fewer rows than twice the partitions, and in them fewer than six times as many salts together: broadcast whatever the data's size.
    """
    from pyspark.sql import types as T

    parts = shuffle_parts(spark)
    keys = local(spark, [(k,) for k in heavy], T.StructType([T.StructField("k", key_type)]))
    seeds = [r[0] for r in keys.select(F.hash("k")).collect()]
    out = [(k, places(seed, -(-4 * n * parts // heavy.total), parts)) for k, n, seed in zip(heavy, heavy.rows, seeds)]
    return local(spark, out, T.StructType([T.StructField(key, key_type), T.StructField("__slots", T.ArrayType(T.IntegerType()))]))


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", heavy: Heavy | None = None) -> DataFrame:
    """left join right on `key`; left's heavy keys are spread over as many partitions as they need, and right's rows for them repeated there.

    The salts of a heavy key are chosen so that the join's own hash sends each to another partition; its rows take turns by a hash of
    their content and input partition, so a repeated task gives every row the same place and equal rows are spread too. Null keys of left (kept by a
    left join only) are spread over all partitions; they meet nothing. right should hold few rows per key.
    """
    spark = left.sparkSession
    heavy = heavy_keys(left, key) if heavy is None else heavy
    if how in ("inner", "left_semi"):
        left = left.where(F.col(key).isNotNull())
    kind = left.schema[key].dataType
    right = right.where(F.col(key).isNotNull()).withColumn(key, F.col(key).cast(kind))
    turn = F.xxhash64(*[F.col(f"`{c}`") for c in left.columns], F.spark_partition_id())
    # a null key's salt is free: nothing has to be repeated for it
    free = F.when(F.col(key).isNull(), F.pmod(turn, F.lit(1 << 30)).cast("int")) if how not in ("inner", "left_semi") else F.when(F.lit(False), F.lit(0))
    if not heavy:
        if how in ("inner", "left_semi"):
            return left.join(right, key, how)
        left = left.withColumn("__salt", F.coalesce(free, F.lit(0)))
        return left.join(right.withColumn("__salt", F.lit(0)), [key, "__salt"], how).drop("__salt")
    # joined by the key's own name, so that no name of a column is reserved besides __salt and __slots
    spread = slots(spark, heavy, kind, key)
    at: Column = F.element_at("__slots", (F.pmod(turn, F.size("__slots")) + 1).cast("int"))
    left = left.join(F.broadcast(spread), key, "left")
    left = left.withColumn("__salt", F.coalesce(F.when(F.col("__slots").isNotNull(), at), free, F.lit(0))).drop("__slots")
    right = right.join(F.broadcast(spread), key, "left")
    right = right.withColumn("__salt", F.explode(F.coalesce("__slots", F.array(F.lit(0))))).drop("__slots")
    return left.join(right, [key, "__salt"], how).drop("__salt")


def with_group_min(rows: DataFrame, key: str, value: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the least `value` of their key's group as column `name`, the table of minima to release() after use); null keys are left out.

    The groups' minima and sizes are one table; its largest groups are the heavy keys of the join, so no second count is made.
    """
    seen = Observation()
    least = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(name), F.count("*").alias("__n"))
    least = cut(least, "least", seen, F.sum("__n").alias("total"), F.max("__n").alias("most"))
    total, most = (seen.get.get(x) or 0 for x in ("total", "most"))
    parts = partitions(rows.sparkSession)
    heavy = most_rows(least.select(F.col(key).alias("k"), F.col("__n").alias("n")), total, parts) if most > bound(total, parts) else Heavy(total=total)
    return lookup_join(rows, least.drop("__n"), key, "inner", heavy), least
