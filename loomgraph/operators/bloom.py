"""A Bloom filter as a table of blocks of 64-bit words: built by bit_or, probed by a broadcast hash join, all in generated code.

A filter is sized for its keys (BITS_PER_KEY). One filter has at most MAX_WORDS words; more keys are parted by hash into shards, each with a filter
of its own, which are broadcast and probed one after the other. So no number of keys makes a filter so full that it proves nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits of one filter: 64 MB, for 33 million keys.
MAX_WORDS = 1 << 23
BITS_PER_KEY = 16
BITS_SET = 4
#: Words in one row of the table.
BLOCK = 1024


def size_for(keys: int, max_words: int = MAX_WORDS) -> tuple[int, int]:
    """(words of a shard, shards) for so many keys."""
    need = -(-max(1, keys) * BITS_PER_KEY // 64)
    shards = -(-need // max_words)
    return max(1, -(-need // shards)), shards


def shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(3)), F.lit(shards)).cast("int")


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words)).cast("bigint")


def _mask(key: Column) -> Column:
    """BITS_SET bits of one word, from a second hash."""
    h = F.xxhash64(key, F.lit(7))
    out = F.lit(0).cast("bigint")
    for i in range(BITS_SET):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return out


def build(keys: DataFrame, key: str, words: int) -> DataFrame:
    """(block, bits): the words of the filter in order, BLOCK in a row, empty ones included."""
    word = F.col("word")
    set_ = keys.where(F.col(key).isNotNull()).select(_word(F.col(key), words).alias("word"), _mask(F.col(key)).alias("m"))
    every = keys.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("m"))
    full = set_.unionByName(every).groupBy("word").agg(F.bit_or("m").alias("m"))
    rows = full.groupBy(F.floor(word / BLOCK).cast("bigint").alias("block")).agg(F.sort_array(F.collect_list(F.struct("word", "m"))).alias("w"))
    return rows.select("block", F.transform("w", lambda x: x["m"]).alias("bits"))


def probe(df: DataFrame, key: str, table: DataFrame, words: int, out: str = "maybe") -> DataFrame:
    """Adds boolean `out`: False proves that no key equals this one; null keys are False."""
    at, wanted = _word(F.col(key), words), _mask(F.col(key))
    hit = F.element_at("__bits", (at % BLOCK + 1).cast("int")).bitwiseAND(wanted) == wanted
    table = table.select(F.col("block").alias("__block"), F.col("bits").alias("__bits"))
    df = df.withColumn("__block", F.when(F.col(key).isNotNull(), F.floor(at / BLOCK).cast("bigint")))
    return df.join(F.broadcast(table), "__block", "left").withColumn(out, F.coalesce(hit, F.lit(False))).drop("__block", "__bits")
