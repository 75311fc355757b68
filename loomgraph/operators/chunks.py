"""Per-key results where a few keys hold most rows: exact offset chunking (problem 4).

Rows are counted per key and input partition, the counts are prefix-summed into offsets, every row of a heavy key gets its exact number within
its key, and chunks of equal size are processed as independent tasks whose ordered boundary states are merged at the end.
Only keys with more than one chunk need offsets and numbers; all other keys are one chunk each. Counting and numbering run in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.runtime import cut, partitions

#: More offsets than this are joined by a shuffle instead of a broadcast.
MAX_BROADCAST_ROWS = 500_000


class Placed:
    """Rows written down with their input partition (`__pid`) and place in it (`__at`), and the counts that follow.

    per_part: (key, __pid, n). per_key: (key, n). offsets: (key, __pid, __offset), the keys of more than one chunk alone, fewer than
    rows / chunk_rows keys.
    """

    def __init__(self, df: DataFrame, key: str, chunk_rows: int | None):
        row, seen = F.monotonically_increasing_id(), Observation()
        rows = df.where(F.col(key).isNotNull())
        place = [F.shiftright(row, 33).cast("int").alias("__pid"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")]
        self.rows = cut(rows.select(*[F.col(f"`{c}`") for c in rows.columns], *place), "placed", seen, F.count("*").alias("n"))
        self.key, n = key, seen.get.get("n") or 0
        self.chunk_rows = chunk_rows or max(1000, n // (4 * partitions(df.sparkSession)))
        self.per_part = cut(self.rows.groupBy(key, "__pid").agg(F.count("*").alias("n")), "counts")
        self.per_key = self.per_part.groupBy(key).agg(F.sum("n").alias("n"))
        heavy = self.per_key.where(F.col("n") > self.chunk_rows).select(key)
        before = Window.partitionBy(key).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
        some = self.per_part.join(heavy, key, "left_semi")
        self.offsets = cut(some.withColumn("__offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "offsets")
        self.small = self.offsets.count() <= MAX_BROADCAST_ROWS

    def with_offset(self, how: str) -> DataFrame:
        """The rows joined with their key's offset in their input partition; few offsets, counted first, are broadcast."""
        return self.rows.join(F.broadcast(self.offsets) if self.small else self.offsets, ["__pid", self.key], how)

    def heavy_rows(self) -> DataFrame:
        """Rows of the keys of more than one chunk, with `__row_no` and `__chunk`. A window holds one key's rows of one input partition."""
        place = F.row_number().over(Window.partitionBy(self.key, "__pid").orderBy("__at")) - 1
        rows = self.with_offset("inner").withColumn("__row_no", F.col("__offset") + place)
        return rows.withColumn("__chunk", F.floor(F.col("__row_no") / self.chunk_rows)).drop("__offset", "__at")


def numbered(df: DataFrame, key: str, chunk_rows: int | None = None) -> DataFrame:
    """df with `__pid`, `__row_no` and `__chunk`; null keys are left out, and no other column's name matters.

    The input order is that of the partitions (__pid) and of the rows in them; it is fixed by writing it down once. A key of more than one chunk has
    __row_no from 0 within the key and __chunk = __row_no // chunk_rows; a smaller key is chunk 0, and its __row_no counts within the partition. Sorting by
    (__pid, __row_no) gives the input order for both.
    chunk_rows defaults to a quarter of a task's fair share of the rows.
    """
    placed = Placed(df, key, chunk_rows)
    light = placed.with_offset("left").where(F.col("__offset").isNull()).drop("__offset").withColumnRenamed("__at", "__row_no").withColumn("__chunk", F.lit(0).cast("bigint"))
    return placed.heavy_rows().unionByName(light)


def chunked_counts(df: DataFrame, key: str, chunk_rows: int | None = None) -> DataFrame:
    """(key, n, n_chunks): rows per key, each chunk counted by itself and the chunks' states merged. A key of one chunk is its count per partition, summed up."""
    placed = Placed(df.select(key), key, chunk_rows)
    states = placed.heavy_rows().groupBy(key, "__chunk").agg(F.count("*").alias("n"))
    heavy = states.groupBy(key).agg(F.sum("n").alias("n"), F.count("*").alias("n_chunks"))
    light = placed.per_key.where(F.col("n") <= placed.chunk_rows).withColumn("n_chunks", F.lit(1).cast("bigint"))
    return heavy.unionByName(light)


def chunked_apply(df: DataFrame, key: str, state: Callable[[pd.DataFrame], dict], merge: Callable[[dict, dict], dict], schema: str, chunk_rows: int | None = None) -> DataFrame:
    """A result per key where order counts: state() reduces one chunk (rows in input order), merge() joins neighbours left to right.

    schema names the state's columns. A key's states reach one task together: one row per chunk, never its rows.
    """
    out = T._parse_datatype_string(schema)
    fields = [f.name for f in out.fields]
    keyed = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("__chunk", T.LongType()), *out.fields])
    rows = numbered(df, key, chunk_rows)

    def one(names, pdf: pd.DataFrame) -> pd.DataFrame:
        s = state(pdf.sort_values(["__pid", "__row_no"]))
        return pd.DataFrame([[names[0], names[1], *[s[f] for f in fields]]], columns=[key, "__chunk", *fields])

    def fold(names, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = pdf.sort_values("__chunk")[fields].to_dict("records")
        total = parts[0]
        for nxt in parts[1:]:
            total = merge(total, nxt)
        return pd.DataFrame([[names[0], *[total[f] for f in fields]]], columns=[key, *fields])

    states = rows.groupBy(key, "__chunk").applyInPandas(one, keyed)
    return states.groupBy(key).applyInPandas(fold, T.StructType([keyed[key], *out.fields]))
