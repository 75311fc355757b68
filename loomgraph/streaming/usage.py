"""The usage log as a stream: daily counts with late data, and features kept up batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.dates import instant
from loomgraph.operators import features
from loomgraph.runtime import children, free_shuffles, remove
from loomgraph.schema import RETENTION_DAYS
from loomgraph.sources.tables import WRITE_OPS, event_slugs, is_event
from loomgraph.sources.usage_log import _file_day, parse_lines


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """New lines of the day files as they come; a file is taken once, so the writer must move finished files in."""
    lines = spark.readStream.format("text").option("pathGlobFilter", "*.jsonl").load(folder)
    return parse_lines(lines.select("value", "_metadata"), _file_day())


def daily(log: DataFrame, late: str = f"{RETENTION_DAYS} days") -> DataFrame:
    """(day, slug, reads, writes) by the event's own UTC day; works on a stream (watermark on the instant) and on a table. Repeated rows count once."""
    rows = log.where(is_event()).withColumn("at", instant(F.col("ts")))
    if log.isStreaming:
        rows = rows.withWatermark("at", late)
    rows = rows.dropDuplicates([*features.logged(log), "at"])  # the instant is part of the key, so that the watermark ends a stream's memory
    flat = event_slugs(rows, ["at", "op"])
    write = F.col("op").isin(WRITE_OPS)
    per = flat.groupBy(F.window("at", "1 day").alias("w"), "slug").agg(F.count_if(~write).alias("reads"), F.count_if(write).alias("writes"))
    return per.select(F.to_date(F.col("w.start")).alias("day"), "slug", "reads", "writes")


class FeatureTable:
    """The per-entity feature state under a folder, advanced by foreachBatch: every batch is signed deltas added to the newest version.

    `rows` holds the distinct rows so far. A row delivered again, in one batch or in a later one, would be inserted and retracted by the same batch: the two cancel
    before they are summed, so only rows not seen before are keyed. Its first delivery stands, so no maximum falls. Versions are written whole and named by batch, so a batch run again after a failure
    writes the same; of the versions the last KEEP are kept. The folder may be on any file system that Spark can use.
    """

    KEEP = 3
    #: A batch meets the rows so far in so many passes, each over its own share of their hashes, so that no more than that share of them is in shuffle files at a time.
    PASSES = 4

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _found(self, before: int | None = None) -> list[int]:
        """Batches whose version is complete, oldest first."""
        found = sorted(int(n) for n in children(self.spark, self.folder) if n.isdigit())
        return [n for n in found if (before is None or n < before) and "_SUCCESS" in children(self.spark, f"{self.folder}/{n}")]

    def latest(self) -> int:
        return max(self._found(), default=-1)

    def version(self, before: int | None = None) -> DataFrame | None:
        found = self._found(before)
        return self.spark.read.schema(features.STATE).parquet(f"{self.folder}/{found[-1]}") if found else None

    def _seen(self, before: int, schema) -> DataFrame | None:
        paths = [f"{self.folder}/rows/{n}" for n in children(self.spark, f"{self.folder}/rows") if n.isdigit() and int(n) < before]
        return self.spark.read.schema(schema).parquet(*paths) if paths else None

    def advance(self, batch: DataFrame, batch_id: int) -> None:
        """Add a batch of log rows as version batch_id."""
        rows = batch.select(*features.logged(batch))
        seen, path = self._seen(batch_id, rows.schema), f"{self.folder}/rows/{batch_id}"
        # compared in full, both sides in one shuffle; equal deliveries are one before it
        both = rows.withColumn("__again", F.lit(0))
        if seen is not None:
            both = both.unionByName(seen.withColumn("__again", F.lit(1)))
        passes = 1 if seen is None else self.PASSES
        for k in range(passes):
            some = both if passes == 1 else both.where(F.pmod(features.print_of(both), F.lit(passes)) == k)
            new = some.groupBy(*rows.columns).agg(F.max("__again").alias("__again")).where("__again = 0").select(*rows.columns)
            new.write.option("compression", "zstd").mode("append" if k else "overwrite").parquet(path)
            free_shuffles(self.spark)
        state, fresh = self.version(before=batch_id), self.spark.read.schema(rows.schema).parquet(path)
        if state is None or not fresh.isEmpty():
            state = features.apply_deltas(state, features.deltas(features.keyed(fresh), 1), None)
        state.write.option("compression", "zstd").mode("overwrite").parquet(f"{self.folder}/{batch_id}")
        free_shuffles(self.spark)
        for n in self._found(batch_id)[: -self.KEEP + 1]:
            remove(self.spark, f"{self.folder}/{n}")

    def start(self, log: DataFrame, checkpoint: str):
        return log.writeStream.foreachBatch(self.advance).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
