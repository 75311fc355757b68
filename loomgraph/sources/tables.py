"""The tables of the wiki: pages, anchor pages, edges, usage log, requests, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.canonical import with_canonical_array
from loomgraph.functions.dates import instant


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Operations that change the wiki (fixed values); every other one is a read.
WRITE_OPS = ["add_node", "update_node", "rename_node", "delete_node", "rebuild_index", "add_edge", "remove_edge", "cleanup"]


def is_event() -> Column:
    """Rows of the usage log that are events: op, slugs and a full instant are there."""
    return F.col("op").isNotNull() & F.col("slugs").isNotNull() & instant(F.col("ts")).isNotNull()


def event_slugs(events: DataFrame, keep: list[str]) -> DataFrame:
    """One row per event row and canonical slug it names: `keep` columns, pos, slug. A slug named twice by one row counts once."""
    wide = with_canonical_array(events, "__slugs", F.col("slugs"))
    return wide.select(*keep, F.posexplode("__slugs").alias("pos", "slug"))
