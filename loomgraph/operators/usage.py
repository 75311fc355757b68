"""Statistics of the usage log: reads and writes per page, by actor, over the last days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.canonical import with_canonical
from loomgraph.sources.tables import WRITE_OPS, event_slugs


def window(log: DataFrame, today: str, days: int) -> DataFrame:
    """Rows of the log files of the last `days` days, today's included: a filter on `day`, so files partitioned by it are not opened."""
    last = dt.date.fromisoformat(today)
    return log.where(F.col("day").between(F.lit(last - dt.timedelta(days=max(1, days) - 1)), F.lit(last)))


def events(log: DataFrame, actor: str | None = None, exclude_actor: str | None = None) -> DataFrame:
    """Rows with an op; actor canonical, `lib` for none; deliveries of one row count once; failures and dry runs count."""
    rows = with_canonical(log.where(F.col("op").isNotNull()).distinct(), "actor", F.col("actor")).withColumn("actor", F.coalesce("actor", F.lit("lib")))
    if actor is not None:
        rows = rows.where(F.col("actor") == actor)
    if exclude_actor is not None:
        rows = rows.where(F.col("actor") != exclude_actor)
    return rows


def is_write() -> Column:
    return F.col("op").isin(WRITE_OPS)


def counts(rows: DataFrame) -> DataFrame:
    """(slug, reads, writes, total, last_ts): last_ts is the greatest ts as text."""
    flat = event_slugs(rows.where(F.col("slugs").isNotNull()), ["op", "ts"])
    per = flat.groupBy("slug").agg(F.count_if(~is_write()).alias("reads"), F.count_if(is_write()).alias("writes"), F.max("ts").alias("last_ts"))
    return per.select("slug", "reads", "writes", (F.col("reads") + F.col("writes")).alias("total"), "last_ts")


def by_actor(rows: DataFrame) -> DataFrame:
    """(slug, actor, n), the long form of a page's counts by actor."""
    return event_slugs(rows.where(F.col("slugs").isNotNull()), ["actor"]).groupBy("slug", "actor").agg(F.count("*").alias("n"))


def by_actor_map(rows: DataFrame) -> DataFrame:
    """(slug, by_actor map): actors are few."""
    return by_actor(rows).groupBy("slug").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("actor", "n")))).alias("by_actor"))


def with_universe(per: DataFrame, slugs: DataFrame) -> DataFrame:
    """per with a zero row for every slug of the universe that no event named; slugs outside it stay."""
    both = per.join(slugs.select("slug").distinct(), "slug", "full_outer")
    return both.select("slug", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("reads", "writes", "total")], "last_ts")


def top(per: DataFrame, n: int = 64) -> DataFrame:
    return per.orderBy(F.desc("total"), "slug").limit(n)


def bottom(per: DataFrame, n: int = 64) -> DataFrame:
    """The ranking of top() from its end."""
    return per.orderBy("total", F.desc("slug")).limit(n)


def totals(log: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: events, events without a target, and log days with any event (whoever acted)."""
    days = log.where(F.col("op").isNotNull()).agg(F.countDistinct("day").alias("days"))
    return rows.agg(F.count("*").alias("events"), F.count_if(F.col("slugs").isNull()).alias("interface_events")).join(F.broadcast(days), F.lit(True))
