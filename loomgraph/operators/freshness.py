"""When facts are due for another look, and which pages may be purged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.dates import real_date
from loomgraph.runtime import local
from loomgraph.schema import CAP, DIVISOR, MONTH, WEEK


def _day(col: Column) -> Column:
    return real_date(col).cast("date")


def _filled(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def schedule(pages: DataFrame, today: str, upcoming: int = 30, ignore_updated: bool = False) -> DataFrame:
    """pages with clock, interval_days, next_due, overdue_days and bucket.

    The clock is `checked`, else `updated` (else `as_of` with ignore_updated). The interval grows with the age the fact had then: a week
    below a month, else age // DIVISOR, from WEEK to CAP days. Buckets: skipped_invalidated, skipped_dream, skipped_no_clock (no clock, or a date
    that is none), due, upcoming (within so many days), later. today must be a real date.
    """
    import datetime as dt

    dt.date.fromisoformat(today)
    second = "as_of" if ignore_updated else "updated"
    ref = F.coalesce(_filled("checked"), _filled(second))
    clock = F.when(_filled("checked").isNotNull(), "checked").when(_filled(second).isNotNull(), second)
    age = F.when(_filled("as_of").isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), F.datediff(_day(ref), _day(F.col("as_of")))))
    valid = _day(ref).isNotNull() & (_filled("as_of").isNull() | _day(F.col("as_of")).isNotNull())
    interval = F.when(F.col("__age") < MONTH, WEEK).otherwise(F.greatest(F.lit(WEEK), F.least(F.lit(CAP), F.floor(F.col("__age") / DIVISOR).cast("int"))))
    df = pages.withColumn("clock", F.when(valid, clock)).withColumn("__ref", F.when(valid, _day(ref))).withColumn("__age", F.when(valid, age))
    df = df.withColumn("interval_days", F.when(F.col("__age").isNotNull(), interval))
    df = df.withColumn("__due", F.date_add("__ref", F.col("interval_days"))).withColumn("overdue_days", F.datediff(F.lit(today).cast("date"), F.col("__due")))
    over = F.col("overdue_days")
    bucket = (
        F.when(F.col("status") == "invalidated", "skipped_invalidated")
        .when(F.col("type") == "dream", "skipped_dream")
        .when(F.col("clock").isNull(), "skipped_no_clock")
        .when(over >= 0, "due")
        .when(-over <= upcoming, "upcoming")
        .otherwise("later")
    )
    return df.withColumn("bucket", bucket).withColumn("next_due", F.date_format("__due", "yyyy-MM-dd")).drop("__ref", "__age", "__due")


def overdue(pages: DataFrame, today: str, ignore_updated: bool = False) -> DataFrame:
    """(slug, overdue_days) of what is due."""
    return schedule(pages, today, ignore_updated=ignore_updated).where("bucket = 'due'").select("slug", "overdue_days")


def due_first(scheduled: DataFrame) -> DataFrame:
    """What is due, longest overdue first."""
    return scheduled.where("bucket = 'due'").orderBy(F.desc("overdue_days"), "slug")


def soon_first(scheduled: DataFrame) -> DataFrame:
    """What is upcoming, soonest first."""
    return scheduled.where("bucket = 'upcoming'").orderBy("next_due", "slug")


def purge_candidates(pages: DataFrame, cutoff: str) -> DataFrame:
    """(slug, clock, clock_source): pages whose `checked`, else `as_of`, is before the cutoff as text; `updated` never counts."""
    clock = F.coalesce(_filled("checked"), _filled("as_of"))
    source = F.when(_filled("checked").isNotNull(), "checked").otherwise("as_of")
    return pages.where(clock < cutoff).select("slug", clock.alias("clock"), source.alias("clock_source"))


def purge_summary(pages: DataFrame, cutoff: str, slugs: list[str] | None = None) -> DataFrame:
    """One row: affected, kept, skipped_no_clock of a purge by date, or affected and not_found of a purge by slugs."""
    clock = F.coalesce(_filled("checked"), _filled("as_of"))
    if slugs is not None:
        wanted = local(pages.sparkSession, [(s,) for s in dict.fromkeys(slugs)], "slug string")
        hit = wanted.join(pages.select("slug", F.lit(1).alias("here")), "slug", "left")
        return hit.agg(F.count_if(F.col("here").isNotNull()).alias("affected"), F.count_if(F.col("here").isNull()).alias("not_found"))
    return pages.agg(F.count_if(clock < cutoff).alias("affected"), F.count_if(clock >= cutoff).alias("kept"), F.count_if(clock.isNull()).alias("skipped_no_clock"))
