"""Strict dates and instants from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def real_date(col: Column) -> Column:
    """The text itself where it is a real date written YYYY-MM-DD, else null."""
    return F.when(col.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & F.try_to_date(col, "yyyy-MM-dd").isNotNull(), col)


#: A full date and time to the second, milliseconds optional, with Z or an hh:mm offset.
INSTANT = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{3})?(Z|[+-][0-9]{2}:[0-9]{2})\z"


def instant(col: Column) -> Column:
    """Timestamp of an INSTANT text, else null; independent of the session's zone."""
    return F.when(col.rlike(INSTANT), col.try_cast("timestamp"))


def utc_text(ts: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SS.mmmZ in UTC, whatever the session's zone."""
    ms = F.unix_millis(ts)
    whole = F.floor(ms / F.lit(1000)).cast("bigint")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(whole / F.lit(86400)).cast("int"))
    sec = F.pmod(whole, F.lit(86400))
    return F.concat(
        F.date_format(day, "yyyy-MM-dd"),
        F.format_string("T%02d:%02d:%02d.%03dZ", F.floor(sec / 3600), F.floor(sec / 60) % 60, sec % 60, F.pmod(ms, F.lit(1000))),
    )


def utc_date(ts: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_millis(ts) / F.lit(86_400_000)).cast("int"))
