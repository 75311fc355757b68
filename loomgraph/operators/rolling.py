"""Rolling aggregates over trailing days by a two-stack monoid queue (problem 6).

Events are first summed per entity and day, so an entity holds at most one row a day whatever its traffic. Requests then
meet their daily rows in sorted partitions, one pass over which keeps the active window of the current request as a queue of two
stacks. Any associative operation serves, invertible or not: total and count are sums, the busiest day is a maximum.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.canonical import with_canonical
from loomgraph.functions.dates import instant, utc_date
from loomgraph.operators.skew import Heavy, lookup_join
from loomgraph.runtime import cut, local
from loomgraph.sources.tables import WRITE_OPS, event_slugs, is_event


class TwoStackQueue:
    """First-in-first-out aggregate of (day, value) under an associative `op`, amortised constant time a step, no inverse needed."""

    def __init__(self, op, unit):
        self.op, self.unit = op, unit
        self.front: list = []  # (day, aggregate of this and all later front entries), next to leave on top
        self.back: list = []  # (day, value)
        self.back_sum = unit

    def push(self, day: int, value) -> None:
        self.back.append((day, value))
        self.back_sum = self.op(self.back_sum, value)

    def drop_before(self, day: int) -> None:
        while True:
            if not self.front:
                if not self.back or self.back[0][0] >= day:
                    return
                total = self.unit
                while self.back:
                    d, v = self.back.pop()
                    total = self.op(v, total)
                    self.front.append((d, total))
                self.back_sum = self.unit
            if self.front[-1][0] >= day:
                return
            self.front.pop()

    def value(self):
        return self.op(self.front[-1][1], self.back_sum) if self.front else self.back_sum


def combine(a: tuple, b: tuple) -> tuple:
    """(total, active days, busiest day's total)."""
    return a[0] + b[0], a[1] + b[1], max(a[2], b[2])


UNIT = (0, 0, 0)
#: Rows of the answer a task and a batch give.
ROWS_PER_TASK, ROWS_PER_BATCH = 100_000, 10_000
EPOCH = dt.date(1970, 1, 1)


def daily_reads(events: DataFrame) -> DataFrame:
    """(slug, day, n): distinct read events per slug and day; the day is the log's, or the instant's UTC date where that is null."""
    reads = events.where(is_event() & ~F.col("op").isin(WRITE_OPS)).dropDuplicates(["ts", "op", "slugs", "actor", "dry", "ok", "err", "day"])
    reads = reads.withColumn("__day", F.coalesce("day", utc_date(instant(F.col("ts")))))
    return event_slugs(reads, ["__day"]).groupBy("slug", F.col("__day").alias("day")).agg(F.count("*").alias("n"))


def requested(windows: DataFrame) -> DataFrame:
    """Distinct (slug, window_days) of the requests that name a slug and at least one day."""
    rows = with_canonical(windows, "slug", F.col("slug")).where(F.col("slug").isNotNull() & (F.col("window_days") >= 1))
    return rows.select("slug", F.col("window_days").cast("bigint").alias("window_days")).distinct()


def rolling_totals(daily: DataFrame, requests: DataFrame, first: dt.date | None, last: dt.date | None) -> DataFrame:
    """For every request and day from first to last: reads, total, active_days, busiest, average over the trailing window_days days.

    Days before `first` still fill the windows; slugs without reads give zero rows; first None (no day at all) gives no rows.
    """
    schema = "slug string, window_days bigint, day date, reads bigint, total bigint, active_days bigint, busiest bigint, average double"
    spark = requests.sparkSession
    if first is None or last is None:
        return local(spark, [], schema)
    lo, hi = (first - EPOCH).days, (last - EPOCH).days
    requests = cut(requests, "requests")
    # one row per slug and day: no key is heavy here; a slug may be asked for with many windows, though
    mine = lookup_join(daily, requests.select("slug").distinct(), "slug", "left_semi", heavy=Heavy())
    joined = lookup_join(requests, mine.select("slug", F.datediff("day", F.lit("1970-01-01").cast("date")).alias("d"), "n"), "slug")
    joined = joined.select("slug", "window_days", "d", "n")
    # as many tasks as the answer needs, not as its small input would get
    tasks = max(1, -(-requests.count() * (hi - lo + 1) // ROWS_PER_TASK))
    placed = joined.repartition(tasks, "slug", "window_days").sortWithinPartitions("slug", "window_days", "d")
    names = ["slug", "window_days", "d", "reads", "total", "active_days", "busiest"]

    def days(slug: str, window: int, rows: list[tuple[int, int]]) -> Iterator[tuple]:
        queue, i, end = TwoStackQueue(combine, UNIT), 0, len(rows)
        for day in range(lo, hi + 1):
            today = 0
            while i < end and rows[i][0] <= day:
                d, n = rows[i]
                queue.push(d, (n, 1, n))
                today = n if d == day else 0
                i += 1
            queue.drop_before(day - window + 1)
            yield (slug, window, day, today, *queue.value())

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        now, rows = None, []
        for pdf in batches:
            for slug, window, d, n in zip(pdf["slug"], pdf["window_days"], pdf["d"], pdf["n"]):
                if (slug, window) != now:
                    if now:
                        yield from days(*now, rows)
                    now, rows = (slug, window), []
                if d == d and d is not None:
                    rows.append((int(d), int(n)))
        if now:
            yield from days(*now, rows)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = groups(batches)
        while part := list(islice(out, ROWS_PER_BATCH)):
            yield pd.DataFrame(part, columns=names)

    out = placed.mapInPandas(scan, "slug string, window_days bigint, d int, reads bigint, total bigint, active_days bigint, busiest bigint")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.col("d")).alias("day")
    return out.select("slug", "window_days", day, "reads", "total", "active_days", "busiest", (F.col("total") / F.col("window_days").cast("double")).alias("average"))
