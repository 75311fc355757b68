"""Per-entity features from events, kept up by signed deltas (problem 2).

State is one row per (slug, event_type): n, last_ms. A change is a row with sign +1 (insert) or -1 (retract). Counts
add up. A maximum only grows under inserts; a retraction forces it to be computed again from the remaining rows, but
only for those keys whose latest event it touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.canonical import with_canonical
from loomgraph.functions.dates import instant, utc_text
from loomgraph.operators.skew import lookup_join
from loomgraph.runtime import cut
from loomgraph.sources.tables import WRITE_OPS, event_slugs

LOG = ["ts", "op", "slugs", "actor", "dry", "ok", "err", "day"]
KEY = ["slug", "event_type"]
MAX_BROADCAST_KEYS = 10_000
MAX_BROADCAST_PRINTS = 500_000
STATE = "slug string, event_type string, n bigint, last_ms bigint"


def logged(events: DataFrame) -> list[str]:
    """The columns of a log that decide which rows are equal."""
    return [c for c in LOG if c in events.columns]


def print_of(events: DataFrame) -> Column:
    """A 64-bit hash of all columns that decide which rows are equal; equal rows have equal hashes, others may."""
    return F.xxhash64(*logged(events))


def keyed(events: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(slug, event_type, ms, pos, *keep) of every event row and slug it names, pos the slug's place among them; rows that are no events are left out."""
    keep = keep or []
    rows = events.where(F.col("op").isNotNull() & F.col("slugs").isNotNull()).withColumn("ms", F.unix_millis(instant(F.col("ts"))))
    # is_event() in two steps: a filter does not pass below the canonical form, so the instant is read once
    rows = with_canonical(rows, "__actor", F.col("actor")).where(F.col("ms").isNotNull())
    rows = rows.withColumn("event_type", F.concat("op", F.lit(":"), F.coalesce("__actor", F.lit("lib"))))
    return event_slugs(rows, ["event_type", "ms", *keep]).select("slug", "event_type", "ms", "pos", *keep)


def repeats(events: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """Retractions for rows delivered more than once: every such row once, with `surplus` deliveries to take back.

    again holds the hashes (__print) that occur more than once, few of them; without it they are counted first. Only rows of these hashes are
    then compared in full, so a clash of hashes retracts nothing. Few such hashes, counted first, are broadcast.
    """
    cols = logged(events)
    if again is None:
        again = cut(events.groupBy(print_of(events).alias("__print")).agg(F.count("*").alias("c")).where("c > 1").select("__print"), "prints")
    rows = events.select(*cols, print_of(events).alias("__print"))
    if again.count() <= MAX_BROADCAST_PRINTS:
        twice = rows.join(F.broadcast(again), "__print", "left_semi")
    else:
        twice = lookup_join(rows, again, "__print", "left_semi")
    return twice.groupBy(*cols).agg((F.count("*") - 1).alias("surplus")).where("surplus > 0")


def deltas(rows: DataFrame, sign: Column | int) -> DataFrame:
    """Signed deltas per key of keyed() rows: d_n, and the latest instant inserted and retracted."""
    rows = rows.withColumn("__sign", sign if isinstance(sign, Column) else F.lit(sign).cast("bigint"))
    return rows.groupBy(*KEY).agg(
        F.sum("__sign").alias("d_n"),
        F.max(F.when(F.col("__sign") > 0, F.col("ms"))).alias("ins_ms"),
        F.max(F.when(F.col("__sign") < 0, F.col("ms"))).alias("ret_ms"),
    )


def apply_deltas(state: DataFrame | None, delta: DataFrame, remaining) -> DataFrame:
    """The state after the deltas.

    remaining(touched) gives the keyed() rows still valid of the keys in `touched` (slug, event_type); it is called once
    and only where a retraction reaches a key's latest event. Keys whose count falls to 0 disappear.
    """
    if state is None:
        merged = delta.withColumn("n", F.col("d_n")).withColumn("old_ms", F.lit(None).cast("bigint"))
    else:
        merged = state.withColumnRenamed("last_ms", "old_ms").join(delta, KEY, "full_outer")
        merged = merged.withColumn("n", F.coalesce("n", F.lit(0)) + F.coalesce("d_n", F.lit(0)))
    merged = merged.where("n > 0").withColumn("top_ms", F.greatest("old_ms", "ins_ms"))
    touched = F.coalesce(F.col("ret_ms") >= F.col("top_ms"), F.lit(False))
    merged = merged.select(*KEY, "n", "top_ms", touched.alias("__touched"))
    if remaining is None:
        return merged.select(*KEY, "n", F.col("top_ms").alias("last_ms"))
    merged = cut(merged, "features")
    again = remaining(merged.where("__touched").select(*KEY)).groupBy(*KEY).agg(F.max("ms").alias("again_ms"))
    fixed = merged.where("__touched").join(again, KEY, "left").select(*KEY, "n", F.col("again_ms").alias("last_ms"))
    return merged.where("NOT __touched").select(*KEY, "n", F.col("top_ms").alias("last_ms")).unionByName(fixed)


def of_keys(rows: DataFrame, touched: DataFrame) -> DataFrame:
    """Keyed rows of the keys in touched (slug, event_type); few keys, counted first, are broadcast, many meet the rows by a salted join."""
    if touched.count() <= MAX_BROADCAST_KEYS:
        return rows.join(F.broadcast(touched), KEY, "left_semi")
    both = F.concat_ws("\0", *KEY)
    return lookup_join(rows.withColumn("__key", both), touched.select(both.alias("__key")), "__key", "left_semi").drop("__key")


def features(events: DataFrame) -> DataFrame:
    """(slug, event_type, n, last_ms) over the distinct events of a usage log.

    Every delivery is inserted; the surplus deliveries of a row that came again are then retracted. A log without repeats retracts nothing; an
    empty log gives no rows. Extra columns of the log are not looked at; LOG columns decide what is equal. The log is spelt out and keyed once; insertions,
    the search for repeats and recomputed maxima all read that table, and only rows that may be repeats are read from the log again.
    """
    named = events.select(*logged(events)).withColumn("__print", print_of(events))
    rows = cut(keyed(named, ["__print"]), "keyed")
    state = apply_deltas(None, deltas(rows, 1), None)
    # an event is in the table once for each slug it names; its first one stands for it
    again = cut(rows.where("pos = 0").groupBy("__print").agg(F.count("*").alias("c")).where("c > 1").select("__print"), "prints")
    surplus = cut(repeats(events, again), "surplus")
    back = keyed(surplus, ["surplus"])

    # a retracted delivery leaves its first one standing
    return apply_deltas(state, deltas(back, -F.col("surplus")), lambda touched: of_keys(rows, touched))


def feature_rows(state: DataFrame) -> DataFrame:
    """One row per slug: reads, writes, last_ts, and maps event type -> n and event type -> last instant.

    A slug has as many map entries as event types occur with it, some hundreds at most.
    """
    op = F.substring_index("event_type", ":", 1)
    write = op.isin(WRITE_OPS)
    entry = F.struct("event_type", "n", utc_text(F.timestamp_millis("last_ms")).alias("last_ts"))
    return (
        state.groupBy("slug")
        .agg(
            F.sum(F.when(~write, F.col("n")).otherwise(0)).alias("reads"),
            F.sum(F.when(write, F.col("n")).otherwise(0)).alias("writes"),
            F.max("last_ms").alias("last_ms"),
            F.sort_array(F.collect_list(entry)).alias("by_type"),
        )
        .select("slug", "reads", "writes", utc_text(F.timestamp_millis("last_ms")).alias("last_ts"), "by_type")
    )
