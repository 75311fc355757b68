"""Queries p1, p2, p4, p6 over the wiki's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.canonical import canonical_sql, with_canonical
from loomgraph.functions.dates import utc_text
from loomgraph.operators import chunks, features, orphans, rolling
from loomgraph.runtime import cut
from loomgraph.sources.tables import WRITE_OPS, table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    pages, anchors, events = (table(spark, d, n) for n in ("kg_pages", "anchor_nodes", "usage_events"))
    refs = orphans.references(pages, "kg_pages").unionByName(orphans.references(anchors, "anchor_nodes"))
    return orphans.orphan_references(refs, orphans.parents([pages, anchors], events))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every reference to a page that is missing, deleted or younger than the reference."""
    return _orphans(spark, d).select("table_name", "ord", "field", "target", "kind").distinct()


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, field, month of `updated` and kind."""
    return orphans.orphan_counts(_orphans(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Events and latest instant per slug and event type."""
    state = features.features(table(spark, d, "usage_events"))
    return state.select("slug", "event_type", "n", utc_text(F.timestamp_millis("last_ms")).alias("last_ts"))


def p2_features(spark: SparkSession, d: str) -> DataFrame:
    """One row per slug: reads, writes, last instant, number of event types."""
    rows = features.feature_rows(features.features(table(spark, d, "usage_events")))
    return rows.select("slug", "reads", "writes", "last_ts", F.size("by_type").cast("bigint").alias("n_types"))


def p2_by_type(spark: SparkSession, d: str) -> DataFrame:
    """One row per slug: reads, writes, last instant, and for each event type its count and last instant."""
    return features.feature_rows(features.features(table(spark, d, "usage_events")))


def _edge_counts(spark: SparkSession, d: str) -> DataFrame:
    keys = with_canonical(table(spark, d, "edges").select("source"), "key", F.col("source")).select("key")
    return chunks.chunked_counts(keys, "key")


def _citing_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "kg_pages").select("slug", F.explode("sources").alias("raw"))
    rows = with_canonical(rows, "key", F.col("raw"), source=True).where(F.col("key").isNotNull() & F.col("slug").isNotNull())
    return chunks.chunked_counts(rows.select("key", "slug").distinct().select("key"), "key")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """Edges per source and citing pages per cited source."""
    both = _edge_counts(spark, d).select(F.lit("edges.source").alias("field"), "key", "n")
    return both.unionByName(_citing_pages(spark, d).select(F.lit("kg_pages.sources").alias("field"), "key", "n"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources with at least 1 % of the edges; sources at least three pages cite."""
    edges = cut(_edge_counts(spark, d), "edge_counts")
    total = edges.agg(F.sum("n")).first()[0] or 0
    heavy = edges.where(F.col("n") * 100 >= total).select(F.lit("edges.source").alias("field"), "key")
    return heavy.unionByName(_citing_pages(spark, d).where("n >= 3").select(F.lit("kg_pages.sources").alias("field"), "key"))


def _rolling(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "usage_events")
    first, last = events.agg(F.min("day"), F.max("day")).first()
    return rolling.rolling_totals(rolling.daily_reads(events), rolling.requested(table(spark, d, "usage_windows")), first, last)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Days without a read of a requested slug whose trailing window holds one."""
    quiet = _rolling(spark, d).where("reads = 0 AND total > 0")
    return quiet.select("slug", "window_days", F.date_format("day", "yyyy-MM-dd").alias("day"))


def p6_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals, averages and busiest day over every requested trailing window, for every day."""
    average = F.floor(F.col("average") * 1000 + 0.5) / 1000
    return _rolling(spark, d).select("slug", "window_days", F.date_format("day", "yyyy-MM-dd").alias("day"), "reads", "total", "active_days", "busiest", average.alias("average"))


QUERIES = {
    "p1_found": p1_found,
    "p1_counts": p1_counts,
    "p2_found": p2_found,
    "p2_features": p2_features,
    "p2_by_type": p2_by_type,
    "p4_found": p4_found,
    "p4_counts": p4_counts,
    "p6_found": p6_found,
    "p6_totals": p6_totals,
}

_DATE = r"'[0-9]{4}-[0-9]{2}-[0-9]{2}'"
_INSTANT = r"'[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{3})?(Z|[+-][0-9]{2}:[0-9]{2})'"
_OPS = ", ".join(f"'{x}'" for x in WRITE_OPS)
_EVENTS = f"""
log AS (SELECT DISTINCT * FROM usage_events),
ev AS (SELECT row_number() OVER () AS rid, op, slugs, actor, dry, ok, day, epoch_ms(try_cast(ts AS TIMESTAMPTZ)) AS ms
       FROM log WHERE op IS NOT NULL AND slugs IS NOT NULL AND regexp_full_match(ts, {_INSTANT}) AND try_cast(ts AS TIMESTAMPTZ) IS NOT NULL),
es AS (SELECT DISTINCT rid, op, actor, dry, ok, day, ms, {canonical_sql('s')} AS slug FROM (SELECT *, unnest(slugs) AS s FROM ev)),
el AS (SELECT * FROM es WHERE slug IS NOT NULL)"""
_UTC = "strftime(make_timestamp(max(ms) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


def _refs(t: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, ord, '{f}' AS field, updated, {e} AS raw FROM {t}"
        for f, e in (("related", "unnest(related).slug"), ("wikilink_targets", "unnest(wikilink_targets)"), ("superseded_by", "superseded_by"))
        if not (t == "anchor_nodes" and f == "wikilink_targets")
    )


_ORPHANS = f"""WITH {_EVENTS},
pages AS (SELECT slug, created FROM kg_pages UNION ALL SELECT slug, created FROM anchor_nodes),
born AS (SELECT slug, min(CASE WHEN regexp_full_match(created, {_DATE}) AND try_cast(created AS DATE) IS NOT NULL THEN created END) AS created FROM pages GROUP BY slug),
gone AS (SELECT DISTINCT slug FROM el WHERE op = 'delete_node' AND ok AND NOT coalesce(dry, false)),
refs AS (SELECT table_name, ord, field, CASE WHEN regexp_full_match(updated, {_DATE}) AND try_cast(updated AS DATE) IS NOT NULL THEN updated END AS updated,
         {canonical_sql('raw')} AS target FROM ({_refs('kg_pages')} UNION ALL {_refs('anchor_nodes')})),
judged AS (SELECT r.*, CASE WHEN b.slug IS NOT NULL THEN CASE WHEN r.updated < b.created THEN 'later' END WHEN g.slug IS NOT NULL THEN 'deleted' ELSE 'missing' END AS kind
           FROM refs r LEFT JOIN born b ON r.target = b.slug LEFT JOIN gone g ON r.target = g.slug WHERE r.target IS NOT NULL)
"""
_DAILY = f"""WITH {_EVENTS},
daily AS (SELECT slug, coalesce(day, CAST(make_timestamp(ms * 1000) AS DATE)) AS day, count(*) AS n FROM el WHERE op NOT IN ({_OPS}) GROUP BY 1, 2),
req AS (SELECT DISTINCT {canonical_sql('slug')} AS slug, CAST(window_days AS BIGINT) AS window_days FROM usage_windows WHERE window_days >= 1),
cal AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM usage_events),
roll AS (SELECT r.slug, r.window_days, c.day, coalesce(sum(n) FILTER (WHERE d.day = c.day), 0) AS reads, coalesce(sum(n), 0) AS total, count(n) AS active_days, coalesce(max(n), 0) AS busiest
         FROM req r CROSS JOIN cal c LEFT JOIN daily d ON d.slug = r.slug AND d.day <= c.day AND d.day > c.day - CAST(r.window_days AS INTEGER)
         WHERE r.slug IS NOT NULL GROUP BY ALL)
"""
_KEYS = f"""WITH ek AS (SELECT {canonical_sql('source')} AS key FROM edges),
sk AS (SELECT DISTINCT slug, {canonical_sql('s', source=True)} AS key FROM (SELECT slug, unnest(sources) AS s FROM kg_pages)),
counts AS (SELECT 'edges.source' AS field, key, count(*) AS n FROM ek WHERE key IS NOT NULL GROUP BY key
           UNION ALL SELECT 'kg_pages.sources', key, count(*) FROM sk WHERE key IS NOT NULL GROUP BY key)
"""

SQL = {
    "p1_found": _ORPHANS + "SELECT DISTINCT table_name, ord, field, target, kind FROM judged WHERE kind IS NOT NULL",
    "p1_counts": _ORPHANS
    + """, once AS (SELECT table_name, field, kind, ord, target, max(substr(updated, 1, 7)) AS month FROM judged WHERE kind IS NOT NULL GROUP BY ALL)
SELECT table_name, field, month, kind, count(*) AS n, count(DISTINCT ord) AS n_records FROM once GROUP BY ALL""",
    "p2_found": f"WITH {_EVENTS} SELECT slug, op || ':' || coalesce({canonical_sql('actor')}, 'lib') AS event_type, count(*) AS n, {_UTC} AS last_ts FROM el GROUP BY 1, 2",
    "p2_features": f"""WITH {_EVENTS} SELECT slug, count(*) FILTER (WHERE op NOT IN ({_OPS})) AS reads, count(*) FILTER (WHERE op IN ({_OPS})) AS writes, {_UTC} AS last_ts,
count(DISTINCT op || ':' || coalesce({canonical_sql('actor')}, 'lib')) AS n_types FROM el GROUP BY 1""",
    "p2_by_type": f"""WITH {_EVENTS}, per AS (SELECT slug, op || ':' || coalesce({canonical_sql('actor')}, 'lib') AS event_type, count(*) AS n, {_UTC} AS last_ts,
count(*) FILTER (WHERE op NOT IN ({_OPS})) AS reads, count(*) FILTER (WHERE op IN ({_OPS})) AS writes FROM el GROUP BY 1, 2)
SELECT slug, CAST(sum(reads) AS BIGINT) AS reads, CAST(sum(writes) AS BIGINT) AS writes, max(last_ts) AS last_ts,
list(struct_pack(event_type := event_type, n := n, last_ts := last_ts) ORDER BY event_type) AS by_type FROM per GROUP BY 1""",
    "p4_found": _KEYS + "SELECT field, key FROM counts WHERE field = 'edges.source' AND n * 100 >= (SELECT count(key) FROM ek) OR field = 'kg_pages.sources' AND n >= 3",
    "p4_counts": _KEYS + "SELECT field, key, n FROM counts",
    "p6_found": _DAILY + "SELECT slug, window_days, strftime(day, '%Y-%m-%d') AS day FROM roll WHERE reads = 0 AND total > 0",
    "p6_totals": _DAILY
    + """SELECT slug, window_days, strftime(day, '%Y-%m-%d') AS day, CAST(reads AS BIGINT) AS reads, CAST(total AS BIGINT) AS total, active_days, CAST(busiest AS BIGINT) AS busiest,
floor(CAST(total AS DOUBLE) / window_days * 1000 + 0.5) / 1000 AS average FROM roll""",
}
