"""Queries of the graph, metrics, scheduling, usage and scoring operators over the wiki's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.functions.canonical import canonical_sql, width_sql, with_canonical
from loomgraph.operators import dml, freshness, graph, metrics, scoring, usage, walk
from loomgraph.operators import pages as P
from loomgraph.schema import KNOWN_TYPES, Tuning
from loomgraph.sources.tables import WRITE_OPS, table
from loomgraph.streaming.usage import daily

CENTER = "semiconductor-cycle"
TODAY = "2025-07-01"
LAST_DAY = "2025-06-30"
SINCE = "2024-06-01"
THEME = "Copper 半导体"


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return P.nodes(table(spark, d, "kg_pages"), table(spark, d, "anchor_nodes"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.from_table(table(spark, d, "edges"))


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "usage_events")


def _used(s: SparkSession, d: str, days: int = 30) -> DataFrame:
    return usage.counts(usage.events(usage.window(_log(s, d), LAST_DAY, days), exclude_actor="dream"))


def _salience(s: SparkSession, d: str) -> DataFrame:
    n = _nodes(s, d)
    return scoring.salience(n, _edges(s, d), _used(s, d), freshness.overdue(n, TODAY, ignore_updated=True), TODAY)


def _listing(rows: DataFrame, take) -> DataFrame:
    """(path, mtime, size): every slug's file at its first (take = F.min) or last (F.max) scan, with the scan as its time and, as the tables hold no texts, the title's bytes as its size."""
    seen = rows.select("slug", F.struct(F.col("ord").alias("mtime"), "path", F.octet_length("title").alias("size")).alias("s")).groupBy("slug").agg(take("s").alias("s"))
    return seen.groupBy(F.col("s.path").alias("path")).agg(F.max(F.struct("s.mtime", "s.size")).alias("t")).select("path", "t.mtime", "t.size")


def _changed_both_ways(s: SparkSession, d: str) -> DataFrame:
    """From the first scan of kg_pages to the last one of all pages: moved pages are gone at one path and added at another, anchors are added."""
    cols = ["slug", "ord", "path", "title"]
    pages = table(s, d, "kg_pages").select(*cols)
    return P.changed_files(_listing(pages, F.min), _listing(pages.unionByName(table(s, d, "anchor_nodes").select(*cols)), F.max))


def _doc_links(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").where(F.contains("text", F.lit("[[")))
    return rows.select("doc_id", F.posexplode(X.wikilinks(F.col("text"))).alias("pos", "target"))


def _deg(s: SparkSession, d: str) -> DataFrame:
    return graph.degree_table(_nodes(s, d), _edges(s, d))


def _comp(s: SparkSession, d: str) -> DataFrame:
    n = _nodes(s, d)
    return graph.components(n, _edges(s, d))


def _pressure(s: SparkSession, d: str) -> DataFrame:
    n = _nodes(s, d)
    return scoring.pressure(n, freshness.overdue(n, TODAY).count(), TODAY, SINCE)


def _overdue_sum(df: DataFrame) -> DataFrame:
    return df.groupBy("bucket", "clock").agg(F.count("*").alias("n"), F.sum("interval_days").alias("intervals"), F.sum("overdue_days").alias("overdue"))


def _events(s, d, **kw):
    return usage.events(_log(s, d), **kw)


QUERIES = {
    "stats_types": lambda s, d: metrics.type_counts(_nodes(s, d)).select("type", "n"),
    "stats_totals": lambda s, d: _nodes(s, d).agg(F.count("*").alias("nodes")).join(F.broadcast(_edges(s, d).agg(F.count("*").alias("edges"))), F.lit(True)),
    "stats_top_tags": lambda s, d: P.ranked(P.value_counts(_nodes(s, d), "tags"), "n", 20).select(F.col("value").alias("tag"), "n"),
    "stats_neighborhoods": lambda s, d: P.ranked(graph.degrees(_edges(s, d)), "total", 10).select("slug", "total"),
    "edges_built": lambda s, d: graph.build(_nodes(s, d)).select("source", "target", F.array_join("origins", ",").alias("origins"), "relation"),
    "edges_dangling": lambda s, d: graph.dangling(_nodes(s, d)).select("source", "target", "origin"),
    "edges_both_carriers": lambda s, d: graph.build(_nodes(s, d)).where(F.size("origins") == 2).select("source", "target"),
    "edges_table": lambda s, d: _edges(s, d).select("source", "target", F.array_join("origins", ",").alias("origins"), "relation"),
    "degree_table": lambda s, d: _deg(s, d).select("slug", "n_in", "n_out", "total"),
    "degree_stats": lambda s, d: metrics.degree_stats(_deg(s, d)),
    "hubs": lambda s, d: metrics.hubs(_deg(s, d)),
    "isolated": lambda s, d: _deg(s, d).where("total = 0").select("slug"),
    "components": _comp,
    "component_summary": lambda s, d: metrics.component_summary(_comp(s, d)),
    "small_components": lambda s, d: metrics.small_components(_comp(s, d)).select("component", "n", F.array_join("slugs", ",").alias("slugs")),
    "bfs_k1": lambda s, d: graph.neighbourhood(_edges(s, d), CENTER, 1),
    "bfs_k2": lambda s, d: graph.neighbourhood(_edges(s, d), CENTER, 2),
    "bfs_k3": lambda s, d: graph.neighbourhood(_edges(s, d), CENTER, 3),
    "subgraph_center": lambda s, d: graph.induced(_edges(s, d), graph.read_nodes(_nodes(s, d), _edges(s, d), center=CENTER, k=1)).select("source", "target"),
    "edges_in_out": lambda s, d: graph.in_out(_edges(s, d), CENTER).select("source", "target", "relation", "direction"),
    "edges_depth": lambda s, d: graph.tree_edges(_edges(s, d), CENTER, 2),
    "read_type": lambda s, d: graph.read_nodes(_nodes(s, d), type="concept").select("slug"),
    "read_tag": lambda s, d: graph.read_nodes(_nodes(s, d), tag="AI").select("slug"),
    "read_query": lambda s, d: graph.read_nodes(_nodes(s, d), query="Copper").select("slug", "title"),
    "read_combo": lambda s, d: graph.read_nodes(_nodes(s, d), _edges(s, d), center=CENTER, k=2, type="entity", tag="cloud", query="a").select("slug"),
    "get_node": lambda s, d: _nodes(s, d).where(F.col("slug") == CENTER).select("slug", "title", "type", "created", "updated", "path"),
    "source_index": lambda s, d: metrics.source_index(_nodes(s, d)).select("source", "n"),
    "source_top": lambda s, d: P.ranked(metrics.source_index(_nodes(s, d)), "n", 10).select("source", "n"),
    "source_dup_clusters": lambda s, d: metrics.duplicate_clusters(_nodes(s, d)).select(F.array_join("sources", "|").alias("sources"), "n", "first_slug", "last_slug"),
    "source_over_extracted": lambda s, d: metrics.over_extracted(_nodes(s, d)).select("source", "n"),
    "source_coverage": lambda s, d: metrics.source_coverage(_nodes(s, d)),
    "type_matrix": lambda s, d: metrics.type_matrix(_nodes(s, d), _edges(s, d)),
    "type_balance": lambda s, d: metrics.type_balance(_nodes(s, d)),
    "type_empty": lambda s, d: metrics.empty_types(_nodes(s, d)),
    "type_dominant": lambda s, d: metrics.type_balance(_nodes(s, d)).limit(1),
    "freshness_all": lambda s, d: freshness.schedule(_nodes(s, d), TODAY).select("slug", "bucket", "clock", "interval_days", "next_due", "overdue_days"),
    "freshness_due": lambda s, d: freshness.due_first(freshness.schedule(_nodes(s, d), TODAY)).select("slug", "overdue_days"),
    "freshness_upcoming": lambda s, d: freshness.soon_first(freshness.schedule(_nodes(s, d), TODAY)).select("slug", "next_due"),
    "freshness_skipped": lambda s, d: _overdue_sum(freshness.schedule(_nodes(s, d), TODAY)),
    "freshness_neglect": lambda s, d: _overdue_sum(freshness.schedule(_nodes(s, d), TODAY, ignore_updated=True)),
    "purge_candidates": lambda s, d: freshness.purge_candidates(_nodes(s, d), "2024-06-01"),
    "purge_summary": lambda s, d: freshness.purge_summary(_nodes(s, d), "2024-06-01"),
    "usage_counts": lambda s, d: usage.counts(_events(s, d)),
    "usage_by_actor": lambda s, d: usage.by_actor(_events(s, d)),
    "usage_top": lambda s, d: usage.top(usage.with_universe(usage.counts(_events(s, d)), _nodes(s, d))).select("slug", "total"),
    "usage_bottom": lambda s, d: usage.bottom(usage.with_universe(usage.counts(_events(s, d)), _nodes(s, d))).select("slug", "total"),
    "usage_window7": lambda s, d: usage.with_universe(usage.counts(usage.events(usage.window(_log(s, d), LAST_DAY, 7))), _nodes(s, d)).select("slug", "reads", "writes"),
    "usage_totals": lambda s, d: usage.totals(_log(s, d), _events(s, d)),
    "usage_exclude_actor": lambda s, d: usage.counts(_events(s, d, exclude_actor="dream")).select("slug", "total"),
    "usage_daily": lambda s, d: daily(_log(s, d)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "slug", "reads", "writes"),
    "pressure": _pressure,
    "salience": lambda s, d: scoring.by_score(_salience(s, d)).select("slug", "score", "used", "n_in", "overdue_days"),
    "forgettability": lambda s, d: scoring.forgettability(_salience(s, d)).select("slug", "forget_score"),
    "forget_candidates": lambda s, d: scoring.forget_candidates(_salience(s, d)).select("slug", "forget_score"),
    "threads": lambda s, d: scoring.threads(_nodes(s, d)),
    "theme_match": lambda s, d: scoring.theme_match(_nodes(s, d), THEME).select("n", F.array_join("slugs", ",").alias("slugs"), "has_purchase"),
    "scenes": lambda s, d: walk.walk(_salience(s, d), _edges(s, d), "20250701"),
    "wikilinks_extracted": _doc_links,
    "slugify": lambda s, d: X.with_slug(table(s, d, "kg_pages").select("ord", "title").distinct(), "made", F.col("title")).select("ord", "made"),
    "type_infer": lambda s, d: with_canonical(table(s, d, "kg_pages"), "t", F.col("type")).select("slug", "ord", P.infer_type(F.col("t"), F.col("path")).alias("type")).distinct(),
    "related_normalized": lambda s, d: P.related(P.latest(table(s, d, "kg_pages"))).select("slug", "target", "relation", "pos"),
    "rename_cascade": lambda s, d: dml.rename(_nodes(s, d), CENTER, "chip-cycle", TODAY).select("slug", "new_slug", "new_path", "updated"),
    "delete_cascade": lambda s, d: dml.delete(_nodes(s, d), CENTER).select("slug", "action", F.size("related").cast("bigint").alias("n_related")),
    "index_lines": lambda s, d: dml.index_lines(_nodes(s, d)).select(F.col("place").cast("bigint").alias("place"), "heading", "slug", "line"),
    "scan_changed_files": lambda s, d: P.changed_files(
        table(s, d, "kg_pages").groupBy("path").agg(F.min("ord").alias("mtime"), F.lit(1).alias("size")),
        table(s, d, "kg_pages").groupBy("path").agg(F.max("ord").alias("mtime"), F.lit(1).alias("size")),
    ),
    "scan_changed_both_ways": _changed_both_ways,
}

# ---- SQL ----

_OPS = ", ".join(f"'{x}'" for x in WRITE_OPS)
_KNOWN = "[" + ", ".join(f"'{t}'" for t in KNOWN_TYPES) + "]"
_INFER = """coalesce({c}, CASE WHEN regexp_matches(path, '/') THEN CASE regexp_extract(path, '([^/]*)/[^/]*$', 1) WHEN 'wiki' THEN 'overview' WHEN 'entities' THEN 'entity' WHEN 'concepts' THEN 'concept'
WHEN 'sources' THEN 'source' WHEN 'queries' THEN 'query' WHEN 'comparisons' THEN 'comparison' WHEN 'synthesis' THEN 'synthesis' WHEN 'dreams' THEN 'dream' END END, 'unknown')"""
_BASE = f"""WITH RECURSIVE allpages AS (SELECT * FROM kg_pages UNION ALL BY NAME SELECT * FROM anchor_nodes),
latest AS (SELECT * FROM allpages WHERE slug IS NOT NULL QUALIFY row_number() OVER (PARTITION BY slug ORDER BY ord DESC) = 1),
typed AS (SELECT *, {canonical_sql('type')} AS ct FROM latest),
nodes AS (SELECT * REPLACE ({_INFER.format(c='ct')} AS type, CASE WHEN lower(trim(compression)) IN ('active', 'condensed', 'skeleton') THEN lower(trim(compression)) END AS compression) FROM typed),
tg AS (SELECT slug, ord, v, min(pos) AS pos FROM (SELECT slug, ord, generate_subscripts(tags, 1) AS pos, {canonical_sql('x')} AS v FROM (SELECT slug, ord, tags, unnest(tags) AS x, generate_subscripts(tags, 1) FROM nodes)) WHERE v IS NOT NULL GROUP BY 1, 2, 3),
"""


def _long(name: str, field: str, source: bool = False) -> str:
    """Distinct canonical elements of an array column, numbered in order of first appearance."""
    return f"""{name} AS (SELECT slug, ord, v, row_number() OVER (PARTITION BY slug ORDER BY p) - 1 AS pos FROM (SELECT slug, ord, v, min(p) AS p FROM
(SELECT slug, ord, p, {canonical_sql('x', source)} AS v FROM (SELECT slug, ord, unnest({field}) AS x, generate_subscripts({field}, 1) AS p FROM nodes)) WHERE v IS NOT NULL GROUP BY 1, 2, 3))"""


_BASE = _BASE[: _BASE.index("tg AS")] + ",\n".join(
    [
        _long("tags_", "tags"),
        _long("srcs", "sources", True),
        _long("wl", "wikilink_targets"),
        f"rel AS (SELECT slug, ord, p - 1 AS pos, {canonical_sql('x.slug')} AS target, {canonical_sql('x.relation')} AS relation FROM (SELECT slug, ord, unnest(related) AS x, generate_subscripts(related, 1) AS p FROM nodes))",
        "rels AS (SELECT * FROM rel WHERE target IS NOT NULL)",
        "links AS (SELECT slug AS source, v AS target, 'wikilink' AS origin, CAST(NULL AS VARCHAR) AS relation, {'o': ord, 'k': 0, 'p': pos} AS seen FROM wl UNION ALL SELECT slug, target, 'related', relation, {'o': ord, 'k': 1, 'p': pos} FROM rels)",
        """built AS (SELECT source, target, string_agg(origin, ',' ORDER BY seen) AS origins, arg_min(relation, rseen) FILTER (WHERE relation IS NOT NULL) AS relation, count(*) AS k FROM
(SELECT source, target, origin, min(seen) AS seen, arg_min(relation, seen) FILTER (WHERE relation IS NOT NULL) AS relation, min(seen) FILTER (WHERE relation IS NOT NULL) AS rseen FROM links SEMI JOIN nodes ON target = nodes.slug GROUP BY 1, 2, 3) GROUP BY 1, 2)""",
        f"e0 AS (SELECT {canonical_sql('source')} AS source, {canonical_sql('target')} AS target, {canonical_sql('relation')} AS relation, ord, origins FROM edges)",
        """et AS (SELECT source, target, arg_min(relation, ord) FILTER (WHERE relation IS NOT NULL) AS relation, min(ord) AS ord, list_sort(list_distinct(flatten(list(coalesce(origins, []))))) AS origins
FROM e0 WHERE source IS NOT NULL AND target IS NOT NULL GROUP BY 1, 2)""",
        "ends AS (SELECT source AS slug, 0 AS i, 1 AS o, ord * 2 AS seen FROM et UNION ALL SELECT target, 1, 0, ord * 2 + 1 FROM et)",
        "dg AS (SELECT slug, sum(i) AS n_in, sum(o) AS n_out, count(*) AS total, min(seen) AS seen FROM ends GROUP BY 1)",
        "deg AS (SELECT n.slug, n.ord, coalesce(n_in, 0)::BIGINT AS n_in, coalesce(n_out, 0)::BIGINT AS n_out, coalesce(total, 0)::BIGINT AS total FROM nodes n LEFT JOIN dg USING (slug))",
        "adj AS (SELECT source AS a, target AS b FROM et UNION SELECT target, source FROM et)",
        f"bfs AS (SELECT '{CENTER}' AS slug, 0 AS depth UNION SELECT b, depth + 1 FROM bfs JOIN adj ON a = slug WHERE depth < 3)",
        "hop AS (SELECT slug, min(depth) AS depth FROM bfs GROUP BY 1)",
        f"""lg AS (SELECT DISTINCT * FROM usage_events WHERE op IS NOT NULL),
ev AS (SELECT row_number() OVER () AS rid, op, slugs, day, ts, coalesce({canonical_sql('actor')}, 'lib') AS actor FROM lg),
el AS (SELECT DISTINCT rid, op, actor, day, ts, {canonical_sql('s')} AS slug FROM (SELECT *, unnest(slugs) AS s FROM ev)),
us AS (SELECT * FROM el WHERE slug IS NOT NULL)""",
        f"uc AS (SELECT slug, count(*) FILTER (WHERE op NOT IN ({_OPS})) AS reads, count(*) FILTER (WHERE op IN ({_OPS})) AS writes, count(*) AS total, max(ts) AS last_ts FROM us GROUP BY 1)",
        "uz AS (SELECT coalesce(u.slug, n.slug) AS slug, coalesce(total, 0) AS total FROM uc u FULL JOIN nodes n ON u.slug = n.slug)",
    ]
) + "\n"

_DATE = "CASE WHEN regexp_full_match({0}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast({0} AS DATE) END"


def _fresh(second: str) -> str:
    ref, as_of = f"coalesce(nullif(checked, ''), nullif({second}, ''))", "nullif(as_of, '')"
    return f""", f1 AS (SELECT *, {ref} AS rf, {as_of} AS ao, CASE WHEN nullif(checked, '') IS NOT NULL THEN 'checked' WHEN nullif({second}, '') IS NOT NULL THEN '{second}' END AS c0 FROM nodes),
f2 AS (SELECT *, {_DATE.format('rf')} AS rd, {_DATE.format('ao')} AS ad FROM f1),
f3 AS (SELECT *, rd IS NOT NULL AND (ao IS NULL OR ad IS NOT NULL) AS ok, CASE WHEN ao IS NULL THEN 0 ELSE greatest(0, date_diff('day', ad, rd)) END AS age FROM f2),
f4 AS (SELECT *, CASE WHEN ok THEN c0 END AS clock, CASE WHEN ok THEN CASE WHEN age < 30 THEN 7 ELSE greatest(7, least(1095, age // 12)) END END AS interval_days FROM f3),
f5 AS (SELECT *, CAST(CASE WHEN ok THEN rd + CAST(interval_days AS INTEGER) END AS DATE) AS due FROM f4),
f6 AS (SELECT *, date_diff('day', due, DATE '{TODAY}') AS overdue_days FROM f5),
fr AS (SELECT *, strftime(due, '%Y-%m-%d') AS next_due, CASE WHEN status = 'invalidated' THEN 'skipped_invalidated' WHEN type = 'dream' THEN 'skipped_dream' WHEN clock IS NULL THEN 'skipped_no_clock'
WHEN overdue_days >= 0 THEN 'due' WHEN -overdue_days <= 30 THEN 'upcoming' ELSE 'later' END AS bucket FROM f6)
"""


_SUMS = "SELECT bucket, clock, count(*) AS n, CAST(sum(interval_days) AS BIGINT) AS intervals, CAST(sum(overdue_days) AS BIGINT) AS overdue FROM fr GROUP BY 1, 2"
_STATS = """st AS (SELECT count(*) AS n, floor(avg(total) * 100 + 0.5) / 100 AS mean, floor(quantile_cont(total, 0.5) * 100 + 0.5) / 100 AS median, floor(stddev_pop(total) * 100 + 0.5) / 100 AS std,
CAST(quantile_disc(total, 0.95) AS BIGINT) AS p95, max(total) AS max, count(*) FILTER (WHERE total = 0) AS isolated FROM deg)"""
_SAL = (
    _fresh("as_of")
    + f""", u30 AS (SELECT slug, count(*) AS used FROM us WHERE actor <> 'dream' AND day BETWEEN DATE '{LAST_DAY}' - 29 AND DATE '{LAST_DAY}' GROUP BY 1),
raw AS (SELECT n.slug, n.type, n.compression, coalesce(used, 0) AS used, coalesce(n_in, 0)::BIGINT AS n_in, coalesce(CASE WHEN fr.bucket = 'due' THEN fr.overdue_days END, 0) AS overdue_days,
CASE WHEN nullif(n.checked, '') IS NOT NULL THEN coalesce(greatest(0, date_diff('day', {_DATE.format('n.checked')}, DATE '{TODAY}')), 0) END AS unchecked
FROM nodes n LEFT JOIN u30 USING (slug) LEFT JOIN dg USING (slug) LEFT JOIN fr ON fr.slug = n.slug),
mx AS (SELECT greatest(1, max(used)) AS a, greatest(1, max(n_in)) AS b, greatest(1, max(overdue_days)) AS c, greatest(1, max(coalesce(unchecked, 0))) AS e FROM raw),
sal AS (SELECT raw.*, floor((0.35::DOUBLE * (used / a) + 0.25::DOUBLE * (n_in / b) + 0.2::DOUBLE * (overdue_days / c) + 0.2::DOUBLE * (coalesce(unchecked, e) / e))
* (CASE compression WHEN 'condensed' THEN 0.5::DOUBLE WHEN 'skeleton' THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END) * 100 + 0.5) / 100 AS score FROM raw, mx),
fg AS (SELECT sal.*, floor((0.35::DOUBLE * (1 / (1 + used)) + 0.3::DOUBLE * (1 - n_in / b) + 0.2::DOUBLE * least(1.0::DOUBLE, overdue_days / c)
+ 0.15::DOUBLE * (CASE compression WHEN 'skeleton' THEN 1.0::DOUBLE WHEN 'condensed' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)) * 1000 + 0.5) / 1000 AS forget_score FROM sal, mx)
"""
)
_HAY = "lower(concat_ws(' ', slug, title, (SELECT string_agg(v, ' ' ORDER BY pos) FROM tags_ t WHERE t.slug = nodes.slug)))"
_HYP = r"regexp_matches(coalesce(content, ''), '(?i)status:\s*hypothesis')"
_INSTANT = r"'[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{3})?(Z|[+-][0-9]{2}:[0-9]{2})'"
_CLOCK = "coalesce(nullif(checked, ''), nullif(as_of, ''))"

_REACH = """, adjn AS (SELECT a, b FROM adj SEMI JOIN nodes x ON a = x.slug SEMI JOIN nodes y ON b = y.slug),
reach AS (SELECT slug AS a, slug AS b FROM nodes UNION SELECT reach.a, adjn.b FROM reach JOIN adjn ON reach.b = adjn.a),
comp AS (SELECT a AS slug, min(b) AS component FROM reach GROUP BY 1), csize AS (SELECT component, count(*) AS n FROM comp GROUP BY 1)
"""

SQL = {
    "stats_types": _BASE + "SELECT type, count(*) AS n FROM nodes GROUP BY 1",
    "stats_totals": _BASE + "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM et) AS edges",
    "stats_top_tags": _BASE + "SELECT v AS tag, count(*) AS n FROM tags_ GROUP BY 1 ORDER BY n DESC, min({'o': ord, 'p': pos}) LIMIT 20",
    "stats_neighborhoods": _BASE + "SELECT slug, total FROM dg ORDER BY total DESC, seen LIMIT 10",
    "edges_built": _BASE + "SELECT source, target, origins, relation FROM built",
    "edges_dangling": _BASE + "SELECT source, target, origin FROM links ANTI JOIN nodes ON target = nodes.slug",
    "edges_both_carriers": _BASE + "SELECT source, target FROM built WHERE k = 2",
    "edges_table": _BASE + "SELECT source, target, array_to_string(list_filter(origins, lambda x: x IS NOT NULL), ',') AS origins, relation FROM et",
    "degree_table": _BASE + "SELECT slug, n_in, n_out, total FROM deg",
    "degree_stats": _BASE + f", {_STATS} SELECT * FROM st",
    "hubs": _BASE + f", {_STATS} SELECT slug, n_in, n_out, total FROM deg, st WHERE st.max > st.median AND CASE WHEN p95 < st.max THEN total > p95 ELSE total >= st.max END ORDER BY total DESC, ord LIMIT 20",
    "isolated": _BASE + "SELECT slug FROM deg WHERE total = 0",
    "components": _BASE + _REACH + "SELECT slug, component FROM comp",
    "component_summary": _BASE
    + _REACH
    + "SELECT count(*) AS components, max(n) AS largest, floor(max(n) / sum(n) * 100 + 0.5) / 100 AS ratio, floor((1 - max(n) / sum(n)) * 100 + 0.5) / 100 AS fragmentation FROM csize",
    "small_components": _BASE + _REACH + "SELECT component, n, (SELECT string_agg(slug, ',' ORDER BY slug) FROM comp WHERE comp.component = csize.component) AS slugs FROM csize WHERE n < 5",
    **{f"bfs_k{k}": _BASE + f"SELECT slug, depth FROM hop WHERE depth <= {k}" for k in (1, 2, 3)},
    "subgraph_center": _BASE + "SELECT source, target FROM et SEMI JOIN (SELECT slug FROM hop JOIN nodes USING (slug) WHERE depth <= 1) a ON source = a.slug SEMI JOIN (SELECT slug FROM hop JOIN nodes USING (slug) WHERE depth <= 1) b ON target = b.slug",
    "edges_in_out": _BASE + f"SELECT source, target, relation, 'inbound' AS direction FROM et WHERE target = '{CENTER}' UNION ALL SELECT source, target, relation, 'outbound' FROM et WHERE source = '{CENTER}'",
    "read_type": _BASE + "SELECT slug FROM nodes WHERE type = 'concept'",
    "read_tag": _BASE + "SELECT DISTINCT slug FROM tags_ WHERE lower(v) = 'ai'",
    "read_query": _BASE + "SELECT slug, title FROM nodes WHERE contains(lower(title), 'copper') OR contains(lower(slug), 'copper')",
    "read_combo": _BASE + "SELECT slug FROM nodes SEMI JOIN (SELECT slug FROM hop WHERE depth <= 2) h USING (slug) SEMI JOIN (SELECT slug FROM tags_ WHERE v = 'cloud') t USING (slug) WHERE type = 'entity' AND (contains(lower(title), 'a') OR contains(lower(slug), 'a'))",
    "get_node": _BASE + f"SELECT slug, title, type, created, updated, path FROM nodes WHERE slug = '{CENTER}'",
    "source_index": _BASE + "SELECT v AS source, count(*) AS n FROM srcs GROUP BY 1",
    "source_top": _BASE + "SELECT v AS source, count(*) AS n FROM srcs GROUP BY 1 ORDER BY n DESC, min({'o': ord, 'p': pos}) LIMIT 10",
    "source_dup_clusters": _BASE + "SELECT s AS sources, count(*) AS n, min(slug) AS first_slug, max(slug) AS last_slug FROM (SELECT slug, string_agg(v, '|' ORDER BY v) AS s FROM srcs GROUP BY 1) GROUP BY 1 HAVING count(*) >= 2",
    "source_over_extracted": _BASE + "SELECT v AS source, count(*) AS n FROM srcs GROUP BY 1 HAVING count(*) >= 3",
    "source_coverage": _BASE + "SELECT (SELECT count(DISTINCT slug) FROM srcs) AS with_sources, (SELECT count(*) FROM nodes) - (SELECT count(DISTINCT slug) FROM srcs) AS without_sources, (SELECT count(DISTINCT v) FROM srcs) AS unique_sources",
    "type_matrix": _BASE
    + f""", c AS (SELECT a.type AS source_type, b.type AS target_type, count(*) AS n FROM et JOIN nodes a ON a.slug = source JOIN nodes b ON b.slug = target GROUP BY 1, 2),
kn AS (SELECT t FROM (SELECT unnest({_KNOWN}) AS t) SEMI JOIN nodes ON t = nodes.type), dn AS (SELECT coalesce(c.source_type, x.t) AS source_type, coalesce(c.target_type, y.t) AS target_type, coalesce(n, 0) AS n FROM kn x CROSS JOIN kn y FULL JOIN c ON c.source_type = x.t AND c.target_type = y.t)
SELECT source_type, target_type, n, CASE WHEN sum(n) OVER (PARTITION BY source_type) > 0 THEN floor(n / sum(n) OVER (PARTITION BY source_type) * 1000 + 0.5) / 1000 ELSE 0.0::DOUBLE END AS ratio FROM dn""",
    "type_balance": _BASE + "SELECT type, count(*) AS n, floor(count(*) / (SELECT count(*) FROM nodes) * 1000 + 0.5) / 1000 AS ratio FROM nodes GROUP BY 1",
    "type_empty": _BASE + f"SELECT t AS type FROM (SELECT unnest({_KNOWN}) AS t) ANTI JOIN nodes ON t = nodes.type",
    "type_dominant": _BASE + "SELECT type, count(*) AS n, floor(count(*) / (SELECT count(*) FROM nodes) * 1000 + 0.5) / 1000 AS ratio FROM nodes GROUP BY 1 ORDER BY n DESC, type LIMIT 1",
    "freshness_all": _BASE + _fresh("updated") + "SELECT slug, bucket, clock, interval_days, next_due, overdue_days FROM fr",
    "freshness_due": _BASE + _fresh("updated") + "SELECT slug, overdue_days FROM fr WHERE bucket = 'due'",
    "freshness_upcoming": _BASE + _fresh("updated") + "SELECT slug, next_due FROM fr WHERE bucket = 'upcoming'",
    "freshness_skipped": _BASE + _fresh("updated") + _SUMS,
    "freshness_neglect": _BASE + _fresh("as_of") + _SUMS,
    "purge_candidates": _BASE + f"SELECT slug, {_CLOCK} AS clock, CASE WHEN nullif(checked, '') IS NOT NULL THEN 'checked' ELSE 'as_of' END AS clock_source FROM nodes WHERE {_CLOCK} < '2024-06-01'",
    "purge_summary": _BASE + f"SELECT count(*) FILTER (WHERE {_CLOCK} < '2024-06-01') AS affected, count(*) FILTER (WHERE {_CLOCK} >= '2024-06-01') AS kept, count(*) FILTER (WHERE {_CLOCK} IS NULL) AS skipped_no_clock FROM nodes",
    "usage_counts": _BASE + "SELECT * FROM uc",
    "usage_by_actor": _BASE + "SELECT slug, actor, count(*) AS n FROM us GROUP BY 1, 2",
    "usage_top": _BASE + "SELECT slug, total FROM uz ORDER BY total DESC, slug LIMIT 64",
    "usage_bottom": _BASE + "SELECT slug, total FROM uz ORDER BY total, slug DESC LIMIT 64",
    "usage_window7": _BASE
    + f", w AS (SELECT slug, count(*) FILTER (WHERE op NOT IN ({_OPS})) AS reads, count(*) FILTER (WHERE op IN ({_OPS})) AS writes FROM us WHERE day BETWEEN DATE '{LAST_DAY}' - 6 AND DATE '{LAST_DAY}' GROUP BY 1) SELECT coalesce(w.slug, n.slug) AS slug, coalesce(reads, 0) AS reads, coalesce(writes, 0) AS writes FROM w FULL JOIN nodes n ON n.slug = w.slug",
    "usage_totals": _BASE + "SELECT count(*) AS events, count(*) FILTER (WHERE slugs IS NULL) AS interface_events, count(DISTINCT day) AS days FROM ev",
    "usage_exclude_actor": _BASE + "SELECT slug, count(*) AS total FROM us WHERE actor <> 'dream' GROUP BY 1",
    "usage_daily": _BASE
    + f"SELECT strftime(make_timestamp(epoch_ms(try_cast(ts AS TIMESTAMPTZ)) * 1000), '%Y-%m-%d') AS day, slug, count(*) FILTER (WHERE op NOT IN ({_OPS})) AS reads, count(*) FILTER (WHERE op IN ({_OPS})) AS writes FROM us WHERE regexp_full_match(ts, {_INSTANT}) AND try_cast(ts AS TIMESTAMPTZ) IS NOT NULL GROUP BY 1, 2",
    "pressure": _BASE
    + _fresh("updated")
    + f""", own AS (SELECT * FROM nodes WHERE type <> 'dream'), p AS (SELECT unnest(['new', 'updated', 'hypotheses', 'contradictions', 'overdue', 'days']) AS component, unnest([1.0::DOUBLE, 0.5, 2.0, 3.0, 1.0, 1.0]) AS weight,
unnest([(SELECT count(*) FROM own WHERE created > '{SINCE}'), (SELECT count(*) FROM own WHERE updated > '{SINCE}' AND NOT coalesce(created > '{SINCE}', false) AND created IS NOT NULL), (SELECT count(*) FROM own WHERE {_HYP}),
(SELECT count(*) FROM rels SEMI JOIN own USING (slug) WHERE relation = 'contradicts'), (SELECT count(*) FROM fr WHERE bucket = 'due'), date_diff('day', DATE '{SINCE}', DATE '{TODAY}')]) AS n) SELECT component, n, weight, n * weight AS contribution FROM p""",
    "salience": _BASE + _SAL + "SELECT slug, score, used, n_in, overdue_days FROM sal",
    "forgettability": _BASE + _SAL + "SELECT slug, forget_score FROM fg",
    "forget_candidates": _BASE + _SAL + "SELECT slug, forget_score FROM fg WHERE type NOT IN ('source', 'overview', 'dream') AND used = 0 ORDER BY forget_score DESC, slug LIMIT 10",
    "threads": _BASE + f"SELECT 'hypothesis' AS kind, slug AS key FROM nodes WHERE {_HYP} UNION ALL SELECT 'contradicts', slug || '→' || target FROM rels WHERE relation = 'contradicts' UNION ALL SELECT 'needs-verification', slug FROM tags_ WHERE v = 'needs-verification'",
    "theme_match": _BASE
    + f", h AS (SELECT slug, ord FROM nodes WHERE contains({_HAY}, 'copper') OR contains({_HAY}, '半导') OR contains({_HAY}, '导体')) SELECT (SELECT count(*) FROM h) AS n, (SELECT string_agg(slug, ',' ORDER BY ord) FROM (SELECT * FROM h ORDER BY ord LIMIT 6)) AS slugs, (SELECT count(*) >= 2 FROM h) AS has_purchase",
    "slugify": rf"""SELECT ord, nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({width_sql('title')})), '\s+', '-', 'g'), '[^\p{{L}}\p{{N}}-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), '') AS made FROM (SELECT DISTINCT ord, title FROM kg_pages)""",
    "type_infer": f"SELECT DISTINCT slug, ord, {_INFER.format(c=canonical_sql('type'))} AS type FROM kg_pages",
    "related_normalized": f"SELECT slug, target, relation, p - 1 AS pos FROM (SELECT slug, {canonical_sql('x.slug')} AS target, {canonical_sql('x.relation')} AS relation, p FROM (SELECT slug, unnest(related) AS x, generate_subscripts(related, 1)::INTEGER AS p FROM (SELECT * FROM kg_pages QUALIFY row_number() OVER (PARTITION BY slug ORDER BY ord DESC) = 1))) WHERE target IS NOT NULL",
    "index_lines": _BASE
    + f"""SELECT CAST(CASE WHEN list_contains({_KNOWN}, type) THEN list_position({_KNOWN}, type) ELSE 9 END AS BIGINT) AS place, CASE type WHEN 'entity' THEN 'Entities' WHEN 'concept' THEN 'Concepts' WHEN 'source' THEN 'Sources' WHEN 'query' THEN 'Queries'
WHEN 'comparison' THEN 'Comparisons' WHEN 'synthesis' THEN 'Synthesis' WHEN 'dream' THEN 'Dreams' WHEN 'overview' THEN 'Overview' ELSE 'Other' END AS heading, slug, '- [[' || slug || ']] — ' || coalesce(title, '') AS line FROM nodes""",
    "scan_changed_files": "SELECT path, 'changed' AS change FROM kg_pages GROUP BY path HAVING min(ord) <> max(ord)",
    "scan_changed_both_ways": """WITH f AS (SELECT slug, path, ord AS mtime, strlen(title) AS size FROM kg_pages),
l AS (SELECT * FROM f UNION ALL SELECT slug, path, ord, strlen(title) FROM anchor_nodes),
a AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY slug ORDER BY mtime, path NULLS FIRST, size NULLS FIRST) = 1),
b AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY slug ORDER BY mtime DESC, path DESC NULLS LAST, size DESC NULLS LAST) = 1),
o AS (SELECT path, mtime, size, true AS there FROM a QUALIFY row_number() OVER (PARTITION BY path ORDER BY mtime DESC, size DESC NULLS LAST) = 1),
n AS (SELECT path, mtime, size, true AS there FROM b QUALIFY row_number() OVER (PARTITION BY path ORDER BY mtime DESC, size DESC NULLS LAST) = 1)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.there IS NULL THEN 'added' WHEN n.there IS NULL THEN 'gone' ELSE 'changed' END AS change
FROM o FULL JOIN n ON o.path = n.path WHERE o.there IS NULL OR n.there IS NULL OR o.mtime <> n.mtime OR o.size IS DISTINCT FROM n.size""",
}
__all__ = ["QUERIES", "SQL", "Tuning"]
