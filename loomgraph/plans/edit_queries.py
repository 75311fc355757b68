"""Queries of edits as plans, chat windows, session reports and streams over the wiki's tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.functions.canonical import width_sql
from loomgraph.functions.dates import utc_text
from loomgraph.operators import chat, dml, graph, metrics, reports, scoring
from loomgraph.operators import pages as P
from loomgraph.plans import core_problems as C
from loomgraph.plans import wiki_queries as W
from loomgraph.runtime import children, local, shared_dir
from loomgraph.sources import usage_log, wiki
from loomgraph.sources.tables import table
from loomgraph.streaming import usage as stream

ANCHOR = "[[nvidia]]"
CONVERSATION = 400
CARRIED = ["bare thread", "needs-verification:" + W.CENTER, "hypothesis:nobody", "bare thread"]


def _messages(s: SparkSession, d: str) -> DataFrame:
    """Documents as conversations: CONVERSATION ids each, in fours a question, a tool call, its result, an answer."""
    step = F.col("doc_id") % 4
    call = F.col("doc_id") - step
    return table(s, d, "documents").select(
        F.floor(F.col("doc_id") / CONVERSATION).alias("conv_id"), F.col("doc_id").alias("turn"),
        F.when(step == 0, "user").when(step == 2, "tool").otherwise("assistant").alias("role"), F.col("text").alias("content"),
        F.when(step == 2, call.cast("string")).alias("tool_call_id"), F.when(step == 1, F.array(call.cast("string"))).alias("tool_call_ids"),
    )


def _new_pages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("title").where(F.col("title").isNotNull()).distinct().withColumn("content", F.lit(""))


def _ends(s: SparkSession, d: str) -> DataFrame:
    """One edge per source: its least target, and the least relation named with any."""
    return W._edges(s, d).groupBy("source").agg(F.min("target").alias("target"), F.min("relation").alias("relation"))


def _calls(s: SparkSession, d: str) -> DataFrame:
    """The usage log as a tool log."""
    slug = F.col("slugs")[0]
    return table(s, d, "usage_events").distinct().where(F.col("op").isNotNull() & F.col("slugs").isNotNull() & (F.size("slugs") > 0)).select(
        F.coalesce("ts", F.lit("")).alias("turn"), F.concat(F.lit("wiki."), "op").alias("tool"), F.when(~F.coalesce("ok", F.lit(True)), "failed").alias("error"), F.lit(None).cast("string").alias("path"),
        slug.alias("slug"), slug.alias("title"), F.lit("concept").alias("type"), slug.alias("old_slug"), F.try_element_at("slugs", F.lit(2)).alias("new_slug"),
    )


def _stream(s: SparkSession, d: str) -> DataFrame:
    name = "usage_events.parquet"
    reader = s.readStream.schema(table(s, d, "usage_events").schema)
    # a stream reads folders; the table may be one or a file beside others
    return reader.option("pathGlobFilter", name).parquet(d) if children(s, f"{d}/{name}") == [name] else reader.parquet(f"{d}/{name}")


def _scratch(s: SparkSession) -> str:
    return f"{shared_dir(s)}/loomgraph/{s.sparkContext.applicationId}/{uuid.uuid4().hex}-stream"


def _stream_daily(s: SparkSession, d: str) -> DataFrame:
    """daily() on the log as a stream; the last state is written by batch, never gathered."""
    folder = _scratch(s)
    out = stream.daily(_stream(s, d)).writeStream.outputMode("complete").foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{folder}/days"))
    out.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{folder}/days").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "slug", "reads", "writes")


def _stream_features(s: SparkSession, d: str) -> DataFrame:
    """The feature table kept up by a stream of the log, in two runs, the second of which delivers everything again."""
    folder = _scratch(s)
    kept = stream.FeatureTable(s, f"{folder}/table")
    kept.start(_stream(s, d), f"{folder}/first").awaitTermination()
    kept.advance(table(s, d, "usage_events"), kept.latest() + 1)
    return kept.version().select("slug", "event_type", "n", utc_text(F.timestamp_millis("last_ms")).alias("last_ts"))


def _page_texts(s: SparkSession, d: str) -> DataFrame:
    """Every page's latest scan as a file's text: front matter of its type, title and tags, and its content."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    line = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), quoted(c), F.lit("\n")))
    head = F.concat_ws("", line("type", "type"), line("title", "title"), F.when(F.col("tags").isNotNull(), F.concat(F.lit("tags: "), F.to_json("tags"), F.lit("\n"))))
    return P.latest(table(s, d, "kg_pages")).where(F.col("path").isNotNull()).select("path", F.concat(F.lit("---\n"), head, F.lit("---\n\n"), F.coalesce("content", F.lit(""))).alias("content"))


def _log_lines(s: SparkSession, d: str) -> DataFrame:
    """The usage log as the JSON lines it came from, with a torn line after each."""
    rows = table(s, d, "usage_events").where(F.col("ts").isNotNull() & F.col("day").isNotNull())
    line = F.to_json(F.struct("ts", "op", F.col("slugs").alias("slug"), "actor", "dry", "ok", "err"))
    return rows.select("day", F.explode(F.array(line, F.substring(line, 1, 20), F.lit(""))).alias("value"))


def _threads(s: SparkSession, d: str) -> DataFrame:
    live = scoring.threads(W._nodes(s, d))
    return reports.thread_names(scoring.carried(local(s, [(t,) for t in CARRIED], "thread string"), live), live).select("thread", (F.col("place.from") == 0).alias("was_carried"))


QUERIES = {
    "add_plan": lambda s, d: dml.add(W._nodes(s, d), _new_pages(s, d), W.TODAY).select("slug", "title", "type", "path", "collides"),
    "update_plan": lambda s, d: dml.update(W._nodes(s, d), W._nodes(s, d).where("type = 'concept'").select("slug", F.lit("entity").alias("type"), F.col("title"), F.lit("invalidated").alias("status")), W.TODAY).select(
        "slug", "new_path", F.array_join(F.array_sort("fields_changed"), ",").alias("fields")
    ),
    "add_edge_plan": lambda s, d: dml.add_edges(W._nodes(s, d), _ends(s, d)).select("slug", F.contains("content", F.concat(F.lit("- [["), "slug")).isNotNull().alias("has_text"), F.size("related").cast("bigint").alias("n_related")),
    "remove_edge_plan": lambda s, d: dml.remove_edges(W._nodes(s, d), _ends(s, d)).select("slug", F.size("related").cast("bigint").alias("n_related")),
    "delete_many_plan": lambda s, d: dml.delete_all(W._nodes(s, d), [W.CENTER, "nvidia", "nobody"]).select("slug", "action", F.size("related").cast("bigint").alias("n_related")),
    "chat_window_keep": lambda s, d: chat.window(_messages(s, d), [ANCHOR]).select("conv_id", "turn", "fate", F.col("keep_chars").cast("bigint").alias("keep_chars")),
    "chat_summary": lambda s, d: chat.summary(chat.window(_messages(s, d), [ANCHOR])).select("conv_id", "operations"),
    "usage_stream_daily": _stream_daily,
    "usage_stream_features": _stream_features,
    "edges_relation_first_wins": lambda s, d: graph.build(W._nodes(s, d)).where("relation IS NOT NULL").select("source", "target", "relation"),
    "degree_p95": lambda s, d: metrics.degree_stats(W._deg(s, d)).select("p95"),
    "dangling_in_texts": lambda s, d: reports.dangling_in_texts(table(s, d, "documents"), W._nodes(s, d), "doc_id", "text"),
    "derived_changes": lambda s, d: reports.changes(_calls(s, d)).groupBy("file", "action").agg(F.count("*").alias("n")),
    "threads_union": _threads,
    "journal_candidates": lambda s, d: reports.candidates(W._salience(s, d)).select(F.posexplode("candidates").alias("place", "c")).select(F.col("place").cast("bigint").alias("place"), "c.*"),
    "node_columns": lambda s, d: graph.node_columns(W._nodes(s, d)).select("slug", "type", "path", F.size("tags").cast("bigint").alias("n_tags"), "ord"),
    "suggested_filters": lambda s, d: P.ranked(metrics.type_counts(W._nodes(s, d)).join(W._nodes(s, d).groupBy("type").agg(F.min("ord").alias("seen")), "type"), "n", 5).select("type", "n"),
    "pages_parsed": lambda s, d: wiki.parse_texts(_page_texts(s, d)).select("path", "slug", "title", "type", F.size("tags").cast("bigint").alias("n_tags"), F.size("wikilink_targets").cast("bigint").alias("n_links")),
    "log_parsed": lambda s, d: usage_log.parse_lines(_log_lines(s, d), F.col("day")).select("ts", "op", F.array_join("slugs", "|", "~").alias("slugs"), "actor", "dry", "ok", "err", "day"),
    "pressure_touched": lambda s, d: scoring.pressure(W._nodes(s, d), 0, W.TODAY, W.SINCE, [W.CENTER, "nvidia", "hbm"]).where("component IN ('new', 'updated', 'hypotheses', 'contradictions')").select("component", "n"),
    "slug_digit": lambda s, d: W._nodes(s, d).where(X.starts_with_digit(F.col("slug"))).select("slug"),
}

_CODE = r"'`[^`]*`'"
_LINKS = rf"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents WHERE contains(text, '[[')),
fl AS (SELECT *, regexp_matches(trim(line), '^(```|~~~)') AS fence FROM lines),
vis AS (SELECT doc_id, no, regexp_extract_all(regexp_replace(line, {_CODE}, '', 'g'), '\[\[([^\]|]+)(?:\|[^\]]+)?\]\]', 1) AS t
        FROM (SELECT *, sum(CASE WHEN fence THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no) AS seen FROM fl) WHERE NOT fence AND seen % 2 = 0),
one AS (SELECT doc_id, no, generate_subscripts(t, 1) AS k, trim(unnest(t)) AS target FROM vis),
doc_links AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY no, k) - 1 AS pos, target FROM one)"""
# links in the pages' own texts, and one row per page with its edge to add or take away
_NODE_LINKS = ", " + _LINKS.replace("doc_links", "node_links").replace("doc_id", "slug").replace("string_split(text,", "string_split(content,").replace("FROM documents WHERE contains(text", "FROM nodes WHERE contains(content")
_SLUGIFY = r"nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '\s+', '-', 'g'), '[^\p{{L}}\p{{N}}-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), '')"
_ENDS = _NODE_LINKS + ", en AS (SELECT source AS slug, min(target) AS t, min(relation) AS rel FROM et GROUP BY 1), li AS (SELECT DISTINCT slug, lower(target) AS t, true AS linked FROM node_links)"
_OWN = "coalesce(related, [])"
_MSG = f"""WITH m AS (SELECT doc_id // {CONVERSATION} AS conv_id, doc_id AS turn, doc_id % 4 AS step, coalesce(text, '') AS c, doc_id - doc_id % 4 AS call FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS no, count(*) OVER (PARTITION BY conv_id) AS cnt, sum(length(c)) OVER (PARTITION BY conv_id) AS total FROM m),
b AS (SELECT *, CASE WHEN step = 1 THEN call WHEN step = 2 AND lag(step) OVER w = 1 AND lag(call) OVER w = call THEN call END AS block, step = 2 AND contains(c, '{ANCHOR}') AS anchor FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
u AS (SELECT *, min(CASE WHEN step = 0 THEN no END) OVER (PARTITION BY conv_id) AS first_user FROM b),
k AS (SELECT *, no = 1 OR no = first_user OR anchor OR no > cnt - 20 AS must FROM u),
j AS (SELECT *, must OR block IS NOT NULL AND bool_or(must) OVER (PARTITION BY conv_id, block) AS keep FROM k),
z AS (SELECT *, CASE WHEN sum(CASE WHEN keep THEN length(c) ELSE 0 END) OVER (PARTITION BY conv_id) > 100000 THEN 512 ELSE 2048 END AS room FROM j),
f AS (SELECT conv_id, turn, step, CASE WHEN total <= 100000 THEN 'keep' WHEN NOT keep THEN 'summarize' WHEN anchor AND length(c) > room THEN 'shorten' ELSE 'keep' END AS fate, CASE WHEN anchor THEN CAST(room AS BIGINT) END AS keep_chars FROM z)
"""

SQL = {
    "add_plan": W._BASE
    + f""", nt AS (SELECT DISTINCT title FROM documents WHERE title IS NOT NULL), ba AS (SELECT title, {_SLUGIFY.format(width_sql('title'))} AS base, '# ' || title AS content FROM nt),
ex AS (SELECT regexp_extract(slug, '^(.*?)(?:-(\\d+))?$', 1) AS base, max(coalesce(try_cast(nullif(regexp_extract(slug, '-(\\d+)$', 1), '') AS INTEGER), 1)) AS most FROM nodes GROUP BY 1),
nu AS (SELECT ba.*, nodes.slug IS NOT NULL AS collides, row_number() OVER (PARTITION BY ba.base ORDER BY ba.content) + CASE WHEN nodes.slug IS NOT NULL THEN coalesce(most, 1) ELSE 0 END AS no
       FROM ba LEFT JOIN nodes ON nodes.slug = ba.base LEFT JOIN ex ON ex.base = ba.base WHERE ba.base IS NOT NULL)
SELECT base || CASE WHEN no = 1 THEN '' ELSE '-' || no END AS slug, title, 'synthesis' AS type, 'wiki/synthesis/' || base || CASE WHEN no = 1 THEN '' ELSE '-' || no END || '.md' AS path, collides FROM nu""",
    "update_plan": W._BASE
    + "SELECT slug, 'wiki/entities/' || slug || '.md' AS new_path, CASE WHEN status IS DISTINCT FROM 'invalidated' THEN 'status,type' ELSE 'type' END AS fields FROM nodes WHERE type = 'concept'",
    "add_edge_plan": W._BASE
    + _ENDS
    + f""", e AS (SELECT n.slug, t, rel, {_OWN} AS own, coalesce(linked, false) AS linked FROM nodes n JOIN en USING (slug) LEFT JOIN li USING (slug, t)),
a AS (SELECT *, coalesce(list_contains([lower(x.slug) for x in own], t), false) AS there, len([x for x in own if lower(x.slug) = t AND rel IS NOT NULL AND x.relation IS DISTINCT FROM rel]) AS raised FROM e)
SELECT slug, true AS has_text, CAST(len(own) + CASE WHEN there OR slug = t THEN 0 ELSE 1 END AS BIGINT) AS n_related FROM a WHERE NOT linked OR slug <> t AND (NOT there OR raised > 0)""",
    "remove_edge_plan": W._BASE
    + _ENDS
    + f""" SELECT slug, k AS n_related FROM (SELECT n.slug, linked, CAST(len({_OWN}) AS BIGINT) AS a, CAST(len([x for x in {_OWN} if coalesce(lower(x.slug) <> t, true)]) AS BIGINT) AS k FROM nodes n JOIN en USING (slug) LEFT JOIN li USING (slug, t)) WHERE a <> k OR linked""",
    "delete_many_plan": W._BASE
    + _NODE_LINKS
    + f""", g AS (SELECT list(slug) AS gs FROM nodes WHERE slug IN ('{W.CENTER}', 'nvidia')), h AS (SELECT DISTINCT slug FROM node_links, g WHERE list_contains(gs, lower(target))),
r AS (SELECT slug, {_OWN} AS a, [x for x in {_OWN} if coalesce(NOT list_contains(gs, lower(x.slug)), true)] AS k FROM nodes, g WHERE NOT list_contains(gs, slug))
SELECT slug, 'update' AS action, CAST(len(k) AS BIGINT) AS n_related FROM r WHERE len(a) <> len(k) OR slug IN (SELECT slug FROM h) UNION ALL SELECT unnest(gs), 'delete', NULL FROM g""",
    "chat_window_keep": _MSG + "SELECT conv_id, turn, fate, keep_chars FROM f",
    "chat_summary": _MSG + "SELECT conv_id, count(*) AS operations FROM f WHERE fate = 'summarize' AND step = 2 GROUP BY 1",
    "usage_stream_daily": W.SQL["usage_daily"],
    "usage_stream_features": C.SQL["p2_found"],
    "edges_relation_first_wins": W._BASE + "SELECT source, target, relation FROM built WHERE relation IS NOT NULL",
    "degree_p95": W._BASE + f", {W._STATS} SELECT p95 FROM st",
    "dangling_in_texts": W._BASE + f", {_LINKS} SELECT DISTINCT doc_id, target FROM doc_links ANTI JOIN nodes ON nodes.slug = lower({width_sql(chr(39).join(['regexp_extract(target, ', '[^/]*$', ')']))})",
    "derived_changes": f"""WITH lg AS (SELECT DISTINCT * FROM usage_events WHERE op IS NOT NULL AND len(slugs) > 0 AND coalesce(ok, true)), c AS (SELECT op, slugs[1] AS a, slugs[2] AS b, {_SLUGIFY.format(width_sql('slugs[1]'))} AS made FROM lg),
w AS (SELECT CASE op WHEN 'add_node' THEN 'concepts/' || made || '.md' WHEN 'rename_node' THEN 'slug:' || coalesce(b, a) WHEN 'update_node' THEN 'slug:' || a WHEN 'delete_node' THEN 'slug:' || a END AS file,
CASE op WHEN 'add_node' THEN 'created' WHEN 'delete_node' THEN 'deleted' ELSE 'modified' END AS action FROM c) SELECT file, action, count(*) AS n FROM w WHERE file IS NOT NULL GROUP BY 1, 2""",
    "threads_union": W._BASE
    + f""", live AS (SELECT 'hypothesis:' || slug AS thread FROM nodes WHERE {W._HYP} UNION SELECT 'contradicts:' || slug || '→' || target FROM rels WHERE relation = 'contradicts' UNION SELECT 'needs-verification:' || slug FROM tags_ WHERE v = 'needs-verification'),
old AS (SELECT DISTINCT unnest({CARRIED!r}) AS thread), kept AS (SELECT thread FROM old WHERE NOT regexp_matches(thread, '^(hypothesis|needs-verification|contradicts):') OR thread IN (SELECT thread FROM live))
SELECT thread, true AS was_carried FROM kept UNION ALL SELECT thread, false FROM live WHERE thread NOT IN (SELECT thread FROM kept)""",
    "journal_candidates": W._BASE
    + W._SAL
    + "SELECT row_number() OVER (ORDER BY score DESC, slug) - 1 AS place, slug, score AS salience, used AS usage30, n_in AS in_degree, overdue_days FROM sal ORDER BY score DESC, slug LIMIT 20",
    "node_columns": W._BASE + "SELECT slug, type, path, (SELECT count(*) FROM tags_ t WHERE t.slug = nodes.slug) AS n_tags, ord FROM nodes",
    "suggested_filters": W._BASE + "SELECT type, count(*) AS n FROM nodes GROUP BY 1 ORDER BY n DESC, min(ord) LIMIT 5",
    "pages_parsed": W._BASE
    + _NODE_LINKS.replace("FROM nodes WHERE contains(content", "FROM pg WHERE contains(content").replace(", lines AS", ", pg AS (SELECT * FROM kg_pages WHERE slug IS NOT NULL AND path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY slug ORDER BY ord DESC) = 1), lines AS", 1)
    + rf""", nl AS (SELECT slug, count(DISTINCT lower({width_sql('target')})) AS k FROM node_links GROUP BY 1)
SELECT path, lower({width_sql("regexp_extract(path, '([^/]*)[.]md$', 1)")}) AS slug, coalesce(title, regexp_extract(path, '([^/]*)[.]md$', 1)) AS title, {W._INFER.format(c="nullif(lower(trim(type, ' ' || chr(12288) || chr(160) || chr(9) || chr(10) || chr(13))), '')")} AS type,
coalesce(len(tags), 0) AS n_tags, coalesce(k, 0) AS n_links FROM pg LEFT JOIN nl USING (slug)""",
    "log_parsed": "SELECT ts, op, array_to_string([coalesce(x, '~') for x in slugs], '|') AS slugs, actor, dry, ok, err, day FROM usage_events WHERE op IS NOT NULL AND ts IS NOT NULL AND day IS NOT NULL",
    "pressure_touched": W._BASE
    + f""", own AS (SELECT * FROM nodes WHERE type <> 'dream' AND slug NOT IN ('{W.CENTER}', 'nvidia', 'hbm')) SELECT unnest(['new', 'updated', 'hypotheses', 'contradictions']) AS component,
unnest([(SELECT count(*) FROM own WHERE created > '{W.SINCE}'), (SELECT count(*) FROM own WHERE updated > '{W.SINCE}' AND NOT coalesce(created > '{W.SINCE}', false) AND created IS NOT NULL), (SELECT count(*) FROM own WHERE {W._HYP}), (SELECT count(*) FROM rels SEMI JOIN own USING (slug) WHERE relation = 'contradicts')]) AS n""",
    "slug_digit": W._BASE + r"SELECT slug FROM nodes WHERE regexp_matches(slug, '^\p{N}')",
    # queries of the other modules
    "wikilinks_extracted": f"WITH {_LINKS} SELECT doc_id, pos, target FROM doc_links",
    "edges_depth": W._BASE
    + f""", w AS (SELECT source AS a, target AS b, source, target, ord * 2 AS e FROM et UNION ALL SELECT target, source, source, target, ord * 2 + 1 FROM et WHERE source <> target),
h1 AS (SELECT b, min(e) AS r, arg_min(source, e) AS source, arg_min(target, e) AS target FROM w WHERE a = '{W.CENTER}' AND b <> '{W.CENTER}' GROUP BY b),
c2 AS (SELECT w.b, [h1.r, w.e] AS r, w.source, w.target FROM w JOIN h1 ON w.a = h1.b WHERE w.b <> '{W.CENTER}' AND w.b NOT IN (SELECT b FROM h1)),
h2 AS (SELECT * FROM c2 QUALIFY row_number() OVER (PARTITION BY b ORDER BY r) = 1) SELECT source, target, 1 AS depth FROM h1 UNION ALL SELECT source, target, 2 FROM h2""",
    "rename_cascade": W._BASE
    + _NODE_LINKS
    + f""" SELECT slug, CASE WHEN slug = '{W.CENTER}' THEN 'chip-cycle' ELSE slug END AS new_slug, CASE WHEN slug = '{W.CENTER}' THEN regexp_replace(path, '[^/]+\\.md$', 'chip-cycle.md') ELSE path END AS new_path,
CASE WHEN slug = '{W.CENTER}' THEN '{W.TODAY}' ELSE updated END AS updated FROM nodes WHERE slug = '{W.CENTER}' OR list_contains([lower(x.slug) for x in {_OWN}], '{W.CENTER}') OR slug IN (SELECT slug FROM node_links WHERE lower(target) = '{W.CENTER}')""",
    "delete_cascade": W._BASE
    + _NODE_LINKS
    + f""" SELECT slug, CASE WHEN slug = '{W.CENTER}' THEN 'delete' ELSE 'update' END AS action, CASE WHEN slug <> '{W.CENTER}' THEN CAST(len([x for x in {_OWN} if coalesce(lower(x.slug) <> '{W.CENTER}', true)]) AS BIGINT) END AS n_related
FROM nodes WHERE slug = '{W.CENTER}' OR list_contains([lower(x.slug) for x in {_OWN}], '{W.CENTER}') OR slug IN (SELECT slug FROM node_links WHERE lower(target) = '{W.CENTER}')""",
}

