"""What sessions over a wiki leave behind and start from: changes by tool logs, dangling links of texts, journal entries, prepared inputs, and their texts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import chat, freshness, scoring, usage, walk
from loomgraph.operators.skew import lookup_join
from loomgraph.runtime import local
from loomgraph.schema import JOURNAL_CANDIDATES, SNIPPET_CHARS, TYPE_DIRS, Tuning

#: Tools that write.
WRITE_TOOLS = ["wiki.add_node", "wiki.update_node", "wiki.delete_node", "wiki.rename_node", "wiki.add_edge", "wiki.remove_edge", "wiki.rebuild_index", "write_file", "edit_file"]
READ_TOOLS = ["get_stats", "read_graph", "get_node", "get_edges", "metrics", "scan_freshness", "usage_stats"]
#: Which graph tools a kind of session may call; `read` is what changes nothing.
ALLOWED = {
    "read": READ_TOOLS,
    "ingest": ["get_stats", "read_graph", "get_node", "add_node", "add_edge", "rename_node"],
    "research": ["get_stats", "read_graph", "get_node", "get_edges", "scan_freshness", "add_node", "update_node", "add_edge", "rename_node"],
    "check": ["get_stats", "read_graph", "get_node", "get_edges", "add_node", "update_node", "add_edge", "delete_node"],
    "reason": ["get_stats", "read_graph", "get_node", "get_edges", "add_node", "update_node", "add_edge"],
    "purge": ["get_stats", "read_graph", "get_node", "update_node", "delete_node"],
    "dream": [*READ_TOOLS, "update_node", "delete_node", "add_edge", "remove_edge", "rebuild_index"],
}


def is_write_tool(name: Column) -> Column:
    return name.isin(WRITE_TOOLS)


def allowed(session: str, tool: str) -> bool:
    return tool.split(".")[-1] in ALLOWED.get(session, [])


def skip_conclusion(status: Column, message: Column, asked: bool, least: int = 500) -> Column:
    """Does a completed run already end in its report: asked for, and long enough."""
    return F.lit(asked) & (status == "completed") & (F.length(message) >= least)


def changes(calls: DataFrame) -> DataFrame:
    """(file, action) for each call of a tool log (turn, tool, error, path, slug, title, type, old_slug, new_slug) that changed a file, in order of turn.

    Failed calls change nothing. A new page's file follows from its title and type; other pages are named by slug, as the log does not know their folder.
    """
    tool = F.element_at(F.split("tool", r"\."), -1)
    folder = F.create_map(*[F.lit(x) for pair in TYPE_DIRS.items() for x in pair])
    rows = X.with_slug(calls.where(F.col("error").isNull()), "__made", F.col("title"))
    kind = F.coalesce("type", F.lit("synthesis"))
    place = F.coalesce(folder[kind], kind)
    made = F.when(F.col("__made").isNotNull(), F.concat(F.when(place == "", "").otherwise(F.concat(place, F.lit("/"))), "__made", F.lit(".md")))
    named = lambda c: F.concat(F.lit("slug:"), c)
    what = (
        F.when(tool.isin("write_file", "edit_file"), F.struct(F.col("path").alias("file"), F.lit("modified").alias("action")))
        .when(tool == "add_node", F.struct(made.alias("file"), F.lit("created").alias("action")))
        .when(tool == "rename_node", F.struct(named(F.coalesce("new_slug", "old_slug")).alias("file"), F.lit("modified").alias("action")))
        .when(tool == "update_node", F.struct(named(F.col("slug")).alias("file"), F.lit("modified").alias("action")))
        .when(tool == "delete_node", F.struct(named(F.col("slug")).alias("file"), F.lit("deleted").alias("action")))
    )
    return rows.select("turn", what.alias("w")).where(F.col("w.file").isNotNull()).orderBy("turn").select("w.file", "w.action")


def dangling_in_texts(texts: DataFrame, slugs: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """(key, target): links of texts that name no page, each once. A link may have folders before the slug; they are not compared."""
    links = texts.where(F.contains(text, F.lit("[["))).select(key, F.explode(F.array_distinct(X.wikilinks(F.col(text)))).alias("target"))
    rows = X.with_nfkc(links, "__slug", F.element_at(F.split("target", r"[/\\]"), -1))
    return lookup_join(rows, slugs.select(F.col("slug").alias("__slug")).distinct(), "__slug", "left_anti").select(key, "target")


def dangling_warning(dangling: DataFrame, key: str = "path") -> DataFrame:
    """(key, warning): one line per text with dangling links; its links by name."""
    links = F.array_join(F.transform(F.sort_array(F.collect_list("target")), lambda t: F.concat(F.lit("[["), t, F.lit("]]"))), ", ")
    return dangling.groupBy(key).agg(F.concat(F.lit("WARNING: "), F.count("*").cast("string"), F.lit(" wikilink(s) point to no page: "), links).alias("warning"))


def thread_names(carried: DataFrame, live: DataFrame) -> DataFrame:
    """(thread, place): threads carried over, then live ones as kind:key; each once, where it first stands."""
    old = carried.select("thread", F.struct(F.lit(0).alias("from"), F.monotonically_increasing_id().alias("no"), F.lit("").alias("key")).alias("place"))
    kinds = F.array(*[F.lit(k) for k in ("hypothesis", "contradicts", "needs-verification")])
    new = live.select(F.concat_ws(":", "kind", "key").alias("thread"), F.struct(F.lit(1).alias("from"), F.array_position(kinds, F.col("kind")).cast("bigint").alias("no"), "key").alias("place"))
    return old.unionByName(new).groupBy("thread").agg(F.min("place").alias("place"))


def candidates(ranking: DataFrame, limit: int = JOURNAL_CANDIDATES) -> DataFrame:
    """One row: the highest scores as an array of (slug, salience, usage30, in_degree, overdue_days), for the journal."""
    top = ranking.orderBy(F.desc("score"), "slug").limit(limit)
    item = F.struct((-F.col("score")).alias("k"), "slug", F.col("score").alias("salience"), F.col("used").alias("usage30"), F.col("n_in").alias("in_degree"), "overdue_days")
    return top.agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: F.struct(x["slug"], x["salience"], x["usage30"], x["in_degree"], x["overdue_days"])).alias("candidates"))


def prepared(pages: DataFrame, edges: DataFrame, log: DataFrame, carried: DataFrame, today: str, since: str | None, touched: list[str] | None = None, theme: str | None = None, tuning: Tuning = Tuning()) -> dict[str, DataFrame]:
    """What a session starts from: pressure, salience, forgettable pages, scenes, open threads (carried ones that still hold first), and the theme's pages."""
    due = freshness.overdue(pages, today)
    used = usage.counts(usage.events(usage.window(log, today, 30), exclude_actor="dream"))
    ranking = scoring.salience(pages, edges, used, freshness.overdue(pages, today, ignore_updated=True), today, tuning)
    live = scoring.threads(pages)
    out = {
        "pressure": scoring.pressure(pages, due.count(), today, since, touched, tuning),
        "salience": ranking.orderBy(F.desc("score"), "slug"),
        "forget": scoring.forget_candidates(ranking, tuning=tuning),
        "scenes": walk.walk(ranking, edges, today.replace("-", ""), tuning),
        "threads": thread_names(scoring.carried(carried, live), live).orderBy("place").select("thread"),
        "candidates": candidates(ranking),
    }
    return out | ({"theme": scoring.theme_match(pages, theme)} if theme else {})


def journal_entry(inputs: dict[str, DataFrame], today: str, calls: DataFrame, report: str = "") -> dict:
    """What a session leaves for the next one: its pressure, scenes as drawn, best candidates, threads still open, slugs it touched. One JSON line, see usage_log.append_entry."""
    scenes: dict[int, list[str]] = {}
    for r in inputs["scenes"].orderBy("scene", "step").collect():
        scenes.setdefault(r.scene, []).append(r.node)
    return {
        "date": today, "seed": today.replace("-", ""),
        "pressure": {r.component: r.n for r in inputs["pressure"].collect()},
        "scenes": [{"nodes": n} for n in scenes.values()],
        "candidates": [c.asDict() for c in inputs["candidates"].first().candidates],
        "threads_carried": [r.thread for r in inputs["threads"].collect()],
        "touched_slugs": sorted(r.slug for r in chat.touched_slugs(calls).collect()),
        "report": report,
    }


def carried_threads(spark: SparkSession, entry: dict | None) -> DataFrame:
    """(thread) that a journal entry carries over; none without an entry."""
    return local(spark, [(t,) for t in (entry or {}).get("threads_carried") or []], "thread string")


class DryRun:
    """Writes that were asked for and not done."""

    def __init__(self) -> None:
        self.calls: list[tuple[str, dict]] = []

    def record(self, tool: str, args: dict) -> str:
        self.calls.append((tool, args))
        return f"[DRY-RUN] {tool}({json.dumps(args, ensure_ascii=False)[:SNIPPET_CHARS]}): nothing was written; go on as if it were."

    def summary(self) -> str:
        shown = (f"  {i}. {tool}({', '.join(f'{k}={json.dumps(args[k], ensure_ascii=False)[:40]}' for k in list(args)[:3])})" for i, (tool, args) in enumerate(self.calls, 1))
        return "\n".join([f"Dry run: {len(self.calls)} writes", *shown]) if self.calls else "No writes."


def pressure_text(components: DataFrame, score: DataFrame) -> str:
    """Pressure as text: a line for each component, then the score and whether a session is due."""
    lines = [f"{r.component}: {r.n} x {r.weight:g} = {r.contribution:g}" for r in components.collect()]
    s = score.first()
    return "\n".join([*lines, f"score {s.score:g}, {'due' if s.suggested else 'not due'}"])


def theme_text(theme: str, match: DataFrame) -> str:
    r = match.first()
    return f"theme {theme!r}: {r.n} page(s){': ' + ', '.join(r.slugs) if r.slugs else ''}{'' if r.has_purchase else ' (too few to work on)'}"
