"""The facade of one wiki: the fourteen graph tools as methods, over frames or over a folder of Markdown, with a log of what was asked."""

from __future__ import annotations

import datetime as dt
import json
import os
import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import index_page
from loomgraph.functions.frontmatter import compose, parse
from loomgraph.functions.text import normalize_slug, title_to_slug
from loomgraph.operators import dml, freshness, graph, metrics, reports, scoring, usage
from loomgraph.operators import pages as P
from loomgraph.runtime import cut, local, release
from loomgraph.schema import MAX_ERROR_CHARS, RETENTION_DAYS, Code, GraphError
from loomgraph.sources import commit, usage_log, wiki

STATE_DIR = ".loomgraph"
TRUST_SECONDS = 30.0


def today() -> str:
    return dt.datetime.now(dt.timezone.utc).date().isoformat()


def seed_of(day: str) -> str:
    """The seed of a day's walk: its date without marks."""
    return day.replace("-", "")


def err_code(e: Exception) -> str:
    """What the usage log says of an error: its code, else the beginning of its text."""
    return e.code.value if isinstance(e, GraphError) else str(e)[:MAX_ERROR_CHARS]


class WikiGraph:
    """A wiki's pages and edges, kept between calls and read again when files may have changed.

    Pages are a written table, so they never depend on files that have vanished since; edges are cached over it.
    root is a folder with wiki/; or give pages (and log) as frames, which are then read-only.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, pages: DataFrame | None = None, log: DataFrame | None = None, actor: str = "lib", trust_seconds: float = TRUST_SECONDS, state_dir: str = STATE_DIR, maintain_index: bool = True, maintain_log: bool = True, strict_verify: bool = False):
        self.spark, self.root, self._given, self._log = spark, root, pages, log
        self.maintain_index, self.strict = maintain_index, strict_verify
        self._building = threading.RLock()
        self.trust, self._pages, self._edges, self._checked = trust_seconds, None, None, 0.0
        self.state = os.path.join(root, state_dir) if root else None
        self.logger = usage_log.UsageLogger(os.path.join(self.state, "usage"), actor) if root and maintain_log else None
        self.validate()

    def validate(self) -> None:
        """WIKI_ROOT_NOT_FOUND unless the root holds wiki/."""
        if self.root and not os.path.isdir(os.path.join(self.root, "wiki")):
            raise GraphError(Code.WIKI_ROOT_NOT_FOUND, f"{self.root} holds no wiki/", detail=self.root)

    # what is kept

    def pages(self) -> DataFrame:
        with self._building:  # calls at the same time share one scan
            if self._pages is None:
                self._pages = self._given.persist() if self._given is not None else cut(wiki.scan(self.spark, self.root), "pages")
                self._checked = time.monotonic()
            elif self.root and time.monotonic() - self._checked > self.trust:
                self.refresh()
            return self._pages

    def edges(self) -> DataFrame:
        with self._building:
            pages = self.pages()
            if self._edges is None:
                self._edges = graph.build(pages).persist()
            return self._edges

    def refresh(self) -> None:
        """Read changed files again; what did not change stays."""
        old = self._pages
        if self.root and old is not None:
            self._pages = cut(wiki.scan(self.spark, self.root, kept=old), "pages")
            release(old)
        if self._edges is not None:
            self._edges.unpersist()
            self._edges = None
        self._checked = time.monotonic()

    def refresh_paths(self, paths: list[str]) -> None:
        """After an edit of these files alone: they are read again, no other file is even looked at."""
        old = self._pages
        if old is None or not self.root:
            return
        self._pages = cut(wiki.rescan(old, self.root, paths), "pages")
        release(old)
        if self._edges is not None:
            self._edges.unpersist()
            self._edges = None

    def release(self) -> None:
        if self._edges is not None:
            self._edges.unpersist()
        if self._pages is not None:
            self._pages.unpersist()
            release(self._pages)
        self._pages = self._edges = None

    def _note(self, op: str, slug=None, ok: bool = True, dry: bool = False, err: str | None = None) -> None:
        if self.logger:
            self.logger.record(op, slug, ok, dry, err)

    # reads

    def get_stats(self) -> dict[str, DataFrame]:
        self._note("get_stats")
        n, e = self.pages(), self.edges()
        totals = n.agg(F.count("*").alias("nodes")).join(F.broadcast(e.agg(F.count("*").alias("edges"))), F.lit(True))
        return {"totals": totals, "types": metrics.type_counts(n), "tags": P.ranked(P.value_counts(n, "tags"), "n", 20), "degrees": P.ranked(graph.degrees(e), "total", 10)}

    def read_graph(self, limit: int | None = None, **filters) -> tuple[DataFrame, DataFrame]:
        self._note("read_graph", filters.get("center"))
        if filters.get("center"):
            filters["center"] = normalize_slug(filters["center"])
        return graph.read_graph(self.pages(), self.edges(), limit, **filters)

    def get_node(self, slug: str):
        self._note("get_node", slug)
        return wiki.find_page(self.pages(), slug)

    def get_edges(self, slug: str, k: int = 1, limit: int | None = None) -> DataFrame:
        self._note("get_edges", slug)
        return graph.get_edges(self.edges(), normalize_slug(slug), k, limit)

    def list_slugs(self) -> DataFrame:
        return self.pages().select("slug")

    def metrics(self) -> dict[str, DataFrame]:
        self._note("metrics")
        n, e = self.pages(), self.edges()
        table = graph.degree_table(n, e)
        parts = graph.components(n, e)
        return {
            "degrees": metrics.degree_stats(table), "hubs": metrics.hubs(table), "components": metrics.component_summary(parts), "small_components": metrics.small_components(parts),
            "source_coverage": metrics.source_coverage(n), "top_sources": P.ranked(metrics.source_index(n), "n", 10), "duplicate_clusters": metrics.duplicate_clusters(n), "over_extracted": metrics.over_extracted(n),
            "type_matrix": metrics.type_matrix(n, e), "type_balance": metrics.type_balance(n), "empty_types": metrics.empty_types(n),
        }

    def scan_freshness(self, day: str | None = None, upcoming: int = 30, ignore_updated: bool = False) -> DataFrame:
        self._note("scan_freshness")
        return freshness.schedule(self.pages(), day or today(), upcoming, ignore_updated)

    def usage_log(self, day: str, days: int) -> DataFrame:
        if self._log is not None:
            return usage.window(self._log, day, days)
        return usage_log.read(self.spark, self.logger.folder, day, days)

    def usage_stats(self, days: int = 30, actor: str | None = None, exclude_actor: str | None = None, day: str | None = None) -> DataFrame:
        """Counts per slug over the last days, zero rows for pages nobody asked for."""
        self._note("usage_stats")
        rows = usage.events(self.usage_log(day or today(), min(days, RETENTION_DAYS)), actor, exclude_actor)
        return usage.with_universe(usage.counts(rows), self.pages())

    def usage_report(self, days: int = 30, actor: str | None = None, exclude_actor: str | None = None, day: str | None = None) -> dict[str, DataFrame]:
        """Totals, the pages used most and least, and counts per page and actor."""
        self._note("usage_stats")
        log = self.usage_log(day or today(), min(days, RETENTION_DAYS))
        rows = usage.events(log, actor, exclude_actor)
        per = usage.with_universe(usage.counts(rows), self.pages())
        return {"totals": usage.totals(log, rows), "top": usage.top(per), "bottom": usage.bottom(per), "pages": per, "by_actor": usage.by_actor(rows)}

    def session_inputs(self, day: str | None = None, theme: str | None = None) -> dict[str, DataFrame]:
        """reports.prepared() since the journal's newest entry, with the threads it carries."""
        day, entry = day or today(), self.last_session() or {}
        carried = reports.carried_threads(self.spark, entry)
        return reports.prepared(self.pages(), self.edges(), self.usage_log(day, 30), carried, day, entry.get("date"), entry.get("touched_slugs"), theme)

    def last_session(self) -> dict | None:
        last = usage_log.last_entry(self.spark, os.path.join(self.state, "journal.jsonl")) if self.state else None
        return json.loads(last) if last else None

    def end_session(self, inputs: dict[str, DataFrame], calls: DataFrame, report: str = "", day: str | None = None) -> dict:
        """Adds the session's entry to the journal."""
        entry = reports.journal_entry(inputs, day or today(), calls, report)
        usage_log.append_entry(os.path.join(self.state, "journal.jsonl"), entry)
        return entry

    def salience(self, day: str | None = None) -> DataFrame:
        day = day or today()
        used = usage.counts(usage.events(self.usage_log(day, 30), exclude_actor="dream"))
        return scoring.salience(self.pages(), self.edges(), used, freshness.overdue(self.pages(), day, ignore_updated=True), day)

    def pressure(self, since: str | None = None, touched: list[str] | None = None, day: str | None = None) -> DataFrame:
        """What has gathered since the last session, whose own edits (touched) don't count; by default since the journal's newest entry."""
        day = day or today()
        if since is None and (entry := self.last_session()):
            since, touched = entry.get("date"), touched or entry.get("touched_slugs")
        return scoring.pressure(self.pages(), freshness.overdue(self.pages(), day).count(), day, since, touched)

    # writes: a plan, then its commit

    def _change(self, row, **changes) -> commit.Change:
        """A page's file with changed body or front matter; keys that nobody changed stay as they are.

        The plan was made from the scan: a file whose time or size is another by now is EXTERNAL_MODIFICATION, here or under the commit's lock.
        """
        path = self._at(row.path)
        state = wiki.snapshot([path], self.strict)[path]
        if state is None or state[:2] != (row.mtime, row.size):
            raise GraphError(Code.EXTERNAL_MODIFICATION, "changed by someone else", slug=row.slug, detail=[path])
        front, body = parse(wiki.read_clean(path)[0])
        front = dict(front or {})
        new_body = changes.pop("content", None)
        front.update({k: v for k, v in changes.items() if v is not None})
        return commit.Change(path, compose(front, body if new_body is None else new_body), state)

    def _rows(self, plan: DataFrame) -> Iterator:
        """A plan's rows with their file's time and size as scanned, one at a time."""
        stat = self.pages().select("slug", "mtime", "size")
        if "path" not in plan.columns:
            stat = self.pages().select("slug", "path", "mtime", "size")
        return plan.join(stat, "slug", "left").toLocalIterator()

    def _moved(self, change: commit.Change, path: str) -> Iterator[commit.Change]:
        """The change, at its new path if that is another one."""
        if path == change.path:
            yield change
        else:
            yield commit.Change(path, change.new, None)
            yield commit.Change(change.path, None, change.seen)

    def _index(self, edit: Callable[[str], str]) -> Iterator[commit.Change]:
        """The index page as edited."""
        if self.maintain_index:
            path = self._at("wiki/index.md")
            seen = wiki.snapshot([path], self.strict)[path]
            old = wiki.read_clean(path)[0] if seen else "# Index\n"
            yield commit.Change(path, edit(old), seen)

    def _commit(self, op: str, slug, changes: Iterable[commit.Change], dry_run: bool) -> list[str]:
        try:
            if not self.root:
                raise GraphError(Code.WIKI_ROOT_NOT_FOUND, "a graph of frames is read-only")
            touched = commit.commit(changes, self.state, dry_run=dry_run, strict=self.strict)
        except Exception as e:
            self._note(op, slug, ok=False, dry=dry_run, err=err_code(e))
            raise
        self._note(op, slug, dry=dry_run)
        if self.logger:
            self.logger.flush()
        if touched and not dry_run:
            self.refresh_paths(touched)
        return touched

    def _at(self, path: str) -> str:
        return os.path.join(self.root, path)

    @staticmethod
    def _rel(rows) -> list[dict]:
        return [{"slug": r["slug"], "relation": r["relation"]} for r in rows]

    def _known(self, *slugs: str) -> None:
        """NODE_NOT_FOUND unless all are pages."""
        asked = local(self.spark, [(normalize_slug(s),) for s in slugs], "slug string")
        for r in dml.missing(self.pages(), asked, "slug").limit(1).collect():
            raise GraphError(Code.NODE_NOT_FOUND, f"no page {r.slug}", slug=r.slug)

    def add_node(self, title: str, type: str = "synthesis", content: str = "", tags: list[str] | None = None, sources: list[str] | None = None, related: list[str] | None = None, on_collision: str = "suffix", dry_run: bool = False) -> list[str]:
        """A new page and its line in the index. on_collision: a taken slug is numbered (suffix) or NODE_ALREADY_EXISTS (error)."""
        kinds = "title string, type string, content string, tags array<string>, sources array<string>, related array<string>"
        new = local(self.spark, [(title, type, content, tags or [], sources or [], related or [])], kinds)

        def changes() -> Iterator[commit.Change]:
            title_to_slug(title)  # an unusable title is an error, not nothing
            for r in dml.add(self.pages(), new, today()).collect():
                if r.collides and on_collision == "error":
                    raise GraphError(Code.NODE_ALREADY_EXISTS, f"page {title_to_slug(title)} exists", slug=title_to_slug(title))
                front = {"type": r.type, "title": r.title, "created": r.created, "updated": r.updated, "tags": r.tags, "related": self._rel({"slug": x, "relation": None} for x in r.links), "sources": r.sources}
                yield commit.Change(self._at(r.path), compose(front, r.content), None)
                yield from self._index(lambda text, r=r: index_page.with_entry(text, r.slug, r.title, r.type))

        return self._commit("add_node", title, changes(), dry_run)

    def update_node(self, slug: str, dry_run: bool = False, **fields) -> list[str]:
        kinds = {f.name: f.dataType.simpleString() for f in self.pages().schema}
        names = [k for k in fields if k in kinds]
        patch = local(self.spark, [(normalize_slug(slug), *[fields[k] for k in names])], ", ".join(["slug string", *[f"{k} {kinds[k]}" for k in names]]))

        def changes() -> Iterator[commit.Change]:
            self._known(slug)
            for r in self._rows(dml.update(self.pages().drop("mtime", "size"), patch, today())):
                own = {k: r[k] for k in r.fields_changed}
                if "related" in own:
                    own["related"] = self._rel(own["related"])
                yield from self._moved(self._change(r, updated=r.updated, **own), self._at(r.new_path))
                if "title" in own:
                    yield from self._index(lambda text, r=r: index_page.with_changed_entry(text, r.slug, r.slug, r.title))

        return self._commit("update_node", slug, changes(), dry_run)

    def rename_node(self, old: str, new: str, dry_run: bool = False) -> list[str]:
        was, name = normalize_slug(old), normalize_slug(new)

        def changes() -> Iterator[commit.Change]:
            title = None
            for r in self._rows(dml.rename(self.pages(), was, name, today())):
                if r.slug == was:
                    title = (wiki.find_page(self.pages(), was).title,)
                yield from self._moved(self._change(r, content=r.content, related=self._rel(r.related), updated=r.updated or None), self._at(r.new_path))
            if title:
                yield from self._index(lambda text: index_page.with_changed_entry(text, was, name, title[0]))

        return self._commit("rename_node", [old, new], changes(), dry_run)

    def _deleted(self, slugs: list[str], dangling: str) -> Iterator[commit.Change]:
        gone = set()
        for r in self._rows(dml.delete_all(self.pages(), slugs, dangling)):
            if r.action == "delete":
                gone.add(r.slug)
                yield commit.Change(self._at(r.path), None, (r.mtime, r.size, None) if not self.strict else wiki.snapshot([self._at(r.path)], True)[self._at(r.path)])
            else:
                yield self._change(r, content=r.content, related=self._rel(r.related))
        if gone:
            yield from self._index(lambda text: index_page.without_entries(text, gone))

    def delete_node(self, slug: str, dangling: str = "strikethrough", dry_run: bool = False) -> list[str]:
        return self._commit("delete_node", slug, self._deleted([normalize_slug(slug)], dangling), dry_run)

    def add_edge(self, source: str, target: str, relation: str | None = None, context: str | None = None, dry_run: bool = False) -> list[str]:
        """context names the section of the source's text that gets the link."""
        want = local(self.spark, [(normalize_slug(source), normalize_slug(target), relation, context)], "source string, target string, relation string, context string")
        return self._edge_plan("add_edge", lambda: dml.add_edges(self.pages(), want), source, target, dry_run)

    def remove_edge(self, source: str, target: str, dry_run: bool = False) -> list[str]:
        gone = local(self.spark, [(normalize_slug(source), normalize_slug(target))], "source string, target string")
        return self._edge_plan("remove_edge", lambda: dml.remove_edges(self.pages(), gone), source, target, dry_run)

    def _edge_plan(self, op: str, plan: Callable[[], DataFrame], source: str, target: str, dry_run: bool) -> list[str]:
        def changes() -> Iterator[commit.Change]:
            self._known(source, target)
            for r in self._rows(plan()):
                yield self._change(r, content=r.content, related=self._rel(r.related))

        return self._commit(op, [source, target], changes(), dry_run)

    def rebuild_index(self, dry_run: bool = False) -> list[str]:
        """index.md written anew from the pages; sections that belong to no type are kept, once, at the end."""

        def changes() -> Iterator[commit.Change]:
            path = self._at("wiki/index.md")
            seen = wiki.snapshot([path], self.strict)[path]
            lines = ((r.heading, r.line) for r in dml.index_lines(self.pages()).toLocalIterator())
            yield commit.Change(path, "\n".join(index_page.rebuilt(lines, wiki.read_clean(path)[0] if seen else "")), seen)

        return self._commit("rebuild_index", None, changes(), dry_run)

    def purge_report(self, before: str | None = None, slugs: list[str] | None = None) -> dict[str, list[str] | int]:
        """What purge() would touch: affected slugs, slugs not found, and by date the number of pages kept and without a clock."""
        if slugs is not None:
            wanted = list(dict.fromkeys(map(normalize_slug, slugs)))
            lost = {r.slug for r in dml.missing(self.pages(), local(self.spark, [(s,) for s in wanted], "slug string"), "slug").collect()}
            return {"affected": [s for s in wanted if s not in lost], "not_found": [s for s in wanted if s in lost]}
        s = freshness.purge_summary(self.pages(), before).first()
        return {"affected": [r.slug for r in freshness.purge_candidates(self.pages(), before).orderBy("slug").toLocalIterator()], "not_found": [], "kept": s.kept, "skipped_no_clock": s.skipped_no_clock}

    def purge(self, before: str | None = None, hard: bool = False, dry_run: bool = False, slugs: list[str] | None = None) -> list[str]:
        """Pages whose clock is before the date, or those named, are marked invalidated, or with hard deleted; one commit."""
        if (before is None) == (slugs is None):
            raise ValueError("a purge goes by date or by slugs")
        if slugs is not None:
            hit = self.pages().join(F.broadcast(local(self.spark, [(normalize_slug(s),) for s in slugs], "slug string").distinct()), "slug", "left_semi")
        else:
            hit = freshness.purge_candidates(self.pages(), before)
        if hard:
            return self._commit("delete_node", None, self._deleted([r.slug for r in hit.select("slug").toLocalIterator()], "strikethrough"), dry_run)
        return self._commit("update_node", None, (self._change(r, status="invalidated", updated=today()) for r in self._rows(hit.select("slug"))), dry_run)

    def cleanup(self) -> list[str]:
        gone = commit.cleanup(self.root, self.state)
        if self.logger:
            self.logger.prune()
        self._note("cleanup")
        self.release()
        return gone


class GraphCache:
    """The graphs used last, three at most; the one unused longest is released."""

    def __init__(self, spark: SparkSession, size: int = 3):
        self.spark, self.size, self.open = spark, size, OrderedDict()

    def get(self, root: str) -> WikiGraph:
        key = os.path.realpath(root)
        if key not in self.open:
            self.open[key] = WikiGraph(self.spark, root)
            while len(self.open) > self.size:
                self.open.popitem(last=False)[1].release()
        self.open.move_to_end(key)
        return self.open[key]


def fan_out(graphs: dict[str, WikiGraph], read) -> tuple[DataFrame | None, dict[str, str]]:
    """read(graph) of several wikis as one frame with a `wiki` column, and the errors of those that failed."""
    out, errors = None, {}
    for name, g in graphs.items():
        try:
            df = read(g).withColumn("wiki", F.lit(name))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        except Exception as e:  # noqa: BLE001: one wiki's failure is a row of the answer
            errors[name] = f"{type(e).__name__}: {e}"
    return out, errors


def register_sql(g: WikiGraph, prefix: str = "") -> list[str]:
    """Temporary views over a graph: nodes, edges, degrees, freshness, dangling links, source index, type counts; their names."""
    n, e = g.pages(), g.edges()
    views = {"nodes": n, "edges": e, "degrees": graph.degree_table(n, e), "freshness": g.scan_freshness(), "dangling_links": graph.dangling(n), "source_index": metrics.source_index(n), "type_counts": metrics.type_counts(n)}
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in views]
