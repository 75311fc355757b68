"""python -m loomgraph graph TOOL --wiki FOLDER [name=value ...]: one graph tool, its answer as JSON lines; and purge, dream, new, status, use."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame

from loomgraph.api import WikiGraph
from loomgraph.operators import reports, scoring
from loomgraph.runtime import session
from loomgraph.schema import TYPE_DIRS, GraphError
from loomgraph.sources import files

TOOLS = "get_stats read_graph get_node get_edges add_node update_node rename_node delete_node add_edge remove_edge rebuild_index metrics scan_freshness usage_stats".split()


WRITES = {"add_node", "update_node", "rename_node", "delete_node", "add_edge", "remove_edge", "rebuild_index"}


def rows(result) -> list:
    if isinstance(result, DataFrame):
        return [json.loads(x) for x in result.toJSON().toLocalIterator()]
    if isinstance(result, dict):
        return [{k: rows(v) for k, v in result.items()}]
    if hasattr(result, "asDict"):  # a row, which is a tuple as well
        return [result.asDict(recursive=True)]
    if isinstance(result, tuple):
        return [{"nodes": rows(result[0]), "edges": rows(result[1])}]
    return [result]


def new_wiki(root: str) -> None:
    """An empty wiki: its directories and index."""
    os.makedirs(os.path.join(root, "raw", "sources"), exist_ok=True)
    for d in TYPE_DIRS.values():
        os.makedirs(os.path.join(root, "wiki", d), exist_ok=True)
    index = os.path.join(root, "wiki", "index.md")
    if not os.path.exists(index):
        with open(index, "w", encoding="utf-8") as f:
            f.write("# Index\n")


def _purge(graph: WikiGraph, a: argparse.Namespace):
    if not a.stale_before and not a.slugs:
        raise SystemExit("purge needs --stale-before or --slugs")
    slugs = files.cli_list(a.slugs) if a.slugs else None
    report = graph.purge_report(a.stale_before, slugs)
    return {**report, "touched": graph.purge(a.stale_before if slugs is None else None, a.hard, a.dry_run, slugs)}


def _pressure(graph: WikiGraph, a: argparse.Namespace):
    parts = graph.pressure(a.since)
    return reports.pressure_text(parts, scoring.pressure_score(parts))


def _one(root: str, a: argparse.Namespace) -> list:
    """The answer of one wiki."""
    spark = session("local[*]")
    spark.sparkContext.setLogLevel("ERROR")
    graph = WikiGraph(spark, root, actor="cli")
    try:
        if a.group == "purge":
            return [_purge(graph, a)]
        if a.group == "dream":
            return [_pressure(graph, a)]
        return rows(getattr(graph, a.tool)(**{k: files.cli_value(v) for k, _, v in (x.partition("=") for x in a.values)}))
    finally:
        graph.logger.flush()


def main(args: list[str]) -> int:
    env = files.load_env(dict(os.environ))
    parser = argparse.ArgumentParser(prog="loomgraph")
    sub = parser.add_subparsers(dest="group", required=True)
    g = sub.add_parser("graph")
    g.add_argument("tool", choices=TOOLS)
    g.add_argument("values", nargs="*", help="name=value; a value is JSON where it can be read as such, - the standard input, @FILE a file's text")
    p = sub.add_parser("purge")
    p.add_argument("--stale-before", "--before")
    p.add_argument("--slugs", help="a, b, c")
    p.add_argument("--hard", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    d = sub.add_parser("dream", help="what has gathered since the last session")
    d.add_argument("--since", help="day of the last session")
    for x in (g, p, d):
        x.add_argument("--wiki", help="a wiki's path, or its name below WIKIS_ROOT")
    sub.add_parser("new").add_argument("root")
    sub.add_parser("status")
    u = sub.add_parser("use", help="print the setting that selects a wiki")
    u.add_argument("wiki")
    a = parser.parse_args(args)
    try:
        if a.group == "new":
            new_wiki(a.root)
        elif a.group == "status":
            print(json.dumps({"selected": env.get("SELECTED_WIKI"), "wikis": files.list_wikis(env.get("WIKIS_ROOT"))}, ensure_ascii=False))
        elif a.group == "use":
            print(f"SELECTED_WIKI={files.find_wiki(a.wiki, env.get('WIKIS_ROOT'))}")
        else:
            write = a.group == "purge" or a.group == "graph" and a.tool in WRITES
            # a folder with wiki/ alone is taken as it is
            roots = [a.wiki] if a.wiki and os.path.isdir(os.path.join(a.wiki, "wiki")) else files.targets(a.wiki, env, write)
            for root in roots:
                for row in _one(root, a):
                    print(json.dumps(row, ensure_ascii=False, default=str) if len(roots) == 1 else json.dumps({"wiki": root, "row": row}, ensure_ascii=False, default=str))
        return 0
    except GraphError as e:
        print(json.dumps({"code": e.code, "message": str(e), "detail": e.detail}, ensure_ascii=False, default=str), file=sys.stderr)
        return 1


def run() -> None:
    sys.exit(main(sys.argv[1:]))


if __name__ == "__main__":
    run()
