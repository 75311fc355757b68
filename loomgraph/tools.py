"""The tools of a session over one wiki: the graph tools it may call and the files it may touch, under a budget, with dry runs and a log. No model is called here."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from loomgraph.api import WikiGraph, err_code
from loomgraph.operators import chat, reports
from loomgraph.runtime import local
from loomgraph.schema import TOOL_RESULT_CHARS
from loomgraph.sources import files
from loomgraph.sources.wiki import read_clean

CALLS = "turn int, tool string, ok boolean, error string, path string, slug string, title string, type string, old_slug string, new_slug string"


@dataclass(frozen=True)
class Result:
    tool: str
    ok: bool
    content: str
    args: dict = field(default_factory=dict)


def shortened(text: str, tool: str, limit: int = TOOL_RESULT_CHARS) -> str:
    """chat.truncated() of one text."""
    if len(text) <= limit:
        return text
    left = f"[truncated, {len(text) - limit} chars omitted from"
    if any(w in tool for w in ("write", "edit", "add", "update", "delete", "rename", "remove", "create")):
        return f"{left} head]\n{text[-limit:]}"
    head = text[:limit]
    return f"{head[: head.rfind(chr(10))] if chr(10) in head[1:] else head}\n{left} tail]"


class ToolBox:
    """call() runs a tool by name (or by the unique end of one). A session has a kind (reports.ALLOWED) and folders it may write to; it ends after most_calls calls,
    most_errors failures in a row, or stop(). In a dry run writes are noted, not done. A page written with links to nothing gets a warning."""

    def __init__(self, graph: WikiGraph, kind: str = "read", scope: list[str] | None = None, dry_run: bool = False, most_calls: int = 30, most_errors: int = 3):
        self.graph, self.kind, self.scope, self.dry = graph, kind, scope, reports.DryRun() if dry_run else None
        self.most_calls, self.most_errors = most_calls, most_errors
        self.log: list[Result] = []
        self.stopped: str | None = None

    def tools(self) -> dict[str, Callable[..., object]]:
        """Name -> function of all this session may call; files are written only where a scope is given."""
        own = {f"wiki.{t}": getattr(self.graph, t) for t in reports.ALLOWED.get(self.kind, [])}
        own |= {"read_file": self._read, "list_directory": self._list}
        return own | ({"write_file": self._write, "edit_file": self._edit} if self.scope is not None else {})

    def _read(self, path: str, offset: int = 1, limit: int = 500) -> str:
        lines = read_clean(files.inside(self.graph.root, path))[0].split("\n")
        part = "\n".join(f"{i}: {x}" for i, x in enumerate(lines[offset - 1 : offset - 1 + limit], offset))
        return files.capped(part, path)

    def _list(self, path: str = ".") -> str:
        return "\n".join(f"{name}/" if folder else f"{name} ({size})" for name, folder, size in files.listing(files.inside(self.graph.root, path)))

    def _write(self, path: str, content: str) -> str:
        files.write_file(self.graph.root, path, content, self.scope)
        return f"wrote {path}{self._warning(path)}"

    def _edit(self, path: str, old_string: str, new_string: str) -> str:
        status = files.edit_file(self.graph.root, path, old_string, new_string, self.scope)
        if status not in ("exact", "loose"):
            raise ValueError(f"{path}: the text to replace is {status}")
        return f"edited {path} ({status}){self._warning(path)}"

    def _warning(self, path: str) -> str:
        if not path.endswith(".md"):
            return ""
        text = local(self.graph.spark, [(path, read_clean(files.inside(self.graph.root, path))[0])], "path string, content string")
        found = reports.dangling_warning(reports.dangling_in_texts(text, self.graph.list_slugs())).first()
        return f"\n\n{found.warning}" if found else ""

    def stop(self, why: str = "stopped") -> None:
        self.stopped = why

    def call(self, name: str, **args) -> Result:
        tools = self.tools()
        tool = chat.resolve_tool(list(tools), name)
        failed = [not r.ok for r in self.log[-self.most_errors :]]
        if self.stopped or len(self.log) >= self.most_calls or len(failed) == self.most_errors and all(failed):
            return Result(tool or name, False, f"session over: {self.stopped or ('budget' if len(self.log) >= self.most_calls else 'too many errors')}", args)
        if tool is None:
            done = Result(name, False, f"no tool {name}", args)
        elif self.dry and tool in reports.WRITE_TOOLS:
            done = Result(tool, True, self.dry.record(tool, args), args)
        else:
            try:
                done = Result(tool, True, shortened(self._text(tools[tool](**args)), tool), args)
            except Exception as e:  # noqa: BLE001: a failed call is an answer
                done = Result(tool, False, err_code(e), args)
        self.log.append(done)
        return done

    @staticmethod
    def _text(answer) -> str:
        from loomgraph.__main__ import rows

        return answer if isinstance(answer, str) else "\n".join(map(str, rows(answer)))

    def calls(self, spark: SparkSession) -> DataFrame:
        """The log as a frame, for reports.changes() and chat.touched_slugs()."""
        get = lambda r, k: None if r.args.get(k) is None else str(r.args[k])
        names = ("path", "slug", "title", "type", "old_slug", "new_slug")
        rows = [(i, r.tool, r.ok, None if r.ok else r.content, *[get(r, k) for k in names]) for i, r in enumerate(self.log)]
        return local(spark, rows, CALLS)
