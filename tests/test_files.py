"""File helpers, session reports, the command line and the shared folder."""

import io
import json
import os
import subprocess
import sys
import zipfile

import pytest
from pyspark.sql import functions as F

from loomgraph import __main__ as cli
from loomgraph import runtime
from loomgraph.api import WikiGraph
from loomgraph.functions import index_page
from loomgraph.operators import chat, graph, reports, scoring
from loomgraph.schema import Code, GraphError, clamp01
from loomgraph.sources import files
from loomgraph.tools import ToolBox, shortened
from tests.test_operators import edges, frame, page


@pytest.fixture
def wikis(tmp_path):
    for name in ("one", "two"):
        cli.new_wiki(str(tmp_path / name))
    (tmp_path / "none").mkdir()
    return str(tmp_path)


def test_where_a_wiki_is(wikis):
    env = {"WIKIS_ROOT": wikis}
    assert [os.path.basename(p) for p in files.list_wikis(wikis)] == ["one", "two"] and files.list_wikis("/nowhere") == []
    assert files.targets("one", env, True) == [f"{wikis}/one"] == files.targets(f"{wikis}/one", {}, True) == files.targets(None, env | {"SELECTED_WIKI": "one"}, True)
    assert len(files.targets(None, env, False)) == 2
    for asked, e, write in ((None, env, True), (None, {}, False), ("three", env, False), ("one", {}, False), (f"{wikis}/none", env, False)):
        with pytest.raises(GraphError) as err:
            files.targets(asked, e, write)
        assert err.value.code == Code.WIKI_ROOT_NOT_FOUND
    assert files.default_root("two", env) == (f"{wikis}/two", None) and files.default_root(None, {}) == (None, None)
    assert files.default_root(None, {"WIKI_ROOT": f"{wikis}/none"}) == (f"{wikis}/none", "WIKI_ROOT is outdated, set SELECTED_WIKI")


def test_settings_and_values(tmp_path, monkeypatch):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / ".env").write_text("# no\nA = 1\r\nB='x y'\nC=\"z\"\nnothing\nD=a=b\nE=\n")
    assert files.find_dotenv(str(tmp_path / "a/b")) == str(tmp_path / ".env")
    assert files.load_env({"A": "kept"}, str(tmp_path / "a/b")) == {"A": "kept", "B": "x y", "C": "z", "D": "a=b", "E": ""}
    (tmp_path / "v").write_text("from a file")
    monkeypatch.setattr(sys, "stdin", io.StringIO("typed"))
    assert [files.cli_value(x) for x in ("-", f"@{tmp_path}/v", "3", '["a"]', "plain")] == ["typed", "from a file", 3, ["a"], "plain"]
    assert files.cli_list(" a, b ,,c") == ["a", "b", "c"]
    assert [clamp01(x) for x in (-1, 0.3, 7, float("nan"), None)] == [0.0, 0.3, 1.0, 0.5, 0.5]


def test_paths_stay_inside(tmp_path):
    (tmp_path / "wiki/dreams").mkdir(parents=True)
    os.symlink("/etc", tmp_path / "wiki/out")
    assert files.inside(str(tmp_path), "wiki/a.md") == str(tmp_path / "wiki/a.md") and files.dreams_dir(str(tmp_path)).endswith("wiki/dreams")
    for path, scope in (("../x", None), ("wiki/out/passwd", None), ("/etc/passwd", None), ("wiki/a.md", ["wiki/dreams"])):
        with pytest.raises(PermissionError):
            files.inside(str(tmp_path), path, scope)
    with pytest.raises(PermissionError):
        files.dreams_dir(str(tmp_path), "raw")


def test_edits_of_one_place(tmp_path):
    text = "a\n  b  \nc\nb c\n"
    assert files.edited(text, "b c", "x") == ("exact", "a\n  b  \nc\nx\n") and files.edited(text, "b", "x").status == "several"
    assert files.edited(text, "a\nb\n c", "x\ny") == ("loose", "x\ny\nb c\n") and files.edited(text, "zz", "x") == ("absent", text)
    assert files.edited(text, " \t", "x").status == "empty" and files.edited("  k v\nq\n  k v\nq", "k v\n q", "x").status == "several"
    (tmp_path / "f.md").write_text(text)
    assert files.edit_file(str(tmp_path), "f.md", "b c", "d") == "exact" and (tmp_path / "f.md").read_text().endswith("\nd\n")
    files.write_file(str(tmp_path), "n/g.md", "new")
    assert files.listing(str(tmp_path)) == [("n", True, 0), ("f.md", False, 12)]


def test_caps(spark, tmp_path):
    long = "\n".join(f"line {i} é" for i in range(3000))
    out = files.capped(long, "x", 100, 50)
    assert out.endswith("\n[truncated: x exceeds the read limit]") and len(out.split("\n[")[0].encode()) <= 100 and files.capped("a\nb", "x") == "a\nb"
    assert files.capped(long, "x").count("\n") == 2000 and files.capped("x" * 60_000, "x").startswith("x" * 51_200 + "\n[")
    df = spark.createDataFrame([("p", long), ("q", ""), ("r", None), ("w", "y" * 200)], "path string, content string")
    got = files.capped_lines(df, 10, 500, 100).groupBy("path").agg(F.count("*").alias("n"), F.min("line_no").alias("a"), F.sum(F.octet_length("line") + 1).alias("b"))
    assert {(r.path, r.n, r.a) for r in got.collect() if r.b <= 100} == {("p", 9, 10)}
    assert [(r.line_no, len(r.line)) for r in files.capped_lines(df.where("path = 'w'"), 1, 500, 100).collect()] == [(1, 200)]


def test_sources_and_snapshots(tmp_path):
    for p in ("a.md", "b.TXT", "c.png", "Thumbs.db", "dist/d.md", "sub/e.html", ".git/f.md"):
        (tmp_path / "in" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / p).write_text(p)
    assert [os.path.relpath(p, tmp_path / "in") for p in files.source_files(str(tmp_path / "in"))] == ["a.md", "b.TXT", "sub/e.html"]
    cli.new_wiki(str(tmp_path / "kb"))
    assert os.path.exists(files.copy_sources(str(tmp_path / "in"), str(tmp_path / "kb")) + "/sub/e.html")
    assert files.copy_sources(str(tmp_path / "in/a.md"), str(tmp_path / "kb")).endswith("raw/sources/a.md")
    with zipfile.ZipFile(files.snapshot_zip(str(tmp_path / "kb"), str(tmp_path / "state"), "s")) as z:
        assert z.namelist() == ["wiki/index.md"]


def test_index_lines():
    text = "# Index\n\n## Entities\n\n- [[b]] — B\n- [[d]] — D\n\n## Notes\n\nmine\n\n## Other\n\n- [[z]] — Z\n"
    for slug, before in (("a", "b"), ("c", "d")):
        lines = index_page.with_entry(text, slug, "T", "entity").split("\n")
        assert lines[lines.index(f"- [[{slug}]] — T") + 1].startswith(f"- [[{before}]]")
    assert "- [[d]] — D\n- [[e]] — \n\n## Notes" in index_page.with_entry(text, "e", None, "entity")
    assert "## Memo\n\n- [[m]] — M\n\n## Other" in index_page.with_entry(text, "m", "M", "memo") and index_page.with_entry("# I", "q", "Q", "query").endswith("## Queries\n\n- [[q]] — Q\n")
    assert index_page.without_entries(text, {"b", "z"}).count("- [[") == 1 and "- [[bb]] — New" in index_page.with_changed_entry(text, "b", "bb", "New")
    new = "\n".join(index_page.rebuilt([("Entities", "- [[a]] — A"), ("Other", "- [[y]] — Y")], text))
    assert new == "# Index\n\n## Entities\n\n- [[a]] — A\n\n## Other\n\n- [[y]] — Y\n\n## Notes\n\nmine\n"
    assert "\n".join(index_page.rebuilt([("Entities", "- [[a]] — A"), ("Other", "- [[y]] — Y")], new)) == new


def test_changes_from_a_tool_log(spark):
    rows = [(1, "write_file", None, "x.md", None, None, None, None, None), (2, "wiki.add_node", None, None, None, "My Page", None, None, None), (3, "add_node", None, None, None, "@#", None, None, None),
            (4, "wiki.add_node", None, None, None, "Top", "overview", None, None), (5, "rename_node", None, None, None, None, None, "a", "b"), (6, "delete_node", "failed", None, "c", None, None, None, None),
            (7, "delete_node", None, None, "c", None, None, None, None), (8, "update_node", None, None, "d", None, None, None, None), (9, "get_node", None, None, "d", None, None, None, None)]
    log = spark.createDataFrame(rows, "turn int, tool string, error string, path string, slug string, title string, type string, old_slug string, new_slug string")
    assert [tuple(r) for r in reports.changes(log).collect()] == [("x.md", "modified"), ("synthesis/my-page.md", "created"), ("top.md", "created"), ("slug:b", "modified"), ("slug:c", "deleted"), ("slug:d", "modified")]
    assert [r.w for r in log.orderBy("turn").select(reports.is_write_tool(F.col("tool")).alias("w")).collect()][:3] == [True, True, False]
    assert reports.allowed("purge", "wiki.delete_node") and not reports.allowed("purge", "add_node") and not reports.allowed("nobody", "get_node")
    run = reports.DryRun()
    assert run.summary() == "No writes." and "add_node" in run.record("add_node", {"title": "T"}) and "1. add_node(title=\"T\")" in run.summary()


def test_dangling_links_of_texts(spark):
    texts = spark.createDataFrame([("a.md", "[[entities/Ｎvidia]] [[gone]] [[gone]]\n`[[code]]`\n[[x/y]]"), ("b.md", None), ("c.md", "[[nvidia]]")], "path string, content string")
    slugs = spark.createDataFrame([("nvidia",), ("nvidia",)], "slug string")
    lost = reports.dangling_in_texts(texts, slugs)
    assert sorted(map(tuple, lost.collect())) == [("a.md", "gone"), ("a.md", "x/y")]
    assert [r.warning for r in reports.dangling_warning(lost).collect()] == ["WARNING: 2 wikilink(s) point to no page: [[gone]], [[x/y]]"]


def test_what_a_session_starts_from(spark):
    n = frame(spark, page("a", 1, content="status: hypothesis", related=[("b", "contradicts")], checked="2024-01-01"), page("b", 2, tags=["needs-verification"]), page("c", 3, type="dream"))
    log = spark.createDataFrame([("2025-06-30T00:00:00Z", "get_node", ["a"], None, None, True, None)], "ts string, op string, slugs array<string>, actor string, dry boolean, ok boolean, err string").withColumn("day", F.to_date(F.substring("ts", 1, 10)))
    old = spark.createDataFrame([("hypothesis:gone",), ("my own",)], "thread string")
    got = reports.prepared(n, edges(spark, ("a", "b")), log, old, "2025-07-01", "2025-01-01", ["b"], "A page")
    assert [r.thread for r in got["threads"].collect()] == ["my own", "hypothesis:a", "contradicts:a→b", "needs-verification:b"]
    (row,) = got["candidates"].collect()
    assert [c.slug for c in row.candidates] == [r.slug for r in got["salience"].collect()] and got["scenes"].where("step = 0").count() == 3
    assert {r.component: r.n for r in got["pressure"].collect()}["hypotheses"] == 1 and set(got) >= {"forget", "theme"}
    calls = spark.createDataFrame([("wiki.update_node", True, "a", None, None), ("rename_node", True, None, "b", "c"), ("update_node", False, "z", None, None)], "tool string, ok boolean, slug string, old_slug string, new_slug string")
    entry = json.loads(json.dumps(reports.journal_entry(got, "2025-07-01", calls, "done")))
    assert entry["touched_slugs"] == ["a", "b", "c"] and len(entry["candidates"]) == 3 and entry["seed"] == "20250701" and len(entry["scenes"]) == 3
    assert [r.thread for r in reports.carried_threads(spark, entry).collect()] == entry["threads_carried"] and reports.carried_threads(spark, None).count() == 0
    parts = got["pressure"]
    assert "hypotheses: 1 x 2 = 2" in reports.pressure_text(parts, scoring.pressure_score(parts)) and reports.theme_text("t", got["theme"]).startswith("theme 't': ")


def test_truncated_results(spark):
    df = spark.createDataFrame([(1, "short", "get_node"), (2, "ab\n" * 10, "get_node"), (3, "ab\n" * 10, "write_file"), (4, "x" * 30, "get_node")], "i int, c string, t string")
    got = {r.i: r.o for r in df.select("i", chat.truncated(F.col("c"), F.col("t"), 10).alias("o")).collect()}
    assert got == {1: "short", 2: "ab\nab\nab\n[truncated, 20 chars omitted from tail]", 3: "[truncated, 20 chars omitted from head]\n\nab\nab\nab\n", 4: "x" * 10 + "\n[truncated, 20 chars omitted from tail]"}
    calls = spark.createDataFrame([(1, i, "get_node", f'slug="p{i}"', "boom" if i == 2 else None, f"c{i}") for i in range(1, 26)], "conv_id int, turn int, tool string, args string, error string, tool_call_id string")
    (row,) = chat.summary_text(calls, calls.where("turn > 1"), 2).collect()
    assert row.text == '[Summary of turns 2–25: 24 operations. 1 errors. get_node(slug="p2") [FAILED]; get_node(slug="p3") [ok]; ... and 22 more]'
    done = spark.createDataFrame([("completed", "x" * 500), ("completed", "x"), ("failed", "x" * 500)], "s string, m string")
    assert [r.k for r in done.select(reports.skip_conclusion(F.col("s"), F.col("m"), True).alias("k")).collect()] == [True, False, False]


def test_command_line(spark, wikis, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda master: spark)
    for k in ("WIKIS_ROOT", "SELECTED_WIKI", "WIKI_ROOT"):
        monkeypatch.delenv(k, raising=False)
    one = f"{wikis}/one"
    assert cli.main(["graph", "add_node", "title=First Page", "type=entity", "--wiki", one]) == 0 and os.path.exists(f"{one}/wiki/entities/first-page.md")
    monkeypatch.setenv("WIKIS_ROOT", wikis)
    capsys.readouterr()
    assert cli.main(["graph", "get_stats"]) == 0 and [json.loads(x)["wiki"] for x in capsys.readouterr().out.splitlines()] == [one, f"{wikis}/two"]
    assert cli.main(["graph", "add_node", "title=x"]) == 1 and "WIKI_ROOT_NOT_FOUND" in capsys.readouterr().err
    assert cli.main(["purge", "--slugs", "first-page, no", "--wiki", "one"]) == 0 and json.loads(capsys.readouterr().out)["not_found"] is not None
    assert cli.main(["dream", "--wiki", "one", "--since", "2025-01-01"]) == 0 and "score" in capsys.readouterr().out
    assert cli.main(["status"]) == 0 and len(json.loads(capsys.readouterr().out)["wikis"]) == 2
    assert cli.main(["use", "one"]) == 0 and capsys.readouterr().out.strip() == f"SELECTED_WIKI={one}"
    assert cli.main(["graph", "update_node", "slug=nobody", "title=x", "--wiki", "one"]) == 1 and "NODE_NOT_FOUND" in capsys.readouterr().err


def test_sessions_follow_one_another(spark, wikis):
    g = WikiGraph(spark, f"{wikis}/one")
    g.add_node("First", "entity", "status: hypothesis")
    assert g.last_session() is None
    inputs = g.session_inputs("2025-07-01")
    g.end_session(inputs, ToolBox(g).calls(spark), "r", "2025-07-01")
    assert g.last_session()["threads_carried"] == ["hypothesis:first"] and g.session_inputs(theme="first")["theme"].first().n == 1
    assert {r.component: r.n for r in g.pressure().collect()}["hypotheses"] == 1 and set(g.usage_report()) == {"totals", "top", "bottom", "pages", "by_actor"}


def test_a_session_of_tools(spark, wikis):
    root = f"{wikis}/one"
    g = WikiGraph(spark, root)
    box = ToolBox(g, "research", ["wiki"], most_calls=9)
    assert box.call("add_node", title="First", type="entity").ok and "first" in box.call("get_node", slug="first").content
    got = box.call("write_file", path="wiki/concepts/second.md", content="[[entities/first]] [[gone]]")
    assert got.ok and "WARNING: 1 wikilink(s) point to no page: [[gone]]" in got.content
    assert box.call("edit_file", path="wiki/concepts/second.md", old_string="[[gone]]", new_string="").content == "edited wiki/concepts/second.md (exact)"
    assert box.call("read_file", path="wiki/concepts/second.md").content == "1: [[entities/first]] " and "second.md" in box.call("list_directory", path="wiki/concepts").content
    assert [box.call(t, **a).ok for t, a in (("write_file", {"path": "../x", "content": ""}), ("delete_node", {"slug": "first"}), ("update_node", {"slug": "nobody", "title": "x"}))] == [False] * 3
    assert box.call("get_node", slug="first").content == "session over: budget"
    assert [tuple(r) for r in reports.changes(box.calls(spark)).collect()] == [("entities/first.md", "created"), ("wiki/concepts/second.md", "modified"), ("wiki/concepts/second.md", "modified")]
    dry = ToolBox(g, "purge", dry_run=True, most_errors=2)
    assert dry.call("wiki.delete_node", slug="first").content.startswith("[DRY-RUN]") and g.get_node("first") and dry.call("write_file", path="x", content="").ok is False
    assert not dry.call("nothing").ok and dry.call("get_node", slug="first").content == "session over: too many errors"
    quiet = ToolBox(g)
    quiet.stop("aborted")
    assert quiet.call("get_node", slug="first").content == "session over: aborted"
    for text, tool in (("short", "get_node"), ("ab\n" * 10, "get_node"), ("ab\n" * 10, "write_file"), ("x" * 30, "get_node")):
        assert shortened(text, tool, 10) == spark.createDataFrame([(text, tool)], "c string, t string").select(chat.truncated(F.col("c"), F.col("t"), 10)).first()[0]


def test_edges_of_no_pages(spark):
    assert graph.components(frame(spark), edges(spark)).count() == 0


def test_shared_folder_is_swept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runtime, "shared_dir", lambda _: f"file://{tmp_path}")
    mine = runtime.cut(spark.range(3), "x")
    spark.range(2).write.parquet(f"file://{tmp_path}/loomgraph/app-dead/1-x")
    assert runtime.sweep(spark) == [] and runtime.sweep(spark, -1) == ["app-dead"] and mine.count() == 3


def test_workers_find_the_package(tmp_path):
    """From any folder, without PYTHONPATH, Python workers get the package from the session."""
    code = "import sys; sys.path.insert(0, sys.argv[1]); from loomgraph.runtime import session; from loomgraph.operators import dml; s = session('local[2]', 2); print('ROWS', s.createDataFrame([('[[a]]',)], 'c string').select(dml._head('c', 'c')).count())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = os.path.dirname(os.path.dirname(os.path.abspath(runtime.__file__)))
    out = subprocess.run([sys.executable, "-c", code, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "ROWS 1" in out.stdout, out.stderr[-2000:]
