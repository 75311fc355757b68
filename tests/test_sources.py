"""The Markdown source, commits, the usage log and its stream, on a small wiki of known numbers."""

import datetime as dt
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import features, graph, metrics, skew
from loomgraph.operators import pages as P
from loomgraph.schema import Code, GraphError
from loomgraph.sources import commit, usage_log, wiki
from loomgraph.streaming import usage as stream

#: slug or file, type, tags, links in the text, related
WIKI = [
    ("nvidia", "entity", "半导体, AI", "hbm ai基建周期", "hbm ai基建周期"),
    ("tsmc", "entity", "半导体, 代工", "nvidia", "nvidia"),
    ("openai", "entity", "AI, 大模型", "transformer", "transformer"),
    ("asml", "entity", "半导体, 光刻", "", ""),
    ("ｔｅｓｔ-ｎｆｋｃ", "entity", "test", "", ""),
    ("ai基建周期", "concept", "AI, 周期", "nvidia hbm", "nvidia hbm"),
    ("hbm", "concept", "半导体, 存储", "nvidia ai基建周期", "nvidia ai基建周期"),
    ("transformer", "concept", "AI, 架构", "openai", "openai"),
    ("kv-cache", "concept", "AI, 推理", "CODE", ""),
    ("dirty-data", "concept", "test", "wikilink nvidia", "[[nvidia]] hbm"),
    ("bare-page", None, None, "nvidia", ""),
    ("nvidia-10k-2025", "source", "财报", "nvidia", "nvidia"),
    ("semiconductor-outlook", "source", "半导体, 研报", "hbm asml", "hbm asml"),
    ("ai-capex-trend", "query", "AI", "ai基建周期 nvidia", "ai基建周期 nvidia"),
    ("nvidia-vs-amd", "comparison", "半导体, AI", "nvidia", "nvidia"),
    ("ai-supply-chain-synthesis", "synthesis", "AI, 半导体", "nvidia tsmc hbm ai基建周期", "nvidia tsmc hbm ai基建周期"),
    ("overview", "overview", "", "", ""),
]
DIRS = {"entity": "entities/", "concept": "concepts/", "source": "sources/", "query": "queries/", "comparison": "comparisons/", "synthesis": "synthesis/", "overview": "", None: "concepts/"}


@pytest.fixture
def root(tmp_path):
    for slug, kind, tags, links, related in WIKI:
        body = "\n".join(f"[[{x}]]" for x in links.split()) if links != "CODE" else "```\n[[nvidia]]\n```\n`[[hbm]]`"
        rel = ", ".join(json.dumps(x, ensure_ascii=False) for x in related.split())
        text = body if kind is None else f"---\ntype: {kind}\ntitle: {slug}\ncreated: 2025-01-01\nupdated: 2025-06-01\ntags: [{tags}]\nrelated: [{rel}]\n---\n\n# {slug}\n\n{body}\n"
        p = tmp_path / "wiki" / f"{DIRS[kind]}{slug}.md"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("﻿" + text if slug == "tsmc" else text, encoding="utf-8")
    (tmp_path / "wiki/index.md").write_text("# Index\n[[nvidia]]")
    (tmp_path / "wiki/.hidden").mkdir()
    (tmp_path / "wiki/.hidden/x.md").write_text("x")
    (tmp_path / "wiki/a.md.tmp-1").write_text("x")
    return str(tmp_path)


def test_scan_and_graph(spark, root):
    n = wiki.scan(spark, root).cache()
    assert n.count() == 17 and {r.slug for r in n.where("type = 'concept'").collect()} >= {"bare-page", "kv-cache"}
    e = graph.build(n).cache()
    assert e.count() == 22
    only = {(r.source, r.target): r.origins for r in e.where(F.size("origins") == 1).collect()}
    assert only == {("dirty-data", "hbm"): ["related"], ("bare-page", "nvidia"): ["wikilink"]}
    t = graph.degree_table(n, e)
    s = metrics.degree_stats(t).first()
    assert (s.mean, s.median, s["std"], s.p95, s["max"], s.isolated) == (2.59, 2.0, 2.83, 11, 11, 3)
    assert [(r.slug, r.n_in, r.n_out) for r in metrics.hubs(t).collect()] == [("nvidia", 9, 2)]
    assert metrics.component_summary(graph.components(n, e)).first().asDict() == {"components": 5, "largest": 12, "ratio": 0.71, "fragmentation": 0.29}
    assert [graph.neighbourhood(e, "nvidia", k).count() for k in (1, 2, 3)] == [10, 11, 12]
    assert {r.slug for r in graph.read_nodes(n, tag="ai").collect()} >= {"nvidia", "openai"}
    assert wiki.find_page(n, "TSMC").slug == "tsmc" and wiki.find_page(n, "no") is None
    assert wiki.leftovers(root) == [os.path.join(root, "wiki/a.md.tmp-1")]
    spark.dataSource.register(wiki.WikiSource)
    assert {r.slug for r in spark.read.format("wiki").option("root", root).load().collect()} == {r.slug for r in n.collect()}


def test_rescan_reads_only_changes(spark, root):
    first = wiki.scan(spark, root).cache()
    first.count()
    os.remove(f"{root}/wiki/entities/asml.md")
    with open(f"{root}/wiki/entities/new.md", "w") as f:
        f.write("new [[nvidia]]")
    again = wiki.scan(spark, root, kept=first)
    assert {r.slug for r in again.collect()} == {r.slug for r in first.collect()} - {"asml"} | {"new"}
    change = {r.path.rsplit("/", 1)[-1]: r.change for r in P.changed_files(first, again).collect()}
    assert change == {"asml.md": "gone", "new.md": "added"}
    with pytest.raises(GraphError) as e:
        wiki.list_pages("/nowhere")
    assert e.value.code == Code.WIKI_ROOT_NOT_FOUND


def test_commit(tmp_path, monkeypatch):
    a, b, state = str(tmp_path / "a.md"), str(tmp_path / "b.md"), str(tmp_path / "state")
    with open(a, "w", newline="") as f:
        f.write("one\r\n")
    assert commit.commit([commit.Change(a, "two\n"), commit.Change(b, "new")], state, dry_run=True) == [a, b] and not os.path.exists(b)
    assert commit.commit([commit.Change(a, "two\n"), commit.Change(b, "new")], state) == [a, b]
    assert open(a, newline="").read() == "two\r\n" and open(b).read() == "new"
    assert commit.commit([commit.Change(b, "new"), commit.Change(str(tmp_path / "c"), None)], state) == []
    seen = wiki.snapshot([a, b], strict=True)
    with open(b, "w") as f:
        f.write("other")
    with pytest.raises(GraphError) as e:
        commit.commit([commit.Change(b, "x")], state, seen=seen, strict=True)
    assert e.value.code == Code.EXTERNAL_MODIFICATION and open(b).read() == "other"
    monkeypatch.setattr(commit, "write_atomic", lambda p, t: (_ for _ in ()).throw(OSError("disk")) if p == b else open(p, "w").write(t))
    with pytest.raises(GraphError) as e:
        commit.commit([commit.Change(a, "three"), commit.Change(b, "x")], state)
    assert e.value.code == Code.TRANSACTION_ROLLBACK and open(a, newline="").read() == "two\r\n"
    with commit.lock(state), pytest.raises(GraphError) as e:
        commit.commit([commit.Change(a, "four")], state, timeout=0.1)
    assert e.value.code == Code.LOCK_TIMEOUT
    open(tmp_path / "z.tmp-1", "w").close()
    assert [os.path.basename(p) for p in commit.cleanup(str(tmp_path), state)] == ["z.tmp-1"]


def test_usage_log(spark, tmp_path):
    folder = str(tmp_path / "usage")
    clock = [dt.datetime(2025, 6, 1, 12, tzinfo=dt.timezone.utc)]
    log = usage_log.UsageLogger(folder, "cli", now=lambda: clock[0])
    for i in range(60):
        log.record("get_node", f"p{i % 3}")
    log.record("add_edge", ["a", "b"], ok=False, err="x" * 500)
    log.record("get_stats")
    log.flush()
    with open(f"{folder}/2025-06-01.jsonl", "a") as f:
        f.write('{"ts":"2025\n\n[1]\n')
    rows = usage_log.read(spark, folder)
    assert rows.count() == 62
    edge = rows.where("op = 'add_edge'").first()
    assert edge.slugs == ["a", "b"] and len(edge.err) == 200 and edge.day == dt.date(2025, 6, 1) and edge.ok is False
    assert rows.where("slugs IS NULL").count() == 1
    assert usage_log.read(spark, folder, "2025-06-10", 3).count() == 0 == usage_log.read(spark, str(tmp_path / "no")).count()
    clock[0] += dt.timedelta(days=100)
    assert log.prune() == ["2025-06-01.jsonl"]
    assert usage_log.slices(["aaa", "bbbb", "c" * 20, "é"], 10) == [b"aaa\nbbbb\n", b"c" * 20 + b"\n", "é\n".encode()] and usage_log.slices([]) == []
    journal = str(tmp_path / "j/journal.jsonl")
    assert usage_log.last_entry(spark, journal) is None
    usage_log.append_entry(journal, {"date": "1"})
    usage_log.append_entry(journal, {"date": "2"})
    with open(journal, "a") as f:
        f.write('{"date": torn')
    assert json.loads(usage_log.last_entry(spark, journal)) == {"date": "2"}


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    for d in (1, 2, 3):
        lines = [{"ts": f"2025-06-0{d}T0{i}:00:00.000Z", "op": "get_node" if i % 2 else "update_node", "slug": "A" if i < 5 else ["b", "a"], "ok": True} for i in range(8)]
        (folder / f"2025-06-0{d}.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n{torn\n")
    q = stream.daily(stream.read_log(spark, str(folder))).writeStream.outputMode("complete").format("memory").queryName("usage_daily").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = usage_log.read(spark, str(folder))
    assert sorted(map(tuple, spark.table("usage_daily").collect())) == sorted(map(tuple, stream.daily(batch).collect()))
    table = stream.FeatureTable(spark, str(tmp_path / "features"))
    first = stream.read_log(spark, str(folder))
    table.start(first, str(tmp_path / "cp")).awaitTermination(120)
    (folder / "2025-06-04.jsonl").write_text(json.dumps({"ts": "2025-06-04T00:00:00Z", "op": "get_node", "slug": "a", "ok": True}) + "\n")
    table.start(stream.read_log(spark, str(folder)), str(tmp_path / "cp")).awaitTermination(120)
    got = sorted(map(tuple, table.version().collect()))
    assert got == sorted(map(tuple, features.features(usage_log.read(spark, str(folder))).select("slug", "event_type", "n", "last_ms").collect()))


def test_stream_delivered_again_with_a_heavy_key(spark, tmp_path, monkeypatch):
    """A whole log that comes again reaches every key's latest event, so all rows are looked at, those of a heavy key too."""
    monkeypatch.setattr(features, "MAX_BROADCAST_KEYS", -1)
    monkeypatch.setattr(skew, "LEAST_HEAVY", 10)
    schema = "ts string, op string, slugs array<string>, actor string, dry boolean, ok boolean, err string, day date"
    rows = [(f"2025-06-01T00:{i // 60:02}:{i % 60:02}Z", "get_node", ["hot"] if i % 3 else [f"k{i}", "b"], None, None, True, None, None) for i in range(300)]
    log = spark.createDataFrame(rows, schema)
    table = stream.FeatureTable(spark, str(tmp_path / "features"))
    for i in range(2):
        table.advance(log, i)
    got = {(r.slug, r.event_type): (r.n, r.last_ms) for r in table.version().collect()}
    at = lambda i: 1748736000000 + 1000 * i
    assert got == {(s, "get_node:lib"): v for s, v in {"hot": (200, at(299)), "b": (100, at(297)), **{f"k{i}": (1, at(i)) for i in range(0, 300, 3)}}.items()}


def test_stream_delivered_again_is_compared_once(spark, tmp_path):
    """A log that comes again goes through one shuffle beside the rows so far, is not spelt out again, and leaves no shuffle files behind."""
    schema = "ts string, op string, slugs array<string>, actor string, dry boolean, ok boolean, err string, day date"
    n = 3000
    log = spark.createDataFrame([(f"2025-06-01T{i // 3600:02}:{i // 60 % 60:02}:{i % 60:02}Z", "get_node", [f"k{i}", "b"], None, None, True, None, None) for i in range(n)], schema)
    sc = spark.sparkContext._jsc.sc()
    shuffles = lambda: {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}

    def moved():
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (stages.apply(i) for i in range(stages.size()))}

    table, before = stream.FeatureTable(spark, str(tmp_path / "features")), shuffles()
    table.advance(log, 0)
    first, done = sorted(map(tuple, table.version().collect())), moved()
    table.advance(log, 1)
    assert sum(v for k, v in moved().items() if k not in done) == 2 * n
    assert sorted(map(tuple, table.version().collect())) == first and len(first) == n + 1
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffles() - before


def test_stream_counts_a_repeated_row_once(spark, tmp_path):
    schema = "ts string, op string, slugs array<string>, actor string, dry boolean, ok boolean, err string, day date"
    row = lambda d, op="get_node": (f"2025-06-0{d}T00:00:00Z", op, ["a", "b"], None, None, True, None, dt.date(2025, 6, d))
    batches = [[row(1), row(2), row(2)], [row(2), row(1, "update_node"), row(3), row(3)], [row(3)]]
    table = stream.FeatureTable(spark, str(tmp_path / "features"))
    for i in (0, 1, 1, 2):
        table.advance(spark.createDataFrame(batches[i], schema), i)
    want = features.features(spark.createDataFrame(sum(batches, []), schema))
    assert sorted(map(tuple, table.version().collect())) == sorted(map(tuple, want.collect()))
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    days = stream.daily(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log")))
    days.writeStream.outputMode("complete").format("memory").queryName("days_once").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r.day.day, r.slug, r.reads, r.writes) for r in spark.table("days_once").collect()) == [(d, s, 1, int(d == 1)) for d in (1, 2, 3) for s in "ab"]
