"""The facade over a folder: reads, edits that are committed, and their invariants."""

import os

import pytest

from loomgraph.__main__ import new_wiki, rows
from loomgraph.api import GraphCache, WikiGraph, fan_out, register_sql, today
from loomgraph.schema import Code, GraphError

PAGES = {"nvidia": ("entities", "entity", "[[hbm]]"), "hbm": ("concepts", "concept", "[[nvidia]]\n- [[asml]]"), "asml": ("entities", "entity", "`[[hbm]]`")}


@pytest.fixture
def root(tmp_path):
    new_wiki(str(tmp_path))
    for slug, (d, kind, body) in PAGES.items():
        (tmp_path / "wiki" / d / f"{slug}.md").write_text(f"---\ntype: {kind}\ntitle: {slug.upper()}\nupdated: 2025-05-01\nkept: yes\n---\n\n# {slug}\n\n{body}\n")
    return str(tmp_path)


def text(root, path):
    with open(os.path.join(root, "wiki", path), encoding="utf-8") as f:
        return f.read()


def test_reads_and_edits(spark, root):
    g = WikiGraph(spark, root)
    assert g.get_node("ASML").title == "ASML" and g.get_node("none") is None
    assert rows(g.get_stats()["totals"]) == [{"nodes": 3, "edges": 3}]
    assert g.get_edges("nvidia").count() == 2 and g.read_graph(center="nvidia", k=1)[0].count() == 2
    assert len(g.rename_node("asml", "asml-holding")) == 3
    assert "[[asml-holding]]" in text(root, "concepts/hbm.md") and "updated: 2025-05-01" in text(root, "concepts/hbm.md").replace("'", "")
    assert "kept:" in text(root, "entities/asml-holding.md") and not os.path.exists(f"{root}/wiki/entities/asml.md")
    assert g.rename_node("asml", "asml-holding") == []
    with pytest.raises(GraphError) as e:
        g.rename_node("hbm", "nvidia")
    assert e.value.code == Code.RENAME_TARGET_EXISTS
    assert len(g.add_edge("nvidia", "asml-holding", " Causes ")) == 1 and g.add_edge("nvidia", "asml-holding", "causes") == []
    assert "relation: causes" in text(root, "entities/nvidia.md")
    assert len(g.remove_edge("nvidia", "asml-holding")) == 1 and "asml" not in text(root, "entities/nvidia.md")
    assert g.add_node("AMD", "entity", "see [[nvidia]]", dry_run=True) and not os.path.exists(f"{root}/wiki/entities/amd.md")
    assert len(g.add_node("AMD", "entity", "see [[nvidia]]")) == 2 and g.get_node("amd").type == "entity"
    assert g.update_node("amd", title="A.M.D.", type="concept") and os.path.exists(f"{root}/wiki/concepts/amd.md")
    assert g.delete_node("asml-holding") and "~~ASML~~" in text(root, "concepts/hbm.md") and g.delete_node("asml-holding") == []
    assert g.rebuild_index() and g.rebuild_index() == [] and "- [[amd]]" in text(root, "index.md")
    assert g.metrics()["degrees"].first()["n"] == 3
    assert {r.slug for r in g.usage_stats().where("total > 0").collect()} >= {"asml", "nvidia"}
    assert g.salience().count() == 3 and g.scan_freshness("2026-01-01").count() == 3
    assert g.purge("2020-01-01") == [] and g.cleanup() == []


def test_views_cache_and_fan_out(spark, root):
    cache = GraphCache(spark, 1)
    g = cache.get(root)
    assert cache.get(root) is g
    names = register_sql(g, "kb_")
    assert spark.sql("SELECT count(*) AS n FROM kb_nodes n JOIN kb_edges e ON e.source = n.slug").first().n == 3 and len(names) == 7
    both, errors = fan_out({"a": g, "b": g, "bad": None}, lambda x: x.list_slugs())
    assert both.count() == 6 and set(errors) == {"bad"}
    with pytest.raises(GraphError):
        WikiGraph(spark, "/nowhere")
    frames = WikiGraph(spark, pages=g.pages())
    assert frames.get_node("hbm").slug == "hbm"
    with pytest.raises(GraphError):
        frames.rebuild_index()


def test_index_follows_edits(spark, root):
    g = WikiGraph(spark, root)
    g.rebuild_index()
    g.add_node("AMD", "entity")
    g.add_node("Note", "memo")
    assert [x for x in text(root, "index.md").splitlines() if x] == [
        "# Index", "## Entities", "- [[amd]] — AMD", "- [[asml]] — ASML", "- [[nvidia]] — NVIDIA", "## Concepts", "- [[hbm]] — HBM", "## Memo", "- [[note]] — Note",
    ]
    g.update_node("amd", title="A.M.D.")
    g.rename_node("asml", "zz")
    g.delete_node("nvidia")
    lines = text(root, "index.md")
    assert "- [[amd]] — A.M.D.\n- [[zz]] — ASML\n" in lines and "nvidia" not in lines and "[[asml]]" not in lines
    quiet = WikiGraph(spark, root, maintain_index=False, maintain_log=False)
    assert len(quiet.add_node("Other", "concept")) == 1 and "other" not in text(root, "index.md") and quiet.logger is None


def test_edits_of_unknown_or_taken_pages(spark, root):
    g = WikiGraph(spark, root)
    for edit in (lambda: g.update_node("nobody", title="x"), lambda: g.add_edge("nvidia", "nobody"), lambda: g.add_edge("nobody", "nvidia"), lambda: g.remove_edge("hbm", "nobody")):
        with pytest.raises(GraphError) as e:
            edit()
        assert e.value.code == Code.NODE_NOT_FOUND and e.value.slug == "nobody"
    with pytest.raises(GraphError) as e:
        g.add_node("NVIDIA", "entity", "new text", on_collision="error")
    assert e.value.code == Code.NODE_ALREADY_EXISTS
    assert any(p.endswith("nvidia-2.md") for p in g.add_node("NVIDIA", "entity", "new text")) and g.add_node("NVIDIA", "entity", "new text") == []
    with pytest.raises(GraphError) as e:
        g.add_node("@#")
    assert e.value.code == Code.INVALID_SLUG
    g.logger.flush()
    errors = [r.err for r in g.usage_log(today(), 2).where("err IS NOT NULL").collect()]
    assert errors.count("NODE_NOT_FOUND") == 4 and "NODE_ALREADY_EXISTS" in errors
    assert g.add_edge("asml", "nvidia", context="## Suppliers") and g.get_edges("asml").count() == 2


@pytest.mark.parametrize("strict", [False, True])
def test_an_edit_in_between_is_not_overwritten(spark, root, strict):
    g = WikiGraph(spark, root, strict_verify=strict)
    g.pages()
    path = f"{root}/wiki/concepts/hbm.md"
    before = open(path).read()
    with open(path, "w") as f:
        f.write(before.replace("HBM", "hbm by hand!"))
    with pytest.raises(GraphError) as e:
        g.rename_node("asml", "asml-holding")
    assert e.value.code == Code.EXTERNAL_MODIFICATION and "by hand" in text(root, "concepts/hbm.md") and os.path.exists(f"{root}/wiki/entities/asml.md")
    g.refresh()
    assert g.rename_node("asml", "asml-holding") and "by hand" in text(root, "concepts/hbm.md") and "[[asml-holding]]" in text(root, "concepts/hbm.md")


def test_purge(spark, root):
    for slug, (d, *_) in PAGES.items():
        p = f"{root}/wiki/{d}/{slug}.md"
        t = open(p).read()
        open(p, "w").write(t.replace("kept: yes", "checked: 2020-01-01\nkept: yes") if slug != "hbm" else t)
    g = WikiGraph(spark, root)
    assert g.purge_report(slugs=["HBM", "no"]) == {"affected": ["hbm"], "not_found": ["no"]}
    assert g.purge_report("2021-01-01") == {"affected": ["asml", "nvidia"], "not_found": [], "kept": 0, "skipped_no_clock": 1}
    assert len(g.purge(slugs=["hbm", "no"])) == 1 and "status: invalidated" in text(root, "concepts/hbm.md")
    gone = g.purge("2021-01-01", hard=True)
    assert sorted(os.path.basename(p) for p in gone if not p.endswith("index.md")) == ["asml.md", "hbm.md", "nvidia.md"]
    assert [r.slug for r in g.list_slugs().collect()] == ["hbm"] and "~~NVIDIA~~" in text(root, "concepts/hbm.md") and "~~ASML~~" in text(root, "concepts/hbm.md")
    with pytest.raises(ValueError):
        g.purge()
