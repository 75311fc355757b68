"""Known values for graph, metrics, scheduling, usage, scoring, text, edit and chat operators."""

import bisect
import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import frontmatter
from loomgraph.functions import text as X
from loomgraph.operators import chat, dml, freshness, graph, metrics, scoring, usage, walk
from loomgraph.operators import pages as P
from loomgraph.schema import Code, GraphError, ResultTooLarge, Tuning

NODE = "slug string, title string, type string, tags array<string>, sources array<string>, wikilink_targets array<string>, related array<struct<slug:string,relation:string>>, created string, updated string, as_of string, checked string, content string, path string, status string, superseded_by string, compression string, ord bigint"


def page(slug, ord=0, **k):
    base = dict(slug=slug, title=slug.upper(), type="concept", tags=[], sources=[], wikilink_targets=[], related=[], created="2025-01-01", updated="2025-01-01", as_of=None, checked=None, content="", path=f"wiki/concepts/{slug}.md", status=None, superseded_by=None, compression=None, ord=ord)
    return base | k


def frame(spark, *pages):
    names = [x.split()[0] for x in NODE.split(", ")]
    return spark.createDataFrame([tuple(p[n] for n in names) for p in pages], NODE)


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, ["wikilink"], None, i) for i, (a, b) in enumerate(pairs)], "source string, target string, origins array<string>, relation string, ord bigint")


def names(spark, text):
    return frame(spark, *[page(s, i) for i, s in enumerate(text.split())])


def test_degree_and_components(spark):
    n, e = names(spark, "a b c"), edges(spark, ("a", "b"), ("b", "c"))
    s = metrics.degree_stats(graph.degree_table(n, e)).first()
    assert (s.mean, s["max"], s.isolated, s.median) == (1.33, 2, 0, 1)
    assert metrics.component_summary(graph.components(n, e)).first().asDict() == {"components": 1, "largest": 3, "ratio": 1.0, "fragmentation": 0.0}
    n, e = names(spark, "a b c d"), edges(spark, ("a", "b"), ("c", "d"))
    assert metrics.component_summary(graph.components(n, e)).first().asDict() == {"components": 2, "largest": 2, "ratio": 0.5, "fragmentation": 0.5}
    none = n.where("false")
    assert metrics.degree_stats(graph.degree_table(none, e.where("false"))).first()["n"] == 0
    assert metrics.component_summary(graph.components(none, e.where("false"))).first().components == 0


def test_hubs(spark):
    leaves = " ".join(f"leaf{i}" for i in range(10))
    star = metrics.hubs(graph.degree_table(names(spark, "hub " + leaves), edges(spark, *[("hub", f"leaf{i}") for i in range(10)]))).collect()
    assert (star[0].slug, star[0].n_out, star[0].total) == ("hub", 10, 10)
    ring = metrics.hubs(graph.degree_table(names(spark, "a b c"), edges(spark, ("a", "b"), ("b", "c"), ("c", "a"))))
    assert ring.count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"v{rng.randrange(120):03}", f"v{rng.randrange(120):03}") for _ in range(70)] + [(f"c{i:02}", f"c{i + 1:02}") for i in range(30)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    n = names(spark, " ".join(up) + " lonely")
    got = {(r.slug, r.component) for r in graph.components(n, edges(spark, *pairs)).collect()}
    assert got == {(x, find(x)) for x in up} | {("lonely", "lonely")}


def test_walks_and_limits(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "d"), ("a", "a"), ("x", "c"), ("d", "x"))
    assert {(r.slug, r.depth) for r in graph.neighbourhood(e, "a", 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert [tuple(r) for r in graph.neighbourhood(e, "nobody", 3).collect()] == [("nobody", 0)]
    assert {(r.source, r.target, r.depth) for r in graph.tree_edges(e, "a", 3).collect()} == {("a", "b", 1), ("b", "c", 2), ("c", "d", 3), ("x", "c", 3)}
    assert sorted((r.source, r.direction) for r in graph.in_out(e, "a").collect()) == [("a", "inbound"), ("a", "outbound"), ("a", "outbound")]
    n = names(spark, "a b c d x")
    kept, inside = graph.read_graph(n, e, center="a", k=1)
    assert kept.count() == 2 and inside.count() == 2
    with pytest.raises(ResultTooLarge) as err:
        graph.read_graph(n, e, limit=2)
    assert err.value.code == Code.RESULT_TOO_LARGE and err.value.suggestions["types"] == [("concept", 5)]


@pytest.mark.parametrize("most", [0, 100_000])
def test_frontiers_of_any_size(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "MAX_BROADCAST_FRONT", most)
    e = edges(spark, *[("hub", f"n{i}") for i in range(50)], *[(f"n{i}", f"m{i % 7}") for i in range(50)], ("m0", "end"))
    depth = {r.slug: r.depth for r in graph.neighbourhood(e, "hub", 3).collect()}
    assert depth == {"hub": 0, "end": 3, **{f"n{i}": 1 for i in range(50)}, **{f"m{i}": 2 for i in range(7)}}
    assert graph.tree_edges(e, "hub", 3).count() == 58 and graph.tree_edges(e, "hub", 5).count() == 58


def test_suggestions_of_a_refusal(spark):
    n, e = names(spark, "a b c d x"), edges(spark, ("a", "b"), ("b", "c"))
    with pytest.raises(ResultTooLarge) as err:
        graph.read_graph(n, e, limit=1, center="a", k=2)
    assert err.value.suggestions["reduce_k"] == 1 and err.value.suggestions["increase_limit"] == 3
    assert set(graph.node_columns(n).columns) & {"content", "wikilink_targets"} == set() and "content" in graph.page_columns(n).columns


def test_places_hold_long_arrays(spark):
    """A page of more links than any packed number had room for comes before the next page."""
    n = frame(spark, page("a", 1, wikilink_targets=["x"] * 100_001 + ["b"], related=[("b", None)] * 3), page("b", 2, wikilink_targets=["a"], tags=["t"] * 3), page("c", 3, tags=["u"] * 3), page("a0", 0, tags=["v"] * 1500 + ["t2"]))
    (row,) = graph.build(n).where("source = 'a'").collect()
    assert row.origins == ["wikilink", "related"] and (row.ord["ord"], row.ord["kind"], row.ord["pos"]) == (1, 0, 100_001)
    assert [r.value for r in P.ranked(P.value_counts(n.where("slug <> 'a'"), "tags"), "n").collect()] == ["v", "t", "u", "t2"]


def test_build_merges_carriers(spark):
    n = frame(spark, page("a", 1, wikilink_targets=["b", "nobody"], related=[("b", "causes"), ("B", "is_a"), ("[[c]]", " Explains "), (None, None)]), page("b", 2, related=[("a", None)]), page("c", 3))
    got = {(r.source, r.target): (r.origins, r.relation) for r in graph.build(n).collect()}
    assert got == {("a", "b"): (["wikilink", "related"], "causes"), ("a", "c"): (["related"], "explains"), ("b", "a"): (["related"], None)}
    assert [r.target for r in graph.dangling(n).collect()] == ["nobody"]


def test_sources_and_types(spark):
    n = frame(spark, page("a", 1, sources=["s1", "s2"], type="entity"), page("b", 2, sources=["s1"], type="entity"), page("c", 3, sources=["s2"]), page("d", 4, sources=["s2", "s1"]))
    assert [(r.source, r.n) for r in P.ranked(metrics.source_index(n), "n").collect()] == [("s1", 3), ("s2", 3)]
    assert [(r.n, r.first_slug, r.last_slug) for r in metrics.duplicate_clusters(n).collect()] == [(2, "a", "d")]
    assert {(r.slug, r.first_slug) for r in metrics.cluster_members(n).collect()} == {("a", "a"), ("d", "a")}
    m = {(r.source_type, r.target_type): (r.n, r.ratio) for r in metrics.type_matrix(n, edges(spark, ("a", "c"), ("a", "b"), ("c", "a"))).collect()}
    assert m == {("entity", "entity"): (1, 0.5), ("entity", "concept"): (1, 0.5), ("concept", "entity"): (1, 1.0), ("concept", "concept"): (0, 0.0)}
    assert {r.type for r in metrics.empty_types(n).collect()} == {"source", "query", "comparison", "synthesis", "dream", "overview"}


FRESH = [
    ("2025-06-01", "2025-06-15", None, False, 7, "checked"),
    (None, "2025-06-15", None, False, 7, "checked"),
    ("2023-01-01", "2025-06-15", None, False, 74, "checked"),
    ("1985-01-01", "2025-01-01", None, False, 1095, "checked"),
    ("2025-06-01", None, "2025-06-15", False, 7, "updated"),
    ("2025-06-01", None, "", False, None, None),
    ("not-a-date", "2025-06-15", None, False, None, None),
    ("2025-06-30", "2025-06-15", None, False, 7, "checked"),
    ("2025-01-01", None, "2026-08-01", True, 7, "as_of"),
    (None, None, "2026-08-01", True, None, None),
]


@pytest.mark.parametrize("case", FRESH)
def test_freshness(spark, case):
    as_of, checked, updated, ignore, interval, clock = case
    row = freshness.schedule(frame(spark, page("a", as_of=as_of, checked=checked, updated=updated)), "2026-05-15", ignore_updated=ignore).first()
    assert (row.interval_days, row.clock) == (interval, clock)


def test_freshness_buckets_and_purge(spark):
    n = frame(spark, page("old", as_of="2020-01-01", checked="2025-01-01"), page("bad", status="invalidated"), page("none", updated=""), page("dream", type="dream"), page("soon", as_of="2025-12-31", checked="2026-05-13"))
    got = {r.slug: (r.bucket, r.next_due, r.overdue_days) for r in freshness.schedule(n, "2026-05-15").collect()}
    assert got["old"] == ("due", "2025-06-02", 347) and got["bad"][0] == "skipped_invalidated" and got["none"][0] == "skipped_no_clock" and got["dream"][0] == "skipped_dream"
    assert got["soon"] == ("upcoming", "2026-05-24", -9)
    assert [(r.slug, r.clock_source) for r in freshness.purge_candidates(n, "2025-02-01").collect()] == [("old", "checked")]
    assert freshness.purge_summary(n, "2025-02-01").first().asDict() == {"affected": 1, "kept": 1, "skipped_no_clock": 3}
    assert freshness.purge_summary(n, "", ["old", "x"]).first().asDict() == {"affected": 1, "not_found": 1}
    with pytest.raises(ValueError):
        freshness.schedule(n, "soon")


def test_usage(spark):
    log = "ts string, op string, slugs array<string>, actor string, dry boolean, ok boolean, err string, day date"
    day = dt.date(2026, 8, 7)
    rows = [("t1", "get_node", ["alpha"], "reason"), ("t2", "get_node", ["alpha"], "check"), ("t3", "update_node", ["alpha"], "check"), ("t4", "add_edge", ["a", "b"], None), ("t5", "get_stats", None, "dream"), ("t5", "get_stats", None, "dream"), ("t6", None, ["a"], None)]
    df = spark.createDataFrame([(*r, None, False, None, day) for r in rows] + [("t0", "get_node", ["old"], "dream", None, True, None, day - dt.timedelta(days=10))], log)
    per = {r.slug: (r.reads, r.writes, r.total, r.last_ts) for r in usage.counts(usage.events(df)).collect()}
    assert per["alpha"] == (2, 1, 3, "t3") and per["a"] == (0, 1, 1, "t4") == per["b"]
    assert {r.slug: r.by_actor for r in usage.by_actor_map(usage.events(df)).collect()}["alpha"] == {"check": 2, "reason": 1}
    assert {r.slug for r in usage.counts(usage.events(usage.window(df, "2026-08-07", 7))).collect()} == {"alpha", "a", "b"}
    assert usage.totals(df, usage.events(df)).first().asDict() == {"events": 6, "interface_events": 1, "days": 2}
    assert "old" not in {r.slug for r in usage.counts(usage.events(df, exclude_actor="dream")).collect()}
    full = usage.with_universe(usage.counts(usage.events(df)), names(spark, "alpha forgotten"))
    assert usage.top(full, 1).first().slug == "alpha" and usage.bottom(full, 1).first().slug == "forgotten"


def test_scores(spark):
    n = frame(spark, page("old", created="2026-01-01", updated="2026-01-01"), page("fresh", created="2026-08-05", updated="2026-08-05"), page("touched", updated="2026-08-06"), page("d", type="dream", created="2026-08-06"))
    rows = {r.component: r.n for r in scoring.pressure(n, 0, "2026-08-07", "2026-08-01").collect()}
    assert (rows["new"], rows["updated"], rows["days"]) == (1, 1, 6)
    assert scoring.pressure_score(scoring.pressure(n, 0, "2026-08-07", "2026-08-01")).first().score == 7.5
    two = frame(spark, page("hub", checked=None), page("lonely"))
    used = spark.createDataFrame([("hub", 10)], "slug string, total bigint")
    due = spark.createDataFrame([], "slug string, overdue_days int")
    got = {r.slug: r.score for r in scoring.salience(two, edges(spark, ("x", "hub"), ("y", "hub")), used, due, "2026-08-07").collect()}
    assert got == {"hub": 0.8, "lonely": 0.2}
    entries = spark.createDataFrame([("stale", 0, 0, 393, None), ("fresh", 0, 4, 12, None)], "slug string, used int, n_in int, overdue_days int, compression string")
    forget = {r.slug: r.forget_score for r in scoring.forgettability(entries).collect()}
    assert forget == {"stale": 0.85, "fresh": 0.356}
    live = scoring.threads(frame(spark, page("h", content="Status:  hypothesis"), page("c", related=[("h", "Contradicts")]), page("v", tags=["needs-verification"])))
    assert {tuple(r) for r in live.collect()} == {("hypothesis", "h"), ("contradicts", "c→h"), ("needs-verification", "v")}
    old = spark.createDataFrame([("hypothesis:h",), ("hypothesis:gone",), ("bare",), ("contradicts:c→h",)], "thread string")
    assert {r.thread for r in scoring.carried(old, live).collect()} == {"hypothesis:h", "bare", "contradicts:c→h"}
    assert scoring.theme_terms("深海章鱼 Oil-on") == ["oil", "深海", "海章", "章鱼"] and scoring.theme_terms("!!! ???") == []


def brute_trails(pool, near, seed, tuning=Tuning()):
    """Trails over lists in memory, with running sums of weights."""
    draw, taken, out = walk.rng(seed), [], []

    def weighted(without):
        left = [(s, max(tuning.floor_weight, w)) for s, w in pool if s not in without]
        sums = list(itertools.accumulate(w for _, w in left))
        return left[min(bisect.bisect_left(sums, draw() * sums[-1]), len(left) - 1)][0]

    while len(taken) < min(tuning.seed_count, len(pool)):
        taken.append(weighted(taken))
        trail = [(taken[-1], "")]
        for _ in range(tuning.hops[0] + int(draw() * (tuning.hops[1] - tuning.hops[0] + 1))):
            on, wants = [s for s, _ in trail], draw() < tuning.p_edge
            if len(on) == len(pool):
                break
            if wants:
                free = [s for s in near.get(on[-1], []) if s not in on]
                trail.append((free[int(draw() * len(free))], "edge") if free else (weighted(on), "dead-end"))
            else:
                trail.append((weighted(on), "teleport"))
        out.append(trail)
    return out


def test_walk_is_seeded(spark):
    draw = walk.rng("20260807")
    assert [round(draw(), 12) for _ in range(4)] == [0.17438494321, 0.817511929432, 0.190543711418, 0.991866750177]
    pool = [(c, 1 - i / 10) for i, c in enumerate("abcdefgh")]
    near = {"a": ["b"], "b": ["a", "c"], "c": ["b"], "d": ["e"], "e": ["d"]}
    ranking = spark.createDataFrame(pool, "slug string, score double")
    rows = walk.walk(ranking, edges(spark, ("a", "b"), ("b", "c"), ("d", "e")), "20260807").orderBy("scene", "step").collect()
    got = [[(r.node, r.via) for r in rows if r.scene == i] for i in range(7)]
    assert got[0] == [("a", ""), ("b", "edge"), ("d", "teleport"), ("e", "edge"), ("c", "dead-end")]
    assert got == brute_trails(pool, near, "20260807") and max(r.scene for r in rows) == 6
    two = walk.walk(ranking.where("slug < 'c'"), edges(spark, ("a", "b")), "x").collect()
    assert {r.scene for r in two} == {0, 1} and len(two) == 4 and walk.walk(ranking.where("false"), edges(spark, ("a", "b")), "x").count() == 0
    assert Tuning().seed_count == 7 and Tuning(certainty=1.0).seed_count == 5 and Tuning().merged(forget={"stale": 1.0}).forget["unread"] == 0.35


def test_walk_draws_from_every_page(spark):
    n, seed = 60_000, "20260807"
    pool = sorted(((f"p{i:05}", i % 7 / 50) for i in range(n)), key=lambda p: (-p[1], p[0]))
    near = {f"p{i:05}": [f"p{j:05}" for j in (i - 1, i + 1) if 0 <= j < n] for i in range(n)}
    slug = lambda i: F.format_string("p%05d", i)
    ranking = spark.range(n, numPartitions=8).select(slug("id").alias("slug"), (F.col("id") % 7 / 50).alias("score"))
    ring = spark.range(n - 1).select(slug("id").alias("source"), slug(F.col("id") + 1).alias("target"), F.col("id").alias("ord"))
    want = [(i, j, p) for i, trail in enumerate(brute_trails(pool, near, seed)) for j, (p, _) in enumerate(trail)]
    assert [(r.scene, r.step, r.node) for r in walk.walk(ranking, ring, seed).orderBy("scene", "step").collect()] == want
    low = {s for s, _ in pool[50_000:]}
    assert any(p in low for *_, p in want)


SLUGS = {"Hello World": "hello-world", "AI基建周期": "ai基建周期", "Ｈｅｌｌｏ": "hello", "（テスト）": "テスト", "a -- b --- c": "a-b-c", "-hello-": "hello", "hello@world!": "helloworld", "a/b\\c": "abc", "英伟达 (NVIDIA)": "英伟达-nvidia", "console": "console", "@#$%": None, "": None, "con": None, "com1": None}


def test_slugs(spark):
    for title, want in SLUGS.items():
        if want is None:
            with pytest.raises(GraphError):
                X.title_to_slug(title)
        else:
            assert X.title_to_slug(title) == want
    df = X.with_slug(spark.createDataFrame([(t,) for t in SLUGS], "t string"), "s", F.col("t"))
    assert {r.t: r.s for r in df.collect()} == SLUGS


LINKS = ["See [[nvidia]] and [[hbm]].", "[[nvidia|NVIDIA Corp]]", "```\n[[no]]\n```\n~~~\n[[no]]\n~~~\n`[[no]]` [[yes]] [[yes]]", "", "none"]


def test_wikilinks(spark):
    want = [["nvidia", "hbm"], ["nvidia"], ["yes", "yes"], [], []]
    assert [X.extract_wikilinks(t) for t in LINKS] == want
    df = spark.createDataFrame([(i, t) for i, t in enumerate(LINKS)], "i int, t string").orderBy("i")
    assert [r.w for r in df.select(X.wikilinks(F.col("t")).alias("w")).collect()] == want
    assert X.remove_wikilinks("See [[nvidia]] for details.", "nvidia") == "See  for details."
    assert X.remove_wikilinks("- [[nvidia]]\n`[[nvidia]]`", "nvidia") == "`[[nvidia]]`"
    assert X.replace_wikilinks("[[old-slug|Display Name]] [[OLD-slug]]", "old-slug", "new") == "[[new|Display Name]] [[new]]"
    assert X.dangling_wikilink("a [[x]]", "x", "T") == "a ~~T~~" and X.dangling_wikilink("a [[x]]", "x", "T", "plain-text") == "a T"
    assert X.insert_wikilink("# A\n\n## 相关\n\n- [[b]]\n", "c") == "# A\n\n## 相关\n\n- [[b]]\n- [[c]]\n"
    assert X.insert_wikilink("# A\n", "c").endswith("## 相关\n\n- [[c]]\n")
    assert X.insert_wikilink("# A\n## Ctx\nx\n# B", "c", "Ctx") == "# A\n## Ctx\nx\n- [[c]]\n# B"


def test_frontmatter():
    front, body = frontmatter.parse("---\ntype: concept\ncreated: 2025-01-15\nn: 1.0\nyes: no\ntags: [a, 2]\nrelated: [x, {slug: y, relation: causes}]\n---\n\nbody\n")
    assert front["created"] == "2025-01-15" and front["n"] == "1" and front["yes"] == "no" and front["tags"] == ["a", "2"] and body == "\nbody\n"
    assert front["related"] == [{"slug": "x", "relation": None}, {"slug": "y", "relation": "causes"}]
    assert frontmatter.parse("no front matter") == (None, "no front matter")
    assert frontmatter.parse("junk\nmore\n---\ntitle: T\n---\nx")[0] == {"title": "T"}
    assert frontmatter.parse("```yaml\n---\ntitle: T\n---\n```\nx")[0] == {"title": "T"}
    assert [r["slug"] for r in frontmatter.parse("---\nrelated: [[a]], [[b]], [[c]]\n---\n")[0]["related"]] == ["a", "b", "c"]
    assert frontmatter.parse("---\na: 1\na: 2\n---\n")[0] is None
    again, body = frontmatter.parse(frontmatter.compose({"title": "T: x", "related": [{"slug": "a", "relation": None}]}, "b"))
    assert again == {"title": "T: x", "related": [{"slug": "a", "relation": None}]} and body.strip() == "b"


def test_edits(spark):
    n = frame(spark, page("a", 1, content="[[b]] [[b|B!]] `[[b]]`", related=[("b", "causes")]), page("b", 2, title="Bee"), page("c", 3))
    got = {r.slug: r for r in dml.rename(n, "b", "bb", "2026-01-01").collect()}
    assert got["a"].content == "[[bb]] [[bb|B!]] `[[b]]`" and got["a"].related[0].slug == "bb" and got["a"].updated == "2025-01-01"
    assert got["b"].new_path == "wiki/concepts/bb.md" and got["b"].updated == "2026-01-01" and set(got) == {"a", "b"}
    with pytest.raises(GraphError):
        dml.rename(n, "b", "c", "x")
    assert dml.rename(n, "gone", "c", "x").count() == 0
    gone = {r.slug: r for r in dml.delete(n, "b").collect()}
    assert gone["a"].content == "~~Bee~~ ~~Bee~~ `[[b]]`" and gone["a"].related == [] and gone["b"].action == "delete"
    assert dml.delete(n, "nobody").count() == 0
    patch = spark.createDataFrame([("c", "entity", "Sea"), ("a", "concept", None), ("zz", "entity", "Z")], "slug string, type string, title string")
    (row,) = dml.update(n, patch, "2026-01-01").collect()
    assert (row.slug, row.new_path, row.title, sorted(row.fields_changed)) == ("c", "wiki/entities/c.md", "Sea", ["title", "type"])
    new = spark.createDataFrame([("B", "x [[c]] [[nope]]"), ("New One", None), ("B", "other")], "title string, content string")
    added = {r.slug: r for r in dml.add(n, new, "2026-01-01").collect()}
    assert set(added) == {"b-2", "b-3", "new-one"} and added["new-one"].path == "wiki/synthesis/new-one.md"
    assert {tuple(r.dangling) for r in added.values()} == {("nope",), ()}
    want = spark.createDataFrame([("c", "a", " Causes "), ("a", "b", None), ("b", "b", "is_a")], "source string, target string, relation string")
    links = {r.slug: r for r in dml.add_edges(n, want).collect()}
    assert set(links) == {"c", "b"} and links["c"].related[0].relation == "causes" and "[[a]]" in links["c"].content and links["b"].related == []
    off = dml.remove_edges(n, spark.createDataFrame([("a", "b"), ("c", "b")], "source string, target string")).collect()
    assert [(r.slug, r.content, r.related) for r in off] == [("a", "  `[[b]]`", [])]


def test_chat_window(spark):
    rows, turn = [("c", 0, "system", "s", None, None), ("c", 1, "user", "u", None, None)], 2
    for i in range(1, 18):
        calls = [f"c{i}"] if i != 9 else ["c9", "c9b"]
        rows.append(("c", turn, "assistant", "", None, calls))
        for c in calls:
            turn += 1
            rows.append(("c", turn, "tool", f"{c} " + ("ANCHOR " if c == "c3" else "") + "x" * 6000, c, None))
        turn += 1
    schema = "conv_id string, turn int, role string, content string, tool_call_id string, tool_call_ids array<string>"
    df = spark.createDataFrame(rows, schema)
    got = {(r.turn): r for r in chat.window(df, ["ANCHOR"]).collect()}
    kept = [r for r in got.values() if r.fate != "summarize"]
    have = {c for r in kept for c in (r.tool_call_ids or [])}
    assert all(r.tool_call_id in have for r in kept if r.role == "tool") and got[0].fate == got[1].fate == "keep"
    assert {r.tool_call_id for r in got.values() if r.role == "tool" and r.fate == "shorten"} == {"c3"}
    assert all(r.fate == "keep" for r in chat.window(df.where("turn < 8")).collect())
    s = chat.summary(chat.window(df, ["ANCHOR"])).first()
    assert s.operations == len(got) - len(kept) - sum(r.role == "assistant" and r.fate == "summarize" for r in got.values())
    assert chat.resolve_tool(["x__get_node", "y"], "get_node") == "x__get_node" and chat.resolve_tool(["a__b", "c__b"], "b") is None
    log = spark.createDataFrame([("update_node", True, "a", None, None), ("rename_node", True, None, "b", "c"), ("update_node", False, "z", None, None), ("get_node", True, "q", None, None)], "tool string, ok boolean, slug string, old_slug string, new_slug string")
    assert {r.slug for r in chat.touched_slugs(log).collect()} == {"a", "b", "c"}


