"""The directed graph of pages: building it, walking it, and its groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loomgraph.functions.canonical import with_canonical
from loomgraph.operators import pages as P
from loomgraph.operators.numbering import Forest, decode, encode
from loomgraph.operators.skew import heavy_keys, lookup_join, with_group_min
from loomgraph.runtime import cut, local, release
from loomgraph.schema import EDGE_LIMIT, EDGE_MAX, MAX_HOPS, READ_LIMIT, READ_MAX, ResultTooLarge


def carriers(nodes: DataFrame) -> DataFrame:
    """(source, target, origin, relation, seen): every link as it is written. seen, its place, is (page's ord, kind, position): wikilinks of a page before its related entries."""
    place = lambda kind: F.struct("ord", F.lit(kind).alias("kind"), "pos").alias("seen")
    link = nodes.select(F.col("slug").alias("source"), "ord", F.posexplode("wikilink_targets").alias("pos", "target"))
    link = link.select("source", "target", F.lit("wikilink").alias("origin"), F.lit(None).cast("string").alias("relation"), place(0))
    rel = P.related(nodes).withColumnRenamed("slug", "source")
    return link.unionByName(rel.select("source", "target", F.lit("related").alias("origin"), "relation", place(1)))


def merge(links: DataFrame) -> DataFrame:
    """(source, target, origins, relation, ord): one edge per ordered pair; origins and the first named relation in order of appearance."""
    return (
        links.groupBy("source", "target", "origin")
        .agg(F.min("seen").alias("seen"), F.min(F.when(F.col("relation").isNotNull(), F.struct("seen", "relation"))).alias("rel"))
        .groupBy("source", "target")
        .agg(F.sort_array(F.collect_list(F.struct("seen", "origin"))).alias("o"), F.min("rel").alias("rel"), F.min("seen").alias("ord"))
        .select("source", "target", F.transform("o", lambda x: x["origin"]).alias("origins"), F.col("rel.relation").alias("relation"), "ord")
    )


def build(nodes: DataFrame) -> DataFrame:
    """Edges between existing pages; links to nothing are left out before the merge."""
    known = nodes.select(F.col("slug").alias("target"))
    return merge(lookup_join(carriers(nodes), known, "target", "left_semi"))


def dangling(nodes: DataFrame) -> DataFrame:
    """(source, target, origin, seen): links whose target is no page."""
    marked = lookup_join(carriers(nodes), nodes.select(F.col("slug").alias("target"), F.lit(True).alias("known")), "target")
    return marked.where(F.col("known").isNull()).select("source", "target", "origin", "seen")


def from_table(edges: DataFrame) -> DataFrame:
    """The edge table made simple: canonical ends, both there; repeated rows are one edge with all origins and its first named relation."""
    rows = with_canonical(edges.select("source", "target", "origins", "relation", "ord"), "source", F.col("source"))
    rows = with_canonical(with_canonical(rows, "target", F.col("target")), "relation", F.col("relation"))
    rows = rows.where(F.col("source").isNotNull() & F.col("target").isNotNull())
    flat = rows.select("source", "target", "relation", "ord", F.explode_outer("origins").alias("origin"))
    return (
        flat.groupBy("source", "target")
        .agg(F.sort_array(F.collect_set("origin")).alias("origins"), F.min(F.when(F.col("relation").isNotNull(), F.struct("ord", "relation"))).alias("rel"), F.min("ord").alias("ord"))
        .select("source", "target", "origins", F.col("rel.relation").alias("relation"), "ord")
    )


def _entry(end: int) -> Column:
    return F.struct("ord", F.lit(end).alias("end"))


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge: (a, b, source, target, eord); a loop is one row. eord, (ord, end), puts an edge's source entry before its target's."""
    ends = F.array(
        F.struct(F.col("source").alias("a"), F.col("target").alias("b"), _entry(0).alias("eord")),
        F.struct(F.col("target").alias("a"), F.col("source").alias("b"), _entry(1).alias("eord")),
    )
    return edges.select("source", "target", F.inline(F.when(F.col("source") == F.col("target"), F.slice(ends, 1, 1)).otherwise(ends)))


def degrees(edges: DataFrame) -> DataFrame:
    """(slug, n_in, n_out, total, seen) of every slug on an edge; a loop counts twice in the total. Combined before the shuffle."""
    ends = F.array(
        F.struct(F.col("source").alias("slug"), F.lit(0).alias("i"), F.lit(1).alias("o"), _entry(0).alias("seen")),
        F.struct(F.col("target").alias("slug"), F.lit(1).alias("i"), F.lit(0).alias("o"), _entry(1).alias("seen")),
    )
    per = edges.select(F.inline(ends)).groupBy("slug").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), F.min("seen").alias("seen"))
    return per.withColumn("total", F.col("n_in") + F.col("n_out"))


def degree_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(slug, ord, n_in, n_out, total) of every node, zeros included."""
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return nodes.select("slug", "ord").join(degrees(edges).drop("seen"), "slug", "left").select("slug", "ord", zero("n_in"), zero("n_out"), zero("total"))


#: A frontier of more nodes is joined by a salted shuffle instead of a broadcast.
MAX_BROADCAST_FRONT = 100_000


def _meet(both: DataFrame, front: DataFrame, n: int, how: str = "inner") -> DataFrame:
    """Directed rows (a, ...) that start in the frontier (a), which has n rows."""
    return both.join(F.broadcast(front), "a", how) if n <= MAX_BROADCAST_FRONT else lookup_join(both, front, "a", how)


def neighbourhood(edges: DataFrame, center: str, k: int = 1) -> DataFrame:
    """(slug, depth) within k hops of center in either direction, itself at depth 0; k above MAX_HOPS counts as MAX_HOPS.

    The edges are written down once, in both directions; each hop joins the frontier alone with them. An unknown center is alone.
    """
    spark = edges.sparkSession
    seen = front = local(spark, [(center, 0)], "slug string, depth int")
    hops, n = min(k, MAX_HOPS), 1
    both = undirected(edges.select("source", "target", "ord")).select("a", "b")
    if hops > 1:
        both = cut(both, "both")
    for hop in range(1, hops + 1):
        step = _meet(both, front.select(F.col("slug").alias("a")), n, "left_semi").select(F.col("b").alias("slug")).distinct()
        at = Observation()
        front = cut(step.join(seen.select("slug"), "slug", "left_anti").withColumn("depth", F.lit(hop)), "hop", at, F.count("*").alias("n"))
        n = at.get.get("n") or 0
        seen = seen.unionByName(front)
        if not n:
            break
    release(both)
    return seen


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends among kept (slug)."""
    a, b = kept.select(F.col("slug").alias("source")), kept.select(F.col("slug").alias("target"))
    edges = cut(edges, "edges") if not hasattr(edges, "loom_path") else edges  # both ends' heavy keys are counted on it
    heavy = heavy_keys(edges, "target")
    return lookup_join(lookup_join(edges, a, "source", "left_semi"), b, "target", "left_semi", heavy)


def in_out(edges: DataFrame, slug: str) -> DataFrame:
    """A node's edges with `direction` inbound or outbound; a loop is in both."""
    hit = edges.where((F.col("source") == slug) | (F.col("target") == slug))
    ways = F.array_compact(F.array(F.when(F.col("target") == slug, "inbound"), F.when(F.col("source") == slug, "outbound")))
    return hit.select("source", "target", "origins", "relation", "ord", F.explode(ways).alias("direction"))


def tree_edges(edges: DataFrame, slug: str, k: int) -> DataFrame:
    """(source, target, depth): the edges by which a breadth-first walk of up to k hops first meets each node.

    Of several edges to a new node that one counts whose near end was met first; among its edges, the earliest.
    """
    spark = edges.sparkSession
    both = cut(undirected(edges.select("source", "target", "ord")), "both")
    # a node's place in the walk is the list of edge places that led to it; lists of one hop compare like the walk's order
    place = both.schema["eord"].dataType.simpleString()
    front, n = local(spark, [(slug, [])], f"a string, rank array<{place}>"), 1
    seen = front.select(F.col("a").alias("b"))
    out = local(spark, [], "source string, target string, depth int")
    for hop in range(1, min(k, MAX_HOPS) + 1):
        new = _meet(both, front, n).join(seen, "b", "left_anti").select("b", F.concat("rank", F.array("eord")).alias("rank"), "source", "target")
        at = Observation()
        found = cut(new.groupBy("b").agg(F.min(F.struct("rank", "source", "target")).alias("m")).select("b", "m.*"), "tree", at, F.count("*").alias("n"))
        n = at.get.get("n") or 0
        out = out.unionByName(found.select("source", "target", F.lit(hop).alias("depth")))
        front = found.select(F.col("b").alias("a"), "rank")
        seen = seen.unionByName(found.select("b"))
        if not n:
            break
    release(both)
    return out


def read_nodes(nodes: DataFrame, edges: DataFrame | None = None, center: str | None = None, k: int = 1, type: str | None = None, tag: str | None = None, query: str | None = None) -> DataFrame:
    """Nodes that pass all given filters: within k hops of center; of a type; with a tag; with the text in title or slug (case aside)."""
    out = nodes
    if center is not None:
        out = out.join(neighbourhood(edges, center, k).select("slug"), "slug", "left_semi")
    if type is not None:
        out = out.where(F.col("type") == type.lower())
    if tag is not None:
        out = out.where(F.exists("tags", lambda t: F.lower(t) == tag.lower()))
    if query is not None:
        q: Column = F.lit(query.lower())
        out = out.where(F.contains(F.lower("title"), q) | F.contains(F.lower("slug"), q))
    return out


def guarded(df: DataFrame, limit: int | None, default: int, most: int, suggest=None) -> DataFrame:
    """df itself if it has at most min(limit or default, most) rows; else ResultTooLarge. Only limit + 1 rows are ever counted."""
    allowed = min(default if limit is None else limit, most)
    if df.limit(allowed + 1).count() > allowed:
        n = df.count()
        raise ResultTooLarge(n, allowed, suggest(n, allowed) if suggest else {})
    return df


def suggestions(nodes: DataFrame, count: int = 0, limit: int = READ_LIMIT, k: int | None = None) -> dict:
    """How to ask for less: the five most frequent types and tags, fewer hops where there are several, a higher limit up to READ_MAX."""
    types = nodes.groupBy("type").agg(F.count("*").alias("n"), F.min("ord").alias("seen"))
    out: dict = {
        "types": [(r.type, r.n) for r in P.ranked(types, "n", 5).collect()],
        "tags": [(r.value, r.n) for r in P.ranked(P.value_counts(nodes, "tags"), "n", 5).collect()],
    }
    if k is not None and k > 1:
        out["reduce_k"] = k - 1
    return out | {"increase_limit": min(max(count, limit), READ_MAX)}


NODE_COLUMNS = ["slug", "title", "type", "tags", "sources", "related", "created", "updated", "as_of", "checked", "path", "status", "superseded_by", "compression", "ord"]


def node_columns(pages: DataFrame) -> DataFrame:
    """A page as a node of the graph: without its text, links and file."""
    return pages.select(*[c for c in NODE_COLUMNS if c in pages.columns])


def page_columns(pages: DataFrame) -> DataFrame:
    """A page in full, as a reader gets it: a node with its text."""
    return pages.select(*[c for c in [*NODE_COLUMNS, "content"] if c in pages.columns])


def read_graph(nodes: DataFrame, edges: DataFrame, limit: int | None = None, **filters) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the filtered subgraph; more nodes than the limit are refused, not cut off."""
    kept = read_nodes(nodes, edges, **filters)
    guarded(kept, limit, READ_LIMIT, READ_MAX, lambda n, allowed: suggestions(nodes, n, allowed, filters.get("k", 1) if filters.get("center") else None))
    return node_columns(kept), induced(edges, kept)


def get_edges(edges: DataFrame, slug: str, k: int = 1, limit: int | None = None) -> DataFrame:
    return guarded(in_out(edges, slug) if k == 1 else tree_edges(edges, slug, k), limit, EDGE_LIMIT, EDGE_MAX)


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(slug, component): the smallest slug linked to each node, lone nodes with themselves; ends of edges that are no nodes join nothing.

    Alternating large-star and small-star steps over numbered (lo, hi) rows: in a large star a node's greater neighbours are hung on its least,
    in a small star its smaller ones. A node with one link left, to a smaller one, leaves the loop; the rounds end when no link is left.
    """
    apart = edges.where(F.col("source") != F.col("target")).select(F.col("source").alias("a"), F.col("target").alias("b"))
    ids, names = encode(apart, nodes.select(F.col("slug").alias("name")))
    pair = lambda x, y: F.struct(F.col(x).alias("lo"), F.col(y).alias("hi"))
    forest = Forest()
    now, left = _links(ids.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")))
    for _ in range(max_rounds):
        if not left:
            return decode(names, forest.roots()).withColumnRenamed("vertex", "slug")
        ends = now.select(F.inline(F.array(F.struct(F.col("lo").alias("v"), F.col("hi").alias("u")), F.struct(F.col("hi").alias("v"), F.col("lo").alias("u")))))
        least = cut(ends.groupBy("v").agg(F.min("u").alias("u"), F.count("*").alias("n")), "least")
        leaf = (F.col("n") == 1) & (F.col("u") < F.col("v"))
        forest.hang(least.where(leaf).select("v", F.col("u").alias("m")))
        leaves = least.where(leaf).select(F.col("v").alias("hi"))
        stay = lookup_join(now, leaves, "hi", "left_anti")
        large = lookup_join(stay, least.select(F.col("v").alias("lo"), F.least("u", "v").alias("m")), "lo", "inner")
        half, n = _links(large.select(F.col("m").alias("lo"), "hi"))
        release(now)
        if not n:
            now, left = half, n
            continue
        hung, low = with_group_min(half, "hi", F.col("lo"), "m")
        now, left = _links(hung.select(F.inline(F.array(pair("m", "lo"), pair("m", "hi")))))
        release(half)
        release(low)
    raise RuntimeError(f"groups not stable after {max_rounds} rounds")


def _links(rows: DataFrame) -> tuple[DataFrame, int]:
    """Distinct rows (lo, hi) without loops, written down, and their number."""
    seen = Observation()
    out = cut(rows.where("lo < hi").distinct(), "links", seen, F.count("*").alias("n"))
    return out, seen.get.get("n") or 0
