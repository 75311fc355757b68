"""Edits as change plans: a frame (path, slug, action, old_text, new_text) computed set-based; writing it is another step (sources.commit).

Pages are rows (slug, title, path, content, related, updated, ...); content is the body, related the array of (slug, relation).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions import text as X
from loomgraph.runtime import local
from loomgraph.schema import KNOWN_TYPES, TYPE_DIRS, TYPE_HEADINGS, Code, GraphError

_replace, _insert, _remove, _head = (X.text_udf(f) for f in (X.replace_wikilinks, X.insert_wikilink, X.remove_wikilinks, X.heading_first))
REL = "array<struct<slug:string,relation:string>>"
#: Fields that count as changed whenever a patch has them.
GIVEN = {"content", "tags", "related", "sources"}


def page_path(kind: Column, slug: Column) -> Column:
    dirs = F.create_map(*[F.lit(x) for pair in TYPE_DIRS.items() for x in pair])
    d = F.coalesce(dirs[kind], kind)
    return F.when(d == "", F.concat(F.lit("wiki/"), slug, F.lit(".md"))).otherwise(F.concat(F.lit("wiki/"), d, F.lit("/"), slug, F.lit(".md")))


def _rel(df: DataFrame) -> DataFrame:
    return df.withColumn("related", F.coalesce("related", F.array().cast(REL)))


def referrers(pages: DataFrame, slug: str) -> DataFrame:
    """Pages that link to slug in text or related; the text is only looked at where it holds a link at all."""
    in_text = F.exists(X.wikilinks(F.coalesce("content", F.lit(""))), lambda t: F.lower(t) == slug)
    return _rel(pages).where(in_text | F.exists("related", lambda r: F.lower(r["slug"]) == slug))


def rename(pages: DataFrame, old: str, new: str, today: str) -> DataFrame:
    """(slug, new_slug, path, new_path, content, related, updated) of the pages a rename changes; only the renamed page's `updated` moves.

    Renaming what is renamed already changes nothing; a taken name is RENAME_TARGET_EXISTS, an unknown one NODE_NOT_FOUND.
    """
    here = {r.slug for r in pages.where(F.col("slug").isin(old, new)).select("slug").distinct().collect()}
    if old not in here and new not in here:
        raise GraphError(Code.NODE_NOT_FOUND, f"no page {old}", slug=old)
    if old in here and new in here and old != new:
        raise GraphError(Code.RENAME_TARGET_EXISTS, f"page {new} exists", slug=old, target=new)
    is_it = F.col("slug") == old
    rows = _rel(pages).where(is_it).unionByName(referrers(pages, old).where(~is_it))
    if old not in here or old == new:
        rows = rows.where("false")
    related = F.transform("related", lambda r: F.struct(F.when(F.lower(r["slug"]) == old, F.lit(new)).otherwise(r["slug"]).alias("slug"), r["relation"].alias("relation")))
    path = F.when(is_it, F.regexp_replace("path", r"[^/]+\.md$", f"{new}.md")).otherwise(F.col("path"))
    return rows.select(
        "slug", F.when(is_it, F.lit(new)).otherwise(F.col("slug")).alias("new_slug"), "path", path.alias("new_path"),
        _replace("content", F.lit(old), F.lit(new)).alias("content"), related.alias("related"), F.when(is_it, F.lit(today)).otherwise(F.col("updated")).alias("updated"),
    )


def delete(pages: DataFrame, slug: str, mode: str = "strikethrough") -> DataFrame:
    """(slug, action, path, content, related, updated): the page goes, its referrers lose their related entry and their links change by mode; no page, no change."""
    return delete_all(pages, [slug], mode)


@F.pandas_udf(T.StringType())
def _dangle_all(content: pd.Series, gone: pd.Series, mode: pd.Series) -> pd.Series:
    def one(text, pages, how):
        for page in pages:
            text = X.dangling_wikilink(text, page["slug"], page["title"], how)
        return text

    return pd.Series([None if c is None else one(c, sorted(g, key=lambda x: x["slug"]), m) for c, g, m in zip(content, gone, mode)], dtype=object)


def delete_all(pages: DataFrame, slugs: list[str], mode: str = "strikethrough") -> DataFrame:
    """delete() of several pages as one plan: a page that refers to some of them is changed once. Unknown slugs change nothing."""
    pages = _rel(pages)
    wanted = local(pages.sparkSession, [(s,) for s in dict.fromkeys(slugs)], "slug string")
    gone = pages.join(F.broadcast(wanted), "slug", "left_semi")
    named = gone.select(F.col("slug").alias("__t"), F.struct("slug", F.coalesce("title", "slug").alias("title")).alias("__page"))
    in_text = F.transform(X.wikilinks(F.coalesce("content", F.lit(""))), F.lower)
    targets = F.array_distinct(F.concat(in_text, F.transform("related", lambda r: F.lower(r["slug"]))))
    hit = pages.select("slug", F.explode(targets).alias("__t")).join(F.broadcast(named), "__t").groupBy("slug").agg(F.collect_list("__page").alias("__gone"))
    rows = pages.join(hit, "slug").join(F.broadcast(wanted), "slug", "left_anti")
    kept = F.filter("related", lambda r: ~F.exists("__gone", lambda g: g["slug"].eqNullSafe(F.lower(r["slug"]))))
    touched = rows.select("slug", F.lit("update").alias("action"), "path", _dangle_all("content", "__gone", F.lit(mode)).alias("content"), kept.alias("related"), "updated")
    lost = gone.select("slug", F.lit("delete").alias("action"), "path", F.lit(None).cast("string").alias("content"), F.lit(None).cast(REL).alias("related"), "updated")
    return touched.unionByName(lost)


def update(pages: DataFrame, patches: DataFrame, today: str) -> DataFrame:
    """Pages changed by patches (slug and any of title, type, status, content, tags, sources, related; null leaves a field): new values,
    path by type, `updated` today, and fields_changed. Texts and lists that are given count as changed, other fields only where they differ.
    Patches that change nothing give no row; unknown slugs none either (see missing())."""
    fields = [c for c in ("title", "type", "status", "superseded_by", "compression", "content", "tags", "sources", "related") if c in patches.columns and c in pages.columns]
    both = pages.alias("p").join(patches.select("slug", *[F.col(c).alias(f"__{c}") for c in fields]), "slug")
    diff = F.array_compact(F.array(*[F.when(F.col(f"__{c}").isNotNull() & (F.lit(c in GIVEN) | ~F.col(f"__{c}").eqNullSafe(F.col(c))), F.lit(c)) for c in fields]))
    out = both.withColumn("fields_changed", diff).where(F.size("fields_changed") > 0)
    for c in fields:
        new = _head(F.col("__content"), F.col("title")) if c == "content" else F.col(f"__{c}")
        out = out.withColumn(c, F.coalesce(new, F.col(c)))
    path = F.when(F.array_contains("fields_changed", "type"), page_path(F.col("type"), F.col("slug"))).otherwise(F.col("path"))
    return out.withColumn("new_path", path).withColumn("updated", F.lit(today)).drop(*[f"__{c}" for c in fields])


def same_set(a: Column, b: Column) -> Column:
    """Arrays of the same elements, whatever their order and repeats; null is empty."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.coalesce(a, none))) == F.array_sort(F.array_distinct(F.coalesce(b, none)))


def add(pages: DataFrame, new: DataFrame, today: str) -> DataFrame:
    """New pages (title, and any of type, content, tags, sources, related (slugs)) as rows: slug, path, content, links (related and content links), dangling, collides.

    A taken slug gets the suffix -2, -3 and so on, counted per slug; the type defaults to synthesis. Two new pages of one title are numbered as well.
    A page equal in content, tags and links to one of its slug or numbered slugs is not added again. dangling are links to no page; collides says that the slug was taken.
    """
    for c, kind in (("type", "string"), ("content", "string"), ("tags", "array<string>"), ("sources", "array<string>"), ("related", "array<string>")):
        if c not in new.columns:
            new = new.withColumn(c, F.lit(None).cast(kind))
    rows = X.with_slug(new, "base", F.col("title")).where(F.col("base").isNotNull())
    rows = rows.withColumn("content", _head(F.coalesce("content", F.lit("")), F.col("title"))).dropDuplicates(["base", "content", "tags", "related"])
    given = F.transform(F.coalesce("related", F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    rows = rows.withColumn("links", F.array_distinct(F.concat(given, F.transform(X.wikilinks(F.col("content")), F.lower))))
    there = _rel(pages).select(F.regexp_extract("slug", r"^(.*?)(?:-(\d+))?$", 1).alias("base"), F.coalesce(F.nullif(F.regexp_extract("slug", r"-(\d+)$", 1), F.lit("")).try_cast("int"), F.lit(1)).alias("no"), "slug", "content", "tags", "related")
    same = there.select("base", F.btrim("content", F.lit(" \t\r\n")).alias("content"), F.col("tags").alias("__tags"), F.transform("related", lambda r: F.lower(r["slug"])).alias("__related"))
    equal = [rows[c] == same[c] for c in ("base", "content")] + [same_set(F.col("tags"), F.col("__tags")), same_set(F.col("links"), F.col("__related")) | (F.size("__related") == 0)]
    rows = rows.join(same, equal, "left_anti")
    plain = pages.select(F.col("slug").alias("base"), F.lit(True).alias("taken"))
    most = there.groupBy("base").agg(F.max("no").alias("most"))
    rows = rows.join(plain, "base", "left").join(most, "base", "left")
    no = F.row_number().over(Window.partitionBy("base").orderBy("content")) + F.when(F.col("taken"), F.coalesce("most", F.lit(1))).otherwise(0)
    rows = rows.withColumn("slug", F.when(no == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), no.cast("string"))))
    rows = rows.withColumn("type", F.coalesce(F.nullif(F.lower(F.trim("type")), F.lit("")), F.lit("synthesis")))
    known = pages.select(F.col("slug").alias("t"))
    lost = rows.select("slug", F.explode("links").alias("t")).join(known, "t", "left_anti").groupBy("slug").agg(F.sort_array(F.collect_list("t")).alias("dangling"))
    rows = rows.join(lost, "slug", "left").withColumn("dangling", F.coalesce("dangling", F.array().cast("array<string>")))
    return rows.select(
        "slug", "title", "type", page_path(F.col("type"), F.col("slug")).alias("path"), "content", "tags", "sources", "links", "dangling", F.coalesce("taken", F.lit(False)).alias("collides"),
        F.lit(today).alias("created"), F.lit(today).alias("updated"),
    )


def missing(pages: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
    """(slug): the distinct slugs in these columns that are no page."""
    asked = wanted.select(F.explode(F.array(*[F.lower(c) for c in columns])).alias("slug")).where("slug IS NOT NULL").distinct()
    return asked.join(pages.select("slug"), "slug", "left_anti")


def set_related(related: Column, slug: Column, relation: Column) -> Column:
    """related with an entry for slug: appended, or given the relation where one is named; a relation is never taken away."""
    there = F.exists(related, lambda r: F.lower(r["slug"]) == slug)
    raised = F.transform(related, lambda r: F.struct(r["slug"].alias("slug"), F.when(F.lower(r["slug"]) == slug, F.coalesce(relation, r["relation"])).otherwise(r["relation"]).alias("relation")))
    return F.when(there, raised).otherwise(F.concat(related, F.array(F.struct(slug.alias("slug"), relation.alias("relation")))))


def add_edges(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """(slug, content, related) of pages changed by wanted (source, target, relation, and maybe context), one edge per source at a time.

    context names the section of the text that gets the link. A link is put into text and related where missing; a loop only into the text. What is there already changes nothing.
    """
    context = F.col("context") if "context" in wanted.columns else F.lit(None).cast("string")
    w = wanted.select(F.col("source").alias("slug"), F.lower("target").alias("t"), F.nullif(F.lower(F.trim("relation")), F.lit("")).alias("rel"), context.alias("context"))
    rows = _rel(pages).join(w, "slug")
    linked = F.exists(X.wikilinks(F.coalesce("content", F.lit(""))), lambda x: F.lower(x) == F.col("t"))
    new_rel = F.when(F.col("slug") == F.col("t"), F.col("related")).otherwise(set_related(F.col("related"), F.col("t"), F.col("rel")))
    rows = rows.withColumn("__r", new_rel).withColumn("__c", F.when(linked, F.col("content")).otherwise(_insert(F.coalesce("content", F.lit("")), F.col("t"), F.col("context"))))
    changed = ~F.col("__r").eqNullSafe(F.col("related")) | ~F.col("__c").eqNullSafe(F.col("content"))
    return rows.where(changed).select("slug", F.col("__c").alias("content"), F.col("__r").alias("related"))


def remove_edges(pages: DataFrame, gone: DataFrame) -> DataFrame:
    """(slug, content, related) of pages that lose the links (source, target), from text and related."""
    g = gone.select(F.col("source").alias("slug"), F.lower("target").alias("t"))
    rows = _rel(pages).join(g, "slug")
    rows = rows.withColumn("__r", F.filter("related", lambda r: ~F.lower(r["slug"]).eqNullSafe(F.col("t")))).withColumn("__c", _remove(F.col("content"), F.col("t")))
    changed = ~F.col("__r").eqNullSafe(F.col("related")) | ~F.col("__c").eqNullSafe(F.col("content"))
    return rows.where(changed).select("slug", F.col("__c").alias("content"), F.col("__r").alias("related"))


def heading(kind: Column) -> Column:
    """Section heading of a type in the index: known types by a fixed plural, others capitalised."""
    known = F.create_map(*[F.lit(x) for pair in TYPE_HEADINGS.items() for x in pair])
    return F.coalesce(known[kind], F.concat(F.upper(F.substring(kind, 1, 1)), F.substring(kind, F.lit(2), F.length(kind))))


def index_lines(pages: DataFrame) -> DataFrame:
    """(place, heading, slug, line): one line per page, by type in its order and slug; a rebuild of the index writes them in that order."""
    place = F.array_position(F.array(*[F.lit(t) for t in KNOWN_TYPES]), F.col("type"))
    known = place > 0
    rows = pages.select(
        F.when(known, place).otherwise(len(KNOWN_TYPES) + 1).alias("place"), F.when(known, heading(F.col("type"))).otherwise("Other").alias("heading"), "slug",
        F.concat(F.lit("- [["), F.col("slug"), F.lit("]] — "), F.coalesce("title", F.lit(""))).alias("line"),
    )
    return rows.orderBy("place", "slug")
