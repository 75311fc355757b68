"""References to records that do not exist (problem 1).

A broadcast Bloom filter of the parent keys proves most orphans at once; only the filter-positive references
reach an exact join, which decides the rest. One filter has a fixed largest size, so it may be broadcast; more parents than it is made for
are parted by hash, and the references of each part meet that part's filter alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.canonical import with_canonical
from loomgraph.functions.dates import real_date
from loomgraph.operators import bloom
from loomgraph.operators.skew import lookup_join
from loomgraph.runtime import cut, release
from loomgraph.sources.tables import event_slugs, is_event

FIELDS = ("related", "wikilink_targets", "superseded_by")


def references(pages: DataFrame, table_name: str) -> DataFrame:
    """(table_name, ord, field, target, updated): one row per non-blank reference, canonical, as often as it is written.

    A table without one of the three fields has no references of that kind. Null arrays and elements say nothing.
    """
    rows = pages.select("ord", "updated", *[c for c in FIELDS if c in pages.columns])
    parts = []
    if "related" in pages.columns:
        parts.append(F.transform("related", lambda r: F.struct(F.lit("related").alias("field"), r["slug"].alias("raw"))))
    if "wikilink_targets" in pages.columns:
        parts.append(F.transform("wikilink_targets", lambda x: F.struct(F.lit("wikilink_targets").alias("field"), x.alias("raw"))))
    if "superseded_by" in pages.columns:
        parts.append(F.array(F.struct(F.lit("superseded_by").alias("field"), F.col("superseded_by").alias("raw"))))
    empty = F.array().cast("array<struct<field:string,raw:string>>")
    rows = rows.select("ord", "updated", F.explode(F.concat(*[F.coalesce(p, empty) for p in parts])).alias("r"))
    rows = with_canonical(rows.select(F.lit(table_name).alias("table_name"), "ord", "r.field", "updated", "r.raw"), "target", F.col("raw"))
    return rows.where(F.col("target").isNotNull()).select("table_name", "ord", "field", "target", "updated")


def parents(tables: list[DataFrame], events: DataFrame | None = None) -> DataFrame:
    """(slug, here, created, deleted): every page slug with its earliest readable creation date, and every slug a delete event names.

    An event counts when it really ran: ok is true and dry is not.
    """
    rows = None
    for t in tables:
        one = t.select("slug", F.lit(True).alias("here"), real_date(F.col("created")).alias("created"), F.lit(False).alias("deleted"))
        rows = one if rows is None else rows.unionByName(one)
    if events is not None:
        gone = events.where((F.col("op") == "delete_node") & F.col("ok") & ~F.coalesce("dry", F.lit(False)) & is_event())
        gone = event_slugs(gone, []).select("slug", F.lit(False).alias("here"), F.lit(None).cast("string").alias("created"), F.lit(True).alias("deleted"))
        rows = rows.unionByName(gone)
    rows = rows.where(F.col("slug").isNotNull() & (F.col("slug") != ""))
    return rows.groupBy("slug").agg(F.max("here").alias("here"), F.min("created").alias("created"), F.max("deleted").alias("deleted"))


def tried(refs: DataFrame, keys: DataFrame, max_words: int = bloom.MAX_WORDS) -> DataFrame:
    """refs with `maybe`, False where the filter proves that no key equals the target; written down. keys (slug) is a written table.

    With several shards both sides are written parted by shard, and one filter at a time is broadcast and gone again.
    """
    words, shards = bloom.size_for(keys.count(), max_words)
    if shards == 1:
        return cut(bloom.probe(refs, "target", bloom.build(keys, "slug", words), words), "refs")
    split = lambda df, key, tag: cut(df.withColumn("__shard", bloom.shard(F.col(key), shards)), tag, by="__shard")
    own, parted = split(keys.select("slug"), "slug", "keys"), split(refs, "target", "refs")
    parts = []
    for i in range(shards):
        here = F.col("__shard") == i
        table = bloom.build(own.where(here), "slug", words)
        parts.append(cut(bloom.probe(parted.where(here).drop("__shard"), "target", table, words), "refs"))
    release(own)
    release(parted)
    return reduce(DataFrame.unionByName, parts)


def orphan_references(refs: DataFrame, keys: DataFrame, max_words: int = bloom.MAX_WORDS) -> DataFrame:
    """refs (any columns, with target and updated) that point nowhere, were deleted or came later, with their `kind`.

    keys is parents(): kind is `deleted` or `missing` where no page has the slug, `later` where the page's first
    creation is after the reference's `updated`, both being real dates. Rows of refs keep their columns and number;
    null targets are no references. Empty inputs give empty results. One extra column, `proof`, says `filter` or `join`.
    """
    keys = cut(keys, "parents")
    rows = tried(refs.where(F.col("target").isNotNull()), keys, max_words)
    sure = rows.where(~F.col("maybe")).drop("maybe").withColumn("kind", F.lit("missing")).withColumn("proof", F.lit("filter"))
    names = {c: f"__k_{c}" for c in ("here", "created", "deleted")}
    found = keys.select(F.col("slug").alias("target"), *[F.col(c).alias(n) for c, n in names.items()])
    joined = lookup_join(rows.where("maybe").drop("maybe"), found, "target")
    late = real_date(F.col("updated")) < F.col("__k_created")
    kind = (
        F.when(F.coalesce("__k_here", F.lit(False)), F.when(late, "later"))
        .when(F.coalesce("__k_deleted", F.lit(False)), "deleted")
        .otherwise("missing")  # passed the filter by chance
    )
    rest = joined.withColumn("kind", kind).where(F.col("kind").isNotNull()).drop(*names.values()).withColumn("proof", F.lit("join"))
    return sure.unionByName(rest)


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Counts per table, field, month of `updated` (null where it is no real date) and kind: distinct (ord, field, target), and rows."""
    month = F.substring(real_date(F.col("updated")), 1, 7)
    once = orphans.groupBy("table_name", "field", "kind", "ord", "target").agg(F.max(month).alias("month"))
    return once.groupBy("table_name", "field", "month", "kind").agg(F.count("*").alias("n"), F.countDistinct("ord").alias("n_records"))
