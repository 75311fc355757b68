"""The wiki as nodes: one row per page, its latest scan, with canonical spellings; and the long forms of its arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.canonical import with_canonical, with_canonical_array
from loomgraph.schema import COMPRESSION_STAGES, DIR_TYPES


def infer_type(kind: Column, path: Column) -> Column:
    """The given type; else by the page's directory (`overview` at the wiki's root); else `unknown`."""
    parent = F.element_at(F.split(path, "/"), F.lit(-2))
    by_dir = F.create_map(*[F.lit(x) for pair in DIR_TYPES.items() for x in pair])
    deep = F.size(F.split(path, "/")) >= 2
    return F.coalesce(kind, F.when(deep & (parent == "wiki"), "overview"), F.when(deep, by_dir[parent]), F.lit("unknown"))


def latest(*tables: DataFrame) -> DataFrame:
    """The row with the highest ord of every slug; columns that a table lacks are null. Rows of equal ord are deliveries of one row; a null ord is the lowest.

    Taken as a maximum, which is combined before the shuffle, so a page scanned ever so often is no burden to one task.
    """
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t, allowMissingColumns=True)
    rows = rows.where(F.col("slug").isNotNull() & (F.col("slug") != ""))
    place = F.struct(F.col("ord").isNotNull(), "ord")
    # one maximum per column, so that columns nobody asks for are not read
    best = [F.max_by(F.col(f"`{c}`"), place).alias(c) for c in rows.columns if c != "slug"]
    return rows.groupBy("slug").agg(*best).select(*[F.col(f"`{c}`") for c in rows.columns])


def nodes(*tables: DataFrame) -> DataFrame:
    """Pages ready for analysis: canonical type (inferred where blank), tags, sources, wikilink targets and stage; blank optional text is null."""
    df = latest(*tables)
    df = with_canonical(df, "type", F.col("type"))
    df = df.withColumn("type", infer_type(F.col("type"), F.col("path")))
    df = with_canonical_array(df, "tags", F.col("tags"))
    df = with_canonical_array(df, "sources", F.col("sources"), source=True)
    if "wikilink_targets" in df.columns:
        df = with_canonical_array(df, "wikilink_targets", F.col("wikilink_targets"))
    stage = F.lower(F.trim("compression"))
    return df.withColumn("compression", F.when(stage.isin(COMPRESSION_STAGES), stage))


def related(df: DataFrame) -> DataFrame:
    """(slug, ord, pos, target, relation) of every related entry that names something; relations trimmed and lower case, blank is null."""
    rows = df.select("slug", "ord", F.posexplode("related").alias("pos", "r"))
    rows = with_canonical(rows, "target", F.col("r.slug"))
    rows = with_canonical(rows, "relation", F.col("r.relation"))
    return rows.where(F.col("target").isNotNull()).select("slug", "ord", "pos", "target", "relation")


def values(df: DataFrame, field: str) -> DataFrame:
    """(slug, value, seen): one row per element of an array column; `seen` orders them as the scan met them."""
    rows = df.select("slug", "ord", F.posexplode(field).alias("pos", "value"))
    return rows.select("slug", "value", F.struct("ord", "pos").alias("seen"))


def ranked(counted: DataFrame, n: str, limit: int | None = None) -> DataFrame:
    """Rows by falling count, ties by first appearance (`seen`); with limit only the first, taken by a top-k."""
    out = counted.orderBy(F.desc(n), "seen")
    return out.limit(limit) if limit else out


def value_counts(df: DataFrame, field: str) -> DataFrame:
    """(value, n, seen) of an array column."""
    return values(df, field).groupBy("value").agg(F.count("*").alias("n"), F.min("seen").alias("seen"))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) between two listings (path, mtime, size): added, changed or gone; what stays is not read again."""
    a, b = old.select("path", F.struct("mtime", "size").alias("o")), new.select("path", F.struct("mtime", "size").alias("n"))
    both = a.join(b, "path", "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "gone").when(~F.col("o").eqNullSafe(F.col("n")), "changed")
    return both.select("path", change.alias("change")).where(F.col("change").isNotNull())
