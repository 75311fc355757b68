"""Counts, degree statistics, source overlap, type matrix and balance of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import pages as P
from loomgraph.operators.skew import lookup_join
from loomgraph.runtime import local
from loomgraph.schema import KNOWN_TYPES


def rounded(x: Column, digits: int = 2) -> Column:
    """Half up on the scaled value, as floor(x * 10^d + 0.5) / 10^d."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale


def type_place(kind: Column) -> Column:
    """Place of a type: known ones in their order, then all others."""
    place = F.array_position(F.array(*[F.lit(t) for t in KNOWN_TYPES]), kind)
    return F.when(place > 0, place).otherwise(len(KNOWN_TYPES) + 1)


def type_counts(nodes: DataFrame) -> DataFrame:
    """(type, n, place): known types in their order, then the others by name."""
    per = nodes.groupBy("type").agg(F.count("*").alias("n"))
    return per.withColumn("place", type_place(F.col("type"))).orderBy("place", "type")


def degree_stats(table: DataFrame) -> DataFrame:
    """One row over all nodes: n, mean, median, std (population), p95 (nearest rank), max, isolated; zeros for no nodes."""
    t = F.col("total")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return table.agg(
        F.count("*").alias("n"),
        rounded(zero(F.avg(t))).alias("mean"),
        rounded(zero(F.expr("percentile(total, 0.5)"))).alias("median"),
        rounded(zero(F.stddev_pop(t))).alias("std"),
        zero(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY total)")).cast("bigint").alias("p95"),
        zero(F.max(t)).alias("max"),
        F.count_if(t == 0).alias("isolated"),
    )


def hubs(table: DataFrame, limit: int = 20) -> DataFrame:
    """Nodes above the 95th percentile (at the maximum, if that equals it), most links first; none where the maximum is the median."""
    s = degree_stats(table).select(F.col("p95").alias("__p"), F.col("max").alias("__m"), F.col("median").alias("__d"))
    t = F.col("total")
    keep = (F.col("__m") > F.col("__d")) & F.when(F.col("__p") < F.col("__m"), t > F.col("__p")).otherwise(t >= F.col("__m"))
    hit = table.join(F.broadcast(s), F.lit(True)).where(keep)  # s is one row
    return hit.select("slug", "n_in", "n_out", "total", "ord").orderBy(F.desc("total"), "ord").limit(limit).drop("ord")


def component_summary(components: DataFrame) -> DataFrame:
    """One row: number of groups, the largest, its share of the nodes, fragmentation; zeros for no nodes."""
    sizes = components.groupBy("component").agg(F.count("*").alias("n"))
    s = sizes.agg(F.count("*").alias("components"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"))
    ratio = F.when(F.col("nodes") > 0, F.col("largest") / F.col("nodes")).otherwise(F.lit(0.0))
    return s.select("components", "largest", rounded(ratio).alias("ratio"), rounded(F.when(F.col("nodes") > 0, 1 - ratio).otherwise(0.0)).alias("fragmentation"))


def small_components(components: DataFrame, below: int = 5) -> DataFrame:
    """(component, n, slugs): groups of fewer than `below` nodes, smallest first. Only small groups are gathered."""
    sizes = components.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") < below)
    return components.join(sizes, "component").groupBy("component", "n").agg(F.sort_array(F.collect_list("slug")).alias("slugs")).orderBy("n", "component")


def source_index(nodes: DataFrame) -> DataFrame:
    """(source, n, seen): citing pages of every source."""
    return P.value_counts(nodes, "sources").withColumnRenamed("value", "source")


def source_coverage(nodes: DataFrame) -> DataFrame:
    has = F.size("sources") > 0
    per = nodes.agg(F.count_if(has).alias("with_sources"), F.count_if(~has).alias("without_sources"))
    return per.join(F.broadcast(P.values(nodes, "sources").agg(F.countDistinct("value").alias("unique_sources"))), F.lit(True))


def duplicate_clusters(nodes: DataFrame) -> DataFrame:
    """(sources, n, first_slug, last_slug): sets of sources that two pages or more share entirely. Members are counted, not gathered."""
    rows = nodes.where(F.size("sources") > 0).select("slug", F.array_sort("sources").alias("sources"))
    return rows.groupBy("sources").agg(F.count("*").alias("n"), F.min("slug").alias("first_slug"), F.max("slug").alias("last_slug")).where("n >= 2").orderBy(F.desc("n"), "first_slug")


def cluster_members(nodes: DataFrame) -> DataFrame:
    """(slug, title, type, first_slug): every page of a duplicate cluster, named by the cluster's first slug."""
    rows = nodes.where(F.size("sources") > 0).select("slug", "title", "type", F.array_sort("sources").alias("sources"))
    return rows.join(duplicate_clusters(nodes).select("sources", "first_slug"), "sources").drop("sources")


def over_extracted(nodes: DataFrame, least: int = 3) -> DataFrame:
    """Sources that at least so many pages cite, most first."""
    return P.ranked(source_index(nodes).where(F.col("n") >= least), "n")


def type_matrix(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_type, target_type, n, ratio): edges between types; ratio is the share of the row.

    Cells without an edge are there for those of the known types that some page has; other types are open-ended, so only their cells with edges are listed.
    """
    kinds = nodes.select("slug", "type")
    # counted per (source, type of target) first, so the second join sees one row per such pair
    half = lookup_join(edges.select("source", "target"), kinds.select(F.col("slug").alias("target"), F.col("type").alias("target_type")), "target", "inner")
    half = half.groupBy("source", "target_type").agg(F.count("*").alias("n"))
    full = half.join(kinds.select(F.col("slug").alias("source"), F.col("type").alias("source_type")), "source")
    known = local(nodes.sparkSession, [(a, b, 0) for a in KNOWN_TYPES for b in KNOWN_TYPES], "source_type string, target_type string, n bigint")
    there = F.broadcast(nodes.select("type").where(F.col("type").isin(KNOWN_TYPES)).distinct())  # eight rows at most
    for end in ("source_type", "target_type"):
        known = known.join(there.withColumnRenamed("type", end), end, "left_semi")
    cells = full.select("source_type", "target_type", "n").unionByName(known).groupBy("source_type", "target_type").agg(F.sum("n").alias("n"))
    row = F.sum("n").over(Window.partitionBy("source_type"))
    dense = cells.withColumn("ratio", F.when(row > 0, rounded(F.col("n") / row, 3)).otherwise(F.lit(0.0)))
    return dense.orderBy(type_place(F.col("source_type")), "source_type", type_place(F.col("target_type")), "target_type")


def type_balance(nodes: DataFrame) -> DataFrame:
    """(type, n, ratio), most frequent first, ties by name."""
    per = nodes.groupBy("type").agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("__all"))
    return per.join(F.broadcast(total), F.lit(True)).select("type", "n", rounded(F.col("n") / F.col("__all"), 3).alias("ratio")).orderBy(F.desc("n"), "type")


def empty_types(nodes: DataFrame) -> DataFrame:
    """Known types no page has."""
    known = local(nodes.sparkSession, [(t,) for t in KNOWN_TYPES], "type string")
    return known.join(nodes.select("type").distinct(), "type", "left_anti")
