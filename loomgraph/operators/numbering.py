"""Exact numbers 0, 1, 2 ... in sorted order over any number of rows, without a single task; pairs of names as pairs of numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loomgraph.operators import skew
from loomgraph.runtime import cut, local, partitions, release


def in_order(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with bigint `name`: the row's place in the order of the columns `order`, which together must be unique.

    Rows are sorted by range and written down with their place in their partition; the partitions' offsets, one row each, are prefix sums.
    """
    row = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    fixed = cut(placed.select(*df.columns, F.shiftright(row, 33).alias("__pid"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("__no")), "numbered")
    sizes = sorted((r["__pid"], r.n) for r in fixed.groupBy("__pid").agg(F.count("*").alias("n")).collect())
    starts, at = [], 0
    for pid, n in sizes:
        starts.append((pid, at))
        at += n
    offsets = local(df.sparkSession, starts, "__pid bigint, __start bigint")
    return fixed.join(F.broadcast(offsets), "__pid").select(*df.columns, (F.col("__start") + F.col("__no")).alias(name))


def encode(pairs: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b) as numbers, names (name, id)) of pairs of names without nulls; numbers follow the order of the names.

    The names are those of the pairs, and their numbers of rows on either side come with them, so no further count finds the heavy ones. With `known` (name), distinct
    names, they are these, and pairs with an end outside them are left out.
    """
    seen, parts = Observation(), partitions(pairs.sparkSession)
    pairs = cut(pairs.select("a", "b"), "pairs", seen, F.count("*").alias("n"))
    total = seen.get.get("n") or 0
    if known is not None:
        names = in_order(known.select("name"), ["name"], "id")
        heavy = {end: skew.heavy_keys(pairs, end) for end in ("a", "b")}
    else:
        side = lambda c: F.struct(F.col(c).alias("name"), F.lit(int(c == "a")).alias("a"), F.lit(int(c == "b")).alias("b"))
        names = pairs.select(F.inline(F.array(side("a"), side("b")))).groupBy("name").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        names = in_order(names, ["name"], "id")
        heavy = {end: skew.most_rows(names.select(F.col("name").alias("k"), F.col(end).alias("n")), total, parts) for end in ("a", "b")}
    out = pairs
    for end in ("a", "b"):
        out = skew.lookup_join(out, names.select(F.col("name").alias(end), F.col("id").alias(f"{end}_id")), end, "inner", heavy[end])
    return out.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")), names.select("name", "id")


class Forest:
    """Vertices that left an iteration, each hung on one that stayed longer; roots() follows them to the end by doubling."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def hang(self, leaves: DataFrame) -> None:
        """leaves (v, m): v leaves, m stays."""
        self.tables.append(leaves.select("v", "m"))

    def roots(self) -> DataFrame | None:
        """(v, m): the root above every vertex that left; None where none did."""
        if not self.tables:
            return None
        now = self.tables[0]
        for t in self.tables[1:]:
            now = now.unionByName(t)
        now = cut(now, "hung")
        above = lambda t: t.select(F.col("v").alias("m"), F.col("m").alias("above"))
        reach = 1
        while reach < len(self.tables):  # a chain has at most one link for each table
            seen = Observation()
            step = skew.lookup_join(now, above(now), "m")
            new = cut(step.select("v", F.coalesce("above", "m").alias("m"), F.col("above").isNotNull().alias("moved")), "hung", seen, F.count_if("moved").alias("n"))
            moved = seen.get.get("n")
            release(now)
            now, reach = new, reach * 2
            if not moved:
                break
        return now.select("v", "m")


def decode(names: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(vertex, component) as names: every name with the name of its root, its own where it never left."""
    if roots is None:
        return names.select(F.col("name").alias("vertex"), F.col("name").alias("component"))
    all_ = names.join(roots.withColumnRenamed("v", "id"), "id", "left").select(F.col("name").alias("vertex"), F.coalesce("m", "id").alias("m"))
    tops = names.select(F.col("id").alias("m"), F.col("name").alias("component"))
    return skew.lookup_join(all_, tops, "m", "inner", skew.heavy_keys(roots, "m")).select("vertex", "component")
