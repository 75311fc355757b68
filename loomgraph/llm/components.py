"""Connected groups by hash-to-min (problem 5).

A link is one row (lo, hi), so the cluster of a vertex is spread over rows and never one set. In each round every vertex sends its cluster
to the cluster's smallest member, and that member to all of its cluster. A vertex with one link left, to a smaller one, has nothing more to say: it leaves the
loop and is hung on that one, so settled groups, and most of the large ones, are not written again; the rounds end when no link is left. They work on the vertices'
places in sorted order, so that minima are those of whole numbers and a row is 16 bytes whatever the names' length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loomgraph.functions.canonical import with_canonical
from loomgraph.operators import skew
from loomgraph.operators.numbering import Forest, decode, encode
from loomgraph.runtime import cut, partitions, release

#: Rounds grow with the logarithm of a group's diameter; more than this means a fault, and is an error, never a partial result.
MAX_ROUNDS = 60


def ends(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Canonical (a, b) of rows whose ends are both non-blank, loops included, as often as they are written."""
    rows = with_canonical(with_canonical(edges.select(source, target), "a", F.col(source)), "b", F.col(target))
    return rows.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")


def links(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Distinct ends()."""
    return ends(edges, source, target).distinct()


def hash_to_min(pairs: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(vertex, component): the smallest vertex linked to each, directly or over others, in either direction.

    pairs has columns a and b without nulls; a loop makes its vertex known. Repeated and reversed rows change nothing; no rows, no groups.
    """
    parts, forest = partitions(pairs.sparkSession), Forest()
    ids, names = encode(pairs)
    link = lambda x, y: F.struct(F.col(x).alias("lo"), F.col(y).alias("hi"))
    seen = Observation()
    now = cut(ids.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")), "links", seen, F.count("*").alias("n"))
    left = seen.get.get("n") or 0
    for _ in range(max_rounds):
        if not left:
            return decode(names, forest.roots())
        # every vertex's least and greatest neighbour; its cluster is its neighbours and itself. Repeated links, of the first round alone, change neither
        both = now.select(F.inline(F.array(F.struct(F.col("lo").alias("v"), F.col("hi").alias("u")), F.struct(F.col("hi").alias("v"), F.col("lo").alias("u")))))
        seen = Observation()
        least = cut(both.groupBy("v").agg(F.min("u").alias("u"), F.max("u").alias("far"), F.count("*").alias("n")), "least", seen, F.max("n").alias("most"))
        heavy = skew.Heavy(total=left)
        if (seen.get.get("most") or 0) > skew.bound(left, parts):
            heavy = skew.most_rows(least.select(F.col("v").alias("k"), "n"), left, parts)
        leaf = (F.col("u") == F.col("far")) & (F.col("u") < F.col("v"))
        forest.hang(least.where(leaf).select("v", F.col("u").alias("m")))
        low = least.select("v", F.least("u", "v").alias("m"), leaf.alias("leaf"))
        rows = skew.lookup_join(now, low.select(F.col("v").alias("hi"), F.col("m").alias("m_hi"), "leaf"), "hi", "inner", heavy)
        rows = skew.lookup_join(rows.where("NOT leaf").drop("leaf"), low.select(F.col("v").alias("lo"), F.col("m").alias("m_lo")), "lo", "inner", heavy)
        sent = rows.select(F.inline(F.array(link("m_hi", "lo"), link("m_lo", "hi")))).unionByName(low.where("NOT leaf").select(F.col("m").alias("lo"), F.col("v").alias("hi")))
        seen = Observation()
        new = cut(sent.where("lo < hi").distinct(), "links", seen, F.count("*").alias("n"))
        release(now)
        now, left = new, seen.get.get("n") or 0
    raise RuntimeError(f"groups not stable after {max_rounds} rounds")
