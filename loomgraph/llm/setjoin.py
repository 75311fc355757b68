"""All pairs of similar sets by a prefix-filtered join (problem 7).

Tokens are numbered by rarity. Equal sets are one class, joined once. Every class is indexed under the first tokens of its sorted set, as few as the
threshold allows, and under its band of sizes; a probe asks for the two or so bands the threshold admits, so the length filter is part of the join key
and a frequent token's list is cut into several. Sizes and positions bound the overlap still possible. Index, probe and candidates hold ids, sizes and
positions alone; the sets meet the candidates, each pair once, only for the exact check.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.numbering import in_order
from loomgraph.operators.skew import heavy_keys, lookup_join
from loomgraph.runtime import cut

THRESHOLD = Fraction(3, 5)


def number_tokens(tokens: DataFrame) -> DataFrame:
    """(token, rank) of the rows' tokens, rank 0 upwards by rising frequency, ties by token."""
    return in_order(tokens.groupBy("token").agg(F.count("*").alias("n")), ["n", "token"], "rank").select("token", "rank")


def classes(members: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, membership) of distinct (id, token) rows of `tokens` for the ids in `members`.

    classes: class (its smallest id), set (ranks, rarest first), size, n_members. membership: id, class.
    """
    mine = tokens.join(members, "id", "left_semi")
    mine = cut(mine, "set_tokens")
    ranks = number_tokens(mine)
    sets = lookup_join(mine, ranks, "token", "inner").groupBy("id").agg(F.sort_array(F.collect_list("rank")).alias("set"))
    sets = cut(sets, "sets")
    grouped = cut(sets.groupBy("set").agg(F.min("id").alias("class"), F.count("*").alias("n_members")).withColumn("size", F.size("set")), "classes")
    # the set itself is the key; a hot class is one row on the right, its members are spread by salt
    keyed = sets.withColumn("key", F.sha2(F.concat_ws(",", F.transform("set", lambda x: x.cast("string"))), 256))
    right = grouped.select(F.sha2(F.concat_ws(",", F.transform("set", lambda x: x.cast("string"))), 256).alias("key"), F.col("set").alias("rset"), "class")
    membership = lookup_join(keyed, right, "key", "inner").where(F.col("set") == F.col("rset")).select("id", "class")
    return grouped, membership


def _need(a: Column, b: Column, t: Fraction) -> Column:
    """Least overlap of sizes a and b at Jaccard t, in whole numbers: ceil(t (a + b) / (1 + t))."""
    p, q = t.numerator, t.denominator
    return F.floor((F.lit(p) * (a + b) + F.lit(p + q - 1)) / F.lit(p + q)).cast("int")


def band(size: Column, t: Fraction) -> Column:
    """Sizes a and b of which the smaller is at least t of the larger are in one band or in neighbouring ones."""
    return F.floor(F.log(size.cast("double") + 0.5) / math.log(max(1.2, 1 / t))).cast("int")


def candidates(some: DataFrame, t: Fraction) -> DataFrame:
    """(small, large) of classes (class, set, size) that share a token of their prefixes and may still overlap enough, each pair once.

    Of every pair the prefix tokens in common are counted, and the last of them says what can still follow: a pair that cannot reach the overlap it needs goes.
    """
    p, q = t.numerator, t.denominator
    size = F.col("size")
    least = F.floor((F.lit(p) * size + F.lit(q - 1)) / F.lit(q)).cast("int")  # ceil(t * size): the smallest partner, and the overlap with it
    first = lambda n: F.posexplode(F.slice("set", F.lit(1), n)).alias("at", "token")
    index = some.select("class", "size", first(size - _need(size, size, t) + 1))
    index = index.select("token", band(size, t).alias("band"), F.col("class").alias("small"), F.col("size").alias("small_size"), F.col("at").alias("i"))
    probe = some.select("class", "size", first(size - least + 1)).withColumn("band", F.explode(F.sequence(band(least, t), band(size, t))))
    probe = probe.select("token", "band", F.col("class").alias("large"), F.col("size").alias("large_size"), F.col("at").alias("j"))
    # a key is (token, band) as one hash; unequal keys of one hash part at the filter. Lists that many probes ask for are repeated where these are
    key = F.xxhash64("token", "band")
    index = index.withColumn("key", key).withColumnsRenamed({"token": "token2", "band": "band2"})
    probe = cut(probe.withColumn("key", key), "probe")
    need = _need(F.col("small_size"), F.col("large_size"), t)
    same = (F.col("token") == F.col("token2")) & (F.col("band") == F.col("band2"))
    fits = (F.col("small_size") * q >= F.col("large_size") * p) & ((F.col("small_size") < F.col("large_size")) | (F.col("small_size") == F.col("large_size")) & (F.col("small") < F.col("large")))
    room = F.least(F.col("small_size") - F.col("i"), F.col("large_size") - F.col("j")) >= need
    met = lookup_join(probe, index, "key", "inner").where(same & fits & room)
    per = met.groupBy("small", "large").agg(F.count("*").alias("shared"), F.max("i").alias("i"), F.max("j").alias("j"), F.first("small_size").alias("small_size"), F.first("large_size").alias("large_size"))
    after = F.least(F.col("small_size") - F.col("i"), F.col("large_size") - F.col("j")) - 1
    return per.where(F.col("shared") + after >= need).select("small", "large")


def similar_classes(grouped: DataFrame, t: Fraction = THRESHOLD) -> DataFrame:
    """(small, large, overlap, similarity): class pairs whose Jaccard similarity is at least t, each pair once.

    small is the class of the smaller set; of equal sizes, the smaller id. Empty sets are similar to nothing.
    """
    some = grouped.where("size > 0")
    found = cut(candidates(some, t), "candidates")
    set_of = lambda end: some.select(F.col("class").alias(end), F.col("set").alias(f"{end}_set"), F.col("size").alias(f"{end}_size"))
    both = lookup_join(lookup_join(found, set_of("small"), "small", "inner"), set_of("large"), "large", "inner", heavy_keys(found, "large"))
    pairs = both.withColumn("overlap", F.size(F.array_intersect("small_set", "large_set"))).where(F.col("overlap") >= _need(F.col("small_size"), F.col("large_size"), t))
    return pairs.select("small", "large", "overlap", (F.col("overlap") / (F.col("small_size") + F.col("large_size") - F.col("overlap"))).alias("similarity"))


def expand(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """(a, b), a < b: the similar pairs of ids, those of equal sets included. Their number is that of the answer.

    The members of a large class are spread over the tasks and meet the class's members there, so no task makes all of its pairs.
    """
    membership = cut(membership, "membership")
    heavy = heavy_keys(membership, "class")
    left = membership.select(F.col("class").alias("small"), F.col("id").alias("x"))
    right = membership.select(F.col("class").alias("large"), F.col("id").alias("y"))
    within = lookup_join(left, right.withColumnRenamed("large", "small"), "small", "inner", heavy).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    # members of the smaller set's class carry each pair of their class; then the members of the larger set's class join
    pairs = cut(pairs.select("small", "large"), "class_pairs")
    half = lookup_join(left, pairs, "small", "inner", heavy)
    across = lookup_join(cut(half, "half"), right, "large", "inner")
    return across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).unionByName(within)


def links_per_id(pairs: DataFrame, grouped: DataFrame, membership: DataFrame) -> DataFrame:
    """(id, class, n_links): one row per id with its class and the number of ids similar to it, counted without expanding copies."""
    sizes, pairs = grouped.select("class", "n_members"), cut(pairs.select("small", "large"), "class_pairs")
    ends = pairs.select(F.col("small").alias("class"), F.col("large").alias("other")).unionByName(pairs.select(F.col("large").alias("class"), F.col("small").alias("other")))
    away = lookup_join(ends, sizes.withColumnRenamed("class", "other"), "other", "inner").groupBy("class").agg(F.sum("n_members").alias("away"))
    per_class = sizes.join(away, "class", "left").select("class", (F.coalesce("away", F.lit(0)) + F.col("n_members") - 1).alias("n_links"))
    return lookup_join(membership, per_class, "class", "inner").select("id", "class", "n_links")
