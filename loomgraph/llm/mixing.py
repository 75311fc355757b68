"""Mixing sources to target weights (problem 9) by pivotal dependent rounding.

Every text of a source should be taken r times, r being the source's wanted tokens over its own. floor(r) copies are certain;
the fraction is rounded so that the source's tokens come out within one text of the target: two texts with fractional
probabilities trade mass, weighed by their tokens, until one of them is whole, at random and without bias. Texts are rounded inside
(source, bucket) groups in parallel, large ones first; each group leaves one fractional text at most, and these are paired again in a tree. A source's
texts pass through that in two tiers: those that alone would shift its share first, then all others, whose probabilities take up what the first tier left.
"""

from __future__ import annotations

import os
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.canonical import with_canonical
from loomgraph.runtime import cut

FAN_IN = 64
ROWS_PER_BUCKET = 20_000
#: The first tier are texts of more tokens than LARGE_MEANS average ones and than 1 / LARGE_PARTS of their source.
LARGE_MEANS, LARGE_PARTS = 8, 1000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits text before the merges (fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODERS: dict = {}


def encoder(path: str = TOKENIZER):
    """The tokenizer of a rank file, read once per worker; where the path is not there, the copy that came with the job."""
    if path not in _ENCODERS:
        import base64

        import tiktoken
        from pyspark import SparkFiles

        with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens): canonical source, tokens of the whole text; null text has none, a null or blank source is null."""
    rows = with_canonical(documents.select("doc_id", "text", "source"), "source", F.col("source"), source=True)
    if os.path.exists(path):
        documents.sparkSession.sparkContext.addFile(path)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in batches:
            pdf["tokens"] = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["text"]]
            yield pdf[["doc_id", "source", "tokens"]]

    return rows.mapInPandas(count, "doc_id bigint, source string, tokens bigint")


def plan(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> tuple[float, dict[str, float]]:
    """(size of the mix, copies wanted per text of each source).

    A source without tokens, share or cap contributes nothing, and the others' shares are scaled to 1. Without
    `total` the mix is the largest in which every such source has exactly its share within its cap. With `total`, a source whose cap is
    reached gives all it may, and the rest of the total is parted among the others by share.
    """
    live = {s: (w, c) for s, (w, c) in targets.items() if sizes.get(s, 0) > 0 and (w or 0) > 0 and (c or 0) > 0}
    if not live:
        return 0.0, {}
    weight = sum(w for w, _ in live.values())
    if total is None:
        total = min(c * sizes[s] * weight / w for s, (w, c) in live.items())
        return total, {s: min(float(c), total * w / weight / sizes[s]) for s, (w, c) in live.items()}
    copies, left, free = {}, float(total), dict(live)
    while free:
        weight = sum(w for w, _ in free.values())
        full = [s for s, (w, c) in free.items() if left * w / weight >= c * sizes[s]]
        if not full:
            copies |= {s: left * w / weight / sizes[s] for s, (w, _) in free.items()}
            break
        for s in full:
            copies[s] = float(free.pop(s)[1])
        left = total - sum(copies[s] * sizes[s] for s in copies)
    return float(total), copies


def trade(p: float, a: float, q: float, b: float, coin: float) -> tuple[float, float]:
    """Moves mass between probabilities p and q of weights a and b so that a p + b q stays and one becomes 0 or 1; expectations stay p and q."""
    up = min((1 - p) * a, q * b)  # weighed mass that can go from q to p
    down = min(p * a, (1 - q) * b)
    if coin * (up + down) < down:
        p, q = p + up / a, q - up / b
    else:
        p, q = p - down / a, q + down / b
    return _whole(p), _whole(q)


def _whole(p: float) -> float:
    return 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p


def _round(batches: Iterator[pd.DataFrame], seed: int, last: bool) -> Iterator[pd.DataFrame]:
    """One pass over rows sorted by (source, bucket): all but one text of each group become whole; with last also that one."""
    group, held, rng = None, None, None
    for pdf in batches:
        out = []
        for source, bucket, doc, tokens, p in zip(pdf["source"], pdf["bucket"], pdf["doc_id"], pdf["tokens"], pdf["p"]):
            if (source, bucket) != group:
                if held:
                    out.append(_end(held, rng, last))
                group, held, rng = (source, bucket), None, random.Random(f"{seed}|{source}|{bucket}")
            item = (source, bucket, doc, tokens, _whole(p))
            if 0 < item[4] < 1 and held:
                x, y = trade(held[4], held[3], item[4], tokens, rng.random())
                held, item = (*held[:4], x), (*item[:4], y)
                if not 0 < x < 1:
                    held, item = item, held
                out.append(item)
                if not 0 < held[4] < 1:
                    out.append(held)
                    held = None
            elif 0 < item[4] < 1:
                held = item
            else:
                out.append(item)
        yield pd.DataFrame(out, columns=list(pdf.columns))
    if held:
        yield pd.DataFrame([_end(held, rng, last)], columns=["source", "bucket", "doc_id", "tokens", "p"])


def _end(held: tuple, rng: random.Random, last: bool) -> tuple:
    return (*held[:4], float(rng.random() < held[4])) if last else held


def pivotal_round(rows: DataFrame, seed: int = 0) -> DataFrame:
    """(source, doc_id, tokens, p) with every p made 0 or 1, its expectation kept and sum(tokens * p) of each source kept within one text.

    In a group large texts come first, so that what is left over is a small one. Groups are keyed by hashes and sorted, and their random numbers follow from the seed, so a task run again gives the same result.
    Texts without tokens must not be among the rows.
    """
    kind = "source string, bucket bigint, doc_id bigint, tokens bigint, p double"
    buckets = max(1, rows.count() // ROWS_PER_BUCKET)
    now = rows.select("source", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket"), "doc_id", "tokens", "p")
    done = None
    while True:
        end = buckets == 1
        placed = now.repartition("source", "bucket").sortWithinPartitions("source", "bucket", F.desc("tokens"), "doc_id")
        level = cut(placed.mapInPandas(lambda it, s=seed + buckets, e=end: _round(it, s, e), kind), "rounded")
        whole = level.where("p <= 0 OR p >= 1")
        done = whole if done is None else done.unionByName(whole)
        if end:
            return done.drop("bucket")
        buckets = -(-buckets // FAN_IN)
        now = level.where("p > 0 AND p < 1").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))


def normal_targets(targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats) with canonical sources; shares of one source add up, its highest cap holds."""
    rows = with_canonical(targets, "source", F.col("source"), source=True).where(F.col("source").isNotNull())
    return rows.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").cast("bigint").alias("max_repeats"))


def mix(counted: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0) -> DataFrame:
    """(doc_id, source, tokens, copies) of every text that is taken at least once; no text more often than its source's cap.

    counted is token_counts(), or any sizes of the same columns. Sources that no target names, null sources and texts without tokens are left out. The table of
    targets is a configuration of some sources; it and some totals per wanted source come to the driver. Rows of one doc_id are texts of their own.
    """
    counted = cut(counted, "tokens") if not hasattr(counted, "loom_path") else counted
    wanted = {r.source: (r.target_share, r.max_repeats) for r in normal_targets(targets).collect()}
    named = counted.where(F.col("source").isin(list(wanted)) & (F.col("tokens") > 0))
    stats = {r.source: (r.n, r.k) for r in named.groupBy("source").agg(F.sum("tokens").alias("n"), F.count("*").alias("k")).collect()}
    _, copies = plan({s: n for s, (n, _) in stats.items()}, wanted, total)
    if not copies:
        return named.where("false").select("doc_id", "source", "tokens", F.lit(0).cast("bigint").alias("copies"))
    large = F.col("tokens") > _by_source({s: max(LARGE_MEANS * n / k, n / LARGE_PARTS) for s, (n, k) in stats.items() if s in copies})
    # the first tier at the wanted rate; then the others at the rate that makes up for it, no text beyond its cap
    first = cut(_tier(named.where(large), copies, seed), "tier")
    there = {r.source: r.n for r in named.where(large).groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    taken = {r.source: r.n for r in first.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("n")).collect()}
    rest = {}
    for s, r in copies.items():
        others = stats[s][0] - there.get(s, 0)
        rest[s] = min(float(wanted[s][1]), max(0.0, (r * stats[s][0] - taken.get(s, 0)) / others)) if others else 0.0
    return first.unionByName(_tier(named.where(~large), rest, seed + 1)).where("copies > 0")


def _tier(rows: DataFrame, rates: dict[str, float], seed: int) -> DataFrame:
    """(doc_id, source, tokens, copies) of texts each wanted rates[source] times: the whole part for certain, the fraction by pivotal rounding."""
    sure = {s: int(r + 1e-9) for s, r in rates.items()}
    rows = rows.select("doc_id", "source", "tokens", _by_source(sure).cast("bigint").alias("sure"), _by_source({s: max(0.0, r - sure[s]) for s, r in rates.items()}).alias("p"))
    chance = pivotal_round(rows.where("p > 1e-9").select("source", "doc_id", "tokens", "p"), seed)
    part = chance.select("doc_id", "source", "tokens", (_by_source(sure) + F.col("p")).cast("bigint").alias("copies"))
    return part.unionByName(rows.where("p <= 1e-9").select("doc_id", "source", "tokens", F.col("sure").alias("copies")))


def _by_source(values: dict):
    return F.create_map(*[F.lit(x) for pair in sorted(values.items()) for x in pair])[F.col("source")]


def shares(mixed: DataFrame, counted: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per wanted source, absent ones too: target_share, max_repeats, tokens there, tokens in the mix, actual share, most copies of a text."""
    there = counted.groupBy("source").agg(F.sum("tokens").alias("tokens_available"))
    taken = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens_mixed"), F.max("copies").alias("most_copies"))
    total = taken.agg(F.sum("tokens_mixed")).first()[0] or 0
    rows = normal_targets(targets).join(there, "source", "left").join(taken, "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    mixed_tokens = zero(F.col("tokens_mixed"))
    return rows.select(
        "source", "target_share", "max_repeats", zero(F.col("tokens_available")).alias("tokens_available"), mixed_tokens.alias("tokens_mixed"),
        (mixed_tokens / F.lit(float(max(1, total)))).alias("actual_share"), zero(F.col("most_copies")).alias("most_copies"),
    )
