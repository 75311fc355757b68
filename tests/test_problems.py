"""The general operators against SQL on the smallest tables and brute force on small, dirty inputs."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomgraph.functions.canonical import with_canonical, with_canonical_array
from loomgraph.functions.dates import instant, real_date, utc_date, utc_text
from loomgraph.operators import bloom, chunks, features, orphans, rolling, skew
from loomgraph.plans import core_problems, edit_queries, wiki_queries
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
LOG = "ts string, op string, slugs array<string>, actor string, dry boolean, ok boolean, err string, day date"
PAGE = "slug string, ord bigint, related array<struct<slug:string,relation:string>>, wikilink_targets array<string>, superseded_by string, created string, updated string, kind string, n bigint, word bigint"


@pytest.mark.parametrize("name", sorted(core_problems.SQL))
def test_problem_equals_sql(spark, name):
    assert compare(spark, SF, name) == ""


@pytest.mark.parametrize("name", sorted(wiki_queries.SQL))
def test_wiki_query_equals_sql(spark, name):
    assert compare(spark, SF, name) == ""


@pytest.mark.parametrize("name", sorted(edit_queries.SQL))
def test_edit_query_equals_sql(spark, name):
    assert compare(spark, SF, name) == ""


def test_changed_files_come_in_all_three_kinds(spark):
    got = wiki_queries.QUERIES["scan_changed_both_ways"](spark, SF.replace("0.001", "0.01"))
    assert {r.change for r in got.select("change").distinct().collect()} == {"added", "gone", "changed"}


def test_canonical(spark):
    cases = [("Ｔｅｓｔ ", "test"), ("[[ A b ]]", "a b"), ("　[[x]]\n", "x"), ("[[]]", None), (" ", None), (None, None), ("[[a", "[[a"), ("É", "é"), ("dir/A#b.md", "dir/a#b.md"), ("[[[[a]]]]", "[[a]]")]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, x string")
    got = [r.y for r in with_canonical(df, "y", F.col("x")).orderBy("i").collect()]
    assert got == [b for _, b in cases]
    assert with_canonical(spark.createDataFrame([("Http://X//",)], "x string"), "y", F.col("x"), source=True).first().y == "http://x/"
    arrays = spark.createDataFrame([(["A", None, "a ", "", "b/"],), (None,)], "x array<string>")
    assert [r.y for r in with_canonical_array(arrays, "y", F.col("x"), source=True).collect()] == [["a", "b"], []]


def test_dates(spark):
    rows = ["2025-01-01T00:30:00+01:00", "2025-01-01 05:06:07.089Z", "2025-02-30T00:00:00Z", "2025-01-01T00:00:00", "1960-01-01T00:00:00.001Z", "", None, "2025-01-01T00:00:00Z\n"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").withColumn("t", instant(F.col("x")))
    got = [(r[0], str(r[1]) if r[1] else None) for r in df.orderBy("i").select(utc_text(F.col("t")), utc_date(F.col("t"))).collect()]
    assert got == [("2024-12-31T23:30:00.000Z", "2024-12-31"), ("2025-01-01T05:06:07.089Z", "2025-01-01"), (None, None), (None, None), ("1960-01-01T00:00:00.001Z", "1960-01-01")] + [(None, None)] * 3
    days = spark.createDataFrame([(x,) for x in ("2024-02-29", "2023-02-29", "2024-2-1", "2024-02-01 ", None)], "x string")
    assert [r.y for r in days.select(real_date(F.col("x")).alias("y")).collect()] == ["2024-02-29", None, None, None, None]


def test_lookup_join_spreads_heavy_and_null_keys(spark):
    rows = [("hot", i) for i in range(5000)] + [(None, i) for i in range(300)] + [(f"k{i}", i) for i in range(100)]
    left, right = spark.createDataFrame(rows, "k string, i int"), spark.createDataFrame([("hot", 1), ("k1", 2), (None, 3)], "k string, v int")
    assert skew.heavy_keys(left, "k") == ["hot"]
    for how in ("left", "inner", "left_semi"):
        got = skew.lookup_join(left, right, "k", how)
        want = left.join(right, "k", how)
        assert sorted(got.select(want.columns).collect(), key=str) == sorted(want.collect(), key=str)
    saved = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for c, v in zip(saved, ("false", "-1")):
        spark.conf.set(c, v)
    tasks = skew.lookup_join(left, right, "k").groupBy("k", F.spark_partition_id().alias("t")).count().collect()
    for c, v in saved.items():
        spark.conf.set(c, v)
    assert len([r for r in tasks if r.k == "hot"]) > 3 and len([r for r in tasks if r.k is None]) > 3
    assert skew.heavy_keys(left.where("false"), "k") == []


def test_lookup_join_by_a_key_of_any_name(spark):
    rows = [("hot", i) for i in range(5000)] + [(None, 1), ("k1", 2), ("k2", 3)]
    for key in ("__key", "k"):
        left, right = spark.createDataFrame(rows, f"{key} string, i int"), spark.createDataFrame([("hot", 1), ("k1", 2), (None, 3)], f"{key} string, v int")
        for how in ("left", "inner", "left_semi", "left_anti"):
            got, want = skew.lookup_join(left, right, key, how), left.join(right, key, how)
            assert got.columns == want.columns and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_lookup_join_spreads_over_many_partitions(spark, monkeypatch):
    """No task has twice its fair share, with 200 partitions, many heavy keys and either way of finding them; equal rows of many input partitions are spread too."""
    k = F.when(F.col("id") < 100_000, "hot").when(F.col("id") < 130_000, "warm").when(F.col("id") < 140_000, F.concat(F.lit("w"), (F.col("id") % 5).cast("string"))).when(F.col("id") < 150_000, None)
    left = spark.range(0, 200_000, 1, 40).select(k.otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"), F.col("id").alias("i"))
    right = spark.createDataFrame([("hot", 1), ("warm", 2), ("w1", 3), ("w1", 4)], "k string, v int")
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "200"}
    saved = {c: spark.conf.get(c) for c in conf}
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        heavy = skew.heavy_keys(left, "k")
        monkeypatch.setattr(skew, "TOP_K_PARTS", 0)
        again = skew.heavy_keys(left, "k")
        assert heavy == again == ["hot", "warm", "w0", "w1", "w2", "w3", "w4"] and heavy.rows == again.rows and heavy.total == again.total == 190_000
        for how, n in (("left", 202_000), ("inner", 134_000), ("left_semi", 132_000), ("left_anti", 68_000)):
            tasks = [r["count"] for r in skew.lookup_join(left, right, "k", how, heavy).groupBy(F.spark_partition_id()).count().collect()]
            assert sum(tasks) == n
            assert how == "left_anti" or max(tasks) < 2 * n / 200
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        equal = spark.range(0, 100_000, 1, 400).select(F.when(F.col("id") >= 0, "hot").alias("k"))
        tasks = [r["count"] for r in skew.lookup_join(equal, right, "k").groupBy(F.spark_partition_id()).count().collect()]
        assert sum(tasks) == 100_000 and max(tasks) < 2 * 100_000 / 8
    finally:
        for c, v in saved.items():
            spark.conf.set(c, v)


def test_salts_hash_as_spark_does(spark):
    for parts in (7, 200):
        for key in ("hot", "漢"):
            seed = spark.range(1).select(F.hash(F.lit(key))).first()[0]
            salts = skew.places(seed, parts, parts)
            at = spark.createDataFrame([(x,) for x in salts], "s int").select(F.pmod(F.hash(F.lit(key), "s"), F.lit(parts)).alias("p"))
            assert at.distinct().count() == parts and len(skew.places(seed, 3, parts)) == 3


def test_bloom_never_denies_a_key(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    probe = spark.range(10_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    for words in (64, bloom.size_for(5000)[0], 5000):
        table = bloom.build(keys, "k", words)
        assert table.agg(F.sum(F.size("bits"))).first()[0] == words and table.count() == -(-words // bloom.BLOCK)
        got = bloom.probe(probe, "k", table, words).withColumn("no", F.substring("k", 2, 9).cast("int"))
        assert got.where("no < 5000 AND NOT maybe").count() == 0
        assert got.where("no >= 5000 AND maybe").count() < 300 or words == 64
    assert bloom.size_for(0) == (1, 1) and bloom.size_for(10 * 256, 64) == (64, 10)


def test_filter_still_proves_misses_beyond_its_size(spark):
    """Ten times the keys of one filter: ten shards, and no more references left to the join than with one."""
    keys = spark.range(10 * 256).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("slug"), F.lit(True).alias("here"), F.lit(None).cast("string").alias("created"), F.lit(False).alias("deleted"))
    refs = spark.range(2 * 2560).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("target"), F.lit(None).cast("string").alias("updated"), F.lit(1).alias("block"))
    for most in (64, bloom.MAX_WORDS):
        got = orphans.orphan_references(refs, keys, most)
        assert got.where("kind = 'missing'").count() == got.count() == 2560 and got.where("proof = 'filter'").count() > 2400


@pytest.mark.parametrize("words", [64, bloom.MAX_WORDS])
def test_orphans(spark, words):
    pages = [
        ("a", 1, [("B ", None), (None, "x"), ("gone", None), ("late", "r")], ["[[nowhere]]", None, " "], "a", "2024-01-01", "2024-05-01", "kind", 1, 2),
        ("b", 2, None, None, None, "x", "2024-5-1", None, None, None),
        ("late", 3, [("late", None)], ["late"], "", "2024-06-01", "2024-05-31", None, None, None),
        ("late", 4, [], [], None, "2024-07-01", "", None, None, None),
        (None, 5, [("b", None)], ["gone"], None, None, None, None, None, None),
    ]
    events = [("2024-01-01T00:00:00Z", "delete_node", ["Gone"], None, None, True, None, None), ("2024-01-01T00:00:00Z", "delete_node", ["nowhere"], None, True, True, None, None), ("torn", "delete_node", ["nowhere"], None, None, True, None, None)]
    p, e = spark.createDataFrame(pages * 2, PAGE), spark.createDataFrame(events, LOG)
    got = orphans.orphan_references(orphans.references(p, "t"), orphans.parents([p], e), words)
    rows = {(r.ord, r.field, r.target, r.kind) for r in got.collect()}
    assert rows == {(1, "related", "gone", "deleted"), (1, "wikilink_targets", "nowhere", "missing"), (1, "related", "late", "later"), (3, "related", "late", "later"), (3, "wikilink_targets", "late", "later"), (5, "wikilink_targets", "gone", "deleted")}
    counts = {(r.field, r.month, r.kind): r.n for r in orphans.orphan_counts(got).collect()}
    assert counts[("wikilink_targets", None, "deleted")] == 1 and counts[("related", "2024-05", "later")] == 2
    none = p.where("false")
    assert orphans.orphan_references(orphans.references(none, "t"), orphans.parents([none], e.where("false"))).count() == 0


def log_rows(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        ts = f"2025-01-{rng.randint(1, 9):02}T{rng.randint(0, 23):02}:00:00{rng.choice(['', '.500'])}Z"
        rows.append((rng.choice([ts] * 9 + ["", None, "2025-01"]), rng.choice(["get_node", "add_edge", "get_node", None]), rng.choice([["a"], ["A ", "a"], ["b", "c"], None, [None, ""], ["hot"], ["hot"]]), rng.choice([None, "X", " x"]), None, rng.choice([True, None]), None, rng.choice([dt.date(2025, 1, 9), None])))
    return rows + rng.sample(rows, n // 4)


def brute_features(rows):
    out = {}
    for ts, op, slugs, actor, *_ in {(*r[:2], tuple(r[2]) if r[2] is not None else None, *r[3:]) for r in rows}:
        if op and slugs is not None and ts and len(ts) > 10:
            t = ts if "." in ts else ts.replace("Z", ".000Z")
            for s in {s.strip().lower() for s in slugs if s and s.strip()}:
                k = (s, f"{op}:{'x' if actor else 'lib'}")
                n, last = out.get(k, (0, ""))
                out[k] = (n + 1, max(last, t))
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("broadcast", [True, False])
def test_features_equal_brute_force(spark, seed, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(features, "MAX_BROADCAST_KEYS", -1)
        monkeypatch.setattr(features, "MAX_BROADCAST_PRINTS", -1)
    rows = log_rows(seed)
    state = features.features(spark.createDataFrame(rows, LOG))
    got = {(r.slug, r.event_type): (r.n, r.t) for r in state.withColumn("t", utc_text(F.timestamp_millis("last_ms"))).collect()}
    assert got == brute_features(rows)
    per = {r.slug: (r.reads, r.writes) for r in features.feature_rows(state).collect()}
    assert per["hot"] == tuple(sum(n for (s, e), (n, _) in got.items() if s == "hot" and e.startswith(p)) for p in ("get_node", "add_edge"))


def test_features_with_many_touched_keys_and_a_heavy_one(spark, monkeypatch):
    monkeypatch.setattr(features, "MAX_BROADCAST_KEYS", -1)
    monkeypatch.setattr(skew, "LEAST_HEAVY", 10)
    rows = log_rows(3)
    rows += [(f"2025-02-01T00:{i // 60:02}:{i % 60:02}Z", "get_node", ["hot"], None, None, True, None, None) for i in range(300)] * 2
    log = spark.createDataFrame(rows, LOG)
    assert len(skew.heavy_keys(features.keyed(log).select(F.concat_ws("\0", *features.KEY).alias("k")), "k")) > 0
    got = {(r.slug, r.event_type): (r.n, r.t) for r in features.features(log).withColumn("t", utc_text(F.timestamp_millis("last_ms"))).collect()}
    assert got == brute_features(rows)


def test_features_retract_and_recompute(spark):
    rows = sorted({(f"2025-01-{i:02}T00:00:00Z", "get_node", ("a",) if i % 2 else ("b",), None, None, None, None, None) for i in range(1, 9)})
    every = spark.createDataFrame([(*r[:2], list(r[2]), *r[3:]) for r in rows], LOG)
    state = features.apply_deltas(None, features.deltas(features.keyed(every), 1), None)
    gone = every.where("ts LIKE '%-07T%' OR ts LIKE '%-02T%' OR ts LIKE '%-04T%'")  # a's latest; older ones of b
    left = every.exceptAll(gone)
    asked = []

    def remaining(touched):
        asked.extend(r.slug for r in touched.collect())
        return features.keyed(left).join(touched, features.KEY, "left_semi")

    new = features.apply_deltas(state, features.deltas(features.keyed(gone), -1), remaining)
    got = {r.slug: (r.n, r.t) for r in new.withColumn("t", utc_text(F.timestamp_millis("last_ms"))).collect()}
    assert asked == ["a"] and got == {"a": (3, "2025-01-05T00:00:00.000Z"), "b": (2, "2025-01-08T00:00:00.000Z")}
    none = features.apply_deltas(new, features.deltas(features.keyed(left), -1), lambda t: features.keyed(left.where("false")))
    assert none.count() == 0 and features.features(every.where("false")).count() == 0


@pytest.mark.parametrize("rows_per_chunk,broadcast", [(1, True), (7, True), (7, False), (10**6, True), (None, True)])
def test_chunks(spark, rows_per_chunk, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(chunks, "MAX_BROADCAST_ROWS", -1)
    rows = [("hot", i, "x") for i in range(3000)] + [(f"k{i % 50}", i, "y") for i in range(200)] + [(None, 1, "z")]
    df = spark.createDataFrame(rows, "key string, i int, chunk string").repartition(5)
    got = {r.key: r.n for r in chunks.chunked_counts(df, "key", rows_per_chunk).collect()}
    assert got == {"hot": 3000, **{f"k{i}": 4 for i in range(50)}}
    if rows_per_chunk == 7:
        numbered = chunks.numbered(df, "key", 7).groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("__row_no").alias("d"), F.max("__row_no").alias("m"), F.max("__chunk").alias("c")).collect()
        assert [(r.n, r.d, r.m, r.c) for r in numbered if r.key == "hot"] == [(3000, 3000, 2999, 2999 // 7)] and all(r.c == 0 for r in numbered if r.key != "hot")
    assert chunks.chunked_counts(df.where("false"), "key", rows_per_chunk).count() == 0


def test_chunked_apply_merges_ordered_states(spark):
    """Runs of equal values per key: a run that crosses chunks counts once."""
    values = [0, 0, 1, 1, 1, 0, 2, 2, 2, 2, 2, 2, 0]
    df = spark.createDataFrame([("k", v) for v in values], "key string, v int").coalesce(1)

    def state(pdf: pd.DataFrame) -> dict:
        v = pdf["v"].tolist()
        return {"runs": 1 + sum(a != b for a, b in zip(v, v[1:])), "first": v[0], "last": v[-1]}

    def merge(a: dict, b: dict) -> dict:
        return {"runs": a["runs"] + b["runs"] - (a["last"] == b["first"]), "first": a["first"], "last": b["last"]}

    for size in (1, 3, 4, 100):
        row = chunks.chunked_apply(df, "key", state, merge, "runs bigint, first int, last int", size).first()
        assert (row["runs"], row["first"], row["last"]) == (5, 0, 0)


def test_two_stack_queue_without_inverse():
    rng = random.Random(0)
    queue, kept, day = rolling.TwoStackQueue(rolling.combine, rolling.UNIT), [], 0
    for _ in range(2000):
        day += rng.randint(0, 2)
        if rng.random() < 0.6:
            n = rng.randint(1, 9)
            queue.push(day, (n, 1, n))
            kept.append((day, n))
        low = day - rng.choice([2, 5])
        kept = [(d, n) for d, n in kept if d >= low]
        queue.drop_before(low)
        assert queue.value() == (sum(n for _, n in kept), len(kept), max([n for _, n in kept], default=0))


def test_rolling_equals_brute_force(spark):
    rng = random.Random(9)
    days = [dt.date(2025, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    daily = {(s, d): rng.randint(1, 5) for s in "abc" for d in days if rng.random() < 0.2} | {("a", dt.date(2024, 12, 25)): 4}
    asked = [(1, " A", 7), (2, "a", 7), (3, "b", 30), (4, "never", 3), (5, None, 3), (6, "c", 0), (7, "c", None), (8, "c", 10**6), (9, "c", 1)]
    frame = spark.createDataFrame([(s, d, n) for (s, d), n in daily.items()], "slug string, day date, n bigint")
    requests = rolling.requested(spark.createDataFrame(asked, "request_id bigint, slug string, window_days int"))
    got = {(r.slug, r.window_days, r.day): (r.reads, r.total, r.active_days, r.busiest) for r in rolling.rolling_totals(frame, requests, days[0], days[-1]).collect()}
    want = {}
    for s, w in {("a", 7), ("b", 30), ("never", 3), ("c", 10**6), ("c", 1)}:
        for d in days:
            ns = [n for (x, y), n in daily.items() if x == s and 0 <= (d - y).days < w]
            want[(s, w, d)] = (daily.get((s, d), 0), sum(ns), len(ns), max(ns, default=0))
    assert got == want
    assert rolling.rolling_totals(frame, requests, None, None).count() == 0
    assert rolling.daily_reads(spark.createDataFrame([], LOG)).count() == 0
