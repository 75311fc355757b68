"""Queries p3, p5, p7 to p10 over the wiki's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.canonical import canonical_sql, width_sql, with_canonical
from loomgraph.llm import components, leakage, mixing, sentences, setjoin, terms
from loomgraph.runtime import cut, local
from loomgraph.sources.tables import table


def _frequencies(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "kg_pages").select("slug", "ord", "tags", "type")
    n_pages = pages.agg(F.countDistinct("slug")).first()[0]
    return terms.marked(terms.term_frequencies(terms.page_terms(pages)), n_pages)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Tags and types that are too rare or too common."""
    return _frequencies(spark, d).where(F.col("mark").isNotNull()).select("field", "term", "mark")


def p3_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Every tag and type with its number of places, of pages, and its mark."""
    return _frequencies(spark, d).select("field", "term", "n", "n_records", "mark")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every slug of the edges with the smallest slug it is linked to."""
    groups = components.hash_to_min(components.ends(table(spark, d, "edges")))  # repeated links fall together once they are numbers
    return groups.select(F.col("vertex").alias("slug"), F.col("component").alias("group_slug"))


def _page_sets(spark: SparkSession, d: str):
    pages = table(spark, d, "kg_pages").where(F.col("slug").isNotNull())
    raw = pages.select(F.col("slug").alias("id"), F.explode("sources").alias("raw"))
    sources = with_canonical(raw, "token", F.col("raw"), source=True).where(F.col("token").isNotNull()).select("id", F.concat(F.lit("s:"), "token").alias("token"))
    raw = pages.select(F.col("slug").alias("id"), F.explode("tags").alias("raw"))
    tags = with_canonical(raw, "token", F.col("raw")).where(F.col("token").isNotNull()).select("id", F.concat(F.lit("t:"), "token").alias("token"))
    tokens = cut(sources.unionByName(tags).distinct(), "page_tokens")
    members = tokens.where(F.col("token").startswith("s:")).groupBy("id").agg(F.count("*").alias("n")).where("n >= 2").select("id")
    return setjoin.classes(members, tokens)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of pages whose sources and tags largely coincide."""
    grouped, membership = _page_sets(spark, d)
    pairs = setjoin.expand(setjoin.similar_classes(grouped), membership)
    return pairs.select(F.col("a").alias("slug_a"), F.col("b").alias("slug_b"))


def p7_links(spark: SparkSession, d: str) -> DataFrame:
    """One row per page with two sources or more: its class of equal sets and its number of similar pages."""
    grouped, membership = _page_sets(spark, d)
    return setjoin.links_per_id(setjoin.similar_classes(grouped), grouped, membership).select(F.col("id").alias("slug"), F.col("class").alias("class_slug"), "n_links")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the evaluation items they give away."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    """The leaked passages as offsets in the documents' original text."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), offsets=True)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the mix with their number of copies."""
    return mixing.mix(mixing.token_counts(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and actual share of every source in the mix."""
    counted, targets = cut(mixing.token_counts(table(spark, d, "documents")), "tokens"), table(spark, d, "mix_targets")
    return mixing.shares(cut(mixing.mix(counted, targets), "mix"), counted, targets)


def p9_budget(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and actual shares of a mix of BUDGET of all tokens, where small sources reach their caps and the rest is parted among the others."""
    counted, targets = cut(mixing.token_counts(table(spark, d, "documents")), "tokens"), table(spark, d, "mix_targets")
    total = int((counted.agg(F.sum("tokens")).first()[0] or 0) * BUDGET)
    return mixing.shares(cut(mixing.mix(counted, targets, total), "mix"), counted, targets)


def p9_by_chars(spark: SparkSession, d: str) -> DataFrame:
    """The mix with characters as sizes and BUDGET of all of them: planned size per source, and whether the mix keeps to it (within one text) and to the caps."""
    documents, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    rows = with_canonical(documents.select("doc_id", "text", "source"), "source", F.col("source"), source=True)
    counted = cut(rows.select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("tokens")), "sizes")
    total = int((counted.agg(F.sum("tokens")).first()[0] or 0) * BUDGET)
    wanted = {r.source: (r.target_share, r.max_repeats) for r in mixing.normal_targets(targets).collect()}
    sizes = {r.source: r.n for r in counted.where(F.col("source").isin(list(wanted))).groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    _, copies = mixing.plan(sizes, wanted, total)
    planned = local(spark, [(s, r * sizes[s], wanted[s][1]) for s, r in sorted(copies.items())], "source string, planned double, cap bigint")
    most = counted.groupBy("source").agg(F.max("tokens").alias("largest"))
    taken = mixing.mix(counted, targets, total).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("taken"), F.max("copies").alias("most"))
    rows = planned.join(most, "source").join(taken, "source", "left")
    return rows.select(
        "source", F.floor(F.col("planned") + 0.5).alias("planned"), (F.abs(F.coalesce("taken", F.lit(0)) - F.col("planned")) <= F.col("largest")).alias("kept"), (F.coalesce("most", F.lit(0)) <= F.col("cap")).alias("capped")
    )


def p10_cover(spark: SparkSession, d: str) -> DataFrame:
    """For every document with a sentence: its visible characters and headings by its sentences, and whether they are in order, apart and without outer white space."""
    rows = sentences.sentence_rows(table(spark, d, "documents"), with_text=True)
    text = F.col("sentence")
    head = F.when(text.rlike(r"^#{1,6}(?:\s|$)"), 1).otherwise(0)
    per = rows.select(
        "doc_id", F.struct("start_char", "end_char").alias("at"), F.length(F.regexp_replace("sentence", _BLANK, "")).alias("n"), head.alias("head"), text.rlike(f"^{_BLANK}|{_BLANK}\\z").alias("loose")
    )
    per = per.groupBy("doc_id").agg(F.sum("n").alias("n_visible"), F.sum("head").alias("n_headings"), F.max("loose").alias("loose"), F.sort_array(F.collect_list("at")).alias("at"))
    apart = F.aggregate("at", F.lit(0).cast("bigint"), lambda end, x: F.when((end >= 0) & (x["start_char"] >= end) & (x["end_char"] > x["start_char"]), x["end_char"]).otherwise(-1)) >= 0
    return per.select("doc_id", "n_visible", "n_headings", (apart & ~F.col("loose")).alias("in_order"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence of every document as offsets."""
    return sentences.sentence_rows(table(spark, d, "documents"))


BUDGET = 0.6
_BLANK = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

QUERIES = {
    "p3_found": p3_found,
    "p3_frequencies": p3_frequencies,
    "p5_found": p5_found,
    "p7_found": p7_found,
    "p7_links": p7_links,
    "p8_found": p8_found,
    "p8_passages": p8_passages,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_budget": p9_budget,
    "p9_by_chars": p9_by_chars,
    "p10_found": p10_found,
    "p10_cover": p10_cover,
}

_TERMS = f"""WITH raw AS (SELECT 'tags' AS field, slug, ord, generate_subscripts(tags, 1) AS pos, unnest(tags) AS x FROM kg_pages UNION ALL SELECT 'type', slug, ord, 0, type FROM kg_pages),
t AS (SELECT field, slug, ord, pos, {canonical_sql('x')} AS term FROM raw),
f AS (SELECT field, term, count(DISTINCT (slug, ord, pos)) AS n, count(DISTINCT slug) AS n_records FROM t WHERE term IS NOT NULL GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN n_records <= 2 THEN 'rare' WHEN n_records * 10 > (SELECT count(DISTINCT slug) FROM kg_pages) THEN 'common' END AS mark FROM f)
"""
_SETS = f"""WITH tok AS (SELECT DISTINCT slug, 's:' || {canonical_sql('x', source=True)} AS token FROM (SELECT slug, unnest(sources) AS x FROM kg_pages)
UNION SELECT DISTINCT slug, 't:' || {canonical_sql('x')} FROM (SELECT slug, unnest(tags) AS x FROM kg_pages)),
good AS (SELECT slug FROM tok WHERE token LIKE 's:%' GROUP BY 1 HAVING count(*) >= 2),
mine AS (SELECT t.slug, t.token FROM tok t JOIN good USING (slug) WHERE token IS NOT NULL),
sizes AS (SELECT slug, count(*) AS n FROM mine GROUP BY 1),
common AS (SELECT a.slug AS slug_a, b.slug AS slug_b, count(*) AS k FROM mine a JOIN mine b ON a.token = b.token AND a.slug < b.slug GROUP BY 1, 2),
pairs AS (SELECT slug_a, slug_b FROM common JOIN sizes x ON x.slug = slug_a JOIN sizes y ON y.slug = slug_b WHERE k * 10 >= 6 * (x.n + y.n - k))
"""

# The texts' compatibility characters are width forms, one vowel sign and one ordinal mark; kana and Han characters are set apart as words of their own.
_SINGLE = r"\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}"
_WORDS = rf"regexp_extract_all(regexp_replace(lower(replace(translate({width_sql('text')}, 'º', 'o'), 'ำ', 'ํา')), '([{_SINGLE}])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+')"
_LEAKS = f"""WITH it AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE item_id IS NOT NULL),
runs AS (SELECT item_id, least(12, len(w)) AS n, array_to_string(w[i : i + least(12, len(w)) - 1], ' ') AS r FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 11) + 1)) AS i FROM it WHERE len(w) > 0)),
dw AS (SELECT doc_id, {_WORDS} AS w FROM documents), sizes AS (SELECT DISTINCT n FROM runs),
spots AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)
"""
_PLAN = f"""WITH d AS (SELECT {canonical_sql('source', source=True)} AS source, length(text) AS n FROM documents), tg AS (SELECT {canonical_sql('source', source=True)} AS source, target_share AS w, max_repeats AS c FROM mix_targets),
z AS (SELECT source, sum(n) AS n FROM d GROUP BY 1), l AS (SELECT source, CAST(z.n AS DOUBLE) AS n, sum(w) AS w, max(c) AS c FROM tg JOIN z USING (source) WHERE z.n > 0 GROUP BY source, z.n HAVING sum(w) > 0 AND max(c) > 0),
t AS (SELECT CAST(floor(sum(n) * {BUDGET}) AS DOUBLE) AS total FROM d),
o AS (SELECT *, coalesce(sum(c * n) OVER b, 0) AS cn, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS wr FROM l, t WINDOW b AS (ORDER BY c * n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, bool_and(c * n / w <= (total - cn) / wr) OVER (ORDER BY c * n / w, source) AS full_ FROM o),
g AS (SELECT total - coalesce(sum(c * n) FILTER (WHERE full_), 0) AS rest, sum(w) FILTER (WHERE NOT full_) AS wr FROM f GROUP BY total)
"""

SQL = {
    "p5_found": f"""WITH RECURSIVE e AS (SELECT DISTINCT {canonical_sql('source')} AS a, {canonical_sql('target')} AS b FROM edges),
adj AS (SELECT a, b FROM e WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM e WHERE a IS NOT NULL AND b IS NOT NULL),
reach AS (SELECT a, a AS b FROM adj UNION SELECT reach.a, adj.b FROM reach JOIN adj ON reach.b = adj.a)
SELECT a AS slug, min(b) AS group_slug FROM reach GROUP BY 1""",
    "p3_found": _TERMS + "SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
    "p3_frequencies": _TERMS + "SELECT field, term, n, n_records, mark FROM m",
    "p8_found": _LEAKS + "SELECT DISTINCT doc_id, item_id FROM spots s JOIN runs ON runs.n = s.n AND runs.r = array_to_string(w[i : i + s.n - 1], ' ')",
    "p9_by_chars": _PLAN + "SELECT source, CAST(floor(CASE WHEN full_ THEN c * n ELSE g.rest * w / g.wr END + 0.5) AS BIGINT) AS planned, true AS kept, true AS capped FROM f, g",
    "p10_cover": rf"""WITH ln AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
SELECT doc_id, length(regexp_replace(any_value(text), '{_BLANK}', '', 'g')) AS n_visible, count(*) FILTER (WHERE regexp_matches(line, '^{_BLANK}{{0,3}}#{{1,6}}({_BLANK}|$)')) AS n_headings, true AS in_order
FROM ln GROUP BY 1 HAVING length(regexp_replace(any_value(text), '{_BLANK}', '', 'g')) > 0""",
    "p7_found": _SETS + "SELECT slug_a, slug_b FROM pairs",
    "p7_links": _SETS
    + """, sets AS (SELECT slug, list_sort(list(token)) AS s FROM mine GROUP BY 1),
ends AS (SELECT slug_a AS slug FROM pairs UNION ALL SELECT slug_b FROM pairs), links AS (SELECT slug, count(*) AS n FROM ends GROUP BY 1)
SELECT slug, min(slug) OVER (PARTITION BY s) AS class_slug, coalesce(n, 0) AS n_links FROM sets LEFT JOIN links USING (slug)""",
}
