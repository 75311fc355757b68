"""Scores by which pages ask for attention or may be forgotten, and the loose ends of the wiki."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.dates import real_date
from loomgraph.operators import graph
from loomgraph.operators import pages as P
from loomgraph.operators.metrics import rounded
from loomgraph.runtime import local
from loomgraph.schema import HIDDEN_TAG, THEME_PURCHASE, Tuning


def is_hypothesis() -> Column:
    return F.coalesce(F.col("content").rlike(r"(?i)status:\s*hypothesis"), F.lit(False))


def contradictions(pages: DataFrame) -> DataFrame:
    """(slug, target, ord, pos) of related entries that contradict."""
    return P.related(pages).where("relation = 'contradicts'").select("slug", "target", "ord", "pos")


def pressure(pages: DataFrame, overdue_count: int, today: str, since: str | None = None, touched: list[str] | None = None, tuning: Tuning = Tuning()) -> DataFrame:
    """(component, n, weight, contribution): what has gathered since the last session; dream pages and what that session touched don't count.

    Without `since` all pages are new. The score is the sum of the contributions.
    """
    own = pages.where(F.col("type") != "dream")
    if touched:
        own = own.join(F.broadcast(local(pages.sparkSession, [(t,) for t in touched], "slug string")), "slug", "left_anti")
    fresh = F.col("created") > since if since else F.lit(True)
    changed = (F.col("updated") > since) & ~fresh if since else F.lit(False)
    per = own.agg(F.count_if(fresh).alias("new"), F.count_if(changed).alias("updated"), F.count_if(is_hypothesis()).alias("hypotheses"))
    per = per.join(F.broadcast(contradictions(own).agg(F.count("*").alias("contradictions"))), F.lit(True))
    days = max(0, (dt.date.fromisoformat(today) - dt.date.fromisoformat(since)).days) if since else 0
    names = list(tuning.pressure)
    per = per.withColumn("overdue", F.lit(overdue_count).cast("bigint")).withColumn("days", F.lit(days).cast("bigint"))
    rows = F.array(*[F.struct(F.lit(n).alias("component"), F.col(n).alias("n"), F.lit(float(tuning.pressure[n])).alias("weight")) for n in names])
    return per.select(F.inline(rows)).withColumn("contribution", F.col("n") * F.col("weight"))


def pressure_score(components: DataFrame, tuning: Tuning = Tuning()) -> DataFrame:
    s = components.agg(rounded(F.sum("contribution")).alias("score"))
    return s.withColumn("suggested", F.col("score") >= tuning.threshold)


def salience(pages: DataFrame, edges: DataFrame, used: DataFrame, overdue: DataFrame, today: str, tuning: Tuning = Tuning()) -> DataFrame:
    """Every page with its score: use, links in, days overdue and days since the last check, each over its maximum, weighed, damped by stage.

    used: (slug, total); overdue: (slug, overdue_days). A page never checked counts as the longest unchecked.
    """
    deg = graph.degrees(edges).select("slug", "n_in", "n_out")
    raw = pages.select("slug", "title", "type", "checked", "compression").join(used.select("slug", F.col("total").alias("used")), "slug", "left")
    raw = raw.join(deg, "slug", "left").join(overdue, "slug", "left")
    since = F.greatest(F.lit(0), F.datediff(F.lit(today).cast("date"), real_date(F.col("checked")).cast("date")))
    filled = F.nullif(F.col("checked"), F.lit(""))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    raw = raw.select("slug", "title", "type", "compression", zero("used"), zero("n_in"), zero("n_out"), zero("overdue_days"), F.when(filled.isNotNull(), F.coalesce(since, F.lit(0))).alias("unchecked"))
    most = raw.agg(*[F.greatest(F.lit(1), F.coalesce(F.max(c), F.lit(0))).alias(f"m_{c}") for c in ("used", "n_in", "overdue_days", "unchecked")])
    w = tuning.salience
    share = lambda c: F.col(c) / F.col(f"m_{c}")
    damp = F.lit(float(tuning.damping.get("active", 1.0)))
    for stage, d in tuning.damping.items():
        damp = F.when(F.col("compression") == stage, float(d)).otherwise(damp)
    touch = F.coalesce(F.col("unchecked"), F.col("m_unchecked")) / F.col("m_unchecked")
    score = (w["usage"] * share("used") + w["degree"] * share("n_in") + w["overdue"] * share("overdue_days") + w["touch"] * touch) * damp
    return raw.join(F.broadcast(most), F.lit(True)).select(*raw.columns, rounded(score).alias("score"))


def by_score(entries: DataFrame) -> DataFrame:
    """salience() in its order: highest score first, ties by slug."""
    return entries.orderBy(F.desc("score"), "slug")


def forgettability(entries: DataFrame, tuning: Tuning = Tuning()) -> DataFrame:
    """salience() rows with forget_score: unread, unneeded, stale, and by stage. The maxima are over all rows given."""
    most = entries.agg(*[F.greatest(F.lit(1), F.coalesce(F.max(c), F.lit(0))).alias(f"m_{c}") for c in ("n_in", "overdue_days")])
    w = tuning.forget
    unread = 1 / (1 + F.col("used"))
    stage = F.when(F.col("compression") == "skeleton", 1.0).when(F.col("compression") == "condensed", 0.5).otherwise(0.0)
    score = w["unread"] * unread + w["unneeded"] * (1 - F.col("n_in") / F.col("m_n_in")) + w["stale"] * F.least(F.lit(1.0), F.col("overdue_days") / F.col("m_overdue_days")) + w["stage"] * stage
    return entries.join(F.broadcast(most), F.lit(True)).select(*entries.columns, rounded(score, 3).alias("forget_score"))


def forget_candidates(entries: DataFrame, limit: int = 10, tuning: Tuning = Tuning()) -> DataFrame:
    """The most forgettable pages nobody used, sources, overviews and dreams aside; scored among all first."""
    rows = forgettability(entries, tuning).where(~F.col("type").isin("source", "overview", "dream") & (F.col("used") == 0))
    return rows.orderBy(F.desc("forget_score"), "slug").limit(limit)


def threads(pages: DataFrame) -> DataFrame:
    """(kind, key): open hypotheses, contradictions and pages that need verification."""
    hyp = pages.where(is_hypothesis()).select(F.lit("hypothesis").alias("kind"), F.col("slug").alias("key"))
    con = contradictions(pages).select(F.lit("contradicts").alias("kind"), F.concat("slug", F.lit("→"), "target").alias("key"))
    need = pages.where(F.array_contains("tags", HIDDEN_TAG)).select(F.lit("needs-verification").alias("kind"), F.col("slug").alias("key"))
    return hyp.unionByName(con).unionByName(need)


def carried(thread_list: DataFrame, live: DataFrame) -> DataFrame:
    """thread_list (thread) without those of a known kind that are live no more; threads without a kind stay."""
    known = F.regexp_extract("thread", r"(?s)^(hypothesis|needs-verification|contradicts):(.*)$", 1)
    key = F.regexp_extract("thread", r"(?s)^(hypothesis|needs-verification|contradicts):(.*)$", 2)
    rows = thread_list.withColumn("kind", known).withColumn("key", key).join(live.distinct().withColumn("live", F.lit(True)), ["kind", "key"], "left")
    return rows.where((F.col("kind") == "") | F.col("live")).select("thread")


def theme_terms(theme: str) -> list[str]:
    """Words of three letters and more without Han characters, and the pairs of neighbouring Han characters."""
    han = "一-鿿"
    out = [w for w in re.split(r"[\W_]+", theme.lower()) if len(w) >= 3 and not re.search(f"[{han}]", w)]
    out += [run[i : i + 2] for run in re.findall(f"[{han}]+", theme) for i in range(len(run) - 1)]
    return list(dict.fromkeys(out))


def theme_match(pages: DataFrame, theme: str, limit: int = 6) -> DataFrame:
    """One row: number of pages whose slug, title or tags hold a term of the theme, the first few in scan order, and whether they suffice."""
    terms = theme_terms(theme)
    hay = F.lower(F.concat_ws(" ", "slug", "title", F.concat_ws(" ", "tags")))
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(hay, F.lit(t))
    found = pages.where(hit).select("slug", "ord")
    first = found.orderBy("ord").limit(limit).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "slug"))), lambda x: x["slug"]).alias("slugs"))
    n = found.agg(F.count("*").alias("n"))
    return n.join(F.broadcast(first), F.lit(True)).withColumn("has_purchase", F.col("n") >= THEME_PURCHASE)
