"""Context windows over chat logs: what is kept whole, what is shortened, what is summed up; per conversation, in frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.schema import ANCHOR_CHARS, CONTEXT_CHARS, DEGRADED_CHARS, RECENT_ROUNDS, TOOL_RESULT_CHARS


def blocks(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, content, tool_call_id, tool_call_ids) with block: a call and the results that answer it directly share one."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    calls = (F.col("role") == "assistant") & (F.coalesce(F.size("tool_call_ids"), F.lit(0)) > 0)
    run = F.sum(F.when(F.col("role") == "tool", 0).otherwise(1)).over(w)
    rows = messages.withColumn("__run", run).withColumn("__calls", calls)
    head = Window.partitionBy("conv_id", "__run").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ids = F.first(F.when(F.col("__calls"), F.col("tool_call_ids"))).over(head)
    rows = rows.withColumn("__ids", ids)
    answers = (F.col("role") == "tool") & F.coalesce(F.array_contains("__ids", F.col("tool_call_id")), F.lit(False))
    # an answer counts only while all tool messages before it in the run answered too
    broken = F.max(F.when((F.col("role") == "tool") & ~answers, 1).otherwise(0)).over(Window.partitionBy("conv_id", "__run").orderBy("turn"))
    inside = F.col("__calls") | (answers & (broken == 0))
    return rows.withColumn("block", F.when(inside, F.col("__run"))).drop("__run", "__calls", "__ids")


def window(messages: DataFrame, anchors: list[str] | None = None, limit: int = CONTEXT_CHARS) -> DataFrame:
    """messages with fate: `keep`, `shorten` (kept, cut to `keep_chars`) or `summarize`.

    A conversation within the limit is kept whole. Else kept are the first message, the first user message, tool results that hold an anchor, the
    last rounds, and whatever shares a block with one of them.
    """
    conv = Window.partitionBy("conv_id")
    size = F.length(F.coalesce("content", F.lit("")))
    rows = blocks(messages).withColumn("__n", F.row_number().over(conv.orderBy("turn"))).withColumn("__all", F.sum(size).over(conv)).withColumn("__of", F.count("*").over(conv))
    first_user = F.min(F.when(F.col("role") == "user", F.col("__n"))).over(conv)
    anchor = F.lit(False)
    for a in anchors or []:
        anchor = anchor | F.contains(F.coalesce("content", F.lit("")), F.lit(a))
    rows = rows.withColumn("__anchor", (F.col("role") == "tool") & F.col("tool_call_id").isNotNull() & anchor)
    must = (F.col("__n") == 1) | (F.col("__n") == first_user) | F.col("__anchor") | (F.col("__n") > F.col("__of") - RECENT_ROUNDS * 2)
    rows = rows.withColumn("__must", must)
    in_block = F.max(F.when(F.col("__must"), 1).otherwise(0)).over(Window.partitionBy("conv_id", "block"))
    rows = rows.withColumn("__must", F.col("__must") | (F.col("block").isNotNull() & (in_block == 1)))
    kept_chars = F.sum(F.when(F.col("__must"), size).otherwise(0)).over(conv)
    keep = F.when(kept_chars > limit, DEGRADED_CHARS).otherwise(ANCHOR_CHARS)
    rows = rows.withColumn("keep_chars", F.when(F.col("__anchor"), keep))
    fate = (
        F.when(F.col("__all") <= limit, "keep")
        .when(~F.col("__must"), "summarize")
        .when(F.col("__anchor") & (size > F.col("keep_chars")), "shorten")
        .otherwise("keep")
    )
    return rows.withColumn("fate", fate).drop(*[c for c in rows.columns if c.startswith("__")])


def summary(fates: DataFrame) -> DataFrame:
    """(conv_id, operations): the tool results that were taken out, one summary a conversation."""
    out = fates.where((F.col("fate") == "summarize") & (F.col("role") == "tool"))
    return out.groupBy("conv_id").agg(F.count("*").alias("operations"), F.concat_ws(", ", F.sort_array(F.collect_set("tool_call_id"))).alias("calls"))


def summary_text(calls: DataFrame, gone: DataFrame, shown: int = 20) -> DataFrame:
    """(conv_id, text): one line for the calls (conv_id, turn, tool, args, error, tool_call_id) whose results `gone` (conv_id, tool_call_id) were taken out: turns, number, errors, and the first of them."""
    rows = calls.join(gone.select("conv_id", "tool_call_id").distinct(), ["conv_id", "tool_call_id"], "left_semi")
    one = F.concat("tool", F.lit("("), F.substring(F.coalesce("args", F.lit("")), 1, 70), F.lit(") ["), F.when(F.col("error").isNull(), "ok").otherwise("FAILED"), F.lit("]"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "tool_call_id"))
    per = rows.withColumn("__one", one).withColumn("__n", place).groupBy("conv_id")
    first = F.transform(F.sort_array(F.collect_list(F.when(F.col("__n") <= shown, F.struct("__n", "__one")))), lambda x: x["__one"])
    out = per.agg(F.min("turn").alias("a"), F.max("turn").alias("b"), F.count("*").alias("n"), F.count("error").alias("bad"), first.alias("first"))
    more = F.when(F.col("n") > shown, F.concat(F.lit("; ... and "), (F.col("n") - shown).cast("string"), F.lit(" more"))).otherwise("")
    errors = F.when(F.col("bad") > 0, F.concat(F.col("bad").cast("string"), F.lit(" errors. "))).otherwise("")
    return out.select("conv_id", F.concat(F.lit("[Summary of turns "), F.col("a").cast("string"), F.lit("–"), F.col("b").cast("string"), F.lit(": "), F.col("n").cast("string"), F.lit(" operations. "), errors, F.array_join("first", "; "), more, F.lit("]")).alias("text"))


def truncated(content: Column, tool: Column, limit: int = TOOL_RESULT_CHARS) -> Column:
    """A tool result within `limit` characters: its end where the tool writes, else its beginning up to a line's end; a note says what is left out."""
    writes = tool.rlike("write|edit|add|update|delete|rename|remove|create")
    left = (F.length(content) - limit).cast("string")
    head = F.substring(content, 1, limit)
    whole = F.when(F.contains(F.substring(head, 2, limit), F.lit("\n")), F.regexp_replace(head, r"\n[^\n]*\z", "")).otherwise(head)
    tail = F.concat(F.lit("[truncated, "), left, F.lit(" chars omitted from head]\n"), F.substring(content, -limit, limit))
    return F.when(F.length(content) <= limit, content).when(writes, tail).otherwise(F.concat(whole, F.lit("\n[truncated, "), left, F.lit(" chars omitted from tail]")))


def resolve_tool(names: list[str], wanted: str) -> str | None:
    """The tool of that name, else the only one whose name ends so."""
    if wanted in names:
        return wanted
    hits = [n for n in names if n.endswith(wanted)]
    return hits[0] if len(hits) == 1 else None


def touched_slugs(calls: DataFrame) -> DataFrame:
    """Distinct slugs that successful edits in a tool log (tool, ok, slug, old_slug, new_slug) name."""
    edits = calls.where(F.col("ok") & F.element_at(F.split("tool", r"\."), -1).isin("update_node", "rename_node", "delete_node"))
    return edits.select(F.explode(F.array("slug", "old_slug", "new_slug")).alias("slug")).where("slug IS NOT NULL").distinct()
