"""Slugs and wikilinks: column expressions for reading them, plain functions (for pandas UDFs and commits) for rewriting text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.canonical import nfkc
from loomgraph.schema import Code, GraphError

#: Device names that no file may have (fixed values).
RESERVED = {"con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10))}
LINK = re.compile(r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]")
CODE = re.compile(r"`[^`]*`")


def normalize_slug(s: str) -> str:
    return unicodedata.normalize("NFKC", s).lower()


def title_to_slug(title: str) -> str:
    """The slug of a title; INVALID_SLUG where nothing or a reserved name is left."""
    s = re.sub(r"\s+", "-", unicodedata.normalize("NFKC", title).strip().lower())
    s = re.sub(r"-+", "-", "".join(c for c in s if c == "-" or unicodedata.category(c)[0] in "LN"))
    s = s.removeprefix("-").removesuffix("-")
    if not s or s in RESERVED:
        raise GraphError(Code.INVALID_SLUG, f"no slug can be made of {title!r}", slug=s)
    return s


def starts_with_digit(slug: Column) -> Column:
    return slug.rlike(r"^\p{N}")


def with_nfkc(df: DataFrame, name: str, col: Column) -> DataFrame:
    """Column form of normalize_slug."""
    return df.withColumn(name, nfkc(col)).withColumn(name, F.lower(name))


def with_slug(df: DataFrame, name: str, title: Column) -> DataFrame:
    """Column form of title_to_slug; null instead of an error."""
    df = df.withColumn(name, F.regexp_replace(F.lower(F.trim(nfkc(title))), r"(?U)\s+", "-"))
    s = F.regexp_replace(F.regexp_replace(F.col(name), r"[^\p{L}\p{N}-]", ""), "-+", "-")
    s = F.regexp_replace(s, "^-|-$", "")
    return df.withColumn(name, F.when((s != "") & ~s.isin(sorted(RESERVED)), s))


def _visible(text: str):
    """(line, outside fences) of each line."""
    fenced = False
    for line in text.split("\n"):
        if line.strip().startswith(("```", "~~~")):
            fenced = not fenced
            yield line, False
        else:
            yield line, not fenced


def extract_wikilinks(text: str) -> list[str]:
    """Targets outside code, in order, repeats kept."""
    return [m[1].strip() for line, seen in _visible(text) if seen for m in LINK.finditer(CODE.sub("", line))]


def wikilinks(text: Column) -> Column:
    """The same as a column: array of targets; fences toggle over the lines in one fold, code spans are removed, links matched."""
    lines = F.split(text, "\n")
    zero = F.struct(F.lit(False).alias("fenced"), F.array().cast("array<string>").alias("kept"))

    def step(state, line):
        fence = F.trim(line).rlike("^(```|~~~)")
        keep = ~fence & ~state["fenced"] & F.contains(line, F.lit("[["))
        return F.struct(
            F.when(fence, ~state["fenced"]).otherwise(state["fenced"]).alias("fenced"),
            F.when(keep, F.concat(state["kept"], F.array(F.regexp_replace(line, "`[^`]*`", "")))).otherwise(state["kept"]).alias("kept"),
        )

    visible = F.aggregate(lines, zero, step, lambda s: s["kept"])
    links = F.flatten(F.transform(visible, lambda line: F.regexp_extract_all(line, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"), F.lit(1))))
    return F.transform(links, lambda x: F.trim(x))


def has_wikilink(text: str, slug: str) -> bool:
    return normalize_slug(slug) in map(normalize_slug, extract_wikilinks(text))


def _rewrite(text: str, slug: str, new: Callable[[re.Match], str], drop: Callable[[str], bool] = lambda line: False) -> str:
    """Applies new() to each link to slug outside code; lines for which drop() holds go."""
    want, out = normalize_slug(slug), []
    for line, seen in _visible(text):
        if seen and drop(line):
            continue
        if seen and "[[" in line:
            parts = re.split(r"(`[^`]*`)", line)
            line = "".join(p if i % 2 else LINK.sub(lambda m: new(m) if normalize_slug(m[1].strip()) == want else m[0], p) for i, p in enumerate(parts))
        out.append(line)
    return "\n".join(out)


def _is_item(slug: str) -> Callable[[str], bool]:
    want = normalize_slug(slug)

    def check(line: str) -> bool:
        m = re.fullmatch(r"\s*[-*+]\s+\[\[([^\]|]+)(?:\|[^\]]+)?\]\]\s*", line)
        return bool(m) and normalize_slug(m[1].strip()) == want

    return check


def replace_wikilinks(text: str, old: str, new: str) -> str:
    """Links to old become links to new; what is shown stays."""
    return _rewrite(text, old, lambda m: f"[[{new}|{m[2]}]]" if m[2] else f"[[{new}]]")


def remove_wikilinks(text: str, slug: str) -> str:
    """List items that are only the link go; links within a line leave nothing."""
    return _rewrite(text, slug, lambda m: "", _is_item(slug))


def dangling_wikilink(text: str, slug: str, title: str, mode: str = "strikethrough") -> str:
    """What a deleted page's links become: struck through, plain text, or nothing."""
    if mode == "remove":
        return remove_wikilinks(text, slug)
    return _rewrite(text, slug, lambda m: f"~~{title}~~" if mode == "strikethrough" else title)


def insert_wikilink(text: str, slug: str, context: str | None = None) -> str:
    """Adds `- [[slug]]` to the end of the section named by context, else `## 相关`, else `## Related`; else a new section at the end."""
    lines, item = text.split("\n"), f"- [[{slug}]]"
    heads = [(i, m) for i, (line, seen) in enumerate(_visible(text)) if seen and (m := re.match(r"(#{1,6})\s+(.*?)\s*$", line))]
    for wanted in ([context] if context else []) + ["相关", "Related"]:
        for i, m in heads:
            if m[2].lower() == wanted.lstrip("# ").strip().lower():
                end = next((j for j, n in heads if j > i and len(n[1]) <= len(m[1])), len(lines))
                while end > i + 1 and not lines[end - 1].strip():
                    end -= 1
                return "\n".join(lines[:end] + [item] + lines[end:])
    return text.rstrip() + f"\n\n## 相关\n\n{item}\n"


def heading_first(content: str, title: str) -> str:
    """Content that starts with a first-level heading as it is, trimmed; else with one put before it."""
    body = content.strip()
    return body if re.match(r"#\s", body) else f"# {title}\n\n{body}".rstrip()


def text_udf(fn: Callable[..., str | None]):
    """A pandas UDF over string columns; null in the first gives null."""

    @F.pandas_udf(T.StringType())
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([None if row[0] is None else fn(*row) for row in zip(*cols)], dtype=object)

    return run
