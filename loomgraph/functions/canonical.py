"""Canonical spelling of slugs, tags, types, sources and actors, kept on the JVM.

Spark has no NFKC function; its own ICU library is called by `reflect`. ASCII text, nearly all of it, skips the call.
`reflect` counts as non-deterministic, so it stands in projections only; the helpers below add columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that NFKC leaves as it is; all other kinds become blanks.
SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85   "


def nfkc(col: Column) -> Column:
    """Unicode NFKC; null stays null."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), col, F.lit(True))
    return F.when(col.isNull() | col.rlike(r"^[\x00-\x7F]*$"), col).otherwise(composed)


#: Text of these characters alone is its own canonical form but for an outer [[ ]] or a trailing slash: visible ASCII without capitals.
PLAIN = r"\A[!-@\[-~]+\z"


def _folded(col: Column) -> Column:
    """NFKC, lower case, without outer white space; the usual plain text is left alone after one look."""
    return F.when(col.rlike(PLAIN), col).otherwise(strip(F.lower(nfkc(col))))


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACE))


def _unbracket(col: Column) -> Column:
    inner = F.when(
        col.startswith("[[") & col.endswith("]]") & (F.length(col) >= 4),
        strip(F.substring(col, F.lit(3), F.length(col) - 4)),
    ).otherwise(col)
    return F.nullif(inner, F.lit(""))


def _unslash(col: Column) -> Column:
    return F.nullif(F.when(col.endswith("/"), F.substring(col, F.lit(1), F.length(col) - 1)).otherwise(col), F.lit(""))


def with_canonical(df: DataFrame, name: str, col: Column, source: bool = False) -> DataFrame:
    """Adds or replaces column `name` with c(col): NFKC, lower case, outer white space and one [[ ]] pair removed.

    Blank becomes null. With source=True one trailing slash goes as well.
    """
    tmp = f"__loom_{name}"
    out = _unbracket(F.col(tmp))
    df = df.withColumn(tmp, _folded(col)).withColumn(name, out)
    if source:
        df = df.withColumn(name, _unslash(F.col(name)))
    return df.drop(tmp)


def with_canonical_array(df: DataFrame, name: str, col: Column, source: bool = False) -> DataFrame:
    """Adds or replaces array column `name`: the distinct c() of the elements; null and blank elements vanish, a null array is empty."""
    tmp = f"__loom_{name}"
    df = df.withColumn(tmp, F.transform(col, _folded))
    df = df.withColumn(tmp, F.transform(tmp, _unbracket))
    if source:
        df = df.withColumn(tmp, F.transform(tmp, _unslash))
    kept = F.filter(tmp, lambda x: x.isNotNull())
    return df.withColumn(name, F.coalesce(F.array_distinct(kept), F.array().cast("array<string>"))).drop(tmp)


_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + " 　"
_PLAIN = "".join(map(chr, range(0x21, 0x7F))) + "  "


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def width_sql(expr: str) -> str:
    """DuckDB form of NFKC for text whose compatibility characters are width forms and blanks: it has NFC only, so those are translated first."""
    return f"nfc_normalize(translate({expr}, {_quote(_WIDE)}, {_quote(_PLAIN)}))"


def canonical_sql(expr: str, source: bool = False) -> str:
    """DuckDB form of c(), with width_sql() for NFKC."""
    space = " || ".join(["' '", *(f"chr({ord(x)})" for x in SPACE[1:])])
    n = f"trim(lower({width_sql(expr)}), {space})"
    n = rf"regexp_replace({n}, '(?s)^\[\[\s*(.*?)\s*\]\]$', '\1')"
    if source:
        n = f"regexp_replace({n}, '/$', '')"
    return f"nullif({n}, '')"
