"""The Markdown wiki as a source: files are listed once, read and parsed on the executors."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomgraph.functions import frontmatter
from loomgraph.functions.text import extract_wikilinks, normalize_slug
from loomgraph.operators.numbering import in_order
from loomgraph.runtime import local
from loomgraph.schema import COMPRESSION_STAGES, DIR_TYPES, INFRA_FILES, Code, GraphError

LISTING = "abs_path string, path string, mtime double, size bigint"
PAGES = (
    "slug string, title string, type string, tags array<string>, sources array<string>, wikilink_targets array<string>, related array<struct<slug:string,relation:string>>, "
    "created string, updated string, as_of string, checked string, content string, path string, status string, superseded_by string, compression string, abs_path string, mtime double, size bigint"
)


def walk(folder: str, keep=lambda name: name.endswith(".md") and ".tmp-" not in name) -> Iterator[str]:
    """Files below folder, hidden directories and node_modules aside; names that start with a dot or underscore are files like others."""
    for base, dirs, files in os.walk(folder):
        dirs[:] = sorted(d for d in dirs if not d.startswith(".") and d != "node_modules")
        yield from (os.path.join(base, f) for f in files if keep(f))


def list_pages(root: str) -> list[tuple[str, str, float, int]]:
    """(abs_path, path, mtime, size) of the wiki's page files in order of abs_path."""
    wiki = os.path.join(root, "wiki")
    if not os.path.isdir(wiki):
        raise GraphError(Code.WIKI_ROOT_NOT_FOUND, f"{root} holds no wiki/", detail=root)
    out = []
    for p in walk(wiki):
        if os.path.basename(p) not in INFRA_FILES:
            st = os.stat(p)
            out.append((p, os.path.relpath(p, root).replace(os.sep, "/"), st.st_mtime, st.st_size))
    return sorted(out)


def read_clean(path: str) -> tuple[str, str]:
    """(text without a byte-order mark, its line end)."""
    with open(path, encoding="utf-8", newline="") as f:
        text = f.read().removeprefix("﻿")
    return text, "\r\n" if "\r\n" in text else "\n"


def _list(v) -> list[str]:
    return [v] if isinstance(v, str) and v else [x for x in v if isinstance(x, str)] if isinstance(v, list) else []


def _unbracket(s: str) -> str:
    s = s.strip()
    return s[2:-2].strip() if s.startswith("[[") and s.endswith("]]") else s


def _related(v) -> list[dict]:
    rows = [x if isinstance(x, dict) else {"slug": str(x), "relation": None} for x in (v if isinstance(v, list) else [v] if v else [])]
    out = [{"slug": normalize_slug(_unbracket(r["slug"] or "")), "relation": (r.get("relation") or "").strip().lower() or None} for r in rows]
    return [r for r in out if r["slug"]]


def parse_page(path: str, text: str) -> dict:
    """One page file as a row; what the front matter lacks is inferred or stays empty."""
    front, body = frontmatter.parse(text)
    fm = front or {}
    stem = path.rsplit("/", 1)[-1].removesuffix(".md")
    parts = path.split("/")
    parent = parts[-2] if len(parts) > 1 else ""
    kind = str(fm.get("type") or "").strip().lower() or ("overview" if parent == "wiki" else DIR_TYPES.get(parent, "unknown"))
    stage = str(fm.get("compression") or "").strip().lower()
    return {
        "slug": normalize_slug(stem), "title": fm["title"] if "title" in fm else stem, "type": kind, "tags": _list(fm.get("tags")), "sources": _list(fm.get("sources")),
        "wikilink_targets": list(dict.fromkeys(normalize_slug(t) for t in extract_wikilinks(body))), "related": _related(fm.get("related")),
        "created": fm.get("created") or "", "updated": fm.get("updated") or "", "as_of": fm.get("as_of") or None, "checked": fm.get("checked") or None,
        "content": body, "path": path, "status": fm.get("status"), "superseded_by": fm.get("superseded_by"), "compression": stage if stage in COMPRESSION_STAGES else None,
    }


def parse_files(listing: DataFrame) -> DataFrame:
    """Listed files read and parsed where the tasks run; the files must be visible to all executors."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{**parse_page(r.path, read_clean(r.abs_path)[0]), "abs_path": r.abs_path, "mtime": r.mtime, "size": r.size} for r in pdf.itertuples()]
            if rows:
                yield pd.DataFrame(rows)

    return listing.select("abs_path", "path", "mtime", "size").mapInPandas(read, PAGES)


def parse_texts(texts: DataFrame) -> DataFrame:
    """Pages as texts (path, content) parsed like files; they have no file of their own."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{**parse_page(p, (t or "").removeprefix("\ufeff")), "abs_path": None, "mtime": None, "size": None} for p, t in zip(pdf["path"], pdf["content"])]
            if rows:
                yield pd.DataFrame(rows)

    return texts.select("path", "content").mapInPandas(read, PAGES)


def with_ord(pages: DataFrame, listing: list) -> DataFrame:
    """Adds ord, the place in the order of abs_path."""
    order = pages.sparkSession.createDataFrame([(x[0], i) for i, x in enumerate(listing)], "abs_path string, ord bigint")
    return pages.join(order, "abs_path")


def scan(spark: SparkSession, root: str, kept: DataFrame | None = None, files_per_task: int = 500) -> DataFrame:
    """All pages of a wiki. With an earlier scan in `kept`, only files whose time or size changed are read again, and vanished ones leave."""
    listing = list_pages(root)
    files = spark.createDataFrame(listing, LISTING).repartition(max(1, len(listing) // files_per_task))
    if kept is None:
        return with_ord(parse_files(files), listing)
    same = files.select("abs_path", "mtime", "size")
    old = kept.drop("ord").join(same, ["abs_path", "mtime", "size"], "left_semi")
    new = files.join(kept.select("abs_path", "mtime", "size"), ["abs_path", "mtime", "size"], "left_anti")
    return with_ord(old.unionByName(parse_files(new)), listing)


def rescan(kept: DataFrame, root: str, paths: list[str]) -> DataFrame:
    """An earlier scan with only these files read again or gone; ord is the place in the order of abs_path, counted anew."""
    spark, there = kept.sparkSession, []
    for p in dict.fromkeys(paths):
        inside = os.path.relpath(p, root).replace(os.sep, "/")
        if p.endswith(".md") and inside.startswith("wiki/") and os.path.basename(p) not in INFRA_FILES and os.path.exists(p):
            st = os.stat(p)
            there.append((p, inside, st.st_mtime, st.st_size))
    touched = local(spark, [(p,) for p in dict.fromkeys(paths)], "abs_path string")
    same = kept.drop("ord").join(F.broadcast(touched), "abs_path", "left_anti")
    rows = same.unionByName(parse_files(local(spark, there, LISTING)).select(*same.columns))
    return in_order(rows, ["abs_path"], "ord")


def leftovers(root: str) -> list[str]:
    """Temporary files of writes that never ended."""
    return sorted(walk(root, lambda f: ".tmp-" in f))


def find_page(pages: DataFrame, slug: str):
    """The one page of a slug, or None; two are AMBIGUOUS_SLUG."""
    hits = pages.where(F.col("slug") == normalize_slug(slug)).orderBy("ord").limit(2).collect()
    if len(hits) > 1:
        raise GraphError(Code.AMBIGUOUS_SLUG, f"more than one page {slug}", slug=slug)
    return hits[0] if hits else None


def numbered_lines(files: DataFrame, first: int = 1, count: int = 2000) -> DataFrame:
    """(path, line_no, line) of texts (path, content), from line `first`, `count` lines at most: a reader's page, as asked for."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("i", "line"))
    return lines.where((F.col("i") >= first - 1) & (F.col("i") < first - 1 + count)).select("path", (F.col("i") + 1).alias("line_no"), "line")


class WikiSource(DataSource):
    """spark.read.format("wiki").option("root", folder).load(): the pages as a data source, a few hundred files a partition."""

    @classmethod
    def name(cls) -> str:
        return "wiki"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["root"], int(self.options.get("files_per_task", "500")))


class _Reader(DataSourceReader):
    def __init__(self, root: str, step: int):
        self.root, self.step = root, step

    def partitions(self):
        files = list_pages(self.root)
        return [InputPartition(files[i : i + self.step]) for i in range(0, len(files), self.step)] or [InputPartition([])]

    def read(self, partition):
        for abs_path, path, mtime, size in partition.value:
            row = parse_page(path, read_clean(abs_path)[0])
            row["related"] = [(r["slug"], r["relation"]) for r in row["related"]]
            yield (*row.values(), abs_path, mtime, size)


def snapshot(paths: list[str], strict: bool = False) -> dict[str, tuple | None]:
    """path -> (mtime, size, sha256 if strict), None where there is no file."""
    out: dict = {}
    for p in paths:
        try:
            st = os.stat(p)
            out[p] = (st.st_mtime, st.st_size, hashlib.sha256(open(p, "rb").read()).hexdigest() if strict else None)
        except FileNotFoundError:
            out[p] = None
    return out
