"""Files around a wiki: where wikis are, paths that may be touched, reading pages of text, listing, copying, single edits, snapshots, settings."""

from __future__ import annotations

import json
import os
import re
import shutil
import sys
import zipfile
from collections.abc import Iterable, Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.schema import FILE_READ_BYTES, FILE_READ_LINES, Code, GraphError
from loomgraph.sources.commit import write_atomic
from loomgraph.sources.wiki import read_clean, walk

#: Directories and files that are never taken in as sources.
EXCLUDED_DIRS = {"node_modules", ".git", ".svn", ".hg", "__pycache__", ".obsidian", ".trash", ".cache", ".venv", "venv", "dist", "build", ".next", ".nuxt", "coverage"}
EXCLUDED_FILES = {".DS_Store", "Thumbs.db", "desktop.ini"}
SOURCE_KINDS = (".md", ".txt", ".html", ".htm", ".mmd", ".rmd")


# where a wiki is


def is_wiki(root: str) -> bool:
    return os.path.isdir(os.path.join(root, "wiki")) and os.path.isdir(os.path.join(root, "raw")) and os.path.isfile(os.path.join(root, "wiki", "index.md"))


def list_wikis(folder: str | None) -> list[str]:
    """Wikis directly below a folder, by name; none of a folder that is none."""
    if not folder or not os.path.isdir(folder):
        return []
    return [p for n in sorted(os.listdir(folder)) if is_wiki(p := os.path.join(folder, n))]


def find_wiki(value: str, folder: str | None) -> str:
    """The root a name or path stands for; a bare name is one of the folder's wikis. WIKI_ROOT_NOT_FOUND else."""
    bare = not os.path.isabs(value) and not re.search(r"[/\\:]", value)
    if bare and not (folder and os.path.isdir(folder)):
        raise GraphError(Code.WIKI_ROOT_NOT_FOUND, f"{value} is a name, and no folder of wikis is set", detail=value)
    root = os.path.join(folder, value) if bare else os.path.abspath(value)
    if not is_wiki(root):
        raise GraphError(Code.WIKI_ROOT_NOT_FOUND, f"{root} lacks wiki/, raw/ or wiki/index.md", detail=root)
    return root


def targets(asked: str | None, env: Mapping[str, str], write: bool) -> list[str]:
    """Roots to work on: the one asked for, else SELECTED_WIKI, else for reads every wiki below WIKIS_ROOT."""
    folder = env.get("WIKIS_ROOT")
    if one := asked or env.get("SELECTED_WIKI"):
        return [find_wiki(one, folder)]
    found = [] if write else list_wikis(folder)
    if not found:
        raise GraphError(Code.WIKI_ROOT_NOT_FOUND, "a write needs one wiki" if write else "no wiki is named and none found", detail=folder)
    return found


def default_root(asked: str | None, env: Mapping[str, str]) -> tuple[str | None, str | None]:
    """(root, warning) for a server: asked, SELECTED_WIKI, or the outdated WIKI_ROOT; what is no wiki is taken as a path and fails when used."""
    value = asked or env.get("SELECTED_WIKI") or env.get("WIKI_ROOT")
    if not value:
        return None, None
    try:
        root = find_wiki(value, env.get("WIKIS_ROOT"))
    except GraphError:
        root = os.path.abspath(value)
    old = not asked and not env.get("SELECTED_WIKI")
    return root, "WIKI_ROOT is outdated, set SELECTED_WIKI" if old else None


# settings and values


def find_dotenv(start: str) -> str | None:
    """The nearest .env in a folder or above it."""
    at = os.path.abspath(start)
    while not os.path.isfile(os.path.join(at, ".env")):
        if (up := os.path.dirname(at)) == at:
            return None
        at = up
    return os.path.join(at, ".env")


def parse_dotenv(text: str) -> dict[str, str]:
    """KEY=value lines; blank lines, comments and lines without = say nothing; one pair of quotes around a value goes."""
    found = re.findall(r"(?m)^[^\S\n]*(?!#)([^=\n]*?)[^\S\n]*=[^\S\n]*(.*?)[^\S\n]*\r?$", text)
    return {k: re.sub(r"""(?s)\A(["'])(.*)\1\Z""", r"\2", v) for k, v in found}


def load_env(env: dict, start: str = ".") -> dict:
    """env with what the nearest .env adds; nothing that is set is changed."""
    path = find_dotenv(start)
    for k, v in (parse_dotenv(read_clean(path)[0]) if path else {}).items():
        env.setdefault(k, v)
    return env


def cli_value(text: str):
    """A value of the command line: `-` is the standard input, @file a file's text, else JSON where it can be read as such, else the text."""
    if text == "-":
        return sys.stdin.read()
    if text.startswith("@"):
        return read_clean(text[1:])[0]
    try:
        return json.loads(text)
    except ValueError:
        return text


def cli_list(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


# paths and texts


def inside(root: str, path: str, scope: Iterable[str] | None = None) -> str:
    """The absolute path of a path below root, links followed; outside it, or outside all folders of `scope`, is a PermissionError."""
    root = os.path.realpath(root)
    full = os.path.realpath(os.path.join(root, path))
    below = lambda base: full == base or full.startswith(base + os.sep)
    if not below(root) or scope is not None and not any(below(os.path.realpath(os.path.join(root, s))) for s in scope):
        raise PermissionError(f"{path} is outside")
    return full


def dreams_dir(root: str, path: str = "wiki/dreams") -> str:
    """The folder sessions write to: below wiki/, whatever is asked for."""
    return inside(root, path, ["wiki"])


def capped(text: str, label: str, most_bytes: int = FILE_READ_BYTES, most_lines: int = FILE_READ_LINES) -> str:
    """A text within both limits, cut at a line's end, with a note where it was cut."""
    lines = text.split("\n")
    head = "\n".join(lines[:most_lines])
    data = head.encode()
    if len(data) > most_bytes:
        short = data[:most_bytes].decode(errors="ignore")
        head = short[: short.rfind("\n")] if "\n" in short[1:] else short
    elif len(lines) <= most_lines:
        return text
    return f"{head}\n[truncated: {label} exceeds the read limit]"


def capped_lines(files: DataFrame, first: int = 1, count: int = 500, most_bytes: int = FILE_READ_BYTES, most_lines: int = FILE_READ_LINES) -> DataFrame:
    """(path, line_no, line) of texts (path, content) from line `first`: `count` lines, most_lines and most_bytes (with line ends) at most; at least one line."""
    part = F.slice(F.split("content", "\n"), F.lit(max(1, first)), F.lit(min(count, most_lines)))
    rows = files.select("path", part.alias("part"))
    sizes = F.transform("part", lambda x: F.octet_length(x).cast("bigint") + 1)
    # bytes up to and with each line, as one fold
    upto = F.aggregate(sizes, F.array().cast("array<bigint>"), lambda a, n: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + n)))
    rows = rows.select("path", F.posexplode(F.arrays_zip(F.col("part").alias("line"), upto.alias("upto"))).alias("i", "x"))
    return rows.where((F.col("i") == 0) | (F.col("x.upto") <= most_bytes)).select("path", (F.col("i") + max(1, first)).alias("line_no"), F.col("x.line").alias("line"))


class Edit(NamedTuple):
    status: str  # exact, loose, absent, several, empty
    text: str


def edited(text: str, old: str, new: str) -> Edit:
    """text with its one place of `old` made `new`; where it stands nowhere as it is, lines are compared without their outer blanks and replaced whole."""
    found = [m.start() for m in re.finditer(f"(?={re.escape(old)})", text)] if old else []
    if found:
        return Edit("several", text) if len(found) > 1 else Edit("exact", text[: found[0]] + new + text[found[0] + len(old) :])
    wanted, lines = [x.strip() for x in old.split("\n")], text.split("\n")
    if not any(wanted):
        return Edit("empty", text)
    bare = [x.strip() for x in lines]
    n = len(wanted)

    def fits(i: int) -> bool:
        # the first and last line may be part of a line, the others are whole lines
        here = bare[i : i + n]
        return len(here) == n and (wanted[0] in here[0] if n == 1 else here[0].endswith(wanted[0]) and here[1:-1] == wanted[1:-1] and here[-1].startswith(wanted[-1]))

    at = [i for i in range(len(lines) - n + 1) if fits(i)]
    if len(at) != 1:
        return Edit("several" if at else "absent", text)
    return Edit("loose", "\n".join([*lines[: at[0]], new, *lines[at[0] + n :]]))


def edit_file(root: str, path: str, old: str, new: str, scope: Iterable[str] | None = None) -> str:
    """edited() of a file below root, written atomically where it changed; the status."""
    full = inside(root, path, scope)
    done = edited(read_clean(full)[0], old, new)
    if done.status in ("exact", "loose"):
        write_atomic(full, done.text)
    return done.status


def write_file(root: str, path: str, text: str, scope: Iterable[str] | None = None) -> None:
    write_atomic(inside(root, path, scope), text)


def listing(folder: str) -> list[tuple[str, bool, int]]:
    """(name, is it a folder, bytes) of a folder's entries, folders first, then by name."""
    rows = [(e.name, e.is_dir(), 0 if e.is_dir() else e.stat().st_size) for e in os.scandir(folder)]
    return sorted(rows, key=lambda r: (not r[1], r[0]))


def source_files(root: str, kinds: tuple[str, ...] = SOURCE_KINDS) -> list[str]:
    """Files below a folder that may be taken in as sources, in order."""
    found = walk(root, lambda name: name.lower().endswith(kinds) and name not in EXCLUDED_FILES)
    return sorted(p for p in found if not EXCLUDED_DIRS & set(os.path.relpath(p, root).split(os.sep)[:-1]))


def copy_sources(source: str, root: str) -> str:
    """A file or tree copied below raw/sources under its own name; where it went."""
    to = os.path.join(root, "raw", "sources", os.path.basename(os.path.abspath(source)))
    if os.path.isdir(source):
        shutil.copytree(source, to, dirs_exist_ok=True)
    else:
        os.makedirs(os.path.dirname(to), exist_ok=True)
        shutil.copy2(source, to)
    return to


def snapshot_zip(root: str, state_dir: str, name: str) -> str:
    """All files of wiki/ in one archive below the state folder, taken before a session writes; its path."""
    os.makedirs(os.path.join(state_dir, "snapshots"), exist_ok=True)
    path = os.path.join(state_dir, "snapshots", f"{name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(walk(os.path.join(root, "wiki"), lambda n: ".tmp-" not in n)):
            z.write(p, os.path.relpath(p, root))
    return path
