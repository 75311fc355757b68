"""The index page as text: one line per page under a heading per type; single lines put in, taken out or changed, and the whole built anew."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from loomgraph.schema import TYPE_HEADINGS

_ENTRY = re.compile(r"- \[\[([^\]]+)\]\]")
_TITLED = re.compile(r"- \[\[([^\]]+)\]\] — ")


def entry(slug: str, title: str | None) -> str:
    return f"- [[{slug}]] — {title or ''}"


def heading(kind: str) -> str:
    return TYPE_HEADINGS.get(kind) or kind[:1].upper() + kind[1:]


def sections(text: str) -> list[list[str]]:
    """Lines of the text before the first second-level heading, then of each section with its heading."""
    out: list[list[str]] = [[]]
    for line in text.split("\n"):
        if line.startswith("## "):
            out.append([])
        out[-1].append(line)
    return out


def _join(parts: Iterable[list[str]]) -> str:
    return "\n".join(line for part in parts for line in part)


def with_entry(text: str, slug: str, title: str | None, kind: str) -> str:
    """The page's line added to its type's section, before the first greater slug; a missing section comes before `Other`, else at the end."""
    parts, name = sections(text), f"## {heading(kind)}"
    for own in parts:
        if own and own[0].strip() == name:
            start = 1 + (own[1:2] == [""])
            stop = next((i for i in range(start, len(own)) if not own[i].strip()), len(own))
            greater = (i for i in range(start, stop) if (m := _ENTRY.match(own[i].strip())) and m[1] > slug)
            own.insert(next(greater, stop), entry(slug, title))
            return _join(parts)
    at = next((i for i, p in enumerate(parts) if p and p[0].strip() == "## Other"), len(parts))
    parts.insert(at, [name, "", entry(slug, title), ""])
    return _join(parts)


def without_entries(text: str, slugs: set[str]) -> str:
    return "\n".join(line for line in text.split("\n") if not ((m := _ENTRY.match(line)) and m[1] in slugs))


def with_changed_entry(text: str, old: str, slug: str, title: str | None) -> str:
    """The line of `old` names slug and title; it stays where it is."""
    return "\n".join(entry(slug, title) if (m := _TITLED.match(line)) and m[1] == old else line for line in text.split("\n"))


def rebuilt(lines: Iterable[tuple[str, str]], old: str) -> Iterator[str]:
    """Lines of a new index from (heading, line) in order; sections of the old one that belong to no type follow, each once."""
    yield "# Index"
    last = None
    for name, line in lines:
        if name != last:
            yield from ("", f"## {name}", "")
            last = name
        yield line
    made = {f"## {h}" for h in (*TYPE_HEADINGS.values(), "Other")}
    own = dict.fromkeys("\n".join(s).rstrip() for s in sections(old)[1:] if s[0].strip() not in made)
    for section in own:
        yield from ("", section)
    yield ""
