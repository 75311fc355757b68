"""YAML front matter under JSON rules: dates and yes/no stay text, numbers print as they would in JavaScript, repeated keys are an error."""

from __future__ import annotations

import json
import re

import yaml

STRICT = re.compile(r"\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\Z)", re.S)
FENCE = re.compile(r"\A```ya?ml[ \t]*\r?\n(.*?)\r?\n```[ \t]*(?:\r?\n|\Z)", re.S)
PREFIX_LINES = 6


class _Loader(yaml.SafeLoader):
    yaml_implicit_resolvers: dict = {}


for tag, pattern, first in (
    ("null", r"^(?:null|~|)$", ["n", "~", ""]),
    ("bool", r"^(?:true|false)$", ["t", "f"]),
    ("int", r"^-?(?:0|[1-9][0-9]*)$", list("-0123456789")),
    ("float", r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]*)?(?:[eE][-+]?[0-9]+)?$", list("-0123456789")),
):
    _Loader.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(pattern), first)


def _mapping(loader: _Loader, node: yaml.MappingNode, deep: bool = False) -> dict:
    keys = [loader.construct_object(k, deep=True) for k, _ in node.value]
    if len({str(k) for k in keys}) < len(keys):
        raise yaml.YAMLError("repeated key")
    return {k if isinstance(k, str) else scalar(k): loader.construct_object(v, deep=True) for k, (_, v) in zip(keys, node.value)}


def _float(loader: _Loader, node: yaml.ScalarNode) -> float:
    return float(node.value)


_Loader.add_constructor("tag:yaml.org,2002:map", _mapping)
_Loader.add_constructor("tag:yaml.org,2002:float", _float)


def scalar(v) -> str:
    """A value as text; null is empty, nested values are JSON."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float) and v.is_integer() and abs(v) < 1e21:
        return str(int(v))
    return json.dumps(v, ensure_ascii=False, separators=(",", ":")) if isinstance(v, (dict, list)) else str(v)


def _repair(block: str) -> str:
    """`key: [[a]], [[b]]`, which is no YAML, becomes a list of a and b."""

    def fix(m: re.Match) -> str:
        items = re.findall(r"\[\[([^\]]+)\]\]", m[2])
        return f"{m[1]}: [{', '.join(json.dumps(i, ensure_ascii=False) for i in items)}]"

    return re.sub(r"^([\w-]+):[ \t]*(\[\[[^\]\n]+\]\](?:[ \t]*,[ \t]*\[\[[^\]\n]+\]\])+)[ \t]*$", fix, block, flags=re.M)


def _load(block: str) -> dict | None:
    for text in dict.fromkeys((block, _repair(block))):
        try:
            value = yaml.load(text, _Loader)  # noqa: S506: a subclass of the safe loader
        except yaml.YAMLError:
            continue
        return value if isinstance(value, dict) else None
    return None


def _value(key: str, v):
    if isinstance(v, list):
        if key == "related":
            return [{"slug": scalar(x.get("slug")), "relation": scalar(x.get("relation")) or None} if isinstance(x, dict) else {"slug": scalar(x), "relation": None} for x in v]
        return [scalar(x) for x in v]
    return scalar(v)


def parse(text: str) -> tuple[dict | None, str]:
    """(front matter, body): a block at the start, or after a few stray lines, or in a yaml fence; null where it can't be read."""
    lines = text.split("\n")
    starts = [i for i, line in enumerate(lines[: PREFIX_LINES + 1]) if i == 0 or line.strip() == "---" or line.startswith("```")]
    for i in starts:
        rest = "\n".join(lines[i:])
        m = STRICT.match(rest) or FENCE.match(rest)
        if not m:
            continue
        inner = STRICT.match(m[1] + "\n")
        found = _load(inner[1] if inner else m[1])
        return None if found is None else {k: _value(k, v) for k, v in found.items()}, rest[m.end() :]
    return None, text


def compose(front: dict, body: str) -> str:
    """A page's text from its front matter, keys in their order, and its body."""
    plain = {k: [x["slug"] if not x.get("relation") else dict(x) for x in v] if k == "related" and isinstance(v, list) else v for k, v in front.items() if v is not None}
    block = yaml.safe_dump(plain, sort_keys=False, allow_unicode=True, width=float("inf"))
    return f"---\n{block}---\n\n{body.strip()}\n"
