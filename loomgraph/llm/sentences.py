r"""Sentence boundaries by cascading tables of break and no-break rules (problem 10).

A text is first parted into blocks: headings, list items, and paragraphs between blank lines. In a paragraph the places after end marks (and,
next to Thai, white space) are candidates; quotations, brackets, links and code are passed over whole. At each candidate the
ordered rules are tried, those of the label's language first, then those of all other languages, then the common table; the first rule whose `before` matches the
text up to the place and whose `after` matches what follows decides. Labels may be wrong and texts mixed: a label only orders the tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import DataFrame

ENDS = ".!?。！？｡…‥।॥؟۔"
#: Opening marks and what may close them. Those of QUOTES may hold whole sentences.
PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "（": "）", "(": ")", "《": "》", "〈": "〉", "[": "]", "【": "】", "‹": "›"}
QUOTES = set("“„«「『\"")
BRACKETS = set("(（[【")
CLOSERS = "”“\"»」』）)\\]】›’"
TAIL = regex.compile(rf"(?:\[\^?\d{{1,3}}\]|[¹²³⁰⁴-⁹]+|[{CLOSERS}]|[   ]?»|[*_]{{1,3}}(?=\s|$)|[{regex.escape(ENDS)}])*")
#: What a tail can begin with, besides a blank before ».
TAIL_FIRST = set("[¹²³⁰⁴⁵⁶⁷⁸⁹”“\"»」』）)]】›’*_" + ENDS)
#: After a quotation or bracket only what surely closes it.
TAIL_AFTER_CLOSE = regex.compile(r"(?:\[\^?\d{1,3}\]|[¹²³⁰⁴-⁹]+|[”»」』）)】›’]|[  ]?»|[*_]{1,3}(?=\s|$))*")
TOKEN = regex.compile(
    rf"(?P<skip>\[\[[^\]\n]*\]\]|`[^`\n]*`)|(?P<open>[“„«「『（(《〈\[【‹\"])|(?P<end>[{regex.escape(ENDS)}]+)|(?P<thai>(?<=\p{{Thai}}[”\"»)]?)\s+|\s+(?=[“\"«(]?\p{{Thai}}))"
)
MARKS = regex.compile(r"[“”„«»「」『』（）()《》〈〉【】‹›\"\[\]]")
#: What a line that is a block of its own begins with, by kind; a numbered item only begins a block or follows an item.
LINES = regex.compile(r"(?P<heading>\s{0,3}#{1,6}(?:\s|$))|(?P<item>\s*[-*+•·‣]\s+\S)|(?P<numbered>\s*\(?\d{1,3}[.)]\s+\S)")


class Rule(NamedTuple):
    breaks: bool
    before: str
    after: str


def _rule(breaks: bool, before: str, after: str) -> Rule:
    return Rule(breaks, before, after)


def _never(words: str, after: str = "") -> Rule:
    """No break after these abbreviations, a space-separated list without the dots."""
    return _rule(False, rf"(?<![\p{{Latin}}\p{{N}}])(?:{'|'.join(map(regex.escape, words.split()))})\.", after)


SPEECH_ZH = "写道|寫道|说道|說道|说|說|问道|問道|问|表示|指出|称|稱|答道"
TABLES: dict[str, list[Rule]] = {
    # asked before all others: a full stop inside a number, a name or an address
    "first": [_rule(False, r"\.", r"[\p{Nd}a-z]")],
    "en": [
        _never("Prof Dr Mr Mrs Ms St Rev Gen Sen Rep Gov Hon Capt Col Lt Sgt"),
        _never("Fig Figs fig Sect Sec Eq Ref Vol vol pp Ch Approx approx vs cf Cf e.g i.e viz al"),
        _never("No no Nos Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec p", r"\s*\d"),
    ],
    "de": [
        _never("Nr Abb Tab Kap Bd bzw ca Ca vgl Vgl ggf inkl exkl zzgl bspw Bspw sog evtl Str Hr Fr Frl Dipl Ing geb"),
        _rule(False, r"(?<![\p{Latin}\p{N}])[zZuUdDoOvViIsS]\.", r"\s*(?:[BaAhHäÄüÜoOeEsSÄ]|d)\."),
        _rule(False, r"(?<![\p{Latin}\p{N}])(?:[zZ]\. ?B|[uU]\. ?a|[dD]\. ?h|[uU]\. ?ä|[oO]\. ?ä|[iI]\. ?d\. ?R|[vV]\. ?a)\.", r""),
        _rule(False, r"(?<![\p{L}\p{N}.,])\d{1,2}\.", r"\s+(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Quartal|Halbjahr|Jahrhundert|Jahr|Mal|Klasse|Platz|Auflage|Kapitel|Tag|Woche|Monat)\b"),
    ],
    "fr": [
        _never("MM Env env art Art av Av fig chap vol éd cf Cf Mgr Me M p pp ex"),
    ],
    "es": [
        _never("Sr Sra Srta Sres Dra Dr D Dña Ud Uds Aprox aprox pág Pág págs núm art trim fig cap ej Véase EE"),
    ],
    "hi": [
        _rule(False, r"\p{Devanagari}[\p{Devanagari}\p{M}]*\.", r""),
        _rule(False, r"[।॥!?…][”\"]", r"\s*[^।॥!?…“”\n]+?\sने\s(?:लिखा|कहा|पूछा|बताया)\s*[।॥!?….]"),
    ],
    "zh": [
        _rule(False, r"[。！？…!?][”」』\"]", rf"[^。！？…!?“”「」]*(?:{SPEECH_ZH})[。！？…!?]"),
    ],
    "ja": [
        _rule(False, r"[。！？…!?][」』”]", r"\s*(?:と|って|との|という|といった|などと)"),
    ],
    "th": [
        _rule(False, r"\d", r"\s+\p{Thai}"),
        _rule(False, r"[\p{Thai}]", r"\s+\d"),
        _rule(True, r"\p{Thai}[”\"»)]?", r"\s+[^\s\d]"),
        _rule(True, r"[^\s\d]", r"\s+[“\"«(]?\p{Thai}"),
    ],
    "common": [
        # initials: one capital with a dot between names
        _rule(False, r"(?<![\p{Latin}\p{N}.])\p{Lu}\.", r"\s*\p{Lu}"),
        # full stops of scripts that know no other use of them
        _rule(True, r"[。！？｡।॥۔؟][!?…]*[”“\"»」』）)】]*", r""),
        _rule(True, r"[\p{Han}\p{Hiragana}\p{Katakana}ー％%0-9\]」）》](?:…+|\.{3,})[。！？]*", r"(?:\s|$|[\p{Han}\p{Hiragana}\p{Katakana}\p{Lu}“„«\"¿¡「《\[【『(（])"),
        # a word that runs on in another script begins anew
        _rule(True, rf"[{regex.escape(ENDS)}][{CLOSERS}]*", r"\s+\p{Ll}+[\p{Han}\p{Hiragana}\p{Katakana}，、]"),
        # small letters go on after abbreviations that can end a sentence, but begin one after any other word, a number of three digits, a question or a call
        _rule(False, r"(?i:(?<![\p{L}\p{N}.])(?:etc|usw|corp|inc|ltd|bros|dept|univ|assn|est|min|max|avg|incl|excl|resp|eds|trans|prov|misc|intl|natl|govt|tel|ca|cf|pp|op|al|vs|no|nr|st|dr|mr|ms|jr|sr|ed|ej|fl|ss|ff|bd|hr|fr|av|ch|eq|ex|cm|mm|kg|ft|oz|lb|id))\.", r"\s+\p{Ll}"),
        _rule(True, r"(?:(?:\p{Ll}{2}|\p{Lu}{3}|\d{3})\.|[\p{L}\p{N}%)\]][!?]+)[)\]）]?", r"\s+\p{Ll}"),
        # an end mark, then white space (or the end) and no small letter or joining mark
        _rule(True, rf"[{regex.escape(ENDS)}][{CLOSERS}]*", r"(?:\s*$|\s+[^\s\p{Ll},;:)\]}»”%–—-])"),
        # a blank left out between sentences
        _rule(True, r"[\p{Ll}\p{N}%°)\]»”][.!?…]+", r"(?:\p{Lu}(?:[\p{Ll}’'. ]|\p{Lu})|[“„«¿¡]|\"\p{Lu}|\[\[|\()"),
        _rule(True, r"\p{Ll}[.!?…]+", r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Devanagari}\p{Thai}「《『]"),
        _rule(True, r"[.!?…][”“»\"]", r"(?:[\p{Lu}\p{Han}\p{Hiragana}\p{Katakana}\p{Devanagari}\p{Thai}“„«¿¡「《『(]|\[\[)"),
        _rule(True, r"[!?…]\)?", r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Devanagari}\p{Thai}]"),
        _rule(True, r"[.!?…]\)", r"(?:\p{Lu}|[“„«¿¡]|\[\[|\()"),
    ],
}
_ORDER = ["en", "de", "fr", "es", "hi", "zh", "ja", "th"]


def cascade(lang: str | None) -> list[Rule]:
    """The tables in the order they are asked: the first one, the label's language, the other languages, the common table."""
    own = (lang or "").strip().lower()[:2]
    order = [own, *[x for x in _ORDER if x != own]] if own in _ORDER else _ORDER
    return [r for name in ["first", *order, "common"] for r in TABLES[name]]


class Compiled(NamedTuple):
    """A cascade ready for use: all rules in one pattern for places right after the mark, else each with `before` matched backwards from the mark."""

    whole: regex.Pattern
    verdicts: list[bool]
    single: list[tuple[bool, regex.Pattern, regex.Pattern]]


def _compile(rules: list[Rule]) -> Compiled:
    """Alternatives are tried in order, so the first that matches is the first rule that does.

    Neighbours with one verdict and one `after` are joined: which of them matches makes no difference.
    """
    merged: list[Rule] = []
    for r in rules:
        if merged and (merged[-1].breaks, merged[-1].after) == (r.breaks, r.after):
            merged[-1] = Rule(r.breaks, f"{merged[-1].before}|{r.before}", r.after)
        else:
            merged.append(r)
    whole = regex.compile("|".join(f"((?<={r.before})(?={r.after}))" for r in merged))
    return Compiled(whole, [r.breaks for r in merged], [(r.breaks, regex.compile(f"(?r)(?:{r.before})$"), regex.compile(r.after)) for r in merged])


_COMPILED: dict = {}


def _rules(lang: str | None) -> tuple[Compiled, Compiled]:
    """The cascade for places after a full stop, and for all others, where rules that ask for a full stop are left out."""
    own = (lang or "").strip().lower()[:2]
    own = own if own in _ORDER else ""
    if own not in _COMPILED:
        rules = cascade(own)
        _COMPILED[own] = _compile(rules), _compile([r for r in rules if not r.before.endswith(r"\.")])
    return _COMPILED[own]


def _decide(rules: tuple, text: str, lo: int, at: int, mark: int, hi: int) -> bool:
    """Does a sentence end at `at`, the marks before it ending at `mark`? The rules see the block [lo, hi), all of it."""
    own = rules[0] if text[mark - 1] == "." else rules[1]
    if at == mark:
        m = own.whole.match(text, at, hi)
        return bool(m) and own.verdicts[m.lastindex - 1]
    return next((breaks for breaks, b, a in own.single if a.match(text, at, hi) and b.match(text, lo, mark)), False)


def _after_close(rules: tuple, text: str, lo: int, inner: str, close: int, at: int, hi: int) -> bool:
    """The same behind a closing mark at `close`: the rules see the quotation's end mark next to it, whatever blank or note stands between (inner is without these)."""
    plain = text[close - 1 : close] == inner[-1:]
    before = text if plain else inner + text[close]
    start, end = (lo, close + 1) if plain else (0, len(before))
    return next((breaks for breaks, b, a in rules[1].single if a.match(text, at, hi) and b.match(before, start, end)), False)


def _matched(text: str, lo: int, hi: int) -> dict[int, int]:
    """Offset of each opening mark that is closed in its block -> offset of its closing mark; one pass."""
    out, stacks = {}, {}
    for m in MARKS.finditer(text, lo, hi):
        c, i = m.group(), m.start()
        if c == '"':
            stack = stacks.setdefault(c, [])
            if stack:
                out[stack.pop()] = i
            else:
                stack.append(i)
        elif c in "“”„":
            stack = stacks.setdefault("“", [])
            if c == "„" or c == "“" and not (stack and text[stack[-1]] == "„"):
                stack.append(i)
            elif stack:
                out[stack.pop()] = i
        elif c in PAIRS:
            stacks.setdefault(PAIRS[c], []).append(i)
        elif stack := stacks.get(c):
            out[stack.pop()] = i
    return out


def _paragraph(text: str, lo: int, hi: int, rules: tuple) -> Iterator[tuple[int, int]]:
    closed = _matched(text, lo, hi)
    start, at = lo, lo
    while True:
        while start < hi and text[start].isspace():
            start += 1
        m = TOKEN.search(text, max(at, start), hi)
        if not m:
            break
        kind = m.lastgroup
        stop = None
        if kind == "skip":
            at = m.end()
        elif kind == "open":
            i = m.start()
            j = closed.get(i)
            if j is None:
                at = i + 1
                continue
            at = j + 1
            c = m.group()
            inner = text[i + 1 : j].rstrip()
            if inner and inner[-1] not in ENDS:
                inner = TAIL_INNER.sub("", inner)
            if inner and inner[-1] in ENDS and (c in QUOTES or c in BRACKETS and i == start):
                tail = TAIL_AFTER_CLOSE.match(text, at, hi)
                if at < hi and text[at] in ENDS:
                    continue
                at = stop = tail.end()
                if _after_close(rules, text, lo, inner, j, stop, hi):
                    yield start, stop
                    start = stop
            continue
        elif kind == "end":
            marks = m.end()
            c = text[marks : min(marks + 1, hi)]
            stop = TAIL.match(text, marks, hi).end() if c in TAIL_FIRST or c.isspace() and text[marks + 1 : marks + 2] == "»" else marks
            # a straight quotation mark opens rather than closes where its partner is still to come
            k = text.find('"', marks, stop)
            if k >= 0 and k in closed:
                stop = k
            k = next((k for k in range(marks, stop) if text[k] in "“" and k in closed), -1)
            if k >= 0:
                stop = k
            at = max(stop, m.start() + 1)
            if _decide(rules, text, lo, stop, marks, hi):
                yield start, stop
                start = stop
        else:  # white space next to Thai
            at = m.end()
            if _decide(rules, text, lo, m.start(), m.start(), hi):
                yield start, m.start()
                start = m.end()
    end = hi
    while end > start and text[end - 1].isspace():
        end -= 1
    if end > start:
        yield start, end


TAIL_INNER = regex.compile(rf"(?:\[\^?\d{{1,3}}\]|[{CLOSERS}\s*_])+$")


def sentences(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of every sentence of a text, in order, as code-point offsets; null and blank texts have none."""
    if not text or text.isspace():
        return []
    rules, out = _rules(lang), []
    para, listed, fresh = None, False, True  # start of the open paragraph; was the last line an item; does a block begin here
    at = 0
    n = len(text)
    while at < n:
        stop = text.find("\n", at)
        stop = n if stop < 0 else stop
        line = text[at:stop]
        kind = m.lastgroup if (m := LINES.match(line)) else None
        alone = kind is not None and (kind != "numbered" or fresh or listed)
        if alone or not line.strip():
            if para is not None:
                out += _paragraph(text, para, at, rules)
                para = None
            if alone:
                lead = len(line) - len(line.lstrip())
                out.append((at + lead, at + len(line.rstrip())))
            listed, fresh = alone and kind != "heading", True
        else:
            if para is None:
                para = at
            listed, fresh = False, False
        at = stop + 1
    if para is not None:
        out += _paragraph(text, para, n, rules)
    return [(s, e) for s, e in out if e > s]


def sentence_rows(documents: DataFrame, with_text: bool = False, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, start_char, end_char), with_text also sentence: one row per sentence of every text, texts whole.

    Repeated ids give their sentences each time; extra columns are not looked at. A table without `lang` is cut by all tables in their usual order.
    """
    labelled = "lang" in documents.columns
    columns = [id_col, "start_char", "end_char"] + ["sentence"] * with_text

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            langs = pdf["lang"] if labelled else [None] * len(pdf)
            rows = []
            for doc, text, lang in zip(pdf[id_col], pdf["text"], langs):
                for s, e in sentences(text, lang if isinstance(lang, str) else None):
                    rows.append((doc, s, e, text[s:e]) if with_text else (doc, s, e))
            yield pd.DataFrame(rows, columns=columns)

    schema = f"`{id_col}` bigint, start_char bigint, end_char bigint" + (", sentence string" if with_text else "")
    return documents.select(id_col, "text", *["lang"] * labelled).mapInPandas(cut_up, schema)
