"""Evaluation passages inside training text (problem 8): one Aho-Corasick automaton over the items' words, every text scanned once.

The automaton's letters are word numbers. Its patterns are not all runs of 12 words, which would hold each word twelve times, but blocks of half a run, placed
so that every run holds exactly one: an item's words stand in it less than once. A block found in a text is extended to both sides as far as text and item agree; a
stretch of 12 words or more is a leak. So one automaton over all items takes a few times the items' own size, and there is one pass whatever that size.
The items are a held-out set: they come to the driver and are broadcast.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 12
#: One word each: kana and Han characters of these ranges; else runs of letters and digits.
_SINGLE = r"぀-ヿ㐀-䶿一-鿿"
WORD = re.compile(rf"[{_SINGLE}]|(?:(?![{_SINGLE}])[^\W_])+")


def words(text: str | None) -> list[str]:
    """Normalised words of a text; null and blank have none."""
    return WORD.findall(unicodedata.normalize("NFKC", text).lower()) if text else []


def blocks(length: int, run: int = RUN) -> tuple[int, list[int]]:
    """(words of a block, places of the blocks) in an item of `length` words: every run of `run` words holds exactly one block.

    An item of fewer words is one block.
    """
    if length <= run:
        return length, [0] * (length > 0)
    size = max(1, run // 2)
    return size, list(range(0, length - size + 1, run - size + 1))


class Machine:
    """The items' words as numbers, and the automaton over their blocks."""

    def __init__(self, items: list[tuple[int, str | None]], run: int = RUN):
        import ahocorasick

        self.run, self.number, self.items = run, {}, []
        places: dict[tuple, list[tuple[int, int]]] = {}
        for item, text in dict.fromkeys(items):
            own = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words(text))
            size, starts = blocks(len(own), run)
            for at in starts:
                places.setdefault(own[at : at + size], []).append((len(self.items), at))
            if own:
                self.items.append((item, own))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE) if places else None
        for block, where in places.items():
            self.automaton.add_word(block, (len(block), where))
        if places:
            self.automaton.make_automaton()

    def scan(self, own: list[str], every: bool = True) -> dict[int, list[tuple[int, int]]]:
        """Item -> (first, last) words of the stretches of a text's words that it shares, a whole run or the whole item long; all of them, or the first alone.

        A stretch is extended once, however many blocks stand in it: further hits on the same alignment of text and item within it are passed over.
        """
        hits: dict[int, list[tuple[int, int]]] = {}
        if not self.automaton or not own:
            return hits
        get, done = self.number.get, {}
        text = tuple([get(w, 0) for w in own])
        n = len(text)
        for end, (size, where) in self.automaton.iter(text):
            for k, at in where:
                item, theirs = self.items[k]
                lo, hi = end - size + 1, end + 1
                line = (k, lo - at)
                if done.get(line, 0) >= hi or not every and item in hits:
                    continue
                i, j = at, at + size
                while i and lo and theirs[i - 1] == text[lo - 1]:
                    i, lo = i - 1, lo - 1
                while j < len(theirs) and hi < n and theirs[j] == text[hi]:
                    j, hi = j + 1, hi + 1
                done[line] = hi
                if hi - lo >= min(self.run, len(theirs)):
                    hits.setdefault(item, []).append((lo, hi - 1))
        return hits


#: The machine a worker scans with just now, by name: built once per worker, not per task.
_BUILT: dict = {}


def _machine(shared) -> Machine:
    name, items, run = shared.value
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Machine(items, run)
    return _BUILT[name]


def origin(text: str) -> list[int]:
    """For each character of NFKC(text).lower(), the offset in text it comes from.

    The text is cut where a character starts anew under composition; where such pieces don't add up to the whole, the pieces are merged at blanks.
    """
    whole = unicodedata.normalize("NFKC", text).lower()
    for pattern in (r"(?s).[̀-゙゚ͯ]*", r"(?s)\s|\S+"):
        at, out, built = [m.span() for m in re.finditer(pattern, text)], [], []
        for s, e in at:
            piece = unicodedata.normalize("NFKC", text[s:e]).lower()
            built.append(piece)
            out += [s] * len(piece)
        if len(out) == len(whole) and "".join(built).replace("ς", "σ") == whole.replace("ς", "σ"):
            return out
    return [min(i, len(text) - 1) for i in range(len(whole))]


def passages(text: str, hits: dict[int, list[tuple[int, int]]]) -> Iterator[tuple[int, int, int, int]]:
    """(item_id, start, end, n_words) of the longest covered stretches, as offsets in the original text."""
    norm = unicodedata.normalize("NFKC", text).lower()
    spans, back = [m.span() for m in WORD.finditer(norm)], origin(text)
    for item, found in hits.items():
        merged: list[list[int]] = []
        for first, last in sorted(found):
            if merged and first <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], last)
            else:
                merged.append([first, last])
        for first, last in merged:
            end = spans[last][1]
            stop = back[end] if end < len(back) and back[end] > back[end - 1] else back[end - 1] + 1
            yield item, back[spans[first][0]], stop, last - first + 1


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, offsets: bool = False, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """(doc_id, item_id), or with offsets also start_char, end_char, n_words per passage; every text whole, each pair or passage once.

    Null and empty texts leak nothing; items without a word are never found; a null item id is no item; the texts of a repeated item id are all
    that item's. Extra columns are not looked at.
    """
    spark = documents.sparkSession
    names = [id_col, item_col] + (["start_char", "end_char", "n_words"] if offsets else [])
    known = [(r[0], r[1]) for r in items.select(item_col, "text").where(F.col(item_col).isNotNull() & F.col("text").isNotNull()).distinct().toLocalIterator()]
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, sorted(known), run))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = _machine(shared)
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf[id_col], pdf["text"]):
                if hits := machine.scan(words(text), offsets):
                    rows += [(doc, *p) for p in passages(text, hits)] if offsets else [(doc, i) for i in hits]
            yield pd.DataFrame(rows, columns=names)

    return documents.select(id_col, "text").mapInPandas(find, ", ".join(f"`{n}` bigint" for n in names))
