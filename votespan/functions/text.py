"""Word lists to text, words back to character spans, spans to other spans."""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

from votespan.functions.arrays import bind, by_cell, cell

# Executors need no copy of what runs in their Python workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLANKS = "[ \\t\\n\\r]"

# The published Treebank de-tokenising rules, in their order of use.
CONTRACTIONS = [
    (r"(?i) ('t)\s(is)\b", "$1$2"),
    (r"(?i) ('t)\s(was)\b", "$1$2"),
    (r"(?i)\b(can)\s(not)\b", "$1$2"),
    (r"(?i)\b(d)\s('ye)\b", "$1$2"),
    (r"(?i)\b(gim)\s(me)\b", "$1$2"),
    (r"(?i)\b(gon)\s(na)\b", "$1$2"),
    (r"(?i)\b(got)\s(ta)\b", "$1$2"),
    (r"(?i)\b(lem)\s(me)\b", "$1$2"),
    (r"(?i)\b(more)\s('n)\b", "$1$2"),
    (r"(?i)\b(wan)\s(na)(\s)", "$1$2$3"),
]
ENDING_QUOTES = [
    (r"([^' ])\s('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1$2 "),
    (r"([^' ])\s('[sS]|'[mM]|'[dD]|') ", "$1$2 "),
    (r"(\S)\s('')", "$1$2"),
    (r"('')\s([.,:)\]>};%])", "$1$2"),
    (r"''", '"'),
]
AFTER_STRIP = [
    (r" -- ", "--"),
    (r"([\[\(\{\<])\s", "$1"),
    (r"\s([\]\)\}\>])", "$1"),
    (r"([\]\)\}\>])\s([:;,.])", "$1$2"),
    (r"([^'])\s'\s", "$1' "),
    (r"\s([?!])", "$1"),
    (r"""([^\.])\s(\.)([\]\)}>"']*)\s*$""", "$1$2$3"),
    (r"([#$])\s", "$1"),
    (r"\s([;%])", "$1"),
    (r"\s\.\.\.\s", "..."),
    (r"\s([:,])", "$1"),
    (r"([ (\[{<])\s``", "$1``"),
    (r"(``)\s", "$1"),
    (r"(``)", '"'),
]
STRIPPED = " \t\n\r\f\x0b"


def split_words(text: Column) -> Column:
    """Blank-separated words."""
    return F.filter(F.split(text, BLANKS + "+"), lambda w: w != "")


# Every match of a rule holds one of these, as long as blanks are spaces; contractions are looked
# for all together, in lower case.
CONTRACTED = [" 't is", " 't was", "can not", "d 'ye", "gim me", "gon na", "got ta", "lem me", "more 'n", "wan na "]
QUOTED = [
    [f" {end} " for end in ("'ll", "'LL", "'re", "'RE", "'ve", "'VE", "n't", "N'T")],
    [f" {end} " for end in ("'s", "'S", "'m", "'M", "'d", "'D", "'")],
    [" ''"], ["'' "], ["''"],
]
SET_OFF = [
    [" -- "], ["[ ", "( ", "{ ", "< "], [" ]", " )", " }", " >"], ["] ", ") ", "} ", "> "], [" ' "], [" ?", " !"],
    [" ."], ["# ", "$ "], [" ;", " %"], [" ... "], [" :", " ,"], [" ``"], ["`` "], ["``"],
]


def _replaced(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, to in rules:
        text = F.regexp_replace(text, pattern, to)
    return text


def _where_any(text: Column, signs: list[str], body: Callable[[Column], Column], fold: Callable = lambda t: t) -> Column:
    """``body`` of a text that holds one of the signs; others stay as they are."""
    def tried(t: Column) -> Column:
        return F.when(bind(fold(t), lambda f: reduce(lambda a, b: a | b, [F.contains(f, F.lit(x)) for x in signs])), body(t)).otherwise(t)

    return bind(text, tried)


def detokenize(words: Column) -> Column:
    """Treebank word list to sentence text.

    Looking for a few signs is much cheaper than a regular expression, so a text goes through
    those rules only that may change it.  One with other blanks than spaces goes through all.
    """
    def all_rules(text: Column) -> Column:
        text = F.btrim(_replaced(text, CONTRACTIONS + ENDING_QUOTES), F.lit(STRIPPED))
        return _replaced(text, AFTER_STRIP)

    def each(text: Column, rules: list[tuple[str, str]], signs: list[list[str]]) -> Column:
        for rule, of in zip(rules, signs, strict=True):
            text = _where_any(text, of, lambda t, rule=rule: _replaced(t, [rule]))
        return text

    def some_rules(text: Column) -> Column:
        text = _where_any(text, CONTRACTED, lambda t: _replaced(t, CONTRACTIONS), F.lower)
        text = _where_any(text, ["'"], lambda t: each(t, ENDING_QUOTES, QUOTED))
        return each(F.btrim(text, F.lit(STRIPPED)), AFTER_STRIP, SET_OFF)

    odd = [b for b in STRIPPED if b != " "]
    text = bind(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), lambda t: F.when(
        reduce(lambda a, b: a | b, [F.contains(t, F.lit(x)) for x in odd]), all_rules(t)).otherwise(some_rules(t)))
    return F.btrim(text, F.lit(STRIPPED))


#: Characters after the cursor that are searched first, and the letters of a gram of the far index.
NEAR, GRAM = 256, 3


class TextSearch:
    """Finds words from a cursor on, at a cost that grows with the text and not with text times words.

    Most words lie near the cursor.  One that does not is looked up by its rarest gram, and one
    that is not there is not there from any later cursor either.
    """

    def __init__(self, text: str):
        self.text = text
        self.gone: set[str] = set()
        self.grams: dict[str, list[int]] | None = None

    def find(self, word: str, cursor: int) -> int:
        at = self.text.find(word, cursor, cursor + len(word) + NEAR)
        if at >= 0 or word in self.gone or cursor + len(word) + NEAR >= len(self.text):
            return at
        at = self._far(word, cursor)
        if at < 0:
            self.gone.add(word)
        return at

    def _far(self, word: str, cursor: int) -> int:
        if len(word) < GRAM:
            return self.text.find(word, cursor)
        if self.grams is None:
            self.grams = {}
            for i in range(len(self.text) - GRAM + 1):
                self.grams.setdefault(self.text[i : i + GRAM], []).append(i)
        places = [(self.grams.get(word[o : o + GRAM], ()), o) for o in range(len(word) - GRAM + 1)]
        rarest, offset = min(places, key=lambda x: len(x[0]))
        for i in range(bisect_left(rarest, cursor + offset), len(rarest)):
            if self.text.startswith(word, rarest[i] - offset):
                return rarest[i] - offset
        return -1


def align_row(words: list[str | None], text: str) -> list[int]:
    """Start and end of each word, one after another."""
    search, cursor, out = TextSearch(text), 0, []
    for word in words:
        at = -1
        if word:
            at = text.find(word, cursor, cursor + len(word) + NEAR)
            if at < 0:
                at = search.find(word, cursor)
                if at < 0 and " " in word:
                    bare = word.replace(" ", "")
                    at = search.find(bare, cursor) if bare else (cursor if cursor <= len(text) else -1)
        elif word == "":
            at = cursor if cursor <= len(text) else -1
        if at < 0:
            out += (-1, -1)
        else:
            cursor = at + len(word)
            out += (at, cursor)
    return out


#: Bytes of text whose words are Python objects at one time, at most about.
SLICE_BYTES = 1 << 20


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, rows) of stretches of a batch: about a million bytes of text each, or one row."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    at = 0
    while at < len(texts):
        end = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE_BYTES, "right")), at + 1)
        yield at, end - at
        at = end


def _words(lists: pa.Array) -> Iterator[list[str | None] | None]:
    every = lists.flatten().to_numpy(zero_copy_only=False).tolist()
    at = 0
    for size in pc.list_value_length(lists).to_pylist():
        yield None if size is None else every[at : at + size]
        at += size or 0


def span_lists(flat: list[np.ndarray], sizes: list[int], gone: list[bool]) -> pa.Array:
    """Lists of spans from rows of (start, end)."""
    pairs = np.concatenate([np.zeros((0, 2), np.int32), *flat])
    spans = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)], ["start", "end"])
    bounds = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), spans, mask=pa.array(gone, pa.bool_()))


def aligned_spans(lists: pa.Array, texts: pa.Array) -> pa.Array:
    """Spans of the words of each row; null words or text give null.

    Words become Python objects a stretch of rows at a time, so a large batch costs no more.
    """
    parts, sizes, gone = [], [], []
    for at, n in slices(texts):
        flat: list[int] = []
        for words, text in zip(_words(lists.slice(at, n)), texts.slice(at, n).to_pylist()):
            gone.append(words is None or text is None)
            sizes.append(0 if gone[-1] else len(words))
            if not gone[-1]:
                flat += align_row(words, text)
        parts.append(np.array(flat, np.int32).reshape(-1, 2))
    return span_lists(parts, sizes, gone)


def _stretches(lists: pa.Array, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bounds = lists.offsets.to_numpy().astype(np.int64)
    return bounds[:-1], np.where(gone, 0, np.diff(bounds))


def _rows_and_places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(sizes)
    return np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(ends - sizes, sizes)


def moved_values(values: pa.MapArray, old: pa.Array, new: pa.Array, skip_empty: bool = False) -> pa.MapArray:
    """``remap_spans`` of a batch whose old spans are those of ``aligned_spans``.

    Words follow one another, so the last one that starts no later than a new span ends last
    too: it holds the new span, or none does.  Words not found hold nothing, for new spans do not
    end before 0.
    """
    gone = np.logical_or.reduce([c.is_null().to_numpy(zero_copy_only=False) for c in (values, old, new)])
    (first, marks), (old_first, words), (new_first, tokens) = (_stretches(c, gone) for c in (values, old, new))
    starts, ends = ([spans.values.field(i).to_numpy().astype(np.int64) for spans in (old, new)] for i in (0, 1))
    row, nth = _rows_and_places(marks)
    entry = first[row] + nth
    pos = values.keys.to_numpy(zero_copy_only=False)[entry]
    found = np.flatnonzero((pos >= 0) & (pos < words[row]))
    at = old_first[row[found]] + pos[found]
    found, at = found[ends[0][at] >= 0], at[ends[0][at] >= 0]
    order = np.lexsort((pos[found], row[found]))
    found, at = found[order], at[order]
    row, entry = row[found], entry[found]
    new_row, place = _rows_and_places(tokens)
    there = new_first[new_row] + place
    last = np.searchsorted((row << 32) + starts[0][at], (new_row << 32) + starts[1][there], "right") - 1
    # A first row of no words stands for none.
    inside = (last >= 0) & (np.append(row, -1)[last] == new_row) & (np.append(ends[0][at], -1)[last] >= ends[1][there])
    if skip_empty:
        inside &= ends[1][there] > starts[1][there]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(new_row[inside], minlength=len(values)))]).astype(np.int32)
    return pa.MapArray.from_arrays(
        pa.array(bounds), pa.array(place[inside].astype(np.int32)), values.items.take(pa.array(entry[last[inside]])), mask=pa.array(gone))


def align_words(words: Column, text: Column) -> Column:
    """Character span of each word, searched left to right from the end of the last find.

    A word that does not occur from there on is tried without its blanks (keeping its own
    length); one that still does not occur gets (-1, -1) and leaves the cursor alone.  Words
    and text travel in Arrow batches; null words or text give null.
    """
    @F.arrow_udf("array<struct<start:int,end:int>>")
    def aligned(lists: pa.Array, texts: pa.Array) -> pa.Array:
        return aligned_spans(lists, texts)

    return aligned(words, text)


def remap_spans(
    values: Column, old_spans: Column, new_spans: Column,
    skip_empty: bool = False, first_only: bool = False,
) -> Column:
    """Moves the value of an old span to each new span inside it.

    ``values`` maps old positions to values; the result maps new positions.  Where
    several old spans with a value contain a new one, the last counts.  Zero-width new
    spans take part unless ``skip_empty``; ``first_only`` looks at the first new span only.

    Old spans with a value are laid out by cells of text, and a new span is tested against
    those of the cell it starts in, so long rows do not pay old times new.
    """
    def laid(row: Column) -> Column:
        def old_at(e: Column) -> Column:
            at = F.get(row["old"], e["key"])
            return F.struct(
                e["key"].alias("pos"), at["start"].alias("start"), at["end"].alias("end"),
                e["value"].alias("value"))

        marked = F.filter(
            F.transform(F.map_entries(row["values"]), old_at), lambda m: m["start"].isNotNull())
        table = by_cell(marked, lambda m: cell(m["start"]), lambda m: cell(m["end"]))

        def assign(near: Column) -> Column:
            def hit(s: Column, i: Column) -> Column:
                inside = F.filter(
                    F.get(near, cell(s["start"])),
                    lambda m: (s["start"] >= m["start"]) & (s["end"] <= m["end"]))
                if skip_empty:
                    inside = F.when(s["end"] > s["start"], inside)
                return F.struct(i.alias("key"), F.try_element_at(inside, F.lit(-1)).alias("m"))

            hits = F.filter(F.transform(row["new"], hit), lambda h: h["m"].isNotNull())
            return F.map_from_entries(
                F.transform(hits, lambda h: F.struct(h["key"], h["m"]["value"].alias("value"))))

        return bind(table, assign)

    new = F.slice(new_spans, 1, 1) if first_only else new_spans
    return bind(
        F.struct(values.alias("values"), old_spans.alias("old"), new.alias("new")),
        lambda row: F.when(
            row["values"].isNotNull() & row["old"].isNotNull() & row["new"].isNotNull(), laid(row)))
