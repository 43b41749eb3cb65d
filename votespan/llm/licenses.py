"""Licence scan: Dice coefficient over word bigrams against notices.

Every line, every paragraph (lines up to one without words) and the whole of each text is a
passage, and so is every window: a stretch of words anywhere in the text, across lines and
paragraphs, that reaches the threshold.  Normalised, a passage is its words: ASCII letters in lower case, digits and whatever
is not ASCII; all else parts words.  Dice = 2 |A and B| / (|A| + |B|) over sets of word bigrams.

A notice of b bigrams can reach the threshold t only with passages of t/(2-t) b to (2-t)/t b
bigrams that share at least t/(2-t) b of them with it; these bounds leave few passages and,
for each, few notices to compare.

Windows are searched in every text that holds t/(2-t) b bigrams of a notice.  A window has at
most (2/t-2) b bigrams that are not the notice's, so stretches with more of them part the text;
in what is left each bigram of the notice begins a window, and all its ends are compared.  The
best windows of a notice that share no word are taken, then those between them.  Of windows of
several notices those with the best Dice stay; a window is left out if half of its matching
bigrams belong to a better one, or if it lies in a passage that is reported under the same name.

Cases: null and empty texts have no passages, nor have passages of fewer than two words;
of notices that fit a passage equally well the smallest name and then the first one
is named; rows that repeat an id are scanned each by itself; other columns are not read.
"""

from __future__ import annotations

from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from votespan.llm.common import keyed, mix, slices, text_bytes, text_of_rows, word_hashes

SLICE = 2 << 20
KINDS = ("line", "paragraph", "text")


def _letters() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    inner = np.zeros(256, bool)
    inner[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    return lower, inner


def bigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each word starts, hash of it and the next word; the last one's means nothing)."""
    lower, inner = _letters()
    ink = inner[data]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    first[edges] = ink[edges]
    last[edges - 1] = ink[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    words = word_hashes(lower[data], starts, ends)
    return starts, mix(words ^ (mix(np.roll(words, -1), 41)), 42)


def _bigrams_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return np.unique(bigrams(data, np.array([0, len(data)]))[1][:-1])


def passages(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(text of each word; number of its line, paragraph and text; first line of each line's text)."""
    doc = text_of_rows(offsets, starts) if len(starts) else np.zeros(0, np.int64)
    newline = data == 10
    # A line ends at a newline or with its text; lines are numbered through the slice.
    line_of_byte = np.concatenate([[0], np.cumsum(newline)])
    line = line_of_byte[starts] + doc
    n_lines = int(line_of_byte[-1]) + len(offsets) - 1
    full = np.zeros(n_lines, bool)
    full[line] = True
    first_line = line_of_byte[offsets[:-1]] + np.arange(len(offsets) - 1)
    part = ~full
    part[first_line] = True
    return doc, [line, np.cumsum(part)[line], doc], first_line


def _ends(pairs: np.ndarray, hit: np.ndarray, size: int, threshold: float) -> list[tuple[float, int, int]]:
    """(Dice, first bigram, last bigram): the best window from every bigram of the notice on, if it reaches the threshold.

    ``new`` holds where each distinct bigram from the start on occurs first; there are never more
    of them than a window can have, however often they repeat.
    """
    ratio = threshold / (2 - threshold)
    least, most = ratio * size - 1e-9, int(size / ratio + 1e-9)
    n = len(pairs)
    order = np.argsort(pairs, kind="stable")
    same = pairs[order[1:]] == pairs[order[:-1]]
    after, before = np.full(n, n), np.full(n, -1)
    after[order[:-1][same]] = order[1:][same]
    before[order[1:][same]] = order[:-1][same]
    after, before, flags = after.tolist(), before.tolist(), hit.tolist()
    found, new, common, end = [], [], 0, 0
    for i in range(n):
        while end < n and (before[end] >= i or len(new) < most):
            if before[end] < i:
                new.append(end)
                common += flags[end]
            end += 1
        if flags[i] and common >= least:
            at = np.array(new)
            dice = 2 * np.cumsum(hit[at]) / (np.arange(1, len(at) + 1) + size)
            best = int(np.argmax(dice))
            if dice[best] >= threshold:
                found.append((float(dice[best]), i, new[best]))
        del new[0]
        if after[i] < end:
            insort(new, after[i])
        else:
            common -= flags[i]
    return found


def _stretches(pairs: np.ndarray, hit: np.ndarray, size: int, threshold: float) -> list[tuple[int, int]]:
    """(begin, end) of the stretches between which no window of the notice can reach."""
    spare = int(size * (2 / threshold - 2) + 1e-9)
    at = np.flatnonzero(hit)
    cuts = []
    for g in np.flatnonzero(np.diff(at) - 1 > spare).tolist():
        gap = pairs[at[g] + 1 : at[g + 1]]
        if len(np.unique(gap[: 4 * spare + 8])) > spare or len(np.unique(gap)) > spare:
            cuts.append(g + 1)
    least = threshold / (2 - threshold) * size - 1e-9
    ranges = [(int(at[a]), int(at[b - 1]) + 1) for a, b in zip([0, *cuts], [*cuts, len(at)]) if b - a >= least]
    return [(a, b) for a, b in ranges if len(np.unique(pairs[a:b][hit[a:b]])) >= least]


def windows(pairs: np.ndarray, hit: np.ndarray, size: int, threshold: float) -> list[tuple[float, int, int]]:
    """(Dice, first bigram, last bigram) of the best windows of a text that share no word.

    ``hit``: which bigrams of the text are among the ``size`` ones of the notice.
    """
    out, todo = [], [(0, len(pairs))]
    while todo:
        low, high = todo.pop()
        for a, b in _stretches(pairs[low:high], hit[low:high], size, threshold) if hit[low:high].any() else []:
            a, b = a + low, b + low
            taken, kept = np.zeros(b - a + 2, bool), []
            for dice, i, j in sorted(_ends(pairs[a:b], hit[a:b], size, threshold), key=lambda x: (-x[0], x[2] - x[1], x[1])):
                if not taken[i : j + 1].any():
                    # The bigrams next to a window share a word with it.
                    taken[max(i - 1, 0) : j + 2] = True
                    kept.append((dice, a + i, a + j))
            if kept:
                out += kept
                spans = sorted((i, j) for _, i, j in kept)
                todo += [(x, y) for x, y in zip([a, *(j + 2 for _, j in spans)], [*(i - 1 for i, _ in spans), b]) if x < y]
    return out


def _scan(names: list[str], sets: list[np.ndarray], threshold: float):
    ratio = threshold / (2 - threshold)
    sizes = np.array([len(x) for x in sets])
    known = np.unique(np.concatenate(sets))
    member = np.array([np.isin(known, x) for x in sets])
    least, most = ratio * sizes.min(), sizes.max() / ratio

    def in_windows(pairs, which, doc, reported):
        """(text, "window", first word, name, Dice); ``which``: number of each known bigram or -1."""
        at = np.flatnonzero(which >= 0)
        if not len(at):
            return
        docs, kinds = np.divmod(np.unique(doc[at] * len(known) + which[at]), len(known))
        tried: dict[int, list[int]] = {}
        for n, size in enumerate(sizes.tolist()):
            for d in np.flatnonzero(np.bincount(docs[member[n][kinds]]) >= ratio * size - 1e-9).tolist():
                tried.setdefault(d, []).append(n)
        for d, notices in tried.items():
            begin, end = np.searchsorted(doc, [d, d + 1]).tolist()
            own, kind = pairs[begin : end - 1], which[begin : end - 1]
            hits = {n: (kind >= 0) & member[n][kind] for n in notices}
            ranked = sorted(
                (-dice, -int(hits[n][i : j + 1].sum()), j - i, i, n, j)
                for n in notices for dice, i, j in windows(own, hits[n], int(sizes[n]), threshold))
            claimed, kept = np.zeros(len(own), bool), []
            for dice, _, _, i, n, j in ranked:
                match = np.flatnonzero(hits[n][i : j + 1]) + i
                if 2 * claimed[match].sum() < len(match):
                    claimed[match] = True
                    kept.append((begin + i, begin + j + 2, names[n], -dice))
            reach: dict[str, int] = {}
            spans = [(a, -b, name, 0) for a, b, name in reported.get(d, [])] + [(a, -b, name, dice) for a, b, name, dice in kept]
            for a, b, name, dice in sorted(spans):
                inside = reach.get(name, 0) >= -b
                reach[name] = max(reach.get(name, 0), -b)
                if dice and not inside:
                    yield d, "window", a, name, dice

    def run(batches):
        for batch in slices(batches, "text", SLICE):
            data, offsets = text_bytes(batch.column(2))
            starts, pairs = bigrams(data, offsets)
            doc, units, first_line = passages(data, offsets, starts)
            which = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
            which[known[which] != pairs] = -1
            hit = which >= 0
            found, reported = [], {}
            for kind, unit in zip(KINDS, units):
                inner = np.zeros(len(unit), bool)
                inner[:-1] = unit[1:] == unit[:-1]
                near, counts = np.unique(unit[hit & inner], return_counts=True)
                near = near[counts >= least]
                begin, end = np.searchsorted(unit, near), np.searchsorted(unit, near, "right")
                for a, b in zip(begin.tolist(), end.tolist()):
                    own = np.unique(pairs[a : b - 1])
                    if len(own) > most:
                        continue
                    best = None
                    for i in np.flatnonzero((sizes >= ratio * len(own)) & (ratio * sizes <= len(own))).tolist():
                        common = len(np.intersect1d(own, sets[i], assume_unique=True))
                        dice = 2 * common / (len(own) + len(sets[i]))
                        if dice >= threshold and (best is None or dice > best[0]):
                            best = dice, i
                    if best:
                        d = int(doc[a])
                        found.append((d, kind, int(units[0][a] - first_line[d]), names[best[1]], best[0]))
                        reported.setdefault(d, []).append((a, b, names[best[1]]))
            which[:-1][doc[1:] != doc[:-1]] = -1
            which[-1:] = -1
            for d, kind, a, name, dice in in_windows(pairs, which, doc, reported):
                found.append((d, kind, int(units[0][a] - first_line[d]), name, dice))
            if found:
                rows, kind, at, name, dice = zip(*found)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(kind), pa.array(at, pa.int64()),
                     pa.array(name), pa.array(dice)], names=["k1", "k2", "passage", "line", "license", "dice"])

    return run


def license_matches(
    docs: DataFrame, notices: list[tuple[str, str]], threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(k1, k2, passage, line, license, dice): the best notice of every passage that reaches the threshold.

    ``line``: number, from 0, of the passage's first line with words.
    """
    ordered = sorted(notices)
    names, sets = [n for n, _ in ordered], [_bigrams_of(t) for _, t in ordered]
    if not sets or min(map(len, sets)) == 0:
        raise ValueError("notices of two words at least are needed")
    return keyed(docs, id_col, text_col).mapInArrow(
        _scan(names, sets, threshold), "k1 long, k2 long, passage string, line long, license string, dice double")
