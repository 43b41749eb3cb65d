"""Sub-word tokenising with a given vocabulary, and a vocabulary from the corpus.

The published WordPiece rule: clean, lower-case, optionally strip accents, cut at blanks
and punctuation, then take the longest known piece from the left of each word.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from votespan.functions.arrays import span
from votespan.functions.text import aligned_spans, moved_values, slices

# Executors need no copy of this package: the functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The special tokens of the public uncased vocabularies.
SPECIALS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"]
#: Longer words are matched along a trie, shorter ones by looking up their pieces.
SHORT = 64
MEMO_SIZE = 200_000
WORD_PATTERN = r"([\p{L}\p{N}]+|[^\p{L}\p{N} \t\n\r])"


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): lower-cased runs of letters and digits, and single other signs."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD_PATTERN), F.lit(1))
    return df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def build_vocab(df: DataFrame, text: str = "text", size: int = 30_000) -> DataFrame:
    """(token, id): specials, every character as a start and as a continuation, then the
    ``size`` most frequent words; the more frequent of a kind first."""
    counts = word_counts(df, text)
    # Characters are counted too: both branches then read one and the same word count.
    chars = (counts.select(F.explode(F.split("word", "")).alias("c"), "n").filter(F.col("c") != "")
             .groupBy("c").agg(F.sum("n").alias("n"))
             .select(F.explode(F.array(F.col("c"), F.concat(F.lit("##"), F.col("c")))).alias("token"),
                     F.lit(1).alias("part"), "n"))
    # Tied to the count, the test of the word stays above the grouping the branches share.
    longer = F.when(F.length("word") > 1, F.col("n")) > 0
    words = (counts.filter(longer).orderBy(F.desc("n"), "word").limit(size)
             .select(F.col("word").alias("token"), F.lit(2).alias("part"), "n"))
    specials = df.sparkSession.createDataFrame(
        [(t, 0, -i) for i, t in enumerate(SPECIALS)], "token string, part int, n bigint")
    every = specials.unionByName(chars).unionByName(words)
    # At most specials + characters + size rows.
    order = Window.orderBy("part", F.desc("n"), "token")
    return every.select("token", (F.row_number().over(order) - 1).alias("id"))


def vocab_dict(vocab: DataFrame, limit: int = 1_000_000) -> dict[str, int]:
    """The vocabulary on the driver; one of more than ``limit`` tokens is refused."""
    rows = vocab.select("token", "id").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} tokens are not a vocabulary")
    return {r["token"]: r["id"] for r in rows}


def _dropped(ch: str) -> bool:
    """Control signs and the two placeholders vanish from the text."""
    return ch in "\x00�" or (ch not in "\t\n\r" and unicodedata.category(ch)[0] == "C")


def _is_cjk(ch: str) -> bool:
    # The blocks of CJK ideographs.
    c = ord(ch)
    return (0x4E00 <= c <= 0x9FFF or 0x3400 <= c <= 0x4DBF or 0x20000 <= c <= 0x2A6DF
            or 0x2A700 <= c <= 0x2B73F or 0x2B740 <= c <= 0x2B81F or 0x2B920 <= c <= 0x2CEAF
            or 0xF900 <= c <= 0xFAFF or 0x2F800 <= c <= 0x2FA1F)


def _is_sign(ch: str) -> bool:
    return (ch.isascii() and not ch.isalnum() and ch.isprintable() and ch != " ") \
        or unicodedata.category(ch)[0] == "P"


BLANK_FREE = re.compile("[^ \t\n\r   -     　]+")


class LongestMatch:
    """The longest known piece at each place of a word, in time that grows with the word alone.

    A trie over the vocabulary with failure links, after "Fast WordPiece Tokenization" (Song et
    al., 2021).  Where no letter leads on from a node, the pieces the letters so far are known
    to begin with are given out, and the link leads to the node of what is left of them.
    """

    START, INNER = 0, 1  # the node in front of a word, and the node between two pieces

    def __init__(self, vocab: dict[str, int]):
        self.next: dict[tuple[int, str], int] = {}
        self.children: list[list[tuple[str, int]]] = [[], []]
        ends: dict[int, tuple[int, int]] = {}
        for token, number in vocab.items():
            node, letters = (self.INNER, token[2:]) if token.startswith("##") else (self.START, token)
            for c in letters:
                onward = self.next.get((node, c))
                if onward is None:
                    onward = self.next[node, c] = len(self.children)
                    self.children[node].append((c, onward))
                    self.children.append([])
                node = onward
            if letters:
                ends[node] = (number, len(letters))
        self.link: list[int | None] = [None] * len(self.children)
        self.given: list[tuple[tuple[int, int], ...]] = [()] * len(self.children)
        # Nodes by their distance from the two roots: links lead to nearer ones.
        level = [self.START, self.INNER]
        while level:
            below = []
            for node in level:
                for c, child in self.children[node]:
                    below.append(child)
                    if child in ends:
                        self.link[child], self.given[child] = self.INNER, (ends[child],)
                        continue
                    at, found = self.link[node], self.given[node]
                    while at is not None and (at, c) not in self.next:
                        found, at = found + self.given[at], self.link[at]
                    if at is not None:
                        self.link[child], self.given[child] = self.next[at, c], found
            level = below

    def pieces(self, letters: str) -> list[tuple[int, int]] | None:
        """(id, letters) of each piece, None where some place has none."""
        out, node = [], self.START
        for c in letters:
            onward = self.next.get((node, c))
            while onward is None:
                if self.link[node] is None:
                    return None
                out += self.given[node]
                node = self.link[node]
                onward = self.next.get((node, c))
            node = onward
        while node != self.INNER:
            if self.link[node] is None:
                return None
            out += self.given[node]
            node = self.link[node]
        return out


class Vocabulary(dict):
    """Tokens and their ids; the trie is built when the first long word comes."""

    _trie: LongestMatch | None = None
    _reach: tuple[int, int] | None = None

    @property
    def reach(self) -> tuple[int, int]:
        """Letters of the longest token and of the longest one inside words."""
        if self._reach is None:
            self._reach = max(map(len, self), default=0), max((len(t) - 2 for t in self if t.startswith("##")), default=0)
        return self._reach

    @property
    def trie(self) -> LongestMatch:
        if self._trie is None:
            self._trie = LongestMatch(self)
        return self._trie


# Signs and letters, without accents and with those of Latin-1 and Latin Extended-A, that stay one
# letter of their kind in lower case.
ASCII, LATIN = re.compile("[!-~]+"), re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
RUNS = re.compile("[0-9A-Za-z\u00c0-\u017f]+|[!-~]")


def pieces_of(chunk: str, vocab: dict[str, int], strip_accents: bool, longest_word: int | None = None) -> list[tuple[int, int, int]]:
    """(id, start, end) of a blank-free stretch of text, ends counted in its characters."""
    vocab = vocab if isinstance(vocab, Vocabulary) else Vocabulary(vocab)
    out = []
    if (ASCII if strip_accents else LATIN).fullmatch(chunk):
        for run in RUNS.finditer(chunk.lower()):
            at = run.start()
            found = _longest_pieces(run[0], vocab, longest_word)
            if found is None:
                out.append((vocab["[UNK]"], at, run.end()))
            else:
                for piece, size in found:
                    out.append((piece, at, at + size))
                    at += size
        return out
    words: list[list[tuple[str, int]]] = [[]]
    for at, ch in enumerate(chunk):
        if _dropped(ch):
            continue
        alone = _is_cjk(ch)
        plain = unicodedata.normalize("NFD", ch) if strip_accents else ch
        for c in plain:
            if strip_accents and unicodedata.category(c) == "Mn":
                continue
            for low in c.lower():
                if alone or _is_sign(low):
                    words += [[(low, at)], []]
                else:
                    words[-1].append((low, at))
    for word in words:
        if word:
            found, start = _longest_pieces("".join(c for c, _ in word), vocab, longest_word), 0
            if found is None:
                out.append((vocab["[UNK]"], word[0][1], word[-1][1] + 1))
            else:
                for piece, size in found:
                    out.append((piece, word[start][1], word[start + size - 1][1] + 1))
                    start += size
    return out


def _longest_pieces(letters: str, vocab: Vocabulary, longest_word: int | None) -> list[tuple[int, int]] | None:
    """(id, letters) of each piece of a word, None where some place has none."""
    if longest_word is not None and len(letters) > longest_word:
        return None
    if len(letters) > SHORT:
        return vocab.trie.pieces(letters)
    found, start, before = [], 0, ""
    longest, inner = vocab.reach
    while start < len(letters):
        for end in range(min(len(letters), start + longest), start, -1):
            piece = vocab.get(before + letters[start:end])
            if piece is not None:
                found.append((piece, end - start))
                start, before, longest = end, "##", inner
                break
        else:
            return None
    return found


class PiecePool:
    """Pieces of the stretches met so far, end to end in growing arrays.

    A stretch is cut once; later on its number is enough.  Numbers 0 and 1 are the start
    and the end sign.
    """

    def __init__(self, vocab: dict[str, int], strip_accents: bool, longest_word: int | None):
        self.vocab, self.strip_accents, self.longest_word = Vocabulary(vocab), strip_accents, longest_word
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.count = [1, 1]  # pieces per stretch
        self.fresh = [(self.vocab["[CLS]"], 0, 0), (self.vocab["[SEP]"], 0, 0)]
        self.pieces = np.zeros((0, 3), np.int32)  # id, start, end
        self.sizes = self.first = np.zeros(0, np.int64)

    def add(self, chunk: str) -> int:
        found = pieces_of(chunk, self.vocab, self.strip_accents, self.longest_word)
        n = self.number[chunk] = len(self.count)
        self.count.append(len(found))
        self.fresh += found
        return n

    def lay_out(self, numbers: list[int], bases: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of the stretches one after another, moved to their bases, and the
        position after each stretch."""
        if self.fresh:
            self.pieces = np.concatenate([self.pieces, np.array(self.fresh, np.int32).reshape(-1, 3)])
            self.fresh = []
        if len(self.sizes) < len(self.count):
            self.sizes = np.concatenate([self.sizes, self.count[len(self.sizes):]])
            self.first = np.cumsum(self.sizes) - self.sizes
        at = np.array(numbers, np.int64)
        counts = self.sizes[at]
        ends = np.cumsum(counts)
        rows = np.repeat(self.first[at] - (ends - counts), counts) + np.arange(counts.sum())
        pieces = self.pieces[rows]
        pieces[:, 1:] += np.repeat(np.array(bases, np.int32), counts)[:, None]
        return pieces, ends


def _lists(values: pa.Array, bounds: np.ndarray, nulls: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values, mask=pa.array(nulls))


def _cut(texts: list[str | None], pool: PiecePool, max_length: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of the texts one after another, and how many each has."""
    if len(pool.number) >= MEMO_SIZE:
        pool.reset()
    room = None if max_length is None else max(max_length - 2, 0)
    numbers: list[int] = []
    bases: list[int] = []
    stretches = [0]
    known, count = pool.number, pool.count
    for text in texts:
        if text is not None:
            numbers.append(0)
            bases.append(0)
            used = 0
            for found in BLANK_FREE.finditer(text):
                chunk = found[0]
                n = known.get(chunk)
                if n is None:
                    n = pool.add(chunk)
                numbers.append(n)
                bases.append(found.start())
                if room is not None:
                    used += count[n]
                    if used >= room:
                        break
            numbers.append(1)
            bases.append(0)
        stretches.append(len(numbers))
    pieces, ends = pool.lay_out(numbers, bases)
    sizes = np.diff(np.concatenate([[0], ends])[stretches])
    if max_length is not None:
        starts = np.cumsum(sizes) - sizes
        place = np.arange(len(pieces)) - np.repeat(starts, sizes)
        last = np.repeat(sizes, sizes) - 1
        pieces = pieces[(place < max_length - 1) | (place == last)]
        sizes = np.minimum(sizes, max_length)
    return pieces, sizes


def cut_texts(texts: pa.Array, pool: PiecePool, max_length: int | None = None) -> tuple[pa.Array, pa.Array]:
    """(ids, spans of characters) of each text, specials included; null text gives nulls.

    Texts are cut a stretch of rows at a time, so a large batch takes little more than its result.
    """
    parts = [_cut(texts.slice(at, n).to_pylist(), pool, max_length) for at, n in slices(texts)]
    pieces = np.concatenate([np.zeros((0, 3), np.int32), *(p for p, _ in parts)])
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)]))])
    gone = texts.is_null().to_numpy(zero_copy_only=False)
    spans = pa.StructArray.from_arrays(
        [pa.array(np.ascontiguousarray(pieces[:, i])) for i in (1, 2)], ["start", "end"])
    return _lists(pa.array(np.ascontiguousarray(pieces[:, 0])), bounds, gone), _lists(spans, bounds, gone)


def wordpiece_udf(
    vocab: dict[str, int], max_length: int | None = None, strip_accents: bool = True, broadcast: Callable = lambda v: v,
    longest_word: int | None = None,
):
    """Arrow UDF text -> struct<tokens, offsets>; the vocabulary travels as a broadcast.

    A frequent stretch of text costs a lookup; its pieces are put together per batch.
    """
    shared = broadcast(vocab)

    @F.arrow_udf("tokens array<int>, offsets array<struct<start:int,end:int>>")
    def tokenize_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pool = PiecePool(shared.value if hasattr(shared, "value") else shared, strip_accents, longest_word)
        for texts in batches:
            yield pa.StructArray.from_arrays(list(cut_texts(texts, pool, max_length)), ["tokens", "offsets"])

    return tokenize_text


def map_batches(df: DataFrame, udf: Callable[..., Column], keys: Sequence[str], args: Sequence[str]) -> DataFrame:
    """Runs a struct UDF in Arrow batches next to the keys and flattens its members.

    The batch size is the session's ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """
    return df.select(*keys, udf(*[F.col(a) for a in args]).alias("_r")).select(*keys, "_r.*")


def valid_runs(tokens: Column, tail_plus_one: bool = False) -> Column:
    """Runs of valid tokens: nothing is padded yet, so one run over all of them."""
    end = F.size(tokens) + (1 if tail_plus_one else 0)
    return F.when(tokens.isNotNull(), F.array(span(F.lit(0), end)))


def tokenize(
    df: DataFrame, text: str, vocab: DataFrame | dict[str, int], max_length: int | None = None,
    strip_accents: bool = True, tail_plus_one: bool = False, keep: Sequence[str] | None = None,
    longest_word: int | None = None, vocab_limit: int = 1_000_000,
) -> DataFrame:
    """Adds ``tokens``, ``mask`` (valid runs) and ``offsets`` (character spans).

    Null text gives nulls.  ``max_length`` cuts a row, specials included; words of more than
    ``longest_word`` characters are unknown (the published rule sets 100); a vocabulary table
    of more than ``vocab_limit`` rows is refused, for it is sent to every task.
    """
    words = vocab if isinstance(vocab, dict) else vocab_dict(vocab, vocab_limit)
    share = df.sparkSession.sparkContext.broadcast
    keys = [c for c in (keep or df.columns)]
    out = map_batches(df, wordpiece_udf(words, max_length, strip_accents, share, longest_word), keys, [text])
    return out.select(*keys, "tokens", valid_runs(F.col("tokens"), tail_plus_one).alias("mask"), "offsets")


def tokenize_aligned(
    df: DataFrame, words: str, text: str, vocab: DataFrame | dict[str, int], max_length: int | None = None,
    strip_accents: bool = True, tail_plus_one: bool = False, longest_word: int | None = None, vocab_limit: int = 1_000_000,
    values: str | None = None, skip_empty: bool = False,
) -> DataFrame:
    """Puts ``tokens``, ``mask``, ``offsets`` and ``word_spans`` (where each word stands in the
    text) in place of ``words`` and ``text``.

    Where ``values`` names a map of words' positions to their values, the values are moved to the
    tokens inside the words, as ``remap_spans`` does, and both kinds of spans are left out.

    Words and text go to Python once for all of it.  Unlike columns of UDFs, the step is a node
    of its own in the plan: a filter on its results cannot make Spark run it a second time.  A
    batch is worked through, and given back, a stretch of rows at a time.
    """
    table = vocab if isinstance(vocab, dict) else vocab_dict(vocab, vocab_limit)
    shared = df.sparkSession.sparkContext.broadcast(table)
    keys = [c for c in df.columns if c not in (words, text, values)]
    spans = "array<struct<start:int,end:int>>"

    def kept(names: Sequence[str]) -> list[str]:
        return [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema]

    made = [f"offsets {spans}", f"word_spans {spans}"] if values is None else kept([values])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = PiecePool(shared.value, strip_accents, longest_word)
        for batch in batches:
            for at, n in slices(batch.column(text)):
                of = dict(zip(batch.schema.names, batch.slice(at, n).columns))
                ids, offsets = cut_texts(of[text], pool, max_length)
                found = aligned_spans(of[words], of[text])
                last = {"offsets": offsets, "word_spans": found} if values is None else {
                    values: moved_values(of[values], found, offsets, skip_empty)}
                yield pa.RecordBatch.from_arrays(
                    [*(of[k] for k in keys), ids, *last.values()], names=[*keys, "tokens", *last])

    out = df.mapInArrow(run, ", ".join([*kept(keys), "tokens array<int>", *made]))
    return out.select(
        *keys, "tokens", valid_runs(F.col("tokens"), tail_plus_one).alias("mask"),
        *(["offsets", "word_spans"] if values is None else [values]))
