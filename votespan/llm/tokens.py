"""Token ids of whole texts by the tokenizers library, at the cost of each distinct word once.

A text is cut before blanks that follow something else, and between a letter and a mark.
Byte-level pre-tokens always end there, so the pieces can be encoded by themselves; a worker
keeps what it has encoded in two generations of bounded size.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa

from votespan.llm.common import BLANK, text_bytes, worker_cache

#: A space with something on both sides.
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Words encoded in one call; words in a generation of the cache, and bytes or ids in it.
JOINED, KEPT, KEPT_SIZE = 300, 400_000, 16 << 20
#: How byte-level vocabularies write a space and a line feed.
BLANKS = ("Ġ", "Ċ")
LETTER, MARK = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
#: No bytes of a blank in any version of Unicode, but for those of longer characters.
INK = np.arange(256) > 0x20
INK[0x7F] = False


def _inked(data: np.ndarray) -> np.ndarray:
    """Bytes of characters that are surely no blanks and no format characters."""
    ink = INK[data]
    for lead in (0xC2, 0xE1, 0xE2, 0xE3, 0xEF):
        at = np.flatnonzero(data == lead)
        if not len(at):
            continue
        second = data[at + 1]
        if lead == 0xC2:
            at = at[(second == 0x85) | (second == 0xA0)]
            ink[at] = ink[at + 1] = False
            continue
        third = data[at + 2]
        if lead == 0xE1:
            odd = (second == 0x9A) | (second == 0xA0)
        elif lead == 0xE2:
            odd = (second == 0x81) | (second == 0x80) & ((third <= 0x8F) | (third >= 0xA8) & (third <= 0xAF))
        elif lead == 0xE3:
            odd = (second == 0x80) & (third == 0x80)
        else:
            odd = (second == 0xBB) & (third == 0xBF)
        at = at[odd]
        ink[at] = ink[at + 1] = ink[at + 2] = False
    return ink


class _Known:
    """Words by number, and their ids on end."""

    def __init__(self, width: str):
        self.number: dict[str, int] = {}
        self.start, self.flat, self.size = np.zeros(1, np.int64), np.zeros(0, width), 0

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.number)
        self.number.update(zip(words, range(n, n + len(words))))
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, ids])
        self.size += sum(map(len, words))

    def find(self, words: list[str]) -> np.ndarray:
        """Their numbers, -1 for those that are not known."""
        return np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of these words on end, how many each has)."""
        start = self.start[numbers]
        sizes = self.start[numbers + 1] - start
        ends = np.cumsum(sizes)
        # Steps of one inside a word, and a jump to where the next one's ids lie.
        return self.flat[np.repeat(start - ends + sizes, sizes) + np.arange(sizes.sum())], sizes

    def full(self) -> bool:
        return len(self.number) > KEPT or max(self.size, len(self.flat)) > KEPT_SIZE


class PieceEncoder:
    """Texts to little-endian ids: two bytes each if the vocabulary allows, else four."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary)
        self.width = id_width(self.library.get_vocab_size())
        self.known, self.older = _Known(self.width), None
        self.begins = np.zeros(self.library.get_vocab_size(), bool)
        self.begins[[i for token, i in self.library.get_vocab().items() if token.startswith(BLANKS)]] = True
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.width) for e in found]

    def _learn(self, plain: list[str], others: list[str]) -> None:
        """``plain`` words begin with a space or line feed and have no other blank."""
        ids, sizes = [], []
        for i in range(0, len(plain), JOINED):
            group = plain[i : i + JOINED]
            # One text: each word begins with the one token in it that begins with a blank.
            of_all = self._ids(["".join(group)])[0]
            starts = np.flatnonzero(self.begins[of_all])
            if len(starts) == len(group) and not starts[0]:
                ids.append(of_all)
                sizes.append(np.diff(starts, append=len(of_all)))
            else:
                each = self._ids(group)
                ids += each
                sizes.append(np.array([len(x) for x in each], np.int64))
        each = self._ids(others)
        if plain or others:
            self.known.add(
                plain + others, np.concatenate([*ids, *each]), np.concatenate([*sizes, np.array([len(x) for x in each], np.int64)]))

    def _starts(self, data: np.ndarray, offsets: np.ndarray, ink: np.ndarray) -> np.ndarray:
        """Where pieces begin: at texts, at blanks that follow something else, at marks that follow a letter."""
        blank, letter = BLANK[data], LETTER[data]
        # Latin letters of two bytes, without the signs for times and divided by.
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        cut = np.zeros(len(data), bool)
        cut[1:] = blank[1:] & ink[:-1] | letter[:-1] & MARK[data[1:]]
        raw = data.tobytes() if self.added else b""
        for content in self.added:
            at = raw.find(content)
            while at >= 0:
                cut[at + 1 : at + len(content)] = False
                at = raw.find(content, at + 1)
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        return np.flatnonzero(cut)

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Texts are cut on their bytes and their distinct pieces found by Arrow; ids are put together by number."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        data, offsets = text_bytes(texts)
        if not len(data):
            return [b""] * len(texts)
        if self.known.full():
            self.known, self.older = _Known(self.width), self.known
        ink = _inked(data)
        starts = self._starts(data, offsets, ink)
        pieces = pa.Array.from_buffers(pa.large_string(), len(starts), [
            None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        codes, words = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = self.known.find(words)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            first = data[starts]
            alone = (np.add.reduceat(~ink, starts, dtype=np.int64) == 1) & ((first == 0x20) | (first == 0x0A))
            plain = np.zeros(len(words), bool)
            plain[codes] = alone
            self._fetch([words[i] for i in missing[plain[missing]].tolist()], [words[i] for i in missing[~plain[missing]].tolist()])
            numbers[missing] = self.known.find([words[i] for i in missing.tolist()])
        ids, sizes = self.known.ids(numbers[codes])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        cuts = ends[np.searchsorted(starts, offsets)].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]

    def _fetch(self, plain: list[str], others: list[str]) -> None:
        """Words that are not known: from the older generation, or by the library."""
        if self.older is not None:
            words = plain + others
            numbers = self.older.find(words)
            there = numbers >= 0
            self.known.add([w for w, t in zip(words, there.tolist()) if t], *self.older.ids(numbers[there]))
            plain, others = ([w for w, t in zip(some, known) if not t] for some, known in (
                (plain, there[: len(plain)].tolist()), (others, there[len(plain) :].tolist())))
        self._learn(plain, others)


def id_width(vocabulary_size: int) -> str:
    return "<u2" if vocabulary_size <= 1 << 16 else "<u4"


def encoder(vocabulary: str) -> PieceEncoder:
    """The worker's encoder for the contents of a vocabulary file."""
    kept = worker_cache().setdefault("encoders", {})
    if vocabulary not in kept:
        kept.clear()
        kept[vocabulary] = PieceEncoder(vocabulary)
    return kept[vocabulary]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
