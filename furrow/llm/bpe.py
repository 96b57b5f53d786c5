"""Whole texts to token ids with the tokenizers library, each different word encoded once.

The byte-level vocabulary cuts a text before its merges: runs of letters, of digits and of marks,
each with one space before it, and runs of white space, whose last character stands apart if a word
follows. Where such a cut is certain from the neighbouring characters alone, a text is cut here as
well, for all texts of a chunk at once; ids of the pieces don't depend on what stands beside them.
Letters beyond Latin, marks beyond ASCII and the like stay with their neighbours up to the next white
space, and characters that may be white space stay with both. A worker process encodes a piece the
first time it meets it and looks it up afterwards. The ids are those of encoding the whole text.
"""

from __future__ import annotations

import os
from collections.abc import Iterable
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa

from furrow.llm.common import utf8

# Kinds of characters. OTHER is no white space and otherwise unknown; UNSURE may be white space.
_UNSURE, _OTHER, _LETTER, _DIGIT, _MARK, _QUOTE, _BREAK, _SPACE = range(8)


def _kind(byte: int) -> int:
    """The kind of an ASCII byte, or of a character that begins with another byte."""
    if byte >= 128:
        return _LETTER if 0xC3 <= byte <= 0xC5 else _OTHER
    char = chr(byte)
    if char in "\t\n\v\f\r ":
        return _SPACE if char == " " else _BREAK
    if not char.isprintable():
        return _UNSURE
    return _LETTER if char.isalpha() else _DIGIT if char.isdigit() else _QUOTE if char == "'" else _MARK


_NEVER, _ALWAYS, _AFTER_BREAK, _IN_WHITE = range(4)


def _between(a: int, b: int) -> int:
    """Whether a text is cut between characters of two kinds."""
    solid, white = range(_OTHER, _BREAK), (_BREAK, _SPACE)
    if a in white and b in white:
        return _IN_WHITE
    if a == _BREAK and b in solid:
        return _AFTER_BREAK
    if a in solid and b in white:
        return _ALWAYS
    known = (_LETTER, _DIGIT, _MARK, _QUOTE)
    # a quote and letters may be a contraction, a quote and marks are one run
    together = a == b or (a, b) in ((_QUOTE, _LETTER), (_QUOTE, _MARK), (_MARK, _QUOTE))
    return _ALWAYS if a in known and b in known and not together else _NEVER


_KINDS = bytes(map(_kind, range(256)))
_CUTS = bytes(_between(p >> 3, p & 7) for p in range(64)) + bytes(192)

_ENCODERS: dict[str, Encoder] = {}

#: Words a process remembers in each of two generations: when the newer one is full it becomes the
#: older one, which is forgotten then; words met again move to the newer one.
MAX_WORDS = 400_000

#: Words looked up at a time: the library's results, large and scattered in memory, are held for
#: these only.
WORDS_AT_ONCE = 1 << 10


def _kinds(data: np.ndarray) -> np.ndarray:
    """The kind of the character that each byte belongs to."""
    kinds = np.frombuffer(bytearray(data).translate(_KINDS), np.uint8)
    inner = np.flatnonzero((data & 0xC0) == 0x80)
    if len(inner):
        # the multiplication and division signs lie among the letters
        sign = inner[(data[inner - 1] == 0xC3) & ((data[inner] == 0x97) | (data[inner] == 0xB7))] - 1
        kinds[sign] = _OTHER
        # white space: U+0085, U+00A0, U+1680, some of U+2000 to U+205F, U+3000; U+180E was once
        at = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
        lead, second, third = data[at], data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
        white = (lead == 0xC2) & ((second == 0x85) | (second == 0xA0))
        white |= (lead == 0xE1) & ((second == 0x9A) | (second == 0xA0))
        white |= (lead == 0xE2) & ((second == 0x80) & ((third < 0x90) | (third >= 0xA8) & (third < 0xB0))
                                   | (second == 0x81))
        white |= (lead == 0xE3) & (second == 0x80) & (third == 0x80)
        kinds[at[white]] = _UNSURE
        for _ in range(3):
            kinds[inner] = kinds[inner - 1]
    return kinds


def _starts(data: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Where pieces begin in the bytes of texts; every text that is not empty begins one."""
    if not len(data):
        return np.zeros(0, np.int64)
    kinds = _kinds(data)
    cuts = np.empty(len(data) + 1, np.uint8)
    cuts[1:-1] = np.frombuffer((kinds[:-1] << 3 | kinds[1:]).tobytes().translate(_CUTS), np.uint8)
    # what stands before a break may be white space, and the two one run
    after = np.flatnonzero(cuts[1:-1] == _AFTER_BREAK) + 1
    cuts[after[kinds[np.maximum(after - 2, 0)] == _UNSURE]] = _NEVER
    # white space stands together but for its last character, and that too at the end of a text
    inside = np.flatnonzero(cuts[1:-1] == _IN_WHITE) + 1
    kinds = np.append(kinds, np.uint8(_UNSURE))
    ends = np.zeros(len(cuts), bool)
    ends[limits] = True
    follows = kinds[inside + 1]
    cuts[inside[(follows < _OTHER) | (follows >= _BREAK) | ends[inside + 1]]] = _NEVER
    cuts[limits] = _ALWAYS
    return np.flatnonzero(cuts[:-1])


class Words:
    """Ids of words: per word a place in one long array."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0

    def add(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Words that are not known yet, with their ids in a row."""
        if not words:
            return
        first, n = len(self.known), len(words)
        ends = self.used + np.cumsum(lengths)
        if first + n > len(self.start):
            room = 2 * (first + n)
            self.start, self.length = np.resize(self.start, room), np.resize(self.length, room)
        if ends[-1] > len(self.flat):
            self.flat = np.resize(self.flat, 2 * int(ends[-1]))
        self.flat[self.used:ends[-1]] = ids
        self.start[first:first + n], self.length[first:first + n] = ends - lengths, lengths
        self.known.update(zip(words, range(first, first + n), strict=True))
        self.used = int(ends[-1])

    def ids(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of several words in a row, and how many each has."""
        counts = self.length[slots].astype(np.int64)
        ends = np.cumsum(counts)
        if not len(ends):
            return np.zeros(0, np.uint32), counts
        # places fit into 32 bits: a generation holds far fewer ids, as does a chunk of texts
        first = (self.start[slots] - ends + counts).astype(np.int32)
        return self.flat[np.repeat(first, counts) + np.arange(ends[-1], dtype=np.int32)], counts


class Encoder:
    """Remembers the ids of pieces."""

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.max_words = max_words
        self.new, self.old = Words(), Words()

    def _learn(self, words: list[str]) -> None:
        """Takes words of the older generation along and encodes those that neither holds."""
        old = self.old.known
        kept = [w for w in words if w in old]
        if kept:
            self.new.add(kept, *self.old.ids(np.array([old[w] for w in kept], np.int64)))
        todo = [w for w in words if w not in old] if kept else words
        if todo:
            # the same ids, without the places of tokens in the text; older versions lack it
            encode = getattr(self.tokenizer, "encode_batch_fast", None) or self.tokenizer.encode_batch
            found = [e.ids for e in encode(todo, add_special_tokens=False)]
            self.new.add(todo, np.fromiter(chain.from_iterable(found), np.uint32),
                         np.fromiter(map(len, found), np.int64, len(found)))

    def _lookup(self, words: list[str]) -> np.ndarray:
        """A slot per word; no word comes twice."""
        known = self.new.known
        slots = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(slots < 0)
        if len(unknown):
            fresh = [words[i] for i in unknown.tolist()]
            self._learn(fresh)
            slots[unknown] = [known[w] for w in fresh]
        return slots

    def _slots(self, words: Iterable[str]) -> np.ndarray:
        """A slot per word, for any number of words."""
        words = iter(words)
        some = iter(lambda: list(islice(words, WORDS_AT_ONCE)), [])
        return np.concatenate([np.zeros(0, np.int64), *map(self._lookup, some)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has. No text is null."""
        if len(self.new.known) > self.max_words:
            self.new, self.old = Words(), self.new
        data, limits = utf8(texts)
        starts = _starts(data, limits)
        pieces = pa.LargeStringArray.from_buffers(
            len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data))
        coded = pieces.dictionary_encode()
        codes = coded.indices.to_numpy()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        limits = np.searchsorted(starts, limits)
        # a text's first word is likely to come again with a space before it
        firsts = dict.fromkeys(
            " " + words[c] for c in codes[limits[:-1][np.diff(limits) > 0]].tolist())
        known = set(words)
        slots = self._slots(chain(words, (w for w in firsts if w not in known)))
        ids, counts = self.new.ids(slots[codes])
        return ids, np.diff(np.concatenate([[0], np.cumsum(counts)])[limits])


def encoder(path: str, max_words: int = MAX_WORDS) -> Encoder:
    """The process's own encoder for a vocabulary file; from now on it remembers max_words words."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].max_words = max_words
    return _ENCODERS[path]


def with_end(ids: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids followed by one more."""
    return np.insert(ids, np.cumsum(lengths), end), lengths + 1
