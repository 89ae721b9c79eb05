"""Token ids of whole texts, piece by piece.

A text is cut where a byte-level BPE tokenizer always ends a piece: before a blank, around a line end, and between a plain word
and the plain marks after it. Pieces repeat, so each is encoded once per worker and looked up from then on, all of a batch at
once (``bytetable``). Texts in which white space comes together are cut by the tokenizer's own rule first: around runs of white
space, of which the last blank belongs to what follows. The table is emptied when it has ``PIECES`` entries.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Hashable
from functools import lru_cache

import numpy as np

from tideline.llm.bytetable import ByteTable

UNITS, PIECES = 200_000, 800_000
#: White space as the tokenizer's patterns know it, and letters whose class is the same in every Unicode version.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTER, MARK = "A-Za-zÀ-ÖØ-öø-ʯ", ".,!?;:"
#: A plain word, marks after it, any other run without white space, white space before more of it or the end, or its last.
PIECE = re.compile(f" ?[{LETTER}]+(?![^{SPACE}{MARK}])|[{MARK}]+(?![^{SPACE}])| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
PLAIN = re.compile(f" ?[{LETTER}]+|[{MARK}]+")
#: A token that the library finds before it cuts pieces; texts that have it are encoded whole.
SPECIAL = "<|endoftext|>"
OTHER, LETTERS, MARKS, BLANK, LINE_END = range(5)
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = LETTERS
_KIND[list(MARK.encode())] = MARKS
_KIND[32], _KIND[10] = BLANK, LINE_END

Encoded = tuple[np.ndarray, np.ndarray]


class Units(dict):
    """From a unit to its number; new ones wait in ``pending``."""

    def __init__(self):
        super().__init__()
        self.pending: list = []

    def __missing__(self, unit: Hashable) -> int:
        number = self[unit] = len(self)
        self.pending.append(unit)
        return number


def cut_pieces(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where pieces or runs of them begin in texts that lie one after the other from ``begins`` on."""
    kind = _KIND[data]
    # The letters À to ÿ have two bytes each; the signs × and ÷ among them are no letters.
    two = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))
    kind[two], kind[two + 1] = LETTERS, LETTERS
    start = kind >= BLANK
    start[1:] |= kind[:-1] == LINE_END
    start[begins] = True
    starts = np.flatnonzero(start)
    before = np.concatenate(([OTHER], kind[:-1])).astype(np.uint8)
    to_marks, back = (kind == MARKS) & (before == LETTERS), (kind == LETTERS) & (before == MARKS)
    to_marks[starts] = back[starts] = False
    # Only a run of letters and one of marks after it are cut apart.
    plain = (np.add.reduceat((kind == OTHER) | back, starts, dtype=np.int32) == 0) & (np.add.reduceat(to_marks, starts, dtype=np.int32) == 1)
    steps = np.flatnonzero(to_marks)
    more = steps[plain[np.searchsorted(starts, steps, side="right") - 1]]
    return np.sort(np.concatenate((starts, more)))


class TextEncoder:
    """Encodes batches of texts; ``words`` and ``rest`` give the ids of strings, end to end, and how many each has.

    ``words`` gets plain words and runs of marks, which are pieces of their own; ``rest`` gets all other strings.
    """

    def __init__(self, words: Callable[[list[str]], Encoded], rest: Callable[[list[str]], Encoded], limit: int = PIECES):
        self.words, self.rest, self.limit = words, rest, limit
        self.table = ByteTable(self._learn)
        self._clear()

    def _clear(self) -> None:
        self.table.clear()
        self.ids = IdTable()

    def _learn(self, new: list[bytes]) -> None:
        pieces = [p.decode() for p in new]
        self.ids.add(*self.encode_each(pieces), list(map(_loose, pieces)))

    def batch(self, texts: list[str | None]) -> Encoded:
        """Ids of all texts, end to end, and how many each has; null has none."""
        if self.table.count > self.limit:
            self._clear()
        whole = np.fromiter((bool(text) and SPECIAL in text for text in texts), bool, len(texts))
        raw = [text.encode() if text and not w else b"" for text, w in zip(texts, whole.tolist())]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data, begins = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes
        odd = np.zeros(len(texts), bool)
        numbers, counts = np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        if len(data):
            starts = cut_pieces(data, begins[sizes > 0])
            numbers = self.table.numbers(data, starts, np.diff(np.append(starts, len(data))))
            of_text = np.searchsorted(begins[sizes > 0], starts, side="right") - 1
            of_text = np.flatnonzero(sizes > 0)[of_text]
            counts = np.bincount(of_text, minlength=len(texts))
            odd[of_text[self.ids.marks[numbers]]] = True
            double = np.flatnonzero((data[:-1] == 10) & (data[1:] == 10))
            odd[np.searchsorted(begins + sizes, double, side="right")] = True
            numbers = numbers[~odd[of_text]]
        found = self.ids.runs(numbers, counts[~odd])
        if odd.any():
            found = _merged(odd, self._by_rule([texts[i] for i in np.flatnonzero(odd)]), found)
        if whole.any():
            found = _merged(whole, self.rest([texts[i] for i in np.flatnonzero(whole)]), (found[0], found[1][~whole]))
        return found

    def _by_rule(self, texts: list[str]) -> Encoded:
        """Ids of texts that are cut by the tokenizer's rule for white space."""
        lists = [PIECE.findall(text) for text in texts]
        sizes = np.fromiter((len(p.encode()) for pieces in lists for p in pieces), np.int64)
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        numbers = self.table.numbers(data, np.cumsum(sizes) - sizes, sizes)
        return self.ids.runs(numbers, np.fromiter(map(len, lists), np.int64, len(lists)))

    def encode_each(self, pieces: list[str]) -> Encoded:
        """Ids of strings that are pieces, or runs of whole pieces, by themselves."""
        plain = np.fromiter((PLAIN.fullmatch(p) is not None for p in pieces), bool, len(pieces))
        parts = [[p for p, is_plain in zip(pieces, plain.tolist()) if is_plain == want] for want in (True, False)]
        return _merged(plain, self.words(parts[0]), self.rest(parts[1]))


def _merged(first: np.ndarray, a: Encoded, b: Encoded) -> Encoded:
    """Ids and counts of rows of which ``a`` has those where ``first`` holds, in order, and ``b`` the others."""
    counts = np.zeros(len(first), np.int64)
    counts[first], counts[~first] = a[1], b[1]
    of_a = np.repeat(first, counts)
    ids = np.zeros(len(of_a), np.uint32)
    ids[of_a], ids[~of_a] = a[0], b[0]
    return ids, counts


def _loose(piece: str) -> bool:
    """Whether white space stands at an edge of the piece, so that more of it may come together there."""
    if piece == "\n":
        return False
    inner = piece[1:] if piece[0] == " " else piece
    return not inner or inner.strip() != inner


class IdTable:
    """Ids of numbered strings, end to end, and a mark for each."""

    def __init__(self):
        self.count = self.used = 0
        self.ids, self.ends, self.marks = np.zeros(1024, np.uint32), np.zeros(1025, np.int64), np.zeros(1024, bool)

    def add(self, ids: np.ndarray, counts: np.ndarray, marks: list[bool] | None = None) -> None:
        """The next strings; ids come end to end."""
        count, used = self.count + len(counts), self.used + len(ids)
        self.ids, self.ends, self.marks = _room(self.ids, used), _room(self.ends, count + 1), _room(self.marks, count)
        self.ids[self.used : used] = ids
        self.ends[self.count + 1 : count + 1] = self.used + np.cumsum(counts)
        if marks is not None:
            self.marks[self.count : count] = marks
        self.count, self.used = count, used

    def runs(self, numbers: np.ndarray, sizes: np.ndarray) -> Encoded:
        """The ids of strings, end to end, and how many each run of so many strings has."""
        starts = self.ends[numbers]
        counts = self.ends[numbers + 1] - starts
        ends = np.concatenate(([0], np.cumsum(counts)))
        total, last = int(ends[-1]), np.cumsum(sizes)
        return self.ids[np.arange(total) + np.repeat(starts - ends[:-1], counts)], ends[last] - ends[last - sizes]


def _room(held: np.ndarray, need: int) -> np.ndarray:
    return held if need <= len(held) else np.concatenate((held, np.zeros(2 * need - len(held), held.dtype)))


@lru_cache(maxsize=4)
def byte_letters() -> tuple[str, ...]:
    """The printable letter that stands for each byte: itself where printable, else the next from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = iter(range(256, 512))
    return tuple(chr(b) if b in printable else chr(next(shifted)) for b in range(256))


@lru_cache(maxsize=4)
def library_text_encoder(path: str) -> TextEncoder:
    """Ids by the tokenizers library: plain words straight from its model, everything else through its pipeline."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenize, letters = tokenizer.model.tokenize, dict(enumerate(byte_letters()))

    def words(pieces: list[str]) -> Encoded:
        ids: list[int] = []
        counts = np.zeros(len(pieces), np.int64)
        for i, piece in enumerate(pieces):
            found = tokenize(piece.encode().decode("latin-1").translate(letters))
            ids += [t.id for t in found]
            counts[i] = len(found)
        return np.array(ids, np.uint32), counts

    def rest(units: list[str]) -> Encoded:
        found = [x.ids for x in tokenizer.encode_batch(units, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)

    return TextEncoder(words, rest)
