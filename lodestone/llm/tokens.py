"""Token ids of whole texts, by the tokenizers library, with the ids of repeated words kept.

The vocabulary's splitting pattern never joins text across a single blank that stands between two non-blanks, so such a text is
encoded as its blank-led pieces, parted again at line ends between other characters and at punctuation behind ASCII letters (unless
a special token holds it), where a token ends as well; each distinct piece is encoded once and kept for later batches. Texts with
other white space next to a blank are encoded whole. Either way the ids are those of Tokenizer.encode(text, add_special_tokens=False). A kept piece is found
by its hash and compared on its bytes; a piece whose hash another one has is encoded by itself.
"""

from __future__ import annotations

import gc
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from . import textnp

_ODD = re.compile(r" \s|\s |^ | $")
#: Pieces, and their ids, kept in a worker; beyond half of either the store starts anew.
MOST, MOST_IDS, MOST_BYTES = 1 << 21, 8 << 20, 32 << 20
#: Bytes of white space other than blank and line end; the last four begin longer ones.
_RARE = np.zeros(256, bool)
_RARE[[0x09, *range(0x0B, 0x0E), *range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True


def _odd_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The rows in which other white space stands next to a blank, or a blank at either end."""
    odd = np.zeros(len(offsets) - 1, bool)
    full = offsets[:-1] < offsets[1:]
    blank, line = data == 0x20, data == 0x0A
    odd[full] = blank[offsets[:-1][full]] | blank[offsets[1:][full] - 1]
    near = np.flatnonzero(blank[:-1] & (blank[1:] | line[1:]) | line[:-1] & blank[1:])
    odd[np.searchsorted(offsets, near, "right") - 1] = True
    rows = np.unique(np.searchsorted(offsets, np.flatnonzero(_RARE[data]), "right") - 1)
    for r in rows[~odd[rows]].tolist():  # few rows hold such bytes, but for typographic marks
        odd[r] = _ODD.search(data[offsets[r] : offsets[r + 1]].tobytes().decode()) is not None
    return odd


#: Bytes of ASCII letters, and of ASCII other than white space and controls.
_LETTER, _INK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _INK[0x21:0x7F] = True
#: ASCII punctuation without the apostrophe, which may begin a contraction, and "<" and "|>", which may belong to a special token.
PUNCTUATION = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"


def _byte_letters() -> dict[int, str]:
    """The printable letter by which byte-level vocabularies write each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()
_CODES = np.array([ord(BYTE_LETTERS[b]) for b in range(256)], "<u2")


class Words:
    """Encodes texts; keeps the ids of pieces in one growing array."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.merge = self.tokenizer.model.tokenize
        self.line = [t.id for t in self.merge("\u010a")]
        self.tails: dict[str, list[int]] = {}
        self.marks = np.zeros(256, bool)  # punctuation that is in no special token
        self.marks[list(PUNCTUATION.encode())] = True
        self.marks[list("".join(t.content for t in self.tokenizer.get_added_tokens_decoder().values()).encode())] = False
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(2 * 1 << (MOST - 1).bit_length(), np.uint64)  # open addressing; 0 is free
        self.values = np.zeros(len(self.keys), np.int32)
        self.known = 0
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)
        self.used = 0
        self.pool = np.zeros(1 << 18, np.uint8)  # the bytes of the kept pieces
        self.place = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.filled = 0

    def _begins(self, data: np.ndarray) -> np.ndarray:
        """Where a piece begins: at each blank, at a line end between two other characters, and at punctuation behind an ASCII letter."""
        begins = data == 0x20
        line = np.flatnonzero(data[1:-1] == 0x0A) + 1
        begins[line[_INK[data[line - 1]] & (_INK[data[line + 1]] | (data[line + 1] >= 0x80) & ~_RARE[data[line + 1]])]] = True
        begins[1:] |= self.marks[data[1:]] & _LETTER[data[:-1]]
        return begins

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of known pieces, -1 for others."""
        mask = np.uint64(len(self.keys) - 1)
        at, out = hashes & mask, np.full(len(hashes), -1, np.int64)
        todo = np.arange(len(hashes))
        while len(todo):
            here = self.keys[at]
            hit = here == hashes[todo]
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (here != 0)
            todo, at = todo[on], (at[on] + np.uint64(1)) & mask
        return out

    def _put(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Adds distinct, unknown hashes."""
        mask = np.uint64(len(self.keys) - 1)
        at = hashes & mask
        while len(hashes):
            free = np.flatnonzero(self.keys[at] == 0)
            self.keys[at[free]] = hashes[free]
            won = self.keys[at] == hashes
            self.values[at[won]] = numbers[won]
            hashes, numbers, at = hashes[~won], numbers[~won], (at[~won] + np.uint64(1)) & mask

    def _simple(self, piece: str) -> list[int] | None:
        """The ids of a piece of letters after at most one blank, perhaps with ASCII punctuation behind, perhaps with a line end and
        another such part behind that: each part is one token of the splitting pattern, so the model's merges alone give its ids.
        None for any other piece."""
        merge = self.merge
        if piece[1:].isalpha() and piece.isascii() and (piece[0] == " " or piece[0].isalpha()):
            return [t.id for t in merge(piece.replace(" ", "\u0120"))]
        core = piece.rstrip(PUNCTUATION)
        if not (core[1:] if core[:1] == " " else core).isalpha():
            left, line, right = piece.partition("\n")
            if line and left and right and right[0] != "\n" and left[-1] != "\n" and (a := self._simple(left)) is not None and right[0] != " " and (b := self._simple(right)) is not None:
                return a + self.line + b
            return None
        ids = [t.id for t in merge(core.replace(" ", "\u0120") if core.isascii() else core.encode().decode("latin-1").translate(BYTE_LETTERS))]
        tail = piece[len(core) :]
        if tail:
            if tail not in self.tails:
                self.tails[tail] = [t.id for t in merge(tail)]
            ids += self.tails[tail]
        return ids

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, and how many each has."""
        encoded = list(map(self._simple, pieces))
        rest = [i for i, e in enumerate(encoded) if e is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            encoded[i] = e.ids
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        return np.fromiter(chain.from_iterable(encoded), np.uint32, int(lengths.sum())), lengths

    def _ids_of(self, pieces: list[bytes], joined: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """_ids of pieces that are joined; those of ASCII letters after at most one blank are cut out as the model's letters."""
        at = np.concatenate([[0], np.cumsum(size)])
        letters = np.diff(np.concatenate([[0], np.cumsum(_LETTER[joined])])[at])
        plain = (letters == size) | (letters > 0) & (letters == size - 1) & (joined[at[:-1]] == 0x20)
        written, merge = _CODES[joined].tobytes().decode("utf-16-le"), self.merge
        encoded: list[list[int]] = [[t.id for t in merge(written[a:b])] if p else [] for a, b, p in zip(at[:-1].tolist(), at[1:].tolist(), plain.tolist(), strict=True)]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        rest = np.flatnonzero(~plain)
        more, lengths[rest] = self._ids([pieces[i].decode() for i in rest.tolist()])
        flat = np.empty(int(lengths.sum()), np.uint32)
        mine = np.repeat(plain, lengths)
        flat[mine] = np.fromiter(chain.from_iterable(encoded), np.uint32, int(mine.sum()))
        flat[~mine] = more
        return flat, lengths

    def _learn(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> None:
        pieces = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        n, size = self.known, ends - starts
        joined = np.frombuffer(b"".join(pieces), np.uint8)
        flat, lengths = self._ids_of(pieces, joined, size)
        while n + len(pieces) > len(self.start):
            self.start, self.length, self.place, self.size = (np.resize(x, 2 * len(x)) for x in (self.start, self.length, self.place, self.size))
        while self.filled + len(joined) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.filled : self.filled + len(joined)] = joined
        self.size[n : n + len(pieces)] = size
        self.place[n : n + len(pieces)] = self.filled + np.cumsum(size) - size
        self.filled += len(joined)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + len(flat)] = flat
        self.length[n : n + len(pieces)] = lengths
        self.start[n : n + len(pieces)] = self.used + np.cumsum(lengths) - lengths
        self.used += len(flat)
        self.known += len(pieces)

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text. Null counts as empty."""
        data, offsets = textnp.utf8(texts if isinstance(texts, pa.Array | pa.ChunkedArray) else pa.array(texts, pa.large_string()))
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        if self.known > MOST // 2 or self.used > MOST_IDS or self.filled > MOST_BYTES:
            self.clear()
        whole = _odd_rows(data, offsets)
        begins = self._begins(data)  # marked and read off in order, without sorting
        for r in np.flatnonzero(whole).tolist():
            begins[offsets[r] : offsets[r + 1]] = False
        begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        hashes = textnp.word_hashes(data, starts, ends)
        hashes += (hashes == 0).astype(np.uint64)
        numbers = self._find(hashes)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            new, first, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            fresh = self.known + np.arange(len(new))
            if self.known + len(new) > MOST:  # a batch of very many new pieces: the store holds this batch alone
                self.clear()
                return self.encode(texts) if len(np.unique(hashes)) <= MOST else self._apart(data, offsets)
            collecting = gc.isenabled()
            gc.disable()  # many small lists that hold no cycles
            try:
                self._learn(data.tobytes(), starts[missing[first]], ends[missing[first]])
            finally:
                if collecting:
                    gc.enable()
            self._put(new, fresh)
            numbers[missing] = fresh[back]
        source, begin, lengths = self.ids, self.start[numbers], self.length[numbers]
        wrong = np.flatnonzero((self.size[numbers] != ends - starts) | ~textnp.same_bytes(data, starts, self.pool, self.place[numbers], np.minimum(ends - starts, self.size[numbers])))
        if len(wrong):  # another piece has this hash: these are encoded by themselves, behind the kept ids
            raw = data.tobytes()
            more, lengths[wrong] = self._ids([raw[a:b].decode() for a, b in zip(starts[wrong].tolist(), ends[wrong].tolist(), strict=True)])
            source = np.concatenate([self.ids[: self.used], more])
            begin[wrong] = self.used + np.cumsum(lengths[wrong]) - lengths[wrong]
        done = np.cumsum(lengths)
        at = np.arange(done[-1]) + np.repeat(begin - (done - lengths), lengths)
        sums = np.concatenate([[0], done])
        edge = sums[np.searchsorted(starts, offsets)]
        return source[at], np.diff(edge)

    def _apart(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        found = [self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.array([len(f) for f in found], np.int64)


_kept: dict[str, Words] = {}


def words(vocabulary: str) -> Words:
    if vocabulary not in _kept:
        _kept[vocabulary] = Words(vocabulary)
    return _kept[vocabulary]


def end_with(ids: np.ndarray, lengths: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Puts the id `end` after each document's ids."""
    if end is None:
        return ids, lengths
    out = np.full(len(ids) + len(lengths), end, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(lengths)), lengths)] = ids
    return out, lengths + 1


def binary(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Rows of little-endian bytes: lengths[i] items of `flat` in row i."""
    data = np.ascontiguousarray(flat)
    offsets = np.concatenate([[0], np.cumsum(lengths)]) * data.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
