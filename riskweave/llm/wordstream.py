"""Words of a column of texts as arrays, without a Python object for each word.

Texts are read as UTF-8 bytes.  A part holds whole texts of a few MB together, or a
stretch of one long text with some words of the next stretch shown ahead, so memory
stays bounded however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PART_BYTES = 4 << 20

WORD_BYTE, BLANK, BREAK = 0, 1, 2

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A good 64-bit mixing of unsigned integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


#: Factors of the letters of a word, by place; they repeat in longer words.
_PLACES = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64)) | np.uint64(1)


class Part(NamedTuple):
    rows: range             # rows of the column; one row alone may go over several parts
    first: bool             # its first row begins here
    last: bool              # its last row ends here
    base: int               # byte of the first row at which the part begins
    cuts: np.ndarray        # byte of data at which each row begins
    data: np.ndarray        # lower-cased bytes
    starts: np.ndarray      # byte ranges of the words in data
    ends: np.ndarray
    row: np.ndarray         # row of each word
    piece: np.ndarray       # grows from a word to the next if a BREAK or a new row is between
    own: int                # words of this part; those after are shown ahead
    codes: np.ndarray       # number of each word in words
    words: pa.StringArray   # the different words
    hashes: np.ndarray      # a 64-bit hash of each word


def hash_words(words: pa.StringArray) -> np.ndarray:
    """64-bit hashes of not empty words: letters times odd factors, summed and mixed."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    letters = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].astype(np.uint64) + np.uint64(1)
    begins, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
    place = np.arange(len(letters)) - np.repeat(begins, sizes)
    with np.errstate(over="ignore"):
        total = np.add.reduceat(letters * _PLACES[place & 0xFFFF], begins)
        return mix(total + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _part(raw: np.ndarray, cuts: np.ndarray, kinds: np.ndarray, rows: range, own_bytes: int,
          first: bool = True, last: bool = True, base: int = 0) -> Part:
    """Words of ``raw``, whose rows begin at ``cuts``; words from ``own_bytes`` on are shown ahead."""
    kind = kinds[_LOWER][raw]
    data = _LOWER[raw]
    inside = kind == WORD_BYTE
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    at = cuts[cuts < len(raw)]
    begin[at] = inside[at]
    at = at[at > 0]
    end[at - 1] = inside[at - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    # rows without bytes share a cut with the next one; the last of them has the words
    row = np.repeat(np.arange(len(cuts)), np.diff(np.append(np.searchsorted(starts, cuts), len(starts))))
    breaks = np.flatnonzero(kind == BREAK)
    at = np.searchsorted(starts, breaks)
    piece = np.zeros(len(starts) + 1, np.int64)
    piece += np.bincount(at, minlength=len(piece))
    piece = np.cumsum(piece)[:-1] + row
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    spelled = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    coded = spelled.dictionary_encode()
    words = coded.dictionary
    codes = coded.indices.to_numpy()
    return Part(rows, first, last, base, cuts, data, starts, ends, row + rows.start, piece,
                int(np.searchsorted(starts, own_bytes)), codes, words, hash_words(words)[codes])


def _next_separator(raw: np.ndarray, kinds: np.ndarray, at: int) -> int:
    while at < len(raw):
        found = np.flatnonzero(kinds[_LOWER[raw[at:at + 65536]]] != WORD_BYTE)
        if len(found):
            return at + int(found[0])
        at += 65536
    return len(raw)


def _after_words(raw: np.ndarray, kinds: np.ndarray, at: int, n: int) -> int:
    """Where the ``n``-th word behind the separator at ``at`` ends."""
    for _ in range(n):
        while at < len(raw):
            found = np.flatnonzero(kinds[_LOWER[raw[at:at + 4096]]] == WORD_BYTE)
            if len(found):
                at += int(found[0])
                break
            at += 4096
        at = _next_separator(raw, kinds, min(at, len(raw)))
    return at


def parts(texts: pa.Array, kinds: np.ndarray, ahead: int = 0, size: int = PART_BYTES) -> Iterator[Part]:
    """Parts of a column of texts, in order.  ``kinds`` names the kind of each lower-cased
    byte; null texts count as empty.  A text of more than ``size`` bytes is cut behind
    words, and each stretch but the last shows up to ``ahead`` words of the next."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.type != pa.string():
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    k = 0
    while k < len(texts):
        stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + size, side="right")) - 1)
        here = raw[offsets[k]:offsets[stop]]
        if len(here) <= size:
            yield _part(here, offsets[k:stop] - offsets[k], kinds, range(k, stop), len(here))
        else:
            at = 0
            while at < len(here):
                end = _next_separator(here, kinds, min(at + size, len(here)))
                shown = _after_words(here, kinds, end, ahead)
                yield _part(here[at:shown], np.zeros(1, np.int64), kinds, range(k, stop), end - at,
                            at == 0, end >= len(here), at)
                at = end
        k = stop


def chain(hashes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of sequences that go on with the words of hash ``word``."""
    with np.errstate(over="ignore"):
        return mix(hashes * np.uint64(0xD1342543DE82EF95) + word)


def kinds_of(word: bytes | None = None, breaks: bytes = b"", blanks: bytes = b"") -> np.ndarray:
    """The kind of each byte: either ``word`` bytes are named and others are blanks, or
    ``breaks`` and ``blanks`` are named and others make words."""
    kinds = np.full(256, WORD_BYTE if word is None else BLANK, np.uint8)
    kinds[list(word or b"")] = WORD_BYTE
    kinds[list(blanks)] = BLANK
    kinds[list(breaks)] = BREAK
    return kinds
