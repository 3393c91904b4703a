"""Vectorised word hashing over Arrow string columns.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, the same as
``[^\\x20\\x09-\\x0D]+`` over UTF-8.  Words are hashed eight bytes at a time for a
whole slice of documents, each step a bijection of the state that is not linear
in the bytes, so no arrangement of few letters or words makes texts collide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text hashed at a time; a longer text forms a slice of its own.
SLICE_BYTES = 1 << 20
#: Spans of more bytes are hashed one by one by a library function.
LONG_SPAN = 128
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_TAILS = np.array([2 ** (8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = (h ^ (h >> np.uint64(33))) * _MIX[0]
    h = (h ^ (h >> np.uint64(29))) * _MIX[1]
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """The words of the documents ``first`` .. ``first + len(bounds) - 2`` of a column.

    ``bounds[i]:bounds[i + 1]`` are the words of the i-th of them; ``starts`` and
    ``ends`` are byte offsets into ``data``.
    """

    first: int
    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray

    @property
    def docs(self) -> np.ndarray:
        """The document (counted from 0 in this slice) of every word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``most`` bytes."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes unchanged."""
    return data + (((data >= 65) & (data <= 90)).view(np.uint8) << np.uint8(5))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """The hash of ``data[start:end]`` for every span; hashes of two seeds are independent."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))  # the 8 bytes from each byte on
    length = ends - starts
    h = mix(length.astype(np.uint64) + np.uint64(seed) * _ODD)
    at = np.flatnonzero((length > 0) & (length <= LONG_SPAN))
    place, left = starts[at], length[at]
    while len(at):
        h[at] = mix(h[at] ^ (eight[place] & _TAILS[np.minimum(left, 8)]))
        more = left > 8
        at, place, left = at[more], place[more] + 8, left[more] - 8
    salt = seed.to_bytes(8, "little")
    for k in np.flatnonzero(length > LONG_SPAN).tolist():
        h[k] = int.from_bytes(blake2b(data[starts[k] : ends[k]], digest_size=8, salt=salt).digest(), "little")
    return h


def word_slices(column: pa.Array, lower: bool = False) -> Iterator[Words]:
    data, offsets = text_buffers(column)
    for i, j in slices(offsets):
        part, offs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if lower:
            part = lowered(part)
        n = len(part)
        inside = ~((part == 32) | ((part >= 9) & (part <= 13)))
        edge = np.zeros(n + 1, dtype=bool)  # a document begins or ends here
        edge[offs] = True
        before = np.concatenate(([False], inside))
        after = np.concatenate((inside, [False]))
        starts = np.flatnonzero(after & (~before | edge))
        ends = np.flatnonzero(before & (~after | edge))
        yield Words(i, part, np.searchsorted(starts, offs), starts, ends, hash_spans(part, starts, ends), offs)


def fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of what ``a`` and then ``b`` are hashes of."""
    return mix(mix(a) * _ODD + b)


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of ``size`` words (len(words) - size + 1 of them), from runs of powers of two."""
    n = len(words) - size + 1
    if n <= 0 or size == 0:
        return np.zeros(0, dtype=np.uint64)
    runs, width, out, have = words, 1, None, 0
    while True:
        if size & width:
            out = runs[:n] if out is None else fold(out, runs[have : have + n])
            have += width
        if have == size:
            return mix(out)
        runs = fold(runs[:-width], runs[width:])
        width *= 2


def joined_words(w: Words, keep: np.ndarray | None = None) -> list[bytes]:
    """The words of each text (those in ``keep``), joined by one space."""
    n = len(w.data)
    starts, ends, docs = (w.starts, w.ends, w.docs) if keep is None else (w.starts[keep], w.ends[keep], w.docs[keep])
    inside = np.zeros(n + 1, dtype=np.int8)
    inside[starts] += 1
    # up to the byte behind a word, if that still belongs to its text
    stop = np.minimum(ends + 1, w.offsets[1:][docs])
    np.subtract.at(inside, stop, 1)
    mask = np.cumsum(inside, dtype=np.int8)[:n] > 0
    data = np.where((w.data >= 9) & (w.data <= 13), np.uint8(32), w.data)
    at = np.concatenate(([0], np.cumsum(mask)))[w.offsets]
    out = data[mask].tobytes()
    return [out[a:b].removesuffix(b" ") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
