"""Vectorised words, word hashes and shingles of a batch of texts.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``. UTF-8 never uses those
bytes inside a longer sequence, so working on bytes gives the same words as working on
code points.

A word has two 64-bit hashes, ``hash`` and ``check``: its 8-byte pieces are taken in one
after another, with an avalanche after each; words above LONG bytes are hashed by BLAKE2b.
Runs of words are hashed by halves, again with an avalanche at every step. No step is a
polynomial, so texts with a pattern (such as Thue-Morse words) don't collide more often
than others: two different words or runs agree in one hash with probability 2**-64, in
both with 2**-128.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text and words handled at a time, which bound a worker's memory, and bytes of a word that is hashed as a whole.
SLICE_BYTES, HASH_WORDS, LONG = 1 << 21, 1 << 17, 256

_MASK = (1 << 64) - 1
_ODD = np.uint64(0xD6E8FEB86659FD93)
_SECOND = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the first n bytes of a piece.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Avalanche of 64-bit values (the splitmix64 finisher)."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """``hash[i]``, ``check[i]``, ``start[i]``, ``end[i]`` describe word i; document d has words ``first[d]:first[d+1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    check: np.ndarray | None
    first: np.ndarray

    def text(self, which: np.ndarray) -> bytes:
        """The words ``which``, joined by one space."""
        raw = self.data
        return b" ".join([raw[a:b].tobytes() for a, b in zip(self.start[which].tolist(), self.end[which].tolist(), strict=True)])


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about SLICE_BYTES of text, one row at least."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def words_of(texts: pa.Array, lower: bool = False, check: bool = False) -> Words:
    """Words of every text; null has none. The second hash is made if asked for."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body is not None and n else np.empty(0, np.uint8)
    offsets = offsets - offsets[0] if n else np.zeros(1, np.int64)
    inside = ~SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = offsets[1:-1]
        at = cut[cut < len(data)]
        begins[at] = inside[at]
        at = cut[cut > 0] - 1
        ends[at] = inside[at]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    del begins, ends, inside
    raw = LOWER[data] if lower else data
    return Words(raw, start, end, *_hash_words(raw, start, end, check), np.searchsorted(start, offsets))


def _hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, check: bool) -> tuple[np.ndarray, np.ndarray | None]:
    one, two = np.empty(len(start), dtype=np.uint64), np.empty(len(start) if check else 0, dtype=np.uint64)
    padded = np.append(data, np.zeros(8, np.uint8))
    pieces = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded.data, strides=(1,))  # the 8 bytes from each place on
    for k in range(0, len(start), HASH_WORDS):
        at, size = start[k : k + HASH_WORDS], (end - start)[k : k + HASH_WORDS]
        whole = np.flatnonzero(size > LONG)
        a = mix(size.astype(np.uint64), 1)
        b = mix(size.astype(np.uint64), 2) if check else None
        done, some = 0, slice(None) if not len(whole) else np.flatnonzero(size <= LONG)
        while len(size[some]):
            x = pieces[at[some] + done] & _FIRST[np.minimum(size[some] - done, 8)]
            a[some] = mix(a[some] ^ x, 3)
            if check:
                b[some] = mix(b[some] * _ODD + x * _SECOND, 4)
            done += 8
            left = np.flatnonzero(size[some] > done)
            some = left if isinstance(some, slice) else some[left]
        for i in whole.tolist():
            body = np.frombuffer(hashlib.blake2b(data[at[i] : at[i] + size[i]].tobytes(), digest_size=16).digest(), np.uint64)
            a[i] = body[0]
            if check:
                b[i] = body[1]
        one[k : k + HASH_WORDS] = a
        if check:
            two[k : k + HASH_WORDS] = b
    return one, two if check else None


def windows(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes.

    Runs of 1, 2, 4, ... words are hashed from two runs of half their length; a run of
    ``size`` words is put together from those that its binary digits name.
    """
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    level, width, begin, total = hashes, 1, 0, None
    while True:
        if size & width:
            part = level[begin : begin + n]
            total = part if total is None else mix(total * _ODD + part, width)
            begin += width
        width *= 2
        if width > size:
            return mix(total, seed + size)
        level = mix(level[: -(width // 2)] * _ODD + level[width // 2 :], width)


def shingle_pairs(words: Words, document: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of the distinct shingles of one document, in the order of the first."""
    at = slice(words.first[document], words.first[document + 1])
    n = min(size, int(at.stop - at.start))
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    one, place = np.unique(windows(words.hash[at], n), return_index=True)
    return one, windows(words.check[at], n, 7)[place]


def shared_pairs(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Shingles that two documents share: both hashes agree."""
    if not len(a[0]) or not len(b[0]):
        return 0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    return int(np.count_nonzero((b[0][at] == a[0]) & (b[1][at] == a[1])))
