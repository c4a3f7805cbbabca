"""Words and shingles of whole Arrow batches as 64-bit hashes, without a loop over words.

A word's hash is that of a polynomial over its bytes modulo 2**64, taken from prefix sums over
the whole buffer, and mixed afterwards.  Texts are cut into chunks of bounded bytes first, so
the arrays stay small whatever the batch holds; a text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 400_000
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

#: Bytes that are part of a word of letters and digits: ASCII ones, and all of a non-ASCII character.
ALNUM = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
#: Bytes that are part of a word between blanks: all but space and 0x09 to 0x0D.
NONBLANK = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
#: 1 for bytes of words of letters and digits, 2 for punctuation, 0 for blanks.
WORD_PUNCT = np.where(ALNUM, 1, np.where(NONBLANK, 2, 0))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambler of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x.astype(U) + U((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            step = np.full(max(n, 1 << 16), _BASE if kind == "p" else _INV, dtype=U)
            step[0] = 1
            have = _powers[kind] = np.cumprod(step, dtype=U)
    return have[:n]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose texts have about ``limit`` bytes together, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(size) - size) // limit if len(size) else size
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(size)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... count[0] of them, then the same of the next."""
    count = count.astype(np.int64)
    total = int(count.sum())
    ends = np.cumsum(count)
    return np.arange(total) - np.repeat(ends - count, count) + np.repeat(start.astype(np.int64), count)


class Buffer:
    """The bytes of some texts, each followed by a line feed, with prefix sums for hashing."""

    def __init__(self, texts: pa.Array, lower: bool):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if lower:
            texts = pc.utf8_lower(texts)
        texts = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        self.offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1].copy()
        whole = texts.buffers()[2]
        raw = np.frombuffer(whole, dtype=np.uint8) if whole else np.zeros(0, np.uint8)
        self.bytes = raw[self.offsets[0] : self.offsets[-1]] if len(texts) else raw[:0]
        self.offsets -= self.offsets[0] if len(self.offsets) else 0
        n = len(self.bytes)
        with np.errstate(over="ignore"):
            self._sum = np.zeros(n + 1, dtype=U)
            np.cumsum((self.bytes.astype(U) + U(1)) * _power("p", n), out=self._sum[1:])

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self._sum[end] - self._sum[start]) * _power("i", len(self.bytes) + 1)[start]
            return mix(h + (end - start).astype(U) * U(0xD6E8FEB86659FD93))

    def runs(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the runs of bytes that the table marks; line feeds are never marked."""
        inside = np.zeros(len(self.bytes) + 2, dtype=np.int8)
        inside[1:-1] = table[self.bytes]
        step = np.diff(inside)
        return np.flatnonzero(step == 1), np.flatnonzero(step == -1)

    def pieces(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the runs of bytes of one kind, but for kind 0, which line feeds have."""
        kind = np.zeros(len(self.bytes) + 2, dtype=np.int8)
        kind[1:-1] = kinds[self.bytes]
        turn = np.flatnonzero(kind[1:] != kind[:-1])
        start, end = turn[:-1], turn[1:]
        real = kind[start + 1] != 0
        return start[real], end[real]

    def owner(self, start: np.ndarray) -> np.ndarray:
        """Number of words before each text: words of text i are [out[i], out[i + 1])."""
        return np.searchsorted(start, self.offsets)


class Words:
    """Hashes of the words of some texts; ``first[i]:first[i + 1]`` are those of text i.

    ``table`` marks the bytes of words, or numbers their kinds (runs of one kind are words then).
    """

    def __init__(self, texts: pa.Array, table: np.ndarray = ALNUM, lower: bool = True):
        self.buffer = Buffer(texts, lower)
        self.start, self.end = self.buffer.runs(table) if table.dtype == bool else self.buffer.pieces(table)
        self.first = self.buffer.owner(self.start)
        self.hash = self.buffer.hash(self.start, self.end)

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def shingles(self, width: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of ``width`` words, and where each text's begin.

        ``whole``: a text with fewer words, but one at least, has one shingle of them all.
        """
        n = self.count()
        with np.errstate(over="ignore"):
            out = np.zeros(len(self.hash), dtype=U)
            out[:] = self.hash * U(0xA24BAED4963EE407)
            padded = np.concatenate([self.hash, np.zeros(width, U)])
            short = np.repeat(n < width, n) if whole else None
            at = np.arange(len(self.hash)) - np.repeat(self.first[:-1], n)
            left = np.repeat(n, n) - at
            for k in range(1, width):
                more = padded[k : k + len(out)]
                nxt = mix(out) + more * U(0x9FB21C651E98DF25)
                out = np.where(left > k, nxt, out) if whole else nxt
        keep = left >= width
        if whole:
            keep |= short & (at == 0)
        out = mix(out[keep], 7)
        count = np.maximum(n - width + 1, (n > 0).astype(n.dtype) if whole else 0)
        return out, np.concatenate([[0], np.cumsum(count)])
