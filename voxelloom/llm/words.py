"""Vectorised word scanning and hashing over Arrow string columns.

Texts stay in the UTF-8 buffer that Arrow hands over. A word is a maximal run
of bytes outside an ASCII separator class, so multi-byte characters are never
cut. Words hash to 64 bits by mixing eight of their bytes after another; two
words of one length up to eight bytes never clash. Sequences hash by mixing the
hashes of two halves. Each hash comes in two independent lanes; what removes,
links or hits anything compares both, 128 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_cache

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_PIECE, _LONG = 1 << 17, 512
_LEFT = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _tables(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: is it in a word, and the byte that it counts as.

    kind: 'space' has words [^\\x20\\x09-\\x0D]+; 'space_lower' takes A-Z as
    a-z; 'alnum_lower' has words of digits, letters and non-ASCII, A-Z as a-z.
    """
    kept = worker_cache().get(("tables", kind))
    if kept is None:
        b = np.arange(256)
        if kind.startswith("space"):
            inside = ~((b == 0x20) | ((b >= 0x09) & (b <= 0x0D)))
        else:
            inside = (b >= 0x80) | ((b >= 48) & (b <= 57)) | ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122))
        as_byte = b.astype(np.uint8)
        if kind.endswith("lower"):
            as_byte[65:91] += 32
        kept = worker_cache()[("tables", kind)] = (inside, as_byte)
    return kept


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    all_bytes = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return all_bytes[at[0] : at[-1]], at - at[0]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range; the lanes 0 and 1 are independent."""
    n = end - start
    out = mix(n.astype(np.uint64) * _ODD[lane] + np.uint64(lane + 1))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # eight bytes from each place on
    for lo in range(0, len(start), _PIECE):
        s, left, h = start[lo : lo + _PIECE], n[lo : lo + _PIECE], out[lo : lo + _PIECE]
        long_ones = np.flatnonzero(left > _LONG)
        live = np.flatnonzero(left <= _LONG) if len(long_ones) else slice(None)
        s, left, x = s[live], left[live], h[live]
        x = mix((x ^ (eight[s] & _LEFT[np.minimum(left, 8)])) * _ODD[lane])
        done, at = 8, np.flatnonzero(left > 8)
        while len(at):
            x[at] = mix((x[at] ^ (eight[s[at] + done] & _LEFT[np.minimum(left[at] - done, 8)])) * _ODD[lane])
            done += 8
            at = at[left[at] > done]
        h[live] = x
        for i in long_ones:
            raw = data[start[lo + i] : end[lo + i]].tobytes()
            h[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=16).digest()[8 * lane : 8 * lane + 8], "little")
    return out


class Words:
    """The words of a batch of texts: byte ranges, hashes, and the first word of each text."""

    def __init__(self, column, kind: str):
        self.data, self.at = utf8(column)
        inside, as_byte = _tables(kind)
        w = inside[self.data]
        self.bytes = as_byte[self.data] if kind.endswith("lower") else self.data
        first = w.copy()
        first[1:] &= ~w[:-1]
        begins = self.at[:-1][self.at[:-1] < self.at[1:]]
        first[begins] = w[begins]
        last = w.copy()
        last[:-1] &= ~w[1:]
        last[self.at[1:][self.at[:-1] < self.at[1:]] - 1] = w[self.at[1:][self.at[:-1] < self.at[1:]] - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        #: Words of text i are ptr[i] to ptr[i + 1].
        self.ptr = np.searchsorted(self.start, self.at)
        self.n = np.diff(self.ptr)

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.n)), self.n)

    def hashes(self, lane: int = 0) -> np.ndarray:
        return span_hashes(self.bytes, self.start, self.end, lane)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, crossing texts; len(h) - k + 1 of them. Runs
    are halved: the hash of one mixes those of two shorter ones that cover it."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    g, have = mix(h + _ODD[1]), 1
    while have < k:
        step = min(have, k - have)
        a, b = g[: len(g) - step], g[step:]
        g = mix(a * _ODD[0] + ((b << np.uint64(32)) | (b >> np.uint64(32))))
        have += step
    return g


def sequence_name(h: tuple[np.ndarray, np.ndarray], a: int, z: int) -> tuple[int, int]:
    """128 bits, as two signed numbers, of the words a to z, given their hashes in both lanes."""
    raw = hashlib.blake2b(h[0][a:z].tobytes() + h[1][a:z].tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def gram_valid(words: Words, k: int) -> np.ndarray:
    """For each word position: does a run of k words start here within its text?"""
    ends = np.repeat(words.ptr[1:], words.n)
    return np.arange(len(words)) + k <= ends


def give_back() -> None:
    """Returns freed memory to the system; a worker that waits for its next task would keep it."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def batches(it, rows_bytes: int = 2 << 20, column: str = "text"):
    """Cuts record batches into slices of about rows_bytes of text (one row at least)."""
    for batch in it:
        col = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        cut = (np.cumsum(col) // rows_bytes).astype(np.int64)
        edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), batch.num_rows]
        for a, z in zip(edges, edges[1:]):
            if z > a:
                yield batch.slice(a, z - a)
    give_back()
