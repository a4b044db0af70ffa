"""Vectorised text kernel: words and hashes of whole Arrow string columns.

Every function works on the UTF-8 bytes of a column inside one Spark task. Bytes
are taken in blocks of bounded size (cut between words), so that the temporary
arrays stay small whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(29))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=U64)
    out[1:] = base
    return np.multiply.accumulate(out)


class _Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = _powers(_BASE, 1 << 12)
        self.down = _powers(_INVERSE, 1 << 12)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            self.up, self.down = _powers(_BASE, size), _powers(_INVERSE, size)
        return self.up, self.down


_POWERS = _Powers()


class Words:
    """What counts as a word byte, and how bytes are folded before hashing."""

    def __init__(self, is_word: np.ndarray, lower: bool) -> None:
        self.is_word = is_word
        code = np.arange(256)
        if lower:
            code[65:91] += 32
        self.values = mix(code.astype(U64) + U64(0x1000))


def _mask(bytes_: list[int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[bytes_] = True
    return out


_SPACE = [0x20, *range(0x09, 0x0E)]
#: [^\x20\x09-\x0D]+ with A-Z lower-cased, and as written.
BLANK_LOWER = Words(~_mask(_SPACE), True)
BLANK = Words(~_mask(_SPACE), False)
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z: digits, letters, all bytes from 0x80.
ALNUM_LOWER = Words(_mask([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]), True)
#: Lines: everything between line feeds.
LINES = Words(~_mask([0x0A]), False)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, length n + 1) and bytes of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def blocks(at: np.ndarray, raw: np.ndarray, is_word: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Byte ranges of about `limit`, cut where a text starts or at a byte outside words."""
    lo, n = 0, len(raw)
    while lo < n:
        hi = min(n, lo + limit)
        if hi < n:
            k = int(np.searchsorted(at, hi, side="right")) - 1
            if at[k] > lo:
                hi = int(at[k])
            else:
                cut = np.flatnonzero(~is_word[raw[lo:hi]])
                if len(cut):
                    hi = lo + int(cut[-1]) + 1
                else:
                    end = int(at[min(k + 1, len(at) - 1)])
                    while hi < end and is_word[raw[hi]]:
                        ahead = np.flatnonzero(~is_word[raw[hi : min(end, hi + limit)]])
                        hi = hi + int(ahead[0]) if len(ahead) else min(end, hi + limit)
        yield lo, hi
        lo = hi


def spans(at: np.ndarray, raw: np.ndarray, words: Words, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (within the block lo..hi) of its words; words never cross texts."""
    inside = words.is_word[raw[lo:hi]]
    begins = np.zeros(hi - lo + 1, dtype=bool)
    k0, k1 = np.searchsorted(at, lo, side="left"), np.searchsorted(at, hi, side="right")
    begins[at[k0:k1] - lo] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | begins[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | begins[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _hash(raw: np.ndarray, words: Words, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _POWERS.get(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=U64)
    np.cumsum(words.values[raw] * up[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U64))


def word_hashes(at: np.ndarray, raw: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word offsets by text (length n + 1) and the 64-bit hashes of all words in order."""
    hashes, starts = [], []
    for lo, hi in blocks(at, raw, words.is_word):
        start, end = spans(at, raw, words, lo, hi)
        hashes.append(_hash(raw[lo:hi], words, start, end))
        starts.append(start + lo)
    if not hashes:
        return np.zeros(len(at), dtype=np.int64), np.zeros(0, dtype=U64)
    where = np.concatenate(starts)
    return np.searchsorted(where, at, side="left"), np.concatenate(hashes)


def hash_text(text: str, words: Words) -> list[int]:
    """Hashes of one text's words, for small inputs."""
    at, raw = buffers(pa.array([text], pa.string()))
    return word_hashes(at, raw, words)[1].tolist()


_RUN = mix(np.arange(1, 65, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of `size` hashes; run i starts at word i. Texts are not told apart here."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = hashes[:n] * _RUN[0]
    for i in range(1, size):
        out = out + hashes[i : i + n] * _RUN[i % 64]
    return mix(out + U64(size))


def window_hash(hashes: np.ndarray) -> int:
    """The hash that windows() gives to this whole run."""
    return int(windows(np.asarray(hashes, dtype=U64), len(hashes))[0])


def set_digest(values: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set of values only, as two signed longs."""
    with np.errstate(over="ignore"):
        a = np.add.reduce(mix(values ^ U64(0x243F6A8885A308D3)))
        b = np.add.reduce(mix(values + U64(0x13198A2E03707344)))
    return int(np.int64(a.astype(np.int64))), int(np.int64(b.astype(np.int64)))


def doc_index(at: np.ndarray) -> np.ndarray:
    """For offsets, the text that each element belongs to."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))
