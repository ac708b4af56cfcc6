"""Vectorised views of a column of texts: numpy over Arrow's byte buffers, no loop over rows.

Texts are UTF-8 bytes throughout. A batch is cut at document boundaries into chunks of about ``CHUNK`` bytes, so the
arrays of a step stay in the processor's cache; a text longer than that is a chunk of its own and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CACHE: dict = {}


def byte_lut(lower: bool = True, keep_digits: bool = True) -> np.ndarray:
    """Maps bytes to lower-case ASCII letters, digits and the bytes of other scripts; all else becomes a space."""
    t = np.full(256, 32, np.uint8)
    for c in range(256):
        if c >= 128 or chr(c).isalpha():
            t[c] = c + 32 if lower and 65 <= c <= 90 else c
        elif chr(c).isdigit():
            t[c] = c if keep_digits else 32
    return t


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets. A null is an empty text."""
    if col.null_count:
        col = col.fill_null("")
    large = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(col: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of each chunk."""
    if not len(col):
        return
    raw, offs = buffers(col)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
        yield at, to, raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser over 64 bits (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _CACHE or len(_CACHE["p"][0]) < n:
        size = max(n, CHUNK + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            both = []
            for b in (_BASE, inverse):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                both.append(np.cumprod(p, dtype=np.uint64))
        _CACHE["p"] = tuple(both)
    return _CACHE["p"]


def words(raw: np.ndarray, offs: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a chunk, in order, and n + 1 offsets of the documents among them.

    A word is a run of bytes that ``lut`` doesn't map to a space. Its hash is a difference of prefix sums of a
    polynomial, mixed; no word is cut out.
    """
    n = len(offs) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    b = lut[raw]
    inside = b != 32
    before = np.empty(len(b), bool)
    before[0] = False
    before[1:] = inside[:-1]
    begins = offs[:-1][offs[:-1] < len(b)]
    before[begins] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(b), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[begins[begins > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    power, inverse = _powers(len(b) + 1)
    sums = np.empty(len(b) + 1, np.uint64)
    sums[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(b.astype(np.uint64) * power[: len(b)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    return hashes, np.searchsorted(starts, offs).astype(np.int64)


def doc_of(offs: np.ndarray) -> np.ndarray:
    """The document's number for each item between the offsets."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def char_ngrams(raw: np.ndarray, offs: np.ndarray, n: int, bits: int, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams that lie in one word with at most its neighbouring space, and their positions.

    The caller puts a space around every text, so that words at its ends count like others and no n-gram spans two
    documents. Position p belongs to the document whose offsets enclose it.
    """
    if len(raw) < n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    b = lut[raw]
    m = len(b) - n + 1
    gap = b == 32
    ok = ~gap[1 : 1 + m] if n > 2 else ~(gap[:m] & gap[1 : 1 + m])
    for i in range(2, n - 1):
        ok &= ~gap[i : i + m]
    at = np.flatnonzero(ok)
    with np.errstate(over="ignore"):
        h = np.full(len(at), n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for i in range(n):
            h = (h ^ b[i:][at]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h >>= np.uint32(32 - bits)
    return h, at


def sum_by_doc(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of the values between the offsets; 0 for an empty range."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]
