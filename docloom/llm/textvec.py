"""Vectorised splitting and hashing of UTF-8 texts in Arrow batches.

A batch of texts is one byte buffer with offsets. Tokens are runs of bytes of one class, their hashes are differences of
a prefix sum of byte * P**i (mod 2**64) brought to a common power, then mixed. No Python object is made per token.

A polynomial modulo 2**64 gives structured strings (Thue-Morse words and their complements) of some hundred bytes one
value, whatever its base. So spans of over PLAIN bytes, which are few, are hashed by BLAKE2b instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes up to which a span is hashed by its polynomial.
PLAIN = 32

#: Bytes of text that are split at once; a longer single text is one slice of its own.
SLICE_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: 0 white space, 1 letters, digits, underscore and all non-ASCII, 2 the rest.
WORD_PUNCT = np.full(256, 2, np.uint8)
WORD_PUNCT[SPACE] = 0
WORD_PUNCT[48:58] = WORD_PUNCT[65:91] = WORD_PUNCT[97:123] = WORD_PUNCT[95] = 1
WORD_PUNCT[128:] = 1


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i up to n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 2 * len(_powers[0]))
        for k, base in enumerate((_P, _P_INV)):
            grown = np.full(size, base, np.uint64)
            grown[0] = 1
            _powers[k] = np.multiply.accumulate(grown)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """s with s[j] - s[i] = sum of (byte + 1) * P**k for k from i to j - 1."""
    p, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=out[1:])
    return out


def short_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes by the polynomial alone: for short spans, or where equal hashes are confirmed by other means."""
    _, inv = powers(len(sums))
    return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64))


def span_hashes(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    out = short_hashes(prefix_sums(body), start, end)
    long = np.flatnonzero(end - start > PLAIN)
    if len(long):
        raw = memoryview(np.ascontiguousarray(body))
        made = b"".join([hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(start[long].tolist(), end[long].tolist())])
        out[long] = np.frombuffer(made, np.uint64)
    return out


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) and n + 1 offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[off[0] : off[-1]], off - off[0]


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of pieces of about SLICE_BYTES, whole texts each."""
    body, off = buffers(texts)
    row, n = 0, len(off) - 1
    while row < n:
        end = int(np.searchsorted(off, off[row] + SLICE_BYTES, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, body[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def runs(classes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of maximal runs of equal nonzero class; no run crosses a row."""
    n = len(classes)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    cut = np.ones(n + 1, bool)
    cut[1:n] = classes[1:] != classes[:-1]
    cut[off] = True
    at = np.flatnonzero(cut)
    start, end = at[:-1], at[1:]
    keep = classes[start] != 0
    start, end = start[keep], end[keep]
    return start, end, np.searchsorted(off, start, side="right") - 1


def shingles(word_hash: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the k-word shingles of every row; a row with fewer words, but any, gives its whole sequence."""
    n = len(word_hash)
    counts = np.bincount(row, minlength=n_rows)
    made, rows = np.zeros(max(0, n - k + 1), np.uint64), row[: max(0, n - k + 1)]
    for j in range(k):
        made = made * np.uint64(0xD6E8FEB86659FD93) + word_hash[j : n - k + 1 + j] if n >= k else made
    if n >= k:
        same = row[: n - k + 1] == row[k - 1 :]
        made, rows = mix(made[same]), rows[same]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.searchsorted(row, short)
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = counts[short] > j
            extra[has] = extra[has] * np.uint64(0xD6E8FEB86659FD93) + word_hash[first[has] + j]
        extra = mix(extra ^ (counts[short].astype(np.uint64) << np.uint64(56)))
        made, rows = np.concatenate([made, extra]), np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        made, rows = made[order], rows[order]
    return made, rows
