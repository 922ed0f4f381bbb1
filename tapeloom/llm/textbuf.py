"""Arrow string columns as flat byte buffers, and words in them as offset and hash arrays.

Everything here works on whole texts; a slice only groups whole rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def flat(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array without nulls: null texts become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    return column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and the row offsets into them."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(column: pa.Array | pa.ChunkedArray, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of whole rows of about max_bytes; a longer row is a run of its own."""
    data, offs = buffers(flat(column))
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def pieces(data: np.ndarray, offs: np.ndarray, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """Like `slices`, but a row longer than max_bytes comes in parts, each cut before white space, so that no word is parted.

    The last value says whether the rows end here.
    """
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1)
        at, end = int(offs[lo]), int(offs[hi])
        if end - at <= max_bytes:
            yield lo, hi, data[at:end], offs[lo : hi + 1] - at, True
        else:
            while at < end:
                cut = min(end, at + max_bytes)
                while cut < end and not SPACE[data[cut]]:
                    ahead = np.flatnonzero(SPACE[data[cut : min(end, cut + 4096)]])
                    cut = cut + int(ahead[0]) if len(ahead) else min(end, cut + 4096)
                yield lo, hi, data[at:cut], np.array([0, cut - at]), cut == end
                at = cut
        lo = hi


def _grow(n: int) -> None:
    """Powers of an odd multiplier and of its inverse modulo 2**64."""
    global _POW, _INV
    if len(_POW) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for name, base in (("_POW", _P), ("_INV", pow(_P, -1, 1 << 64))):
            out, have = np.ones(size, np.uint64), 1
            while have < size:
                step = np.uint64(pow(base, have, 1 << 64))
                out[have : 2 * have] = out[:have] * step
                have *= 2
            globals()[name] = out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(30))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], from one running sum over the buffer."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    _grow(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _POW[: len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * _INV[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offs: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words (runs of bytes that are not `apart`: other than ASCII white space) of each row."""
    ink = ~apart[data]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    full = np.flatnonzero(np.diff(offs))
    first[offs[full]] = ink[offs[full]]
    last[offs[full + 1] - 1] = ink[offs[full + 1] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    rows = np.searchsorted(offs, starts, "right") - 1
    return starts, ends, rows
