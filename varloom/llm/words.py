"""Words of texts as arrays: positions, hashes, and hashes of runs of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

# The white space that separates words.
SPACES = b" \t\n\x0b\x0c\r"
#: Texts are handled in pieces of about so many bytes, cut between words.
PIECE = 1 << 19
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
BYTE = np.random.default_rng(711).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_tables: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            t = np.full(n, base, np.uint64)
            t[0] = 1
            _tables[name] = np.multiply.accumulate(t)
    return _tables["up"][:n], _tables["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of `data` (bytes)."""
    edge = np.diff(np.r_[True, _IS_SPACE[data], True].astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def _hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word: a polynomial in its bytes."""
    starts, ends = spans(data)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * up[:-1], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return starts, mix(h ^ (ends - starts).astype(np.uint64))


def hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word, piece by piece; equal words have equal hashes."""
    if len(data) <= PIECE:
        return _hash(data)
    found, at = [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        if end < len(data):
            cut = np.flatnonzero(_IS_SPACE[data[at:end]])
            if len(cut):
                end = at + int(cut[-1]) + 1
            else:  # one word longer than a piece
                while end < len(data) and not len(cut := np.flatnonzero(_IS_SPACE[data[end : end + PIECE]])):
                    end = min(end + PIECE, len(data))
                if end < len(data):
                    end += int(cut[0])
                h = xxhash.xxh3_64_intdigest(data[at:end])
                found.append((np.array([at]), np.array([h], np.uint64)))
                at = end
                continue
        starts, h = _hash(data[at:end])
        found.append((starts + at, h))
        at = end
    return tuple(map(np.concatenate, zip(*found)))


def windows(h: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of every run of `size` values; none if there are fewer."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, block, width, power = None, 0, h, 1, base | 1
    step = power
    while True:
        if size & width:
            part = block[done : done + n]
            out = part.copy() if out is None else out + part * np.uint64(pow(power, done, 1 << 64))
            done += width
        if done == size:
            return mix(out)
        block = block[:-width] + block[width:] * np.uint64(step)
        step = step * step & _MASK
        width *= 2


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column, in place; a null is empty."""
    kind = column.type
    column = column.cast(pa.large_binary()) if pa.types.is_string(kind) or pa.types.is_binary(kind) else column
    if column.null_count:
        column = column.fill_null(b"")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def groups(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `size` bytes each; a longer row is alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)
