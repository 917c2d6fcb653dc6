"""Words of a text column as numpy arrays.

Arrow hands a text column over as one run of UTF-8 bytes with row offsets. Words, lines and windows are found on those
bytes for many rows at once, without a Python object per word. Work goes through slices of about ``SLICE`` bytes, so
memory follows the slice, or the longest single text.

Hashes of bytes are sums of scrambled lanes of eight bytes, each keyed by its place in the run. Hashes of windows of words are
polynomials modulo 2**64 over these, taken from prefix sums (the Rabin-Karp form), then mixed. Such polynomials are blind to
Thue-Morse sequences of 1,024 values and more, so they are taken of at most ``PLAIN`` words, wider windows are chained from
such, and bytes never go through them. Two independent hashes are kept where equality decides anything across documents:
unequal runs agree in both with probability 2**-128 as long as nobody searches for collisions of these very constants.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
BLOCK = 1 << 18
PLAIN = 64

_U = np.uint64
BASES = (_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93))
WORD_BASES = (_U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB))

_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
IS_NEWLINE = np.zeros(256, bool)
IS_NEWLINE[10] = True
AS_IS = np.arange(256, dtype=np.uint8)
LOWER = AS_IS.copy()
LOWER[65:91] += 32

_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base modulo 2**64, and their inverses."""
    size = max(1 << 12, 1 << int(n - 1).bit_length()) if n > 1 else 1 << 12
    key = (int(base), size)
    if key not in _powers:
        inverse = pow(int(base), -1, 1 << 64)
        both = []
        for b in (int(base), inverse):
            steps = np.full(size, _U(b))
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        if size > 1 << 20:
            return both[0], both[1]
        _powers[key] = (both[0], both[1])
    return _powers[key]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finisher)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums with a leading zero."""
    out = np.empty(len(values) + 1, values.dtype)
    out[0] = 0
    np.cumsum(values, out=out[1:])
    return out


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and row offsets of a text column; nulls count as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64)


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``limit`` bytes: first row, end row, bytes, offsets from 0."""
    data, offsets = text_buffers(column)
    row, rows = 0, len(column)
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, rows)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def spans(space: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not ``space``; a run never goes past a position in ``breaks``."""
    n = len(space)
    word = ~space
    start, end = word.copy(), word.copy()
    start[1:] &= space[:-1]
    end[:-1] &= space[1:]
    inner = breaks[(breaks > 0) & (breaks < n)]
    start[inner] = word[inner]
    end[inner - 1] = word[inner - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, bases=BASES) -> list[np.ndarray]:
    """One hash per base of ``values[start:end]`` (unsigned 64-bit values, a few)."""
    out = []
    for base in bases:
        up, down = powers(base, len(values) + 1)
        sums = prefix(values * up[: len(values)])
        h = (sums[ends] - sums[starts]) * down[starts]
        out.append(mixed(h + (ends - starts).astype(np.uint64) * _U(0x2545F4914F6CDD1D)))
    return out


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bases=BASES) -> list[np.ndarray]:
    """One hash per base of the bytes ``data[start:end]``, of any length."""
    sizes = ends - starts
    lanes = (sizes + 7) >> 3
    first = prefix(lanes)
    place = np.arange(first[-1]) - np.repeat(first[:-1], lanes)
    at = np.repeat(starts, lanes) + 8 * place
    left = np.repeat(ends, lanes) - at
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, np.dtype("<u8"), padded, 0, (1,))[at] & _LOW_BYTES[np.minimum(left, 8)]
    place = place.astype(np.uint64) + _U(1)
    out = []
    for base in bases:
        # Twice scrambled: with one round two lanes could trade a difference that the scrambling carries over unchanged.
        sums = prefix(mixed(mixed(eights ^ (place * base)) + base))
        out.append(mixed(sums[first[1:]] - sums[first[:-1]] + sizes.astype(np.uint64) * _U(0x2545F4914F6CDD1D)))
    return out


class Words:
    """The words of some texts: byte bounds, word offsets per text and hashes. With another ``gap``, lines or the like."""

    def __init__(self, data, offsets: np.ndarray, fold: np.ndarray = AS_IS, hashes: int = 2, gap: np.ndarray = IS_SPACE):
        found = list(_run_blocks(data, offsets, fold, BASES[:hashes], gap))
        join = lambda k, kind: np.concatenate([f[k] for f in found]) if found else np.zeros(0, kind)
        self.starts, self.ends = join(0, np.int64), join(1, np.int64)
        self.hashes = [join(2 + k, np.uint64) for k in range(hashes)]
        self.offsets = np.searchsorted(self.starts, offsets)
        self.rows = np.repeat(np.arange(len(offsets) - 1), np.diff(self.offsets))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def windows(self, size: int, bases=WORD_BASES) -> tuple[np.ndarray, list[np.ndarray]]:
        """Start (as a word number) and hashes of every window of ``size`` words that lies in one text."""
        n = len(self.starts)
        if n < size:
            return np.zeros(0, np.int64), [np.zeros(0, np.uint64) for _ in bases]
        at = np.flatnonzero(self.rows[: n - size + 1] == self.rows[size - 1 :])
        return at, [window_hashes(values, size, base)[at] for values, base in zip(self.hashes, bases)]


def window_hashes(values: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """The hash of every ``size`` neighbouring values, whatever text they belong to."""
    n = len(values)
    if size > PLAIN:
        parts = window_hashes(values, PLAIN, base)
        out = np.zeros(max(0, n - size + 1), np.uint64)
        for k in [*range(0, size - PLAIN, PLAIN), size - PLAIN]:
            out = mixed(out * base ^ parts[k : k + len(out)])
        return out
    up, down = powers(base, n + 1)
    sums = prefix(values * up[:n])
    return mixed((sums[size:] - sums[: n - size + 1]) * down[: n - size + 1])


def _run_blocks(data, offsets, fold, bases, gap):
    """Runs block by block, so that the wide arrays stay small even for one very long text."""
    at, n = 0, len(data)
    while at < n:
        stop = min(at + BLOCK, n)
        while stop < n:
            gaps = np.flatnonzero(gap[data[at:stop]])
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
                break
            stop = min(at + 2 * (stop - at), n)
        part = data[at:stop]
        lo, hi = np.searchsorted(offsets, (at, stop))
        starts, ends = spans(gap[part], offsets[lo:hi] - at)
        yield (starts + at, ends + at, *(byte_hashes(fold[part], starts, ends, bases) if bases else ()))
        at = stop


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` neighbours."""
    out, width = values, 1
    while width * 2 <= size:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = size - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between consecutive offsets."""
    return np.diff(prefix(flags.astype(np.int64))[offsets])


def repeated(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which keys occur more than once within their row."""
    keys = mixed(keys ^ (rows.astype(np.uint64) * BASES[0]))
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def later_copies(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which keys equal an earlier one of their row."""
    keys = mixed(keys ^ (rows.astype(np.uint64) * BASES[0]))
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    out[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return out


def covered(at: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in one of the runs of ``size`` that begin at ``at`` (distinct)."""
    steps = np.zeros(n + 1, np.int64)
    steps[at] += 1
    steps[at + size] -= 1
    return np.cumsum(steps[:-1]) > 0


class PieceBytes:
    """Pieces of a byte array, read eight bytes at a time."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self._eights = np.ndarray(len(data) + 1, np.dtype("<u8"), padded, 0, (1,))
        self.starts, self.sizes = starts, sizes

    def eight(self, k: int, which: np.ndarray) -> np.ndarray:
        """Bytes ``8 k`` to ``8 k + 7`` of the pieces ``which``, which must be longer than ``8 k``; zeros beyond their end."""
        return self._eights[self.starts[which] + 8 * k] & _LOW_BYTES[np.minimum(self.sizes[which] - 8 * k, 8)]

    def taken(self, which: np.ndarray) -> "PieceBytes":
        out = copy(self)
        out.starts, out.sizes = self.starts[which], self.sizes[which]
        return out

    def hashes(self, reach: int | None = None) -> np.ndarray:
        """A hash of each piece: of its length and its bytes, or of the first ``reach`` of them (a multiple of 8)."""
        out = mixed(self.sizes.astype(np.uint64))
        which, k = np.flatnonzero(self.sizes), 0
        while len(which) and k * 8 != reach:
            out[which] = mixed(out[which] ^ self.eight(k, which))
            k += 1
            which = which[self.sizes[which] > 8 * k]
        return out
