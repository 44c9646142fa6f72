"""Vectorised views of text columns: byte slices, word spans and rolling hashes in numpy.

Every operator of this package that leaves the JVM works on Arrow batches.  A batch
of strings already is one contiguous UTF-8 buffer plus offsets, so words, lines and
n-grams of all its documents are found by a handful of array operations, without a
Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; bounds the temporaries (about 60 bytes per byte).
SLICE_BYTES = 1 << 20
#: The prime modulus of span hashes, and their base.
PRIME = np.uint64((1 << 61) - 1)
_ROOT = 0x1B0E5D3C7A94F268 % ((1 << 61) - 1)
#: Bytes of a span whose sums can't overflow.
_LONG = 1 << 22
_BASE = np.uint64(0x9E3779B97F4A7C13)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C13, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_roots: list[np.ndarray] = [np.ones(1, np.uint32), np.zeros(1, np.uint32), np.ones(1, np.uint64)]

#: ``[^\x20\x09-\x0D]``
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
ALNUM_ANY_CASE = ALNUM.copy()
ALNUM_ANY_CASE[65:91] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240607)
#: A random odd 64-bit value for each byte, for the hashes of short windows.
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: What a byte counts in a span hash, and the same with A-Z folded to a-z.
BYTE_CODES = np.arange(1, 257, dtype=np.uint64)
LOWER_CODES = BYTE_CODES[LOWER]


def modest_batches(spark) -> None:
    """Fewer rows per Arrow batch, as rows hold whole texts; a number that someone has chosen stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "2000")


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets (one more than rows); null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    low, high = int(offsets[0]), int(offsets[-1])
    values = np.frombuffer(data, np.uint8)[low:high] if data is not None and high > low else np.zeros(0, np.uint8)
    return values, offsets - low


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches of about ``most`` bytes of text (one row at least), each with its bytes and offsets."""
    for batch in batches:
        at, n = 0, batch.num_rows
        if not n:
            continue
        _, offsets = strings(batch.column(column))
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            part = batch.slice(at, to - at)
            yield part, *strings(part.column(column))
            at = to


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that don't cross rows: starts, ends, and for each row the index of its first run (one more than rows)."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    begin[first] = inside[first]
    end[last] = inside[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def line_spans(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""Starts and ends of the ``\n``-separated lines, and each row's first line; an empty row has one empty line."""
    breaks = np.flatnonzero(values == 10)
    row = np.searchsorted(offsets, breaks, "right") - 1
    counts = np.bincount(row, minlength=len(offsets) - 1) + 1 if len(offsets) > 1 else np.zeros(0, np.int64)
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    starts, ends = np.empty(bounds[-1], np.int64), np.empty(bounds[-1], np.int64)
    opening = np.zeros(bounds[-1], bool)
    opening[bounds[:-1]] = True
    starts[opening], starts[~opening] = offsets[:-1], breaks + 1
    closing = np.zeros(bounds[-1], bool)
    closing[bounds[1:] - 1] = True
    ends[closing], ends[~closing] = offsets[1:], breaks
    return starts, ends, bounds


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, SLICE_BYTES + (SLICE_BYTES >> 2))
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _fold(x: np.ndarray) -> np.ndarray:
    """64-bit values modulo PRIME."""
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of values below it."""
    half, low = np.uint64(31), np.uint64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    middle = a1 * b0 + a0 * b1
    return _fold(_fold((a1 * b1 << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << half)) + _fold(a0 * b0))


def _root_powers(n: int) -> list[np.ndarray]:
    """Powers of the base as low 32 and high bits, and powers of its inverse; at least n of each."""
    if len(_roots[2]) < n:
        n = max(n, SLICE_BYTES + (SLICE_BYTES >> 2))
        found = []
        for base in (_ROOT, pow(_ROOT, -1, int(PRIME))):
            x = np.ones(n, np.uint64)
            at = 1
            while at < n:
                step = np.uint64(pow(base, at, int(PRIME)))
                x[at : 2 * at] = _times(x[: min(at, n - at)], step)
                at *= 2
            found.append(x)
        _roots[:] = (found[0] & np.uint64(0xFFFFFFFF)).astype(np.uint32), (found[0] >> np.uint64(32)).astype(np.uint32), found[1]
    return _roots


def prefix_hash(values: np.ndarray, codes: np.ndarray = BYTE_CODES) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial sums (of the powers' low and high bits) from which ``span_hash`` takes the hash of any span."""
    low, high, _ = _root_powers(len(values) + 1)
    code = codes[values]
    sums = np.zeros((2, len(values) + 1), np.uint64)
    np.cumsum(code * low[: len(values)], out=sums[0, 1:])
    np.cumsum(code * high[: len(values)], out=sums[1, 1:])
    return sums[0], sums[1]


def span_hash(sums: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans, a polynomial in a fixed random point modulo 2**61 - 1, mixed with the length.

    Equal content gives equal hashes wherever it stands; two different spans of n bytes clash with a
    probability of at most n / 2**61 over the choice of the point, however regular they are.
    """
    low, high = sums
    back = _root_powers(len(low))[2]

    def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        up = _fold(high[b] - high[a])
        return _fold(_fold(low[b] - low[a]) + ((up << np.uint64(32) & PRIME) | up >> np.uint64(29)))

    total = between(starts, np.minimum(ends, starts + _LONG))
    for k in np.flatnonzero(ends - starts > _LONG):  # each of them is megabytes
        cuts = np.append(np.arange(starts[k] + _LONG, ends[k], _LONG), ends[k])
        rest = int(sum(int(x) for x in between(cuts[:-1], cuts[1:])) % int(PRIME))
        total[k] = (int(total[k]) + rest) % int(PRIME)
    return mix(_times(total, back[starts]) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_sums(values: np.ndarray) -> np.ndarray:
    """Running sums for ``window_hash``, modulo 2**64: cheaper than ``prefix_hash``, for windows of some dozens of bytes only."""
    forward, _ = _power(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[values] * forward[: len(values)], out=sums[1:])
    return sums


def window_hash(sums: np.ndarray, at: np.ndarray, size: np.ndarray, since: np.ndarray) -> np.ndarray:
    """Hashes of windows at ``at``, where several runs of sums stand in one array; ``since`` bytes after their run's start."""
    _, back = _power(int(since.max(initial=0)) + 1)
    return mix((sums[at + size] - sums[at]) * back[since] + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ngram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n consecutive word hashes (len(words) - n + 1 of them, row borders not observed)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * _BASE + words[k : k + len(out)]
    return mix(out)


def in_one_row(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of the windows of n items starting at 0, 1, ... lie within one row; ``first``: rows' first items."""
    ok = np.ones(max(0, total - n + 1), bool)
    for back in range(1, n):
        at = first[1:-1] - back
        at = at[(at >= 0) & (at < len(ok))]
        ok[at] = False
    return ok


def row_of(first: np.ndarray) -> np.ndarray:
    """For each item the row that it belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sums_by_row(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur at least twice."""
    ordered = np.sort(keys)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(again, keys)
    at[at == len(again)] = 0
    return again[at] == keys


def cover(marks: np.ndarray, n: int, total: int) -> np.ndarray:
    """Items covered by any marked window of n items."""
    steps = np.zeros(total + 1, np.int32)
    at = np.flatnonzero(marks)
    np.add.at(steps, at, 1) if len(at) < 64 else np.add(steps, np.bincount(at, minlength=total + 1), out=steps, casting="unsafe")
    stop = np.bincount(np.minimum(at + n, total), minlength=total + 1)
    return np.cumsum(steps - stop)[:total] > 0
