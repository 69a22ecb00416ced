"""Vectorised text helpers shared by the operators that work inside tasks.

Texts reach a task as Arrow batches. They are handled in slices of a few
megabytes, so memory does not depend on the batch; within a slice, words are
found and hashed on the UTF-8 bytes at once. No text is cut: a longer text is
a slice of its own, and hashing runs over it in pieces that end at blanks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2_000_000
PIECE_BYTES = 1 << 18

_SEED = np.random.default_rng(20240501)
_BYTE_CODE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []

BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _power_table(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [_power_table(_BASE, n), _power_table(_BASE_INVERSE, n)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of the code sequence (wrapping uint64 codes)."""
    up, down = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Words of some texts: byte spans in ``data``, text index and hash of each."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # first word of each text, and the total at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column (null: empty) and the offsets of its texts."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Maximal runs of other bytes than blank, tab, LF, VT, FF and CR."""
    blank = np.frombuffer(data.tobytes().translate(BLANK.tobytes()), bool)
    edge = np.empty(len(data) + 1, np.int8)
    if len(data):
        edge[0] = not blank[0]
        edge[1:-1] = blank[:-1].view(np.int8) - blank[1:].view(np.int8)
        edge[-1] = -1 if not blank[-1] else 0
    else:
        edge[0] = 0
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    if len(inner):  # a word may not reach over the border of two texts
        cut = np.unique(inner[~blank[inner] & ~blank[inner - 1]])
        if len(cut):
            start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    first = np.searchsorted(start, offsets).astype(np.int64)
    first[-1] = len(start)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    codes = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(start, start[at] + PIECE_BYTES)))
        low, high = start[at], end[stop - 1]
        codes[at:stop] = span_hashes(np.take(_BYTE_CODE, data[low:high]), start[at:stop] - low, end[at:stop] - low)
        at = stop
    return Words(data, offsets, start, end, doc, codes, first)


def slices(batch: pa.RecordBatch | pa.Table, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows with at most ``limit`` bytes of text (a
    longer text alone); yields rows, bytes and offsets."""
    data, offsets = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, stop - at), data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at]
        at = stop


def text_at(data: np.ndarray, low: int, high: int) -> str:
    return data[low:high].tobytes().decode("utf-8", "replace")


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values between consecutive borders."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of values[start : start + length] for each pair."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return values[shift + np.arange(total)]


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of equal keys of a stream sorted by them, one at a time; a group
    may reach over several batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for key in keys:
            values = batch.column(key).to_numpy(zero_copy_only=False)
            change[1:] |= values[1:] != values[:-1]
        borders = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for low, high in zip(borders[:-1], borders[1:], strict=True):
            key = tuple(batch.column(k)[low].as_py() for k in keys)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
            last = key
    if held:
        yield pa.Table.from_batches(held)
