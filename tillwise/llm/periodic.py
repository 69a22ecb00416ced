"""Periodic runs of words: maximal stretches that repeat a period four times or more.

A run is a stretch of consecutive words whose smallest period is q (words q
apart are equal), of at least ``max(least_length, exponent * q)`` words, that no
neighbouring word extends with the same period.

Texts of a slice are laid end to end, longest first, as one sequence of exact
word numbers that differ between texts. At the dyadic scale L the sequence is
cut into blocks of L words, and periods from L to 2L - 1 are looked for:

1. Block convolution. The sum of squared differences between a block and each
   place of the window behind it is ``sum(T^2) - 2 sum(T P) + sum(P^2)``; the
   middle term is a cyclic correlation, taken exactly by number-theoretic
   transforms modulo 65537. A window spans two blocks, so its transform is the
   sum of theirs, the second with alternating signs. Where the sum is zero, the
   block may recur without a mismatch (a true recurrence always gives zero).
   Transforms are at most 65536 long: of a longer block the first 32768 words
   are the pattern, and the window behind is visited in steps of that length.
2. Seeds. A run of period q holds at least two blocks in a row that recur at
   distance q. Only such chains of blocks at one distance are followed, and not
   those inside a known run whose period divides the distance: two runs of
   periods under L share fewer than 2L words, so at most one known run covers
   the first two blocks of a chain, and a search over run ends finds it.
3. Extension. The words around a chain are compared one to one. The chain
   reaches less than a block further on both sides, so the work is linear in
   its length, and accidental zeros of the first step fall out here.

A text is never cut; the work for n words is n log(n)^2. Texts are told apart by
rows, so ids may be null or repeated. Null and empty texts and texts of blanks
have no runs and collapse to the empty string. An empty table gives an empty
result. Other columns are not read, unless they are asked for with ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tillwise.llm import text as tx

PRIME = 65537  # fixed: 2**16 + 1, where 3 generates all units
GENERATOR = 3
LONGEST = 1 << 15  # longest pattern: transforms have twice its length
CELLS = 1 << 18  # numbers a transform works on at a time


@dataclass(frozen=True)
class Params:
    least_length: int = 6
    exponent: int = 4  # periods a run holds at least; 4 or more


def _fold(x: np.ndarray) -> np.ndarray:
    """Congruent numbers of few bits: 2**16 is -1 modulo the prime."""
    return (x & 0xFFFF) - (x >> 16)


@cache
def _twiddles(size: int, inverse: bool) -> np.ndarray:
    """The first half of the powers of a root of unity of the given order."""
    root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
    if inverse:
        root = pow(root, -1, PRIME)
    out = np.ones(max(1, size // 2), np.int64)
    for k in range(1, len(out)):
        out[k] = out[k - 1] * root % PRIME
    return out


def transform(x: np.ndarray) -> np.ndarray:
    """Transform along the first axis (a power of two), result in bit-reversed order."""
    size, width = x.shape
    step = size // 2
    while step:
        halves = x.reshape(-1, 2, step, width)
        low, high = halves[:, 0], halves[:, 1]
        turned = (low - high) * _twiddles(2 * step, False)[None, :, None]
        x = np.stack([_fold(low + high), _fold(turned)], axis=1).reshape(size, width)
        step //= 2
    return x


def inverse_transform(x: np.ndarray) -> np.ndarray:
    """Undo ``transform`` but for the factor ``size``."""
    size, width = x.shape
    step = 1
    while step < size:
        halves = x.reshape(-1, 2, step, width)
        low, high = halves[:, 0], _fold(halves[:, 1] * _twiddles(2 * step, True)[None, :, None])
        x = np.stack([_fold(low + high), _fold(low - high)], axis=1).reshape(size, width)
        step *= 2
    return x


@cache
def _negated(size: int) -> np.ndarray:
    """Where the transform at the negative frequency lies, in bit-reversed order."""
    bits = size.bit_length() - 1
    place = np.arange(size)
    reverse = np.zeros(size, np.int64)
    for k in range(bits):
        reverse |= ((place >> k) & 1) << (bits - 1 - k)
    return reverse[-reverse % size]


def recurrences(codes: np.ndarray, length: int, pattern: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks (by start) and the distances in [length, 2 * length) where their
    first ``pattern`` words may recur: all true recurrences, few others.

    ``codes``: numbers in [0, 65537), a multiple of ``length`` of them. A place
    behind the end holds the code 0.
    """
    blocks = len(codes) // length
    found_at, found_distance = [], []
    per_turn = max(1, CELLS // (2 * pattern))
    steps = length // pattern
    sign = np.ones((2 * pattern, 1), np.int64)
    sign[pattern:] = -1  # odd frequencies lie in the second half
    padded = np.concatenate([codes, np.zeros(2 * length + pattern, np.int64)])
    squares = np.concatenate([[0], np.cumsum(padded * padded)])
    spread = lambda starts: padded[starts[None, :] + np.arange(pattern)[:, None]]

    def transformed(starts: np.ndarray) -> np.ndarray:
        x = np.zeros((2 * pattern, len(starts)), np.int64)
        x[:pattern] = spread(starts)
        return transform(x)

    offsets = np.arange(pattern)[:, None]
    scale = pow(2 * pattern, -1, PRIME)
    for low in range(0, blocks, per_turn):
        starts = np.arange(low, min(low + per_turn, blocks)) * length
        if pattern == length:  # blocks and windows share their transforms
            shared = transformed(np.arange(low, starts[-1] // length + 3) * length)
            base, parts = shared[:, :-2], [(shared[:, 1:-1], shared[:, 2:])]
        else:
            base, parts = transformed(starts), None
        turned = base[_negated(2 * pattern)] % PRIME
        own = squares[starts + pattern] - squares[starts]
        for s in range(steps):
            near = starts + length + s * pattern
            first, second = parts[0] if parts else (transformed(near), transformed(near + pattern))
            product = _fold(turned * ((first + sign * second) % PRIME))
            both = inverse_transform(product)[:pattern] % PRIME * scale
            there = squares[near + offsets + pattern] - squares[near + offsets]
            shift, block = np.nonzero((there + own - 2 * both) % PRIME == 0)
            found_at.append(starts[block])
            found_distance.append(length + s * pattern + shift)
    if not found_at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_at), np.concatenate(found_distance)


def _covered(at: np.ndarray, distance: np.ndarray, length: int, runs: np.ndarray) -> np.ndarray:
    """Whether two blocks from ``at`` on lie in a known run whose period divides the distance."""
    long = runs[runs[:, 1] >= 2 * length]
    if not len(long):
        return np.zeros(len(at), bool)
    long = long[np.argsort(long[:, 0], kind="stable")]
    ends = long[:, 0] + long[:, 1]  # rise with the starts, as no such run holds another
    k = np.minimum(np.searchsorted(ends, at + 2 * length), len(long) - 1)
    inside = (long[k, 0] <= at) & (ends[k] >= at + 2 * length)
    return inside & (distance % long[k, 2] == 0)


def runs_of(keys: np.ndarray, lengths: np.ndarray, p: Params | None = None) -> np.ndarray:
    """Runs of a sequence of texts, longest text first: rows of start, length, period.

    ``keys``: a number per word, equal for equal words of one text, different
    for words of different texts. ``lengths``: words per text, not increasing.
    """
    p = p or Params()
    total = len(keys)
    ends = np.cumsum(lengths)
    codes = (tx.mix(keys.astype(np.uint64) + np.uint64(1)) % np.uint64(PRIME)).astype(np.int64)
    runs = np.zeros((0, 3), np.int64)
    length = 1
    while True:
        least = max(p.least_length, p.exponent * length)
        texts = int(np.searchsorted(-lengths, -least, side="right"))  # texts long enough
        if not texts:
            return runs
        part = -(-int(ends[texts - 1]) // length) * length
        seen = np.zeros(part, np.int64)
        seen[: min(part, total)] = codes[:part]
        pattern = min(length, LONGEST)
        at, distance = recurrences(seen, length, pattern)
        order = np.lexsort((at, distance))
        at, distance = at[order], distance[order]
        # Chains of neighbouring blocks at one distance.
        starts = np.ones(len(at), bool)
        starts[1:] = (distance[1:] != distance[:-1]) | (at[1:] != at[:-1] + length)
        first = np.flatnonzero(starts)
        number = np.diff(np.append(first, len(at)))
        begin, distance = at[first], distance[first]
        wanted = np.maximum(p.least_length, p.exponent * distance) - distance
        enough = (number * length + 2 * (length - 1) >= wanted) & ~_covered(begin, distance, length, runs)
        begin, distance, number, wanted = begin[enough], distance[enough], number[enough], wanted[enough]
        if len(begin):
            low = np.maximum(begin - length + 1, 0)
            high = np.maximum(np.minimum(begin + (number + 1) * length - 1, total - distance), low)
            runs = np.concatenate([runs, _extended(keys, low, high, distance, wanted)])
        length *= 2


def _extended(keys: np.ndarray, low: np.ndarray, high: np.ndarray, distance: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Longest stretches in [low, high) whose words recur at the distance, if there are ``wanted`` of them."""
    out = [np.zeros((0, 3), np.int64)]
    size = high - low
    sums = np.concatenate([[0], np.cumsum(size)])
    at = 0
    while at < len(low):
        stop = max(at + 1, int(np.searchsorted(sums, sums[at] + CELLS, side="right")) - 1)
        part = slice(at, stop)
        owner = np.repeat(np.arange(at, stop), size[part])
        place = low[owner] + np.arange(len(owner)) - (sums[owner] - sums[at])
        same = keys[place] == keys[place + distance[owner]]
        edge = np.ones(len(owner), bool)
        edge[1:] = (same[1:] != same[:-1]) | (owner[1:] != owner[:-1])
        border = np.flatnonzero(edge)
        reach = np.diff(np.append(border, len(owner)))
        good = same[border] & (reach >= wanted[owner[border]]) if len(border) else np.zeros(0, bool)
        border, reach = border[good], reach[good]
        period = distance[owner[border]]
        out.append(np.stack([place[border], reach + period, period], axis=1))
        at = stop
    return np.concatenate(out)


def _word_numbers(words: tx.Words) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """Equal numbers for equal words of the slice, by their bytes."""
    size = words.end - words.start
    flat = tx.ragged(words.data, words.start, size)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def slice_runs(words: tx.Words, p: Params) -> np.ndarray:
    """Rows of text, start (word of the text), length, period; by text, start, period."""
    counts = words.counts
    number = _word_numbers(words)
    # Longest texts first, so that those a scale can matter for come first.
    order = np.argsort(-counts, kind="stable")
    place = tx.ragged(np.arange(len(number)), words.first[order], counts[order])
    owner = np.repeat(np.arange(len(counts)), counts[order])
    keys = number[place] + owner * (int(number.max(initial=0)) + 1)
    runs = runs_of(keys, counts[order], p)
    begins = np.concatenate([[0], np.cumsum(counts[order])])
    rank = np.searchsorted(begins, runs[:, 0], side="right") - 1
    out = np.column_stack([order[rank], runs[:, 0] - begins[rank], runs[:, 1:]])
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _collapsed(words: tx.Words, runs: np.ndarray) -> pa.Array:
    """Texts of the words that no run holds beyond its first period, one blank between."""
    n = len(words.start)
    change = np.zeros(n + 1, np.int64)
    begin = words.first[runs[:, 0]] + runs[:, 1]
    np.add.at(change, begin + runs[:, 3], 1)
    np.add.at(change, begin + runs[:, 2], -1)
    kept = np.flatnonzero(np.cumsum(change[:n]) == 0)
    doc = words.doc[kept]
    size = words.end[kept] - words.start[kept]
    follows = np.zeros(len(kept), bool)
    follows[:-1] = doc[1:] == doc[:-1]
    taken = size + follows
    data = np.append(words.data, np.uint8(32))  # a word may end the slice
    flat = tx.ragged(data, words.start[kept], taken)
    flat[(np.cumsum(taken) - 1)[follows]] = 32
    per_text = np.bincount(doc, taken, len(words.counts)).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(per_text)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(per_text), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))).cast(pa.string())


def _run_lists(texts: int, runs: np.ndarray) -> pa.Array:
    offsets = np.searchsorted(runs[:, 0], np.arange(texts + 1)).astype(np.int32)
    fields = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], names=["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(offsets), fields)


def find_runs(docs: DataFrame, keep: list[str], text_column: str = "text", params: Params | None = None) -> DataFrame:
    """``keep`` columns, runs (array of start, length, period by start, then
    period; numbers of words from 0) and collapsed (the words that no run holds
    beyond its first period, joined by one blank) of each row. Columns of
    ``keep`` named runs or collapsed raise a ValueError."""
    p = params or Params()
    if p.exponent < 4:
        raise ValueError("a chain of two blocks is only certain from an exponent of 4 on")
    clash = {"runs", "collapsed"} & {c.lower() for c in keep}
    if clash:
        raise ValueError(f"columns to keep are named like results: {sorted(clash)}")
    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "runs array<struct<start: bigint, length: bigint, period: bigint>>", "collapsed string"])

    def run(batches):
        for batch in batches:
            for rows, data, offsets in tx.slices(batch, text_column):
                words = tx.words_of(data, offsets)
                found = slice_runs(words, p)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), _run_lists(rows.num_rows, found), _collapsed(words, found)], names=[*keep, "runs", "collapsed"])

    return docs.select(*dict.fromkeys([*keep, text_column])).mapInArrow(run, schema)
