"""Vector codes by product quantisation, with adaptive distance bounds.

Components become integers ``floor(scale * x)``; a vector is cut into ``parts``
equal consecutive parts, and each part position has a codebook. It starts as
that part of the first vectors by id; each round assigns every part to its
nearest entry (squared distance, ties to the lower entry) and moves each entry
to the floored mean of its parts (unused entries stay). A last assignment gives
the codes.

Assignments keep bounds between rounds, row by row in a table on the shared
folder. Of each part it holds the entry, the ``b`` next closest entries in the
order of lower bounds on their distances, and one outer bound below the
distances of all others. When entries have moved, a listed bound falls by the
move of its entry, the outer one by the largest move. With u, the exact distance
to the part's own entry:

* u is below the first bound: the entry stays, nothing is searched;
* u is below a later bound: only the listed entries before it are compared;
* else all entries are, and the list is built anew.

Bounds are floating-point numbers rounded down; wherever they do not decide by
a margin, integers do, ties included. So the codes are those of the plain
algorithm. ``b`` is chosen anew for each round from the counts of how far down
the lists the searches had to go, at the least cost; it never grows, as the
bounds of entries outside the lists are not known.

A round is one pass: tasks write the rows with their new bounds and, at the end,
their sums per entry, which Spark adds up. The codebooks (``parts * entries``
rows) are all that reaches the driver. Integers stay exact: products are taken
in doubles while every sum is below 2**53, otherwise in 64-bit integers.

Rows whose vector is null or holds null or non-finite components are dropped.
The codebooks are made for the length of the vector of smallest id whose length
is a positive multiple of ``parts``; rows of another length, and rows with a
component of more than 2**24 after scaling, stay with null code and error and
count for no codebook. Null ids are coded but start no codebook; a repeated id
starts it once, with its smallest vector; every row is coded. An empty table
gives an empty result. Columns that are not kept are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.session import scratch_path

LARGEST = 1 << 24
EXACT = 1 << 53
CELLS = 1 << 20  # distances computed at a time


@dataclass(frozen=True)
class Params:
    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024
    bounds: int = 16  # listed entries at the start
    least_bounds: int = 2


@dataclass
class Codebooks:
    """``books``: (parts, entries, width) integers; ``moved``: how far each entry
    went in its last update; ``bounds``: listed entries per part in each round."""

    books: np.ndarray
    moved: np.ndarray
    bounds: list[int]


def finite(vector: Column) -> Column:
    """Whether a vector is neither null nor holds null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def _small(vector: Column, scale: int) -> Column:
    return ~F.exists(vector, lambda x: F.abs(F.floor(x.cast("double") * scale).cast("double")) > LARGEST)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances, as doubles where they are exact, else as integers."""
    reach = 2 * max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if x.shape[1] * reach * reach * len(book) < EXACT:
        a, b = x.astype(np.float64), book.astype(np.float64)
        return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
    out = np.empty((len(x), len(book)), np.int64)
    for e, entry in enumerate(book):
        step = x - entry
        out[:, e] = (step * step).sum(1)
    return out


def closest(x: np.ndarray, book: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``number`` closest entries of each row, ties by entry, and their squared distances."""
    found = distances(x, book)
    if found.dtype == np.float64 and number < len(book):
        key = found * len(book) + np.arange(len(book))
        best = np.argpartition(key, number - 1, axis=1)[:, :number]
        order = np.argsort(np.take_along_axis(key, best, 1), axis=1)
        best = np.take_along_axis(best, order, 1)
    else:
        best = np.argsort(found, axis=1, kind="stable")[:, :number]
    return best, np.take_along_axis(found, best, 1)


def _down(x: np.ndarray) -> np.ndarray:
    """Lower bounds as short floats that are not above them."""
    return (x * (1 - 1e-6)).astype(np.float32)


def search(x: np.ndarray, book: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry, listed entries and bounds (the outer one last) of each row, over all entries."""
    code = np.empty(len(x), np.uint8)
    near = np.empty((len(x), b), np.uint8)
    low = np.empty((len(x), b + 1), np.float32)
    step = max(1, CELLS // len(book))
    for at in range(0, len(x), step):
        best, d = closest(x[at : at + step], book, min(b + 2, len(book)))
        rows = slice(at, at + len(best))
        code[rows], near[rows] = best[:, 0], best[:, 1 : b + 1]
        low[rows] = np.inf
        low[rows, : d.shape[1] - 1] = _down(np.sqrt(d[:, 1:].astype(np.float64)))
    return code, near, low


def _own(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    step = x - entries
    return (step * step).sum(-1)


def reassign(x: np.ndarray, book: np.ndarray, moved: np.ndarray, code: np.ndarray, near: np.ndarray, low: np.ndarray):
    """New entry, list and bounds of each row after the entries have moved, and
    how many bounds of its list did not decide (one more than it holds: the
    outer one did not either)."""
    b = near.shape[1]
    bound = low.astype(np.float64)
    bound[:, :b] -= moved[near]
    bound[:, b] -= moved.max(initial=0.0)
    # In order: no bound is above a later one.
    bound = np.minimum.accumulate(bound[:, ::-1], axis=1)[:, ::-1]
    upper = np.sqrt(_own(x, book[code]).astype(np.float64))
    need = (bound <= (upper * (1 + 1e-9) + 1e-6)[:, None]).sum(1)
    code, near = code.copy(), near.copy()
    low = _down(np.maximum(bound, 0))
    everything = np.flatnonzero(need > b)
    if len(everything):
        code[everything], near[everything], low[everything] = search(x[everything], book, b)
    some = np.flatnonzero((need > 0) & (need <= b))
    step = max(1, CELLS // max(1, (b + 1) * x.shape[1]))
    for at in range(0, len(some), step):
        rows = some[at : at + step]
        deep = int(need[rows].max())
        listed = np.concatenate([code[rows, None], near[rows]], axis=1)
        exact = _own(x[rows, None, :], book[listed[:, : deep + 1]])
        asked = np.arange(deep + 1)[None, :] <= need[rows, None]
        # Smallest distance among those asked, then smallest entry.
        least = np.where(asked, exact, np.iinfo(np.int64).max).min(1)
        ties = asked & (exact == least[:, None])
        best = np.where(ties, listed[:, : deep + 1].astype(np.int64), 256).argmin(1)
        value = np.empty(listed.shape)
        value[:, 0] = upper[rows]
        value[:, 1:] = bound[rows, :b]
        value[:, : deep + 1] = np.where(asked, np.sqrt(exact.astype(np.float64)), value[:, : deep + 1])
        value[np.arange(len(rows)), best] = -1  # the own entry first
        order = np.argsort(value, axis=1, kind="stable")
        listed, value = np.take_along_axis(listed, order, 1), np.take_along_axis(value, order, 1)
        code[rows], near[rows] = listed[:, 0], listed[:, 1:]
        low[rows, :b] = _down(np.maximum(value[:, 1:], 0))
    return code, near, low, need


def shortened(near: np.ndarray, low: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """The first b listed entries; what is left out falls under the outer bound."""
    return near[:, :b], np.concatenate([low[:, :b], low[:, b:].min(1, keepdims=True)], axis=1)


def cheapest(need: np.ndarray, entries: int, least: int) -> int:
    """List length of least cost. ``need[z]``: rows of which z bounds did not
    decide, the last: rows whose outer bound did not. A listed entry costs the
    upkeep of its bound, and a comparison where it is asked for; a row that its
    list cannot serve costs a search over all entries."""
    b = len(need) - 2
    total = need.sum()
    served = np.cumsum(need[: b + 1] * np.arange(b + 1))
    rest = total - np.cumsum(need[: b + 1])
    cost = [served[k] + rest[k] * entries + total * k / 4 for k in range(b + 1)]
    return max(min(least, b), int(np.argmin(cost)))


def _bytes(column: pa.Array) -> np.ndarray:
    """A column of byte strings of one length as rows of bytes."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), -1)


def _rows_as_bytes(x: np.ndarray) -> pa.Array:
    width = x.shape[1] * x.itemsize
    offsets = np.arange(len(x) + 1, dtype=np.int64) * width
    flat = np.ascontiguousarray(x).view(np.uint8).reshape(-1)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).cast(pa.binary())


STATE = ["x", "code", "near", "low"]
TOTALS = ["part", "entry", "number", "sums"]


def _scaled(column: pa.Array, scale: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).astype(np.int64).reshape(len(column), -1)


def _round(kept: list[str], found: Codebooks, b: int, scale: int, first: bool):
    """Assign rows (of vectors in the first round, of the state later) and sum them up."""
    books, moved = found.books, found.moved
    parts, entries, width = books.shape

    def run(batches):
        number = np.zeros((parts, entries), np.int64)
        sums = np.zeros((parts, entries, width), np.int64)
        needs = np.zeros((parts, b + 2), np.int64)
        schema = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _scaled(batch.column("x"), scale) if first else _bytes(batch.column("x")).view(np.int32).astype(np.int64)
            if not first:
                codes = _bytes(batch.column("code"))
                nears = _bytes(batch.column("near")).reshape(len(x), parts, -1)
                lows = _bytes(batch.column("low")).view(np.float32).reshape(len(x), parts, -1)
            out = []
            for p in range(parts):
                part = x[:, p * width : (p + 1) * width]
                if first:
                    code, near, low = search(part, books[p], b)
                else:
                    near, low = shortened(nears[:, p], lows[:, p], b)
                    code, near, low, need = reassign(part, books[p], moved[p], codes[:, p], near, low)
                    needs[p] += np.bincount(need, minlength=b + 2)
                number[p] += np.bincount(code, minlength=entries)
                order = np.argsort(code, kind="stable")
                used, start = np.unique(code[order], return_index=True)
                sums[p, used] += np.add.reduceat(part[order], start, axis=0)
                out.append((code[:, None], near, low))
            state = [_rows_as_bytes(x.astype(np.int32)), *(_rows_as_bytes(np.concatenate([o[k] for o in out], axis=1)) for k in range(3))]
            ids = [batch.column(k) for k in kept]
            nothing = [pa.nulls(len(x), t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            made = pa.RecordBatch.from_arrays([*ids, *state, *nothing], names=[*kept, *STATE, *TOTALS])
            schema = made.schema
            yield made
        if schema is None:
            return
        # Sums per part and entry, then how far the lists were asked (entry -1 - z).
        rows = [(p, e, int(number[p, e]), sums[p, e].tolist()) for p, e in zip(*np.nonzero(number), strict=True)]
        rows += [(p, -1 - z, int(needs[p, z]), None) for p, z in zip(*np.nonzero(needs), strict=True)]
        columns = [pa.nulls(len(rows), schema.field(c).type) for c in [*kept, *STATE]]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array([r[k] for r in rows], schema.field(c).type) for k, c in enumerate(TOTALS))], schema=schema)

    return run


def _updated(found: Codebooks, totals: DataFrame, p: Params) -> Codebooks:
    """Entries at the floored means of their parts; the next list length."""
    parts, entries, width = found.books.shape
    sums = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)]
    books = found.books.copy()
    b = found.bounds[-1]
    need = np.zeros(b + 2)
    for row in totals.groupBy("part", "entry").agg(F.sum("number"), *sums).collect():
        if row[1] < 0:
            need[-1 - row[1]] += row[2]
        else:
            books[row[0], row[1]] = [s // row[2] for s in row[3:]]
    moved = np.sqrt(((books - found.books) ** 2).sum(-1).astype(np.float64)) * (1 + 1e-9)
    return Codebooks(books, moved, [*found.bounds, cheapest(need, entries, p.least_bounds) if need.any() else b])


def _seeds(vectors: DataFrame, number: int) -> list:
    """The vectors of the smallest ids, one for each id."""
    found: dict = {}
    while len(found) < number:
        rest = vectors.where(F.col("id") > F.lit(max(found))) if found else vectors.where(F.col("id").isNotNull())
        rows = rest.orderBy("id", "x").limit(number).collect()
        for row in rows:
            if len(found) < number:
                found.setdefault(row[0], row[1])
        if len(rows) < number:
            break
    return [found[k] for k in sorted(found)]


def compress(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", keep: tuple[str, ...] = (), params: Params | None = None) -> tuple[DataFrame, Codebooks | None]:
    """Rows of id, ``keep`` columns, code (two hex digits per part) and error
    (squared distance to the entries), and the codebooks; None without a vector
    to start from. Kept columns named code or error raise a ValueError."""
    p = params or Params()
    if p.entries > 256:
        raise ValueError("a code has two hexadecimal digits per part")
    names = list(dict.fromkeys([id_column, *keep]))
    if {"code", "error"} & {n.lower() for n in names}:
        raise ValueError("columns to keep are named like results")
    spark = vectors.sparkSession
    kept = [f"k{i}" for i in range(len(names))]
    renamed = [F.col(f"`{n}`").alias(k) for n, k in zip(names, kept, strict=True)]
    usable = vectors.where(finite(F.col(vector_column))).select(*renamed, F.col(f"`{vector_column}`").alias("x"))
    fits = _small(F.col("x"), p.scale) & (F.size("x") > 0) & (F.size("x") % p.parts == 0)
    by_id = usable.where(fits).select(F.col("k0").alias("id"), "x")
    head = by_id.where("id IS NOT NULL").orderBy("id", "x").limit(1).collect()
    back = [F.col(k).alias(n) for k, n in zip(kept, names, strict=True)]
    if not head:
        return usable.select(*back, F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error")), None
    size = len(head[0][1])
    good = fits & (F.size("x") == size)
    seeds = _seeds(by_id.where(F.size("x") == size), p.entries)
    start = np.floor(np.array(seeds, np.float64) * p.scale).astype(np.int64).reshape(len(seeds), p.parts, -1).transpose(1, 0, 2)
    b = max(0, min(p.bounds, len(seeds) - 1))
    found = Codebooks(np.ascontiguousarray(start), np.zeros(start.shape[:2]), [b])
    types = dict(usable.dtypes)
    ids = ", ".join(f"{k} {types[k]}" for k in kept)
    schema = f"{ids}, x binary, code binary, near binary, low binary, part int, entry int, number bigint, sums array<bigint>"
    now = usable.where(good)
    for r in range(p.rounds):
        path = scratch_path(spark, f"codes-{r}")
        now.mapInArrow(_round(kept, found, found.bounds[-1], p.scale, r == 0), schema).write.parquet(path)
        table = spark.read.schema(schema).parquet(path)
        found = _updated(found, table.where("part IS NOT NULL").select(*TOTALS), p)
        now = table.where("part IS NULL").select(*kept, *STATE)
    path = scratch_path(spark, "codes")
    first = p.rounds == 0
    now.mapInArrow(_final(kept, found, p.scale, first), f"{ids}, code string, error bigint").write.parquet(path)
    coded = spark.read.schema(f"{ids}, code string, error bigint").parquet(path)
    others = usable.where(~good).select(*kept, F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    return coded.unionByName(others).select(*back, "code", "error"), found


def _final(kept: list[str], found: Codebooks, scale: int, first: bool):
    """Codes and errors by the final entries."""
    books, moved, b = found.books, found.moved, found.bounds[-1]
    parts, _, width = books.shape
    digits = np.array([f"{e:02x}" for e in range(256)])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _scaled(batch.column("x"), scale) if first else _bytes(batch.column("x")).view(np.int32).astype(np.int64)
            error = np.zeros(len(x), np.int64)
            text = np.full(len(x), "", "U1")
            for p in range(parts):
                part = x[:, p * width : (p + 1) * width]
                if first:
                    code, _, _ = search(part, books[p], b)
                else:
                    near = _bytes(batch.column("near")).reshape(len(x), parts, -1)[:, p]
                    low = _bytes(batch.column("low")).view(np.float32).reshape(len(x), parts, -1)[:, p]
                    code = reassign(part, books[p], moved[p], _bytes(batch.column("code"))[:, p], *shortened(near, low, b))[0]
                error += _own(part, books[p][code])
                text = np.char.add(text, digits[code])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(text.tolist(), pa.string()), pa.array(error)], names=[*kept, "code", "error"])

    return run
