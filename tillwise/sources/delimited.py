"""Delimited text whose quoted values may hold line breaks, read in splits.

A split of a file can't know from its own text whether it starts inside a
quoted value. So each split is first judged for both cases: from either state,
outside or inside quotes, it ends in some state and starts some number of
records. These few numbers per split are composed in the order of the splits;
then it is known of each split where it starts and which number its first
record has. A second pass emits the records that lie in one split; the few that
reach over a border are put together from their pieces, in the files concerned.

One small row per split reaches the driver, where Spark itself keeps the list of
splits. Rules: a quote at the start of a value opens it, two quotes inside it
are one, a quote elsewhere is a character; what follows a closing quote belongs
to the value. LF, CR LF and CR end a record outside quotes and are kept inside.
Blank lines are no records. An open quote at the end of a file ends there.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART = 10_000  # records of a batch


@dataclass(frozen=True)
class Dialect:
    sep: str = ","
    quote: str = '"'
    encoding: str = "UTF-8"

    def patterns(self) -> tuple[re.Pattern, re.Pattern]:
        """Lines after which no quote is open, begun outside and inside quotes."""
        s, q = re.escape(self.sep), re.escape(self.quote)
        close = rf"[^{q}]*+(?:{q}{q}[^{q}]*+)*+{q}(?!{q})[^{s}]*+"
        value = rf"(?:{q}{close}|[^{q}{s}][^{s}]*+|)"
        return re.compile(rf"{value}(?:{s}{value})*+", re.S), re.compile(rf"{close}(?:{s}{value})*+", re.S)


@dataclass
class Lines:
    """Consecutive lines of a split: texts, their line ends, and whether a quote
    is open after each, by the state before it."""

    text: list[str]
    end: list[str]
    from_outside: np.ndarray
    from_inside: np.ndarray

    def states(self, before: bool) -> np.ndarray:
        """State before each line and after the last one."""
        n = len(self.text)
        out = np.empty(n + 1, bool)
        out[0] = before
        if n:
            fixed = self.from_outside == self.from_inside
            flips = np.cumsum(self.from_outside & ~self.from_inside)
            last = np.maximum.accumulate(np.where(fixed, np.arange(n), -1))
            known = last >= 0
            base = np.where(known, self.from_outside[last], before)
            since = flips - np.where(known, flips[last], 0)
            out[1:] = base ^ (since % 2 == 1)
        return out

    def starts(self, states: np.ndarray) -> np.ndarray:
        """Lines that start a record."""
        return ~states[:-1] & np.fromiter((t != "" for t in self.text), bool, len(self.text))


def _decoded(values: pa.Array, d: Dialect, head: bool) -> tuple[list[str], list[str]]:
    """Lines of a batch and their ends."""
    raw = b"\n".join(v or b"" for v in values.to_pylist())
    if head and raw.startswith(b"\xef\xbb\xbf"):
        raw = raw[3:]
    text = raw.decode(d.encoding, "replace")
    lines = text.split("\n")
    if "\r" not in text:
        return lines, ["\n"] * len(lines)
    found, ends = [], []
    for line in lines:
        parts = line.split("\r")
        if len(parts) > 1 and not parts[-1]:
            parts.pop()
            last = "\r\n"
        else:
            last = "\n"
        found += parts
        ends += ["\r"] * (len(parts) - 1) + [last]
    return found, ends


def _read(values: pa.Array, d: Dialect, head: bool, closed: re.Pattern, closes: re.Pattern) -> Lines:
    text, end = _decoded(values, d, head)
    out, inside = np.zeros(len(text), bool), np.ones(len(text), bool)
    for i, line in enumerate(text):
        if d.quote in line:
            out[i] = closed.fullmatch(line) is None
            inside[i] = closes.fullmatch(line) is None
    return Lines(text, end, out, inside)


def _splits(batches: Iterator[pa.RecordBatch], d: Dialect) -> Iterator[tuple[str, int, bool, Lines]]:
    """File, split, whether the split begins here, and lines in the given order."""
    closed, closes = d.patterns()
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        file = batch.column("file").dictionary_encode()
        number, block = file.indices.to_numpy(), batch.column("block").to_numpy()
        edge = np.flatnonzero((number[1:] != number[:-1]) | (block[1:] != block[:-1])) + 1
        for low, high in zip([0, *edge], [*edge, len(block)], strict=True):
            here = file.dictionary[int(number[low])].as_py(), int(block[low])
            yield *here, here != last, _read(batch.column("value").slice(low, high - low), d, here != last and here[1] == 0, closed, closes)
            last = here


def _judged(d: Dialect):
    """Per split: state at the end and records started, for both starts."""

    def run(batches):
        found: dict[tuple[str, int], list] = {}
        for file, block, _, lines in _splits(batches, d):
            now = found.setdefault((file, block), [False, True, 0, 0])
            for k in (0, 1):
                states = lines.states(now[k])
                now[2 + k] += int(lines.starts(states).sum())
                now[k] = bool(states[-1])
        rows = [(f, b, *v) for (f, b), v in found.items()]
        names = ["file", "block", "end_outside", "end_inside", "starts_outside", "starts_inside"]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(6)], names=names)

    return run


JUDGED = "file string, block bigint, end_outside boolean, end_inside boolean, starts_outside bigint, starts_inside bigint"


@dataclass
class Split:
    inside: bool  # a quoted value is open at the start
    first: int  # number of the first record that starts here
    starts: int
    owner: int  # split in which the record open at the start began
    open_end: bool


@dataclass
class Layout:
    """The splits of all files, and which records of a file are wanted: those
    from ``skip`` on, before ``stop`` of the file."""

    splits: dict[str, dict[int, Split]]
    skip: int = 0
    stop: dict[str, int] = field(default_factory=dict)

    def of(self, file: str, block: int) -> Split:
        try:
            return self.splits[file][block]
        except KeyError:
            raise ValueError(f"{file} is cut differently than when it was judged; keep the sizes of splits fixed between the passes") from None

    def wanted(self, file: str, number: int) -> bool:
        return self.skip <= number < self.stop.get(file, sys.maxsize)

    def borders(self) -> set[tuple[str, int]]:
        """Splits that begin a wanted record they don't end."""
        return {(f, b) for f, splits in self.splits.items() for b, s in splits.items() if s.open_end and s.starts and self.wanted(f, s.first + s.starts - 1)}

    def holding(self, wanted: set[tuple[str, int]]) -> set[tuple[str, int]]:
        """Splits that hold a piece of the records that begin in one of the wanted ones."""
        return wanted | {(f, b) for f, splits in self.splits.items() for b, s in splits.items() if s.inside and (f, s.owner) in wanted}


def layout(lines: DataFrame, d: Dialect, skip: int = 0, max_rows: int | None = None) -> Layout:
    """Judge the splits and compose them, file by file."""
    splits: dict[str, dict[int, Split]] = {}
    stop: dict[str, int] = {}
    rest = max_rows
    state, number, owner, last = False, 0, 0, None

    def close(file: str | None) -> None:
        nonlocal rest
        if file is not None and rest is not None:
            taken = min(rest, max(0, number - skip))
            stop[file], rest = skip + taken, rest - taken

    for row in sorted(lines.mapInArrow(_judged(d), JUDGED).collect()):
        if row.file != last:
            close(last)
            state, number, owner, last = False, 0, row.block, row.file
        starts = row.starts_inside if state else row.starts_outside
        end = row.end_inside if state else row.end_outside
        splits.setdefault(row.file, {})[row.block] = Split(state, number, starts, owner, end)
        if starts:
            owner = row.block
        state, number = end, number + starts
    close(last)
    return Layout(splits, skip, stop)


def to_arrow(rows: list[list[str]], columns: list[str], numbers: Iterable[int] = (), number: str | None = None) -> pa.RecordBatch:
    """Text columns; missing values are empty, surplus ones are dropped. The
    numbers of the records are a last column, if it has a name."""
    n = len(columns)
    padded = [r if len(r) >= n else r + [""] * (n - len(r)) for r in rows]
    arrays = [pa.array([r[i] for r in padded], pa.string()) for i in range(n)]
    if number is None:
        return pa.RecordBatch.from_arrays(arrays, names=columns)
    return pa.RecordBatch.from_arrays([*arrays, pa.array(numbers, pa.int64())], names=[*columns, number])


def parse(texts: Iterable[str], d: Dialect) -> Iterator[list[str]]:
    """Records of lines with their ends."""
    csv.field_size_limit(sys.maxsize)
    return filter(None, csv.reader(texts, delimiter=d.sep, quotechar=d.quote))


def _records(plan: Layout, d: Dialect, columns: list[str], numbered: str | None):
    """Wanted records that begin and end in a split."""

    def run(batches):
        open_, number, state, headless = [], 0, False, False
        for file, block, begins, lines in _splits(batches, d):
            if begins:
                split = plan.of(file, block)
                open_, number, state, headless = [], split.first, split.inside, split.inside
            states = lines.states(state)
            state = bool(states[-1])
            texts = [t + e for t, e in zip(lines.text, lines.end, strict=True)]
            closed = np.flatnonzero(~states[1:])  # lines that leave no quote open
            if not len(closed):
                if not headless:
                    open_ += texts
                continue
            # The first lines may belong to a record that began in an earlier split.
            low, high, headless = int(closed[0]) + 1 if headless else 0, int(closed[-1]) + 1, False
            ready, open_ = open_ + texts[low:high], texts[high:]
            if number >= plan.stop.get(file, sys.maxsize):
                continue
            rows = list(parse(ready, d))
            first = number
            number += len(rows)
            rows = rows[max(0, plan.skip - first) : max(0, plan.stop.get(file, sys.maxsize) - first)]
            first = max(0, first - plan.skip) + 1
            for at in range(0, len(rows), PART):
                part = rows[at : at + PART]
                yield to_arrow(part, columns, range(first + at, first + at + len(part)), numbered)

    return run


def _pieces(plan: Layout, wanted: set[tuple[str, int]], d: Dialect):
    """Pieces of the records that begin in one of the splits and end in a later one."""

    def run(batches):
        found: dict[tuple[str, int], dict[int, list[str]]] = {}
        states_now: dict[tuple[str, int], tuple[bool, bool]] = {}
        for file, block, _, lines in _splits(batches, d):
            split = plan.of(file, block)
            state, headless = states_now.get((file, block), (split.inside, split.inside))
            states = lines.states(state)
            texts = [t + e for t, e in zip(lines.text, lines.end, strict=True)]
            closed = np.flatnonzero(~states[1:])
            if headless and (file, split.owner) in wanted:
                taken = int(closed[0]) + 1 if len(closed) else len(texts)
                found.setdefault((file, split.owner), {}).setdefault(block, []).extend(texts[:taken])
            if (file, block) in wanted:
                tail = found.setdefault((file, block), {}).setdefault(block, [])
                if len(closed):  # what was open before has ended
                    tail.clear()
                    tail.extend(texts[int(closed[-1]) + 1 :])
                elif not headless:
                    tail.extend(texts)
            states_now[(file, block)] = (bool(states[-1]), headless and not len(closed))
        rows = [(f, o, b, "".join(t)) for (f, o), parts in found.items() for b, t in parts.items() if t]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(4)], names=["file", "owner", "block", "text"])

    return run


def _whole(plan: Layout, d: Dialect, columns: list[str], numbered: str | None):
    def number(file: str, owner: int) -> int:
        split = plan.of(file, owner)
        return split.first + split.starts - plan.skip

    def run(batches):
        for batch in batches:
            rows = [next(parse(io.StringIO(t, newline=""), d)) for t in batch.column("text").to_pylist()]
            places = zip(batch.column("file").to_pylist(), batch.column("owner").to_pylist(), strict=True)
            yield to_arrow(rows, columns, [number(*p) for p in places], numbered)

    return run


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw lines with their file and the offset of their split in the file."""
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        # Else the sizes of splits follow the cores that happen to be registered.
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    read = spark.read.option("lineSep", "\n").text(path)
    return read.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def records(
    lines: DataFrame, columns: list[str], d: Dialect, skip: int = 0, max_rows: int | None = None, numbered: str | None = None
) -> DataFrame:
    """Records of lines (value, file, block), the lines of a split in their
    order. The first ``skip`` records of each file go; ``max_rows`` keeps the
    first ones, by file and place. ``numbered`` names a column for the place of
    a record among those of its file, from 1. Judging the splits is a job of its
    own."""
    schema = ", ".join([*(f"`{c}` string" for c in columns), *([f"`{numbered}` bigint"] if numbered else [])])
    plan = layout(lines, d, skip, max_rows)
    out = lines.mapInArrow(_records(plan, d, columns, numbered), schema)
    wanted = plan.borders()
    if wanted:
        # Only the splits with such a record go on. The condition names file and block in one
        # value: by a condition on the file alone Spark lists fewer files, and cuts them anew.
        place = F.concat_ws(":", F.col("block").cast("string"), "file")
        concerned = lines.where(place.isin(*sorted(f"{b}:{f}" for f, b in plan.holding(wanted))))
        pieces = concerned.mapInArrow(_pieces(plan, wanted, d), "file string, owner bigint, block bigint, text string")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "")
        out = out.unionByName(pieces.groupBy("file", "owner").agg(joined.alias("text")).mapInArrow(_whole(plan, d, columns, numbered), schema))
    return out
