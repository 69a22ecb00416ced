"""Rules that depend on the outcome of the event before, per key.

Whether an attempt is refused depends on what became of the earlier attempts of
its key. Rows are cut into chunks along key and order (``prefix.cut``), so a
key that holds half of a table lies in many chunks. A key that begins in a chunk
starts from the machine's first state; only the key a chunk begins with may have
come from an earlier chunk. For that one the chunk is folded from every state it
may start in, into a transition table; tables are composed in the order of the
chunks, which gives the true start of each, and then all chunks are replayed
side by side. At most one start per chunk reaches the driver.

A table row says: a start in ``slot`` whose time lies in [low, high) ends in
``end``. Rows that end alike are merged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from tillwise.functions.prefix import CHUNK, cut

LONG_AGO, NEVER = -(1 << 62), 1 << 62
ANY = -1  # slot of starts that only their time decides


def _merged(slot: int, borders: list[int], ends: list[tuple]) -> list[tuple]:
    """Table rows for the times up to each border (ascending), equal neighbours merged."""
    rows: list[list] = []
    low = LONG_AGO
    for border, end in zip(borders, ends, strict=True):
        if rows and rows[-1][3] == end:
            rows[-1][2] = border + 1
        elif border + 1 > low:
            rows.append([slot, low, border + 1, end])
        low = max(low, border + 1)
    return [tuple(r) for r in rows]


@dataclass(frozen=True)
class Lockout:
    """State: failures since the last accepted attempt, end of the lock.

    ``end`` of a table: whether the failures are counted from the start of the
    chunk on, failures, end of the lock (``NEVER``: as at the start)."""

    limit: int
    hold: int
    start: tuple = (0, LONG_AGO)

    def step(self, state: tuple, at: int, ok: bool) -> tuple[tuple, tuple]:
        fails, until = state
        if at < until:
            return state, ("refused", fails)
        if ok:
            return (0, until), ("accepted", 0)
        fails += 1
        if fails >= self.limit:
            return (fails, at + self.hold), ("locked", fails)
        return (fails, until), ("failed", fails)

    def table(self, times: list[int], ok: list[bool]) -> list[tuple]:
        """From the last attempt to the first: how a chunk ends that goes on
        with attempt j, unlocked, after no failure (``fresh``) or after so many
        that the next one locks (``due``)."""
        n = len(times)
        behind = np.searchsorted(np.array(times), np.array(times) + self.hold).tolist()
        fresh: list[tuple] = [(0, 0, LONG_AGO)] * (n + 1)
        due: list[tuple] = [(1, 0, NEVER)] * (n + 1)
        until_ok = [0] * (n + 1)  # failures before the next accepted attempt
        for j in range(n - 1, -1, -1):
            until_ok[j] = 0 if ok[j] else until_ok[j + 1] + 1
            due[j] = fresh[j + 1] if ok[j] else self._locked(due, behind, times, j, 1)
            fresh[j] = self._from(0, j, fresh, due, until_ok, behind, times)
        rows = [(f, LONG_AGO, NEVER, self._from(f, 0, fresh, due, until_ok, behind, times)) for f in range(self.limit)]
        return rows + _merged(ANY, [*times, NEVER - 1], due)

    def _locked(self, due, behind, times, j: int, added: int) -> tuple:
        """Attempt j locks; ``added`` failures came to those at the start."""
        counted, more, until = due[behind[j]]
        if not counted:
            return due[behind[j]]
        return 1, more + added, times[j] + self.hold if until == NEVER else until

    def _from(self, fails: int, j: int, fresh, due, until_ok, behind, times) -> tuple:
        """Go on with attempt j, unlocked, after ``fails`` failures, fewer than the limit."""
        n = len(times)
        missing = self.limit - fails
        if until_ok[j] >= missing:
            counted, more, until = self._locked(due, behind, times, j + missing - 1, 0)
            return (0, self.limit + more, until) if counted else (0, more, until)
        over = j + until_ok[j]
        return (0, fails + until_ok[j], LONG_AGO) if over == n else fresh[over + 1]

    def places(self, state: tuple) -> list[tuple[int, int]]:
        fails, until = state
        return [(fails, until)] if fails < self.limit else [(ANY, until)]

    def after(self, state: tuple, end: tuple) -> tuple:
        counted, fails, until = end
        return (fails + state[0] if counted else fails, state[1] if until == NEVER else until)


@dataclass(frozen=True)
class RateLimit:
    """State: requests counted, end of the counter. ``end`` of a table likewise."""

    start: tuple = (0, LONG_AGO)

    def step(self, state: tuple, at: int, most: int, hold: int) -> tuple[tuple, tuple]:
        count, expires = state
        if at >= expires:
            count = 0
        if count >= most:
            return state, (True,)
        return (count + 1, at + hold), (False,)

    def table(self, times: list[int], most: list[int], hold: list[int]) -> list[tuple]:
        """A start (count, end) either lets the first request pass that allows
        more than ``count``, if that comes before the end, or begins anew with
        the first request behind it that allows any."""
        at, allowed, expires = np.array(times), np.array(most), np.array(times) + np.array(hold)
        n = len(at)
        levels = np.unique(allowed[allowed > 0])
        # following[l][i]: first request from i on that allows levels[l] or more.
        following = np.full((len(levels), n + 1), n)
        for k, level in enumerate(levels):
            following[k, :n] = np.minimum.accumulate(np.where(allowed >= level, np.arange(n), n)[::-1])[::-1]
        if not len(levels):
            return []
        firsts = following[0, :n]
        counts = np.arange(int(levels[-1]))
        passing = following[np.searchsorted(levels, counts, side="right"), 0]
        counts, passing = counts[passing < n], passing[passing < n]
        begin = np.unique(firsts[firsts < n])
        nodes = np.concatenate([np.stack([np.ones_like(begin), begin], 1), np.stack([counts + 1, passing], 1)])
        ends = self._ends(nodes, at, expires, levels, following)
        renewed = dict(zip(begin.tolist(), ends[: len(begin)], strict=True))
        rows = [(int(c), int(at[p]) + 1, NEVER, e) for c, p, e in zip(counts, passing, ends[len(begin) :], strict=True)]
        return rows + _merged(ANY, [t for t, f in zip(times, firsts, strict=True) if f < n], [renewed[f] for f in firsts.tolist() if f < n])

    def _ends(self, nodes: np.ndarray, at, expires, levels, following) -> list[tuple]:
        """State at the end after request i has passed as number c, for each (c, i).
        All paths go on step by step together; those that meet go on as one."""
        n = len(at)
        nodes, place = np.unique(nodes, axis=0, return_inverse=True)
        done = np.empty((len(nodes), 2), np.int64)
        joined = np.arange(len(nodes))  # the path that a path has become part of
        count, i, live = nodes[:, 0], nodes[:, 1], np.arange(len(nodes))
        turn = 0
        while len(live):
            level = np.searchsorted(levels, count, side="right")
            later = np.where(level < len(levels), following[np.minimum(level, len(levels) - 1), i + 1], n)
            passes = (later < n) & (at[np.minimum(later, n - 1)] < expires[i])
            anew = following[0, np.searchsorted(at, expires[i])]
            over = ~passes & (anew == n)
            done[live[over], 0], done[live[over], 1] = count[over], expires[i[over]]
            count, i = np.where(passes, count + 1, 1)[~over], np.where(passes, later, anew)[~over]
            live = live[~over]
            turn += 1
            if turn % 8 == 0 and len(live) > 1:
                _, first, same = np.unique(np.stack([count, i], 1), axis=0, return_index=True, return_inverse=True)
                joined[live] = live[first][same.reshape(-1)]
                count, i, live = count[first], i[first], live[first]
        while (joined[joined] != joined).any():
            joined = joined[joined]
        return [tuple(map(int, done[joined[k]])) for k in place.reshape(-1)]

    def places(self, state: tuple) -> list[tuple[int, int]]:
        return [state, (ANY, state[1])]

    def after(self, state: tuple, end: tuple) -> tuple:
        return end


KEY = "_key"
TABLE = f"{CHUNK} int, part int, {KEY} string, slot bigint, low bigint, high bigint, end array<bigint>"


def _segments(batch: pa.RecordBatch, before: tuple | None):
    """Stretches of equal (chunk, key) of a batch: chunk, key, whether the key
    begins here, whether its chunk does, borders."""
    chunk = batch.column(CHUNK).to_numpy()
    coded = batch.column(KEY).dictionary_encode()
    number = coded.indices.to_numpy()
    edge = np.flatnonzero((chunk[1:] != chunk[:-1]) | (number[1:] != number[:-1])) + 1
    for low, high in zip([0, *edge.tolist()], [*edge.tolist(), len(chunk)], strict=True):
        here = int(chunk[low]), coded.dictionary[int(number[low])].as_py()
        yield *here, here != before, before is None or here[0] != before[0], low, high
        before = here


def _tables(machine, inputs: list[str]):
    """Transition table of the key a chunk begins with (part 1), and the end of
    the key it ends with, if that begins inside the chunk (part 0)."""

    def run(batches):
        rows: list[tuple] = []
        now, heads, held = None, False, []

        def close() -> None:
            columns = [np.concatenate([h[k] for h in held]).tolist() for k in range(len(inputs))]
            if heads:
                rows.append((now[0], 1, now[1], None, None, None, None))
                rows.extend((now[0], 1, now[1], *t) for t in (machine.table(*columns) if columns[0] else []))
            else:
                state = machine.start
                for values in zip(*columns, strict=True):
                    state, _ = machine.step(state, *values)
                rows.append((now[0], 0, now[1], None, None, None, state))

        for batch in batches:
            if not batch.num_rows:
                continue
            asked = batch.column("_asked").to_numpy(zero_copy_only=False)
            values = [batch.column(c).to_numpy(zero_copy_only=False) for c in inputs]
            for chunk, key, begins, first, low, high in _segments(batch, now):
                if begins:
                    if now is not None and (first or heads):  # keys inside a chunk need neither
                        close()
                    now, heads, held = (chunk, key), first, []
                taken = asked[low:high]
                held.append([v[low:high][taken] for v in values])
        if now is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))],
            names=[CHUNK, "part", KEY, "slot", "low", "high", "end"],
        )

    return run


def _composed(machine):
    """Start of each chunk that goes on with a key; one state is all that is kept."""

    def run(batches):
        key, state, place, found, wanted = object(), None, None, None, []
        out: list[tuple[int, tuple]] = []

        def step() -> None:  # past the last chunk
            nonlocal state, found
            if found is not None:
                state, found = machine.after(state, found), None

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                chunk, part, k, slot, low, high, end = row
                if k != key:
                    key, state, found, place = k, machine.start, None, None
                if part == 0:
                    state = tuple(end)
                elif slot is None:  # a chunk begins
                    step()
                    out.append((chunk, state))
                    wanted, place = machine.places(state), None
                else:
                    for rank, (s, at) in enumerate(wanted):
                        if s == slot and low <= at < high and (place is None or rank < place):
                            found, place = tuple(end), rank
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([list(o[1]) for o in out], pa.list_(pa.int64()))], names=[CHUNK, "state"])

    return run


def fold(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], machine, outputs: list[StructField], asked: Column | None = None) -> DataFrame:
    """The rows with the outputs of ``machine.step(state, *inputs) → (state, outputs)``,
    called along the order for each key; rows that are not ``asked`` are passed
    by, with null outputs. Null keys are one key. ``inputs`` are not null.

    Cutting, tables and their composition are jobs of their own."""
    schema, names = StructType([*df.schema.fields, *outputs]), list(df.columns)
    marked = df.withColumn("_asked", F.coalesce(asked, F.lit(False)) if asked is not None else F.lit(True))
    parts = cut(marked.withColumn(KEY, F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})), [*keys, *order])
    in_order = [CHUNK, *keys, *order]
    slim = parts.select(CHUNK, KEY, "_asked", *dict.fromkeys([*inputs, *keys, *order])).sortWithinPartitions(*in_order)
    tables = slim.mapInArrow(_tables(machine, inputs), TABLE)
    starts = tables.repartition(KEY).sortWithinPartitions(KEY, CHUNK, "part", F.asc_nulls_first("slot"), "low").mapInArrow(_composed(machine), f"{CHUNK} int, state array<bigint>")
    known = {row[0]: tuple(row[1]) for row in starts.collect()}  # one row per chunk at most

    def run(batches):
        now, state = None, machine.start
        for batch in batches:
            if not batch.num_rows:
                continue
            wanted = batch.column("_asked").to_pylist()
            values = list(zip(*[batch.column(c).to_pylist() for c in inputs], strict=True))
            made: list[tuple] = []
            nothing = (None,) * len(outputs)
            for chunk, key, begins, first, low, high in _segments(batch, now):
                if begins:
                    now, state = (chunk, key), known.get(chunk, machine.start) if first else machine.start
                for asked_, v in zip(wanted[low:high], values[low:high], strict=True):
                    if asked_:
                        state, out = machine.step(state, *v)
                        made.append(out)
                    else:
                        made.append(nothing)
            columns = [pa.array(c, type=_arrow(f)) for f, c in zip(outputs, zip(*made, strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], names=[*names, *(f.name for f in outputs)])

    return parts.sortWithinPartitions(*in_order).mapInArrow(run, schema)


def _arrow(f: StructField) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[f.dataType.simpleString()]


def lockout(events: DataFrame, user: str, ts: str, tie: str, success: Column, limit: int = 5, minutes: int = 30) -> DataFrame:
    """Outcome of every login attempt: accepted, failed, locked (this failure
    locks the account) or refused (while it is locked), and the failures since
    the last accepted one. The same rules as the streaming job. Attempts without
    a time are left out."""
    timed = events.where(F.col(ts).isNotNull())
    slim = timed.select(user, tie, ts, F.unix_micros(ts).alias("_at"), F.coalesce(success, F.lit(False)).alias("_ok"))
    outputs = [StructField("outcome", StringType()), StructField("failures", IntegerType())]
    return fold(slim, [user], [ts, tie], ["_at", "_ok"], Lockout(limit, minutes * 60_000_000), outputs).drop("_at", "_ok")


def rate_limit(requests: DataFrame, ts: str, tie: str, allowed: Column, seconds: Column) -> DataFrame:
    """``refused_by`` of every request ``(ip, user_id, endpoint, …)``: ip, user
    or endpoint, null where it passes. Requests without a time are left out.

    Counters per address, per user (if known) and per endpoint and address (if
    the endpoint has a class) are asked one after the other; the first that has
    reached ``allowed`` refuses the request. A counter that lets a request pass
    goes up and lives on for ``seconds``; a refused request changes nothing in
    the counter that refuses it, nor in those behind it.
    """
    timed = requests.where(F.col(ts).isNotNull())
    rows = timed.withColumns({"_at": F.unix_micros(ts), "_most": allowed.cast("bigint"), "_hold": seconds.cast("bigint") * 1_000_000, "refused_by": F.lit(None).cast("string")})
    for name, keys, asked in (
        ("ip", ["ip"], F.lit(True)),
        ("user", ["user_id"], F.col("user_id").isNotNull()),
        ("endpoint", ["endpoint", "ip"], F.col("endpoint").isNotNull()),
    ):
        open_ = F.col("refused_by").isNull() & asked
        folded = fold(rows, keys, [ts, tie], ["_at", "_most", "_hold"], RateLimit(), [StructField("_no", BooleanType())], open_)
        rows = folded.withColumn("refused_by", F.coalesce("refused_by", F.when(F.col("_no"), name))).drop("_no")
    return rows.drop("_at", "_most", "_hold")
