"""Near-duplicate documents by b-bit MinHash.

A document's set is its distinct word shingles (A-Z lower-cased; fewer words
than a shingle: the whole sequence is the only shingle; no words: empty set).

1. ``sketch``: per document the size and a 128-bit digest of its set, one key
   per band of minima, and the low ``bits`` bits of all minima packed in longs.
2. Documents with one digest have one set: the smallest id stands for them, so
   a group of exact copies costs one row from here on.
3. Band keys held by two representatives or more bring these together. A bucket
   is dealt in blocks of at most ``block`` rows, a task for each pair of blocks,
   so no bucket is one task's load. Packed signatures are compared by bit counts
   and the estimate is corrected for chance equality of low bits; a pair counts
   in the first band it shares only. What leaves the task is which
   representatives still have a possible partner, not the pairs.
4. These get their full sets. Block by block, exact intersections come from a
   product of incidence matrices; of the links of a block pair a spanning
   forest is kept, so n similar texts give at most n rows.
5. Components of the links (``components``), brought back to all copies.

The bands miss a pair at exactly 0.75 with a chance of 5e-6 by default, the
estimate (five standard deviations below the threshold) with about 1e-6.

Null and empty texts have no shingles, are linked with nothing and stay. A
repeated id gives a row for each of its rows; a row without an id takes the
component of its exact copies, if there are any, and is never kept. An empty
table gives an empty result. Other columns than id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm import text as tx
from tillwise.llm.components import components
from tillwise.session import scratch_path


@dataclass(frozen=True)
class Params:
    words: int = 5
    percent: int = 75  # links: 100 * intersection >= percent * union
    bands: int = 32
    rows: int = 4
    bits: int = 4
    block: int = 512

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def least_estimate(self) -> float:
        """Threshold less five standard deviations of the estimate."""
        j, c = self.percent / 100, 2.0**-self.bits
        match = c + (1 - c) * j
        return j - 5 * (match * (1 - match) / self.hashes) ** 0.5 / (1 - c)


def shingle_hashes(words: tx.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle (not yet distinct) and each text's first one."""
    counts = words.counts
    number = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(number)])
    factors = tx.mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    size = np.repeat(np.minimum(counts, width), number)
    at = tx.ragged(np.arange(len(words.hash) + 1), words.first[:-1], number)
    out = size.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
    padded = np.concatenate([words.hash, np.zeros(width, np.uint64)])
    for k in range(width):
        out += np.where(size > k, padded[at + k] * factors[k], np.uint64(0))
    return tx.mix(out), first


def distinct_sets(hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct hashes of each text."""
    return [np.unique(hashes[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _minima(hashes: np.ndarray, first: np.ndarray, number: int) -> np.ndarray:
    """Minimum of each hash function over each non-empty set: (number, texts)."""
    seeds = np.random.default_rng(7).integers(1, 2**63, (number, 2), dtype=np.uint64)
    starts = first[:-1]
    out = np.empty((number, len(starts)), np.uint64)
    for k in range(number):
        out[k] = np.minimum.reduceat(hashes * (seeds[k, 0] | np.uint64(1)) + seeds[k, 1], starts)
    return out


def _pack(low: np.ndarray, bits: int) -> np.ndarray:
    """(hashes, texts) small values → (texts, longs), fields of ``bits`` bits."""
    per = 64 // bits
    pad = -len(low) % per
    low = np.concatenate([low, np.zeros((pad, low.shape[1]), np.uint64)])
    shifts = (np.arange(per, dtype=np.uint64) * np.uint64(bits))[None, :, None]
    return np.bitwise_or.reduce(low.reshape(-1, per, low.shape[1]) << shifts, axis=1).T


def _long(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _lists(matrix: np.ndarray) -> pa.Array:
    """(rows, k) → list column."""
    flat = np.ascontiguousarray(matrix).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, matrix.shape[1], dtype=np.int32)), pa.array(_long(flat)))


def _sketch_schema(id_column: str) -> str:
    return f"`{id_column}` bigint, text_hash bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, packed array<bigint>"


def sketch(docs: DataFrame, id_column: str, text_column: str, p: Params) -> DataFrame:
    """id, text_hash, n_shingles, set digest (set_a, set_b), band keys and packed
    low bits; keys and bits are null for an empty set. Id and hash tell the
    texts of a repeated id apart."""

    def run(batches):
        for batch in batches:
            for rows, data, offsets in tx.slices(batch, text_column):
                words = tx.words_of(tx.LOWER[data], offsets)
                hashes, first = shingle_hashes(words, p.words)
                sets = distinct_sets(hashes, first)
                sizes = np.array([len(s) for s in sets], np.int64)
                digest = np.zeros((2, len(sets)), np.uint64)
                full = np.flatnonzero(sizes)
                bands = packed = None
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    starts = np.concatenate([[0], np.cumsum(sizes[full])])
                    digest[0, full] = np.add.reduceat(flat, starts[:-1])
                    digest[1, full] = np.add.reduceat(tx.mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts[:-1])
                    minima = _minima(flat, starts, p.hashes)
                    keys = np.zeros((p.bands, len(full)), np.uint64)
                    for r in range(p.rows):
                        keys = tx.mix(keys * np.uint64(31) + minima[r :: p.rows][: p.bands])
                    bands = keys.T
                    packed = _pack(tx.mix(minima) & np.uint64((1 << p.bits) - 1), p.bits)
                place = np.full(len(sets), -1)
                place[full] = np.arange(len(full))
                take = pa.array(place, mask=place < 0)
                empty = pa.nulls(len(sets), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(id_column).cast(pa.int64()),
                        rows.column("text_hash"),
                        pa.array(sizes),
                        pa.array(_long(digest[0])),
                        pa.array(_long(digest[1])),
                        _lists(bands).take(take) if len(full) else empty,
                        _lists(packed).take(take) if len(full) else empty,
                    ],
                    names=[id_column, "text_hash", "n_shingles", "set_a", "set_b", "bands", "packed"],
                )

    return docs.select(F.col(id_column).cast("bigint").alias(id_column), F.xxhash64(text_column).alias("text_hash"), text_column).mapInArrow(run, _sketch_schema(id_column))


def estimate(a: np.ndarray, b: np.ndarray, p: Params) -> np.ndarray:
    """Similarity of packed signatures (rows of a against rows of b) from the
    share of equal low bits, corrected for equality by chance."""
    fields = np.uint64(sum(1 << (i * p.bits) for i in range(64 // p.bits)))
    differ = np.zeros((len(a), len(b)), np.int32)
    for k in range(a.shape[1]):
        x = a[:, k, None] ^ b[None, :, k]
        folded = x.copy()
        for shift in range(1, p.bits):
            folded |= x >> np.uint64(shift)
        differ += np.bitwise_count(folded & fields)
    match = 1 - differ / p.hashes
    chance = 2.0**-p.bits
    return (match - chance) / (1 - chance)


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    flat = table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return flat.reshape(table.num_rows, -1)


def _dealt(rows: DataFrame, sizes: DataFrame, keys: list[str], member: list[str], block: int) -> DataFrame:
    """Copies of the rows for every pair of blocks (i <= j) their block is in;
    ``side`` 0 is block i, 1 is block j; a block meets itself once."""
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(*member), F.col("blocks")).cast("int")
    return (
        rows.join(sizes, keys)
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .withColumn("i", F.least("own", "other"))
        .withColumn("j", F.greatest("own", "other"))
        .withColumn("side", F.when(F.col("own") == F.col("i"), 0).otherwise(1))
        .drop("n", "blocks", "own", "other")
    )


SLOT = ["band", "key", "i", "j"]
MEMBER = ["rep", "rep_hash"]  # a text: its id and hash


def _sorted_slots(rows: DataFrame) -> DataFrame:
    return rows.repartition(*SLOT).sortWithinPartitions(*SLOT)


def _possible(p: Params):
    """Members of a slot that have a possible partner there (step 3)."""

    def run(batches):
        for slot in tx.groups(batches, SLOT):
            band = slot.column("band")[0].as_py()
            side = slot.column("side").to_numpy()
            same = slot.column("i")[0].as_py() == slot.column("j")[0].as_py()
            left = np.arange(len(side)) if same else np.flatnonzero(side == 0)
            right = left if same else np.flatnonzero(side == 1)
            if not len(left) or not len(right):
                continue
            packed, bands = _matrix(slot, "packed"), _matrix(slot, "bands")
            good = estimate(packed[left], packed[right], p) >= p.least_estimate
            if same:
                np.fill_diagonal(good, False)
            for b in range(band):
                if not good.any():
                    break
                good &= bands[left, b, None] != bands[None, right, b]
            hit = np.zeros(len(side), bool)
            hit[left[good.any(1)]] = True
            hit[right[good.any(0)]] = True
            if hit.any():
                yield from slot.select([*MEMBER, *SLOT, "side"]).filter(pa.array(hit)).combine_chunks().to_batches()

    return run


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Whether each pair of sets (rows left, columns right) reaches the
    threshold, exactly: 100 * intersection >= percent * union."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    value, owner = flat[order], owner[order]
    new = np.concatenate([[True], value[1:] != value[:-1]]) if len(value) else np.zeros(0, bool)
    run = np.cumsum(new) - 1
    shared = np.bincount(run)[run] > 1 if len(run) else new
    owner, run = owner[shared], run[shared]
    _, column = np.unique(run, return_inverse=True)
    both = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    for low in range(0, int(column.max()) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])  # columns ascend, as values were sorted
        incidence = np.zeros((len(sets), width), np.float32)
        incidence[owner[a:b], column[a:b] - low] = 1
        both += incidence[left] @ incidence[right].T
    both = both.astype(np.int64)
    union = sizes[left][:, None] + sizes[right][None, :] - both
    return (100 * both >= percent * union) & (union > 0)


def forest(links: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges (row, row) of a spanning forest of the links between rows."""
    full = np.zeros((n, n), bool)
    full[np.ix_(left, right)] = links
    full |= full.T
    np.fill_diagonal(full, False)
    out, free = [], np.ones(n, bool)
    for root in np.flatnonzero(full.any(1)):
        if not free[root]:
            continue
        free[root] = False
        todo = [root]
        while todo:
            at = todo.pop()
            for other in np.flatnonzero(full[at] & free).tolist():
                free[other] = False
                out.append((at, other))
                todo.append(other)
    return out


def _confirmed(p: Params):
    """Links of the full sets within a slot (step 4)."""

    def run(batches):
        for slot in tx.groups(batches, SLOT):
            reps = slot.column("rep").to_numpy()
            side = slot.column("side").to_numpy()
            if len(reps) < 2:
                continue
            same = slot.column("i")[0].as_py() == slot.column("j")[0].as_py()
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in slot.column("shingles")]
            left = np.arange(len(reps)) if same else np.flatnonzero(side == 0)
            right = left if same else np.flatnonzero(side == 1)
            if not len(left) or not len(right):
                continue
            edges = forest(linked(sets, left, right, p.percent), left, right, len(reps))
            if edges:
                u, v = np.array(edges).T
                yield pa.RecordBatch.from_arrays([pa.array(reps[u]), pa.array(reps[v])], names=["u", "v"])

    return run


def _with_sets(p: Params, text_column: str):
    def run(batches):
        for batch in batches:
            for rows, data, offsets in tx.slices(batch, text_column):
                hashes, first = shingle_hashes(tx.words_of(tx.LOWER[data], offsets), p.words)
                sets = pa.array([s.tobytes() for s in distinct_sets(hashes, first)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in MEMBER), rows.column("slots"), sets], names=[*MEMBER, "slots", "shingles"])

    return run


SLOTS = "array<struct<band: int, key: bigint, i: int, j: int, side: int>>"


def _once(texts: DataFrame, sketches: DataFrame) -> DataFrame:
    """Texts (rep, rep_hash, t), repeated rows once. The written sketches tell
    which are repeated, so that no others have to be brought together."""
    again = sketches.groupBy(F.col("id").alias("rep"), F.col("text_hash").alias("rep_hash")).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    if again.isEmpty():
        return texts
    one = texts.join(again, MEMBER, "left_semi").groupBy(*MEMBER).agg(F.first("t").alias("t"))
    return texts.join(again, MEMBER, "left_anti").unionByName(one)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", params: Params | None = None) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable
    by links, itself included), kept (id = component_id)."""
    p = params or Params()
    spark = docs.sparkSession
    path = scratch_path(spark, "sketches")
    sketch(docs, id_column, text_column, p).write.parquet(path)
    sketches = spark.read.parquet(path).withColumnRenamed(id_column, "id")

    digest = ["set_a", "set_b", "n_shingles"]
    filled = sketches.where("n_shingles > 0")
    # Texts of one set are one class, of equal bands and bits; the smallest id
    # stands for it, with one of its texts.
    known = F.when(F.col("id").isNotNull(), F.struct("id", "text_hash"))
    written = scratch_path(spark, "classes")
    filled.groupBy(*digest).agg(F.min(known).alias("r"), F.first("bands").alias("bands"), F.first("packed").alias("packed")).write.parquet(written)
    classes = spark.read.parquet(written)  # so joins to it are plain shuffles, which the skew join can split
    exact = classes.select(*digest, F.col("r.id").alias("rep"))
    reps = classes.where("r IS NOT NULL").select(F.col("r.id").alias("rep"), F.col("r.text_hash").alias("rep_hash"), "bands", "packed")
    keys = reps.select(*MEMBER, F.posexplode("bands").alias("band", "key"))
    sizes = keys.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = _dealt(keys, sizes, ["band", "key"], MEMBER, p.block).join(reps, MEMBER)
    possible = _sorted_slots(members).mapInArrow(_possible(p), "rep bigint, rep_hash bigint, band int, key bigint, i int, j int, side int")
    slots = possible.groupBy(*MEMBER).agg(F.collect_list(F.struct(*SLOT, "side")).alias("slots"))
    texts = _once(docs.select(F.col(id_column).cast("bigint").alias("rep"), F.xxhash64(text_column).alias("rep_hash"), F.col(text_column).alias("t")), filled)
    sets = texts.join(slots, MEMBER).mapInArrow(_with_sets(p, "t"), f"rep bigint, rep_hash bigint, slots {SLOTS}, shingles binary")
    placed = sets.select("rep", "shingles", F.inline("slots"))
    links = _sorted_slots(placed).mapInArrow(_confirmed(p), "u bigint, v bigint")
    found = components(links)

    root = F.coalesce("component", "rep", "id")
    return (
        sketches.select("id", "n_shingles", "set_a", "set_b")
        .join(exact, digest, "left")
        .join(found.withColumnRenamed("node", "rep"), "rep", "left")
        .select(F.col("id").alias(id_column), "n_shingles", root.alias("component_id"), F.coalesce(F.col("id") == root, F.lit(False)).alias("kept"))
    )
