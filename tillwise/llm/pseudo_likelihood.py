"""Scoring documents by masked pseudo-likelihood.

A window network predicts every token of a text from the tokens on both sides
of it. Tokens are words: the ``frequent`` most frequent ones (A-Z lower-cased)
of the corpus by name, the others by a hash class. The embeddings of the
neighbours, one table shared by all places, are laid side by side and go through
a tanh layer to a softmax in two steps: the cluster of the token, then the token
within it. A word of a hash class has its share of the class's probability, by
the counts of the whole corpus, so every word has a probability of its own,
however rare: (n + 1) / (all of its class + different words of it + 1), which
leaves a place for words that the corpus does not hold. A text's score is the
sum of the logarithms of these probabilities.

Training runs on all documents. Word counts of the whole corpus decide the
vocabulary. In each of ``rounds`` rounds every task descends from the current
network over its own texts, at the positions of the round's residues modulo
``every`` (the rounds share out all residues, so each position of each text is a
target in exactly one round), and sends its network, in blocks, with the number of
positions it saw. Blocks are averaged in two steps (salted, then whole), so a
block is never one task's load, and what is gathered grows with the input. Only
the averaged network (fixed size, under 1 MB), the vocabulary (``frequent``
rows) and the totals of the hash classes pass through the driver; the counts of
the words, which grow with the corpus, are a table in which the rarer words of
the texts are looked up, by parts of the hashes.

Null and empty texts have no tokens, a sum of 0 and no mean. Repeated rows are
scored one by one and count as often as they occur. An empty table trains
nothing and gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm import text as tx
from tillwise.session import scratch_path

SCORED = 8_192  # positions of a scoring step
LEADING = np.uint64(44)  # a shift that leaves 20 bits of a hash
LOOKED_UP = 1 << 22  # words that a task holds to look up their counts


@dataclass(frozen=True)
class Params:
    clusters: int = 64
    per_cluster: int = 64
    frequent: int = 3_840
    reach: int = 2  # neighbours on each side
    width: int = 16  # of an embedding
    hidden: int = 32
    rounds: int = 2
    every: int = 2  # residues of positions that the rounds share out
    batch: int = 4_096
    rate: float = 0.1
    blocks: int = 32
    salts: int = 16

    @property
    def words(self) -> int:
        return self.clusters * self.per_cluster

    def shapes(self) -> list[tuple[int, ...]]:
        inner = 2 * self.reach * self.width
        return [
            (self.words + 1, self.width),  # the last row stands for places outside the text
            (inner, self.hidden),
            (self.hidden,),
            (self.hidden, self.clusters),
            (self.clusters,),
            (self.clusters, self.hidden, self.per_cluster),
            (self.clusters, self.per_cluster),
        ]


def unpacked(flat: np.ndarray, p: Params) -> list[np.ndarray]:
    out, at = [], 0
    for shape in p.shapes():
        size = int(np.prod(shape))
        out.append(flat[at : at + size].reshape(shape))
        at += size
    return out


def initial(p: Params) -> np.ndarray:
    r = np.random.default_rng(3)
    return np.concatenate([(r.normal(0, 0.1, int(np.prod(s))) if len(s) > 1 and s != (p.clusters, p.per_cluster) else np.zeros(int(np.prod(s)))) for s in p.shapes()]).astype(np.float32)


def _exponentials(logits: np.ndarray) -> np.ndarray:
    """Turn logits into their exponentials, in place; the sum of each row."""
    if logits.max() > 60 or logits.min() < -60:  # else no exponential and no sum leaves the range of its type
        logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    return logits @ np.ones(logits.shape[1], np.float32)


def neighbours(ids: np.ndarray, first: np.ndarray, doc: np.ndarray, at: np.ndarray, p: Params) -> np.ndarray:
    """(positions, 2 * reach) ids around each position, within its text."""
    out = np.empty((len(at), 2 * p.reach), np.int64)
    low, high = first[doc[at]], first[doc[at] + 1]
    steps = [s for s in range(-p.reach, p.reach + 1) if s]
    for k, s in enumerate(steps):
        place = at + s
        inside = (place >= low) & (place < high)
        out[:, k] = np.where(inside, ids[np.clip(place, 0, len(ids) - 1)], p.words)
    return out


class Room:
    """Arrays that every batch uses again: fresh ones of this size come as pages
    that the system maps and clears first."""

    def __init__(self):
        self.kept: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.kept or len(self.kept[name]) < size:
            self.kept[name] = np.empty(size, np.float32)
        return self.kept[name][:size].reshape(shape)


def forward(net: list[np.ndarray], around: np.ndarray, p: Params, room: Room) -> tuple[np.ndarray, np.ndarray]:
    x = room("x", len(around), 2 * p.reach * p.width)
    np.take(net[0], around, axis=0, out=x.reshape(*around.shape, p.width), mode="clip")
    h = np.matmul(x, net[1], out=room("h", len(around), p.hidden))
    h += net[2]
    h *= 2  # tanh x = 1 - 2 / (exp 2x + 1), by the faster exponential
    with np.errstate(over="ignore"):
        np.exp(h, out=h)
    h += 1
    np.divide(-2, h, out=h)
    h += 1
    return x, h


def _by_cluster(cluster: np.ndarray, p: Params) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order of the positions by cluster; cluster, begin and end of each stretch."""
    order = np.argsort(cluster.astype(np.uint16), kind="stable")  # 16 bits are sorted by radix
    ends = np.cumsum(np.bincount(cluster, minlength=p.clusters)).tolist()
    return order, [(c, low, high) for c, (low, high) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if low < high]


def _log_softmax_at(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logarithm of each row's softmax at its place; the logits are used up."""
    sums = _exponentials(logits)
    return np.log(logits[np.arange(len(at)), at] / sums + 1e-12)


def log_probabilities(net: list[np.ndarray], ids: np.ndarray, around: np.ndarray, p: Params, room: Room) -> np.ndarray:
    cluster, word = np.divmod(ids, p.per_cluster)
    order, stretches = _by_cluster(cluster, p)
    _, h = forward(net, around[order], p, room)
    logits = np.matmul(h, net[3], out=room("logits", len(ids), p.clusters))
    logits += net[4]
    log = _log_softmax_at(logits, cluster[order]).astype(np.float64)
    logits = room("logits", len(ids), p.per_cluster)
    for c, low, high in stretches:
        part = np.matmul(h[low:high], net[5][c], out=logits[low:high])
        part += net[6][c]
    log += _log_softmax_at(logits, word[order])
    out = np.empty(len(ids))
    out[order] = log
    return out


def descend(net: list[np.ndarray], squares: list[np.ndarray], ids: np.ndarray, around: np.ndarray, p: Params, room: Room) -> None:
    """One adaptive gradient step on a batch, in place."""
    n = len(ids)
    every = np.arange(n)
    x, h = forward(net, around, p, room)
    cluster, word = np.divmod(ids, p.per_cluster)
    slope = np.matmul(h, net[3], out=room("slope", n, p.clusters))
    slope += net[4]
    slope *= (1 / (n * _exponentials(slope)))[:, None]
    slope[every, cluster] -= 1 / n
    back = np.matmul(slope, net[3].T, out=room("back", n, p.hidden))
    steps: list[tuple[int, object, np.ndarray]] = [(3, ..., h.T @ slope), (4, ..., slope.sum(0))]
    # Within the clusters: the positions in order of cluster, a stretch of each.
    order, stretches = _by_cluster(cluster, p)
    own = np.take(h, order, axis=0, out=room("own", n, p.hidden), mode="clip")
    inner = room("inner", n, p.per_cluster)
    for c, low, high in stretches:
        part = np.matmul(own[low:high], net[5][c], out=inner[low:high])
        part += net[6][c]
    inner *= (1 / (n * _exponentials(inner)))[:, None]
    inner[every, word[order]] -= 1 / n
    weights, biases, inner_back = room("weights", *net[5].shape), room("biases", *net[6].shape), room("inner_back", n, p.hidden)
    weights[...], biases[...] = 0, 0
    for c, low, high in stretches:
        part = inner[low:high]
        np.matmul(part, net[5][c].T, out=inner_back[low:high])
        np.matmul(own[low:high].T, part, out=weights[c])
        np.add.reduce(part, 0, out=biases[c])
    steps += [(5, ..., weights), (6, ..., biases)]
    place = np.empty(n, np.int64)
    place[order] = every
    back += np.take(inner_back, place, axis=0, out=own, mode="clip")
    np.multiply(h, h, out=own)
    back *= np.subtract(1, own, out=own)
    steps += [(1, ..., x.T @ back), (2, ..., back.sum(0))]
    into = np.matmul(back, net[1].T, out=room("into", *x.shape)).reshape(-1, p.width)
    flat = around.reshape(-1)
    order = np.argsort(flat.astype(np.uint16) if p.words < 1 << 16 else flat, kind="stable")
    flat = flat[order]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(flat)) + 1])
    sorted_ = np.take(into, order, axis=0, out=room("sorted", *into.shape), mode="clip")
    # Two columns go as one complex number: sums of short stretches cost by the column.
    pairs = sorted_ if p.width % 2 else sorted_.view(np.complex64)
    steps.append((0, flat[starts], np.add.reduceat(pairs, starts).view(np.float32)))
    for k, where, g in steps:
        step = np.multiply(g, g, out=room("step", *g.shape))
        squares[k][where] += step
        np.sqrt(squares[k][where], out=step)
        step += 1e-6
        g *= p.rate
        g /= step
        net[k][where] -= g


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tx.Words:
    lower = np.frombuffer(data.tobytes().translate(tx.LOWER.tobytes()), np.uint8)
    return tx.words_of(lower, offsets)


def classes(hashes: np.ndarray, p: Params) -> np.ndarray:
    """Hash class of each word hash."""
    return (hashes % np.uint64(p.words - p.frequent)).astype(np.int64)


class Vocabulary:
    """Ids of word hashes: rank by corpus count, or a hash class."""

    def __init__(self, hashes: np.ndarray, p: Params):
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]
        self.p = p

    @cached_property
    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """By leading bits: the place in ``sorted``, and whether several words share them."""
        slots = self.sorted >> LEADING
        place, shared = np.full(1 << 20, -1, np.int32), np.zeros(1 << 20, bool)
        place[slots] = np.arange(len(slots))
        shared[slots[1:][slots[1:] == slots[:-1]]] = True
        return place, shared

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        p = self.p
        other = p.frequent + classes(hashes, p)
        if not len(self.sorted):
            return other
        slots = hashes >> LEADING
        place, shared = self.places
        at = place[slots]
        several = np.flatnonzero(shared[slots])
        at[several] = np.minimum(np.searchsorted(self.sorted, hashes[several]), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], other)


@dataclass
class Model:
    """``counts``: path of the table of word counts (hash, n). ``totals``:
    per hash class the occurrences of its words and how many different ones."""

    vocabulary: Vocabulary
    flat: np.ndarray
    params: Params
    counts: str
    totals: np.ndarray


def count_words(docs: DataFrame, p: Params, text_column: str = "text") -> DataFrame:
    """hash, n: occurrences of each word in the whole corpus."""

    def run(batches):
        for batch in batches:
            for _, data, offsets in tx.slices(batch, text_column):
                values, counts = np.unique(word_hashes(data, offsets).hash, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], names=["hash", "n"])

    return docs.select(text_column).mapInArrow(run, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))


def class_totals(counts: DataFrame, vocabulary: Vocabulary, p: Params) -> np.ndarray:
    """(classes, 2): occurrences and different words, those known by name left out."""
    names = counts.sparkSession.createDataFrame([(h,) for h in vocabulary.sorted.view(np.int64).tolist()], "hash bigint")
    number = p.words - p.frequent
    out = np.zeros((number, 2), np.int64)
    # The hash is an unsigned number kept in a signed one.
    class_ = F.pmod(F.pmod("hash", F.lit(number)) + F.when(F.col("hash") < 0, F.lit((1 << 64) % number)).otherwise(0), F.lit(number))
    for k, n, words in counts.join(names, "hash", "left_anti").groupBy(class_.alias("class")).agg(F.sum("n"), F.count("*")).collect():
        out[k] = n, words
    return out


def frequent_words(counts: DataFrame, number: int) -> list[int]:
    """Hashes of the most frequent words, ties by hash.

    A histogram of counts (four bins per doubling) first tells from which bin on
    words can be among them, so tasks do not each send their own top list."""
    bin_ = F.floor(F.log2("n") * 4)
    sizes = sorted(counts.groupBy(bin_.alias("bin")).agg(F.count("*").alias("c")).collect(), reverse=True)
    total, least = 0, 0
    for r in sizes:
        total, least = total + r["c"], r["bin"]
        if total >= number:
            break
    top = counts.where(bin_ >= least).orderBy(F.desc("n"), "hash").limit(number)
    return [r["hash"] for r in top.collect()]


def targets(words: tx.Words, turn: int, p: Params) -> np.ndarray:
    """Positions that a round trains on; those of all rounds are all positions, each once."""
    if not len(words.hash):
        return np.zeros(0, np.int64)
    # Texts begin at different residues, so short ones do not all meet in one round.
    begin = words.first[:-1]
    shift = (words.hash[np.minimum(begin, len(words.hash) - 1)] % np.uint64(p.every)).astype(np.int64)
    residue = (np.arange(len(words.hash)) + (shift - begin)[words.doc]) % p.every
    return np.flatnonzero((residue >= turn * p.every // p.rounds) & (residue < (turn + 1) * p.every // p.rounds))


def _round(docs: DataFrame, text_column: str, model: Model, turn: int) -> DataFrame:
    """Blocks of every task's network after its texts: block, salt, seen, values."""
    p = model.params

    start, vocabulary = model.flat, model.vocabulary

    def run(batches):
        flat = start.copy()
        net = unpacked(flat, p)
        squares = unpacked(np.full(len(flat), 0.01, np.float32), p)
        room, seen = Room(), 0
        for batch in batches:
            for _, data, offsets in tx.slices(batch, text_column):
                words = word_hashes(data, offsets)
                if not len(words.hash):
                    continue
                ids = vocabulary.ids(words.hash)
                chosen = np.random.default_rng(turn).permutation(targets(words, turn, p))
                for low in range(0, len(chosen), p.batch):
                    at = chosen[low : low + p.batch]
                    descend(net, squares, ids[at], neighbours(ids, words.first, words.doc, at, p), p, room)
                seen += len(chosen)
        if seen:
            salt = TaskContext.get().partitionId() % p.salts
            parts = np.array_split(flat, p.blocks)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(p.blocks), pa.int32()), pa.array([salt] * p.blocks, pa.int32()), pa.array([seen] * p.blocks, pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())],
                names=["block", "salt", "seen", "part"],
            )

    return docs.select(text_column).mapInArrow(run, "block int, salt int, seen bigint, part binary")


def _averaged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted mean of the parts of each key."""

    def run(batches):
        for group in tx.groups(batches, keys):
            total, seen = 0.0, 0
            for n, part in zip(group.column("seen").to_pylist(), group.column("part"), strict=True):
                total = total + n * np.frombuffer(part.as_py(), np.float32).astype(np.float64)
                seen += n
            head = {k: group.column(k)[0].as_py() for k in ("block", "salt")}
            yield pa.RecordBatch.from_arrays(
                [pa.array([head["block"]], pa.int32()), pa.array([head["salt"]], pa.int32()), pa.array([seen], pa.int64()), pa.array([(total / seen).astype(np.float32).tobytes()], pa.binary())],
                names=["block", "salt", "seen", "part"],
            )

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "block int, salt int, seen bigint, part binary")


def train(docs: DataFrame, text_column: str = "text", params: Params | None = None) -> Model:
    p = params or Params()
    spark = docs.sparkSession
    path = scratch_path(spark, "words")
    count_words(docs, p, text_column).write.parquet(path)
    counts = spark.read.parquet(path)
    vocabulary = Vocabulary(np.array(frequent_words(counts, p.frequent), np.int64).view(np.uint64), p)
    model = Model(vocabulary, initial(p), p, path, class_totals(counts, vocabulary, p))
    for turn in range(p.rounds):
        path = scratch_path(spark, "networks")
        _averaged(_round(docs, text_column, model, turn), ["block", "salt"]).write.parquet(path)
        blocks = _averaged(spark.read.parquet(path), ["block"]).collect()
        if blocks:  # a fixed number of blocks of a network of fixed size
            model.flat = np.concatenate([np.frombuffer(r["part"], np.float32) for r in sorted(blocks, key=lambda r: r["block"])])
    return model


RARE = pa.list_(pa.struct([("part", pa.int32()), ("hashes", pa.binary()), ("places", pa.binary()), ("times", pa.binary())]))


def _by_part(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order of word hashes by part, then hash; part, begin and end of each stretch."""
    part = hashes.view(np.int64) % parts
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(part[order].astype(np.uint16 if parts <= 1 << 16 else np.int64), kind="stable")]
    ends = np.cumsum(np.bincount(part, minlength=parts)).tolist()
    return order, [(k, low, high) for k, (low, high) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if low < high]


def _network_sums(docs: DataFrame, model: Model, id_column: str, text_column: str, parts: int) -> DataFrame:
    """Per row: its slice of texts and place there, id, n_tokens, the network's sum.
    The first row of a slice also has its words of hash classes, by part of the
    hashes: hash, place of the text and number in the text, as packed numbers."""
    p, flat, vocabulary = model.params, model.flat, model.vocabulary
    kind = dict(docs.dtypes)[id_column]

    def run(batches):
        net, room = unpacked(flat, p), Room()
        slice_ = TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows, data, offsets in tx.slices(batch, text_column):
                words = word_hashes(data, offsets)
                ids = vocabulary.ids(words.hash)
                sums = np.zeros(rows.num_rows)
                for low in range(0, len(ids), SCORED):
                    at = np.arange(low, min(low + SCORED, len(ids)))
                    log = log_probabilities(net, ids[at], neighbours(ids, words.first, words.doc, at, p), p, room)
                    sums += np.bincount(words.doc[at], log, rows.num_rows)
                rare = np.flatnonzero(ids >= p.frequent)
                order, stretches = _by_part(words.hash[rare], parts)
                hashes, places = words.hash[rare][order], words.doc[rare][order]
                # Equal words of a text follow each other, as texts are in order.
                edge = np.ones(len(order), bool)
                edge[1:] = (places[1:] != places[:-1]) | (hashes[1:] != hashes[:-1])
                at = np.flatnonzero(edge)
                times = np.diff(np.append(at, len(order))).astype(np.int32)
                hashes, places = hashes[at], places[at].astype(np.int32)
                found = []
                for k, low, high in stretches:
                    low, high = np.searchsorted(at, (low, high))
                    found.append({"part": k, "hashes": hashes[low:high].tobytes(), "places": places[low:high].tobytes(), "times": times[low:high].tobytes()})
                yield pa.RecordBatch.from_arrays(
                    [pa.array([slice_] * rows.num_rows, pa.int64()), pa.array(range(rows.num_rows), pa.int32()), rows.column(id_column), pa.array(words.counts), pa.array(sums), pa.array([found] + [[]] * (rows.num_rows - 1), RARE)],
                    names=["slice", "place", "id", "n_tokens", "net", "rare"],
                )
                slice_ += 1

    return docs.select(id_column, text_column).mapInArrow(
        run, f"slice bigint, place int, id {kind}, n_tokens bigint, net double, rare array<struct<part: int, hashes: binary, places: binary, times: binary>>"
    )


def _packed_counts(counts: DataFrame, parts: int) -> DataFrame:
    """part, hashes, counts: the words of each part, some rows of packed numbers each."""

    def packed(held):
        table = pa.Table.from_batches(held)
        hashes, n = table.column("hash").to_numpy().view(np.uint64), table.column("n").to_numpy()
        order, stretches = _by_part(hashes, parts)
        for k, low, high in stretches:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([hashes[order[low:high]].tobytes()], pa.binary()), pa.array([n[order[low:high]].tobytes()], pa.binary())], names=["part", "hashes", "counts"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= LOOKED_UP // 4:
                yield from packed(held)
                held, size = [], 0
        if size:
            yield from packed(held)

    return counts.select("hash", "n").mapInArrow(run, "part int, hashes binary, counts binary")


def _shares(rare: DataFrame, counts: DataFrame, model: Model, parts: int) -> DataFrame:
    """slice, place, shares: logarithms of the shares of the rarer words, summed by
    text. A task has the counts of one part at a time; the words of the slices
    stream past them."""
    p = model.params
    sizes = model.totals.sum(axis=1) + 1
    both = _packed_counts(counts, parts).unionByName(rare, allowMissingColumns=True)

    def look_up(batches):
        part, known, numbers, ready = None, [], [], False
        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] != part:
                    part, known, numbers, ready = r["part"], [], [], False
                hashes = np.frombuffer(r["hashes"], np.uint64)
                if r["slice"] is None:
                    known.append(hashes)
                    numbers.append(np.frombuffer(r["counts"], np.int64))
                    continue
                if not ready:  # all counts of the part came before; a last place is for words beyond them
                    known = np.concatenate([*known, np.full(1, 2**64 - 1, np.uint64)])
                    order = np.argsort(known, kind="stable")
                    known, numbers, ready = known[order], np.concatenate([*numbers, np.zeros(1, np.int64)])[order], True
                at = np.searchsorted(known, hashes)
                n = np.where(known[at] == hashes, numbers[at], 0)
                log = np.frombuffer(r["times"], np.int32) * np.log((n + 1) / sizes[classes(hashes, p)])
                sums = np.bincount(np.frombuffer(r["places"], np.int32), log)
                yield pa.RecordBatch.from_arrays([pa.array([r["slice"]], pa.int64()), pa.array([sums.tobytes()], pa.binary())], names=["slice", "sums"])

    def summed(batches):
        for group in tx.groups(batches, ["slice"]):
            vectors = [np.frombuffer(v.as_py()) for v in group.column("sums")]
            total = np.zeros(max(map(len, vectors)))
            for v in vectors:
                total[: len(v)] += v
            yield pa.RecordBatch.from_arrays([pa.array([group.column("slice")[0].as_py()] * len(total), pa.int64()), pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["slice", "place", "shares"])

    # Null slices, the counts, come first.
    sums = both.repartition("part").sortWithinPartitions("part", F.col("slice").asc_nulls_first()).mapInArrow(look_up, "slice bigint, sums binary")
    return sums.repartition("slice").sortWithinPartitions("slice").mapInArrow(summed, "slice bigint, place int, shares double")


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_tokens, log_likelihood (sum) and mean_log_likelihood of each row.

    The network's sums are written with the place of each row, by which the shares
    of the rarer words come back to their texts."""
    spark = docs.sparkSession
    path = scratch_path(spark, "sums")
    parts = max(64, -(-int(model.totals[:, 1].sum()) // LOOKED_UP))
    _network_sums(docs, model, id_column, text_column, parts).write.parquet(path)
    table = spark.read.parquet(path)
    rare = table.select("slice", F.inline("rare"))
    shares = _shares(rare, spark.read.parquet(model.counts), model, parts)
    total = F.col("net") + F.coalesce("shares", F.lit(0.0))
    return table.join(shares, ["slice", "place"], "left").select(
        F.col("id").alias(id_column), "n_tokens", total.alias("log_likelihood"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_likelihood")
    )
