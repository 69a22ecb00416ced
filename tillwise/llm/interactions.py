"""Toxicity: a factorisation machine over hashed terms.

Terms of a text are its words (runs of letters, lower-cased) and the beginnings
of words, hashed into ``buckets``; a text is the set of its buckets. Its score
is the logistic of

    bias + sum of weight[i] + share * sum over pairs i < j of <factor[i], factor[j]>

where the pair sum is half of ``|sum of factors|^2 - sum of |factors|^2``, so it
takes one pass over the terms. Pairs of terms that only matter together, such as
an insult with the mention of a group, get factors that point the same way;
linear weights alone can't tell them. ``share`` is ``1 / sqrt(n)`` for n known
terms: pairs grow with the square of a text's length, this keeps them in step.

Fitting reads at most ``sample_rows`` labelled texts (those with the smallest
hash of their id, one row per id and label) of at most ``sample_terms`` terms in
all, in the order of that hash: documented bounds; no text is cut. Terms found
in fewer than ``least_texts`` of them, or which are not told from chance, keep
weights of zero. Linear weights are shrunk towards zero (proximal steps), which
leaves most of them at zero exactly. Scoring reads every text whole.

Null and empty texts have no terms and score the bias. Without labelled rows, or
with one class only, every score is the smoothed share of class 1. Null labels,
labels other than 0 and 1 and null ids are not learned from. Repeated rows of an
id count once per label, with the text of smallest hash. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwise.llm import text as tx


@dataclass(frozen=True)
class Params:
    buckets: int = 1 << 18
    prefixes: tuple[int, ...] = (4, 6)  # bytes of a word's beginning that are terms too
    sample_rows: int = 8_000
    sample_terms: int = 12_000_000
    least_texts: int = 8
    factors: int = 6
    rounds: int = 6
    steps: int = 120  # at least; few texts are read in more rounds
    batch: int = 256
    rate: float = 0.5
    factor_rate: float = 0.01
    shrink: float = 1.0  # standard errors of a weight's slope that are taken off
    decay: float = 2e-3  # on factors
    threshold: float = 0.3


@dataclass
class Model:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def known(self) -> np.ndarray:
        return (self.weight != 0) | self.factor.any(1)

    def score(self, terms: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of texts whose buckets are ``terms[first[k]:first[k + 1]]``."""
        return 1 / (1 + np.exp(-margin(self, terms, first)[0]))


def _text_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over the terms of each text, also of texts without terms."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), np.float64)
    some = np.flatnonzero(first[1:] > first[:-1])
    if len(some):
        out[some] = np.add.reduceat(values, first[some], axis=0, dtype=np.float64)
    return out


def margin(model: Model, terms: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score before the logistic, the sums of factors and the share of pairs."""
    rows = model.factor[terms]
    total = _text_sums(rows, first)
    alone = _text_sums((rows * rows).sum(1), first)
    share = 1 / np.sqrt(np.maximum(np.diff(first), 1))
    pairs = 0.5 * ((total * total).sum(1) - alone)
    return model.bias + _text_sums(model.weight[terms], first) + share * pairs, total, share


LETTER = np.full(256, 32, np.uint8)  # other bytes end a word
LETTER[65:91] = np.arange(97, 123)
LETTER[97:123] = np.arange(97, 123)
LETTER[128:] = np.arange(128, 256)


def terms_of(data: np.ndarray, offsets: np.ndarray, p: Params, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text, ascending, and the borders of the texts."""
    words = tx.words_of(LETTER[data], offsets)
    size = words.end - words.start
    # Lengths of beginnings are told apart by a factor, a whole word by another.
    hashes, docs = [words.hash], [words.doc]
    for width in p.prefixes:
        longer = np.flatnonzero(size > width)
        begin = words.start[longer]
        code = np.zeros(len(longer), np.uint64)
        for k in range(width):
            code = code * np.uint64(0x100000001B3) + words.data[begin + k].astype(np.uint64) + np.uint64(1)
        hashes.append(tx.mix(code + np.uint64(width << 56)))
        docs.append(words.doc[longer])
    bucket = (np.concatenate(hashes) & np.uint64(p.buckets - 1)).astype(np.int64)
    doc = np.concatenate(docs)
    if known is not None:
        seen = known[bucket]
        bucket, doc = bucket[seen], doc[seen]
    pairs = np.unique(doc * p.buckets + bucket)
    first = np.searchsorted(pairs, np.arange(len(offsets)) * p.buckets)
    return pairs & (p.buckets - 1), first


def fit(terms: np.ndarray, first: np.ndarray, y: np.ndarray, p: Params | None = None) -> Model:
    """Fit on texts given by their buckets and 0/1 labels."""
    p = p or Params()
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))), np.zeros(p.buckets), np.zeros((p.buckets, p.factors)))
    if not len(y) or y.min() == y.max():
        return model
    often = np.bincount(terms, minlength=p.buckets) >= p.least_texts
    owner = np.repeat(np.arange(len(y)), np.diff(first))
    keep = often[terms]
    terms, owner = terms[keep], owner[keep]
    first = np.searchsorted(owner, np.arange(len(y) + 1))
    # Buckets that occur, numbered without gaps.
    used, terms = np.unique(terms, return_inverse=True)
    error = p.shrink * np.sqrt(share * (1 - share) * np.bincount(terms)) / len(y)
    rng = np.random.default_rng(17)
    small = Model(model.bias, np.zeros(len(used)), rng.normal(0, 0.01, (len(used), p.factors)))
    weight_sum, factor_sum = np.full(len(used), 1e-6), np.full(small.factor.shape, 1e-6)
    bias_sum = 1e-6
    for _ in range(max(p.rounds, -(-p.steps * p.batch // len(y)))):
        order = rng.permutation(len(y))
        for low in range(0, len(order), p.batch):
            rows = order[low : low + p.batch]
            count = first[rows + 1] - first[rows]
            taken = tx.ragged(terms, first[rows], count)
            border = np.concatenate([[0], np.cumsum(count)])
            value, total, pair_share = margin(small, taken, border)
            slope = (1 / (1 + np.exp(-value)) - y[rows]) / len(rows)
            bias_sum += slope.sum() ** 2
            small.bias -= p.rate * slope.sum() / np.sqrt(bias_sum)
            text = np.repeat(np.arange(len(rows)), count)
            here, place = np.unique(taken, return_inverse=True)
            g = np.bincount(place, slope[text], len(here))
            weight_sum[here] += g * g
            step = p.rate / np.sqrt(weight_sum[here])
            moved = small.weight[here] - step * g
            small.weight[here] = np.sign(moved) * np.maximum(np.abs(moved) - step * error[here], 0)
            pull = slope[text] * pair_share[text]
            near = total[text] - small.factor[taken]
            gf = np.stack([np.bincount(place, pull * near[:, k], len(here)) for k in range(p.factors)], axis=1) + p.decay * small.factor[here] / len(y)
            factor_sum[here] += gf * gf
            small.factor[here] -= p.factor_rate * gf / np.sqrt(factor_sum[here])
    model.bias = small.bias
    model.weight[used], model.factor[used] = small.weight, small.factor
    return model


def _featured(docs: DataFrame, keep: list[str], text_column: str, p: Params) -> DataFrame:
    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "terms array<int>"])

    def run(batches):
        for batch in batches:
            for rows, data, offsets in tx.slices(batch, text_column):
                terms, first = terms_of(data, offsets, p)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(terms.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), lists], names=[*keep, "terms"])

    return docs.select(*keep, text_column).mapInArrow(run, schema)


def sample(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, p: Params) -> DataFrame:
    """The rows to learn from: y and terms, within the documented bounds."""
    usable = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isin(0, 1)).select(F.col(id_column).alias("i_"), F.col(label_column).cast("int").alias("y_")).distinct()
    # At most sample_rows ids: the side that is sent out has a fixed bound.
    asked = F.broadcast(usable.orderBy(F.xxhash64("i_"), "i_", "y_").limit(p.sample_rows))
    texts = docs.select(F.col(id_column).alias("i_"), F.col(text_column).alias("t_")).join(asked, "i_")
    one = texts.groupBy("i_", "y_").agg(F.min_by("t_", F.struct(F.xxhash64("t_"), "t_")).alias("t_"))
    terms = _featured(one, ["i_", "y_"], "t_", p)
    # At most sample_rows rows reach this window.
    so_far = Window.orderBy(F.xxhash64("i_"), "i_", "y_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return terms.withColumn("n_", F.sum(F.size("terms").cast("long")).over(so_far)).where(F.col("n_") <= p.sample_terms).select("i_", "y_", "terms")


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", params: Params | None = None) -> Model:
    """Fit on labelled documents; ``labels``: the rows that may be learned from."""
    p = params or Params()
    found = sample(docs, labels, id_column, text_column, label_column, p).toArrow()
    found = found.sort_by([("i_", "ascending"), ("y_", "ascending")]).combine_chunks()
    y = found.column("y_").to_numpy().astype(float)
    lists = found.column("terms")
    sizes = pa.compute.list_value_length(lists).to_numpy().astype(np.int64)
    terms = lists.combine_chunks().flatten().to_numpy().astype(np.int64) if len(y) else np.zeros(0, np.int64)
    return fit(terms, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), y, p)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", params: Params | None = None) -> DataFrame:
    """id, score (0 to 1) and predicted (1 if score >= ``threshold``) of each row."""
    p = params or Params()
    kind = dict(docs.dtypes)[id_column]
    known = model.known()
    # Only known buckets travel to the tasks.
    used = np.flatnonzero(known)
    number = np.zeros(p.buckets, np.int32)
    number[used] = np.arange(len(used))
    small = Model(model.bias, model.weight[used].astype(np.float32), model.factor[used].astype(np.float32))

    def run(batches):
        for batch in batches:
            for rows, data, offsets in tx.slices(batch, text_column):
                terms, first = terms_of(data, offsets, p, known)
                s = small.score(number[terms], first)
                yield pa.RecordBatch.from_arrays([rows.column(id_column), pa.array(s), pa.array((s >= p.threshold).astype(np.int32))], names=[id_column, "score", "predicted"])

    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, score double, predicted int")
