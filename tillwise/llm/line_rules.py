"""Quality rules by line labelling.

Base counts of each whole text decide hard failures. Beyond them, a linear-chain
conditional random field over the lines of a text marks each line as content or
boilerplate by Viterbi decoding; a text stays if enough of its words stand in
content lines.

The field is fitted on stretches of at most ``fit_lines`` lines, cut from the
whole texts of ``sample_rows`` labelled documents (smallest hash of the id): the
``fit_stretches`` of smallest hash, equal ones once. Lines of documents labelled
0 count as boilerplate, other lines as content. These bounded rows of line
features are all that reaches the driver. Judging reads every text whole.

Null and empty texts have no words, so they fail the base rule. Without
labelled rows the field has zero weights and takes every line for content.
Repeated rows are judged one by one; an empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm import crf
from tillwise.llm import text as tx
from tillwise.llm.features import DIGIT, END_MARK, LEAD, SYMBOL, UPPER, Lines, repeated_words, span_counts

CONTENT, BOILERPLATE = 0, 1


@dataclass(frozen=True)
class Params:
    least_words: int = 50
    most_repeat_percent: int = 50
    least_content: float = 0.5
    sample_rows: int = 2_000
    fit_stretches: int = 2_000
    fit_lines: int = 300
    epochs: int = 80


#: Borders of the buckets of each line feature.
BORDERS = {
    "symbols": (1e-9, 0.1, 0.3, 0.6),
    "upper": (0.05, 0.15, 0.3, 0.6),
    "distinct": (0.2, 0.4, 0.6, 0.8),
    "digits": (1e-9, 0.1, 0.3),
    "bangs": (1e-9, 0.1, 0.3),
    "marks": (1e-9, 0.05, 0.2),
    "word_length": (3, 4.5, 6, 8),
    "repeat": (0.5,),
}
_SIZES = [len(b) + 1 for b in BORDERS.values()]
_BASES = np.concatenate([[0], np.cumsum(_SIZES)])
N_IDS = int(_BASES[-1])


def line_slots(words: tx.Words, lines: Lines) -> np.ndarray:
    """(lines, features) feature ids."""
    borders = np.concatenate([lines.word, lines.word_end[-1:]])
    n = np.maximum(lines.n_words, 1)
    chars = span_counts(LEAD[words.data], words.start, words.end)
    line_chars = np.maximum(tx.per_doc(chars, borders), 1)
    bytes_in = lambda mask: span_counts(mask, lines.start, lines.end)
    owner = np.repeat(np.arange(len(lines.n_words)), np.diff(borders))
    keyed = np.unique(tx.mix(words.hash + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_index=True)[1]
    distinct = np.bincount(owner[keyed], minlength=len(n)) if len(owner) else np.zeros(len(n))
    last = words.data[words.end - 1] if len(words.end) else np.zeros(0, np.uint8)
    values = {
        "symbols": tx.per_doc(span_counts(SYMBOL[words.data], words.start, words.end) > 0, borders) / n,
        "upper": bytes_in(UPPER[words.data]) / line_chars,
        "distinct": distinct / n,
        "digits": bytes_in(DIGIT[words.data]) / line_chars,
        "bangs": bytes_in(words.data == 33) / n,
        "marks": tx.per_doc(END_MARK[last], borders) / n,
        "word_length": line_chars / n,
        "repeat": lines.repeats(),
    }
    return np.stack([np.searchsorted(BORDERS[k], values[k], side="right") + _BASES[i] for i, k in enumerate(BORDERS)], axis=1)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_words", "boilerplate_lines")


def judge_slice(data: np.ndarray, offsets: np.ndarray, chain: crf.Chain, p: Params) -> dict[str, np.ndarray]:
    """Counts and verdicts of the texts of a slice."""
    words = tx.words_of(data, offsets)
    lines = Lines(words)
    label = chain.decode(chain.emissions(line_slots(words, lines)), lines.first) if len(lines.doc) else np.zeros(0, np.int8)
    n = words.counts
    out = {
        "n_words": n,
        "word_chars": tx.per_doc(span_counts(LEAD[data], words.start, words.end), words.first),
        "n_symbols": span_counts(SYMBOL[data], offsets[:-1], offsets[1:]),
        "n_dup_lines": tx.per_doc(lines.repeats(), lines.first),
        "n_repeat_words": repeated_words(words),
        "content_words": tx.per_doc(np.where(label == CONTENT, lines.n_words, 0), lines.first),
        "boilerplate_lines": tx.per_doc((label == BOILERPLATE) & (lines.n_words > 0), lines.first),
    }
    out["base_failed"] = (n < p.least_words) | (100 * out["n_repeat_words"] > p.most_repeat_percent * n)
    out["kept"] = ~out["base_failed"] & (out["content_words"] >= p.least_content * n)
    return out


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", params: Params | None = None) -> crf.Chain:
    """Fit the field on a bounded sample of labelled documents."""
    p = params or Params()
    usable = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isin(0, 1)).select(F.col(id_column), F.col(label_column).cast("int").alias("y_"))
    sample = usable.orderBy(F.xxhash64(id_column), id_column, "y_").limit(p.sample_rows)

    def run(batches):
        for batch in batches:
            for rows, data, offsets in tx.slices(batch, text_column):
                words = tx.words_of(data, offsets)
                lines = Lines(words)
                slots = line_slots(words, lines).astype(np.uint8)
                found = []
                for k, y in enumerate(rows.column("y_").to_pylist()):
                    for a in range(lines.first[k], lines.first[k + 1], p.fit_lines):
                        b = min(lines.first[k + 1], a + p.fit_lines)
                        gold = np.full(b - a, CONTENT if y else BOILERPLATE, np.uint8)
                        found.append(np.column_stack([slots[a:b], gold]).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["lines"])

    # At most sample_rows ids: the side that is sent out has a fixed bound.
    rows = docs.select(id_column, text_column).join(F.broadcast(sample), id_column).select(text_column, "y_")
    chosen = rows.mapInArrow(run, "lines binary").distinct().orderBy(F.xxhash64("lines"), "lines").limit(p.fit_stretches)
    found = sorted(bytes(r[0]) for r in chosen.collect())
    parts = [np.frombuffer(r, np.uint8).reshape(-1, len(BORDERS) + 1) for r in found]
    table = np.concatenate(parts).astype(np.int64) if parts else np.zeros((0, len(BORDERS) + 1), np.int64)
    first = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
    return crf.fit(table[:, :-1], table[:, -1], first, N_IDS, 2, p.epochs)


def judge(docs: DataFrame, chain: crf.Chain, id_column: str = "doc_id", text_column: str = "text", params: Params | None = None) -> DataFrame:
    """id, the counts (long), base_failed and kept of each row."""
    p = params or Params()
    kind = dict(docs.dtypes)[id_column]
    schema = ", ".join([f"`{id_column}` {kind}", *(f"{c} bigint" for c in COUNTS), "base_failed boolean, kept boolean"])

    def run(batches):
        for batch in batches:
            for rows, data, offsets in tx.slices(batch, text_column):
                found = judge_slice(data, offsets, chain, p)
                columns = [pa.array(found[c].astype(np.int64)) for c in COUNTS] + [pa.array(found[c]) for c in ("base_failed", "kept")]
                yield pa.RecordBatch.from_arrays([rows.column(id_column), *columns], names=[id_column, *COUNTS, "base_failed", "kept"])

    return docs.select(id_column, text_column).mapInArrow(run, schema)


def passing(docs: DataFrame, chain: crf.Chain, text_column: str = "text", params: Params | None = None) -> DataFrame:
    """The rows, with all their columns, that the rules keep."""
    p = params or Params()
    schema = docs.schema

    def run(batches):
        for batch in batches:
            for rows, data, offsets in tx.slices(batch, text_column):
                kept = judge_slice(data, offsets, chain, p)["kept"]
                yield from pa.Table.from_batches([rows]).filter(pa.array(kept)).to_batches()

    return docs.mapInArrow(run, schema)
