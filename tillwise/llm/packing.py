"""Vector bin packing of tokenised examples into training sequences.

A sequence has three limits at once: tokens, segments and loss-bearing tokens.
Each task streams its texts through a pool of waiting examples and fills one
sequence after the other: of the examples that still fit, the one whose vector
(shares of the three limits) has the largest dot product with the sequence's
free space goes in. When nothing fits whole, or one segment is left, the
largest example is cut to the free space and its rest stays in the pool.
Examples longer than a sequence are cut in the same way.

Tasks pack on their own, so nothing is shuffled, and only the last sequence of
a task can stay short for want of text. Sequence ids hold the partition number
in their upper bits. Memory is the pool plus one slice of text.

Null and empty texts are an end mark alone. Repeated rows are packed one by
one. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tillwise.llm import pretokens
from tillwise.llm import text as tx

CACHE_PIECES = 300_000


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048
    pool: int = 512


@dataclass
class Example:
    key: object
    ids: np.ndarray  # uint32
    loss_from: int  # tokens from here on bear loss
    start: int = 0

    def left(self) -> int:
        return len(self.ids) - self.start

    def loss(self) -> int:
        return len(self.ids) - max(self.start, min(self.loss_from, len(self.ids)))


@dataclass
class Piece:
    example: Example
    start: int
    length: int
    sequence: int
    offset: int

    def loss(self) -> int:
        return max(0, self.start + self.length - max(self.start, self.example.loss_from))


def pack(examples: Iterator[Example], limits: Limits) -> Iterator[Piece]:
    """Place all tokens of the examples; sequences are numbered from 0."""
    scale = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
    pool: list[Example] = []
    need = np.zeros((limits.pool, 3))  # tokens, segments, loss of what is left
    source = iter(examples)
    dry = False
    sequence = 0
    free = scale.copy()
    while True:
        while not dry and len(pool) < limits.pool:
            new = next(source, None)
            if new is None:
                dry = True
            elif new.left():
                need[len(pool)] = new.left(), 1, new.loss()
                pool.append(new)
        if not pool:
            return
        n = len(pool)
        fits = (need[:n] <= free).all(1)
        if free[1] > 1 and fits.any():
            worth = (need[:n] / scale) @ (free / scale)
            worth[~fits] = -1
            at = int(worth.argmax())
        else:
            at = int(need[:n, 0].argmax())
        item = pool[at]
        # Tokens that bear no loss cost nothing of the third limit.
        length = int(min(item.left(), free[0], max(0, item.loss_from - item.start) + free[2]))
        if free[1] >= 1 and length > 0:
            piece = Piece(item, item.start, length, sequence, int(limits.tokens - free[0]))
            free -= length, 1, piece.loss()
            item.start += length
            yield piece
            if item.left():
                need[at] = item.left(), 1, item.loss()
            else:
                need[at] = need[n - 1]
                pool[at] = pool[-1]
                pool.pop()
        if length <= 0 or free[0] < 1 or free[1] < 1:
            sequence += 1
            free = scale.copy()


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _special(path: str) -> list[str]:
    return [t.content for t in _tokenizer(path).get_added_tokens_decoder().values()]


@cache
def _token_bytes(path: str) -> np.ndarray:
    """Bytes that each id stands for; a byte-level vocabulary writes one character per byte."""
    vocabulary = _tokenizer(path).get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, np.int64)
    out[list(vocabulary.values())] = [len(t) for t in vocabulary]
    return out


JOINED = 100  # words that are encoded in one go


def encode_pieces(pieces: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pieces, one after the other, and how many each has.

    A blank and letters is a piece wherever it stands among its like, so such
    words are encoded joined; ids then fall to the words by their bytes. If a
    word did not end where an id ends, all are encoded one by one.
    """
    model = _tokenizer(path)
    number = np.zeros(len(pieces), np.int64)
    joined = [k for k, p in enumerate(pieces) if p[0] == " " and p[1:].isalpha()]
    parts: dict[int, list[int]] = {}
    flat = np.zeros(0, np.uint32)
    if joined:
        runs = ["".join(pieces[k] for k in joined[low : low + JOINED]) for low in range(0, len(joined), JOINED)]
        flat = np.array([i for e in model.encode_batch_fast(runs, add_special_tokens=False) for i in e.ids], np.uint32)
        ends = np.cumsum(_token_bytes(path)[flat])
        wanted = np.cumsum([len(pieces[k].encode()) for k in joined])
        last = np.searchsorted(ends, wanted)
        if len(ends) and ends[-1] == wanted[-1] and (ends[last] == wanted).all():
            number[joined] = np.diff(np.concatenate([[-1], last]))
        else:
            joined, flat = [], flat[:0]
    single = np.ones(len(pieces), bool)
    single[joined] = False
    rest = np.flatnonzero(single).tolist()
    for low in range(0, len(rest), 10_000):
        part = rest[low : low + 10_000]
        for k, e in zip(part, model.encode_batch_fast([pieces[k] for k in part], add_special_tokens=False), strict=True):
            parts[k] = e.ids
            number[k] = len(e.ids)
    singles = np.array([i for k in rest for i in parts[k]], np.uint32)
    # Back into the order of the pieces.
    begin = np.zeros(len(pieces), np.int64)
    begin[joined] = np.cumsum(number[joined]) - number[joined]
    begin[rest] = len(flat) + np.cumsum(number[rest]) - number[rest]
    return tx.ragged(np.concatenate([flat, singles]), begin, number), number


_known: dict[str, pretokens.Known] = {}


def token_ids(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the texts of a slice, and where each text's ids begin.

    Merges never reach over the borders of pre-tokenisation pieces, so each
    different piece is encoded once. Texts that hold a special token's string
    go through the tokenizer whole.
    """
    model = _tokenizer(path)
    pieces = pretokens.cut(data, offsets)
    known = _known.setdefault(path, pretokens.Known(CACHE_PIECES, np.uint32))
    flat, begin, size = known.look_up(pieces, lambda new: encode_pieces(new, path))
    per_piece = size[pieces.codes] if len(size) else np.zeros(0, np.int64)
    ids = tx.ragged(flat, begin[pieces.codes], per_piece) if len(size) else flat[:0]
    first = np.concatenate([[0], np.cumsum(per_piece)])[pieces.first]
    whole = data.tobytes()
    if any(s.encode() in whole for s in _special(path)):
        texts = [tx.text_at(data, a, b) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        parts = [
            np.array(model.encode(t, add_special_tokens=False).ids, np.uint32) if any(s in t for s in _special(path)) else ids[a:b]
            for t, a, b in zip(texts, first[:-1].tolist(), first[1:].tolist(), strict=True)
        ]
        first = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        ids = np.concatenate(parts) if parts else ids
    return ids, first


def pack_documents(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    limits: Limits | None = None,
    tokenizer_path: str | None = None,
    end_id: int = 1,
    loss_from: Column | None = None,
    encode: Callable = token_ids,
) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens (with the end mark),
    loss_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    ``loss_from``: first token of a text that bears loss (default 0), such as
    the length of a prompt. The end mark bears loss.
    """
    limits = limits or Limits()
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    kind = dict(docs.dtypes)[id_column]
    schema = f"`{id_column}` {kind}, start bigint, length bigint, doc_tokens bigint, loss_tokens bigint, sequence_id bigint, offset bigint, ids binary"

    def run(batches):
        base = TaskContext.get().partitionId() << 40

        def examples():
            for batch in batches:
                for rows, data, offsets in tx.slices(batch, text_column):
                    ids, first = encode(data, offsets, path)
                    losses = rows.column("loss_from_").to_pylist()
                    for k, key in enumerate(rows.column(id_column).to_pylist()):
                        yield Example(key, np.append(ids[first[k] : first[k + 1]], np.uint32(end_id)).astype("<u4"), losses[k] or 0)

        held: list[Piece] = []

        def flush():
            columns = [
                pa.array([p.example.key for p in held], type=arrow_kind),
                *(pa.array(v, pa.int64()) for v in ([p.start for p in held], [p.length for p in held], [len(p.example.ids) for p in held], [p.loss() for p in held], [base + p.sequence for p in held], [p.offset for p in held])),
                pa.array([p.example.ids[p.start : p.start + p.length].tobytes() for p in held], pa.binary()),
            ]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=[id_column, "start", "length", "doc_tokens", "loss_tokens", "sequence_id", "offset", "ids"])

        for piece in pack(examples(), limits):
            held.append(piece)
            if len(held) >= 1000:
                yield flush()
        if held:
            yield flush()

    arrow_kind = to_arrow_type(docs.schema[id_column].dataType)
    loss = F.lit(0) if loss_from is None else loss_from
    return docs.select(id_column, text_column, loss.cast("int").alias("loss_from_")).mapInArrow(run, schema)
