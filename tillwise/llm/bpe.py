"""Byte-level BPE encoding and decoding on padded matrices.

The different pieces of a slice are dealt into buckets by length; a bucket is a
padded matrix with a row per piece. In each round every row merges its leftmost
pair of smallest rank: pair ranks come from a hash table of (left id, right id),
the merged cell replaces the pair and the row is compacted by one column. Rows
without a mergeable pair leave the matrix. A piece that is itself in the
vocabulary is its own id, as in the public library.

Pieces over ``LONG`` bytes are handled one at a time; a round then merges all
occurrences of the smallest pair from left to right if none of the pairs that
arise ranks below it (which is what merging them one after the other would do),
else only the leftmost one.

Null and empty texts have no ids and decode to no bytes. Repeated rows are
encoded one by one; an empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from tillwise.llm import pretokens
from tillwise.llm import text as tx

LONG = 256
NONE = np.int64(1) << 40
CACHE_PIECES = 200_000
SLICE_BYTES = 1_000_000


class Vocabulary:
    """Ranks of a public rank file, with the hash table of mergeable pairs."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        left, right, rank = [], [], []
        for token, r in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        self._build(self.key(np.array(left, np.int64), np.array(right, np.int64)), np.array(rank, np.int64))
        self.known = pretokens.Known(CACHE_PIECES, np.int32)

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left << 24) | right

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.size_bits)).astype(np.int64)

    def _build(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """Open addressing with linear probing, filled in rounds."""
        self.size_bits = max(4, int(len(keys) * 4).bit_length())
        mask = (1 << self.size_bits) - 1
        self.table_keys = np.full(1 << self.size_bits, -1, np.int64)
        self.table_ranks = np.full(1 << self.size_bits, NONE, np.int64)
        todo, at, self.probes = np.arange(len(keys)), self._home(keys), 0
        while len(todo):
            self.probes += 1
            free = self.table_keys[at] == -1
            slot, winner = np.unique(at[free], return_index=True)
            chosen = todo[free][winner]
            self.table_keys[slot], self.table_ranks[slot] = keys[chosen], ranks[chosen]
            left = np.ones(len(todo), bool)
            left[np.flatnonzero(free)[winner]] = False
            todo, at = todo[left], (at[left] + 1) & mask

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where it doesn't merge or an id is -1."""
        keys = self.key(left, right)
        at = self._home(keys)
        stored = self.table_keys[at]
        out = np.where(stored == keys, self.table_ranks[at], NONE)
        todo = np.flatnonzero((stored != keys) & (stored != -1))
        mask = (1 << self.size_bits) - 1
        flat_keys, flat_at, flat_out = keys.reshape(-1), at.reshape(-1), out.reshape(-1)
        if out.ndim > 1:
            todo = np.flatnonzero(((stored != keys) & (stored != -1)).reshape(-1))
        step = 0
        while len(todo):
            step += 1
            slot = (flat_at[todo] + step) & mask
            stored = self.table_keys[slot]
            hit = stored == flat_keys[todo]
            flat_out[todo[hit]] = self.table_ranks[slot[hit]]
            todo = todo[~hit & (stored != -1)]
        return np.where((left < 0) | (right < 0), NONE, flat_out.reshape(out.shape))

    def _rows(self, matrix: np.ndarray, out: list, where: np.ndarray) -> None:
        """Merge all rows of a padded matrix; writes ids to out[where[row]]."""
        ranks = self.pair_ranks(matrix[:, :-1], matrix[:, 1:])
        while len(where):
            column = ranks.argmin(1)  # the leftmost of the smallest
            row = np.arange(len(where))
            best = ranks[row, column]
            done = best == NONE
            if done.any():
                for k in np.flatnonzero(done).tolist():
                    ids = matrix[k]
                    out[where[k]] = ids[ids >= 0].astype(np.int32)
                keep = ~done
                matrix, ranks, where, column, best = matrix[keep], ranks[keep], where[keep], column[keep], best[keep]
                row = np.arange(len(where))
                if not len(where):
                    return
            width = matrix.shape[1]
            matrix[row, column] = best
            move = np.arange(width - 1)[None, :]
            matrix = np.take_along_axis(matrix, move + (move > column[:, None]), axis=1)
            if width == 2:
                ranks = np.full((len(where), 1), NONE)
                matrix = np.concatenate([matrix, np.full((len(where), 1), -1, np.int64)], axis=1)
                continue
            move = np.arange(width - 2)[None, :]
            ranks = np.take_along_axis(ranks, move + (move >= column[:, None]), axis=1)
            before = column > 0
            ranks[row[before], column[before] - 1] = self.pair_ranks(matrix[row[before], column[before] - 1], best[before])
            after = column < width - 2
            ranks[row[after], column[after]] = self.pair_ranks(best[after], matrix[row[after], column[after] + 1])

    def _long(self, piece: bytes) -> np.ndarray:
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        while len(ids) > 1:
            ranks = self.pair_ranks(ids[:-1], ids[1:])
            best = ranks.min()
            if best == NONE:
                break
            at = np.flatnonzero(ranks == best)
            # Of overlapping occurrences (a run of one id) every other one merges.
            run_start = np.concatenate([[True], np.diff(at) > 1])
            begin = np.maximum.accumulate(np.where(run_start, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            merged = ids.copy()
            merged[at] = best
            right = at + 2
            right = right[right < len(ids)]
            risen = self.pair_ranks(np.full(len(right), best), ids[right])
            left = at[at > 0] - 1
            left = np.where(keep[left], left, left - 1)
            risen = np.concatenate([risen, self.pair_ranks(merged[left], np.full(len(left), best))])
            if len(risen) and risen.min() < best:
                at = at[:1]
                keep[:] = True
                keep[at + 1] = False
                merged = ids.copy()
                merged[at] = best
            ids = merged[keep]
        return ids.astype(np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[k] = np.array([rank], np.int32)
            elif len(piece) > LONG:
                out[k] = self._long(piece)
            else:
                buckets.setdefault(-(-len(piece) // 4) * 4, []).append(k)
        for width, rows in buckets.items():
            for low in range(0, len(rows), 20_000):
                part = rows[low : low + 20_000]
                joined = np.frombuffer(b"".join(pieces[k].ljust(width, b"\0") for k in part), np.uint8).reshape(len(part), width)
                matrix = self.byte_ids[joined]
                sizes = np.array([len(pieces[k]) for k in part])
                matrix[np.arange(width)[None, :] >= sizes[:, None]] = -1
                self._rows(matrix, out, np.array(part))
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a slice and where each text's ids begin."""
        pieces = pretokens.cut(data, offsets)
        if not len(pieces.keys):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        flat, begin, size = self.known.look_up(pieces, self._encode_new)
        per_piece = size[pieces.codes]
        ids = tx.ragged(flat, begin[pieces.codes], per_piece)
        return ids, np.concatenate([[0], np.cumsum(per_piece)])[pieces.first]

    def _encode_new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.encode_pieces([p.encode() for p in pieces])
        return np.concatenate([*found, np.zeros(0, np.int32)]), np.array([len(x) for x in found], np.int64)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """id and ids (array<int>) of each row."""
    path = path or default_path()

    def run(batches):
        for batch in batches:
            for rows, data, offsets in tx.slices(batch, text_column, SLICE_BYTES):
                ids, first = vocabulary(path).encode(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([rows.column(id_column), lists], names=[id_column, "ids"])

    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {dict(docs.dtypes)[id_column]}, ids array<int>")


def decode(encoded: DataFrame, ids_column: str = "ids", path: str | None = None) -> DataFrame:
    """The rows with a further column ``bytes``: what their ids stand for. A
    null list decodes to no bytes; ids outside the vocabulary are an error."""
    path = path or default_path()
    schema = StructType([*encoded.schema.fields, StructField("bytes", BinaryType())])

    def run(batches):
        for batch in batches:
            tokens = vocabulary(path)
            for low in range(0, batch.num_rows, 500):
                rows = batch.slice(low, 500)
                out = [tokens.decode(x.values.to_pylist() if x.is_valid else []) for x in rows.column(ids_column)]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.binary())], names=[*rows.schema.names, "bytes"])

    return encoded.mapInArrow(run, schema)
