"""Cut texts into the pieces that the public byte-level vocabularies merge within.

The split pattern is public_tokenizers.PATTERN. Its branches depend on the
classes of neighbouring code points only, so all piece borders of a slice come
from a few comparisons of whole arrays.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pandas as pd
import tiktoken

from tillwise.llm import text as tx
from tillwise.llm.features import LEAD

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@cache
def class_table() -> np.ndarray:
    """Class of every code point, asked of the public library itself, as its
    edition of the character database decides. The two libraries installed
    agree (a test compares them)."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        matches = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found = bytes(matches.encode_ordinary(every)).decode("utf-8")
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return out


@dataclass
class Pieces:
    """Pieces of a slice: where the different ones stand in the text and their
    hashes, the code of each piece in order, and each text's first piece (with
    the total at the end)."""

    text: str
    start: np.ndarray
    end: np.ndarray
    keys: np.ndarray
    codes: np.ndarray
    first: np.ndarray

    def strings(self, at: np.ndarray) -> list[str]:
        """Some of the different pieces."""
        return [self.text[a:b] for a, b in zip(self.start[at].tolist(), self.end[at].tolist(), strict=True)]

    @cached_property
    def distinct(self) -> list[str]:
        return self.strings(np.arange(len(self.keys)))


class Known:
    """Ids of the pieces that a worker has met, by hash, in one array. When there
    are too many, the older half is let go: pieces not met since the last time."""

    def __init__(self, most: int, kind: type) -> None:
        self.most, self.kind = most, kind
        self.keys = np.zeros(0, np.uint64)
        self.begin, self.flat = np.zeros(1, np.int64), np.zeros(0, kind)
        self.before: Known | None = None

    def _add(self, keys: np.ndarray, flat: np.ndarray, number: np.ndarray) -> None:
        self.keys = np.concatenate([self.keys, keys])
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(number)])
        self.flat = np.concatenate([self.flat, flat])

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return pd.Index(self.keys).get_indexer(keys)

    def look_up(self, pieces: Pieces, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids known, and where the ids of each different piece begin and how
        many they are. ``encode``: ids of new pieces, one after the other, and
        how many each has."""
        at = self._places(pieces.keys)
        new = np.flatnonzero(at < 0)
        if len(self.keys) + len(new) > self.most and len(self.keys):
            older = Known(self.most, self.kind)
            older.keys, older.begin, older.flat = self.keys, self.begin, self.flat
            self.__init__(self.most, self.kind)
            self.before, new = older, np.arange(len(pieces.keys))
        if len(new):
            if self.before is not None:
                old = self.before
                where = old._places(pieces.keys[new])
                kept, where = new[where >= 0], where[where >= 0]
                size = old.begin[where + 1] - old.begin[where]
                self._add(pieces.keys[kept], tx.ragged(old.flat, old.begin[where], size), size)
                new = np.setdiff1d(new, kept, assume_unique=True)
            self._add(pieces.keys[new], *encode(pieces.strings(new)))
            at = self._places(pieces.keys)
        return self.flat, self.begin[at], self.begin[at + 1] - self.begin[at]


def piece_starts(points: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each code point; ``borders``: the texts' places."""
    n = len(points)
    kind = class_table()[points]
    opens = np.zeros(n + 1, bool)
    opens[borders] = True  # first code point of a text, or the end
    run = opens[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    # The last blank before other characters is cut off the blanks before it;
    # a plain space joins what follows.
    ahead = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~opens[1:n])
    start[ahead] = True
    plain = ahead[points[ahead] == 32]
    start[plain + 1] = False
    # An apostrophe that opens a piece takes a contraction's letters.
    mark = np.flatnonzero((points[:-1] == 39) & start[:-1] & (kind[1:] == LETTER) & ~opens[1:n])
    if len(mark):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[mark + 1], padded[mark + 2]
        inside = ~opens[np.minimum(mark + 2, n)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        double = inside & np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")])
        taken = np.where(short, 1, np.where(double, 2, 0))
        mark, taken = mark[taken > 0], taken[taken > 0]
        start[mark + 1] = False
        rest = mark + 1 + taken
        rest = rest[rest < n]
        rest = rest[(kind[rest] == LETTER) & ~opens[rest]]
        start[rest] = True
    return start


def cut(data: np.ndarray, offsets: np.ndarray) -> Pieces:
    """Pieces of the texts of a slice (UTF-8 bytes and offsets)."""
    text = data.tobytes().decode("utf-8")
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum(LEAD[data], out=lead[1:])
    borders = lead[offsets]
    if not len(points):
        none = np.zeros(0, np.int64)
        return Pieces("", none, none, none.astype(np.uint64), none, np.zeros(len(offsets), np.int64))
    start = np.flatnonzero(piece_starts(points, borders))
    end = np.append(start[1:], len(points))
    codes = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(start, start[at] + tx.PIECE_BYTES)))
        low, high = start[at], end[stop - 1]
        codes[at:stop] = tx.span_hashes(tx.mix(points[low:high].astype(np.uint64) + np.uint64(1)), start[at:stop] - low, end[at:stop] - low)
        at = stop
    code, seen = pd.factorize(codes)
    where = np.empty(len(seen), np.int64)
    where[code[::-1]] = np.arange(len(code))[::-1]
    return Pieces(text, start[where], end[where], seen, code, np.searchsorted(start, borders))
