"""Secret scans with a linear-chain conditional random field.

Words of each line are tagged outside, begin or inside by Viterbi decoding.
Features of a word: length, character classes, digits and changes between
letters and digits, its first letters, the words before it, the shape of the
next one, and how much of the text looks like a file of settings. Spans of
fixed forms (``base_spans``) are always reported; tagged spans that go beyond
any one of them are added as kind ``crf``, overlapping ones too.

The field is fitted on windows of about ``fit_words`` words, cut from the whole
texts of ``sample_rows`` documents (smallest hash of the id): by hash of the
window ``fit_windows`` that may hold a base span and ``plain_windows`` others.
These documented bounds are all that reaches the driver. Words under a base span
are tagged as secret there; and generated credentials of other forms are put
into copies of the lines, so that shape and neighbours are learned rather than
the fixed forms alone. Scanning reads every text whole, and what decoding tags
is reported.

Null and empty texts have no spans. Repeated rows are scanned one by one; an
empty table gives an empty result, and a field of zero weights marks nothing.
Columns other than id and text are not read (``redacted`` passes them on).
"""

from __future__ import annotations

import random
import re
import string
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm import crf
from tillwise.llm import text as tx
from tillwise.llm.features import DIGIT, LEAD, LOWER, UPPER, Lines, span_counts

OUTSIDE, BEGIN, INSIDE = 0, 1, 2
KINDS = ("assign", "access", "hex", "crf")

# Fixed forms that the contract names.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Where a base span may start, for the choice of what to fit on.
LIKELY = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""
LONG_HEX = re.compile(r"[0-9a-f]{24,}")


@dataclass(frozen=True)
class Params:
    sample_rows: int = 3_000
    fit_windows: int = 2_500  # windows that may hold a base span
    plain_windows: int = 500  # and others
    fit_words: int = 120  # words of a window
    epochs: int = 40


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of the fixed forms, by start, then kind as listed."""
    found = []
    if "=" in text or ":" in text:  # the form needs one of them
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if LONG_HEX.search(text):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return [(a, b, KINDS[k]) for a, k, b in sorted(found)]


#: Slots and their numbers of ids.
SLOTS = {"length": 10, "classes": 256, "digits": 25, "head": 512, "before": 1024, "before_two": 1024, "next": 256, "file": 5}
_BASES = np.concatenate([[0], np.cumsum(list(SLOTS.values()))])
N_IDS = int(_BASES[-1])
_LENGTHS = np.array([3, 5, 8, 12, 16, 20, 28, 40, 64])
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[ord(c) for c in "._-/+"]] = True


def word_slots(words: tx.Words, lines: Lines) -> np.ndarray:
    """(words, features) feature ids; neighbours are those of the line."""
    data, start, end = words.data, words.start, words.end
    n = len(start)
    length = end - start
    count = lambda mask: span_counts(mask, start, end)
    digits, upper, lower = count(DIGIT[data]), count(UPPER[data]), count(LOWER[data])
    other = data >= 128
    kinds = np.where(DIGIT[data], 1, np.where(UPPER[data] | LOWER[data], 2, 0)).astype(np.int8)
    change = np.zeros(len(data), bool)
    change[1:] = (kinds[1:] != kinds[:-1]) & (kinds[1:] > 0) & (kinds[:-1] > 0)
    inner = start + 1
    changes = span_counts(change, np.minimum(inner, end), end)
    flags = (digits > 0, upper > 0, lower > 0, count(data == ord("=")) > 0, count((data == 34) | (data == 39)) > 0, count(_PUNCTUATION[data]) > 0, count(other) > 0, count((data == ord(":")) | (data == ord("@"))) > 0)
    classes = sum(f.astype(np.int64) << k for k, f in enumerate(flags))
    # Letters of the word without quotes and marks, as its name to its neighbours.
    name = words.hash
    head = np.zeros(n, np.uint64)
    for k in range(4):
        at = start + k
        head = head * np.uint64(257) + np.where(at < end, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint64)
    line = np.repeat(np.arange(len(lines.n_words)), np.diff(np.concatenate([lines.word, lines.word_end[-1:]])))

    def neighbour(values: np.ndarray, step: int, none: int) -> np.ndarray:
        out = np.full(n, none, np.int64)
        if step < 0:
            same = line[-step:] == line[:step]
            out[-step:][same] = values[:step][same]
        else:
            same = line[:-step] == line[step:]
            out[:-step][same] = values[step:][same]
        return out

    named = (name % np.uint64(1023)).astype(np.int64) + 1
    odd = (digits > 0).astype(np.int64)
    share = tx.per_doc(odd, words.first) / np.maximum(words.counts, 1)
    columns = [
        np.searchsorted(_LENGTHS, length, side="right"),
        classes,
        np.minimum(digits * 4 // np.maximum(length, 1), 4) * 5 + np.minimum(changes, 4),
        (tx.mix(head) % np.uint64(512)).astype(np.int64),
        neighbour(named, -1, 0),
        neighbour(named, -2, 0),
        neighbour(classes, 1, 0),
        np.searchsorted([0.005, 0.02, 0.1, 0.3], share)[words.doc],
    ]
    return np.stack([c + _BASES[k] for k, c in enumerate(columns)], axis=1)


def line_borders(words: tx.Words, lines: Lines) -> np.ndarray:
    return np.concatenate([lines.word, [len(words.start)]])


def tagged_spans(words: tx.Words, tags: np.ndarray) -> list[tuple[int, int, int]]:
    """Text, first and last byte (exclusive) of the tagged spans, without
    surrounding quotes and marks."""
    out = []
    for k in np.flatnonzero(tags == BEGIN).tolist():
        stop = k + 1
        while stop < len(tags) and tags[stop] == INSIDE and words.doc[stop] == words.doc[k]:
            stop += 1
        raw = words.data[words.start[k] : words.end[stop - 1]].tobytes()
        left = len(raw) - len(raw.lstrip(b"\"'(<[{,;"))
        right = len(raw.rstrip(b"\"')>]},;.:"))
        if right > left:
            out.append((int(words.doc[k]), int(words.start[k]) + left, int(words.start[k]) + right))
    return out


def scan_slice(data: np.ndarray, offsets: np.ndarray, chain: crf.Chain, p: Params) -> list[list[tuple[int, int, str]]]:
    """All spans of each text of a slice, in code points, in order."""
    texts = [tx.text_at(data, a, b) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    found = [base_spans(t) for t in texts]
    words = tx.words_of(data, offsets)
    if not len(words.start):
        return found
    lines = Lines(words)
    tags = chain.decode(chain.emissions(word_slots(words, lines)), line_borders(words, lines))
    spans = tagged_spans(words, tags)
    if spans:
        points = np.zeros(len(data) + 1, np.int64)
        np.cumsum(LEAD[data], out=points[1:])
        reach: dict[int, tuple[list[int], list[int]]] = {}  # of the base spans: starts, farthest end so far
        for doc, a, b in spans:
            low, high = int(points[a] - points[offsets[doc]]), int(points[b] - points[offsets[doc]])
            if doc not in reach:
                base = sorted(found[doc])
                reach[doc] = [s for s, _, _ in base], list(accumulate((e for _, e, _ in base), max))
            starts, ends = reach[doc]
            before = bisect_right(starts, low)
            if not before or ends[before - 1] < high:
                found[doc].append((low, high, "crf"))
    order = {k: i for i, k in enumerate(KINDS)}
    return [sorted(f, key=lambda x: (x[0], order[x[2]])) for f in found]


def _credential(r: random.Random) -> tuple[list[str], int]:
    """Words of a generated credential and how many of them lead up to it."""
    letters, hexes = string.ascii_letters + string.digits, "0123456789abcdef"
    make = lambda alphabet, a, b: "".join(r.choice(alphabet) for _ in range(r.randint(a, b)))
    form = r.randrange(10)  # short ones take what is left
    if form == 0:
        return ["Bearer", make(letters + "-_", 24, 60)], 1
    if form == 1:
        return [r.choice(["ghp_", "gho_", "pat_", "sk_live_", "glpat-", "xoxb-", "key-"]) + make(letters, 20, 40)], 0
    if form == 2:
        return ["eyJ" + make(letters, 16, 30) + "." + make(letters, 20, 60) + "." + make(letters + "-_", 20, 43)], 0
    if form == 3:
        return [r.choice(["passphrase", "credential", "private_key", "client_secret", "auth", "pwd"]), r.choice(["=", ":"]), '"' + make(letters + "+/!%", 14, 40) + '"'], 2
    if form == 4:
        return [make(letters + "+/", 32, 60) + r.choice(["", "=", "=="])], 0
    if form == 5:
        return [r.choice(["pwd", "auth", "credential"]) + r.choice(["=", ":"]) + make(letters, 12, 32)], 0
    if form == 6:
        return [make("ABCDEFGHJKLMNPQRSTUVWXYZ23456789", 20, 32)], 0
    name, mark, value = r.choice(["pwd", "pwd", "pass", "passphrase", "credential"]), r.choice("=:"), make(letters + "#!%$@&*", 8, 14)
    return r.choice([([name + mark, value], 1), ([name, mark, value], 2), ([name + mark + value], 0)])


def _plain(r: random.Random) -> str:
    """A word that looks odd but is no secret."""
    number = lambda a: "".join(r.choice(string.digits) for _ in range(a))
    word = lambda a: "".join(r.choice(string.ascii_lowercase) for _ in range(a))
    return r.choice(
        [
            f"{word(6)}.{number(2)}@{word(5)}{number(1)}.example.com",
            f"https://{word(8)}.example.org/{word(6)}/{number(5)}?{word(3)}={number(4)}",
            number(16),
            f"{number(4)}-{number(2)}-{number(2)}",
            f"+{number(11)}",
            ".".join(number(2) for _ in range(4)),
            word(25),
            word(14).upper(),
            f"{word(9)}_{word(8)}_{number(1)}",
            f"v{number(1)}.{number(2)}.{number(1)}",
            f"{word(10)}-{word(9)}-{word(8)}",
            number(9) + ".",
        ]
    )


def examples(texts: list[str], p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots, tags and line borders to fit on, from the words of windows."""
    r = random.Random(11)
    lines_out, tags_out = [], []
    for text in texts:
        spans = base_spans(text)
        at = taken = 0
        for line in text.split("\n"):
            if taken >= p.fit_words:
                break
            words = [(m.start() + at, m.end() + at) for m in re.finditer(r"[^\x20\x09-\x0D]+", line)][: p.fit_words]
            tags = []
            for a, b in words:
                hit = next((k for k, (s, e, _) in enumerate(spans) if s < b and a < e), None)
                tags.append((hit, text[a:b]))
            at += len(line) + 1
            taken += len(words)
            if not tags:
                continue
            marks = [OUTSIDE if h is None else INSIDE if k and tags[k - 1][0] == h else BEGIN for k, (h, _) in enumerate(tags)]
            plain = [w for _, w in tags]
            lines_out.append(plain)
            tags_out.append(marks)
            put = r.randint(0, len(plain))
            if all(m == OUTSIDE for m in marks):
                secret, lead = _credential(r)
                added = [OUTSIDE] * lead + [BEGIN]
                if r.random() < 0.5:
                    secret, added = [_plain(r)], [OUTSIDE]
                lines_out.append(plain[:put] + secret + plain[put:])
                tags_out.append(marks[:put] + added + marks[put:])
    joined = [" ".join(x) for x in lines_out]
    slots, gold, first = [np.zeros((0, len(SLOTS)), np.int64)], [], [0]
    for rows, data, offsets in tx.slices(pa.record_batch([pa.array(joined, pa.string())], names=["text"]), "text"):
        words = tx.words_of(data, offsets)
        slots.append(word_slots(words, Lines(words)))
    for marks in tags_out:
        gold += marks
        first.append(len(gold))
    return np.concatenate(slots), np.array(gold, np.int64), np.array(first, np.int64)


def windows(text: str, width: int) -> list[str]:
    """The whole text in stretches of at most ``width`` characters that end
    behind a line or, in long lines, behind a blank."""
    out, at = [], 0
    while at < len(text):
        stop = at + width
        if stop < len(text):
            border = text.rfind("\n", at + width // 2, stop)
            border = border if border > at else text.rfind(" ", at, stop)
            stop = border + 1 if border > at else stop
        out.append(text[at:stop])
        at = stop
    return out


def sample(docs: DataFrame, id_column: str, text_column: str, p: Params) -> list[str]:
    """Windows to fit on: of the whole texts of ``sample_rows`` documents, those
    of smallest hash, ``fit_windows`` with something likely and ``plain_windows``
    without. Equal windows count once."""
    ids = docs.where(F.col(id_column).isNotNull()).select(id_column).distinct().orderBy(F.xxhash64(id_column), id_column).limit(p.sample_rows)
    # At most sample_rows ids: the side that is sent out has a fixed bound.
    rows = docs.select(id_column, text_column).join(F.broadcast(ids), id_column).select(text_column)

    def run(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = windows(text or "", 8 * p.fit_words)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["w"])

    cut = rows.mapInArrow(run, "w string").distinct().withColumn("likely", F.col("w").rlike(LIKELY))
    first = lambda likely, n: cut.where(F.col("likely") == likely).orderBy(F.xxhash64("w"), "w").limit(n)
    both = first(True, p.fit_windows).unionByName(first(False, p.plain_windows))
    return [r[0] for r in sorted(both.select("w", "likely").collect(), key=lambda r: (not r[1], r[0]))]


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", params: Params | None = None) -> crf.Chain:
    """Fit the field on a bounded sample of windows."""
    p = params or Params()
    slots, gold, first = examples(sample(docs, id_column, text_column, p), p)
    return crf.fit(slots, gold, first, N_IDS, 3, p.epochs, forbidden=((OUTSIDE, INSIDE),), not_first=(INSIDE,))


def _span_type() -> str:
    return "array<struct<start: bigint, end: bigint, kind: string>>"


def scan(docs: DataFrame, chain: crf.Chain, id_column: str = "doc_id", text_column: str = "text", params: Params | None = None) -> DataFrame:
    """id and spans (start, end in code points, kind) of each row."""
    p = params or Params()
    struct = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches):
        for batch in batches:
            for rows, data, offsets in tx.slices(batch, text_column):
                found = [[{"start": a, "end": b, "kind": k} for a, b, k in spans] for spans in scan_slice(data, offsets, chain, p)]
                yield pa.RecordBatch.from_arrays([rows.column(id_column), pa.array(found, struct)], names=[id_column, "spans"])

    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {dict(docs.dtypes)[id_column]}, spans {_span_type()}")


def redact(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    """The text with every span (overlapping ones as one) replaced by the mark."""
    out, at = [], 0
    for start, end, _ in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, chain: crf.Chain, text_column: str = "text", mark: str = "<secret>", params: Params | None = None) -> DataFrame:
    """The rows, with all their columns, their texts without secrets."""
    p = params or Params()
    schema = docs.schema
    at = docs.columns.index(text_column)

    def run(batches):
        for batch in batches:
            for rows, data, offsets in tx.slices(batch, text_column):
                texts = rows.column(text_column).to_pylist()
                spans = scan_slice(data, offsets, chain, p)
                new = [redact(t, s, mark) if s else t for t, s in zip(texts, spans, strict=True)]
                columns = list(rows.columns)
                columns[at] = pa.array(new, rows.schema.field(text_column).type)
                yield pa.RecordBatch.from_arrays(columns, schema=rows.schema)

    return docs.mapInArrow(run, schema)
