"""Format-preserving pseudonyms for personal data in texts.

Values are found by form and checked (Luhn digit, mod-97 remainder, number
ranges, calendar). Each is then permuted by a keyed Feistel network within the
set of values of its own form, so a card number becomes another valid card
number, a date another date, an address another address. The network works on
the bare value, without separators, and depends on kind and length only: equal
values get equal pseudonyms in every document and every notation, and whoever
has the key can turn them back (``restore``).

Rounds add a keyed hash of one half to the other half, modulo the size of that
half, which is a permutation for halves of any size. Where a form is no full
product of digits (dates), values outside are permuted again until they are
inside.

Null texts stay null, empty texts stay empty; a text without values stays as it
is. Repeated rows give equal rows; an empty table gives an empty result.
Columns other than id and text are not read.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "iban", "date", "ip", "ssn", "phone", "card")
ROUNDS = 8
DEFAULT_KEY = b"change me: pseudonyms are as secret as this key"


class Feistel:
    """Keyed permutation of the numbers below ``size``."""

    def __init__(self, key: bytes, name: str, size: int):
        self.size = size
        self.right = max(1, int(size**0.5)) if size < 1 << 52 else 1 << (size.bit_length() // 2)
        self.left = -(-size // self.right)
        self.key = hashlib.blake2b(f"{name}/{size}".encode(), key=hashlib.sha256(key).digest()).digest()[:32]

    def _hash(self, round_: int, half: int) -> int:
        data = round_.to_bytes(1, "little") + half.to_bytes((half.bit_length() + 8) // 8, "little")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest(), "little")

    def _once(self, value: int, back: bool) -> int:
        a, b = divmod(value, self.right)
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if r % 2:
                b = (b + sign * self._hash(r, a)) % self.right
            else:
                a = (a + sign * self._hash(r, b)) % self.left
        return a * self.right + b

    def __call__(self, value: int, back: bool = False) -> int:
        value = self._once(value, back)
        while value >= self.size:
            value = self._once(value, back)
        return value


def luhn_digit(digits: str) -> str:
    """Check digit that makes digits + it pass the Luhn test."""
    total = sum(sum(divmod(int(d) * (2 - k % 2), 10)) for k, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text))


def _refill(form: str, chars: str, keep: Callable[[str], bool]) -> str:
    """The form with each character that ``keep`` calls part of the value replaced."""
    fresh = iter(chars)
    return "".join(next(fresh) if keep(c) else c for c in form)


class Permuter:
    """Pseudonyms of single values under a key; ``back`` turns them back."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = key, back
        self.networks: dict[tuple[str, int], Feistel] = {}

    def _permute(self, kind: str, value: int, size: int) -> int:
        if (kind, size) not in self.networks:
            self.networks[kind, size] = Feistel(self.key, kind, size)
        return self.networks[kind, size](value, self.back)

    def _mixed(self, kind: str, text: str) -> str:
        """Letters among letters, digits among digits; other characters stay."""
        alphabets = ["0123456789" if c in "0123456789" else "abcdefghijklmnopqrstuvwxyz" for c in text if c in "0123456789abcdefghijklmnopqrstuvwxyz"]
        value, size = 0, 1
        for c, alphabet in zip((c for c in text if c in "0123456789abcdefghijklmnopqrstuvwxyz"), alphabets, strict=True):
            value, size = value * len(alphabet) + alphabet.index(c), size * len(alphabet)
        shape = "".join("9" if a[0] == "0" else "a" for a in alphabets)
        value = self._permute(f"{kind}:{shape}", value, size)
        out = []
        for alphabet in reversed(alphabets):
            value, k = divmod(value, len(alphabet))
            out.append(alphabet[k])
        return _refill(text, "".join(reversed(out)), lambda c: c in "0123456789abcdefghijklmnopqrstuvwxyz")

    def email(self, text: str) -> str | None:
        local, _, domain = text.lower().partition("@")
        name, dot, top = domain.rpartition(".")
        return f"{self._mixed('email', local)}@{self._mixed('domain', name)}{dot}{top}"

    def card(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        size = 10 ** (len(digits) - 1)
        body = str(self._permute("card", int(digits[:-1]), size)).zfill(len(digits) - 1)
        if len(set(body + luhn_digit(body))) == 1:  # such a number would not be taken for a card
            body = str(self._permute("card", int(body), size)).zfill(len(digits) - 1)
        return _refill(text, body + luhn_digit(body), str.isdigit)

    def ssn(self, text: str) -> str | None:
        area, group, serial = int(text[:3]), int(text[4:6]), int(text[7:])
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        # 898 areas, 99 groups, 9999 serials
        place = area - 1 - (area > 666)
        value = self._permute("ssn", (place * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999)
        value, serial = divmod(value, 9999)
        place, group = divmod(value, 99)
        area = place + 1 + (place >= 665)
        return f"{area:03}{text[3]}{group + 1:02}{text[6]}{serial + 1:04}"

    def ip(self, text: str) -> str | None:
        parts = [int(x) for x in text.split(".")]
        if max(parts) > 255 or any(str(v) != x for v, x in zip(parts, text.split("."), strict=True)):
            return None
        value = self._permute("ip", int.from_bytes(bytes(parts), "big"), 1 << 32)
        return ".".join(map(str, value.to_bytes(4, "big")))

    def phone(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if len(digits) == 10 or len(digits) == 11 and digits[0] == "1":  # North American plan
            code, number = digits[:-10], digits[-10:]
            if number[0] in "01" or number[3] in "01":
                return None
            area, exchange, line = int(number[:3]) - 200, int(number[3:6]) - 200, int(number[6:])
            value = self._permute("phone-na", (area * 800 + exchange) * 10_000 + line, 800 * 800 * 10_000)
            value, line = divmod(value, 10_000)
            area, exchange = divmod(value, 800)
            return _refill(text, f"{code}{area + 200}{exchange + 200}{line:04}", str.isdigit)
        if not text.startswith("+") or not 8 <= len(digits) <= 15 or digits[0] == "0":
            return None
        head, tail = digits[:2], digits[2:]
        value = self._permute("phone", int(tail), 10 ** len(tail))
        return _refill(text, head + str(value).zfill(len(tail)), str.isdigit)

    def iban(self, text: str) -> str | None:
        bare = text.replace(" ", "")
        if not 15 <= len(bare) <= 34 or _iban_number(bare[4:] + bare[:4]) % 97 != 1:
            return None
        body = self._mixed("iban" + bare[:2], bare[4:].lower()).upper()
        check = 98 - _iban_number(body + bare[:2] + "00") % 97
        return _refill(text, f"{bare[:2]}{check:02}{body}", lambda c: c != " ")

    _FIRST, _DAYS = datetime.date(1900, 1, 1).toordinal(), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days

    def date(self, text: str) -> str | None:
        parts = [int(x) for x in re.split(r"[-/.]", text)]
        mark = text[4] if text[:4].isdigit() else text[2]
        iso = text[:4].isdigit()
        year, month, day = parts if iso else parts[::-1]
        american = False
        try:
            value = datetime.date(year, month, day)
        except ValueError:
            if iso or mark != "/":
                return None
            try:
                value, american = datetime.date(year, day, month), True
            except ValueError:
                return None
        place = value.toordinal() - self._FIRST
        if not 0 <= place < self._DAYS:
            return None
        new = datetime.date.fromordinal(self._FIRST + self._permute("date", place, self._DAYS))
        if american and new.day <= 12:
            # Read back, it would be taken day first: go on until the order is plain.
            while new.day <= 12:
                new = datetime.date.fromordinal(self._FIRST + self._permute("date", new.toordinal() - self._FIRST, self._DAYS))
        if iso:
            return f"{new.year:04}{mark}{new.month:02}{mark}{new.day:02}"
        first, second = (new.month, new.day) if american else (new.day, new.month)
        return f"{first:02}{mark}{second:02}{mark}{new.year:04}"


#: Forms, in order of precedence where two begin together or overlap.
FORMS = {
    "email": re.compile(r"(?<![\w.+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-])", re.ASCII),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)", re.ASCII),
    "date": re.compile(r"(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![\w/-]|\.[0-9])"),
    "ip": re.compile(r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9])"),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}([- ])[0-9]{2}\1[0-9]{4}(?![\w-])"),
    "phone": re.compile(r"(?<![\w+])(?:\+1[-. ]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![\w-])|(?<!\w)\+[0-9]{1,3}(?:[-. ]?\(?[0-9]{2,4}\)?){2,5}(?![\w-])"),
    "card": re.compile(r"(?<![\w-])[0-9](?:[- ]?[0-9]){12,}(?![\w-])"),  # runs of digit groups, cards are looked for inside
}
#: Lengths of IBANs by country.
IBAN_LENGTH = {
    c: int(n)
    for n, names in (x.split(":") for x in "15:NO 16:BE 18:DK FI FO GL NL 19:MK SI 20:AT BA EE KZ LT LU XK 21:CH HR LI LV 22:BG BH CR DE GB GE IE ME RS VA 23:AE GI IL TL 24:AD CZ ES MD PK RO SA SE SK TN VG 25:PT 26:IS TR 27:FR GR IT MC MR SM 28:AL AZ CY DO GT HU LB PL 29:BR PS QA UA 30:JO KW MU 31:MT SC".replace(" 1", "|1").replace(" 2", "|2").replace(" 3", "|3").split("|"))
    for c in names.split()
}
#: Groups of digits that cards are printed in; one group alone is a card as well.
CARD_GROUPS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4)}
_HINT = re.compile(r"[0-9]|@")


@dataclass(frozen=True)
class Found:
    start: int
    end: int
    kind: str
    new: str


def card_spans(run: str, closed: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Cards of a run of digit groups, left to right: printed groupings before
    others, then longer before shorter ones, none of them touching ``closed``."""
    groups = [g.span() for g in re.finditer("[0-9]+", run)]
    free: list[tuple[bool, int, int]] = []
    for i, (start, _) in enumerate(groups):
        digits, sizes = "", []
        for first, end in groups[i:]:
            digits += run[first:end]
            sizes.append(end - first)
            if len(digits) > 19:
                break
            if len(digits) < 13 or any(start < b and a < end for a, b in closed):
                continue
            if luhn_digit(digits[:-1]) == digits[-1] and len(set(digits)) > 1:
                free.append((not (len(sizes) == 1 or tuple(sizes) in CARD_GROUPS), start, -end))
    taken: list[tuple[int, int]] = []
    for _, start, end in sorted(free):
        if not any(start < b and a < -end for a, b in taken):
            taken.append((start, -end))
    return sorted(taken)


def iban_spans(run: str, closed: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The IBAN that a run of blocks begins with: the length of its country
    before others, then longer before shorter ones."""
    ends = [g.end() for g in re.finditer("[A-Z0-9]+", run)]
    bare = {end: run[:end].replace(" ", "") for end in ends}
    for end in sorted(ends, key=lambda e: (len(bare[e]) != IBAN_LENGTH.get(run[:2]), -e)):
        if 15 <= len(bare[end]) <= 34 and _iban_number(bare[end][4:] + bare[end][:4]) % 97 == 1 and not any(a < end and 0 < b for a, b in closed):
            return [(0, end)]
    return []


def _grouped(text: str, kind: str, form: re.Pattern, permuter: Permuter, taken: Taken) -> list[Found]:
    """Values of a kind whose groups may stand beside other groups.

    Values of a run are permuted together until the same places are found in the
    new run, so that turning back finds them again."""
    spans_of = iban_spans if kind == "iban" else card_spans
    out: list[Found] = []
    m = form.search(text)
    while m:
        low, run, next_ = m.start(), m.group(), m.start() + 1
        closed = [(f.start - low, f.end - low) for f in taken.between(low, m.end())]
        spans = spans_of(run, closed)
        new = run
        while spans:
            for a, b in spans:
                new = new[:a] + getattr(permuter, kind)(new[a:b]) + new[b:]
            if spans_of(new, closed) == spans:
                break
        out += [Found(low + a, low + b, kind, new[a:b]) for a, b in spans]
        if spans:
            next_ = low + spans[-1][1]
        if kind == "card":  # a run has been searched whole
            next_ = m.end()
        m = form.search(text, next_)
    return out


class Taken:
    """Found values, apart and in order, so that a place is looked up by bisection."""

    def __init__(self) -> None:
        self.found: list[Found] = []
        self.starts: list[int] = []

    def between(self, low: int, high: int) -> list[Found]:
        """Values that share a character with [low, high)."""
        first = max(0, bisect_right(self.starts, low) - 1)
        return [f for f in self.found[first : bisect_left(self.starts, high)] if low < f.end]

    def add(self, new: list[Found]) -> None:
        if new:
            self.found = sorted([*self.found, *new], key=lambda f: f.start)
            self.starts = [f.start for f in self.found]


def find(text: str, permuter: Permuter) -> list[Found]:
    """Checked values of a text with their pseudonyms, from left to right
    without overlaps; of two that overlap the kind named first wins."""
    if not _HINT.search(text):
        return []
    taken = Taken()
    for kind, form in FORMS.items():
        if kind == "email" and "@" not in text:
            continue
        if kind in ("iban", "card"):
            taken.add(_grouped(text, kind, form, permuter, taken))
            continue
        new = []
        for m in form.finditer(text):
            if not taken.between(m.start(), m.end()) and (value := getattr(permuter, kind)(m.group())) is not None:
                new.append(Found(m.start(), m.end(), kind, value))
        taken.add(new)  # matches of one form never overlap
    return taken.found


def replaced(text: str, found: list[Found]) -> str:
    out, at = [], 0
    for f in found:
        out += [text[at : f.start], f.new]
        at = f.end
    return "".join([*out, text[at:]])


def _mapped(docs: DataFrame, id_column: str, text_column: str, key: bytes, back: bool) -> DataFrame:
    kind = dict(docs.dtypes)[id_column]
    schema = ", ".join([f"`{id_column}` {kind}", f"`{text_column}` string", *(f"n_{k} bigint" for k in KINDS)])

    def run(batches):
        permuter = Permuter(key, back)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                texts = part.column(text_column).to_pylist()
                found = [find(t, permuter) if t else [] for t in texts]
                new = [replaced(t, f) if f else t for t, f in zip(texts, found, strict=True)]
                counts = [pa.array([sum(x.kind == k for x in f) for f in found], pa.int64()) for k in KINDS]
                yield pa.RecordBatch.from_arrays([part.column(id_column), pa.array(new, pa.string()), *counts], names=[id_column, text_column, *(f"n_{k}" for k in KINDS)])

    return docs.select(id_column, text_column).mapInArrow(run, schema)


def pseudonymize(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", key: bytes = DEFAULT_KEY) -> DataFrame:
    """id, text with pseudonyms, and the number of values of each kind."""
    return _mapped(docs, id_column, text_column, key, False)


def restore(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", key: bytes = DEFAULT_KEY) -> DataFrame:
    """Inverse of ``pseudonymize`` under the same key (e-mail in lower case)."""
    return _mapped(docs, id_column, text_column, key, True)
