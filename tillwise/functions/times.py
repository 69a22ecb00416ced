"""Parsing and formatting of times."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillwise.functions.columns import col

# Strftime directives and their Java letters.
STRFTIME = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss",
    "%f": "SSSSSS", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%p": "a", "%z": "xx",
}
# Accepted timestamp layouts, first match wins.
LAYOUTS = (
    "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f",
    "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%d", "%m/%d/%Y %H:%M:%S", "%m/%d/%Y",
)


def java_pattern(strftime: str, override: dict[str, str] | None = None) -> str:
    letters = STRFTIME | (override or {})
    out, i, literal = [], 0, ""

    def flush():
        nonlocal literal
        if literal:
            out.append("'" + literal + "'" if any(ch.isalpha() for ch in literal) else literal)
        literal = ""

    while i < len(strftime):
        two = strftime[i : i + 2]
        if two in letters:
            flush()
            out.append(letters[two])
            i += 2
        else:
            literal += strftime[i]
            i += 1
    flush()
    return "".join(out)


# How a directive is read: lenient Java letters and the text it may match.
READ = {
    "%Y": ("yyyy", r"\d{4}"), "%m": ("M", r"\d{1,2}"), "%d": ("d", r"\d{1,2}"), "%H": ("H", r"\d{1,2}"),
    "%I": ("h", r"\d{1,2}"), "%M": ("m", r"\d{1,2}"), "%S": ("s", r"\d{1,2}"), "%y": ("yy", r"\d{2}"),
    "%f": ("[SSSSSS][SSSSS][SSSS][SSS][SS][S]", r"\d{1,6}"),
}


def parse(c: str | Column, layout: str) -> Column:
    """Timestamp, or null where the text does not have the strftime layout.

    A regular expression screens the text first, because a failing parse costs
    an exception per row.
    """
    pieces = re.split(r"(%[A-Za-z])", layout)
    shape = "".join(READ[x][1] if x in READ else (r"\w+" if x.startswith("%") else re.escape(x)) for x in pieces)
    pattern = java_pattern(layout, {k: v[0] for k, v in READ.items()})
    text = col(c).cast("string")
    return F.when(text.rlike(f"^{shape}$"), F.try_to_timestamp(text, F.lit(pattern)))


def parse_any(c: str | Column, layouts=LAYOUTS) -> Column:
    return F.coalesce(*[parse(c, p) for p in layouts])


def iso(ts: Column) -> Column:
    """ISO text; the fraction only where there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.unix_micros(ts) % 1_000_000
    return F.when(micros == 0, whole).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def standardize(c: str | Column) -> Column:
    """First matching layout as ISO text, other text unchanged."""
    text = col(c).cast("string")
    return F.coalesce(iso(parse_any(text)), text)


def sunday_week(ts: Column) -> Column:
    """Start of the week, weeks starting on Sunday."""
    return F.date_sub(F.to_date(ts), F.dayofweek(ts) - 1)
