"""Commit dates in many formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIMES = ("h:mm:ss a", "h:mm a", "H:mm:ss", "H:mm", "")
FALLBACKS = (
    "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd",
)


def normal_date(value: Column) -> Column:
    """Plain blanks; ``00:mm AM`` becomes ``12:mm AM``; no AM or PM after an hour beyond 12."""
    text = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\s  ]+", " "))
    text = F.regexp_replace(text, r"\b00?(:\d{2}(?::\d{2})?\s*[AaPp][Mm])", "12$1")
    return F.regexp_replace(text, r"\b((?:1[3-9]|2[0-3]):\d{2}(?::\d{2})?)\s*[AaPp][Mm]\b", "$1")


def date_order(value: Column) -> Column:
    """``ymd``, ``mdy`` or ``dmy``: year first by its size, day first unless that is impossible."""
    text = normal_date(value)
    pattern = r"^(\d{1,4})[/.\-](\d{1,2})[/.\-](\d{1,4})"
    first = F.regexp_extract(text, pattern, 1)
    a, b = first.try_cast("int"), F.regexp_extract(text, pattern, 2).try_cast("int")
    return (
        F.when((F.length(first) == 4) | (a > 31), "ymd").when((b > 12) & (a <= 12), "mdy").when(a.isNotNull(), "dmy")
    )


def parse_commit_date(value: Column) -> Column:
    """A timestamp, or null where no format fits."""
    text = F.regexp_replace(normal_date(value), r",\s*", " ")
    plain = F.upper(F.regexp_replace(text, r"(?<=\d)[/.](?=\d)", "-"))
    order = date_order(value)
    tries = []
    for name, dates in (
        ("ymd", ("yyyy-M-d", "yy-M-d")), ("mdy", ("M-d-yyyy", "M-d-yy")), ("dmy", ("d-M-yyyy", "d-M-yy")),
    ):
        # A two-digit year only where the text has one.
        short = F.rlike(plain, F.lit(r"^\d{1,2}-\d{1,2}-\d{2}(?!\d)"))
        for date, fits in zip(dates, (~short, short)):
            for time in TIMES:
                form = f"{date} {time}".strip()
                tries.append(F.when((order == name) & fits, F.try_to_timestamp(plain, F.lit(form))))
    tries += [F.try_to_timestamp(text, F.lit(f)) for f in FALLBACKS]
    return F.coalesce(*tries)


def days_between(a: Column, b: Column) -> Column:
    return F.abs(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 86_400e6
