"""String measures and parsers that need dynamic programming or a scanner: Arrow-batched UDFs."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Pairs whose measure a Python worker remembers; names of methods and tests repeat.
KNOWN = 1 << 16


@lru_cache(KNOWN)
def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, by bits: one integer step a character of ``b``."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@lru_cache(KNOWN)
def common_substring_length(a: str, b: str) -> int:
    """Longest common substring, ignoring case."""
    a, b = a.lower(), b.lower()
    best, last = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                row[j] = last[j - 1] + 1
                best = max(best, row[j])
        last = row
    return best


def _pairwise(measure):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([measure(x, y) for x, y in zip(a.fillna(""), b.fillna(""))], dtype="int32")

    return F.pandas_udf(run, "int")


def lcs(a: Column, b: Column) -> Column:
    return _pairwise(lcs_length)(a, b)


def common_substring(a: Column, b: Column) -> Column:
    return _pairwise(common_substring_length)(a, b)


def similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length; 0 for two blanks."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1.0 - F.levenshtein(a, b) / longest).otherwise(F.lit(0.0))


def strip_test_marker(name: Column) -> Column:
    """A class name without its test suffix, or else prefix; never stripped to nothing."""
    suffix = F.regexp_replace(name, r"(?i)(?<=.)(?:testcase|tests|test|_estest)$", "")
    prefix = F.regexp_replace(name, r"(?i)^tests?(?=.)", "")
    return F.when(suffix != name, suffix).otherwise(prefix)


def last_object(text: str | None) -> str | None:
    """JSON text that is an object, else the last embedded object with a list ``methods``."""
    decoder = json.JSONDecoder()
    text = (text or "").strip()
    try:
        if isinstance(json.loads(text), dict):
            return text
    except ValueError:
        pass
    found = None
    for at in (m.start() for m in re.finditer(r"\{", text)):
        try:
            value, _ = decoder.raw_decode(text, at)
        except ValueError:
            continue
        if isinstance(value, dict) and isinstance(value.get("methods"), list):
            found = json.dumps(value)
    return found


def lenient_json(text: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(last_object), "string")(text)


BLOCK_KEY = re.compile(r"^\s*[-*]?\s*(METHOD|CONFIDENCE|RATIONALE)\s*[:=]\s*(.*)$", re.I)


def text_blocks(text: str | None) -> list[dict]:
    """METHOD / CONFIDENCE / RATIONALE blocks of a plain-text answer; a METHOD opens a block."""
    blocks: list[dict] = []
    last = None
    for line in (text or "").splitlines():
        hit = BLOCK_KEY.match(line)
        if hit and (hit[1].upper() == "METHOD" or blocks):
            last = hit[1].lower()
            if last == "method":
                blocks.append({"method": "", "confidence": None, "rationale": ""})
            value = hit[2].strip()
            if last == "confidence":
                number = re.search(r"\d+(?:\.\d+)?", value)
                blocks[-1][last] = float(number[0]) if number else None
            else:
                blocks[-1][last] = value
        elif last == "rationale" and line.strip():
            blocks[-1]["rationale"] = f"{blocks[-1]['rationale']} {line.strip()}".strip()
    return blocks


def method_blocks(text: Column) -> Column:
    kind = "array<struct<method:string,confidence:double,rationale:string>>"
    return F.pandas_udf(lambda s: s.map(text_blocks), kind)(text)


HUNK = re.compile(r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@")


def diff_rows(diff: str | None) -> list[dict]:
    """Side-by-side rows of a unified diff; removed and added lines of one stretch stand in pairs."""
    rows: list[dict] = []
    old = new = 1
    gone: list[tuple[int, str]] = []
    come: list[tuple[int, str]] = []

    def flush():
        for k in range(max(len(gone), len(come))):
            a, b = (side[k] if k < len(side) else (None, None) for side in (gone, come))
            kind = "change" if a[0] and b[0] else "delete" if a[0] else "add"
            rows.append({"kind": kind, "old_line": a[0], "old_text": a[1], "new_line": b[0], "new_text": b[1]})
        gone.clear()
        come.clear()

    for line in (diff or "").split("\n"):
        if hit := HUNK.match(line):
            flush()
            old, new = int(hit[1]), int(hit[2])
        elif line.startswith(("---", "+++", "diff ", "index ", "\\")):
            continue
        elif line.startswith("-"):
            gone.append((old, line[1:]))
            old += 1
        elif line.startswith("+"):
            come.append((new, line[1:]))
            new += 1
        elif line.startswith(" "):
            flush()
            rows.append({"kind": "same", "old_line": old, "old_text": line[1:], "new_line": new, "new_text": line[1:]})
            old, new = old + 1, new + 1
    flush()
    return rows


def parsed_diff(diff: Column) -> Column:
    kind = "array<struct<kind:string,old_line:int,old_text:string,new_line:int,new_text:string>>"
    return F.pandas_udf(lambda s: s.map(diff_rows), kind)(diff)
