"""Numbers in text, code predicates, URLs, smells and signatures, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Modifiers that may stand before a return type.
MODIFIERS = (
    "public", "protected", "private", "static", "final", "abstract", "synchronized", "native", "strictfp", "default",
)


def blank(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def number(column: Column) -> Column:
    """A number or null, whatever the text."""
    return column.try_cast("double")


def whole(column: Column, kind: str = "long") -> Column:
    """An integer from integer-like or float-like text (``72.0``); null otherwise."""
    value = number(column)
    return F.when(value == F.rint(value), value).try_cast(kind)


def normal_integer(column: Column) -> Column:
    """Float-shaped integers lose their fraction; other text stays; null is blank."""
    return F.coalesce(whole(column).cast("string"), blank(column))


def round_even(column: Column, digits: int = 2) -> Column:
    """Scaled rounding, ties to even."""
    return F.rint(column * 10.0**digits) / 10.0**digits


def percent(part: Column, of: Column) -> Column:
    """Share in percent with two digits; 0 where there is nothing to share."""
    return F.when(of > 0, round_even(part / of * 100.0)).otherwise(F.lit(0.0))


def valid_loc(column: Column) -> Column:
    """A positive line count (truncated to an integer), else null."""
    value = number(column)
    value = F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)).cast("long")
    return F.when(value > 0, value)


def method_loc(start: Column, end: Column) -> Column:
    """Lines from start to end as text, blank where either is no number."""
    return blank((whole(end) - whole(start) + 1).cast("string"))


# ---- code -----------------------------------------------------------------------------------


def is_empty_code(code: Column) -> Column:
    """Blank, a bare declaration, or no braces; an empty body is not empty."""
    body = F.regexp_replace(blank(code), r"^\s+|\s+$", "")
    opened, closed = F.contains(body, F.lit("{")), F.contains(body, F.lit("}"))
    return (body == "") | (F.endswith(body, F.lit(";")) & ~opened) | ~(opened & closed)


def quoted(name: Column) -> Column:
    return F.concat(F.lit(r"\Q"), name, F.lit(r"\E"))


def line_count(start: Column, end: Column, code: Column) -> Column:
    """Lines by their numbers, at least 0; by the code where a number is missing."""
    lines = F.split(blank(code), r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85  ]")
    n = F.size(lines) - F.when(F.element_at(lines, -1) == "", 1).otherwise(0)
    by_number = F.floor(number(end)) - F.floor(number(start)) + 1  # null where a number is missing
    return F.when(by_number.isNull(), n).otherwise(F.greatest(by_number, F.lit(0))).cast("long")


def parameter_count(code: Column, name: Column) -> Column:
    """Parameters of the first ``name(...)``; null where there is none."""
    pattern = F.concat(F.lit(r"(?s)\b"), quoted(name), F.lit(r"\s*\(([^)]*)\)"))
    found = F.regexp_extract_all(blank(code), pattern, F.lit(1))
    parts = F.filter(F.split(F.get(found, F.lit(0)), ","), lambda p: F.rlike(p, F.lit(r"\S")))
    return F.when(F.size(found) > 0, F.size(parts))


def return_type(code: Column, name: Column) -> Column:
    """The last token before ``name(`` that is no modifier; annotations do not count."""
    pattern = F.concat(F.lit(r"(?s)\A(.*?)\b"), quoted(name), F.lit(r"\s*\("))
    before = F.regexp_replace(F.call_function("regexp_extract", blank(code), pattern, F.lit(1)), r"@\w+(?:\([^)]*\))?", " ")
    words = F.regexp_extract_all(before, F.lit(r"([A-Za-z_$][\w$]*(?:\[\])*|[A-Za-z_$][\w$]*<[^>]+>)"), F.lit(1))
    # Trailing modifiers go: keep what follows the last word that is none.
    modifiers = F.array(*[F.lit(m) for m in MODIFIERS])
    kept = F.filter(words, lambda w: ~F.array_contains(modifiers, w))
    return F.get(kept, F.size(kept) - 1)


def is_short_accessor(name: Column, start: Column, end: Column, code: Column) -> Column:
    """A getter without parameter that returns something, or a setter of one; under five lines."""
    short = line_count(start, end, code) < 5
    parameters, kind = parameter_count(code, name), return_type(code, name)
    getter = F.startswith(name, F.lit("get")) & (parameters == 0) & kind.isNotNull() & (kind != "void")
    setter = F.startswith(name, F.lit("set")) & (parameters == 1) & (kind == "void")
    return F.coalesce(short & (getter | setter), F.lit(False))


def is_trivial(name: Column, start: Column, end: Column, code: Column) -> Column:
    return is_empty_code(code) | is_short_accessor(name, start, end, code)


def code_body(code: Column) -> Column:
    """From the first brace on; the whole code where there is none."""
    at = F.locate("{", code)
    return F.when(at > 0, F.substring(code, at, F.length(code))).otherwise(code)


# ---- URLs -----------------------------------------------------------------------------------


def url_line(url: Column) -> Column:
    return F.regexp_extract(blank(url), r"#L(\d+)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(blank(url), r"/blob/[^/]+/([^#?]*)", 1)


def url_commit(url: Column) -> Column:
    return F.regexp_extract(blank(url), r"/blob/([^/]+)/", 1)


def parse_method_url(url: Column) -> Column:
    """struct(project, commit, path, line) of a blob URL; null where it is none."""
    whole_url = r"^https?://[^/]+/[^/]+/([^/]+)/blob/([^/]+)/([^#?]+)#L(\d+)$"
    part = lambda i: F.regexp_extract(blank(url), whole_url, i)
    return F.when(
        F.rlike(blank(url), F.lit(whole_url)),
        F.struct(
            part(1).alias("project"), part(2).alias("commit"), F.url_decode(part(3)).alias("path"),
            part(4).try_cast("int").alias("line"),
        ),
    )


def method_url(repository: Column, commit: Column, file: Column, line: Column) -> Column:
    return F.concat(repository, F.lit("/blob/"), commit, F.lit("/"), file, F.lit("#L"), line.cast("string"))


def history_suffix(file: Column, name: Column, line: Column) -> Column:
    """``dir/File--name--line.json`` of a method in ``dir/File.java``."""
    return F.concat(F.regexp_replace(file, r"\.java$", ""), F.lit("--"), name, F.lit("--"), line.cast("string"), F.lit(".json"))


def history_file_url(repository: Column, commit: Column, file: Column) -> Column:
    """The blob URL of a method from the name of its history file."""
    pattern = r"^(.*?)--(.*)--(\d+)\.json$"
    path = F.concat(F.regexp_extract(file, pattern, 1), F.lit(".java"))
    return method_url(repository, commit, path, F.regexp_extract(file, pattern, 3))


def repository_url(url: Column) -> Column:
    """Trimmed, without trailing slashes and ``.git``; the case stays."""
    return F.regexp_replace(F.regexp_replace(F.trim(blank(url)), r"/+$", ""), r"\.git$", "")


def source_root(file: Column, package: Column) -> Column:
    """The folder of ``file`` without the package's folders, or just the folder on a mismatch."""
    folder = F.regexp_replace(F.regexp_replace(file, r"[^/]*$", ""), r"/$", "")
    tail = F.translate(blank(package), ".", "/")
    inside = (tail != "") & F.endswith(F.concat(F.lit("/"), folder), F.concat(F.lit("/"), tail))
    cut = F.substring(folder, F.lit(1), F.length(folder) - F.length(tail))
    return F.when(inside, F.regexp_replace(cut, r"/$", "")).otherwise(folder)


# ---- smells and lists in text ---------------------------------------------------------------


def split_smells(value: Column) -> Column:
    """Smells of a cell; repeats stay."""
    return F.filter(F.split(blank(value), r"\s+"), lambda s: s != "")


def smell_flag(value: Column, smell: str) -> Column:
    """Whether a cell has ``smell``; ANY (or ALL) and NONE stand for some and no smell."""
    smells = split_smells(value)
    if smell in ("any", "all"):
        return F.size(smells) > 0
    if smell == "none":
        return F.size(smells) == 0
    return F.array_contains(smells, smell)


def list_item(value: Column, index: Column) -> Column:
    """Item ``index`` (from 0) of a comma list, else its first."""
    items = F.transform(F.split(blank(value), ","), lambda x: F.trim(x))
    found = F.get(items, index)
    return F.when(found.isNull() | (found == ""), F.get(items, F.lit(0))).otherwise(found)


def smell_range(begin: Column, end: Column, index: Column) -> Column:
    """struct(first, last) of the index-th smell's lines, in order; null if either is no number."""
    a, b = whole(list_item(begin, index)), whole(list_item(end, index))
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(F.least(a, b).alias("first"), F.greatest(a, b).alias("last")))


def new_side_lines(diff: Column) -> Column:
    """Lines of a unified diff that exist after it."""
    lines = F.filter(
        F.split(blank(diff), "\n"),
        lambda x: (x.startswith("+") & ~x.startswith("+++")) | x.startswith(" "),
    )
    return F.size(lines)


# ---- signatures -----------------------------------------------------------------------------


def invocation_name(signature: Column) -> Column:
    return F.substring_index(F.substring_index(blank(signature), "(", 1), ".", -1)


def compact_signature(signature: Column) -> Column:
    return F.trim(F.regexp_replace(blank(signature), r"\s+", " "))


def simple_parameter(kind: Column) -> Column:
    """Without generics, varargs as an array, the last dotted name."""
    plain = F.trim(F.regexp_replace(blank(kind), r"<.*>", ""))
    return F.substring_index(F.regexp_replace(plain, r"\.\.\.", "[]"), ".", -1)


def simple_type(kind: Column) -> Column:
    """The word before ``<``, else the last dotted name without brackets."""
    before = F.regexp_extract(blank(kind), r"(\w+)<", 1)
    plain = F.substring_index(F.regexp_replace(blank(kind), r"\[\]", ""), ".", -1)
    return F.when(before != "", before).otherwise(plain)


def parameter_list(signature: Column) -> Column:
    """Text between the outer parentheses split at commas outside ``<>`` and ``[]``."""
    inside = F.regexp_extract(blank(signature), r"(?s)\((.*)\)", 1)
    letters = F.split(inside, "")
    empty = F.expr("CAST(array() AS array<string>)")
    first = F.struct(empty.alias("done"), F.lit("").alias("part"), F.lit(0).alias("depth"))

    def step(state, x):
        depth = state["depth"] + F.when(x.isin("<", "["), 1).when(x.isin(">", "]"), -1).otherwise(0)
        cut = (x == ",") & (state["depth"] == 0)
        return F.struct(
            F.when(cut, F.concat(state["done"], F.array(state["part"]))).otherwise(state["done"]).alias("done"),
            F.when(cut, F.lit("")).otherwise(F.concat(state["part"], x)).alias("part"),
            depth.alias("depth"),
        )

    parts = F.aggregate(letters, first, step, lambda s: F.concat(s["done"], F.array(s["part"])))
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def linker_signature(signature: Column) -> Column:
    """The declared signature with simple parameter types."""
    name = F.substring_index(blank(signature), "(", 1)
    kinds = F.transform(parameter_list(signature), simple_parameter)
    return F.concat(name, F.lit("("), F.array_join(kinds, ","), F.lit(")"))


def first_with_parenthesis(*columns: Column) -> Column:
    """The first column that holds a signature, else blank."""
    return F.coalesce(*[F.when(F.contains(blank(c), F.lit("(")), c) for c in columns], F.lit(""))


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*[F.when(F.trim(blank(c)) != "", c) for c in columns], F.lit(""))


def stable_shard(key: Column, shards: int) -> Column:
    """1 + sha1(key) mod shards, over the 160-bit number, without a big integer type."""
    # Horner's scheme over the hash's hexadecimal digits.
    digits = F.filter(F.split(F.sha1(key), ""), lambda d: d != "")
    rest = F.aggregate(digits, F.lit(0).cast("long"), lambda r, d: (r * 16 + _digit(d)) % shards)
    return (rest + 1).cast("int")


def _digit(d: Column) -> Column:
    return F.conv(d, 16, 10).cast("long")
