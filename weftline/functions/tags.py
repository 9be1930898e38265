"""Artifact tags: sets written as ``#a #b`` text (or compact ``#a#b``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tags, in the order in which they are written.
TAG_ORDER = (
    "test-module", "doc-module", "test-code", "main-code", "test-case-method", "test-fixture-method",
    "test-helper-method", "test-resource", "main-resource", "test-code-generated", "main-code-generated",
)
# The roles, first match wins.
ROLE_ORDER = (
    "test-case-method", "test-fixture-method", "test-helper-method", "test-code", "main-code", "test-resource",
    "main-resource",
)
TEST_KIND, PRODUCTION_KIND = "test-case-method", "main-code"


def split_tags(artifact: Column) -> Column:
    """The set of tags as an array, in order of appearance; null counts as blank."""
    parts = F.split(F.coalesce(artifact, F.lit("")), r"[\s#]+")
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def encode_tags(tags: Column) -> Column:
    """Tags as text in the fixed order; unknown tags go."""
    order = F.array(*[F.lit(t) for t in TAG_ORDER])
    known = F.filter(order, lambda t: F.array_contains(tags, t))
    return F.array_join(F.transform(known, lambda t: F.concat(F.lit("#"), t)), " ")


def has_tag(artifact: Column, tag: str) -> Column:
    return F.array_contains(split_tags(artifact), tag.strip().lstrip("#"))


def is_production(artifact: Column) -> Column:
    """Main code without any tag of tests or documentation."""
    tags = split_tags(artifact)
    return F.array_contains(tags, "main-code") & ~F.exists(tags, lambda t: t.startswith("test-") | t.startswith("doc-"))


def artifact_role(artifact: Column) -> Column:
    tags = split_tags(artifact)
    role = F.when(F.array_contains(tags, ROLE_ORDER[0]), ROLE_ORDER[0])
    for tag in ROLE_ORDER[1:]:
        role = role.when(F.array_contains(tags, tag), tag)
    return role.otherwise("unknown")


def method_kind(artifact: Column) -> Column:
    """Test case or production method, else null."""
    return F.when(has_tag(artifact, TEST_KIND), TEST_KIND).when(has_tag(artifact, PRODUCTION_KIND), PRODUCTION_KIND)


def review_tags(text: Column) -> Column:
    """Tags of a review cell: split at blanks and commas, each with one ``#``, each once."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\s,]+"), lambda t: t != "")
    return F.array_distinct(F.transform(parts, lambda t: F.concat(F.lit("#"), F.regexp_replace(t, r"^#+", ""))))


def has_exact_tag(text: Column, tag: str) -> Column:
    """Whether a blank-separated cell holds the very token ``tag``."""
    return F.array_contains(F.split(F.coalesce(text, F.lit("")), r"\s+"), tag)
