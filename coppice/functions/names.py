"""Column functions on symbol, command and event names, and similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"), "[^A-Za-z0-9]+", "_"))


def command_key(name: Column) -> Column:
    """Commands are equal up to case style, and a `_command` or `_cmd` ending."""
    return F.regexp_replace(F.regexp_replace(snake_case(name), "_(command|cmd)$", ""), "[^a-z0-9]", "")


def event_key(name: Column) -> Column:
    """Lower case; anything but letters, digits and the wildcard is an underscore."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9*]", "_")


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, both_empty).otherwise(F.size(F.array_intersect(a, b)) / union)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / length of the longer one; 1 for two empty strings."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)
