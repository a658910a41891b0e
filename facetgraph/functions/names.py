"""Naming rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def qualified_name(parent: Column, name: Column) -> Column:
    """parent.name, or name if the parent is null or empty."""
    return F.concat_ws(".", F.nullif(parent, F.lit("")), name)


def simple_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def object_key(scope: Column, name: Column) -> Column:
    return F.concat(F.coalesce(F.nullif(scope, F.lit("")), F.lit("<module>")), F.lit(":"), name)


def stable_output_name(prefix: str, logical: Column, fallback: str) -> Column:
    """prefix, ten hex digits of the name's SHA-256, and the name with runs of other signs as one underscore (80 characters at most)."""
    safe = F.regexp_replace(F.regexp_replace(logical, "[^A-Za-z0-9_-]+", "_"), "^[_-]+|[_-]+$", "")
    safe = F.regexp_replace(F.substring(safe, 1, 80), "[_-]+$", "")
    return F.concat_ws("_", F.lit(prefix), F.substring(F.sha2(logical, 256), 1, 10), F.coalesce(F.nullif(safe, F.lit("")), F.lit(fallback)))


def name_words(name: Column) -> Column:
    """The lower-case words of a name, cut at underscores and where a large letter follows a small one or a digit."""
    parts = F.split(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"), "_")
    return F.filter(F.transform(parts, F.lower), lambda x: x != "")


def communication_name(callable_name: Column) -> Column:
    """The name without its last segment: who takes part in a communication."""
    return F.regexp_replace(callable_name, r"\.[^.]*$", "")


def module_name(path: Column) -> Column:
    """The dotted name of a module file: directories and the file's stem; a package's own file names its directory."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\.[^./]*$", ""), "/"), lambda x: ~x.isin("", "."))
    package = (F.element_at(parts, -1) == "__init__") & (F.size(parts) > 1)
    return F.array_join(F.when(package, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts), ".")
