"""Names: slugs, format names, base names, cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(name: Column) -> Column:
    """Without the extension, lower case, other characters as single hyphens; ``track`` if nothing is left."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    out = F.regexp_replace(F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(out == "", "track").otherwise(F.coalesce(out, F.lit("track")))


def format_name(*names: Column) -> Column:
    """The first name present, trimmed, in lower case, each other character an underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(*names))), "[^a-z0-9]", "_"), "^_+|_+$", "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stable_hash(value: Column) -> Column:
    """Lower-case hex SHA-256."""
    return F.sha2(value.cast("binary"), 256)


def cache_key(*fields: Column) -> Column:
    """SHA-256 of the fields' JSON object, in the order given."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)
