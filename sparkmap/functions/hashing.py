"""Reproducible draws.

A draw is a hash of what is drawn and of a seed, so it does not depend on
partitioning, task order or engine.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def seed_key(*parts: Column, sep: str = "|") -> Column:
    """One text key per draw, e.g. (root, subject, k, repeat, query site); a missing part has a mark of its own."""
    return F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts])


def _hex_to_long(hexed: Column) -> Column:
    return F.conv(F.substring(hexed, 1, 8), 16, 10).cast("bigint")


def stable_seed(*parts: Column, sep: str = "|") -> Column:
    """First 8 hex digits of the sha256 of the joined parts, as BIGINT."""
    return _hex_to_long(F.sha2(seed_key(*parts, sep=sep), 256))


def hash_long(*parts: Column, sep: str = "|") -> Column:
    """First 8 hex digits of the md5 of the joined parts, as BIGINT."""
    return _hex_to_long(F.md5(seed_key(*parts, sep=sep)))


def hash_text(*parts: Column, sep: str = "|") -> Column:
    """md5 of the joined parts: a uniform sort key."""
    return F.md5(seed_key(*parts, sep=sep))


def hash_unit(*parts: Column, sep: str = "|") -> Column:
    """A uniform number in [0, 1)."""
    return hash_long(*parts, sep=sep) / F.lit(4294967296.0)
