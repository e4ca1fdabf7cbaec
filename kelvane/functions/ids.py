"""Identifiers, names and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeeze


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def digits(c: Column) -> Column:
    """All digits, or null where there are none: registration numbers."""
    return empty_to_null(F.regexp_replace(c.cast("string"), r"\D", ""))


def tax_number(c: Column) -> Column:
    """Digits without a leading country code SI."""
    return digits(F.regexp_replace(F.trim(c.cast("string")), r"(?i)^SI\s*", ""))


def strict_identifier(c: Column, tax: bool = False) -> Column:
    """Without white space and (for tax numbers) SI; null unless only digits are left."""
    v = F.upper(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)\s", ""))
    v = F.regexp_replace(v, "^SI", "") if tax else v
    return F.when(v.rlike("^[0-9]+$"), v)


def person_name(c: Column) -> Column:
    return empty_to_null(F.lower(squeeze(c)))


def email(c: Column) -> Column:
    return empty_to_null(F.lower(F.trim(c)))


def linkedin_url(c: Column) -> Column:
    return empty_to_null(F.regexp_replace(F.lower(F.trim(c)), "/+$", ""))


def raw_hash(*fields: str) -> Column:
    """SHA-256 of a row's JSON with its fields in alphabetical order; nulls are written out."""
    return F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)


def page_fingerprint(ids: Column) -> Column:
    """Twenty hex digits for a set of row ids, whatever their order."""
    return F.substring(F.sha2(F.array_join(F.array_sort(ids), "\n"), 256), 1, 20)


def entity_key(*parts: Column) -> Column:
    """A stable surrogate key of natural-key parts; null and '' differ."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)


def clamp_confidence(c: Column) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0)), F.lit(100)))


def at_most(c: Column, most: int) -> Column:
    """The lesser of both, and null for null: ``least`` alone would skip it."""
    return F.when(c.isNotNull(), F.least(c, F.lit(most)))
