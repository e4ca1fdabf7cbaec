"""Telephone numbers: the matcher's national form and the observation form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import let

_EXTENSION = r"(?i)(?:;ext=|\bext\.?\s*|\bint\.?\s*|\bx\s*)(?=\d)"


def match_phone(c: Column) -> Column:
    """Digits with country code 386 where the length says that it was left out; '' for none."""
    return let(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\D", ""), _national)


def _national(d: Column) -> Column:
    return (
        F.when(d.startswith("00386"), F.substring(d, 3, 100)).when(d.startswith("386"), d)
        .when((F.length(d) == 9) & d.startswith("0"), F.concat(F.lit("386"), F.substring(d, 2, 100)))
        .when(F.length(d) == 8, F.concat(F.lit("386"), d)).otherwise(d)
    )


def phones_match(a: Column, b: Column) -> Column:
    """Equal in the matcher's form, or equal in their last eight digits."""
    x, y = match_phone(a), match_phone(b)
    tail = (F.length(x) >= 8) & (F.length(y) >= 8) & (F.right(x, F.lit(8)) == F.right(y, F.lit(8)))
    return (x != "") & (y != "") & ((x == y) | tail)


def observed_phone(c: Column) -> Column:
    """'+' and digits if it was written internationally, else the digits as written; ';ext=' for an extension; null unless 7 to 15 digits."""
    v = F.trim(F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c), r"(?i)^tel:", ""))
    v = F.regexp_replace(v, r"^(\+\d{1,3})\s*\(0\)", "$1")

    def built(parts: Column) -> Column:
        number = F.element_at(parts, 1)
        extension = F.when(F.size(parts) == 2, F.concat(F.lit(";ext="), F.regexp_replace(F.try_element_at(parts, F.lit(2)), r"\D", ""))).otherwise(F.lit(""))

        def joined(d: Column) -> Column:
            abroad = F.ltrim(number).startswith("+") | d.startswith("00")
            bare = F.when(d.startswith("00"), F.substring(d, 3, 100)).otherwise(d)
            return F.when(F.length(d).between(7, 15), F.concat(F.when(abroad, F.lit("+")).otherwise(F.lit("")), bare, extension))

        return let(F.regexp_replace(number, r"\D", ""), joined)

    return let(F.split(v, _EXTENSION, 2), built)
