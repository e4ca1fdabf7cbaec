"""Similarity of company names and candidate scores."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import phones, urls
from .text import match_name


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, " "), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common words of two folded names; 0 if either has none."""
    x, y = tokens(a), tokens(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(F.lit(0.0))


@F.pandas_udf(DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two strings; no builtin has it."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def name_similarity(a: Column, b: Column, ratio: Column | None = None) -> Column:
    """0 to 100 from two raw names: 0.55 of the character ratio and 0.45 of the word overlap. ``ratio`` replaces the Python part."""
    return similarity_of(match_name(a), match_name(b), ratio)


def similarity_of(x: Column, y: Column, ratio: Column | None = None, overlap: Column | None = None) -> Column:
    """``name_similarity`` of names in the matcher's form; ``overlap`` is that of their words, where it is known."""
    both = F.round(55 * (matching_ratio(x, y) if ratio is None else ratio) + 45 * (jaccard(x, y) if overlap is None else overlap), 2)
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 100.0).otherwise(both)


#: Points and steps of the score, as fixed values.
NAME_STEPS = ((95, 55, "name_exact_or_near_exact"), (85, 45, "name_strong"), (70, 30, "name_good"), (55, 15, "name_weak"))
LEVELS = ((90, "HIGH"), (70, "MEDIUM"), (50, "LOW"))


def candidate_score(similarity: Column, same_registration: Column, same_tax: Column, same_domain: Column, same_phone: Column) -> Column:
    """struct(score, confidence, reasons) of a candidate."""
    points, reason = F.lit(0), None
    for least, worth, name in reversed(NAME_STEPS):
        points = F.when(similarity >= least, worth).otherwise(points)
    for least, _, name in NAME_STEPS:
        text = F.concat(F.lit(name + ":"), F.round(similarity, 0).cast("int").cast("string"))
        reason = F.when(similarity >= least, text) if reason is None else reason.when(similarity >= least, text)
    flags = ((same_registration, 100, "registration_number_exact"), (same_tax, 100, "tax_number_exact"), (same_domain, 80, "email_domain_match"), (same_phone, 60, "phone_match"))
    for flag, worth, _ in flags:
        points = points + F.when(flag, worth).otherwise(0)
    score = F.least(points, F.lit(100)).cast("double")
    level = F.when(score >= LEVELS[0][0], LEVELS[0][1])
    for least, name in LEVELS[1:]:
        level = level.when(score >= least, name)
    reasons = F.array_compact(F.array(*[F.when(f, F.lit(n)) for f, _, n in flags], reason))
    return F.struct(score.alias("score"), level.otherwise("REJECT").alias("confidence"), reasons.alias("reasons"))


def equal_and_present(a: Column, b: Column) -> Column:
    x, y = F.trim(F.coalesce(a, F.lit(""))), F.coalesce(b, F.lit(""))
    return (x != "") & (y != "") & (x == y)


def same_domain(email: Column, site: Column, other_email_domain: Column) -> Column:
    own = urls.email_domain(email)
    return (own != "") & ((own == urls.match_domain(site)) | (own == urls.match_domain(other_email_domain)))


def same_phone(a: Column, b: Column) -> Column:
    return phones.phones_match(a, b)


def match_status(confidence: Column) -> Column:
    return F.when(confidence == "HIGH", "CONFIRMED").when(confidence.isin("MEDIUM", "LOW"), "REVIEW").otherwise("NO_MATCH")
