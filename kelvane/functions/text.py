"""Text folding and legal-form handling.

Spark has no Unicode normalisation builtin. ``fold`` covers the Latin letters of European languages with
``translate`` and stays in generated code; ``fold_exact`` is the full compatibility decomposition as an Arrow UDF.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _letter_pairs() -> tuple[str, str]:
    """Every precomposed letter of Latin-1 Supplement to Latin Extended Additional with one base letter, and that letter."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        ch = chr(code).lower()
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if len(ch) == 1 and len(base) == 1 and base != ch and ch not in source:
            source.append(ch)
            target.append(base)
    return "".join(source), "".join(target)


_FROM, _TO = _letter_pairs()

#: Legal forms as fixed values: the alternatives that end a company's own name.
LEGAL_FORM = r"\b(?:d\s*\.\s*o\s*\.\s*o\.?|d\s*\.\s*d\.?|s\s*\.\s*p\.?|s\s*\.\s*r\s*\.\s*o\.?|gmbh|a\s*\.\s*s\.?)"
#: The shorter list used for verification and for search queries, as fixed values.
LOCAL_LEGAL_FORM = r"\b(?:d\s*\.\s*o\s*\.\s*o\.?|d\s*\.\s*d\.?|s\s*\.\s*p\.?)"


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def unaccent(c: Column) -> Column:
    """Lower case without diacritics, for Latin letters."""
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), _FROM, _TO)


def fold(c: Column) -> Column:
    """Lower case, no diacritics, everything but a-z and 0-9 a single space; null gives ''."""
    return F.trim(F.regexp_replace(unaccent(c), "[^a-z0-9]+", " "))


@F.pandas_udf(StringType())
def _nfkd_fold(values: pd.Series) -> pd.Series:
    def one(v: str | None) -> str:
        bare = "".join(c for c in unicodedata.normalize("NFKD", (v or "").lower()) if not unicodedata.combining(c))
        return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in bare).split())

    return values.map(one)


def fold_exact(c: Column) -> Column:
    """``fold`` with full compatibility decomposition (ligatures, full-width forms and so on)."""
    return _nfkd_fold(c)


@F.pandas_udf(StringType())
def _casefolded(values: pd.Series) -> pd.Series:
    def one(v: str | None) -> str:
        text = unicodedata.normalize("NFKC", v or "").casefold()
        return " ".join("".join(c if c.isalnum() else " " for c in text).split())

    return values.map(one)


def legal_name(c: Column) -> Column:
    """Case, punctuation and white space made equal, letters of all alphabets kept."""
    return _casefolded(c)


def core_name(c: Column) -> Column:
    """What stands before the first legal form, folded."""
    return fold(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)" + LEGAL_FORM + r".*$", ""))


def name_without_forms(c: Column) -> Column:
    """Legal forms removed wherever they stand, folded: the verifier's name."""
    return fold(F.regexp_replace(F.coalesce(c, F.lit("")), "(?i)" + LOCAL_LEGAL_FORM, " "))


def base_name(c: Column) -> Column:
    """What stands before the first local legal form, case kept, without commas and blanks around it."""
    cut = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)" + LOCAL_LEGAL_FORM + r".*$", "")
    return F.regexp_replace(cut, r"^[ ,]+|[ ,]+$", "")


#: Tokens that the matcher drops, as fixed values.
MATCH_FORMS = ("doo", "dd", "sp", "jdoo", "dno", "kd", "kdd", "dooel", "sro", "ag", "se", "inc", "ltd", "llc")
MATCH_WORDS = ("druzba", "omejeno", "odgovornostjo", "z")


def match_name(c: Column) -> Column:
    """The matcher's name: legal forms written as one token, then dropped with filler words; order and repeats stay."""
    v = F.trim(unaccent(c))
    v = F.regexp_replace(v, r"\bd\s*[.\-]?\s*o\s*[.\-]?\s*o\b", " doo ")
    v = F.regexp_replace(v, r"\bd\s*[.\-]?\s*d\b", " dd ")
    v = F.regexp_replace(v, r"\bj\s*[.\-]?\s*d\s*[.\-]?\s*o\s*[.\-]?\s*o\b", " jdoo ")
    tokens = F.split(F.trim(F.regexp_replace(v, "[^a-z0-9]+", " ")), " ")
    return F.array_join(F.filter(tokens, lambda t: ~t.isin(*MATCH_FORMS, *MATCH_WORDS) & (t != "")), " ")


#: In the order in which they are tried, as fixed values.
DOMAIN_FORMS = ("d.o.o.", "d.o.o", "d.d.", "d.d", "d.n.o.", "k.d.", "s.p.", "z.o.o.")


def domain_label(c: Column) -> Column:
    """The generator's name: cut at the first form of the list that occurs, folded, without spaces."""
    v = F.lower(F.coalesce(c, F.lit("")))
    cut = None
    for form in DOMAIN_FORMS:
        at = F.instr(v, form)
        cut = F.when(at > 0, F.substring(v, F.lit(1), at - 1)) if cut is None else cut.when(at > 0, F.substring(v, F.lit(1), at - 1))
    return F.replace(fold(cut.otherwise(v)), F.lit(" "), F.lit(""))


def legal_form(c: Column) -> Column:
    """The first legal form, folded and without spaces; '' if there is none."""
    return F.replace(fold(F.regexp_extract(F.coalesce(c, F.lit("")), "(?i)(" + LEGAL_FORM + ")", 1)), F.lit(" "), F.lit(""))


def contains_phrase(haystack: Column, needle: Column) -> Column:
    """Whether folded words ``needle`` stand in folded words ``haystack``."""
    return (needle != "") & F.contains(F.concat(F.lit(" "), haystack, F.lit(" ")), F.concat(F.lit(" "), needle, F.lit(" ")))


def contains_name(value: Column, company_name: Column) -> Column:
    """Whether a text names the company; names of fewer than three letters and digits never count."""
    n = core_name(company_name)
    return (F.length(F.replace(n, F.lit(" "), F.lit(""))) >= 3) & contains_phrase(fold(value), n)


def legal_conflict(value: Column, company_name: Column) -> Column:
    """Whether a text names the company with another legal form."""
    mine, other = legal_form(company_name), legal_form(value)
    return (mine != "") & (other != "") & (mine != other) & contains_name(value, company_name)


def eligibility(company_name: Column) -> Column:
    """struct(status, reason): companies in bankruptcy are not eligible."""
    bankrupt = F.concat(F.lit(" "), legal_name(company_name), F.lit(" ")).contains(" v stečaju ")
    return F.struct(F.when(bankrupt, "INELIGIBLE").otherwise("ELIGIBLE").alias("status"), F.when(bankrupt, "BANKRUPTCY").alias("reason"))
