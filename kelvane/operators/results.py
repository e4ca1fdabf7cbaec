"""Rows of result pages, page problems and error triage. Builtins only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, numbers
from .extract import absolute, visible_text

#: Markers as fixed values.
RATE_LIMITS = ("rate limit", "too many requests", "prevec zahtev", "preveč zahtev", "poskusite kasneje", "temporarily unavailable")
FAILURES = ("oprostite, prišlo je do napake", "oprostite, prislo je do napake")
LOGINS = ("authenticate", "accounts.")
RETRYABLE = ("ddgsexception", "timeout", "dns error", "nodename nor servname", "temporarily unavailable", "connection reset", "429")


def _inside(html: Column, opening: str, closing: str) -> Column:
    return visible_text(F.regexp_extract(html, rf"(?is){opening}(.*?){closing}", 1))


def company_rows(pages: DataFrame, key: str, html: str, base_url: str) -> DataFrame:
    """(key, row_no, company_name, address, municipality, registration_number, tax_number, external_id, detail_url) of result rows; rows without a name are left out."""
    items = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<li\b[^>]*class=\"[^\"]*newsearchIcon[^\"]*\"[^>]*>(.*?)</li>"), F.lit(1))
    rows = pages.select(key, F.posexplode(items).alias("row_no", "item"))
    item = F.col("item")
    href = F.regexp_extract(item, r"(?is)<a\b[^>]*href=\"([^\"]*CompanyId=[^\"]*)\"", 1)
    labelled = lambda cls, label: ids.empty_to_null(F.regexp_replace(_inside(item, rf'<span\b[^>]*class="[^"]*{cls}[^"]*"[^>]*>', "</span>"), rf"(?i)^{label}:\s*", ""))
    out = rows.select(
        key, "row_no", _inside(item, r"<h3\b[^>]*>", "</h3>").alias("company_name"), _inside(item, r'<div\b[^>]*class="[^"]*address[^"]*"[^>]*>', "</div>").alias("address"),
        labelled("registrationNumber", "Matična").alias("registration_number"), labelled("taxNumber", "Davčna").alias("tax_number"), ids.empty_to_null(F.regexp_extract(href, r"CompanyId=(\d+)", 1)).alias("external_id"),
        F.when(href != "", absolute(href, F.lit(base_url))).alias("detail_url"),
    )
    return out.withColumn("municipality", numbers.municipality(F.col("address"))).filter("company_name <> ''")


def distinct_pages(rows: DataFrame, page: str, identity: Column) -> DataFrame:
    """(page, fingerprint, first_page) of pages by the set of their rows: a page whose fingerprint stood before repeats it."""
    prints = rows.groupBy(page).agg(ids.page_fingerprint(F.collect_set(identity)).alias("fingerprint"))
    first = prints.groupBy("fingerprint").agg(F.min(page).alias("first_page"))
    return prints.join(first, "fingerprint").select(page, "fingerprint", "first_page")


def page_problem(url: Column, body: Column) -> Column:
    """RATE_LIMITED, LOGIN, ERROR_PAGE, or null for a usable page."""
    low, at = F.lower(F.coalesce(body, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    has = lambda c, words: F.greatest(*[c.contains(w) for w in (*words, words[0])])
    return F.when(has(at, LOGINS), "LOGIN").when(at.contains("errorpage.aspx") | has(low, FAILURES), "ERROR_PAGE").when(has(low, RATE_LIMITS), "RATE_LIMITED")


def triage(results: DataFrame, status: str, message: str) -> DataFrame:
    """One row: errors that may go away and those that will not."""
    low = F.lower(F.coalesce(F.col(message), F.lit("")))
    again = F.greatest(*[low.contains(t) for t in RETRYABLE])
    failed = F.col(status) == "ERROR"
    return results.agg(F.count_if(failed & again).alias("retryable"), F.count_if(failed & ~again).alias("non_retryable"))


def filled_counts(df: DataFrame, *columns: str) -> DataFrame:
    """One row: for each column, how many values are not blank."""
    return df.agg(*[F.count_if(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")).alias(c) for c in columns])
