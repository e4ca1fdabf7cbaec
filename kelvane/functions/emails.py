"""E-mail addresses: extraction, scores and roles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls
from .text import core_name

#: An address, as a fixed value.
EMAIL = r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,63}"
#: Parts of addresses that are never a company's, and endings of image names; fixed values.
IGNORED = ("example.com", "example.org", "noreply", "no-reply", "donotreply", "sentry.io", "wixpress.com")
IMAGES = (".png", ".jpg", ".jpeg", ".webp", ".svg")
#: Beginnings of generic local parts for the score, and whole ones for the ranking; fixed values.
GENERIC_STARTS = ("info", "office", "kontakt", "contact", "prodaja", "sales")
GENERIC_LOCALS = ("info", "contact", "kontakt", "office", "sales", "prodaja", "support", "podpora")
#: Roles by the beginnings of local parts, in order; fixed values.
ROLES = {
    "GENERAL": ("info", "office", "kontakt", "contact", "hello", "tajnistvo"),
    "SALES": ("sales", "prodaja", "komerciala"),
    "MANAGEMENT": ("uprava", "management", "direktor", "direkcija"),
    "PURCHASING": ("nabava", "purchasing", "procurement"),
    "ACCOUNTING": ("racunovodstvo", "accounting", "finance"),
    "HR": ("hr", "kadrovska", "zaposlitev"),
    "SUPPORT": ("support", "podpora", "servis"),
    "MARKETING": ("marketing", "trzenje"),
}
OPEN_STARTS = ("prodaja", "sales", "servis")


def extract_emails(c: Column, ignored: Sequence[str] = IGNORED) -> Column:
    """The distinct addresses of a text, lower case, sorted."""
    text = F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c, F.lit(""))
    found = F.transform(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), lambda m: F.rtrim(F.lower(m), F.lit(".")))
    keep = lambda m: ~F.greatest(F.lit(False), *[m.contains(w) for w in ignored], *[m.endswith(s) for s in IMAGES])
    return F.array_sort(F.array_distinct(F.filter(found, keep)))


def mailto_emails(href: Column) -> Column:
    """Recipients of a mailto link; its query is ignored."""
    return F.when(F.lower(href).startswith("mailto:"), extract_emails(F.regexp_replace(F.regexp_replace(href, "(?i)^mailto:", ""), r"(?s)\?.*$", ""))).otherwise(F.array().cast("array<string>"))


def on_domain(email: Column, site: Column) -> Column:
    host, own = F.lower(F.substring_index(email, "@", -1)), urls.domain(site)
    return (own != "") & ((host == own) | host.endswith(F.concat(F.lit("."), own)))


def score_email(email: Column, page_url: Column, site: Column, found_in: Column) -> Column:
    local = F.substring_index(email, "@", 1)
    generic = F.greatest(*[local.startswith(s) for s in GENERIC_STARTS])
    score = F.lit(55) + F.when(on_domain(email, site), 20).otherwise(0) + F.when(urls.link_priority(page_url) == 0, 10).otherwise(0)
    return F.least(score + F.when(generic, 10).otherwise(0) + F.when(found_in == "mailto", 5).otherwise(0), F.lit(100))


def primary_order(email: Column, site: Column, confidence: Column) -> list[Column]:
    """Sort keys that put a company's primary address first."""
    local, host = F.lower(F.substring_index(email, "@", 1)), F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(site, F.lit("")), "^https?://", ""), "/.*$", "")), r"^www\.", "")
    return [local.isin(*GENERIC_LOCALS).desc(), (F.lower(F.substring_index(email, "@", -1)) == host).desc(), F.coalesce(confidence.cast("int"), F.lit(0)).desc(), email.asc()]


def role(email: Column, company_name: Column | None = None) -> Column:
    """The role that an address names: a department, PERSON for 'first.last', or UNKNOWN."""
    local = F.lower(F.substring_index(email, "@", 1))
    out = None
    for name, starts in ROLES.items():
        tests = [t for s in starts for t in ([local == s, local.startswith(s + "."), local.startswith(s + "_")] + ([local.startswith(s)] if s in OPEN_STARTS else []))]
        hit = F.greatest(*tests)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    out = out.when(local.startswith("rezervni.deli") | local.startswith("spare.parts"), "SUPPORT")
    if company_name is not None:
        out = out.when(F.substring_index(local, ".", 1) == F.replace(core_name(company_name), F.lit(" "), F.lit("")), "GENERAL")
    return out.when(local.rlike(r"^\p{L}{2,}[._-]\p{L}{2,}$"), "PERSON").otherwise("UNKNOWN")
