"""Hosts, URLs and scopes.

Two domain normalisers exist side by side because the flows that use them differ: ``domain`` (after the last @,
parsed as a URL) and ``match_domain`` (after the first @, cut by hand).
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .ids import empty_to_null
from .text import core_name, fold, name_without_forms

#: What may stand before a host: a mailto scheme, any scheme, or nothing; up to the last @ where that is no part of a URL.
_HOST = r"^(?:mailto:(?:[^?]*@)?|[a-z][a-z0-9+.\-]*://(?:[^/?#]*@)?|(?![^?]*://)(?:.*@)?)([^/?#:]*)"
_PARTS = r"(?s)^([A-Za-z]+)://([^/?#]*)([^?#]*)(\?[^#]*)?(?:#.*)?$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once however often the body uses it: columns are trees and would repeat it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def domain(c: Column) -> Column:
    """Host of a URL, e-mail address or bare host, without www and trailing dots; '' if there is none. IDNA: ``domain_idna``."""
    return F.regexp_replace(F.regexp_extract(F.lower(F.trim(F.coalesce(c, F.lit("")))), _HOST, 1), r"^www\.|\.+$", "")


@F.pandas_udf(StringType())
def _idna(hosts: pd.Series) -> pd.Series:
    def one(h: str | None) -> str:
        try:
            return (h or "").encode("idna").decode("ascii")
        except UnicodeError:
            return ""

    return hosts.map(one)


def domain_idna(c: Column) -> Column:
    """``domain`` with letters beyond ASCII encoded; only then is Python needed."""
    return _idna(domain(c))


def match_domain(c: Column) -> Column:
    v = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    v = F.when(v.contains("@"), F.regexp_replace(v, r"^[^@]*@", "")).otherwise(v)
    v = F.regexp_replace(F.regexp_replace(v, "^https?://", ""), r"^www\.", "")
    return F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(v, "/.*$", ""), ":.*$", "")), r"\.+$", "")


def email_domain(c: Column) -> Column:
    v = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(v.contains("@"), match_domain(F.substring_index(v, "@", -1))).otherwise(F.lit(""))


def url(c: Column) -> Column:
    """An http(s) URL with lower-case host, a path and no fragment; '' for credentials, odd ports, addresses and local names."""
    given = F.trim(F.coalesce(c, F.lit("")))

    def built(v: Column) -> Column:
        part = lambda k: F.regexp_extract(v, _PARTS, k)
        return F.struct(F.lower(part(1)).alias("scheme"), F.lower(part(2)).alias("netloc"), part(3).alias("path"), part(4).alias("query"))

    def joined(p: Column) -> Column:
        host, port = F.regexp_replace(p["netloc"], r":\d*$", ""), F.regexp_extract(p["netloc"], r":(\d*)$", 1)
        # '' is no URL: a host needs a dot, and is neither an address nor local
        good = p["scheme"].isin("http", "https") & host.rlike(r"^(?!\d{1,3}(?:\.\d{1,3}){3}$)(?!.*\.local$)[^@:\[]*\.[^@:]*$") & port.isin("", "80", "443")
        query = F.when(F.length(p["query"]) > 1, p["query"]).otherwise(F.lit(""))
        return F.when(good, F.concat(p["scheme"], F.lit("://"), p["netloc"], F.when(p["path"] == "", F.lit("/")).otherwise(p["path"]), query)).otherwise(F.lit(""))

    return let(let(given, lambda g: F.when(g.contains("://"), g).otherwise(F.concat(F.lit("https://"), g))), lambda v: let(built(v), joined))


def same_site(a: Column, b: Column) -> Column:
    return (domain(a) != "") & (domain(a) == domain(b))


def homepage(c: Column) -> Column:
    return F.concat(F.regexp_extract(c, r"^([^:]+://[^/?#]*)", 1), F.lit("/"))


@F.pandas_udf(StringType())
def _canonical(urls: pd.Series) -> pd.Series:
    def one(u: str | None) -> str:
        try:
            path = urlsplit(u or "").path
        except ValueError:
            path = ""
        return posixpath.normpath("/" + unquote(unquote(path)).replace("\\", "/").lstrip("/"))

    return urls.map(one)


def canonical_path(c: Column) -> Column:
    """The path, unquoted twice, with dots resolved; traversal cannot leave it. An Arrow UDF."""
    return _canonical(c)


def simple_path(c: Column) -> Column:
    """``canonical_path`` for URLs without escapes, backslashes, dot segments or doubled slashes: builtins only."""
    path = F.regexp_extract(F.coalesce(c, F.lit("")), r"^[^:]+://[^/?#]*([^?#]*)", 1)
    return F.when(path.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(path, "/+$", ""))


def in_scope(u: Column, scope: Column, exact: bool = True) -> Column:
    """Whether a URL lies on the scope's host, at or below the scope's path."""
    path = canonical_path if exact else simple_path
    base, here = path(scope), path(u)
    below = (base == "/") | (here == base) | here.startswith(F.concat(base, F.lit("/")))
    return (url(u) != "") & (url(scope) != "") & (domain(u) == domain(scope)) & below


def host_brand(u: Column, company_name: Column) -> Column:
    """Whether the host's first label is the company's name."""
    brand = F.replace(core_name(company_name), F.lit(" "), F.lit(""))
    return (F.length(brand) >= 3) & (F.replace(fold(F.substring_index(domain(u), ".", 1)), F.lit(" "), F.lit("")) == brand)


def domain_matches(u: Column, company_name: Column) -> Column:
    """Whether the first label and the company's name contain one another; names below four letters never do."""
    host, name = F.substring_index(domain(u), ".", 1), F.replace(name_without_forms(company_name), F.lit(" "), F.lit(""))
    return (F.length(name) >= 4) & (host.contains(name) | name.contains(host))


def brand_match(u: Column, company_name: Column) -> Column:
    """Whether a label is the name, but for hyphens, or has exactly its words in any order."""
    words = F.split(core_name(company_name), " ")
    labels = F.split(domain(u), r"\.")
    labels = F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0)))
    same = lambda x: (F.replace(x, F.lit("-"), F.lit("")) == F.array_join(words, "")) | (F.array_sort(F.regexp_extract_all(x, F.lit("[a-z0-9]+"), F.lit(0))) == F.array_sort(words))
    return F.exists(labels, same)


#: Words of a link that lead to a company's identity, as fixed values.
LINK_WORDS = ("kontakt", "contact", "o-nas", "about", "podjetj", "company", "impress", "legal", "privacy", "zasebnost", "terms", "pogoji", "podatki")


def link_priority(c: Column) -> Column:
    """0 contact, 1 legal, 2 about, 3 other."""
    v = F.lower(c)
    return F.when(v.rlike("kontakt|contact"), 0).when(v.rlike("impress|legal|podatki"), 1).when(v.rlike("o-nas|about|podjetj|company"), 2).otherwise(3)


def query_value(c: Column, name: str) -> Column:
    """A parameter of a URL's query, or null."""
    return empty_to_null(F.regexp_extract(F.coalesce(c, F.lit("")), rf"[?&]{name}=([^&#]*)", 1))


def candidate_urls(company_name: Column) -> Column:
    """Guessed addresses of a company: bare and www under .si, .com and .eu; none below three letters."""
    from .text import domain_label

    base = domain_label(company_name)
    made = F.array(*[F.concat(F.lit(f"https://{www}"), base, F.lit(tld)) for tld in (".si", ".com", ".eu") for www in ("", "www.")])
    return F.when(F.length(base) >= 3, made).otherwise(F.array().cast("array<string>"))


def search_url(base: str, name: Column) -> Column:
    return F.concat(F.lit(base), F.url_encode(name))


def queries(company_name: Column, place: Column, tax: Column) -> Column:
    """The two search texts of a company."""
    from .text import base_name

    base = base_name(company_name)
    number = F.regexp_replace(F.coalesce(tax, F.lit("")), "^SI", "")
    first = F.format_string('"%s" %s', base, F.coalesce(F.nullif(place, F.lit("")), F.lit("Slovenija")))
    return F.array(first, F.when(number != "", F.format_string('"%s" "%s"', number, base)).otherwise(F.format_string('"%s" Slovenija kontakt', base)))


#: Mail hosts that say nothing about a company's own site, as fixed values.
PUBLIC_MAIL = ("gmail.com", "hotmail.com", "outlook.com", "live.com", "yahoo.com", "icloud.com", "me.com", "siol.net", "t-2.net", "amis.net", "aol.com")


def website_from_email(c: Column) -> Column:
    """https://host of an address on a host of its own, or null."""
    host = email_domain(c)
    return F.when((host != "") & ~host.isin(*PUBLIC_MAIL), F.concat(F.lit("https://"), host))


def sanitized_url(c: Column) -> Column:
    """A stored address with a scheme, or null where none is stored."""
    v = F.trim(c)
    return F.when((v == "") | (F.lower(v) == "ni podatka"), None).otherwise(F.when(v.startswith("http"), v).otherwise(F.concat(F.lit("https://"), v)))
