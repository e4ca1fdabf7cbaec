"""Observations from text: phones, URLs, identifiers, activities; languages and social links from HTML. Builtins only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import emails, ids, phones, text, urls

#: Patterns as fixed values.
URL = r"(?i)https?://[^\s<>\"\)]+|(?<![@\w.-])(?:www\.)?[\w-]+\.(?:si|com|eu|net|org)(?:/[^\s<>\"\)]*)?"
PHONE = r"(?i)(?:tel(?:efon)?|phone|mobil(?:ni)?)\s*[:.]?\s*(\+?\d[\d ()/.-]{5,}\d(?:\s*(?:ext\.?|int\.?|x)\s*\d+)?)"
IDENTIFIER = (
    r"(?iU)(?<!\w)(mati[čc]na(?:\s+[šs]tevilka)?|registration(?:\s+number)?|company\s+id|"
    r"dav[čc]na(?:\s+[šs]tevilka)?|vat|id\s+za\s+ddv)(?!\w)\s*[:.]?\s*(?:SI\s*)?(\d[\d .-]{5,}\d)"
)
ACTIVITY = r"(?i)\bSKD\s*(?:(20\d{2})\s*[:/-]?\s*)?[: ]*([A-U]?\s*\d{2}\.\d{2,3})\b"
LANGUAGES = ("sl", "en", "de", "it", "hr", "fr", "es", "cs", "pl", "hu")
LANGUAGE_WORDS = {"en": "english", "de": "deutsch", "it": "italiano", "hr": "hrvatski", "fr": "français", "es": "español"}
SOCIAL = {"linkedin": ("linkedin.com",), "facebook": ("facebook.com",), "instagram": ("instagram.com",), "youtube": ("youtube.com",), "twitter": ("twitter.com", "x.com"), "tiktok": ("tiktok.com",)}


def found_urls(c: Column) -> Column:
    """Usable URLs of a text, first occurrences in order."""
    raw = F.regexp_extract_all(c, F.lit(URL), F.lit(0))
    return F.array_distinct(F.filter(F.transform(raw, lambda u: urls.url(F.regexp_replace(u, r"[.,;]+$", ""))), lambda u: u != ""))


def found_phones(c: Column) -> Column:
    """array<struct<raw, phone>> of labelled numbers with a usable length."""
    raw = F.regexp_extract_all(c, F.lit(PHONE), F.lit(1))
    return F.filter(F.transform(raw, lambda r: F.struct(r.alias("raw"), phones.observed_phone(r).alias("phone"))), lambda p: p["phone"].isNotNull())


def found_identifiers(c: Column) -> Column:
    """array<struct<kind, label, value>> of labelled tax and registration numbers."""
    labels, values = (F.regexp_extract_all(c, F.lit(IDENTIFIER), F.lit(k)) for k in (1, 2))
    kind = lambda label: F.when(text.fold(label).rlike("davcna|vat|ddv"), "TAX_NUMBER").otherwise("REGISTRATION_NUMBER")
    return F.zip_with(labels, values, lambda a, b: F.struct(kind(a).alias("kind"), a.alias("label"), F.regexp_replace(b, r"\D", "").alias("value")))


def found_activities(c: Column) -> Column:
    """array<struct<code, version>> of activity codes; version null if the text gives none."""
    codes, versions = (F.regexp_extract_all(c, F.lit(ACTIVITY), F.lit(k)) for k in (2, 1))
    return F.zip_with(codes, versions, lambda a, b: F.struct(a.alias("code"), ids.empty_to_null(b).alias("version")))


def observations(df: DataFrame, key: str, body: str, ignored=emails.IGNORED) -> DataFrame:
    """Long form: (key, kind, raw, value) of every e-mail, phone, URL, identifier and activity of a text."""
    row = lambda kind, raw, value: F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), raw.alias("raw"), value.alias("value"))
    c = F.coalesce(F.col(body), F.lit(""))
    parts = [
        F.transform(emails.extract_emails(c, ignored), lambda e: row("EMAIL_CANDIDATE", e, e)),
        F.transform(found_phones(c), lambda p: row("PHONE_CANDIDATE", p["raw"], p["phone"])),
        F.transform(found_urls(c), lambda u: row("WEBSITE_CANDIDATE", u, u)),
        F.transform(found_identifiers(c), lambda i: row(i["kind"], i["label"], i["value"])),
        F.transform(found_activities(c), lambda a: row("REGISTERED_ACTIVITY", a["code"], a["code"])),
    ]
    return df.select(key, F.explode(F.concat(*parts)).alias("o")).select(key, "o.*")


def incidental(df: DataFrame, key: str, body: str, company_name: str, tax: str, registration: str) -> DataFrame:
    """(key, kind, value): a text that names the company or one of its numbers is an identity mention, and any text that is not blank a description; neither asserts anything."""
    from .ownership import entity_context

    said = F.coalesce(F.col(body), F.lit(""))
    named = entity_context(said, F.col(company_name), F.col(tax), F.col(registration))
    kinds = F.array_compact(F.array(F.when(named, "COMPANY_IDENTITY"), F.when(F.trim(F.regexp_replace(said, r"\s+", " ")) != "", "BUSINESS_DESCRIPTION")))
    return df.select(key, F.explode(kinds).alias("kind"), said.alias("value"))


def exclude_identifiers(candidates: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Phone candidates whose digits are a known identifier (key, kind, value) of the same company become exclusions."""
    digits = F.regexp_replace(F.substring_index(F.col("value"), ";", 1), r"\D", "")
    numbers = known.select(F.col(key).alias("__key"), F.col("kind").alias("__kind"), F.regexp_replace("value", r"\D", "").alias("__digits")).filter("__digits <> ''")
    first = numbers.groupBy("__key", "__digits").agg(F.min("__kind").alias("__kind"))
    out = candidates.join(first, (F.col(key) == F.col("__key")) & (digits == F.col("__digits")) & (F.col("kind") == "PHONE_CANDIDATE"), "left")
    hit = F.col("__kind").isNotNull()
    return out.withColumns({"kind": F.when(hit, "PHONE_EXCLUSION").otherwise(F.col("kind")), "exclusion_reason": F.when(hit, F.concat(F.lit("MATCHES_"), F.col("__kind")))}).drop("__key", "__kind", "__digits")


def search_candidates(results: DataFrame, company_name: str, tax: str | None = None, registration: str | None = None) -> DataFrame:
    """Observations of search results (url, title, body), with whether they name the legal entity: its whole name, or one of its numbers."""
    from .ownership import entity_specific

    number = lambda c: F.col(c) if c else F.lit(None).cast("string")
    said = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")))
    df = results.withColumn("__said", said).withColumn("identity_match", entity_specific(said, F.col(company_name), number(tax), number(registration)))
    own = F.transform(F.filter(F.array(urls.url(F.col("url"))), lambda u: u != ""), lambda u: F.struct(F.lit("WEBSITE_CANDIDATE").alias("kind"), F.lit("search_url").alias("method"), u.alias("value")))
    said_urls = F.transform(found_urls(F.col("__said")), lambda u: F.struct(F.lit("WEBSITE_CANDIDATE").alias("kind"), F.lit("snippet_url").alias("method"), u.alias("value")))
    mails = emails.extract_emails(F.col("__said"))
    found = F.transform(mails, lambda e: F.struct(F.lit("EMAIL_CANDIDATE").alias("kind"), F.lit("search_snippet").alias("method"), e.alias("value")))
    hosts = F.when(F.col("identity_match"), F.transform(mails, lambda e: F.struct(F.lit("WEBSITE_CANDIDATE").alias("kind"), F.lit("email_domain").alias("method"), F.concat(F.lit("https://"), F.substring_index(e, "@", -1), F.lit("/")).alias("value"))))
    numbers = F.transform(found_phones(F.col("__said")), lambda p: F.struct(F.lit("PHONE_CANDIDATE").alias("kind"), F.lit("search_snippet").alias("method"), p["phone"].alias("value")))
    every = F.concat(own, said_urls, found, F.coalesce(hosts, F.array().cast("array<struct<kind:string,method:string,value:string>>")), numbers)
    return df.select(*results.columns, "identity_match", F.explode(every).alias("o")).select(*results.columns, "identity_match", "o.*")


def languages(html: Column, visible: Column | None = None) -> Column:
    """Sorted language codes that a page shows in its markup, paths or switcher; 'sl' if none."""
    said = F.struct(F.lower(F.coalesce(html, F.lit(""))).alias("low"), F.lower(html if visible is None else visible).alias("shown"))
    return urls.let(said, lambda v: _languages(v["low"], F.coalesce(v["shown"], F.lit("")) if visible is None else v["shown"]))


def _languages(low: Column, shown: Column) -> Column:
    declared = F.regexp_extract(low, r"<html[^>]*\blang\s*=\s*[\"']?([a-z]{2})", 1)
    every = lambda pattern: F.regexp_extract_all(low, F.lit(pattern), F.lit(1))
    # each pattern finds all codes in one pass; the ends of paths are looked at and left, as the next code may begin there
    marked = F.concat(every(r"hreflang\s*=\s*[\"']?([a-z]{2})"), every(r"lang=\"([a-z]{2})\""), every(r"lang=(?=([a-z]{2}))"), every(r"/([a-z]{2})(?=[/\"?])"), F.array(declared))
    words = [F.when(shown.contains(w), F.lit(code)) for code, w in LANGUAGE_WORDS.items() if code in LANGUAGES]
    codes = F.array_intersect(F.concat(marked, F.array_compact(F.array(*words))), F.array(*map(F.lit, LANGUAGES)))
    return urls.let(F.array_sort(codes), lambda found: F.when(F.size(found) == 0, F.array(F.lit("sl"))).otherwise(found))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))


def social_links(html: Column, exact: bool = False) -> list[Column]:
    """A boolean for each network; by substring (as stored data has it: x.com also hits netflix.com) or by exact host."""
    links = F.transform(hrefs(html), F.lower)
    test = (lambda u, d: (urls.domain(u) == d) | urls.domain(u).endswith("." + d)) if exact else (lambda u, d: u.contains(d))
    any_of = lambda domains: lambda u: F.greatest(F.lit(False), *[test(u, d) for d in domains])
    return [F.exists(links, any_of(domains)).alias(name) for name, domains in SOCIAL.items()]


def title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def description(html: Column) -> Column:
    return F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<meta\s+name=[\"']description[\"']\s+content=[\"']([^\"']*)[\"']", 1)


def absolute(href: Column, base: Column) -> Column:
    """A link made absolute: full, scheme-relative, rooted or relative to the page's folder."""
    root = F.regexp_extract(base, r"^([^:]+://[^/?#]*)", 1)
    folder = F.when(F.regexp_extract(base, r"^[^:]+://[^/?#]*(/[^?#]*)", 1) == "", F.concat(root, F.lit("/"))).otherwise(F.regexp_extract(base, r"^([^:]+://[^/?#]*/(?:[^?#]*/)?)", 1))
    return (
        F.when(href.rlike("(?i)^[a-z][a-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.substring_index(base, "//", 1), href))
        .when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(folder, href))
    )


def internal_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", words=urls.LINK_WORDS) -> DataFrame:
    """(key, link, priority, position): a page's links to identity pages (by ``words``) of its own site, contact pages first."""
    links = pages.select(key, F.col(url).alias("__base"), F.explode(hrefs(F.col(html))).alias("__href"))
    # one step at a time: each uses its input many times over, and nested they would multiply
    links = links.select(key, "__base", absolute(F.col("__href"), F.col("__base")).alias("__link"))
    links = links.filter(F.lower("__link").rlike("|".join(words))).withColumn("link", urls.url(F.col("__link"))).filter("link <> ''")
    links = links.filter(urls.same_site(F.col("link"), F.col("__base"))).select(key, "link").distinct()
    links = links.withColumn("priority", urls.link_priority(F.col("link")))
    from pyspark.sql import Window

    return links.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("priority", "link")))


def visible_text(html: Column) -> Column:
    """What is left without comments, scripts, styles and tags: an approximation in builtins of ``html.visible``."""
    v = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<(script|style|noscript|svg|iframe)\b[^>]*>.*?</\1\s*>", " ")
    return text.squeeze(F.regexp_replace(v, r"(?s)<[^>]*>", " "))
