"""Who publishes a page: page types, page signals, site ownership and e-mail attribution.

Each classifier is an ordered ``when`` chain over columns; evidence of several pages is folded with one aggregate.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls

#: Markers as fixed values.
STRUCTURAL = ("/business/", "/ddv/", "/exhibitor", "exhibitor-search", "/searchdealer", "/prodajno-mesto/")
DIRECTORY_TITLES = (
    "business directory", "company directory", "company database", "baza podjetij", "poslovni imenik", "seznam davcnih zavezancev",
    "iskanje davcnih zavezancev", "profil kompanije", "company listing", "exhibitor", "supplier report",
)
DIRECTORY_BODIES = ("business directory", "company directory", "poslovni imenik", "baza podjetij")
PROFILE_TITLES = ("company profile", "seller profile", "dealer profile", "job portal", "news article")
GROUP_PATHS = ("/locations/", "/skupina/", "/lesoteka-group/", "/podjetja-v-koncernu", "/standorte")
GROUP_TITLES = ("group locations", "podjetja v koncernu")
GROUP_BODIES = ("our subsidiaries", "group companies", "podjetja v skupini", "podjetja v koncernu")
PARKED = ("domain for sale", "domain is for sale", "buy this domain", "domena je naprodaj", "sedo domain parking")
LISTING = ("business directory", "poslovni imenik", "company directory", "company profile", "supplier report", "company listing", "profil podjetja")
PROFILES = ("prosta delovna mesta", "zaposlitev", "job opening", "job portal", "career portal", "company profile", "supplier report", "business directory", "company directory", "company listing", "profile page")
NEWS = ("novice", "news article", "press release")
MARKETS = ("machinery marketplace", "equipment marketplace", "online marketplace")
SELLER_TITLES = ("seller profile", "dealer profile", "seller listing", "dealer listing", "company profile", "searchdealer")
SELLER_BODIES = ("verified seller", "other sellers on", "sellers on this marketplace")
CREDITS = ("website by", "developed by", "designed by", "izdelava splet", "powered by")


def any_in(c: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds one of the words: one pattern, since as many tests would repeat the text's expression as often."""
    return F.coalesce(c.rlike("|".join(re.escape(w) for w in words)), F.lit(False))


#: Words that keep a search result from being a candidate, as fixed values.
NO_CANDIDATES = ("mojedelo", "bettercareer", "job portal", "jobs", "izkusnje zaposlenih", "novice", "news", "company profile", "business directory", "company directory")


def candidate_fit(url: Column, policy: Column, title: Column, body: Column) -> Column:
    """Whether a search result may be a company's own site: by domain policy, kind of page, and the words of its address, title and first 400 characters."""
    said = text.fold(F.concat_ws(" ", url, F.coalesce(title, F.lit("")), F.substring(F.coalesce(body, F.lit("")), 1, 400)))
    blocked = F.coalesce(policy == "BLOCK_AS_OFFICIAL", F.lit(False))
    return ~blocked & (page_type(url, policy, title, body) == "COMPANY_PAGE") & ~any_in(said, NO_CANDIDATES)


def entity_specific(publication: Column, company_name: Column, tax: Column, registration: Column) -> Column:
    """Whether a mention names the legal entity itself: its whole name with the legal form, or one of its numbers."""
    return text.contains_phrase(text.fold(publication), text.fold(company_name)) | names_number(publication, tax) | names_number(publication, registration)


def page_type(url: Column, policy: Column, title: Column, body: Column, signals: Column | None = None) -> Column:
    """THIRD_PARTY, GROUP, PROFILE or COMPANY_PAGE; the domain policy comes first."""
    path = F.lower(F.coalesce(F.try_url_decode(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:]+://[^/?#]*([^?#]*)", 1)), F.lit("")))
    label, visible = text.fold(title), text.fold(body)
    signals = F.array().cast("array<string>") if signals is None else F.coalesce(signals, F.array().cast("array<string>"))
    return (
        F.when(policy == "BLOCK_AS_OFFICIAL", "THIRD_PARTY").when(policy == "GROUP_REVIEW", "GROUP")
        .when(any_in(path, STRUCTURAL) | any_in(label, DIRECTORY_TITLES) | any_in(visible, DIRECTORY_BODIES), "THIRD_PARTY")
        .when(any_in(label, PROFILE_TITLES) | path.contains("/company/") | path.contains("/companies/") | path.contains("/dealers/"), "PROFILE")
        .when(any_in(path, GROUP_PATHS) | any_in(label, GROUP_TITLES), "GROUP")
        .when(F.array_contains(signals, "third_party_marketplace_page"), "THIRD_PARTY")
        .when(F.array_contains(signals, "third_party_profile_page") | F.array_contains(signals, "directory_page"), "PROFILE").otherwise("COMPANY_PAGE")
    )


def names_number(body: Column, number: Column) -> Column:
    """Whether a text holds an identifier of seven digits or more, not inside a longer number."""
    d = F.regexp_replace(F.coalesce(number.cast("string"), F.lit("")), r"\D", "")
    return (F.length(d) >= 7) & F.rlike(F.coalesce(body, F.lit("")), F.concat(F.lit(r"(?i)(?<!\d)(?:SI\s*)?"), d, F.lit(r"(?!\d)")))


def page_signals(company: dict[str, Column], url: Column, title: Column, visible: Column, organisations: Column) -> Column:
    """Array of what a page says about the company (columns company_name, tax_number, registration_number, address, municipality)."""
    body, name = text.fold(visible), text.name_without_forms(company["company_name"])
    searched = F.concat_ws(" ", visible, F.array_join(organisations, " "))
    street, place = text.fold(F.substring_index(F.coalesce(company["address"], F.lit("")), ",", 1)), text.fold(company["municipality"])
    label = text.fold(F.concat_ws(" ", title, url))
    market = any_in(body, MARKETS) & (any_in(label, SELLER_TITLES) | any_in(body, SELLER_BODIES)) & ~urls.domain_matches(url, company["company_name"])
    flags = {
        "tax_exact": names_number(searched, company["tax_number"]), "registration_exact": names_number(searched, company["registration_number"]),
        "company_name_exact": (F.length(F.replace(name, F.lit(" "), F.lit(""))) >= 4) & text.contains_phrase(body, name),
        "organization_name_exact": F.exists(organisations, lambda o: text.name_without_forms(o) == name),
        "street_address_exact": street.rlike("[0-9]") & (F.length(street) > 5) & text.contains_phrase(body, street),
        "postal_locality_exact": text.contains_phrase(body, place), "parked_domain": any_in(body, PARKED), "directory_page": any_in(body, LISTING),
        "third_party_profile_page": any_in(label, PROFILES), "news_or_media_page": any_in(label, NEWS),
        "domain_matches_company_name": urls.domain_matches(url, company["company_name"]), "third_party_marketplace_page": market,
    }
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in flags.items()]))


#: What says in folded text who runs a site, as a fixed value; the company's folded name follows.
OPERATED = r"(?:website (?:is )?(?:operated|owned) by|upravljavec (?:spletne strani|spletnega mesta))\s*[:\-]?\s*"


def page_facts(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """``pages`` (one row for each key) with page_type, operator_match, operator_scope, group_context, legal_conflict and site_brand_match.

    Columns: company_name, page_url, page_title, visible, html, policy. A page's operator is named by a statement in its
    text, or as the publisher of a WebSite object in whose scope the page lies; that object's address is the scope (the
    last one's, of several). An Organization object alone names nobody's operator.
    """
    from .html import json_ld

    c, visible = F.col, text.fold(F.col("visible"))
    told = json_ld(pages, key, "html").filter("kind = 'PUBLISHER' and url <> ''").join(pages.select(key, "company_name", "page_url"), key)
    told = told.filter(text.contains_name(c("name"), c("company_name")) & urls.in_scope(c("page_url"), c("url")))
    scopes = told.groupBy(key).agg(F.max_by("url", "position").alias("__scope"))
    kind = page_type(c("page_url"), c("policy"), c("page_title"), c("visible"))
    stated = F.rlike(visible, F.concat(F.lit(OPERATED), text.core_name(c("company_name")), F.lit(r"\b")))
    out = pages.join(scopes, key, "left").withColumn("page_type", kind)
    return out.select(
        *pages.columns, "page_type", (c("__scope").isNotNull() | stated).alias("operator_match"), F.coalesce("__scope", F.lit("")).alias("operator_scope"), ((c("page_type") == "GROUP") | any_in(visible, GROUP_BODIES)).alias("group_context"),
        text.legal_conflict(c("page_title"), c("company_name")).alias("legal_conflict"), text.contains_name(c("page_title"), c("company_name")).alias("site_brand_match"),
    )


def evaluate_ownership(pages: DataFrame, key: str = "company_id") -> DataFrame:
    """(key, status, relationship, scope, reason) from a company's pages.

    Columns: company_name, candidate_url, page_url, page_title, page_no, signals, page_type, operator_match,
    operator_scope, group_context, legal_conflict, known_group, and assessment (a stored verdict, or null).
    """
    c = F.col
    has = lambda s: F.array_contains(c("signals"), s)
    exact = has("tax_exact") | has("registration_exact")
    named = has("company_name_exact") | has("organization_name_exact")
    street, place = has("street_address_exact"), has("postal_locality_exact")
    identity = (exact & (named | (street & place))) | (named & street & place)
    host = urls.domain(c("page_url"))
    labels = F.split(host, r"\.")
    tail = F.array_join(F.slice(labels, -2, 2), ".")
    tenant = (F.size(labels) >= 3) & ~tail.isin("co.uk", "com.au", "co.nz", "co.za")
    on_title = text.contains_name(c("page_title"), c("company_name"))
    dedicated = ~tenant & urls.host_brand(c("page_url"), c("company_name")) & on_title
    words, label = F.split(text.core_name(c("company_name")), " "), text.fold(F.element_at(labels, 1))
    title_words = F.split(text.fold(c("page_title")), " ")
    local = tenant & (F.length(label) >= 4) & F.array_contains(words, label) & F.array_contains(words, F.try_element_at(labels, F.lit(-2))) & (F.size(F.array_except(words, title_words)) == 0)
    path = urls.canonical_path(c("page_url"))
    handoff = (F.coalesce(c("candidate_url"), F.lit("")) != "") & urls.host_brand(c("candidate_url"), c("company_name")) & (urls.domain(c("candidate_url")) != host) & (path != "/") & on_title
    operator = F.coalesce(c("operator_match"), F.lit(False))
    staging = F.arrays_overlap(labels, F.array(*[F.lit(x) for x in ("testni", "staging", "preview", "test")]))
    counts = ~staging & ~((c("page_type") == "PROFILE") & ~(dedicated | operator | handoff)) & (operator | dedicated | local | handoff)
    root = urls.homepage(c("page_url"))
    subtree = F.concat(F.regexp_replace(root, "/$", ""), F.regexp_replace(path, "/+$", ""), F.lit("/"))
    own_scope = F.coalesce(c("operator_scope"), F.lit(""))
    scope = (
        F.when(handoff & (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))) > 1), subtree)
        .when(operator & (own_scope != "") & urls.in_scope(c("page_url"), own_scope), own_scope).when(handoff | (operator & ~dedicated & (path != "/")), subtree).otherwise(root)
    )
    prepared = pages.withColumns({"__identity": identity, "__exact": exact, "__scope": F.when(counts, scope)}).withColumns({
        "__third": (c("page_type") == "THIRD_PARTY") | has("parked_domain"), "__group": (c("page_type") == "GROUP") | F.coalesce("group_context", F.lit(False)),
        "__entity": operator & exact, "__conflict": F.coalesce("legal_conflict", F.lit(False)) | text.legal_conflict(c("page_title"), c("company_name")),
    })
    folded = prepared.groupBy(key).agg(
        F.bool_or("__identity").alias("identity"), F.bool_or("__third").alias("third"), F.bool_or("__group").alias("grouped"), F.bool_or("__conflict").alias("conflict"),
        F.bool_or("__entity").alias("entity"), F.bool_or(F.coalesce("known_group", F.lit(False))).alias("known"), F.max("assessment").alias("assessment"),
        F.min_by("__scope", F.when(c("__scope").isNotNull(), c("page_no"))).alias("first_scope"),
    )
    likely = c("assessment") == "LIKELY_THIRD_PARTY"
    known = c("known") | (F.coalesce("assessment", F.lit("")) == "LIKELY_GROUP_OR_PARENT")
    group = (known | c("grouped")) & (known | ~c("entity"))
    made = lambda status, relationship, reason, scope=None: F.struct(F.lit(status).alias("status"), F.lit(relationship).alias("relationship"), (F.lit("") if scope is None else scope).alias("scope"), F.lit(reason).alias("reason"))
    verdict = (
        F.when(likely, made("REVIEW", "THIRD_PARTY", "Stored assessment")).when(c("assessment") == "UNCERTAIN", made("REVIEW", "UNRESOLVED", "Stored assessment"))
        .when(c("third"), made("REVIEW", "THIRD_PARTY", "Publisher is a directory, database or listing")).when(group, made("GROUP_REVIEW", "GROUP_PARENT", "Shared group or parent site"))
        .when(c("conflict"), made("REVIEW", "UNRESOLVED", "Conflicting legal form")).when(c("identity") & c("first_scope").isNotNull(), made("VERIFIED", "LEGAL_ENTITY", "Identity and site ownership", c("first_scope")))
        .otherwise(made("REVIEW", "UNRESOLVED", "Site operator or scope not established"))
    )
    return folded.withColumn("__v", verdict).select(key, "__v.*")


def entity_context(body: Column, company_name: Column, tax: Column, registration: Column) -> Column:
    """Whether a text names the company or one of its numbers; addresses in it do not count as its name."""
    prose = F.regexp_replace(F.coalesce(body, F.lit("")), r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9.-]+", " ")
    return text.contains_name(prose, company_name) | names_number(body, tax) | names_number(body, registration)


def email_attribution(mails: DataFrame) -> DataFrame:
    """``mails`` with attributable and reason: the first rule that fails decides.

    Columns: company_name, tax_number, registration_number, email, visible_email, source_url, source_type (page type),
    publication, status and scope of the site, in_group_scope, block_target, block_other, block_single_page (null
    without a contact block), page_named (the source page itself names the company).
    """
    c = F.col
    explicit = F.when(c("block_target").isNotNull(), c("block_target") & ~F.coalesce("block_other", F.lit(False))).otherwise(
        entity_context(c("publication"), c("company_name"), c("tax_number"), c("registration_number")) & ~text.legal_conflict(c("publication"), c("company_name"))
    )
    vendor = any_in(text.fold(c("publication")), CREDITS)
    own_host = urls.domain(F.substring_index("email", "@", -1)) == urls.domain(c("scope"))
    accepted = explicit | (own_host & (F.coalesce("page_named", F.lit(False)) | F.coalesce("block_single_page", F.lit(False))))
    shown = F.coalesce("visible_email", F.lit(""))
    said = lambda ok, reason: F.struct((F.lit(ok) if isinstance(ok, bool) else ok).alias("attributable"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    group = c("status") == "GROUP_REVIEW"
    rule = (
        F.when((shown != "") & (F.lower(shown) != F.lower("email")), said(False, "Displayed e-mail and link target disagree"))
        .when(~F.coalesce(c("status").isin("VERIFIED", "GROUP_REVIEW"), F.lit(False)), said(False, "Site ownership unresolved"))
        .when(c("source_type") == "THIRD_PARTY", said(False, "Listing source")).when(F.coalesce("block_other", F.lit(False)), said(False, "Contact block of another entity"))
        .when(group & ~F.coalesce("in_group_scope", F.lit(False)), said(False, "Outside the group's site")).when(group & vendor, said(False, "Agency context"))
        .when(group, said(explicit, F.when(explicit, "Explicit entity block").otherwise("No explicit entity")))
        .when(~urls.in_scope(c("source_url"), F.coalesce("scope", F.lit(""))), said(False, "Outside the verified scope")).when(vendor, said(False, "Agency context"))
        .when(text.legal_conflict(c("publication"), c("company_name")), said(False, "Different legal entity"))
        .otherwise(said(accepted, F.when(accepted, "Entity context on verified scope").otherwise("Insufficient entity context")))
    )
    return mails.withColumn("__r", rule).select(*mails.columns, "__r.*")


def best_candidate(verified: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The candidate that a sequential search would end with: the first verified one, else the most confident, first on ties."""
    w = Window.partitionBy(key).orderBy((F.col("status") == "VERIFIED").desc(), F.when(F.col("status") == "VERIFIED", 0).otherwise(-F.col("confidence")).asc(), F.col(ordinal).asc())
    return verified.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def verified_confidence(status: Column, exact: Column, n_signals: Column) -> Column:
    """95 or 85 for verified sites, 40 for groups, up to 60 by signals for reviews."""
    return F.when(status == "VERIFIED", F.when(exact, 95).otherwise(85)).when(status == "GROUP_REVIEW", 40).otherwise(F.least(F.lit(60), 20 * n_signals))


def candidate_order(company_name: Column, url: Column, guessed: Column, identity: Column) -> list[Column]:
    """Sort keys of website candidates: brand, found before guessed, contact path, identity, .si .com .eu, short."""
    path = F.lower(F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1))
    tld = F.substring_index(urls.domain(url), ".", -1)
    place = F.when(tld == "si", 0).when(tld == "com", 1).when(tld == "eu", 2).otherwise(3)
    return [urls.brand_match(url, company_name).desc(), guessed.asc(), path.rlike("kontakt|contact").desc(), F.coalesce(identity, F.lit(False)).desc(), place.asc(), F.length(url).asc()]
