"""Ownership, attribution, contacts, observations, pages and registry records, over settings built from the tables' keys.

The settings are expressions that Spark's and DuckDB's SQL both read; the SQL beside each query works the rules out anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import emails
from ..operators import contacts, extract, html, ownership, registry, results
from ..sources.shared import shared_folder
from ..sources.tables import spread, table
from ._registry import query
from .decisions import _CORE, _LEGAL, _ROLE, NAME, SAID, _any, _fold


def _rows(spark: SparkSession, folder: str, name: str, columns: dict[str, str]) -> DataFrame:
    return table(spark, folder, name).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def _pages(spark: SparkSession, folder: str, columns: dict[str, str]) -> DataFrame:
    """A page of each customer: few bytes are read, much is parsed."""
    return spread(table(spark, folder, "customer").select("c_custkey", "c_name")).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def _sql(name: str, columns: dict[str, str]) -> str:
    return "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {name})"


def _legal(column: str) -> str:
    return _LEGAL.replace("regexp_extract(n,", f"regexp_extract({column},")


def _names(column: str) -> str:
    """Whether the text names ``core``."""
    return f"(length(replace(core, ' ', '')) >= 3 AND contains(' ' || {_fold(column)} || ' ', ' ' || core || ' '))"


def _conflicts(column: str) -> str:
    return f"({_LEGAL} <> '' AND {_legal(column)} <> '' AND {_LEGAL} <> {_legal(column)} AND {_names(column)})"


def _host(column: str) -> str:
    return rf"regexp_extract(lower({column}), '://(?:www\.)?([^/]+)', 1)"


def _path(column: str) -> str:
    return f"coalesce(nullif(rtrim(regexp_extract({column}, '://[^/]+(/.*)$', 1), '/'), ''), '/')"


def _within(url: str, scope: str) -> str:
    return f"({scope} <> '' AND {_host(url)} = {_host(scope)} AND ({_path(scope)} = '/' OR {_path(url)} = {_path(scope)} OR starts_with({_path(url)}, {_path(scope)} || '/')))"


# Ownership of sites

_COMPANY = "(CASE c_custkey % 8 WHEN 7 THEN 'ALFA' || c_custkey || ' Kranj d.o.o.' ELSE 'ALFA' || c_custkey || ' d.o.o.' END)"
_OWNED = {
    "company_id": "c_custkey", "company_name": _COMPANY, "candidate_url": "CASE WHEN c_custkey % 5 = 0 THEN 'https://alfa' || c_custkey || '.com/' ELSE '' END",
    "page_url": """CASE c_custkey % 8 WHEN 0 THEN 'https://alfa' || c_custkey || '.si/' WHEN 1 THEN 'https://www.alfa' || c_custkey || '.si/o-nas' WHEN 2 THEN 'https://alfa' || c_custkey || '.splet.si/' WHEN 3 THEN 'https://splet.si/alfa' || c_custkey || '/x'
WHEN 4 THEN 'https://test.alfa' || c_custkey || '.si/' WHEN 5 THEN 'https://imenik.si/podjetje/' || c_custkey WHEN 6 THEN 'https://alfa' || c_custkey || '.co.uk/' ELSE 'https://kranj.alfa' || c_custkey || '.si/' END""",
    "page_title": f"CASE c_custkey % 7 WHEN 3 THEN 'Domov' WHEN 4 THEN 'Vstop' WHEN 5 THEN 'ALFA' || c_custkey || ' d.d.' WHEN 6 THEN 'Alfa' || c_custkey || ' | Kranj' ELSE {_COMPANY} END",
    "page_no": "1",
    "signals": """CASE c_custkey % 9 WHEN 4 THEN 'company_name_exact' WHEN 5 THEN 'registration_exact,street_address_exact,postal_locality_exact' WHEN 6 THEN 'organization_name_exact,street_address_exact,postal_locality_exact' WHEN 7 THEN ''
WHEN 8 THEN 'tax_exact,company_name_exact,parked_domain' ELSE 'tax_exact,company_name_exact' END""",
    "page_type": "CASE c_custkey % 11 WHEN 0 THEN 'THIRD_PARTY' WHEN 1 THEN 'GROUP' WHEN 2 THEN 'PROFILE' ELSE 'COMPANY_PAGE' END", "operator_match": "c_custkey % 13 < 4",
    "operator_scope": "CASE c_custkey % 13 WHEN 0 THEN 'https://splet.si/alfa' || c_custkey || '/' WHEN 1 THEN 'https://alfa' || c_custkey || '.si/' ELSE '' END",
    "group_context": "c_custkey % 17 = 0", "legal_conflict": "c_custkey % 19 = 0", "known_group": "c_custkey % 23 = 0",
    "assessment": "CASE c_custkey % 29 WHEN 0 THEN 'LIKELY_THIRD_PARTY' WHEN 1 THEN 'UNCERTAIN' WHEN 2 THEN 'LIKELY_GROUP_OR_PARENT' END",
}
_SECOND = _OWNED | {
    "page_url": "'https://alfa' || c_custkey || '.si/kontakt'", "page_title": _COMPANY, "page_no": "2", "signals": "'tax_exact,company_name_exact'", "page_type": "'COMPANY_PAGE'",
    "operator_match": "false", "operator_scope": "''", "group_context": "false", "legal_conflict": "false", "known_group": "false",
}


_VERDICTS = f"""WITH pages_ AS (SELECT *, company_name AS n FROM (SELECT * FROM {_sql("customer", _OWNED)} UNION ALL SELECT * FROM {_sql("customer", _SECOND)} WHERE company_id % 4 = 1)),
a AS (SELECT *, {_CORE} AS core, {_host("page_url")} AS host, {_host("candidate_url")} AS other, {_path("page_url")} AS path, string_split(signals, ',') AS s FROM pages_),
b AS (SELECT *, string_split(host, '.') AS labels, string_split(core, ' ') AS words, replace(core, ' ', '') AS brand, {_names("page_title")} AS titled, {_conflicts("page_title")} AS title_conflict, {_within("page_url", "operator_scope")} AS own_scope,
 regexp_extract(page_url, '^([^:]+://[^/]+)', 1) AS root FROM a),
c AS (SELECT *, len(labels) >= 3 AND labels[-2] || '.' || labels[-1] NOT IN ('co.uk', 'com.au', 'co.nz', 'co.za') AS tenant, length(brand) >= 3 AND labels[1] = brand AS branded,
 candidate_url <> '' AND string_split(other, '.')[1] = brand AND other <> host AND path <> '/' AND titled AS handoff FROM b),
d AS (SELECT *, NOT tenant AND branded AND titled AS dedicated, tenant AND length(labels[1]) >= 4 AND list_contains(words, labels[1]) AND list_contains(words, labels[-2]) AND len(list_filter(words, lambda w: NOT list_contains(string_split({_fold("page_title")}, ' '), w))) = 0 AS local_ FROM c),
e AS (SELECT *, CASE WHEN NOT (list_contains(labels, 'test') OR list_contains(labels, 'testni') OR list_contains(labels, 'staging') OR list_contains(labels, 'preview')) AND (page_type <> 'PROFILE' OR dedicated OR operator_match OR handoff) AND (operator_match OR dedicated OR local_ OR handoff)
 THEN CASE WHEN handoff AND length(path) - length(replace(path, '/', '')) > 1 THEN root || path || '/' WHEN operator_match AND own_scope THEN operator_scope WHEN handoff OR (operator_match AND NOT dedicated AND path <> '/') THEN root || path || '/' ELSE root || '/' END END AS scope,
 list_contains(s, 'tax_exact') OR list_contains(s, 'registration_exact') AS exact, list_contains(s, 'company_name_exact') OR list_contains(s, 'organization_name_exact') AS named, list_contains(s, 'street_address_exact') AND list_contains(s, 'postal_locality_exact') AS placed FROM d),
f AS (SELECT company_id, bool_or((exact AND (named OR placed)) OR (named AND placed)) AS identity, bool_or(page_type = 'THIRD_PARTY' OR list_contains(s, 'parked_domain')) AS third, bool_or(page_type = 'GROUP' OR group_context) AS grouped, bool_or(legal_conflict OR title_conflict) AS conflict,
 bool_or(operator_match AND exact) AS entity, bool_or(known_group) OR coalesce(max(assessment) = 'LIKELY_GROUP_OR_PARENT', false) AS known, max(assessment) AS assessment, arg_min(scope, page_no) FILTER (scope IS NOT NULL) AS scope FROM e GROUP BY company_id),
g AS (SELECT *, CASE WHEN assessment = 'LIKELY_THIRD_PARTY' THEN 1 WHEN assessment = 'UNCERTAIN' THEN 2 WHEN third THEN 3 WHEN known OR (grouped AND NOT entity) THEN 4 WHEN conflict THEN 5 WHEN identity AND scope IS NOT NULL THEN 6 ELSE 7 END AS v FROM f)
SELECT company_id, ['REVIEW', 'REVIEW', 'REVIEW', 'GROUP_REVIEW', 'REVIEW', 'VERIFIED', 'REVIEW'][v] AS status, ['THIRD_PARTY', 'UNRESOLVED', 'THIRD_PARTY', 'GROUP_PARENT', 'UNRESOLVED', 'LEGAL_ENTITY', 'UNRESOLVED'][v] AS relationship, CASE WHEN v = 6 THEN scope ELSE '' END AS scope,
['Stored assessment', 'Stored assessment', 'Publisher is a directory, database or listing', 'Shared group or parent site', 'Conflicting legal form', 'Identity and site ownership', 'Site operator or scope not established'][v] AS reason FROM g"""


@query(_VERDICTS)
def ownership_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """A verdict on each customer's site, from one or two of its pages."""
    first = _rows(spark, folder, "customer", _OWNED)
    pages = first.unionByName(_rows(spark, folder, "customer", _SECOND).filter("company_id % 4 = 1"))
    return ownership.evaluate_ownership(pages.withColumn("signals", F.split("signals", ",")))


_MAILS = {
    "n_": "c_custkey", "company_name": "'ALFA' || c_custkey || ' d.o.o.'", "tax_number": "'SI' || (10000000 + c_custkey)", "registration_number": "CASE WHEN c_custkey % 2 = 0 THEN '' || (5000000 + c_custkey) END",
    "email": "CASE c_custkey % 4 WHEN 0 THEN 'info@alfa' || c_custkey || '.si' WHEN 1 THEN 'Prodaja@Alfa' || c_custkey || '.si' WHEN 2 THEN 'alfa@gmail.com' ELSE 'ana@www.alfa' || c_custkey || '.si' END",
    "visible_email": "CASE c_custkey % 7 WHEN 0 THEN 'drugo@x.si' WHEN 1 THEN 'ALFA@gmail.com' WHEN 2 THEN NULL ELSE '' END",
    "source_url": "CASE c_custkey % 5 WHEN 4 THEN 'https://beta.si/' WHEN 3 THEN 'https://www.alfa' || c_custkey || '.si/a/b' ELSE 'https://alfa' || c_custkey || '.si/kontakt' END", "source_type": "CASE WHEN c_custkey % 11 = 0 THEN 'THIRD_PARTY' ELSE 'COMPANY_PAGE' END",
    "publication": """CASE c_custkey % 6 WHEN 0 THEN 'Kontakt: ALFA' || c_custkey || ', Kranj' WHEN 1 THEN 'pišite nam na info@alfa' || c_custkey || '.si' WHEN 2 THEN 'ALFA' || c_custkey || ' d.d.' WHEN 3 THEN 'ALFA' || c_custkey || ', izdelava splet: Beta' WHEN 4 THEN 'Davčna SI ' || (10000000 + c_custkey) ELSE 'alfa@' || c_custkey || '.si' END""",
    "status": "CASE c_custkey % 10 WHEN 0 THEN NULL WHEN 1 THEN 'REVIEW' WHEN 2 THEN 'GROUP_REVIEW' WHEN 3 THEN 'GROUP_REVIEW' WHEN 4 THEN 'GROUP_REVIEW' ELSE 'VERIFIED' END",
    "scope": "CASE WHEN c_custkey % 14 = 5 THEN 'https://alfa' || c_custkey || '.si/a/' ELSE 'https://alfa' || c_custkey || '.si/' END", "in_group_scope": "c_custkey % 3 > 0",
    "block_target": "CASE c_custkey % 12 WHEN 3 THEN true WHEN 4 THEN true WHEN 7 THEN false WHEN 8 THEN false END", "block_other": "CASE WHEN c_custkey % 17 = 0 THEN true END", "block_single_page": "c_custkey % 8 = 1", "page_named": "c_custkey % 9 = 0",
}
_PROSE = f"regexp_replace(publication, '{emails.EMAIL.replace(chr(39), chr(39) * 2)}', ' ', 'g')"


def _number_in(column: str, number: str) -> str:
    """Whether a text holds the digits of an identifier, bare or after SI, not inside a longer number."""
    return rf"coalesce(length(regexp_replace({number}, '\D', '', 'g')) >= 7 AND list_contains(regexp_extract_all({column}, '\d+'), regexp_replace({number}, '\D', '', 'g')), false)"


def _gate(source: str) -> str:
    """Attribution of the addresses of ``source``, rule by rule."""
    return f"""WITH m AS (SELECT *, company_name AS n, {_CORE.replace("(n,", "(company_name,")} AS core FROM {source}),
a AS (SELECT *, {_names(_PROSE)} OR {_number_in("publication", "tax_number")} OR {_number_in("publication", "registration_number")} AS context, {_conflicts("publication")} AS conflict, {_any(_fold("publication"), ownership.CREDITS)} AS vendor,
 replace(lower(split_part(email, '@', 2)), 'www.', '') = {_host("scope")} AS own_host, {_within("source_url", "scope")} AS inside FROM m),
b AS (SELECT *, CASE WHEN block_target IS NOT NULL THEN block_target AND NOT coalesce(block_other, false) ELSE context AND NOT conflict END AS explicit FROM a),
c AS (SELECT *, explicit OR (own_host AND (page_named OR block_single_page)) AS accepted FROM b),
d AS (SELECT *, CASE WHEN coalesce(visible_email, '') <> '' AND lower(visible_email) <> lower(email) THEN 1 WHEN coalesce(status NOT IN ('VERIFIED', 'GROUP_REVIEW'), true) THEN 2 WHEN source_type = 'THIRD_PARTY' THEN 3 WHEN coalesce(block_other, false) THEN 4
 WHEN status = 'GROUP_REVIEW' AND NOT in_group_scope THEN 5 WHEN status = 'GROUP_REVIEW' AND vendor THEN 6 WHEN status = 'GROUP_REVIEW' THEN CASE WHEN explicit THEN 7 ELSE 8 END WHEN NOT inside THEN 9 WHEN vendor THEN 6 WHEN conflict THEN 10 WHEN accepted THEN 11 ELSE 12 END AS r FROM c)
SELECT n_, r IN (7, 11) AS attributable, ['Displayed e-mail and link target disagree', 'Site ownership unresolved', 'Listing source', 'Contact block of another entity', 'Outside the group''s site', 'Agency context', 'Explicit entity block', 'No explicit entity', 'Outside the verified scope', 'Different legal entity',
 'Entity context on verified scope', 'Insufficient entity context'][r] AS reason FROM d"""


@query(_gate(_sql("customer", _MAILS)))
def email_attributions(spark: SparkSession, folder: str) -> DataFrame:
    """An address of each customer through the ordered gate."""
    return ownership.email_attribution(_rows(spark, folder, "customer", _MAILS)).select("n_", "attributable", "reason")


# Contacts

_SEEN = {
    "company_id": "o_custkey", "company_name": "'ALFA' || o_custkey || ' d.o.o.'", "kind": "CASE WHEN o_orderkey % 3 = 2 THEN 'PHONE' ELSE 'EMAIL' END", "observation_id": "'o' || o_orderkey", "seq": "o_orderkey",
    "normalized_value": """CASE WHEN o_orderkey % 3 = 2 THEN CASE o_orderkey % 4 WHEN 0 THEN '+38612345678' WHEN 1 THEN '+4930123456;ext=5' ELSE '041234567' END
ELSE CASE o_orderkey % 5 WHEN 0 THEN 'info@alfa.si' WHEN 1 THEN 'prodaja.jug@alfa.si' WHEN 2 THEN 'ana.novak@alfa.si' WHEN 3 THEN 'alfa' || o_custkey || '.x@alfa.si' ELSE 'nekaj7@alfa.si' END END""",
    "source_kind": "CASE WHEN o_orderkey % 7 = 0 THEN 'SEARCH_RESULT' ELSE 'FETCHED_PAGE' END", "on_scope": "o_orderkey % 11 > 2", "page_bad": "o_orderkey % 13 = 0", "visible_email": "CASE WHEN o_orderkey % 17 = 0 THEN 'x@y.si' ELSE '' END", "display_conflict": "o_orderkey % 19 = 0",
    "publication": """CASE o_orderkey % 10 WHEN 0 THEN 'ALFA' || o_custkey || ' centrala' WHEN 1 THEN 'prodaja' WHEN 2 THEN 'vracila in orders' WHEN 3 THEN 'gdpr' WHEN 4 THEN 'tajnistvo' WHEN 5 THEN 'gsm direktor' WHEN 6 THEN 'foreign office' WHEN 7 THEN 'powered by Beta' WHEN 8 THEN 'ALFA' || o_custkey || ' d.d.' ELSE 'servis' END""",
    "headings": "CASE WHEN o_orderkey % 9 = 0 THEN 'Glavni kontakt' ELSE '' END", "block_target": "o_orderkey % 4 = 0", "block_other": "o_orderkey % 23 = 0", "block_single_page": "o_orderkey % 4 = 1", "block_section": "o_orderkey % 6 = 0", "block_explicit": "o_orderkey % 10 = 0",
    "identity_match": "o_orderkey % 2 = 0", "other_host": "o_orderkey % 8 < 6",
}
_RANKED = _ROLE.replace(" WHEN regexp_matches(l,", " WHEN split_part(l, '.', 1) = replace(core, ' ', '') THEN 'GENERAL' WHEN regexp_matches(l,")
_CONTACTS = f"""WITH o AS (SELECT *, company_name AS n, {_CORE.replace("(n,", "(company_name,")} AS core, {_fold("publication || ' ' || headings")} AS x, lower(split_part(normalized_value, '@', 1)) AS l, split_part(normalized_value, ';', 1) AS num FROM {_sql("orders", _SEEN)}),
q AS (SELECT *, bool_or(source_kind = 'SEARCH_RESULT' AND identity_match AND other_host) OVER (PARTITION BY company_id, kind, normalized_value) AS backed, CASE WHEN kind = 'PHONE' THEN 'UNKNOWN' ELSE {_RANKED} END AS role FROM o),
j AS (SELECT *, CASE WHEN source_kind <> 'FETCHED_PAGE' THEN 2 WHEN NOT on_scope THEN 3 WHEN page_bad OR (visible_email <> '' AND visible_email <> normalized_value) OR display_conflict OR block_other OR {_conflicts("publication")} OR {_any(_fold("publication"), ownership.CREDITS)} THEN 4 WHEN block_target THEN 1 WHEN block_single_page AND (block_section OR backed) THEN 1 ELSE 3 END AS place,
 CASE kind WHEN 'EMAIL' THEN CASE WHEN {_any("x", contacts.TRANSACTIONAL)} THEN 60 WHEN {_any("x", contacts.LEGAL)} THEN 50 WHEN role = 'PERSON' THEN 40 WHEN {_any("x", contacts.GENERAL_EMAIL)} THEN 0 WHEN {_any("x", contacts.OFFICE)} THEN 10 WHEN role = 'GENERAL' THEN 15 WHEN role = 'SALES' OR {_any("x", contacts.SALES)} THEN 20 WHEN role NOT IN ('UNKNOWN', 'GENERAL') THEN 30 ELSE 25 END
 ELSE CASE WHEN {_any("x", contacts.GENERAL)} THEN 0 WHEN {_any("x", contacts.OFFICE)} THEN 10 WHEN {_any("x", contacts.SALES)} THEN 30 WHEN {_any("x", contacts.DEPARTMENT)} THEN 40 WHEN {_any("x", contacts.MOBILE)} THEN 50 ELSE 20 END
 + CASE WHEN (starts_with(num, '+') AND NOT starts_with(num, '+386')) OR (NOT starts_with(num, '+') AND {_any("x", contacts.FOREIGN)}) THEN CASE WHEN {_any("x", contacts.GENERAL)} AND block_target THEN 0 ELSE 100 + CASE WHEN {_any("x", contacts.FOREIGN)} THEN 50 ELSE 0 END END WHEN starts_with(num, '+386') THEN -2 ELSE 0 END END AS rank_ FROM q),
k AS (SELECT *, row_number() OVER (PARTITION BY company_id, kind, normalized_value ORDER BY place, block_explicit DESC, block_section DESC, seq) AS k, min(rank_) FILTER (place = 1) OVER (PARTITION BY company_id, kind, normalized_value) AS best,
 list(observation_id) OVER (PARTITION BY company_id, kind, normalized_value) AS ids FROM j),
resolved AS (SELECT company_id, kind, normalized_value, ['ATTRIBUTED', 'CANDIDATE', 'UNCERTAIN', 'REJECTED'][place] AS status, observation_id AS primary_observation_id, array_to_string(list_sort(list_distinct(ids)), ';') AS supporting, role, coalesce(best, rank_) AS default_rank, block_explicit AS explicit_company, block_section AS contact_section FROM k WHERE k = 1)
"""


def _observed(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder, "orders", _SEEN).withColumn("headings", F.when(F.col("headings") != "", F.array("headings")))


@query(_CONTACTS + "SELECT * FROM resolved")
def resolved_contacts(spark: SparkSession, folder: str) -> DataFrame:
    """Every order as an observation of a contact of its customer."""
    return contacts.resolve(_observed(spark, folder)).withColumn("supporting", F.array_join("supporting", ";"))


@query(_CONTACTS + """SELECT company_id, kind, normalized_value, default_rank FROM (SELECT *, row_number() OVER (PARTITION BY company_id, kind ORDER BY default_rank, explicit_company DESC, contact_section DESC, normalized_value) AS d FROM resolved WHERE status = 'ATTRIBUTED' AND role <> 'PERSON') WHERE d = 1""")
def default_contacts(spark: SparkSession, folder: str) -> DataFrame:
    return contacts.defaults(contacts.resolve(_observed(spark, folder))).select("company_id", "kind", "normalized_value", "default_rank")


# Observations in texts

_TEXT = """(CASE c_custkey % 6 WHEN 0 THEN 'Tel: +386 1 ' || (1000000 + c_custkey) || ', matična številka: ' || (1000000 + c_custkey) || '.' WHEN 1 THEN 'Davčna številka: SI ' || (10000000 + c_custkey) || '. Telefon: ' || (10000000 + c_custkey)
WHEN 2 THEN 'SKD 2025: 62.0' || (10 + c_custkey % 90) || ', piši na Info' || c_custkey || '@Alfa.si' WHEN 3 THEN 'obišči www.alfa' || c_custkey || '.si ali https://beta.com/x?k=' || c_custkey || '.' WHEN 4 THEN 'Mobil: 041/' || (100000 + c_custkey) || ' in phone 0' || c_custkey || ' 12' END)"""


@query(rf"""WITH t AS (SELECT c_custkey AS id, {_TEXT} AS t, '' || (10000000 + c_custkey) AS tax FROM customer),
phones AS (SELECT id, tax, trim(unnest(regexp_extract_all(t, '(?:Tel|Telefon|Mobil|phone):? ([+0-9][0-9 /]+[0-9])', 1))) AS raw FROM t)
SELECT DISTINCT id, CASE WHEN id % 2 = 1 AND d = tax THEN 'PHONE_EXCLUSION' ELSE 'PHONE_CANDIDATE' END AS kind, CASE WHEN starts_with(raw, '+') THEN '+' ELSE '' END || d AS value FROM (SELECT *, regexp_replace(raw, '\D', '', 'g') AS d FROM phones WHERE length(raw) >= 7) WHERE length(d) BETWEEN 7 AND 15
UNION ALL SELECT id, 'REGISTRATION_NUMBER', regexp_extract(t, 'matična številka: (\d+)', 1) FROM t WHERE contains(t, 'matična') UNION ALL SELECT id, 'TAX_NUMBER', regexp_extract(t, 'Davčna številka: SI (\d+)', 1) FROM t WHERE contains(t, 'Davčna')
UNION ALL SELECT id, 'REGISTERED_ACTIVITY', regexp_extract(t, 'SKD 20\d\d: (\d\d\.\d+)', 1) FROM t WHERE contains(t, 'SKD') UNION ALL SELECT id, 'EMAIL_CANDIDATE', lower(regexp_extract(t, '\S+@\S+', 0)) FROM t WHERE contains(t, '@')
UNION ALL SELECT id, 'WEBSITE_CANDIDATE', 'https://' || regexp_extract(t, 'www\.\S+', 0) || '/' FROM t WHERE contains(t, 'www.') UNION ALL SELECT id, 'WEBSITE_CANDIDATE', rtrim(regexp_extract(t, 'https://\S+', 0), '.') FROM t WHERE contains(t, 'https')""")
def labelled_observations(spark: SparkSession, folder: str) -> DataFrame:
    """What texts say; a number that is the company's own identifier is no phone."""
    rows = _rows(spark, folder, "customer", {"id": "c_custkey", "t": _TEXT})
    known = _rows(spark, folder, "customer", {"id": "c_custkey", "kind": "'TAX_NUMBER'", "value": "'SI' || (10000000 + c_custkey)"}).filter("id % 2 = 1")
    return extract.exclude_identifiers(extract.observations(rows, "id", "t"), known, "id").select("id", "kind", "value").distinct()


_TOLD = f"(CASE c_custkey % 5 WHEN 0 THEN 'ID za DDV: SI' || (10000000 + c_custkey) WHEN 1 THEN '  ' WHEN 2 THEN 'info@alfa' || c_custkey || '.si' WHEN 3 THEN NULL ELSE {SAID} END)"


@query(f"""SELECT id, kind, coalesce(t, '') AS value FROM (SELECT c_custkey AS id, {_TOLD} AS t, {NAME} AS n, {_CORE.replace("(n,", f"({NAME},")} AS core, 'SI' || (10000000 + c_custkey) AS tax FROM customer),
(SELECT unnest(['COMPANY_IDENTITY', 'BUSINESS_DESCRIPTION']) AS kind) WHERE CASE kind WHEN 'BUSINESS_DESCRIPTION' THEN trim(coalesce(t, '')) <> '' ELSE {_names(_PROSE.replace("publication", "coalesce(t, '')"))} OR {_number_in("coalesce(t, '')", "tax")} END""")
def incidental_observations(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions of the company by name or number, and texts that are not blank."""
    rows = _rows(spark, folder, "customer", {"id": "c_custkey", "t": _TOLD, "n": NAME, "tax": "'SI' || (10000000 + c_custkey)", "reg": "CAST(NULL AS STRING)"})
    return extract.incidental(rows, "id", "t", "n", "tax", "reg")


# Pages

_FIRM = "'ALFA' || page_id || ' d.o.o.'"
_LD = f"""(CASE page_id % 5 WHEN 0 THEN '{{"@graph": [{{"@type": "WebSite", "url": "https://alfa' || page_id || '.si/", "publisher": {{"name": "' || {_FIRM} || '"}}}}, {{"@type": ["Store"], "legalName": "' || {_FIRM} || '"}}]}}'
WHEN 1 THEN '{{"@type": "Organization", "name": "' || {_FIRM} || '", "url": "https://alfa' || page_id || '.si/"}}' WHEN 2 THEN '{{bad' WHEN 3 THEN '{{"@type": "WebSite", "url": "https://splet.si/alfa' || page_id || '", "publisher": {{"legalName": "' || {_FIRM} || '", "name": "y"}}}}' ELSE '' END)"""
_BLOCK = """(CASE page_id % 4 WHEN 0 THEN '<section><h2>ALFA' || page_id || '</h2><p hidden>skrito</p><a href="mailto:Info' || page_id || '@alfa.si?subject=x">info' || page_id || '@alfa.si</a></section>' WHEN 1 THEN '<div><h3>Prodaja</h3><p>Pokliči <a href="tel:+3861' || (1000000 + page_id) || '">klic</a></p></div>'
WHEN 2 THEN '<p>Piši: <a href="mailto:x@y.si">tukaj</a></p>' ELSE '' END)"""
_HTML = f"""replace(replace(html, '</head>', '<script type="application/ld+json">' || {_LD} || '</script></head>'), '<body>', '<body>' || {_BLOCK})"""
_PAGE = {
    "page_id": "page_id", "html": _HTML, "company_name": _FIRM, "page_url": "CASE page_id % 3 WHEN 0 THEN 'https://alfa' || page_id || '.si/kontakt' WHEN 1 THEN 'https://splet.si/alfa' || page_id || '/a' ELSE 'https://www.alfa' || page_id || '.si/skupina/a' END",
    "page_title": f"CASE page_id % 7 WHEN 0 THEN 'Domov' WHEN 1 THEN 'ALFA' || page_id || ' d.d.' WHEN 2 THEN 'Poslovni imenik' ELSE {_FIRM} END",
    "visible": f"CASE page_id % 6 WHEN 0 THEN 'Upravljavec spletne strani: ALFA' || page_id || ', d.o.o.' WHEN 1 THEN 'Podjetja v skupini' WHEN 2 THEN 'website is operated by alfa' || page_id || 'x' ELSE 'nekaj' END",
    "policy": "CASE page_id % 11 WHEN 0 THEN 'BLOCK_AS_OFFICIAL' WHEN 1 THEN 'GROUP_REVIEW' END",
}
_OBJECTS = f"""SELECT page_id, page_url, company_name, o FROM (SELECT *, regexp_extract(html, 'ld[+]json">(.*?)</script>', 1) AS j FROM {_sql("pages", _PAGE)}), (SELECT unnest(['$', '$."@graph"[0]', '$."@graph"[1]']) AS p), LATERAL (SELECT json_extract(CASE WHEN json_valid(j) THEN j ELSE '{{}}' END, p) AS o) WHERE o IS NOT NULL"""
_LD_SQL = f"""SELECT page_id, page_url, company_name, kind, coalesce(json_extract_string(x, '$.legalName'), json_extract_string(x, '$.name'), '') AS name, coalesce(json_extract_string(o, '$.url'), '') AS url
FROM ({_OBJECTS}), (SELECT unnest(['ORGANIZATION', 'PUBLISHER']) AS kind), LATERAL (SELECT CASE kind WHEN 'PUBLISHER' THEN json_extract(o, '$.publisher') ELSE o END AS x)
WHERE CASE kind WHEN 'PUBLISHER' THEN json_extract_string(o, '$."@type"') = 'WebSite' ELSE json_extract_string(o, '$."@type"') IN ('Organization', '["Store"]') END"""


@query(f"SELECT page_id, kind, name, url FROM ({_LD_SQL})")
def json_ld_names(spark: SparkSession, folder: str) -> DataFrame:
    """Organisations and publishers in the structured data of all pages."""
    return html.json_ld(_rows(spark, folder, "pages", _PAGE), "page_id", "html").select("page_id", "kind", "name", "url")


@query(rf"""SELECT page_id, regexp_extract(s, 'href="([^"]+)"', 1) AS href, trim(regexp_replace(regexp_replace(regexp_replace(s, '<p hidden>[^<]*</p>', ' '), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS publication, regexp_extract(s, '<h[1-4]>(.*?)</h', 1) AS heading,
CASE WHEN contains(regexp_extract(s, '<a [^>]*>(.*?)</a>', 1), '@') THEN regexp_extract(s, '<a [^>]*>(.*?)</a>', 1) ELSE '' END AS visible_email, len(regexp_extract_all(html, '<h[1-4][ >]'))::INT AS n_headings FROM (SELECT *, regexp_extract(html, '<body>(.*?)<nav>', 1) AS s FROM {_sql("pages", _PAGE)}) WHERE contains(s, 'href')""")
def contact_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The block around each mail and telephone link."""
    found = html.blocks(_rows(spark, folder, "pages", _PAGE), "page_id", "html")
    return found.select("page_id", "href", "publication", F.coalesce(F.try_element_at("headings", F.lit(1)), F.lit("")).alias("heading"), "visible_email", F.size("page_headings").alias("n_headings"))


_TYPED = f"""CASE WHEN policy = 'BLOCK_AS_OFFICIAL' THEN 'THIRD_PARTY' WHEN policy = 'GROUP_REVIEW' THEN 'GROUP' WHEN page_title = 'Poslovni imenik' THEN 'THIRD_PARTY' WHEN contains(page_url, '/skupina/') THEN 'GROUP' ELSE 'COMPANY_PAGE' END"""


@query(f"""WITH p AS (SELECT *, company_name AS n, {_CORE.replace("(n,", "(company_name,")} AS core, {_TYPED} AS page_type, {_fold("visible")} AS v FROM {_sql("pages", _PAGE)}),
s AS (SELECT page_id, max(url) AS scope FROM ({_LD_SQL}) WHERE kind = 'PUBLISHER' AND url <> '' AND name = company_name AND {_within("page_url", "url")} GROUP BY page_id)
SELECT page_id, page_type, scope IS NOT NULL OR contains(v || ' ', 'upravljavec spletne strani ' || core || ' ') OR contains(v || ' ', 'website is operated by ' || core || ' ') AS operator_match, coalesce(scope, '') AS operator_scope, page_type = 'GROUP' OR contains(v, 'podjetja v skupini') AS group_context, {_conflicts("page_title")} AS legal_conflict, {_names("page_title")} AS site_brand_match
FROM p LEFT JOIN s USING (page_id)""")
def page_operators(spark: SparkSession, folder: str) -> DataFrame:
    """Who runs each page: publishers in scope, statements, groups, other legal forms."""
    return ownership.page_facts(_rows(spark, folder, "pages", _PAGE)).select("page_id", "page_type", "operator_match", "operator_scope", "group_context", "legal_conflict", "site_brand_match")


# Registry pages


def _row(label: str, value: str) -> str:
    return f"""'<div class="row"><span class="text-thin">{label}</span><b>' || {value} || '</b></div>'"""


_DETAIL = f"""('<div id="accordianBody1">' || {_row("Firma", "c_name || ' d.o.o.'")} || {_row("Matična številka", "(5000000 + c_custkey) || ' 000'")} || {_row("Ident. št. za DDV in davčna številka", "'SI ' || (10000000 + c_custkey)")} || {_row("Poslovni naslov", "'Cesta ' || c_custkey")}
|| {_row("Status subjekta", "CASE c_custkey % 3 WHEN 0 THEN 'vpisan' WHEN 1 THEN 'izbrisan' ELSE 'ni vpisa' END")} || {_row("Osnovni kapital", "CASE WHEN c_custkey % 4 = 0 THEN '' ELSE (7500 + c_custkey) || ',00' END")} || '</div>'
|| '<div id="accordianBody3"><div class="matchHeight">' || {_row("Osebno ime", "'Oseba  Ena ' || c_custkey")} || {_row("Vrsta zastopnika", "CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'direktor' END")} || {_row("Naslov", "'Doma ' || c_custkey")} || {_row("Datum podelitve pooblastila", "(1 + c_custkey % 28) || '.2.2020'")} || '</div></div>'
|| '<div id="accordianBody2"><div class="col-md-6"><h4>DRUŽBENIKI</h4><div style="page-break-inside: avoid">' || {_row("Zap. št. družbenika", "'1'")} || {_row("CASE_NAME", "'Oseba ' || c_custkey")} || {_row("Naslov", "'Doma 1'")} || '</div></div>'
|| '<div class="col-md-6"><h4>POSLOVNI DELEŽI</h4><div style="page-break-inside: avoid">' || {_row("Zap. št. deleža", "'' || c_custkey")} || {_row("Imetniki", "'Zap. št. družbenika 1'")} || {_row("Delež v odstotku ali ulomku", "CASE WHEN c_custkey % 5 = 0 THEN '1/2' ELSE (c_custkey % 100) || ',5 %' END")} || '</div></div></div>')"""
_DETAIL = _DETAIL.replace("CASE_NAME", "' || CASE WHEN c_custkey % 2 = 0 THEN 'Firma' ELSE 'Osebno ime' END || '")
_REGISTERED = {"id": "c_custkey", "url": "'https://r.example.com/podjetje.asp?e=' || c_custkey", "html": _DETAIL}


@query("""SELECT c_custkey AS id, what, name, value FROM customer, LATERAL (SELECT * FROM (VALUES ('company', c_name || ' d.o.o.', (5000000 + c_custkey) || '000 ' || (10000000 + c_custkey) || ' Cesta ' || c_custkey || ' ' || c_custkey),
('fact', 'registry_status', CASE c_custkey % 3 WHEN 0 THEN 'vpisan' WHEN 1 THEN 'izbrisan' END), ('fact', 'share_capital', CASE WHEN c_custkey % 4 > 0 THEN (7500 + c_custkey) || ',00' END),
('person', 'Oseba Ena ' || c_custkey, CASE WHEN c_custkey % 7 > 0 THEN 'REPRESENTATIVE direktor 2020-02-' || lpad('' || (1 + c_custkey % 28), 2, '0') || ' [REDACTED]' END),
('share', 'Oseba ' || c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'LEGAL_ENTITY ' ELSE 'NATURAL_PERSON ' END || CASE WHEN c_custkey % 5 > 0 THEN (c_custkey % 100) || '.5 ' ELSE '' END || CASE WHEN c_custkey % 2 = 0 THEN 'Doma 1' ELSE '[REDACTED]' END)) t(what, name, value)) WHERE value IS NOT NULL""")
def registry_page(spark: SparkSession, folder: str) -> DataFrame:
    """The company, facts, people and owners on a detail page of every customer; addresses of people are not kept."""
    pages = _pages(spark, folder, _REGISTERED)
    parsed = registry.details(pages, "id", "html", "url")
    path = shared_folder(spark, "pages")  # four tables are made of what is parsed once
    parsed.write.parquet(path)
    found = spark.read.schema(parsed.schema).parquet(path)
    out = registry.companies(found, "id", "url").select("id", F.lit("company").alias("what"), F.col("canonical_name").alias("name"), F.concat_ws(" ", "registration_number", "tax_number", "address", "external_id").alias("value"))
    out = out.unionAll(registry.facts(found, "id").select("id", F.lit("fact"), "fact_key", "value"))
    out = out.unionAll(registry.people(found, "id").select("id", F.lit("person"), "full_name", F.concat_ws(" ", "role_type", "title", "valid_from", F.col("raw_fields")["Naslov"])))
    return out.unionAll(registry.ownership(found, "id").select("id", F.lit("share"), "owner_raw_name", F.concat_ws(" ", "owner_type", F.col("share_percent").cast("string"), F.col("raw_fields")["Naslov"])))


_SHOWN = """(CASE c_custkey % 4 WHEN 0 THEN 'Ni zadetkov' WHEN 1 THEN 'PRIJAVA V SISTEM' ELSE '<table><tr><th>Firma</th><th>Matična številka</th><th>Davčna številka</th></tr><tr><td><a href="podjetje.asp?e=' || c_custkey || '">' || c_name || '</a></td><td>' || c_custkey || ' 4321</td><td>SI ' || (10000000 + c_custkey) || '</td></tr>'
|| CASE WHEN c_custkey % 4 = 3 THEN '<tr><td>druga</td><td>77</td><td></td></tr>' ELSE '<tr><td>kratka</td></tr>' END || '</table>' END)"""


@query("""SELECT c_custkey AS id, 'OK' AS status, c_name AS name, c_custkey || '4321' AS registration_number, '' || (10000000 + c_custkey) AS tax_number, 'https://r.example.com/podjetje.asp?e=' || c_custkey AS detail_url FROM customer WHERE c_custkey % 4 > 1
UNION ALL SELECT c_custkey, 'OK', 'druga', '77', NULL, NULL FROM customer WHERE c_custkey % 4 = 3 UNION ALL SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'NO_RESULT' ELSE 'LOGIN_REQUIRED' END, NULL, NULL, NULL, NULL FROM customer WHERE c_custkey % 4 < 2""")
def registry_search(spark: SparkSession, folder: str) -> DataFrame:
    return registry.search_candidates(_pages(spark, folder, {"id": "c_custkey", "html": _SHOWN}), "id", "html", "https://r.example.com/")


_FIGURE = "(CASE o_orderkey % 6 WHEN 0 THEN '-' WHEN 1 THEN 'x' WHEN 2 THEN 'skupaj: ' || o_orderkey || ',25' WHEN 3 THEN '1.' || (100 + o_orderkey % 900) || ',5' ELSE '' || o_orderkey END)"
_OF = "(CASE o_orderkey % 4 WHEN 0 THEN 'Prihodki' WHEN 1 THEN 'Čisti dobiček' WHEN 2 THEN 'Zaposleni' ELSE 'Drugo' END)"


@query(rf"""WITH c AS (SELECT o_custkey AS id, o_orderkey AS no, ['revenue', 'profit', 'employees', NULL][o_orderkey % 4 + 1] AS m, {_FIGURE} AS raw FROM orders),
v AS (SELECT *, try_cast(replace(replace(regexp_replace(CASE WHEN contains(raw, ':') THEN split_part(raw, ':', 2) ELSE raw END, '\s', '', 'g'), '.', ''), ',', '.') AS DOUBLE) AS x FROM c),
p AS (SELECT id, m, count(*) AS n, any_value(x) AS x, bool_or(x IS NULL AND raw <> '-') AS bad, bool_or(x IS NULL) AS empty FROM v WHERE m IS NOT NULL GROUP BY id, m),
w AS (SELECT id, max(CASE WHEN m = 'revenue' AND n = 1 THEN x END) AS revenue_2025, max(CASE WHEN m = 'profit' AND n = 1 THEN x END) AS profit_2025, max(CASE WHEN m = 'employees' AND n = 1 THEN x END) AS employees_2025, bool_or(n > 1 OR bad) AS wrong, bool_or(empty) AS lacks FROM p GROUP BY id)
SELECT id, revenue_2025, profit_2025, employees_2025, CASE WHEN coalesce(wrong, true) THEN 'PARSE_ERROR' WHEN revenue_2025 IS NULL OR profit_2025 IS NULL OR employees_2025 IS NULL OR lacks THEN 'PARTIAL' ELSE 'OK' END AS financial_status FROM (SELECT DISTINCT id FROM c) LEFT JOIN w USING (id)""")
def financial_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Every order as a labelled cell of its customer's statement; a metric that stands twice is an error."""
    cells = _rows(spark, folder, "orders", {"id": "o_custkey", "cell_no": "o_orderkey", "raw": _FIGURE, "label": _OF})
    return registry.financials(cells, "id").select("id", "revenue_2025", "profit_2025", "employees_2025", "financial_status")


_LISTED = """('<ul><li class="x newsearchIcon"><h3>' || c_name || '</h3><div class="address">Cesta 1, ' || (4000 + c_custkey % 100) || ' Kranj</div><span class="registrationNumber">Matična: ' || (5000000 + c_custkey) || '</span><span class="taxNumber">' || CASE WHEN c_custkey % 2 = 0 THEN 'Davčna: ' || (10000000 + c_custkey) ELSE '' END || '</span><a href="/d?CompanyId=' || c_custkey || '">več</a></li>'
|| CASE WHEN c_custkey % 3 = 0 THEN '<li class="newsearchIcon"><h3> </h3></li>' ELSE '<li class="newsearchIcon"><h3>Druga &amp; ' || c_custkey || '</h3></li>' END || '</ul>')"""


@query("""SELECT c_custkey AS id, 0 AS row_no, c_name AS company_name, 'Cesta 1, ' || (4000 + c_custkey % 100) || ' Kranj' AS address, (4000 + c_custkey % 100) || ' Kranj' AS municipality, '' || (5000000 + c_custkey) AS registration_number, CASE WHEN c_custkey % 2 = 0 THEN '' || (10000000 + c_custkey) END AS tax_number, '' || c_custkey AS external_id, 'https://r.example.com/d?CompanyId=' || c_custkey AS detail_url FROM customer
UNION ALL SELECT c_custkey, 1, 'Druga &amp; ' || c_custkey, '', '', NULL, NULL, NULL, NULL FROM customer WHERE c_custkey % 3 > 0""")
def result_rows(spark: SparkSession, folder: str) -> DataFrame:
    found = results.company_rows(_pages(spark, folder, {"id": "c_custkey", "html": _LISTED}), "id", "html", "https://r.example.com/")
    return found.select("id", "row_no", "company_name", "address", "municipality", "registration_number", "tax_number", "external_id", "detail_url")
