"""Names, addresses, contacts, pages and reports by their rules, over variants that are built from the tables' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import emails, ids, numbers, phones, text, urls
from ..operators import contacts, jobs, ownership, results
from ..operators import relational as rel
from ..sources.tables import table
from ._registry import query

#: A company's name with one of several endings; the same expression in Spark's and DuckDB's SQL.
NAME = """(CASE c_custkey % 9 WHEN 0 THEN 'Alfa ' || c_custkey || ' d.o.o.' WHEN 1 THEN 'Beta' || c_custkey || ', D. D., Kranj' WHEN 2 THEN 'GAMA ' || c_custkey || ' s.p.' WHEN 3 THEN 'Čebela-' || c_custkey || ' GmbH & Co'
WHEN 4 THEN 'Žaga ' || c_custkey || ' družba z omejeno odgovornostjo d.o.o. - v stečaju' WHEN 5 THEN 'ab' WHEN 6 THEN 'Delta ' || c_custkey || ' inc' WHEN 7 THEN ' Šola  ' || c_custkey || ' d o o ' ELSE c_name END)"""
#: What a page says, naming the company or not.
SAID = f"(CASE c_custkey % 4 WHEN 0 THEN 'Kontakt: ' || {NAME} || ' - vsi podatki' WHEN 1 THEN 'ALFA ' || c_custkey || ' d.d. in drugi' WHEN 2 THEN 'Beta' || c_custkey || ', d.o.o.' ELSE 'nekaj drugega' END)"
_FORM = text.LEGAL_FORM
_LOCAL = text.LOCAL_LEGAL_FORM


def _fold(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({x})), '[^a-z0-9]+', ' ', 'g'))"


_CORE = _fold(rf"regexp_replace(n, '(?is){_FORM}.*$', '')")
_LEGAL = "replace(" + _fold(rf"regexp_extract(n, '(?i)({_FORM})', 1)") + ", ' ', '')"
_LIST = ", ".join(f"'{w}'" for w in (*text.MATCH_FORMS, *text.MATCH_WORDS))
_BANKRUPT = r"contains(' ' || trim(regexp_replace(lower(n), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ', ' v stečaju ')"
_LABEL = "replace(" + _fold("CASE " + " ".join(f"WHEN instr(lower(n), '{f}') > 0 THEN substr(lower(n), 1, instr(lower(n), '{f}') - 1)" for f in text.DOMAIN_FORMS) + " ELSE lower(n) END") + ", ' ', '')"


def _named(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("*", F.expr(NAME).alias("n"), F.expr(SAID).alias("said"))


@query(rf"""SELECT c_custkey, {_CORE} AS core, {_fold(rf"regexp_replace(n, '(?i){_LOCAL}', ' ', 'g')")} AS without_forms,
regexp_replace(regexp_replace(n, '(?is){_LOCAL}.*$', ''), '^[ ,]+|[ ,]+$', '', 'g') AS base,
array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(strip_accents(lower(n))),
 '\bd\s*[.\-]?\s*o\s*[.\-]?\s*o\b', ' doo ', 'g'), '\bd\s*[.\-]?\s*d\b', ' dd ', 'g'), '\bj\s*[.\-]?\s*d\s*[.\-]?\s*o\s*[.\-]?\s*o\b', ' jdoo ', 'g'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t NOT IN ({_LIST}) AND t <> ''), ' ') AS matched,
{_LABEL} AS label, {_LEGAL} AS legal_form, CASE WHEN {_BANKRUPT} THEN 'INELIGIBLE' ELSE 'ELIGIBLE' END AS eligibility,
trim(regexp_replace(lower(n), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS legal_name FROM (SELECT c_custkey, {NAME} AS n FROM customer)""")
def company_names(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("n")
    return _named(spark, folder).select(
        "c_custkey", text.core_name(n).alias("core"), text.name_without_forms(n).alias("without_forms"), text.base_name(n).alias("base"), text.match_name(n).alias("matched"),
        text.domain_label(n).alias("label"), text.legal_form(n).alias("legal_form"), text.eligibility(n)["status"].alias("eligibility"), text.legal_name(n).alias("legal_name"),
    )


_NAMES = f"(length(replace({_CORE}, ' ', '')) >= 3 AND contains(' ' || {_fold('said')} || ' ', ' ' || {_CORE} || ' '))"
_OTHER = "replace(" + _fold(rf"regexp_extract(said, '(?i)({_FORM})', 1)") + ", ' ', '')"


@query(f"""SELECT c_custkey, {_NAMES} AS names_it, {_LEGAL} <> '' AND {_OTHER} <> '' AND {_LEGAL} <> {_OTHER} AND {_NAMES} AS conflict FROM (SELECT c_custkey, {NAME} AS n, {SAID} AS said FROM customer)""")
def company_mentions(spark: SparkSession, folder: str) -> DataFrame:
    return _named(spark, folder).select("c_custkey", text.contains_name(F.col("said"), F.col("n")).alias("names_it"), text.legal_conflict(F.col("said"), F.col("n")).alias("conflict"))


@query(f"""SELECT c_custkey, url FROM (SELECT c_custkey, {_LABEL} AS l FROM (SELECT c_custkey, {NAME} AS n FROM customer)), (SELECT 'https://' || w || '%' || t AS p FROM (VALUES (''), ('www.')) a(w), (VALUES ('.si'), ('.com'), ('.eu')) b(t)), LATERAL (SELECT replace(p, '%', l) AS url)
WHERE length(l) >= 3""")
def guessed_urls(spark: SparkSession, folder: str) -> DataFrame:
    return _named(spark, folder).select("c_custkey", F.explode(urls.candidate_urls(F.col("n"))).alias("url"))


@query(rf"""SELECT c_custkey, '"' || b || '" ' || coalesce(nullif(place, ''), 'Slovenija') AS first, CASE WHEN tax <> '' THEN '"' || tax || '" "' || b || '"' ELSE '"' || b || '" Slovenija kontakt' END AS second, 'https://s.example.com/?q=' || replace(url_encode(b), '%20', '+') AS link
FROM (SELECT c_custkey, regexp_replace(regexp_replace({NAME}, '(?is){_LOCAL}.*$', ''), '^[ ,]+|[ ,]+$', '', 'g') AS b, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN 'Kranj' END AS place, CASE WHEN c_custkey % 2 = 0 THEN '' || (10000000 + c_custkey) ELSE '' END AS tax FROM customer)""")
def search_texts(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    place, tax = F.when(k % 3 == 0, "").when(k % 3 == 1, "Kranj"), F.when(k % 2 == 0, F.concat(F.lit("SI"), (10000000 + k).cast("string")))
    made = urls.queries(F.col("n"), place, tax)
    return _named(spark, folder).select("c_custkey", made[0].alias("first"), made[1].alias("second"), urls.search_url("https://s.example.com/?q=", text.base_name(F.col("n"))).alias("link"))


@query(r"""SELECT c_custkey, regexp_extract(place, '^\s*(\d{4})\s*(.*)$', 1) AS code, trim(regexp_extract(place, '^\s*(\d{4})\s*(.*)$', 2)) AS city, trim(regexp_extract(address, '(\d{4}\s+[A-Za-zČŠŽčšžĆćĐđ\- ]+)$', 1)) AS municipality,
CASE WHEN regexp_matches(day, '^\d{1,2}\.\d{1,2}\.\d{4}$') THEN split_part(day, '.', 3) || '-' || lpad(split_part(day, '.', 2), 2, '0') || '-' || lpad(split_part(day, '.', 1), 2, '0') END AS day,
CASE WHEN regexp_matches(share, '%$') THEN try_cast(replace(trim(rtrim(share, '%')), ',', '.') AS DOUBLE) END AS share, greatest(least(c_custkey - 50, 100), 0)::INT AS confidence, CASE WHEN c_custkey % 5 > 0 THEN least(c_custkey, 60) END::INT AS capped,
nullif(CASE WHEN lower(regexp_replace(trim(cell), '\.0$', '')) <> 'nan' THEN regexp_replace(trim(cell), '\.0$', '') END, '') AS cell FROM (
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'brez' ELSE ' ' || (1000 + c_custkey % 9000) || '  Novo Mesto ' || c_custkey % 7 END AS place, 'Cesta ' || c_custkey || ', ' || (1000 + c_custkey % 9000) || CASE WHEN c_custkey % 4 = 0 THEN ' Škofja Loka' ELSE ' Kranj 2' END AS address,
CASE WHEN c_custkey % 6 = 0 THEN '2021-01-02' ELSE (1 + c_custkey % 28) || '.' || (1 + c_custkey % 12) || '.20' || (10 + c_custkey % 15) END AS day, CASE WHEN c_custkey % 5 = 0 THEN '1/2' ELSE (c_custkey % 100) || ',' || (c_custkey % 10) || ' %' END AS share,
CASE c_custkey % 4 WHEN 0 THEN ' ' || c_custkey || '.0' WHEN 1 THEN 'NaN' WHEN 2 THEN '  ' ELSE 'a.0b' END AS cell FROM customer)""")
def cell_values(spark: SparkSession, folder: str) -> DataFrame:
    made = table(spark, folder, "customer").select(
        "c_custkey",
        F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'brez' ELSE ' ' || (1000 + c_custkey % 9000) || '  Novo Mesto ' || c_custkey % 7 END").alias("place"),
        F.expr("'Cesta ' || c_custkey || ', ' || (1000 + c_custkey % 9000) || CASE WHEN c_custkey % 4 = 0 THEN ' Škofja Loka' ELSE ' Kranj 2' END").alias("address"),
        F.expr("CASE WHEN c_custkey % 6 = 0 THEN '2021-01-02' ELSE (1 + c_custkey % 28) || '.' || (1 + c_custkey % 12) || '.20' || (10 + c_custkey % 15) END").alias("day"),
        F.expr("CASE WHEN c_custkey % 5 = 0 THEN '1/2' ELSE (c_custkey % 100) || ',' || (c_custkey % 10) || ' %' END").alias("share"),
        F.expr("CASE c_custkey % 4 WHEN 0 THEN ' ' || c_custkey || '.0' WHEN 1 THEN 'NaN' WHEN 2 THEN '  ' ELSE 'a.0b' END").alias("cell"),
    )
    parts, k = numbers.postal_parts(F.col("place")), F.col("c_custkey")
    return made.select(
        "c_custkey", parts["code"].alias("code"), parts["city"].alias("city"), numbers.municipality(F.col("address")).alias("municipality"), numbers.european_date(F.col("day")).alias("day"), numbers.percent(F.col("share")).alias("share"),
        ids.clamp_confidence(k - 50).cast("int").alias("confidence"), ids.at_most(F.when(k % 5 > 0, k), 60).cast("int").alias("capped"), numbers.cell_text(F.col("cell")).alias("cell"),
    )


_TAX = "(CASE c_custkey % 4 WHEN 0 THEN ' si ' || (10000000 + c_custkey) WHEN 1 THEN 'SI' || c_custkey || ' 5' WHEN 2 THEN 'brez' ELSE '' || c_custkey || '-7' END)"
_TEL = "(CASE c_custkey % 6 WHEN 0 THEN 'tel:+386 (0)1 ' || (2000000 + c_custkey) WHEN 1 THEN '00386 41 ' || (100000 + c_custkey) WHEN 2 THEN '01/234-' || (1000 + c_custkey % 9000) || ' ext. 12' WHEN 3 THEN '12' WHEN 4 THEN '+49 30 ' || (100000 + c_custkey) ELSE 'klic 01 ' || (100000 + c_custkey) END)"


@query(rf"""SELECT c_custkey, nullif(regexp_replace(regexp_replace(trim(t), '(?i)^SI\s*', ''), '\D', '', 'g'), '') AS tax, CASE WHEN regexp_matches(regexp_replace(upper(regexp_replace(t, '\s', '', 'g')), '^SI', ''), '^[0-9]+$') THEN regexp_replace(upper(regexp_replace(t, '\s', '', 'g')), '^SI', '') END AS strict,
CASE WHEN length(d) BETWEEN 7 AND 15 THEN CASE WHEN starts_with(v, '+') OR starts_with(d, '00') THEN '+' ELSE '' END || CASE WHEN starts_with(d, '00') THEN substr(d, 3) ELSE d END || CASE WHEN contains(v, 'ext.') THEN ';ext=12' ELSE '' END END AS phone
FROM (SELECT *, regexp_replace(split_part(v, ' ext.', 1), '\D', '', 'g') AS d FROM (SELECT c_custkey, {_TAX} AS t, regexp_replace(trim(regexp_replace({_TEL}, '(?i)^tel:', '')), '^(\+\d{{1,3}})\s*\(0\)', '\1') AS v FROM customer))""")
def numbers_and_phones(spark: SparkSession, folder: str) -> DataFrame:
    t = F.expr(_TAX)
    return table(spark, folder, "customer").select("c_custkey", ids.tax_number(t).alias("tax"), ids.strict_identifier(t, tax=True).alias("strict"), phones.observed_phone(F.expr(_TEL)).alias("phone"))


_MAIL = "(CASE c_custkey % 8 WHEN 0 THEN 'info@alfa' || c_custkey || '.si' WHEN 1 THEN 'prodaja.jug@gmail.com' WHEN 2 THEN 'ana.novak@mail.alfa' || c_custkey || '.si' WHEN 3 THEN 'HR@beta.com' WHEN 4 THEN 'uprava_1@beta.com' WHEN 5 THEN 'nekaj7@siol.net' WHEN 6 THEN 'servis-k@x.eu' ELSE 'racunovodstvo@y.eu' END)"
_SITE = "('https://www.alfa' || (c_custkey - c_custkey % 3) || '.si/o-nas?CompanyId=' || c_custkey || '#x')"


def _starts(*words: str) -> str:
    return " OR ".join(f"l = '{w}' OR starts_with(l, '{w}.') OR starts_with(l, '{w}_')" + (f" OR starts_with(l, '{w}')" if w in emails.OPEN_STARTS else "") for w in words)


_HOSTS = ", ".join(f"'{h}'" for h in urls.PUBLIC_MAIL)
_ROLE = "CASE " + " ".join(f"WHEN {_starts(*w)} THEN '{r}'" for r, w in emails.ROLES.items()) + r" WHEN regexp_matches(l, '^\p{L}{2,}[._-]\p{L}{2,}$') THEN 'PERSON' ELSE 'UNKNOWN' END"


@query(rf"""SELECT c_custkey, {_ROLE} AS role, h = site OR ends_with(h, '.' || site) AS on_site, CASE WHEN h NOT IN ({_HOSTS}) THEN 'https://' || h END AS website, '' || c_custkey AS company_id, 'https://www.' || site || '/' AS home, contains(split_part(site, '.', 1), 'alfa' || c_custkey) AS named
FROM (SELECT c_custkey, lower(split_part({_MAIL}, '@', 1)) AS l, lower(split_part({_MAIL}, '@', 2)) AS h, 'alfa' || (c_custkey - c_custkey % 3) || '.si' AS site FROM customer)""")
def email_roles(spark: SparkSession, folder: str) -> DataFrame:
    mail, site = F.expr(_MAIL), F.expr(_SITE)
    return table(spark, folder, "customer").select(
        "c_custkey", emails.role(mail).alias("role"), emails.on_domain(mail, site).alias("on_site"), urls.website_from_email(mail).alias("website"), urls.query_value(site, "CompanyId").alias("company_id"),
        urls.homepage(site).alias("home"), urls.host_brand(site, F.concat(F.lit("Alfa "), F.col("c_custkey").cast("string"), F.lit(" d.o.o."))).alias("named"),
    )


_CELL = "(CASE c_custkey % 7 WHEN 0 THEN 'Čisti prihodki od prodaje' WHEN 1 THEN 'Čisti dobiček' WHEN 2 THEN 'Povprečno število zaposlenih' WHEN 3 THEN ' Sredstva ' WHEN 4 THEN 'Kapital' WHEN 5 THEN 'Dobiček na zaposlenega' ELSE 'Ostala sredstva' END)"
_HITS = "[" + ", ".join(f"CASE WHEN regexp_matches(lower({_CELL}), '{p}') THEN '{m}' END" for m, p in numbers.METRICS.items()) + "]"


@query(f"SELECT c_custkey, CASE WHEN len(m) = 1 THEN m[1] END AS metric FROM (SELECT c_custkey, list_filter({_HITS}, lambda x: x IS NOT NULL) AS m FROM customer)")
def financial_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", numbers.financial_metric(F.expr(_CELL)).alias("metric"))


_ERROR = "(CASE event_id % 7 WHEN 0 THEN 'Timeout after ' || user_id WHEN 1 THEN 'HTTP 429' WHEN 2 THEN 'Connection refused' WHEN 3 THEN NULL WHEN 4 THEN 'DDGSException: none' WHEN 5 THEN 'bad value' ELSE 'SSLError x' END)"
_AGAIN = "(" + " OR ".join(f"contains(lower(coalesce(m, '')), '{t}')" for t in results.RETRYABLE) + ")"
_DOWN = "(" + " OR ".join(f"contains(lower(coalesce(m, '')), '{t}')" for t in jobs.INFRASTRUCTURE) + ")"
_STATE = "CASE event_id % 3 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'FOUND' ELSE 'NOT_FOUND' END"


@query(f"SELECT count(*) FILTER (s = 'ERROR' AND {_AGAIN}) AS retryable, count(*) FILTER (s = 'ERROR' AND NOT {_AGAIN}) AS non_retryable, count(*) FILTER ({_DOWN}) AS infrastructure FROM (SELECT {_ERROR} AS m, {_STATE} AS s FROM events)")
def error_triage(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select(F.expr(_ERROR).alias("m"), F.expr(_STATE).alias("s"))
    down = rows.agg(F.count_if(jobs.infrastructure_failure(F.col("m"))).alias("infrastructure"))
    return results.triage(rows, "s", "m").crossJoin(down)  # one row each


@query(f"""SELECT s AS status, n, e AS with_emails, r AS requests, sum(e) OVER ()::BIGINT AS companies_with_emails, sum(r) OVER ()::BIGINT AS all_requests FROM (SELECT {_STATE} AS s, count(*) AS n, count(*) FILTER (event_id % 5 > 2) AS e, sum(event_id % 11)::BIGINT AS r FROM events GROUP BY 1)""")
def batch_summary_long(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select(F.expr(_STATE).alias("s"), F.greatest(F.col("event_id") % 5 - 2, F.lit(0)).alias("e"), (F.col("event_id") % 11).alias("r"))
    total = jobs.batch_summary(rows, "s", "e", "r")
    by = rows.groupBy("s").agg(F.count_if(F.col("e") > 0).alias("with_emails"), F.sum("r").alias("requests"))
    return total.select(F.explode("statuses").alias("s", "n"), "companies_with_emails", F.col("requests").alias("all_requests")).join(by, "s").withColumnRenamed("s", "status")


_BODY = "(CASE page_id % 6 WHEN 0 THEN 'Preveč zahtev, poskusite kasneje' WHEN 1 THEN 'Oprostite, prišlo je do napake' WHEN 2 THEN 'Too Many Requests' WHEN 3 THEN NULL ELSE 'podatki' END)"
_AT = "(CASE page_id % 10 WHEN 0 THEN url || '/Authenticate' WHEN 5 THEN url || '/ErrorPage.aspx' ELSE url END)"


@query(f"""SELECT page_id, CASE WHEN contains(u, 'authenticate') OR contains(u, 'accounts.') THEN 'LOGIN' WHEN contains(u, 'errorpage.aspx') OR {" OR ".join(f"contains(b, '{w}')" for w in results.FAILURES)} THEN 'ERROR_PAGE' WHEN {" OR ".join(f"contains(b, '{w}')" for w in results.RATE_LIMITS)} THEN 'RATE_LIMITED' END AS problem
FROM (SELECT page_id, lower({_AT}) AS u, lower(coalesce({_BODY}, '')) AS b FROM pages)""")
def page_problems(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", results.page_problem(F.expr(_AT), F.expr(_BODY)).alias("problem"))


_PATH = "(CASE page_id % 7 WHEN 0 THEN '/business/x' WHEN 1 THEN '/skupina/x' WHEN 2 THEN '/company/x' ELSE '/o-nas' END)"
_TITLE = "(CASE page_id % 5 WHEN 0 THEN 'Poslovni imenik' WHEN 1 THEN 'Company profile: Alfa' WHEN 2 THEN 'Podjetja v koncernu' ELSE 'Alfa' END)"
_POLICY = "(CASE page_id % 11 WHEN 0 THEN 'BLOCK_AS_OFFICIAL' WHEN 1 THEN 'GROUP_REVIEW' WHEN 2 THEN 'ALLOW' END)"
_SEEN = "(CASE page_id % 13 WHEN 0 THEN 'our company directory' ELSE 'nas program' END)"


def _any(c: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


@query(f"""SELECT page_id, CASE WHEN p = 'BLOCK_AS_OFFICIAL' THEN 'THIRD_PARTY' WHEN p = 'GROUP_REVIEW' THEN 'GROUP' WHEN {_any('u', ownership.STRUCTURAL)} OR {_any('t', ownership.DIRECTORY_TITLES)} OR {_any('b', ownership.DIRECTORY_BODIES)} THEN 'THIRD_PARTY'
WHEN {_any('t', ownership.PROFILE_TITLES)} OR {_any('u', ('/company/', '/companies/', '/dealers/'))} THEN 'PROFILE' WHEN {_any('u', ownership.GROUP_PATHS)} OR {_any('t', ownership.GROUP_TITLES)} THEN 'GROUP' WHEN s = 'third_party_marketplace_page' THEN 'THIRD_PARTY' WHEN s = 'directory_page' THEN 'PROFILE' ELSE 'COMPANY_PAGE' END AS page_type
FROM (SELECT page_id, {_PATH} AS u, lower({_TITLE}) AS t, {_POLICY} AS p, {_SEEN} AS b, CASE page_id % 17 WHEN 0 THEN 'third_party_marketplace_page' WHEN 1 THEN 'directory_page' END AS s FROM pages)""")
def page_type_rules(spark: SparkSession, folder: str) -> DataFrame:
    signals = F.expr("array_compact(array(CASE page_id % 17 WHEN 0 THEN 'third_party_marketplace_page' WHEN 1 THEN 'directory_page' END))")
    url = F.concat(F.lit("https://x.example.com"), F.expr(_PATH))
    return table(spark, folder, "pages").select("page_id", ownership.page_type(url, F.expr(_POLICY), F.expr(_TITLE), F.expr(_SEEN), signals).alias("page_type"))


_CANDIDATES = "SELECT user_id AS company, event_id AS ordinal, CASE event_id % 5 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'GROUP_REVIEW' ELSE 'REVIEW' END AS status, event_id % 3 = 0 AS exact, (event_id % 4)::INT AS n_signals FROM events"


@query(f"""SELECT company, ordinal, status, confidence FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY CASE WHEN status = 'VERIFIED' THEN 1000 ELSE confidence END DESC, ordinal) AS k
FROM (SELECT *, CASE status WHEN 'VERIFIED' THEN CASE WHEN exact THEN 95 ELSE 85 END WHEN 'GROUP_REVIEW' THEN 40 ELSE least(60, 20 * n_signals) END AS confidence FROM ({_CANDIDATES}))) WHERE k = 1""")
def best_website(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, folder, "events").select(F.col("user_id").alias("company"), e.alias("ordinal"), F.when(e % 5 == 0, "VERIFIED").when(e % 5 == 1, "GROUP_REVIEW").otherwise("REVIEW").alias("status"), (e % 3 == 0).alias("exact"), (e % 4).cast("int").alias("n_signals"))
    rows = rows.withColumn("confidence", ownership.verified_confidence(F.col("status"), F.col("exact"), F.col("n_signals")))
    return ownership.best_candidate(rows, "company", "ordinal").select("company", "ordinal", "status", "confidence")


_HOST = "('https://' || CASE event_id % 4 WHEN 0 THEN 'alfa-' || user_id ELSE 'mesto' || event_id END || CASE event_id % 5 WHEN 0 THEN '.si' WHEN 1 THEN '.com' WHEN 2 THEN '.eu' ELSE '.net' END || CASE WHEN event_id % 3 = 0 THEN '/kontakt' ELSE '/' END)"


@query(f"""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 4 = 0 DESC, event_id % 2 = 0, event_id % 3 = 0 DESC, event_id % 7 = 0 DESC, CASE WHEN event_id % 5 < 3 THEN event_id % 5 ELSE 3 END, length({_HOST}), event_id)::INT AS place FROM events""")
def website_candidate_order(spark: SparkSession, folder: str) -> DataFrame:
    e, name = F.col("event_id"), F.concat(F.lit("Alfa "), F.col("user_id").cast("string"), F.lit(" d.o.o."))
    order = ownership.candidate_order(name, F.expr(_HOST), e % 2 == 0, e % 7 == 0)
    return rel.numbered(table(spark, folder, "events").select("user_id", "event_id"), "user_id", "place", *order, "event_id")


_CONTEXT = "(CASE c_custkey % 9 WHEN 0 THEN 'vracila in reklamacije' WHEN 1 THEN 'gdpr in zasebnost' WHEN 2 THEN 'general contact' WHEN 3 THEN 'tajnistvo' WHEN 4 THEN 'centrala' WHEN 5 THEN 'prodaja' WHEN 6 THEN 'servis' WHEN 7 THEN 'gsm direktor' ELSE 'foreign office' END)"
_NUMBER = "(CASE c_custkey % 4 WHEN 0 THEN '+38612345678' WHEN 1 THEN '+4930123456' ELSE '012345678' END)"


def _in(words: tuple[str, ...]) -> str:
    return _any("x", words)


@query(f"""SELECT c_custkey, CASE WHEN {_in(contacts.TRANSACTIONAL)} THEN 60 WHEN {_in(contacts.LEGAL)} THEN 50 WHEN r = 'PERSON' THEN 40 WHEN {_in(contacts.GENERAL_EMAIL)} THEN 0 WHEN {_in(contacts.OFFICE)} THEN 10 WHEN r = 'GENERAL' THEN 15 WHEN r = 'SALES' OR {_in(contacts.SALES)} THEN 20 WHEN r NOT IN ('UNKNOWN', 'GENERAL') THEN 30 ELSE 25 END AS email_rank,
CASE WHEN {_in(contacts.GENERAL)} THEN 0 WHEN {_in(contacts.OFFICE)} THEN 10 WHEN {_in(contacts.SALES)} THEN 30 WHEN {_in(contacts.DEPARTMENT)} THEN 40 WHEN {_in(contacts.MOBILE)} THEN 50 ELSE 20 END
+ CASE WHEN (starts_with(n, '+') AND NOT starts_with(n, '+386')) OR (NOT starts_with(n, '+') AND {_in(contacts.FOREIGN)}) THEN CASE WHEN {_in(contacts.GENERAL)} AND g THEN 0 ELSE 100 + CASE WHEN {_in(contacts.FOREIGN)} THEN 50 ELSE 0 END END WHEN starts_with(n, '+386') THEN -2 ELSE 0 END AS phone_rank
FROM (SELECT c_custkey, {_CONTEXT} AS x, {_NUMBER} AS n, c_custkey % 5 = 0 AS g, CASE c_custkey % 6 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'GENERAL' WHEN 2 THEN 'SALES' WHEN 3 THEN 'HR' ELSE 'UNKNOWN' END AS r FROM customer)""")
def contact_ranks(spark: SparkSession, folder: str) -> DataFrame:
    role = F.expr("CASE c_custkey % 6 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'GENERAL' WHEN 2 THEN 'SALES' WHEN 3 THEN 'HR' ELSE 'UNKNOWN' END")
    return table(spark, folder, "customer").select("c_custkey", contacts.email_rank(F.expr(_CONTEXT), role).alias("email_rank"), contacts.phone_rank(F.expr(_CONTEXT), F.expr(_NUMBER), F.col("c_custkey") % 5 == 0).alias("phone_rank"))


@query("""SELECT c_custkey, CASE WHEN a THEN 'circuit-breaker' WHEN b THEN 'complete' WHEN c THEN 'interrupted' ELSE 'incomplete' END AS state, len(list_distinct(done)) = 2 AND len(list_filter(done, lambda x: NOT list_contains(wanted, x))) = 0 AS valid,
CASE WHEN c_custkey % 5 = 0 THEN 'VERIFIED' WHEN c_custkey % 5 < 3 THEN 'REVIEW' ELSE 'NOT_FOUND' END AS website, CASE WHEN NOT b THEN 'INCOMPLETE' WHEN c_custkey % 7 > 0 THEN 'FOUND' ELSE 'NO_ATTRIBUTED_CONTACT' END AS contacts
FROM (SELECT c_custkey, c_custkey % 7 = 0 AS a, c_custkey % 3 = 0 AS b, c_custkey % 2 = 0 AS c, [c_custkey, c_custkey + 1] AS wanted, [c_custkey + c_custkey % 3, c_custkey + 1] AS done FROM customer)""")
def report_states(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    made = contacts.outcome(F.when(k % 5 == 0, "VERIFIED").when(k % 5 == 1, "REVIEW").when(k % 5 == 2, "GROUP_REVIEW").otherwise("x"), k % 7, k % 3 == 0)
    return table(spark, folder, "customer").select(
        "c_custkey", jobs.report_state(k % 7 == 0, k % 3 == 0, k % 2 == 0).alias("state"), jobs.report_valid(F.array(k, k + 1), F.array(k + k % 3, k + 1)).alias("valid"), made["website"].alias("website"), made["contacts"].alias("contacts"),
    )
