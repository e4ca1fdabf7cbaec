"""What pages and search results say, repairs of stored evidence, budgets, sorted reports, SQL functions, adapters and round trips through files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import emails, sql, text, urls
from ..operators import extract, jobs, merge, ownership, repair, runs
from ..operators import relational as rel
from ..sources import files
from ..sources.shared import shared_folder
from ..sources.tables import table
from ._registry import query
from .decisions import _any, _fold
from .evidence import _MAILS, _OWNED, _SECOND, _VERDICTS, _gate, _number_in, _rows, _sql

# Page signals

_SAYS = """CASE c_custkey % 9 WHEN 0 THEN 'ALFA ' || c_custkey || ', Cesta ' || c_custkey || ', Novo mesto' WHEN 1 THEN 'Davčna SI' || (10000000 + c_custkey) || ' in ' || (5000000 + c_custkey) WHEN 2 THEN 'Domena je naprodaj' WHEN 3 THEN 'Poslovni imenik: Alfa ' || c_custkey WHEN 4 THEN 'online marketplace, verified seller'
WHEN 5 THEN 'alfa ' || c_custkey || 'x' WHEN 6 THEN 'cesta ' || c_custkey || ' 1, novo mesto' WHEN 7 THEN '9' || (10000000 + c_custkey) ELSE '' END"""
_SCORED = {
    "k": "c_custkey", "company_name": "CASE WHEN c_custkey % 7 = 0 THEN 'Ab d.o.o.' ELSE 'Alfa ' || c_custkey || ' d.o.o.' END", "tax_number": "'SI' || (10000000 + c_custkey)", "registration_number": "CASE WHEN c_custkey % 2 = 0 THEN '' || (5000000 + c_custkey) END",
    "address": "'Cesta ' || c_custkey || ', Novo mesto'", "municipality": "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'Novo mesto' END", "visible": _SAYS,
    "url": "CASE c_custkey % 4 WHEN 0 THEN 'https://alfa' || c_custkey || '.si/' WHEN 1 THEN 'https://trg.si/searchdealer/x' WHEN 2 THEN 'https://novice.si/x' ELSE 'https://x.si/' END", "title": "CASE c_custkey % 11 WHEN 0 THEN 'Company profile' WHEN 1 THEN 'Zaposlitev' WHEN 2 THEN 'News article' ELSE 'Domov' END",
    "organisation": "CASE WHEN c_custkey % 6 = 0 THEN 'ALFA ' || c_custkey || ', d.d.' ELSE 'Druga' END",
}
_BARE = rf"{_fold(rf"regexp_replace(%s, '(?i){text.LOCAL_LEGAL_FORM}', ' ', 'g')")}"
_LABEL = "regexp_extract(url, '//(?:www[.])?([^./]+)', 1)"
_FLAGS = {
    "tax_exact": _number_in("said", "tax_number"), "registration_exact": _number_in("said", "registration_number"),
    "company_name_exact": "length(tight) >= 4 AND contains(' ' || b || ' ', ' ' || bare || ' ')", "organization_name_exact": f"bare = {_BARE.replace('%s', 'organisation')}",
    "street_address_exact": "length(street) > 5 AND contains(' ' || b || ' ', ' ' || street || ' ')", "postal_locality_exact": "place <> '' AND contains(' ' || b || ' ', ' ' || place || ' ')",
    "parked_domain": _any("b", ownership.PARKED), "directory_page": _any("b", ownership.LISTING), "third_party_profile_page": _any("l", ownership.PROFILES), "news_or_media_page": _any("l", ownership.NEWS),
    "domain_matches_company_name": f"length(tight) >= 4 AND (contains({_LABEL}, tight) OR contains(tight, {_LABEL}))",
    "third_party_marketplace_page": f"{_any('b', ownership.MARKETS)} AND ({_any('l', ownership.SELLER_TITLES)} OR {_any('b', ownership.SELLER_BODIES)}) AND NOT (length(tight) >= 4 AND (contains({_LABEL}, tight) OR contains(tight, {_LABEL})))",
}


@query(f"""WITH s AS (SELECT *, visible || ' ' || organisation AS said, {_fold('visible')} AS b, {_BARE.replace('%s', 'company_name')} AS bare, {_fold("split_part(address, ',', 1)")} AS street, {_fold('municipality')} AS place, {_fold("title || ' ' || url")} AS l FROM {_sql('customer', _SCORED)}),
t AS (SELECT *, replace(bare, ' ', '') AS tight FROM s)
SELECT k, array_to_string(list_filter([{", ".join(f"CASE WHEN {v} THEN '{n}' END" for n, v in _FLAGS.items())}], lambda x: x IS NOT NULL), ',') AS signals FROM t""")
def page_signals(spark: SparkSession, folder: str) -> DataFrame:
    """What a page says about each customer."""
    c = F.col
    rows = _rows(spark, folder, "customer", _SCORED)
    company = {n: c(n) for n in ("company_name", "tax_number", "registration_number", "address", "municipality")}
    return rows.select("k", F.array_join(ownership.page_signals(company, c("url"), c("title"), c("visible"), F.array("organisation")), ",").alias("signals"))


_FOUND = {
    "k": "c_custkey", "url": "CASE c_custkey % 8 WHEN 0 THEN 'https://mojedelo.si/x' WHEN 1 THEN 'https://a.si/jobs/' WHEN 2 THEN 'https://a.si/company/x' WHEN 3 THEN 'https://a.si/skupina/x' WHEN 4 THEN 'https://a.si/business/x' ELSE 'https://alfa' || c_custkey || '.si/' END",
    "policy": "CASE c_custkey % 13 WHEN 0 THEN 'BLOCK_AS_OFFICIAL' WHEN 1 THEN 'GROUP_REVIEW' WHEN 2 THEN 'ALLOW' END", "title": "CASE c_custkey % 7 WHEN 0 THEN 'Novice' WHEN 1 THEN NULL WHEN 2 THEN 'Company profile' ELSE 'Alfa' END",
    "body": "CASE c_custkey % 5 WHEN 0 THEN 'Izkušnje zaposlenih' WHEN 1 THEN repeat('x', 398) || ' news' WHEN 2 THEN NULL WHEN 3 THEN 'Alfa ' || c_custkey || ', d.o.o.' ELSE 'SI' || (10000000 + c_custkey) || ' alfa' END",
    "n": "'Alfa ' || c_custkey || ' d.o.o.'", "tax": "'' || (10000000 + c_custkey)",
}


@query(f"""WITH r AS (SELECT *, {_fold("url || ' ' || coalesce(title, '') || ' ' || substr(coalesce(body, ''), 1, 400)")} AS said FROM {_sql('customer', _FOUND)})
SELECT k, coalesce(policy, '') NOT IN ('BLOCK_AS_OFFICIAL', 'GROUP_REVIEW') AND NOT {_any('url', ('/company/', '/skupina/', '/business/'))} AND NOT {_any('said', ownership.NO_CANDIDATES)} AS fit,
contains(' ' || {_fold("coalesce(body, '')")} || ' ', ' ' || {_fold('n')} || ' ') OR {_number_in("coalesce(body, '')", 'tax')} AS specific FROM r""")
def candidate_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Which search results may be a company's own site, and which mentions name the entity itself."""
    c = F.col
    rows = _rows(spark, folder, "customer", _FOUND)
    return rows.select("k", ownership.candidate_fit(c("url"), c("policy"), c("title"), c("body")).alias("fit"), ownership.entity_specific(c("body"), c("n"), c("tax"), F.lit(None).cast("string")).alias("specific"))


_LINKED = "(CASE c_custkey % 5 WHEN 0 THEN 'mailto:Info' || c_custkey || '@Alfa.si,b@c.si?subject=x@y.si' WHEN 1 THEN 'MAILTO:a%40b.si' WHEN 2 THEN 'tel:+38612345678' WHEN 3 THEN 'mailto:?to=a@b.si' ELSE NULL END)"


@query(f"""SELECT k, unnest(CASE k % 5 WHEN 0 THEN list_sort(['b@c.si', 'info' || k || '@alfa.si']) WHEN 1 THEN ['a@b.si'] END) AS email FROM (SELECT c_custkey AS k, {_LINKED} AS href FROM customer) WHERE starts_with(lower(href), 'mailto:')""")
def mailto_recipients(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer").selectExpr("c_custkey AS k", f"{_LINKED} AS href")
    return rows.select("k", F.explode(emails.mailto_emails(F.col("href"))).alias("email"))


_HIT = {
    "k": "c_custkey", "company_name": "'ALFA' || c_custkey || ' d.o.o.'", "url": "CASE c_custkey % 3 WHEN 0 THEN 'HTTPS://Alfa' || c_custkey || '.si/o#x' WHEN 1 THEN 'ftp://x.si/' ELSE 'https://user@x.si/' END",
    "tax": "'' || (10000000 + c_custkey)", "title": "CASE c_custkey % 4 WHEN 0 THEN 'Alfa' || c_custkey || ', D. O. O. | Domov' WHEN 1 THEN 'Alfa' || c_custkey || ' | Domov' WHEN 2 THEN 'SI' || (10000000 + c_custkey) END", "body": "CASE c_custkey % 5 WHEN 0 THEN 'Piši na Info@alfa' || c_custkey || '.si' WHEN 1 THEN 'Tel: 01 234 ' || (1000 + c_custkey) WHEN 2 THEN 'glej https://beta.com/' || c_custkey || ',' ELSE 'nič' END",
}


@query(f"""WITH h AS (SELECT *, contains(' ' || {_fold("coalesce(title, '') || ' ' || body")} || ' ', ' alfa' || k || ' d o o ') OR contains(coalesce(title, ''), tax) AS m FROM {_sql('customer', _HIT)})
SELECT k, m AS identity_match, 'WEBSITE_CANDIDATE' AS kind, 'search_url' AS method, 'https://alfa' || k || '.si/o' AS value FROM h WHERE k % 3 = 0
UNION ALL SELECT k, m, 'EMAIL_CANDIDATE', 'search_snippet', lower(regexp_extract(body, '\\S+@\\S+', 0)) FROM h WHERE contains(body, '@')
UNION ALL SELECT k, m, 'WEBSITE_CANDIDATE', 'email_domain', 'https://' || split_part(lower(body), '@', 2) || '/' FROM h WHERE contains(body, '@') AND m
UNION ALL SELECT k, m, 'PHONE_CANDIDATE', 'search_snippet', regexp_replace(body, '\\D', '', 'g') FROM h WHERE starts_with(body, 'Tel')
UNION ALL SELECT k, m, 'WEBSITE_CANDIDATE', 'snippet_url', rtrim(regexp_extract(body, 'https://\\S+', 0), ',') FROM h WHERE contains(body, 'https')""")
def search_observations(spark: SparkSession, folder: str) -> DataFrame:
    """Websites, addresses and telephone numbers in search results."""
    return extract.search_candidates(_rows(spark, folder, "customer", _HIT), "company_name", "tax").select("k", "identity_match", "kind", "method", "value")


# Repair of stored evidence

_STORED = {c: e for c, e in _MAILS.items() if c not in ("status", "scope")}


@query(f"""WITH v AS ({_VERDICTS}), g AS ({_gate(f"(SELECT m.*, v.status, v.scope FROM {_sql('customer', _STORED)} m LEFT JOIN v ON v.company_id = m.n_)")})
SELECT 'sites' AS "of", company_id, '' AS email, 'UPDATE' AS action, status || ' ' || relationship AS said FROM v WHERE status <> 'VERIFIED' OR relationship <> 'LEGAL_ENTITY' OR scope <> 'https://alfa' || company_id || '.si/'
UNION ALL SELECT 'mails', n_, email, 'DELETE', reason FROM g JOIN {_sql('customer', _STORED)} USING (n_) WHERE NOT attributable
UNION ALL SELECT 'kept', n_, email, 'RETAIN', '' FROM g JOIN {_sql('customer', _STORED)} USING (n_) WHERE attributable""")
def evidence_repair(spark: SparkSession, folder: str) -> DataFrame:
    """All stored verdicts and addresses judged again by what their pages say: the journal, and what stays."""
    pages = _rows(spark, folder, "customer", _OWNED).unionByName(_rows(spark, folder, "customer", _SECOND).filter("company_id % 4 = 1")).withColumn("signals", F.split("signals", ","))
    sites = _rows(spark, folder, "customer", {"company_id": "c_custkey", "website_status": "'VERIFIED'", "relationship": "'LEGAL_ENTITY'", "scope": "'https://alfa' || c_custkey || '.si/'"})
    mails = _rows(spark, folder, "customer", _STORED).withColumnRenamed("n_", "company_id")
    _, kept, journal = repair.reassess(sites, mails, pages)
    field = lambda c, n: F.get_json_object(c, f"$.{n}")
    said = F.when(F.col("of") == "sites", F.concat_ws(" ", field("after", "website_status"), field("after", "relationship"))).otherwise(field("before", "reason"))
    return journal.select("of", "company_id", "email", "action", said.alias("said")).unionByName(kept.select(F.lit("kept").alias("of"), "company_id", "email", F.lit("RETAIN").alias("action"), F.lit("").alias("said")))


# Joins, budgets and reports


@query("""SELECT o_orderkey, o_custkey, o_orderkey % 3 AS attempt FROM orders JOIN customer ON c_custkey = o_custkey AND o_orderkey % 3 = c_custkey % 3 AND o_orderstatus = CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'O' END""")
def selected_attempt_results(spark: SparkSession, folder: str) -> DataFrame:
    """Results of the run and attempt that each company has selected: one join on three keys."""
    found = table(spark, folder, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 3).alias("attempt"), F.col("o_orderstatus").alias("run"))
    k = F.col("c_custkey")
    chosen = table(spark, folder, "customer").select(k.alias("o_custkey"), (k % 3).alias("attempt"), F.when(k % 2 == 0, "F").otherwise("O").alias("run"))
    return runs.current_results(found, chosen, ["o_custkey", "attempt", "run"]).select("o_orderkey", "o_custkey", "attempt")


@query("""SELECT o_custkey, o_orderpriority AS role, o_orderkey AS link_id, c_name FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS k FROM orders) JOIN customer ON c_custkey = o_custkey WHERE k = 1""")
def role_links(spark: SparkSession, folder: str) -> DataFrame:
    """The first link of each person and role, in a fixed order."""
    links = rel.top_per_key(table(spark, folder, "orders"), ["o_custkey", "o_orderpriority"], 1, "o_orderdate", "o_orderkey")
    people = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return links.join(people, "o_custkey").select("o_custkey", F.col("o_orderpriority").alias("role"), F.col("o_orderkey").alias("link_id"), "c_name")


_ZONES = ("Etc/GMT-5", "Etc/GMT+8")


@query("""WITH d AS (SELECT event_id, event_type, (ts + INTERVAL 1 HOUR * CASE event_type WHEN 'view' THEN 5 WHEN 'error' THEN -8 ELSE 0 END)::DATE AS day FROM events)
SELECT event_id, event_type, day, row_number() OVER (PARTITION BY event_type, day ORDER BY event_id) AS used, row_number() OVER (PARTITION BY event_type, day ORDER BY event_id) <= 50 AS allowed FROM d""")
def local_day_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Daily budgets in each source's own calendar day; an unknown zone counts in UTC."""
    zone = F.when(F.col("event_type") == "view", _ZONES[0]).when(F.col("event_type") == "error", _ZONES[1]).when(F.col("event_type") == "click", "Nowhere/Else")
    rows = table(spark, folder, "events").select("event_id", "event_type", rel.local_day(F.col("ts").cast("timestamp"), zone, _ZONES).alias("day"))
    return rel.within_quota(rows, "event_type", F.col("day"), 50, "event_id").select("event_id", "event_type", "day", F.col("used").cast("long").alias("used"), "allowed")


@query("""SELECT c_custkey, c_mktsegment AS region, row_number() OVER (PARTITION BY c_mktsegment ORDER BY lpad('' || (1000 + c_nationkey * 37 % 900), 4, '0'), CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'Mesto ' || c_custkey % 4 END NULLS LAST, c_name DESC) AS place FROM customer""")
def sorted_report(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each region by postal code, place and name."""
    k = F.col("c_custkey")
    rows = table(spark, folder, "customer").select("c_custkey", F.col("c_mktsegment").alias("region"), "c_name", F.lpad((1000 + F.col("c_nationkey") * 37 % 900).cast("string"), 4, "0").alias("code"), F.when(k % 3 > 0, F.concat(F.lit("Mesto "), (k % 4).cast("string"))).alias("city"))
    return rel.numbered(rows, "region", "place", F.col("code").asc(), F.col("city").asc_nulls_last(), F.col("c_name").desc()).select("c_custkey", "region", F.col("place").cast("long").alias("place"))


_SITE = "(CASE c_custkey % 6 WHEN 0 THEN ' www.alfa' || c_custkey || '.si ' WHEN 1 THEN 'http://beta.si/' WHEN 2 THEN 'Ni podatka' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE 'httpd.si' END)"


@query(f"""SELECT c_custkey, CASE WHEN trim(s) = '' OR lower(trim(s)) = 'ni podatka' THEN NULL WHEN starts_with(trim(s), 'http') THEN trim(s) ELSE 'https://' || trim(s) END AS url FROM (SELECT c_custkey, {_SITE} AS s FROM customer)""")
def sanitized_urls(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", urls.sanitized_url(F.expr(_SITE)).alias("url"))


@query("""SELECT s_suppkey AS id, s_name AS name, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer""")
def additive_migration(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of an older and a newer schema in one table."""
    old = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return merge.add_columns(old, table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def in_list_join(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose key is in a list of any length: a semi join, not chunks of literals."""
    wanted = table(spark, folder, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(wanted, "o_custkey", "left_semi")


@query("""SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'PENDING' ELSE 'CLAIMED' END AS status, CASE WHEN o_orderstatus <> 'O' THEN 'w' || o_custkey % 5 END AS claimed_by, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS lease_until FROM orders""")
def released_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Pending tasks lose their lease columns."""
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "PENDING").otherwise("CLAIMED").alias("status"), F.concat(F.lit("w"), (F.col("o_custkey") % 5).cast("string")).alias("claimed_by"), F.col("o_orderdate").alias("lease_until")
    )
    return jobs.released(rows)


# Surfaces


@query(r"""SELECT c_custkey, nullif(regexp_replace(regexp_replace(trim(t), '(?i)^SI\s*', ''), '\D', '', 'g'), '') AS tax, CASE WHEN regexp_matches(regexp_replace(upper(regexp_replace(t, '\s', '', 'g')), '^SI', ''), '^[0-9]+$') THEN regexp_replace(upper(regexp_replace(t, '\s', '', 'g')), '^SI', '') END AS strict, nullif(lower(trim(regexp_replace(c_name || '  X', '\s+', ' ', 'g'))), '') AS person,
CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 3 END AS priority FROM (SELECT *, CASE c_custkey % 4 WHEN 0 THEN ' si ' || (10000000 + c_custkey) WHEN 1 THEN 'SI' || c_custkey || ' 5' WHEN 2 THEN 'brez' ELSE c_custkey || '-7' END AS t FROM customer)""")
def sql_functions(spark: SparkSession, folder: str) -> DataFrame:
    """The normalisers called from SQL text."""
    sql.register(spark)
    rows = table(spark, folder, "customer").selectExpr("c_custkey", "c_name", "CASE c_custkey % 4 WHEN 0 THEN ' si ' || (10000000 + c_custkey) WHEN 1 THEN 'SI' || c_custkey || ' 5' WHEN 2 THEN 'brez' ELSE c_custkey || '-7' END AS t")
    rows.createOrReplaceTempView("kelvane_numbers")
    return spark.sql("SELECT c_custkey, tax_number(t) AS tax, strict_identifier(t, true) AS strict, person_name(c_name || '  X') AS person, link_priority(if(c_custkey % 3 = 0, '/kontakt', '/x')) AS priority FROM kelvane_numbers")


@query("""SELECT event_id, 'seen:' || user_id AS note, NULL AS amount FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, 'paid', value FROM events WHERE event_type = 'purchase' AND event_id % 2 = 0""")
def adapter_results(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks through the adapters that are registered for their source and kind; others are left alone."""
    tasks = table(spark, folder, "events").select("event_id", "user_id", "value", F.col("event_type").alias("source"), F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd").alias("task_type"))
    known = jobs.Adapters()
    for kind in ("even", "odd"):
        known.register("view", kind, lambda t: t.select("event_id", F.concat(F.lit("seen:"), F.col("user_id").cast("string")).alias("note")))
    known.register("purchase", "even", lambda t: t.select("event_id", F.lit("paid").alias("note"), F.col("value").alias("amount")))
    return known.run(tasks).select("event_id", "note", "amount")


@query("""SELECT '' || c_custkey AS company_id, c_name AS company_name, CASE WHEN c_custkey % 3 > 0 THEN 'a "b", ' || c_custkey END AS note FROM customer""")
def delimited_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Customers written as CSV with a byte-order mark and read again by other names of the header, all as text."""
    path = shared_folder(spark, "csv")
    k = F.col("c_custkey")
    rows = table(spark, folder, "customer").select(F.col("c_name").alias("Company Name"), k.alias("ID podjetja"), F.when(k % 3 > 0, F.concat(F.lit('a "b", '), k.cast("string"))).alias("Opomba"))
    blank = rows.limit(3).select(*[F.lit("  ").alias(c) for c in rows.columns])
    files.export_csv(rows.select(*[F.col(f"`{c}`").cast("string") for c in rows.columns]).unionByName(blank), path)
    return files.read_delimited(spark, path, {"company_name": ["naziv", "company name", "\ufeffcompany name"], "company_id": ["idpodjetja"], "note": ["opomba"]})


@query("""WITH r AS (SELECT user_id % 40 AS report, user_id AS id, event_id FROM events), g AS (SELECT report, count(*) AS n, count(DISTINCT id) AS d FROM r WHERE event_id % 20 = 0 GROUP BY report)
SELECT 'r' || report AS name, n AS companies, CASE WHEN report % 4 = 0 THEN 'circuit-breaker' WHEN report % 3 = 0 THEN 'complete' WHEN report % 2 = 0 THEN 'interrupted' ELSE 'incomplete' END AS state, n = d AS valid FROM g""")
def report_files(spark: SparkSession, folder: str) -> DataFrame:
    """Reports written as JSON files and read again with their states and validity."""
    path = shared_folder(spark, "reports")
    r = F.col("user_id") % 40
    rows = table(spark, folder, "events").filter("event_id % 20 = 0").groupBy(r.alias("r")).agg(
        F.collect_set("user_id").alias("selected_ids"), F.collect_list(F.struct(F.col("user_id").alias("company_id"), F.lit("FOUND").alias("status"))).alias("companies")
    )
    r = F.col("r")
    made = rows.select("selected_ids", "companies", (r % 3 == 0).alias("complete"), (r % 2 == 0).alias("interrupted"), F.struct((r % 4 == 0).alias("triggered")).alias("circuit_breaker"), F.concat(F.lit("r"), r.cast("string")).alias("rule_version"), F.concat(F.lit("p"), r.cast("string")).alias("p"))
    made.repartition(40, "p").write.partitionBy("p").json(path)
    found = files.read_reports(spark, path)
    return found.select(F.col("rule_version").alias("name"), F.size("companies").cast("long").alias("companies"), "state", "valid")
