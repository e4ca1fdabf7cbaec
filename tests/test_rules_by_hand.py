"""Rules on rows made by hand: each case names the rows that the rules give."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from kelvane.operators import contacts, extract, html, ingest, ownership, registry, results

CASES = {}


def case(sql):
    def add(f):
        CASES[f.__name__] = (f, sql)
        return f

    return add


@case("""SELECT * FROM (VALUES ('companies', 3), ('source_records', 4), ('observations', 4), ('people', 2), ('roles', 2), ('ownership', 1), ('conflicts', 1), ('current_facts', 3)) t(name, n)""")
def nested_ingest(spark):
    """Five records, one of them twice and one that names two companies; the second ingest of the batch changes nothing."""
    people = [("Ana  Novak", "ANA@a.si", None, [("director", "D", "r1", None, None)]), ("Bo Kos", None, "https://l.example/bo/", [("owner", None, "r2", None, None)])]
    one = ("reg", "1", "Alfa", "111", "SI 11", "Cesta 1", "d", "{1}", 1, [("status", "ok", None, None), ("size", None, 5.0, 2020)], people, [("Ana", "NATURAL_PERSON", "s1", 50.0, None, None)])
    rows = [one, (*one[:8], 2, *one[9:]), ("web", "2", "Beta", "222", None, None, "d", "{2}", 3, [("status", "new", None, None)], [], []), ("web", "3", None, None, "33", None, "d", "{3}", 4, [], [], []), ("web", "4", "?", "111", "33", None, "d", "{4}", 5, [], [], []), ("web", "5", "Beta", "222", None, "Pot 2", "d", "{5}", 6, [("status", "old", None, None)], [], [])]
    records = spark.createDataFrame(rows, ingest.RECORD)
    tables = {k: spark.createDataFrame([], v) for k, v in ingest.TABLES.items()}
    found = ingest.ingest(records.filter("external_id <> '4'"), tables)
    found = ingest.ingest(records, {k: found[k] for k in ingest.TABLES})
    out = None
    for name, df in found.items():
        part = df.agg(F.lit(name).alias("name"), F.count("*").cast("int").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


# Attribution


_PAGES = "company_id int, company_name string, candidate_url string, page_url string, page_title string, page_no int, signals array<string>, page_type string, operator_match boolean, operator_scope string, group_context boolean, legal_conflict boolean, known_group boolean, assessment string"


@case("""SELECT * FROM (VALUES (1, 'VERIFIED', 'LEGAL_ENTITY', 'https://alfa.si/'), (2, 'REVIEW', 'THIRD_PARTY', ''), (3, 'REVIEW', 'UNRESOLVED', ''), (4, 'GROUP_REVIEW', 'GROUP_PARENT', ''), (5, 'REVIEW', 'UNRESOLVED', ''), (6, 'REVIEW', 'UNRESOLVED', ''),
(7, 'VERIFIED', 'LEGAL_ENTITY', 'https://skupina.si/alfa/x/'), (8, 'REVIEW', 'THIRD_PARTY', ''), (9, 'GROUP_REVIEW', 'GROUP_PARENT', ''), (10, 'VERIFIED', 'LEGAL_ENTITY', 'https://alfa.si/')) t(company_id, status, relationship, scope)""")
def ownership_verdicts(spark):
    """One company in ten settings: its own site, a listing, a name alone, a group, another legal form, stored verdicts, an operator inside a group, a parked domain, a known group, evidence over two pages."""
    page = lambda i, url, title, signals, kind="COMPANY_PAGE", operator=False, group=False, known=False, verdict=None, no=1: (i, "ALFA d.o.o.", url, url, title, no, signals, kind, operator, "", group, False, known, verdict)
    full = ["tax_exact", "company_name_exact"]
    rows = [
        page(1, "https://alfa.si/", "ALFA d.o.o.", full), page(2, "https://imenik.si/alfa", "x", full, "THIRD_PARTY"), page(3, "https://alfa.si/", "ALFA", ["company_name_exact"]), page(4, "https://koncern.si/alfa", "Koncern", full, "GROUP"),
        page(5, "https://alfa.si/", "ALFA d.d.", full), page(6, "https://alfa.si/", "ALFA", full, verdict="UNCERTAIN"), page(7, "https://skupina.si/alfa/x", "Skupina", full, operator=True, group=True),
        page(8, "https://alfa.si/", "ALFA", [*full, "parked_domain"]), page(9, "https://alfa.si/", "ALFA", full, known=True), page(10, "https://alfa.si/", "ALFA", []), page(10, "https://alfa.si/kontakt", "Kontakt", full, no=2),
    ]
    return ownership.evaluate_ownership(spark.createDataFrame(rows, _PAGES)).select("company_id", "status", "relationship", "scope")


_MAILS = "n int, company_name string, tax_number string, registration_number string, email string, visible_email string, source_url string, source_type string, publication string, status string, scope string, in_group_scope boolean, block_target boolean, block_other boolean, block_single_page boolean, page_named boolean"


@case("""SELECT * FROM (VALUES (1, true, 'Entity context on verified scope'), (2, false, 'Displayed e-mail and link target disagree'), (3, false, 'Site ownership unresolved'), (4, false, 'Outside the verified scope'), (5, false, 'Agency context'), (6, false, 'Insufficient entity context'),
(7, true, 'Entity context on verified scope'), (8, false, 'Contact block of another entity'), (9, false, 'Listing source'), (10, false, 'Outside the group''s site'), (11, true, 'Explicit entity block'), (12, false, 'No explicit entity'), (13, false, 'Different legal entity'), (14, false, 'Site ownership unresolved')) t(n, attributable, reason)""")
def email_attributions(spark):
    """One address in fourteen settings, each of which meets one rule of the gate first."""
    names = [f.split()[0] for f in _MAILS.split(", ")]
    base = dict(zip(names, (0, "ALFA d.o.o.", None, None, "info@alfa.si", "", "https://alfa.si/k", "COMPANY_PAGE", "Kontakt ALFA", "VERIFIED", "https://alfa.si/", False, None, None, None, False), strict=True))
    cases = [
        {}, {"visible_email": "x@y.si"}, {"status": "REVIEW"}, {"source_url": "https://b.si/"}, {"publication": "ALFA, powered by X"}, {"publication": "pišite"}, {"publication": "pišite", "page_named": True}, {"block_other": True, "block_target": False},
        {"source_type": "THIRD_PARTY"}, {"status": "GROUP_REVIEW"}, {"status": "GROUP_REVIEW", "in_group_scope": True}, {"status": "GROUP_REVIEW", "in_group_scope": True, "publication": "x"}, {"publication": "ALFA d.d.", "block_target": True}, {"status": None},
    ]
    rows = [tuple((base | c | {"n": i + 1})[k] for k in names) for i, c in enumerate(cases)]
    return ownership.email_attribution(spark.createDataFrame(rows, _MAILS)).select("n", "attributable", "reason")


_SEEN = "company_id int, company_name string, kind string, observation_id string, seq int, normalized_value string, source_kind string, on_scope boolean, page_bad boolean, visible_email string, display_conflict boolean, publication string, headings array<string>, block_target boolean, block_other boolean, block_single_page boolean, block_section boolean, block_explicit boolean, identity_match boolean, other_host boolean"


def _contacts(spark):
    o = lambda n, value, said, kind="EMAIL", source="FETCHED_PAGE", scope=True, bad=False, target=True, single=False: (1, "ALFA d.o.o.", kind, f"o{n}", n, value, source, scope, bad, "", False, said, [], target, False, single, False, False, True, True)
    rows = [
        o(1, "ana.novak@alfa.si", "ALFA"), o(2, "prodaja@alfa.si", "ALFA prodaja"), o(3, "info@alfa.si", "ALFA"), o(4, "info@alfa.si", "x", source="SEARCH_RESULT"), o(5, "+38612345678", "ALFA centrala", "PHONE"), o(6, "+4930123456", "ALFA", "PHONE"),
        o(7, "a@alfa.si", "ALFA", scope=False), o(8, "b@alfa.si", "ALFA", bad=True), o(9, "c@alfa.si", "x", source="SEARCH_RESULT"), o(10, "d@alfa.si", "ALFA", target=False), o(11, "e@alfa.si", "ALFA", target=False, single=True), o(12, "e@alfa.si", "x", source="SEARCH_RESULT"),
    ]
    return contacts.resolve(spark.createDataFrame(rows, _SEEN))


@case("""SELECT * FROM (VALUES ('ana.novak@alfa.si', 'ATTRIBUTED', 'PERSON', 40, 'o1'), ('prodaja@alfa.si', 'ATTRIBUTED', 'SALES', 20, 'o2'), ('info@alfa.si', 'ATTRIBUTED', 'GENERAL', 15, 'o3;o4'), ('+38612345678', 'ATTRIBUTED', 'UNKNOWN', -2, 'o5'), ('+4930123456', 'ATTRIBUTED', 'UNKNOWN', 120, 'o6'),
('a@alfa.si', 'UNCERTAIN', 'UNKNOWN', 25, 'o7'), ('b@alfa.si', 'REJECTED', 'UNKNOWN', 25, 'o8'), ('c@alfa.si', 'CANDIDATE', 'UNKNOWN', 25, 'o9'), ('d@alfa.si', 'UNCERTAIN', 'UNKNOWN', 25, 'o10'), ('e@alfa.si', 'ATTRIBUTED', 'UNKNOWN', 25, 'o11;o12')) t(normalized_value, status, role, default_rank, supporting)""")
def resolved_contacts(spark):
    return _contacts(spark).select("normalized_value", "status", "role", "default_rank", F.array_join("supporting", ";").alias("supporting"))


@case("SELECT * FROM (VALUES ('EMAIL', 'info@alfa.si'), ('PHONE', '+38612345678')) t(kind, normalized_value)")
def default_contacts(spark):
    return contacts.defaults(_contacts(spark)).select("kind", "normalized_value")


# Texts and pages


@case("""SELECT * FROM (VALUES (1, 'EMAIL_CANDIDATE', 'info@alfa.si'), (1, 'PHONE_CANDIDATE', '+38612345678'), (1, 'REGISTERED_ACTIVITY', '62.010'), (1, 'REGISTRATION_NUMBER', '1234567'), (1, 'WEBSITE_CANDIDATE', 'https://www.alfa.si/'), (2, 'TAX_NUMBER', '12345678'), (2, 'PHONE_EXCLUSION', '12345678')) t(id, kind, value)""")
def labelled_observations(spark):
    """What two texts say, a number that is the company's own identifier being no phone."""
    rows = [(1, "Tel: +386 1 234 5678, matična številka: 1234567, SKD 2025: 62.010, piši na info@alfa.si ali www.alfa.si."), (2, "Davčna številka: SI 12345678. Telefon: 12345678"), (3, None)]
    found = extract.observations(spark.createDataFrame(rows, "id int, t string"), "id", "t")
    known = spark.createDataFrame([(2, "TAX_NUMBER", "SI12345678")], "id int, kind string, value string")
    return extract.exclude_identifiers(found, known, "id").select("id", "kind", "value").distinct()


_HTML = """<html lang="sl"><head><title>ALFA d.o.o.</title><script type="application/ld+json">{"@graph": [{"@type": "WebSite", "url": "https://alfa.si/", "publisher": {"name": "ALFA d.o.o."}}, {"@type": ["Store"], "legalName": "ALFA d.o.o."}]}</script></head>
<body><p hidden>skrito</p><section><h2>ALFA d.o.o.</h2><a href="mailto:info@alfa.si?subject=x">info@alfa.si</a></section><a href="/kontakt">Kontakt</a></body></html>"""


def _page(spark):
    return spark.createDataFrame([(1, _HTML), (2, None)], "id int, html string")


@case("SELECT * FROM (VALUES (1, 'ORGANIZATION', 'ALFA d.o.o.'), (1, 'PUBLISHER', 'ALFA d.o.o.')) t(id, kind, name)")
def json_ld_names(spark):
    return html.json_ld(_page(spark), "id", "html").select("id", "kind", "name")


@case("SELECT 1 AS id, 'ALFA d.o.o.' AS heading, 'info@alfa.si' AS visible_email")
def contact_blocks(spark):
    return html.blocks(_page(spark), "id", "html").select("id", F.element_at("headings", 1).alias("heading"), "visible_email")


@case("""SELECT * FROM (VALUES (1, 'COMPANY_PAGE', true, 'https://alfa.si/', false, false, true), (2, 'COMPANY_PAGE', true, '', false, false, false), (3, 'GROUP', false, '', true, false, false), (4, 'COMPANY_PAGE', false, '', true, true, true), (5, 'THIRD_PARTY', false, '', false, false, false), (6, 'COMPANY_PAGE', false, '', false, false, true)) t(page_id, page_type, operator_match, operator_scope, group_context, legal_conflict, site_brand_match)""")
def page_operators(spark):
    """A publisher in scope, a statement, a group's path, another legal form beside a group's words, a listing, and an organisation that is no publisher."""
    site = '<script type="application/ld+json">{"@type": "WebSite", "url": "%s", "publisher": {"name": "ALFA d.o.o."}}</script>'
    firm = '<script type="application/ld+json">{"@type": "Organization", "name": "ALFA d.o.o."}</script>'
    rows = [
        (1, "https://alfa.si/kontakt", "ALFA", "", site % "https://alfa.si/", None), (2, "https://splet.si/a", "x", "Upravljavec spletne strani: ALFA, d.o.o., Kranj", site % "https://drugje.si/", None), (3, "https://x.si/skupina/a", "x", "", None, None),
        (4, "https://alfa.si/", "ALFA d.d.", "Podjetja v skupini", "", None), (5, "https://y.si/", "x", "", "", "BLOCK_AS_OFFICIAL"), (6, "https://alfa.si/", "ALFA", "nekaj", firm, None),
    ]
    pages = spark.createDataFrame([(*r, "ALFA d.o.o.") for r in rows], "page_id int, page_url string, page_title string, visible string, html string, policy string, company_name string")
    return ownership.page_facts(pages).select("page_id", "page_type", "operator_match", "operator_scope", "group_context", "legal_conflict", "site_brand_match")


@case("""SELECT * FROM (VALUES (1, 'COMPANY_IDENTITY'), (1, 'BUSINESS_DESCRIPTION'), (2, 'BUSINESS_DESCRIPTION'), (3, 'COMPANY_IDENTITY'), (3, 'BUSINESS_DESCRIPTION'), (5, 'BUSINESS_DESCRIPTION')) t(id, kind)""")
def incidental_observations(spark):
    """The name, another text, a number, blanks, and a name inside an address only."""
    texts = ["O podjetju ALFA d.o.o.", "Izdelujemo okna", "ID za DDV: SI12345678", " \n ", "info@alfa.si"]
    df = spark.createDataFrame([(i, t, "ALFA d.o.o.", "SI12345678", None) for i, t in enumerate(texts, 1)], "id int, t string, n string, tax string, reg string")
    return extract.incidental(df, "id", "t", "n", "tax", "reg").select("id", "kind")


_DETAIL = """<div id="accordianBody1"><div class="row"><span class="text-thin">Firma</span><b>ALFA d.o.o.</b></div><div class="row"><span class="text-thin">Matična številka</span><b>7654321 000</b></div>
<div class="row"><span class="text-thin">Status subjekta</span><b>vpisan</b></div><div class="row"><span class="text-thin">Osnovni kapital</span><b>ni vpisa</b></div></div>
<div id="accordianBody3"><div class="matchHeight"><div class="row"><span class="text-thin">Osebno ime</span><b>Oseba Ena</b></div><div class="row"><span class="text-thin">Vrsta zastopnika</span><b>direktor</b></div><div class="row"><span class="text-thin">Naslov</span><b>Doma 1</b></div><div class="row"><span class="text-thin">Datum podelitve pooblastila</span><b>1.2.2020</b></div></div></div>
<div id="accordianBody2"><div class="col-md-6"><h4>DRUŽBENIKI</h4><div style="page-break-inside: avoid"><div class="row"><span class="text-thin">Zap. št. družbenika</span><b>1</b></div><div class="row"><span class="text-thin">Osebno ime</span><b>Oseba Ena</b></div><div class="row"><span class="text-thin">Naslov</span><b>Doma 1</b></div></div></div>
<div class="col-md-6"><h4>POSLOVNI DELEŽI</h4><div style="page-break-inside: avoid"><div class="row"><span class="text-thin">Zap. št. deleža</span><b>7</b></div><div class="row"><span class="text-thin">Imetniki</span><b>Zap. št. družbenika 1</b></div><div class="row"><span class="text-thin">Delež v odstotku ali ulomku</span><b>50,5 %</b></div></div></div></div>"""


@case("""SELECT * FROM (VALUES ('company', 'ALFA d.o.o.', '7654321000'), ('fact', 'registry_status', 'vpisan'), ('person', 'Oseba Ena', 'direktor 2020-02-01 [REDACTED]'), ('share', 'NATURAL_PERSON', '50.5 [REDACTED]')) t(what, name, value)""")
def registry_page(spark):
    """A detail page's company, facts, people and owners; addresses of people are not kept."""
    pages = spark.createDataFrame([(1, "https://r.example.com/podjetje.asp?e=42", _DETAIL)], "id int, url string, html string")
    found = registry.details(pages, "id", "html").join(pages.select("id", "url"), "id")
    out = registry.companies(found, "id", "url").select(F.lit("company").alias("what"), F.col("canonical_name").alias("name"), F.col("registration_number").alias("value"))
    out = out.unionAll(registry.facts(found, "id").select(F.lit("fact"), "fact_key", "value"))
    out = out.unionAll(registry.people(found, "id").select(F.lit("person"), "full_name", F.concat_ws(" ", "title", "valid_from", F.col("raw_fields")["Naslov"])))
    return out.unionAll(registry.ownership(found, "id").select(F.lit("share"), "owner_type", F.concat_ws(" ", F.col("share_percent").cast("string"), F.col("raw_fields")["Naslov"])))


@case("""SELECT * FROM (VALUES (1, 'OK', '7654321', 'https://r.example.com/podjetje.asp?e=5'), (2, 'NO_RESULT', NULL, NULL), (3, 'LOGIN_REQUIRED', NULL, NULL)) t(id, status, registration_number, detail_url)""")
def registry_search(spark):
    shown = '<table><tr><th>Firma</th><th>Matična številka</th><th>Davčna številka</th></tr><tr><td><a href="podjetje.asp?e=5">ALFA</a></td><td>765 4321</td><td>SI 12345678</td></tr><tr><td>kratka</td></tr></table>'
    pages = spark.createDataFrame([(1, shown), (2, "Ni zadetkov"), (3, "PRIJAVA V SISTEM")], "id int, html string")
    return registry.search_candidates(pages, "id", "html", "https://r.example.com/").select("id", "status", "registration_number", "detail_url")


@case("""SELECT * FROM (VALUES (1, 1234.5, 'PARTIAL'), (2, NULL, 'PARSE_ERROR'), (3, NULL, 'PARSE_ERROR'), (4, 1.0, 'OK')) t(id, revenue_2025, financial_status)""")
def financial_cells(spark):
    rows = [(1, 0, "1.234,50", "Prihodki"), (1, 1, "-", "Čisti poslovni izid"), (1, 2, "7", "Zaposleni"), (2, 0, "x", "Prihodki"), (3, 0, "5", "?"), (4, 0, "1", "Prihodki"), (4, 1, "2", "Dobiček"), (4, 2, "3", "Zaposleni")]
    return registry.financials(spark.createDataFrame(rows, "id int, cell_no int, raw string, label string"), "id").select("id", F.col("revenue_2025").cast("decimal(5,1)").alias("revenue_2025"), "financial_status")


@case("""SELECT * FROM (VALUES (1, 0, 'ALFA d.o.o.', '7654321', '12345678', '42', '4000 Kranj')) t(id, row_no, company_name, registration_number, tax_number, external_id, municipality)""")
def result_rows(spark):
    item = '<li class="x newsearchIcon"><h3>ALFA d.o.o.</h3><div class="address">Cesta 1, 4000 Kranj</div><span class="registrationNumber">Matična: 7654321</span><span class="taxNumber">Davčna: 12345678</span><a href="/d?CompanyId=42">več</a></li><li class="newsearchIcon"><h3> </h3></li>'
    pages = spark.createDataFrame([(1, f"<ul>{item}</ul>")], "id int, html string")
    return results.company_rows(pages, "id", "html", "https://r.example.com/").select("id", "row_no", "company_name", "registration_number", "tax_number", "external_id", "municipality")


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    made, sql = CASES[name]
    df, want = made(spark), duckdb.sql(sql)
    plain = lambda v: float(v) if hasattr(v, "as_tuple") else v
    rows = Counter(tuple(plain(v) for v in r) for r in df.collect())
    assert df.columns == want.columns
    assert rows == Counter(tuple(plain(v) for v in r) for r in want.fetchall())


def test_every_reason_is_met(spark):
    """The settings of the queries over given tables meet each rule of the gates at least once."""
    from kelvane.plans import QUERIES

    folder = "/root/testdata/sf0.01"
    seen = {r.reason for r in QUERIES["ownership_verdicts"].run(spark, folder).select("reason").distinct().collect()}
    assert len(seen) == 6
    seen = {r.reason for r in QUERIES["email_attributions"].run(spark, folder).select("reason").distinct().collect()}
    assert len(seen) == 12
    found = QUERIES["resolved_contacts"].run(spark, folder)
    assert {r.status for r in found.select("status").distinct().collect()} == {"ATTRIBUTED", "CANDIDATE", "UNCERTAIN", "REJECTED"}
