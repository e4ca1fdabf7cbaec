from __future__ import annotations

import random

from pyspark.sql import functions as F

from kelvane.operators import contacts, domains, extract, html, identity, jobs, keywords, merge, ownership, registry
from kelvane.operators import relational as rel


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_latest_and_coverage(spark):
    companies = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    history = spark.createDataFrame([(1, 1, "ERROR"), (2, 1, "VERIFIED"), (3, 2, "REVIEW"), (4, 9, "ERROR")], "row long, company_id long, status string")
    joined = rel.latest_join(companies, history, "id", "company_id", "row")
    assert rows(joined.select("id", "status")) == [(1, "VERIFIED"), (2, "REVIEW"), (3, None)]
    one = joined.agg(F.count("*").alias("t"), F.count("status").alias("p")).select("p", *rel.coverage(F.col("t"), F.col("p"))).first()
    assert tuple(one) == (2, 1, 66.7)
    counts = rel.status_counts(joined.filter("status is not null"), "status", ("VERIFIED", "ERROR")).first()
    assert tuple(counts) == (1, 0, 1)
    assert tuple(spark.range(0).agg(F.count("*").alias("t")).select(*rel.coverage(F.col("t"), F.col("t"))).first()) == (0, 0.0)


def test_failure_runs_and_trip(spark):
    df = spark.createDataFrame([(i, "a", s) for i, s in enumerate("ffosfffof")], "i int, k string, s string")
    assert [r.run_length for r in rel.failure_runs(df, "k", F.col("s") == "f", "i").orderBy("i").collect()] == [1, 2, 0, 0, 1, 2, 3, 0, 1]
    kept = rel.before_trip(df, "k", F.col("s") == "f", 3, "i").orderBy("i").collect()
    assert [(r.i, r.interrupted) for r in kept][-1] == (6, True) and len(kept) == 7


def test_reserved_slots(spark):
    df = spark.createDataFrame([(1, "h1", False), (2, "h2", True), (3, "h2", True), (4, "h3", True), (5, "h4", True)], "i int, host string, brand boolean").withColumn("k", F.lit(0))
    assert [r.i for r in rel.reserved_then_rest(df, "k", F.col("brand"), "host", 2, "i").orderBy("slot").collect()] == [2, 4, 1, 3, 5]


def test_merges_are_idempotent_and_order_free(spark):
    schema = "k int, a string, b int"
    old = spark.createDataFrame([(1, "x", None), (2, "", 5), (None, "n", 1)], schema)
    new = spark.createDataFrame([(1, None, 7), (2, "y", 6), (3, "z", 8), (None, "m", None)], schema)
    once = merge.coalescing_upsert(old, new, ["k"])
    assert rows(once) == [(None, "m", 1), (1, "x", 7), (2, "y", 6), (3, "z", 8)]
    assert rows(merge.coalescing_upsert(once, new, ["k"])) == rows(once)
    filled = merge.fill_blanks(old, new, ["k"])
    assert {r.k: (r.a, r.b, r.conflicts) for r in filled.collect()} == {1: ("x", 7, []), 2: ("y", 5, ["b"]), 3: ("z", 8, []), None: ("n", 1, ["a"])}
    counted = merge.overwrite_upsert(old, new, ["k"], counters=["b"])
    assert rows(counted) == [(None, "m", 1), (1, None, 7), (2, "y", 11), (3, "z", 8)]
    assert rows(merge.insert_new(old.filter("k is not null"), new.filter("k is not null"), ["k"])) == [(1, "x", None), (2, "", 5), (3, "z", 8)]
    assert {r.k: r.action for r in merge.changes(old.filter("k is not null"), once.filter("k is not null"), ["k"]).collect()} == {1: "UPDATE", 2: "UPDATE", 3: "INSERT"}


def test_current_facts_last_ingested(spark):
    facts = [("c", "f", None, "old", 1), ("c", "f", None, "new", 2), ("c", "f", 2020, "y", 3), ("c", "f", None, "old", 4)]
    random.Random(1).shuffle(facts)
    df = spark.createDataFrame(facts, "company_id string, fact_key string, value_year int, v string, seq long").repartition(3)
    assert rows(merge.current_facts(df).select("value_year", "v", "seq")) == [(None, "old", 4), (2020, "y", 3)]


def test_active_task_dedup(spark):
    schema = "id int, company int, person int, status string"
    tasks = spark.createDataFrame([(1, 5, None, "DONE"), (2, 6, None, "PENDING")], schema)
    new = spark.createDataFrame([(3, 5, None, "PENDING"), (4, 6, None, "PENDING"), (5, 5, None, "PENDING")], schema)
    out, held = merge.insert_active(tasks, new, ["company", "person"], F.col("status").isin("PENDING", "RUNNING"), "id")
    assert [r.id for r in out.orderBy("id").collect()] == [1, 2, 3] and [r.id for r in held.orderBy("id").collect()] == [4, 5]


def test_identity(spark):
    known = spark.createDataFrame([(1, "11", "21"), (2, "12", "22"), (3, None, "23")], "e int, reg string, tax string")
    batch = spark.createDataFrame([("a", "11", "21"), ("b", "11", "22"), ("c", "99", None), ("d", None, None), ("e", None, "23")], "k string, reg string, tax string")
    got = identity.resolve(batch, known, "k", "e", {"reg": F.col("reg"), "tax": F.col("tax")})
    assert {r.k: (r.e, r.outcome) for r in got.collect()} == {"a": (1, "RESOLVED"), "b": (None, "CONFLICT"), "c": (None, "NEW"), "d": (None, "NO_IDENTIFIER"), "e": (3, "RESOLVED")}
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    two = identity.resolve_two(batch, known, "e", "reg", "tax")
    assert {r.k: (r.e, r.conflict) for r in two.collect()}["b"] == (None, True)
    assert identity.conflict_journal(two, "reg", "tax").count() == 1


def test_people_need_a_single_email(spark):
    people = spark.createDataFrame([(1, "l1", "x"), (2, None, "y"), (3, None, "y"), (4, None, "z")], "person_id int, linkedin_url string, email string")
    batch = spark.createDataFrame([("a", "l1", "q"), ("b", None, "y"), ("c", None, "z")], "k string, linkedin_url string, email string")
    assert {r.k: r.person_id for r in identity.resolve_people(batch, people).collect()} == {"a": 1, "b": None, "c": 4}


def test_policies(spark):
    pages = spark.createDataFrame([("https://sub.bizi.si/x",), ("https://mascus.co.uk",), ("https://veto.si/",), ("https://notbizi.si",), ("https://10.0.0.1/",)], "url string")
    got = {r.url: (r.classification, r.policy) for r in domains.with_policy(pages, "url", domains.registry(spark)).collect()}
    assert got["https://sub.bizi.si/x"][0] == "COMPANY_DATABASE" and got["https://mascus.co.uk"][0] == "MARKETPLACE" and got["https://veto.si/"][1] == "GROUP_REVIEW"
    assert got["https://notbizi.si"] == (None, None) and got["https://10.0.0.1/"][1] == "BLOCK_AS_OFFICIAL"


def test_family(spark):
    df = spark.createDataFrame([("Smo DRUŽINSKO podjetje",), ("second generation",), ("our family, founded by",), (None,)], "t string")
    got = [(r.score, r.family_status) for r in keywords.with_family(df, "t").collect()]
    assert got == [(100, "EXPLICIT"), (70, "LIKELY"), (80, "LIKELY"), (0, "UNKNOWN")]


def test_observations(spark):
    body = "Tel: +386 1 234 5678, matična številka: 1234567, SKD 2025: 62.010, piši na info@alfa.si ali www.alfa.si."
    df = spark.createDataFrame([(1, body)], "id int, t string")
    got = {(r.kind, r.value) for r in extract.observations(df, "id", "t").collect()}
    assert {("PHONE_CANDIDATE", "+38612345678"), ("EMAIL_CANDIDATE", "info@alfa.si"), ("REGISTRATION_NUMBER", "1234567"), ("REGISTERED_ACTIVITY", "62.010"), ("WEBSITE_CANDIDATE", "https://www.alfa.si/")} <= got


def test_identifiers_are_no_phones(spark):
    found = spark.createDataFrame([(1, "PHONE_CANDIDATE", "x", "12345678"), (1, "PHONE_CANDIDATE", "y", "+38612345678")], "id int, kind string, raw string, value string")
    known = spark.createDataFrame([(1, "TAX_NUMBER", "SI12345678")], "id int, kind string, value string")
    assert {r.raw: r.kind for r in extract.exclude_identifiers(found, known, "id").collect()} == {"x": "PHONE_EXCLUSION", "y": "PHONE_CANDIDATE"}


PAGE = """<html lang="sl"><head><title>ALFA d.o.o.</title><script type="application/ld+json">{"@graph": [{"@type": "WebSite", "url": "https://alfa.si/", "publisher": {"name": "ALFA d.o.o."}}, {"@type": ["Store"], "legalName": "ALFA d.o.o."}]}</script></head>
<body><p hidden>skrito</p><div style="display: none">tudi</div><section><h2>ALFA d.o.o.</h2><a href="mailto:info@alfa.si">info@alfa.si</a></section><a href="/kontakt">Kontakt</a><a href="https://netflix.com/en/">x</a></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, "https://alfa.si/", PAGE), (2, "https://b.si", None)], "page_id int, url string, html string")
    seen = {r.page_id: r.v for r in pages.select("page_id", html.visible(F.col("html")).alias("v")).collect()}
    assert "skrito" not in seen[1] and "tudi" not in seen[1] and "ALFA d.o.o." in seen[1] and seen[2] == ""
    assert {(r.kind, r.name) for r in html.json_ld(pages, "page_id", "html").collect()} == {("ORGANIZATION", "ALFA d.o.o."), ("PUBLISHER", "ALFA d.o.o.")}
    block = html.blocks(pages, "page_id", "html").first()
    assert block.headings == ["ALFA d.o.o."] and block.visible_email == "info@alfa.si"
    links = extract.internal_links(pages).collect()
    assert [(r.link, r.priority) for r in links] == [("https://alfa.si/kontakt", 0)]
    assert pages.filter("page_id = 1").select(*extract.social_links(F.col("html"))).first().twitter is True
    assert pages.filter("page_id = 1").select(*extract.social_links(F.col("html"), exact=True)).first().twitter is False
    assert pages.filter("page_id = 1").select(extract.languages(F.col("html")).alias("l")).first().l == ["en", "sl"]


OWN = "company_id int, company_name string, candidate_url string, page_url string, page_title string, page_no int, signals array<string>, page_type string, operator_match boolean, operator_scope string, group_context boolean, legal_conflict boolean, known_group boolean, assessment string"


def test_ownership(spark):
    page = lambda i, url, title, signals, kind="COMPANY_PAGE", operator=False, group=False, known=False, verdict=None: (i, "ALFA d.o.o.", url, url, title, 1, signals, kind, operator, "", group, False, known, verdict)
    full = ["tax_exact", "company_name_exact"]
    df = spark.createDataFrame([
        page(1, "https://alfa.si/", "ALFA d.o.o.", full), page(2, "https://imenik.si/alfa", "x", full, "THIRD_PARTY"), page(3, "https://alfa.si/", "ALFA", ["company_name_exact"]),
        page(4, "https://koncern.si/alfa", "Koncern", full, "GROUP"), page(5, "https://alfa.si/", "ALFA d.d.", full), page(6, "https://alfa.si/", "ALFA", full, verdict="UNCERTAIN"),
        page(7, "https://skupina.si/alfa/x", "Skupina", full, operator=True, group=True),
    ], OWN)
    got = {r.company_id: (r.status, r.relationship) for r in ownership.evaluate_ownership(df).collect()}
    assert got[1] == ("VERIFIED", "LEGAL_ENTITY") and got[2] == ("REVIEW", "THIRD_PARTY") and got[3] == ("REVIEW", "UNRESOLVED")
    assert got[4] == ("GROUP_REVIEW", "GROUP_PARENT") and got[5] == ("REVIEW", "UNRESOLVED") and got[6] == ("REVIEW", "UNRESOLVED") and got[7][0] == "VERIFIED"


def test_page_types_and_signals(spark):
    df = spark.createDataFrame([("https://x.si/business/a", None, "", ""), ("https://x.si/", None, "Company profile", ""), ("https://x.si/skupina/a", None, "", ""), ("https://x.si/", "GROUP_REVIEW", "", ""), ("https://x.si/", None, "", "")], "u string, p string, t string, b string")
    assert [r[0] for r in df.select(ownership.page_type(F.col("u"), F.col("p"), F.col("t"), F.col("b"))).collect()] == ["THIRD_PARTY", "PROFILE", "GROUP", "GROUP", "COMPANY_PAGE"]
    company = {k: F.lit(v) for k, v in {"company_name": "ALFA d.o.o.", "tax_number": "SI12345678", "registration_number": "7654321", "address": "Glavna ulica 12, Kranj", "municipality": "Kranj"}.items()}
    one = spark.range(1).select(ownership.page_signals(company, F.lit("https://alfa.si/"), F.lit("Alfa"), F.lit("ALFA, Glavna ulica 12, Kranj, ID SI12345678, 97654321"), F.array(F.lit("Alfa d.o.o."))).alias("s")).first()
    assert set(one.s) == {"tax_exact", "company_name_exact", "organization_name_exact", "street_address_exact", "postal_locality_exact", "domain_matches_company_name"}


def test_email_attribution(spark):
    schema = "company_name string, tax_number string, registration_number string, email string, visible_email string, source_url string, source_type string, publication string, status string, scope string, in_group_scope boolean, block_target boolean, block_other boolean, block_single_page boolean, page_named boolean"
    base = ("ALFA d.o.o.", None, None, "info@alfa.si", "", "https://alfa.si/k", "COMPANY_PAGE", "Kontakt ALFA", "VERIFIED", "https://alfa.si/", False, None, None, None, False)
    change = lambda **k: tuple(k.get(n, v) for n, v in zip([f.split()[0] for f in schema.split(", ")], base, strict=True))
    cases = [change(), change(visible_email="x@y.si"), change(status="REVIEW"), change(source_url="https://b.si/"), change(publication="ALFA, powered by X"), change(publication="pišite"), change(publication="pišite", page_named=True), change(block_other=True, block_target=False)]
    got = [r.attributable for r in ownership.email_attribution(spark.createDataFrame(cases, schema)).collect()]
    assert got == [True, False, False, False, False, False, True, False]


def test_contacts(spark):
    schema = "company_id int, company_name string, kind string, observation_id string, seq int, normalized_value string, source_kind string, on_scope boolean, page_bad boolean, visible_email string, display_conflict boolean, publication string, headings array<string>, block_target boolean, block_other boolean, block_single_page boolean, block_section boolean, block_explicit boolean, identity_match boolean, other_host boolean"
    o = lambda id_, value, text, target=True, kind="EMAIL", source="FETCHED_PAGE": (1, "ALFA d.o.o.", kind, id_, int(id_[1:]), value, source, True, False, "", False, text, [], target, False, False, False, False, False, True)
    df = spark.createDataFrame([o("o1", "ana.novak@alfa.si", "ALFA"), o("o2", "prodaja@alfa.si", "ALFA prodaja"), o("o3", "info@alfa.si", "ALFA"), o("o4", "info@alfa.si", "x", source="SEARCH_RESULT"), o("o5", "+38612345678", "ALFA centrala", kind="PHONE"), o("o6", "+4930123456", "ALFA", kind="PHONE")], schema)
    found = contacts.resolve(df)
    got = {r.normalized_value: (r.status, r.role, r.default_rank, r.supporting) for r in found.collect()}
    assert got["info@alfa.si"] == ("ATTRIBUTED", "GENERAL", 15, ["o3", "o4"]) and got["ana.novak@alfa.si"][1] == "PERSON" and got["+4930123456"][2] == 120 and got["+38612345678"][2] == -2
    assert {r.kind: r.normalized_value for r in contacts.defaults(found).collect()} == {"EMAIL": "info@alfa.si", "PHONE": "+38612345678"}


DETAIL = """<div id="accordianBody1"><div class="row"><span class="text-thin">Firma</span><b>ALFA d.o.o.</b></div><div class="row"><span class="text-thin">Matična številka</span><b>7654321 000</b></div>
<div class="row"><span class="text-thin">Status subjekta</span><b>vpisan</b></div><div class="row"><span class="text-thin">Osnovni kapital</span><b>ni vpisa</b></div></div>
<div id="accordianBody3"><div class="matchHeight"><div class="row"><span class="text-thin">Osebno ime</span><b>Oseba Ena</b></div><div class="row"><span class="text-thin">Vrsta zastopnika</span><b>direktor</b></div><div class="row"><span class="text-thin">Naslov</span><b>Doma 1</b></div><div class="row"><span class="text-thin">Datum podelitve pooblastila</span><b>1.2.2020</b></div></div></div>
<div id="accordianBody2"><div class="col-md-6"><h4>DRUŽBENIKI</h4><div style="page-break-inside: avoid"><div class="row"><span class="text-thin">Zap. št. družbenika</span><b>1</b></div><div class="row"><span class="text-thin">Osebno ime</span><b>Oseba Ena</b></div><div class="row"><span class="text-thin">Naslov</span><b>Doma 1</b></div></div></div>
<div class="col-md-6"><h4>POSLOVNI DELEŽI</h4><div style="page-break-inside: avoid"><div class="row"><span class="text-thin">Zap. št. deleža</span><b>7</b></div><div class="row"><span class="text-thin">Imetniki</span><b>Zap. št. družbenika 1</b></div><div class="row"><span class="text-thin">Delež v odstotku ali ulomku</span><b>50,5 %</b></div></div></div></div>"""
RESULTS = '<table><tr><th>Firma</th><th>Matična številka</th><th>Davčna številka</th></tr><tr><td><a href="podjetje.asp?e=5">ALFA</a></td><td>765 4321</td><td>SI 12345678</td></tr><tr><td>kratka</td></tr></table>'


def test_registry(spark):
    pages = spark.createDataFrame([(1, "https://r.example.com/podjetje.asp?e=42", DETAIL)], "id int, url string, html string")
    found = registry.details(pages, "id", "html").join(pages.select("id", "url"), "id").cache()
    company = registry.companies(found, "id", "url").first()
    assert (company.canonical_name, company.registration_number, company.external_id) == ("ALFA d.o.o.", "7654321000", "42")
    assert rows(registry.facts(found, "id")) == [(1, "registry_status", "vpisan")]
    person = registry.people(found, "id").first()
    assert (person.full_name, person.title, person.valid_from, person.raw_fields["Naslov"]) == ("Oseba Ena", "direktor", "2020-02-01", "[REDACTED]")
    share = registry.ownership(found, "id").first()
    assert (share.share_percent, share.owner_type, share.raw_fields["Naslov"]) == (50.5, "NATURAL_PERSON", "[REDACTED]")
    search = spark.createDataFrame([(1, RESULTS), (2, "Ni zadetkov"), (3, "PRIJAVA V SISTEM")], "id int, html string")
    got = registry.search_candidates(search, "id", "html", "https://r.example.com/").orderBy("id").collect()
    assert [(r.status, r.registration_number, r.detail_url) for r in got] == [("OK", "7654321", "https://r.example.com/podjetje.asp?e=5"), ("NO_RESULT", None, None), ("LOGIN_REQUIRED", None, None)]


def test_financials(spark):
    cells = spark.createDataFrame([(1, 0, "1.234,50", "Prihodki"), (1, 1, "-", "Čisti poslovni izid"), (1, 2, "7", "Zaposleni"), (2, 0, "x", "Prihodki"), (3, 0, "5", "?"), (4, 0, "1", "Prihodki"), (4, 1, "2", "Dobiček"), (4, 2, "3", "Zaposleni")], "id int, cell_no int, raw string, label string")
    got = {r.id: (r.revenue_2025, r.financial_status) for r in registry.financials(cells, "id").collect()}
    assert got == {1: (1234.5, "PARTIAL"), 2: (None, "PARSE_ERROR"), 3: (None, "PARSE_ERROR"), 4: (1.0, "OK")}


def test_queue(spark):
    schema = "id int, source string, priority int, created_at timestamp, status string, attempts int, max_attempts int, not_before timestamp"
    t = "2024-01-0{}".format
    from datetime import datetime

    at = lambda d: datetime.fromisoformat(t(d))
    tasks = spark.createDataFrame([(1, "a", 2, at(1), "PENDING", 0, 3, None), (2, "a", 1, at(2), "PENDING", 0, 3, None), (3, "b", 1, at(1), "PENDING", 3, 3, None), (4, "b", 1, at(1), "PENDING", 0, 3, at(9)), (5, "c", 1, at(1), "PENDING", 0, 3, None), (6, "d", 3, at(1), "PENDING", 0, 3, None)], schema)
    budgets = spark.createDataFrame([("a", 2, True), ("c", 5, False)], "source string, daily_limit int, enabled boolean")
    used = spark.createDataFrame([("a", 1)], "source string, used_count int")
    assert [r.id for r in jobs.claim(tasks, F.lit(at(5)), budgets, used, 10).collect()] == [2, 6]
    assert jobs.infrastructure_failure(F.lit("x")) is not None
    valid = spark.createDataFrame([([1, 2], [1]), ([1, 1], [1]), ([1], [2]), (None, [1])], "s array<int>, c array<int>")
    assert [r[0] for r in valid.select(jobs.report_valid(F.col("s"), F.col("c"))).collect()] == [True, False, False, False]


def test_adapters(spark):
    import pytest

    known = jobs.Adapters()
    known.register("a", "x", lambda df: df.withColumn("done", F.lit(True)))
    with pytest.raises(ValueError):
        known.register("a", "x", None)
    tasks = spark.createDataFrame([("a", "x"), ("b", "x")], "source string, task_type string")
    assert known.run(tasks).count() == 1


def test_insert_null_safe_moves_rows_once(spark):
    """One exchange for both sides; nulls in keys are equal, all target rows stay, and the first of new rows counts."""
    schema = "k string, y int, v string, seq long"
    target = spark.createDataFrame([("a", None, "old", 1), ("a", None, "old again", 2), (None, 1, "old", 3)], schema)
    source = spark.createDataFrame([("a", None, "x", 0), (None, 1, "x", 0), (None, None, "late", 9), (None, None, "first", 4), ("b", 1, "new", 5)], schema)
    out = merge.insert_null_safe(target, source, ["k", "y"], "seq")
    assert sorted((r.v for r in out.collect())) == ["first", "new", "old", "old", "old again"]
    assert out.columns == target.columns
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
