from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kelvane.operators import ingest, results, runs

RECORDS = [
    ("reg", "e1", "ALFA d.o.o.", "765 4321", "SI12345678", "Glavna 1", None, '{"a":1}', 1, [("legal_form", "d.o.o.", None, None), ("capital", None, 7.5, 2024)], [("Oseba Ena", "A@b.si ", None, [("DIRECTOR", "direktor", "1", "2020-01-01", None)])], [("Oseba Ena", "NATURAL_PERSON", "s1", 50.0, None, None)]),
    ("web", "e2", None, "7654321", None, None, None, '{"b":2}', 2, [("legal_form", "d. o. o.", None, None)], [], []),
    ("web", "e3", "Gama", "7654321", "99999999", None, None, '{"c":3}', 3, [("legal_form", "x", None, None)], [], []),
    ("web", "e4", "Brez", None, None, None, None, '{"d":4}', 4, [], [], []),
]


def test_ingest_twice_is_once(spark):
    empty = {k: spark.createDataFrame([], v) for k, v in ingest.TABLES.items()}
    keep = lambda df: df.cache()
    first = ingest.ingest(spark.createDataFrame(RECORDS[:2], ingest.RECORD), empty, keep)
    snapshot = {k: spark.createDataFrame(df.collect(), df.schema) for k, df in first.items()}
    assert {k: df.count() for k, df in snapshot.items()} == {"companies": 1, "source_records": 2, "observations": 3, "people": 1, "roles": 1, "ownership": 1, "conflicts": 0, "current_facts": 2}
    company = snapshot["companies"].first()
    assert (company.canonical_name, company.registration_number, company.tax_number) == ("ALFA d.o.o.", "7654321", "12345678")
    assert {r.fact_key: (r.value_text, r.value_number) for r in snapshot["current_facts"].collect()} == {"legal_form": ("d. o. o.", None), "capital": (None, 7.5)}
    again = ingest.ingest(spark.createDataFrame(RECORDS[:2], ingest.RECORD), {k: snapshot[k] for k in ingest.TABLES}, keep)
    for k in ingest.TABLES:
        assert sorted(map(str, again[k].collect())) == sorted(map(str, snapshot[k].collect())), k


def test_ingest_conflicts_and_unidentified(spark):
    tables = {k: spark.createDataFrame([], v) for k, v in ingest.TABLES.items()}
    tables["companies"] = spark.createDataFrame([("c1", "ALFA", "7654321", None, None), ("c2", "GAMA", None, "99999999", "here")], ingest.TABLES["companies"])
    out = ingest.ingest(spark.createDataFrame(RECORDS, ingest.RECORD), tables)
    assert out["conflicts"].first().entity_b == "c2" and out["companies"].count() == 2
    assert {r.company_id: r.tax_number for r in out["companies"].collect()} == {"c1": "12345678", "c2": "99999999"}
    assert out["source_records"].count() == 2


def test_runs(spark):
    companies = spark.createDataFrame([(7, "ALFA", 1), (3, "Beta v stečaju", 2), (5, None, 3)], "id int, name string, position int")
    run = runs.start(companies, "id", "name", "position").cache()
    assert {r.id: r.status for r in run.collect()} == {7: "PENDING", 3: "INELIGIBLE", 5: "PENDING"}
    expected = runs.manifest_hash(run.repartition(3), "position").first().asDict()
    runs.check(run, "position", expected)
    with pytest.raises(ValueError):
        runs.check(run.filter("id <> 5"), "position", expected)
    with pytest.raises(ValueError):
        runs.check(run.withColumn("identity_json", F.lit("{}")), "position", expected)
    attempts = spark.createDataFrame([(7, 1, "RUNNING"), (7, 2, "COMPLETED"), (5, 1, "RUNNING")], "id int, attempt_number int, status string")
    assert [(r.id, r.attempt_number) for r in runs.remaining(run, runs.interrupted(attempts), "id").collect()] == [(5, 2)]


def test_publish_validation(spark):
    contacts = spark.createDataFrame([(1, "EMAIL", "a@b.si", ["o1"], "o1"), (1, "EMAIL", "c@b.si", ["o1"], "o1"), (1, "PHONE", "123", ["o3"], "o9")], "attempt int, kind string, normalized_value string, supporting array<string>, primary_observation_id string")
    seen = spark.createDataFrame([(1, "o1", "EMAIL_CANDIDATE", "a@b.si"), (1, "o3", "PHONE_CANDIDATE", "123")], "attempt int, observation_id string, observation_type string, normalized_value string")
    assert {r.normalized_value for r in runs.invalid_contacts(contacts, seen, ["attempt"]).collect()} == {"c@b.si", "123"}


def test_deadline_and_ledger(spark):
    with runs.deadline(spark, 30):
        assert spark.range(10).count() == 10

    def fail():
        raise RuntimeError("x")

    assert runs.ledger("t", "s", fail, spark).first().status == "FAILED" and runs.ledger("t", "s", lambda: {"processed": 3}, spark).first().processed_items == 3


def test_result_rows(spark):
    html = '<ul><li class="newsearchIcon x"><h3><a href="/p?CompanyId=12">ALFA  d.o.o.</a></h3><div class="address">Glavna 1, 1000 Ljubljana</div><span class="registrationNumber">Matična: 7654321</span><span class="taxNumber">Davčna: SI1</span></li><li class="newsearchIcon"><h3></h3></li></ul>'
    pages = spark.createDataFrame([(1, html), (2, html), (3, "<ul></ul>")], "id int, html string")
    got = results.company_rows(pages, "id", "html", "https://r.example.com/x").cache()
    assert got.count() == 2
    row = got.filter("id = 1").first()
    assert (row.company_name, row.registration_number, row.tax_number, row.external_id, row.detail_url, row.municipality) == ("ALFA d.o.o.", "7654321", "SI1", "12", "https://r.example.com/p?CompanyId=12", "1000 Ljubljana")
    assert {r.id: r.first_page for r in results.distinct_pages(got, "id", F.col("external_id")).collect()} == {1: 1, 2: 1}


def test_problems_and_triage(spark):
    df = spark.createDataFrame([("https://x/authenticate", ""), ("https://x/errorpage.aspx", ""), ("https://x/", "Too many requests"), ("https://x/", "ok")], "u string, b string")
    assert [r[0] for r in df.select(results.page_problem(F.col("u"), F.col("b"))).collect()] == ["LOGIN", "ERROR_PAGE", "RATE_LIMITED", None]
    found = spark.createDataFrame([("ERROR", "Connection reset by peer"), ("ERROR", "bad page"), ("REVIEW", None)], "s string, m string")
    assert tuple(results.triage(found, "s", "m").first()) == (1, 1) and results.filled_counts(found, "m").first().m == 2
