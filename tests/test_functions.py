from __future__ import annotations

import difflib
import unicodedata

import pytest
from pyspark.sql import functions as F

from kelvane.functions import emails, ids, names, numbers, phones, text, urls


def values(spark, column, rows, make):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {column} string")
    return [r[0] for r in df.orderBy("i").select(make(F.col(column))).collect()]


def test_identifiers(spark):
    assert values(spark, "x", ["SI 123-45", " 007 ", "abc", None], ids.tax_number) == ["12345", "007", None, None]
    assert values(spark, "x", ["SI12345678", "12a", " 1 2 ", None], lambda c: ids.strict_identifier(c, tax=True)) == ["12345678", None, "12", None]
    assert values(spark, "x", ["SI12345678"], ids.strict_identifier) == [None]
    assert values(spark, "x", ["https://L.com/in/a//", " "], ids.linkedin_url) == ["https://l.com/in/a", None]


def test_least_keeps_null(spark):
    df = spark.createDataFrame([(None,), (80,), (10,)], "c int")
    assert [r[0] for r in df.select(ids.at_most(F.col("c"), 60)).collect()] == [None, 60, 10]
    assert [r[0] for r in df.select(ids.clamp_confidence(F.col("c") * 2)).collect()] == [None, 100, 20]


SAMPLES = ["ŠPICA d.o.o.", "Élan  Ž", "ﬁ Ⅳ", "straße", "a_b", "", "Æ ł đ", "１２"]


def test_fold_exact_is_full_decomposition(spark):
    def model(v):
        bare = "".join(c for c in unicodedata.normalize("NFKD", v.lower()) if not unicodedata.combining(c))
        return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in bare).split())

    assert values(spark, "x", SAMPLES, text.fold_exact) == [model(s) for s in SAMPLES]
    latin = ["ŠPICA d.o.o.", "Élan  Ž", "çà et là", "Ñandú ü"]
    assert values(spark, "x", latin, text.fold) == [model(s) for s in latin]


@pytest.mark.parametrize(("make", "want"), [
    (text.core_name, ["alfa", "beta trgovina", "gama gmb", ""]),
    (text.name_without_forms, ["alfa ljubljana", "beta trgovina", "gama gmb", ""]),
    (text.base_name, ["ALFA", "Beta, trgovina", "Gama gmb", ""]),
    (text.match_name, ["alfa ljubljana", "beta trgovina s p", "gama gmb", ""]),
    (text.domain_label, ["alfa", "betatrgovina", "gamagmb", ""]),
])
def test_company_names_differ_by_flow(spark, make, want):
    assert values(spark, "x", ["ALFA d.o.o. Ljubljana", "Beta, trgovina, s.p.", "Gama gmb", None], make) == want


def test_legal_conflict(spark):
    df = spark.createDataFrame([("ALFA d.o.o.", "Alfa d.d. Kranj"), ("ALFA d.o.o.", "Beta d.d."), ("ALFA d.o.o.", "Alfa d. o. o."), ("ALFA", "Alfa d.d.")], "n string, v string")
    assert [r[0] for r in df.select(text.legal_conflict(F.col("v"), F.col("n"))).collect()] == [True, False, False, False]


def test_eligibility(spark):
    assert [r["status"] for r in values(spark, "x", ["Alfa d.o.o. - V STEČAJU", "Vstečaju", None], text.eligibility)] == ["INELIGIBLE", "ELIGIBLE", "ELIGIBLE"]


def test_numbers(spark):
    assert values(spark, "x", ["1.234,50", "1234.5", "-", None, "1 000"], numbers.european_number) == [1234.5, 12345.0, None, None, 1000.0]
    assert values(spark, "x", ["3.4.2021", "31.02.2020", "2020-01-01"], numbers.european_date) == ["2021-04-03", "2020-02-31", None]
    assert values(spark, "x", ["12,5 %", "1/2", "7%"], numbers.percent) == [12.5, None, 7.0]
    assert values(spark, "x", ["12.0", " nan", "", "x"], numbers.cell_text) == ["12", None, None, "x"]
    assert values(spark, "x", ["Čisti prihodki", "Prihodki in dobiček", "Sredstva", "x"], numbers.financial_metric) == ["revenue", None, "assets", None]
    assert [tuple(r) for r in values(spark, "x", ["1000 Ljubljana", "Kranj"], numbers.postal_parts)] == [("1000", "Ljubljana"), ("", "")]


def test_urls(spark):
    assert values(spark, "x", ["https://www.A.si:443/x", "mailto:b@c.si?x=1", "a@d.si", "u@v@w.si", ""], urls.domain) == ["a.si", "c.si", "d.si", "w.si", ""]
    assert values(spark, "x", ["u@v@w.si", "http://www.k.si/x"], urls.match_domain) == ["v@w.si", "k.si"]
    bad = ["http://u:p@a.si/", "https://1.2.3.4/", "ftp://a.si", "https://a.si:81/", "https://a.local/", "localhost"]
    assert values(spark, "x", bad, urls.url) == [""] * len(bad)
    assert values(spark, "x", ["A.si", "http://a.si/x?q=1#f"], urls.url) == ["https://a.si/", "http://a.si/x?q=1"]


def test_scopes_resist_traversal(spark):
    rows = [("https://a.si/x/y", "https://a.si/x/", True), ("https://a.si/xy", "https://a.si/x", False), ("https://a.si/x/%252e%252e/z", "https://a.si/x", False), ("https://b.si/x", "https://a.si/", False), ("https://a.si/q", "https://a.si/", True)]
    df = spark.createDataFrame(rows, "u string, s string, want boolean")
    assert [r[0] for r in df.select(urls.in_scope(F.col("u"), F.col("s")) == F.col("want")).collect()] == [True] * len(rows)


def test_brand(spark):
    df = spark.createDataFrame([("https://alfa-beta.si/", True), ("https://beta-alfa.si", True), ("https://alfabetagama.si", False), ("https://shop.alfabeta.com", True)], "u string, want boolean")
    assert [r[0] for r in df.select(urls.brand_match(F.col("u"), F.lit("Alfa Beta d.o.o.")) == F.col("want")).collect()] == [True] * 4


def test_candidates(spark):
    assert values(spark, "x", ["Alfa d.o.o.", "Ab"], urls.candidate_urls) == [[f"https://{w}alfa{t}" for t in (".si", ".com", ".eu") for w in ("", "www.")], []]


def test_phones(spark):
    assert values(spark, "x", ["00386 1 234 5678", "041 234 567", "1234 5678", "+386 41 234567", None], phones.match_phone) == ["38612345678", "38641234567", "38612345678", "38641234567", ""]
    assert values(spark, "x", ["+386 (0)1 2345678", "01 2345678 int. 5", "123", "00 49 30 123456"], phones.observed_phone) == ["+38612345678", "012345678;ext=5", None, "+4930123456"]


def test_emails(spark):
    body = "Info%40x.si info@Alfa.si, INFO@alfa.si. logo@2x.png noreply@alfa.si a@example.com"
    assert values(spark, "x", [body, None], emails.extract_emails) == [["info@alfa.si", "info@x.si"], []]
    assert values(spark, "x", ["MAILTO:a@b.si,c@d.si?cc=e@f.si", "https://x"], emails.mailto_emails) == [["a@b.si", "c@d.si"], []]
    assert values(spark, "x", ["info@a.si", "prodaja2@a.si", "hrvoje@a.si", "ana.novak@a.si", "x1@a.si", "rezervni.deli@a.si"], emails.role) == ["GENERAL", "SALES", "UNKNOWN", "PERSON", "UNKNOWN", "SUPPORT"]


def test_similarity(spark):
    pairs = [("Alfa Beta d.o.o.", "Beta Alfa"), ("Alfa", "alfa d.d."), ("", "x"), ("Gama trgovina", "Gama storitve")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").orderBy("i")

    def model(a, b):
        if not a or not b:
            return 0.0
        if a == b:
            return 100.0
        x, y = set(a.split()), set(b.split())
        return round(55 * difflib.SequenceMatcher(None, a, b).ratio() + 45 * len(x & y) / len(x | y), 2)

    clean = [("alfa beta", "beta alfa"), ("alfa", "alfa"), ("", "x"), ("gama trgovina", "gama storitve")]
    assert [r[0] for r in df.select(names.name_similarity(F.col("a"), F.col("b"))).collect()] == pytest.approx([model(*c) for c in clean])


def test_score(spark):
    one = spark.range(1)
    got = lambda *a: one.select(names.candidate_score(*[F.lit(x) for x in a]).alias("s")).first().s
    assert (got(96.0, False, False, False, False).score, got(96.0, False, False, False, False).confidence) == (55.0, "LOW")
    assert got(60.0, False, False, True, False).reasons == ["email_domain_match", "name_weak:60"]
    assert (got(0.0, True, True, True, True).score, got(0.0, True, True, True, True).confidence) == (100.0, "HIGH")
    assert got(54.9, False, False, False, True).confidence == "LOW"


def test_sql_functions_agree(spark):
    from kelvane.functions import sql

    sql.register(spark)
    df = spark.createDataFrame([(v,) for v in ["SI 123", "si12345678", "a1", " 7 7 ", "1.234,5", "3.4.2021", "  Ana  NOVAK ", None]], "v string")
    df.createOrReplaceTempView("sql_function_values")
    got = spark.sql("SELECT registration_number(v) a, tax_number(v) b, strict_identifier(v, true) c, strict_identifier(v, false) d, person_name(v) e, european_number(v) f, european_date(v) g, link_priority(v) h FROM sql_function_values").collect()
    c = F.col("v")
    want = df.select(ids.digits(c), ids.tax_number(c), ids.strict_identifier(c, tax=True), ids.strict_identifier(c), ids.person_name(c), numbers.european_number(c), numbers.european_date(c), urls.link_priority(c)).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    assert spark.sql("SELECT at_most(NULL, 60) IS NULL AND at_most(80, 60) = 60").first()[0]
