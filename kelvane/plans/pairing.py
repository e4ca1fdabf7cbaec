"""Candidate matching and export queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import emails, names
from ..operators import matching
from ..operators import relational as rel
from ..sources.tables import table
from ._registry import query


@query("""WITH p AS (SELECT p_partkey, p_brand, list_distinct(list_filter(string_split(p_name, ' '), lambda x: x <> '')) AS t FROM part),
j AS (SELECT a.p_partkey AS a, b.p_partkey AS b, round(CASE WHEN len(a.t) > 0 AND len(b.t) > 0 THEN len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) ELSE 0 END, 6) AS jaccard FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey)
SELECT a, b, jaccard, place FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY jaccard DESC, b) AS place FROM j) WHERE place <= 3""")
def name_jaccard_topk(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part").select("p_partkey", "p_brand", "p_name")
    # parts with equal names have the same neighbours but for themselves: names are paired, each with its first four parts
    held = rel.top_per_key(p, ["p_brand", "p_name"], 4, "p_partkey").select("p_brand", F.col("p_name").alias("y"), F.col("p_partkey").alias("b"))
    left, right = p.select("p_brand", F.col("p_name").alias("x")).distinct(), p.select("p_brand", F.col("p_name").alias("y")).distinct()
    pairs = matching.blocked_pairs(left, right, "p_brand").withColumn("jaccard", F.round(names.jaccard(F.col("x"), F.col("y")), 6))
    found = pairs.withColumnsRenamed({"p_brand": "brand", "y": "name"}).join(held, (F.col("brand") == F.col("p_brand")) & F.col("name").eqNullSafe(F.col("y")))
    near = rel.top_per_key(found, ["brand", "x"], 4, F.col("jaccard").desc(), "b").select("brand", "x", "b", "jaccard")
    others = p.withColumnRenamed("p_partkey", "a").join(near, (F.col("brand") == F.col("p_brand")) & F.col("x").eqNullSafe(F.col("p_name"))).filter("a <> b")
    best = rel.numbered(others, "a", "place", F.col("jaccard").desc(), "b").filter("place <= 3")
    return best.select("a", "b", "jaccard", F.col("place").cast("long").alias("place"))


_WORDS = "alfa beta gama delta epsilon zeta eta theta iota kapa lambda mi ni ksi omikron pi ro sigma tau"
_ASKING = {
    "input_id": "c_custkey",
    "in_name": f"""CASE c_custkey % 4 WHEN 0 THEN 'Supplier ' || c_custkey % 100 WHEN 1 THEN c_custkey % 100 || ', SUPPLIER d.o.o.' WHEN 2 THEN 'Supplier ' || c_custkey % 100 || ' {_WORDS}' ELSE '{_WORDS} Supplier ' || c_custkey % 100 || ' ipsilon' END""",
    "in_email": "'info@host' || c_custkey % 400 || '.example.com'", "in_phone": "CASE WHEN c_custkey % 3 = 0 THEN '0' || (41000000 + c_custkey % 600) ELSE '' END",
    "in_registration_number": "CASE WHEN c_custkey % 9 = 0 THEN '' || c_custkey % 100 ELSE '' END", "in_tax_number": "CASE WHEN c_custkey % 7 = 0 THEN ' T' || c_custkey % 300 END",
}
_OFFERED = {
    "cand_id": "s_suppkey", "cand_name": f"CASE WHEN s_suppkey % 4 < 2 THEN 'Supplier ' || s_suppkey ELSE 'Supplier ' || s_suppkey || ' {_WORDS}' END", "cand_domain": "CASE WHEN s_suppkey % 2 = 0 THEN 'https://www.host' || s_suppkey % 400 || '.example.com/x' END",
    "cand_email_domain": "CASE WHEN s_suppkey % 5 = 0 THEN 'x@host' || (s_suppkey + 1) % 400 || '.example.com' ELSE '' END", "cand_phone": "'+386 ' || (41000000 + s_suppkey % 600)", "cand_registration_number": "'' || s_suppkey", "cand_tax_number": "CASE WHEN s_suppkey % 2 = 1 THEN 'T' || s_suppkey END",
}


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    made = lambda name, columns: table(spark, folder, name).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])
    return made("customer", _ASKING), made("supplier", _OFFERED)


def _listed(name: str, columns: dict[str, str]) -> str:
    return "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {name})"


def _plain_name(c: str) -> str:
    return f"list_filter(string_split(trim(regexp_replace(regexp_replace(lower({c}), 'd\\.o\\.o\\.?', ' doo '), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w NOT IN ('doo', ''))"


_POINTS = rf"""a AS (SELECT *, {_plain_name('in_name')} AS x, split_part(in_email, '@', 2) AS d, right(in_phone, 8) AS t FROM {_listed('customer', _ASKING)}),
b AS (SELECT *, {_plain_name('cand_name')} AS y, regexp_extract(cand_domain, 'www\.([^/]+)', 1) AS d1, split_part(cand_email_domain, '@', 2) AS d2, right(cand_phone, 8) AS t FROM {_listed('supplier', _OFFERED)}),
j AS (SELECT input_id, cand_id, CASE WHEN x = y THEN 100.0 ELSE round(100 * (len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE), 2) END AS sim, CASE WHEN in_registration_number <> '' AND in_registration_number = cand_registration_number THEN 100 ELSE 0 END
 + CASE WHEN coalesce(trim(in_tax_number) = cand_tax_number, false) THEN 100 ELSE 0 END + CASE WHEN coalesce(a.d = d1, false) OR a.d = d2 THEN 80 ELSE 0 END + CASE WHEN in_phone <> '' AND a.t = b.t THEN 60 ELSE 0 END AS base FROM a CROSS JOIN b),
s AS (SELECT input_id, cand_id, least(base + CASE WHEN sim >= 95 THEN 55 WHEN sim >= 85 THEN 45 WHEN sim >= 70 THEN 30 WHEN sim >= 55 THEN 15 ELSE 0 END, 100)::DOUBLE AS score FROM j)"""


@query(f"""WITH {_POINTS}, best AS (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY score DESC, cand_id) AS k FROM s WHERE score >= 50)
SELECT c_custkey AS input_id, cand_id, coalesce(score, 0) AS score, CASE WHEN score >= 90 THEN 'HIGH' WHEN score >= 70 THEN 'MEDIUM' WHEN score >= 50 THEN 'LOW' ELSE 'REJECT' END AS confidence,
CASE WHEN score >= 90 THEN 'CONFIRMED' WHEN score >= 50 THEN 'REVIEW' ELSE 'NO_MATCH' END AS match_status FROM customer LEFT JOIN best ON input_id = c_custkey AND k = 1""")
def candidate_score_gate(spark: SparkSession, folder: str) -> DataFrame:
    """The best candidate of every customer among all suppliers; those that none reaches the gate for have no match."""
    left, right = _sides(spark, folder)
    best = matching.matches(left, right, "input_id", "cand_id", exact=False)
    found = left.select("input_id").join(best, "input_id", "left").withColumns({"score": F.coalesce("score", F.lit(0.0)), "confidence": F.coalesce("confidence", F.lit("REJECT"))})
    return matching.with_status(found).select("input_id", "cand_id", "score", "confidence", "match_status")


@query(f"""WITH {_POINTS} SELECT input_id, cand_id, score, k AS place FROM (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY score DESC, cand_id) AS k FROM s WHERE score >= 30) WHERE k <= 3""")
def candidate_score_top(spark: SparkSession, folder: str) -> DataFrame:
    """The three best of every customer down to names that are good only."""
    left, right = _sides(spark, folder)
    best = matching.matches(left, right, "input_id", "cand_id", gate=30, n=3, exact=False)
    return rel.numbered(best, "input_id", "place", F.col("score").desc(), "cand_id").select("input_id", "cand_id", "score", F.col("place").cast("long").alias("place"))


@query()
def candidate_score_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The three best with the character ratio; tests hold them against all pairs."""
    left, right = _sides(spark, folder)
    return matching.with_status(matching.matches(left, right, "input_id", "cand_id", n=3))


@query("""WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1),
m AS (SELECT o_custkey AS id, lower(CASE WHEN o_orderkey % 3 = 0 THEN 'info' ELSE 'u' || o_orderkey END || '@' || CASE WHEN o_orderkey % 4 = 0 THEN 'own.example.com' ELSE 'mail.example.com' END) AS email, (o_orderkey % 101)::INT AS confidence FROM orders WHERE o_orderstatus = 'F'),
u AS (SELECT id, email, max(confidence) AS confidence FROM m GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY split_part(email, '@', 1) = 'info' DESC, split_part(email, '@', 2) = 'own.example.com' DESC, confidence DESC, email) AS rn FROM u),
a AS (SELECT id, min(email) FILTER (rn = 1) AS primary_email, string_agg(email, '; ' ORDER BY rn) FILTER (rn > 1) AS other_emails, count(*) AS email_count FROM r GROUP BY id)
SELECT c_custkey AS company_id, c_mktsegment AS region, c_name AS company_name, event_type AS website_status, coalesce(primary_email, '') AS primary_email, coalesce(other_emails, '') AS other_emails, coalesce(email_count, 0) AS email_count
FROM customer LEFT JOIN latest ON user_id = c_custkey LEFT JOIN a ON a.id = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def export_rows(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    local, host = F.when(k % 3 == 0, "info").otherwise(F.concat(F.lit("u"), k.cast("string"))), F.when(k % 4 == 0, "own.example.com").otherwise("mail.example.com")
    mails = table(spark, folder, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"), F.lower(F.concat(local, F.lit("@"), host)).alias("email"), (k % 101).cast("int").alias("confidence"))
    mails = mails.groupBy("id", "email").agg(F.max("confidence").alias("confidence"))
    ranked = rel.numbered(mails, "id", "rn", *emails.primary_order(F.col("email"), F.lit("https://www.own.example.com/start"), F.col("confidence")))
    others = F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") > 1, F.struct("rn", "email")))), lambda e: e["email"])
    packed = ranked.groupBy("id").agg(F.min(F.when(F.col("rn") == 1, F.col("email"))).alias("primary_email"), F.array_join(others, "; ").alias("other_emails"), F.count("*").alias("email_count"))
    companies = table(spark, folder, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_name", "c_mktsegment")
    sites = rel.latest_join(companies, table(spark, folder, "events").select("event_id", "user_id", "event_type"), "c_custkey", "user_id", "event_id")
    return sites.join(packed, F.col("c_custkey") == F.col("id"), "left").select(
        F.col("c_custkey").alias("company_id"), F.col("c_mktsegment").alias("region"), F.col("c_name").alias("company_name"), F.col("event_type").alias("website_status"),
        F.coalesce("primary_email", F.lit("")).alias("primary_email"), F.coalesce("other_emails", F.lit("")).alias("other_emails"), F.coalesce("email_count", F.lit(0).cast("long")).alias("email_count"),
    )


@query("""WITH e AS (SELECT c_mktsegment AS region, c_custkey % 3 = 0 AS has_email, c_acctbal FROM customer)
SELECT region, count(*) AS companies, count(*) FILTER (has_email) AS with_email, count(*) FILTER (NOT has_email) AS without_email, round(sum(c_acctbal), 2) AS balance FROM e GROUP BY GROUPING SETS ((region), ())""")
def export_report(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer").select(F.col("c_mktsegment").alias("region"), (F.col("c_custkey") % 3 == 0).alias("has_email"), "c_acctbal")
    return rel.with_total(rows, "region", F.count("*").alias("companies"), F.count_if("has_email").alias("with_email"), F.count_if(~F.col("has_email")).alias("without_email"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
