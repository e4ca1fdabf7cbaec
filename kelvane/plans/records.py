"""Runs over manifests, ingests, result pages and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import ingest, merge, results, runs
from ..operators import relational as rel
from ..sources.catalog import Catalog
from ..sources.shared import shared_folder, written
from ..sources.tables import table
from ._registry import query


# Runs over a manifest


@query(r"""SELECT c_custkey, position, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}' AS identity_json, sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}') AS identity_hash, 'PENDING' AS status
FROM (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_name DESC) AS position FROM customer)""")
def run_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots of all customers with their digests; positions come from a table, here from names."""
    rows = table(spark, folder, "customer").select("c_custkey", "c_name")
    most = rows.count()
    placed = rows.withColumn("position", F.lit(most) - F.regexp_extract("c_name", r"(\d+)$", 1).cast("long"))
    return runs.start(placed, "c_custkey", "c_name", "position").select("c_custkey", "position", "identity_json", "identity_hash", "status")


_ATTEMPTS = "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS attempt_number, CASE WHEN event_id % 40 = 0 THEN 'COMPLETED' WHEN event_id % 7 = 0 THEN 'RUNNING' ELSE 'FAILED' END AS status FROM events"


@query(f"""SELECT c_custkey AS user_id, coalesce(max(attempt_number), 0) + 1 AS attempt_number FROM customer LEFT JOIN ({_ATTEMPTS}) ON user_id = c_custkey GROUP BY c_custkey HAVING count(*) FILTER (status = 'COMPLETED') = 0""")
def run_remaining(spark: SparkSession, folder: str) -> DataFrame:
    attempts = rel.numbered(table(spark, folder, "events"), "user_id", "attempt_number", "event_id")
    e = F.col("event_id")
    attempts = attempts.withColumn("status", F.when(e % 40 == 0, "COMPLETED").when(e % 7 == 0, "RUNNING").otherwise("FAILED"))
    run = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("ELIGIBLE").alias("eligibility_status"))
    return runs.remaining(run, attempts, "user_id").select("user_id", "attempt_number")


@query("SELECT CASE WHEN event_id % 7 = 0 THEN 'INTERRUPTED' ELSE event_type END AS status, count(*) AS n FROM events GROUP BY 1")
def run_interrupted(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select(F.when(F.col("event_id") % 7 == 0, "RUNNING").otherwise(F.col("event_type")).alias("status"))
    return runs.interrupted(rows).groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey AS company, 'EMAIL' AS kind, 'm' || c_custkey AS normalized_value FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 7 = 0 OR c_custkey % 11 = 0""")
def invalid_contacts(spark: SparkSession, folder: str) -> DataFrame:
    """References that are missing, of another value, or lack the primary one."""
    k = F.col("c_custkey")
    value = F.concat(F.lit("m"), k.cast("string"))
    rows = table(spark, folder, "customer")
    found = rows.select(k.alias("company"), F.lit("EMAIL").alias("kind"), value.alias("normalized_value"), F.array(k, -k).alias("supporting"), F.when(k % 11 == 0, 0).otherwise(k).alias("primary_observation_id"))
    seen = rows.select(k.alias("company"), k.alias("observation_id"), F.lit("EMAIL_CANDIDATE").alias("observation_type"), F.when(k % 7 == 0, "x").otherwise(value).alias("normalized_value"))
    seen = seen.unionByName(rows.filter(k % 5 != 0).select(k.alias("company"), (-k).alias("observation_id"), F.lit("EMAIL").alias("observation_type"), value.alias("normalized_value")))
    return runs.invalid_contacts(found, seen, ["company"])


# Merges


@query("""WITH t AS (SELECT o_custkey AS company, o_orderpriority AS person, o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'PENDING' ELSE 'DONE' END AS status FROM orders WHERE o_orderkey % 2 = 0),
n AS (SELECT o_custkey AS company, o_orderpriority AS person, o_orderkey AS id, 'PENDING' AS status FROM orders WHERE o_orderkey % 2 = 1),
f AS (SELECT *, row_number() OVER (PARTITION BY company, person ORDER BY id) AS k FROM n WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.company = n.company AND t.person = n.person AND t.status = 'PENDING'))
SELECT id, company, person, status FROM t UNION ALL SELECT id, company, person, status FROM f WHERE k = 1""")
def insert_active_tasks(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select(k.alias("id"), F.col("o_custkey").alias("company"), F.col("o_orderpriority").alias("person"), F.when((k % 3 == 0) | (k % 2 == 1), "PENDING").otherwise("DONE").alias("status"))
    return merge.insert_active(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"), ["company", "person"], F.col("status") == "PENDING", "id")[0]


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN m ELSE o_custkey END AS company_id FROM orders LEFT JOIN (SELECT o_orderdate, min(o_custkey) AS m FROM orders WHERE o_orderkey % 4 > 1 GROUP BY 1) USING (o_orderdate)""")
def back_filled_records(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select(k.alias("id"), "o_orderdate", F.when(k % 4 > 0, F.col("o_custkey")).alias("company_id"))
    return merge.back_fill(rows, rows.filter("id % 4 > 1"), ["o_orderdate"], "company_id").select("id", "company_id")


_OBSERVED = "SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS source_record_id, o_orderpriority AS fact_key, (o_orderkey % 2)::INT AS year, o_orderstatus AS value FROM orders"


@query(f"""WITH o AS ({_OBSERVED}), a AS (SELECT *, row_number() OVER (PARTITION BY source_record_id, fact_key, year ORDER BY seq) AS k, row_number() OVER (PARTITION BY fact_key, year, value ORDER BY seq) AS j FROM o WHERE source_record_id IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY fact_key, year, value ORDER BY seq) AS k FROM o WHERE source_record_id IS NULL),
x AS (SELECT DISTINCT fact_key, year, value FROM a WHERE k = 1)
SELECT seq, source_record_id, fact_key, year, value FROM a WHERE k = 1 UNION ALL SELECT seq, source_record_id, fact_key, year, value FROM b ANTI JOIN x USING (fact_key, year, value) WHERE k = 1""")
def appended_observations(spark: SparkSession, folder: str) -> DataFrame:
    """All orders as observations, appended to none: those of a record are known by it, others by their value."""
    k = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select(k.alias("seq"), F.when(k % 3 > 0, F.col("o_custkey")).alias("source_record_id"), F.col("o_orderpriority").alias("fact_key"), (k % 2).cast("int").alias("year"), F.col("o_orderstatus").alias("value"))
    return merge.append_observations(rows.limit(0), rows, ["source_record_id", "fact_key", "year"], ["fact_key", "year", "value"])


@query("""WITH t AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'L' || s_suppkey END AS source_id, s_nationkey AS nation, s_suppkey % 5 AS role FROM supplier),
s AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'L' || c_custkey END AS source_id, c_nationkey AS nation, c_custkey % 5 AS role FROM customer)
SELECT k, coalesce(a.id, b.id) AS matched_id FROM s LEFT JOIN (SELECT source_id, min(id) AS id FROM t WHERE source_id IS NOT NULL GROUP BY 1) a USING (source_id) LEFT JOIN (SELECT nation, role, min(id) AS id FROM t GROUP BY 1, 2) b ON b.nation = s.nation AND b.role = s.role""")
def linked_roles(spark: SparkSession, folder: str) -> DataFrame:
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    known = table(spark, folder, "supplier").select(k.alias("id"), F.when(k % 2 == 0, F.concat(F.lit("L"), k.cast("string"))).alias("source_id"), F.col("s_nationkey").alias("nation"), (k % 5).alias("role"))
    rows = table(spark, folder, "customer").select(c.alias("k"), F.when(c % 3 == 0, F.concat(F.lit("L"), c.cast("string"))).alias("source_id"), F.col("c_nationkey").alias("nation"), (c % 5).alias("role"))
    return merge.link_with_fallback(known, rows, "source_id", ["nation", "role"]).select("k", "matched_id")


_FILED = {
    "k": "c_custkey", "source": "CASE WHEN c_custkey % 3 = 0 THEN 'web' ELSE 'reg' END", "external_id": "'' || c_custkey", "canonical_name": "c_name",
    "registration_number": "CASE WHEN c_custkey % 10 < 8 THEN (1000000 + c_custkey - c_custkey % 2) || ' ' END",
    "tax_number": "CASE WHEN c_custkey % 50 = 11 THEN 'SI' || (10000003 + c_custkey) WHEN c_custkey % 10 < 8 AND c_custkey % 2 = 0 THEN 'SI' || (10000000 + c_custkey) WHEN c_custkey % 10 = 8 THEN 'si ' || (20000000 + c_custkey) END",
    "address": "CASE WHEN c_custkey % 3 > 0 THEN 'Cesta ' || c_custkey END", "observed_at": "'d'", "raw_json": "'{' || c_custkey || '}'", "seq": "c_custkey",
}
_NESTED = {
    "facts": "array(named_struct('fact_key', 'status', 'value_text', 'v' || c_custkey % 4, 'value_number', CAST(NULL AS DOUBLE), 'value_year', CAST(NULL AS INT)), named_struct('fact_key', 'size', 'value_text', CAST(NULL AS STRING), 'value_number', CAST(c_custkey AS DOUBLE), 'value_year', CAST(2020 + c_custkey % 2 AS INT)))",
    "people": "array(named_struct('full_name', 'Ana  ' || c_custkey, 'email', CASE WHEN c_custkey % 5 > 0 THEN 'Ana' || (c_custkey - c_custkey % 4) || '@a.si' END, 'linkedin_url', CAST(NULL AS STRING), 'roles', array(named_struct('role_type', 'director', 'title', 'D', 'source_role_id', 'r' || c_custkey, 'valid_from', CAST(NULL AS STRING), 'valid_to', CAST(NULL AS STRING)))))",
    "ownership": "array(named_struct('owner_raw_name', 'Own ' || c_custkey % 7, 'owner_type', 'LEGAL_ENTITY', 'source_share_id', 's1', 'share_percent', 50.0D, 'valid_from', CAST(NULL AS STRING), 'valid_to', CAST(NULL AS STRING)))",
}
_FILED_SQL = "SELECT *, nullif(regexp_replace(coalesce(registration_number, ''), '\\D', '', 'g'), '') AS reg, nullif(regexp_replace(coalesce(tax_number, ''), '\\D', '', 'g'), '') AS tax, k % 50 = 11 AS clash FROM (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _FILED.items()) + " FROM customer)"


def _ingested(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Two ingests, each under one commit of all tables: all records but those that name two companies, then all of them."""
    records = table(spark, folder, "customer").selectExpr(*[f"{e} AS {c}" for c, e in (_FILED | _NESTED).items()]).drop("k")
    catalog = Catalog(spark, shared_folder(spark, "catalog"))
    tables, at = {k: spark.createDataFrame([], v) for k, v in ingest.TABLES.items()}, 0
    buckets = max(4, -(-records.count() // 100_000))
    for batch in (records.filter("seq % 50 <> 11"), records):
        change = catalog.begin()
        for name, df in ingest.ingest(batch, tables, lambda df: written(df, "ingest")).items():
            change.replace(name, df, [df.columns[0]], buckets)
        at = change.commit()
        tables = {k: catalog.read(k, at) for k in ingest.TABLES}
    return tables


@query(f"""WITH r AS (SELECT *, coalesce('r' || reg, 't' || tax) AS c FROM ({_FILED_SQL}) WHERE NOT clash)
SELECT arg_max(canonical_name, k) AS canonical_name, any_value(reg) AS registration_number, any_value(tax) AS tax_number, arg_max(address, k) FILTER (address IS NOT NULL) AS address, count(*) AS n_records, 2 * count(*) AS n_facts, count(*) AS n_roles,
count(DISTINCT coalesce(CASE WHEN k % 5 > 0 THEN 'ana' || (k - k % 4) END, c || k)) AS n_people, count(DISTINCT k % 7) AS n_shares FROM r WHERE c IS NOT NULL GROUP BY c""")
def nested_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer as a nested record, two of which make a company; ingesting them again changes nothing."""
    made = _ingested(spark, folder)
    count = lambda name, *of: made[name].groupBy("company_id").agg(*of)
    out = made["companies"].join(count("source_records", F.count("*").alias("n_records")), "company_id").join(count("observations", F.count("*").alias("n_facts")), "company_id")
    out = out.join(count("roles", F.count("*").alias("n_roles"), F.count_distinct("person_id").alias("n_people")), "company_id").join(count("ownership", F.count("*").alias("n_shares")), "company_id")
    return out.drop("company_id")


@query(f"""WITH r AS ({_FILED_SQL}) SELECT x.reg AS identifier_value, 'registration_number' AS identifier_type, b.tax AS other_tax FROM r x JOIN r b ON b.tax = x.tax AND NOT b.clash WHERE x.clash""")
def ingest_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """The journal of records whose identifiers name two companies."""
    made = _ingested(spark, folder)
    other = made["companies"].select(F.col("company_id").alias("entity_b"), F.col("tax_number").alias("other_tax"))
    return made["conflicts"].join(other, "entity_b").select("identifier_value", "identifier_type", "other_tax")


@query("SELECT count(*) FILTER (event_id % 4 = 0) AS resolved, count(*) FILTER (event_id % 4 = 1) AS unresolved, count(*) FILTER (event_id % 4 = 2) AS duplicates, count(*) FILTER (event_id % 4 = 3) AS errors FROM events")
def import_statistics(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("event_id") % 4
    return ingest.import_statistics(table(spark, folder, "events").select(F.when(e == 0, "imported/resolved").when(e == 1, "imported/unresolved").when(e == 2, "skipped/duplicate").otherwise("error").alias("s")), "s")


@query("SELECT count(*) FILTER (trim(text) <> '') AS text, count(*) FILTER (trim(lang) <> '') AS lang, count(*) FILTER (trim(source) <> '') AS source FROM documents")
def filled_columns(spark: SparkSession, folder: str) -> DataFrame:
    return results.filled_counts(table(spark, folder, "documents"), "text", "lang", "source")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50""")
def keyset_page(spark: SparkSession, folder: str) -> DataFrame:
    return rel.page_after(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 100, 50)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 > 0")
def active_rows(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey", (k % 3 == 0).cast("int").alias("is_current"), F.when(k % 5 == 0, "2020-01-01").alias("valid_to"))
    return rel.active(rows).select("o_orderkey", "o_custkey")


@query("SELECT page_id, row_number() OVER (ORDER BY CASE WHEN page_id % 4 = 0 THEN 0 ELSE 1 END, page_id)::INT AS place FROM pages")
def home_domain_first(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "pages").select("page_id", F.lit(1).alias("one"), F.when(F.col("page_id") % 4 == 0, "https://www.a.si/x").otherwise("https://a.com/.si").alias("link"))
    return rel.numbered(rows, "one", "place", *rel.home_first(F.col("link"), ".si"), "page_id").select("page_id", "place")


@query("SELECT c_custkey, c_nationkey FROM customer")
def hidden_columns(spark: SparkSession, folder: str) -> DataFrame:
    return rel.without_columns(table(spark, folder, "customer"), "c_name", "c_acctbal", "c_mktsegment", "not_there")


@query("SELECT user_id, event_id, event_type FROM events ORDER BY coalesce(CASE WHEN event_id % 2 = 0 THEN ts END, ts) DESC, event_id DESC LIMIT 1")
def last_finished(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events")
    return rows.orderBy(F.coalesce(F.when(F.col("event_id") % 2 == 0, F.col("ts")), F.col("ts")).desc(), F.col("event_id").desc()).limit(1).select("user_id", "event_id", "event_type")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 > 0 UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0""")
def bag_of_reports(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return rows.filter("o_orderkey % 3 > 0").unionByName(rows.filter("o_orderkey % 2 = 0"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 = 0")
def evicted_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Remembered keys that are no longer grouped."""
    rows = table(spark, folder, "orders").select("o_orderkey")
    return rel.pending(rows.filter("o_orderkey % 2 = 0"), rows.filter("o_orderkey % 3 > 0"), "o_orderkey")


# Pages


@query("""WITH p AS (SELECT c_nationkey AS page, list_sort(list(DISTINCT c_mktsegment)) AS ids FROM customer GROUP BY 1) SELECT page, substr(sha256(array_to_string(ids, chr(10))), 1, 20) AS fingerprint, min(page) OVER (PARTITION BY ids) AS first_page FROM p""")
def repeated_pages(spark: SparkSession, folder: str) -> DataFrame:
    return results.distinct_pages(table(spark, folder, "customer").select(F.col("c_nationkey").alias("page"), "c_mktsegment"), "page", F.col("c_mktsegment"))


@query("SELECT c_custkey, sha256('reg' || chr(31) || c_custkey) AS key FROM customer")
def stable_keys(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", ids.entity_key(F.lit("reg"), F.col("c_custkey")).alias("key"))
