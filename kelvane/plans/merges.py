"""Merge, archive, fact and identity queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import identity, merge
from ..operators import relational as rel
from ..sources.tables import table
from ._registry import query

# Two overlapping halves of orders with holes made by rule: the snapshot and the batch of every merge here.
_T = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price, o_orderpriority AS priority FROM orders WHERE o_orderkey % 4 <> 0"
_S = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'X' END AS status, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice + 1 END AS price, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE lower(o_orderpriority) END AS priority FROM orders WHERE o_orderkey % 4 <> 1"


def _halves(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, folder, "orders")
    hole = lambda n, c: F.when(F.col("o_orderkey") % n != 0, c)
    k = F.col("o_orderkey").alias("k")
    target = o.filter("o_orderkey % 4 <> 0").select(k, hole(3, F.col("o_orderstatus")).alias("status"), hole(5, F.col("o_totalprice")).alias("price"), F.col("o_orderpriority").alias("priority"))
    blank = F.when(F.col("o_orderkey") % 6 == 0, "").otherwise(F.lower("o_orderpriority"))
    source = o.filter("o_orderkey % 4 <> 1").select(k, hole(2, F.lit("X")).alias("status"), hole(7, F.col("o_totalprice") + 1).alias("price"), blank.alias("priority"))
    return target, source


@query("SELECT source, sha256(text) AS raw_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1, 2")
def raw_record_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").groupBy("source", F.sha2("text", 256).alias("raw_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT source, count(*) AS n FROM (SELECT source, sha256(text) AS h FROM documents WHERE doc_id % 2 = 0 UNION SELECT source, sha256(text) FROM documents) GROUP BY source")
def raw_record_archive(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", "source", F.sha2("text", 256).alias("raw_hash"))
    first = rel.keep_first(rows.filter("doc_id % 2 = 0"), ["source", "raw_hash"], "doc_id")
    return merge.insert_new(first, rows, ["source", "raw_hash"], "doc_id").groupBy("source").agg(F.count("*").alias("n"))


@query(f"SELECT k, coalesce(s.status, t.status) AS status, coalesce(s.price, t.price) AS price, coalesce(t.priority, s.priority) AS priority FROM ({_T}) t FULL JOIN ({_S}) s USING (k)")
def coalescing_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return merge.coalescing_upsert(*_halves(spark, folder), ["k"], first_wins=["priority"])


@query(f"""SELECT k, coalesce(nullif(t.status, ''), nullif(s.status, '')) AS status, coalesce(t.price, s.price) AS price, coalesce(nullif(t.priority, ''), nullif(s.priority, '')) AS priority,
coalesce((nullif(t.status, '') <> nullif(s.status, ''))::INT, 0) + coalesce((t.price <> s.price)::INT, 0) + coalesce((nullif(t.priority, '') <> nullif(s.priority, ''))::INT, 0) AS conflicts
FROM ({_T}) t FULL JOIN ({_S}) s USING (k)""")
def fill_blank_merge_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return merge.fill_blanks(*_halves(spark, folder), ["k"]).withColumn("conflicts", F.size("conflicts"))


_COUNTED = "SELECT user_id, max(event_id) AS last_id, count(*) AS n, min(event_id) AS first_id FROM events WHERE event_id % 2 = {0} GROUP BY user_id"


@query(f"""SELECT user_id, CASE WHEN s.n IS NOT NULL THEN s.last_id ELSE t.last_id END AS last_id, coalesce(t.n, 0) + coalesce(s.n, 0) AS n, CASE WHEN t.n IS NOT NULL THEN t.first_id ELSE s.first_id END AS first_id
FROM ({_COUNTED.format(0)}) t FULL JOIN ({_COUNTED.format(1)}) s USING (user_id)""")
def overwrite_upsert_counter(spark: SparkSession, folder: str) -> DataFrame:
    part = lambda r: table(spark, folder, "events").filter(F.col("event_id") % 2 == r).groupBy("user_id").agg(F.max("event_id").alias("last_id"), F.count("*").alias("n"), F.min("event_id").alias("first_id"))
    return merge.overwrite_upsert(part(0), part(1), ["user_id"], counters=["n"], keep=["first_id"])


@query(f"SELECT k, status, price, priority FROM ({_S}) UNION ALL SELECT k, status, price, priority FROM ({_T}) WHERE k NOT IN (SELECT k FROM ({_S}))")
def insert_or_replace(spark: SparkSession, folder: str) -> DataFrame:
    return merge.replace_rows(*_halves(spark, folder), ["k"])


@query(f"SELECT k, status, price, priority FROM ({_T}) UNION ALL SELECT k, status, price, priority FROM ({_S}) WHERE k NOT IN (SELECT k FROM ({_T}))")
def insert_or_ignore(spark: SparkSession, folder: str) -> DataFrame:
    return merge.insert_new(*_halves(spark, folder), ["k"])


@query(f"""SELECT action, count(*) AS n FROM (SELECT CASE WHEN t.k IS NULL THEN 'INSERT' WHEN s.k IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS action FROM (SELECT k AS k, status, price, priority FROM ({_T})) t
FULL JOIN (SELECT k AS k, status, price, priority FROM ({_S})) s ON t.k = s.k WHERE t.k IS NULL OR s.k IS NULL OR t.status IS DISTINCT FROM s.status OR t.price IS DISTINCT FROM s.price OR t.priority IS DISTINCT FROM s.priority) GROUP BY action""")
def audit_changes(spark: SparkSession, folder: str) -> DataFrame:
    return merge.changes(*_halves(spark, folder), ["k"]).groupBy("action").agg(F.count("*").alias("n"))


@query("""WITH facts AS (SELECT o_custkey AS company_id, 'status' AS fact_key, year(o_orderdate) AS value_year, o_orderstatus AS value_text, NULL::DOUBLE AS value_number, o_orderkey AS seq FROM orders
UNION ALL SELECT o_custkey, 'price', CAST(NULL AS BIGINT), NULL, o_totalprice, o_orderkey FROM orders)
SELECT company_id, fact_key, value_year, value_text, value_number, seq FROM (SELECT *, row_number() OVER (PARTITION BY company_id, fact_key, coalesce(value_year, -1) ORDER BY seq DESC) AS rn FROM facts) WHERE rn = 1""")
def eav_current_facts(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    none = lambda t: F.lit(None).cast(t)
    facts = o.select(F.col("o_custkey").alias("company_id"), F.explode(F.array(
        F.struct(F.lit("status").alias("fact_key"), F.year("o_orderdate").cast("long").alias("value_year"), F.col("o_orderstatus").alias("value_text"), none("double").alias("value_number"), F.col("o_orderkey").alias("seq")),
        F.struct(F.lit("price").alias("fact_key"), none("long").alias("value_year"), none("string").alias("value_text"), F.col("o_totalprice").alias("value_number"), F.col("o_orderkey").alias("seq")),
    )).alias("f")).select("company_id", "f.*")
    return merge.current_facts(facts)


@query("SELECT o_custkey AS company_id, max_by(o_orderstatus, o_orderkey) AS status, CAST(max_by(o_totalprice, o_orderkey) AS VARCHAR) IS NOT NULL AS has_price FROM orders GROUP BY o_custkey")
def pivot_current_facts(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    facts = o.select(F.col("o_custkey").alias("company_id"), F.explode(F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("price"), F.col("o_totalprice").cast("string"))).alias("fact_key", "value"), F.lit(None).cast("int").alias("value_year"), F.col("o_orderkey").alias("seq"))
    wide = merge.pivot_facts(merge.current_facts(facts), "company_id", "fact_key", ["status", "price"], "value")
    return wide.select("company_id", "status", F.col("price").isNotNull().alias("has_price"))


# A batch of rows that carry up to two identifiers of suppliers, some of them of two different ones.
_KNOWN = "SELECT s_suppkey AS entity_id, s_suppkey::VARCHAR AS reg, (1000 + s_suppkey)::VARCHAR AS tax FROM supplier WHERE s_suppkey % 3 <> 0"
_BATCH = "SELECT c_custkey AS row_id, CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 150)::VARCHAR END AS reg, CASE WHEN c_custkey % 5 <> 0 THEN (1000 + (c_custkey + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END) % 150)::VARCHAR END AS tax FROM customer"


def _known(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, folder, "supplier").filter(k % 3 != 0).select(k.alias("entity_id"), k.cast("string").alias("reg"), (1000 + k).cast("string").alias("tax"))


def _incoming(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    shift = F.when(k % 7 == 0, 1).otherwise(0)
    return table(spark, folder, "customer").select(k.alias("row_id"), F.when(k % 4 != 0, (k % 150).cast("string")).alias("reg"), F.when(k % 5 != 0, (1000 + (k + shift) % 150).cast("string")).alias("tax"))


@query(f"""WITH k AS ({_KNOWN}), b AS ({_BATCH}), m AS (SELECT row_id, count(DISTINCT entity_id) AS matches, min(entity_id) AS e FROM b JOIN k ON b.reg = k.reg OR b.tax = k.tax GROUP BY row_id)
SELECT row_id, coalesce(matches, 0) AS matches, CASE WHEN matches = 1 THEN e END AS entity_id,
CASE WHEN reg IS NULL AND tax IS NULL THEN 'NO_IDENTIFIER' WHEN matches IS NULL THEN 'NEW' WHEN matches > 1 THEN 'CONFLICT' ELSE 'RESOLVED' END AS outcome FROM b LEFT JOIN m USING (row_id)""")
def identity_resolution(spark: SparkSession, folder: str) -> DataFrame:
    columns = {"reg": F.col("reg"), "tax": F.col("tax")}
    return identity.resolve(_incoming(spark, folder), _known(spark, folder), "row_id", "entity_id", columns)


@query(f"""WITH k AS ({_KNOWN}), b AS ({_BATCH}) SELECT row_id, CASE WHEN coalesce(x.entity_id <> y.entity_id, false) THEN NULL ELSE coalesce(x.entity_id, y.entity_id) END AS entity_id, coalesce(x.entity_id <> y.entity_id, false) AS conflict
FROM b LEFT JOIN k x ON b.reg = x.reg LEFT JOIN k y ON b.tax = y.tax""")
def identity_two_probes(spark: SparkSession, folder: str) -> DataFrame:
    return identity.resolve_two(_incoming(spark, folder), _known(spark, folder), "entity_id", "reg", "tax").select("row_id", "entity_id", "conflict")


@query(f"""WITH k AS ({_KNOWN}), b AS ({_BATCH}), r AS (SELECT b.*, CASE c WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'REVIEW' WHEN 2 THEN 'ERROR' WHEN 3 THEN 'NO_MATCH' ELSE 'ODD' END AS status, x.entity_id IS NOT NULL OR y.entity_id IS NOT NULL AS known
FROM (SELECT *, row_id % 5 AS c FROM b) b LEFT JOIN k x ON b.reg = x.reg LEFT JOIN k y ON b.tax = y.tax),
g AS (SELECT row_id, CASE WHEN status = 'CONFIRMED' AND reg IS NULL AND tax IS NULL THEN 'UNRESOLVED_IDENTITY' WHEN status = 'REVIEW' AND NOT known THEN 'REVIEW_HELD' WHEN status = 'ERROR' THEN 'SOURCE_ROW_ERROR' WHEN status = 'NO_MATCH' THEN 'NO_MATCH' WHEN status = 'ODD' THEN 'UNKNOWN_MATCH_STATUS' END AS error_type FROM r)
SELECT coalesce(error_type, 'OK') AS outcome, count(*) AS n FROM g GROUP BY 1""")
def import_gate(spark: SparkSession, folder: str) -> DataFrame:
    found = identity.resolve_two(_incoming(spark, folder), _known(spark, folder), "entity_id", "reg", "tax")
    c = F.col("row_id") % 5
    status = F.when(c == 0, "CONFIRMED").when(c == 1, "REVIEW").when(c == 2, "ERROR").when(c == 3, "NO_MATCH").otherwise("ODD")
    gate = identity.import_gate(status, F.col("reg").isNotNull() | F.col("tax").isNotNull(), F.col("by_first").isNotNull() | F.col("by_second").isNotNull())
    return found.groupBy(F.coalesce(gate["error_type"], F.lit("OK")).alias("outcome")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT p_partkey AS person_id, 'u' || p_partkey AS linkedin_url, 'e' || (p_partkey % 900) AS email FROM part), b AS (SELECT c_custkey AS row_id, 'u' || (c_custkey * 3) AS linkedin_url, 'e' || c_custkey AS email FROM customer),
e AS (SELECT email, min(person_id) AS x FROM p GROUP BY email HAVING count(*) = 1)
SELECT row_id, coalesce(p.person_id, e.x) AS person_id FROM b LEFT JOIN p ON b.linkedin_url = p.linkedin_url LEFT JOIN e ON b.email = e.email""")
def person_resolution(spark: SparkSession, folder: str) -> DataFrame:
    k, c = F.col("p_partkey"), F.col("c_custkey")
    text = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    people = table(spark, folder, "part").select(k.alias("person_id"), text("u", k).alias("linkedin_url"), text("e", k % 900).alias("email"))
    batch = table(spark, folder, "customer").select(c.alias("row_id"), text("u", c * 3).alias("linkedin_url"), text("e", c).alias("email"))
    return identity.resolve_people(batch, people).select("row_id", "person_id")


@query(r"""WITH o AS (SELECT s_nationkey AS company_id, s_suppkey::VARCHAR AS shareholder_id, s_name AS owner FROM supplier), n AS (SELECT company_id, count(*) AS n, min(shareholder_id) AS only_one FROM o GROUP BY 1),
s AS (SELECT s_nationkey AS company_id, s_suppkey AS share_id, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'Zap. št. družbenika ' || s_suppkey || ', Zap. št. družbenika ' || (s_suppkey + 25) END AS holders FROM supplier),
h AS (SELECT company_id, share_id, unnest(CASE WHEN len(ids) > 0 THEN ids WHEN only_one IS NOT NULL THEN [only_one] ELSE [] END) AS shareholder_id
FROM (SELECT s.company_id, share_id, regexp_extract_all(holders, 'Zap\.?\s*št\.?\s*družbenika\s*(\d+)', 1) AS ids, CASE WHEN n.n = 1 THEN only_one END AS only_one FROM s LEFT JOIN n USING (company_id)))
SELECT h.company_id, share_id, h.shareholder_id, owner FROM h JOIN o ON o.company_id = h.company_id AND o.shareholder_id = h.shareholder_id""")
def ownership_share_join(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier")
    owners = s.select(F.col("s_nationkey").alias("company_id"), F.col("s_suppkey").cast("string").alias("shareholder_id"), F.col("s_name").alias("owner"))
    holders = F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.format_string("Zap. št. družbenika %d, Zap. št. družbenika %d", "s_suppkey", F.col("s_suppkey") + 25))
    shares = s.select(F.col("s_nationkey").alias("company_id"), F.col("s_suppkey").alias("share_id"), holders.alias("holders"))
    return identity.ownership_edges(shares, owners).select("company_id", "share_id", "shareholder_id", "owner")


@query("SELECT c_custkey, sha256(coalesce(c_name, chr(0)) || chr(31) || coalesce(c_nationkey::VARCHAR, chr(0))) AS entity_key FROM customer")
def entity_keys(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", ids.entity_key(F.col("c_name"), F.col("c_nationkey")).alias("entity_key"))


@query("SELECT region_key, sha256('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"region_key\":' || region_key || '}') AS raw_hash FROM (SELECT n_name, n_nationkey, n_regionkey AS region_key FROM nation)")
def raw_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").withColumnRenamed("n_regionkey", "region_key").select("region_key", ids.raw_hash("region_key", "n_name", "n_nationkey").alias("raw_hash"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 'REVIEW' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 10 = 0 THEN CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE least(o_orderkey % 97, 60) END ELSE CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE o_orderkey % 97 END END AS confidence FROM orders")
def targeted_repair(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select(k.alias("id"), F.col("o_orderstatus").alias("status"), F.when(k % 20 != 0, k % 97).alias("confidence"))
    return merge.demote(rows, rows.filter("id % 10 = 0"), "id", "status", "REVIEW")


@query("""WITH h AS (SELECT event_id, user_id AS company_id, event_type AS status, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS attempt_count FROM events)
SELECT company_id, count(*) AS n, max(attempt_count) AS attempts FROM (SELECT company_id, attempt_count FROM h UNION ALL SELECT c_custkey, coalesce(m, 0) + 1 FROM customer LEFT JOIN (SELECT company_id, max(attempt_count) AS m FROM h GROUP BY 1) ON company_id = c_custkey) GROUP BY 1""")
def append_attempts(spark: SparkSession, folder: str) -> DataFrame:
    h = table(spark, folder, "events").select("event_id", F.col("user_id").alias("company_id"), F.col("event_type").alias("status"))
    history = rel.numbered(h, "company_id", "attempt_count", "event_id")
    results = table(spark, folder, "customer").select(F.col("c_custkey").alias("company_id"), F.lit("RETRIED").alias("status"))
    return merge.append_attempt(history, results, "company_id", "event_id").groupBy("company_id").agg(F.count("*").alias("n"), F.max("attempt_count").alias("attempts"))
