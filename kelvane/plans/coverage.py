"""Latest rows, coverage, grouping and other relational queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as rel
from ..sources.tables import table
from ._registry import query

TYPES = ("click", "error", "purchase", "view")
_LATEST = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events"


@query(f"""
WITH latest AS (SELECT * FROM ({_LATEST}) WHERE rn = 1),
n AS (SELECT count(*) AS total, count(l.event_id) AS processed, count(*) FILTER (l.event_type = 'click') AS click, count(*) FILTER (l.event_type = 'error') AS error,
  count(*) FILTER (l.event_type = 'purchase') AS purchase, count(*) FILTER (l.event_type = 'view') AS "view",
  count(*) FILTER (l.event_id IS NOT NULL AND l.event_type NOT IN ('click', 'error', 'purchase', 'view')) AS other_statuses
  FROM customer c LEFT JOIN latest l ON l.user_id = c.c_custkey)
SELECT *, greatest(total - processed, 0) AS remaining, CASE WHEN total > 0 THEN round(100.0 * processed / total, 1) ELSE 0.0 END AS percent FROM n""")
def latest_status_coverage(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type")
    joined = rel.latest_join(table(spark, folder, "customer").select("c_custkey"), events, "c_custkey", "user_id", "event_id")
    there = F.col("event_id").isNotNull()
    counts = [F.count_if(F.col("event_type") == t).alias(t) for t in TYPES]
    n = joined.agg(F.count("*").alias("total"), F.count_if(there).alias("processed"), *counts, F.count_if(there & ~F.coalesce(F.col("event_type").isin(*TYPES), F.lit(False))).alias("other_statuses"))
    return n.select("*", *rel.coverage(F.col("total"), F.col("processed")))


@query(f"SELECT user_id, event_id, event_type, round(value, 4) AS value FROM ({_LATEST}) WHERE rn = 1")
def latest_row_per_key(spark: SparkSession, folder: str) -> DataFrame:
    return rel.latest_per_key(table(spark, folder, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type", F.round("value", 4).alias("value"))


@query("SELECT event_type, count(*) AS n FROM (" + _LATEST + ") JOIN customer ON c_custkey = user_id WHERE rn = 1 GROUP BY event_type")
def latest_inner_group(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type")
    return rel.latest_join(table(spark, folder, "customer").select("c_custkey"), events, "c_custkey", "user_id", "event_id", how="inner").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE (o_custkey, o_orderkey) IN (SELECT o_custkey, max(o_orderkey) FROM orders GROUP BY o_custkey)")
def latest_by_max_semi(spark: SparkSession, folder: str) -> DataFrame:
    return rel.latest_semi(table(spark, folder, "orders"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def unprocessed_anti_join(spark: SparkSession, folder: str) -> DataFrame:
    done = table(spark, folder, "events").select(F.col("user_id").alias("c_custkey"))
    return rel.not_yet(table(spark, folder, "customer").select("c_custkey", "c_name"), done, "c_custkey")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer")
def exists_flag(spark: SparkSession, folder: str) -> DataFrame:
    seen = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has_orders", F.lit(True))
    return table(spark, folder, "customer").select("c_custkey").join(seen, "c_custkey", "left").select("c_custkey", F.coalesce("has_orders", F.lit(False)).alias("has_orders"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase,
count(*) FILTER (event_type = 'view') AS "view", count(*) FILTER (event_type NOT IN ('click', 'error', 'purchase', 'view')) AS other_statuses FROM events GROUP BY user_id""")
def status_pivot_zero_fill(spark: SparkSession, folder: str) -> DataFrame:
    counts = [F.count_if(F.col("event_type") == t).alias(t) for t in TYPES]
    return table(spark, folder, "events").groupBy("user_id").agg(*counts, F.count_if(~F.col("event_type").isin(*TYPES)).alias("other_statuses"))


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS other_statuses FROM orders")
def status_totals(spark: SparkSession, folder: str) -> DataFrame:
    return rel.status_counts(table(spark, folder, "orders"), "o_orderstatus", ("F", "O"))


@query("""SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_totalprice > 200000) AS large, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())""")
def region_grouping_sets(spark: SparkSession, folder: str) -> DataFrame:
    return rel.with_total(table(spark, folder, "orders"), "o_orderpriority", F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 200000).alias("large"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT sha256(text) AS content_hash, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys_having(spark: SparkSession, folder: str) -> DataFrame:
    return rel.duplicate_keys(table(spark, folder, "documents").select(F.sha2("text", 256).alias("content_hash")), "content_hash")


@query("SELECT l_suppkey, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY l_suppkey")
def distinct_count_exact(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_orderkey").alias("orders"))


@query("""SELECT CASE WHEN event_type = 'error' AND value > 50 THEN 'retryable' WHEN event_type = 'error' THEN 'final' WHEN value IS NULL THEN 'empty' ELSE 'ok' END AS reason, count(*) AS n
FROM events GROUP BY 1""")
def reason_histogram(spark: SparkSession, folder: str) -> DataFrame:
    failed = F.col("event_type") == "error"
    reason = F.when(failed & (F.col("value") > 50), "retryable").when(failed, "final").when(F.col("value").isNull(), "empty").otherwise("ok")
    return table(spark, folder, "events").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name, p_size FROM part WHERE regexp_matches(trim(p_size::VARCHAR), '^[45][0-9]') AND p_name IS NOT NULL AND p_name <> ''")
def postal_like_filter(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").filter(F.trim(F.col("p_size").cast("string")).rlike("^[45][0-9]") & (F.col("p_name") != "")).select("p_partkey", "p_name", "p_size")


@query("SELECT n_nationkey, n_name FROM nation WHERE lower(trim(n_name)) NOT IN ('', 'nation_3', 'ni', 'n/a', '-')")
def sentinel_filter(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").filter(~F.lower(F.trim("n_name")).isin("", "nation_3", "ni", "n/a", "-")).select("n_nationkey", "n_name")


@query("SELECT event_id, user_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS delta FROM events")
def delta_lag(spark: SparkSession, folder: str) -> DataFrame:
    return rel.delta(table(spark, folder, "events"), "user_id", "value", "event_id").select("event_id", "user_id", F.round("delta", 6).alias("delta"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS attempt, max(turn) OVER (PARTITION BY conv_id) + 1 AS next_turn FROM conversations")
def attempt_numbering(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    rows = rel.numbered(table(spark, folder, "conversations").select("conv_id", "turn"), "conv_id", "attempt", "turn")
    return rows.select("conv_id", "turn", F.col("attempt").cast("long").alias("attempt"), (F.max("turn").over(Window.partitionBy("conv_id")) + 1).alias("next_turn"))


@query("""SELECT turn, source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, source LIMIT 10""")
def interleave_sources(spark: SparkSession, folder: str) -> DataFrame:
    found = rel.interleave(table(spark, folder, "documents").select("source", "doc_id"), "source", "doc_id")
    return found.select(F.col("turn").cast("long").alias("turn"), "source", "doc_id")


@query("""WITH c AS (SELECT o_orderpriority AS region, c_name AS name, count(*) AS orders FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)
SELECT region, name, orders, count(*) OVER (PARTITION BY region) AS n FROM c""")
def names_by_region(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct names of each region and their number, a row for each: one cell would grow with the table."""
    orders = table(spark, folder, "orders").select("o_custkey", F.col("o_orderpriority").alias("region"))
    named = orders.join(table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name")), "o_custkey")
    return rel.distinct_members(named, ["region"], "name", "orders", "n")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 3)")
def orphan_check(spark: SparkSession, folder: str) -> DataFrame:
    parents = table(spark, folder, "part").filter("p_size > 3").select(F.col("p_partkey").alias("l_partkey"))
    return rel.orphans(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), parents, "l_partkey")


@query("""SELECT p.position, p.id AS c_custkey, c_name, c_name IS NULL AS missing FROM (VALUES (1, 77), (2, 3), (3, 999999), (4, 12)) p(position, id) LEFT JOIN customer ON c_custkey = p.id""")
def manifest_order(spark: SparkSession, folder: str) -> DataFrame:
    ids = spark.createDataFrame([(1, 77), (2, 3), (3, 999999), (4, 12)], "position int, c_custkey int")
    return rel.manifest(ids, table(spark, folder, "customer").select(F.col("c_custkey").cast("int").alias("c_custkey"), "c_name"), "c_custkey", "position").select("position", "c_custkey", "c_name", "missing")


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id) AS n FROM events WHERE value IS NOT NULL)
SELECT user_id, event_id, event_type FROM e WHERE n = 1""")
def keep_first(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").filter("value is not null")
    return rel.top_per_key(rows, "user_id", 1, "event_type", "event_id").select("user_id", "event_id", "event_type")
