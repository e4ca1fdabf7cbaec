"""Queue, quota, breaker and workload queries, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import jobs
from ..operators import relational as rel
from ..sources.shared import shared_folder
from ..sources.tables import table
from ..streaming import latest_status, quota_use, task_states
from ._registry import query

_ISLANDS = "SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events"
_RUNS = f"SELECT *, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, island ORDER BY event_id) AS run_length FROM ({_ISLANDS})"


@query(f"SELECT event_id, user_id, CAST(run_length AS BIGINT) AS run_length FROM ({_RUNS})")
def circuit_breaker_runs(spark: SparkSession, folder: str) -> DataFrame:
    return rel.failure_runs(table(spark, folder, "events"), "user_id", F.col("event_type") == "error", "event_id").select("event_id", "user_id", "run_length")


@query(f"""SELECT user_id, count(*) AS processed, bool_or(run_length >= 3) AS tripped FROM (SELECT *, coalesce(max((run_length >= 3)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({_RUNS})) WHERE before = 0 GROUP BY user_id""")
def circuit_breaker_stop(spark: SparkSession, folder: str) -> DataFrame:
    kept = rel.before_trip(table(spark, folder, "events"), "user_id", F.col("event_type") == "error", 3, "event_id")
    return kept.groupBy("user_id").agg(F.count("*").alias("processed"), F.bool_or("interrupted").alias("tripped"))


@query("SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY event_id) AS used, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY event_id) <= 40 AS allowed FROM events")
def daily_quota(spark: SparkSession, folder: str) -> DataFrame:
    used = rel.within_quota(table(spark, folder, "events").select("event_id", "event_type", "ts"), "event_type", F.to_date("ts"), 40, "event_id")
    return used.select("event_id", "event_type", F.col("used").cast("long").alias("used"), "allowed")


@query("""SELECT o_orderkey AS id, position FROM (SELECT o_orderkey, row_number() OVER (ORDER BY CAST(left(o_orderpriority, 1) AS INTEGER), o_orderdate, o_orderkey) AS position FROM (
SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY CAST(left(o_orderpriority, 1) AS INTEGER), o_orderdate, o_orderkey) AS nth FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 3 <> 0) WHERE nth <= CASE o_orderstatus WHEN 'F' THEN 30 ELSE 15 END) WHERE position <= 40""")
def task_claim_order(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    tasks = table(spark, folder, "orders").select(
        k.alias("id"), F.col("o_orderstatus").alias("source"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_orderdate").alias("created_at"),
        F.when(k % 3 == 0, "DONE").otherwise("PENDING").alias("status"), F.lit(0).alias("attempts"), F.lit(3).alias("max_attempts"), F.lit(None).cast("timestamp_ntz").alias("not_before"),
    )
    budgets = spark.createDataFrame([("F", 50, True), ("O", 15, True), ("P", 10, False)], "source string, daily_limit int, enabled boolean")
    used = spark.createDataFrame([("F", 20)], "source string, used_count int")
    now = F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")
    found = jobs.claim(tasks, now, budgets, used, 40)
    return found.select("id", F.row_number().over(Window.orderBy("priority", "created_at", "id")).cast("long").alias("position"))


@query("SELECT c_custkey, max(o_orderdate) AS last_done, coalesce(max(o_orderdate) < TIMESTAMP '2001-06-01', true) AS due FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def freshness_due(spark: SparkSession, folder: str) -> DataFrame:
    done = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate")
    return jobs.due(table(spark, folder, "customer").select("c_custkey"), done, "c_custkey", "o_orderdate", F.lit("2001-06-01 00:00:00").cast("timestamp_ntz"))


_ATTEMPTS = """WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'purchase' THEN 'SUCCESS' ELSE 'RETRYABLE_ERROR' END AS s FROM events),
l AS (SELECT * FROM (SELECT *, coalesce(max((s = 'SUCCESS')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS attempt FROM e) WHERE done = 0 AND attempt <= 3),
g AS (SELECT user_id, max(attempt) AS attempts, max_by(s, attempt) AS last_status, max_by(ts, attempt) AS last_ts FROM l GROUP BY 1)
SELECT user_id, attempts, CASE WHEN last_status = 'SUCCESS' THEN 'DONE' WHEN attempts >= 3 THEN 'ERROR' ELSE 'PENDING' END AS task_status"""


@query(_ATTEMPTS + """, CASE WHEN last_status <> 'SUCCESS' AND attempts < 3 THEN last_ts + INTERVAL 15 MINUTE * attempts END AS not_before FROM g""")
def retry_backoff_fold(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").withColumn("s", F.when(F.col("event_type") == "purchase", "SUCCESS").otherwise("RETRYABLE_ERROR"))
    return jobs.retry_fold(events, "user_id", "s", "ts", "event_id").select("user_id", "attempts", "task_status", "not_before")


@query("""WITH sel AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 = 0), comp AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 6 = 0), p AS (SELECT id FROM sel WHERE id NOT IN (SELECT id FROM comp))
SELECT count(*) AS batch_remaining, count(*) FILTER (id NOT IN (SELECT user_id FROM events)) AS uncovered, greatest(500 - count(*) FILTER (id NOT IN (SELECT user_id FROM events)), 0) AS remaining_after_batch FROM p""")
def workload_estimate(spark: SparkSession, folder: str) -> DataFrame:
    ids = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"))
    return jobs.workload(ids.filter("id % 3 = 0"), ids.filter("id % 6 = 0"), table(spark, folder, "events").select(F.col("user_id").alias("id")), "id", 500)


@query("""WITH l AS (SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1)
SELECT c_custkey FROM customer LEFT JOIN l ON user_id = c_custkey WHERE event_type IS NULL OR event_type IN ('error') ORDER BY c_custkey LIMIT 150""")
def work_selection(spark: SparkSession, folder: str) -> DataFrame:
    history = table(spark, folder, "events").select(F.col("user_id").alias("c_custkey"), "event_id", F.when(F.col("event_type") == "error", "ERROR").otherwise("VERIFIED").alias("status"))
    return jobs.work_selection(table(spark, folder, "customer").select("c_custkey"), history, "c_custkey", "event_id", retry=True, limit=150)


@query("SELECT CASE WHEN event_type = 'error' THEN 'retry' ELSE 'ok' END AS kind, count(*) AS n, count(*) FILTER (value > 20) AS with_value, round(sum(value), 3) AS total FROM events GROUP BY 1")
def batch_summary_rows(spark: SparkSession, folder: str) -> DataFrame:
    message = F.when(F.col("event_type") == "error", "urllib: Connection refused by host").otherwise("")
    kind = F.when(jobs.infrastructure_failure(message), "retry").otherwise("ok")
    return table(spark, folder, "events").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 20).alias("with_value"), F.round(F.sum("value"), 3).alias("total"))


@query("SELECT user_id, md5(string_agg(event_id || ':' || event_type, ',' ORDER BY event_id)) AS signature FROM events WHERE user_id % 2 = 0 GROUP BY user_id")
def changed_inputs(spark: SparkSession, folder: str) -> DataFrame:
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda e: F.concat_ws(":", e["event_id"].cast("string"), e["event_type"]))
    now = table(spark, folder, "events").groupBy("user_id").agg(F.md5(F.array_join(pairs, ",")).alias("signature"))
    return jobs.changed_inputs(now, now.filter("user_id % 2 <> 0"), "user_id", "signature")


def _drained(stream: DataFrame, spark: SparkSession, key: str, seq: str | None, mode: str = "update") -> DataFrame:
    """Run a stream over what is there and give each key's last row."""
    base = shared_folder(spark, "stream")

    def save(batch: DataFrame, n: int) -> None:
        batch.withColumn("__batch", F.lit(n)).write.mode("overwrite").parquet(f"{base}/out/b={n}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    out = spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out").drop("b")
    return rel.latest_per_key(out, key, "__batch").drop("__batch") if seq is None else rel.latest_per_key(out, key, "__batch", seq).drop("__batch")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{folder}/events.parquet*")


@query("SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def stream_latest_status(spark: SparkSession, folder: str) -> DataFrame:
    return _drained(latest_status(_events(spark, folder), "user_id", "event_type", "event_id"), spark, "user_id", None)


@query("SELECT event_type, ts::DATE AS day, count(*) AS used, least(count(*), 40) AS allowed FROM events GROUP BY 1, 2")
def stream_quota(spark: SparkSession, folder: str) -> DataFrame:
    found = quota_use(_events(spark, folder).withColumn("ts", F.col("ts").cast("timestamp")), "event_type", "ts", 40)
    keyed = found.withColumn("k", F.concat_ws("|", "event_type", F.col("day").cast("string")))
    return _drained(keyed, spark, "k", None).select("event_type", "day", "used", "allowed")


@query(_ATTEMPTS + " FROM g")
def stream_task_states(spark: SparkSession, folder: str) -> DataFrame:
    events = _events(spark, folder).withColumn("s", F.when(F.col("event_type") == "purchase", "SUCCESS").otherwise("RETRYABLE_ERROR")).select("user_id", "s", "event_id")
    return _drained(task_states(events, "user_id", "s", "event_id"), spark, "user_id", None)
