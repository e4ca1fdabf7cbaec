"""Queries of the library's mechanisms over whole tables: automata, timed state, catalogs, quarantine, remembered aggregates, table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import udtfs
from ..operators import keywords, merge, quarantine
from ..sources.catalog import Catalog
from ..sources.partials import Partials
from ..sources.shared import shared_folder
from ..sources.tables import table
from ._registry import query
from .evidence import _DETAIL, _LD_SQL, _PAGE, _SHOWN, _pages

# Rules by automaton: the words of all documents that are long enough and whose hash ends so are the keywords

_RULES = """(SELECT w AS keyword, 'c' || length(w) % 5 AS category, (1 + length(w) % 9)::INT AS score FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM documents) WHERE length(w) >= 6 AND right(md5(w), 1) IN ('0', '8'))"""


def _rules(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "documents").select(F.explode(F.split("text", " ", -1)).alias("keyword")).distinct()
    size = F.length("keyword")
    return words.filter((size >= 6) & F.right(F.md5("keyword"), F.lit(1)).isin("0", "8")).select("keyword", F.concat(F.lit("c"), (size % 5).cast("string")).alias("category"), (1 + size % 9).alias("score"))


@query(f"""SELECT doc_id, coalesce(sum(score), 0)::BIGINT AS score, count(keyword) AS n_matches FROM documents LEFT JOIN {_RULES} ON contains(lower(text), lower(keyword)) GROUP BY doc_id""")
def keyword_automaton(spark: SparkSession, folder: str) -> DataFrame:
    """Thousands of rules, made of the corpus's own words, over all documents in one pass."""
    return keywords.score_by_rules(table(spark, folder, "documents"), "doc_id", "text", _rules(spark, folder))


# Timed state

_ACTIONS = """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS t, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
s AS (SELECT DISTINCT user_id, 0::BIGINT AS rn, 0 AS attempts, 'NONE' AS state, 0::BIGINT AS due, NULL::BIGINT AS fired, NULL::VARCHAR AS fired_as, 0 AS fired_attempts, NULL::BIGINT AS ended FROM e UNION ALL
SELECT user_id, rn, attempts, state, CASE WHEN ignored THEN before_due WHEN state = 'PENDING' THEN t + 21600000 * attempts ELSE t + 86400000 END, fired, fired_as, fired_attempts, CASE WHEN ignored OR state = 'PENDING' THEN NULL ELSE t END FROM (
 SELECT *, CASE WHEN ignored THEN before_attempts ELSE before_attempts + 1 END::INT AS attempts, CASE WHEN ignored THEN before WHEN ok THEN 'DONE' WHEN before_attempts + 1 >= 3 THEN 'ERROR' ELSE 'PENDING' END AS state FROM (
 SELECT *, before IN ('DONE', 'ERROR') AS ignored FROM (
 SELECT e.user_id, e.rn, e.t, e.ok, CASE WHEN s.due > 0 AND s.due < e.t THEN s.due END AS fired, CASE WHEN s.due > 0 AND s.due < e.t THEN CASE WHEN s.state = 'PENDING' THEN 'WAKE' ELSE 'EXPIRED' END END AS fired_as, s.attempts AS fired_attempts,
 CASE WHEN s.due > 0 AND s.due < e.t AND s.state IN ('DONE', 'ERROR') THEN 'NONE' ELSE s.state END AS before, CASE WHEN s.due > 0 AND s.due < e.t THEN 0 ELSE s.due END AS before_due, CASE WHEN s.due > 0 AND s.due < e.t AND s.state IN ('DONE', 'ERROR') THEN 0 ELSE s.attempts END AS before_attempts
 FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1)))),
x AS (SELECT user_id, max_by(due, rn) AS due, max_by(state, rn) AS state, max_by(attempts, rn) AS attempts FROM s GROUP BY user_id)
SELECT user_id, fired AS t, fired_as AS action, fired_attempts AS attempts FROM s WHERE fired IS NOT NULL UNION ALL SELECT user_id, ended, state, attempts FROM s WHERE ended IS NOT NULL
UNION ALL SELECT user_id, due, CASE WHEN state = 'PENDING' THEN 'WAKE' ELSE 'EXPIRED' END, attempts FROM x WHERE due > 0 AND due <= (SELECT max(t) - 3600000 FROM e)"""


@query(_ACTIONS)
def stream_task_actions(spark: SparkSession, folder: str) -> DataFrame:
    """Every user as a task: retries woken by timers, ends, and what is forgotten a day after."""
    from ..streaming.lifecycle import rocks, task_actions
    from .queues import _events

    base = shared_folder(spark, "stream")
    events = _events(spark, folder).withColumn("s", F.when(F.col("event_type") == "purchase", "SUCCESS").otherwise("RETRYABLE_ERROR"))
    with rocks(spark):
        made = task_actions(events, "user_id", "s", "ts", "event_id", base_minutes=360)
        made.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").format("parquet").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{base}/out")


# Catalog


@query("""WITH b AS (SELECT o_custkey AS k, max(o_totalprice) AS balance, arg_max(o_orderpriority, o_orderkey) AS segment FROM orders WHERE o_orderkey % 50 = 0 GROUP BY 1)
SELECT coalesce(k, c_custkey) AS c_custkey, c_name, CASE WHEN k % 2 = 0 THEN balance ELSE coalesce(c_acctbal, balance) END AS c_acctbal, coalesce(segment, c_mktsegment) AS c_mktsegment, (SELECT count(*) FROM b) AS merged FROM customer FULL JOIN b ON k = c_custkey""")
def catalog_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Customers and a journal of a batch of orders under one commit: only buckets that the batch touches are written anew."""
    catalog = Catalog(spark, shared_folder(spark, "catalog"))
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    with catalog.lease("first"):
        change = catalog.begin()
        change.replace("customers", customers, ["c_custkey"], 16)
        change.replace("journal", customers.select("c_custkey").limit(0), ["c_custkey"], 16)
        change.commit()
    key = F.col("o_custkey").alias("c_custkey")
    batch = table(spark, folder, "orders").filter("o_orderkey % 50 = 0").groupBy(key).agg(F.max("o_totalprice").alias("price"), F.max_by("o_orderpriority", "o_orderkey").alias("c_mktsegment"))
    fresh = batch.select("c_custkey", F.lit(None).cast("string").alias("c_name"), F.when(F.col("c_custkey") % 2 == 0, F.col("price")).alias("c_acctbal"), "c_mktsegment")
    blank = batch.filter("c_custkey % 2 <> 0").select("c_custkey", F.lit(None).cast("string").alias("c_name"), F.col("price").alias("c_acctbal"), F.lit(None).cast("string").alias("c_mktsegment"))
    with catalog.lease("second") as lease:
        change = catalog.begin(lease)
        change.merge("customers", fresh, lambda old, new: merge.coalescing_upsert(old, new, ["c_custkey"]))
        change.merge("customers", blank, lambda old, new: merge.fill_blanks(old, new, ["c_custkey"]).drop("conflicts"))
        change.merge("journal", batch.select("c_custkey"), lambda old, new: merge.insert_new(old, new, ["c_custkey"]))
        at = change.commit()
    merged = catalog.read("journal", at).agg(F.count("*").alias("merged"))
    return catalog.read("customers", at).crossJoin(merged)  # one row


# Quarantine

_AMOUNT = "CASE event_id % 7 WHEN 0 THEN 'n/a' WHEN 1 THEN ' ' WHEN 2 THEN '-' || event_id ELSE '' || event_id || '.5' END"
_DAY = "CASE WHEN event_id % 11 = 0 THEN '2024-13-01' WHEN event_id % 11 = 1 THEN NULL ELSE '2024-01-' || (10 + event_id % 20) END"


@query(f"""WITH r AS (SELECT event_id, {_AMOUNT} AS a, {_DAY} AS d FROM events), p AS (SELECT *, try_cast(nullif(trim(a), '') AS DOUBLE) AS amount, try_cast(d AS DATE) AS day FROM r)
SELECT event_id, amount, day, bad, CASE WHEN bad THEN array_to_string(list_filter([CASE WHEN amount IS NULL AND trim(a) <> '' THEN 'amount UNREADABLE ' || a END, CASE WHEN day IS NULL AND d IS NOT NULL THEN 'day UNREADABLE ' || d END, CASE WHEN amount < 0 THEN ' NEGATIVE ' END], lambda x: x IS NOT NULL), ';') ELSE '' END AS errors
FROM (SELECT *, (amount IS NULL AND trim(a) <> '') OR (day IS NULL AND d IS NOT NULL) OR coalesce(amount < 0, false) AS bad FROM p)""")
def quarantined_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All events with raw amounts and days: good rows and the quarantine, from one pass."""
    rows = table(spark, folder, "events").selectExpr("event_id", f"{_AMOUNT} AS amount_raw", f"{_DAY} AS day_raw")
    parsed = {"amount": ("amount_raw", F.col("amount_raw").try_cast("double")), "day": ("day_raw", F.col("day_raw").try_cast("date"))}
    good, bad = quarantine.split(quarantine.checked(rows, parsed, {"NEGATIVE": F.col("amount") >= 0}))
    said = F.array_join(F.transform("errors", lambda e: F.concat_ws(" ", e["field"], e["reason"], F.coalesce(e["raw"], F.lit("")))), ";")
    out = good.select("event_id", "amount", "day", F.lit(False).alias("bad"), F.lit("").alias("errors"))
    return out.unionByName(bad.select("event_id", "amount", "day", F.lit(True).alias("bad"), said.alias("errors")))


# Remembered aggregates


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY event_type")
def remembered_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of all event files by partials of each; the second update finds nothing to read."""
    measures = {"n": (F.count("*"), "sum"), "total": (F.sum("value"), "sum"), "first_id": (F.min("event_id"), "min"), "last_id": (F.max("event_id"), "max")}
    cache = Partials(spark, shared_folder(spark, "partials"), f"{folder}/events.parquet", ["event_type"], measures)
    cache.update()
    if cache.update():
        raise RuntimeError("files that did not change were read again")
    return cache.read().withColumn("total", F.round("total", 4))


# Table functions in SQL


def _view(spark: SparkSession, folder: str, name: str, columns: dict[str, str]) -> str:
    """A temporary view of a table with these columns; gives its name."""
    view = f"kelvane_{name}"
    table(spark, folder, name).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()]).createOrReplaceTempView(view)
    return view


def _page_view(spark: SparkSession, folder: str, html: str) -> str:
    _pages(spark, folder, {"id": "c_custkey", "html": html}).createOrReplaceTempView("kelvane_customer")
    return "kelvane_customer"


@query(f"SELECT page_id, kind, name, url FROM ({_LD_SQL})")
def lateral_json_ld(spark: SparkSession, folder: str) -> DataFrame:
    """What json_ld_names gives, as SQL text over a table function."""
    udtfs.register(spark)
    view = _view(spark, folder, "pages", _PAGE)
    return spark.sql(f"SELECT page_id, o.kind, o.name, o.url FROM {view} p, LATERAL page_objects(p.html) o")


@query("""SELECT page_id, count(*) AS n_links, count(*) FILTER (contains(l, 'href="/')) AS n_rooted, min(regexp_extract(l, 'href="([^"]*)"', 1)) AS first_href FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*"')) AS l FROM pages) GROUP BY page_id""")
def lateral_links(spark: SparkSession, folder: str) -> DataFrame:
    udtfs.register(spark)
    view = _view(spark, folder, "pages", {"page_id": "page_id", "html": "html"})
    return spark.sql(f"SELECT page_id, count(*) AS n_links, count_if(l.href LIKE '/%') AS n_rooted, min(l.href) AS first_href FROM {view} p, LATERAL page_links(p.html) l GROUP BY page_id")


@query("""SELECT c_custkey AS id, 'OK' AS status, c_name AS name, c_custkey || ' 4321' AS registration, 'https://r.example.com/podjetje.asp?e=' || c_custkey AS detail_url FROM customer WHERE c_custkey % 4 > 1
UNION ALL SELECT c_custkey, 'OK', 'druga', '77', NULL FROM customer WHERE c_custkey % 4 = 3 UNION ALL SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'NO_RESULT' ELSE 'LOGIN_REQUIRED' END, NULL, NULL, NULL FROM customer WHERE c_custkey % 4 < 2""")
def lateral_registry_search(spark: SparkSession, folder: str) -> DataFrame:
    udtfs.register(spark)
    view = _page_view(spark, folder, _SHOWN)
    return spark.sql(f"SELECT id, c.status, c.name, c.registration, c.detail_url FROM {view} p, LATERAL registry_candidates(p.html, 'https://r.example.com/') c")


@query("""SELECT c_custkey AS id, section, label, value FROM customer, LATERAL (SELECT * FROM (VALUES ('company', 'Firma', c_name || ' d.o.o.'), ('company', 'Poslovni naslov', 'Cesta ' || c_custkey), ('REPRESENTATIVE', 'Naslov', 'Doma ' || c_custkey), ('shares', 'Zap. št. deleža', '' || c_custkey)) t(section, label, value))""")
def lateral_registry_fields(spark: SparkSession, folder: str) -> DataFrame:
    udtfs.register(spark)
    view = _page_view(spark, folder, _DETAIL)
    wanted = "(f.section = 'company' AND f.label IN ('Firma', 'Poslovni naslov')) OR (f.section = 'REPRESENTATIVE' AND f.label = 'Naslov') OR (f.section = 'shares' AND f.label = 'Zap. št. deleža')"
    return spark.sql(f"SELECT id, f.section, f.label, f.value FROM {view} p, LATERAL registry_fields(p.html) f WHERE {wanted}")
