"""Queues, quotas, retries and runs, in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import latest_per_key


def claimable(tasks: DataFrame, now: Column, budgets: DataFrame | None = None) -> DataFrame:
    """Pending tasks with attempts left whose time has come and whose source is enabled (sources without a budget are)."""
    fit = tasks.filter((F.col("status") == "PENDING") & (F.col("attempts") < F.col("max_attempts")) & (F.col("not_before").isNull() | (F.col("not_before") <= now)))
    if budgets is None:
        return fit
    return fit.join(budgets.select("source", F.col("enabled").alias("__on")), "source", "left").filter(F.coalesce("__on", F.lit(True))).drop("__on")


def claim(tasks: DataFrame, now: Column, budgets: DataFrame, used: DataFrame, n: int) -> DataFrame:
    """The next n tasks in queue order (priority, created_at, id) that their sources' remaining daily budgets allow.

    budgets: source, daily_limit (null: none), enabled. used: source, used_count of today.
    """
    fit = claimable(tasks, now, budgets).join(budgets.select("source", "daily_limit"), "source", "left").join(used.select("source", "used_count"), "source", "left")
    order = [F.col("priority").asc(), F.col("created_at").asc(), F.col("id").asc()]
    nth = F.row_number().over(Window.partitionBy("source").orderBy(*order))
    left = F.col("daily_limit") - F.coalesce("used_count", F.lit(0))
    # no source gives more than n: with a literal bound, Spark drops the rest before it shuffles
    first = fit.withColumn("__n", nth).filter(F.col("__n") <= n)
    allowed = first.filter(F.col("daily_limit").isNull() | (F.col("__n") <= left))
    return allowed.drop("__n", "daily_limit", "used_count").orderBy(*order).limit(n)


def released(tasks: DataFrame, leased: tuple[str, ...] = ("claimed_by", "lease_until")) -> DataFrame:
    """Tasks whose lease columns are emptied where they are pending: nobody holds them."""
    return tasks.withColumns({c: F.when(F.col("status") != "PENDING", F.col(c)) for c in leased})


def retry_fold(events: DataFrame, key: str, status: str, ts: str, *order: str, base_minutes: int = 15, max_attempts: int = 3) -> DataFrame:
    """The state of each task after its ordered results: attempts, status and earliest next time.

    A success ends a task; a retryable error puts it off by base * attempt minutes until attempts are used up.
    """
    w = Window.partitionBy(key).orderBy(*order)
    done = F.max((F.col(status) == "SUCCESS").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    live = events.withColumn("__done", F.coalesce(done, F.lit(0))).filter("__done = 0").withColumn("attempt", F.row_number().over(w)).filter(F.col("attempt") <= max_attempts)
    last = live.groupBy(key).agg(F.max("attempt").alias("attempts"), F.max_by(status, "attempt").alias("last_status"), F.max_by(ts, "attempt").alias("last_ts"))
    failed = F.col("last_status") != "SUCCESS"
    out = F.when(~failed, "DONE").when(F.col("attempts") >= max_attempts, "ERROR").otherwise("PENDING")
    wait = F.make_dt_interval(F.lit(0), F.lit(0), base_minutes * F.col("attempts"))
    return last.withColumn("task_status", out).withColumn("not_before", F.when(F.col("task_status") == "PENDING", F.col("last_ts") + wait))


def due(entities: DataFrame, tasks: DataFrame, key: str, finished: str, cutoff: Column) -> DataFrame:
    """``entities`` with last_done and due: never done, or done before the cutoff."""
    last = tasks.groupBy(key).agg(F.max(finished).alias("last_done"))
    return entities.join(last, key, "left").withColumn("due", F.col("last_done").isNull() | (F.col("last_done") < cutoff))


def work_selection(companies: DataFrame, history: DataFrame, key: str, seq: str, wanted: DataFrame | None = None, retry: bool = False, force: bool = False, limit: int = 20) -> DataFrame:
    """Companies to process: without history, interrupted, or (with ``retry``) in error; a wanted list restricts and orders them."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be from 1 to 200")
    last = latest_per_key(history, key, seq).select(key, F.col("status").alias("__last"))
    rows = companies.join(last, key, "left")
    fit = F.col("__last").isNull() | (F.col("__last") == "INTERRUPTED") | (F.lit(retry) & F.col("__last").isin("ERROR", "NOT_FOUND")) | F.lit(force)
    rows = rows.filter(fit).drop("__last")
    if wanted is not None:
        return rows.join(wanted, key).orderBy("position").limit(limit)
    return rows.orderBy(key).limit(limit)


def report_state(triggered: Column, complete: Column, interrupted: Column) -> Column:
    on = lambda c: F.coalesce(c, F.lit(False))
    return F.when(on(triggered), "circuit-breaker").when(on(complete), "complete").when(on(interrupted), "interrupted").otherwise("incomplete")


def report_valid(selected: Column, completed: Column) -> Column:
    """Both lists are there and free of repeats, and all that is completed was selected."""
    unique = lambda a: F.size(F.array_distinct(a)) == F.size(a)
    return F.coalesce(unique(selected) & unique(completed) & (F.size(F.array_except(completed, selected)) == 0), F.lit(False))


def workload(selected: DataFrame, completed: DataFrame, processed: DataFrame, key: str, remaining: Column | int) -> DataFrame:
    """One row: batch_remaining, uncovered (pending without any result) and what will remain after the batch."""
    left = selected.select(key).distinct().join(completed.select(key), key, "left_anti")
    fresh = left.join(processed.select(key).distinct().withColumn("__seen", F.lit(1)), key, "left")
    rest = F.lit(remaining) if isinstance(remaining, int) else remaining
    return fresh.agg(F.count("*").alias("batch_remaining"), F.count_if(F.col("__seen").isNull()).alias("uncovered")).withColumn("remaining_after_batch", F.greatest(rest - F.col("uncovered"), F.lit(0)))


#: Parts of messages that mean that the network failed, as fixed values.
INFRASTRUCTURE = (
    "dns error", "nameresolutionerror", "failed to resolve", "nodename nor servname", "name or service not known", "temporary failure in name resolution",
    "connecterror", "connectionerror", "connection refused", "connection reset", "no connections available", "network is unreachable", "transporterror",
    "proxyerror", "sslerror", "tls handshake", "timeout", "timed out",
)


def infrastructure_failure(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.greatest(*[low.contains(t) for t in INFRASTRUCTURE])


def batch_summary(results: DataFrame, status: str, emails: str, requests: str) -> DataFrame:
    """One row: a status histogram, companies with e-mails, and summed requests."""
    by = results.groupBy(status).agg(F.count("*").alias("n"), F.count_if(F.col(emails) > 0).alias("e"), F.sum(requests).alias("r"))
    return by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(status, "n")))).alias("statuses"), F.sum("e").alias("companies_with_emails"), F.sum("r").alias("requests"))


def changed_inputs(inputs: DataFrame, memo: DataFrame, key: str, signature: str) -> DataFrame:
    """Inputs whose signature is not the remembered one: only these need computing again."""
    return inputs.join(memo.select(key, signature), [key, signature], "left_anti")


class Adapters:
    """Named DataFrame transforms by (source, task type)."""

    def __init__(self) -> None:
        self._known: dict[tuple[str, str], object] = {}

    def register(self, source: str, task_type: str, transform) -> None:
        if (source, task_type) in self._known:
            raise ValueError(f"already registered: {source}/{task_type}")
        self._known[source, task_type] = transform

    def get(self, source: str, task_type: str):
        return self._known.get((source, task_type))

    def run(self, tasks: DataFrame) -> DataFrame:
        """Each registered transform over its own tasks, united."""
        out = None
        for (source, kind), transform in sorted(self._known.items()):
            part = transform(tasks.filter((F.col("source") == source) & (F.col("task_type") == kind)))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return tasks.limit(0) if out is None else out
