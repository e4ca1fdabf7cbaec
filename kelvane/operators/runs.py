"""Runs over a frozen manifest: integrity, attempts, resume, and validation of what is published."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import eligibility


def start(companies: DataFrame, key: str, name: str, position: str) -> DataFrame:
    """A run's rows: position, a JSON snapshot of each company's identity with its digest, eligibility and first status."""
    fields = sorted(c for c in companies.columns if c != position)
    snapshot = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    rows = companies.select(key, position, snapshot.alias("identity_json"), F.sha2(snapshot, 256).alias("identity_hash"), eligibility(F.col(name)).alias("e"))
    return rows.select(key, position, "identity_json", "identity_hash", F.col("e.status").alias("eligibility_status"), F.col("e.reason").alias("eligibility_reason"), F.when(F.col("e.status") == "INELIGIBLE", "INELIGIBLE").otherwise("PENDING").alias("status"))


def manifest_hash(run: DataFrame, position: str) -> DataFrame:
    """One row: a digest of the run's identities by position. Each row is hashed with its place and the hashes are added, so no row order or single task is needed."""
    part = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col(position).cast("string"), "identity_hash"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return run.agg(F.count("*").alias("companies"), F.coalesce(F.sum(part), F.lit(0).cast("decimal(38,0)")).cast("string").alias("manifest_hash"))


def check(run: DataFrame, position: str, expected: dict[str, object]) -> None:
    """Refuse to go on if the manifest is not the one that was started, or if a row's snapshot was changed."""
    if not run.filter(F.sha2("identity_json", 256) != F.col("identity_hash")).isEmpty():
        raise ValueError("a company's snapshot was changed")
    found = manifest_hash(run, position).first().asDict()
    if found != expected:
        raise ValueError(f"the manifest differs: {found}, expected {expected}")


def remaining(run: DataFrame, attempts: DataFrame, key: str) -> DataFrame:
    """Eligible companies without a completed attempt, with the number of their next one; a running attempt counts as interrupted."""
    done = attempts.filter(F.col("status") == "COMPLETED").select(key).distinct()
    last = attempts.groupBy(key).agg(F.max("attempt_number").alias("__n"))
    return run.filter("eligibility_status = 'ELIGIBLE'").join(done, key, "left_anti").join(last, key, "left").withColumn("attempt_number", F.coalesce("__n", F.lit(0)) + 1).drop("__n")


def interrupted(attempts: DataFrame) -> DataFrame:
    return attempts.withColumn("status", F.when(F.col("status") == "RUNNING", "INTERRUPTED").otherwise(F.col("status")))


def invalid_contacts(contacts: DataFrame, observations: DataFrame, context: list[str]) -> DataFrame:
    """Contacts with a reference that is not an observation of the same attempt with their kind and value, or whose primary one is not among them."""
    refs = contacts.select(*context, "kind", "normalized_value", F.explode("supporting").alias("observation_id"))
    seen = observations.select(*context, "observation_id", F.regexp_replace("observation_type", "_CANDIDATE$", "").alias("kind"), "normalized_value")
    bad = refs.join(seen, [*context, "observation_id", "kind", "normalized_value"], "left_anti").select(*context, "kind", "normalized_value")
    lone = contacts.filter(~F.array_contains("supporting", F.col("primary_observation_id"))).select(*context, "kind", "normalized_value")
    return bad.unionByName(lone).distinct()


def invalid_defaults(defaults: DataFrame) -> DataFrame:
    return defaults.filter((F.col("status") != "ATTRIBUTED") | (F.col("role") == "PERSON"))


def current_results(results: DataFrame, run: DataFrame, context: list[str]) -> DataFrame:
    """Results of the attempt that each company of a run has selected."""
    return results.join(run.select(*context), context)


@contextmanager
def deadline(spark: SparkSession, seconds: float) -> Iterator[str]:
    """Jobs started inside are cancelled after so many seconds."""
    group = uuid.uuid4().hex
    spark.addTag(group)
    timer = threading.Timer(seconds, spark.interruptTag, [group])
    timer.start()
    try:
        yield group
    finally:
        timer.cancel()
        spark.removeTag(group)


def ledger(job_type: str, source: str, run: Callable[[], dict[str, int]], spark: SparkSession) -> DataFrame:
    """Run a job and give its ledger row: status, counts and times."""
    import datetime

    began = datetime.datetime.now(datetime.timezone.utc)
    try:
        counts, status, error = run(), "FINISHED", None
    except Exception as e:
        counts, status, error = {}, "FAILED", str(e)
    return spark.createDataFrame([(uuid.uuid4().hex, job_type, source, status, counts.get("processed", 0), counts.get("errors", 0), error, began, datetime.datetime.now(datetime.timezone.utc))], "job_id string, job_type string, source string, status string, processed_items int, error_count int, error_message string, started_at timestamp, finished_at timestamp")
