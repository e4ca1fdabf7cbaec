"""Stored evidence judged again: what the present rules no longer bear out goes, and every change is journalled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import merge, ownership


def reassess(sites: DataFrame, mails: DataFrame, pages: DataFrame, key: str = "company_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sites, mails, journal) after judging stored evidence by the present rules; nothing is fetched.

    ``sites`` (key, website_status, relationship, scope) are the stored verdicts, ``pages`` the evidence that
    ``ownership.evaluate_ownership`` reads, ``mails`` the stored addresses with what ``ownership.email_attribution``
    reads but for status and scope, which the new verdicts give. Companies without evidence keep their verdict.
    Addresses that are no longer attributable go. The journal has a row for each change (table, keys, action, before,
    after), as JSON.
    """
    found = ownership.evaluate_ownership(pages, key).select(key, F.col("status").alias("new_status"), F.col("relationship").alias("new_relationship"), F.col("scope").alias("new_scope"))
    judged = sites.join(found, key, "left")
    after = judged.select(key, *[F.coalesce(f"new_{n}", c).alias(c) for n, c in (("status", "website_status"), ("relationship", "relationship"), ("scope", "scope"))])
    verdicts = after.select(key, F.col("website_status").alias("status"), "scope")
    kept = ownership.email_attribution(mails.join(verdicts, key, "left"))
    retained = kept.filter("attributable").select(*mails.columns)
    journal = merge.changes(sites, after, [key]).select(F.lit("sites").alias("of"), F.col(key), F.lit("").alias("email"), "action", "before", "after")
    gone = kept.filter("not attributable").select(F.lit("mails").alias("of"), key, "email", F.lit("DELETE").alias("action"), F.to_json(F.struct("email", "reason", "source_url")).alias("before"), F.lit(None).cast("string").alias("after"))
    return after, retained, journal.unionByName(gone)
