"""Identity resolution: incoming rows against known entities by several identifiers.

A condition ``a = x OR b = y`` would be a nested loop over all pairs. Identifiers are unpivoted to (kind, value)
instead, so it is one equi join and one aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import entity_key


def identifiers(df: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """(key, kind, value) of the identifiers that are not null."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("value")) for k, c in columns.items()])
    return df.select(key, F.explode(kinds).alias("i")).select(key, "i.kind", "i.value").filter("value is not null")


def resolve(batch: DataFrame, known: DataFrame, key: str, entity: str, columns: dict[str, Column]) -> DataFrame:
    """``key``, matches, entity and outcome (RESOLVED, NEW, CONFLICT, NO_IDENTIFIER) of each row of a batch."""
    mine = identifiers(batch, key, columns)
    theirs = identifiers(known, entity, columns)
    hits = mine.join(theirs, ["kind", "value"]).groupBy(key).agg(F.count_distinct(entity).alias("matches"), F.min(entity).alias("__entity"))
    have = mine.groupBy(key).agg(F.count("*").alias("__given"))
    out = batch.select(key).join(have, key, "left").join(hits, key, "left")
    outcome = F.when(F.col("__given").isNull(), "NO_IDENTIFIER").when(F.col("matches").isNull(), "NEW").when(F.col("matches") > 1, "CONFLICT").otherwise("RESOLVED")
    return out.select(key, F.coalesce("matches", F.lit(0).cast("long")).alias("matches"), F.when(F.col("matches") == 1, F.col("__entity")).alias(entity), outcome.alias("outcome"))


def resolve_two(batch: DataFrame, known: DataFrame, entity: str, first: str, second: str) -> DataFrame:
    """``batch`` with the entity found by the first identifier, else by the second; disagreement is a conflict."""
    one = known.filter(F.col(first).isNotNull()).groupBy(first).agg(F.min(entity).alias("__one"))
    two = known.filter(F.col(second).isNotNull()).groupBy(second).agg(F.min(entity).alias("__two"))
    joined = batch.join(one, first, "left").join(two, second, "left")
    clash = F.coalesce(F.col("__one") != F.col("__two"), F.lit(False))
    return joined.select(*batch.columns, F.when(~clash, F.coalesce("__one", "__two")).alias(entity), clash.alias("conflict"), F.col("__one").alias("by_first"), F.col("__two").alias("by_second"))


def create(new: DataFrame, columns: Sequence[str], entity: str) -> DataFrame:
    """New entities with a stable key made of their identifiers: the same input gives the same keys on any cluster."""
    return new.withColumn(entity, entity_key(*[F.col(c) for c in columns])).dropDuplicates([entity])


def conflict_journal(resolved: DataFrame, first: str, second: str) -> DataFrame:
    """Journal rows of two-identifier conflicts."""
    return resolved.filter("conflict").select(F.lit(first).alias("identifier_type"), F.col(first).alias("identifier_value"), F.col("by_first").alias("entity_a"), F.col("by_second").alias("entity_b"), F.to_json(F.struct(first, second)).alias("details"))


def resolve_people(batch: DataFrame, people: DataFrame) -> DataFrame:
    """``batch`` (linkedin_url, email) with person_id: by profile; else by e-mail, but only if exactly one person has it."""
    by_profile = people.filter("linkedin_url is not null").groupBy("linkedin_url").agg(F.min("person_id").alias("__a"))
    by_email = people.filter("email is not null").groupBy("email").agg(F.min("person_id").alias("__b"), F.count("*").alias("__n")).filter("__n = 1").drop("__n")
    return batch.join(by_profile, "linkedin_url", "left").join(by_email, "email", "left").select(*batch.columns, F.coalesce("__a", "__b").alias("person_id"))


def import_gate(status: Column, has_id: Column, exists: Column) -> Column:
    """struct(ingest, error_type) of a matched row: confirmed rows need an identifier, rows under review must exist already."""
    error = (
        F.when((status == "CONFIRMED") & ~has_id, "UNRESOLVED_IDENTITY").when((status == "REVIEW") & ~exists, "REVIEW_HELD")
        .when(status == "ERROR", "SOURCE_ROW_ERROR").when(status == "NO_MATCH", "NO_MATCH").when(~F.coalesce(status.isin("CONFIRMED", "REVIEW"), F.lit(False)), "UNKNOWN_MATCH_STATUS")
    )
    return F.struct(error.isNull().alias("ingest"), error.alias("error_type"))


def ownership_edges(shares: DataFrame, owners: DataFrame, company: str = "company_id") -> DataFrame:
    """Owner edges from shares whose holders are ids in a text; a share that names none goes to the only owner, if there is just one.

    Both sides may be parsed from pages, which are many more bytes than estimates say: they are merged, never broadcast.
    """
    ids = F.transform(F.regexp_extract_all("holders", F.lit(r"(?i)Zap\.?\s*št\.?\s*družbenika\s*(\d+)"), F.lit(1)), lambda x: x)
    single = owners.groupBy(company).agg(F.count("*").alias("n"), F.min("shareholder_id").alias("only")).filter("n = 1").select(company, "only")
    named = shares.join(single.hint("merge"), company, "left").withColumn("__ids", F.when(F.size(ids) > 0, ids).when(F.col("only").isNotNull(), F.array("only")))
    return named.withColumn("shareholder_id", F.explode("__ids")).drop("__ids", "only").join(owners.hint("merge"), [company, "shareholder_id"])
