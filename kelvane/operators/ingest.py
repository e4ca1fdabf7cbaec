"""Ingest of nested company records into the normalised tables, as new snapshots.

A record is (source, external_id, canonical_name, registration_number, tax_number, address, observed_at, raw_json,
seq, facts[], people[{full_name, email, linkedin_url, roles[]}], ownership[]). Every table is one explode and one
merge; nothing is looked up row by row. Ingesting the same batch twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.text import squeeze
from . import identity, merge
from .relational import top_per_key

RECORD = (
    "source string, external_id string, canonical_name string, registration_number string, tax_number string, address string, observed_at string, raw_json string, seq long, "
    "facts array<struct<fact_key: string, value_text: string, value_number: double, value_year: int>>, "
    "people array<struct<full_name: string, email: string, linkedin_url: string, roles: array<struct<role_type: string, title: string, source_role_id: string, valid_from: string, valid_to: string>>>>, "
    "ownership array<struct<owner_raw_name: string, owner_type: string, source_share_id: string, share_percent: double, valid_from: string, valid_to: string>>"
)
TABLES = {
    "companies": "company_id string, canonical_name string, registration_number string, tax_number string, address string",
    "source_records": "company_id string, source string, external_id string, raw_hash string, raw_json string, seq long",
    "observations": "company_id string, source string, source_record_id string, fact_key string, value_text string, value_number double, value_year int, seq long",
    "people": "person_id string, full_name string, email string, linkedin_url string",
    "roles": "company_id string, person_id string, role_type string, title string, source_role_id string, valid_from string, valid_to string",
    "ownership": "company_id string, owner_raw_name string, owner_type string, source_share_id string, share_percent double, valid_from string, valid_to string",
    "conflicts": "identifier_type string, identifier_value string, entity_a string, entity_b string, details string",
}


def ingest(records: DataFrame, tables: dict[str, DataFrame], keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """New snapshots of all tables, and ``current_facts``. ``keep`` is applied to what several tables are derived from (a checkpoint, say)."""
    old = dict(tables)
    rows = records.withColumns({"registration_number": ids.digits(F.col("registration_number")), "tax_number": ids.tax_number(F.col("tax_number"))})
    found = identity.resolve_two(rows, old["companies"], "company_id", "registration_number", "tax_number")
    # digests and ids are most of a row's bytes: they are made where they are used, and those of a conflict kept for conflicts
    found = keep(found.withColumns({c: F.when(F.col("conflict"), F.col(c)) for c in ("by_first", "by_second")}))
    journal = identity.conflict_journal(found, "registration_number", "tax_number")
    # new companies are known by their registration number, else by their tax number
    key = F.when(F.col("registration_number").isNotNull(), ids.entity_key(F.lit("reg"), F.col("registration_number"))).when(F.col("tax_number").isNotNull(), ids.entity_key(F.lit("tax"), F.col("tax_number")))
    known = found.filter("not conflict").withColumn("company_id", F.coalesce("company_id", key)).filter("company_id is not null").withColumn("raw_hash", F.sha2("raw_json", 256))

    latest = known.groupBy("company_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in ("canonical_name", "registration_number", "tax_number", "address")])
    companies = merge.fill_blanks(old["companies"], latest.select(*old["companies"].columns), ["company_id"]).drop("conflicts")
    archived = known.select("company_id", "source", "external_id", "raw_hash", "raw_json", "seq")
    source_records = merge.insert_null_safe(old["source_records"], archived, ["source", "external_id", "raw_hash"], "seq")

    record_id = ids.entity_key(F.col("source"), F.col("external_id"), F.col("raw_hash")).alias("source_record_id")
    facts = known.select("company_id", "source", record_id, F.explode("facts").alias("f"), "seq").select("company_id", "source", "source_record_id", "f.*", "seq").select(*old["observations"].columns)
    observations = merge.insert_null_safe(old["observations"], facts, ["source_record_id", "fact_key", "value_year"], "seq")
    again = old["observations"].unionByName(facts)  # a fact that is seen again becomes current again

    who = known.select("company_id", F.explode("people").alias("p")).select("company_id", squeeze(F.col("p.full_name")).alias("full_name"), ids.email(F.col("p.email")).alias("email"), ids.linkedin_url(F.col("p.linkedin_url")).alias("linkedin_url"), "p.roles")
    placed = identity.resolve_people(who, old["people"])
    own = ids.entity_key(F.coalesce("linkedin_url", "email", F.concat_ws("|", "company_id", F.lower("full_name"))))
    placed = keep(placed.withColumn("person_id", F.coalesce("person_id", own)))
    # one person's columns come from one record: the one that says most, then the first by its values
    said = F.struct(*[F.col(c).isNull().cast("int").alias(f"no_{c}") for c in ("linkedin_url", "email", "full_name")], *[F.coalesce(c, F.lit("")).alias(c) for c in ("full_name", "email", "linkedin_url")])
    one = placed.groupBy("person_id").agg(F.min_by(F.struct("full_name", "email", "linkedin_url"), said).alias("p")).select("person_id", "p.*")
    people = merge.fill_blanks(old["people"], one, ["person_id"]).drop("conflicts")
    roles = placed.select("company_id", "person_id", F.explode("roles").alias("r")).select("company_id", "person_id", "r.*").select(*old["roles"].columns)
    roles = _least(roles, ["company_id", "person_id", "role_type", "title", "source_role_id"])
    shares = known.select("company_id", F.explode("ownership").alias("o")).select("company_id", "o.*").select(*old["ownership"].columns)
    shares = _least(shares, ["company_id", "source_share_id", "owner_raw_name"])
    return {
        "companies": companies, "source_records": source_records, "observations": observations, "people": people,
        "roles": merge.coalescing_upsert(old["roles"], roles, ["company_id", "person_id", "role_type", "title", "source_role_id"]),
        "ownership": merge.coalescing_upsert(old["ownership"], shares, ["company_id", "source_share_id", "owner_raw_name"]),
        "conflicts": old["conflicts"].unionByName(journal).distinct(),
        "current_facts": merge.current_facts(again.drop("source_record_id")),
    }


def _least(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row of each key: the least by its other columns in turn."""
    return top_per_key(rows, key, 1, *[F.col(c).asc_nulls_last() for c in rows.columns if c not in key])


def import_statistics(outcomes: DataFrame, status: str) -> DataFrame:
    """One row: resolved, unresolved, duplicate and failed rows of an import."""
    s = F.col(status)
    return outcomes.agg(F.count_if(s == "imported/resolved").alias("resolved"), F.count_if(s == "imported/unresolved").alias("unresolved"), F.count_if(s == "skipped/duplicate").alias("duplicates"), F.count_if(s == "error").alias("errors"))
