"""Contacts resolved from observations: attribution, ranking and defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import emails, text
from .ownership import CREDITS, any_in
from .relational import top_per_key

#: Context words as fixed values; contexts are folded before they are searched, so those with diacritics only serve raw text.
GENERAL = ("glavni", "main", "centrala", "switchboard", "centralni", "splošni", "splosni")
GENERAL_EMAIL = ("general company contact", "general contact", "splošni kontakt", "splosni kontakt", "glavni kontakt", "centralni kontakt")
OFFICE = ("pisarna", "office", "recepcija", "reception", "tajništvo", "tajnistvo")
SALES = ("prodaja", "sales", "komerciala")
DEPARTMENT = ("oddelek", "department", "servis", "support", "računovodstvo", "racunovodstvo", "nabava", "marketing")
MOBILE = ("mobilni", "mobile", "gsm", "direktor", "vodja", "manager")
TRANSACTIONAL = ("vračil", "vracil", "returns", "reklamacij", "orders", "naročil", "narocil", "transaction")
LEGAL = ("zasebnost", "privacy", "legal", "pravna", "gdpr", "pooblaščen", "pooblascen")
FOREIGN = ("foreign office", "foreign branch", "podružnica", "podruznica", "subsidiary", "office in", "pisarna v", "foreign market", "tuji trg", "mednarodn", "international")
ORDER = ("ATTRIBUTED", "CANDIDATE", "UNCERTAIN", "REJECTED")


def attribution(corroborated: Column) -> Column:
    """Status of an observation. Columns: source_kind, on_scope, page_bad, normalized_value, visible_email, company_name, publication, block_* flags."""
    c = F.col
    flag = lambda n: F.coalesce(F.col(n), F.lit(False))
    shown = F.coalesce("visible_email", F.lit(""))
    clash = ((shown != "") & (F.lower(shown) != F.lower("normalized_value"))) | flag("display_conflict") | flag("block_other") | text.legal_conflict(c("publication"), c("company_name"))
    return (
        F.when(c("source_kind") != "FETCHED_PAGE", "CANDIDATE").when(~flag("on_scope"), "UNCERTAIN")
        .when(flag("page_bad") | clash | any_in(text.fold(c("publication")), CREDITS), "REJECTED").when(flag("block_target"), "ATTRIBUTED")
        .when(flag("block_single_page") & (flag("block_section") | corroborated), "ATTRIBUTED").otherwise("UNCERTAIN")
    )


def email_rank(context: Column, role: Column) -> Column:
    """0 (general contact) to 60 (transactional), from a folded publication context and the address's role."""
    return (
        F.when(any_in(context, TRANSACTIONAL), 60).when(any_in(context, LEGAL), 50).when(role == "PERSON", 40).when(any_in(context, GENERAL_EMAIL), 0)
        .when(any_in(context, OFFICE), 10).when(role == "GENERAL", 15).when((role == "SALES") | any_in(context, SALES), 20).when(~role.isin("UNKNOWN", "GENERAL"), 30).otherwise(25)
    )


def phone_rank(context: Column, number: Column, target: Column, country: str = "386") -> Column:
    """0 (switchboard) to 50 (mobile), plus penalties for foreign numbers and offices, less 2 at home."""
    general, foreign_context = any_in(context, GENERAL), any_in(context, FOREIGN)
    base = F.when(general, 0).when(any_in(context, OFFICE), 10).when(any_in(context, SALES), 30).when(any_in(context, DEPARTMENT), 40).when(any_in(context, MOBILE), 50).otherwise(20)
    abroad = number.startswith("+")
    home = abroad & number.startswith("+" + country)
    named = general & F.coalesce(target, F.lit(False))
    penalty = F.when(named, 0).otherwise(F.lit(100) + F.when(foreign_context, 50).otherwise(0))
    return base + F.when((abroad & ~home) | (~abroad & foreign_context), penalty).when(home, -2).otherwise(0)


def resolve(observations: DataFrame, key: str = "company_id") -> DataFrame:
    """One row per (key, kind, normalized_value): best status, its observation, all supporting observations, role and rank.

    Columns besides those of ``attribution``: kind (EMAIL or PHONE), observation_id, seq, identity_match,
    other_host (the source is not on the owner's host), headings.
    """
    c, group = F.col, [key, "kind", "normalized_value"]
    seen = observations.groupBy(*group).agg(F.bool_or((c("source_kind") == "SEARCH_RESULT") & F.coalesce("identity_match", F.lit(False)) & F.coalesce("other_host", F.lit(True))).alias("__corroborated"))
    judged = observations.join(seen, group).withColumn("status", attribution(c("__corroborated")))
    context = text.fold(F.concat_ws(" ", "publication", F.array_join(F.coalesce("headings", F.array().cast("array<string>")), " ")))
    role = F.when(c("kind") == "EMAIL", emails.role(c("normalized_value"), c("company_name"))).otherwise("UNKNOWN")
    judged = judged.withColumn("role", role).withColumn("rank", F.when(c("kind") == "EMAIL", email_rank(context, c("role"))).otherwise(phone_rank(context, F.substring_index("normalized_value", ";", 1), c("block_target"))))
    place = F.array_position(F.array(*[F.lit(s) for s in ORDER]), c("status"))
    best = F.struct(place.alias("p"), (~F.coalesce("block_explicit", F.lit(False))).alias("e"), (~F.coalesce("block_section", F.lit(False))).alias("s"), c("seq").alias("q"))
    ranked = F.struct(c("rank").alias("r"), c("seq").alias("q"))
    out = judged.groupBy(*group).agg(
        F.min_by(F.struct("status", "observation_id", F.coalesce("block_explicit", F.lit(False)).alias("explicit"), F.coalesce("block_section", F.lit(False)).alias("section"), "rank"), best).alias("b"),
        F.min_by("rank", F.when(c("status") == "ATTRIBUTED", ranked)).alias("__rank"), F.array_sort(F.collect_set("observation_id")).alias("supporting"), F.first("role").alias("role"),
    )
    return out.select(*group, c("b.status").alias("status"), c("b.observation_id").alias("primary_observation_id"), "supporting", "role", F.coalesce("__rank", "b.rank").alias("default_rank"), c("b.explicit").alias("explicit_company"), c("b.section").alias("contact_section"))


def defaults(contacts: DataFrame, key: str = "company_id") -> DataFrame:
    """The default e-mail and phone of each company: attributed, not a person's, best rank."""
    fit = contacts.filter((F.col("status") == "ATTRIBUTED") & (F.col("role") != "PERSON"))
    return top_per_key(fit, [key, "kind"], 1, F.col("default_rank").asc(), F.col("explicit_company").desc(), F.col("contact_section").desc(), F.col("normalized_value").asc())


def outcome(website_status: Column, emails_found: Column, complete: Column) -> Column:
    """struct(website, contacts) of a finished company."""
    site = F.when(website_status == "VERIFIED", "VERIFIED").when(website_status.isin("REVIEW", "GROUP_REVIEW"), "REVIEW").otherwise("NOT_FOUND")
    return F.struct(site.alias("website"), F.when(~complete, "INCOMPLETE").when(emails_found > 0, "FOUND").otherwise("NO_ATTRIBUTED_CONTACT").alias("contacts"))
