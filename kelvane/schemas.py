"""Schemas of the logical tables."""

from __future__ import annotations

from pyspark.sql.types import StructType

VERSION = 1

COMPANIES = StructType.fromDDL("id long not null, company_name string, registration_number string, tax_number string, address string, municipality string, revenue_2025 double, profit_2025 double, employees_2025 double, assets_2025 double, capital_2025 double, financial_raw_json string, financial_status string, collected_at string")
WEBSITE_HISTORY = StructType.fromDDL("id long not null, company_id long, website string, confidence int, status string, method string, checked_at string, evidence_json string, attempt_count int, rule_version string, relationship string, verified_scope string, ownership_json string")
EMAILS = StructType.fromDDL("id long not null, company_id long, email string, confidence int, page_url string, page_title string, found_in string, website string, evidence_json string, discovered_at string")
SOURCE_RECORDS = StructType.fromDDL("id string not null, company_id string, source string, source_file string, source_row int, external_id string, raw_json string, raw_hash string, seq long")
OBSERVATIONS = StructType.fromDDL("id string not null, company_id string, source string, source_record_id string, fact_key string, value_text string, value_number double, value_json string, value_year int, confidence double, observed_at string, seq long")
TASKS = StructType.fromDDL("id long not null, company_id long, source string, task_type string, status string, priority int, attempts int, max_attempts int, not_before timestamp, created_at timestamp, lease_owner string")
BUDGETS = StructType.fromDDL("source string not null, daily_limit int, enabled boolean, timezone string")
OWNERSHIP = StructType.fromDDL("owned_company_id string, owner_person_id string, owner_company_id string, owner_raw_name string, share_percent double, valid_from string, valid_to string, is_current boolean, source_share_id string")

#: Columns of the outreach export in their order, as fixed values.
EXPORT_COLUMNS = (
    "company_id", "region", "company_name", "address", "postal_code", "city", "municipality", "tax_number", "registration_number", "revenue_2025", "employees_2025",
    "website", "website_status", "website_confidence", "primary_email", "other_emails", "email_count", "contact_person", "sent", "sent_date", "reply", "called",
    "call_date", "outcome", "follow_up_date", "owner", "notes",
)
