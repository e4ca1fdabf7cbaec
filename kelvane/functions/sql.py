"""The normalisers as SQL functions of a session, for use in ``spark.sql``. They are SQL bodies, so they are inlined and optimised."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "registration_number(value STRING)": r"nullif(regexp_replace(value, '\\D', ''), '')",
    "tax_number(value STRING)": r"nullif(regexp_replace(regexp_replace(trim(value), '(?i)^SI\\s*', ''), '\\D', ''), '')",
    "strict_identifier(value STRING, tax BOOLEAN)": r"regexp_extract(regexp_replace(upper(regexp_replace(value, '\\s', '')), if(tax, '^SI', '^\\b\\B'), ''), '^([0-9]+)$', 1)",
    "person_name(value STRING)": r"nullif(lower(trim(regexp_replace(value, '\\s+', ' '))), '')",
    "european_number(value STRING)": r"try_cast(replace(replace(regexp_replace(value, '\\s+', ''), '.', ''), ',', '.') AS DOUBLE)",
    "european_date(value STRING)": r"if(trim(value) rlike '^\\d{1,2}\\.\\d{1,2}\\.\\d{4}$', concat_ws('-', split_part(trim(value), '.', 3), lpad(split_part(trim(value), '.', 2), 2, '0'), lpad(split_part(trim(value), '.', 1), 2, '0')), NULL)",
    "link_priority(url STRING)": r"CASE WHEN lower(url) rlike 'kontakt|contact' THEN 0 WHEN lower(url) rlike 'impress|legal|podatki' THEN 1 WHEN lower(url) rlike 'o-nas|about|podjetj|company' THEN 2 ELSE 3 END",
    "at_most(value INT, most INT)": r"if(value IS NULL, NULL, least(value, most))",
}
RETURNS = {"european_number": "DOUBLE", "link_priority": "INT", "at_most": "INT"}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; gives their names."""
    names = []
    for signature, body in FUNCTIONS.items():
        name = signature.split("(")[0]
        body = f"nullif({body}, '')" if name == "strict_identifier" else body
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {RETURNS.get(name, 'STRING')} RETURN {body}")
        names.append(name)
    return names
