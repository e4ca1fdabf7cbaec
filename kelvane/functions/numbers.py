"""Numbers, dates and places written the European way."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import empty_to_null
from .text import squeeze


def cell_text(c: Column) -> Column:
    """Trimmed text without a trailing '.0'; null for blanks and nan."""
    v = F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")
    return empty_to_null(F.when(F.lower(v) != "nan", v))


def european_number(c: Column, places: int | None = None) -> Column:
    """'1.234,50' as 1234.5; dots are always separators of thousands. Null where it is no finite number."""
    v = F.replace(F.replace(F.regexp_replace(c, r"\s+", ""), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    n = v.try_cast("double")
    n = F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)
    return F.round(n, places) if places is not None else n


def european_date(c: Column) -> Column:
    """'3.4.2021' as '2021-04-03'; the calendar is not checked. Null for anything else."""
    v = squeeze(c)
    parts = [F.regexp_extract(v, r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", k) for k in (3, 2, 1)]
    return F.when(parts[0] != "", F.concat_ws("-", parts[0], *[F.lpad(p, 2, "0") for p in parts[1:]]))


def percent(c: Column) -> Column:
    """'12,5 %' as 12.5; fractions and bare numbers give null."""
    return F.regexp_extract(F.replace(squeeze(c), F.lit(","), F.lit(".")), r"^(\d+(?:\.\d+)?)\s*%$", 1).try_cast("double")


def postal_parts(c: Column) -> Column:
    """struct(code, city) of '1000 Ljubljana'; both '' where it does not begin with four digits."""
    v = F.coalesce(c, F.lit(""))
    return F.struct(F.regexp_extract(v, r"^\s*(\d{4})\s*(.*)$", 1).alias("code"), F.trim(F.regexp_extract(v, r"^\s*(\d{4})\s*(.*)$", 2)).alias("city"))


def municipality(address: Column) -> Column:
    """The code and place that end an address, or ''."""
    return F.trim(F.regexp_extract(F.coalesce(address, F.lit("")), r"(\d{4}\s+[A-Za-zČŠŽčšžĆćĐđ\- ]+)$", 1))


#: Metric by the words of its label, as fixed values.
METRICS = {
    "revenue": r"prihod|celotni prih|revenue",
    "profit": r"dobič|dobic|profit|poslovni izid|čisti poslov",
    "employees": r"zaposlen|employees|povprečno št",
    "assets": r"^\s*(?:sredstva|assets)\s*$",
    "capital": r"^\s*(?:kapital|capital)\s*$",
}


def financial_metric(label: Column) -> Column:
    """The one metric that a label names; null if it names none or several."""
    v = F.lower(label)
    found = F.array_compact(F.array(*[F.when(v.rlike(p), F.lit(m)) for m, p in METRICS.items()]))
    return F.when(F.size(found) == 1, F.element_at(found, 1))


def typed_value(c: Column, kind: str) -> Column:
    """struct(text, number, json) of which one is filled, by the column's type: the layout of observations."""
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        values = (F.lit(None).cast("string"), c.cast("double"), F.lit(None).cast("string"))
    elif kind.startswith(("struct", "array", "map")):
        values = (F.lit(None).cast("string"), F.lit(None).cast("double"), F.to_json(c))
    else:
        values = (c.cast("string"), F.lit(None).cast("double"), F.lit(None).cast("string"))
    return F.struct(*[v.alias(n) for v, n in zip(values, ("text", "number", "json"), strict=True)])
