"""Registry pages: search tables to candidates, detail pages to nested company records, and those to tables.

Parsing is one Arrow pass that emits nested rows; everything after it is ``explode`` and joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids, numbers, text, urls
from .html import Node, parse

#: Labels of registry pages, as fixed values.
LOGIN_MARKERS = ("Za prikaz podatkov je obvezna prijava.", "PRIJAVA V SISTEM")
NO_HITS = "Ni zadetkov"
FACTS = {
    "Pravnoorganizacijska oblika": "legal_form", "Status subjekta": "registry_status", "Osnovni kapital": "share_capital",
    "Število delnic": "share_count", "Datum vpisa subjekta v sodni register": "court_register_entered_at",
}
PEOPLE = (("accordianBody3", "REPRESENTATIVE"), ("accordianBody4", "SUPERVISORY_BOARD"))
NAME_LABELS = ("Osebno ime", "osebno ime", "Ime in priimek")
TITLE_LABELS = ("Vrsta zastopnika", "tip člana", "Tip člana")
ROLE_ID_LABELS = ("Zap. št. zastopnika", "zap. št. člana", "Zap. št. člana")
FROM_LABELS = ("Datum podelitve pooblastila", "datum izvolitve ali imenovanja")
REDACTED = "[REDACTED]"

_PAIRS = pa.map_(pa.string(), pa.string())


def _has(node: Node, name: str) -> bool:
    value = node.attrs.get("class")
    return bool(value) and name in value and name in value.split()


def _pairs(root: Node) -> dict[str, str]:
    out: dict[str, str] = {}
    for row in (n for n in root.walk() if _has(n, "row")):
        label = next((n for n in row.walk() if n is not row and _has(n, "text-thin")), None)
        if label is None or label.parent is None:
            continue
        after = [c for c in label.parent.children[label.parent.children.index(label) + 1 :] if isinstance(c, Node)]
        if name := label.text(seen_only=False):
            out[name] = after[0].text(seen_only=False) if after else ""
    return out


def _sections(root: Node) -> dict[str, Node]:
    """The first node of each id."""
    out: dict[str, Node] = {}
    for node in root.walk():
        if "id" in node.attrs:
            out.setdefault(node.attrs["id"], node)
    return out


def parse_detail(html: str | None) -> dict:
    """Fields, people and ownership blocks of a detail page, all as label to value maps."""
    found, none = _sections(parse(html)), Node("[none]", {}, None)
    people = [{"role_type": role, "fields": list(_pairs(b).items())} for id_, role in PEOPLE for b in found.get(id_, none).walk() if _has(b, "matchHeight")]
    owners, shares = [], []
    for column in (n for n in found.get("accordianBody2", none).walk() if _has(n, "col-md-6")):
        head = next((n.text(seen_only=False) for n in column.walk() if n.tag == "h4"), "")
        into = {"DRUŽBENIKI": owners, "POSLOVNI DELEŽI": shares}.get(head)
        if into is not None:
            into += [list(_pairs(b).items()) for b in column.walk() if b.tag == "div" and "page-break-inside" in (b.attrs.get("style") or "")]
    return {"fields": list(_pairs(found.get("accordianBody1", none)).items()), "people": people, "owners": owners, "shares": shares}


def parse_results(html: str | None, base: str) -> tuple[str, list[dict]]:
    """Status (OK, NO_RESULT, LOGIN_REQUIRED) and candidate rows of a search page."""
    root = parse(html)
    body = root.text(seen_only=False)
    if any(m in body for m in LOGIN_MARKERS):
        return "LOGIN_REQUIRED", []
    if NO_HITS in body:
        return "NO_RESULT", []
    out = []
    for grid in (n for n in root.walk() if n.tag == "table"):
        rows = [r for r in grid.walk() if r.tag == "tr"]
        cells = [[c for c in r.walk() if c.tag in ("td", "th")] for r in rows]
        heads = [c.text(seen_only=False) for c in cells[0]] if cells else []
        if "Matična številka" not in heads:
            continue
        for row, mine in zip(rows[1:], cells[1:], strict=True):
            if len(mine) < len(heads):
                continue
            value = dict(zip(heads, (c.text(seen_only=False) for c in mine), strict=False))
            link = next((a.attrs["href"] for a in row.walk() if a.tag == "a" and re.search(r"podjetje\.asp", a.attrs.get("href", ""))), None)
            out.append({"name": value.get("Firma") or value.get("Skrajšana firma"), "registration": value.get("Matična številka"), "tax": value.get("Davčna številka"), "detail_url": urljoin(base, link) if link else None})
    return ("OK", out) if out else ("NO_RESULT", [])


def search_candidates(pages: DataFrame, key: str, html: str, base_url: str) -> DataFrame:
    """(key, status, name, registration_number, tax_number, detail_url) of search pages; one row with nulls where there is no candidate."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                status, found = parse_results(source, base_url)
                rows += [{key: k, "status": status, **c} for c in found or [{}]]
            schema = pa.schema([(key, batch.schema.field(0).type), *((n, pa.string()) for n in ("status", "name", "registration", "tax", "detail_url"))])
            yield from pa.Table.from_pylist(rows, schema=schema).to_batches()

    raw = pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, status string, name string, registration string, tax string, detail_url string")
    return raw.select(key, "status", "name", ids.digits(F.col("registration")).alias("registration_number"), ids.tax_number(F.col("tax")).alias("tax_number"), "detail_url")


def details(pages: DataFrame, key: str, html: str, *also: str) -> DataFrame:
    """(key, fields, people, owners, shares) and the columns ``also``: the nested content of detail pages."""
    person = pa.struct([("role_type", pa.string()), ("fields", _PAIRS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_detail(h) for h in batch.column(1).to_pylist()]
            column = lambda n, t: pa.array([f[n] for f in found], t)
            yield pa.RecordBatch.from_arrays([batch.column(0), column("fields", _PAIRS), column("people", pa.list_(person)), column("owners", pa.list_(_PAIRS)), column("shares", pa.list_(_PAIRS)), *batch.columns[2:]], names=[key, "fields", "people", "owners", "shares", *also])

    pairs = "map<string, string>"
    kept = "".join(f", `{c}` {pages.schema[c].dataType.simpleString()}" for c in also)
    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html, *also).mapInArrow(run, f"`{key}` {kind}, fields {pairs}, people array<struct<role_type: string, fields: {pairs}>>, owners array<{pairs}>, shares array<{pairs}>{kept}")


def _first(fields, labels):
    return F.coalesce(*[F.nullif(F.try_element_at(fields, F.lit(n)), F.lit("")) for n in labels])


def _redacted(fields, person):
    return F.transform_values(fields, lambda k, v: F.when(person & (k == "Naslov") & (v != ""), F.lit(REDACTED)).otherwise(v))


def companies(found: DataFrame, key: str, url: str | None = None) -> DataFrame:
    f = F.col("fields")
    get = lambda *n: _first(f, n)
    extra = [urls.query_value(F.col(url), "e").alias("external_id")] if url else []
    return found.select(
        key, get("Firma", "Skrajšana firma").alias("canonical_name"), ids.digits(get("Matična številka")).alias("registration_number"),
        ids.tax_number(get("Ident. št. za DDV in davčna številka")).alias("tax_number"), get("Poslovni naslov").alias("address"), *extra,
    )


def facts(found: DataFrame, key: str) -> DataFrame:
    """(key, fact_key, value) of the labelled facts that a page gives."""
    rows = F.array(*[F.struct(F.lit(k).alias("fact_key"), _first(F.col("fields"), [label]).alias("value")) for label, k in FACTS.items()])
    return found.select(key, F.explode(rows).alias("r")).select(key, "r.*").filter("value is not null and value <> 'ni vpisa'")


def people(found: DataFrame, key: str) -> DataFrame:
    rows = found.select(key, F.posexplode("people").alias("person_no", "p")).select(key, "person_no", "p.role_type", F.col("p.fields").alias("f"))
    get = lambda labels: _first(F.col("f"), labels)
    out = rows.select(
        key, "person_no", "role_type", text.squeeze(get(NAME_LABELS)).alias("full_name"), text.squeeze(get(TITLE_LABELS)).alias("title"), get(ROLE_ID_LABELS).alias("source_role_id"),
        numbers.european_date(get(FROM_LABELS)).alias("valid_from"), numbers.european_date(get(["Datum prenehanja"])).alias("valid_to"), _redacted(F.col("f"), F.lit(True)).alias("raw_fields"),
    )
    return out.filter("full_name is not null and title is not null")


def ownership(found: DataFrame, key: str) -> DataFrame:
    """Owner edges with share and validity: shares joined to the holders that they name."""
    from .identity import ownership_edges

    own = found.select(key, F.explode("owners").alias("f"))
    legal = _first(F.col("f"), ["Firma"])
    owners = own.select(
        key, _first(F.col("f"), ["Zap. št. družbenika"]).alias("shareholder_id"), F.when(legal.isNotNull(), "LEGAL_ENTITY").otherwise("NATURAL_PERSON").alias("owner_type"),
        text.squeeze(F.coalesce(legal, _first(F.col("f"), ["Osebno ime", "Ime in priimek"]))).alias("owner_raw_name"), _first(F.col("f"), ["Identifikacijska številka"]).alias("owner_raw_identifier"),
        numbers.european_date(_first(F.col("f"), ["Datum vstopa"])).alias("valid_from"), numbers.european_date(_first(F.col("f"), ["Datum izstopa"])).alias("valid_to"),
        _redacted(F.col("f"), legal.isNull()).alias("raw_fields"),
    )
    owners = owners.withColumn("shareholder_id", F.coalesce("shareholder_id", "owner_raw_name", F.lit("")))
    share = found.select(key, F.explode("shares").alias("s"))
    shares = share.select(key, _first(F.col("s"), ["Zap. št. deleža"]).alias("share_id"), F.coalesce(F.try_element_at("s", F.lit("Imetniki")), F.lit("")).alias("holders"), _first(F.col("s"), ["Delež v odstotku ali ulomku"]).alias("share_raw"), _first(F.col("s"), ["Osnovni vložek"]).alias("nominal_value_raw"))
    return ownership_edges(shares, owners, key).withColumn("share_percent", numbers.percent(F.col("share_raw"))).drop("holders")


def financials(cells: DataFrame, key: str, year: int = 2025) -> DataFrame:
    """Labelled cells (key, cell_no, raw, label) to a row of metrics, a status and the cells as JSON. Labels decide, never positions."""
    c = F.col
    after_colon = numbers.european_number(F.when(c("raw").contains(":"), F.substring_index("raw", ":", -1)), 2)
    parsed = cells.withColumn("metric", numbers.financial_metric(c("label"))).withColumn("value", F.coalesce(numbers.european_number(c("raw"), 2), after_colon))
    blank = F.lower(F.trim("raw")).isin("", "-", "—", "n/a", "ni podatka")
    per = parsed.groupBy(key, "metric").agg(F.count("*").alias("n"), F.first("value").alias("v"), F.bool_or(c("value").isNull() & ~blank).alias("bad"), F.bool_or(c("value").isNull()).alias("empty"))
    known = c("metric").isNotNull()
    names = list(numbers.METRICS)
    wide = per.groupBy(key).agg(
        *[F.max(F.when((c("metric") == m) & (c("n") == 1), c("v"))).alias(f"{m}_{year}") for m in names],
        F.bool_or(known & ((c("n") > 1) | c("bad"))).alias("__error"), F.bool_or(known & c("empty")).alias("__empty"), F.bool_or(known).alias("__any"),
    )
    lacking = c(f"revenue_{year}").isNull() | c(f"profit_{year}").isNull() | c(f"employees_{year}").isNull() | c("__empty")
    status = F.when(c("__error") | ~c("__any"), "PARSE_ERROR").when(lacking, "PARTIAL").otherwise("OK")
    raw = parsed.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct("cell_no", "label", "metric", "raw", "value")))).alias("financial_raw_json"))
    return wide.withColumn("financial_status", status).drop("__error", "__empty", "__any").join(raw, key)
