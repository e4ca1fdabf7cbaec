"""Parsers of pages as table functions of a session, for LATERAL joins in SQL. Rows are pickled in batches: by Arrow, a frame would be made of each page's few rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

PAIRS = "array<struct<label: string, value: string>>"


class PageBlocks:
    """page_blocks(html): a row for each mail and telephone link."""

    def eval(self, html: str) -> Iterator[tuple]:
        from ..operators.html import page_blocks

        for row in page_blocks(html):
            yield row["href"], row["publication"], row["headings"], row["page_headings"], row["visible_email"]


class PageObjects:
    """page_objects(html): organisations and publishers of the structured data."""

    def eval(self, html: str) -> Iterator[tuple]:
        from ..operators.html import page_objects

        for row in page_objects(html):
            yield row["position"], row["kind"], row["name"], row["url"]


class PageLinks:
    """page_links(html): href and shown text of every link that is not hidden."""

    def eval(self, html: str) -> Iterator[tuple]:
        from ..operators.html import parse

        for k, node in enumerate(n for n in parse(html).walk() if n.tag == "a" and "href" in n.attrs and not n.hidden()):
            yield k, node.attrs["href"], node.text()


class RegistryCandidates:
    """registry_candidates(html, base): status and candidates of a search page; one row with nulls where there is none."""

    def eval(self, html: str, base: str) -> Iterator[tuple]:
        from ..operators.registry import parse_results

        status, found = parse_results(html, base)
        for row in found or [{}]:
            yield status, row.get("name"), row.get("registration"), row.get("tax"), row.get("detail_url")


class RegistryFields:
    """registry_fields(html): section, number of the block in it, label and value of a detail page."""

    def eval(self, html: str) -> Iterator[tuple]:
        from ..operators.registry import parse_detail

        found = parse_detail(html)
        blocks = [("company", 0, found["fields"]), *((p["role_type"], k, p["fields"]) for k, p in enumerate(found["people"]))]
        blocks += [(name, k, block) for name in ("owners", "shares") for k, block in enumerate(found[name])]
        for section, k, fields in blocks:
            for label, value in fields:
                yield section, k, label, value


FUNCTIONS = {
    "page_blocks": (PageBlocks, "href string, publication string, headings array<string>, page_headings array<string>, visible_email string"),
    "page_objects": (PageObjects, "position int, kind string, name string, url string"),
    "page_links": (PageLinks, "position int, href string, shown string"),
    "registry_candidates": (RegistryCandidates, "status string, name string, registration string, tax string, detail_url string"),
    "registry_fields": (RegistryFields, "section string, block int, label string, value string"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the table functions in the session; gives their names."""
    for name, (handler, schema) in FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(handler, returnType=schema, useArrow=False))
    return list(FUNCTIONS)
