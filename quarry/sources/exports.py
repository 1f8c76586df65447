"""Sinks of a result list: separated values and RSS with OpenSearch elements."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.url import strip_markup

#: The columns of an exported list, in order.
COLUMNS = ["query", "engine", "caption", "url", "type", "language", "modtime", "size", "abstract"]
OPEN_SEARCH = "http://a9.com/-/spec/opensearch/1.1/"


def export_rows(results: DataFrame) -> DataFrame:
    """The nine columns as strings, null as empty, caption and abstract without markup."""
    return results.select(*[(strip_markup(x) if c in ("caption", "abstract") else x).alias(c) for c, x in ((c, F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in COLUMNS)])


def write_csv(results: DataFrame, path: str) -> bool:
    """Part files with a header each, `;` between quoted fields, quotes doubled. An empty list writes nothing."""
    if results.isEmpty():
        return False
    export_rows(results).write.mode("overwrite").csv(path, sep=";", header=True, quoteAll=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return True


def to_rss(results: DataFrame, query: str, engine: str, limit: int = 100) -> str:
    """One page of results as RSS 2.0 text; the limit is the page's size."""
    rows = export_rows(results).limit(limit).collect()
    ET.register_namespace("opensearch", OPEN_SEARCH)
    rss = ET.Element("rss", version="2.0")
    channel = ET.SubElement(rss, "channel")
    ET.SubElement(channel, "title").text = query
    ET.SubElement(channel, "description").text = engine
    ET.SubElement(channel, f"{{{OPEN_SEARCH}}}totalResults").text = str(len(rows))
    ET.SubElement(channel, f"{{{OPEN_SEARCH}}}itemsPerPage").text = str(len(rows))
    ET.SubElement(channel, f"{{{OPEN_SEARCH}}}Query", role="request", searchTerms=query)
    for r in rows:
        item = ET.SubElement(channel, "item")
        for tag, c in (("title", "caption"), ("link", "url"), ("description", "abstract")):
            ET.SubElement(item, tag).text = r[c]
    return ET.tostring(rss, encoding="unicode")
