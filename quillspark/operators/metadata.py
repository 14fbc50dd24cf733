"""Book metadata out of archive pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import clean_cell, strip
from quillspark.sources.templates import COMBINED, TYPES

# Marks of the pages, and labels in the languages they come in.
ROW = "tableMatrikaBasicInfoRow"
LABEL = r'tableMatrikaBasicInfoHeader1"[^>]*>\s*<div>([^<]+)</div>'
VALUE = r'tableMatrikaBasicInfoHeader2"[^>]*>\s*<div[^>]*>(?:<span>)?([^<]+)'
SPAN = r"^\d{4}\s*-\s*\d{4}$"
ORIGIN = r'puvodceLink"[^>]*>\s*<span>([^<]+)'
PLACE = r'obecCastLabel">([^<]+)'
NOTE = r'(?s)(?:General description|Obecný popis|Allgemeine Beschreibung)[^<]*</span>.*?tableMatrikaDescriptionHeader1"[^>]*>\s*<span>(.*?)</span>'
DISTRICT = ("district", "okres", "bezirk")
SHEETS = ("number of sheets", "počet listů", "anzahl der blätter")


def record_type(ranges: Column) -> Column:
    """unknown, the one type with a range of years, or combined; ranges: map of type to range or null."""
    present = F.filter(F.array(*map(F.lit, TYPES)), lambda t: F.try_element_at(ranges, t).isNotNull())
    return F.when(F.size(present) == 0, "unknown").when(F.size(present) == 1, present[0]).otherwise(COMBINED)


def parse_meta(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with record_ranges, typ, district, sheets, provenance, localities, note.

    The first three rows of two or more values are births, marriages and deaths; their
    first value counts if it is a range of years.
    """
    parts = F.split(F.coalesce(html, F.lit("")), ROW)
    rows = F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda s: F.struct(clean_cell(F.regexp_extract(s, LABEL, 1)).alias("label"), F.transform(F.regexp_extract_all(s, F.lit(VALUE), F.lit(1)), clean_cell).alias("values")),
    )
    out = pages.withColumn("__rows", F.when(F.size(parts) > 1, rows).otherwise(F.slice(rows, 1, 0)))
    many = F.transform(F.filter("__rows", lambda r: F.size(r["values"]) >= 2), lambda r: r["values"][0])
    year_range = lambda i: F.when(F.get(many, F.lit(i)).rlike(SPAN), F.get(many, F.lit(i)))
    out = out.withColumn("record_ranges", F.create_map(*(x for i, t in enumerate(TYPES) for x in (F.lit(t), year_range(i)))))
    labelled = lambda names: F.get(F.filter("__rows", lambda r: F.lower(r["label"]).isin(*names) & (F.size(r["values"]) > 0)), F.lit(0))["values"][0]
    found = lambda form: clean_cell(F.regexp_extract(F.coalesce(html, F.lit("")), form, 1))
    places = F.filter(F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(PLACE), F.lit(1)), clean_cell), lambda p: p != "")
    return out.withColumns(
        {
            "typ": record_type(F.col("record_ranges")),
            "district": F.coalesce(labelled(DISTRICT), F.lit("")),
            "sheets": strip(labelled(SHEETS)).try_cast("int"),
            "provenance": found(ORIGIN),
            "localities": places,
            "note": found(NOTE),
        }
    ).drop("__rows")
