"""Dates and ages out of free text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import lexicon as L
from quillspark.functions.text import ColumnOrName, col, fold_ascii, map_of, strip

# The forms of a date, tightest first.
TIGHT = r"(\d{1,2})\.(\d{1,2})\.(\d{4})"
LOOSE = r"(\d{1,2})\s*\.?\s*/?\s*(\d{1,2})\s*\.?\s+?(\d{4})"
WORD = r"(\d{1,2})\.?\s+(\p{L}+)\s+(\d{4})"
MONTH = r"(\p{L}+)\s+(\d{4})"
YEAR = r"(1[5-9]\d\d|20\d\d)"
AGE = r"(\d{1,3})\s*(let|roku|roků|rok|r\.|Jahre?)"
UNDER_A_YEAR = r"(mesic|tyd|dn[iu]|den|hodin)"


def parse_date(c: ColumnOrName) -> Column:
    """struct(iso, precision, year): 'YYYY-MM-DD', 'YYYY-MM' or 'YYYY' as far as the text goes.

    Day and month out of range leave the year; the calendar isn't checked. Nothing found:
    '', 'none' and null.
    """
    s = strip(c)
    part = lambda form, k: F.regexp_extract(s, form, k)
    number = lambda form, k: part(form, k).try_cast("int")
    month = lambda form, k: F.try_element_at(map_of(L.MONTH_OF), fold_ascii(part(form, k)))

    def made(precision: str, y: Column, m: Column | None = None, d: Column | None = None) -> Column:
        iso = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), *(F.lpad(x.cast("string"), 2, "0") for x in (m, d) if x is not None))
        return F.struct(iso.alias("iso"), F.lit(precision).alias("precision"), y.alias("year"))

    def day(form: str, m: Column) -> Column:
        y, d = number(form, 3), number(form, 1)
        return F.when(m.between(1, 12) & d.between(1, 31), made("day", y, m, d)).otherwise(made("year", y))

    none = F.struct(F.lit("").alias("iso"), F.lit("none").alias("precision"), F.lit(None).cast("int").alias("year"))
    return (
        F.when(s.rlike(TIGHT), day(TIGHT, number(TIGHT, 2)))
        .when(s.rlike(LOOSE), day(LOOSE, number(LOOSE, 2)))
        .when(month(WORD, 2).isNotNull(), day(WORD, month(WORD, 2)))
        .when(month(MONTH, 1).isNotNull(), made("month", number(MONTH, 2), month(MONTH, 1)))
        .when(s.rlike(YEAR), made("year", number(YEAR, 1)))
        .otherwise(none)
    )


def parse_age(c: ColumnOrName) -> Column:
    """Years of age, or null: 'N let', a unit below a year (0), or a bare number below 120."""
    s = strip(c)
    bare = F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("int"))
    return F.when(s.rlike(AGE), F.regexp_extract(s, AGE, 1).try_cast("int")).when(fold_ascii(s).rlike(UNDER_A_YEAR), F.lit(0)).when(bare < 120, bare)


def decade(year: ColumnOrName) -> Column:
    """The first year of the decade, towards zero."""
    y = col(year)
    return (y - y % 10).cast("int")
