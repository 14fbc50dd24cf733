"""Checks of transcribed pages and books, and repair of transcribers' answers."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import leading_int, strip
from quillspark.operators import asking
from quillspark.operators.asking import AT_ONCE, Pace
from quillspark.sources.templates import REQUIRED, Template


def lint_rows(rows: DataFrame, t: Template, page: list[str] | None = None) -> DataFrame:
    """Checks of rows (page columns, row_idx, cells): empty, header, number, previous number, missing keys.

    The previous number is the last one read on the page, in row order.
    """
    page = page or ["book_id", "file"]
    value = lambda k: strip(F.try_element_at("cells", F.lit(k)))
    values = F.array(*(value(k) for k in t.keys))
    labels = F.array(*map(F.lit, t.labels))
    hits = F.size(F.filter(values, lambda v: (v != "") & F.array_contains(labels, F.lower(v))))
    before = Window.partitionBy(*page).orderBy("row_idx").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("empty", F.size(F.filter(values, lambda v: v == "")))
        .withColumn("header", (hits >= 3) & (hits * 2 >= len(t.keys)))
        .withColumn("no_number", value("cislo") == "")
        .withColumn("number", leading_int(F.try_element_at("cells", F.lit("cislo"))))
        .withColumn("previous", F.last("number", ignorenulls=True).over(before))
        .withColumn("missing", F.filter(F.array(*map(F.lit, REQUIRED.get(t.typ, ()))).cast("array<string>"), lambda k: strip(F.try_element_at("cells", k)) == ""))
    )


def lint_pages(rows: DataFrame, t: Template, page: list[str] | None = None) -> DataFrame:
    """One row per page with rows: empty_cells, issues (sorted), ok."""
    page = page or ["book_id", "file"]
    r = lint_rows(rows, t, page)
    falls = F.when(F.col("number") <= F.col("previous"), F.format_string("numbers do not rise (%d after %d)", "number", "previous"))
    agg = r.groupBy(*page).agg(
        F.sum("empty").alias("empty_cells"), F.collect_list(F.when(falls.isNotNull(), F.struct("row_idx", falls.alias("m")))).alias("falls"),
        F.count_if("no_number").alias("n_no"), F.count_if("header").alias("n_head"), F.flatten(F.collect_list("missing")).alias("gone"),
    )
    lacking = lambda k: F.size(F.filter("gone", lambda g: g == F.lit(k)))
    counts = [lacking(k) for k in REQUIRED.get(t.typ, ())]
    said = [F.when(n > 0, F.format_string(f"%d rows without required {k}", n)) for k, n in sorted(zip(REQUIRED.get(t.typ, ()), counts, strict=True), key=lambda x: x[0])]
    rest = [F.when(F.col("n_no") > 0, F.format_string("%d rows without a number", "n_no")), F.when(F.col("n_head") > 0, F.format_string("%d rows look like a header", "n_head")), *said]
    issues = F.concat(F.transform(F.array_sort("falls"), lambda x: x["m"]), F.filter(F.array(*rest), lambda x: x.isNotNull()))
    return agg.select(*page, "empty_cells", issues.alias("issues")).withColumn("ok", F.size("issues") == 0)


def relint(scans: DataFrame, rows: DataFrame, t: Template) -> DataFrame:
    """scans with their checks made anew; failed pages keep theirs, pages without rows say so."""
    fresh = lint_pages(rows, t).select("book_id", "file", F.struct("ok", F.col("empty_cells").cast("long").alias("empty_cells"), "issues").alias("__lint"))
    bare = F.struct(F.lit(False).alias("ok"), F.lit(0).cast("long").alias("empty_cells"), F.array(F.lit("page without rows")).alias("issues"))
    return scans.join(fresh, ["book_id", "file"], "left").withColumn("lint", F.when(F.col("ok"), F.coalesce("__lint", bare)).otherwise(F.col("lint"))).drop("__lint")


def gaps(numbers: DataFrame, by: str, number: str) -> DataFrame:
    """Numbers that lack between the least and the largest of each group: by, number."""
    span = numbers.where(F.col(number).isNotNull()).groupBy(by).agg(F.min(number).alias("lo"), F.max(number).alias("hi"))
    return span.select(by, F.explode(F.sequence("lo", "hi")).alias(number)).join(numbers.select(by, number).distinct(), [by, number], "left_anti")


def duplicates(numbers: DataFrame, by: str, number: str) -> DataFrame:
    """Numbers that a group has more than once: by, number, n."""
    return numbers.where(F.col(number).isNotNull()).groupBy(by, number).agg(F.count("*").alias("n")).where("n > 1")


def fill_rates(rows: DataFrame, by: str = "book_id") -> DataFrame:
    """Filled cells per key: by, key, filled, total, percent (whole numbers)."""
    total = rows.groupBy(by).agg(F.count("*").alias("total"))
    filled = rows.select(by, F.explode("cells").alias("key", "value")).where(strip("value") != "").groupBy(by, "key").agg(F.count("*").alias("filled"))
    return filled.join(total, by).select(by, "key", "filled", "total", F.expr("filled * 100 div total").alias("percent"))


def book_report(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """Per book: book_name, pages, pages_ok, pages_failed, total_rows, least and largest number, gaps, duplicates, issues."""
    ok = F.coalesce("page.ok", F.lit(False))
    text = F.concat_ws(": ", "page.file", F.when(~ok, F.coalesce("page.error", F.lit(""))).when(~F.coalesce("page.lint.ok", F.lit(True)), F.concat_ws("; ", "page.lint.issues")))
    bad = ~ok | ~F.coalesce("page.lint.ok", F.lit(True))
    p = pages.groupBy("book_id").agg(F.min("book_name").alias("book_name"), F.count("*").alias("pages"), F.count_if(ok).alias("pages_ok"), F.count_if(~ok).alias("pages_failed"), F.sum(F.when(ok, F.coalesce(F.size("page.rows"), F.lit(0))).otherwise(0)).alias("total_rows"), F.array_sort(F.collect_list(F.when(bad, F.struct("line_no", text.alias("t"))))).alias("__i"))
    n = rows.select("book_id", leading_int(F.try_element_at("cells", F.lit("cislo"))).alias("number"))
    each = n.where("number IS NOT NULL").groupBy("book_id", "number").agg(F.count("*").alias("n"))
    said = each.groupBy("book_id").agg(F.min("number").alias("number_min"), F.max("number").alias("number_max"), F.collect_list("number").alias("__seen"), F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.col("number")))).alias("__twice"))
    # Gaps are listed last, where a book's numbers lie: there are far more of them than numbers, so they aren't shuffled.
    lacking = F.array_except(F.sequence("number_min", "number_max"), "__seen")
    out = p.join(said, "book_id", "left").withColumns({"gaps": F.when(F.size(lacking) > 0, lacking), "duplicates": F.when(F.size("__twice") > 0, F.col("__twice"))}).drop("__seen", "__twice")
    return out.withColumn("page_issues", F.transform("__i", lambda x: x["t"])).drop("__i")


def preview(numbers: Column | str, most: int = 40) -> Column:
    """The first numbers of a list as text."""
    n = F.col(numbers) if isinstance(numbers, str) else numbers
    return F.concat(F.concat_ws(", ", F.slice(n, 1, most).cast("array<string>")), F.when(F.size(n) > most, " …").otherwise(""))


def report_texts(report: DataFrame, fills: DataFrame) -> DataFrame:
    """(book_id, text): a book report to be read by people, a labelled line for each thing it says."""
    said = lambda label, c: F.concat(F.rpad(F.lit(label), 9, " "), c)
    each = lambda label, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: said(label, x))
    listed = lambda label, c: F.filter(F.array(F.when(F.size(c) > 0, said(label, preview(c)))), lambda x: x.isNotNull())
    share = F.format_string("%s in %d of %d rows, %d per cent", "key", "filled", "total", "percent")
    columns = fills.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("key", share.alias("t"))))["t"].alias("__columns"))
    span = F.when(F.col("number_min").isNotNull(), F.format_string("from %d to %d", "number_min", "number_max")).otherwise("none")
    head = [("book", F.col("book_name")), ("pages", F.format_string("%d read, %d failed", "pages_ok", "pages_failed")), ("rows", F.col("total_rows").cast("string")), ("numbers", span)]
    lines = F.concat(F.array(*(said(k, v) for k, v in head)), listed("missing", F.col("gaps")), listed("repeated", F.col("duplicates")), each("filled", F.col("__columns")), each("look at", F.col("page_issues")))
    return report.join(columns, "book_id", "left").select("book_id", F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "").alias("text"))


def norm_key(c: Column) -> Column:
    """A key without white space, in lower case."""
    return F.lower(F.regexp_replace(c, r"\s+", ""))


def normalised_cells(cells: Column | str, t: Template) -> Column:
    """Only the template's keys, found whatever their spacing and case; '' for those that lack."""
    m = F.col(cells) if isinstance(cells, str) else cells
    entries = F.transform(F.map_entries(m), lambda e: F.struct(norm_key(e["key"]).alias("k"), strip(e["value"]).alias("v")))

    def value(key: str) -> Column:
        own = F.filter(entries, lambda e: e["k"] == "".join(key.split()).lower())
        filled = F.filter(own, lambda e: e["v"] != "")
        return F.coalesce(F.get(filled, F.size(filled) - 1)["v"], F.lit(""))

    return F.map_from_arrays(F.array(*map(F.lit, t.keys)), F.array(*map(value, t.keys)))


def unknown_keys(cells: Column | str, t: Template) -> Column:
    """Keys that the template hasn't, sorted."""
    m = F.col(cells) if isinstance(cells, str) else cells
    known = F.array(*(F.lit("".join(k.split()).lower()) for k in t.keys))
    return F.array_sort(F.filter(F.map_keys(m), lambda k: ~F.array_contains(known, norm_key(k))))


def has_value(cells: Column | str) -> Column:
    """Whether any cell is filled."""
    return F.exists(F.map_values(F.col(cells) if isinstance(cells, str) else cells), lambda v: strip(v) != "")


def as_text(v: object) -> str:
    """A JSON value as a cell's text."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return "ano" if v else "ne"
    if isinstance(v, float) and v.is_integer():
        return str(int(v))
    if isinstance(v, list):
        return "; ".join(filter(None, map(as_text, v)))
    return json.dumps(v, ensure_ascii=False, separators=(",", ":")) if isinstance(v, dict) else str(v).strip()


def json_block(text: str | None) -> str | None:
    """The first whole {...} in a text, code fences aside; braces in strings don't count."""
    s = (text or "").strip()
    if "```" in s:
        s = s.split("```", 1)[1]
        s = s[4:] if s[:4] in ("json", "JSON") else s
        s = s.rsplit("```", 1)[0]
    start = s.find("{")
    depth, quoted, skip = 0, False, False
    for i in range(max(start, 0), len(s) if start >= 0 else 0):
        c = s[i]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return s[start : i + 1]
    return None


@F.pandas_udf(T.StringType())
def extract_json(s: pd.Series) -> pd.Series:
    """json_block of each text."""
    return s.map(json_block)


@F.pandas_udf(T.StringType())
def rows_as_text(s: pd.Series) -> pd.Series:
    """A JSON object with rows: its rows as JSON with all values as text; null if it can't be read."""

    def one(text: str | None) -> str | None:
        try:
            rows = json.loads(text or "").get("rows") or []
        except (ValueError, AttributeError):
            return None
        return json.dumps([{k: as_text(v) for k, v in r.items()} for r in rows if isinstance(r, dict)], ensure_ascii=False)

    return s.map(one)


def read_answers(answers: DataFrame, t: Template, text: str = "raw") -> DataFrame:
    """Answers of a transcriber to rows: the JSON found, its rows by the template, empty ones dropped, unknown keys."""
    rows = F.from_json(rows_as_text(extract_json(F.col(text))), "array<map<string,string>>")
    out = answers.withColumn("__rows", rows)
    kept = F.filter(F.transform("__rows", lambda r: normalised_cells(r, t)), has_value)
    unknown = F.array_sort(F.array_distinct(F.flatten(F.transform("__rows", lambda r: unknown_keys(r, t)))))
    return out.withColumns({"ok": F.col("__rows").isNotNull(), "rows": F.coalesce(kept, F.array().cast("array<map<string,string>>")), "unknown_keys": unknown}).drop("__rows")


def merged_halves(left: Column | str, right: Column | str) -> Column:
    """Rows of two half pages by position; a filled cell wins, the left one first; the longer side goes on."""
    cell = lambda _, a, b: F.when(F.coalesce(a, F.lit("")) != "", a).otherwise(F.coalesce(b, a, F.lit("")))
    empty = F.create_map().cast("map<string,string>")
    both = lambda a, b: F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), cell)
    return F.zip_with(left, right, both)


def halves_issue(left: Column | str, right: Column | str) -> Column:
    """Says that two half pages differ in rows, or null."""
    a, b = (F.size(F.col(x) if isinstance(x, str) else x) for x in (left, right))
    return F.when(a != b, F.format_string("split: row counts differ (left %d, right %d)", a, b))


def first_of_equal(images: DataFrame, by: str | None = None, order: str = "path", content: str = "content") -> DataFrame:
    """images with sha256 and the first one of equal content (per group)."""
    h = images.withColumn("sha256", F.sha2(content, 256))
    key = [*([by] if by else []), "sha256"]
    return h.join(h.groupBy(*key).agg(F.min(order).alias("first")), key)


def asked(images: DataFrame, ask: Callable[[bytes, int], str], content: str = "content", tries: int = 2, pace: Pace = AT_ONCE) -> DataFrame:
    """asking.asked, where an answer is a text that holds a JSON object."""
    return asking.asked(images, ask, lambda raw: json_block(raw) is not None, content, tries, pace)
