"""Readers: transcribed pages, side files, images, finished sets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import book_id_of, first_non_empty, strip
from quillspark.storage import staged

_TEXT, _LONG = T.StringType(), T.LongType()
LINT = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("empty_cells", _LONG), T.StructField("issues", T.ArrayType(_TEXT))])
_PAGE = {
    "file": _TEXT, "typ": _TEXT, "folio": _TEXT, "rok": _TEXT, "ok": T.BooleanType(), "rows_count": _LONG, "rows": T.ArrayType(T.MapType(_TEXT, _TEXT)), "lint": LINT,
    "model": _TEXT, "attempts": _LONG, "ts": _TEXT, "raw": _TEXT, "prompt_tokens": _LONG, "completion_tokens": _LONG, "duration_ms": _LONG, "error": _TEXT,
}
PAGE = T.StructType([T.StructField(k, v) for k, v in _PAGE.items()])
LINE_CAP = 16 << 20
META = T.StructType([T.StructField(k, T.ArrayType(_TEXT) if k == "localities" else _TEXT) for k in ("id", "name", "typ", "district", "localities", "source")])


def read_lines(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """path, line_no (from 0) and line of text files, which are split as Spark likes.

    A line's number is its place in its split, after the lines of the splits before it. Both
    scans deal files out alike, and only one count per split is shuffled.
    """
    text = spark.read.option("lineSep", "\n").text([paths] if isinstance(paths, str) else list(paths))
    text = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__start"), "value").withColumn("__at", F.monotonically_increasing_id())
    counts = text.groupBy("path", "__start").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(Window.partitionBy("path").orderBy("__start")) - F.col("__n") - F.col("__first")
    shift = staged(counts.select("path", "__start", before.alias("__shift")), "splits")
    return text.join(shift, ["path", "__start"]).select("path", (F.col("__at") + F.col("__shift")).cast("long").alias("line_no"), F.col("value").alias("line"))


def read_pages(spark: SparkSession, paths: str | Iterable[str], strict: bool = True, most_bytes: int = LINE_CAP) -> DataFrame:
    """One row per page line: path, book_id, book_name, line_no, line, page.

    Paths may be globs; a file is a book. Blank lines are skipped but counted. A malformed line,
    or one of over most_bytes, fails the read, or with strict=False gives a null page (see
    sound_books).
    """
    lines = read_lines(spark, paths).withColumn("line", strip("line")).where("line <> ''")
    name = F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))
    short = F.octet_length("line") <= most_bytes
    if strict:
        page = F.when(short, F.from_json("line", PAGE, {"mode": "FAILFAST"})).otherwise(F.from_json(F.raise_error(F.concat(F.lit("line too long: "), "path")).cast("string"), PAGE))
    else:
        page = F.when(short & F.get_json_object("line", "$").isNotNull(), F.from_json("line", PAGE, {"mode": "PERMISSIVE"}))
    return lines.select("path", book_id_of(name).alias("book_id"), F.regexp_replace(name, r"\.[^.]*$", "").alias("book_name"), "line_no", "line", page.alias("page"))


def rejected(pages: DataFrame) -> DataFrame:
    """path and the first bad line (line_no) of each book that has one; pages as read with strict=False."""
    return pages.where("page IS NULL").groupBy("path").agg(F.min("line_no").alias("line_no"))


def sound_books(pages: DataFrame) -> DataFrame:
    """The pages of books without a bad line: one bad line fails its book, other books stay."""
    return pages.join(rejected(pages).select("path"), "path", "left_anti").select(pages.columns)


def read_meta(spark: SparkSession, books_root: str) -> DataFrame:
    """The meta.json of each book folder, with the folder's name: a file, or what sinks.write_once has written under that name."""
    meta = spark.read.schema(META).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "{meta,part-*}.json").json(books_root)
    scans_dir = F.regexp_extract("_metadata.file_path", r"^(.*)/meta\.json(?:/part-[^/]*)?$", 1)
    folder = F.url_decode(F.replace(F.element_at(F.split(scans_dir, "/"), -1), F.lit("+"), F.lit("%2B")))
    return meta.select("*", folder.alias("folder"), scans_dir.alias("scans_dir")).where("scans_dir <> ''")


def books(pages: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """One row per book: id, name, typ, district, localities, scans_dir ('' without a side file)."""
    b = pages.groupBy("book_id").agg(F.min("book_name").alias("book_name"), F.min_by("page.typ", "line_no").alias("page_typ"))
    if meta is None:
        return b.select(F.col("book_id").alias("id"), F.col("book_name").alias("name"), F.col("page_typ").alias("typ"), F.lit("").alias("district"), F.array().cast("array<string>").alias("localities"), F.lit("").alias("scans_dir"))
    j = b.join(meta.drop("id", "name"), b["book_name"] == meta["folder"], "left")
    return j.select(
        F.col("book_id").alias("id"), F.col("book_name").alias("name"), first_non_empty("typ", "page_typ").alias("typ"), F.coalesce("district", F.lit("")).alias("district"),
        F.coalesce("localities", F.array().cast("array<string>")).alias("localities"), F.coalesce("scans_dir", F.lit("")).alias("scans_dir"),
    )


def scans(pages: DataFrame) -> DataFrame:
    """One row per page: book_id, line_no, file, folio, rok, ok, lint."""
    return pages.select("book_id", "line_no", "page.file", "page.folio", "page.rok", F.coalesce("page.ok", F.lit(False)).alias("ok"), "page.lint")


def records(pages: DataFrame) -> DataFrame:
    """One row per table row of ok pages: book_id, line_no, file, row_idx (from 0), record_type, cells.

    The cell record_type, if it is filled, names the type; else the page does.
    """
    rows = pages.where("page.ok AND page.rows IS NOT NULL").select("book_id", "line_no", "page.file", "page.typ", F.posexplode("page.rows").alias("row_idx", "cells"))
    return rows.select("book_id", "line_no", "file", "row_idx", first_non_empty(F.try_element_at("cells", F.lit("record_type")), "typ").alias("record_type"), "cells")


def read_images(spark: SparkSession, root: str, extensions: Iterable[str] = ("png", "jpg", "jpeg")) -> DataFrame:
    """path, length, content of images below root; order by path for the reading order."""
    either = ",".join("".join(f"[{c.lower()}{c.upper()}]" for c in e) for e in extensions)
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{either}}}").load(root).select("path", "length", "content")


def finished(pages: DataFrame) -> DataFrame:
    """The files that a former run has transcribed."""
    return pages.where("page.ok").select("book_id", "page.file").distinct()


def to_do(files: DataFrame, done: DataFrame, start: int = 1, end: int | None = None, limit: int | None = None, by: str = "book_id", name: str = "file") -> DataFrame:
    """Files start to end of each book in order of name (from 1), without those done, limit at most."""
    numbered = files.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(name)))
    inside = numbered.where(F.col("__n") >= start if end is None else F.col("__n").between(start, end)).drop("__n")
    left = inside.join(done, [by, name], "left_anti")
    return left if limit is None else left.orderBy(by, name).limit(limit)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Training samples: id, kind, image, prompt, target, meta."""
    return spark.read.schema("id string, kind string, image string, prompt string, target string, meta map<string,string>").json(path)
