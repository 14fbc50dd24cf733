"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import ColumnOrName, col


def replace_books(df: DataFrame, path: str, by: str = "book_id") -> None:
    """Write df partitioned by book; only the books in df are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """new, and the rows of old whose key isn't in new."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def append_pages(df: DataFrame, path: str) -> None:
    """Append page records as JSON lines."""
    df.write.mode("append").json(path)


def write_once(df: DataFrame, path: str, force: bool = False) -> None:
    """One JSON file, not overwritten unless forced; for side files of a few rows, as one task computes df."""
    df.coalesce(1).write.mode("overwrite" if force else "ignore").json(path)


def write_splits(samples: DataFrame, path: str) -> None:
    """Samples as JSON lines by split, and a manifest of ids and hashes."""
    samples.write.mode("overwrite").partitionBy("split").json(f"{path}/samples")
    samples.select("split", "id", F.sha2("target", 256).alias("sha256")).write.mode("overwrite").partitionBy("split").json(f"{path}/manifest")


def deep_link(book_id: ColumnOrName, scan_file: ColumnOrName, base_url: str) -> Column:
    """base_url/book/scan number, or '' unless both are numbers."""
    n = F.regexp_extract(F.coalesce(col(scan_file), F.lit("")), r"^0*([0-9]+)(?:\.[^.]*)?$", 1).try_cast("long")
    ok = F.coalesce(col(book_id), F.lit("")).rlike("^[0-9]+$") & n.isNotNull() & (n > 0)
    return F.when(ok, F.concat_ws("/", F.lit(base_url.rstrip("/")), col(book_id), n.cast("string"))).otherwise("")


def write_reports(report: DataFrame, texts: DataFrame, path: str) -> None:
    """Reports by book as JSON (path/json) and as text (path/txt); only the books in them are replaced."""
    own = lambda d: d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_id")
    own(report).json(f"{path}/json")
    own(texts.select("book_id", "text")).text(f"{path}/txt")
