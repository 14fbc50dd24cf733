"""Helpers that the corpus operators share: table access, bounded batches, labelled samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.storage import shared_dir, staged

__all__ = ["bounded", "cut", "held_out_train", "labelled_sample", "mapped", "shared_dir", "staged", "table", "texts"]

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(batches: Batches, rows: int = 512, most_bytes: int = 16 << 20) -> Batches:
    """Batches in parts of at most `rows` rows and about most_bytes, or one row."""
    for b in batches:
        step = max(1, min(rows, b.num_rows * most_bytes // max(1, b.nbytes)))
        for k in range(0, b.num_rows, step):
            yield b.slice(k, step)


def bounded(spark: SparkSession, rows: int = 512) -> None:
    """Lower the session's Arrow batches to `rows` rows, unless they are smaller: what the JVM and a Python worker hold at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def mapped(df: DataFrame, f: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """df.mapInArrow(f) with bounded batches."""
    bounded(df.sparkSession)
    return df.mapInArrow(lambda batches: f(cut(batches)), schema)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id as long and the text as string (null: empty), whatever else docs has."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def fold(doc_id: Column, parts: int) -> Column:
    """CRC-32 of the id as text, modulo parts."""
    return F.crc32(doc_id.cast("string")) % parts


def held_out_train(parts: int, out: int) -> tuple[Column, Column]:
    """(held out, for training) as columns of doc_id; a row without an id is neither scored with its label nor held out."""
    rest = fold(F.col("doc_id"), parts)
    return F.coalesce(rest == out, F.lit(False)), F.coalesce(rest != out, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, sample: int) -> DataFrame:
    """At most `sample` rows (doc_id, y, text) of labelled training documents, by a hash of their ids.

    Of several labels of one id the largest counts, of several texts the one of the smallest hash.
    """
    drawn = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & train)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    own = texts(docs).join(F.broadcast(drawn), "doc_id")
    return own.groupBy("doc_id").agg(F.max("y").alias("y"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "y", "t.text")
