"""Pages that arrive as files: the stream's checkpoint takes the place of a list of finished files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quillspark.functions.text import book_id_of, strip
from quillspark.sources.pages import PAGE, records

FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def page_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Pages of new JSON-lines files in folder: path, book_id, book_name, line_no (by file offset), page."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.jsonl").load(folder)
    name = F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))
    lines = F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line_no", "line")
    rows = files.select("path", book_id_of(name).alias("book_id"), F.regexp_replace(name, r"\.[^.]*$", "").alias("book_name"), lines)
    rows = rows.withColumn("line", strip("line")).where("line <> ''")
    return rows.withColumn("page", F.from_json("line", PAGE)).withColumn("line_no", F.col("line_no").cast("long"))


def ingest(stream: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write the records of arriving pages below target by book; a book that comes again replaces what it had.

    The file source takes brackets in names for patterns and may list such files more than
    once in a batch, so lines are made distinct first.
    """

    def write(batch: DataFrame, _: int) -> None:
        records(batch.dropDuplicates(["path", "line_no"])).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_id").parquet(target)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
