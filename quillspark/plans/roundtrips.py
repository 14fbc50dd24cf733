"""Queries that write what the given tables hold, in each sink's form, and read it back."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import quality
from quillspark.operators.asking import Pace, Refused, unfinished
from quillspark.plans import snapshot
from quillspark.plans.register import SQL as REG
from quillspark.plans.register import register, table
from quillspark.plans.registry import query
from quillspark.sources import pages, sinks
from quillspark.storage import shared_dir, staged


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _written_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each order, its lines as rows, appended in two goes and read by a glob."""
    line = table(spark, sf_dir, "lineitem")
    cells = F.map_from_arrays(F.array(F.lit("cislo"), F.lit("record_type")), F.array(F.col("l_partkey").cast("string"), F.when(F.col("l_suppkey") % 2 == 0, "umrti").otherwise("")))
    rows = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.map_entries(cells)).alias("r"))
    o = table(spark, sf_dir, "orders").join(rows, "o_orderkey", "left")
    page = o.select(
        "o_orderkey", F.concat(F.col("o_orderkey").cast("string"), F.lit(".png")).alias("file"), F.lit("narozeni").alias("typ"), F.concat(F.lit("fol. "), F.col("o_custkey").cast("string")).alias("folio"),
        (F.col("o_orderstatus") != "F").alias("ok"), F.transform(F.coalesce("r", F.array().cast("array<array<struct<key:string,value:string>>>")), lambda x: F.map_from_entries(x)).alias("rows"),
    )
    at = _folder(spark, "pages")
    for half in (0, 1):
        sinks.append_pages(page.where(F.col("o_orderkey") % 2 == half).drop("o_orderkey"), f"{at}/books-0")
    return pages.read_pages(spark, f"{at}/books-*/*.json")


@query("""SELECT o_orderkey || '.png' AS file, 'fol. ' || o_custkey AS folio, o_orderstatus <> 'F' AS ok, count(l_orderkey)::INT AS rows, true AS numbered
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderstatus""")
def pages_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page; numbered: do the line numbers of its file run from 0 without a gap?"""
    p = _written_pages(spark, sf_dir)
    whole = p.groupBy("path").agg((F.max("line_no") == F.count("*") - 1).alias("to_last"), (F.count_distinct("line_no") == F.count("*")).alias("each_once"))
    return p.join(whole, "path").select("page.file", "page.folio", "page.ok", F.size("page.rows").alias("rows"), (F.col("to_last") & F.col("each_once")).alias("numbered"))


@query("""SELECT o_orderkey || '.png' AS file, l_partkey::VARCHAR AS cislo, CASE WHEN l_suppkey % 2 = 0 THEN 'umrti' ELSE 'narozeni' END AS record_type FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F'""")
def records_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.records(_written_pages(spark, sf_dir)).select("file", F.col("cells")["cislo"].alias("cislo"), "record_type")


@query("""SELECT (o_custkey % 20)::VARCHAR AS book_id, o_orderkey, o_custkey % 20 IN (3, 5) AS again FROM orders WHERE o_custkey % 20 NOT IN (3, 5) OR o_orderkey % 2 = 0""")
def replaced_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two books are written again with half their rows; the others stay as they were."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).cast("string").alias("book_id"), "o_orderkey")
    at = _folder(spark, "books")
    sinks.replace_books(o.withColumn("again", F.lit(False)), at)
    sinks.replace_books(o.where("book_id IN ('3', '5') AND o_orderkey % 2 = 0").withColumn("again", F.lit(True)), at)
    return spark.read.schema("o_orderkey long, again boolean, book_id string").parquet(at)


def _snapshot(spark: SparkSession, sf_dir: str) -> str:
    at = _folder(spark, "snapshot")
    none = spark.createDataFrame([], "mention_a long, mention_b long, score double, accepted boolean")
    r, o = register(spark, sf_dir), table(spark, sf_dir, "orders")
    records = o.select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").cast("string").alias("book_id"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".png")).alias("file"), F.lit(0).alias("row_idx"), F.lit("").alias("record_type"))
    links = r.person_mentions.withColumns({"confidence": F.lit(1.0), "source": F.lit("auto")})
    books = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    snapshot.write_snapshot(replace(r, records=records, books=books, person_mentions=links, events=r.events.withColumn("house_no", F.lit(""))), none, at)
    return at


@query(REG + " SELECT p.id, count(m.id) AS mentions FROM reg_persons p LEFT JOIN reg_links l ON l.person_id = p.id LEFT JOIN reg_mentions m ON m.id = l.mention_id GROUP BY p.id")
def snapshot_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = snapshot.read_snapshot(spark, _snapshot(spark, sf_dir), "details")
    return d.select("id", F.size(F.coalesce("mentions", F.array())).cast("long").alias("mentions"))


def _service(image: bytes, n: int) -> str:
    """A service that fails at first, talks at first, always fails, refuses, or answers, by the number of the page."""
    k = int(image.decode())
    if k % 5 == 2 or k % 5 == 0 and n < 2:
        raise TimeoutError(f"busy {n}")
    if k % 5 == 3 and k % 2:
        raise Refused("too large")
    return "let me see" if k % 5 == 1 and n == 0 else f'{{"rows": [{{"cislo": "{k}"}}]}}'


@query("""SELECT o_orderkey, k % 5 <> 2 AND NOT (k % 5 = 3 AND k % 2 = 1) AS answered, CASE WHEN k % 5 = 0 THEN 3 WHEN k % 5 = 1 THEN 2 WHEN k % 5 = 2 THEN 6 ELSE 1 END::INT AS tries,
  CASE WHEN k % 5 = 2 THEN 'busy 5' WHEN k % 5 = 3 AND k % 2 = 1 THEN 'too large' END AS error, CASE k % 5 WHEN 0 THEN 20.0 WHEN 2 THEN 70.0 ELSE 0.0 END::DOUBLE AS backed_off FROM (SELECT *, o_orderkey AS k FROM orders)""")
def asked_in_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scripted service asked about every order, at most four times, and again about those left, up to six; its clock is the tests' own."""

    def timer() -> tuple:
        now = [0.0]
        return (lambda: now[0]), (lambda s: now.__setitem__(0, now[0] + s))

    images = table(spark, sf_dir, "orders").select("o_orderkey", F.encode(F.col("o_orderkey").cast("string"), "UTF-8").alias("content"))
    pace = Pace(timer=timer)
    first = staged(quality.asked(images, _service, tries=4, pace=pace), "answers")
    left = unfinished(images, first.where("coalesce(error, '') <> 'too large'"), ["o_orderkey"], 6)
    again = quality.asked(left.where("tries IS NOT NULL"), _service, tries=6, pace=pace)
    both = first.unionByName(again).groupBy("o_orderkey")
    return both.agg(F.max("answered").alias("answered"), F.max("tries").alias("tries"), F.max_by("error", "tries").alias("error"), F.sum("backed_off").alias("backed_off"))


@query("SELECT json_object('n_nationkey', n_nationkey, 'n_name', n_name, 'n_regionkey', CASE WHEN n_regionkey > 0 THEN n_regionkey END)::VARCHAR AS json FROM nation")
def rows_as_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.as_objects(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")).alias("n_regionkey")))


@query("""SELECT CASE WHEN doc_id % 10 = 3 THEN 'val' ELSE 'train' END AS split, doc_id::VARCHAR AS id, sha256(text) AS sha256, strlen(text)::INT AS n_bytes, lang AS book FROM documents""")
def samples_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by split with their manifest of hashes."""
    d = table(spark, sf_dir, "documents")
    s = d.select(F.when(F.col("doc_id") % 10 == 3, "val").otherwise("train").alias("split"), F.col("doc_id").cast("string").alias("id"), F.lit("page").alias("kind"), F.lit("x.jpg").alias("image"), F.lit("read").alias("prompt"), F.col("text").alias("target"), F.create_map(F.lit("book"), "lang").alias("meta"))
    at = _folder(spark, "dataset")
    sinks.write_splits(s, at)
    read = pages.read_samples(spark, f"{at}/samples").select("id", F.octet_length("target").alias("n_bytes"), F.col("meta")["book"].alias("book"))
    return spark.read.schema("id string, sha256 string, split string").json(f"{at}/manifest").join(read, "id").select("split", "id", "sha256", "n_bytes", "book")
