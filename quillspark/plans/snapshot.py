"""A static snapshot of a linked register: search index, graph, details, analyses, counts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.graph import edge_layers
from quillspark.operators.search import MOST_CANDIDATES, candidates_of, provenance, search_index
from quillspark.plans.analytics import ANALYSES, Register, stats
from quillspark.sources.sinks import deep_link
from quillspark.storage import staged


def persons_index(r: Register) -> DataFrame:
    """One row per person for the search."""
    return search_index(r.persons, r.mentions, r.person_mentions)


def graph_edges(r: Register) -> DataFrame:
    """type, source, target, confidence, layers of every relation."""
    return edge_layers(r.relations, r.events).select("type", F.col("person_a").alias("source"), F.col("person_b").alias("target"), "confidence", "layers")


def details(r: Register, candidates: DataFrame, base_url: str = "") -> DataFrame:
    """Per person the mentions by year and id, and at most 20 open candidates, the best first."""
    m = provenance(r.mentions, r.records, r.events, r.person_mentions, r.books, base_url).where("person_id IS NOT NULL")
    own = ["id", "role", "raw_text", "given_name", "surname", "event_type", "event_date", "event_year", "book_name", "file", "link", "source"]
    own = [c for c in own if c in m.columns]
    # What follows from other columns is added where a person's mentions have met: it isn't shuffled.
    met = F.collect_list(F.struct(*(c for c in own if c != "link"), F.col("book_id").alias("__b")))
    whole = lambda x: F.struct(F.coalesce(x["event_year"], F.lit(0)).alias("__y"), *((deep_link(x["__b"], x["file"], base_url) if c == "link" else x[c]).alias(c) for c in own))
    mentions = m.groupBy("person_id").agg(F.transform(F.array_sort(F.transform(met, whole)), lambda x: x.dropFields("__y")).alias("mentions"))
    open_ones = candidates_of(r.persons, r.person_mentions, candidates)
    best = open_ones.groupBy("person_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("__s"), "other_id", "other_name", "score"))), 1, MOST_CANDIDATES).alias("c"))
    best = best.select("person_id", F.transform("c", lambda x: x.dropFields("__s")).alias("candidates"))
    return r.persons.join(mentions.withColumnRenamed("person_id", "id"), "id", "left").join(best.withColumnRenamed("person_id", "id"), "id", "left")


def _apart(r: Register) -> Register:
    """r whose relations are made once, not for each part that reads them; persons, books and relations are never broadcast, since they are far larger in memory than their columns' share of a file."""
    never = lambda df: None if df is None else df.hint("merge")
    return replace(r, persons=never(r.persons), books=never(r.books), relations=never(staged(r.relations, "relations")))


def write_snapshot(r: Register, candidates: DataFrame, path: str, base_url: str = "") -> None:
    """persons, graph, details, analytics/<name> and stats as JSON lines, gzipped, below path."""
    r = _apart(r)
    parts: dict[str, Callable[[], DataFrame]] = {"persons": lambda: persons_index(r), "graph": lambda: graph_edges(r), "details": lambda: details(r, candidates, base_url), "stats": lambda: stats(r)}
    parts |= {f"analytics/{k}": lambda f=f: f(r) for k, f in ANALYSES.items()}
    for name, make in parts.items():
        make().write.mode("overwrite").json(f"{path}/{name}", compression="gzip")


def as_objects(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def read_snapshot(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One part of a snapshot: persons, graph, details, stats or analytics/<name>; an error if it isn't there."""
    return spark.read.json(f"{path}/{name}")
