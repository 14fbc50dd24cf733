"""Graphs as DataFrames: components, neighbourhoods, layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import fold_ascii, old_orthography, surname_norm
from quillspark.storage import staged

LAYERS = ("birth", "marriage", "death")
LEAST_SURE = 0.85


def adjacency(relations: DataFrame) -> DataFrame:
    """Both directions of each relation: u, v."""
    one = relations.select(F.col("person_a").alias("u"), F.col("person_b").alias("v"))
    return one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def _stars(e: DataFrame) -> bool:
    """Whether each u of the edges (u, v) has one v, which is no u."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("back")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("back")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("back").alias("back")).where("out > 1 OR out = 1 AND back = 1").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 64) -> DataFrame:
    """(node, root): the smallest node that each node with an edge reaches.

    Each round points every neighbour of a node to the smallest of them, first the larger
    ones, then the smaller ones, until only stars remain. Rounds end in staged tables.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = staged(e, "edges")
    for _ in range(most_rounds):
        if _stars(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        e = staged(e.join(low, "u").select(F.inline(pairs)).where("u <> v").distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def reached(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(id, depth) of all nodes within hops of the seeds (id), depth the least."""
    seen = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    front = seen
    for depth in range(1, hops + 1):
        step = front.join(edges, front["id"] == edges["u"]).select(F.col("v").alias("id")).distinct()
        front = staged(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)), "front")
        seen = seen.unionByName(front)
    return seen


def bounded(value: int, least: int, most: int, otherwise: int) -> int:
    return value if least <= value <= most else otherwise


def neighbourhood(person_id: int, persons: DataFrame, relations: DataFrame, depth: int = 2) -> DataFrame:
    """(id, depth) around one person; depth 1 to 6, else 2."""
    return reached(persons.where(F.col("id") == person_id).select("id"), adjacency(relations), bounded(depth, 1, 6, 2))


def surname_bearers(surname: Column | str, mentions: DataFrame, person_mentions: DataFrame) -> DataFrame:
    """Persons (id) that any mention gives the surname, own or maiden."""
    name = surname_norm(F.lit(surname) if isinstance(surname, str) else surname)
    own = mentions.where((F.col("surname_norm") == name) | (F.col("maiden_norm") == name))
    return own.join(person_mentions, own["id"] == person_mentions["mention_id"]).select(F.col("person_id").alias("id")).distinct()


def surname_tree(surname: str, mentions: DataFrame, person_mentions: DataFrame, relations: DataFrame, hops: int = 1) -> DataFrame:
    """(id, depth, focus) around all bearers of a surname; hops 1 to 3, else 1."""
    seeds = surname_bearers(surname, mentions, person_mentions)
    return reached(seeds, adjacency(relations), bounded(hops, 1, 3, 1)).withColumn("focus", F.col("depth") == 0)


def edge_layers(relations: DataFrame, events: DataFrame) -> DataFrame:
    """relations with layers: the event types of their evidence, in the order birth, marriage, death."""
    seen = relations.select("type", "person_a", "person_b", F.explode("evidence").alias("record_id")).join(events.select("record_id", F.col("type").alias("layer")), "record_id")
    by = seen.groupBy("type", "person_a", "person_b").agg(F.collect_set("layer").alias("__set"))
    ordered = F.filter(F.array(*map(F.lit, LAYERS)), lambda x: F.array_contains(F.coalesce("__set", F.array().cast("array<string>")), x))
    return relations.join(by, ["type", "person_a", "person_b"], "left").withColumn("layers", ordered).drop("__set")


def visible(active: list[str]) -> Column:
    """Whether an edge shows: it has no layers or an active one."""
    return (F.size("layers") == 0) | F.arrays_overlap("layers", F.array(*map(F.lit, active)).cast("array<string>"))


def low_confidence(c: str = "confidence") -> Column:
    """Whether a person or an edge is unsure."""
    return F.coalesce(F.col(c) < LEAST_SURE, F.lit(False))


def subgraph(nodes: DataFrame, persons: DataFrame, relations: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The persons of nodes (id, depth[, focus]) with has_death, and the edges among them with layers; both with low_confidence."""
    shown = persons.join(nodes, "id").withColumn("has_death", F.col("death_year_est").isNotNull())
    inside = relations.join(nodes.select(F.col("id").alias("person_a")), "person_a", "left_semi").join(nodes.select(F.col("id").alias("person_b")), "person_b", "left_semi")
    flagged = lambda d: d.withColumn("low_confidence", low_confidence() if "confidence" in d.columns else F.lit(False))
    return flagged(shown), flagged(edge_layers(inside, events))


def merged(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Nodes or edges of both, those of old first for the same key."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def search_norm(text: str | Column) -> Column:
    """Folded, w as v: the form in which names are searched."""
    return old_orthography(fold_ascii(F.lit(text) if isinstance(text, str) else text))
