"""Search, details and edits of persons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import fold_ascii, old_orthography, place_norm
from quillspark.sources.sinks import deep_link

MOST_HITS, MOST_CANDIDATES = 200, 20


def _norm(text: str) -> Column:
    return old_orthography(fold_ascii(F.lit(text.strip())))


def search(persons: DataFrame, mentions: DataFrame, person_mentions: DataFrame, q: str = "", surname: str = "", place: str = "", year_from: int | None = None, year_to: int | None = None, most: int = MOST_HITS) -> DataFrame:
    """Persons that meet all conditions, by name: id, name, sex, birth_year, death_year, confidence, mention_count.

    Each word of q starts a given name or surname of some mention; surname starts a
    surname; place is part of a place's text, ASCII case aside; years bound the birth (or
    death) year. One pass over the mentions tests all of them.
    """
    m = person_mentions.select("person_id", "mention_id").join(mentions.select(F.col("id").alias("mention_id"), "given_norm", "surname_norm", "place_text"), "mention_id")
    tests = [F.startswith("given_norm", _norm(t)) | F.startswith("surname_norm", _norm(t)) for t in q.split()]
    tests += [F.startswith("surname_norm", _norm(surname))] if surname.strip() else []
    tests += [F.contains(F.lower("place_text"), F.lower(F.lit(place.strip())))] if place.strip() else []
    known = m.groupBy("person_id").agg(F.count("*").alias("mention_count"), *(F.coalesce(F.bool_or(t), F.lit(False)).alias(f"__t{i}") for i, t in enumerate(tests)))
    years = [F.coalesce("birth_year_est", "death_year_est", F.lit(9999)) >= year_from] if year_from is not None else []
    years += [F.coalesce("birth_year_est", "death_year_est", F.lit(0)) <= year_to] if year_to is not None else []
    found = persons.join(known.withColumnRenamed("person_id", "id"), "id", "left").withColumn("mention_count", F.coalesce("mention_count", F.lit(0).cast("long")))
    for test in [F.coalesce(f"__t{i}", F.lit(False)) for i in range(len(tests))] + years:
        found = found.where(test)
    return found.select("id", F.col("display_name").alias("name"), "sex", F.col("birth_year_est").alias("birth_year"), F.col("death_year_est").alias("death_year"), "confidence", "mention_count").orderBy("name", "id").limit(most)


def provenance(mentions: DataFrame, records: DataFrame, events: DataFrame, person_mentions: DataFrame, books: DataFrame | None = None, base_url: str = "") -> DataFrame:
    """Mentions with record, book, event, person and link to the scan."""
    r = records.select("record_id", "book_id", "file", "row_idx", "record_type")
    e = events.select("record_id", F.col("type").alias("event_type"), F.col("date").alias("event_date"), F.col("year").alias("event_year"), F.col("place_text").alias("event_place"), "house_no")
    p = person_mentions.select(F.col("mention_id").alias("id"), "person_id", F.col("confidence").alias("link_confidence"), "source")
    # Records get their events and books before they meet the mentions, which are many more and wider, so that these are shuffled for two joins only.
    r = r.join(e, "record_id", "left")
    named = ["book_id"] if books is not None else []
    if books is not None:
        r = r.join(books.select(F.col("id").alias("book_id"), F.col("name").alias("book_name")), "book_id")
    r = r.withColumn("link", deep_link("book_id", "file", base_url))
    out = mentions.join(p, "id", "left").join(r, "record_id")
    first = [*named, "id", "record_id", *(c for c in mentions.columns if c not in ("id", "record_id"))]
    last = [*p.columns[1:], *(["book_name"] if named else []), "link"]
    return out.select(*first, *(c for c in r.columns if c not in {*first, *last}), *last)


def candidates_of(persons: DataFrame, person_mentions: DataFrame, candidates: DataFrame) -> DataFrame:
    """(person_id, other_id, other_name, score) of open candidates, in both directions."""
    of = lambda m, p: person_mentions.select(F.col("mention_id").alias(m), F.col("person_id").alias(p))
    c = candidates.where("NOT accepted").join(of("mention_a", "pa"), "mention_a").join(of("mention_b", "pb"), "mention_b").where("pa <> pb").select("pa", "pb", "score")
    both = c.select(F.col("pa").alias("person_id"), F.col("pb").alias("other_id"), "score").unionByName(c.select(F.col("pb").alias("person_id"), F.col("pa").alias("other_id"), "score"))
    return both.distinct().join(persons.select(F.col("id").alias("other_id"), F.col("display_name").alias("other_name")), "other_id").select("person_id", "other_id", "other_name", "score")


def person_detail(person_id: int, persons: DataFrame, provenanced: DataFrame, open_candidates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The person; the mentions by year and id; at most 20 candidates, the best first."""
    own = F.col("person_id") == person_id
    return persons.where(F.col("id") == person_id), provenanced.where(own).orderBy(F.coalesce("event_year", F.lit(0)), "id"), open_candidates.where(own).orderBy(F.desc("score"), "other_id").limit(MOST_CANDIDATES)


def record_detail(record_id: int, records: DataFrame, corrections: DataFrame, books: DataFrame) -> DataFrame:
    """A record's cells, its corrections and where it is from."""
    fixes = corrections.where(F.col("record_id") == record_id).groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("cell_key", "corrected_value"))).alias("corrections"))
    return records.where(F.col("record_id") == record_id).join(fixes, "record_id", "left").join(books.select(F.col("id").alias("book_id"), F.col("name").alias("book_name")), "book_id")


def search_index(persons: DataFrame, mentions: DataFrame, person_mentions: DataFrame) -> DataFrame:
    """Persons with sorted distinct surnames (maiden too), given names and place forms."""
    m = person_mentions.select("person_id", F.col("mention_id").alias("id")).join(mentions, "id")
    filled = lambda *cs: F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.filter(F.array(*cs), lambda x: x != "")))))
    by = m.groupBy("person_id").agg(F.count("*").alias("mention_count"), filled("surname_norm", "maiden_norm").alias("surname_norms"), filled("given_norm").alias("given_norms"), filled(place_norm("place_text")).alias("places"))
    return persons.join(by.withColumnRenamed("person_id", "id"), "id", "left")


def corrected_cell(corrections: DataFrame, record_id: int, cell_key: str, value: str) -> DataFrame:
    """corrections with one cell set."""
    rest = corrections.where((F.col("record_id") != record_id) | (F.col("cell_key") != cell_key))
    one = corrections.sparkSession.range(1).select(F.lit(record_id).cast("long").alias("record_id"), F.lit(cell_key).alias("cell_key"), F.lit(value).alias("corrected_value"))
    return rest.select("record_id", "cell_key", "corrected_value").unionByName(one)


def added_constraint(constraints: DataFrame, kind: str, a: int, b: int, note: str = "") -> DataFrame:
    """constraints (id, kind, mention_a, mention_b, note) and one more, its id after the largest."""
    if kind not in ("must_link", "cannot_link") or not a or not b:
        raise ValueError("a constraint is a must_link or cannot_link of two mentions")
    one = constraints.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).cast("long").alias("id"))
    one = one.select("id", F.lit(kind).alias("kind"), F.lit(a).cast("long").alias("mention_a"), F.lit(b).cast("long").alias("mention_b"), F.lit(note).alias("note"))
    return constraints.select(one.columns).unionByName(one)


def without_constraint(constraints: DataFrame, constraint_id: int) -> DataFrame:
    """constraints but the one of an id."""
    return constraints.where(F.col("id") != constraint_id)


def _constraint(like: DataFrame, kind: str, pair: DataFrame) -> DataFrame:
    return like.select("kind", "mention_a", "mention_b").unionByName(pair.select(F.lit(kind).alias("kind"), "mention_a", "mention_b"))


def merge_persons(constraints: DataFrame, person_mentions: DataFrame, a: int, b: int) -> DataFrame:
    """Constraints after merging: no cannot-link across the two, a must-link of their first mentions."""
    of = lambda m: person_mentions.where(F.col("person_id").isin(a, b)).select(F.col("mention_id").alias(m), F.col("person_id").alias(f"p_{m}"))
    across = constraints.where("kind = 'cannot_link'").join(of("mention_a"), "mention_a").join(of("mention_b"), "mention_b").where("p_mention_a <> p_mention_b").select("kind", "mention_a", "mention_b")
    kept = constraints.join(across, ["kind", "mention_a", "mention_b"], "left_anti")
    first = person_mentions.where(F.col("person_id").isin(a, b)).groupBy("person_id").agg(F.min("mention_id").alias("m")).agg(F.min("m").alias("mention_a"), F.max("m").alias("mention_b"))
    return _constraint(kept, "must_link", first)


def split_person(constraints: DataFrame, person_mentions: DataFrame, person_id: int, out: list[int]) -> DataFrame:
    """Constraints after taking mentions out of a person: no must-link across, one cannot-link; both sides hold some."""
    own = person_mentions.where(F.col("person_id") == person_id).select("mention_id", F.col("mention_id").isin(*out).alias("goes"))
    sides = own.agg(F.min(F.when(F.col("goes"), F.col("mention_id"))).alias("mention_a"), F.min(F.when(~F.col("goes"), F.col("mention_id"))).alias("mention_b"))
    row = sides.first()
    if row["mention_a"] is None or row["mention_b"] is None:
        raise ValueError("a split needs mentions on both sides")
    of = lambda m: own.select(F.col("mention_id").alias(m), F.col("goes").alias(f"g_{m}"))
    across = constraints.where("kind = 'must_link'").join(of("mention_a"), "mention_a").join(of("mention_b"), "mention_b").where("g_mention_a <> g_mention_b").select("kind", "mention_a", "mention_b")
    return _constraint(constraints.join(across, ["kind", "mention_a", "mention_b"], "left_anti"), "cannot_link", sides)
