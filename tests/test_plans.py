from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import functions as F

from quillspark.operators import identity, linkage
from quillspark.plans import analytics, catalog
from quillspark.plans.people import people
from quillspark.plans.register import register

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_needed_columns_are_read(spark):
    p = plan(catalog.QUERIES["timeline"](spark, SF))
    assert re.findall(r"ReadSchema: struct<([^>]*)>", p) == ["o_orderkey:bigint,o_orderdate:timestamp_ntz"] and p.count("Exchange") == 1


def test_filters_reach_the_scan(spark, tmp_path):
    at = str(tmp_path / "t")
    spark.range(100).withColumn("book_id", (F.col("id") % 5).cast("string")).write.mode("overwrite").partitionBy("book_id").parquet(at)
    p = plan(spark.read.parquet(at).where("book_id = '3' AND id > 50"))
    assert "PartitionFilters: [isnotnull(book_id" in p and "GreaterThan(id,50)" in p


def test_analyses_stay_in_the_jvm(spark):  # summary joins single rows
    r = register(spark, SF)
    assert not [k for k, f in analytics.ANALYSES.items() if k != "summary" and re.search("Python|Arrow|Cartesian|BroadcastNestedLoop", plan(f(r)))]


def test_pairs_come_from_one_equi_join(spark):
    m, e = people(spark, SF)
    p = plan(linkage.candidate_pairs(linkage.enriched(m, e)))
    assert not re.search("Cartesian|NestedLoop|Python", p) and re.search(r"(SortMerge|BroadcastHash|ShuffledHash)Join \[block", p)


def test_only_pairs_of_like_given_names_are_made(spark):
    m, e = people(spark, SF)
    m = linkage.enriched(m, e)
    near = lambda p: {(r["x"], r["y"]) for r in p.select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).collect()}
    every = linkage.candidate_pairs(m)
    alike = near(every.where(linkage.name_similarity("a.given_norm", "b.given_norm") >= linkage.LEAST_GIVEN))
    assert near(linkage.candidate_pairs(m, linkage.near_names(m, linkage.LEAST_GIVEN))) == alike and len(alike) < every.count()


def test_old_ids_are_not_broadcast(spark):
    new, old = spark.range(3).withColumnRenamed("id", "k"), spark.range(5).selectExpr("id AS k", "id + 10 AS i")
    df = identity.keep_ids(new, old, ["k"], ["k"], "i")
    assert "BroadcastHashJoin [k" not in plan(df) and {(r["k"], r["i"]) for r in df.collect()} == {(0, 10), (1, 11), (2, 12)}


def test_links_without_suggestions(spark):
    """Only pairs that can still be links are made; clusters, persons and relations are those of a whole run."""
    m, e = people(spark, "/root/testdata/sf0.001")
    whole, links = linkage.link(m, e), linkage.link(m, e, suggestions=False)
    same = lambda a, b, *c: sorted(map(tuple, a.select(*c).collect()), key=str) == sorted(map(tuple, b.select(*c).collect()), key=str)
    assert same(whole.person_mentions, links.person_mentions, "person_id", "mention_id", "confidence") and same(whole.persons, links.persons, *whole.persons.columns)
    assert same(whole.relations, links.relations, *whole.relations.columns) and same(whole.found, links.found, "id", "root")
    assert 0 < links.pairs.count() == whole.pairs.where("score >= 0.72").count() < whole.pairs.count()
    near = linkage.near_names(whole.mentions, linkage.LEAST_GIVEN)
    bound = linkage.candidate_pairs(whole.mentions, near, 0.72)
    assert links.pairs.count() <= bound.count() < linkage.candidate_pairs(whole.mentions, near).count()


def test_snapshots_are_gzipped(spark):
    from quillspark.plans import roundtrips

    at = roundtrips._snapshot(spark, "/root/testdata/sf0.001")
    names = [f.name for f in Path(at, "details").iterdir() if f.name.startswith("part-")]
    assert names and all(n.endswith(".json.gz") for n in names)


def test_only_some_pairs_are_suggested(spark):
    """A function of ids leaves all links and of the other pairs those it names; none is made by a broadcast of mentions."""
    m, e = people(spark, SF)
    m = linkage.enriched(m, e)
    some = lambda a, b: (a + b) % 3 == 1
    of = lambda p: {tuple(r) for r in p.select("a", "b", "score").collect()}
    every, part = of(linkage.scored_pairs(m)), of(linkage.scored_pairs(m, lambda a, b: F.when(some(a, b), 0.5).otherwise(0.72)))
    assert part == {x for x in every if x[2] >= 0.72 or (x[0] + x[1]) % 3 == 1} and len(part) < len(every)
    assert "BroadcastHashJoin [block" not in plan(linkage.candidate_pairs(m))


def _counted_scores(monkeypatch):
    """The steps in which pairs are scored, one entry each."""
    made, whole = [], linkage._explained
    monkeypatch.setattr(linkage, "_explained", lambda m, least: made.append(m) or whole(m, least))
    return made


def test_constraints_on_scored_pairs_cost_no_second_scoring(spark, monkeypatch):
    from quillspark.plans import people as P

    made = _counted_scores(monkeypatch)
    got = P.linkage_constrained(spark, "/root/testdata/sf0.001")
    assert len(made) == 1
    m, e = people(spark, "/root/testdata/sf0.001")
    want = linkage.link(m, e, P._constraints(linkage.scored_pairs(linkage.enriched(m, e)))).person_mentions
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def test_reruns_score_what_has_changed(spark, tmp_path, monkeypatch):
    """A rerun scores nothing if all mentions are as they were, else pairs with one that isn't; candidates are those of a whole run."""
    from quillspark.sources.versions import Versions

    m, e = people(spark, "/root/testdata/sf0.001")
    v = Versions(spark, f"{tmp_path}/v")
    linkage.rebuild(v, m.where("id % 7 <> 3"), e, t=linkage.Thresholds(flag=0.8))
    made = _counted_scores(monkeypatch)
    candidates = lambda c: sorted((r["mention_a"], r["mention_b"], r["score"], tuple(sorted(r["features"].items())), r["accepted"]) for r in c.collect())
    pairs = lambda df: {(r["a"], r["b"]) for r in df.select("a", "b").collect()}
    linkage.rebuild(v, m, e)
    again = linkage._explained(made[0], 0.5)
    whole = linkage.link(m, e, t=linkage.Thresholds(flag=0.8))
    assert 0 < len(pairs(again)) < len(pairs(whole.pairs)) and pairs(v.read("match_pairs")) == pairs(whole.pairs)
    n = len(made)
    # One mention goes, one gets another place, and the bound of suggestions is higher: the rest is kept.
    less = m.where("id <> 10").withColumn("place_text", F.when(F.col("id") == 20, "elsewhere").otherwise(F.col("place_text")))
    linkage.rebuild(v, less, e, t=linkage.Thresholds(flag=0.8, suggest=0.6))
    assert len(made) == n + 1 and made[-1].where("fresh").count() < 10
    first = linkage.link(less, e, t=linkage.Thresholds(flag=0.8, suggest=0.6))
    assert pairs(v.read("match_pairs")) == pairs(first.pairs)
    known = lambda c: sorted(x[:4] for x in candidates(c.where("accepted")))
    assert known(v.read("match_candidates")) == known(first.candidates)
    n = len(made)
    linkage.rebuild(v, less, e)
    assert len(made) == n and candidates(v.read("match_candidates")) == candidates(v.read("match_candidates", 3))


def test_snapshots_broadcast_no_persons(spark):
    """Neither persons nor books are broadcast, however small their files; relations are read, not made, by each part."""
    from dataclasses import replace

    from quillspark.plans import snapshot

    r = register(spark, SF)
    books = spark.read.parquet(f"{SF}/customer.parquet").selectExpr("CAST(c_custkey AS STRING) AS id", "c_name AS name")
    records = r.records.selectExpr("o_orderkey AS record_id", "CAST(o_custkey AS STRING) AS book_id", "'x.png' AS file", "0 AS row_idx", "'' AS record_type")
    none = spark.createDataFrame([], "mention_a long, mention_b long, score double, accepted boolean")
    whole = replace(r, records=records, books=books, person_mentions=r.person_mentions.selectExpr("*", "1.0D AS confidence", "'auto' AS source"), events=r.events.selectExpr("*", "'' AS house_no"))
    apart = snapshot._apart(whole)
    keys = ("person_a", "person_b", "parent", "otec_id", "matka_id", "person_id", "other_id", "book_id")
    found = lambda r: {k for f in (*snapshot.ANALYSES.values(), lambda r: snapshot.details(r, none)) for k in keys if f"BroadcastHashJoin [{k}#" in plan(f(r))}
    assert found(whole) and not found(apart)
    assert all("lineitem" not in plan(snapshot.ANALYSES[k](apart)) for k in ("family-size", "top-families"))
    for name in ("family-size", "top-families", "marriage-age"):
        assert sorted(map(str, snapshot.ANALYSES[name](whole).collect())) == sorted(map(str, snapshot.ANALYSES[name](apart).collect()))
