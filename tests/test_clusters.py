"""Clusters, lasting ids, blocks and edits against one-by-one definitions."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quillspark.operators import clusters, linkage, search
from quillspark.plans.people import people
from tests.test_register import greedy

SF = "/root/testdata/sf0.001"
PAIRS, CONS = "a long, b long, score double", "kind string, mention_a long, mention_b long"


@pytest.mark.parametrize(("seed", "ties"), [(11, 1), (13, 6)])
def test_dense_links_with_many_constraints(spark, seed, ties):
    """Few scores, so that ties decide; constraints inside most components; cannot-links between tied mentions are void."""
    r = random.Random(seed)
    pairs = r.sample(list(combinations(range(60), 2)), 160)
    may = [(0.72 + r.randrange(ties) / 20, a, b) for a, b in pairs[:110]]
    must, cannot = pairs[110:114], [*pairs[114:150], pairs[110]]
    cons = spark.createDataFrame([("must_link", a, b) for a, b in must] + [("cannot_link", b, a) for a, b in cannot], CONS)
    got = {x["id"]: x for x in linkage.clusters(spark.range(60), spark.createDataFrame([(a, b, s) for s, a, b in may], PAIRS), cons, 0.72).collect()}
    assert [got[i]["root"] for i in range(60)] == greedy(60, must, cannot, may, 0.72)
    assert all(got[got[i]["root"]]["component"] == got[i]["component"] for i in range(60))


def test_a_chain_that_waits(spark):
    n = 12
    may = [(i, i + 1, 0.99 - i / 100) for i in range(n - 1)]
    cons = spark.createDataFrame([("cannot_link", i, i + 2) for i in range(n - 2)], CONS)
    got = sorted(tuple(x)[:2] for x in linkage.clusters(spark.range(n), spark.createDataFrame(may, PAIRS), cons, 0.72).collect())
    assert [x for _, x in got] == greedy(n, [], [(i, i + 2) for i in range(n - 2)], [(s, a, b) for a, b, s in may], 0.72)


@pytest.mark.parametrize("seed", range(2))
def test_ids_as_chosen_one_by_one(spark, seed):
    r = random.Random(seed)
    found = [(i, r.randrange(12) * 10) for i in range(120)]
    before = [(r.randrange(1, 15), i) for i in range(100)]
    sizes = {root: [i for i, x in found if x == root] for root in {x for _, x in found}}
    want, taken, top = {}, set(), max(p for p, _ in before)
    for root in sorted(sizes, key=lambda x: (-len(sizes[x]), x)):
        shared = {}
        for p, i in before:
            if i in sizes[root] and p not in taken:
                shared[p] = shared.get(p, 0) + 1
        if shared:
            want[root] = min(shared, key=lambda p: (-shared[p], p))
            taken.add(want[root])
        else:
            top += 1
            want[root] = top
    got = clusters.lasting_ids(spark.createDataFrame(found, "id long, root long"), spark.createDataFrame(before, "person_id long, mention_id long"), max(p for p, _ in before))
    assert dict(map(tuple, got.select("root", "person_id").collect())) == want


def test_pairs_of_decades_are_all_pairs(spark):
    m, e = people(spark, SF)
    wide = linkage.enriched(m, e)
    wide = wide.withColumns({"year_min": F.when(F.col("id") % 9 == 4, 0).otherwise(F.col("year_min")), "year_max": F.when(F.col("id") % 9 == 4, 3000).otherwise(F.col("year_max"))})
    own = wide.where("surname_norm <> '' AND given_norm <> ''").withColumn("k", F.substring("surname_norm", 1, 4))
    plain = own.alias("a").join(own.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.sex") == F.col("b.sex")) & (F.col("a.id") < F.col("b.id")) & linkage.possible())
    want = sorted(tuple(x) for x in plain.select("a.id", "b.id").collect())
    assert sorted(tuple(x) for x in linkage.candidate_pairs(wide).select("a.id", "b.id").collect()) == want and len(want) > 100


def every(r):
    cut = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    return (
        cut(r.persons, "id", "display_name", "sex", "birth_year_est", "death_year_est", "confidence"), cut(r.person_mentions, "person_id", "mention_id", "confidence", "source"),
        cut(r.relations, "type", "person_a", "person_b", "confidence", F.array_sort("evidence"), "source"), cut(r.candidates, "mention_a", "mention_b", "score", "accepted"), cut(r.found, "id", "root", "component"),
    )


def test_edits_one_after_the_other(spark):
    """Merge two persons, split one, take a constraint back: each time what a whole run gives."""
    m, e = people(spark, SF)
    m = m.where("record_id < 60")
    last, cons = linkage.link(m, e), spark.createDataFrame([], CONS)
    large = [x["person_id"] for x in last.person_mentions.groupBy("person_id").count().orderBy(F.desc("count"), "person_id").limit(3).collect()]
    for step in ("merge", "split", "undo"):
        before = cons
        if step == "merge":
            cons = search.merge_persons(cons, last.person_mentions, large[0], large[1])
        elif step == "split":
            out = [x["mention_id"] for x in last.person_mentions.where(F.col("person_id") == large[2]).orderBy("mention_id").limit(1).collect()]
            cons = search.split_person(cons, last.person_mentions, large[2], out)
        else:
            cons = cons.where("kind = 'cannot_link'")
        cons = spark.createDataFrame(cons.collect(), CONS)
        again = linkage.relinked(last, before, cons)
        assert every(again) == every(linkage.link(m, e, cons, last.person_mentions))
        last = again
    assert linkage.relinked(last, None, None) is last
