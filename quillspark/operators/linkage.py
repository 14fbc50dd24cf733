"""Mentions to persons: blocking, scoring, clustering, lasting ids, relations.

Pairs come from equi-joins on (first four letters of the surname, sex, decade of birth);
vetoes are residual predicates of the join, so only pairs that may be one person reach the
similarity, which runs on distinct pairs of unequal names. Clusters and ids settle in rounds of
joins. After an edit of constraints only the components that it touches are done again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.similarity import name_similarity
from quillspark.functions.text import place_norm
from quillspark.operators.clusters import changed, clusters, largest_id, lasting_ids
from quillspark.sources.versions import Versions
from quillspark.storage import staged

__all__ = ["Linkage", "Thresholds", "candidate_pairs", "clusters", "enriched", "lasting_ids", "link", "possible", "rebuild", "relations_of", "relinked", "scored_pairs"]

PARENTS_OF = ("zenich", "nevesta", "zemrely", "otec", "matka")
ONCE = ("dite", "zemrely")
UNREADABLE = "(nečitelné jméno)"
#: Years of a block, and how many years of birth a mention may have to be put into blocks by years.
DECADE, WIDE = 10, 200
#: What the given names of a pair must have in common.
LEAST_GIVEN = 0.70


@dataclass(frozen=True)
class Thresholds:
    """auto is kept for the record; merging starts at flag, candidates at suggest."""

    auto: float = 0.90
    flag: float = 0.72
    suggest: float = 0.50


@dataclass(frozen=True)
class Linkage:
    """What a run gives; mentions (enriched), pairs, found (id, root, component, linked), named (id, person_id) and sure (person_id, confidence, where it has links) are what a later edit needs."""

    persons: DataFrame
    person_mentions: DataFrame
    relations: DataFrame
    candidates: DataFrame
    mentions: DataFrame
    pairs: DataFrame
    found: DataFrame
    named: DataFrame
    sure: DataFrame


def enriched(mentions: DataFrame, events: DataFrame) -> DataFrame:
    """Mentions with event, place norm, parents' names and the plausible years of birth (year_min, year_max)."""
    e = events.select("record_id", F.col("type").alias("event_type"), F.col("year").alias("event_year"))
    m = mentions.join(e, "record_id", "left").withColumn("place_fold", place_norm("place_text"))
    of = F.col("role")
    m = m.withColumn("__f", F.when(of == "dite", "otec").when(of.isin(*PARENTS_OF), F.concat(of, F.lit("_otec")))).withColumn("__m", F.when(of == "dite", "matka").when(of.isin(*PARENTS_OF), F.concat(of, F.lit("_matka"))))
    # The parents of a record, one for each role, meet its mentions in the shuffle that brings the event.
    parents = mentions.where(F.col("role").isin("otec", "matka", *(f"{r}_{p}" for r in PARENTS_OF for p in ("otec", "matka")))).repartition("record_id")
    parents = parents.groupBy("record_id", "role").agg(F.max_by(F.struct("given_norm", "surname_norm"), "ordinal").alias("n")).groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "n"))).alias("__p"))
    m = m.join(parents, "record_id", "left")
    for side, slot in (("father", "__f"), ("mother", "__m")):
        m = m.withColumn("__n", F.try_element_at("__p", slot)).withColumns({f"{side}_given": F.coalesce("__n.given_norm", F.lit("")), f"{side}_surname": F.coalesce("__n.surname_norm", F.lit(""))}).drop("__n", slot)
    m = m.drop("__p")
    year, own = F.col("event_year"), F.col("birth_year")
    span = lambda back, to: F.struct((year - back).alias("lo"), (year - to).alias("hi"))
    years = (
        F.when(own > 0, F.struct((own - 2).alias("lo"), (own + 2).alias("hi")))
        .when(year > 0, F.when(of == "dite", span(1, 0)).when(of.isin("zenich", "nevesta"), span(60, 15)).when(of == "zemrely", span(105, 0)).otherwise(span(75, 15)))
        .otherwise(F.struct(F.lit(0).alias("lo"), F.lit(3000).alias("hi")))
    )
    return m.withColumn("__y", years).withColumns({"year_min": F.col("__y.lo"), "year_max": F.col("__y.hi")}).drop("__y")


KEEP = ("id", "record_id", "role", "given_norm", "surname_norm", "maiden_norm", "sex", "birth_year", "event_year", "place_fold", "father_given", "father_surname", "mother_given", "mother_surname", "year_min", "year_max")


def possible(a: str = "a", b: str = "b") -> Column:
    """No veto: different records, agreeing sexes, once-only roles, nobody dead at a later event, years that meet."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    later = lambda p, q: (p("role") == "zemrely") & (p("event_year") > 0) & (q("event_year") > p("event_year"))
    veto = (
        (x("record_id") == y("record_id"))
        | (x("sex") != "") & (y("sex") != "") & (x("sex") != y("sex"))
        | x("role").isin(*ONCE) & (x("role") == y("role"))
        | F.coalesce(later(x, y) | later(y, x), F.lit(False))
        | (x("year_max") < y("year_min"))
        | (y("year_max") < x("year_min"))
    )
    return ~veto


def near_names(own: DataFrame, least: float) -> DataFrame:
    """(given_norm, near): for each given name those that any block and sex has with it, with the similarity if it comes first (ahead) and last (behind), null if below `least`; each pair is compared once."""
    names = own.select(F.substring("surname_norm", 1, 4).alias("block"), "sex", "given_norm").where("surname_norm <> '' AND given_norm <> ''").distinct()
    both = names.join(names.withColumnRenamed("given_norm", "other"), ["block", "sex"]).select("given_norm", "other").distinct()
    # Written before they are compared: the optimizer would else compare them under the first distinct, in each block again.
    alike = staged(both, "names").withColumn("s", name_similarity("given_norm", "other")).where(F.col("s") >= least)
    turned = alike.select(F.col("other").alias("given_norm"), F.col("given_norm").alias("other"), F.lit(None).cast("double").alias("ahead"), F.col("s").alias("behind"))
    turned = alike.select("given_norm", "other", F.col("s").alias("ahead"), F.lit(None).cast("double").alias("behind")).unionByName(turned).groupBy("given_norm", "other").agg(F.struct(F.max("ahead").alias("ahead"), F.max("behind").alias("behind")).alias("s"))
    return staged(turned.groupBy("given_norm").agg(F.map_from_entries(F.collect_list(F.struct("other", "s"))).alias("near")), "near")


def _born(gap: Column) -> Column:
    return F.when(gap == 0, 0.15).when(gap <= 2, 0.08).when(gap > 2, -0.20).otherwise(0.0)


def _total(given: Column, surname: Column, gap: Column, place: Column, father: Column, mother: Column) -> tuple[Column, Column]:
    """The score before it is cut to 0..1, and what parents add to it; it grows with each of them but gap."""
    parents = F.when(father & mother, 0.15).when(father | mother, 0.08).otherwise(0.0)
    return F.lit(0.35) * given + F.lit(0.35) * surname + _born(gap) + F.when(place, 0.08).otherwise(0.0) + parents, parents


def _both(c: str) -> Column:
    return (F.coalesce(F.col(f"a.{c}"), F.lit("")) != "") & (F.coalesce(F.col(f"b.{c}"), F.lit("")) != "")


def _gap() -> Column:
    year = lambda side: F.when(F.col(f"{side}.birth_year") > 0, F.col(f"{side}.birth_year"))
    return F.abs(year("a") - year("b"))


def _same_place() -> Column:
    return _both("place_fold") & (F.col("a.place_fold") == F.col("b.place_fold"))


#: The least score that a pair of ids, the smaller first, must have: a number, or what a function of both columns gives.
Least = float | Callable[[Column, Column], Column]


def _least(of: Least, a: Column, b: Column) -> Column:
    return of(a, b) if callable(of) else F.lit(of)


def candidate_pairs(m: DataFrame, near: DataFrame | None = None, least: Least = 0.0) -> DataFrame:
    """Pairs (a, b), each a struct, of enriched mentions in one block, a.id < b.id, without veto.

    A block is (first letters of the surname, sex, decade of birth). A mention is in all decades
    of its plausible years, and a pair is made in the first that both are in: the first of one of
    them, so each mention in its first decade meets those in all of theirs. Mentions that may be
    born over more than WIDE years are in no decade: they meet all others of their letters and sex.
    near (of near_names) keeps the pairs whose given names it has, and adds their similarity as
    `given`, and only of those that would have a score of `least` if all else were alike: inside the join, before a pair is made.
    If m says which mentions are fresh, only pairs with a fresh one are made.
    """
    marked = "fresh" in m.columns
    own = m.where("surname_norm <> '' AND given_norm <> ''").select(*KEEP, *(["fresh"] if marked else []))
    own = own.withColumns({"block": F.substring("surname_norm", 1, 4), "wide": F.col("year_max") - F.col("year_min") > WIDE})
    known = own if near is None else own.join(near, "given_norm")
    # Not turned after a join: one join with turned pairs was far slower than these two, presumably since its code was too long to be compiled.
    both = F.struct(*(F.col(f"a.{c}") for c in KEEP)).alias("a"), F.struct(*(F.col(f"b.{c}") for c in KEEP)).alias("b")
    same = (F.col("a.block") == F.col("b.block")) & (F.col("a.sex") == F.col("b.sex")) & (F.col("a.id") < F.col("b.id"))
    if marked:
        same = same & (F.col("a.fresh") | F.col("b.fresh"))

    def met(a: DataFrame, b: DataFrame, at: Column, knows: str) -> DataFrame:
        """Pairs of a and b; one side knows the names near its own."""
        # Not by broadcast: mentions are far smaller as a file than in memory, in all their decades above all.
        a, b = a.alias("a").hint("merge"), b.alias("b")
        if near is None:
            return a.join(b, same & at & possible()).select(*both)
        given = F.try_element_at("a.near", F.col("b.given_norm"))["ahead"] if knows == "a" else F.try_element_at("b.near", F.col("a.given_norm"))["behind"]
        score = _total(given, F.lit(1.0), _gap(), _same_place(), _both("father_given"), _both("mother_given"))[0]
        return a.join(b, same & at & given.isNotNull() & possible() & (score >= _least(least, F.col("a.id"), F.col("b.id")))).select(*both, given.alias("given"))

    decade = lambda c: F.floor(F.col(c) / DECADE)
    dated = lambda df: df.where("NOT wide").withColumn("first", decade("year_min"))
    all_of, first_of = dated(own).withColumn("decade", F.explode(F.sequence("first", decade("year_max")))), dated(known).withColumn("decade", F.col("first"))
    here = F.col("a.decade") == F.col("b.decade")
    later, earlier = met(all_of, first_of, here & (F.col("a.first") <= F.col("b.first")), "b"), met(first_of, all_of, here & (F.col("b.first") < F.col("a.first")), "a")
    wide = known.where("wide")
    return later.unionByName(earlier).unionByName(met(own, wide, F.lit(True), "b")).unionByName(met(wide, own, ~F.col("b.wide"), "a"))


def _or(a: Column, b: Column) -> Column:
    return F.when(a == "", b).otherwise(a)


def similarities(pairs: DataFrame) -> DataFrame:
    """a, b, what their scores need, and the similarities of their names; each batch compares a pair of names once."""
    x, y = (lambda c: F.coalesce(F.col(f"a.{c}"), F.lit(""))), (lambda c: F.coalesce(F.col(f"b.{c}"), F.lit("")))
    woman = (F.col("a.sex") == "f") | (F.col("b.sex") == "f")
    known = {"given": F.col("given")} if "given" in pairs.columns else {"given": name_similarity(x("given_norm"), y("given_norm"))}
    names = {
        "surname": (x("surname_norm"), y("surname_norm")),
        # Only women's maiden names count.
        "maiden": tuple(F.when(woman, _or(c("maiden_norm"), c("surname_norm"))) for c in (x, y)),
        "father_g": (x("father_given"), y("father_given")),
        "father_s": (x("father_surname"), y("father_surname")),
        "mother_g": (x("mother_given"), y("mother_given")),
    }
    return pairs.select(
        F.col("a.id").alias("a"), F.col("b.id").alias("b"), woman.alias("woman"), _gap().alias("gap"), _same_place().alias("place"), _both("father_given").alias("fathers"), _both("father_surname").alias("father_surnames"),
        _both("mother_given").alias("mothers"), *(c.alias(k) for k, c in known.items()), *(name_similarity(p, q).alias(k) for k, (p, q) in names.items()),
    )


#: What a score is made of; born is the class of the years between two births: 0 equal, 1 close, 2 in conflict.
WHY = ("given", "surname", "maiden_used", "born", "place", "parents")


def _features(why: Column) -> Column:
    """The map of features of a pair; made last, since it is many times larger than what it is made of."""
    feature = {
        "given": why["given"], "surname": why["surname"], "maiden_used": F.when(why["maiden_used"], 1.0), "birth_year_exact": F.when(why["born"] == 0, 1.0),
        "birth_year_close": F.when(why["born"] == 1, 1.0), "birth_year_conflict": F.when(why["born"] == 2, 1.0), "place": F.when(why["place"], 1.0), "parents": F.when(why["parents"] > 0, why["parents"]),
    }
    return F.map_filter(F.create_map(*(x for k, v in feature.items() for x in (F.lit(k), v))), lambda _, v: v.isNotNull())


def _explained(m: DataFrame, suggest: Least) -> DataFrame:
    """scored_pairs with why instead of features."""
    s = staged(similarities(candidate_pairs(m, near_names(m, LEAST_GIVEN), suggest)), "similarities")
    by_maiden = F.col("woman") & (F.col("maiden") > F.col("surname"))
    surname = F.when(by_maiden, F.col("maiden")).otherwise(F.col("surname"))
    gap, place = F.col("gap"), F.col("place")
    father = F.col("fathers") & (F.col("father_g") >= 0.85) & (~F.col("father_surnames") | (F.col("father_s") >= 0.85))
    mother = F.col("mothers") & (F.col("mother_g") >= 0.85)
    total, parents = _total(F.col("given"), surname, gap, place, father, mother)
    parts = F.col("given"), surname, by_maiden, F.when(gap == 0, 0).when(gap <= 2, 1).when(gap > 2, 2), place, parents
    near = s.where((F.col("given") >= LEAST_GIVEN) & (surname >= 0.75))
    out = near.select("a", "b", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)).alias("score"), F.struct(*(c.alias(k) for k, c in zip(WHY, parts, strict=True))).alias("why"))
    return out.where(F.col("score") >= _least(suggest, F.col("a"), F.col("b")))


def scored_pairs(m: DataFrame, suggest: Least = Thresholds.suggest) -> DataFrame:
    """a, b, score, features of all pairs of enriched mentions with score >= suggest."""
    return _explained(m, suggest).select("a", "b", "score", _features(F.col("why")).alias("features"))


def _rescored(m: DataFrame, before: tuple[DataFrame, DataFrame], suggest: float) -> DataFrame:
    """_explained, of which before has the mentions and pairs of an earlier run with the same bound or a lower one: a pair of two mentions that are what they were is not scored again."""
    former, pairs = before
    pairs = pairs.where(F.col("score") >= suggest)
    told = lambda df, name: df.select("id", F.struct(*KEEP).alias(name))
    both = staged(told(m, "now").join(told(former, "then"), "id", "full").select("id", F.col("now").isNull().alias("gone"), (~F.col("now").eqNullSafe(F.col("then"))).alias("changed")), "compared")
    stays = both.where("NOT changed").select("id")
    if both.where("changed").isEmpty():
        return pairs
    kept = pairs.join(stays.withColumnRenamed("id", "a"), "a", "left_semi").join(stays.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b", "score", "why")
    fresh = both.where("changed AND NOT gone").select("id", F.lit(True).alias("fresh"))
    anew = _explained(m.join(fresh, "id", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False))), suggest)
    return staged(kept.unionByName(anew), "pairs")


def _summaries(m: DataFrame) -> DataFrame:
    """(person_id, display_name, sex, birth_year_est, death_year_est) of enriched mentions with person_id."""
    full = lambda g, s: F.btrim(F.concat_ws(" ", F.nullif(F.coalesce(g, F.lit("")), F.lit("")), F.nullif(F.coalesce(s, F.lit("")), F.lit(""))))
    name = _or(full("given_name", "surname"), full("given_norm", "surname_norm"))
    weight = F.when(F.col("role").isin("dite", "zenich", "nevesta", "zemrely"), 3).when(F.col("role").isin("otec", "matka"), 2).otherwise(1)
    votes = m.select("person_id", name.alias("name"), weight.alias("w")).where("name <> ''").groupBy("person_id", "name").agg(F.sum("w").alias("v"))
    names = votes.groupBy("person_id").agg(F.min(F.struct((-F.col("v")).alias("v"), "name"))["name"].alias("display_name"))
    baptised = (F.col("role") == "dite") & (F.col("event_type") == "birth") & (F.col("event_year") > 0)
    rest = m.groupBy("person_id").agg(
        F.count_if(F.col("sex") == "m").alias("men"),
        F.count_if(F.col("sex") == "f").alias("women"),
        F.coalesce(F.max_by(F.when(baptised, F.col("event_year")), F.when(baptised, F.col("id"))), F.min_by(F.when(F.col("birth_year") > 0, F.col("birth_year")), F.when(F.col("birth_year") > 0, F.col("id")))).alias("birth_year_est"),
        F.max_by(F.when((F.col("role") == "zemrely") & (F.col("event_year") > 0), F.col("event_year")), F.when((F.col("role") == "zemrely") & (F.col("event_year") > 0), F.col("id"))).alias("death_year_est"),
    )
    sex = F.when(F.col("men") > F.col("women"), "m").when(F.col("women") > 0, "f").otherwise("")
    return rest.join(names, "person_id", "left").select("person_id", F.coalesce("display_name", F.lit(UNREADABLE)).alias("display_name"), sex.alias("sex"), "birth_year_est", "death_year_est")


def relation_rules() -> list[tuple[str, str, str]]:
    """(type, role a, role b) of all relations that roles in one record imply."""
    own = [("parent_child", "otec", "dite"), ("parent_child", "matka", "dite"), ("spouse", "otec", "matka"), ("spouse", "zenich", "nevesta")]
    of = [r for p in ("otec", "matka", "zenich", "nevesta", "zemrely") for r in (("parent_child", f"{p}_otec", p), ("parent_child", f"{p}_matka", p), ("spouse", f"{p}_otec", f"{p}_matka"))]
    return own + of


def relations_of(roles: DataFrame, confidence: DataFrame | None = None) -> DataFrame:
    """Relations of roles (record_id, role, person_id): type, person_a, person_b, confidence, evidence, source.

    A person stands for a role of a record; of several, the last in order of id. The rules
    are constants, so they are broadcast. Persons that confidence lacks have 1.
    """
    spark = roles.sparkSession
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{t}', '{a}', '{b}')" for t, a, b in relation_rules()) + " AS r(type, role_a, role_b)")
    a = roles.select("record_id", F.col("role").alias("role_a"), F.col("person_id").alias("pa")).join(F.broadcast(rules), "role_a")
    b = roles.select("record_id", F.col("role").alias("role_b"), F.col("person_id").alias("pb"))
    found = a.join(b, ["record_id", "role_b"]).where("pa <> pb")
    turn = (F.col("type") == "spouse") & (F.col("pa") > F.col("pb"))
    edges = found.select("type", F.when(turn, F.col("pb")).otherwise(F.col("pa")).alias("person_a"), F.when(turn, F.col("pa")).otherwise(F.col("pb")).alias("person_b"), "record_id")
    out = edges.groupBy("type", "person_a", "person_b").agg(F.array_sort(F.collect_list("record_id")).alias("evidence"))
    if confidence is None:
        return out.withColumns({"confidence": F.lit(1.0), "source": F.lit("auto")})
    c = lambda x, y: confidence.select(F.col("person_id").alias(x), F.col("confidence").alias(y))
    out = out.join(c("person_a", "ca"), "person_a", "left").join(c("person_b", "cb"), "person_b", "left")
    return out.select("type", "person_a", "person_b", F.least(F.coalesce("ca", F.lit(1.0)), F.coalesce("cb", F.lit(1.0))).alias("confidence"), "evidence", F.lit("auto").alias("source"))


def _described(m: DataFrame, links: DataFrame, named: DataFrame, constraints: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(persons, person_mentions, sure) of the mentions m; links: their pairs from the bound of links on; named: (id, person_id) of all ends of links."""
    inside = _placed(links.select("a", "b", "score"), named).where("pa = pb")
    sure = staged(inside.groupBy(F.col("pa").alias("person_id")).agg(F.min(F.floor(F.col("score") * 1000 + 0.5) / 1000).alias("confidence")), "sure")
    with_person = m.join(named.select("id", "person_id"), "id")
    persons = _surely(_summaries(with_person), sure)
    source = F.lit("auto")
    members = with_person.select("person_id", F.col("id").alias("mention_id"))
    if constraints is not None:
        bound = constraints.where("kind = 'must_link'").select(F.explode(F.array("mention_a", "mention_b")).alias("mention_id")).distinct().withColumn("__bound", F.lit(True))
        members, source = members.join(bound, "mention_id", "left"), F.when(F.col("__bound"), "constraint").otherwise("auto")
    return persons.withColumnRenamed("person_id", "id"), _surely(members, sure).select("person_id", "mention_id", "confidence", source.alias("source")), sure


def _surely(df: DataFrame, sure: DataFrame) -> DataFrame:
    """df (person_id, ...) with the confidence of the persons: 1 where they have no links."""
    return df.join(sure, "person_id", "left").withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))


def _placed(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """pairs with the persons pa and pb of their ends."""
    ends = lambda x, y: named.select(F.col("id").alias(x), F.col("person_id").alias(y))
    return pairs.join(ends("a", "pa"), "a").join(ends("b", "pb"), "b")


def _candidates(pairs: DataFrame, named: DataFrame, t: Thresholds) -> DataFrame:
    """Links inside a person (accepted), and pairs of two persons; made when they are read."""
    placed = _placed(pairs, named).withColumn("accepted", (F.col("score") >= t.flag) & (F.col("pa") == F.col("pb")))
    return placed.where("accepted OR pa <> pb").select(F.col("a").alias("mention_a"), F.col("b").alias("mention_b"), "score", _features(F.col("why")).alias("features"), "accepted")


def _relations(m: DataFrame, named: DataFrame, sure: DataFrame) -> DataFrame:
    roles = m.join(named, "id").groupBy("record_id", "role").agg(F.max_by("person_id", "id").alias("person_id"))
    return relations_of(roles, sure)


def link(
    mentions: DataFrame, events: DataFrame, constraints: DataFrame | Callable[[DataFrame], DataFrame] | None = None, previous: DataFrame | None = None, t: Thresholds | None = None,
    largest: int | None = None, suggestions: bool | Callable[[Column, Column], Column] = True, before: tuple[DataFrame, DataFrame] | None = None,
) -> Linkage:
    """A whole run. previous: the last person_mentions; largest: the largest person id ever given (else of previous).

    Constraints that depend on the scored pairs (a, b, score) are given as a function of these, so that pairs are scored once.
    before: mentions and pairs of an earlier run with the same t.suggest or a lower one; of them only what has changed is scored, if all pairs are suggested.

    Without suggestions only links are scored, pairs from t.flag on: clusters, persons and relations are the same, candidates and pairs lack the rest.
    A function of two columns of ids, the smaller first, says which pairs below t.flag are suggested; the others are never made.
    """
    t = t or Thresholds()
    links_only = max(t.flag, t.suggest)
    least = (lambda a, b: F.when(suggestions(a, b), t.suggest).otherwise(links_only)) if callable(suggestions) else t.suggest if suggestions else links_only
    m = staged(enriched(mentions, events), "enriched")
    pairs = staged(_explained(m, least), "pairs") if before is None or suggestions is not True else _rescored(m, before, t.suggest)
    constraints = constraints(pairs) if callable(constraints) else constraints
    found = staged(clusters(m, pairs, constraints, t.flag), "clusters")
    named = staged(found.join(lasting_ids(found, previous, largest_id(previous) if largest is None else largest), "root").select("id", "person_id"), "named")
    persons, links, sure = _described(m, pairs.where(F.col("score") >= t.flag), named, constraints)
    return Linkage(persons, links, _relations(m, named, sure), _candidates(pairs, named, t), m, pairs, found, named, sure)


def relinked(last: Linkage, before: DataFrame | None, after: DataFrame | None, t: Thresholds | None = None, largest: int | None = None) -> Linkage:
    """last, made under the constraints before and the same thresholds, as a whole run would make it under the constraints after with last's ids as the previous ones.

    Nothing is scored again, and what is linked without constraints is known. Clusters, ids, persons
    and candidates are made anew only in the components of mentions whose constraints differ,
    relations only in the records of these.
    """
    t = t or Thresholds()
    edited = changed(before, after)
    if edited is None:
        return last
    touched = last.found.join(edited, "id", "left_semi").select("component").distinct()
    own = staged(last.found.join(touched, "component", "left_semi").select("id", "linked"), "touched")
    of = lambda x: own.select(F.col("id").alias(x))
    mine = lambda df, x: df.join(of(x), x, "left_semi")
    others = lambda df, x: df.join(of(x), x, "left_anti")
    found = staged(clusters(own, last.pairs, after, t.flag, own), "clusters")
    former = mine(last.named, "id")
    ids = lasting_ids(found, former.withColumnRenamed("id", "mention_id"), largest_id(last.named) if largest is None else largest)
    anew = staged(found.join(ids, "root").select("id", "person_id"), "named")
    named = anew.unionByName(others(last.named, "id").select("id", "person_id"))
    m = mine(last.mentions, "id")
    # Both ends of a link are in one component.
    persons, links, sure = _described(m, mine(last.pairs.where(F.col("score") >= t.flag), "a"), anew, after)
    gone = former.select("person_id").union(anew.select("person_id")).distinct()
    kept = lambda df, x: df.join(gone.withColumnRenamed("person_id", x), x, "left_anti")
    persons = persons.unionByName(kept(last.persons, "id").select(persons.columns))
    sure = sure.unionByName(kept(last.sure, "person_id").select(sure.columns))
    records = last.mentions.join(m.select("record_id").distinct(), "record_id", "left_semi")
    end = lambda x: gone.select(F.col("person_id").alias(x)).withColumn(f"__{x}", F.lit(True))
    at = lambda df: df.join(end("person_a"), "person_a", "left").join(end("person_b"), "person_b", "left")
    fresh, old = at(_relations(records, named, sure)).where("__person_a OR __person_b"), at(last.relations).where("__person_a IS NULL AND __person_b IS NULL")
    relations = fresh.select(last.relations.columns).unionByName(old.select(last.relations.columns))
    links = links.unionByName(others(last.person_mentions, "mention_id").select(links.columns))
    pairs = last.pairs.join(of("a").withColumn("__a", F.lit(True)), "a", "left").join(of("b").withColumn("__b", F.lit(True)), "b", "left").where("__a OR __b").drop("__a", "__b")
    candidates = _candidates(pairs, named, t)
    candidates = candidates.unionByName(others(others(last.candidates, "mention_a"), "mention_b").select(candidates.columns))
    found = found.unionByName(others(last.found, "id").select(found.columns))
    return Linkage(persons, links, relations, candidates, last.mentions, last.pairs, found, named, sure)


def run_row(run_id: int, t: Thresholds, started_at: Column | None = None) -> list[Column]:
    """Columns of a row of the run log."""
    params = F.to_json(F.struct(F.lit(t.auto).alias("auto"), F.lit(t.flag).alias("flag"), F.lit(t.suggest).alias("suggest")))
    return [F.lit(run_id).alias("id"), (started_at if started_at is not None else F.current_timestamp()).alias("started_at"), params.alias("params")]


def last_thresholds(runs: DataFrame) -> Thresholds:
    """Those of the latest run, or the defaults."""
    row = runs.agg(F.max_by("params", "id").alias("p")).select(F.from_json("p", "auto double, flag double, suggest double").alias("p")).first()
    return Thresholds(**{k: v for k, v in row["p"].asDict().items() if v is not None}) if row and row["p"] else Thresholds()


def rebuild(versions: Versions, mentions: DataFrame, events: DataFrame, constraints: DataFrame | None = None, t: Thresholds | None = None) -> int:
    """A whole run over the current version's persons, committed as the next version; its number.

    Without thresholds those of the last run are taken. persons, person_mentions, relations,
    match_candidates and match_runs change together or not at all. match_mentions and
    match_pairs are what the next run needs to score only pairs of mentions that have changed.
    """
    known = versions.current() is not None
    runs = versions.read("match_runs") if known else None
    run_id = (runs.agg(F.max("id")).first()[0] if runs is not None else 0) + 1
    t = t or (last_thresholds(runs) if runs is not None else Thresholds())
    largest = versions.read("persons").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] if known else 0
    before = None
    if known and {"match_mentions", "match_pairs"} <= set(versions.tables()) and last_thresholds(runs).suggest <= t.suggest:
        before = versions.read("match_mentions"), versions.read("match_pairs")
    r = link(mentions, events, constraints, versions.read("person_mentions") if known else None, t, largest, before=before)
    log = versions.spark.range(1).select(*run_row(run_id, t))
    tables = {
        "persons": r.persons.withColumn("first_seen_run", F.lit(run_id)), "person_mentions": r.person_mentions, "relations": r.relations,
        "match_candidates": r.candidates.withColumn("run_id", F.lit(run_id)), "match_runs": log if runs is None else runs.unionByName(log),
        "match_mentions": r.mentions.select(*KEEP), "match_pairs": r.pairs,
    }
    return versions.commit(tables)
