"""The named analyses over events, mentions, persons, person_mentions and relations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.dates import decade


@dataclass(frozen=True)
class Register:
    """The tables that analyses read."""

    events: DataFrame
    mentions: DataFrame
    persons: DataFrame
    person_mentions: DataFrame
    relations: DataFrame
    scans: DataFrame | None = None
    records: DataFrame | None = None
    books: DataFrame | None = None


def _count(when: Column, name: str) -> Column:
    return F.count_if(when).alias(name)


def _by_type(name: Column, events: DataFrame) -> DataFrame:
    kinds = [_count(F.col("type") == t, t) for t in ("birth", "marriage", "death")]
    return events.groupBy(name.alias("name")).agg(*kinds)


def surnames(r: Register, top: int = 30) -> DataFrame:
    """Persons per surname, the most frequent first."""
    own = r.mentions.where("surname_norm <> ''").select(F.col("id").alias("mention_id"), F.col("surname_norm").alias("name"))
    return own.join(r.person_mentions, "mention_id").groupBy("name").agg(F.countDistinct("person_id").alias("value")).orderBy(F.desc("value"), "name").limit(top)


def lifespan(r: Register) -> DataFrame:
    """Persons by decade of life reached, below 110 years."""
    span = F.col("death_year_est") - F.col("birth_year_est")
    return r.persons.where((span >= 0) & (span < 110)).groupBy(decade(span).alias("name")).agg(F.count("*").alias("value"))


def _weddings(r: Register) -> DataFrame:
    e = r.events.where("type = 'marriage'").select("record_id", "year", F.col("place_text").alias("target"))
    return r.mentions.where(F.col("role").isin("zenich", "nevesta")).join(e, "record_id")


def marriage_age(r: Register) -> DataFrame:
    """Mean age at the wedding by decade, of grooms and of brides; ages of 14 to 80."""
    born = r.persons.where("birth_year_est IS NOT NULL").select(F.col("id").alias("person_id"), "birth_year_est")
    w = _weddings(r).where("year IS NOT NULL").withColumnRenamed("id", "mention_id").join(r.person_mentions.select("mention_id", "person_id"), "mention_id").join(born, "person_id")
    age = F.col("year") - F.col("birth_year_est")
    mean = lambda role: F.round(F.avg(F.when(F.col("role") == role, age)), 1).alias(role)
    return w.where(age.between(14, 80)).groupBy(decade("year").alias("name")).agg(mean("zenich"), mean("nevesta"))


def seasonality(r: Register) -> DataFrame:
    """Events by month and type, of those dated to the month."""
    return _by_type(F.substring("date", 6, 2).try_cast("int"), r.events.where(F.col("date_precision").isin("day", "month")))


def migration(r: Register, top: int = 40) -> DataFrame:
    """From a spouse's place to the wedding's, where the texts differ."""
    w = _weddings(r).where("place_text <> '' AND target <> '' AND place_text <> target")
    return w.groupBy(F.col("place_text").alias("name"), "target").agg(F.count("*").alias("value")).orderBy(F.desc("value"), "name", "target").limit(top)


def children(r: Register) -> DataFrame:
    """(otec, matka, dite) of all children of a man and a woman."""
    sex = r.persons.select("id", "sex")
    kin = r.relations.where("type = 'parent_child'").select(F.col("person_a").alias("parent"), F.col("person_b").alias("dite")).join(sex.withColumnRenamed("id", "parent"), "parent")
    side = lambda s, name: kin.where(F.col("sex") == s).select(F.col("parent").alias(name), "dite").distinct()
    return side("m", "otec").join(side("f", "matka"), "dite")


def family_size(r: Register) -> DataFrame:
    """Couples by number of children; 0 for couples without a known one."""
    sex = lambda p: r.persons.select(F.col("id").alias(p), F.col("sex").alias(f"{p}_sex")).where(F.col(f"{p}_sex").isin("m", "f"))
    married = r.relations.where("type = 'spouse'").join(sex("person_a"), "person_a").join(sex("person_b"), "person_b").where("person_a_sex <> person_b_sex")
    man = F.col("person_a_sex") == "m"
    couples = married.select(F.when(man, F.col("person_a")).otherwise(F.col("person_b")).alias("otec"), F.when(man, F.col("person_b")).otherwise(F.col("person_a")).alias("matka"))
    all_of = couples.withColumn("dite", F.lit(None).cast("long")).unionByName(children(r).select("otec", "matka", "dite"))
    return all_of.groupBy("otec", "matka").agg(F.countDistinct("dite").alias("name")).groupBy("name").agg(F.count("*").alias("value"))


def top_families(r: Register, top: int = 15) -> DataFrame:
    """The couples with most children, with names and ids."""
    c = children(r).groupBy(F.col("otec").alias("otec_id"), F.col("matka").alias("matka_id")).agg(F.countDistinct("dite").alias("value"))
    name = lambda k: r.persons.select(F.col("id").alias(f"{k}_id"), F.col("display_name").alias(k))
    ranked = c.join(name("otec"), "otec_id").join(name("matka"), "matka_id")
    return ranked.select("otec", "matka", "otec_id", "matka_id", "value").orderBy(F.desc("value"), "otec", "otec_id", "matka_id").limit(top)


def marriages_per_person(r: Register) -> DataFrame:
    """Persons by number of weddings, men and women."""
    w = _weddings(r).select(F.col("id").alias("mention_id"), "record_id").join(r.person_mentions.select("mention_id", "person_id"), "mention_id")
    n = w.groupBy("person_id").agg(F.countDistinct("record_id").alias("name")).join(r.persons.select(F.col("id").alias("person_id"), "sex"), "person_id")
    return n.groupBy("name").agg(_count(F.col("sex") == "m", "muzi"), _count(F.col("sex") == "f", "zeny"))


def remarriages(r: Register) -> DataFrame:
    """Weddings by decade, and those of widowers and widows."""
    w = _weddings(r).where("year IS NOT NULL")
    role, status = F.col("role"), F.col("marital_status")
    return w.groupBy(decade("year").alias("name")).agg(_count(role == "zenich", "snatky"), _count((role == "zenich") & (status == "vdovec"), "vdovci"), _count((role == "nevesta") & (status == "vdova"), "vdovy"))


def timeline(r: Register) -> DataFrame:
    """Events by year and type."""
    return _by_type(F.col("year"), r.events.where("year IS NOT NULL"))


def legitimacy(r: Register) -> DataFrame:
    """Children born in and out of wedlock by decade."""
    e = r.events.where("type = 'birth' AND year IS NOT NULL").select("record_id", "year")
    m = r.mentions.where("role = 'dite' AND marital_status IN ('manzelsky', 'nemanzelsky')").select("record_id", "marital_status")
    return m.join(e, "record_id").groupBy(decade("year").alias("name")).agg(_count(F.col("marital_status") == "manzelsky", "manzelske"), _count(F.col("marital_status") == "nemanzelsky", "nemanzelske"))


def legitimate_percent(d: DataFrame) -> DataFrame:
    """Of legitimacy: percent out of wedlock, one decimal; 0 without children."""
    both = F.col("manzelske") + F.col("nemanzelske")
    return d.withColumn("percent", F.when(both > 0, F.round(F.col("nemanzelske") * 100 / both, 1)).otherwise(0.0))


def summary(r: Register) -> DataFrame:
    """One row of counts."""
    e, c = F.col("type"), F.col("marital_status")
    events = r.events.agg(_count(e == "birth", "narozeni"), _count(e == "marriage", "snatky"), _count(e == "death", "umrti"))
    kids = r.mentions.where("role = 'dite'").agg(_count(c == "manzelsky", "manzelske_deti"), _count(c == "nemanzelsky", "nemanzelske_deti"))
    one = [r.persons.agg(F.count("*").alias("osoby")), events, r.relations.agg(_count(e == "parent_child", "vazby_rodic_dite")), kids]
    out = one[0].withColumn("__one", F.lit(1))
    for d in one[1:]:  # single rows
        out = out.join(d.withColumn("__one", F.lit(1)), "__one")
    return out.drop("__one")


def stats(r: Register) -> DataFrame:
    """Rows per table: name, value."""
    tables = {"books": r.books, "scans": r.scans, "records": r.records, "mentions": r.mentions, "persons": r.persons, "relations": r.relations}
    parts = [d.agg(F.lit(k).alias("name"), F.count("*").alias("value")) for k, d in tables.items() if d is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def representative(r: Register) -> DataFrame:
    """The first mention of each person."""
    return r.person_mentions.groupBy("person_id").agg(F.min("mention_id").alias("mention_id"))


ANALYSES: dict[str, Callable[[Register], DataFrame]] = {
    "surnames": surnames, "lifespan": lifespan, "marriage-age": marriage_age, "seasonality": seasonality, "migration": migration,
    "family-size": family_size, "top-families": top_families, "marriages-per-person": marriages_per_person,
    "remarriages": remarriages, "timeline": timeline, "legitimacy": legitimacy, "summary": summary,
}


def analysis(name: str, r: Register) -> DataFrame:
    """An analysis by name; KeyError for another."""
    return ANALYSES[name](r)
