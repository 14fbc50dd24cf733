"""Events and person mentions out of records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.dates import parse_age, parse_date
from quillspark.functions.names import parse_cells
from quillspark.functions.text import feminize_surname, first_non_empty, fold_ascii, given_norm, split_people, split_place_house, status_of, strip
from quillspark.operators.identity import keep_ids
from quillspark.storage import staged

_TEXTS = "raw_text given_name surname given_norm surname_norm maiden_norm sex occupation marital_status place_text".split()
MENTION = T.StructType(
    [T.StructField("role", T.StringType()), T.StructField("ordinal", T.IntegerType())]
    + [T.StructField(f, T.StringType()) for f in _TEXTS]
    + [T.StructField("birth_year", T.IntegerType()), T.StructField("age_text", T.StringType()), T.StructField("extra", T.MapType(T.StringType(), T.StringType()))]
)
EVENT_TYPES = {"narozeni": "birth", "oddani": "marriage", "umrti": "death"}


def number_records(records: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """records with record_id in the order of book, line and row; known ones keep theirs."""
    return keep_ids(records, previous, ["book_id", "file", "row_idx"], ["book_id", "line_no", "row_idx"], "record_id")


def corrected(records: DataFrame, corrections: DataFrame | None) -> DataFrame:
    """records with the cells that corrections (record_id, cell_key, corrected_value) replace or add."""
    if corrections is None:
        return records
    by = corrections.groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("cell_key", "corrected_value"))).alias("__fix"))
    fixed = F.map_zip_with("cells", F.coalesce("__fix", F.create_map().cast("map<string,string>")), lambda _, old, new: F.coalesce(new, old))
    return records.join(by, "record_id", "left").withColumn("cells", fixed).drop("__fix")


def _cell(key: str) -> Column:
    return F.coalesce(F.try_element_at(F.col("cells"), F.lit(key)), F.lit(""))


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c computed once: f may name it many times without the plan's code growing."""
    return F.transform(F.array(c), f)[0]


def _place(key_or_text: str | Column) -> Column:
    return _once(_cell(key_or_text) if isinstance(key_or_text, str) else key_or_text, split_place_house)["place"]


def _mention(role: str, p: Column, ordinal: Column | int = 0, **own: Column) -> Column:
    """A mention of person p; own replaces fields."""
    names = {"raw_text": "raw", "given_name": "given", "place_text": "place"}
    values = {f: p[names.get(f, f)] for f in MENTION.fieldNames() if f not in ("role", "ordinal", "birth_year", "age_text", "extra")}
    values |= {"role": F.lit(role), "ordinal": F.lit(ordinal) if isinstance(ordinal, int) else ordinal, "birth_year": F.lit(None), "age_text": F.lit(""), "extra": F.lit(None)}
    values |= own
    return F.struct(*(values[f.name].cast(f.dataType).alias(f.name) for f in MENTION))


def _with_parents(role: str, cell: Column, mention: Column, when: Column) -> list[Column]:
    """The mention and those of the parents that its cell names; null where there is none."""
    return [
        F.when(when, mention),
        F.when(when & cell["f"].isNotNull(), _mention(f"{role}_otec", cell["f"])),
        F.when(when & cell["m"].isNotNull(), _mention(f"{role}_matka", cell["m"])),
    ]


def _or(a: Column, b: Column) -> Column:
    return F.when(a == "", b).otherwise(a)


def _sex_of(cell: Column, otherwise: Column) -> Column:
    said = _once(fold_ascii(strip(cell)), lambda s: F.when(s.isin("chlapec", "muz", "m"), "m").when(s.isin("devce", "divka", "zena", "f", "z"), "f"))
    return F.coalesce(said, otherwise)


def _parsed(r: DataFrame, single: dict[str, Column], listed: tuple[str, str] | None = None) -> DataFrame:
    """r with the parsed cells by name and those of a list cell (name, key); all cells of a record are parsed in one call."""
    cells = F.array(*single.values())
    if listed:
        cells = F.concat(cells, _once(_cell(listed[1]), split_people))
    r = r.withColumn("__cells", parse_cells(cells))
    r = r.withColumns({k: F.col("__cells")[i] for i, k in enumerate(single)})
    return r.withColumn(listed[0], F.transform(F.slice("__cells", F.lit(len(single) + 1), F.size("__cells")), lambda c: c["p"])) if listed else r


def _births(r: DataFrame) -> DataFrame:
    r = _parsed(r, {k: _cell(c) for k, c in (("__otec", "otec_jmeno_stav"), ("__matka", "matka_jmeno_rodice"), ("__dite", "dite_jmeno"), ("__babka", "babka"))}, ("__kmotri", "kmotri"))
    otec, matka, dite, babka = (F.col(k)["p"] for k in ("__otec", "__matka", "__dite", "__babka"))
    has = {k: strip(_cell(c)) != "" for k, c in (("otec", "otec_jmeno_stav"), ("matka", "matka_jmeno_rodice"), ("dite", "dite_jmeno"), ("babka", "babka"))}
    name, norm = F.coalesce(otec["surname"], F.lit("")), F.coalesce(otec["surname_norm"], F.lit(""))
    inherits = lambda p: (p["surname"] == "") & (name != "")
    sex = _sex_of(_cell("dite_pohlavi"), dite["sex"])
    given = _or(dite["given"], strip(_cell("dite_jmeno")))
    mentions = [
        *_with_parents("otec", F.col("__otec"), _mention("otec", otec, sex=F.lit("m"), place_text=_or(otec["place"], _place("otec_bydliste"))), has["otec"]),
        *_with_parents(
            "matka", F.col("__matka"),
            _mention(
                "matka", matka, sex=F.lit("f"), place_text=_or(matka["place"], _place("matka_bydliste")),
                surname=F.when(inherits(matka), _once(name, feminize_surname)).otherwise(matka["surname"]),
                surname_norm=F.when(inherits(matka), norm).otherwise(matka["surname_norm"]),
            ), has["matka"],
        ),
        F.when(
            has["dite"],
            _mention(
                "dite", dite, raw_text=_cell("dite_jmeno"), given_name=given, sex=sex,
                given_norm=F.when(dite["given"] == "", _once(given, given_norm)).otherwise(dite["given_norm"]),
                surname=F.when(inherits(dite) & (sex == "f"), _once(name, feminize_surname)).when(inherits(dite), name).otherwise(dite["surname"]),
                surname_norm=F.when(inherits(dite), norm).otherwise(dite["surname_norm"]),
                marital_status=F.coalesce(_once(_cell("dite_manzelske"), status_of), dite["marital_status"]),
                place_text=_or(dite["place"], F.col("event.place_text")), birth_year=F.col("event.year"),
            ),
        ),
    ]
    listed = F.transform("__kmotri", lambda p, i: _mention("kmotr", p, i))
    last = [F.when(has["babka"], _mention("babka", babka, sex=F.lit("f")))]
    return r.withColumn("__all", F.concat(F.array(*mentions), listed, F.array(*last)))


def _marriages(r: DataFrame) -> DataFrame:
    bride = first_non_empty(_cell("nevesta_jmeno_stav_rodice"), _cell("nevesta_jmeno"))
    birthplace = first_non_empty(_cell("nevesta_misto_narozeni"), _cell("nevesta_misto_zrozeni"))
    r = _parsed(r, {"__zenich": _cell("zenich_jmeno_stav_rodice"), "__nevesta": bride}, ("__svedkove", "svedkove")).withColumn("__born", _once(_cell("nevesta_datum_narozeni"), parse_date))
    zenich, nevesta, born = F.col("__zenich")["p"], F.col("__nevesta")["p"], F.col("__born")
    plain = F.concat_ws(" | ", birthplace, _cell("nevesta_datum_narozeni"), _cell("nevesta_stav"))
    mentions = [
        *_with_parents("zenich", F.col("__zenich"), _mention("zenich", zenich, sex=F.lit("m"), place_text=_or(zenich["place"], _place("zenich_misto_prebyvani"))), strip(_cell("zenich_jmeno_stav_rodice")) != ""),
        *_with_parents(
            "nevesta", F.col("__nevesta"),
            _mention(
                "nevesta", nevesta, sex=F.lit("f"), raw_text=_or(nevesta["raw"], strip(plain)), place_text=_or(nevesta["place"], _place(birthplace)),
                marital_status=_or(nevesta["marital_status"], F.coalesce(_once(_cell("nevesta_stav"), status_of), F.lit(""))), birth_year=born["year"],
                extra=F.when(born["year"].isNotNull(), F.create_map(F.lit("birth_date"), born["iso"], F.lit("birth_date_precision"), born["precision"])),
            ), (bride != "") | (strip(_cell("nevesta_datum_narozeni")) != ""),
        ),
    ]
    return r.withColumn("__all", F.concat(F.array(*mentions), F.transform("__svedkove", lambda p, i: _mention("svedek", p, i))))


def _deaths(r: DataFrame) -> DataFrame:
    r = _parsed(r, {"__zemrely": _cell("zemrely_jmeno_stav")})
    p, age = F.col("__zemrely")["p"], strip(_cell("vek"))
    own = _mention("zemrely", p, sex=_sex_of(_cell("pohlavi"), p["sex"]), place_text=_or(p["place"], F.col("event.place_text")), age_text=age, birth_year=F.col("event.year") - _once(age, parse_age))
    return r.withColumn("__all", F.array(*_with_parents("zemrely", F.col("__zemrely"), own, strip(_cell("zemrely_jmeno_stav")) != "")))


def _events(records: DataFrame) -> DataFrame:
    """records of the three types with their event as a struct."""
    kind = F.col("record_type")
    one = lambda n, o, z: F.when(kind == "narozeni", n).when(kind == "oddani", o).otherwise(z)
    text = one(first_non_empty(_cell("datum_narozeni"), _cell("datum_krtu")), first_non_empty(_cell("datum_oddavek"), _cell("datum_ohlasek")), first_non_empty(_cell("datum_umrti"), _cell("datum_pohrbu")))
    place = _once(one(_cell("misto_dum"), _cell("misto_oddavek"), _cell("misto_dum")), split_place_house)
    r = records.where(kind.isin(*EVENT_TYPES)).withColumns({"__text": text, "__place": place}).withColumn("__date", _once(F.col("__text"), parse_date))
    event = F.struct(
        one(*(F.lit(t) for t in EVENT_TYPES.values())).alias("type"), F.col("__text").alias("date_text"), F.col("__date.iso").alias("date"),
        F.col("__date.precision").alias("date_precision"), F.nullif("__date.year", F.lit(0)).alias("year"), F.col("__place.place").alias("place_text"), F.col("__place.house").alias("house_no"),
    )
    return r.withColumn("event", event).drop("__text", "__place", "__date")


def extract_events(records: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """One event per record of a known type: record_id, type, date_text, date, date_precision, year, place_text, house_no."""
    return _events(corrected(records, corrections)).select("record_id", "event.*")


def read_mentions(records: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """Mentions without ids: record_id, seq (their place in the record) and the fields of MENTION.

    Each record is parsed where it lies, without a shuffle. The outer explode keeps the optimizer
    from filtering on the size of the array first, which would parse every cell twice.
    """
    r = _events(corrected(records, corrections))
    branches = [make(r.where(F.col("record_type") == t)).select("record_id", F.posexplode_outer("__all").alias("seq", "m")) for t, make in zip(EVENT_TYPES, (_births, _marriages, _deaths), strict=True)]
    found = branches[0].unionByName(branches[1]).unionByName(branches[2]).where("m is not null").select("record_id", "seq", "m.*")
    return found.withColumn("birth_year", F.nullif("birth_year", F.lit(0)))


def extract_mentions(records: DataFrame, corrections: DataFrame | None = None, previous: DataFrame | None = None) -> DataFrame:
    """Mentions (id, record_id and the fields of MENTION); ids that previous has for (record_id, role, ordinal) stay.

    They are written before ids are given: ranging them would else parse all cells twice, to sample and to shuffle.
    """
    found = staged(read_mentions(records, corrections), "mentions")
    return keep_ids(found, previous, ["record_id", "role", "ordinal"], ["record_id", "seq"], "id").drop("seq")


def extract_report(mentions: DataFrame, events: DataFrame) -> DataFrame:
    """Counts by role, and of events without a date."""
    roles = mentions.groupBy(F.col("role").alias("name")).agg(F.count("*").alias("value"))
    return roles.unionByName(events.agg(F.lit("unparsed_dates").alias("name"), F.count_if((F.col("date_precision") == "none") & (F.col("date_text") != "")).alias("value")))


def without_stale(dependents: DataFrame, mentions: DataFrame, *columns: str) -> DataFrame:
    """Rows of constraints or links whose mentions all exist."""
    for c in columns:
        dependents = dependents.join(mentions.select(F.col("id").alias(c)), c, "left_semi")
    return dependents


def reextracted(records: DataFrame, corrections: DataFrame, events: DataFrame, mentions: DataFrame, record_id: int) -> tuple[DataFrame, DataFrame]:
    """(events, mentions) after a correction of one record: its book is extracted anew, other books stay as they are.

    Mentions keep their ids; persons aren't matched again. ValueError if there is no such record.
    """
    row = records.where(F.col("record_id") == record_id).select("book_id").first()
    if row is None:
        raise ValueError(f"no record {record_id}")
    own = records.where(F.col("book_id") == row["book_id"])
    rest = lambda d: d.join(own.select("record_id"), "record_id", "left_anti")
    return rest(events).unionByName(extract_events(own, corrections)), rest(mentions).unionByName(extract_mentions(own, corrections, mentions))
