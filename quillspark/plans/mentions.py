"""Births, marriages and deaths invented from orders, and every mention that they must give, value by value, in SQL.

Each person of a record is put together from the names' forms; the SQL knows the parts and
states the mentions without reading a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import extract
from quillspark.plans.forms import MEN, PLACES, SURNAMES, TRADES, WOMEN, _column, _pick, _sql
from quillspark.plans.register import table
from quillspark.plans.registry import query

#: Which name of a pool each person has, as a divisor of the order's key.
_AT = {"father": 3, "grandfather": 7, "grandmother": 11, "mother": 13, "child": 17, "godfather": 19, "godmother": 23, "midwife": 29, "groom": 5, "bride": 31, "bridefather": 37, "witness": 41, "dead": 43}
_GIVEN, _SUR = {"m": MEN, "f": WOMEN}, {("m", 0): 0, ("f", 0): 1, ("m", 1): 2, ("f", 1): 3}
_FIELDS = "role ordinal given_name surname given_norm surname_norm maiden_norm sex occupation marital_status place_text birth_year".split()


def _given(who: str, sex: str, case: int = 0) -> Column:
    return _pick(_column(_GIVEN[sex], case), f"o_orderkey div {_AT[who]}")


def _surname(who: str, sex: str, case: int = 0) -> Column:
    return _pick(_column(SURNAMES, _SUR[sex, case]), f"o_orderkey div {_AT[who] + 1}")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    day = F.format_string("%d.%d.%d", F.dayofmonth("o_orderdate"), F.month("o_orderdate"), F.year("o_orderdate"))
    trade = F.when(k % 4 != 0, join(", ", _pick(TRADES, "o_orderkey div 2"), " v ", _pick(PLACES, "o_orderkey div 4"))).otherwise("")
    widowed = lambda word: F.when(k % 5 == 0, f", {word}").otherwise("")
    of = lambda who: join(", syn ", _given("grandfather", "m", 1), " ", _surname(who, "m", 1), " a ", _given("grandmother", "f", 1), " roz. ", _surname("grandmother", "f", 1))
    man = lambda who: join(_surname(who, "m"), " ", _given(who, "m"), trade, widowed("vdovec"), F.when(k % 2 == 0, of(who)).otherwise(""))
    girl = k % 6 == 0
    cells = {
        0: {
            "datum_narozeni": day, "misto_dum": join("Testov č. ", (k % 90).cast("string")), "otec_jmeno_stav": man("father"), "otec_bydliste": "Lhota č. 7",
            "matka_jmeno_rodice": F.when(k % 2 == 0, _given("mother", "f")).otherwise(join(_surname("mother", "f"), " ", _given("mother", "f"), ", dcera ", _given("grandfather", "m", 1), " ", _surname("mother", "m", 1))),
            "matka_bydliste": "Kladno", "dite_jmeno": F.when(girl, _given("child", "f")).otherwise(_given("child", "m")), "dite_pohlavi": F.when(girl, "děvče").otherwise("Chlapec "),
            "dite_manzelske": F.when(k % 9 == 0, "nemanželské").otherwise(""), "kmotri": join(_given("godfather", "m"), " ", _surname("godfather", "m"), ", kovář; ", _surname("godmother", "f"), " ", _given("godmother", "f")),
            "babka": F.when(k % 4 == 1, join(_given("midwife", "f"), " ", _surname("midwife", "f"))).otherwise(" "),
        },
        1: {
            "datum_oddavek": day, "zenich_jmeno_stav_rodice": man("groom"), "zenich_misto_prebyvani": "Brodec č. 4",
            "nevesta_jmeno": F.when(k % 4 != 3, join(_given("bride", "f"), " ", _surname("bride", "f"), widowed("vdova"), F.when(k % 8 == 1, join(", dcera ", _given("bridefather", "m", 1), " ", _surname("bridefather", "m", 1))).otherwise(""))).otherwise(""),
            "nevesta_misto_zrozeni": "Kamenice", "nevesta_datum_narozeni": F.format_string("%d.5.%d", k % 28 + 1, F.year("o_orderdate") - 20), "nevesta_stav": F.when(k % 3 == 1, "svobodná").otherwise(""),
            "svedkove": join(_surname("witness", "m"), " ", _given("witness", "m")),
        },
        2: {"datum_umrti": day, "misto_dum": "Testov č. 3", "zemrely_jmeno_stav": man("dead"), "pohlavi": F.when(k % 10 == 0, "muž").otherwise(""), "vek": F.format_string("%d let", k % 90)},
    }
    maps = [F.create_map(*(x for key, v in c.items() for x in (F.lit(key), F.lit(v) if isinstance(v, str) else v))) for c in cells.values()]
    typ = F.element_at(F.array(F.lit("narozeni"), F.lit("oddani"), F.lit("umrti")), (k % 3 + 1).cast("int"))
    return o.select(k.alias("record_id"), typ.alias("record_type"), F.when(k % 3 == 0, maps[0]).when(k % 3 == 1, maps[1]).otherwise(maps[2]).alias("cells"))


def _oracle() -> str:
    k = "o_orderkey"
    given = lambda who, sex, at=0: _sql(_column(_GIVEN[sex], at), f"{k} // {_AT[who]}")
    sur = lambda who, at=0: _sql(_column(SURNAMES, at), f"{k} // {_AT[who] + 1}")
    trade, place = f"CASE WHEN {k} % 4 <> 0 THEN {_sql(TRADES, f'{k} // 2')} || ' v ' || {_sql(PLACES, f'{k} // 4')} ELSE '' END", _sql(PLACES, f"{k} // 4")
    year = "year(o_orderdate)"
    nobody = dict.fromkeys(_FIELDS, "''") | {"ordinal": "0", "birth_year": "NULL"}

    def one(role: str, given_: str, surname: str, g_norm: str, s_norm: str, sex: str, when: str = "true", **more: str) -> tuple[str, str]:
        v = nobody | {"role": f"'{role}'", "given_name": given_, "surname": surname, "given_norm": g_norm, "surname_norm": s_norm, "sex": sex} | more
        return when, "{" + ", ".join(f"'{f}': {v[f]}" for f in _FIELDS) + "}"

    def man(role: str, who: str, otherwise: str, **more: str) -> list[tuple[str, str]]:
        own = {"occupation": trade, "marital_status": f"CASE WHEN {k} % 5 = 0 THEN 'vdovec' ELSE '' END", "place_text": f"CASE WHEN {k} % 4 <> 0 THEN {place} ELSE '{otherwise}' END"} | more
        return [
            one(role, given(who, "m"), sur(who), given(who, "m", 2), sur(who, 4), "'m'", **own),
            one(f"{role}_otec", given("grandfather", "m"), sur(who), given("grandfather", "m", 2), sur(who, 4), "'m'", f"{k} % 2 = 0"),
            one(f"{role}_matka", given("grandmother", "f"), "''", given("grandmother", "f", 2), "''", "'f'", f"{k} % 2 = 0", maiden_norm=sur("grandmother", 4)),
        ]

    girl, plain, bride = f"{k} % 6 = 0", f"{k} % 2 = 0", f"{k} % 4 <> 3"
    either = lambda test, a, b: f"CASE WHEN {test} THEN {a} ELSE {b} END"
    births = [
        *man("otec", "father", "Lhota"),
        one("matka", given("mother", "f"), either(plain, sur("father", 1), sur("mother", 1)), given("mother", "f", 2), either(plain, sur("father", 4), sur("mother", 4)), "'f'", place_text="'Kladno'"),
        one("matka_otec", given("grandfather", "m"), sur("mother"), given("grandfather", "m", 2), sur("mother", 4), "'m'", f"NOT {plain}"),
        one("dite", either(girl, given("child", "f"), given("child", "m")), either(girl, sur("father", 1), sur("father")), either(girl, given("child", "f", 2), given("child", "m", 2)), sur("father", 4), either(girl, "'f'", "'m'"),
            marital_status=either(f"{k} % 9 = 0", "'nemanzelsky'", "''"), place_text="'Testov'", birth_year=year),
        one("kmotr", given("godfather", "m"), sur("godfather"), given("godfather", "m", 2), sur("godfather", 4), "'m'", occupation="'kovář'"),
        one("kmotr", given("godmother", "f"), sur("godmother", 1), given("godmother", "f", 2), sur("godmother", 4), "'f'", ordinal="1"),
        one("babka", given("midwife", "f"), sur("midwife", 1), given("midwife", "f", 2), sur("midwife", 4), "'f'", f"{k} % 4 = 1"),
    ]
    weddings = [
        *man("zenich", "groom", "Brodec"),
        one("nevesta", either(bride, given("bride", "f"), "''"), either(bride, sur("bride", 1), "''"), either(bride, given("bride", "f", 2), "''"), either(bride, sur("bride", 4), "''"), "'f'",
            marital_status=f"CASE WHEN {bride} AND {k} % 5 = 0 THEN 'vdova' WHEN {k} % 3 = 1 THEN 'svobodna' ELSE '' END", place_text="'Kamenice'", birth_year=f"{year} - 20"),
        one("nevesta_otec", given("bridefather", "m"), sur("bridefather"), given("bridefather", "m", 2), sur("bridefather", 4), "'m'", f"{k} % 8 = 1"),
        one("svedek", given("witness", "m"), sur("witness"), given("witness", "m", 2), sur("witness", 4), "'m'"),
    ]
    deaths = man("zemrely", "dead", "Testov", birth_year=f"{year} - {k} % 90")
    lists = ["[" + ", ".join(f"CASE WHEN {when} THEN {cell} END" for when, cell in rows) + "]" for rows in (births, weddings, deaths)]
    return f"""WITH each AS (SELECT o_orderkey AS record_id, unnest(CASE o_orderkey % 3 WHEN 0 THEN {lists[0]} WHEN 1 THEN {lists[1]} ELSE {lists[2]} END) AS m FROM orders)
SELECT record_id, m.role, m.ordinal::INT AS ordinal, {", ".join(f"m.{f}" for f in _FIELDS[2:-1])}, m.birth_year::INT AS birth_year FROM each WHERE m IS NOT NULL"""


@query(_oracle())
def mentions_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mention of every record, with all its values."""
    return extract.extract_mentions(_records(spark, sf_dir)).select("record_id", *_FIELDS)
