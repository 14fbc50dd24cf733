from __future__ import annotations

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from quillspark.functions import dates as D
from quillspark.functions import similarity
from quillspark.functions import text as X
from quillspark.functions.names import norm_given, norm_surname, read_cell, split_name
from quillspark.functions.similarity import edit_distance, edits, jaro, jaro_winkler


def values(spark, function, inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["y"] for r in rows.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


DATES = [
    ("30.9.1878", "1878-09-30", "day", 1878), ("30. 9. 1878", "1878-09-30", "day", 1878), ("dne 30. září 1878", "1878-09-30", "day", 1878),
    ("5. ledna 1901", "1901-01-05", "day", 1901), ("12. Jänner 1855", "1855-01-12", "day", 1855), ("září 1878", "1878-09", "month", 1878),
    ("1878", "1878", "year", 1878), ("31.13.1900", "1900", "year", 1900), ("31.2.1900", "1900-02-31", "day", 1900), ("5. neznámo 1870", "1870", "year", 1870),
    ("", "", "none", None), ("nečitelné", "", "none", None), (None, "", "none", None),
]


def test_dates(spark):
    got = values(spark, D.parse_date, [d[0] for d in DATES])
    assert [(g["iso"], g["precision"], g["year"]) for g in got] == [d[1:] for d in DATES]


def test_ages(spark):
    cases = {"72 let": 72, "1 rok": 1, "6 měsíců": 0, "14 dní": 0, "45": 45, "": None, "130": None, "3/4 roku": 4, "asi starý": None}
    assert values(spark, D.parse_age, list(cases)) == list(cases.values())


def test_fold_and_norms(spark):
    assert values(spark, X.fold_ascii, ["Šťastný Vojtěch", "Straße", None]) == ["stastny vojtech", "strasse", None]
    surnames = {"Nováková": "novak", "Slavík": "slavik", "Svoboda": "svoboda", "Vořechovská": "vorechovsky", "Worechowski": "vorechovsky", "Růžička": "ruzicka"}
    assert values(spark, X.surname_norm, list(surnames)) == list(surnames.values()) == [norm_surname(s) for s in surnames]
    genitives = {"Novákové": "novak", "Slavíka": "slavik", "Vořechovského": "vorechovsky", "Svobody": "svobod"}
    assert values(spark, lambda c: X.surname_norm(c, True), list(genitives)) == list(genitives.values()) == [norm_surname(s, True) for s in genitives]
    given = {"Johann": "jan", "Joannes": "jan", "Wenzel": "vaclav", "Maria": "marie", "Willibald": "villibald"}
    assert values(spark, X.given_norm, list(given)) == list(given.values()) == [norm_given(g) for g in given]
    assert norm_given("Josefa", True, "m") == "josef" and norm_given("Josefa", False, "f") == "josefa"
    assert values(spark, lambda c: X.given_norm_in_context(c, F.lit(True), F.lit("m")), ["Josefa", "Jana"]) == ["josef", "jan"]
    assert values(spark, X.place_norm, ["Testov", "Testově", "Testova", "Aš"]) == ["testov", "testov", "testov", "as"]
    assert values(spark, X.feminize_surname, ["Dvořák", "Černý", "Worechowsky", "Svoboda", "Nováková", ""]) == ["Dvořáková", "Černá", "Worechowská", "Svobodová", "Nováková", ""]
    assert values(spark, X.nominative_surname, ["Slavíka", "Dvořákové", "Svobody", "Černého", "Aba"]) == ["Slavík", "Dvořáková", "Svoboda", "Černý", "Aba"]
    assert values(spark, X.sex_from_given, ["Marie", "Hans", "Libuše", "Eva"]) == ["f", "m", "", "f"]


def test_lists_and_places(spark):
    got = values(spark, X.split_people, ["Jan Novák, rolník z Kladna a Josef Dvořák, havíř", "Jan Novák; ;Josef Dvořák", " ", None])
    assert got == [["Jan Novák, rolník z Kladna", "Josef Dvořák, havíř"], ["Jan Novák", "Josef Dvořák"], [], []]
    assert [tuple(g) for g in values(spark, X.split_place_house, ["Kročehlavy č. 123", "čp. 7", "Lhota", ""])] == [("Kročehlavy", "123"), ("", "7"), ("Lhota", ""), ("", "")]
    assert values(spark, X.book_id_of, ["a/Lhota N [7001].jsonl", "Lhota.jsonl"]) == ["7001", "Lhota"]
    assert values(spark, X.leading_int, ["12/b", " 7", "x1", None]) == [12, 7, None, None]
    assert values(spark, X.clean_cell, ["<b>a&nbsp;b</b> - ", "---", None]) == ["a b", "", ""]


def test_binaries(spark):
    df = spark.createDataFrame([(b"\x89PNG\r\n\x1a\nxyz",), (b"\xff\xd8\xff",), (b"RIFF0000WEBP",), (b"",)], "b binary")
    got = df.select(X.image_type("b").alias("t"), X.content_hash("b").alias("h"), X.content_hash("b", 4).alias("f")).collect()
    assert [r["t"] for r in got] == ["png", "jpg", "webp", "bin"]
    assert got[0]["f"] == hashlib.sha256(b"\x89PNG").hexdigest() and got[3]["h"] == hashlib.sha256(b"").hexdigest()
    paths = spark.createDataFrame([("/a/b/c.png", "/a/"), ("/x/c.png", "/a")], "p string, r string")
    assert [r[0] for r in paths.select(X.relative_path("p", "r")).collect()] == ["b/c.png", "/x/c.png"]
    years = spark.createDataFrame([(1876, 1903), (None, 1903), (None, None)], "b int, d int")
    assert [r[0] for r in years.select(X.years_label("b", "d")).collect()] == ["*1876 †1903", "†1903", ""]


def test_cells():
    p, f, m = read_cell("Slavík František, mistr obuvnický v Kladně, syn Josefa Slavíka, rolníka z Hnidous, a Marie roz. Dvořákové")
    assert (p.given, p.surname, p.given_norm, p.surname_norm, p.sex, p.place) == ("František", "Slavík", "frantisek", "slavik", "m", "Kladně")
    assert p.occupation.startswith("mistr") and (f.given, f.surname, f.surname_norm, f.place) == ("Josef", "Slavík", "slavik", "Hnidous")
    assert (m.given_norm, m.maiden_norm, m.sex) == ("marie", "dvorak", "f")
    p, f, m = read_cell("Anna, dcera Václava Dvořáka, domkáře z Buštěhradu, a Kateřiny rozené Novákové")
    assert (p.given_norm, p.sex, f.surname_norm, m.given_norm, m.maiden_norm) == ("anna", "f", "dvorak", "katerina", "novak")
    p, f, m = read_cell("Žák Štěpán, syn Šimona Čermáka a Červenky Anny")  # capitals outside ASCII
    assert (p.surname, p.given, f.surname) == ("Žák", "Štěpán", "Čermák") and m is not None
    assert read_cell(None)[1:] == (None, None) and read_cell("nemanželské dítě")[0].marital_status == "nemanzelsky"
    assert split_name("Slavík", "František") == ("František", "Slavík") and split_name("Xaver", "Ypsilon", True) == ("Xaver", "Ypsilon")


@pytest.mark.parametrize(("a", "b", "least", "most"), [("slavik", "slavik", 1, 1), ("slavik", "slavyk", 0.9, 0.95), ("slavik", "dvorak", 0, 0.7), ("", "x", 0, 0)])
def test_similarity(a, b, least, most):
    assert least <= jaro_winkler(a, b) <= most


def test_half_transpositions_count():
    assert jaro("martha", "marhta") == pytest.approx((1 + 1 + 5 / 6) / 3)
    assert jaro("abcd", "bcda") == pytest.approx((0.75 + 0.75 + 1) / 3)


def test_lines_and_months(spark):
    def lines(text, width):
        return spark.range(1).select(X.wrapped(F.lit(text), width)).first()[0]

    assert lines("", 5) == [""] and lines("abcdefghijkl", 5) == ["abcde", "fghij", "kl"]
    assert lines("one two  three", 8) == ["one two", "three"] and lines("a bcdefghij k", 8) == ["a bcdefg", "hij k"]
    got = spark.createDataFrame([(1,), (12,), (13,), (None,)], "n int").select(X.month_label("n")).collect()
    assert [r[0] for r in got] == ["led", "pro", "13", None]


def test_edits_by_bit_vectors(spark):
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    r = random.Random(4)
    word = lambda n, letters: "".join(r.choice(letters) for _ in range(r.randint(0, n)))
    cases = [(word(n, letters), word(n, letters)) for n in (3, 9, 70, 200) for letters in ("ab", "abcdé漢😀") for _ in range(12)]
    assert [edits(a, b) for a, b in cases] == [plain(a, b) for a, b in cases]
    long = ("x" * 3000 + word(2000, "abc"), "y" * 2500)
    rows = [*cases, long, (None, "a"), ("a", None), ("same" * 9000, "same" * 9000 + "!")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(rows)], "i int, a string, b string")
    got = [x["n"] for x in df.select("i", edit_distance(F.col("a"), F.col("b"), (4, 30)).alias("n")).orderBy("i").collect()]
    assert got == [*(plain(a, b) for a, b in cases), max(map(len, long)), None, None, 1]


def test_edits_of_long_texts_are_few():
    r = random.Random(5)
    whole = "".join(r.choice("abcd \n") for _ in range(300_000))
    start = time.process_time()
    assert edits(whole, whole.replace("\n", " ", 200)) <= 200
    assert edits(whole, "".join(c for k, c in enumerate(whole) if k % 3000 != 1500)) == 100
    assert time.process_time() - start < 10  # by bit vectors alone: minutes


def test_many_similarities_at_once():
    """Those of the pairs one by one, to the last bit, whatever their lengths."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcé漢\0") for _ in range(r.randrange(12))) * r.choice((1, 1, 1, 4))
    pairs = [(word(), word()) for _ in range(3000)] + [("a", ""), ("", ""), ("martha", "marhta"), ("x" * 70, "x" * 69 + "y"), ("ab\0", "ab")]
    want = [similarity.jaro_winkler(x, y) if x and y and x != y else float(x == y != "") for x, y in pairs]
    assert similarity.similarities(pairs).tolist() == want and sum(0 < s < 1 for s in want) > 1000 and not len(similarity.similarities([]))
