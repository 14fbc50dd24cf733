"""Queries of cells, forms and small operators, each with its SQL.

Cells are put together from parts that the SQL knows, so it states what must be read without
reading them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import names as N
from quillspark.functions import text as X
from quillspark.operators import dataset, extract, graph, linkage, metadata, quality, search
from quillspark.plans.register import SQL as REG
from quillspark.plans.register import register, table
from quillspark.plans.registry import query
from quillspark.sources import pages, sinks
from quillspark.sources.templates import template
from quillspark.storage import staged

# (nominative, genitive, norm) of given names and (man's, woman's, genitives of both, norm) of surnames
MEN = (("Tomáš", "Tomáše", "tomas"), ("Jakub", "Jakuba", "jakub"), ("Martin", "Martina", "martin"), ("Jiří", "Jiřího", "jiri"), ("Vojtěch", "Vojtěcha", "vojtech"))
WOMEN = (("Terezie", "Terezie", "terezie"), ("Kateřina", "Kateřiny", "katerina"), ("Barbora", "Barbory", "barbora"), ("Alžběta", "Alžběty", "alzbeta"))
SURNAMES = (("Zeman", "Zemanová", "Zemana", "Zemanové", "zeman"), ("Čihák", "Čiháková", "Čiháka", "Čihákové", "cihak"), ("Vondrák", "Vondráková", "Vondráka", "Vondrákové", "vondrak"), ("Holub", "Holubová", "Holuba", "Holubové", "holub"), ("Brdlanský", "Brdlanská", "Brdlanského", "Brdlanské", "brdlansky"))
PLACES = ("Lubné", "Kamenici", "Brodci")
TRADES = ("rolník", "kovář", "domkář")


def _pick(values: tuple[str, ...], i: Column | str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.expr(i) if isinstance(i, str) else i).cast("int") % len(values) + 1)


def _sql(values: tuple[str, ...], i: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][(({i}) % {len(values)} + 1)::INT]"


def _column(table: tuple[tuple[str, ...], ...], k: int) -> tuple[str, ...]:
    return tuple(r[k] for r in table)


_K, _F, _M = "c_custkey", "c_custkey div 2", "c_custkey div 3"
_DK, _DF, _DM = "c_custkey", "c_custkey // 2", "c_custkey // 3"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a cell each: man or woman, name in either order, trade and place, one parent or both."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("c_custkey")
    woman = k % 4 == 3
    given = F.when(woman, _pick(_column(WOMEN, 0), _K)).otherwise(_pick(_column(MEN, 0), _K))
    surname = F.when(woman, _pick(_column(SURNAMES, 1), _F)).otherwise(_pick(_column(SURNAMES, 0), _F))
    name = F.when(k % 5 < 3, F.concat(surname, F.lit(" "), given)).otherwise(F.concat(given, F.lit(" "), surname))
    trade = F.when(k % 7 != 0, F.concat(F.lit(", "), _pick(TRADES, _M), F.lit(" v "), _pick(PLACES, _K)))
    status = F.when(k % 11 == 0, F.when(woman, F.lit(", vdova")).otherwise(F.lit(", vdovec")))
    father = F.concat(_pick(_column(MEN, 1), _M), F.lit(" "), _pick(_column(SURNAMES, 2), _F))
    mother = F.concat(F.lit(" a "), _pick(_column(WOMEN, 1), _F), F.lit(" roz. "), _pick(_column(SURNAMES, 3), _M))
    parents = F.when(k % 6 != 0, F.concat(F.when(woman, F.lit(", dcera ")).otherwise(F.lit(", syn ")), father, F.when(k % 3 != 0, mother).otherwise(F.lit(""))))
    cell = F.concat(name, F.coalesce(trade, F.lit("")), F.coalesce(status, F.lit("")), F.coalesce(parents, F.lit("")))
    return c.withColumn("cell", F.when(k % 13 == 12, F.lit(" ")).otherwise(cell))


@query(f"""SELECT c_custkey, CASE WHEN blank THEN '' WHEN woman THEN {_sql(_column(WOMEN, 2), _DK)} ELSE {_sql(_column(MEN, 2), _DK)} END AS given_norm, CASE WHEN blank THEN '' ELSE {_sql(_column(SURNAMES, 4), _DF)} END AS surname_norm,
  CASE WHEN blank THEN '' WHEN woman THEN 'f' ELSE 'm' END AS sex, CASE WHEN blank OR c_custkey % 7 = 0 THEN '' ELSE {_sql(TRADES, _DM)} || ' v ' || {_sql(PLACES, _DK)} END AS occupation,
  CASE WHEN blank OR c_custkey % 7 = 0 THEN '' ELSE {_sql(PLACES, _DK)} END AS place, CASE WHEN blank OR c_custkey % 11 <> 0 THEN '' WHEN woman THEN 'vdova' ELSE 'vdovec' END AS marital_status,
  CASE WHEN has_father THEN {_sql(_column(MEN, 2), _DM)} END AS father_given, CASE WHEN has_father THEN {_sql(_column(SURNAMES, 4), _DF)} END AS father_surname, CASE WHEN has_father THEN {_sql(_column(MEN, 0), _DM)} END AS father_written,
  CASE WHEN has_mother THEN {_sql(_column(WOMEN, 2), _DF)} END AS mother_given, CASE WHEN has_mother THEN {_sql(_column(SURNAMES, 4), _DM)} END AS mother_maiden
  FROM (SELECT *, c_custkey % 4 = 3 AS woman, c_custkey % 13 = 12 AS blank, c_custkey % 13 <> 12 AND c_custkey % 6 <> 0 AS has_father, c_custkey % 13 <> 12 AND c_custkey % 6 <> 0 AND c_custkey % 3 <> 0 AS has_mother FROM customer)""")  # fmt: skip
def person_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cells(spark, sf_dir).withColumn("c", N.parse_person_cell("cell"))
    own = [F.col(f"c.p.{f}").alias(f) for f in ("given_norm", "surname_norm", "sex", "occupation", "place", "marital_status")]
    return c.select("c_custkey", *own, F.col("c.f.given_norm").alias("father_given"), F.col("c.f.surname_norm").alias("father_surname"), F.col("c.f.given").alias("father_written"), F.col("c.m.given_norm").alias("mother_given"), F.col("c.m.maiden_norm").alias("mother_maiden"))


@query(f"""WITH w AS (SELECT c_custkey AS k, c_custkey % 3 AS form FROM customer)
  SELECT k, CASE form WHEN 2 THEN {_sql(_column(WOMEN, 2), 'k')} ELSE {_sql(_column(MEN, 2), 'k')} END AS in_context, CASE form WHEN 2 THEN 'f' ELSE 'm' END AS sex, CASE form WHEN 2 THEN {_sql(_column(WOMEN, 0), 'k')} ELSE {_sql(_column(MEN, 0), 'k')} END AS written FROM w""")  # fmt: skip
def given_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms 0: a man's nominative, 1: his genitive, 2: a woman's genitive."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 3).alias("form"))
    word = F.when(F.col("form") == 0, _pick(_column(MEN, 0), "k")).when(F.col("form") == 1, _pick(_column(MEN, 1), "k")).otherwise(_pick(_column(WOMEN, 1), "k"))
    sex, genitive = F.when(F.col("form") == 2, "f").otherwise("m"), F.col("form") > 0
    return c.select("k", X.given_norm_in_context(word, genitive, sex).alias("in_context"), X.sex_from_given(X.nominative_given(word, genitive, sex)).alias("sex"), X.nominative_given(word, genitive, sex).alias("written"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN trim(c_mktsegment) ELSE '' END AS first,
  CASE c_custkey % 4 WHEN 0 THEN 'vdovec' WHEN 1 THEN 'vdova' END AS status, regexp_replace('a' || c_custkey || ': b/c', '[/:]+', '_', 'g') AS safe,
  CASE WHEN c_custkey % 2 = 0 THEN 'x/' || c_custkey || '.png' ELSE 'other/' || c_custkey || '.png' END AS relative, coalesce('*' || CASE WHEN c_custkey % 3 <> 0 THEN (1800 + c_custkey % 99) END, '') || CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 2 = 0 THEN ' ' ELSE '' END
  || coalesce('†' || CASE WHEN c_custkey % 2 = 0 THEN (1900 + c_custkey % 50) END, '') AS years, CASE WHEN c_custkey % 2 = 0 THEN c_custkey::VARCHAR ELSE 'Book ' || c_custkey END AS book FROM customer""")  # fmt: skip
def small_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    text = k.cast("string")
    return c.select(
        "c_custkey",
        X.first_non_empty(F.lit("  "), F.when(k % 3 == 0, F.concat(F.lit(" "), "c_name")), F.when(k % 3 == 1, F.concat("c_mktsegment", F.lit("\t")))).alias("first"),
        X.status_of(F.element_at(F.array(F.lit(" Vdovec "), F.lit("VDOVA"), F.lit("nikdo"), F.lit("")), (k % 4 + 1).cast("int"))).alias("status"),
        X.safe_file_name(F.concat(F.lit(" a"), text, F.lit(": b/c "))).alias("safe"),
        X.relative_path(F.concat(F.when(k % 2 == 0, F.lit("root\\dir/x\\")).otherwise(F.lit("other/")), text, F.lit(".png")), F.lit("root/dir/")).alias("relative"),
        X.years_label(F.when(k % 3 != 0, 1800 + k % 99), F.when(k % 2 == 0, 1900 + k % 50)).alias("years"),
        X.book_id_of(F.when(k % 2 == 0, F.concat(F.lit("dir/Kniha ["), text, F.lit("].jsonl"))).otherwise(F.concat(F.lit("dir/Book "), text, F.lit(".jsonl")))).alias("book"),
    )


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'gif' WHEN 3 THEN 'webp' ELSE 'bin' END AS kind, sha256(encode(doc_id::VARCHAR)[1:2]) AS first_two FROM documents")
def content_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    head = F.element_at(F.array(*(F.lit(h) for h in ("89504E470D0A", "FFD8FFE0", "474946383961", "524946460000000057454250", "00FF"))), (k % 5 + 1).cast("int"))
    return d.select("doc_id", X.image_type(F.unhex(head)).alias("kind"), X.content_hash(F.encode(k.cast("string"), "UTF-8"), 2).alias("first_two"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 8 = 0 THEN 'unknown' WHEN s_suppkey % 8 IN (1, 2, 4) THEN CASE s_suppkey % 8 WHEN 1 THEN 'narozeni' WHEN 2 THEN 'oddani' ELSE 'umrti' END ELSE 'kombinovana' END AS typ,
  'Okres ' || s_nationkey AS district, (s_suppkey % 90 + 1)::INT AS sheets, 'Ves ' || s_nationkey || ',Lhota' AS localities, CASE WHEN s_suppkey % 2 = 1 THEN '1700 - 1750' END AS births FROM supplier""")  # fmt: skip
def book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive pages of books: which of three ranges of years they have, district, sheets, places."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    row = lambda label, *values: F.concat(F.lit('<tr class="tableMatrikaBasicInfoRow"><td class="tableMatrikaBasicInfoHeader1"><div>'), F.lit(label), F.lit("</div></td>"), *(F.concat(F.lit('<td class="tableMatrikaBasicInfoHeader2"><div>'), v, F.lit("</div></td>")) for v in values), F.lit("</tr>"))
    span = lambda bit: F.when(F.expr(f"s_suppkey div {bit} % 2 = 1"), F.lit("1700 - 1750")).otherwise(F.lit("-"))
    html = F.concat(row("N", span(1), F.lit("I")), row("O", span(2), F.lit("II")), row("Z", span(4), F.lit("III")), row("Okres", F.concat(F.lit("Okres&nbsp;"), F.col("s_nationkey").cast("string"))), row("Počet listů", (k % 90 + 1).cast("string")), F.lit('<b class="obecCastLabel">Ves '), F.col("s_nationkey").cast("string"), F.lit('</b><b class="obecCastLabel">Lhota</b>'))
    m = metadata.parse_meta(s.select("s_suppkey", html.alias("html")))
    return m.select("s_suppkey", "typ", "district", "sheets", F.array_join("localities", ",").alias("localities"), F.col("record_ranges")["narozeni"].alias("births"))


@query("SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN (o_orderkey % 100)::VARCHAR WHEN 1 THEN '2; x' WHEN 2 THEN 'ano' WHEN 3 THEN '' WHEN 4 THEN '1.5' ELSE 'text ' || o_orderkey END AS value, o_orderkey % 6 <> 3 AS filled FROM orders")
def values_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a model, one value each, as cells."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    value = F.element_at(F.array(F.concat((k % 100).cast("string"), F.lit(".0")), F.lit('[2, null, " x "]'), F.lit("true"), F.lit("null"), F.lit("1.5"), F.concat(F.lit('" text '), k.cast("string"), F.lit(' "'))), (k % 6 + 1).cast("int"))
    raw = F.concat(F.lit('Here it is: {"folio": "1", "rows": [{"vek": '), value, F.lit(', "cislo": "1"}]} end'))
    a = quality.read_answers(o.select("o_orderkey", raw.alias("raw")), template("umrti"))
    cell = F.col("rows")[0]["vek"]
    return a.select("o_orderkey", cell.alias("value"), (cell != "").alias("filled"))


_LINKS = "(SELECT l_partkey AS person_id, (l_orderkey * 10 + l_linenumber) * 1000 + l_suppkey % 1000 AS mention_id FROM lineitem)"


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("person_id"), F.expr("(l_orderkey * 10 + l_linenumber) * 1000 + l_suppkey % 1000").alias("mention_id"))


_CONS = f"""links AS {_LINKS}, firsts AS (SELECT person_id, min(mention_id) AS lo, max(mention_id) AS hi FROM links GROUP BY 1),
cons AS (SELECT 'cannot_link' AS kind, a.lo AS mention_a, b.hi AS mention_b FROM firsts a JOIN firsts b ON b.person_id = a.person_id + 1 UNION SELECT 'must_link', lo, hi FROM firsts)"""


def _cons(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _links(spark, sf_dir).groupBy("person_id").agg(F.min("mention_id").alias("lo"), F.max("mention_id").alias("hi"))
    other = f.select((F.col("person_id") - 1).alias("person_id"), F.col("hi").alias("mention_b"))
    return f.join(other, "person_id").select(F.lit("cannot_link").alias("kind"), F.col("lo").alias("mention_a"), "mention_b").unionByName(f.select(F.lit("must_link").alias("kind"), F.col("lo").alias("mention_a"), F.col("hi").alias("mention_b")))


@query(f"""WITH {_CONS}, own AS (SELECT mention_id, person_id FROM links WHERE person_id IN (7, 8)),
across AS (SELECT kind, mention_a, mention_b FROM cons JOIN own a ON a.mention_id = mention_a JOIN own b ON b.mention_id = mention_b WHERE kind = 'cannot_link' AND a.person_id <> b.person_id)
SELECT * FROM cons EXCEPT SELECT * FROM across UNION SELECT 'must_link', least(a.lo, b.lo), greatest(a.lo, b.lo) FROM firsts a, firsts b WHERE a.person_id = 7 AND b.person_id = 8""")  # fmt: skip
def merged_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.merge_persons(_cons(spark, sf_dir), _links(spark, sf_dir), 7, 8).distinct()


@query(f"""WITH {_CONS}, gone AS (SELECT max(mention_id) AS g FROM links WHERE person_id = 9), own AS (SELECT mention_id, mention_id = g AS goes FROM links, gone WHERE person_id = 9),
across AS (SELECT kind, mention_a, mention_b FROM cons JOIN own a ON a.mention_id = mention_a JOIN own b ON b.mention_id = mention_b WHERE kind = 'must_link' AND a.goes <> b.goes)
SELECT * FROM cons EXCEPT SELECT * FROM across UNION SELECT 'cannot_link', g, (SELECT min(mention_id) FROM own WHERE NOT goes) FROM gone""")  # fmt: skip
def split_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir)
    last = links.where("person_id = 9").agg(F.max("mention_id")).first()[0]
    return search.split_person(_cons(spark, sf_dir), links, 9, [last]).distinct()


@query(f"WITH {_CONS} SELECT * FROM cons WHERE mention_a IN (SELECT mention_id FROM links WHERE person_id % 3 <> 0) AND mention_b IN (SELECT mention_id FROM links WHERE person_id % 3 <> 0)")
def constraints_without_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _links(spark, sf_dir).where("person_id % 3 <> 0").select(F.col("mention_id").alias("id"))
    return extract.without_stale(_cons(spark, sf_dir), left, "mention_a", "mention_b").select("kind", "mention_a", "mention_b")


@query("""SELECT o_custkey::VARCHAR AS book_id, o_orderkey::VARCHAR AS file, u.side, o_custkey || '_' || o_orderkey || '_' || upper(u.side[1]) AS id,
  CASE WHEN u.side = 'left' THEN 'v' || o_orderkey ELSE '' END AS number, CASE WHEN u.side = 'right' THEN 'n' || o_orderkey ELSE '' END AS remark FROM orders, (SELECT unnest(['left', 'right']) AS side) u""")  # fmt: skip
def half_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey").cast("string")
    rows = F.array(F.create_map(F.lit("cislo"), F.concat(F.lit("v"), k), F.lit("poznamenani"), F.concat(F.lit("n"), k)))
    s = o.select(F.col("o_custkey").cast("string").alias("book_id"), F.concat(k, F.lit(".png")).alias("file"), F.lit("1").alias("folio"), F.lit("").alias("rok"), rows.alias("rows"))
    h = dataset.half_samples(s, template("narozeni"))
    cell = lambda name: F.get_json_object("target", f"$.rows[0].{name}")
    return h.select("book_id", F.regexp_replace("file", ".png$", "").alias("file"), "side", "id", cell("cislo").alias("number"), cell("poznamenani").alias("remark"))


@query("SELECT o_custkey AS book_id, o_orderkey AS file FROM orders WHERE o_orderkey % 4 <> 0 AND o_custkey % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY o_custkey % 17, o_orderkey % 7 ORDER BY o_orderkey) = 1")
def usable_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("file"), F.col("o_orderkey").alias("seq"))
    images = o.where("file % 4 <> 0").select("book_id", "file", F.concat_ws("-", (F.col("book_id") % 17).cast("string"), (F.col("file") % 7).cast("string")).alias("sha256"))
    return dataset.usable(o, images, o.where("book_id % 5 = 0").select("book_id").distinct()).select("book_id", "file")


@query("SELECT l_orderkey AS page, (n - 1)::INT AS pos, 'b' || n AS band, 'r' || n AS row FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS n FROM lineitem)")
def paired_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.count("*").cast("int").alias("n"))
    numbered = lambda c: F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.lit(c), i.cast("string")))
    p = n.select("page", numbered("b").alias("bands"), numbered("r").alias("rows"), F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.lit(5.0)).alias("heights"))
    return dataset.row_samples(p).select("page", "pos", "band", "row")


@query("""SELECT name, value FROM (SELECT role AS name, count(*) AS value FROM (""" + "SELECT CASE l_linenumber WHEN 1 THEN 'otec' WHEN 2 THEN 'matka' ELSE 'dite' END AS role FROM lineitem" + """) GROUP BY 1 UNION ALL SELECT 'unparsed_dates', count(*) FROM orders WHERE o_orderkey % 7 = 0)""")
def extract_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") == 1, "otec").when(F.col("l_linenumber") == 2, "matka").otherwise("dite").alias("role"))
    e = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 7 < 2, "none").otherwise("day").alias("date_precision"), F.when(F.col("o_orderkey") % 7 == 1, "").otherwise("x").alias("date_text"))
    return extract.extract_report(m, e)


@query("""SELECT lang AS book_id, count(*) AS halves, count(*) FILTER (doc_id % 3 = 0) AS matched, coalesce(any_value(n), 0) AS rows FROM documents LEFT JOIN (SELECT lang AS l, count(*) AS n FROM documents WHERE doc_id % 5 = 0 AND lang <> 'fr' GROUP BY 1) ON l = lang GROUP BY 1""")
def dataset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("book_id"), "doc_id", (F.col("doc_id") % 3 == 0).alias("matched"))
    return dataset.dataset_report(d, d.where("doc_id % 5 = 0 AND book_id <> 'fr'"))


def _page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as page lines: a third not transcribed, the others with two rows."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    cells = lambda n, typ: F.create_map(F.lit("cislo"), (k * 2 % 1000 + n).cast("string"), F.lit("record_type"), F.when(k % 2 == 0, typ).otherwise(""))
    ok = k % 3 != 0
    page = F.struct(F.concat(k.cast("string"), F.lit(".png")).alias("file"), F.lit("umrti").alias("typ"), F.lit("f").alias("folio"), F.lit("").alias("rok"), ok.alias("ok"), F.array(cells(0, "oddani"), cells(1, "narozeni")).alias("rows"), F.struct((k % 5 != 0).alias("ok"), F.lit(0).alias("empty_cells"), F.array(F.lit("odd")).alias("issues")).alias("lint"), F.when(~ok, F.lit("timeout")).alias("error"))
    return o.select(F.col("o_custkey").cast("string").alias("book_id"), F.lit("Book").alias("book_name"), k.alias("line_no"), page.alias("page"))


_RECORD = "SELECT o_custkey::VARCHAR AS book_id, o_orderkey AS line_no, o_orderkey || '.png' AS file, n::INT AS row_idx, CASE WHEN o_orderkey % 2 = 1 THEN 'umrti' WHEN n = 0 THEN 'oddani' ELSE 'narozeni' END AS record_type, (o_orderkey * 2 % 1000 + n)::VARCHAR AS number FROM orders, (SELECT unnest([0, 1]) AS n) u WHERE o_orderkey % 3 <> 0"


@query(_RECORD)
def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.records(_page_rows(spark, sf_dir)).select("book_id", "line_no", "file", "row_idx", "record_type", F.col("cells")["cislo"].alias("number"))


@query("SELECT o_custkey::VARCHAR AS book_id, count(*) AS pages, count(*) FILTER (o_orderkey % 3 <> 0) AS pages_ok, count(*) FILTER (o_orderkey % 3 = 0) AS pages_failed, count(*) FILTER (o_orderkey % 3 <> 0) * 2 AS total_rows, array_to_string(list(o_orderkey || '.png: ' || CASE WHEN o_orderkey % 3 = 0 THEN 'timeout' ELSE 'odd' END ORDER BY o_orderkey) FILTER (o_orderkey % 3 = 0 OR o_orderkey % 5 = 0), '|') AS issues FROM orders GROUP BY 1")
def book_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _page_rows(spark, sf_dir)
    r = quality.book_report(p, pages.records(p))
    return r.select("book_id", "pages", "pages_ok", "pages_failed", F.col("total_rows").cast("long").alias("total_rows"), F.when(F.size("page_issues") > 0, F.array_join("page_issues", "|")).alias("issues"))


@query("SELECT DISTINCT o_custkey::VARCHAR AS book_id, o_orderkey || '.png' AS file FROM orders WHERE o_orderkey % 3 <> 0")
def finished_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.finished(_page_rows(spark, sf_dir))


@query("SELECT o_custkey::VARCHAR AS id, 'Book' AS name, 'umrti' AS typ FROM orders GROUP BY 1")
def page_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.books(_page_rows(spark, sf_dir)).select("id", "name", "typ")


@query("SELECT o_custkey::VARCHAR AS book_id, o_orderkey AS line_no, o_orderkey || '.png' AS file, o_orderkey % 3 <> 0 AS ok FROM orders")
def page_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.scans(_page_rows(spark, sf_dir)).select("book_id", "line_no", "file", "ok")


@query("SELECT record_id, CASE WHEN record_id % 4 = 0 THEN 'fixed ' || record_id WHEN record_id % 4 = 1 THEN 'new' ELSE 'old' END AS value, CASE WHEN record_id % 4 = 1 THEN 'added' ELSE '' END AS extra FROM (SELECT o_orderkey AS record_id FROM orders)")
def corrected_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"))
    r = o.withColumn("cells", F.create_map(F.lit("value"), F.lit("old")))
    k = F.col("record_id")
    fixes = o.where("record_id % 4 < 2").select("record_id", F.lit("value").alias("cell_key"), F.when(k % 4 == 0, F.concat(F.lit("fixed "), k.cast("string"))).otherwise("new").alias("corrected_value"))
    fixes = fixes.unionByName(o.where("record_id % 4 = 1").select("record_id", F.lit("extra").alias("cell_key"), F.lit("added").alias("corrected_value")))
    c = extract.corrected(r, search.corrected_cell(fixes, -1, "none", "x"))
    return c.select("record_id", F.col("cells")["value"].alias("value"), F.coalesce(F.try_element_at("cells", F.lit("extra")), F.lit("")).alias("extra"))


@query(REG + """ SELECT r.type, person_a, person_b, list_contains(list(e.type), 'birth') AS shown, bool_or(p.death_year_est IS NOT NULL) AS a_died FROM (SELECT type, person_a, person_b, unnest(evidence) AS record_id FROM reg_relations) r
  JOIN reg_events e USING (record_id) JOIN reg_persons p ON p.id = person_a GROUP BY 1, 2, 3""")  # fmt: skip
def shown_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = register(spark, sf_dir)
    nodes, edges = graph.subgraph(r.persons.select("id", F.lit(0).alias("depth")), r.persons, r.relations, r.events)
    e = edges.select("type", "person_a", "person_b", graph.visible(["birth"]).alias("shown"))
    return e.join(nodes.select(F.col("id").alias("person_a"), F.col("has_death").alias("a_died")), "person_a").select("type", "person_a", "person_b", "shown", "a_died")


@query(REG + " SELECT p.id, p.display_name, array_to_string(list_sort(list(m.id)), ',') AS mentions FROM reg_persons p JOIN reg_links l ON l.person_id = p.id JOIN reg_mentions m ON m.id = l.mention_id WHERE p.id = 20 GROUP BY 1, 2")
def one_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = register(spark, sf_dir)
    none = spark.createDataFrame([], "person_id long, other_id long, other_name string, score double")
    own = r.person_mentions.join(r.mentions.withColumnRenamed("id", "mention_id"), "mention_id").join(r.events.select("record_id", F.col("year").alias("event_year")), "record_id", "left").withColumnRenamed("mention_id", "id")
    person, mentions, _ = search.person_detail(20, r.persons, own, none)
    return person.select("id", "display_name").join(mentions.groupBy(F.col("person_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(mentions["id"])).cast("array<string>"), ",").alias("mentions")), "id")


@query("SELECT o_orderkey AS record_id, 'Book ' || o_custkey AS book_name, 'x' || o_orderkey AS fixed, 'v' AS cell FROM orders WHERE o_orderkey = 3")
def one_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    r = o.select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("book_id"), F.create_map(F.lit("a"), F.lit("v")).alias("cells"))
    fixes = o.select(F.col("o_orderkey").alias("record_id"), F.lit("a").alias("cell_key"), F.concat(F.lit("x"), F.col("o_orderkey").cast("string")).alias("corrected_value"))
    books = o.select(F.col("o_custkey").alias("id")).distinct().withColumn("name", F.concat(F.lit("Book "), F.col("id").cast("string")))
    return search.record_detail(3, r, fixes, books).select("record_id", "book_name", F.col("corrections")["a"].alias("fixed"), F.col("cells")["a"].alias("cell"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey > 0 THEN 'https://example.org/d/' || o_custkey || '/' || o_orderkey ELSE '' END AS link, array_to_string([x::VARCHAR FOR x IN range(1, 41)], ', ') || CASE WHEN o_orderkey % 3 = 0 THEN ' …' ELSE '' END AS shown FROM orders")
def links_and_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    file = F.when(k % 2 == 0, F.concat(F.lit("000"), k.cast("string"), F.lit(".png"))).otherwise("cover.png")
    return o.select("o_orderkey", sinks.deep_link(F.col("o_custkey").cast("string"), file, "https://example.org/d/").alias("link"), quality.preview(F.sequence(F.lit(1), F.when(k % 3 == 0, 45).otherwise(40))).alias("shown"))


@query("SELECT o_orderkey, CASE o_orderkey % 14 WHEN 0 THEN '' WHEN 13 THEN '13' ELSE (['led', 'úno', 'bře', 'dub', 'kvě', 'čvn', 'čvc', 'srp', 'zář', 'říj', 'lis', 'pro'])[o_orderkey % 14] END AS label FROM orders")
def month_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", X.month_label(F.col("o_orderkey") % 14).alias("label"))


@query("""SELECT o_orderkey, n_lines, first_line, last_line FROM (SELECT o_orderkey, o_orderkey % 20 + 1 AS n, [ 'w' || lpad((o_orderkey % 1000 + i)::VARCHAR, 8, '0') FOR i IN range(o_orderkey % 20 + 1)] AS w FROM orders),
  LATERAL (SELECT ((n + 2) // 3)::INT AS n_lines, array_to_string(w[1:3], ' ') AS first_line, array_to_string(w[(n - 1) // 3 * 3 + 1:n], ' ') AS last_line)""")  # fmt: skip
def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of nine letters, three to a line of at most 35."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    words = F.transform(F.sequence(F.lit(0).cast("long"), k % 20), lambda i: F.concat(F.lit("w"), F.lpad((k % 1000 + i).cast("string"), 8, "0")))
    w = o.select("o_orderkey", X.wrapped(F.array_join(words, " "), 35).alias("w"))
    return w.select("o_orderkey", F.size("w").alias("n_lines"), F.col("w")[0].alias("first_line"), F.element_at("w", -1).alias("last_line"))


@query("SELECT c_custkey + 1 AS id, 'must_link' AS kind, c_custkey AS mention_a, c_custkey + 1 AS mention_b, '' AS note FROM customer WHERE c_custkey <> 4 UNION ALL SELECT max(c_custkey) + 2, 'cannot_link', 3, 9, 'seen twice' FROM customer")
def edited_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).cast("long").alias("id"), F.lit("must_link").alias("kind"), F.col("c_custkey").cast("long").alias("mention_a"), (F.col("c_custkey") + 1).cast("long").alias("mention_b"), F.lit("").alias("note"))
    return search.without_constraint(search.added_constraint(c, "cannot_link", 3, 9, "seen twice"), 5)


@query("SELECT p_partkey, p_partkey % 100 / 100.0 < 0.85 AS unsure FROM part")
def unsure_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 100 / 100.0).alias("confidence")).select("p_partkey", graph.low_confidence().alias("unsure"))


@query("""SELECT o_orderkey AS record_id, CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders) THEN '1881-04-03' ELSE '1880-02-01' END AS date, 1::BIGINT AS mentions, true AS kept FROM orders""")
def reextracted_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cells corrected; only the book of the first record is extracted anew."""
    o = table(spark, sf_dir, "orders")
    cells = F.create_map(F.lit("datum_umrti"), F.lit("1.2.1880"), F.lit("zemrely_jmeno_stav"), F.lit("Jakub Zeman"))
    r = o.select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").cast("string").alias("book_id"), F.lit("umrti").alias("record_type"), cells.alias("cells"))
    events, mentions = extract.extract_events(r), staged(extract.extract_mentions(r), "before")
    one = r.orderBy("record_id").first()
    other = r.where(F.col("book_id") != one["book_id"]).agg(F.min("record_id").alias("record_id")).first()["record_id"]
    none = spark.createDataFrame([], "record_id long, cell_key string, corrected_value string")
    fixes = search.corrected_cell(search.corrected_cell(none, other, "datum_umrti", "9.9.1899"), one["record_id"], "datum_umrti", "3.4.1881")
    e, m = extract.reextracted(r, fixes, events, mentions, one["record_id"])
    by = m.join(mentions.select("id", F.col("record_id").alias("before")).hint("merge"), "id", "left").groupBy("record_id").agg(F.count("*").alias("mentions"), F.bool_and(F.col("before").eqNullSafe(F.col("record_id"))).alias("kept"))
    return e.select("record_id", "date").join(by, "record_id")


@query(f"""WITH rec AS ({_RECORD}), num AS (SELECT book_id, number::INT AS n FROM rec), span AS (SELECT book_id, min(n) AS lo, max(n) AS hi FROM num GROUP BY 1),
gap AS (SELECT book_id, list(n ORDER BY n) AS g FROM (SELECT book_id, unnest(range(lo, hi + 1))::INT AS n FROM span EXCEPT SELECT * FROM num) GROUP BY 1),
dup AS (SELECT book_id, list(n ORDER BY n) AS d FROM (SELECT book_id, n FROM num GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1),
page AS (SELECT o_custkey::VARCHAR AS book_id, count(*) AS pages, count(*) FILTER (o_orderkey % 3 <> 0) AS ok, count(*) FILTER (o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0) AS even,
  list('look at  ' || o_orderkey || '.png: ' || CASE WHEN o_orderkey % 3 = 0 THEN 'timeout' ELSE 'odd' END ORDER BY o_orderkey) FILTER (o_orderkey % 3 = 0 OR o_orderkey % 5 = 0) AS issues FROM orders GROUP BY 1)
SELECT book_id, 'book     Book' || chr(10) || 'pages    ' || ok || ' read, ' || pages - ok || ' failed' || chr(10) || 'rows     ' || ok * 2 || chr(10)
  || 'numbers  ' || CASE WHEN lo IS NULL THEN 'none' ELSE 'from ' || lo || ' to ' || hi END || chr(10)
  || CASE WHEN g IS NULL THEN '' ELSE 'missing  ' || array_to_string(g[1:40], ', ') || CASE WHEN len(g) > 40 THEN ' …' ELSE '' END || chr(10) END
  || CASE WHEN d IS NULL THEN '' ELSE 'repeated ' || array_to_string(d[1:40], ', ') || CASE WHEN len(d) > 40 THEN ' …' ELSE '' END || chr(10) END
  || CASE WHEN ok = 0 THEN '' ELSE 'filled   cislo in ' || ok * 2 || ' of ' || ok * 2 || ' rows, 100 per cent' || chr(10) END
  || CASE WHEN even = 0 THEN '' ELSE 'filled   record_type in ' || even * 2 || ' of ' || ok * 2 || ' rows, ' || even * 100 // ok || ' per cent' || chr(10) END
  || CASE WHEN issues IS NULL THEN '' ELSE array_to_string(issues, chr(10)) || chr(10) END AS text
FROM page LEFT JOIN span USING (book_id) LEFT JOIN gap USING (book_id) LEFT JOIN dup USING (book_id)""")  # fmt: skip
def report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _page_rows(spark, sf_dir)
    r = pages.records(p)
    return quality.report_texts(quality.book_report(p, r), quality.fill_rates(r))
