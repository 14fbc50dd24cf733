from __future__ import annotations

import random
from itertools import combinations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.operators import dataset, extract, graph, identity, linkage, metadata, quality, search
from quillspark.plans import analytics, catalog, snapshot
from quillspark.sources import pages, sinks
from quillspark.sources.templates import combined, template
from quillspark.streaming import pages as stream
from tests import village


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("village")
    p = pages.read_pages(spark, village.write(folder)).cache()
    records = extract.number_records(pages.records(p)).cache()
    events, mentions = extract.extract_events(records).cache(), extract.extract_mentions(records).cache()
    linked = linkage.link(mentions, events)
    books = pages.books(p, pages.read_meta(spark, f"{folder}/books"))
    reg = analytics.Register(events, mentions, linked.persons, linked.person_mentions, linked.relations, pages.scans(p), records, books)
    return {"folder": folder, "pages": p, "records": records, "events": events, "mentions": mentions, "linked": linked, "books": books, "reg": reg}


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


def roles_with(run, role, surname):
    j = run["mentions"].join(run["linked"].person_mentions, F.col("id") == F.col("mention_id"))
    own = j.where((F.col("role") == role) & (F.col("surname_norm") == surname)).select("person_id")
    return {r["role"] for r in j.join(own.distinct(), "person_id").collect()}


def test_sources(run):
    assert run["pages"].count() == 4 and run["records"].count() == 7 and run["reg"].scans.count() == 4
    assert rows(run["books"], "id", "district") == [("8101", "Tábor"), ("8102", ""), ("8103", "")]
    assert [r[0] for r in rows(run["records"], "record_id")] == list(range(1, 8))


def test_extract(run):
    e = {r["record_id"]: r for r in run["events"].collect()}
    assert (e[1]["date"], e[1]["house_no"], e[2]["date"], e[5]["date"], e[7]["year"]) == ("1861-09-07", "4", "1863-11-24", "1892-10-03", 1899)
    m = {(r["record_id"], r["role"], r["ordinal"]): r for r in run["mentions"].collect()}
    assert m[1, "matka", 0]["surname"] == "Zemanová" and m[2, "dite", 0]["surname"] == "Holubová" and m[2, "dite", 0]["marital_status"] == "nemanzelsky"
    assert m[4, "nevesta", 0]["birth_year"] == 1863 and m[4, "nevesta", 0]["extra"] == {"birth_date": "1863-11-24", "birth_date_precision": "day"}
    assert m[5, "nevesta", 0]["raw_text"] == "Mlýnec č. 30 | 1867 | vdova" and m[5, "nevesta", 0]["marital_status"] == "vdova"
    assert m[6, "zemrely", 0]["birth_year"] == 1835 and m[7, "zemrely", 0]["birth_year"] == 1851
    assert (2, "kmotr", 1) in m and (2, "babka", 0) not in m
    assert sum(r["surname_norm"] == "brdlansky" for r in m.values()) == 7
    ids = sorted((r["id"], r["record_id"]) for r in m.values())
    assert [i for i, _ in ids] == list(range(1, len(ids) + 1)) and [r for _, r in ids] == sorted(r for _, r in ids)


def test_corrections_keep_ids(spark, run):
    fix = spark.createDataFrame([(7, "zemrely_jmeno_stav", "Vondrák Jakub, nádeník v Mlýnci, syn Tomáše Vondráka")], "record_id long, cell_key string, corrected_value string")
    again = extract.extract_mentions(run["records"], fix, run["mentions"])
    old, new = {tuple(r) for r in rows(run["mentions"], "id", "record_id", "role", "ordinal")}, {tuple(r) for r in rows(again, "id", "record_id", "role", "ordinal")}
    assert old < new and [r[1:3] for r in new - old] == [(7, "zemrely_otec")]


def test_linkage(run):
    assert "dite" in roles_with(run, "zenich", "zeman") and "dite" in roles_with(run, "nevesta", "holub") and "dite" in roles_with(run, "zenich", "brdlansky")
    assert {"otec", "zenich_otec"} <= roles_with(run, "zemrely", "zeman") and "zenich_otec" in roles_with(run, "otec", "brdlansky")
    spouses = run["linked"].relations.where("type = 'spouse'")
    assert spouses.where("person_a >= person_b").count() == 0 and spouses.count() > 3


def test_rerun_is_stable(run):
    again = linkage.link(run["mentions"], run["events"], previous=run["linked"].person_mentions)
    assert rows(again.person_mentions, "person_id", "mention_id", "source") == rows(run["linked"].person_mentions, "person_id", "mention_id", "source")
    assert rows(again.relations, "type", "person_a", "person_b") == rows(run["linked"].relations, "type", "person_a", "person_b")


def test_constraints(spark, run):
    ids = {(r["role"], r["surname_norm"]): r["id"] for r in run["mentions"].collect()}
    groom, child, dead = ids["zenich", "zeman"], ids["dite", "zeman"], [ids["zemrely", "zeman"], ids["zemrely", "vondrak"]]
    cons = spark.createDataFrame([("cannot_link", groom, child), ("must_link", *dead), ("must_link", 9999, 1)], "kind string, mention_a long, mention_b long")
    got = {r["mention_id"]: r for r in linkage.link(run["mentions"], run["events"], cons, run["linked"].person_mentions).person_mentions.collect()}
    assert got[groom]["person_id"] != got[child]["person_id"] and got[dead[0]]["person_id"] == got[dead[1]]["person_id"]
    assert got[dead[0]]["source"] == "constraint" and got[groom]["source"] == "auto"


def greedy(n, must, cannot, may, flag):
    """Greedy clustering as the rules say, one pair after the other."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def union(a, b):
        a, b = sorted((find(a), find(b)))
        root[b] = a

    for a, b in must:
        union(a, b)
    for s, a, b in sorted(may, key=lambda x: (-x[0], x[1], x[2])):
        ends = {find(a), find(b)}
        if s >= flag and len(ends) == 2 and not any({find(x), find(y)} == ends for x, y in cannot):
            union(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_clusters_equal_plain_greedy(spark, seed):
    r = random.Random(seed)
    pairs = r.sample(list(combinations(range(40), 2)), 60)
    may = [(round(r.uniform(0.5, 1), 2), a, b) for a, b in pairs[:45]]
    must, cannot = pairs[45:48], pairs[48:]
    cons = spark.createDataFrame([("must_link", a, b) for a, b in must] + [("cannot_link", a, b) for a, b in cannot], "kind string, mention_a long, mention_b long")
    scored = spark.createDataFrame([(a, b, s) for s, a, b in may], "a long, b long, score double")
    got = dict(rows(linkage.clusters(spark.range(40), scored, cons, 0.72), "id", "root"))
    assert [got[i] for i in range(40)] == greedy(40, must, cannot, may, 0.72)


def test_components(spark):
    edges = pd.DataFrame([(i, i + 1) for i in range(50) if i % 10] + [(100, 3)], columns=["a", "b"])
    got = dict(rows(graph.components(spark.createDataFrame(edges)), "node", "root"))
    assert got[9] == 1 and got[50] == 41 and got[100] == 1 and 0 not in got
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_analyses(run):
    r = run["reg"]
    assert all(f(r).count() >= 0 for f in analytics.ANALYSES.values())
    assert rows(analytics.timeline(r), "name", "birth", "marriage", "death") == [(1861, 1, 0, 0), (1863, 1, 0, 0), (1866, 1, 0, 0), (1886, 0, 1, 0), (1892, 0, 1, 0), (1898, 0, 0, 1), (1899, 0, 0, 1)]
    assert rows(analytics.legitimacy(r), "name", "manzelske", "nemanzelske") == [(1860, 2, 1)]
    assert rows(analytics.remarriages(r), "name", "snatky", "vdovci", "vdovy") == [(1880, 1, 0, 0), (1890, 1, 0, 1)]
    assert dict(rows(analytics.lifespan(r), "name", "value")) == {40: 1, 60: 1}
    assert dict(rows(analytics.family_size(r), "name", "value"))[0] >= 1
    with pytest.raises(KeyError):
        analytics.analysis("other", r)


def test_search_and_graph(run):
    linked, m = run["linked"], run["mentions"]
    found = search.search(linked.persons, m, linked.person_mentions, q="Brdlansky adam")
    assert {r["name"] for r in found.collect()} and found.where("NOT name LIKE '%rdlansk%'").count() == 0
    assert search.search(linked.persons, m, linked.person_mentions, place="mlýn", year_from=1860, year_to=1862).where("name = 'Tomáš Zeman'").count() == 1
    tree = graph.surname_tree("Zeman", m, linked.person_mentions, linked.relations, 1)
    assert tree.where("focus").count() > 0 and tree.where("depth = 1").count() > 0
    shown, edges = graph.subgraph(tree, linked.persons, linked.relations, run["events"])
    assert shown.where("has_death").count() >= 1 and edges.where("size(layers) = 0").count() == 0
    assert edges.where(graph.visible(["birth"])).count() <= edges.count()


def test_edits(spark, run):
    links = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (2, 21)], "person_id long, mention_id long")
    cons = spark.createDataFrame([("cannot_link", 10, 20), ("must_link", 10, 11)], "kind string, mention_a long, mention_b long")
    assert rows(search.merge_persons(cons, links, 1, 2), "kind", "mention_a", "mention_b") == [("must_link", 10, 11), ("must_link", 10, 20)]
    assert rows(search.split_person(cons, links, 1, [11]), "kind", "mention_a", "mention_b") == [("cannot_link", 10, 20), ("cannot_link", 11, 10)]
    with pytest.raises(ValueError):
        search.split_person(cons, links, 1, [10, 11])


def test_lint_and_report(run):
    rows_ = run["records"].where("record_type = 'umrti'")
    assert rows(quality.gaps(rows_.select("book_id", F.col("cells")["cislo"].cast("int").alias("n")), "book_id", "n"), "n") == [(2,), (3,)]
    bad = rows_.withColumn("cells", F.map_from_arrays(F.array(F.lit("cislo"), F.lit("datum_umrti")), F.array(F.when(F.col("row_idx") == 0, "5").otherwise("4"), F.lit(""))))
    page = quality.lint_pages(bad, template("umrti")).first()
    assert page["issues"] == ["numbers do not rise (4 after 5)", "2 rows without required datum_umrti", "2 rows without required zemrely_jmeno_stav"] and not page["ok"]
    report = {r["book_id"]: r for r in quality.book_report(run["pages"], run["records"]).collect()}
    assert (report["8103"]["gaps"], report["8103"]["total_rows"], report["8101"]["pages_ok"]) == ([2, 3], 2, 2)
    assert quality.fill_rates(run["records"]).where("book_id = '8103' AND key = 'vek' AND percent = 100").count() == 1


def test_answers(spark):
    raw = 'Here:\n```json\n{"folio": "1", "rows": [{" Cislo ": 3.0, "vek": [1, "x"], "odd": true}, {}]}\n```'
    got = quality.read_answers(spark.createDataFrame([(raw,), ("no",)], "raw string"), template("umrti")).collect()
    assert got[0]["ok"] and len(got[0]["rows"]) == 1 and got[0]["rows"][0]["cislo"] == "3" and got[0]["rows"][0]["vek"] == "1; x" and got[0]["unknown_keys"] == ["odd"]
    assert not got[1]["ok"] and got[1]["rows"] == []
    assert quality.json_block('x {"a": "}\\""} y') == '{"a": "}\\""}' and quality.json_block("{") is None and quality.as_text(True) == "ano"


def test_halves_and_samples(spark, run):
    left, right = F.array(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit(""))), F.array(F.create_map(F.lit("b"), F.lit("2")), F.create_map(F.lit("a"), F.lit("3")))
    got = spark.range(1).select(quality.merged_halves(left, right).alias("m"), quality.halves_issue(left, right).alias("i")).first()
    assert got["m"] == [{"a": "1", "b": "2"}, {"a": "3"}] and "left 1, right 2" in got["i"]
    assert dataset.visible_keys("oddani", "right")[-1] == "poznamenani" and len(dataset.visible_keys("narozeni", "left")) == 10
    s = run["pages"].where("book_id = '8101'").select("book_id", "page.*").select("book_id", "file", "folio", "rok", "rows")
    halves = dataset.half_samples(s, template("narozeni"))
    assert halves.count() == 4 and rows(halves.where("file = '0001.png'"), "id") == [("8101_0001_L",), ("8101_0001_R",)]
    w = spark.createDataFrame([([9.0, 3.0, 3.1, 3.0, 8.0],), ([1.0, 2.0],), ([1.0, 9.0, 1.0, 9.0],)], "h array<double>")
    assert [r[0] for r in w.select(dataset.uniform_window("h", 3)).collect()] == [2, None, None]
    ev = spark.createDataFrame([("b", [{"a": "abcd"}], [{"a": "abcx"}]), ("b", [{"a": "x"}], None), ("c", [{"a": "q"}], [{"a": "q"}])], "book_id string, truth array<map<string,string>>, got array<map<string,string>>")
    got = {r["book_id"]: r for r in dataset.evaluation(ev).collect()}
    assert (got["b"]["cer"], got["b"]["json_valid"], got[None]["n"], got["c"]["field_accuracy"]) == (0.25, 1, 3, 1.0)


def test_usable_scans_and_samples(spark):
    scans = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "1", 3), ("c", "1", 4)], "book_id string, file string, seq long")
    images = spark.createDataFrame([("a", "1", "x"), ("a", "2", "y"), ("b", "1", "x"), ("c", "1", "z")], "book_id string, file string, sha256 string")
    out = dataset.usable(scans, images, spark.createDataFrame([("c",)], "book_id string"))
    assert rows(out, "book_id", "file") == [("a", "1"), ("a", "2")]
    assert rows(dataset.every(scans, 3, "seq"), "seq") == [(1,), (4,)]


def test_templates_and_meta(spark):
    assert [len(template(t).keys) for t in ("narozeni", "oddani", "umrti")] == [16, 19, 12] and combined().keys[0] == "record_type"
    with pytest.raises(ValueError):
        template("x")
    cell = lambda n, v: f'tableMatrikaBasicInfoHeader{n}" x><div>{v}</div>'
    html = "".join("tableMatrikaBasicInfoRow" + cell(1, k) + "".join(cell(2, v) for v in vs) for k, vs in (("N", ["1700 - 1750", "-"]), ("O", ["---", "1"]), ("Z", ["1701-1720", "1"]), ("Okres", ["Kladno"])))
    got = metadata.parse_meta(spark.createDataFrame([(html + 'obecCastLabel">Lhota<',), (None,)], "html string")).collect()
    assert (got[0]["typ"], got[0]["district"], got[0]["record_ranges"]["umrti"], got[0]["localities"]) == ("kombinovana", "Kladno", "1701-1720", ["Lhota"]) and got[1]["typ"] == "unknown"


def test_sinks(spark, run, tmp_path):
    sinks.replace_books(run["records"], f"{tmp_path}/r")
    sinks.replace_books(run["records"].where("book_id = '8103'").limit(1), f"{tmp_path}/r")
    assert spark.read.parquet(f"{tmp_path}/r").count() == 6
    link = spark.createDataFrame([("55", "0006.png"), ("x", "0006.png"), ("55", "a.png")], "b string, f string").select(sinks.deep_link("b", "f", "https://example.org/d"))
    assert [r[0] for r in link.collect()] == ["https://example.org/d/55/6", "", ""]
    snapshot.write_snapshot(run["reg"], run["linked"].candidates, f"{tmp_path}/s", "https://example.org/d")
    assert spark.read.json(f"{tmp_path}/s/details").where("size(mentions) > 0").count() == run["linked"].persons.count()
    assert spark.read.json(f"{tmp_path}/s/stats").count() == 6


def test_stream_and_resume(spark, run, tmp_path):
    q = stream.ingest(stream.page_stream(spark, str(run["folder"])), f"{tmp_path}/t", f"{tmp_path}/c")
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/t").count() == 7
    files = spark.createDataFrame([("8101", f"000{i}.png") for i in range(1, 6)], "book_id string, file string")
    assert rows(pages.to_do(files, pages.finished(run["pages"]), 2, 4), "file") == [("0003.png",), ("0004.png",)]


def test_malformed_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"file": "1", "ok": true}\n{broken\n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        pages.read_pages(spark, f"{tmp_path}/x.jsonl").select("page").collect()
    assert pages.read_pages(spark, f"{tmp_path}/x.jsonl", strict=False).where("page IS NULL").count() == 1


def test_one_book_is_extracted_again(spark, run):
    target = run["records"].where("record_type = 'umrti'").orderBy("record_id").first()
    none = spark.createDataFrame([], "record_id long, cell_key string, corrected_value string")
    fixes = search.corrected_cell(none, target["record_id"], "datum_umrti", "2.3.1899")
    e, m = extract.reextracted(run["records"], fixes, run["events"], run["mentions"], target["record_id"])
    assert rows(e.where(F.col("record_id") == target["record_id"]), "date") == [("1899-03-02",)]
    assert rows(m, "id", "record_id", "role") == rows(run["mentions"], "id", "record_id", "role") and e.count() == run["events"].count()
    with pytest.raises(ValueError):
        extract.reextracted(run["records"], fixes, run["events"], run["mentions"], -5)


def test_constraints_come_and_go(spark):
    empty = spark.createDataFrame([], "id long, kind string, mention_a long, mention_b long, note string")
    one = search.added_constraint(empty, "must_link", 4, 5)
    two = search.added_constraint(one, "cannot_link", 4, 6, "other parish")
    assert rows(search.without_constraint(two, 1), "id", "kind", "mention_a", "mention_b", "note") == [(2, "cannot_link", 4, 6, "other parish")]
    for bad in (("link", 1, 2), ("must_link", 0, 2)):
        with pytest.raises(ValueError):
            search.added_constraint(empty, *bad)


def test_report_files(spark, run, tmp_path):
    report = quality.book_report(run["pages"], run["records"])
    sinks.write_reports(report, quality.report_texts(report, quality.fill_rates(run["records"])), str(tmp_path))
    text = "\n".join(r["value"] for r in spark.read.text(f"{tmp_path}/txt/book_id=8103").collect())
    assert "missing  2, 3" in text and "100 per cent" in text
    assert spark.read.json(f"{tmp_path}/json").where("book_id = 8103").first()["gaps"] == [2, 3]


def test_asked_again_until_json(spark):
    images = spark.createDataFrame([("a", b"x"), ("b", b"bad"), ("c", b"late")], "file string, content binary")

    def ask(content: bytes, n: int) -> str:
        if content == b"bad":
            raise RuntimeError("timeout")
        return '{"rows": []}' if content == b"x" or n else "no table"

    assert rows(quality.asked(images, ask), "file", "raw", "error", "tries") == [("a", '{"rows": []}', None, 1), ("b", "", "timeout", 2), ("c", '{"rows": []}', None, 2)]


def test_images_and_snapshot_parts_are_found(spark, tmp_path):
    for name in ("a/1.png", "a/2.JPG", "b/3.txt", "4.jpeg"):
        (tmp_path / "img" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "img" / name).write_bytes(b"x")
    assert sorted(r["path"].rpartition("/")[2] for r in pages.read_images(spark, f"{tmp_path}/img").collect()) == ["1.png", "2.JPG", "4.jpeg"]
    spark.range(2).write.json(f"{tmp_path}/snap/analytics/surnames")
    assert rows(snapshot.read_snapshot(spark, f"{tmp_path}/snap", "analytics/surnames"), "id") == [(0,), (1,)]


def test_gaps_of_a_report_are_not_shuffled(spark):
    ends = [(1, 1), (1, 40_000), (1, 40_000), (2, 7), (3, None)]
    rows = spark.createDataFrame(ends, "book_id long, n int").selectExpr("book_id", "map('cislo', coalesce(CAST(n AS STRING), '')) AS cells")
    p = spark.createDataFrame([(1,), (2,), (3,)], "book_id long").selectExpr("book_id", "'B' AS book_name", "0L AS line_no", "named_struct('file', 'f', 'ok', true, 'error', '', 'rows', array(1), 'lint', named_struct('ok', true, 'issues', array('x'))) AS page")
    report = quality.book_report(p, rows)
    got = {r["book_id"]: r for r in report.collect()}
    assert got[1]["gaps"] == list(range(2, 40_000)) and got[1]["duplicates"] == [40_000] and (got[1]["number_min"], got[1]["number_max"]) == (1, 40_000)
    assert all(got[k]["gaps"] is None and got[k]["duplicates"] is None for k in (2, 3)) and got[2]["number_min"] == 7 and got[3]["number_min"] is None
    assert "explode" not in report._jdf.queryExecution().executedPlan().toString()


def test_roles_are_counted_where_cells_lie(spark, monkeypatch):
    """No ids are given and nothing is written for a count of roles."""

    def written(*_):
        raise AssertionError("written")

    monkeypatch.setattr(identity, "staged", written)
    monkeypatch.setattr(extract, "staged", written)
    got = {r["role"]: r["n"] for r in catalog.extracted_roles(spark, "/root/testdata/sf0.001").collect()}
    assert got["otec"] > 0 and got["zenich"] * 2 == got["svedek"]
