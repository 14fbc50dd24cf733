"""Readers over splits and versioned tables."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from quillspark.sources import pages, sinks
from quillspark.sources.versions import Versions


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "1000", "spark.sql.files.openCostInBytes": "10"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_numbers_of_lines_over_splits(spark, tmp_path, small_splits):
    """Books larger than a split, lines longer than one, blank lines, both line ends, odd names."""
    r, want = random.Random(2), {}
    for k, name in enumerate(("Kniha A+B [12]", "Lhota č. 3 [7]", "empty [8]", "one")):
        lines = [json.dumps({"file": f"{i}.png", "typ": "umrti", "ok": True, "rows": [{"cislo": "é" * r.choice([0, 5, 300, 2500])}]}, ensure_ascii=False) for i in range((90, 40, 0, 1)[k])]
        lines = [x for line in lines for x in ((line, "", "  \r") if r.random() < 0.2 else (line,))]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(x + r.choice(["", "\r"]) for x in lines) + r.choice(["", "\n"]), encoding="utf-8", newline="")
        want |= {(name, i): json.loads(x)["file"] for i, x in enumerate(lines) if x.strip()}
    read = pages.read_pages(spark, f"{tmp_path}/*.jsonl")
    assert read.rdd.getNumPartitions() > 20
    assert {(x["book_name"], x["line_no"]): x["f"] for x in read.select("book_name", "line_no", F.col("page.file").alias("f")).collect()} == want
    assert {x["book_id"] for x in read.select("book_id").distinct().collect()} == {"12", "7", "one"}


def test_a_bad_line_fails_its_book(spark, tmp_path):
    good = json.dumps({"file": "1.png", "ok": True})
    (tmp_path / "a [1].jsonl").write_text(f"{good}\n\n{good}\n")
    (tmp_path / "b [2].jsonl").write_text(f"{good}\n{{broken\n{good}\n{{again\n")
    (tmp_path / "c [3].jsonl").write_text(f"{good}\n" + json.dumps({"file": "x" * 500}) + "\n")
    read = pages.read_pages(spark, f"{tmp_path}/*.jsonl", strict=False, most_bytes=200)
    assert sorted((x["book_id"], x["line_no"]) for x in pages.sound_books(read).collect()) == [("1", 0), ("1", 2)]
    assert sorted((x["path"].rpartition("/")[2][0], x["line_no"]) for x in pages.rejected(read).collect()) == [("b", 1), ("c", 1)]
    with pytest.raises(Exception, match="line too long"):
        pages.read_pages(spark, f"{tmp_path}/c*.jsonl", most_bytes=200).collect()
    with pytest.raises(Exception, match="(?i)malformed"):
        pages.read_pages(spark, f"{tmp_path}/b*.jsonl").collect()


def test_versions(spark, tmp_path):
    v = Versions(spark, str(tmp_path))
    assert v.current() is None
    with pytest.raises(ValueError, match="no version yet"):
        v.read("t")
    assert v.commit({"t": spark.range(3), "u": spark.range(1)}) == 1
    with pytest.raises(Exception, match="stop"):
        v.commit({"t": spark.range(9), "u": spark.range(5).select(F.raise_error(F.lit("stop")).alias("id"))})
    assert v.current()[0] == 1 and v.read("t").count() == 3
    assert v.commit({"t": v.read("t").union(spark.range(4)), "u": spark.range(2)}) == 2 and v.read("t").count() == 7 and v.read("u", 1).count() == 1
    v.commit({"t": spark.range(8)})
    v.prune(keep=2)
    assert v.read("t", 2).count() == 7 and v.read("t").count() == 8 and len(list(tmp_path.iterdir())) == 3
    with pytest.raises(Exception, match="(?i)path"):
        v.read("t", 1)
    with pytest.raises(ValueError, match="no version 9"):
        v.read("t", 9)


def test_side_files_are_written_once(spark, tmp_path):
    """A side file of a book, as one JSON file or as written by the sink, which keeps the first unless forced."""
    one = lambda name: spark.createDataFrame([("7", name, ["Lhota", "Ves"])], "id string, name string, localities array<string>")
    at = tmp_path / "Kniha A+B [7]" / "meta.json"
    sinks.write_once(one("first"), str(at))
    sinks.write_once(one("second"), str(at))
    (tmp_path / "deep" / "Plain [8]").mkdir(parents=True)
    (tmp_path / "deep" / "Plain [8]" / "meta.json").write_text('{\n "id": "8",\n "name": "plain"}')
    (tmp_path / "deep" / "Plain [8]" / "part-1.json").write_text('{"id": "no"}')
    read = lambda: sorted((r["id"], r["name"], r["folder"], r["localities"]) for r in pages.read_meta(spark, str(tmp_path)).collect())
    assert read() == [("7", "first", "Kniha A+B [7]", ["Lhota", "Ves"]), ("8", "plain", "Plain [8]", None)]
    sinks.write_once(one("second"), str(at), force=True)
    assert read()[0][1] == "second" and pages.read_meta(spark, str(tmp_path)).where("id = '7'").first()["scans_dir"].endswith("/Kniha%20A+B%20%5B7%5D")
