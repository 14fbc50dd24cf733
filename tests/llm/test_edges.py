"""Every operator and stage on odd and on empty tables."""

from __future__ import annotations

import pytest

import corpus_pipeline
from quillspark.llm import chroma, decontamination, licenses, packing, quality, secrets, simhash, substring_dedup, token_counts, toxicity
from quillspark.llm.token_counts import tokenizer_path as path

PER_ROW = {
    "licenses": lambda d, *_: licenses.scan(d),
    "chroma": lambda d, *_: chroma.grouped(d, "doc_id", "text", rate=2000, frame=256, hop=64, sample="u1"),
    "secrets": lambda d, *_: secrets.scan(d),
    "tokens": lambda d, *_: token_counts.count_tokens(d, path("piece_bpe_32k.model"), chunk_chars=1000, overlap=50),
    "simhash": lambda d, *_: simhash.near_duplicates(d),
    "substring": lambda d, *_: substring_dedup.remove_repeats(d),
    "toxicity": lambda d, labels, _: toxicity.score_toxicity(d, labels),
    "quality": lambda d, labels, _: quality.score_quality(d, labels),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_each(odd, none_at_all, labels, benchmark, name):
    got = PER_ROW[name](odd, labels, benchmark).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in odd.collect())
    assert PER_ROW[name](none_at_all, labels, benchmark).count() == 0


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_without_labels(odd, labels, benchmark, name):
    got = PER_ROW[name](odd, labels.where("false"), benchmark).collect()
    assert len({r["score"] for r in got}) == 1 and all(0 <= r["score"] <= 1 for r in got)


def test_decontamination(odd, none_at_all, benchmark):
    assert decontamination.leaks(odd, benchmark).count() == 0 and decontamination.leaks(none_at_all, benchmark).count() == 0
    assert decontamination.leaks(odd, benchmark.where("false")).count() == 0
    assert decontamination.clean_documents(odd, benchmark).count() == odd.count()


def test_packing(odd, none_at_all):
    files = path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken")
    got = packing.pack(odd, *files).toPandas()
    assert got[got["doc_id"] == 2]["length"].tolist() == [1] and int((got["start"] == 0).sum()) == odd.count()
    assert packing.pack(none_at_all, *files).count() == 0


def test_stages(spark, odd, none_at_all, labels, benchmark, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, none_at_all):
        at = docs
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{name}-{docs is odd}")
            at = spark.read.parquet(f"{tmp_path}/{name}-{docs is odd}")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert at.columns == docs.columns
        assert (at.count() > 0) == (docs is odd)


def test_names_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "decontamination", "secrets", "packing"]


ROWS = "doc_id long, text string, __id string, component_id string, th string"


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_simhash_stage_keeps_texts_that_share_an_id(spark, most):
    a, b = " ".join(f"alpha{i}" for i in range(40)), " ".join(f"one{i}" for i in range(40))
    rows = [(3, a, "x"), (3, b, "y"), (5, a, "z"), (3, a, "w"), (7, "single", "s"), (7, "single", "s"), (None, a, "n"), (8, None, "e"), (9, "", "f")]
    docs = spark.createDataFrame([(i, t, x, x, None) for i, t, x in rows], ROWS)
    got = simhash.deduplicated(docs, most_broadcast=most)
    assert got.columns == docs.columns
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in got.collect())
    assert kept == sorted([("3", a), ("3", b), ("7", "single"), ("None", a), ("8", "")])
    again = sorted(map(str, simhash.deduplicated(docs.repartition(5), most_broadcast=most).collect()))
    assert again == sorted(map(str, got.collect()))


def test_values_on_odd_tables(odd, labels, benchmark):
    """Repeated ids with different texts, very long texts, clashing columns: each row has the value of its own text."""
    alone = {"licenses": ("n_words", "score"), "secrets": ("spans",), "tokens": ("n_tokens",), "simhash": ("fingerprint",), "toxicity": ("score",), "quality": ("score",), "chroma": ("fingerprint_sha256",)}
    numbered = odd.collect()
    spark = odd.sparkSession
    unique = spark.createDataFrame([(100 + k, r["text"]) for k, r in enumerate(numbered)], "doc_id long, text string")
    for name, columns in alone.items():
        if name in ("toxicity", "quality"):
            continue  # their models need the labels of the ids
        mine = {r["doc_id"] - 100: tuple(r[c] for c in columns) for r in PER_ROW[name](unique, labels, benchmark).collect()}
        want = sorted(str((r["doc_id"], mine[k])) for k, r in enumerate(numbered))
        assert sorted(str((r["doc_id"], tuple(r[c] for c in columns))) for r in PER_ROW[name](odd, labels, benchmark).collect()) == want
