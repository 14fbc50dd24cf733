"""The pipeline, stage by stage, against plain versions on the whole small table."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

import corpus_pipeline
from quillspark.llm import decontamination, quality
from quillspark.llm.common import table
from quillspark.llm.token_counts import tokenizer_path
from tests.llm.test_exact import plain_fingerprint, plain_spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("steps")
    docs = table(spark, SF, "documents")
    found = [("documents", docs.collect())]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
        found.append((name, docs.collect()))
    return dict(found)


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_quality_keeps_what_the_operator_predicts(spark, steps):
    scored = quality.score_quality(table(spark, SF, "documents"), table(spark, SF, "labels"))
    assert ids(steps["quality"]) == ids(scored.where("predicted = 1").collect()) != ids(steps["documents"])


def test_smallest_of_each_group_stays(steps):
    fp = {r["doc_id"]: plain_fingerprint(r["text"]) for r in steps["quality"]}
    root = {i: i for i in fp}
    for _ in range(8):
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    assert ids(steps["simhash"]) == sorted(set(root.values())) and len(set(root.values())) < len(fp)


def test_documents_with_items_go(spark, steps):
    form = lambda t: bytes(decontamination.normalised(np.frombuffer(t.encode(), np.uint8))[0])
    items = [form(r["text"]).strip() for r in table(spark, SF, "benchmark").collect()]
    held = {r["doc_id"] for r in steps["simhash"] if any(i in form(r["text"]) for i in items)}
    assert set(ids(steps["simhash"])) - set(ids(steps["decontamination"])) == held and held


def test_secrets_are_replaced(steps):
    before = {r["doc_id"]: r["text"] for r in steps["decontamination"]}
    assert ids(steps["secrets"]) == sorted(before)
    for r in steps["secrets"]:
        t, spans = before[r["doc_id"]], plain_spans(before[r["doc_id"]])
        assert not plain_spans(r["text"]) and r["n_chars"] == len(r["text"]) and (r["text"] == t) == (not spans)


def test_pieces_hold_all_tokens_once(steps):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    pieces: dict[int, list] = {}
    for r in steps["packing"]:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert sorted(pieces) == ids(steps["secrets"])
    for r in steps["secrets"]:
        own = np.array([*t.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(pieces[r["doc_id"]], key=lambda p: p["start"]):
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(own[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(own)


def test_run_gives_the_last_stage(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert {(r["doc_id"], r["start"], r["ids_crc32"]) for r in got.collect()} >= {(r["doc_id"], r["start"], r["ids_crc32"]) for r in steps["packing"] if r["length"] == 2048}
