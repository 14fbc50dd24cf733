"""Operators against brute force, exact round trips and held-out labels."""

from __future__ import annotations

import hashlib
import math
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import chroma, decontamination, induced_sort, licenses, packing, quality, queries, secrets, simhash, substring_dedup, toxicity
from quillspark.llm.bytewords import Words, batch_bytes
from quillspark.llm.components import connected_components
from quillspark.llm.token_counts import PieceCounter
from quillspark.llm.token_counts import tokenizer_path as path
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


# -- 1 ------------------------------------------------------------------------------


def license_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_license_places(spark):
    r = random.Random(1)
    bits = ["Under the MIT License", "apache license, VERSION 2", "CC BY-NC 4.0", "under the", "mit", "ſ", "license", licenses.NOTICES[0][1], licenses.NOTICES[2][1].replace("forms", "form"), "é", "K-x", "\x00"]
    rows = [(i, " ".join(r.choice(bits) for _ in range(r.randint(0, 9)))) for i in range(80)]
    for got in licenses.scan(frame(spark, rows)).collect():
        w = license_words(dict(rows)[got["doc_id"]])
        places = [(i, label) for label, phrase in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        assert (got["n_words"], got["n_base"]) == (len(w), len(places))
        assert (got["first_word"], got["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert got["base_labels"] == ",".join(sorted({x for _, x in places})) and set(got["base_labels"].split(",")) <= {*got["labels"].split(","), ""}


def test_license_notice_with_edits(spark):
    text = "x " + licenses.NOTICES[0][1].replace("free of charge", "without any charge").replace("portions", "parts") + " y"
    got = licenses.scan(frame(spark, [(1, text), (2, "licensed to no one under any license at all")])).orderBy("doc_id").collect()
    assert got[0]["labels"] == "mit" and got[0]["base_labels"] == "" and 0.8 <= got[0]["score"] < 1 and got[1]["labels"] == ""


def test_license_lower_cases_ascii_only(spark):
    t = "wor\u212a"
    notice = "waived all copyright and related or neighboring rights to this work"
    got = licenses.scan(frame(spark, [(1, notice.replace("work", t)), (2, "UNDER THE MIT LICENSE \u0130 I")])).orderBy("doc_id").collect()
    assert got[0]["score"] == pytest.approx(10 / 11) and got[1]["base_labels"] == "mit" and got[1]["n_words"] == 6


def test_license_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rel = c.sql(queries.oracle_sql()["op1_license_scan"])
    cols = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = queries.op1_license_scan(spark, SF).select(*cols).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == sorted(rel.select(*cols).fetchall())


# -- 2 ------------------------------------------------------------------------------


def test_chroma_aligns_cut_and_noisy_recordings(spark):
    rng = np.random.default_rng(0)
    rate, t = 11025, np.arange(11025 * 12) / 11025

    def tune(seed):
        notes = np.random.default_rng(seed).integers(40, 70, 48)
        return sum(np.sin(2 * np.pi * 440 * 2 ** ((notes[(t * 4).astype(int)] - 69) / 12) * t * h) / h for h in (1, 2, 3)) * 8000

    pcm = lambda x: np.clip(x, -32768, 32767).astype("<i2").tobytes()
    media = [(1, pcm(tune(1))), (2, pcm(tune(1)[20475:])), (3, pcm(tune(1) + rng.normal(0, 300, len(t)))), (4, pcm(tune(2))), (5, pcm(tune(1))), (6, b""), (7, None)]
    got = {r["doc_id"]: r for r in chroma.grouped(spark.createDataFrame(media, "id long, pcm binary"), "id", "pcm", rate).collect()}
    assert got[1]["group_id"] == got[2]["group_id"] == got[3]["group_id"] == got[5]["group_id"] == 1 and got[5]["class_id"] == 1
    assert got[4]["group_id"] == 4 and got[6]["group_id"] is None and got[7]["n_codes"] == 0
    a, b = (chroma.integers(chroma.chroma(np.frombuffer(media[i][1], "<i2").astype(np.float32), rate, 4096, 1365)) for i in (0, 1))
    assert chroma.aligned(a, b)[0] == 15


def test_chroma_recall_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    own = {r["doc_id"]: chroma.integers(chroma.chroma(np.frombuffer(r["text"].encode(), np.uint8).astype(np.float32) - 128, 2000, 256, 64)) for r in docs.collect()}
    ids = [i for i, c in own.items() if len(c)]
    near = [(x, y) for k, x in enumerate(ids) for y in ids[k + 1 :] if chroma.same(own[x], own[y], 0.2, 0.5, 8)[0]]
    group = {r["doc_id"]: r["group_id"] for r in queries.op2_chroma_fingerprints(spark, "/root/testdata/sf0.01").collect()}
    assert len(near) > 30 and np.mean([group[x] == group[y] for x, y in near]) >= 0.9


def fingerprint_rows(spark, rows):
    return spark.createDataFrame([(i, bytearray(c.astype("<u4").tobytes())) for i, c in rows], "rep long, codes binary").repartition(3)


def noisy(rng, codes, keep):
    """codes with three bits changed in each integer but those of keep."""
    flip = sum(np.uint32(1) << rng.permuted(np.tile(np.arange(32, dtype=np.uint32), (len(codes), 1)), axis=1)[:, k] for k in range(3))
    flip[list(keep)] = 0
    return codes ^ flip.astype(np.uint32)


@pytest.mark.parametrize("options", [{}, {"limit": 4}, {"limit": 1, "rounds": 0}])
def test_chroma_links_past_the_centres(spark, options):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(0, 2**32, 40, np.uint32)) for i in range(12)]
    for _, c in rows:
        c[10:14] = 7, 8, 9, 11  # a common passage
    rows.append((12, noisy(rng, rows[-1][1], range(10, 14))))
    assert {(r["a"], r["b"]) for r in chroma.links(fingerprint_rows(spark, rows), **options).collect()} == {(11, 12)}


def test_chroma_links_all_of_a_large_bucket(spark):
    rng = np.random.default_rng(4)
    whole = rng.integers(0, 2**32, 60, np.uint32)
    rows = [(k, noisy(rng, whole, [30])) for k in range(20)]
    assert {(r["a"], r["b"]) for r in chroma.links(fingerprint_rows(spark, rows), limit=4).collect()} == {(a, b) for b in range(20) for a in range(b)}


def test_chroma_links_clips_of_long_recordings(spark):
    rng = np.random.default_rng(2)
    long = rng.integers(0, 2**32, 6000, np.uint32)
    rows = [(0, long)] + [(k, noisy(rng, long[600 * k : 600 * k + 60], [30])) for k in range(1, 10)]
    assert {(r["a"], r["b"], r["offset"]) for r in chroma.links(fingerprint_rows(spark, rows)).collect()} == {(0, k, 600 * k) for k in range(1, 10)}


@pytest.mark.parametrize("hits", [1 << 21, 50])
def test_chroma_part_links_as_pair_by_pair(hits, monkeypatch):
    monkeypatch.setattr(chroma, "HITS", hits)
    rng = np.random.default_rng(5)
    rows = [(k, noisy(rng, np.resize(rng.integers(0, 9, 30, np.uint32), n), range(0, n, 7))) for k, n in enumerate(rng.integers(8, 90, 60).tolist())]
    rows += [(60 + k, noisy(rng, rows[k][1][k % 5 :], range(3))) for k in range(30)]
    part = chroma.Part(np.array([i for i, _ in rows]), [c.astype("<u4").tobytes() for _, c in rows])
    got = [x for u, v, *rest in chroma.Index(part).links(part, True, 0.2, 0.5, 8) for x in zip(*(c.tolist() for c in (part.rep[u], part.rep[v], *rest)), strict=True)]
    want = [(a, b, offset, errors) for a, x in rows for b, y in rows if a < b and set(x) & set(y) for ok, offset, errors in [chroma.same(x, y, 0.2, 0.5, 8)] if ok]
    assert len(want) >= 20 and sorted(got) == sorted(want)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_chroma_large_groups_without_a_row_per_link(spark, parts):
    rng = np.random.default_rng(7)
    whole = rng.integers(0, 2**32, 40, np.uint32)
    rows = [(k, noisy(rng, whole, [20])) for k in range(0, 300, 2)] + [(k, rng.integers(0, 2**32, 40, np.uint32)) for k in range(1, 30, 2)]
    rows.append((301, np.concatenate([rows[-1][1][:39], rng.integers(0, 2**32, 1, np.uint32)])))
    classes = fingerprint_rows(spark, rows)
    own, got = chroma.links(classes, parts=parts).collect(), chroma.linked(classes, parts=parts).collect()
    want = Counter(i for r in own for i in (r["a"], r["b"]))
    assert len(own) > 2000 and len(got) <= (parts + 1) * len(rows)
    assert want == sum((Counter({r["rep"]: r["n_links"]}) for r in got), Counter())

    def groups(edges):
        of = {i: {i} for i, _ in rows}
        for a, b in edges:
            if of[a] is not of[b]:
                of[a] |= of[b]
                of |= dict.fromkeys(of[b], of[a])
        return {frozenset(g) for g in of.values()}

    assert groups((r["a"], r["b"]) for r in own) == groups((r["rep"], r["root"]) for r in got)


def test_chroma_shuffles_codes_not_pairs(spark):
    rng = np.random.default_rng(6)
    rows = [(k, np.concatenate([rng.integers(0, 2**32, 20, np.uint32), np.arange(k % 3, k % 3 + 12, dtype=np.uint32)])) for k in range(300)]
    plan = chroma.links(fingerprint_rows(spark, rows))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "collect_list" not in plan


@pytest.mark.parametrize("table, least", [("sf0.01", 6), ("sf0.1", 100)])
def test_chroma_recall_of_different_fingerprints(spark, table, least):
    docs = spark.read.parquet(f"/root/testdata/{table}/documents.parquet")
    rows = chroma.fingerprints(docs, "doc_id", "text", 2000, 256, 64, "u1").where("octet_length(codes) >= 32").orderBy(F.desc("id")).collect()
    own = {r["fingerprint_sha256"]: (r["id"], np.frombuffer(r["codes"], "<u4")) for r in rows}
    at = {}
    for i, c in sorted(own.values(), key=lambda x: x[0]):
        for x in set(c.tolist()):
            at.setdefault(x, []).append((i, c))
    pairs = {(a, b): (x, y) for bucket in at.values() for k, (a, x) in enumerate(bucket) for b, y in bucket[k + 1 :]}  # what aligns has an equal integer
    near = [p for p, (x, y) in pairs.items() if chroma.same(x, y, 0.2, 0.5, 8)[0]]
    group = {r["doc_id"]: r["group_id"] for r in queries.op2_chroma_fingerprints(spark, f"/root/testdata/{table}").collect()}
    assert len(near) >= least and np.mean([group[x] == group[y] for x, y in near]) >= 0.9


def test_chroma_of_short_recordings(spark):
    short = ["a", "b", "ab", "a short one", "another short one", "é" * 300, "x" * 958, "x" * 959, "x" * 960]
    rows = list(enumerate([*short, "", None, *short]))
    for r in chroma.grouped(frame(spark, rows), "doc_id", "text", rate=2000, frame=256, hop=64, sample="u1").collect():
        i, n = r["doc_id"], len(short)
        want = i % (n + 2) if i not in (n, n + 1) else None
        assert (r["n_codes"], r["class_id"], r["group_id"]) == ((1, want, want) if want is not None else (0, None, None))


# -- 3 ------------------------------------------------------------------------------

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PARTS = ["token", "secret", "PassWord", "api_key", "APIKEY", "=", ":", " ", "'", '"', "abcd1234", "AKIA", "ABCDEF012345", "0123456789abcdef", "0123456789abcdef" * 2, "é", "İ", "K", "ſ", "x", "f" * 31, "f" * 33]


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=16).map("".join))
def test_base_spans(t):
    assert [s for s in secrets.find_secrets(t) if s[1] < 3] == plain_spans(t)


def base62(value):
    out = ""
    while value:
        value, d = divmod(value, 62)
        out = secrets.BASE62[d] + out
    return out.rjust(6, "0")


def test_checksums_and_redaction(spark):
    body = "0aB" * 10
    good = "ghp_" + body + base62(zlib.crc32(body.encode()))
    key = "AGE-SECRET-KEY-1GFPYYSJZGFPYYSJZGFPYYSJZGFPYYSJZGFPYYSJZGFPYYSJZGFPQ4EGAEX"
    assert secrets.find_secrets(f"é {good}.") == [(2, 3, 2 + len(good))] and not secrets.find_secrets("ghp_" + body + "000000")
    assert [NAME for NAME in (secrets.NAMES[k] for _, k, _ in secrets.find_secrets(key))] == ["age"] and not secrets.find_secrets(key[:-1] + "Y")
    t = 'a token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" b'
    r = secrets.scan(frame(spark, [(1, t)])).first()
    assert r["spans"] == ",".join(f"{n}:{s}:{e}" for n, s, e in [("assign", 2, 51), ("hex", 11, 51)])
    assert r["base_sha256"] == hashlib.sha256(r["spans"].encode()).hexdigest() and secrets.redacted_text(t) == 'a [SECRET]" b'
    assert [x["text"] for x in secrets.redacted(frame(spark, [(1, t), (2, None)])).orderBy("doc_id").collect()] == ['a [SECRET]" b', None]


# -- 4 ------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "  ", " ", "\n", "é", "word ", "▁", "漢字", "😀", "x" * 90, "\t", "<s>"]), max_size=200).map("".join))
def test_spliced_counts(t):
    p = PieceCounter(path("piece_bpe_32k.model"), 40, 4)
    assert p.stable and p.counts([t]) == [len(p.sp.encode(t))]


# -- 5 ------------------------------------------------------------------------------


def fewest_edits(item, text):
    prev = [0] * (len(text) + 1)
    for c in item:
        cur = [prev[0] + 1]
        for j, d in enumerate(text):
            cur.append(min(prev[j] + (c != d), prev[j + 1] + 1, cur[j] + 1))
        prev = cur
    return min(prev)


def test_leaks_by_all_alignments(spark):
    r = random.Random(5)
    items = [(i, prose(r, 20)) for i in range(12)]
    docs = []
    for d in range(60):
        y = list(r.choice(items)[1])
        for _ in range(r.randint(0, int(len(y) * 0.16))):
            p, what = r.randrange(len(y)), r.random()
            y[p : p + (what < 0.7)] = [] if what < 0.35 else [r.choice("abc ")]
        docs.append((d, prose(r, 15) + ". " + "".join(y).upper() + "!! " + prose(r, 15)))
    (built,) = decontamination.Items.build(items, 0.1)
    form = lambda t: bytes(decontamination.normalised(np.frombuffer(t.encode(), np.uint8))[0])
    want = {(d, i): e for d, t in docs for k, (i, _) in enumerate(items) if (e := fewest_edits(bytes(built.texts[k]), form(t))) <= built.edits[k]}
    got = decontamination.leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x["doc_id"], x["item_id"]): x["edits"] for x in got.collect()} == want and len(want) > 20
    blocks = decontamination.leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_bytes=500)
    assert {(x["doc_id"], x["item_id"]) for x in blocks.collect()} == set(want)
    assert {x["doc_id"] for x in decontamination.clean_documents(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_leaks_in_cut_and_repetitive_texts():
    (items,) = decontamination.Items.build([(1, "ab" * 60), (2, "the quick brown fox jumps over the lazy dog again")], 0.1)
    text = "ba" * 4000 + " x " * 300 + "The quick brown fox -- jumps over the lazy dog again" + " y" * 3000
    assert {i for _, i, *_ in decontamination.held(items, pa.array([text]), part_bytes=700)} == {0, 1} == {i for _, i, *_ in decontamination.held(items, pa.array([text]))}


@pytest.mark.parametrize("most", [1 << 23, 64])
def test_leaks_of_items_of_1_to_40_bytes(spark, monkeypatch, most):
    monkeypatch.setattr(decontamination, "MOST", most)
    r = random.Random(15)
    items = [(n, "".join(r.choice("abcdef") for _ in range(n))) for n in range(1, 41)]
    docs = []
    for d in range(120):
        y = list(r.choice(items)[1])
        for _ in range(r.randint(0, 1 + len(y) // 8)):
            if y:
                p = r.randrange(len(y))
                y[p : p + 1] = [r.choice("abcdef")] if r.random() < 0.5 else []
        docs.append((d, "".join(r.choice("ghijk") for _ in range(9)) + "".join(y) + "".join(r.choice("ghijk") for _ in range(9))))
    column = pa.array([t for _, t in docs])
    got = {(t, built.ids[i]): e for built in decontamination.Items.build(items, 0.1) for t, i, e, *_ in decontamination.held(built, column)}
    want = {(d, i): e for d, t in docs for i, x in items if (e := fewest_edits(x.encode(), t.encode())) <= len(x) // 10}
    assert got == want and len({i for _, i in want}) > 30 and sum(want.values()) > 20


# -- 6 ------------------------------------------------------------------------------


def plain_fingerprint(t):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_components_of_all_pairs(spark):
    r = random.Random(6)
    rows, base = [], [prose(r, 300) for _ in range(8)]
    for i in range(160):
        w = r.choice(base).split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = "Neu"
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, " "), (202, "ÀB c"), (203, "Àb C")]
    fp = {i: plain_fingerprint(t) for i, t in rows}
    root = {i: i for i in fp}
    for _ in fp:
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    for bucket in (64, 1):
        got = {x["doc_id"]: x for x in simhash.near_duplicates(frame(spark, rows), max_bucket=bucket).collect()}
        assert {i: int(x["fingerprint"], 16) for i, x in got.items()} == fp and {i: x["component_id"] for i, x in got.items()} == root
    kept = simhash.deduplicated(frame(spark, rows)).collect()
    assert sorted(x["doc_id"] for x in kept) == sorted(set(root.values()))


def test_golay_keys_never_miss():
    rng = np.random.default_rng(1)
    u = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    flip = lambda: np.uint64(1) << rng.integers(0, 64, 4000, dtype=np.uint64)
    for v in (u, u ^ flip(), u ^ flip() ^ flip()):
        keys = [{(a, b) for a, b in zip(*map(np.ndarray.tolist, simhash.segment_keys(x)), strict=True)} for x in (u, v)]
        assert {row for row, _ in keys[0] & keys[1]} == set(range(4000))


def test_connected_components(spark):
    e = [(i, i + 1) for i in range(60) if i % 20] + [(5, 5), (7, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got[20] == 1 and got[60] == 41 and 0 not in got


# -- 7 ------------------------------------------------------------------------------


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"ab", b"abc", b"b\x00", b"zz"]), min_size=1, max_size=60).map(b"".join), st.sampled_from([3, 20, 100]), st.sampled_from([5, 64, 1 << 19]), st.sampled_from([0, 1 << 20]))
def test_suffixes_by_induction(b, depth, block, memory):
    b += b"\xff"
    with induced_sort.Scratch(memory) as s:
        s.block = block
        got = list(induced_sort.SuffixSorter(np.frombuffer(b, np.uint8), s, depth).descending())
        folder = s.folder
    place, common = (np.concatenate(x) for x in zip(*got, strict=True))
    keys = [b[p : p + depth] for p in place]
    assert sorted(place.tolist()) == list(range(len(b))) and keys == sorted(keys, reverse=True) and not folder.exists()
    for x, y, c in zip(keys, keys[1:], common[1:], strict=False):
        assert c == next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))


def test_suffixes_of_long_texts_by_recursion():
    """Several levels of names, on disk and in memory, with runs, repeats and long substrings."""
    r = random.Random(12)
    piece = ["".join(r.choice("abcde ") for _ in range(r.randint(1, 90))) for _ in range(30)]
    texts = ["".join(r.choice(piece) for _ in range(300)), "ab" * 4000, "a" * 3000 + "b" + "a" * 3000, "".join(r.choice("abcdefghij") for _ in range(9000))]
    for t in texts:
        b = t.encode() + b"\xff"
        for memory in (0, 1 << 26):
            with induced_sort.Scratch(memory) as s:
                place = np.concatenate([p for p, _ in induced_sort.SuffixSorter(np.frombuffer(b, np.uint8), s, 100).descending()])
            keys = [b[p : p + 100] for p in place]
            assert sorted(place.tolist()) == list(range(len(b))) and keys == sorted(keys, reverse=True)


def test_memory_of_the_sort_does_not_grow():
    code = """
import random, sys
import numpy as np
from quillspark.llm.induced_sort import Scratch, SuffixSorter
r = random.Random(1)
words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(3000)]
with Scratch(1 << 20) as s:
    t, at, peak = s.array(int(sys.argv[1]), np.uint8), 0, lambda: int(next(x for x in open("/proc/self/status") if x.startswith("VmHWM")).split()[1])
    while at < len(t) - 1:
        b = np.frombuffer((r.choice(words) + " ").encode(), np.uint8)[: len(t) - 1 - at]
        t[at : at + len(b)] = b
        at += len(b)
    t[-1] = 255
    before = peak()
    n = sum(len(p) for p, _ in SuffixSorter(t, s, 100).descending())
    assert n == len(t)
    print(peak() - before)
"""
    grown = [int(subprocess.run([sys.executable, "-c", code, str(n)], capture_output=True, check=True, text=True).stdout) for n in (1 << 19, 1 << 21)]
    assert grown[1] < 65536 and grown[1] - grown[0] < 24576


def plain_repeats(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        goes = [False] * len(b)
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                goes[s : s + length] = [True] * length
            seen.add(b[s : s + length])
        spans = sum(g and not (i and goes[i - 1]) for i, g in enumerate(goes))
        out[d] = len(b), sum(goes), spans, hashlib.sha256(bytes(c for c, g in zip(b, goes, strict=True) if not g)).hexdigest()
    return out


@pytest.mark.parametrize("options", [{}, {"most_contexts": 2}, {"memory": 0}])
def test_repeats(spark, options):
    r = random.Random(2)
    pool = ["".join(r.choice("abcdefgh é") for _ in range(r.randint(20, 400))) for _ in range(12)]
    rows = [(i, "".join(r.choice(pool)[r.randint(0, 30) :] for _ in range(r.randint(0, 5)))) for i in range(120)]
    rows += [(200, "ab" * 300), (201, "ab" * 90 + "c"), (202, None), (203, ""), (204, "x" * 99), (205, "x" * 101)]
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in substring_dedup.remove_repeats(frame(spark, rows), **options).collect()}
    assert got == plain_repeats(rows)


def test_anchors_in_segments(monkeypatch):
    r = random.Random(4)
    raw = np.frombuffer("".join(r.choice("abc ") for _ in range(3000)).encode(), np.uint8)
    whole = [np.concatenate(x) for x in zip(*substring_dedup.anchors(raw, 100), strict=True)]
    monkeypatch.setattr(substring_dedup, "SEGMENT", 211)
    parts = [np.concatenate(x) for x in zip(*substring_dedup.anchors(raw, 100), strict=True)]
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_anchors_of_all_lengths_around_segments(monkeypatch):
    r = random.Random(5)
    raw = np.frombuffer("".join(r.choice("abc ") for _ in range(1200)).encode(), np.uint8)
    lengths = [n for k in (0, 1, 2, 5) for n in range(211 * k, 211 * k + 140)]
    found = lambda n: [np.concatenate(x).tolist() for x in zip(*substring_dedup.anchors(raw[:n], 100), strict=True)]
    whole = [found(n) for n in lengths]
    monkeypatch.setattr(substring_dedup, "SEGMENT", 211)
    assert [found(n) for n in lengths] == whole


# -- 8 and 9 ------------------------------------------------------------------------


def auc(score, y):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize(("make", "label", "parts", "out"), [(queries.op8_toxicity_neighbours, "toxic", 5, 0), (queries.op9_quality_attention, "quality", 4, 2)])
def test_held_out_accuracy(spark, make, label, parts, out):
    sf = "/root/testdata/sf0.1"
    y = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in make(spark, sf).collect() if r["doc_id"] in y]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == out) for r in got)
    held = [r for r in got if r["held_out"]]
    truth = np.array([y[r["doc_id"]] for r in held])
    least = {"toxic": (0.9, 0.93), "quality": (0.96, 0.97)}[label]  # some 360 toxic examples in four languages
    assert auc(np.array([r["score"] for r in held]), truth) > least[0]
    assert np.mean([r["predicted"] for r in held] == truth) > least[1]


def plain_neighbours(examples, asked, passage_words, k):
    """For each passage of each text asked about, the k nearest examples (cosine, id) by plain TF-IDF."""
    words = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().translate(simhash.LOWER))
    counts = {i: Counter(words(t)) for i, t in examples.items()}
    counts = {i: c for i, c in counts.items() if c}
    df = Counter(w for c in counts.values() for w in c)

    def unit(c):
        v = {w: (1 + math.log(n)) * math.log(1 + len(counts) / df[w]) ** 2 for w, n in c.items() if w in df}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    vectors = {i: unit(c) for i, c in counts.items()}
    out = {}
    for i, t in asked.items():
        w = words(t)
        out[i] = []
        for at in range(0, max(1, len(w)), passage_words):
            q = unit(Counter(w[at : at + passage_words]))
            near = sorted(((-sum(x * v[y] for y, x in q.items() if y in v), j) for j, v in vectors.items()))[:k]
            out[i].append([(-c, j) for c, j in near if c < 0])
    return out


def test_evidence_of_the_registered_query_is_exact(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labelled = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["toxic"] in (0, 1) and zlib.crc32(str(r["doc_id"]).encode()) % 5}
    want = plain_neighbours({i: texts[i] for i in labelled if i in texts}, texts, 128, 3)
    rows = queries.op8_toxicity_neighbours(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = [(float(c), int(i)) for i, c in (x.split(":") for x in r["evidence"].split(",") if x)]
        assert any(len(got) == len(near) and all(abs(a - c) < 1e-4 for (a, _), (c, _) in zip(got, near, strict=True)) for near in want[r["doc_id"]])


@pytest.mark.parametrize(("block", "k"), [(4, 7), (64, 7), (8, 200)])
def test_nearest_are_exact(block, k):
    r = random.Random(8)
    examples = {i: prose(r, r.randint(1, 60)) for i in range(150)}
    examples[77] = ""
    asked = {i: prose(r, r.choice([3, 40, 90])) for i in range(40)} | {40: "", 41: "nothing known", 42: examples[5]}
    build = lambda d, n: toxicity.passage_terms(pa.array(list(d.values()), pa.large_string()), n)
    ids, y = np.arange(150) * 3, np.arange(150) % 2.0
    ix = toxicity.BlockMaxIndex.build(ids, y, *build(examples, toxicity.WHOLE)[1:], block, k)
    first, *terms = build(asked, 20)
    got = {}
    for p, e, c in ix.search(*terms, int(first[-1])):
        for i in np.unique(p):
            got[int(i)] = [(x, int(j) // 3) for x, j in zip(c[p == i].tolist(), ix.doc[e[p == i]].tolist(), strict=True)]
    want = plain_neighbours(examples, asked, 20, k)
    for i in asked:
        for n, near in enumerate(want[i]):
            found = got.get(int(first[i]) + n, [])
            assert len(found) == len(near) and np.allclose([c for c, _ in found], [c for c, _ in near], atol=1e-9)
            assert [j for _, j in found if _ > near[-1][0] + 1e-9] == [j for _, j in near if _ > near[-1][0] + 1e-9] or sorted(j for _, j in found) == sorted(j for _, j in near)
    skipped = [e for p, e, c in ix.search(*terms, int(first[-1]), np.full(int(first[-1]), 15)) for e in ix.doc[e].tolist()]
    assert 15 not in skipped and len(skipped)


def test_attention_gradient_and_forward():
    rng = np.random.default_rng(4)
    bags = [rng.normal(0, 1, (n, 5)) for n in (1, 4, 2)]
    x, first, y = np.concatenate(bags), np.array([0, 1, 5, 7]), np.array([1.0, 0.0, 1.0])
    shape = {"W": (5, 3), "b": (3,), "V": (3, 2), "U": (3, 2), "w": (2,), "c": (3,), "d": (1,)}
    m = quality.AttentionModel(0.5, np.zeros(5), np.ones(5), {k: rng.normal(0, 0.7, s) for k, s in shape.items()})

    def plain(p):
        out = []
        for bag in bags:
            h = [np.tanh(r @ p["W"] + p["b"]) for r in bag]
            e = np.array([(np.tanh(v @ p["V"]) / (1 + np.exp(-(v @ p["U"])))) @ p["w"] for v in h])
            a = np.exp(e) / np.exp(e).sum()
            out.append(1 / (1 + np.exp(-(sum(w * v for w, v in zip(a, h, strict=True)) @ p["c"] + p["d"][0]))))
        return np.array(out)

    loss = lambda p: -np.mean(y * np.log(plain(p)) + (1 - y) * np.log(1 - plain(p)))
    assert np.allclose(m.scores(x, np.array([0, 1, 1, 1, 1, 2, 2]), 3), plain(m.p))
    grad = m.gradient(x, first, y)
    for name, s in shape.items():
        for at in np.ndindex(s):
            up, down = ({k: v.copy() for k, v in m.p.items()} for _ in range(2))
            up[name][at] += 1e-6
            down[name][at] -= 1e-6
            assert abs((loss(up) - loss(down)) / 2e-6 - np.asarray(grad[name])[at]) < 1e-6


def test_training_reads_all_passages(spark):
    long = " ".join(["good"] * 64 * 300)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1)], "doc_id long, quality int")
    seen = []
    fit = quality.AttentionModel.fit
    try:
        quality.AttentionModel.fit = staticmethod(lambda bags, y: seen.append(([len(b) for b in bags], y.tolist())) or fit(bags, y))
        quality.train_model(frame(spark, [(1, long), (2, "a b"), (2, "a b"), (2, "c d e")]), labels, F.lit(True))
    finally:
        quality.AttentionModel.fit = staticmethod(fit)
    assert seen == [([300, 1], [1.0, 1.0])]


def test_attention_finds_the_bad_passage():
    rng = np.random.default_rng(9)
    bags, y = [], []
    for i in range(300):
        x = rng.normal(0, 1, (rng.integers(1, 9), 4)).astype(np.float32)
        if i % 2:
            x[rng.integers(len(x)), 0] = 6
        bags.append(x)
        y.append(1 - i % 2)
    m = quality.AttentionModel.fit(bags, np.array(y, np.float32), epochs=80)
    x, owner = np.concatenate(bags), np.repeat(np.arange(300), [len(b) for b in bags])
    assert ((m.scores(x, owner, 300) >= 0.5) == np.array(y)).mean() > 0.97


def test_words_of_batches():
    column = pa.array(["ab Cd", "", "x", "  ab"])
    w = Words(*batch_bytes(column), quality.CLASS != 3)
    h = w.hashes().tolist()
    assert w.text.tolist() == [0, 0, 2, 3] and h[0] == h[3] and len(set(h)) == 3


# -- 10 -----------------------------------------------------------------------------


def test_pieces_round_trip(spark):
    r = random.Random(10)
    rows = [(i, prose(r, r.choice([0, 5, 300, 900, 4000])) + r.choice(["", "<|endoftext|>", "\n\n  é漢"])) for i in range(90)] + [(91, None)]
    got = packing.pack(frame(spark, rows), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), fanin=2, windows=3).toPandas()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    for d, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = got[got["doc_id"] == d].sort_values("start")
        assert own["start"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() == len(ids) and set(own["doc_tokens"]) == {len(ids)}
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own["start"], own["length"], strict=True)] == own["ids_crc32"].tolist()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        n = int(s["length"].sum())
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and n <= 2048 and n & (n - 1) == 0
