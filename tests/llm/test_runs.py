"""Periodic runs, spelling variants and url verdicts against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st


from quillspark.llm import periodic_runs, queries, spelling, url_filters
from quillspark.llm.common import table

SF = "/root/testdata/sf0.001"


# -- 11 -----------------------------------------------------------------------------


def all_runs(w, least=12):
    """Runs by definition: every lag, every maximal stretch, the smallest period of each."""
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(least, 2 * p):
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def runs_of(texts, least=12, scan=32):
    """find_runs over several texts, in their order."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    w, starts = [], {}
    for k, i in enumerate(order):
        starts[i] = len(w)
        w += [*texts[i], -1 - k]
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    start, length, period = periodic_runs.find_runs(np.array(w, np.int64), sizes, least, scan)
    rows = list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
    return [[(s - starts[i], n, p) for s, n, p in rows if starts[i] <= s < starts[i] + len(texts[i])] for i in range(len(texts))]


def repetitive(r, n, letters):
    """Words that repeat on several scales, with runs inside runs and edits."""
    out = [r.randrange(letters) for _ in range(r.randint(1, 4))]
    while len(out) < n:
        kind = r.random()
        if kind < 0.4:
            a = r.randrange(len(out))
            out += out[a : a + r.randint(1, 60)] * r.randint(1, 4)
        elif kind < 0.6:
            out += out[-r.randint(1, len(out)) :]
        elif kind < 0.8:
            out[r.randrange(len(out))] = r.randrange(letters)
        else:
            out += [r.randrange(letters) for _ in range(r.randint(1, 9))]
    return out[:n]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=90), max_size=3), st.sampled_from([4, 8]), st.sampled_from([2, 5, 12]))
def test_runs_on_small_words(texts, scan, least):
    assert runs_of(texts, least, scan) == [all_runs(t, least) for t in texts]


@pytest.mark.parametrize("seed", range(12))
def test_runs_on_several_scales(seed):
    r = random.Random(seed)
    texts = [repetitive(r, r.choice([0, 1, 13, 200, 700, 1500]), r.choice([1, 2, 3, 50])) for _ in range(4)]
    for scan in (4, 32):
        assert runs_of(texts, 12, scan) == [all_runs(t) for t in texts]


def test_runs_whose_period_is_nearly_periodic():
    thue = [bin(i).count("1") % 2 for i in range(1024)]
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    texts = [([0, 1] * 25 + [0]) * 2, [2, *([0, 1] * 40 + [0]) * 2, 3], ([0] * 70 + [1]) * 3, [0] * 900, thue, fib[-1], thue[:512] * 2, list(range(300)) * 3]
    for scan in (4, 32):
        assert runs_of(texts, 12, scan) == [all_runs(t) for t in texts]


def test_long_runs_take_linear_steps():
    one = runs_of([[7] * 300_000, ([1, 2, 3] * 50 + [9]) * 2000])
    assert one[0] == [(0, 300_000, 1)] and (0, 302_000, 151) in one[1] and len(one[1]) == 2001


def periodic_by_hand(doc_id, text, plant=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if plant and doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = all_runs(w)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_registered_runs(spark):
    docs = table(spark, SF, "documents").collect()
    got = sorted(map(tuple, queries.op11_periodic_runs(spark, SF).collect()))
    want = sorted(periodic_by_hand(r["doc_id"], r["text"]) for r in docs if len(r["text"] or "") < 20_000)
    short = {r[0] for r in want}
    assert [r for r in got if r[0] in short] == want and len(got) == len(docs) and sum(r[1] > 0 for r in want) > 10


def test_runs_without_planting(spark, odd):
    want = sorted((str(periodic_by_hand(r["doc_id"], r["text"], False)) for r in odd.collect() if r["doc_id"] != 6))
    assert sorted(str(tuple(r)) for r in periodic_runs.detect(odd).collect() if r["doc_id"] != 6) == want
    assert periodic_runs.detect(odd.where("false")).count() == 0
    text = " ".join(["É x", "\x1f", "é"] * 9) + "\x0b\x0c\r\n\t" + "z"
    got = periodic_runs.detect(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert tuple(got) == periodic_by_hand(1, text, False) and got["period"] == 3


# -- 12 -----------------------------------------------------------------------------


def one_edit(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", max_size=6), max_size=40), st.sampled_from([None, 0, 2]))
def test_acceptor_pairs(words, most_rest):
    words = sorted(words)
    got = [(words[i], words[j]) for i, j in spelling.Acceptor(words).edits(most_rest)]
    pairs = {tuple(sorted(p)) for p in got}
    want = {(u, v) for u in words for v in words if u < v and one_edit(u, v)}
    assert len(got) == len(pairs) and pairs <= want
    if most_rest is None:
        assert pairs == want
    else:  # differing before the last letters, seen from the end
        assert pairs >= {(u, v) for u, v in want if u[::-1][: most_rest + 1] != v[::-1][: most_rest + 1]}


def test_acceptor_is_minimal():
    words = sorted(a + b + c for a in "abcd" for b in "xyz" for c in ("", "s"))
    assert len(spelling.Acceptor(words).final) == 4
    deep = ["a" * 3000, "a" * 3001, "b" + "a" * 3000]
    assert sorted(spelling.Acceptor(deep).edits()) == [(0, 1), (0, 2), (1, 2)]


def vocabulary_by_hand(rows, every=199, least=5):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if every and doc_id is not None and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= 6
    return {w: c for w, c in n.items() if c >= least}


def variants_by_hand(n):
    by_cut = defaultdict(set)
    for w in n:
        by_cut[w].add(w)
        for i in range(len(w)):
            by_cut[w[:i] + w[i + 1 :]].add(w)
    near = {w: {o for s in (w, *(w[:i] + w[i + 1 :] for i in range(len(w)))) for o in by_cut[s] if one_edit(w, o)} for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root(w)) for w in n)


COLUMNS = ("word", "n", "n_near", "form", "form_n", "root")


def test_registered_variants(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    got = sorted(tuple(r[c] for c in COLUMNS) for r in queries.op12_spelling_variants(spark, SF).collect())
    assert got == variants_by_hand(vocabulary_by_hand(map(tuple, docs))) and sum(r[3] is not None for r in got) > 10


@pytest.mark.parametrize("most", [20_000, 40, 3])
def test_variants_whatever_the_bound(spark, most):
    """Initial states that are opened again and again give the same pairs; chains of forms end at their roots."""
    r = random.Random(5)
    words = {"".join(r.choice("abé") for _ in range(r.randint(6, 8))) for _ in range(300)} | {"a" * k for k in range(6, 12)} | {"common" + x for x in "aabbccdd"} | {"xommon" + "q" * k for k in range(9)}
    words |= {w + "ing" for w in words} | {"pre" + w for w in words}
    n = {w: r.choice([5, 6, 30, 200, 1100, 6000]) for w in sorted(words)}
    got = sorted(map(tuple, spelling.near_words(spark.createDataFrame(list(n.items()), "word string, n long").repartition(3), most=most).collect()))
    want = []
    for w in n:
        near = [o for o in n if one_edit(w, o)]
        if near:
            best = min(near, key=lambda o: (-n[o], o))
            want.append((w, len(near), n[best], best))
    assert got == sorted(want)


def test_chains_of_forms(spark):
    names = ["abcdefg", "abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk", "abcdefghijkl"]
    rows = [(k, " ".join([w] * 5 ** (k + 1))) for k, w in enumerate(names)] + [(50, " ".join(["Ångström"] * 5)), (51, "ÅNGSTRÖM × ÷ straße straße" * 3), (52, None), (53, ""), (None, "abcdefg")]
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.values()) == variants_by_hand(vocabulary_by_hand(rows, None))
    assert got["abcdefgh"]["root"] == "abcdefghijkl" and got["abcdefg"]["n"] == 6


def test_variants_on_odd_tables(odd):
    got = sorted(tuple(r[c] for c in COLUMNS) for r in spelling.variants(odd, every=7).collect())
    assert got == variants_by_hand(vocabulary_by_hand([(r["doc_id"], r["text"]) for r in odd.collect()], 7))
    assert spelling.variants(odd.where("false")).count() == 0


# -- 13 -----------------------------------------------------------------------------


def url_by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    tail = rest[end:]
    stop = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
    return re.sub("[A-Z]", lambda m: m[0].lower(), rest[:end]), tail[:stop]


def rule_by_hand(host, path, rules=url_filters.RULES):
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, None)


URLS = [
    None, "", "no scheme here", "http://", "http:///only/path", "HTTPS://WWW.Example.ORG/es/1", "https://example.org/en/12?x=/es/", "https://a.example.org#/es/", "x://org/", "http://org", "http://borg/a",
    "http://example.orgs/es/", "http://a.com/fr/é/漢", "http://a.com:80/de/", "http://u@a.com/de/x", "a://b://c.com/de/", "http://a.com/de", "http://a.com/de/?q", "ftp://É.com/FR/", "http://a.com/" + "x/" * 900, "http://h.net/\n/es/1", "http://h.net//de//1",
]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filters.judged(pages, url_filters.rules_table(spark)).collect()}
    assert len(got) == len(URLS)
    for k, url in enumerate(URLS):
        host, path = url_by_hand(url)
        rule, verdict = rule_by_hand(host, path)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule), url
        assert got[k]["verdict"] == verdict if verdict else got[k]["verdict"] in ("allow", "block")


def test_templates_of_a_host(spark):
    """Articles under /bad/ are blocked wherever rules know them, so unknown ones are too; a hot host keeps few templates."""
    rules = [("block", "one.net", "/bad/"), ("allow", "one.net", "/good/"), ("block", "two.net", "/bad/"), ("allow", "two.net", "/good/"), ("block", "one.net", "/mixed/x/")]
    urls = [f"http://{h}.net/{kind}/{word}{k}/{k}.html" for h in ("one", "two", "three") for kind in ("bad", "good") for k in range(40) for word in ("ab", "cd")]
    urls += ["http://three.net/bad/unseen/1", "http://three.net/good/unseen/1", "http://one.net/other/7"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filters.judged(pages, url_filters.rules_table(spark, rules), fan=4).collect()}
    for k, url in enumerate(urls[:-1]):
        assert got[k]["verdict"] == ("block" if "/bad/" in url else "allow"), url
    assert {got[k]["template"] for k in range(160)} == {"one.net/=bad/{w}/{n}.*", "one.net/=good/{w}/{n}.*"}


def test_similar_branches_merge(spark):
    rows = [("host", "h", ["=a", "{n}"], 1, 99), ("host", "h", ["=b", "{n}"], 2, 98), ("host", "h", ["=c", "{n}"], 90, 5), ("host", "h", ["=d", "{n}"], 0, 0), ("host", "g", ["=a", "{n}"], 5, 5)]
    t = spark.createDataFrame(rows, "way string, tree string, tokens array<string>, a long, b long")
    got = {(r["tree"], r["tokens"][0]): (r["to"], r["sum_a"], r["sum_b"]) for r in url_filters.merged(t, 2).collect()}
    assert got["h", "=a"] == got["h", "=b"] == (["=a|=b", "{n}"], 3, 197)
    assert got["h", "=c"] == (["=c", "{n}"], 90, 5) and got["h", "=d"] == (["=d", "{n}"], 0, 0) and got["g", "=a"] == (["=a", "{n}"], 5, 5)


def test_urls_of_odd_tables(spark):
    pages = spark.createDataFrame([(1, "http://x.com/de/1", "a", 1), (1, "http://x.com/de/1", "a", 2), (None, None, None, None)], "page_id long, url string, host string, path long")
    got = url_filters.judged(pages, url_filters.rules_table(spark)).collect()
    assert [(r["page_id"], r["host"], r["rule"]) for r in got if r["page_id"]] == [(1, "x.com", "com/de/")] * 2 and len(got) == 3
    assert url_filters.judged(pages.where("false"), url_filters.rules_table(spark)).count() == 0
    nothing = url_filters.judged(pages, url_filters.rules_table(spark).where("false")).collect()
    assert {r["purity"] for r in nothing} == {0.5}


@pytest.mark.parametrize("name", ["op12_spelling_variants", "op13_url_filters"])
def test_registered_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    want = c.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want.select(*(f'"{x}"' for x in df.columns)).fetchall()))
