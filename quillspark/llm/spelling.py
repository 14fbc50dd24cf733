"""Spelling variants: pairs of words at one edit, by composing a vocabulary acceptor with a one-edit transducer and the acceptor again.

* Words are counted in the texts' own batches; only distinct words with their counts are shuffled.
* Two words at one edit share their first `head` letters, or else the edit lies in these and they
  share the last `head` letters (words have 2 * head letters at least). So the composition is
  cut by its first states: the words of one beginning are the language of one initial state,
  those of one ending the language of one initial state of the acceptor of reversed words. A
  pair is taken in the second only if its beginnings differ, hence once in all.
* In each initial state's partition the words make a minimised acceptor. The composition's
  states are (q, 0, q) before the edit, as the acceptor is deterministic, and (x, 1, y) after
  it; a pair (x, y) goes on only while both accept a common rest, which is found once for each
  pair of states. An inserted letter is put after equal ones, so no pair comes twice.
* An initial state of more than `most` words is opened in Spark: pairs whose edit is the next
  letter have equal rests without that letter, which is a join with at most one word and its
  alphabet on a key; all other pairs share the next letter, so the words go on to the states
  behind it. Nothing is cut off, whatever the vocabulary.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Batches, cut, mapped, texts
from quillspark.storage import staged

HEAD = 3
LEAST_LETTERS = 2 * HEAD
LEAST_COUNT = 5
RATIO = 5
MOST = 20_000

#: [a-zÀ-ÿ]+ in UTF-8, where no letter's bytes begin inside another character.
_RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")


def _typed(word: bytes, doc_id: int, every: int) -> bytes:
    """The word, without one letter if `every` divides the checksum of id and word."""
    h = zlib.crc32(b"%d:%b" % (doc_id, word))
    if h % every:
        return word
    letters = word.decode()
    k = h % len(letters)
    return (letters[:k] + letters[k + 1 :]).encode()


def _counts(batches: Batches, every: int | None) -> Batches:
    found: dict[bytes, int] = {}

    def rows() -> pa.RecordBatch:
        words = [w.decode() for w in found]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    for b in cut(batches):
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            own: dict[bytes, int] = {}
            for w in _RUN.findall(text.as_py().encode().lower()):
                own[w] = own.get(w, 0) + 1
            for w, n in own.items():
                if every and doc_id is not None:
                    w = _typed(w, doc_id, every)
                if len(w) - w.count(b"\xc3") >= LEAST_LETTERS:
                    found[w] = found.get(w, 0) + n
        if len(found) > 200_000:
            yield rows()
            found.clear()
    yield rows()


def vocabulary(docs: DataFrame, least_count: int = LEAST_COUNT, every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of at least six letters and least_count occurrences."""
    found = mapped(texts(docs, id_col, text_col), lambda batches: _counts(batches, every), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


_WIDE = "".join(map(chr, range(0xC0, 0x100)))
#: As many letters of one byte that no lower-cased word has, since the SQL engine's edit distance counts bytes.
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F) if chr(c) not in "'\"\\`" and not chr(c).islower())[: len(_WIDE)]


class Acceptor:
    """The minimal deterministic acceptor of sorted distinct words; a word is told by its rank.

    Of each state: is it final, its arcs letter -> (state, words before them), and the length
    of its shortest word. The rank of a word is the sum over its arcs.
    """

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.shortest: list[int] = []
        self._size: list[int] = []
        self._known: dict[tuple, int] = {}
        self._meet: dict[tuple[int, int], bool] = {}
        open_: list[tuple[bool, list[tuple[str, int]]]] = [(False, [])]
        last = ""
        for w in words:
            k, most = 0, min(len(w), len(last))
            while k < most and w[k] == last[k]:
                k += 1
            self._close(open_, last, k)
            open_ += [(False, []) for _ in w[k:]]
            open_[-1] = (True, open_[-1][1])
            last = w
        self._close(open_, last, 0)
        self.root = self._state(*open_[0])

    def _close(self, open_: list, last: str, depth: int) -> None:
        while len(open_) > depth + 1:
            state = self._state(*open_.pop())
            open_[-1][1].append((last[len(open_) - 1], state))

    def _state(self, final: bool, arcs: list[tuple[str, int]]) -> int:
        key = (final, *arcs)
        if key not in self._known:
            self._known[key] = len(self.final)
            before, own = int(final), {}
            for a, s in arcs:
                own[a] = (s, before)
                before += self._size[s]
            self.final.append(final)
            self.arcs.append(own)
            self._size.append(before)
            self.shortest.append(0 if final else 1 + min((self.shortest[s] for _, s in arcs), default=0))
        return self._known[key]

    def _both(self, x: int, y: int) -> Iterator[tuple[str, int, int]]:
        to = self.arcs[y]
        return ((a, s, to[a][0]) for a, (s, _) in self.arcs[x].items() if a in to)

    def meet(self, x: int, y: int) -> bool:
        """Do both states accept a common word? Found once for each pair of states."""
        known, todo = self._meet, [(x, y)]
        while todo:
            x, y = todo[-1]
            if (x, y) not in known:
                if x == y or self.final[x] and self.final[y]:
                    known[x, y] = True
                else:
                    behind = [(s, t) for _, s, t in self._both(x, y)]
                    if any(known.get(p) for p in behind):
                        known[x, y] = True
                    elif open_ := next((p for p in behind if p not in known), None):
                        todo.append(open_)
                        continue
                    else:
                        known[x, y] = False
            done = known[todo.pop()]
        return done

    def common(self, x: int, y: int, never_first: str = "") -> Iterator[tuple[int, int]]:
        """The ranks, from x and from y, of the words that both accept, but for those that begin with never_first."""
        todo = [(x, y, 0, 0, True)] if self.meet(x, y) else []
        while todo:
            x, y, i, j, first = todo.pop()
            if self.final[x] and self.final[y]:
                yield i, j
            for a, s, t in self._both(x, y):
                if (not first or a != never_first) and self.meet(s, t):
                    todo.append((s, t, i + self.arcs[x][a][1], j + self.arcs[y][a][1], False))

    def edits(self, most_rest: int | None = None) -> Iterator[tuple[int, int]]:
        """Each pair of accepted words at one edit, once, as ranks; with most_rest, not all those where more than most_rest letters follow the edit."""
        todo = [(self.root, 0)]
        while todo:
            q, r = todo.pop()
            arcs = list(self.arcs[q].items())
            near = most_rest is None or self.shortest[q] <= most_rest + 1
            for k, (a, (x, before)) in enumerate(arcs):
                todo.append((x, r + before))
                if near:
                    yield from ((r + i, r + before + j) for i, j in self.common(q, x, a))
                    for _, (y, other) in arcs[k + 1 :]:
                        yield from ((r + before + i, r + other + j) for i, j in self.common(x, y))


_NEAR = "word string, near long, best_n long, best string"


def _composed(group: pa.Table, head: int) -> pa.Table:
    """For each word of one initial state: how many near words it has there, and the most frequent (of several the least) of them."""
    back = group.column("back")[0].as_py()
    first = group.column("first")[0].as_py()
    rows = sorted(zip(group.column("rest").to_pylist(), group.column("n").to_pylist(), strict=True))
    counts = [n for _, n in rows]
    whole = [(first + r)[::-1] if back else first + r for r, _ in rows]
    out: dict[str, tuple[int, int, str]] = {}
    for u, v in Acceptor([r for r, _ in rows]).edits(head - 1 if back else None):
        p, q = whole[u], whole[v]
        if back and p[:head] == q[:head]:
            continue
        for w, o, n in ((p, q, counts[v]), (q, p, counts[u])):
            near, best_n, best = out.get(w, (0, 0, ""))
            out[w] = (near + 1, n, o) if n > best_n or n == best_n and o < best else (near + 1, best_n, best)
    words = list(out)
    cols = list(zip(*out.values(), strict=True)) if out else [(), (), ()]
    return pa.table({"word": pa.array(words, pa.string()), "near": pa.array(cols[0], pa.int64()), "best_n": pa.array(cols[1], pa.int64()), "best": pa.array(cols[2], pa.string())})


def _opened(words: DataFrame, head: int) -> DataFrame:
    """Near words whose edit is the first letter of rest, as (word, near, best_n, best), of words (word, n, back, first, rest)."""
    own = ["back", "first"]
    less = words.where("rest <> ''").select(*own, "word", "n", F.expr("substring(rest, 2)").alias("key"), F.substring("rest", 1, 1).alias("letter"))
    plain = words.select(*own, F.col("word").alias("o_word"), F.col("n").alias("o_n"), F.col("rest").alias("key"), F.lit(None).cast("string").alias("o_letter"))
    others = plain.unionByName(less.select(*own, F.col("word").alias("o_word"), F.col("n").alias("o_n"), "key", F.col("letter").alias("o_letter")))
    # A letter inserted before equal ones is the same insertion after them: a later state has it.
    inserted = F.col("o_letter").isNull() & (F.col("letter") != F.substring("key", 1, 1))
    pairs = less.join(others, [*own, "key"]).where(inserted | (F.col("letter") < F.col("o_letter")))
    pairs = pairs.where(~F.col("back") | (F.substring("word", 1, head) != F.substring("o_word", 1, head)))
    both = pairs.select("word", "o_n", "o_word").union(pairs.select("o_word", "n", "word"))
    return both.groupBy("word").agg(F.count("*").alias("near"), F.min(F.struct((-F.col("o_n")).alias("m"), F.col("o_word").alias("w"))).alias("b")).select("word", "near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def near_words(words: DataFrame, head: int = HEAD, most: int = MOST) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have a near one; words have at least 2 * head letters and are distinct."""
    way = lambda back, w: words.select("word", "n", F.lit(back).alias("back"), F.substring(w, 1, head).alias("first"), F.substring(w, head + 1, 1 << 30).alias("rest"))
    states = staged(way(False, F.col("word")).unionByName(way(True, F.reverse("word"))), "states")
    parts = []
    while True:
        large = states.groupBy("back", "first").agg(F.count("*").alias("c")).where(F.col("c") > most).select("back", "first")
        large = staged(large, "large")
        if large.isEmpty():
            break
        behind = staged(states.join(large, ["back", "first"], "left_semi"), "opened")
        parts.append(_opened(behind, head))
        small = states.join(large, ["back", "first"], "left_anti")
        parts.append(small.groupBy("back", "first").applyInArrow(lambda t: _composed(t, head), _NEAR))
        states = behind.where("rest <> ''").select("word", "n", "back", F.expr("first || substring(rest, 1, 1)").alias("first"), F.expr("substring(rest, 2)").alias("rest"))
        states = staged(states, "states")
    parts.append(states.groupBy("back", "first").applyInArrow(lambda t: _composed(t, head), _NEAR))
    found = reduce(DataFrame.unionByName, parts)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def roots(forms: DataFrame, longest: int) -> DataFrame:
    """(word, root) of forms (word, form): the end of each word's chain of forms of at most `longest` steps, by doubling."""
    up = forms.select("word", F.col("form").alias("root"))
    step = 1
    while step < longest:
        up = staged(up, "roots")
        further = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        up = up.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
        step *= 2
    return up


def variants(docs: DataFrame, least_count: int = LEAST_COUNT, ratio: int = RATIO, every: int | None = None, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each word of the vocabulary with its form: the most frequent word at one inserted, deleted or replaced letter, if it has at least ratio times its occurrences.

    Columns: word, n, n_near, form, form_n, root (the end of the chain of forms; the word
    itself if it has none). Of equally frequent near words the first in order of code points
    counts. every: where it divides the CRC-32 of `id:word`, the word is read without one of
    its letters, which plants misspellings in any corpus; texts without an id stay as they are.

    Null and empty texts have no words; texts of any length are read whole; repeated rows count
    as often as they come; an empty table gives an empty result; other columns are ignored;
    ids must be numbers or null.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2, so that chains of forms end")
    words = staged(vocabulary(docs, least_count, every, id_col, text_col), "vocabulary")
    near = near_words(words, most=most)
    is_form = F.col("best_n") >= ratio * F.col("n")
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    found = staged(found, "forms")
    # A form has ratio times the count, so a chain is as long as the logarithm of the largest count.
    top, longest = words.agg(F.max("n")).first()[0] or 0, 0
    while top >= ratio * least_count:
        top, longest = top // ratio, longest + 1
    return found.join(roots(found.where("form IS NOT NULL"), longest), "word", "left").withColumn("root", F.coalesce("root", "word"))


#: variants(documents, every=199). The checksum is linear in the bytes, so it is a sum of shares.
ORACLE_SQL = rf"""
WITH RECURSIVE
steps(b, k, t) AS (SELECT b, 0, b FROM range(256) AS r(b) UNION ALL SELECT b, k + 1, CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384) ELSE t >> 1 END FROM steps WHERE k < 8),
poly AS (SELECT b, t FROM steps WHERE k = 8),
runs AS (SELECT doc_id, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS x FROM documents) GROUP BY ALL),
messages AS (SELECT doc_id, w, n, coalesce(doc_id::VARCHAR, '') || ':' || w AS m FROM runs),
sizes AS (SELECT DISTINCT strlen(m) AS k FROM messages),
-- A byte's share of the checksum with d bytes after it: the checksum is linear in the bytes.
share(b, d, v) AS (
  SELECT b, 0, t FROM poly
  UNION ALL
  SELECT s.b, d + 1, xor(v >> 8, p.t) FROM share AS s JOIN poly AS p ON p.b = s.v & 255 WHERE d < (SELECT max(k) FROM sizes)
),
-- The share of the initial value, for messages of k bytes.
start(k, v) AS (SELECT 0, 4294967295::BIGINT UNION ALL SELECT k + 1, xor(v >> 8, p.t) FROM start AS s JOIN poly AS p ON p.b = s.v & 255 WHERE k < (SELECT max(k) FROM sizes)),
bytes AS (SELECT doc_id, w, n, hex(m) AS h, strlen(m) AS k FROM messages),
each AS (SELECT doc_id, w, n, k, i, ('0x' || h[2 * i + 1 : 2 * i + 2])::INT AS b FROM (SELECT *, unnest(range(k)) AS i FROM bytes)),
summed AS (SELECT doc_id, w, n, k, bit_xor(v) AS v FROM each JOIN share AS s ON s.b = each.b AND s.d = k - 1 - i GROUP BY ALL),
checked AS (SELECT doc_id, w, n, xor(xor(summed.v, start.v), 4294967295) AS h FROM summed JOIN start USING (k)),
typed AS (SELECT CASE WHEN doc_id IS NOT NULL AND h % 199 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM checked),
words AS (SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
narrow AS (SELECT word, n, length(word) AS len, translate(word, '{_WIDE}', '{_NARROW}') AS s FROM words),
cuts AS (SELECT word, n, len, s, s AS cut, 0 AS place FROM narrow UNION ALL SELECT word, n, len, s, left(s, i - 1) || substr(s, i + 1), i FROM narrow, unnest(range(1, len + 1)) AS r(i)),
near AS (SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM cuts AS a JOIN cuts AS b USING (cut) WHERE a.word <> b.word AND levenshtein(a.s, b.s) = 1),
best AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, hex(other))) AS other FROM near GROUP BY word),
forms AS (SELECT w.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM words AS w LEFT JOIN best USING (word)),
chain(word, top) AS (SELECT word, word FROM forms UNION ALL SELECT c.word, f.form FROM chain AS c JOIN forms AS f ON f.word = c.top WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.top AS root FROM forms AS f JOIN chain AS c USING (word) JOIN forms AS g ON g.word = c.top AND g.form IS NULL
"""
