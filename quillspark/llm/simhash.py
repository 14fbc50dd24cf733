"""SimHash near-duplicates by Golay-code fuzzy hashing (operator 6).

Fingerprint: 3-word shingles of the text with A-Z lowered and ASCII white space as the
separator, repeats included; XXH64 with seed 42; a bit is 1 if it is set in over half of the
hashes. Fewer words give one shingle of all words; no word gives the fingerprint zero.

Search: the 64 bits are split into segments a, b, c of 22, 21 and 21 bits. With at most two
differing bits, one of the ordered pairs (a, b), (b, c), (c, a) has an equal first and a
second segment with at most one error. So each fingerprint gets, for each pair, the keys
(first segment, codeword index) for the codewords near the second in the perfect
(23, 12, 7) Golay code: the one it decodes to, and, where that is three bits away, also the
five at four bits. Words one bit apart always share such a codeword. Keys are joined and
pairs verified by their Hamming distance.

A key with more than max_bucket fingerprints is not expanded into pairs. Its fingerprints
are linked through the 65 words within one bit of each: two fingerprints are within two
bits just if they share such a word, so linking each to the smallest one at the same word
loses no link and makes a number of rows in proportion to the fingerprints. Sizes and
smallest fingerprints of keys are summed on both sides of the shuffle and joined back, so
that a hot key can be split.

Equal fingerprints are one class from the start, so copies are never paired.

Nulls count as empty texts. Very long texts are hashed whole. Repeated rows give repeated rows,
and rows of one id are linked each by its own text. A row without an id gets the component of
its fingerprint's class (null if no row with an id is in it). Components have no ties: the
smallest id names them. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import mapped, staged, texts
from quillspark.llm.components import connected_components

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
SHINGLE = 3
PAIRS = (("a", "b"), ("b", "c"), ("c", "a"))


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return digest(joined, 42)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    at = zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
    n = len(words) - SHINGLE + 1
    hashes = np.fromiter((digest(joined[i:j], 42) for i, j in at), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 8192):
        part = np.unpackbits(hashes[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _remainder(words: np.ndarray) -> np.ndarray:
    """The syndrome of 23-bit words: the remainder by the generator."""
    r = words.astype(np.int64)
    for bit in range(22, 10, -1):
        r = np.where(r >> bit & 1, r ^ (GENERATOR << (bit - 11)), r)
    return r


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error pattern of the nearest codeword, and the patterns of the five at distance four (0: none)."""
    nearest, more = np.zeros(2048, np.int64), np.zeros((2048, 5), np.int64)
    far: set[int] = set()
    for weight in range(4):
        e = np.array([sum(1 << i for i in x) for x in combinations(range(23), weight)], np.int64)
        s = _remainder(e)
        nearest[s] = e
        if weight == 3:
            far = set(s.tolist())
    by: dict[int, list[int]] = defaultdict(list)
    e = np.array([sum(1 << i for i in x) for x in combinations(range(23), 4)], np.int64)
    for s, x in zip(_remainder(e).tolist(), e.tolist(), strict=True):
        by[s].append(x)
    for s in far:
        more[s] = by[s]
    return nearest, more


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """(n, 6): indices of codewords near each 23-bit word, -1 for none; words one bit apart share one."""
    nearest, more = golay_tables()
    s = _remainder(words)
    out = np.empty((len(words), 6), np.int64)
    out[:, 0] = (words ^ nearest[s]) >> 11
    out[:, 1:] = np.where(more[s] > 0, (words[:, None] ^ more[s]) >> 11, -1)
    return out


def segment_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for each key of each unsigned fingerprint."""
    u = fps.astype(np.uint64)
    part = {"a": (u & np.uint64((1 << 22) - 1)).astype(np.int64), "b": (u >> np.uint64(22) & np.uint64((1 << 21) - 1)).astype(np.int64), "c": (u >> np.uint64(43)).astype(np.int64)}
    rows, keys = [], []
    for kind, (exact, near) in enumerate(PAIRS):
        index = codeword_indices(part[near])
        key = (np.int64(kind) << 40) | (part[exact][:, None] << 12) | index
        row, col = np.nonzero(index >= 0)
        rows.append(row)
        keys.append(key[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) for every row of docs; th (a hash of the text) if hashed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter(map(fingerprint, b.column("text").to_pylist()), np.uint64, b.num_rows)
            cols = {n: b.column(n) for n in b.schema.names if n != "text"} | {"fp": pa.array(fps.view(np.int64))}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    own = texts(docs, id_col, text_col)
    if hashed:
        return mapped(own.select("doc_id", F.xxhash64("text").alias("th"), "text"), run, "doc_id long, th long, fp long")
    return mapped(own, run, "doc_id long, fp long")


def links(classes: DataFrame, max_bucket: int = 64) -> DataFrame:
    """classes (rep long, fp long, distinct) -> links (a, b) whose fingerprints differ in at most two bits, enough to connect all such."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rep, fp = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("rep", "fp"))
            row, key = segment_keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, rep[row], fp[row])], names=["key", "rep", "fp"])

    def flipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
        for b in batches:
            rep, fp = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("rep", "fp"))
            word = (fp.view(np.uint64)[:, None] ^ masks).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (word, np.repeat(rep, 65))], names=["word", "rep"])

    keys = staged(classes.select("rep", "fp").mapInArrow(keyed, "key long, rep long, fp long"), "keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sized = staged(keys.join(sizes, "key"), "buckets")
    few = sized.where(F.col("n") <= max_bucket)
    right = few.select("key", F.col("rep").alias("rep_b"), F.col("fp").alias("fp_b"))
    near = few.join(right, "key").where("rep < rep_b and bit_count(fp ^ fp_b) <= 2").select(F.col("rep").alias("a"), F.col("rep_b").alias("b"))
    hot = sized.where(F.col("n") > max_bucket).select("rep", "fp").distinct()
    words = hot.mapInArrow(flipped, "word long, rep long")
    low = words.groupBy("word").agg(F.min("rep").alias("m"))
    stars = words.join(low, "word").where("rep <> m").select(F.col("m").alias("a"), F.col("rep").alias("b"))
    return near.unionByName(stars).distinct()


def _components(classes: DataFrame, max_bucket: int) -> DataFrame:
    """fp, component_id of distinct fingerprints (rep, fp): the smallest rep reachable."""
    roots = connected_components(links(classes.where("rep is not null"), max_bucket))
    return classes.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("fp", F.coalesce("root", "rep").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bucket: int = 64) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for every row of docs."""
    fps = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    return fps.join(_components(classes, max_bucket), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bucket: int = 64, most_broadcast: int = 1 << 20) -> DataFrame:
    """docs with one document of each component: that of the smallest id, of several texts of this id that of the smallest hash.

    Rows that repeat both id and text are one document, of which the row of the smallest hash
    stays. Rows without an id stay. An id that stands for texts of several components stays in
    each. Up to most_broadcast keys of rows that go are broadcast, so texts aren't shuffled;
    more are joined by a shuffle.
    """
    fps = staged(fingerprints(docs, id_col, text_col, hashed=True), "fingerprints").where("doc_id IS NOT NULL")
    key = ["doc_id", "th"]
    classes = staged(fps.select("fp").distinct().withColumn("rep", F.col("fp")), "classes")  # an id may stand for several texts
    rows = staged(fps.join(_components(classes, max_bucket), "fp").groupBy("component_id", *key).agg(F.count("*").alias("n")), "rows")
    best = staged(rows.groupBy("component_id").agg(F.min(F.struct(*key)).alias("best")), "best")  # a table, so that adaptive execution can split the join of a hot component
    judged = rows.join(best, "component_id").withColumn("stays", F.struct(*key) == F.col("best"))
    goes = staged(judged.where("NOT stays OR n > 1").select(*key, "stays"), "goes")
    few = goes.count() <= most_broadcast
    hint = F.broadcast if few else (lambda df: df)
    own = [F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))]
    match = lambda k: (own[0] == k["__id"]) & (own[1] == k["__th"])
    named = lambda df: hint(df.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")))
    gone, again = named(goes), named(goes.where("stays"))
    kept = docs.join(gone, match(gone), "left_anti")
    repeated = docs.join(again, match(again), "left_semi")
    one = repeated.groupBy(own[0].alias("__id"), own[1].alias("__th")).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns))))).alias("__row"))
    return kept.unionByName(one.select("__row.*"))
