"""Benchmark decontamination by q-gram lemma filtering (operator 5).

Texts and items are normalised to lower-case letters, digits and non-ASCII bytes with single
spaces between runs of them. A document holds an item of m bytes if some part of it is
within e = floor(rate * m) edits of the item. By the q-gram lemma such a part shares at
least m + 1 - q * (e + 1) q-grams with it, and they lie on diagonals at most e apart. Shared
q-grams are counted in diagonal bands of 2w, w = e + 1, each overlapping the next by half,
so some band has all of them. Bands that reach the bound are verified by an alignment
within the band and e diagonals on either side.

q is the largest of QS for which an item's bound is one at least, so short items are found as
well: those of under ten bytes, at the default rate, where the text holds them unchanged. Items
are read in blocks of at most block_bytes, each a scan of the documents; a block is what the
driver and each task hold. Hits are counted MOST at a time.

Null texts and items count as empty, and an empty item is in no text; very long texts are cut
with overlaps; repeated items give repeated pairs, repeated documents too; an empty table on
either side gives an empty result; extra columns are ignored. The result has one row per
document and item it holds, with the fewest edits and where that part lies (UTF-8 bytes of the
text); of equal edits the earliest part, then the shortest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.bytewords import batch_bytes
from quillspark.llm.common import bounded, mapped, texts

NORMAL = np.full(256, 32, np.uint8)
NORMAL[48:58], NORMAL[97:123], NORMAL[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
NORMAL[65:91] = np.arange(97, 123)
BITS = 21  # of the table of q-gram hashes and of band cells
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
QS = (8, 4, 2, 1)
MOST = 1 << 23  # shared q-grams that are held at once
UNIT = 1 << 24  # an edit, in alignment cells that also hold where the part starts


def normalised(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The normal form of the bytes of one text, and the place each of its bytes has in the text."""
    b = NORMAL[raw]
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
    at = np.flatnonzero(keep)
    return b[at], at


def grams(b: np.ndarray, q: int) -> np.ndarray:
    """The q-gram at each place, as a number."""
    if len(b) < q:
        return np.empty(0, np.uint64)
    b = np.concatenate([b, np.zeros(8 - q, np.uint8)])
    return np.ndarray((len(b) - 7,), "<u8", b.data, strides=(1,)) & np.uint64((1 << 8 * q) - 1)


@dataclass
class Items:
    """A block of benchmark items with the table of their q-grams."""

    q: int
    ids: list[int | None]
    texts: list[np.ndarray]
    edits: np.ndarray
    bound: np.ndarray
    known: np.ndarray
    gram: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray

    @staticmethod
    def build(rows: list[tuple[int | None, str | None]], rate: float) -> list[Items]:
        """The items by the q-gram length that their bounds allow."""
        by: dict[int, list[tuple[int | None, np.ndarray, int]]] = {}
        for i, t in rows:
            b, _ = normalised(np.frombuffer((t or "").encode(), np.uint8))
            b = b[1:] if len(b) and b[0] == 32 else b
            b = b[:-1] if len(b) and b[-1] == 32 else b
            e = int(rate * len(b))
            if len(b):
                by.setdefault(next(q for q in QS if len(b) + 1 - q * (e + 1) >= 1), []).append((i, b, e))
        return [Items._of(q, *map(list, zip(*found, strict=True))) for q, found in sorted(by.items())]

    @staticmethod
    def _of(q: int, ids: list[int | None], forms: list[np.ndarray], edits: list[int]) -> Items:
        e, m = np.array(edits, np.int64), np.array([len(b) for b in forms], np.int64)
        g = np.concatenate([grams(b, q) for b in forms])
        item = np.repeat(np.arange(len(forms)), m - q + 1)
        place = np.concatenate([np.arange(len(b) - q + 1) for b in forms])
        order = np.argsort(g, kind="stable")
        g, item, place = g[order], item[order], place[order]
        unique, first = np.unique(g, return_index=True)
        known = np.zeros(1 << BITS, bool)
        known[(unique * MULTIPLIER) >> np.uint64(64 - BITS)] = True
        return Items(q, ids, forms, e, m + 1 - q * (e + 1), known, unique, np.append(first, len(g)), item, place)

    def _cells(self, at: np.ndarray, where: np.ndarray, shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item, half band) of the shared q-grams, at most MOST at a time or those of one place."""
        size = self.first[where + 1] - self.first[where]
        edges = np.unique(np.concatenate([np.searchsorted(np.cumsum(size), np.arange(0, size.sum(), MOST), "right"), [len(size)]]))
        for lo, hi in zip(np.append(0, edges[:-1]).tolist(), edges.tolist(), strict=True):
            s = size[lo:hi]
            post = np.repeat(self.first[where[lo:hi]] - (np.cumsum(s) - s), s) + np.arange(s.sum())
            item = self.item[post]
            yield item, (np.repeat(at[lo:hi], s) - self.place[post] + shift) // (self.edits[item] + 1)

    def bands(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, first diagonal) of the bands of b that reach the bound."""
        g, none = grams(b, self.q), (np.empty(0, np.int64), np.empty(0, np.int64))
        at = np.flatnonzero(self.known[(g * MULTIPLIER) >> np.uint64(64 - BITS)])
        where = np.minimum(np.searchsorted(self.gram, g[at]), len(self.gram) - 1)
        ok = self.gram[where] == g[at]
        at, where = at[ok], where[ok]
        if not len(at):
            return none
        shift = max(len(t) for t in self.texts)
        # a table of sums that may mix cells, so never too small, first thins out the matches
        mask, table, keys, counts = (1 << BITS) - 1, np.zeros(1 << BITS, np.int64), [], []
        for item, cell in self._cells(at, where, shift):
            table += np.bincount(item * 1000003 + cell & mask, minlength=1 << BITS)
        for item, cell in self._cells(at, where, shift):
            slot = item * 1000003 + cell
            ok = table[slot & mask] + np.maximum(table[slot + 1 & mask], table[slot - 1 & mask]) >= self.bound[item]
            key, n = np.unique(item[ok] << 40 | cell[ok], return_counts=True)
            keys.append(key)
            counts.append(n)
        key, of = np.unique(np.concatenate(keys), return_inverse=True)
        if not len(key):
            return none
        n = np.bincount(of, np.concatenate(counts)).astype(np.int64)
        below, c = np.union1d(key, key - 1), np.append(n, 0)
        find = lambda k: c[np.where(np.append(key, -9)[np.searchsorted(key, k)] == k, np.searchsorted(key, k), len(key))]
        total = find(below) + find(below + 1)
        item = below >> 40
        ok = (total >= self.bound[np.minimum(item, len(self.bound) - 1)]) & (item < len(self.bound)) & (item >= 0)
        item, band = item[ok], below[ok] & ((1 << 40) - 1)
        return item, band * (self.edits[item] + 1) - shift

    def align(self, b: np.ndarray, item: int, diagonals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(edits, start, end) of the best part of b in each band of one item."""
        t, e = self.texts[item], int(self.edits[item])
        width = 2 * (e + 1) + 2 * e
        s = diagonals - e
        k = np.arange(width)
        pad = np.concatenate([np.zeros(len(t) + 2 * width + 1, np.uint8), b, np.zeros(len(t) + 2 * width + 1, np.uint8)])
        base = s[:, None] + k + len(t) + 2 * width + 1
        cur = np.broadcast_to(k, (len(s), width)).astype(np.int64)
        ramp = k * UNIT
        for i, ch in enumerate(t):
            text = pad[np.clip(base + i, 0, len(pad) - 1)]
            new = cur + (text != ch) * UNIT
            new[:, :-1] = np.minimum(new[:, :-1], cur[:, 1:] + UNIT)
            cur = np.minimum.accumulate(new - ramp, axis=1) + ramp
        best = np.argmin(cur, axis=1)
        value = cur[np.arange(len(s)), best]
        return value // UNIT, s + value % UNIT, s + len(t) + best

    def found(self, b: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(item, edits, start, end) of items that b holds, the best part of each; zero bytes are text borders."""
        item, diagonal = self.bands(b)
        for i in np.unique(item):
            edits, start, end = self.align(b, int(i), diagonal[item == i])
            for j in np.flatnonzero(edits <= self.edits[i]):
                yield int(i), int(edits[j]), int(start[j]), int(end[j])


def held(items: Items, column: pa.Array, part_bytes: int = 1 << 20) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, edits, start, end) for a batch; texts are joined up to part_bytes, longer ones cut with overlaps."""
    raw, offsets = batch_bytes(column)
    overlap = 2 * max(len(t) for t in items.texts) + items.q
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    parts: list[tuple[int, np.ndarray, np.ndarray]] = []

    def flush() -> None:
        starts, own, places, joined, at = [], [], [], [], 0
        for text, b, place in parts:
            starts.append(at)
            own.append(text)
            places.append(place)
            joined += [b, np.zeros(1, np.uint8)]
            at += len(b) + 1
        if not parts:
            return
        for i, edits, start, end in items.found(np.concatenate(joined)):
            p = int(np.searchsorted(starts, max(0, (start + end) // 2), side="right")) - 1
            n = len(places[p])
            lo, hi = max(0, start - starts[p]), min(n, end - starts[p])
            if hi <= lo:
                continue
            got = (edits, int(places[p][lo]), int(places[p][hi - 1]) + 1)
            best[own[p], i] = min(best.get((own[p], i), got), got)
        parts.clear()

    size = 0
    for text in range(len(offsets) - 1):
        b, place = normalised(raw[offsets[text] : offsets[text + 1]])
        for cut in range(0, max(1, len(b) - overlap), part_bytes):
            piece = slice(cut, cut + part_bytes + overlap)
            parts.append((text, b[piece], place[piece]))
            size += len(b[piece])
            if size >= part_bytes:
                flush()
                size = 0
    flush()
    for (text, i), (edits, start, end) in sorted(best.items()):
        yield text, i, edits, start, end


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in blocks of about block_bytes; each row is in one."""
    rows = texts(benchmark, "item_id", "text").withColumnRenamed("doc_id", "item_id")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + total // block_bytes
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
        yield [(r["item_id"], r["text"]) for r in block.toLocalIterator()]


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, item_id, edits, start_byte, end_byte of every document and item that it holds."""
    spark = docs.sparkSession
    out = None
    for rows in _blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(Items.build(rows, rate))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column("doc_id")
                got = [(ids[t].as_py(), items.ids[i], e, s, z) for items in shared.value for t, i, e, s, z in held(items, b.column("text"))]
                cols = list(zip(*got, strict=True)) if got else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "edits", "start_byte", "end_byte"])

        part = mapped(texts(docs), run, "doc_id long, item_id long, edits long, start_byte long, end_byte long")
        out = part if out is None else out.unionByName(part)
    return out


def _holds_none(shared: Broadcast) -> Callable[[Column], Column]:
    @F.pandas_udf("boolean")
    def clean(s: pd.Series) -> pd.Series:
        column = pa.array(s.fillna(""), pa.large_string())
        dirty = {t for items in shared.value for t, *_ in held(items, column)}
        return pd.Series([i not in dirty for i in range(len(s))])

    return clean


def clean_documents(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs that hold no item."""
    spark = docs.sparkSession
    bounded(spark)
    for rows in _blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(Items.build(rows, rate))
        docs = docs.where(_holds_none(shared)(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return docs
