"""Repeated byte strings, by external induced suffix sorting of content shards (operator 7).

A byte of a text goes if a string of `length` bytes that covers it also starts earlier: in a
document of a smaller id, or earlier in the same one. Strings don't cross documents and are
judged on the input.

1. Anchors. Each window of `length` bytes has one: the leftmost of its 32-byte grams of the
   least hash. Equal windows have equal anchors at the same place in them, so it is enough
   to compare the windows of equal anchors. An anchor's context is all bytes that decide
   which windows it serves and what they hold. Of equal contexts, all but the first lose all
   windows of the anchor; batches settle that among their own texts before the shuffle.
2. Shards. Anchors with several contexts send the bytes of their windows, of the first of
   each context, to the shard that the anchor's hash names. There, windows are left out whose
   surroundings of the anchor no other context has. What is left is one text on disk; its
   suffixes are sorted by recursive induction with their common prefixes (see induced_sort),
   and runs of windows with `length` common bytes are equal windows: all but the first go.
   The rows of a shard and where they are from are files too; `memory` bounds what is held
   beside an Arrow batch. Anchors of more than most_contexts contexts are split: each quarter
   of their windows goes to the shard that what all of them hold around the anchor names, and
   batches first settle equal ones among their own.
3. The windows that go are joined to the texts as ranges.

Nulls count as empty texts; very long texts are read in segments, and a window belongs to one.
Rows that repeat both id and text are one document with as many result rows; texts of one id
are told apart by their hash, the smaller first; a null id comes before all others. An empty
table gives an empty result. Extra columns are ignored. Contexts are told apart by 64-bit
hashes, not by their bytes: of two that differ but had equal hashes, one would be taken for the
other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.bytewords import BASE, BASE_INVERSE, batch_bytes, powers
from quillspark.llm.common import mapped, staged, texts
from quillspark.llm.induced_sort import Rows, Scratch, SuffixSorter

GRAM = 32
SEGMENT = 1 << 21
QUARTERS = 4
PLACE = np.uint64((1 << 22) - 1)
BORDER = 0xFF  # not in UTF-8
NO_ID = np.iinfo(np.int64).min


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return _mixed((total[end] - total[start]) * powers(BASE_INVERSE, len(total))[start])


def _totals(raw: np.ndarray) -> np.ndarray:
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(raw)), out=total[1:])
    return total


def anchors(raw: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(gram hash, context hash, first window, last window, place) of the anchors of one text, in parts."""
    n, w = len(raw), length - GRAM + 1
    for a in range(0, n - GRAM + 1 if n >= length else 0, SEGMENT):  # anchors reach n - GRAM
        lo = max(0, a - w + 1)
        part = raw[lo : a + SEGMENT + length + w]
        total = _totals(part)
        m = len(part) - GRAM + 1
        i = np.arange(m)
        g = _hash(total, i, i + GRAM)
        v = (g & ~PLACE) | i.astype(np.uint64)
        rows = -(-m // w)
        block = np.full(rows * w, np.uint64(0xFFFFFFFFFFFFFFFF))
        block[:m] = v
        block = block.reshape(rows, w)
        ahead = np.minimum.accumulate(block, axis=1).ravel()
        back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        s = np.arange(len(part) - length + 1)
        at = (np.minimum(back[s], ahead[s + w - 1]) & PLACE).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        at = at[first]
        own = (at >= a - lo) & (at < a - lo + SEGMENT)
        first, last, at = first[own], last[own], at[own]
        left, right = np.maximum(at - w + 1, 0), np.minimum(at + length, len(part))
        context = _mixed(_hash(total, left, right) + _mixed((at - left).astype(np.uint64) << np.uint64(32) | (right - left).astype(np.uint64)))
        yield g[at], context, lo + first, lo + last, lo + at


def _first_of(keys: list[np.ndarray], order: list[np.ndarray]) -> np.ndarray:
    """Which rows are the first of their keys, by order."""
    sort = np.lexsort([*order[::-1], *keys[::-1]])
    new = np.ones(len(sort), bool)
    new[1:] = np.any([k[sort][1:] != k[sort][:-1] for k in keys], axis=0)
    out = np.zeros(len(sort), bool)
    out[sort[new]] = True
    return out


def _ids(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return b.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False), b.column("th").to_numpy(zero_copy_only=False)


def _anchor_rows(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = batch_bytes(b.column("text"))
            ids, ths = _ids(b)
            parts = []
            for i in range(b.num_rows):
                for part in anchors(raw[offsets[i] : offsets[i + 1]], length):
                    parts.append((*part, np.full(len(part[0]), ids[i]), np.full(len(part[0]), ths[i])))
            if not parts:
                continue
            gram, context, lo, hi, at, doc, th = (np.concatenate(x) for x in zip(*parts, strict=True))
            one = _first_of([gram, context, doc, th, lo], [doc])  # rows that repeat id and text
            gram, context, lo, hi, at, doc, th = (x[one] for x in (gram, context, lo, hi, at, doc, th))
            known = ~_first_of([gram, context], [doc, th, lo])
            gram = np.where(known, _mixed(doc.view(np.uint64) * np.uint64(31) + lo.astype(np.uint64)), gram)
            cols = [gram.view(np.int64), context.view(np.int64), doc, th, lo.astype(np.int32), (hi - lo).astype(np.int16), (at - lo).astype(np.int16), known]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["gram", "context", "doc_id", "th", "lo", "more", "anchor", "known"])

    return run


def _window_rows(length: int) -> Callable:
    """Bytes of contended windows: (shard, doc_id, th, lo, anchor in the bytes or -1, bytes); with lo < 0, windows from -1 - lo on that go at once, one more than `anchor`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = batch_bytes(b.column("text"))
            data, out, hot = raw.tobytes(), [], []
            ids, ths = _ids(b)
            for i, spans in enumerate(b.column("spans").to_pylist()):
                at = int(offsets[i])
                for x in spans:
                    lo, end = x["lo"], x["lo"] + x["more"] + length
                    if not x["hot"]:
                        out.append((x["gram"], ids[i], ths[i], lo, x["anchor"], data[at + lo : at + end]))
                        continue
                    for k, (left, right, most) in enumerate(_quarters(length)):
                        place = lo + x["anchor"]
                        first, last = max(lo, place - most), min(lo + x["more"], place - left)
                        if first <= last:
                            around = data[at + place - left : at + place + GRAM + right]
                            name = hashlib.blake2b(around, digest_size=8, salt=f"{x['gram'] + k:x}".encode()[-16:]).digest()
                            hot.append((int.from_bytes(name, "little", signed=True), ids[i], ths[i], first, last - first, data[at + first : at + last + length]))
            best: dict[tuple, tuple] = {}
            for row in hot:
                if (was := best.get((row[0], row[5]))) and was[:4] != row[:4]:
                    row, gone = min(row, was, key=lambda r: r[1:4]), max(row, was, key=lambda r: r[1:4])
                    out.append((*gone[:3], -1 - gone[3], gone[4], b""))
                best[row[0], row[5]] = row
            out += [(*r[:4], -1, r[5]) for r in best.values()]
            for k in range(0, len(out), 20000):
                cols = list(zip(*out[k : k + 20000], strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.binary())], names=["shard", "doc_id", "th", "lo", "anchor", "bytes"])

    return run


def _quarters(length: int) -> list[tuple[int, int, int]]:
    """(left, right, most): windows that have left to most bytes before their anchor hold left before it and right behind it."""
    span = length - GRAM
    q = -(-(span + 1) // QUARTERS)
    return [(left, max(0, span - left - q + 1), min(span, left + q - 1)) for left in range(0, span + 1, q)]


def _shared_keys(raw: np.ndarray, offsets: np.ndarray, anchor: np.ndarray, shard: np.ndarray, length: int) -> list[np.ndarray]:
    """For each quarter a hash of the shard and of what its windows hold around the anchor; 0 where they lack it."""
    total, out = _totals(raw), []
    for k, (left, right, _) in enumerate(_quarters(length)):
        at = offsets[:-1] + anchor
        ok = (anchor >= left) & (at + GRAM + right <= offsets[1:])
        h = np.zeros(len(anchor), np.uint64)
        h[ok] = _mixed(_hash(total, at[ok] - left, at[ok] + GRAM + right) ^ _mixed(shard[ok].view(np.uint64) + np.uint64(k))) | np.uint64(1)
        out.append(h)
    return out


def _shared_windows(scratch: Scratch, meta: Rows, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each row that may be equal to another row's: its quarter's key is not alone.

    Equal windows of an anchor have equal keys, so none is lost; rows without an anchor are
    of one quarter already, which names their shard.
    """
    first, last = scratch.array(meta.n, np.int64), scratch.array(meta.n, np.int64)
    last[:] = -1
    first[:] = np.iinfo(np.int64).max

    def mark(b: np.ndarray, shared: np.ndarray) -> None:
        b = b[shared]
        first[b["i"]] = np.minimum(first[b["i"]], b["lo"])
        last[b["i"]] = np.maximum(last[b["i"]], b["hi"])

    quarters = _quarters(length)
    for k in range(len(quarters) + 1):
        keyed, at = Rows(scratch, {"key": "u8", "i": "i8", "lo": "i8", "hi": "i8"}), 0
        for b in meta.blocks():
            i = at + np.arange(len(b))
            at += len(b)
            if k == len(quarters):
                ok, key, lo, hi = b["anchor"] < 0, b["shard"].view(np.uint64), np.zeros(len(b), np.int64), b["size"] - length
            else:
                left, _, most = quarters[k]
                ok, key, lo, hi = b[f"k{k}"] != 0, b[f"k{k}"], b["anchor"] - most, b["anchor"] - left
            keyed.add(key[ok], i[ok], lo[ok], hi[ok])
        held = None  # the last row of a block, which the next tells whether it is alone
        for b in keyed.ordered(("key",)):
            b = b if held is None else np.concatenate([held, b])
            equal = np.zeros(len(b) + 1, bool)
            equal[1:-1] = b["key"][1:] == b["key"][:-1]
            mark(b, equal[1:] | equal[:-1])
            held = b[-1:]
        scratch.release()
    for at in range(0, meta.n, scratch.block):
        part = slice(at, at + scratch.block)
        first[part] = np.maximum(first[part], 0)
    return first, last


def _gathered(scratch: Scratch, path: Path, meta: Rows, length: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The windows that may be equal to others as one text, a border behind each row's, and where they are from."""
    first, last = _shared_windows(scratch, meta, length)
    kept, text, at, end = Rows(scratch, {"doc": "i8", "th": "i8", "lo": "i8", "start": "i8"}), scratch.path(), 0, 0
    source = np.memmap(path, np.uint8, "r")
    scratch.maps.append(source)
    with text.open("wb") as f:
        for b in meta.blocks():
            lo, hi = np.asarray(first[at : at + len(b)]), np.asarray(np.minimum(last[at : at + len(b)], b["size"] - length))
            at += len(b)
            ok = lo <= hi
            b, lo, hi = b[ok], lo[ok], hi[ok]
            n = hi - lo + length + 1
            begin, start = b["begin"] + lo, end + np.cumsum(n) - n
            for k in range(0, len(b), 4096):
                size = n[k : k + 4096]
                piece = source[np.minimum(np.repeat(begin[k : k + 4096] - (np.cumsum(size) - size), size) + np.arange(size.sum()), len(source) - 1)]
                piece[np.cumsum(size) - 1] = BORDER
                f.write(piece.tobytes())
            kept.add(b["doc"], b["th"], b["lo"] + lo, start)
            end += int(n.sum())
            scratch.release()
    rows, at = {name: scratch.array(kept.n + (name == "start"), np.int64) for name in kept.dtype.names}, 0
    for b in kept.blocks():
        for name in kept.dtype.names:
            rows[name][at : at + len(b)] = b[name]
        at += len(b)
    rows["start"][at:] = end
    for x in (first, last, source):
        scratch.maps = [m for m in scratch.maps if m is not x]
    out = np.memmap(text, np.uint8, "r") if end else np.empty(0, np.uint8)
    if end:
        scratch.maps.append(out)
    return out, rows


def _later_windows(length: int, memory: int) -> Callable:
    """Sort the shards of a task; the windows that are not the first of their kind, as ranges (doc_id, th, lo, hi)."""
    names = ["doc", "th", "anchor", "lo", "shard", "begin", "size", *(f"k{k}" for k in range(len(_quarters(length))))]

    def ranges(doc: np.ndarray, th: np.ndarray, lo: np.ndarray) -> pa.RecordBatch:
        sort = np.lexsort([lo, th, doc])
        doc, th, lo = doc[sort], th[sort], lo[sort]
        new = np.ones(len(lo), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (lo[1:] > lo[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(lo)) - 1
        cols = [doc[first], th[first], lo[first], lo[last]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc_id", "th", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Scratch(memory) as scratch:
            path, at, meta = scratch.path(), 0, Rows(scratch, {n: "u8" if n[0] == "k" else "i8" for n in names})
            with path.open("wb") as f:
                for b in batches:
                    doc, th, lo, anchor, shard = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "th", "lo", "anchor", "shard"))
                    raw, offsets = batch_bytes(b.column("bytes"))
                    live = lo >= 0
                    n = anchor[~live] + 1
                    if len(n):
                        each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        yield ranges(np.repeat(doc[~live], n), np.repeat(th[~live], n), np.repeat(-1 - lo[~live], n) + each)
                    f.write(raw.tobytes())
                    columns = dict(zip(names, [doc, th, anchor, lo, shard, at + offsets[:-1], np.diff(offsets), *_shared_keys(raw, offsets, anchor, shard, length)], strict=True))
                    meta.add(*(columns[n][live] for n in names))
                    at += len(raw)
            if not meta.n or not at:
                return
            text, rows = _gathered(scratch, path, meta, length)
            if not len(text):
                return
            run_no, least, found, held = 0, None, [], 0  # least: the first of the windows of the run that goes on
            for place, common in SuffixSorter(text, scratch, length).descending():
                row = np.searchsorted(rows["start"], place, side="right") - 1
                run = run_no + np.cumsum(common < length)
                run_no = int(run[-1])
                ok = place + length < rows["start"][row + 1]  # the border is the last byte of a row
                row, run = row[ok], run[ok]
                columns = [run, rows["doc"][row], rows["th"][row], rows["lo"][row] + (place[ok] - rows["start"][row])]
                if least is not None:
                    columns = [np.concatenate(x) for x in zip(least, columns, strict=True)]
                if not len(columns[0]):
                    continue
                later = ~_first_of(columns[:1], columns[1:])
                found.append([c[later] for c in columns[1:]])
                held += int(later.sum())
                least = [c[~later][columns[0][~later] == columns[0][-1]] for c in columns]
                if held > scratch.block:
                    yield ranges(*(np.concatenate(x) for x in zip(*found, strict=True)))
                    found, held = [], 0
            if held:
                yield ranges(*(np.concatenate(x) for x in zip(*found, strict=True)))

    return run


def _cut(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = batch_bytes(b.column("text"))
            out = []
            for i, spans in enumerate(b.column("spans").to_pylist()):
                own = raw[offsets[i] : offsets[i + 1]]
                if not spans:
                    out.append((0, 0, hashlib.sha256(own.tobytes()).hexdigest()))
                    continue
                lo, hi = np.array([s["lo"] for s in spans]), np.array([s["hi"] for s in spans])
                step = np.zeros(len(own) + 1, np.int64)
                np.add.at(step, lo, 1)
                np.add.at(step, hi + length, -1)
                goes = np.cumsum(step[:-1]) > 0
                n_spans = int(goes[0]) + int((goes[1:] & ~goes[:-1]).sum())
                out.append((int(goes.sum()), n_spans, hashlib.sha256(own[~goes].tobytes()).hexdigest()))
            removed, n_spans, digest = zip(*out, strict=True) if out else ((), (), ())
            cols = [b.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, length: int = 100, most_contexts: int = 200, memory: int = 128 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""
    if length < 2 * GRAM:
        raise ValueError(f"length is {2 * GRAM} at least")
    own = texts(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    rows = mapped(own, _anchor_rows(length), "gram long, context long, doc_id long, th long, lo int, more short, anchor short, known boolean")
    in_order = Window.partitionBy("gram", "context").orderBy("doc_id", "th", "lo")
    by_gram = Window.partitionBy("gram")
    repeats = (
        rows.repartition("gram")
        .withColumn("later", F.row_number().over(in_order) > 1)
        .withColumn("contexts", F.count_if(~F.col("known") & ~F.col("later")).over(by_gram))
        .where(F.col("known") | F.col("later") | (F.col("contexts") > 1))
        .withColumn("goes", F.col("known") | F.col("later"))
    )
    repeats = staged(repeats.select("gram", "doc_id", "th", "lo", "more", "anchor", "goes", (F.col("contexts") > most_contexts).alias("hot")), "repeats")
    key = ["doc_id", "th"]
    contended = repeats.where("not goes").groupBy(*key).agg(F.collect_list(F.struct("gram", "lo", "more", "anchor", "hot")).alias("spans"))
    with_id = own.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    windows = with_id.join(contended, key).mapInArrow(_window_rows(length), "shard long, doc_id long, th long, lo long, anchor long, bytes binary")
    later = windows.repartition("shard").mapInArrow(_later_windows(length, memory), "doc_id long, th long, lo long, hi long")
    later = staged(later, "later")
    gone = repeats.where("goes").select(*key, F.col("lo").cast("long").alias("lo"), (F.col("lo") + F.col("more")).cast("long").alias("hi")).unionByName(later)
    spans = gone.groupBy(*key).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    cut = with_id.join(spans, key, "left").mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return cut.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
