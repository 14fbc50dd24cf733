"""Periodic runs of words: stretches that repeat with a period, found through multi-scale minimizers.

A run is a stretch of words with smallest period p and at least max(least, 2p) words that can't
be extended on either side. Each batch of documents becomes one array of word numbers (equal
numbers: equal bytes; a number of its own between documents, so that nothing crosses them).

* Periods under SCAN are read off directly: for each lag, the maximal stretches where a word
  equals the one a lag before.
* Scale k finds the periods of 2^k to 2^(k+1) - 1. It hashes all grams of g = 2^(k-1) words and
  keeps the leftmost least hash of each window of g grams. A window and its copy a period later
  lie in the run whole, so their minima are equal grams at period distance: pairs of equal
  minimizers at distances of the scale miss no run, and hash collisions only add pairs.
* In a stretch of smaller period, equal minimizers are dense. Runs of periods up to g/2 are known
  by then, so equal grams inside one of them form one unit (a first place, a last place, a
  step): no two units of a gram are closer than g/2, hence each meets at most eight others, and
  each lag between two units is tried once instead of once per pair of places.
* A lag at a place is extended both ways word by word; what is long enough is a run. Of several
  periods of one stretch the smallest counts.

Work on a document of n words is O(n log n) beyond the extensions; nothing is pruned or capped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

from quillspark.llm.bytewords import BASE, BASE_INVERSE, batch_bytes, powers
from quillspark.llm.common import Batches, cut, mapped, texts

#: Periods below it are scanned lag by lag; scales begin with it.
SCAN = 32
LEAST = 12
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words_of(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of a batch of texts as a dictionary array, and where each text's words start (one more than texts)."""
    raw, offsets = batch_bytes(column)
    if not len(raw):
        return pa.array([], pa.large_binary()).dictionary_encode(), np.zeros(len(offsets), np.int64)
    space = _SPACE[raw]
    begins = ~space
    begins[1:] &= space[:-1]
    first = offsets[:-1][offsets[:-1] < len(raw)]
    begins[first] = ~space[first]
    starts = np.flatnonzero(begins)
    dense = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(~space, out=dense[1:])
    ends = np.append(dense[starts], dense[-1])
    packed = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(raw[~space])])
    return packed.dictionary_encode(), np.searchsorted(starts, offsets)


def _stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the maximal stretches of True with at least `least` places."""
    breaks = np.concatenate(([-1], np.flatnonzero(~same), [len(same)]))
    gaps = np.diff(breaks) - 1
    long = np.flatnonzero(gaps >= least)
    return breaks[long] + 1, gaps[long]


def _smallest(runs: Runs) -> Runs:
    """One period for each (start, end), the smallest; in order of start, then period."""
    start, length, period = runs
    order = np.lexsort((period, start + length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _joined(parts: list[Runs]) -> Runs:
    return tuple(np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in range(3))  # type: ignore[return-value]


def _scan(w: np.ndarray, scan: int, least: int) -> list[Runs]:
    out = []
    for p in range(1, min(scan, len(w))):
        start, length = _stretches(w[p:] == w[:-p], max(least - p, p))
        out.append((start, length + p, np.full(len(start), p)))
    return out


def _minimizers(w: np.ndarray, g: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the leftmost least gram hash of each window of g grams of g words, and the hashes there."""
    x = w.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    total = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(x * powers(BASE, len(w)), out=total[1:])
    n = len(w) - g + 1
    h = (total[g:] - total[:n]) * powers(BASE_INVERSE, n)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    # The place in the low bits makes the leftmost of equal hashes the least.
    bits = np.uint64(max(1, (n - 1).bit_length()))
    key = (h >> bits) << bits | np.arange(n, dtype=np.uint64)
    blocks = np.full(-(-n // g) * g, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = key
    blocks = blocks.reshape(-1, g)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(tail[: n - g + 1], head[g - 1 : n])
    places = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    places = places[np.append(True, places[1:] != places[:-1])]
    return places, h[places]


def _lags(w: np.ndarray, g: int, known: Runs) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) for the lags of 2g to 4g - 1 at which a run may lie: one for each lag between two units of equal minimizers."""
    at, h = _minimizers(w, g)
    start, length, period = known
    inner = (period <= g // 2) & (length >= g)
    start, last, period = start[inner], (start + length - g)[inner], period[inner]
    run = np.searchsorted(start, at, side="right") - 1
    inside = run >= 0
    inside[inside] = at[inside] <= last[run[inside]]
    label = np.where(inside, run, -1 - np.arange(len(at)))
    order = np.lexsort((at, label, h))
    at, h, label = at[order], h[order], label[order]
    new = np.ones(len(at), bool)
    new[1:] = (h[1:] != h[:-1]) | (label[1:] != label[:-1])
    u = np.flatnonzero(new)
    first, end, h, label = at[u], at[np.append(u[1:], len(at)) - 1], h[u], label[u]
    step = np.where(label >= 0, period[np.maximum(label, 0)] if len(period) else 1, 1)
    order = np.lexsort((first, h))
    first, end, h, step = first[order], end[order], h[order], step[order]
    places, lags = [], []
    i, t = np.arange(len(first) - 1), 1
    while len(i):
        i = i[(i + t < len(first))]
        i = i[h[i + t] == h[i]]
        i = i[first[i + t] - end[i] < 4 * g]
        j = i + t
        least, most = first[j] - end[i], np.minimum(end[j] - first[i], 4 * g - 1)
        least += np.maximum(0, -((least - 2 * g) // step[i])) * step[i]
        count = np.maximum(0, (most - least) // step[i] + 1)
        k = np.repeat(np.arange(len(i)), count)
        lag = least[k] + (np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count)) * step[i][k]
        places.append(np.maximum(first[i][k], first[j][k] - lag))
        lags.append(lag)
        t += 1
    return (np.concatenate(places), np.concatenate(lags)) if places else (np.empty(0, np.int64), np.empty(0, np.int64))


def _same_for(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading places of a and b, of one length, are equal."""
    done, size = 0, 64
    while done < len(a):
        differ = a[done : done + size] != b[done : done + size]
        if differ.any():
            return done + int(differ.argmax())
        done += size
        size *= 2
    return len(a)


def _extend(w: np.ndarray, places: np.ndarray, lags: np.ndarray, least: int) -> Runs:
    """The runs at (place, lag): each stretch is walked once."""
    out, last, until = [], -1, -1
    for i in np.lexsort((places, lags)).tolist():
        m, p = int(places[i]), int(lags[i])
        if p == last and m < until:
            continue
        ahead = _same_for(w[m : len(w) - p], w[m + p :])
        back = _same_for(w[:m][::-1], w[p : m + p][::-1])
        last, until = p, m + ahead
        if ahead + back >= max(p, least - p):
            out.append((m - back, ahead + back + p, p))
    a = np.array(out, np.int64).reshape(-1, 3)
    return a[:, 0], a[:, 1], a[:, 2]


def find_runs(w: np.ndarray, sizes: np.ndarray, least: int = LEAST, scan: int = SCAN) -> Runs:
    """(start, length, period) of all runs of w, in order of start, then period.

    w holds texts one after the other, longest first, each followed by a number that occurs
    nowhere else; sizes are the texts' words. scan is a power of two.
    """
    if scan < 4 or scan & (scan - 1):
        raise ValueError("scan must be a power of two of at least 4")
    found = _smallest(_joined(_scan(w, scan, least)))
    k = scan
    while len(sizes) and sizes[0] >= 2 * k:
        long = int((sizes >= 2 * k).sum())
        part = w[: int((sizes[:long] + 1).sum())]
        found = _smallest(_joined([found, _extend(part, *_lags(part, k // 2, found), least)]))
        k *= 2
    return found


def _digests(batches: Batches, least: int, scan: int, planted: bool) -> Batches:
    for b in cut(batches, most_bytes=4 << 20):
        ids, (dictionary, bounds) = b.column("doc_id"), words_of(b.column("text"))
        codes = dictionary.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.diff(bounds)
        if planted:
            codes = codes.copy()
            for i, h in enumerate(b.column("h").to_pylist()):
                n = int(sizes[i])
                if h is not None and h % 10 == 0 and n:
                    g = h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    own = codes[bounds[i] : bounds[i + 1]]
                    own[a:] = own[a + np.arange(n - a) % p]
        order = np.argsort(-sizes, kind="stable")
        at = np.concatenate(([0], np.cumsum(sizes[order] + 1)))
        w = np.arange(-1, -1 - at[-1], -1)
        source = np.repeat(bounds[order] - at[:-1], sizes[order] + 1) + np.arange(at[-1])
        real = np.ones(at[-1], bool)
        real[at[1:] - 1] = False
        w[real] = codes[source[real]]
        start, length, period = find_runs(w, sizes[order], least, scan)
        drop = np.zeros(at[-1] + 1, np.int64)
        np.add.at(drop, start + period, 1)
        np.add.at(drop, start + length, -1)
        keep = real & (np.cumsum(drop[:-1]) == 0)
        kept = pc.take(dictionary.dictionary, pa.array(w[keep]))
        ends = np.concatenate(([0], np.cumsum(keep)))[at]
        text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), kept), pa.scalar(b" ", kept.type))
        own = np.searchsorted(start, at)
        rows: list[tuple] = [()] * len(sizes)
        for place, i in enumerate(order.tolist()):
            mine = list(zip((start[own[place] : own[place + 1]] - at[place]).tolist(), length[own[place] : own[place + 1]].tolist(), period[own[place] : own[place + 1]].tolist(), strict=True))
            s, n, p = min(mine, key=lambda r: (-r[1], r[0], r[2])) if mine else (None, None, None)
            lines = "".join(f"{x},{y},{z}\n" for x, y, z in mine)
            rows[i] = (len(mine), s, n, p, 1000 * n // p if mine else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text[place].as_buffer()).hexdigest())
        cols = list(zip(*rows, strict=True)) if rows else [()] * 7
        types = [pa.int64()] * 5 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])


def detect(docs: DataFrame, least: int = LEAST, scan: int = SCAN, planted: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its runs, the greatest of them, and digests of all runs and of the text without repeats.

    Words are maximal runs of bytes other than ASCII white space, numbered from 0. A word is
    dropped from the collapsed text if a run holds it beyond that run's first period. The
    greatest run is the longest, then the first, then that of the smallest period.

    planted: an expression h over doc_id; where h is divisible by 10, words from h // 10 modulo
    the document's words on repeat with a period made from h. It tests the operator on any corpus.

    Null and empty texts have no words: no runs, four nulls, digests of nothing. Texts of any
    length are read whole, one at a time if they exceed a batch; repeated rows give repeated
    rows; an empty table gives an empty result; other columns are ignored; ids must be numbers
    or null.
    """
    own, plant = texts(docs, id_col, text_col), planted is not None
    if plant:
        own = own.withColumn("h", planted.cast("long"))
    return mapped(own, lambda batches: _digests(batches, least, scan, plant), SCHEMA)
