"""Chroma fingerprints of audio columns (operator 2).

Samples are cut into overlapping windows; the power spectrum of each is folded into twelve
pitch classes, smoothed over time and scaled to unit length. Sixteen filters compare sums
over rectangles of this image, taken from its integral image; each difference of logarithms
is cut into four levels, two bits in Gray code, so each place in time gives an integer of
32 bits. Recordings are aligned by the histogram of offsets between equal integers, and
judged by the share of different bits at the most frequent offset; fewer than least_codes
integers prove nothing.

Search: equal fingerprints are one class. Two that align have an equal integer; every pair of
classes that has one is aligned, so the links and groups are those of all alignments. Classes are
dealt into `parts` by a hash, and each two parts meet in one task: the first lies there as an index
of its integers, the second goes past it in batches, so codes are shuffled, pairs never. There are
at least PARTS parts, and more where one would be larger than PART_BYTES; codes are shuffled once
for each part, and the pairs grow with the square of the classes that have an integer in common.
Classes that fit, directly or through others, form a group; a meeting gives a row for each of its
classes that have links, not for each link.

The tables have no recordings. The query plays the UTF-8 bytes of texts as 8-bit samples at
2 kHz, in windows of 256.

Media too short for an integer are followed by silence up to one; of these, only equal samples
are one class. Null and empty media have an empty fingerprint and form no group; media of any
length are read whole, one at a time; of offsets with equally many integers the least counts;
repeated rows give repeated rows; classes of one id have the sum of their links; a null id takes part in no search and has its fingerprint's
group; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.bytewords import batch_bytes
from quillspark.llm.common import mapped, staged
from quillspark.llm.components import connected_components

CLASSES, LOWEST, SPAN = 12, 27.5, 8
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
LEVELS = (-0.05, 0.0, 0.05)
FLOOR = 0.05
GRAY = np.array([0, 1, 3, 2], np.uint32)
CHUNK = 4096
#: Least number of parts of a search, most bytes of codes of one, and equal integers or codes that are compared at once.
PARTS, PART_BYTES, HITS = 8, 48 << 20, 1 << 21


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, class, classes, frames) of sixteen filters: four kinds at four places and sizes each."""
    return [(kind, (3 * step + kind) % 8, (2, 4, 3, 5)[step] - kind % 2, (SPAN, SPAN // 2, SPAN, SPAN // 2)[step]) for kind in range(4) for step in range(4)]


@cache
def pitch_matrix(rate: int, frame: int) -> np.ndarray:
    """The pitch class of each bin of the spectrum, as a matrix; bins below the lowest note are left out."""
    f = np.fft.rfftfreq(frame, 1 / rate)
    out = np.zeros((len(f), CLASSES), np.float32)
    ok = f >= LOWEST
    out[np.flatnonzero(ok), np.round(CLASSES * np.log2(f[ok] / LOWEST)).astype(int) % CLASSES] = 1
    return out


def chroma(samples: np.ndarray, rate: int, frame: int, hop: int) -> np.ndarray:
    """The smoothed pitch-class frames of one recording."""
    if len(samples) < frame:
        return np.zeros((0, CLASSES))
    view = np.lib.stride_tricks.sliding_window_view(samples, frame)[::hop]
    window, parts = np.hanning(frame).astype(np.float32), []
    for k in range(0, len(view), CHUNK):
        x = view[k : k + CHUNK].astype(np.float32)
        x -= x.mean(axis=1, keepdims=True)
        power = np.abs(np.fft.rfft(x * window, axis=1)).astype(np.float32) ** 2
        parts.append(power @ pitch_matrix(rate, frame))
    c = np.concatenate(parts).astype(np.float64)
    n = len(c) - len(SMOOTH) + 1
    if n <= 0:
        return np.zeros((0, CLASSES))
    c = sum(w * c[i : i + n] for i, w in enumerate(SMOOTH))
    norm = np.sqrt((c * c).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-9, c / np.maximum(norm, 1e-9), 0)


def integers(image: np.ndarray) -> np.ndarray:
    """The packed integers of pitch-class frames."""
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    total = np.zeros((len(image) + 1, CLASSES + 1))
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return total[t + t1, y1] - total[t + t0, y1] - total[t + t1, y0] + total[t + t0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in filters():
        mid, half = y + max(1, h // 2), w // 2
        if kind == 0:  # low against high classes
            parts = [(0, w, y, mid)]
        elif kind == 1:  # before against after
            parts = [(0, half, y, y + h)]
        elif kind == 2:  # opposite corners
            parts = [(0, half, y, mid), (half, w, mid, y + h)]
        else:  # inner against outer frames
            parts = [(w // 4, w - w // 4, y, y + h)]
        cells = sum((t1 - t0) * (y1 - y0) for t0, t1, y0, y1 in parts)
        a = sum(area(*p) for p in parts)
        rest = (area(0, w, y, y + h) - a) / (w * h - cells)
        level = np.digitize(np.log((FLOOR + a / cells) / (FLOOR + rest)), LEVELS)
        out = out << np.uint32(2) | GRAY[level]
    return out


def aligned(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, float]:
    """(offset of b in a, equal integers there, overlap, share of different bits) at the most frequent offset; overlap 0 if none is equal."""
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    size = hi - lo
    total = int(size.sum())
    if not total:
        return 0, 0, 0, 1.0
    counts = np.zeros(len(a) + len(b), np.int64)
    for k in range(0, len(a), 1024):  # hits of some integers at a time: silence has many
        part = slice(k, k + 1024)
        s = size[part]
        where = np.repeat(lo[part] - (np.cumsum(s) - s), s) + np.arange(s.sum())
        counts += np.bincount(np.repeat(np.arange(k, k + len(s)), s) - order[where] + len(b), minlength=len(counts))
    offset = int(np.argmax(counts)) - len(b)
    start, stop = max(0, offset), min(len(a), offset + len(b))
    bits = np.bitwise_count(a[start:stop] ^ b[start - offset : stop - offset]).sum()
    return offset, int(counts[offset + len(b)]), stop - start, float(bits) / (32 * (stop - start))


def same(a: np.ndarray, b: np.ndarray, most_errors: float, least_overlap: float, least_codes: int) -> tuple[bool, int, float]:
    """Whether two fingerprints align: few bit errors over enough of the shorter one, and enough integers."""
    offset, _, overlap, errors = aligned(a, b)
    return overlap >= max(least_codes, least_overlap * min(len(a), len(b))) and errors <= most_errors, offset, errors


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ..., sizes[i] numbers, for all i."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def portions(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of consecutive places whose sizes add up to `most` or less, or of one place."""
    total, k = np.cumsum(sizes), 0
    while k < len(sizes):
        end = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + most, "right")))
        yield slice(k, end)
        k = end


class Part:
    """Fingerprints, one after the other."""

    def __init__(self, rep: np.ndarray, codes: list[bytes]) -> None:
        self.rep, self.size = rep, np.array([len(c) // 4 for c in codes], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.codes = np.frombuffer(b"".join(codes), "<u4")

    def own(self, k: int) -> np.ndarray:
        return self.codes[self.start[k] : self.start[k] + self.size[k]]


class Index:
    """A part whose integers can be looked up."""

    def __init__(self, part: Part) -> None:
        self.part = part
        self.order = np.argsort(part.codes, kind="stable").astype(np.uint32 if len(part.codes) < 1 << 32 else np.int64)
        self.sorted = part.codes[self.order]
        self.owner = np.repeat(np.arange(len(part.rep), dtype=np.int32), part.size)

    def links(self, other: Part, within: bool, most_errors: float, least_overlap: float, least_codes: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(u, v, offset, bit_errors) of what `same` finds between places u of the part and v of other; within: other is of the part too, each pair is found from its larger id."""
        limits, x, y = (most_errors, least_overlap, least_codes), self.part, other
        lo, hi = np.searchsorted(self.sorted, y.codes, "left"), np.searchsorted(self.sorted, y.codes, "right")
        hits = np.add.reduceat(hi - lo, y.start) if len(y.codes) else np.zeros(0, np.int64)
        for rows in portions(hits, HITS):
            if hits[rows].sum() > HITS:  # one fingerprint with very many equal integers: pair by pair
                yield self._one_by_one(y, rows.start, lo, hi, within, limits)
                continue
            at = slice(y.start[rows.start], y.start[rows.stop - 1] + y.size[rows.stop - 1])
            n = hi[at] - lo[at]
            i = self.order[ranges(lo[at], n)]
            u = self.owner[i].astype(np.int64)
            j = np.repeat(np.arange(at.start, at.stop), n)
            v = np.repeat(np.repeat(np.arange(rows.start, rows.stop), y.size[rows]), n)
            wanted = x.rep[u] < y.rep[v] if within else x.rep[u] != y.rep[v]
            i, u, j, v = i[wanted].astype(np.int64), u[wanted], j[wanted], v[wanted]
            if not len(u):
                continue
            first = x.rep[u] < y.rep[v]
            offset = (i - x.start[u]) - (j - y.start[v])
            offset = np.where(first, offset, -offset)
            # Equal integers of each pair and offset, in this order; of the offsets of a pair the first of the most.
            least, width = offset.min(), int(offset.max() - offset.min()) + 1
            told, count = np.unique(((v - rows.start) * len(x.rep) + u) * width + (offset - least), return_counts=True)
            pair = told // width
            head = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            most = np.repeat(np.maximum.reduceat(count, head), np.diff(np.r_[head, len(pair)]))
            top = np.flatnonzero(count == most)
            top = top[np.r_[True, pair[top][1:] != pair[top][:-1]]]
            offset, u, v = told[top] % width + least, pair[top] % len(x.rep), pair[top] // len(x.rep) + rows.start
            yield from self._judged(y, u, v, offset, limits)

    def _judged(self, y: Part, u: np.ndarray, v: np.ndarray, offset: np.ndarray, limits: tuple[float, float, int]) -> Iterator[tuple[np.ndarray, ...]]:
        x, (most_errors, least_overlap, least_codes) = self.part, limits
        first = x.rep[u] < y.rep[v]
        m, n = np.where(first, x.size[u], y.size[v]), np.where(first, y.size[v], x.size[u])
        start, stop = np.maximum(0, offset), np.minimum(m, offset + n)
        ok = np.flatnonzero(stop - start >= np.maximum(least_codes, least_overlap * np.minimum(m, n)))
        u, v, offset, first, start, size = u[ok], v[ok], offset[ok], first[ok], start[ok], (stop - start)[ok]
        in_x, in_y = x.start[u] + np.where(first, start, start - offset), y.start[v] + np.where(first, start - offset, start)
        for some in portions(size, HITS):
            bits = np.bitwise_count(x.codes[ranges(in_x[some], size[some])] ^ y.codes[ranges(in_y[some], size[some])])
            errors = np.add.reduceat(bits, np.cumsum(size[some]) - size[some], dtype=np.int64) / (32 * size[some])
            near = errors <= most_errors
            yield u[some][near], v[some][near], offset[some][near], errors[near]

    def _one_by_one(self, y: Part, v: int, lo: np.ndarray, hi: np.ndarray, within: bool, limits: tuple[float, float, int]) -> tuple[np.ndarray, ...]:
        x, out = self.part, []
        near = np.zeros(len(x.rep), bool)
        at = np.arange(y.start[v], y.start[v] + y.size[v])
        _, once = np.unique(y.codes[at], return_index=True)  # each place of the index is looked at once
        for some in portions((hi - lo)[at[once]], HITS):
            k = at[once][some]
            near[self.owner[self.order[ranges(lo[k], hi[k] - lo[k])]]] = True
        for u in np.flatnonzero(near & (x.rep < y.rep[v] if within else x.rep != y.rep[v])).tolist():
            first = x.rep[u] < y.rep[v]
            ok, offset, errors = same(*((x.own(u), y.own(v)) if first else (y.own(v), x.own(u))), *limits)
            if ok:
                out.append((u, v, offset, errors))
        return tuple(np.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ((),) * 4, (np.int64, np.int64, np.int64, np.float64), strict=True))


def fingerprints(media: DataFrame, id_col: str, media_col: str, rate: int = 11025, frame: int = 4096, hop: int = 1365, sample: str = "<i2") -> DataFrame:
    """id, n_samples, codes (little-endian 32-bit integers), fingerprint_sha256, short_sha256 (of the samples, if silence was added; else empty) for every row; media_col is binary PCM, one channel."""
    span = frame + (len(SMOOTH) + SPAN - 2) * hop
    width, middle = np.dtype(sample).itemsize, 128 if np.dtype(sample).kind == "u" else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = batch_bytes(b.column("media"))
            codes, n, short = [], [], []
            for i in range(b.num_rows):
                own = raw[offsets[i] : offsets[i + 1]]
                x = np.frombuffer(own[: len(own) // width * width].tobytes(), sample)
                n.append(len(x))
                short.append(hashlib.sha256(x.tobytes()).hexdigest() if 0 < len(x) < span else "")
                x = np.pad(x.astype(np.float32) - middle, (0, span - len(x) if short[-1] else 0))
                codes.append(integers(chroma(x, rate, frame, hop)).astype("<u4").tobytes())
            sha = [hashlib.sha256(c).hexdigest() for c in codes]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(codes, pa.binary()), pa.array(sha, pa.string()), pa.array(short, pa.string())], names=["id", "n_samples", "codes", "fingerprint_sha256", "short_sha256"])

    rows = media.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{media_col}`").cast("binary"), F.lit(b"")).alias("media"))
    return mapped(rows, run, "id long, n_samples long, codes binary, fingerprint_sha256 string, short_sha256 string")


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join a[i] and b[i] for all i in root, where each place has the smallest of its group."""
    while len(a := a[(apart := root[a] != root[b])]):
        b = b[apart]
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while not np.array_equal(root, further := root[root]):
            root[:] = further


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Index, Part | None, int | None]]:
    """(index, other, base) of sorted cells: all that meets the index, then None; base is the place of other in the index's own part, None if it is of another."""
    cell, itself, lying, index = None, False, [], None

    def ended() -> Iterator[tuple[Index, Part | None, int | None]]:
        one = index or (Index(Part(np.concatenate([r for r, _ in lying]), [c for _, codes in lying for c in codes])) if lying and itself else None)
        if one is not None and itself:
            for k in range(0, len(one.part.rep), 512):
                rep = one.part.rep[k : k + 512]
                yield one, Part(rep, [one.part.own(i).tobytes() for i in range(k, k + len(rep))]), k
        if one is not None:
            yield one, None, None

    for b in batches:
        cells, moving = b.column("cell").to_numpy(), b.column("moving").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]) | (moving[1:] != moving[:-1])) + 1).tolist(), b.num_rows]
        for k, end in zip(cuts, cuts[1:], strict=False):
            if k == end:
                continue
            if cells[k] != cell:
                yield from ended()
                cell, itself, lying, index = cells[k], b.column("itself")[k].as_py(), [], None
            rep, codes = b.column("rep").slice(k, end - k).to_numpy(), b.column("codes").slice(k, end - k).to_pylist()
            if not moving[k]:
                lying.append((rep, codes))
                continue
            if lying:
                index = Index(Part(np.concatenate([r for r, _ in lying]), [c for _, own in lying for c in own]))
                lying = []
            if index is not None:
                yield index, Part(rep, codes), None
    yield from ended()


def cut_rows(cols: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(cols[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + (1 << 16)]) for c in cols], names=names)


def links(classes: DataFrame, limit: int = 16, rounds: int = 2, most_errors: float = 0.2, least_overlap: float = 0.5, least_codes: int = 8, parts: int | None = None) -> DataFrame:
    """(a, b, offset, bit_errors) of classes (rep, codes) that align. limit and rounds, of an earlier search, change nothing."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for index, other, base in meetings(batches):
            for u, v, offset, errors in index.links(other, base is not None, most_errors, least_overlap, least_codes) if other is not None else ():
                p, q = index.part.rep[u], other.rep[v]
                yield from cut_rows([np.minimum(p, q), np.maximum(p, q), offset, errors], ["a", "b", "offset", "bit_errors"])

    return mapped(dealt(classes, least_codes, parts), met, "a long, b long, offset long, bit_errors double").dropDuplicates(["a", "b"])


def linked(classes: DataFrame, limit: int = 16, rounds: int = 2, most_errors: float = 0.2, least_overlap: float = 0.5, least_codes: int = 8, parts: int | None = None) -> DataFrame:
    """(rep, root, n_links) for each class and meeting of two parts where it has links: how many, and one class that they reach. What `links` gives, without a row for each pair of a large group."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = count = None
        for index, other, base in meetings(batches):
            n = len(index.part.rep)
            if root is None:
                root, count = np.arange(n), np.zeros(n, np.int64)
            if other is None:
                some = np.flatnonzero(count)
                yield from cut_rows([index.part.rep[some], index.part.rep[root[some]], count[some]], ["rep", "root", "n_links"])
                root = None
                continue
            if base is None:  # the other's places come after those of the index
                root, count = np.append(root, np.arange(n, n + len(other.rep))), np.append(count, np.zeros(len(other.rep), np.int64))
            for u, v, _, _ in index.links(other, base is not None, most_errors, least_overlap, least_codes):
                v = v + (n if base is None else base)
                count += np.bincount(np.concatenate([u, v]), minlength=len(count))
                joined(root, u, v)
            if base is None:
                some = n + np.flatnonzero(count[n:])
                yield from cut_rows([other.rep[some - n], index.part.rep[root[some]], count[some]], ["rep", "root", "n_links"])
                root, count = root[:n], count[:n]

    return mapped(dealt(classes, least_codes, parts), met, "rep long, root long, n_links long")


def dealt(classes: DataFrame, least_codes: int, parts: int | None) -> DataFrame:
    """Classes once for each meeting (cell) of their part with one of `parts`, those that lie first."""
    classes = classes.where(F.octet_length("codes") >= 4 * max(1, least_codes))  # shorter ones fit nothing
    if parts is None:
        size = classes.agg(F.coalesce(F.sum(F.octet_length("codes").cast("long")), F.lit(0))).first()[0]
        parts = max(PARTS, -(-size // PART_BYTES))
    of, other = F.col("part"), F.col("other")
    low, high = F.least(of, other), F.greatest(of, other)
    met = classes.withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(parts))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    met = met.select((high * (high + 1) / 2 + low).cast("int").alias("cell"), (of > other).alias("moving"), (of == other).alias("itself"), "rep", "codes")
    return met.repartitionById(parts * (parts + 1) // 2, "cell").sortWithinPartitions("cell", "moving")


def grouped(media: DataFrame, id_col: str, media_col: str, rate: int = 11025, frame: int = 4096, hop: int = 1365, sample: str = "<i2", **search: float) -> DataFrame:
    """doc_id, n_samples, n_codes, fingerprint_sha256, class_id, group_id, n_links for every row of media.

    class_id: the smallest id of the same fingerprint (of short media: of the same samples); group_id: of all classes that align,
    directly or through others; n_links: the links found for the class. All null for empty
    fingerprints.
    """
    fps = staged(fingerprints(media, id_col, media_col, rate, frame, hop, sample), "fingerprints")
    classes = fps.where("octet_length(codes) > 0 AND id IS NOT NULL").groupBy("fingerprint_sha256", "short_sha256").agg(F.min("id").alias("rep"), F.first("codes").alias("codes"))
    classes = staged(classes, "classes")
    found = staged(linked(classes.select("rep", "codes"), **search), "links")
    roots = connected_components(found.select(F.least("rep", "root").alias("a"), F.greatest("rep", "root").alias("b")).distinct())
    n = found.groupBy("rep").agg(F.sum("n_links").alias("n_links"))
    named = classes.select("fingerprint_sha256", "short_sha256", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").join(n, "rep", "left")
    out = fps.join(named, ["fingerprint_sha256", "short_sha256"], "left")
    links_of = F.when(F.col("rep").isNotNull(), F.coalesce("n_links", F.lit(0).cast("long")))
    return out.select(F.col("id").alias("doc_id"), "n_samples", F.expr("CAST(octet_length(codes) div 4 AS BIGINT)").alias("n_codes"), "fingerprint_sha256", F.col("rep").alias("class_id"), F.coalesce("root", "rep").alias("group_id"), links_of.alias("n_links"))
