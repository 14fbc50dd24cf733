"""Row bands of scanned tables: where the ruled lines of a form cut a half page into records.

Images go through Arrow in batches of at most BATCH rows, results in parts of about PART bytes. Grey
images in the binary PGM form need no library; other formats are decoded by an imaging
library where executors have one.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of an Arrow batch, and about how many bytes of one are answered at once.
BATCH, PART = 64, 16 << 20
BANDS = "bands array<struct<y0: int, y1: int>>, heights array<double>, separators array<int>"


@dataclass(frozen=True)
class Form:
    """What counts as page, ink, line and record."""

    bright: int = 110
    page_hole: int = 15
    window: int = 51
    darker: int = 15
    least_line: int = 20
    line_share: float = 1 / 40
    covered: float = 0.30
    line_gap: int = 20
    bottom: int = 8
    least_height: float = 0.08
    inset: int = 6
    side: float = 0.03
    least_ink: float = 0.004
    most_ink: float = 0.25
    column_share: float = 0.5
    least_columns: int = 2


def decoded(content: bytes | pa.Buffer) -> np.ndarray:
    """Grey values of an image, rows by columns."""
    head = re.match(rb"P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", content)
    if head and int(head[3]) < 256:
        w, h = int(head[1]), int(head[2])
        return np.frombuffer(content, np.uint8, w * h, head.end()).reshape(h, w)
    from PIL import Image

    return np.asarray(Image.open(io.BytesIO(content)).convert("L"))


def encoded(gray: np.ndarray) -> bytes:
    """The PGM form of grey values."""
    return b"P5\n%d %d\n255\n" % (gray.shape[1], gray.shape[0]) + np.ascontiguousarray(gray, np.uint8).tobytes()


@dataclass(frozen=True)
class Bits:
    """A mask as one whole number, row after row, the first place lowest; each row ends in gap or more zeros.

    Moving all places by a row or a column is one shift, so a step over 64 places costs about
    as much as one over a place.
    """

    rows: int
    columns: int
    stride: int
    value: int

    @classmethod
    def of(cls, mask: np.ndarray, gap: int = 1) -> Bits:
        h, w = mask.shape
        stride = (w + gap + 63) // 64 * 64
        wide = np.zeros((h, stride), bool)
        wide[:, :w] = mask
        return cls(h, w, stride, int.from_bytes(np.packbits(wide, bitorder="little").tobytes(), "little"))

    def like(self, value: int) -> Bits:
        return Bits(self.rows, self.columns, self.stride, value)

    def packed(self) -> np.ndarray:
        """Each row's places as words of 64 bits."""
        return np.frombuffer(self.value.to_bytes(self.rows * self.stride // 8, "little"), "<u8").reshape(self.rows, -1)

    def mask(self, rows: slice | np.ndarray = slice(None)) -> np.ndarray:
        return np.unpackbits(np.ascontiguousarray(self.packed()[rows]).view(np.uint8), axis=1, bitorder="little")[:, : self.columns].view(bool)


@lru_cache(64)
def _inside(rows: int, columns: int, stride: int) -> int:
    """The places of a mask that aren't gaps."""
    return int.from_bytes(((1 << columns) - 1).to_bytes(stride // 8, "little") * rows, "little")


def _spread(m: int, k: int, step: int) -> int:
    """Where a window of k places around, step bits apart, holds a set one; windows grow by doubling."""
    m, w = m << k // 2 * step, 1
    while 2 * w <= k:
        m, w = m | m >> w * step, 2 * w
    return m | m >> (k - w) * step


def _around(mask: Bits, m: int, k: int) -> int:
    """The places of a mask whose square of side k holds a place of m."""
    whole = _inside(mask.rows, mask.columns, mask.stride)
    return _spread(_spread(m, k, mask.stride) & whole, k, 1) & whole


def _eroded(mask: Bits, k: int) -> Bits:
    """The places whose square of side k is set; what lies outside counts as set."""
    whole = _inside(mask.rows, mask.columns, mask.stride)
    return mask.like(whole ^ _around(mask, whole ^ mask.value, k))


def _opened(mask: Bits, k: int) -> Bits:
    """opened for a mask with gaps of k."""
    return mask.like(_around(mask, _eroded(mask, k).value, k))


def opened(mask: np.ndarray, k: int) -> np.ndarray:
    """The parts of a mask that hold a square of side k; what lies outside counts as set."""
    return _opened(Bits.of(mask, k), k).mask()


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the horizontal runs of a mask, row by row."""
    edge = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    edge[:, 1:-1] = mask
    step = np.diff(edge, axis=1)
    row, start = np.nonzero(step == 1)
    return row, start, np.nonzero(step == -1)[1]


def _long(mask: Bits, k: int, down: bool = False) -> Bits:
    """The horizontal (or vertical) runs of at least k places."""
    step = mask.stride if down else 1
    m, w = mask.value, 1
    while 2 * w <= k:
        m, w = m & m >> w * step, 2 * w
    m, w = m & m >> (k - w) * step, 1  # where runs of k start
    while 2 * w <= k:
        m, w = m | m << w * step, 2 * w
    return mask.like(m | m << (k - w) * step)


def long_runs(mask: np.ndarray, k: int) -> np.ndarray:
    """The horizontal runs of at least k places."""
    return _long(Bits.of(mask), k).mask()


def _crossed(mask: Bits) -> tuple[int, int, int, int] | None:
    """(x0, y0, x1, y1) around all places of a mask, if a row and a column between these bounds are set throughout: their region reaches all four, so no other is larger."""
    words = np.ascontiguousarray(mask.packed().T)
    filled = np.flatnonzero(np.bitwise_or.reduce(words, axis=0))
    if not len(filled):
        return None
    y0, y1 = int(filled[0]), int(filled[-1]) + 1
    over = int.from_bytes(np.bitwise_or.reduce(words[:, y0:y1], axis=1).tobytes(), "little")
    x0, x1 = (over & -over).bit_length() - 1, over.bit_length()
    row = np.frombuffer(((1 << x1) - (1 << x0)).to_bytes(mask.stride // 8, "little"), "<u8")
    if np.bitwise_and.reduce(words[:, y0:y1], axis=1).any() and not np.bitwise_or.reduce(words ^ row[:, None], axis=0).all():
        return x0, y0, x1, y1
    return None


def page_box(gray: np.ndarray, f: Form) -> tuple[int, int, int, int]:
    """(x, y, width, height) of the largest bright region, or of the image if none is bright."""
    k = f.page_hole
    kept = _eroded(Bits.of(gray > f.bright, k), k)
    box = _crossed(kept)
    if box:
        x0, y0, x1, y1 = box
        x0, y0, x1, y1 = max(0, x0 + k // 2 + 1 - k), max(0, y0 + k // 2 + 1 - k), min(gray.shape[1], x1 + k // 2), min(gray.shape[0], y1 + k // 2)
        return x0, y0, x1 - x0, y1 - y0
    bright = kept.like(_around(kept, kept.value, k))
    mask = bright.packed()
    # Rows like the one before add nothing but height: one of each stretch of equal rows is looked at.
    tops = np.flatnonzero(np.append(True, (mask[1:] != mask[:-1]).any(axis=1)))
    below = np.append(tops[1:], len(mask)).tolist()
    row, start, end = _runs(bright.mask(tops))
    if not len(row):
        return 0, 0, gray.shape[1], gray.shape[0]
    root = list(range(len(row)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first = np.searchsorted(row, np.arange(len(tops) + 1)).tolist()
    rows, starts, ends = row.tolist(), start.tolist(), end.tolist()
    for y in range(1, len(tops)):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if starts[i] <= ends[j] and starts[j] <= ends[i]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
            if ends[i] < ends[j]:
                i += 1
            else:
                j += 1
    boxes: dict[int, list[int]] = {}
    for i, y in enumerate(rows):
        box = boxes.setdefault(find(i), [starts[i], int(tops[y]), ends[i], below[y]])
        box[0], box[2], box[3] = min(box[0], starts[i]), max(box[2], ends[i]), below[y]
    x0, y0, x1, y1 = max(boxes.values(), key=lambda b: (b[2] - b[0]) * (b[3] - b[1]))
    return x0, y0, x1 - x0, y1 - y0


def _sums(a: np.ndarray, k: int, most: int, kind: type[np.integer]) -> np.ndarray:
    """The sums of each k rows that follow one another, by windows that double; of a kind that holds them as soon as values up to most no longer fit."""
    n, w, done, out = len(a) - k + 1, 1, 0, None
    while True:
        if k & w:
            part, done = a[done : done + n], done + w
            if out is not None and done * most > np.iinfo(out.dtype).max:
                out, part = out.astype(kind, copy=False), part.astype(kind, copy=False)
            out = part if out is None else out + part
        if 2 * w > k:
            return out
        if 2 * w * most > np.iinfo(a.dtype).max:
            a = a.astype(kind, copy=False)
        a, w = a[: len(a) - w] + a[w:], 2 * w


def _darker(padded: np.ndarray, f: Form) -> np.ndarray:
    """darker_than_around for an image whose borders are already repeated, from the sum of every window."""
    half, (h, w) = f.window // 2, padded.shape
    k = 2 * half + 1
    kind = np.int32 if k * k * (256 + abs(f.darker)) < 1 << 31 else np.int64
    high = _sums(padded.astype(np.uint16), k, 255, kind)
    # Rows are put end to end, and what is summed over their ends is left out.
    flat = np.zeros(high.size + 2 * half, high.dtype)
    flat[: high.size] = high.ravel()
    sums = _sums(flat, k, 255 * k, kind).reshape(-1, w)[:, : w - 2 * half]
    # k * k is odd, so no mean lies half way: gray + darker <= the rounded mean, without dividing.
    least = padded[half : h - half, half : w - half].astype(kind)
    least *= k * k
    least += k * k * f.darker - k * k // 2
    return sums >= least


#: Places of a side of the blocks whose sums bound those of windows.
BLOCK = 8


def _surely_darker(padded: np.ndarray, f: Form) -> np.ndarray | None:
    """What _darker gives, if two bounds settle it for all places: a mean is at most the largest value of the window's columns, and at least what the whole blocks in the window hold; else None."""
    half, (h, w) = f.window // 2, padded.shape
    k, n = 2 * half + 1, (2 * half + 1 - (BLOCK - 1)) // BLOCK
    tall, wide = h - 2 * half, w - 2 * half
    if n < 1 or not 0 <= f.darker < 256 or not tall or not wide:
        return None
    gray = padded[half : h - half, half : w - half]
    most, v = padded.max(axis=0), 1
    while 2 * v <= k:
        most, v = np.maximum(most[: len(most) - v], most[v:]), 2 * v
    most = np.maximum(most[:wide], most[k - v : k - v + wide])
    maybe = gray <= np.maximum(most, f.darker) - np.uint8(f.darker)
    # Group g holds places BLOCK * g and on; block g starts BLOCK - 1 later, so blocks g to g + n - 1 lie in all of its windows.
    rows, columns = -(-tall // BLOCK), -(-wide // BLOCK)
    inner = np.zeros(((rows + n - 1) * BLOCK, (columns + n - 1) * BLOCK), np.uint8)
    part = padded[BLOCK - 1 : BLOCK - 1 + inner.shape[0], BLOCK - 1 : BLOCK - 1 + inner.shape[1]]
    inner[: part.shape[0], : part.shape[1]] = part
    words = inner.view("<u8")  # eight places each, added in four parts of 16 bits
    words = (words & np.uint64(0x00FF00FF00FF00FF)) + (words >> np.uint64(8) & np.uint64(0x00FF00FF00FF00FF))
    words = words.reshape(-1, BLOCK, words.shape[1]).sum(axis=1)
    blocks = (words * np.uint64(0x0001000100010001) >> np.uint64(48)).astype(np.int64)
    within = sum(blocks[i : i + rows] for i in range(n))
    within = sum(within[:, i : i + columns] for i in range(n))
    # A place is surely darker if its value is below this; the mean is rounded.
    below = np.clip((within + k * k // 2) // (k * k) - f.darker + 1, 0, 255).astype(np.uint8)
    below = below.repeat(BLOCK, axis=1)[:, :wide].repeat(BLOCK, axis=0)[:tall]
    return maybe if not (maybe & (gray >= below)).any() else None


def darker_than_around(gray: np.ndarray, f: Form) -> np.ndarray:
    """Places at least f.darker below the mean of the window around them, borders repeated outwards."""
    half, (h, w) = f.window // 2, gray.shape
    padded = np.empty((h + 2 * half, w + 2 * half), np.uint8)
    middle = padded[half : half + h]
    middle[:, :half], middle[:, half : half + w], middle[:, half + w :] = gray[:, :1], gray, gray[:, -1:]
    padded[:half], padded[half + h :] = middle[:1], middle[-1:]
    sure = _surely_darker(padded, f)
    return _darker(padded, f) if sure is None else sure


def _counts(words: np.ndarray) -> np.ndarray:
    """The places set in each row of words."""
    return np.bitwise_count(np.ascontiguousarray(words.T)).sum(axis=0, dtype=np.int32)


def row_bands(gray: np.ndarray, f: Form = Form()) -> tuple[list[tuple[int, int]], list[int]]:
    """The bands (y0, y1) of records and all separators, in the image's own rows.

    Separators are rows mostly covered by long horizontal runs. A band between two counts if it
    is tall enough, holds writing but isn't black, and vertical lines run through it.
    """
    x, top, w, h = page_box(gray, f)
    dark = Bits.of(darker_than_around(gray[top : top + h, x : x + w], f))
    across = _long(dark, max(f.least_line, int(w * f.line_share)))
    down = _long(dark, max(f.least_line, int(h * f.line_share)), down=True)
    lines = np.flatnonzero(_counts(across.packed()) / w > f.covered).tolist()
    if len(lines) < 2:
        return [], []
    cuts = lines[:1]
    for y in lines:
        if y - cuts[-1] > f.line_gap:
            cuts.append(y)
    if h - f.bottom - cuts[-1] > f.least_height * h:
        cuts.append(h - f.bottom)
    left, right = int(f.side * w), int((1 - f.side) * w)
    wide = max(0, right - left)
    middle = np.frombuffer(((1 << left + wide) - (1 << left)).to_bytes(dark.stride // 8, "little"), "<u8")
    writing = _counts(dark.like(dark.value & ~(across.value | down.value)).packed() & middle).tolist()
    # Only columns that hold a long run anywhere are counted.
    words = np.ascontiguousarray(down.packed().T)
    at = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(words, axis=1).view(np.uint8), bitorder="little"))
    ruled = words[at >> 6] >> (at & 63).astype(np.uint64)[:, None] & np.uint64(1)
    bands = []
    for y0, y1 in zip(cuts, cuts[1:], strict=False):
        inner = slice(y0 + f.inset, y1 - f.inset)
        part = writing[inner]
        if y1 - y0 >= f.least_height * h and part and wide and f.least_ink <= sum(part) / (len(part) * wide) <= f.most_ink and int((ruled[:, inner].sum(axis=1) / len(part) > f.column_share).sum()) >= f.least_columns:
            bands.append((top + y0, top + y1))
    return bands, [top + y for y in cuts]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of about PART bytes, or one row."""
    for b in batches:
        step = max(1, b.num_rows * PART // max(1, b.nbytes))
        for k in range(0, b.num_rows, step):
            yield b.slice(k, step)


def mapped(df: DataFrame, f: Callable[[pa.RecordBatch], list[pa.Array]], added: str, without: str | None = None) -> DataFrame:
    """df, but for a column `without`, and the columns `added` that f makes of a batch."""
    spark, at = df.sparkSession, None if without is None else df.columns.index(without)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, str(BATCH))  # else a task holds thousands of images at once
    stay = [i for i in range(len(df.columns)) if i != at]
    schema = spark.createDataFrame([], added).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.empty(24 << 20, np.uint8)  # freed at once: from then on the allocator keeps memory of that size, else each image's arrays are paged in anew
        for b in _parts(batches):
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in stay), *f(b)], [*(b.schema.names[i] for i in stay), *schema.names])

    return df.mapInArrow(run, type(schema)([*(df.schema.fields[i] for i in stay), *schema.fields]))


#: Where the images of a batch are: in a column, or wherever a function finds them, which gives each row's bytes or None.
Content = str | Callable[[pa.RecordBatch], Iterable[bytes | None]]


def _reader(df: DataFrame, content: Content) -> tuple[Callable[[pa.RecordBatch], Iterable[bytes | pa.Buffer | None]], str | None]:
    """A function that gives the images of a batch, and the column that holds them."""
    if callable(content):
        return content, None
    at = df.columns.index(content)
    return lambda b: (x.as_buffer() for x in b.column(at)), content


def banded(images: DataFrame, content: Content = "content", form: Form = Form(), keep: bool = True) -> DataFrame:
    """images with bands (y0, y1), their heights, and separators; null for a null image. Other columns stay; the image too, if keep.

    Images that a function of content opens in the task are in no column and never leave it.
    """
    read, column = _reader(images, content)

    def run(b: pa.RecordBatch) -> list[pa.Array]:
        found = [row_bands(decoded(x), form) if x is not None else None for x in read(b)]

        def listed(rows: list[list | None], values: Callable[[list], pa.Array]) -> pa.Array:
            """Lists of a batch, made of all their values at once."""
            ends = list(accumulate((len(r) if r is not None else 0 for r in rows), initial=0))
            starts = [None if r is None else e for r, e in zip(rows, ends, strict=False)]
            return pa.ListArray.from_arrays(pa.array([*starts, ends[-1]], pa.int32()), values([v for r in rows if r for v in r]))

        bands, separators = ([None if x is None else x[k] for x in found] for k in (0, 1))
        ends = lambda values, k: pa.array([v[k] for v in values], pa.int32())
        return [
            listed(bands, lambda v: pa.StructArray.from_arrays([ends(v, 0), ends(v, 1)], ["y0", "y1"])),
            listed(bands, lambda v: pa.array([y1 - y0 for y0, y1 in v], pa.float64())),
            listed(separators, lambda v: pa.array(v, pa.int32())),
        ]

    return mapped(images, run, BANDS, None if keep else column)


def _crop(gray: np.ndarray, cut: dict[str, int], pad: int) -> bytes:
    return encoded(gray[max(0, cut["y0"] - pad) : cut["y1"] + pad])


def cut_out(samples: DataFrame, content: str = "content", band: str = "band", pad: int = 10) -> DataFrame:
    """samples with `crop`: the rows of the image from pad above to pad below its band, as PGM."""
    at, of = samples.columns.index(content), samples.columns.index(band)

    def run(b: pa.RecordBatch) -> list[pa.Array]:
        rows = zip(b.column(at), b.column(of).to_pylist(), strict=True)
        return [pa.array([_crop(decoded(x.as_buffer()), cut, pad) if x.is_valid and cut is not None else None for x, cut in rows], pa.binary())]

    return mapped(samples, run, "crop binary")


def cut_all(pages: DataFrame, content: Content = "content", bands: str = "bands", pad: int = 10) -> DataFrame:
    """pages with `crops` instead of their image: what cut_out gives for each of their bands, in order; an image is sent to Python or opened once, not once for each band."""
    (read, column), of = _reader(pages, content), pages.columns.index(bands)

    def crops(x: bytes | pa.Buffer | None, cuts: list[dict[str, int] | None] | None) -> list[bytes | None] | None:
        if not cuts or x is None:
            return None if cuts is None else [None] * len(cuts)
        gray = decoded(x)
        return [None if c is None else _crop(gray, c, pad) for c in cuts]

    def run(b: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([crops(x, cuts) for x, cuts in zip(read(b), b.column(of).to_pylist(), strict=True)], pa.list_(pa.binary()))]

    return mapped(pages, run, "crops array<binary>", column)
