"""Name similarity: Jaro and Jaro-Winkler on UTF-8 bytes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from quillspark.functions.text import ColumnOrName, col

BOOST_FROM, PREFIX, SCALE = 0.7, 4, 0.1
#: Bytes up to which texts are compared many at once.
SHORT = 64
#: Edits up to which texts are compared by diagonals.
FEW = 512


@lru_cache(1 << 16)
def jaro(a: str, b: str) -> float:
    """Jaro similarity; half of the matched bytes out of order count, halves too."""
    x, y = a.encode(), b.encode()
    if x == y:
        return 1.0
    if not x or not y:
        return 0.0
    reach = max(max(len(x), len(y)) // 2 - 1, 0)
    free = list(range(len(y)))
    left, right = [], []
    for i, c in enumerate(x):
        j = next((j for j in free if abs(i - j) <= reach and y[j] == c), None)
        if j is not None:
            free.remove(j)
            left.append(c)
            right.append(j)
    if not left:
        return 0.0
    m = len(left)
    moved = sum(c != y[j] for c, j in zip(left, sorted(right), strict=True)) / 2
    return (m / len(x) + m / len(y) + (m - moved) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro, raised by the common prefix where it is high enough."""
    s = jaro(a, b)
    if s < BOOST_FROM:
        return s
    x, y, n = a.encode(), b.encode(), 0
    while n < min(PREFIX, len(x), len(y)) and x[n] == y[n]:
        n += 1
    return s + n * SCALE * (1 - s)


def _letters(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts as rows, filled up with zeros, and their lengths."""
    length = np.array([len(t) for t in texts], np.int64)
    width = int(length.max())
    return np.array(texts, f"S{width}").view(np.uint8).reshape(len(texts), width), length


def _jaro_winkler_of(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """jaro_winkler of many pairs of texts at once, none empty."""
    (x, nx), (y, ny) = _letters(a), _letters(b)
    row, at = np.arange(len(a)), np.arange(y.shape[1])
    reach = np.maximum(np.maximum(nx, ny) // 2 - 1, 0)[:, None]
    inside = at < ny[:, None]
    free, hits = inside.copy(), np.zeros(x.shape, bool)
    for i in range(x.shape[1]):
        may = free & (y == x[:, i : i + 1]) & (np.abs(at - i) <= reach) & (i < nx)[:, None]
        j = may.argmax(axis=1)
        hit = may[row, j]
        free[row[hit], j[hit]] = False
        hits[:, i] = hit
    m = hits.sum(axis=1)
    both = min(x.shape[1], y.shape[1])
    matched = lambda t, hit: np.take_along_axis(t, np.argsort(~hit, axis=1, kind="stable"), axis=1)[:, :both]
    moved = ((matched(x, hits) != matched(y, inside & ~free)) & (np.arange(both) < m[:, None])).sum(axis=1) / 2
    some = np.maximum(m, 1)
    s = np.where(m == 0, 0.0, (m / nx + m / ny + (m - moved) / some) / 3)
    few = min(PREFIX, both)
    same = (x[:, :few] == y[:, :few]) & (np.arange(few) < np.minimum(nx, ny)[:, None])
    n = np.logical_and.accumulate(same, axis=1).sum(axis=1)
    return np.where(s < BOOST_FROM, s, s + n * SCALE * (1 - s))


def similarities(pairs: list[tuple[str, str]]) -> np.ndarray:
    """0 for each pair with an empty text, 1 for equal texts, else jaro_winkler; short ones all at once."""
    out = np.array([float(x == y and x != "") for x, y in pairs])
    todo = [k for k, (x, y) in enumerate(pairs) if x and y and x != y]
    texts = [(pairs[k][0].encode(), pairs[k][1].encode()) for k in todo]
    short = [k for k, (x, y) in enumerate(texts) if max(len(x), len(y)) <= SHORT]
    if short:
        out[[todo[k] for k in short]] = _jaro_winkler_of([texts[k][0] for k in short], [texts[k][1] for k in short])
    for k in set(range(len(todo))) - set(short):
        out[todo[k]] = jaro_winkler(*pairs[todo[k]])
    return out


@F.arrow_udf(DoubleType())
def _pairs(a: pa.Array, b: pa.Array) -> pa.Array:
    x, y = a.dictionary_encode(), b.dictionary_encode()
    xs, ys = x.dictionary.to_pylist(), y.dictionary.to_pylist()
    code, where = np.unique(x.indices.to_numpy().astype(np.int64) * len(ys) + y.indices.to_numpy(), return_inverse=True)
    return pa.array(similarities([(xs[k // len(ys)], ys[k % len(ys)]) for k in code.tolist()])[where], pa.float64())


def name_similarity(a: ColumnOrName, b: ColumnOrName) -> Column:
    """0 if either is empty, 1 if equal, else Jaro-Winkler."""
    return _pairs(F.coalesce(col(a), F.lit("")), F.coalesce(col(b), F.lit("")))


def _common(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many characters x from i on and y from j on have in common, for each i and j; x and y end in different marks."""
    out, width, todo = np.zeros(len(i), np.int64), 8, np.arange(len(i))
    while len(todo):
        part = np.arange(width)
        p, q = i[todo] + out[todo], j[todo] + out[todo]
        unlike = x[np.minimum(p[:, None] + part, len(x) - 1)] != y[np.minimum(q[:, None] + part, len(y) - 1)]
        whole = ~unlike.any(axis=1)
        out[todo] += np.where(whole, width, unlike.argmax(axis=1))
        todo, width = todo[whole], min(4 * width, 1 << 14)
    return out


def _few_edits(a: str, b: str, most: int) -> int | None:
    """The edit distance if it is at most `most`: how far each diagonal gets with one edit more, all diagonals at once."""
    if abs(len(a) - len(b)) > most:
        return None
    x, y = (np.append(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4"), np.uint32(mark)) for t, mark in ((a, 0xFFFFFFFE), (b, 0xFFFFFFFF)))
    goal = len(b) - len(a)
    far, none = np.full(3, -1, np.int64), np.full(1, -1, np.int64)
    far[1] = _common(x, y, np.zeros(1, np.int64), np.zeros(1, np.int64))[0]
    for n in range(most + 1):  # far[k]: places of a done on diagonal k - n - 1, none outside
        if abs(goal) <= n and far[goal + n + 1] == len(a):
            return n
        wide = np.concatenate([none, far, none])
        # From the diagonal below a character of b is put in, from the one above one of a left out.
        k = np.arange(-n - 1, n + 2)
        i = np.maximum(np.maximum(np.where(far >= 0, far + 1, -1), wide[:-2]), np.where(wide[2:] >= 0, wide[2:] + 1, -1))
        i = np.minimum(i, np.minimum(len(a), len(b) - k))
        ok = (i >= 0) & (i + k >= 0)
        i[~ok] = -1
        i[ok] += _common(x, y, i[ok], (i + k)[ok])
        far = np.concatenate([none, i, none])
    return None


def edits(a: str, b: str) -> int:
    """The edit distance of two texts: by diagonals if it is at most FEW, else by bit vectors.

    A column of the table is two numbers of len(b) bits. The bits of `up` and `down` say where the next cell of the column is one more or one less;
    each character of a changes them with a few operations on whole numbers, so 64 cells cost
    about as much as one.
    """
    while a and b and a[0] == b[0]:
        k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        a, b = a[k:], b[k:]
    while a and b and a[-1] == b[-1]:
        k = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b), strict=False)) if x != y), min(len(a), len(b)))
        a, b = a[: len(a) - k], b[: len(b) - k]
    if not a or not b:
        return len(a) + len(b)
    if len(b) > len(a):
        a, b = b, a
    if len(b) > FEW and (few := _few_edits(a, b, FEW)) is not None:
        return few
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    full, last = (1 << len(b)) - 1, 1 << len(b) - 1
    up, down, n = full, 0, len(b)
    for c in a:
        equal = where.get(c, 0)
        diagonal = (((equal & up) + up) ^ up) | equal | down
        right_up, right_down = down | (full & ~(diagonal | up)), up & diagonal
        n += bool(right_up & last) - bool(right_down & last)
        right_up, right_down = (right_up << 1 | 1) & full, right_down << 1 & full
        up, down = right_down | (full & ~(diagonal | right_up)), right_up & diagonal
    return n


@F.arrow_udf(LongType())
def _edits(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else edits(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int64())


def edit_distance(a: Column, b: Column, bands: tuple[int, ...] = ()) -> Column:
    """Edits between two texts of any length, in bands that widen first if there are any; null if one is null."""
    if not bands:
        return _edits(a, b)
    banded = F.coalesce(*(F.when((n := F.levenshtein(a, b, k)) >= 0, n) for k in bands)).cast("long")
    rest = banded.isNull()
    return F.coalesce(banded, _edits(F.when(rest, a), F.when(rest, b)))
