"""External suffix sorting by recursive induction, with common-prefix values.

Suffixes are compared on their first `depth` bytes; common prefixes are cut off there too.
The sort is the induced one. The suffixes at left-most S places (LMS) are ordered first: the
substrings between them are named in sorted order, and the text of these names, at most half
as long, is sorted the same way, again and again until all names differ or their text fits in
memory, where it is sorted by doubling. The ordered LMS suffixes induce the L suffixes in one ascending pass, and these the S suffixes in one
descending pass.

Each pass is driven by a priority queue of tuples (symbol, order of arrival, place). It is
monotone in the symbol, so it is kept as buckets of symbols, blocks of arrays that go to disk
beyond the memory bound; a bucket is put in order when its turn comes. A tuple taken out puts
in the one of the place before it. In the text itself tuples carry the common prefix with the
tuple before as well: that of two neighbours put in is one more than the least of the values
of the tuples taken out between them, which range minima over the block and a running minimum
for each byte give.

Texts, places, names and orders are files in a scratch folder; sorting by a key deals rows to
ranges on disk until one fits in memory. In memory are a block of each file and one bucket of
each queue, whose size the memory bound sets.
"""

from __future__ import annotations

import mmap
import shutil
import tempfile
from collections import deque
from collections.abc import Iterator
from pathlib import Path
from types import TracebackType

import numpy as np

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
FAN = 32
BYTES_A_NAME = 48


class Scratch:
    """Files in a folder of their own, and how much memory may be used beside them."""

    def __init__(self, memory: int):
        self.memory, self.count, self.maps = memory, 0, []
        self.block = max(1 << 12, min(1 << 19, memory // 64))
        self.folder = Path(tempfile.mkdtemp(prefix="induced-"))

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, kind: type | None, value: BaseException | None, trace: TracebackType | None) -> None:
        self.maps.clear()
        shutil.rmtree(self.folder, ignore_errors=True)

    def path(self) -> Path:
        self.count += 1
        return self.folder / str(self.count)

    def array(self, n: int, dtype: type | str) -> np.ndarray:
        """An array of zeros that is a file."""
        if not n:
            return np.empty(0, dtype)
        out = np.memmap(self.path(), dtype, "w+", shape=(n,))
        self.maps.append(out)
        return out

    def drop(self, a: np.ndarray) -> None:
        self.maps = [m for m in self.maps if m is not a]
        if isinstance(a, np.memmap):
            Path(a.filename).unlink()

    def release(self) -> None:
        """Let go of the pages of files that are mapped just now; they stay in the files."""
        for m in self.maps:
            m._mmap.madvise(mmap.MADV_DONTNEED)


class Rows:
    """Rows of equal columns in the order they came, on disk beyond a block."""

    def __init__(self, scratch: Scratch, columns: dict[str, str]):
        self.scratch, self.dtype, self.n = scratch, np.dtype(list(columns.items())), 0
        self.held: list[np.ndarray] = []
        self.held_n, self.file = 0, None
        self.path = scratch.path()

    def add(self, *columns: np.ndarray) -> None:
        rows = np.empty(len(columns[0]), self.dtype)
        for name, c in zip(self.dtype.names, columns, strict=True):
            rows[name] = c
        self._put(rows)

    def _put(self, rows: np.ndarray, most: int | None = None) -> None:
        self.held.append(rows)
        self.held_n += len(rows)
        self.n += len(rows)
        if self.held_n >= (most or self.scratch.block):
            with self.path.open("ab") as f:
                for r in self.held:
                    f.write(r.tobytes())
            self.file, self.held, self.held_n = True, [], 0

    def blocks(self, backwards: bool = False) -> Iterator[np.ndarray]:
        on_disk, size, step = self.n - self.held_n, self.dtype.itemsize, self.scratch.block
        parts = [(at, min(step, on_disk - at)) for at in range(0, on_disk, step)]

        def read(at: int, n: int) -> np.ndarray:
            with self.path.open("rb") as f:
                f.seek(at * size)
                return np.frombuffer(f.read(n * size), self.dtype)

        held = [np.concatenate(self.held)] if self.held else []
        if backwards:
            yield from (h[::-1] for h in held)
            yield from (read(*p)[::-1] for p in reversed(parts))
        else:
            yield from (read(*p) for p in parts)
            yield from held

    def drop(self) -> None:
        self.held = []
        if self.file:
            self.path.unlink()

    def ordered(self, keys: tuple[str, ...], first: int = 0) -> Iterator[np.ndarray]:
        """Blocks of the rows by keys[first:], equal ones in the order they came; the rows are gone then."""
        if first == len(keys) or not self.n:
            yield from self.blocks()
            self.drop()
            return
        size = self.n * self.dtype.itemsize
        if size <= max(self.scratch.memory // 4, 1 << 16):
            rows = np.concatenate(list(self.blocks()))
            self.drop()
            yield rows[np.lexsort([rows[k] for k in keys[first:][::-1]])]
            return
        step = max(1, self.n // 4096)
        sample = np.sort(np.concatenate([b[keys[first]][:: min(step, max(1, len(b) // 8))] for b in self.blocks()]))
        cuts = np.unique(sample[np.linspace(0, len(sample) - 1, FAN + 1).astype(int)])
        # below the first cut, equal to it, between it and the second, ...
        parts = [Rows(self.scratch, {n: self.dtype[n].str for n in self.dtype.names}) for _ in range(2 * len(cuts) + 1)]
        small = max(64, self.scratch.block // FAN)
        for b in self.blocks():
            v = b[keys[first]]
            to = np.searchsorted(cuts, v, "left") + np.searchsorted(cuts, v, "right")
            order = np.argsort(to, kind="stable")
            edges = np.searchsorted(to[order], np.arange(len(parts) + 1))
            for i in np.flatnonzero(np.diff(edges)):
                parts[i]._put(b[order[edges[i] : edges[i + 1]]], small)
        self.drop()
        for i, p in enumerate(parts):
            yield from p.ordered(keys, first + i % 2)


class _OnDisk:
    def __init__(self, path: Path, columns: int):
        self.path, self.columns = path, columns


class Blocks:
    """A queue of blocks of columns; older ones may be on disk."""

    def __init__(self, scratch: Scratch):
        self.scratch = scratch
        self.parts: deque = deque()

    def put(self, *columns: np.ndarray) -> int:
        self.parts.append(columns)
        return sum(c.nbytes for c in columns)

    def spill(self) -> None:
        """Write what is in memory to one file, but leave the order."""
        fresh = []
        while self.parts and isinstance(self.parts[-1], tuple):
            fresh.append(self.parts.pop())
        if fresh:
            path = self.scratch.path()
            with path.open("wb") as f:
                for c in zip(*fresh[::-1], strict=True):
                    np.save(f, np.concatenate(c))
            self.parts.append(_OnDisk(path, len(fresh[0])))

    @staticmethod
    def _load(part: tuple | _OnDisk) -> tuple[np.ndarray, ...]:
        if isinstance(part, tuple):
            return part
        with part.path.open("rb") as f:
            got = tuple(np.load(f) for _ in range(part.columns))
        part.path.unlink()
        return got

    def take(self, least: int = 1 << 14) -> tuple[np.ndarray, ...] | None:
        """The oldest blocks, some at once if they are small."""
        got, n = [], 0
        while self.parts and n < least:
            got.append(self._load(self.parts.popleft()))
            n += len(got[-1][0])
        return tuple(np.concatenate(c) for c in zip(*got, strict=True)) if got else None

    def take_last(self) -> tuple[np.ndarray, ...] | None:
        return self._load(self.parts.pop()) if self.parts else None


class TupleQueue:
    """The priority queue of a text of bytes: smallest (or largest) first byte, then order of arrival."""

    def __init__(self, scratch: Scratch, depth: int, memory: int):
        self.by = [Blocks(scratch) for _ in range(256)]
        self.low = np.full(256, -1, np.int64)  # least value taken out since the last tuple of this byte
        self.depth, self.memory, self.held = depth, memory, 0

    def put(self, common: np.ndarray, push: np.ndarray, byte: np.ndarray, place: np.ndarray) -> None:
        """common: of all tuples taken out, in order; push: which of them put in (byte, place)."""
        n = len(common)
        if not n:
            return
        if not len(push):
            self.low = np.minimum(self.low, common.min())
            return
        order = np.argsort(byte, kind="stable")
        at, b, p = push[order], byte[order], place[order]
        new = np.ones(len(at), bool)
        new[1:] = b[1:] != b[:-1]
        start = np.where(new, 0, np.concatenate([[0], at[:-1] + 1]))
        least = _range_minima(common, start, at)
        heads = np.flatnonzero(new)
        least[heads] = np.minimum(least[heads], self.low[b[heads]])
        value = np.minimum(least + 1, self.depth).astype(np.uint8)
        self.low = np.minimum(self.low, common.min())
        tails = np.append(heads[1:], len(at)) - 1
        for h, t in zip(heads.tolist(), tails.tolist(), strict=True):
            self.held += self.by[b[h]].put(p[h : t + 1], value[h : t + 1])
            rest = common[at[t] + 1 :]
            self.low[b[h]] = rest.min() if len(rest) else self.depth
        if self.held > self.memory:
            for q in self.by:
                q.spill()
            self.held = 0


def _range_minima(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """min(values[start..end]) for each pair."""
    out = np.empty(len(start), np.int64)
    level = np.frexp((end - start + 1).astype(np.float64))[1] - 1
    table = values
    for k in range(int(level.max(initial=-1)) + 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        use = level == k
        out[use] = np.minimum(table[start[use]], table[end[use] - (1 << k) + 1])
    return out


class Buckets:
    """Ranges of the symbols of a text of names; a symbol of very many places has one of its own."""

    def __init__(self, t: np.ndarray, scratch: Scratch):
        self.n, step = max(1, len(t)), scratch.block
        self.ranges = int(max(FAN, min(4096, 64 * self.n // max(1, scratch.memory // 4))))
        last, count = np.full(self.ranges, -1, np.int64), np.zeros(self.ranges, np.int64)
        for lo in range(0, len(t), step):  # a name is the number of smaller substrings, so a very frequent one is the last of its range
            part = np.asarray(t[lo : lo + step])
            np.maximum.at(last, part * self.ranges // self.n, part)
        for lo in range(0, len(t), step):
            part = np.asarray(t[lo : lo + step])
            count += np.bincount(own := part * self.ranges // self.n, part == last[own], self.ranges).astype(np.int64)
        self.alone = np.where(count > self.n // self.ranges, last, -1)

    def of(self, symbol: np.ndarray) -> np.ndarray:
        r = symbol * self.ranges // self.n
        return 2 * r + (self.alone[r] == symbol)


def _induced(t: np.ndarray, scratch: Scratch, buckets: Buckets, seeds: Iterator[np.ndarray], first: int | None, down: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """One pass over a text of names: (place, whether it was induced), by symbol, up or down.

    seeds are places in that order; of one symbol they come after those that are induced. A
    place induces the one before it if its symbol comes later, or is the same and the place
    was induced itself.
    """
    sign, n_buckets = (-1 if down else 1), 2 * buckets.ranges
    queue, held = [Blocks(scratch) for _ in range(n_buckets)], 0
    memory = max(1 << 18, scratch.memory // 4)

    def put(symbol: np.ndarray, place: np.ndarray) -> None:
        nonlocal held
        if not len(place):
            return
        to = buckets.of(symbol)
        order = np.argsort(to, kind="stable")
        to, place = to[order], place[order]
        heads = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        for h, e in zip(heads, np.append(heads[1:], len(to)), strict=True):
            held += queue[to[h]].put(place[h:e])
        if held > memory:
            for q in queue:
                q.spill()
            held = 0
            scratch.release()

    def before(place: np.ndarray, symbol: np.ndarray, induced: np.ndarray | bool) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the places before, and which are put in."""
        q = sign * t[np.maximum(place - 1, 0)]
        return q, (place > 0) & ((q > symbol) | (q == symbol) & induced)

    if first is not None:
        put(np.array([t[first]]), np.array([first]))
    rest: tuple[np.ndarray, np.ndarray] | None = None
    stream = iter(seeds)

    def seeds_of(b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks (key, place) of the seeds of a bucket."""
        nonlocal rest
        while True:
            if rest is None or not len(rest[1]):
                place = next(stream, None)
                if place is None:
                    return
                symbol = np.asarray(t[place])
                rest = buckets.of(symbol), sign * symbol, place
            n = int(np.searchsorted(sign * rest[0], sign * b, "right"))
            if n:
                yield rest[1][:n], rest[2][:n]
            got_all = n == len(rest[2])
            rest = tuple(x[n:] for x in rest)
            if not got_all:
                return

    for b in range(n_buckets - 1, -1, -1) if down else range(n_buckets):
        if b % 2:  # one symbol
            while got := queue[b].take():
                place = got[0]
                s = sign * t[place[:1]]
                q, push = before(place, s, True)
                put(sign * q[push], place[push] - 1)
                yield place, np.ones(len(place), bool)
            for s, place in seeds_of(b):
                q, push = before(place, s, False)
                put(sign * q[push], place[push] - 1)
                yield place, np.zeros(len(place), bool)
            continue
        got = queue[b].take(1 << 60)
        place = got[0] if got else np.empty(0, np.int64)
        symbol = sign * t[place]
        order = np.argsort(symbol, kind="stable")
        key, place = symbol[order] * 2, place[order]
        for s, p in seeds_of(b):  # seeds have odd keys
            at = np.searchsorted(key, s * 2 + 1, "right")
            key, place = np.insert(key, at, s * 2 + 1), np.insert(place, at, p)
        window = 1 << 12
        while len(key):
            k, p = key[:window], place[:window]
            s, induced = k >> 1, (k & 1) == 0
            q, push = before(p, s, induced)
            least = np.minimum.accumulate(np.where(push, q * 2, np.iinfo(np.int64).max))  # an induced one comes after its equals that are there, and before seeds
            ok = np.append(True, k[1:] <= least[:-1])
            n = len(k) if ok.all() else int(np.argmin(ok))
            yield p[:n], induced[:n]
            key, place = key[n:], place[n:]
            q, p = q[:n][push[:n]], p[:n][push[:n]] - 1
            mine = buckets.of(sign * q) == b
            if mine.any():
                order = np.argsort(q[mine], kind="stable")
                new_key, new_place = q[mine][order] * 2, p[mine][order]
                at = np.searchsorted(key, new_key, "right")
                key, place = np.insert(key, at, new_key), np.insert(place, at, new_place)
            put(sign * q[~mine], p[~mine])


class SuffixSorter:
    """Sorts the suffixes of text (bytes or names; the last may not occur before as part of what matters)."""

    def __init__(self, text: np.ndarray, scratch: Scratch, depth: int):
        self.t, self.n, self.scratch, self.depth, self.block = text, len(text), scratch, depth, scratch.block
        self.word, self.bits = (8, 8) if text.dtype == np.uint8 else (2, 32)

    # -- LMS places -----------------------------------------------------------------

    def _lms(self) -> np.ndarray:
        """The LMS places in ascending order, found block by block from the end."""
        t, n, next_s, nxt = self.t, self.n, False, -1
        places, at = self.scratch.array(n // 2 + 1, np.int64), n // 2 + 1
        for lo in range((max(n - 1, 0) // self.block) * self.block, -1, -self.block):
            part = np.asarray(t[lo : lo + self.block]).astype(np.int64)
            after = np.append(part[1:], nxt)
            differ = np.flatnonzero(part != after)
            s = np.empty(len(part), bool)
            where = np.searchsorted(differ, np.arange(len(part)))
            inside = where < len(differ)
            s[inside] = part[differ[where[inside]]] < after[differ[where[inside]]]
            s[~inside] = next_s
            left = int(t[lo - 1]) if lo else -1
            before = np.empty(len(part), bool)
            before[1:] = ~s[:-1]
            before[0] = lo > 0 and (left > part[0] or (left == part[0] and not s[0]))
            found = lo + np.flatnonzero(s & before)
            places[at - len(found) : at] = found
            at -= len(found)
            next_s, nxt = bool(s[0]), int(part[0])
        return places[at:]

    def _words(self, place: np.ndarray) -> np.ndarray:
        """The next symbols at each place, as numbers that order like them; beyond the end, zeros."""
        out = np.zeros(len(place), np.uint64)
        for i in range(self.word):
            ok = place + i < self.n
            v = self.t[place[ok] + i].astype(np.uint64) + np.uint64(self.bits == 32)
            out[ok] |= v << np.uint64(self.bits * (self.word - 1 - i))
        return out

    def _names(self, lms: np.ndarray) -> tuple[Rows, bool]:
        """(i, name) of the i-th LMS substring, and whether all names differ; a name is the number of smaller substrings. Substrings end with the next LMS symbol and are cut off after depth."""
        m, word, named, unique = len(lms), self.word, Rows(self.scratch, {"i": "i8", "name": "i8"}), True
        rows = Rows(self.scratch, {"group": "i8", "word": "u8", "i": "i8", "size": "i8"})

        def key(place: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
            short = np.clip(word * (k + 1) - size, 0, word)
            mask = np.where(short >= word, ONES, (np.uint64(1) << (np.uint64(self.bits) * np.minimum(short, word - 1).astype(np.uint64))) - np.uint64(1))
            return self._words(place + word * k) | mask

        for lo in range(0, m, self.block):
            place = np.asarray(lms[lo : lo + self.block + 1])
            size = np.diff(np.append(place, self.n) if lo + self.block >= m else place) + 1
            place = place[: len(size)]
            rows.add(np.zeros(len(size), np.int64), key(place, size, 0), np.arange(lo, lo + len(size)), np.minimum(size, self.depth + word))
        k = 0
        while rows.n:
            nxt = Rows(self.scratch, {"group": "i8", "word": "u8", "i": "i8", "size": "i8"})
            more = word * (k + 1) < self.depth + word
            last_group, last_word, name, at = -1, None, 0, 0
            pending = None  # the last row waits for the next block, which tells whether it is alone

            def settle(r: np.ndarray, name: np.ndarray, alone: np.ndarray, nxt: Rows = nxt, more: bool = more, k: int = k) -> None:
                nonlocal unique
                goes = ~alone & (r["size"] >= word * (k + 1)) & more  # one that ends here is told from longer ones by the next word
                unique = unique and bool((alone | goes).all())
                named.add(r["i"][~goes], name[~goes])
                if goes.any():
                    nxt.add(name[goes], key(lms[r["i"][goes]], r["size"][goes], k + 1), r["i"][goes], r["size"][goes])

            for b in rows.ordered(("group", "word")):
                group, w = b["group"], b["word"]
                new_group = np.concatenate([[group[0] != last_group], group[1:] != group[:-1]])
                new = new_group | np.concatenate([[w[0] != last_word], w[1:] != w[:-1]])
                index = np.arange(len(b))
                in_group = index - np.maximum.accumulate(np.where(new_group, index, 0))
                if not new_group[0]:
                    run = int(np.argmax(new_group)) if new_group.any() else len(b)
                    in_group[:run] += at
                head = np.maximum.accumulate(np.where(new, index, -1))
                names = np.where(head >= 0, group + in_group[np.maximum(head, 0)], name)
                if pending is not None:
                    settle(pending[0], pending[1], pending[2] & new[:1])
                alone = new & np.append(new[1:], True)
                settle(b[:-1], names[:-1], alone[:-1])
                pending = b[-1:], names[-1:], new[-1:]
                last_group, last_word, name, at = group[-1], w[-1], names[-1], in_group[-1] + 1
            settle(*pending)
            self.scratch.release()
            rows, k = nxt, k + 1
        return named, unique

    def _sorted_lms(self) -> Rows:
        """The LMS places in the order of their suffixes, on depth symbols."""
        lms, out = self._lms(), Rows(self.scratch, {"place": "i8"})
        if not len(lms):
            return out
        named, unique = self._names(lms)
        ranked = Rows(self.scratch, {"i": "i8", "rank": "i8"})
        if unique:
            for b in named.ordered(("i",)):
                ranked.add(b["i"], b["name"])
        else:
            names, at = self.scratch.array(len(lms), np.int64), 0
            for b in named.ordered(("i",)):
                names[at : at + len(b)] = b["name"]
                at += len(b)
            rank = len(lms)
            for place in SuffixSorter(names, self.scratch, self.depth // 2 + 2).places_descending():
                ranked.add(place, rank - 1 - np.arange(len(place)))
                rank -= len(place)
            self.scratch.drop(names)
        placed, at = Rows(self.scratch, {"rank": "i8", "place": "i8"}), 0
        for b in ranked.ordered(("i",)):
            placed.add(b["rank"], np.asarray(lms[at : at + len(b)]))
            at += len(b)
        for b in placed.ordered(("rank",)):
            out.add(b["place"])
        self.scratch.release()
        return out

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The common prefixes of the suffixes at a and b, up to depth."""
        out, live, word = np.zeros(len(a), np.int64), np.arange(len(a)), self.word
        for k in range(0, self.depth, word):
            if not len(live):
                break
            x = self._words(a[live] + k) ^ self._words(b[live] + k)
            room = self.n - np.maximum(a[live], b[live]) - k
            equal = np.where(x == 0, word, 0)
            odd = np.flatnonzero(x)
            for byte in range(word):  # leading equal bytes
                odd = odd[(x[odd] >> np.uint64(8 * (word - 1 - byte))) == 0]
                equal[odd] += 1
            out[live] += np.clip(np.minimum(equal, room), 0, word)
            live = live[(equal == word) & (room > word)]
        return np.minimum(out, self.depth)

    def _in_memory(self) -> np.ndarray:
        """The places of a text of names that fits in memory, in the order of their suffixes on depth names."""
        rank, step = np.array(self.t), 1
        while True:
            order = np.argsort(rank, kind="stable")
            new = np.append(True, rank[order][1:] != rank[order][:-1])
            rank[order] = np.cumsum(new)
            if step >= self.depth or new.all():
                return order
            rank *= self.n + 1
            rank[:-step] += rank[step:] // (self.n + 1)
            step *= 2

    # -- passes ---------------------------------------------------------------------

    def places_descending(self) -> Iterator[np.ndarray]:
        """All suffixes of a text of names from the largest down, in blocks of places."""
        if not self.n:
            return
        if BYTES_A_NAME * self.n <= self.scratch.memory:
            yield self._in_memory()[::-1]
            return
        seeds = self._sorted_lms()
        buckets, ascending = Buckets(self.t, self.scratch), Rows(self.scratch, {"place": "i8"})
        for place, induced in _induced(self.t, self.scratch, buckets, (b["place"] for b in seeds.blocks()), self.n - 1, False):
            ascending.add(place[induced])
        seeds.drop()
        for place, _ in _induced(self.t, self.scratch, buckets, (b["place"] for b in ascending.blocks(backwards=True)), None, True):
            yield place
        ascending.drop()

    def descending(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All suffixes of a text of bytes from the largest down, in blocks: place, common prefix with the one before."""
        if not self.n:
            return
        t, lms = self.t, self._sorted_lms()
        memory = max(1 << 18, self.scratch.memory // 4)
        queue = TupleQueue(self.scratch, self.depth, memory)
        kept = [Blocks(self.scratch) for _ in range(256)]
        one = lambda x, kind=np.int64: np.array([x], kind)
        queue.put(one(0), one(0), one(t[self.n - 1], np.uint8), one(self.n - 1))
        queue.low[t[self.n - 1]] = self.depth
        held, stream, rest = 0, (b["place"] for b in lms.blocks()), np.empty(0, np.int64)
        for c in range(256):
            previous = -1
            while got := queue.by[c].take():
                place, common = got
                held += kept[c].put(place, common)
                previous = place[-1]
                before = t[np.maximum(place - 1, 0)]
                push = np.flatnonzero((place > 0) & (before >= c))
                queue.put(common.astype(np.int64), push, before[push], place[push] - 1)
            if held > memory:
                for q in kept[: c + 1]:
                    q.spill()
                held = 0
                self.scratch.release()
            while True:
                if not len(rest):
                    rest = next(stream, None)
                    if rest is None:
                        rest = np.empty(0, np.int64)
                        break
                n = int(np.searchsorted(t[rest], c, "right"))
                place, rest = rest[:n], rest[n:]
                if n:
                    common = np.zeros(n, np.int64)
                    common[1:] = self._common(place[1:], place[:-1])
                    if previous >= 0:
                        common[:1] = self._common(place[:1], one(previous))
                    previous = place[-1]
                    queue.put(common, np.arange(n), t[place - 1], place - 1)
                if len(rest):
                    break
        lms.drop()
        queue = TupleQueue(self.scratch, self.depth, memory)
        for c in range(255, -1, -1):
            previous, seen = -1, 0
            while got := queue.by[c].take():
                place, common = got
                previous = place[-1]
                yield place, common.astype(np.int64)
                before = t[np.maximum(place - 1, 0)]
                push = np.flatnonzero((place > 0) & (before <= c))
                queue.put(common.astype(np.int64), push, before[push], place[push] - 1)
            link = None if previous < 0 else previous
            while got := kept[c].take_last():
                place, ascending = got[0][::-1], got[1].astype(np.int64)
                common = np.empty(len(place), np.int64)
                common[1:] = ascending[1:][::-1]
                common[0] = 0 if link is None else self._common(place[:1], one(link))[0]
                link = place[-1]
                yield place, common
                before = t[np.maximum(place - 1, 0)]
                push = np.flatnonzero((place > 0) & (before < c))
                queue.put(common, push, before[push], place[push] - 1)
                seen += len(place)
                if seen > self.scratch.memory // 16:
                    self.scratch.release()
                    seen = 0
