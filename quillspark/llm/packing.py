"""Bounded-space online packing of token sequences (operator 10).

Every partition keeps a fixed number of open windows. A document's whole windows go out at
once; what is left goes into the open window it fits best. If none fits and no more may be
opened, the fullest is filled with the document's next tokens and emitted, and the rest is
placed in turn. The open windows that a partition is left with carry their ids on and are
merged in the same way, fanin partitions at a time, until one task has the last few; their
end is cut at powers of two, so that no sequence needs padding.

Nulls count as empty texts (one token: the end id); texts of any length are packed whole, cut
into pieces; of windows that fit equally well the first opened takes the piece; repeated rows
and ids are packed once each; an empty input gives no sequence; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import mapped, staged, texts

FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
SCHEMA = ", ".join(f"{c} long" for c in FIELDS) + ", ids binary"
LEVEL, PARTITION = 56, 32  # bits of a sequence id below its level and its partition


class ByteBpe:
    """Ids as the tokenizers library gives them; a faster encoder of the same ranks takes ordinary texts."""

    def __init__(self, json_file: str, ranks_file: str | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_file)
        self.special = [x.content for x in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_file:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast and len(text) < 1 << 20 and not any(x in text for x in self.special):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


class Window:
    """An open sequence: pieces (doc_id, start, doc_tokens, ids)."""

    def __init__(self) -> None:
        self.pieces: list[tuple] = []
        self.used = 0

    def put(self, piece: tuple) -> None:
        self.pieces.append(piece)
        self.used += len(piece[3])


class Packer:
    """Best-fit into at most `windows` open sequences; out gets each closed one."""

    def __init__(self, size: int, windows: int, out: Callable[[Window], None]):
        self.size, self.most, self.out = size, windows, out
        self.open: list[Window] = []

    def add(self, doc_id: int | None, start: int, total: int, ids: np.ndarray) -> None:
        while len(ids) >= self.size:
            w = Window()
            w.put((doc_id, start, total, ids[: self.size]))
            self.out(w)
            ids, start = ids[self.size :], start + self.size
        while len(ids):
            fits = [w for w in self.open if self.size - w.used >= len(ids)]
            if fits:
                w, n = max(fits, key=lambda w: w.used), len(ids)
            elif len(self.open) < self.most:
                self.open.append(w := Window())
                n = len(ids)
            else:
                w = max(self.open, key=lambda w: w.used)
                n = self.size - w.used
            w.put((doc_id, start, total, ids[:n]))
            ids, start = ids[n:], start + n
            if w.used == self.size:
                self.open.remove(w)
                self.out(w)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 8
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:7]), pa.array(cols[7], pa.binary())], names=[*FIELDS, "ids"])


class _Emitter:
    """Rows of closed windows; those of open ones keep their ids."""

    def __init__(self, level: int):
        self.rows: list[tuple] = []
        self.next = (level << LEVEL) | (TaskContext.get().partitionId() << PARTITION)

    def closed(self, w: Window, keep: bool = False) -> None:
        at = 0
        for doc_id, start, total, ids in w.pieces:
            raw = ids.astype("<u4").tobytes()
            self.rows.append((doc_id, start, len(ids), zlib.crc32(raw), total, self.next, at, raw if keep else None))
            at += len(ids)
        self.next += 1

    def batches(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            yield _batch(self.rows)
            self.rows = []


def _powers(windows: list[Window], size: int, out: Callable[[Window], None]) -> None:
    """Close the last windows: refilled one after the other, the end cut at powers of two."""
    pieces = [p for w in windows for p in w.pieces]
    left = sum(w.used for w in windows)
    while left:
        room = min(size, 1 << left.bit_length() - 1)
        left -= room
        w = Window()
        while room:
            doc_id, start, total, ids = pieces[0]
            n = min(room, len(ids))
            w.put((doc_id, start, total, ids[:n]))
            room -= n
            pieces[0] = (doc_id, start + n, total, ids[n:])
            if n == len(ids):
                pieces.pop(0)
        out(w)


def pack(docs: DataFrame, json_file: str, ranks_file: str | None = None, size: int = 2048, end_id: int = 1, windows: int = 16, fanin: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, e = ByteBpe(json_file, ranks_file), _Emitter(0)
        packer = Packer(size, windows, e.closed)
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = bpe.ids(text)
                ids.append(end_id)
                packer.add(doc_id, 0, len(ids), np.array(ids, np.uint32))
            yield from e.batches(1000)
        for w in packer.open:
            e.closed(w, keep=True)
        yield from e.batches()

    def merge(level: int, last: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            e = _Emitter(level)
            packer = Packer(size, windows, e.closed)
            for b in batches:
                for r in b.to_pylist():
                    packer.add(r["doc_id"], r["start"], r["doc_tokens"], np.frombuffer(r["ids"], "<u4"))
                yield from e.batches(1000)
            if last:
                _powers(packer.open, size, e.closed)
            else:
                for w in packer.open:
                    e.closed(w, keep=True)
            yield from e.batches()

        return run

    got = staged(mapped(texts(docs, id_col, text_col), first, SCHEMA), "packed")
    done = got.where("ids is null")
    left = got.where("ids is not null")
    parts = (left.agg(F.max(F.shiftright("sequence_id", PARTITION).bitwiseAND((1 << LEVEL - PARTITION) - 1))).first()[0] or 0) + 1
    level = 0
    while True:
        level += 1
        groups = -(-parts // fanin)
        group = F.shiftright("sequence_id", PARTITION).bitwiseAND((1 << LEVEL - PARTITION) - 1) % groups
        dealt = left.repartition(groups, group) if groups > 1 else left.coalesce(1)
        got = staged(mapped(dealt, merge(level, groups == 1), SCHEMA), "packed")
        done = done.unionByName(got.where("ids is null"))
        if groups == 1:
            return done.select(*FIELDS)
        left, parts = got.where("ids is not null"), groups
