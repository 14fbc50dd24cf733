"""Token counts by overlap resynchronisation (operator 4).

Texts up to chunk_chars are encoded whole. Longer ones are encoded as overlapping chunks with
offsets. Two neighbouring chunks are spliced at a boundary that both have and that is proven
stable: two characters that stay as they are when the text is normalised and that no piece of
the vocabulary has side by side, or a space after a non-space where no piece has a space mark
behind another character (checked when the model is loaded). No merge crosses such a place, so
what stands on either side can't change the other. Without such a boundary in the overlap, the
overlap is doubled, and after the whole chunk the chunk is: the work stays in proportion to the
text, and in the limit the whole text is one chunk.

Nulls count as empty texts; empty texts have no token; texts of any length are counted whole;
repeated rows and ids give one row each; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import mapped, texts

MARK = "▁"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCounter:
    """Counts tokens of one sentencepiece model; keeps the count of whole texts exactly."""

    def __init__(self, model_file: str, chunk_chars: int = 65536, overlap: int = 1024):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        pieces = list(pieces)
        self.stable = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.inner = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        # Without bytes to fall back to, unknown characters that stand together are one token.
        self.bytes = any(self.sp.is_byte(i) for i in range(self.sp.get_piece_size()))
        self._splits: dict[str, bool] = {}
        self.chunk, self.overlap = max(2, chunk_chars), max(1, overlap)

    def counts(self, texts: list[str]) -> list[int]:
        short = [t for t in texts if len(t) <= self.chunk]
        done = iter(self.sp.encode(short, num_threads=1) if short else [])
        return [len(next(done)) if len(t) <= self.chunk else self.long_count(t) for t in texts]

    def _bounds(self, text: str, start: int, end: int) -> list[int]:
        """Where the tokens of text[start:end] begin, in characters of text."""
        return [start + begin for begin, _ in self.sp.encode(text[start:end], return_type="offset_mapping")["offsets"]]

    def splits(self, pair: str) -> bool:
        """Can no token cover both characters of the pair?"""
        if pair not in self._splits:
            a, b = pair
            if b == " ":
                ok = self.stable and a not in " " + MARK
            else:
                plain = not (a.isspace() or MARK in pair or unicodedata.combining(b) or unicodedata.category(b) in ("Cf", "Cn", "Cs") or "\u1100" <= b <= "\u11ff")
                ok = plain and self.bytes and pair not in self.inner and all(self.sp.normalize(x).lstrip(MARK) == x for x in (a, b, pair))
            self._splits[pair] = ok
        return self._splits[pair]

    def long_count(self, text: str) -> int:
        n, total, cut, start = len(text), 0, 0, 0
        end = min(n, self.chunk)
        left = self._bounds(text, start, end)
        while end < n:
            overlap, at, stop, right = self.overlap, None, min(n, end + self.chunk), []
            while at is None:
                low = max(end - overlap, cut + 1)
                if any(self.splits(text[i - 1 : i + 1]) for i in range(low + 1, end)):
                    right = self._bounds(text, low, stop)
                    at = self._common(text, left, right, low, end)
                if at is None and low == cut + 1:
                    break
                overlap *= 2
            if at is None:
                end = min(n, start + 2 * (end - start))
                left = self._bounds(text, start, end)
            else:
                total += sum(cut <= b < at for b in left)
                cut, start, end, left = at, low, stop, right
        return total + self._from(left, cut)

    @staticmethod
    def _from(bounds: list[int], cut: int) -> int:
        return sum(b >= cut for b in bounds)

    def _common(self, text: str, left: list[int], right: list[int], low: int, end: int) -> int | None:
        """The middlemost boundary of both encodings that is stable."""
        both = sorted(b for b in set(left) & set(right) if low < b < end and self.splits(text[b - 1 : b + 1]))
        return both[len(both) // 2] if both else None


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, chunk_chars: int = 65536, overlap: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row of docs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model_file, chunk_chars, overlap)
        for b in batches:
            n = counter.counts(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = texts(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return mapped(rows, run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
