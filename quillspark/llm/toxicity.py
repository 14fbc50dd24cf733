"""Toxicity from the nearest labelled examples by exact TF-IDF cosine (operator 8).

Words are terms, A-Z lowered; every term of the examples counts. An example is a labelled
training document, whole. At most `sample` are drawn, by a hash of their ids. Documents are
asked about passage by passage, `passage_words` words each, all of each text.

Weights are (1 + ln tf) * ln(1 + n / df)^2, scaled to unit length; the terms that no example
has don't count. The inverted index keeps the examples in blocks, those with the same frequent
terms side by side, and for each frequent term (in over 1 / FREQUENT of the examples) and block
the largest weight. A passage first reads the postings of its other terms; the k-th best sum
rules out each block whose best sum and largest weights together are below it. Frequent terms
are read in the blocks that are left, so the k nearest are exact.

Their votes, weighted by 1 / (1 - cosine), give each passage log-odds; the highest of a
document and the mean of its three highest become its score by a logistic curve fitted to the
documents of the sample, each voted on by the others. The evidence is the nearest examples of
the passage with the highest log-odds.

Null and empty texts, and texts without a known term, have no neighbour and get the share of
toxic documents. Very long texts are read whole; GROUP passages are searched at a time. Of
equal cosines the example of the smaller id is nearer; of passages with equal log-odds the
earlier one gives the evidence. Repeated rows give repeated rows; of several labels of one id
the largest counts, of several texts of one id that of the smallest hash is learnt from;
without labels of both kinds every score is the share of toxic labels (0 without any). Empty
documents give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.bytewords import Words, batch_bytes
from quillspark.llm.common import held_out_train, labelled_sample, mapped, staged, texts

INSIDE = np.zeros(256, bool)
INSIDE[48:58] = INSIDE[65:91] = INSIDE[97:123] = INSIDE[128:] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
GROUP = 32
FREQUENT = 12
IDF_POWER = 2
PRIOR_VOTES = 10.0
CLOSE = 1e-9
TOP = 3
WHOLE = 1 << 60
NO_ID = np.iinfo(np.int64).min


def passage_terms(column: pa.Array, passage_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, passage, term, count): passages first[i] .. first[i + 1] are text i's; the terms of each, counted, by passage and term hash."""
    raw, offsets = batch_bytes(column)
    words = Words(FOLD[raw], offsets, INSIDE)
    size = np.bincount(words.text, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(np.maximum(1, -(-size // passage_words)))])
    rank = np.arange(len(words.text)) - (np.cumsum(size) - size)[words.text]
    passage, term = first[words.text] + rank // passage_words, words.hashes()
    order = np.lexsort((term, passage))
    passage, term = passage[order], term[order]
    new = np.ones(len(term), bool)
    new[1:] = (passage[1:] != passage[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(new)
    return first, passage[at], term[at], np.diff(np.append(at, len(term)))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of size[0] places, then those of start[1], ..."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _starts(of: np.ndarray, n: int) -> np.ndarray:
    """Where each of 0..n begins in the ascending array of."""
    return np.searchsorted(of, np.arange(n + 1)).astype(np.int64)


@dataclass
class BlockMaxIndex:
    """Examples, their postings by term, and for frequent terms the largest weight of each block; weights of frequent terms are a matrix."""

    k: int
    prior: float
    block: int = 64
    n: int = 0
    doc: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # of each example
    y: np.ndarray = field(default_factory=lambda: np.empty(0))
    vocabulary: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    idf: np.ndarray = field(default_factory=lambda: np.empty(0))
    start: np.ndarray | None = None  # where the postings of a term begin; none of frequent terms
    posting: np.ndarray | None = None
    weight: np.ndarray | None = None
    row: np.ndarray | None = None  # of a frequent term, else -1
    dense: np.ndarray | None = None  # frequent term, block, example of the block
    most: np.ndarray | None = None  # frequent term, block
    curve: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0)

    @staticmethod
    def build(doc: np.ndarray, y: np.ndarray, example: np.ndarray, term: np.ndarray, tf: np.ndarray, block: int, k: int) -> BlockMaxIndex:
        """From the counted terms of examples, one of each document."""
        prior = float(y.mean()) if len(y) else 0.0
        known, example = np.unique(example, return_inverse=True)  # one without a term is near nothing
        if not len(known):
            return BlockMaxIndex(k, prior)
        doc, y, n = doc[known], y[known], len(known)
        vocabulary, of, df = np.unique(term, return_inverse=True, return_counts=True)
        idf = np.log1p(n / df) ** IDF_POWER
        w = (1 + np.log(tf)) * idf[of]
        w /= np.sqrt(np.bincount(example, w * w, n))[example]
        # examples with the same frequent terms stand side by side
        order = np.lexsort((-df[of], example))
        own = _starts(example[order], n)
        two = of[order][np.minimum(own[:-1, None] + np.arange(2), own[1:, None] - 1)]
        at = np.lexsort((doc, two[:, 1], two[:, 0]))
        place = np.empty(n, np.int64)
        place[at] = np.arange(n)
        example, doc, y = place[example], doc[at], y[at]
        frequent = df > n / FREQUENT
        row = np.where(frequent, np.cumsum(frequent) - 1, -1)
        dense = np.zeros((int(frequent.sum()), -(-n // block) * block))
        much = frequent[of]
        dense[row[of[much]], example[much]] = w[much]
        dense = dense.reshape(len(dense), -1, block)
        of, example, w = of[~much], example[~much], w[~much]
        order = np.lexsort((example, of))
        return BlockMaxIndex(k, prior, block, n, doc, y, vocabulary, idf, _starts(of[order], len(vocabulary)), example[order], w[order], row, dense, dense.max(axis=2))

    def weights(self, passage: np.ndarray, term: np.ndarray, tf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, term number, weight) of n passages' known terms, those of each passage of unit length."""
        at = np.searchsorted(self.vocabulary, term)
        ok = at < len(self.vocabulary)
        ok[ok] = self.vocabulary[at[ok]] == term[ok]
        passage, at = passage[ok], at[ok]
        w = (1 + np.log(tf[ok])) * self.idf[at]
        return passage, at, w / np.sqrt(np.bincount(passage, w * w, n))[passage]

    def nearest(self, passage: np.ndarray, at: np.ndarray, w: np.ndarray, n: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, example, cosine) of the k nearest of each of n passages, nearest first, cosines above zero; none of the document skip[passage]."""
        n_blocks, row = self.most.shape[1], self.row[at]
        rare, much = row < 0, np.flatnonzero(row >= 0)
        lo, size = self.start[at[rare]], self.start[at[rare] + 1] - self.start[at[rare]]
        where = _ranges(lo, size)
        slots = n_blocks * self.block
        score = np.bincount(np.repeat(passage[rare] * slots, size) + self.posting[where], np.repeat(w[rare], size) * self.weight[where], n * slots).astype(np.float64).reshape(n, n_blocks, self.block)
        head = _starts(passage[much], n)
        out = []
        for i in range(n):
            mine = much[head[i] : head[i + 1]]
            own = np.flatnonzero(self.doc == skip[i])
            score[i].ravel()[own] = 0
            bound = w[mine] @ self.most[row[mine]]
            least = np.partition(score[i].ravel(), -self.k)[-self.k] if self.k < slots else 0.0  # so much have k examples by rare terms alone
            read = np.flatnonzero(bound + score[i].max(axis=1) >= max(least, CLOSE) - CLOSE)
            if len(mine) and len(read):
                score[i, read] += np.tensordot(w[mine], self.dense[row[mine][:, None], read], 1)
                score[i].ravel()[own] = 0
            flat = score[i, read].ravel()
            near = np.flatnonzero(flat >= max(least, CLOSE) - CLOSE)
            near = near[flat[near] > 0]
            if len(near) > self.k:
                near = near[flat[near] >= np.partition(flat[near], -self.k)[-self.k] - CLOSE]
            e, cosine = read[near // self.block] * self.block + near % self.block, flat[near]
            order = np.lexsort((self.doc[e], -np.round(cosine, 12)))[: self.k]
            out.append((np.full(len(order), i), e[order], np.minimum(cosine[order], 1.0)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def search(self, passage: np.ndarray, term: np.ndarray, tf: np.ndarray, n: int, skip: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """nearest() of n passages, group by group."""
        if not self.n:
            return
        passage, at, w = self.weights(passage, term, tf, n)
        skip = np.full(n, NO_ID) if skip is None else skip
        for lo in range(0, n, GROUP):
            s = slice(*np.searchsorted(passage, (lo, lo + GROUP)))
            if s.start < s.stop:
                p, e, cosine = self.nearest(passage[s] - lo, at[s], w[s], min(GROUP, n - lo), skip[lo : lo + GROUP])
                yield p + lo, e, cosine

    def votes(self, passage: np.ndarray, term: np.ndarray, tf: np.ndarray, n: int, skip: np.ndarray | None = None, evidence: int = 0) -> tuple[np.ndarray, dict[int, list[tuple[int, float]]]]:
        """Log-odds of each of n passages by the votes of its nearest, with the prior as some votes more; its nearest (document, cosine)."""
        good, total, near = np.zeros(n), np.zeros(n), {}
        for p, e, cosine in self.search(passage, term, tf, n, skip):
            w = 1 / (1.02 - cosine)
            good += np.bincount(p, w * self.y[e], n)
            total += np.bincount(p, w, n)
            head = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if evidence and len(p) else []
            for i in head:
                s = slice(i, i + min(evidence, int(np.searchsorted(p, p[i], "right")) - i))
                near[int(p[i])] = list(zip(self.doc[e[s]].tolist(), cosine[s].tolist(), strict=True))
        share = np.clip((good + PRIOR_VOTES * self.prior) / (total + PRIOR_VOTES), 1e-4, 1 - 1e-4)
        return np.log(share / (1 - share)), near

    def score(self, seen: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Scores of documents by what summed() has of them; those without a known term get the prior."""
        if self.prior in (0.0, 1.0):
            return np.full(len(seen), self.prior)
        return np.where(known, 1 / (1 + np.exp(-np.clip(seen @ np.array(self.curve[:3]) + self.curve[3], -30, 30))), self.prior)

    def calibrate(self, seen: np.ndarray, y: np.ndarray) -> None:
        """Fit the curve to documents that others voted on (Newton's method, a small ridge)."""
        if not len(y) or y.min() == y.max():
            return
        m, start = np.column_stack([seen, np.ones(len(y))]), np.array([1.0, 0.0, 0.0, 0.0])
        loss = lambda b: np.logaddexp(0, (1 - 2 * y) * (m @ b)).sum() + 5e-3 * ((b - start) ** 2).sum()
        beta = start.copy()
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(m @ beta, -30, 30)))
            step, part = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + 1e-2 * np.eye(4), m.T @ (p - y) + 1e-2 * (beta - start)), 1.0
            while part > 1e-6 and loss(beta - part * step) > loss(beta):
                part /= 2
            beta -= part * step
            if np.abs(part * step).max() < 1e-9:
                break
        self.curve = tuple(float(x) for x in beta)


def summed(odds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each text: the highest log-odds of its passages, the mean of the TOP highest, the logarithm of how many passages it has."""
    size = np.diff(first)
    order = np.lexsort((-odds, np.repeat(np.arange(len(size)), size)))
    total = np.append(0, np.cumsum(odds[order]))
    top = np.minimum(size, TOP)
    return np.column_stack([odds[order][first[:-1]], (total[first[:-1] + top] - total[first[:-1]]) / top, np.log(size)])


def _voter(index: Callable[[], BlockMaxIndex], passage_words: int, evidence: int) -> Callable:
    """A function over batches (doc_id, text, ...): score features, or with evidence the score and the nearest examples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index()
        for b in batches:
            first, passage, term, tf = passage_terms(b.column("text"), passage_words)
            ids = b.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            odds, near = ix.votes(passage, term, tf, int(first[-1]), None if evidence else np.repeat(ids, np.diff(first)), evidence)
            if not b.num_rows:
                continue
            seen = summed(odds, first)
            if not evidence:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(list(seen), pa.list_(pa.float64()))], names=["doc_id", "y", "seen"])
                continue
            known, why = np.zeros(b.num_rows, bool), []
            for i in range(b.num_rows):
                at = [p for p in range(first[i], first[i + 1]) if near.get(p)]
                known[i] = bool(at)
                best = max(at, key=lambda p: odds[p]) if at else -1
                why.append(",".join(f"{d}:{c:.4f}" for d, c in near.get(best, [])))
            scores = ix.score(seen, known)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64()), pa.array(why, pa.string())], names=["doc_id", "score", "evidence"])

    return run


def train_index(docs: DataFrame, labels: DataFrame, sample: int = 3200, passage_words: int = 128, block: int = 64, k: int = 80) -> BlockMaxIndex:
    """Fit to the bounded sample of labelled documents: at most `sample` rows, each whole."""
    spark = docs.sparkSession
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, term, tf = passage_terms(b.column("text"), WHOLE)[1:]
            cut = [slice(*np.searchsorted(text, (i, i + 1))) for i in range(b.num_rows)]
            cols = [pa.array([v[s].astype(kind).tobytes() for s in cut], pa.binary()) for v, kind in ((term, "<u8"), (tf, "<i4"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), *cols], names=["doc_id", "y", "terms", "tf"])

    _, train = held_out_train(5, 0)
    rows = staged(labelled_sample(docs, labels, "toxic", train, sample), "examples")
    got = mapped(rows, count, "doc_id long, y int, terms binary, tf binary").toPandas().sort_values("doc_id")  # `sample` rows at most
    term, tf = (np.concatenate([np.empty(0, kind), *(np.frombuffer(x, kind) for x in got[c])]) for c, kind in (("terms", "<u8"), ("tf", "<i4")))
    example = np.repeat(np.arange(len(got)), [len(x) // 4 for x in got["tf"]])
    index = BlockMaxIndex.build(got["doc_id"].to_numpy(np.int64), got["y"].to_numpy(np.float64), example, term, tf, block, k)
    if index.n and index.prior not in (0.0, 1.0):
        shared = spark.sparkContext.broadcast(index)  # as large as its bounded sample at most
        voted = mapped(rows.repartition(4 * spark.sparkContext.defaultParallelism), _voter(lambda: shared.value, passage_words, 0), "doc_id long, y int, seen array<double>").toPandas().sort_values("doc_id")
        index.calibrate(np.array(voted["seen"].tolist()), voted["y"].to_numpy(np.float64))
    return index


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, evidence: int = 3, passage_words: int = 128, **fit: int) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence ("id:cosine" of the nearest) for every row of docs."""
    spark = docs.sparkSession
    held_out, _ = held_out_train(5, 0)
    index = train_index(docs, labels, passage_words=passage_words, **fit)
    shared = spark.sparkContext.broadcast(index)  # as large as its bounded sample at most
    scored = mapped(texts(docs), _voter(lambda: shared.value, passage_words, max(1, evidence)), "doc_id long, score double, evidence string")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
