"""Quality by attention-based multiple-instance learning (operator 9).

A document is a bag of passages of `passage_words` words, all of its text. Each passage is
encoded as a vector: shares of byte classes, repetition of words within and before the
passage, word lengths, sentence marks. Gated attention, softmax of w(tanh(Vh) * sigm(Uh))
over the bag, weights the hidden vectors h of the passages; a logistic layer scores their
weighted sum. Only document labels teach it.

The model is fitted on the driver to at most `sample` labelled documents, drawn by a hash
of their ids; that bounds the rows that the driver holds. Training and scoring read every
passage, of very long texts too.

Null and empty texts are bags of one passage without words. Repeated rows give repeated
rows; of several labels of one id the largest counts, of several texts of one id that of the
smallest hash is learnt from; equal texts have equal scores. Without labels of both kinds the
score is the share of good labels (0.5 without any). Empty documents give an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.bytewords import Words, batch_bytes
from quillspark.llm.common import bounded, cut, held_out_train, labelled_sample, mapped, texts

#: Byte classes: 0 lower-case letter, 1 capital, 2 digit, 3 white space, 4 sentence mark, 5 comma and the like, 6 other ASCII, 7 not ASCII.
CLASS = np.full(256, 6, np.uint8)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = 0, 1, 2, 7
CLASS[[9, 10, 11, 12, 13, 32]] = 3
CLASS[[ord(c) for c in ".!?"]] = 4
CLASS[[ord(c) for c in ",;:'\"-()"]] = 5
FEATURES = 22


def passages(column: pa.Array, passage_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages of a batch, in order, and the text that each belongs to."""
    raw, offsets = batch_bytes(column)
    n_texts = len(offsets) - 1
    words = Words(raw, offsets, CLASS != 3)
    count = np.bincount(words.text, minlength=n_texts)
    first_word = np.concatenate([[0], np.cumsum(count)])
    n_passages = np.maximum(1, -(-count // passage_words))
    first = np.concatenate([[0], np.cumsum(n_passages)])
    owner = np.repeat(np.arange(n_texts), n_passages)
    total = int(first[-1])
    rank = np.arange(len(words.text)) - first_word[words.text]
    of = first[words.text] + rank // passage_words
    size = np.bincount(of, minlength=total).astype(np.float64)
    each = np.maximum(size, 1)
    # bytes belong to the passage of the last word that starts at or before them
    x = np.zeros((total, FEATURES))
    lengths = (words.end - words.start).astype(np.float64)
    if len(words.start):
        kind = CLASS[raw]
        head = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        begin, which = words.start[head], of[head]
        chars = np.diff(np.append(begin, len(raw))).astype(np.float64)
        for c in range(8):
            x[which, c] = np.add.reduceat((kind == c).astype(np.int64), begin) / chars
        x[which, 8] = np.add.reduceat((raw == 10).astype(np.int64), begin) / each[which]
        x[which, 9] = np.add.reduceat((raw == 124).astype(np.int64), begin) / each[which]
        h = words.hashes()
        order = np.lexsort((h, of))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
        x[:, 10] = np.bincount(of[order], new, total) / each
        same = np.zeros(len(h))
        same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        x[:, 11] = np.bincount(of, same, total) / each
        order = np.lexsort((np.arange(len(h)), h, words.text))
        seen = np.zeros(len(h))
        seen[order[1:]] = (h[order][1:] == h[order][:-1]) & (words.text[order][1:] == words.text[order][:-1])
        x[:, 12] = np.bincount(of, seen, total) / each
        x[:, 13] = np.bincount(of, lengths, total) / each
        x[:, 14] = np.sqrt(np.maximum(0, np.bincount(of, lengths**2, total) / each - x[:, 13] ** 2))
        initial, final = kind[words.start], kind[words.end - 1]
        x[:, 15] = np.bincount(of, initial == 1, total) / each
        x[:, 16] = np.bincount(of, final == 4, total) / each
        x[:, 17] = np.bincount(of, final == 6, total) / each
        x[:, 18] = np.bincount(of, lengths > 20, total) / each
        x[:, 19] = np.bincount(of, (final == 1) & (lengths > 1), total) / each
    x[:, 20] = np.log1p(size)
    x[:, 21] = np.log1p(n_passages)[owner]
    return x.astype(np.float32), owner


@dataclass
class AttentionModel:
    """Weights of the encoder, the gated attention and the scorer; rate is used where nothing could be learnt."""

    rate: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    p: dict[str, np.ndarray] | None = None

    def _forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        p = self.p
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        e -= np.maximum.reduceat(e, first[:-1])[owner]
        a = np.exp(e)
        a /= np.add.reduceat(a, first[:-1])[owner]
        z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return owner, h, t, g, a, z, s

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss of bags first[i] .. first[i + 1] of scaled passages, by weight."""
        owner, h, t, g, a, z, s = self._forward(x, first)
        p = self.p
        ds = ((s - y) / len(y)).astype(h.dtype)
        dz = ds[:, None] * p["c"]
        dh = a[:, None] * dz[owner]
        da = np.einsum("ij,ij->i", h, dz[owner])
        de = a * (da - np.add.reduceat(a * da, first[:-1])[owner])
        dtg = de[:, None] * p["w"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh += dt @ p["V"].T + dg @ p["U"].T
        dpre = dh * (1 - h * h)
        return {"W": x.T @ dpre, "b": dpre.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ ds, "d": ds.sum(keepdims=True)}

    def scores(self, x: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Scores of n bags; each has a passage at least, and owner ascends."""
        if self.p is None:
            return np.full(n, self.rate)
        first = np.searchsorted(owner, np.arange(n + 1))
        return self._forward((x - self.mean) / self.scale, first)[-1].astype(np.float64)

    @staticmethod
    def fit(bags: list[np.ndarray], y: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 60, batch: int = 64, rate: float = 0.004, seed: int = 7) -> AttentionModel:
        """Adam on the log loss, with a small weight decay."""
        if len(y) == 0 or y.min() == y.max():
            return AttentionModel(float(y.mean()) if len(y) else 0.5)
        rng = np.random.default_rng(seed)
        x = np.concatenate(bags)
        m = AttentionModel(float(y.mean()), x.mean(axis=0), x.std(axis=0) + 1e-3)
        d = x.shape[1]
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        m.p = {"W": init(d, hidden), "b": np.zeros(hidden, np.float32), "V": init(hidden, gate), "U": init(hidden, gate), "w": init(gate), "c": init(hidden), "d": np.full(1, np.log(y.mean() / (1 - y.mean())), np.float32)}
        bags = [(b - m.mean) / m.scale for b in bags]
        first_m = {k: np.zeros_like(v) for k, v in m.p.items()}
        second_m = {k: np.zeros_like(v) for k, v in m.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for k in range(0, len(order), batch):
                ids = order[k : k + batch]
                first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in ids])])
                p, grad = m.p, m.gradient(np.concatenate([bags[i] for i in ids]), first, y[ids])
                step += 1
                lr = rate * min(1, 2 * (1 - epoch / epochs))
                for name, gr in grad.items():
                    gr = gr + 1e-4 * p[name]
                    first_m[name] = 0.9 * first_m[name] + 0.1 * gr
                    second_m[name] = 0.999 * second_m[name] + 0.001 * gr * gr
                    p[name] = (p[name] - lr * (first_m[name] / (1 - 0.9**step)) / (np.sqrt(second_m[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return m


def train_model(docs: DataFrame, labels: DataFrame, train: Column, sample: int = 4000, passage_words: int = 64) -> AttentionModel:
    """Fit to the bounded sample, all passages of each; train says of a doc_id whether its label may be used."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, owner = passages(b.column("text"), passage_words)
            first = np.searchsorted(owner, np.arange(b.num_rows + 1))
            rows = [x[first[i] : first[i + 1]].astype("<f4").tobytes() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(rows, pa.binary())], names=["doc_id", "y", "bag"])

    got = mapped(labelled_sample(docs, labels, "quality", train, sample), encode, "doc_id long, y int, bag binary").toPandas().sort_values("doc_id")  # `sample` rows at most
    bags = [np.frombuffer(r, "<f4").reshape(-1, FEATURES) for r in got["bag"]]
    return AttentionModel.fit(bags, got["y"].to_numpy(np.float32))


def scorer(model: AttentionModel, passage_words: int = 64) -> Callable[[Column], Column]:
    """A column function from text to score."""

    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        out = []
        for b in cut([pa.RecordBatch.from_arrays([pa.array(s.fillna(""), pa.large_string())], ["text"])]):
            out.append(model.scores(*passages(b.column("text"), passage_words), b.num_rows))
        return pd.Series(np.concatenate(out) if out else np.empty(0))

    return score


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, passage_words: int = 64, **fit: int) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    held_out, train = held_out_train(4, 2)
    model = train_model(docs, labels, train, passage_words=passage_words, **fit)
    bounded(docs.sparkSession)
    scored = texts(docs).withColumn("score", scorer(model, passage_words)(F.col("text")))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score at least threshold; null texts are scored as empty ones."""
    _, train = held_out_train(4, 2)
    model = train_model(docs, labels, train)
    bounded(docs.sparkSession)
    return docs.where(scorer(model)(F.coalesce(F.col("text").cast("string"), F.lit(""))) >= threshold)
