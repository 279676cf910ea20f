"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A text counts as its distinct words in order of first appearance. A word is the bag of its character n-grams (on UTF-8 bytes, with word bounds), each
with an embedding vector in a hashed table. The vectors of a word are averaged, the
words of a block of the text are averaged, and a linear softmax reads the block. A text
is as toxic as its worst block, so a single insult in a long text still counts. The
vectors and the softmax are trained jointly in numpy, on the worst block of each
training text, so unseen inflections and misspellings share the vectors of their stems.

The model is fitted on a bounded sample of labelled rows: at most ``SAMPLE`` rows of
each class, the first by hash of the id. Everything labelled takes part in the draw;
every whole text is scored.

Null and empty texts are scored from the bias alone. Rows with a null id or label are
not learned from; a null id is not held out. Several labels of one id count as their
maximum. Without labels of both classes every score is the share of toxic labels, or
zero. Repeated rows are scored alike; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evraklab.llm.core import map_batches, remainder, utf8

SAMPLE = {1: 1500, 0: 3000}
FOLDS = 5
NGRAMS = (3, 4, 5, 6)
BUCKETS = 1 << 17
DIM = 4
BLOCK = 32
# A block of fewer words is averaged over so many, lest one word make a verdict.
LEAST = 8
SCALE = 32.0
ROUNDS = 60
RATE = 0.05
SHRINK = 1e-3
CACHE = 400_000
PIECE = 1 << 14  # words whose n-grams are handled at a time, to keep arrays small


def distinct(text: bytes) -> list[bytes]:
    """The lower-cased distinct words of a text, by first appearance."""
    return list(dict.fromkeys(text.lower().split()))


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the n-grams of all words, and how many each word has (one at least)."""
    parts = [_subwords(words[i : i + PIECE]) for i in range(0, len(words), PIECE)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    buffer = np.frombuffer(b"".join(b"<%b>" % w for w in words), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    end = np.cumsum(lengths)[owner]
    at = np.arange(len(buffer))
    out, owners = [], []
    value = np.zeros(len(buffer), np.uint64)
    for n in range(1, NGRAMS[-1] + 1):
        if n > len(buffer):
            break
        value = value[: len(buffer) - n + 1] * np.uint64(0x100000001B3) + buffer[n - 1 :]
        if n in NGRAMS:
            inside = at[: len(value)] + n <= end[: len(value)]
            mixed = value[inside] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
            out.append((mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32))
            owners.append(owner[: len(value)][inside])
    grams, owners = np.concatenate(out), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return grams[order], np.bincount(owners, minlength=len(words)).astype(np.int32)


@dataclass
class Model:
    """Score of each n-gram bucket (its vector times the softmax's difference) and the bias."""

    grams: np.ndarray
    bias: float

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        grams, counts = subwords(words)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        return np.add.reduceat(self.grams[grams], starts) / counts

    def score(self, words: np.ndarray) -> float:
        """Probability of the toxic class for a text, given its distinct words' scores."""
        worst = 0.0
        if len(words):
            starts = np.arange(0, len(words), BLOCK)
            sizes = np.maximum(np.diff(np.append(starts, len(words))), LEAST)
            worst = float((np.add.reduceat(words, starts) / sizes).max())
        z = SCALE * worst + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def train(texts: list[bytes], labels: list[int]) -> Model:
    """Fit embeddings and softmax jointly on the worst block of each text, with Adam."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(BUCKETS), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    code: dict[bytes, int] = {}
    streams = [np.array([code.setdefault(w, len(code)) for w in distinct(t)], np.int32) for t in texts]
    grams, counts = subwords(list(code))
    gram_starts = np.concatenate([[0], np.cumsum(counts)])
    pieces = [(i, min(i + PIECE, len(counts))) for i in range(0, len(counts), PIECE)]
    stream = np.concatenate(streams)
    del code
    # Blocks of all texts; texts without a word have none.
    sizes, owner = [], []
    for i, s in enumerate(streams):
        full, rest = divmod(len(s), BLOCK)
        sizes += [BLOCK] * full + [rest] * bool(rest)
        owner += [i] * (full + bool(rest))
    sizes, owner = np.array(sizes), np.array(owner)
    spread = np.maximum(sizes, LEAST)
    block_starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    text_starts = np.flatnonzero(np.diff(owner, prepend=-1))
    held = owner[text_starts]
    weight = np.where(y[held] > 0, 0.5 / y[held].sum(), 0.5 / (1 - y[held]).sum())

    rng = np.random.default_rng(7)
    table = rng.normal(0, 0.05, (BUCKETS, DIM))
    out = rng.normal(0, 0.5, (DIM, 2))
    bias = np.zeros(2)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (table, out, bias)]
    for step in range(1, ROUNDS + 1):
        toward = out[:, 1] - out[:, 0]
        gram_scores = table @ toward
        word = np.concatenate(
            [
                np.add.reduceat(gram_scores[grams[gram_starts[i] : gram_starts[j]]], gram_starts[i:j] - gram_starts[i])
                for i, j in pieces
            ]
        )
        word /= counts
        block = np.add.reduceat(word[stream], block_starts) / spread
        best = np.array(
            [s + block[s:e].argmax() for s, e in zip(text_starts, np.append(text_starts[1:], len(block)))]
        )
        z = SCALE * block[best] + bias[1] - bias[0]
        slope = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[held])
        # Back through the averages: to blocks, words and n-grams.
        per_word = np.repeat(SCALE * slope / spread[best], sizes[best])
        at = np.repeat(block_starts[best], sizes[best]) + np.concatenate([np.arange(k) for k in sizes[best]])
        on_words = np.bincount(stream[at], per_word, len(counts))
        on_grams = np.zeros(BUCKETS)
        for i, j in pieces:
            pull = np.repeat(on_words[i:j] / counts[i:j], counts[i:j])
            on_grams += np.bincount(grams[gram_starts[i] : gram_starts[j]], pull, BUCKETS)
        pull = table.T @ on_grams
        grads = (
            on_grams[:, None] * toward + SHRINK * table,
            np.stack([-pull, pull], axis=1),
            np.array([-slope.sum(), slope.sum()]),
        )
        for p, g, (m, v) in zip((table, out, bias), grads, state):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(table @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> Model:
    """Fit on the bounded sample of labelled training rows of ``docs``."""
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna()
    marked = marked.filter(remainder(F.col("doc_id"), FOLDS) != 0)
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    drawn = [marked.filter(F.col("toxic") == k).orderBy(order, "doc_id").limit(n) for k, n in sample.items()]
    # The draw is bounded by ``sample``, whatever the tables' sizes.
    ids = F.broadcast(drawn[0].unionByName(drawn[1]))
    texts = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    rows = texts.join(ids, "doc_id").select("doc_id", "text", "toxic").collect()
    rows.sort(key=lambda r: (r[0], r[1] or b""))
    return train([bytes(r[1] or b"") for r in rows], [r[2] for r in rows])


def _scorer(model: Model):
    """Scores of a column of texts; words are scored once and remembered, within bounds."""
    cache: dict[bytes, float] = {}

    def scores(texts: pa.Array) -> np.ndarray:
        out = []
        for text in utf8(texts):
            words = distinct(text)
            new = [w for w in words if w not in cache]
            if new:
                if len(cache) > CACHE:
                    cache.clear()
                    new = words
                cache.update(zip(new, model.word_scores(new).tolist()))
            out.append(model.score(np.array([cache[w] for w in words])))
        return np.array(out)

    return scores


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scores = _scorer(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [batch.column(0), batch.column(1), pa.array(scores(batch.column(2)), pa.float64())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score"])

    slim = docs.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    kind = slim.schema["doc_id"].dataType.simpleString()
    scored = map_batches(slim, run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text is predicted toxic; all columns as they were."""
    scores, position = _scorer(model), docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(scores(batch.column(position)) < 0.5))

    return map_batches(docs, run, docs.schema)
