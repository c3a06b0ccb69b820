"""Toxicity scores from a subword-bag model: averaged n-gram embeddings and a linear softmax.

A word is the bag of itself and its character n-grams, hashed to buckets that share
one embedding table, so a misspelling that was never seen still meets the n-grams of
the word that it comes from. A document is the average of its n-grams' embeddings, and
a softmax is linear in that. The vocabulary has the n-grams that toxic documents have
more often than chance explains; others are not part of the average, so that a long
document with a few toxic words is not averaged away. Table and softmax are trained
together in numpy, in one task, on a bounded sample of labelled documents; the table is
then a number for each bucket, as the softmax is linear, and scoring is a lookup for
each word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.llm.text import ASCII_LOWER, as_bytes

#: Words that a worker remembers, but for those of the documents at hand, and documents scored together.
REMEMBERED, TOGETHER = 400_000, 64
#: Bytes of the words that a worker remembers, and of those that it hashes at once, if they are several.
REMEMBERED_BYTES, HASHED_BYTES = 1 << 25, 1 << 20
TRIM = b".,;:!?\"'()[]{}|#*$%&<>"


@dataclass(frozen=True)
class Settings:
    """sample_rows: labelled documents that the model is fitted on at most, the smallest hashes first, each with its whole text.

    deviations: how many standard deviations an n-gram is in more toxic documents than
    its share of all to be in the vocabulary. epochs, rate: of the training, whose steps
    get smaller up to the end.
    """

    sample_rows: int = 3000
    buckets: int = 1 << 17
    width: int = 8
    shortest: int = 3
    longest: int = 5
    deviations: float = 2.5
    epochs: int = 15
    rate: float = 4.0
    seed: int = 7


def gram_buckets(words: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of each word itself and of its character n-grams, with marks for its two ends.

    All words are hashed together as one row of code points, whole however long they are.
    A word of marks alone has no buckets.
    """
    texts = [w.translate(ASCII_LOWER).strip(TRIM).decode("utf-8", "replace") for w in words]
    texts = [f"<{t}>" if t else "" for t in texts]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # code points up to the word's end
    mixed = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    owners, hashes = [], []
    for n in range(1, s.longest + 1):
        mixed = mixed if n == 1 else (mixed[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) + (codes[n - 1 :] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        if n >= s.shortest:
            fits = left[: len(mixed)] >= n
            owners.append(owner[: len(mixed)][fits])
            hashes.append(mixed[fits] + np.uint64(n))
        if len(mixed) <= 1:
            break
    some = np.flatnonzero(sizes)
    placed = (codes * np.uint64(0xD6E8FEB86659FD93)) ^ (left.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    placed *= placed | np.uint64(1)
    owners.append(some)
    hashes.append(np.add.reduceat(placed, (np.cumsum(sizes) - sizes)[some]) if len(some) else np.empty(0, np.uint64))
    h = np.concatenate(hashes)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xE7037ED1A0B428DB)
    return np.concatenate(owners), ((h >> np.uint64(33)) % np.uint64(s.buckets)).astype(np.int32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def bag(data: bytes, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The different buckets of a whole text and how often it has each."""
    times = Counter(data.split())
    words, n = list(times), np.fromiter(times.values(), np.float64, len(times))
    counts = np.zeros(s.buckets)
    for part in _parts(words):
        at, buckets = gram_buckets([words[k] for k in part], s)
        counts += np.bincount(buckets, n[part][at], s.buckets)
    some = np.flatnonzero(counts)
    return some, counts[some]


def _parts(words: list[bytes]) -> list[np.ndarray]:
    """Places of words in parts that are hashed at once."""
    sizes = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) // HASHED_BYTES
    return np.split(np.arange(len(words)), np.flatnonzero(np.diff(sizes)) + 1) if words else []


def vocabulary(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, s: Settings) -> np.ndarray:
    """Whether a bucket is in the vocabulary: it is in more toxic documents than as many documents have by chance."""
    every, toxic = np.zeros(s.buckets), np.zeros(s.buckets)
    for (buckets, _), label in zip(bags, labels, strict=True):
        every[buckets] += 1
        toxic[buckets] += label
    share = labels.mean() if len(labels) else 0.0
    return toxic - every * share >= s.deviations * np.sqrt(every * share * (1 - share) + 1)


def train(texts: list[bytes], labels: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Weight of each bucket, NaN outside the vocabulary, and bias, from embeddings and a softmax fitted together.

    Two classes make the softmax a sigmoid of the difference of their logits, which
    `out` holds; bucket weights are the embeddings times it. A step moves embeddings and
    softmax along the gradient, as far as moves the document's own logit by its error
    times the rate (normalised least mean squares), so that long and short documents
    count alike. Texts without an n-gram of the vocabulary, empty ones too, teach the
    bias alone; no texts, or one label alone, give an empty vocabulary and a bias. Repeated
    and equal texts count each.
    """
    rng = np.random.default_rng(s.seed)
    bags = [bag(data, s) for data in texts]
    known = vocabulary(bags, labels, s)
    place = np.cumsum(known) - 1
    rows = [(place[b[keep]], (c[keep] / max(1.0, c[keep].sum())).astype(np.float32)) for b, c in bags for keep in [known[b]]]
    table = rng.normal(0, 0.1 / s.width, (int(known.sum()), s.width)).astype(np.float32)
    out = rng.normal(0, 1 / np.sqrt(s.width), s.width).astype(np.float32)
    prior = float(np.clip(labels.mean(), 1e-3, 0.999)) if len(labels) else 0.01
    bias = float(np.log(prior / (1 - prior)))
    for epoch in range(s.epochs):
        rate = s.rate * (1 - epoch / s.epochs)
        for k in rng.permutation(len(rows)):
            at, x = rows[k]
            mean = x @ table[at]
            error = float(_sigmoid(float(mean @ out) + bias) - labels[k])
            bias -= 0.01 * rate * error
            if len(at):
                step = rate * error / float((x @ x) * (out @ out) + mean @ mean)
                table[at] -= (step * x)[:, None] * out[None, :]
                out -= step * mean
    weight = np.full(s.buckets, np.nan, np.float32)
    weight[known] = table @ out
    return weight, float(bias)


class Scorer:
    """Scores of texts; the sum and the count of a word's bucket weights are remembered as one complex number."""

    def __init__(self, weight: np.ndarray, bias: float, s: Settings):
        self.weight, self.bias, self.s = weight, bias, s
        self.known: dict[bytes, complex] = {}
        self.held = 0

    def _learn(self, words: set[bytes]) -> None:
        new = list(words - self.known.keys())
        self.held += sum(map(len, new))
        if len(self.known) + len(new) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.known.clear()
            new = list(words)
            self.held = sum(map(len, new))
        for part in _parts(new):
            some = [new[k] for k in part]
            at, buckets = gram_buckets(some, self.s)
            weight = self.weight[buckets]
            inside = ~np.isnan(weight)
            at, weight = at[inside], weight[inside]
            sums = np.bincount(at, weight, len(some)) + 1j * np.bincount(at, minlength=len(some))
            self.known.update(zip(some, sums.tolist(), strict=True))

    def scores(self, texts: list[bytes]) -> list[float]:
        split = [x.split() for x in texts]
        self._learn(set().union(*split))
        return [self._score(words) for words in split]

    def _score(self, words: list[bytes]) -> float:
        total = sum(map(self.known.__getitem__, words), 0j)
        return float(_sigmoid(total.real / max(1.0, total.imag) + self.bias))


def _held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> tuple[np.ndarray, float]:
    """The model of `labels.toxic`, from rows that are not held out.

    At most `sample_rows` labelled documents are used, those with the smallest hashes of
    their ids, each with its whole text, of which a task keeps counts of buckets; they
    go to one task, which returns the weights. A document with several labels is toxic if one
    says so, of rows that repeat a doc_id the smallest text counts, and null ids and
    labels are none.
    """
    train_ids = labels.where(~_held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    train_ids = train_ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample_rows)
    # at most sample_rows ids
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(train_ids), "doc_id")
    chosen = chosen.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic", F.xxhash64("doc_id").alias("order"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            ids, toxic, order = (batch.column(k).to_pylist() for k in (0, 2, 3))
            rows += [(h, i, data or b"", int(t)) for h, i, data, t in zip(order, ids, as_bytes(batch.column(1)), toxic, strict=True)]
        rows.sort()
        weight, bias = train([x[2] for x in rows], np.array([x[3] for x in rows], float), s)
        yield pa.RecordBatch.from_arrays([pa.array([weight.tobytes()], pa.binary()), pa.array([bias])], names=["weight", "bias"])

    found = chosen.repartition(1).mapInArrow(run, "weight binary, bias double").collect()
    if not found:  # no partition, no rows
        return train([], np.empty(0), s)
    return np.frombuffer(found[0]["weight"], np.float32), found[0]["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], s: Settings = Settings()) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of `docs`.

    Whole texts are scored, each row by itself, so that repeated ids and equal texts
    need no rule. A null or empty text, or one without an n-gram of the vocabulary, gets
    the score of the bias alone. Extra columns
    are dropped.
    """
    weight, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weight, bias, s)
        for batch in batches:
            texts = [data or b"" for data in as_bytes(batch.column(2))]
            p = [x for k in range(0, len(texts), TOGETHER) for x in scorer.scores(texts[k : k + TOGETHER])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", _held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
