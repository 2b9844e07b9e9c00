"""Quality classifier: supervised subword embeddings.

Each word stands for the hashed vectors of itself and of its character n-grams, and a pair of
equal words in a row for one vector more (the one word bigram that says something of words never
seen); a document is the average of all its vectors, followed by a softmax layer.  Vectors and layer
are learned by stochastic gradient descent in numpy, on the driver, from a bounded sample of
labelled texts.  Scoring sends the model (fixed size: buckets x 4 bytes) to the executors.

The layer is linear, so a document's logit is the average, over its vectors, of their projection
on the layer: executors keep one number a bucket, and a word's sum once computed.

Results: texts that are null, empty or blank score the share of label 1 the model learned
without features (the softmax of the bias).  Labels other than 0 and 1, and documents with
contradicting labels, are not learned from.
"""

from __future__ import annotations

import hashlib
import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.llm.common import WordCache, kept, slices, texts_of, tidy, unused

# Words whose projections a worker remembers.
CACHED = 200_000

FOLDS, HELD_OUT = 5, 0


@dataclass(frozen=True)
class Settings:
    """``sample``: labelled documents learned from at most, those of smallest hash;
    ``longest``: longer labelled texts (characters) are not learned from, so that the sample
    fits the driver.  Neither limits what is scored."""

    buckets: int = 1 << 18
    width: int = 8
    shortest: int = 2
    longest_gram: int = 4
    epochs: int = 4
    rate: float = 0.5
    sample: int = 2_000
    longest: int = 10_000
    keep: float = 0.3
    seed: int = 7


def word_buckets(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, place of its word) of all ``words`` and of their character n-grams, borders marked."""
    marked = [f"<{w}>" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.array([len(m) for m in marked], dtype=np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))  # characters to the word's end
    whole = np.array([zlib.crc32(m.encode("utf-8", "surrogatepass")) for m in marked], dtype=np.int64)
    buckets, owners = [whole % s.buckets], [np.arange(len(words))]
    gram = points
    for n in range(2, s.longest_gram + 1):
        gram = gram[:-1] * np.uint64(0x100000001B3) + points[n - 1 :] if len(gram) else gram
        if n >= s.shortest:
            at = np.flatnonzero(left[: len(gram)] >= n)
            mixed = (gram[at] ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            buckets.append(((mixed >> np.uint64(32)) % np.uint64(s.buckets)).astype(np.int64))
            owners.append(owner[at])
    return np.concatenate(buckets), np.concatenate(owners)


def repeats(words: list[str]) -> int:
    """How often a word follows itself."""
    return sum(map(operator.eq, words, words[1:]))


def repeat_bucket(s: Settings) -> int:
    return zlib.crc32(b"<same word again>") % s.buckets


@dataclass
class Model:
    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    settings: Settings

    def projected(self) -> tuple[np.ndarray, float]:
        """Per bucket, and for the bias: how far it moves the logit of label 1 over label 0."""
        return (self.vectors @ (self.layer[1] - self.layer[0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def fit(texts: list[str], labels: list[int], s: Settings = Settings()) -> Model:
    """Plain stochastic gradient descent, one document a step, the rate falling to nothing."""
    rng = np.random.default_rng(s.seed)
    vectors = ((rng.random((s.buckets, s.width)) - 0.5) / s.width).astype(np.float32)
    layer, bias = np.zeros((2, s.width), dtype=np.float32), np.zeros(2, dtype=np.float32)
    split = [t.split() for t in texts]
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for d in split for w in d))}
    buckets, owners = word_buckets(list(vocabulary), s)
    order = np.argsort(owners, kind="stable")
    of_word = np.split(buckets[order], np.cumsum(np.bincount(owners, minlength=len(vocabulary)))[:-1])
    bags = []
    for words in split:
        ids = np.concatenate([np.full(repeats(words), repeat_bucket(s)), *(of_word[vocabulary[w]] for w in words)])
        found, counts = np.unique(ids.astype(np.int64), return_counts=True)
        bags.append((found, (counts / max(1, len(ids))).astype(np.float32)))
    steps, done = s.epochs * len(bags), 0
    for _ in range(s.epochs):
        for k in rng.permutation(len(bags)):
            ids, share = bags[k]
            rate = s.rate * (1 - done / steps)
            done += 1
            mean = share @ vectors[ids]
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = layer.T @ p
            layer -= rate * np.outer(p, mean)
            bias -= 0.1 * rate * p
            # Shares are small numbers; the length of the bag keeps rare grams moving.
            vectors[ids] -= (rate * len(ids) ** 0.5) * np.outer(share, back)
    return Model(vectors, layer, bias, s)


def training_rows(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """(text, quality) of the sample: labelled, outside the held-out fold, of smallest hash.

    The sample is chosen from the label table alone, so documents are read once, against at
    most ``2 * sample`` ids.
    """
    chosen = (
        labels.select("doc_id", "quality")
        .where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("_other"))
        .where((F.col("quality") == F.col("_other")) & ~held_out("doc_id"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(2 * s.sample)
        .select("doc_id", "quality")
    )
    return (
        docs.select("doc_id", "text")
        .where(F.length("text").between(1, s.longest))
        .join(F.broadcast(chosen), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "text")
        .limit(s.sample)
        .select("text", "quality")
    )


def held_out(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    rows = training_rows(docs, labels, s).toArrow()
    return fit(rows.column("text").to_pylist(), rows.column("quality").to_pylist(), s)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1."""
    weights, bias = model.projected()
    s = model.settings
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    name = hashlib.sha256(weights.tobytes()).hexdigest()
    docs = docs.drop(out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value

        def measure(words: list[str]) -> list[complex]:
            """Sum of each word's projections, and (imaginary) how many they are."""
            buckets, owners = word_buckets(words, s)
            sums = np.bincount(owners, weights=weights[buckets], minlength=len(words))
            return (sums + 1j * np.bincount(owners, minlength=len(words))).tolist()

        cache = kept(("quality", name), lambda: WordCache(measure, CACHED))
        for batch in batches:
            for part in slices(batch, text):
                words = [t.split() for t in texts_of(part, text)]
                values = np.array(cache.of([w for d in words for w in d]), dtype=np.complex128)
                ends = np.cumsum([len(d) for d in words])
                # One sum a document: sums of a running total would depend on the neighbours.
                sums = np.array([values[e - len(d) : e].sum() for d, e in zip(words, ends.tolist())])
                again = np.array([repeats(d) for d in words])
                sums += again * complex(weights[repeat_bucket(s)], 1)
                logit = sums.real / np.maximum(sums.imag, 1) + bias
                made = pa.array(1 / (1 + np.exp(-logit)), type=pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, out])

    return docs.mapInArrow(tidy(run), schema)


def classify(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = train(docs, labels, s)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= s.keep).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents the classifier does not reject, their columns unchanged."""
    name = unused(docs, "score")
    return score(docs, train(docs, labels, s), out=name).where(F.col(name) >= s.keep).drop(name)
