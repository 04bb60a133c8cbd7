"""Quality classifier: supervised subword embeddings.

Words, pairs of words (their hashes combined by exclusive or, so that a word and itself make one pair of all words)
and character n-grams of words, all hashed, each have a learned vector; a document is the mean of the vectors of all its
words and n-grams; a softmax layer gives the label's probability; everything is trained by stochastic gradient descent
in numpy. Scoring multiplies each vector with the softmax layer once, so a document's score is a mean of one number
a feature, in one pass over whole texts.

Words are lower-cased (A-Z); n-grams are of whole characters and take a word with one space before and after it, so they
mark its ends and never span two words.

The model is fitted on at most ``sample`` labelled rows (a documented bound; the rows are those of the smallest hash of
their id, so the choice doesn't depend on order), with all features of their whole texts, and every row is scored. The
features of the sample are kept in a file of the driver while it is fitted, so memory grows with one batch only. Texts
that are null or empty get the score of the bias alone. Rows without label are not learned from; with none, all scores
are 0.5. A document with several labels is learned from once for each; repeated rows are scored each, and equal texts
score the same. Very long texts have at most N_FEATURES distinct features. Extra columns are not read; empty tables give
empty results.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language_id import held_out
from .textblocks import _SPACE, Words, blocks, mix, reduce_texts

WORD_BITS = PAIR_BITS = NGRAM_BITS = 15
N_FEATURES = (1 << WORD_BITS) + (1 << PAIR_BITS) + (1 << NGRAM_BITS)
#: Lengths in characters of the n-grams, spaces at word ends included.
NGRAMS = (3, 5)
DIM = 8
#: Features of no weight that each mean includes, so that a few words don't decide.
PRIOR = 16
#: Labelled rows that the model is fitted on at most, and those that reach the driver at a time.
SAMPLE, ROWS_AT_ONCE = 6000, 500


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(feature numbers, bounds of each text's) for words, pairs and each n-gram length."""
    words = Words(data, offsets)
    out = [((words.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64), words.bounds)]
    text = words.text_of()
    same = text[1:] == text[:-1]
    pairs = mix(words.hash[1:] ^ words.hash[:-1])[same] >> np.uint64(64 - PAIR_BITS)
    out.append((pairs.astype(np.int64) + (1 << WORD_BITS), np.concatenate([[0], np.cumsum(np.maximum(words.counts - 1, 0))])))
    code, at = characters(words.data, offsets)
    text_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    blank = code == 0x20
    for n in NGRAMS:
        m = max(len(code) - n + 1, 0)
        h = np.zeros(m, np.uint32)
        for k in range(n):
            h = h * np.uint32(0x01000193) ^ code[k : k + m]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
        h >>= np.uint32(32 - NGRAM_BITS)
        keep = text_of[:m] == text_of[n - 1 : n - 1 + m]
        for k in range(1, n - 1):
            keep &= ~blank[k : k + m]
        where = np.flatnonzero(keep)
        out.append((h[where].astype(np.int64) + (1 << WORD_BITS) + (1 << PAIR_BITS), np.searchsorted(where, at)))
    return out


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each character of UTF-8 texts (white space as one space each), and bounds of the texts' characters."""
    first = np.flatnonzero((data & 0xC0) != 0x80)
    code = data[first].astype(np.uint32)
    code[_SPACE[data[first]]] = 0x20
    if len(first) < len(data):
        size = np.diff(np.append(first, len(data)))
        for k in (1, 2, 3):
            longer = np.flatnonzero(size > k)
            code[longer] = code[longer] * np.uint32(0x01000193) ^ data[first[longer] + k]
    return code, np.searchsorted(first, offsets)


def training_rows(rows: DataFrame) -> DataFrame:
    """(label, f binary, x binary) of rows (text, label): feature numbers (int32) and their shares of the document (float32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, x = [], []
            for _, data, offsets in blocks(b.column(0)):
                parts = features(data, offsets)
                for i in range(len(offsets) - 1):
                    got, n = np.unique(np.concatenate([v[a[i] : a[i + 1]] for v, a in parts]), return_counts=True)
                    f.append(got.astype(np.int32).tobytes())
                    x.append((n / (n.sum() + PRIOR)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(f, pa.binary()), pa.array(x, pa.binary())], ["label", "f", "x"])

    return rows.mapInArrow(run, "label int, f binary, x binary")


def train(label: np.ndarray, f: list[np.ndarray], x: list[np.ndarray], epochs: int | None = None, rate: float = 2.0, batch: int = 16) -> tuple[np.ndarray, float]:
    """Stochastic gradient descent on the vectors and the softmax layer; returns (one number a feature, bias): their mean and sum is the logit."""
    rng = np.random.default_rng(7)
    e = rng.uniform(-1 / DIM, 1 / DIM, (N_FEATURES, DIM)).astype(np.float32)
    w, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    n = len(label)
    epochs = epochs or max(8, min(200, 40_000 // n))  # few rows are gone over more often
    steps, step = max(1, epochs * ((n + batch - 1) // batch)), 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, batch):
            pick = order[k : k + batch]
            lr = np.float32(rate * (1 - step / steps))
            step += 1
            sizes = np.array([len(f[i]) for i in pick])
            rows, share = np.concatenate([f[i] for i in pick]), np.concatenate([x[i] for i in pick])
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            mean = reduce_texts(np.add, e[rows] * share[:, None], bounds, 0)
            z = mean @ w + bias
            z = np.exp(z - z.max(1, keepdims=True))
            g = z / z.sum(1, keepdims=True)
            g[np.arange(len(pick)), label[pick]] -= 1
            g /= len(pick)
            back = g @ w.T
            w -= lr * mean.T @ g
            bias -= lr * 0.1 * g.sum(0)
            scale = lr * 40.0  # a document's mean moves by the shares of its features only
            np.subtract.at(e, rows, scale * share[:, None] * np.repeat(back, sizes, axis=0))
    score = e @ w
    return (score[:, 1] - score[:, 0]).astype(np.float32), float(bias[1] - bias[0])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float] | None:
    """The model from rows (id, text, label in 0 and 1); at most ``sample`` of them reach the driver, a partition at a time."""
    chosen = labelled.orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    rows = training_rows(chosen.select("text", "label").repartition(max(1, sample // ROWS_AT_ONCE)))
    label, keys, sizes = [], [], []
    with tempfile.TemporaryFile() as numbers, tempfile.TemporaryFile() as shares:
        for r in rows.toLocalIterator():
            f, x = np.frombuffer(r.f, np.int32), np.frombuffer(r.x, np.float32)
            label.append(r.label)
            keys.append((r.label, int(f.sum(dtype=np.int64)), float(x[:8].sum())))
            sizes.append(len(f))
            numbers.write(r.f)
            shares.write(r.x)
        if not label:
            return None
        ends = np.cumsum(sizes)
        if not ends[-1]:
            return train(np.array(label), [np.empty(0, np.int32)] * len(label), [np.empty(0, np.float32)] * len(label))
        numbers.flush()
        shares.flush()
        flat = [np.memmap(file, kind, "r") for file, kind in ((numbers, np.int32), (shares, np.float32))]
        order = sorted(range(len(label)), key=keys.__getitem__)
        f, x = ([part[ends[i] - sizes[i] : ends[i]] for i in order] for part in flat)
        return train(np.array(label)[order], f, x)


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score), a row for each row, one pass over whole texts."""
    weights, bias = model or (np.zeros(N_FEATURES, np.float32), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for _, data, offsets in blocks(b.column(0)):
                total, n = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
                for v, bounds in features(data, offsets):
                    total += reduce_texts(np.add, weights[v].astype(np.float64), bounds, 0)
                    n += np.diff(bounds)
                out.append(1 / (1 + np.exp(-np.clip(total / (n + PRIOR) + bias, -30, 30))))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())], [*b.schema.names[1:], "score"])

    rows = docs.select(docs[text_col].cast("string").alias("__text"), docs[id_col], F.coalesce(held_out(docs[id_col]), F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, rows.drop("__text").schema.simpleString()[7:-1] + ", score double")


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """(id, held_out, score, predicted): fitted on the labelled rows that aren't held out, applied to all.

    The labels are cut down to the sample before the join, so the join moves no more than the labels' ids."""
    known = labels.where(labels[label_col].isin(0, 1) & labels[id_col].isNotNull() & ~held_out(labels[id_col])).select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).join(chosen, "id")
    return score(docs, fit(rows, sample), id_col, text_col).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))
