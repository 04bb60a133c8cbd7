"""Language identification as mixture inference over n-gram likelihoods.

Each language has a distribution over hashed byte trigrams (of lower-cased text in which everything but letters is
one space), counted over all training rows by Spark. A document's trigrams are taken as draws from a mixture of the
languages; expectation-maximisation estimates its proportions, once for each nested set of its likeliest languages,
and the set with the best penalised likelihood (BIC) is kept. The prediction is the language of the largest
proportion and the score is that proportion.

Texts: a null text, or one without any letter, is ``und`` with score 0. Rows with null languages are not learned from.
With no training row at all, every text is ``und``. Texts are used whole, very long ones too; repeated rows count as
often as they occur. Of languages of equal proportion the first by name is predicted. Empty tables give empty results.
Extra columns are not read, and columns that are kept may have any names but those of the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textblocks import blocks, reduce_texts

BUCKETS = 1 << 13
#: The model has BUCKETS numbers a language and is sent to every executor; more languages than this are an error.
MOST_LANGUAGES = 512
ROUNDS = 12
UNKNOWN = "und"

_CLASS = np.full(256, 0x20, np.uint8)
_CLASS[0x61:0x7B] = np.arange(0x61, 0x7B)
_CLASS[0x41:0x5B] = np.arange(0x61, 0x7B)
_CLASS[0x80:] = np.arange(0x80, 0x100)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of each text and their bounds; trigrams of two spaces or more are left out."""
    c = _CLASS[data]
    h = c.astype(np.uint32)
    h = (h[:-2] * np.uint32(0x9E3779B1) ^ h[1:-1] * np.uint32(0x85EBCA77)) + h[2:] * np.uint32(0xC2B2AE3D) if len(c) > 2 else np.empty(0, np.uint32)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(19)
    ok = np.ones(len(h), bool)
    blank = c == 0x20
    if len(h):
        ok &= (blank[:-2].astype(np.int8) + blank[1:-1] + blank[2:]) < 2
        for back in (1, 2):  # trigrams over a text's end
            ends = offsets[1:-1] - back
            ok[ends[(ends >= 0) & (ends < len(ok))]] = False
    at = np.flatnonzero(ok)
    return h[at].astype(np.int64), np.searchsorted(at, offsets)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def count_trigrams(train: DataFrame) -> DataFrame:
    """(lang, bucket, n) over the rows (text, lang); each task sends one row a language and bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(1).to_pylist()
            for i, data, offsets in blocks(b.column(0)):
                h, bounds = trigrams(data, offsets)
                names, place = np.unique(np.array(langs[i : i + len(offsets) - 1], dtype=object).astype(str), return_inverse=True)
                if len(names) > MOST_LANGUAGES:
                    raise ValueError("more languages than the model has room for")
                counts = np.bincount(np.repeat(place, np.diff(bounds)) * BUCKETS + h, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for name, c in zip(names.tolist(), counts, strict=True):
                    total[name] = total[name] + c if name in total else c
        for name, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at].astype(np.int64))], ["lang", "bucket", "n"])

    return train.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn(train: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their bucket distributions, from rows (text, lang). At most MOST_LANGUAGES * BUCKETS counts reach the driver."""
    counts = count_trigrams(train)
    rows = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError("more languages than the model has room for")
    rows.sort(key=lambda r: r.lang)
    model = np.full((BUCKETS, len(rows)), 0.5)
    for k, row in enumerate(rows):
        for bucket, n in row.c:
            model[bucket, k] += n
    return [r.lang for r in rows], (model / model.sum(0)).astype(np.float32)


def _mixture(p: np.ndarray, n: np.ndarray, bounds: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents x languages) after expectation-maximisation from w, and log-likelihoods. p: rows x languages, n: counts."""
    size = np.diff(bounds)
    total = np.maximum(reduce_texts(np.add, n, bounds, 0), 1)
    for _ in range(ROUNDS):
        share = p * np.repeat(w, size, axis=0)
        share *= (n / np.maximum(share.sum(1), 1e-30))[:, None]
        w = reduce_texts(np.add, share, bounds, 0) / total[:, None]
    like = np.log(np.maximum((p * np.repeat(w, size, axis=0)).sum(1), 1e-30)) * n
    return w, reduce_texts(np.add, like, bounds, 0)


def infer(p: np.ndarray, n: np.ndarray, bounds: np.ndarray, first: int = 3) -> np.ndarray:
    """Proportions of each document in the language set of the best penalised likelihood, among nested sets.

    All documents try sets of up to ``first`` languages; a document goes on to larger ones while the last was the best
    yet, or the likelihood of all languages leaves room for a better one."""
    docs, langs = len(bounds) - 1, p.shape[1]
    size = np.diff(bounds)
    full, limit = _mixture(p, n, bounds, np.full((docs, langs), 1 / langs, np.float32))
    order = np.argsort(-full, axis=1, kind="stable")
    penalty = np.log(np.maximum(reduce_texts(np.add, n, bounds, 0), 2)) / 2
    best, chosen = np.full(docs, -np.inf), full.copy()
    live = np.arange(docs)
    for k in range(1, langs + 1):
        if not len(live):
            break
        rows = np.repeat(np.isin(np.arange(docs), live), size)
        top, some, many = order[live, :k], n[rows], np.concatenate([[0], np.cumsum(size[live])])
        part = np.take_along_axis(p[rows], np.repeat(top, size[live], axis=0), axis=1)
        start = np.take_along_axis(full[live], top, axis=1) + np.float32(1e-3)
        start /= start.sum(1, keepdims=True)
        if k == 1:
            w, like = start, reduce_texts(np.add, np.log(part[:, 0]) * some, many, 0)
        else:
            w, like = _mixture(part, some, many, start)
        value = like - penalty[live] * (k - 1)
        better = value > best[live]
        best[live] = np.where(better, value, best[live])
        wide = np.zeros((len(live), langs), full.dtype)
        np.put_along_axis(wide, top, w.astype(wide.dtype), axis=1)
        chosen[live] = np.where(better[:, None], wide, chosen[live])
        if k >= first:
            live = live[better | (limit[live] - penalty[live] * k > best[live])]
    return chosen


def predict(docs: DataFrame, languages: list[str], model: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] = ()) -> DataFrame:
    """docs' id, the columns in ``keep``, lang_pred, score and proportions (map); a row for each row, one pass, no shuffle.

    Only texts go to Python, once, and only predictions come back; the other columns stay in the JVM."""

    @F.arrow_udf("struct<lang_pred:string,score:double,proportions:map<string,double>>")
    def mixture(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            pred, score, props = [], [], []
            for i, data, offsets in blocks(texts):
                n_docs = len(offsets) - 1
                best, weight, w = [UNKNOWN] * n_docs, np.zeros(n_docs), np.zeros((n_docs, len(languages)))
                letters = reduce_texts(np.logical_or, (_CLASS[data] != 0x20) & (data < 0x80), offsets, False)
                for k in np.flatnonzero(~letters):
                    letters[k] = has_letter(texts[i + int(k)].as_py())
                if languages:
                    h, bounds = trigrams(data, offsets)
                    key, n = np.unique(np.repeat(np.arange(n_docs), np.diff(bounds)) * BUCKETS + h, return_counts=True)
                    w = infer(model[key % BUCKETS], n.astype(np.float32), np.searchsorted(key, np.arange(n_docs + 1) * BUCKETS))
                    top = w.argmax(1)
                    best = [languages[t] if ok else UNKNOWN for t, ok in zip(top.tolist(), letters.tolist(), strict=True)]
                    weight = np.where(letters, w[np.arange(n_docs), top], 0).clip(0, 1)
                pred += best
                score += weight.astype(float).tolist()
                props += [[(la, float(x)) for la, x in zip(languages, r, strict=True) if x > 0.01] if ok else [] for r, ok in zip(w.tolist(), letters.tolist(), strict=True)]
            yield pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(props, pa.map_(pa.string(), pa.float64()))], ["lang_pred", "score", "proportions"])

    rows = docs.select(docs[id_col], *keep, mixture(docs[text_col].cast("string")).alias("__mixture"))
    return rows.select(*(F.col(f"`{c}`") for c in rows.columns[:-1]), "__mixture.lang_pred", "__mixture.score", "__mixture.proportions")


def held_out(id_col: Column) -> Column:
    """Whether a row is held out of training: crc32 of the id as text is divisible by 5."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score, proportions), learned from the rows of docs that aren't held out and have a language."""
    out = held_out(docs[id_col])
    train = docs.where(~out & docs[lang_col].isNotNull()).select(docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    languages, model = learn(train)
    return predict(docs, languages, model, id_col, text_col, [F.coalesce(out, F.lit(False)).alias("held_out")])
