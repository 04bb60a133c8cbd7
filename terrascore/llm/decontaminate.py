"""Benchmark decontamination with SimHash windows.

Every benchmark item has a SimHash fingerprint of its weighted shingles (``SHINGLE`` words, weighted by how often they
occur in it). Every document is read through windows of the items' own sizes, moved word by word, and each window has a
fingerprint of the same kind. Fingerprints are cut into blocks, indexed once for each block: two fingerprints within
``RADIUS`` bits agree in some block up to ``RADIUS // BLOCKS`` bits (pigeonhole), so the blocks' neighbourhoods find
every item within the radius. Candidates are then held against the item exactly: the weighted Jaccard similarity of the
shingles, the sum of smaller over the sum of larger weights, must reach ``SIMILARITY``.

Before that, windows that cannot reach the similarity are passed over: the similarity can't be higher than the share of
the window's shingles that belong to the benchmark at all, so a window with fewer than that share isn't fingerprinted.
This is a necessary condition and loses nothing. The items' index goes to every task; the benchmark's size is checked
(``MOST_ITEM_WORDS``), and a larger one is worked through in parts of that size, each in one pass over the documents.

Texts: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Items without words are left out; an item of fewer words
than a shingle is one shingle. Null and empty documents have no windows and stay. A document of fewer shingles
than an item is one window for it, which can reach the similarity from SIMILARITY times the item's shingles on; shorter
ones can't. Repeated rows and null ids give results of their own; of equal windows the first is reported. Of a very
long text WINDOW_SHINGLES are held in windows at a time. Empty tables give empty results. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut
from .textblocks import Words, blocks, combine, mix

SHINGLE = 5
SIMILARITY = 0.8
BITS, BLOCKS, RADIUS = 64, 8, 23
#: Words of items that one index holds.
MOST_ITEM_WORDS = 1_000_000
#: Shingles of the windows that are held at a time.
WINDOW_SHINGLES = 1 << 18

_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def fingerprints(runs: np.ndarray) -> np.ndarray:
    """SimHash of each row of shingle hashes: every shingle votes on each bit, as often as it occurs."""
    n, size = runs.shape
    out = np.empty(n, np.uint64)
    for k in range(0, n, 2048):
        part = np.ascontiguousarray(runs[k : k + 2048])
        votes = np.unpackbits(part.view(np.uint8).reshape(len(part), size, 8), axis=2).sum(1, dtype=np.int32)
        out[k : k + 2048] = np.packbits(2 * votes > size, axis=1).view(np.uint64).ravel()
    return out


def hamming(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _POPCOUNT[(x ^ y).view(np.uint8).reshape(-1, 8)].sum(1, dtype=np.int32)


class Index:
    """Benchmark items by the blocks of their fingerprints; each block value lists the items within RADIUS // BLOCKS bits of it."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids: list[int] = []
        self.shape: list[tuple[int, int]] = []  # words in a shingle, shingles
        self.weights: list[tuple[np.ndarray, np.ndarray]] = []
        prints: list[np.ndarray] = []
        for first, data, offsets in blocks(pa.array(texts, pa.string())):
            words = Words(data, offsets)
            for i in range(len(offsets) - 1):
                run = words.hash[words.bounds[i] : words.bounds[i + 1]]
                if len(run):
                    s = mix(combine(run, min(SHINGLE, len(run))))
                    self.ids.append(ids[first + i])
                    self.shape.append((min(SHINGLE, len(run)), len(s)))
                    self.weights.append(np.unique(s, return_counts=True))
                    prints.append(fingerprints(s[None, :]))
        self.prints = np.concatenate(prints) if prints else np.empty(0, np.uint64)
        self.sizes = sorted(set(self.shape))
        self.place = np.array([self.sizes.index(x) for x in self.shape], np.int64)
        self.known = {n: np.unique(np.concatenate([w[0] for w, x in zip(self.weights, self.shape, strict=True) if x[0] == n])) for n in {x[0] for x in self.sizes}}
        self.filter = {}
        for n, values in self.known.items():
            self.filter[n] = np.zeros(1 << 22, bool)
            self.filter[n][values >> np.uint64(42)] = True
        near = [np.flatnonzero(_POPCOUNT[np.arange(256) ^ v] <= RADIUS // BLOCKS) for v in range(256)]
        parts = self.prints.view(np.uint8).reshape(-1, BLOCKS)
        self.lists = []
        for b in range(BLOCKS):
            lists: list[list[int]] = [[] for _ in range(256)]
            for item, v in enumerate(parts[:, b].tolist()):
                for x in near[v].tolist():
                    lists[x].append(item)
            self.lists.append([np.array(x, np.int64) for x in lists])

    def candidates(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs of one size within the radius, each found in some block."""
        parts = prints.view(np.uint8).reshape(-1, BLOCKS)
        pairs = []
        for b in range(BLOCKS):
            lists = [self.lists[b][v] for v in parts[:, b].tolist()]
            w = np.repeat(np.arange(len(prints)), [len(x) for x in lists])
            i = np.concatenate(lists) if lists else np.empty(0, np.int64)
            same = self.place[i] == size
            w, i = w[same], i[same]
            close = hamming(prints[w], self.prints[i]) <= RADIUS
            pairs.append(w[close] * len(self.ids) + i[close])
        pairs = np.unique(np.concatenate(pairs))
        return pairs // len(self.ids), pairs % len(self.ids)

    def similarity(self, run: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of a window's shingles and an item's."""
        values, counts = np.unique(run, return_counts=True)
        theirs, weights = self.weights[item]
        _, x, y = np.intersect1d(values, theirs, assume_unique=True, return_indices=True)
        both = int(np.minimum(counts[x], weights[y]).sum())
        return both / (len(run) + int(weights.sum()) - both)

    def search(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float, int]]:
        """(text, item, similarity, first word) of the best window of each text and item that reach SIMILARITY."""
        words = Words(data, offsets)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for n, known in self.known.items():
            s = mix(combine(words.hash, n))
            hit = self.filter[n][s >> np.uint64(42)] if len(s) else np.empty(0, bool)
            at = np.flatnonzero(hit)
            at = at[known[np.minimum(np.searchsorted(known, s[at]), len(known) - 1)] == s[at]]
            texts = np.unique(np.searchsorted(words.bounds, at, "right") - 1)
            for t in texts.tolist():
                a, b = int(words.bounds[t]), int(words.bounds[t + 1]) - n + 1
                inside = at[(at >= a) & (at < b)]
                if b <= a or not len(inside):
                    continue
                total = np.zeros(b - a + 1, np.int64)
                total[inside - a + 1] = 1
                total = np.cumsum(total)
                for place, (words_each, size) in enumerate(self.sizes):
                    if words_each != n or total[-1] < SIMILARITY * size - 1e-9:
                        continue
                    width = min(size, b - a)  # a text of fewer shingles than the item is one window
                    start = np.flatnonzero(total[width:] - total[:-width] >= SIMILARITY * size - 1e-9)
                    if not len(start):
                        continue
                    for first in range(0, len(start), max(1, WINDOW_SHINGLES // width)):  # a long text's windows a part at a time
                        some = start[first : first + max(1, WINDOW_SHINGLES // width)]
                        runs = s[a + some[:, None] + np.arange(width)]
                        for w, i in zip(*(x.tolist() for x in self.candidates(fingerprints(runs), place)), strict=True):
                            value = self.similarity(runs[w], i)
                            if value >= SIMILARITY and value > best.get((t, i), (0.0, 0))[0]:
                                best[t, i] = (value, int(some[w]))
        return [(t, i, *v) for (t, i), v in sorted(best.items())]


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, key, item_id, similarity, first_word): for each row of docs and item the best window, if it reaches SIMILARITY.

    key is a 128-bit hash of the text. One pass over docs without a shuffle for each MOST_ITEM_WORDS words of the benchmark."""
    items = benchmark.select(benchmark[item_col].cast("long").alias("i"), benchmark[item_text].cast("string").alias("t")).where("t is not null")
    words = items.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = words // (5 * MOST_ITEM_WORDS) + 1
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")).withColumn("key", F.md5(F.col("text").cast("binary")))
    out = None
    for part in range(parts):
        own = sorted(items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part).collect(), key=lambda r: (r.i is None, r.i, r.t))
        index = docs.sparkSession.sparkContext.broadcast(Index([r.i for r in own], [r.t for r in own]))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            x = index.value
            for b in batches:
                for first, data, offsets in blocks(b.column(1)):
                    found = x.search(data, offsets) if x.ids else []
                    at = pa.array([first + f[0] for f in found], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(at), b.column(2).take(at), pa.array([x.ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.int64())],
                        ["id", "key", "item_id", "similarity", "first_word"],
                    )

        found = rows.mapInArrow(run, f"id {kind}, key string, item_id long, similarity double, first_word long")
        out = found if out is None else out.union(found)
    return out


#: Texts that a broadcast may hold the hashes of; more are joined by a shuffle.
MOST_BROADCAST = 500_000


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text holds a benchmark item; the columns stay as they are."""
    gone = cut(matches(docs, benchmark, id_col, text_col).select("key").distinct())
    if gone.count() <= MOST_BROADCAST:
        gone = F.broadcast(gone)
    return docs.join(gone, F.md5(F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")) == gone["key"], "left_anti")
