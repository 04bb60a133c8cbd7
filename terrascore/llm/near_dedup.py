"""MinHash near-duplicate detection with min-max hashing.

Each of ``PERMUTATIONS`` permutations of the shingle hashes gives two signature values, the least and the greatest, so
half as many hash evaluations are made as values are kept. Signatures are cut into bands; documents of equal bands are
candidates, and every link is confirmed on the full shingle sets (64-bit hashes of whole texts).

No bucket is expanded into rows of pairs:

1. documents of equal sets form one class, a node from here on;
2. in each bucket every member is held against three leaders, the members of smallest hash under three seeds, the same
   in all buckets, so that a group of copies meets few leaders; confirmed links are contracted into components;
3. what is left are buckets that hold several components. Those of more than BLOCK members are first cut by set size:
   sets that can reach the threshold are of one size class or two adjacent ones. Members outside the bucket's largest
   component, the probes, and the others are dealt into blocks bounded in rows and in shingles. A task holds two blocks
   with their texts, compares signatures, and confirms on the full sets the pairs of different components that can
   reach the threshold by their sets' sizes and their estimate, each pair in its first common band only. It returns the
   links that joined two components inside the group: a forest, never more rows than members. The sizes are an exact
   bound; the estimate rules out a pair at the threshold with a chance of MISSED at most, and one above it less often.

Only links between different components are looked for in step 3, which is all that components need.

Texts: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A text of fewer words than a shingle is one shingle; a
null or empty text has none and is linked with nothing. Rows of one id belong to one component, whatever their texts.
A row with a null id takes no part: its component is null and it is kept. Empty tables give empty results, ties are
no case of their own (the smallest id of a component is unique), and columns other than id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import cut, stored
from .textblocks import Words, blocks, distinct, mix, reduce_texts, shingles

PERMUTATIONS = 128
#: Bands take the first BAND * BANDS values; estimates take all.
BAND, BANDS = 4, 24
#: The chance, at most, that a pair at the threshold is ruled out by its estimate.
MISSED = 1e-6
SEEDS = (11, 23, 47)
#: Members of a bucket, and shingles of them, that one block holds, about; two blocks are compared at a time.
BLOCK, BLOCK_SHINGLES = 2048, 500_000
#: Candidates that a probe confirms at a time, best estimates first.
AT_ONCE = 16
#: Nodes that a broadcast may hold; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000

_rng = np.random.default_rng(4)
_MUL = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64)


def least_estimate(percent: int) -> float:
    """The smallest estimate that doesn't rule a pair out: values are equal with the pair's similarity as chance (binomial)."""
    values, share = 2 * PERMUTATIONS, percent / 100
    k, below = 0, (1 - share) ** values
    while below <= MISSED:
        k += 1
        below += math.comb(values, k) * share**k * (1 - share) ** (values - k)
    return k / values


def signatures(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, hi, lo, sig): sizes, a 128-bit hash and the min-max signature of each row's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data, offsets in blocks(b.column(2)):
                values, bounds = distinct(*shingles(Words(data, offsets), n))
                sig = np.empty((len(bounds) - 1, 2 * PERMUTATIONS), np.uint32)
                for k in range(PERMUTATIONS):
                    h = (values ^ _XOR[k]) * _MUL[k]
                    h >>= np.uint64(32)
                    h = h.astype(np.uint32)
                    sig[:, 2 * k] = reduce_texts(np.minimum, h, bounds, 0)
                    sig[:, 2 * k + 1] = reduce_texts(np.maximum, h, bounds, 0)
                lo = reduce_texts(np.add, mix(values), bounds, 0).view(np.int64)
                hi = reduce_texts(np.add, mix(values ^ np.uint64(0x5851F42D4C957F2D)), bounds, 0).view(np.int64)
                m = len(bounds) - 1
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, m), b.column(1).slice(i, m), pa.array(np.diff(bounds)), pa.array(hi), pa.array(lo), pa.array([r.tobytes() for r in sig], pa.binary())],
                    ["doc_id", "text_hash", "n_shingles", "hi", "lo", "sig"],
                )

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, hi long, lo long, sig binary")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs[text_col].cast("string")
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _texts(nodes: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of the nodes: the text of one row of each class. A table of few nodes is broadcast, others are shuffled."""
    wanted = cut(classes.join(nodes, "node", "left_semi").select("node", "doc_id", "text_hash"))
    few = wanted.count() <= MOST_BROADCAST
    found = _rows(docs, id_col, text_col).join(F.broadcast(wanted) if few else wanted, ["doc_id", "text_hash"])
    return found.select("node", "text")


def _sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, data, offsets in blocks(texts):
        v, at = shingles(Words(data, offsets), n)
        out += [np.unique(v[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
    return out


def confirm(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full shingle sets have 100 * intersection >= percent * union. texts: (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                b = batch.slice(k, 128)
                ok = []
                for x, y in zip(_sets(b.column(2), n), _sets(b.column(3), n), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) else 0
                    ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda node, text: texts.select(F.col("node").alias(node), F.col("text").alias(text))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _placed(member: DataFrame) -> DataFrame:
    """member (bucket, k, upper, node, n_shingles, component) of mixed buckets as (bucket, k, i, j, own, upper, node,
    component), a row for each pair of blocks i <= j that the row's own block is in. i is always one of probes, the
    members outside the largest component of their bucket, so all pairs with a probe meet."""
    per = member.groupBy("bucket", "component").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("s"))
    mixed = per.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("m").alias("m"), F.sum("s").alias("s"), F.max(F.struct("m", "component", "s")).alias("main")).where("parts > 1")
    number = lambda m, s: F.greatest(F.ceil(m / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    mixed = mixed.select("bucket", F.col("main.component").alias("main"), number(F.col("m") - F.col("main.m"), F.col("s") - F.col("main.s")).alias("probes"), number(F.col("main.m"), F.col("main.s")).alias("others"))
    deal = lambda n: F.pmod(F.xxhash64("node", F.lit(3)), n).cast("int")
    rows = member.join(mixed, "bucket").withColumn("probe", F.col("component") != F.col("main"))
    rows = rows.withColumn("own", F.when(F.col("probe"), deal(F.col("probes"))).otherwise(F.col("probes") + deal(F.col("others"))))
    none = F.array().cast("array<struct<i:int,j:int>>")
    first = F.when(F.col("probe"), F.transform(F.sequence("own", F.col("probes") + F.col("others") - 1), lambda j: F.struct(F.col("own").alias("i"), j.alias("j")))).otherwise(none)
    before = F.least("own", "probes")
    second = F.when(before > 0, F.transform(F.sequence(F.lit(0), before - 1), lambda i: F.struct(i.alias("i"), F.col("own").alias("j")))).otherwise(none)
    return rows.select("bucket", "k", "upper", "node", "component", "own", F.explode(F.concat(first, second)).alias("x")).select("bucket", "k", "x.i", "x.j", "own", "upper", "node", "component")


def _common(base: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of a sorted set with others."""
    flat = np.concatenate(sets)
    hit = base[np.minimum(np.searchsorted(base, flat), len(base) - 1)] == flat
    return np.add.reduceat(hit, np.cumsum([0, *(len(x) for x in sets[:-1])]), dtype=np.int64)


def _forest(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) from rows (bucket, k, i, j, own, upper, node, component, n_shingles, sig, text): in each group of a bucket
    and two blocks the confirmed pairs that join components which nothing before them in the group has joined."""
    least = least_estimate(percent)

    def found(t: pa.Table) -> pa.RecordBatch | None:
        own, i, j, k = (t.column(c).to_numpy() for c in ("own", "i", "j", "k"))
        probe, resident = np.flatnonzero(own == i), np.flatnonzero(own == j)
        if not len(probe) or not len(resident):
            return None
        node, comp = t.column("node").to_numpy(), t.column("component").to_numpy().copy()
        upper, size = t.column("upper").to_numpy(), t.column("n_shingles").to_numpy()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(len(node), -1)
        small = sig.astype(np.uint8)  # equal values have equal low bytes: a cheap bound of the estimate
        band = int(k[0])
        text = t.column("text")
        sets: dict[int, np.ndarray] = {}

        def set_of(r: int) -> np.ndarray:
            if r not in sets:
                sets[r] = _sets(text.slice(r, 1), n)[0]
            return sets[r]

        links = []
        for p in probe.tolist():
            r = resident if i[0] < j[0] else resident[resident > p]  # within a block every pair once
            r = r[(comp[r] != comp[p]) & (100 * np.minimum(size[r], size[p]) >= percent * np.maximum(size[r], size[p]))]
            if upper[p]:
                r = r[~upper[r]]  # two of the next size class meet in its own part
            r = r[np.count_nonzero(small[r] == small[p], axis=1) >= least * sig.shape[1]]
            if not len(r):
                continue
            same = sig[r] == sig[p]
            est = same.mean(1)
            earlier = same[:, : BAND * band].reshape(len(r), band, BAND).all(2).any(1)  # they meet in an earlier band
            ok = (est >= least) & ~earlier
            r, est = r[ok], est[ok]
            r = r[np.argsort(-est, kind="stable")]
            while len(r):
                now, r = r[:AT_ONCE], r[AT_ONCE:]
                base = set_of(p)
                both = _common(base, [set_of(x) for x in now.tolist()])
                for x in now[100 * both >= percent * (len(base) + size[now] - both)].tolist():
                    if comp[x] != comp[p]:
                        links.append((node[p], node[x]))
                        comp[comp == comp[x]] = comp[p]
                r = r[comp[r] != comp[p]]
        if not links:
            return None
        a, b = np.array(links, np.int64).T
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def groups(last: bool) -> Iterator[pa.Table]:
            nonlocal held
            if not held:
                return
            t = pa.concat_tables(held).combine_chunks()
            keys = [t.column(c).to_numpy() for c in ("bucket", "i", "j")]
            cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            bounds = [0, *cuts.tolist(), t.num_rows]
            for x, y in zip(bounds[:-1], bounds[1:] if last else bounds[1:-1], strict=False):
                yield t.slice(x, y - x)
            held = [] if last else [t.slice(bounds[-2])]

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) >= 2 * BLOCK or sum(t.nbytes for t in held) > 16 * BLOCK_SHINGLES:
                for g in groups(False):
                    if (r := found(g)) is not None:
                        yield r
        for g in groups(True):
            if (r := found(g)) is not None:
                yield r

    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, "a long, b long")


def near_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row."""
    sigs = stored(signatures(docs, n, id_col, text_col), "signatures")
    whole = sigs.where("n_shingles > 0 and doc_id is not null")
    classes = whole.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"), F.first("n_shingles").alias("n_shingles"), F.min("sig").alias("sig"))
    # numbers of classes are fixed by writing them
    classes = stored(classes.select("hi", "lo", "row.doc_id", "row.text_hash", "n_shingles", "sig", F.monotonically_increasing_id().alias("node")), "classes")
    at = F.col("k") * (4 * BAND) + 1
    bands = classes.select("node", "n_shingles", "sig", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("k")).select("node", "n_shingles", "k", F.xxhash64("k", F.substring("sig", at, F.lit(4 * BAND))).alias("bucket"))
    leads = bands.groupBy("bucket").agg(F.count("*").alias("size"), *(F.min_by("node", F.struct(F.xxhash64("node", F.lit(s)), "node")).alias(f"l{s}") for s in SEEDS)).where("size > 1")
    shared = stored(bands.join(leads, "bucket"), "shared")
    stars = shared.select("node", F.explode(F.array_distinct(F.array(*(f"l{s}" for s in SEEDS)))).alias("lead")).where("node <> lead")
    stars = cut(stars.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct())
    texts = _texts(shared.select("node").distinct(), classes, docs, id_col, text_col)
    # rows of one id are one document: links between the classes of its texts
    of_id = whole.join(classes.select("hi", "lo", "node"), ["hi", "lo"]).select(whole["doc_id"], "node")
    ends = of_id.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    again = of_id.join(ends.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b")).distinct()
    comp = cut(components(cut(confirm(stars, texts, n, percent).union(again))))
    # sizes that can reach the threshold differ by less than one class; each class goes with its own and with the next
    size_class = F.floor(F.log("n_shingles") / math.log(100 / percent * (1 + 1e-9))) if percent < 100 else F.col("n_shingles")
    part = lambda upper, *key: F.struct(F.xxhash64("bucket", *key).alias("bucket"), F.lit(upper).alias("upper"))
    parts = F.when(F.col("size") > BLOCK, F.array(part(False, size_class), part(True, size_class - 1))).otherwise(F.array(part(False)))
    member = shared.select("node", "k", "n_shingles", F.explode(parts).alias("x")).select("node", "k", "n_shingles", "x.bucket", "x.upper")
    member = member.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = stored(_placed(member), "placed")
    texts = _texts(placed.select("node").distinct(), classes, docs, id_col, text_col)
    links = cut(_forest(placed.join(classes.select("node", "n_shingles", "sig"), "node").join(texts, "node"), n, percent))
    end = lambda x: comp.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    joined = links.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    to = components(joined).select(F.col("node").alias("component"), F.col("component").alias("to"))
    of_class = classes.select("hi", "lo", "doc_id", "node").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of_class = of_class.join(to, "component", "left").select("hi", "lo", "doc_id", F.coalesce("to", "component").alias("component"))
    least = of_class.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = sigs.select("doc_id", "n_shingles", "hi", "lo").join(of_class.join(least, "component").select("hi", "lo", "component_id"), ["hi", "lo"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return linked.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose id isn't the smallest of its component; the columns stay as they are."""
    gone = near_components(docs, n, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")
