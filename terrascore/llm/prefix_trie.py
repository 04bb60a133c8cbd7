"""The trie of all conversations' prefixes: which conversations begin alike, for how long, and what sharing saves.

1. Each turn becomes a turn id, two 64-bit hashes of (role, text), and a number of code points; texts aren't moved.
2. Conversations are dealt out by ranges of (sequence of turn ids, conv_id). A shard lays its sequences out as padded matrices
   of WIDTH columns at a time, sorts them by lexsort, compares each row with the one before, and accumulates these masks
   along the columns by OR: a row begins a node at each depth from its first change on. Runs between such starts are the
   nodes of a depth, aggregated by reduceat, and sums over subtrees go from the deepest column up. Only rows that reach a
   block of columns are in its matrix, so a long conversation doesn't widen those of others.
3. Nodes on the path of a shard's first or last row may go on in the next shard; all others are whole. The former are
   recombined by the hash of their prefix: sums are added, and what neighbours counted twice (a child on both sides, a leaf
   that isn't one, the copy that each shard counts as the first) is corrected at the node and all nodes above it.

A group of equal conversations of any size is split by conv_id. The list of conversations that end at a node is hashed in
ascending order in pieces, one after the other, never held whole. A conversation's turn ids (24 bytes a turn) lie in one row.

Edge cases: a null role or text is empty; rows of a null conv_id belong to no conversation; turns come in ascending order, null first, rows of
the same turn by their turn ids; repeated rows are turns of their own. An empty table gives an empty result. Columns of other names aren't read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_stored, stored

#: Columns of a padded matrix, and turns of a shard.
WIDTH, SHARD_TURNS = 8, 1 << 16
LEAST = np.iinfo(np.int64).min
ROOT = b"\0" * 16
EMPTY = hashlib.sha256(b"").digest()

NODE = "kind int, shard int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 binary, key binary, parent_key binary, chars long, is_leaf long, path long, ends array<long>, keys array<binary>"
_NODE = pa.schema(
    [("kind", pa.int32()), ("shard", pa.int32())] + [(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")] + [(c, pa.binary()) for c in ("ends_sha256", "key", "parent_key")]
    + [(c, pa.int64()) for c in ("chars", "is_leaf", "path")] + [("ends", pa.list_(pa.int64())), ("keys", pa.list_(pa.binary()))]
)
#: Rows of the table that a shard leaves: whole nodes; whole nodes below a node of the shard's border; nodes of the border; the border's paths.
WHOLE, BELOW, BORDER, PATH = range(4)


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) with turns an array of (hi, lo, chars) in order."""
    c = conversations
    role, text = (F.coalesce(c[x].cast("string"), F.lit("")) for x in ("role", "text"))
    # the least value of a hash pads the matrices
    safe = lambda h: F.greatest(h, F.lit(int(LEAST) + 1))
    rows = c.where(c["conv_id"].isNotNull()).select(c["conv_id"].cast("long").alias("conv_id"), F.struct(c["turn"].cast("long").alias("turn"), safe(F.xxhash64(role, text)).alias("hi"), safe(F.xxhash64(F.lit(7), role, text)).alias("lo"), F.length(text).cast("long").alias("chars")).alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda x: F.struct(x["hi"].alias("hi"), x["lo"].alias("lo"), x["chars"].alias("chars"))).alias("turns"))


def with_shared_heads(seqs: DataFrame, every: int = 100, most: int = 5) -> DataFrame:
    """Conversations rebuilt to begin like others: conversation c takes the first h turns of c - c % every (all if there are fewer, none
    if it is absent) and then its own after its first h; h is the crc32 of its decimal id modulo most + 1. Ids are divided towards minus infinity."""
    own = F.pmod(F.col("conv_id"), F.lit(every))
    heads = seqs.where(own == 0).select(F.col("conv_id").alias("__base"), F.slice("turns", 1, most).alias("__head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    joined = seqs.withColumn("__base", F.col("conv_id") - own).join(heads, "__base", "left").withColumn("__h", h)
    none = F.slice("turns", 1, 0)
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("__head", none), F.lit(1), F.col("__h")), F.slice("turns", F.col("__h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


class ShardTrie:
    """The nodes of one shard's sequences, depth by depth.

    Lists by depth (0 is the root): n (members), least (smallest conv_id), parent (place among the nodes a depth above),
    chars; ended: (nodes, conv_ids) of sequences that end there, by node and then ascending id; first_row and last_row
    in the order of sequences."""

    def __init__(self, conv: np.ndarray, offsets: np.ndarray, hi: np.ndarray, lo: np.ndarray, chars: np.ndarray):
        size = np.diff(offsets)
        rows = len(conv)
        order = np.lexsort((conv, size > 0))
        group, node_at = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        done = order[size[order] == 0]
        self.n, self.least, self.parent, self.chars = [np.array([rows])], [np.array([conv.min()])], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        self.ended = [(np.zeros(len(done), np.int64), conv[done])]
        begin = 0
        while len(place := np.flatnonzero(size[order] > begin)):
            sub = order[place]
            width = int(min(WIDTH, size[sub].max() - begin))
            column = begin + np.arange(width)
            valid = column < size[sub][:, None]
            at = np.where(valid, offsets[sub][:, None] + column, 0)
            high, low = np.where(valid, hi[at], LEAST), np.where(valid, lo[at], LEAST)
            keys = [conv[sub], size[sub] > begin + width]
            for j in range(width - 1, -1, -1):
                keys += [low[:, j], high[:, j]]
            s = np.lexsort((*keys, group[place]))
            sub, valid, high, low, before = sub[s], valid[s], high[s], low[s], group[place][s]
            order[place] = sub
            change = np.ones((len(sub), width + 1), bool)
            change[1:, 0] = before[1:] != before[:-1]
            change[1:, 1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
            starts = np.logical_or.accumulate(change, axis=1)[:, 1:]
            for j in range(width):
                self._depth(begin + j + 1, sub[valid[:, j]], starts[valid[:, j], j], conv, size, offsets, chars, node_at)
            group[place] = np.cumsum(starts[:, -1])
            begin += width
        self.first_row, self.last_row = int(order[0]), int(order[-1])
        self._up()

    def _depth(self, depth, rows, starts, conv, size, offsets, chars, node_at) -> None:
        first = np.flatnonzero(starts)
        self.n.append(np.diff(np.append(first, len(rows))))
        self.least.append(np.minimum.reduceat(conv[rows], first))
        self.parent.append(node_at[rows[first]])
        self.chars.append(chars[offsets[rows[first]] + depth - 1])
        node_at[rows] = np.cumsum(starts) - 1
        ends = rows[size[rows] == depth]
        self.ended.append((node_at[ends], conv[ends]))

    def _up(self) -> None:
        """children, leaves and saved of every node, the deepest first."""
        depths = len(self.n)
        self.children = [np.bincount(self.parent[d + 1], minlength=len(self.n[d])) if d + 1 < depths else np.zeros(len(self.n[d]), np.int64) for d in range(depths)]
        self.leaves = [(c == 0).astype(np.int64) for c in self.children]
        self.saved = [(n - 1) * c for n, c in zip(self.n, self.chars, strict=True)]
        for d in range(depths - 2, -1, -1):
            up = self.parent[d + 1]  # ascending
            first = np.flatnonzero(np.append(True, up[1:] != up[:-1]))
            for part in (self.leaves, self.saved):
                part[d][up[first]] += np.add.reduceat(part[d + 1], first)

    def ends_at(self, depth: int) -> dict[int, np.ndarray]:
        """{node: ascending ids of the conversations that end there}."""
        node, ids = self.ended[depth]
        cuts = np.flatnonzero(node[1:] != node[:-1]) + 1
        return dict(zip(node[np.append(0, cuts)].tolist(), np.split(ids, cuts), strict=True)) if len(node) else {}


def joined(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


def shard_nodes(shard: int, conv: np.ndarray, offsets: np.ndarray, hi: np.ndarray, lo: np.ndarray, chars: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows that a shard leaves; see NODE."""
    trie = ShardTrie(conv, offsets, hi, lo, chars)
    paths = []
    for row in (trie.first_row, trie.last_row):
        keys = [ROOT]
        for k in range(offsets[row], offsets[row + 1]):
            keys.append(hashlib.blake2b(keys[-1] + hi[k].tobytes() + lo[k].tobytes(), digest_size=16).digest())
        paths.append(keys)
    yield pa.RecordBatch.from_pylist([{"kind": PATH, "path": 2 * shard + side, "keys": keys} for side, keys in enumerate(paths)], _NODE)
    above: dict[int, bytes] = {}
    for d, n in enumerate(trie.n):
        border = {at: (paths[side][d], side) for side, at in ((1, len(n) - 1), (0, 0)) if d < len(paths[side])}
        ends = trie.ends_at(d)
        edge = [{
            "kind": BORDER, "shard": shard, "conv_id": int(trie.least[d][i]), "depth": d, "n_convs": int(n[i]), "n_children": int(trie.children[d][i]), "n_leaves": int(trie.leaves[d][i]), "saved_tokens": int(trie.saved[d][i]),
            "key": key, "parent_key": above.get(int(trie.parent[d][i])) if d else None, "chars": int(trie.chars[d][i]), "is_leaf": int(trie.children[d][i] == 0), "path": 2 * shard + side, "ends": ends[i].tolist() if i in ends else None,
        } for i, (key, side) in border.items()]
        if edge:
            yield pa.RecordBatch.from_pylist(edge, _NODE)
        rest = np.ones(len(n), bool)
        rest[list(border)] = False
        if rest.any():
            sha = np.full(len(n), EMPTY, object)
            for i, ids in ends.items():
                sha[i] = hashlib.sha256(joined(ids)).digest()
            up = trie.parent[d][rest]
            below = np.array([above.get(p) for p in up.tolist()], object)
            known = np.array([x is None for x in below])
            ints = {"conv_id": trie.least[d][rest], "n_convs": n[rest], "n_children": trie.children[d][rest], "n_leaves": trie.leaves[d][rest], "saved_tokens": trie.saved[d][rest]}
            columns = {k: pa.array(v) for k, v in ints.items()} | {"kind": pa.array(np.where(known, WHOLE, BELOW).astype(np.int32)), "shard": pa.array(np.full(len(up), shard, np.int32)), "depth": pa.array(np.full(len(up), d))}
            columns |= {"parent_conv_id": pa.array(trie.least[d - 1][up], mask=~known), "ends_sha256": pa.array(sha[rest], pa.binary()), "parent_key": pa.array(below, pa.binary())}
            yield pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(len(up), f.type) for f in _NODE], schema=_NODE)
        above = {i: key for i, (key, _) in border.items()}


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got).combine_chunks()
    turns = table.column("turns").chunk(0)
    values = turns.flatten()
    offsets = np.concatenate([[0], np.cumsum(turns.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    flat = [values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)]
    flat = [x if len(x) else np.zeros(1, np.int64) for x in flat]
    yield from shard_nodes(int(table.column("shard")[0].as_py()), table.column("conv_id").to_numpy(), offsets, *flat)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends_sha256) from pieces of ids, sorted by key and first id; the hash goes on from piece to piece."""
    key, state, rows = None, None, []
    for b in batches:
        for k, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if k != key:
                if state is not None:
                    rows.append({"key": key, "ends_sha256": state.digest()})
                key, state, comma = k, hashlib.sha256(), b""
            state.update(comma + ",".join(map(str, ids)).encode())
            comma = b","
    if state is not None:
        rows.append({"key": key, "ends_sha256": state.digest()})
    if rows:
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("key", pa.binary()), ("ends_sha256", pa.binary())]))


def recombine(nodes: DataFrame) -> DataFrame:
    """The border nodes of all shards as whole nodes: (key, parent_key, and the columns of a node but parent_conv_id)."""
    part = nodes.where(F.col("kind") == BORDER)
    own = part.groupBy("key").agg(
        F.first("parent_key", True).alias("parent_key"), F.first("depth").alias("depth"), F.first("chars").alias("chars"), F.min("conv_id").alias("conv_id"), F.count("*").alias("shards"), F.min("path").alias("path"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "is_leaf")),
    )
    again = own.where("shards > 1").select("key", "parent_key", "depth", "path", (F.col("shards") - 1).alias("extra"), ((F.col("shards") - 1) * F.col("chars")).alias("more_saved"), (F.when(F.col("n_children") == 0, 1).otherwise(0) - F.col("is_leaf")).alias("more_leaves"))
    paths = nodes.where(F.col("kind") == PATH).select("path", "keys")
    up = again.join(paths, "path").select(F.explode(F.slice("keys", F.lit(1), (F.col("depth") + 1).cast("int"))).alias("key"), "more_saved", "more_leaves").groupBy("key").agg(F.sum("more_saved").alias("more_saved"), F.sum("more_leaves").alias("more_leaves"))
    twice = again.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.sum("extra").alias("twice"))
    pieces = part.where("ends is not null").select("key", "ends")
    ends = pieces.withColumn("__first", F.get("ends", F.lit(0))).repartition("key").sortWithinPartitions("key", "__first").select("key", "ends").mapInArrow(_digests, "key binary, ends_sha256 binary")
    zero = lambda c: F.coalesce(c, F.lit(0))
    whole = own.join(up, "key", "left").join(twice, "key", "left").join(ends, "key", "left")
    return whole.select(
        "key", "parent_key", "conv_id", "depth", "n_convs", (F.col("n_children") - zero("twice")).alias("n_children"), (F.col("n_leaves") + zero("more_leaves")).alias("n_leaves"),
        (F.col("saved_tokens") + zero("more_saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def trie(seqs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each node.

    seqs: (conv_id, turns array of (hi, lo, chars)), ids without nulls or repetition. conv_id is a node's smallest member; saved_tokens sums, over the
    subtree, (members - 1) times the code points of the last turn; ends_sha256 is the hash of the ids, ascending and joined by
    commas, of conversations that end at the node."""
    kept = stored(seqs.select("conv_id", "turns"), "sequences")
    turns, rows = kept.agg(F.coalesce(F.sum(F.size("turns")), F.lit(0)), F.count("*")).first()
    shards = max(1, math.ceil((turns + rows) / shard_turns))
    dealt = kept.repartitionByRange(shards, "turns", "conv_id").select("conv_id", "turns", F.spark_partition_id().alias("shard"))
    nodes = stored(dealt.mapInArrow(_shard, NODE), "trie-nodes")
    drop_stored(kept)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    border = stored(recombine(nodes), "trie-border")
    parents = border.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("__up"))
    edge = border.join(parents, "parent_key", "left").withColumn("parent_conv_id", F.col("__up")).select(*columns)
    # children of a border node look it up in their own shard, so that no key has more of them than a shard has rows
    seen = nodes.where(F.col("kind") == BORDER).select("shard", F.col("key").alias("parent_key")).join(parents, "parent_key")
    below = nodes.where(F.col("kind") == BELOW).join(seen, ["shard", "parent_key"]).withColumn("parent_conv_id", F.col("__up")).select(*columns)
    whole = nodes.where(F.col("kind") == WHOLE).select(*columns)
    return whole.unionByName(below).unionByName(edge).withColumn("ends_sha256", F.lower(F.hex("ends_sha256")))
