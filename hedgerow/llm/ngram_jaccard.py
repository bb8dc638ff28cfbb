"""N-gram Jaccard join by a token-group matrix: exact, for documents as sets of distinct word n-grams.

Documents link when |A & B| >= threshold * |A | B|. Equal sets are one node. The steps:

1. Document frequency. Every task sends the distinct n-gram hashes of its nodes, packed, to parts by hash. A part finds
   the n-grams that two or more nodes share and returns them per node; n-grams of one node (most) end there. A node
   survives only if at least `threshold` of its n-grams are shared, as any link needs; most documents drop out here,
   among them those that merely hold a passage or line which very many documents share. N-grams frequent within a task
   are dealt by node instead of by hash, with a marker left behind, so no n-gram fills one task.
2. Groups. Survivors with the same smallest shared n-gram in one of a few random orders meet in blocks of at most about
   `BLOCK` nodes. A block's member links are computed in its task by a 0/1 matrix product over the block's token union
   and reduced to a spanning set by union-find. The components so far are the groups, again in blocks; nodes without a
   link stay in the block of their smallest n-gram, if it holds several of them.
3. Matrix. Prefix tokens (n-grams of one node first, then rare ones by a count sketch of fixed size) of all members, one
   entry per block and token with the sizes of the block's sets, are the token-group matrix; blocks of different groups
   that share an entry and whose sizes allow a link are candidates. A candidate
   block's nodes are bounded by their overlap with the other block's token union, first on bitmaps of the unions (2,048
   bits, so that few nodes travel), then in full; only where a node reaches the least overlap is the block opened and its
   rows compared. This finds every link that the groups did not hold.
4. Links become components by label propagation with pointer jumping over written tables; labels are doc_ids.

Nothing is sampled or capped, no pair list within a group is emitted, and no step collects nodes to the driver.

Defined results: null and wordless texts have an empty set, linked with nothing; texts with fewer words than n are one
n-gram; repeated rows of one doc_id are separate sets with the same id; very long texts are processed whole; an empty
table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, read, runs_of, splitmix, trim
from .packed import SCHEMA, exchange, parts_for, spread

N = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
BLOCK = 256
#: Counters of the sketch that puts rare n-grams first, and the slices in which they are summed.
COUNTERS, SLICES = 1 << 20, 64
#: So many nodes that are alike but not linked are one block of the matrix.
MERGED = 8
#: Bits of a block's token bitmap.
OUTLINE = 2048
#: Random orders by whose smallest n-gram nodes are first grouped.
ROUNDS = 3
#: Guest nodes that meet a block in one task.
GUESTS = 4096
#: An n-gram that so many nodes of one task share is dealt by node.
HOT = 64
MULTIPLIERS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63))
NODE = np.dtype([("node", "<u8"), ("n", "<u4")])
HEAD = np.dtype([("node", "<u8"), ("n", "<u4"), ("k", "<u4")])
#: A posting is 64 bits: 48 of the token's hash, one for "dealt by node", 15 for the node's place in its cell. Tokens
#: that agree in 48 bits only let a node survive; in a compared pair they coincide by chance with odds below 1e-8.
TOKEN_BITS, PLACES = np.uint64((1 << 48) - 1), 1 << 15


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and the bounds of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    pieces = lists.flatten().dictionary_encode()
    kinds = pieces.dictionary.to_pylist()
    value = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in kinds), dtype=np.uint64, count=len(kinds))
    word = np.fromiter((k != "" for k in kinds), dtype=bool, count=len(kinds))
    idx = pieces.indices.to_numpy(zero_copy_only=False)
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    real = word[idx] if len(idx) else np.zeros(0, bool)
    place = np.concatenate([[0], np.cumsum(real)])
    return (value[idx][real] if len(idx) else np.zeros(0, np.uint64)), place[ends]


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text in a row, and the bounds of each text."""
    h, bounds = word_hashes(texts)
    size = np.diff(bounds)
    own = np.repeat(np.arange(len(size)), np.where(size >= N, size - N + 1, 0))
    if len(h) >= N:
        s = h[: len(h) - N + 1] * MULTIPLIERS[0]
        for j in range(1, N):
            s = splitmix(s) + h[j : len(h) - N + 1 + j] * MULTIPLIERS[j]
        s = splitmix(s)
        starts = bounds[:-1][size >= N]
        count = size[size >= N] - N + 1
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        tokens = s[at]
    else:
        tokens = np.zeros(0, np.uint64)
    few = np.flatnonzero((size > 0) & (size < N))
    if len(few):
        extra = np.array([xxhash.xxh3_64_intdigest(h[bounds[d] : bounds[d + 1]].tobytes()) for d in few], np.uint64)
        tokens, own = np.concatenate([tokens, extra]), np.concatenate([own, few])
    order = np.lexsort((tokens, own))
    tokens, own = tokens[order], own[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (own[1:] != own[:-1])
    tokens, own = tokens[new], own[new]
    return tokens, np.searchsorted(own, np.arange(len(size) + 1))


def set_ids(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set; equal sets have equal ids."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(splitmix(tokens ^ MULTIPLIERS[1]))])
    other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(splitmix(tokens + MULTIPLIERS[3]))])
    a, b = total[bounds[1:]] - total[bounds[:-1]], other[bounds[1:]] - other[bounds[:-1]]
    return splitmix(splitmix(a) ^ b)


def batches_of(b: pa.RecordBatch, column: int, most: int = 2 << 20) -> Iterator[tuple[int, int, pa.Array]]:
    texts = pc.fill_null(b.column(column), "")
    for i, j in runs_of(pc.binary_length(texts).to_pylist(), most):
        yield i, j, texts.slice(i, j - i)


def sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n, node) of every document; node is null for empty sets."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, texts in batches_of(b, 1):
                tokens, bounds = shingles(texts)
                n = np.diff(bounds)
                node = set_ids(tokens, bounds).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(node, mask=n == 0)], ["doc_id", "n", "node"])
        trim()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, node long")


def survivors(docs: DataFrame) -> DataFrame:
    """(node, n, shared, keys): nodes of which enough n-grams are shared, these as sorted 64-bit numbers in one cell, and
    the smallest of them in each of ROUNDS random orders."""
    partitions, _ = parts_for(docs, 2.6, 12 << 20)
    parts = partitions

    targets = spread(parts)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in batches:
            for _, _, texts in batches_of(b, 0):
                t, bounds = shingles(texts)
                ids, n = set_ids(t, bounds), np.diff(bounds)
                new = []
                for d in np.flatnonzero(n):
                    if int(ids[d]) not in done:
                        done.add(int(ids[d]))
                        new.append(d)
                if len(done) > 2_000_000:  # repeats beyond are dropped by the parts
                    done.clear()
                for x in range(0, len(new), PLACES):
                    yield from cells(t, bounds, ids, n, np.array(new[x : x + PLACES]))
        trim()

    def cells(t, bounds, ids, n, rows) -> Iterator[pa.RecordBatch]:
        """A cell a part: number of nodes, nodes, postings."""
        table = np.empty(len(rows), NODE)
        table["node"], table["n"] = ids[rows], n[rows]
        size = n[rows]
        at = np.repeat(bounds[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        token, own = t[at] & TOKEN_BITS, np.repeat(np.arange(len(rows)), size)
        part = (splitmix(token) % np.uint64(parts)).astype(np.int32)
        flag = np.zeros(len(token), np.uint64)
        order = np.argsort(token, kind="stable")
        runs = np.flatnonzero(np.concatenate([[True], np.diff(token[order]) != 0, [True]]))
        long_runs = np.flatnonzero(np.diff(runs) >= HOT)
        more = [order[runs[k] : runs[k] + 2] for k in long_runs]  # the token's own part still sees that it is shared
        marks = np.concatenate(more) if more else np.zeros(0, int)
        mark_part = part[marks]
        if len(long_runs):
            hot = np.concatenate([order[runs[k] : runs[k + 1]] for k in long_runs])
            part[hot] = (splitmix(table["node"][own[hot]]) % np.uint64(parts)).astype(np.int32)
            flag[hot] = PLACES
        token, own, flag = np.concatenate([token, token[marks]]), np.concatenate([own, own[marks]]), np.concatenate([flag, np.zeros(len(marks), np.uint64)])
        part = np.concatenate([part, mark_part])
        order = np.argsort(part, kind="stable")
        token, own, flag, part = token[order], own[order], flag[order], part[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
        out = []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            used, place = np.unique(own[s:e], return_inverse=True)
            x = token[s:e] << np.uint64(16) | flag[s:e] | place.astype(np.uint64)
            out.append(len(used).to_bytes(4, "little") + table[used].tobytes() + x.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(targets[part[cuts[:-1]]], pa.int32()), pa.array(out, pa.binary())], ["part", "data"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, n, token, hot = [], [], [], []
        for b in batches:
            for cell in b.column(1):
                raw = memoryview(cell.as_buffer())
                end = 4 + int.from_bytes(raw[:4], "little") * NODE.itemsize
                head, x = np.frombuffer(raw[4:end], NODE), np.frombuffer(raw[end:], np.uint64)
                place = (x & np.uint64(PLACES - 1)).astype(np.int64)
                node.append(head["node"][place])
                n.append(head["n"][place])
                token.append(x >> np.uint64(16))
                hot.append((x & np.uint64(PLACES)) != 0)
        if not node:
            return
        node, n, token, hot = map(np.concatenate, (node, n, token, hot))
        order = np.lexsort((node, token))
        node, n, token, hot = node[order], n[order], token[order], hot[order]
        run = np.concatenate([[True], token[1:] != token[:-1]])
        new = run.copy()
        new[1:] |= node[1:] != node[:-1]
        kind = np.cumsum(run) - 1
        shared = (np.bincount(kind, weights=new) > 1) | (np.bincount(kind, weights=hot) > 0)
        keep = new & shared[kind]
        node, n, token = node[keep], n[keep], token[keep]
        part = (splitmix(node) % np.uint64(parts)).astype(np.int32)
        order = np.lexsort((token, node, part))
        node, n, token, part = node[order], n[order], token[order], part[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else [0]
        out = []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            first = np.concatenate([[0], np.flatnonzero(np.diff(node[s:e])) + 1])
            head = np.empty(len(first), HEAD)
            head["node"], head["n"], head["k"] = node[s:e][first], n[s:e][first], np.diff(np.append(first, e - s))
            out.append(len(first).to_bytes(4, "little") + head.tobytes() + token[s:e].tobytes())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(targets[part[cuts[:-1]]], pa.int32()), pa.array(out, pa.binary())], ["part", "data"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, n, token = [], [], []
        for b in batches:
            for cell in b.column(1):
                raw = memoryview(cell.as_buffer())
                end = 4 + int.from_bytes(raw[:4], "little") * HEAD.itemsize
                head = np.frombuffer(raw[4:end], HEAD)
                node.append(np.repeat(head["node"], head["k"]))
                n.append(np.repeat(head["n"], head["k"]))
                token.append(np.frombuffer(raw[end:], np.uint64))
        if not node:
            return
        node, n, token = map(np.concatenate, (node, n, token))
        order = np.lexsort((token, node))
        node, n, token = node[order], n[order], token[order]
        new = np.ones(len(node), bool)
        new[1:] = (node[1:] != node[:-1]) | (token[1:] != token[:-1])
        node, n, token = node[new], n[new], token[new]
        first = np.concatenate([[0], np.flatnonzero(np.diff(node)) + 1])
        size = np.diff(np.append(first, len(node)))
        alive = np.flatnonzero(size * 100 >= PERCENT * n[first].astype(np.int64))
        for x in range(0, len(alive), 512):
            rows = alive[x : x + 512]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(node[first[rows]].view(np.int64)), pa.array(n[first[rows]].astype(np.int64)), pa.array([token[first[r] : first[r] + size[r]].tobytes() for r in rows], pa.binary()),
                    pa.array([[int(splitmix(token[first[r] : first[r] + size[r]] ^ m).min().view(np.int64)) for m in MULTIPLIERS[:ROUNDS]] for r in rows], pa.list_(pa.int64())),
                ],
                ["node", "n", "shared", "keys"],
            )
        trim()

    posted = exchange(docs.select("text").mapInArrow(emit, SCHEMA), partitions)
    found = exchange(posted.mapInArrow(meet, SCHEMA), partitions)
    return found.mapInArrow(gather, "node long, n long, shared binary, keys array<long>")


def prefix(shared: np.ndarray, n: int, counts: np.ndarray | None = None) -> np.ndarray:
    """The shared n-grams among the first n - least + 1 of a node, where n-grams of one node come first.

    counts: the others' order, rare ones first; any numbers by hash give one order for all nodes, which is what exactness
    needs, so these may be shared by several n-grams.
    """
    least = -(-PERCENT * n // 100)
    size = max(0, len(shared) - least + 1)
    if counts is not None and size < len(shared):
        shared = shared[np.lexsort((shared, counts[_counter(shared)]))]
    return shared[:size]


def _counter(tokens: np.ndarray) -> np.ndarray:
    return (splitmix(tokens + np.uint64(7)) % np.uint64(COUNTERS)).astype(np.int64)


def _frequencies(nodes: DataFrame) -> np.ndarray:
    """How many nodes hold n-grams of each of COUNTERS hash classes: summed by slices, of fixed size for any input."""
    width = COUNTERS // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for c in b.column(0).to_pylist():
                np.add.at(total, _counter(np.frombuffer(c, np.uint64)), 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([total[k * width : (k + 1) * width].astype(np.int32).tobytes() for k in range(SLICES)], pa.binary())], ["slice", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in t.column("counts").to_pylist())
        return pa.table({"slice": t.column("slice")[:1], "counts": pa.array([np.minimum(total, (1 << 31) - 1).astype(np.int32).tobytes()], pa.binary())})

    parts = nodes.select("shared").mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInArrow(add, "slice int, counts binary").collect()
    out = np.zeros(COUNTERS, np.int32)
    for r in parts:
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], np.int32)
    return out


def _roots(m: int, pairs: np.ndarray) -> np.ndarray:
    """Smallest member of each one's component."""
    root = np.arange(m)
    while True:
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]]) if len(pairs) else np.zeros(0, int)
        new = root.copy()
        np.minimum.at(new, pairs[:, 0], low)
        np.minimum.at(new, pairs[:, 1], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


class Block:
    """Nodes of a block with the token union as sorted columns."""

    def __init__(self, node: np.ndarray, n: np.ndarray, cells: list[bytes]):
        self.node, self.n = node, n
        self.sets = [np.frombuffer(c, np.uint64) for c in cells]
        self.union = np.unique(np.concatenate(self.sets))

    def overlaps(self, other: Block, rows: np.ndarray) -> np.ndarray:
        """Sizes of intersections of some nodes of another block with all of this one."""
        out = np.zeros((len(rows), len(self.sets)), np.int64)
        width = max(1, (16 << 20) // max(len(self.sets) + len(rows), 1))
        # Column slices keep the 0/1 matrices small however large the union is.
        for s in range(0, len(self.union), width):
            cols = self.union[s : s + width]
            out += (_matrix([other.sets[r] for r in rows], cols) @ _matrix(self.sets, cols).T).astype(np.int64)
        return out

    def links(self, other: Block) -> np.ndarray:
        """Linked (row of other, row of self) pairs; rows of other that the union bound rules out are not compared."""
        hits = np.array([np.count_nonzero(_find(x, self.union) >= 0) for x in other.sets])
        rows = np.flatnonzero(hits * 100 >= PERCENT * other.n)
        if not len(rows):
            return np.zeros((0, 2), int)
        both = self.overlaps(other, rows)
        union = other.n[rows][:, None] + self.n[None, :] - both
        a, b = np.nonzero(100 * both >= PERCENT * union)
        return np.stack([rows[a], b], 1)


def _find(x: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Column of each token, or -1."""
    at = np.minimum(np.searchsorted(cols, x), len(cols) - 1)
    return np.where(cols[at] == x, at, -1)


def _matrix(sets_: list[np.ndarray], cols: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets_), len(cols)), np.float32)
    for k, x in enumerate(sets_):
        at = _find(x[np.searchsorted(x, cols[0]) : np.searchsorted(x, cols[-1], side="right")], cols)
        out[k, at[at >= 0]] = 1
    return out


def _dealt(nodes: DataFrame) -> DataFrame:
    """(node, block, own): nodes under each of their keys that others have too, in blocks of about BLOCK; own where the key
    is the node's first."""
    each = nodes.select("node", F.posexplode("keys").alias("place", "key")).groupBy("node", "key").agg((F.min("place") == 0).alias("own"))
    many = each.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / BLOCK).alias("k"))
    return each.join(many, "key").select("node", F.xxhash64("key", F.pmod(F.xxhash64("node", "key"), "k")).alias("block"), "own")


def _grouped(nodes: DataFrame, dealt: DataFrame) -> DataFrame:
    """(block, node, n, shared)"""
    return dealt.join(nodes.select(F.col("node").alias("_node"), "n", "shared"), F.col("node") == F.col("_node")).select("block", "node", "n", "shared")


def _blocks(nodes: DataFrame, parts: DataFrame, dealt: DataFrame) -> DataFrame:
    """(block, part, node, n, shared): nodes in blocks of about BLOCK; no links are left to find within a part.

    Linked nodes go by the component that is known so far. Nodes that are linked with none yet stay with the others of the
    block where their first key put them, if these are MERGED or more: all of them have been compared there, and so many
    alike but unlinked nodes would make a candidate of each of their pairs.
    """
    many = parts.groupBy("part").count().where(F.col("count") > BLOCK).select("part", F.ceil(F.col("count") / BLOCK).alias("k"))
    linked = parts.join(many, "part", "left").select("node", "part", F.xxhash64("part", F.pmod(F.xxhash64("node", F.lit("block")), F.coalesce("k", F.lit(1)))).alias("block"))
    alone = dealt.where("own").join(parts.select("node"), "node", "left_anti").select("node", "block")
    full = alone.groupBy("block").count().where(F.col("count") >= MERGED).select("block")
    merged = alone.join(full, "block").select("node", F.col("block").alias("part"), F.xxhash64("block", F.lit("alone")).alias("block"))
    known = linked.unionByName(merged).toDF("_node", "part", "block")
    own = nodes.join(known, F.col("node") == F.col("_node"), "left")
    return own.select(F.coalesce("block", F.xxhash64("node", F.lit(0))).alias("block"), F.coalesce("part", "node").alias("part"), "node", "n", "shared")


def _ints(rows: list) -> pa.Array:
    return pa.array(rows, pa.int64())


def _outlines(nodes: DataFrame) -> DataFrame:
    """A row a block: its size m, the n-grams n and those of its node alone (own), and the union of its token bitmaps."""
    names = [f"w{k}" for k in range(OUTLINE // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, cells = b.column(1).to_numpy(), b.column(2).to_pylist()
            bits = np.zeros((len(cells), OUTLINE), bool)
            own = np.zeros(len(cells), np.int64)
            for k, c in enumerate(cells):
                x = np.frombuffer(c, np.uint64)
                bits[k, (splitmix(x) % np.uint64(OUTLINE)).astype(np.int64)] = True
                own[k] = n[k] - len(x)
            w = np.packbits(bits, axis=1).view(np.int64).reshape(len(cells), len(names))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own), *(pa.array(w[:, k].copy()) for k in range(len(names)))], ["block", "n", "own", *names])

    rows = nodes.select("block", "n", "shared").mapInArrow(run, "block long, n long, own long, " + ", ".join(f"{x} long" for x in names))
    sums = rows.groupBy("block").agg(F.count("*").alias("m"), F.max("n").alias("n"), F.max("own").alias("own"), *[F.bit_or(x).alias(x) for x in names])
    return sums.select("block", "m", "n", "own", F.array(*names).alias("bits"))


def _bounded(pairs: DataFrame, outlines: DataFrame) -> DataFrame:
    """Pairs (p, q, mp, mq) that the bitmaps do not rule out.

    A bit of a node that the other side lacks stands for an n-gram outside the other's union, as does every n-gram that
    the node shares with nobody; a link leaves room for few of these. Blocks of several nodes are not bounded themselves.
    """
    p = outlines.toDF("p", "mp", "np", "op", "bp")
    q = outlines.toDF("q", "mq", "nq", "oq", "bq")
    missing = lambda own, a, b: own + F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda s, x: s + x)
    single = (F.col("mp") == 1) & (F.col("mq") == 1)
    # |A & B| >= t / (100 + t) * (|A| + |B|) for two nodes, >= t / 100 * |A| for a node and a union.
    both = F.ceil(PERCENT * (F.col("np") + F.col("nq")) / (100 + PERCENT) - 1e-9)
    room = lambda n: F.col(n) - F.when(single, both).otherwise(F.ceil(PERCENT * F.col(n) / 100 - 1e-9))
    fits_p = (F.col("mp") > 1) | (missing(F.col("op"), F.col("bp"), F.col("bq")) <= room("np"))
    fits_q = (F.col("mq") > 1) | (missing(F.col("oq"), F.col("bq"), F.col("bp")) <= room("nq"))
    return pairs.join(p, "p").join(q, "q").where(fits_p & fits_q).select("p", "q", "mp", "mq")


def links(docs: DataFrame) -> DataFrame:
    """(a, b): links between nodes that connect all linked nodes."""
    alive = cut(survivors(docs))

    def inside(t: pa.Table) -> pa.Table:
        node = t.column("node").to_numpy()
        if len(node) < 2:
            return pa.table({"a": _ints([]), "b": _ints([])})
        block = Block(node, t.column("n").to_numpy(), t.column("shared").to_pylist())
        root = _roots(len(node), block.links(block))
        other = np.flatnonzero(root != np.arange(len(node)))
        return pa.table({"a": _ints(node[root[other]]), "b": _ints(node[other])})

    dealt = cut(_dealt(alive))
    within = cut(_grouped(alive, dealt).groupBy("block").applyInArrow(inside, "a long, b long").distinct())
    ends = within.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    nodes = cut(_blocks(alive, components(within, ends.select("node", F.col("node").alias("label"))).toDF("node", "part"), dealt))

    shared_counts = docs.sparkSession.sparkContext.broadcast(_frequencies(alive))  # 4 MB for any input

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, part, n, cells = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_pylist()
            pre = [prefix(np.frombuffer(c, np.uint64), k, shared_counts.value) for c, k in zip(cells, n, strict=True)]
            size = [len(p) for p in pre]
            token = np.concatenate(pre).view(np.int64) if pre else np.zeros(0, np.int64)
            if len(token):
                rows = np.unique(np.stack([token, *(np.repeat(x, size) for x in (block, part, n))], 1), axis=0)
                yield pa.RecordBatch.from_arrays([_ints(rows[:, k]) for k in (0, 1, 2, 3, 3)], ["token", "block", "part", "least", "most"])

    rows = nodes.select("block", "part", "n", "shared").mapInArrow(entries, "token long, block long, part long, least long, most long")
    matrix = rows.groupBy("token", "block", "part").agg(F.min("least").alias("least"), F.max("most").alias("most"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of blocks of different parts with a common entry; a token's entries are in one partition."""
        t = pa.Table.from_batches(list(batches), pa.schema([(c, pa.int64()) for c in ("token", "block", "part", "least", "most")]))
        token, block, part, least, most = (t.column(k).to_numpy() for k in range(5))
        if not len(token):
            return
        order = np.lexsort((block, token))
        token, block, part, least, most = (x[order] for x in (token, block, part, least, most))
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(token)) + 1, [len(token)]])
        found = [np.zeros((0, 2), np.int64)]
        held = 0
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            for i in range(s, e - 1):
                # Sets in the ratio of their sizes under PERCENT can't link.
                fits = (part[i + 1 : e] != part[i]) & (100 * most[i + 1 : e] >= PERCENT * least[i]) & (100 * most[i] >= PERCENT * least[i + 1 : e])
                other = block[i + 1 : e][fits]
                if len(other):
                    found.append(np.stack([np.full(len(other), block[i]), other], 1))
                    held += len(other)
            if held > 1_000_000:
                found, held = [np.unique(np.concatenate(found), axis=0)], 0
        pairs = np.unique(np.concatenate(found), axis=0)
        yield pa.RecordBatch.from_arrays([_ints(pairs[:, 0]), _ints(pairs[:, 1])], ["p", "q"])

    pairs = cut(matrix.repartition("token").mapInArrow(meet, "p long, q long").distinct())
    nodes = nodes.select("block", "node", "n", "shared")
    ranked = _bounded(pairs, cut(_outlines(nodes)))
    # The larger block stays in place and its partners' nodes come to it, in shares of about GUESTS.
    home = F.col("mp") >= F.col("mq")
    ask = ranked.select(F.when(home, F.col("p")).otherwise(F.col("q")).alias("home"), F.when(home, F.col("q")).otherwise(F.col("p")).alias("guest"), F.least("mp", "mq").alias("m"))
    ask = cut(ask)
    shares = ask.groupBy("home").agg(F.ceil(F.sum("m") / GUESTS).alias("k"))
    guests = ask.join(shares, "home").withColumn("share", F.pmod(F.xxhash64("guest"), "k")).select("home", "share", "guest")
    guests = guests.join(nodes.toDF("guest", "g_node", "g_n", "g_shared"), "guest")
    homes = nodes.join(shares.withColumnRenamed("home", "block"), "block").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))

    def across(left: pa.Table, right: pa.Table) -> pa.Table:
        out_a, out_b = [], []
        if left.num_rows and right.num_rows:
            own = Block(left.column("node").to_numpy(), left.column("n").to_numpy(), left.column("shared").to_pylist())
            cells = right.column("g_shared")
            for i in range(0, right.num_rows, BLOCK):
                part = right.slice(i, BLOCK)
                other = Block(part.column("g_node").to_numpy(), part.column("g_n").to_numpy(), cells.slice(i, BLOCK).to_pylist())
                found = own.links(other)
                if len(found):
                    # A spanning set of this two-sided piece.
                    m = len(own.node)
                    root = _roots(m + len(other.node), np.stack([found[:, 1], found[:, 0] + m], 1))
                    names = np.concatenate([own.node, other.node])
                    rest = np.flatnonzero(root != np.arange(len(names)))
                    out_a.append(names[root[rest]])
                    out_b.append(names[rest])
        a = np.concatenate(out_a) if out_a else np.zeros(0, np.int64)
        b = np.concatenate(out_b) if out_b else np.zeros(0, np.int64)
        return pa.table({"a": _ints(a), "b": _ints(b)})

    opened = homes.select("block", "share", "node", "n", "shared").groupBy("block", "share").cogroup(guests.groupBy("home", "share")).applyInArrow(across, "a long, b long")
    return within.unionByName(opened)


def components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label): the smallest label of each node's component, by propagation along edges and pointer jumping.

    edges: (a, b); labels: (node, label), for at least every node of an edge. Each round is written out, so a lost
    executor never repeats earlier rounds; rounds grow with the logarithm of a component's diameter.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    both = cut(both)
    state = cut(labels.join(both.select(F.col("a").alias("node")).distinct(), "node", "left_semi"))
    while True:
        near = both.join(state.toDF("b", "label"), "b").groupBy("a").agg(F.min("label").alias("best"))
        step = state.join(near.toDF("node", "best"), "node").select("node", F.col("label").alias("old"), F.least("label", "best").alias("label"))
        # Jump: follow the label's own label.
        jump = step.select(F.col("old").alias("label"), F.col("label").alias("far")).groupBy("label").agg(F.min("far").alias("far"))
        new = cut(step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        if new.where(F.col("old") != F.col("label")).isEmpty():
            return new.select("node", "label")
        state = new.select("node", "label")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    docs = docs.select("doc_id", "text")
    every = cut(sets(docs))
    rep = every.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("label"), F.count("*").alias("copies"))
    edges = links(docs)
    joined = components(edges, rep.select("node", "label"))
    # Nodes that several documents or a link touch; all others are their own component.
    known = rep.where("copies > 1").select("node", "label").join(joined.toDF("node", "far"), "node", "full_outer")
    known = cut(known.select("node", F.coalesce("far", "label").alias("component_id")))
    out = every.join(known, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


#: Links by counting shared n-grams of all pairs, components by reachability: for small tables.
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {N} THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - {N - 2}), lambda i: array_to_string(w[i:i + {N - 1}], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
link AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * m >= {PERCENT} * (na.n + nb.n - m)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS at FROM documents UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.at)
SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reach.at) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, the one with its smallest doc_id (null ids last).

    Documents are told apart by doc_id and text, null-safely: rows that share an id but not a text are different
    documents, rows equal in both are one.
    """
    none, text_id = F.col("doc_id").isNull(), F.xxhash64("text")
    keyed = docs.select(F.struct(none.alias("none"), "doc_id", text_id.alias("text_id")).alias("doc_id"), "text")
    first = near_duplicates(keyed).where(F.col("doc_id") == F.col("component_id")).select("doc_id.*").distinct()
    first = first.select(F.col("doc_id").alias("__hg_id"), F.col("text_id").alias("__hg_first"))
    own = docs.withColumn("__hg_tid", text_id)
    kept = own.join(first, F.col("doc_id").eqNullSafe(F.col("__hg_id")) & (F.col("__hg_tid") == F.col("__hg_first")), "left_semi")
    w = Window.partitionBy("doc_id", "__hg_tid").orderBy("__hg_tid")
    return kept.withColumn("__hg_r", F.row_number().over(w)).where("__hg_r = 1").select(*docs.columns)
