"""Line dedup by a segment-partition edit join.

Lines of at least `min_chars` characters take part. A line is dropped if it isn't the first occurrence of its text in
the corpus (by doc_id, then line number), or if some earlier line is within `TAU` edits of it. Shorter lines are kept; with
`short_repeats`, as the pipeline stage has it, exact repeats of those that hold a word are dropped too, and only the edit
join leaves them out.

Exact repeats are found by a 128-bit line hash with partial aggregation, so a line that a third of all rows share costs
one row a task. For the edit join a line is split into TAU + 1 nearly equal segments; two lines within TAU edits agree
in one segment of the shorter, at a place shifted by few characters. Segments are indexed by (length, number, hash), and
the longer line is probed with the substrings that a multi-match-aware window of places allows for each length. All
hashes come from prefix sums of a polynomial hash over the code points of a batch, without a Python loop over lines.

A line needs one earlier line as its witness, not all its pairs, so no pair ever leaves a task:

1. Postings travel packed (21 bytes). In a segment's bucket, lines without a partner by a character-count signature (each
   edit moves counts by at most 2) go; each other line leaves once, as a member of the bucket.
2. Only members' lines are read again, through a bit set of fixed size, with their places.
3. A bucket of more than HOT lines is split by a second segment: the parts left and right of the shared one are within the
   remaining edits, so they are segmented and probed in the same way. What still holds more than GRID lines is dealt as a
   grid of cells, each line a prober in one row and a witness in one column, which bounds a task's memory.
4. In its bucket a line is compared with earlier lines, earliest first, by a banded bit-parallel edit distance, until one
   is close. Near copies of one line are settled by the first few.

Defined results: null texts stay null, empty texts empty; very long texts and lines are handled whole; rows equal in
doc_id and text are one document; null ids come first in the order; the text's other lines keep their order; an empty
table gives an empty result; extra columns pass through, but for n_lines and n_kept_lines, which `dedup_lines` replaces
(the stage keeps them as they came).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codepoints import LIMIT, chunks
from .common import SPACE, cut, read, splitmix, trim
from .packed import SCHEMA, exchange, pack, parts_for, unpack

TAU = 2
MIN_CHARS = 24
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
#: code: segment, length difference and shift of a posting (see _code).
POSTING = np.dtype([("k", "<u4"), ("line", "<u8"), ("sig", "<u8"), ("code", "u1")])
#: Buckets of more members are split by a second segment; those of more after that are dealt as a grid.
HOT, GRID = 4096, 8192
#: Bytes of postings that a task gathers before it sends them.
HELD = 24 << 20
#: Bits of the set of lines that are read again.
SEEN_BITS = 24
#: What a text or line with a word matches.
WORD = r"[^\x20\x09-\x0D]"


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_values: dict[int, np.ndarray] = {}


def _tables(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of base and of its inverse for at least n places, and the value of each code point; kept by the worker."""
    key = int(base)
    if key not in _powers or len(_powers[key][0]) < n:
        up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
        up[1:], down[1:] = base, _inverse(base)
        _powers[key] = (np.cumprod(up, out=up), np.cumprod(down, out=down))
    if key not in _values:
        _values[key] = splitmix(np.arange(LIMIT, dtype=np.uint64) + base)
    return *_powers[key], _values[key]


class Hasher:
    """Hashes of any substring of an array of code points, from prefix sums modulo 2**64."""

    def __init__(self, points: np.ndarray, base: np.uint64):
        n = len(points)
        up, self.down, values = _tables(base, n + 1)
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum(values[points] * up[:n], out=self.sum[1:])

    def of(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return splitmix((self.sum[start + size] - self.sum[start]) * self.down[start] + size.astype(np.uint64) * BASES[0])


def lines_of(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, line number, start, size) of every line of the texts of a chunk."""
    breaks = np.flatnonzero(points == 10)
    begin = np.concatenate([[0], breaks[:-1] + 1]) if len(breaks) else np.zeros(0, np.int64)
    doc = np.searchsorted(starts, begin, side="right") - 1
    first = np.searchsorted(begin, starts)
    return doc, np.arange(len(begin)) - first[doc], begin, breaks - begin


def segments(size: np.ndarray, i: int, tau: int = TAU) -> tuple[np.ndarray, np.ndarray]:
    """(place, size) of segment i of tau + 1 of strings of these sizes: the last ones are longer by one where sizes don't
    divide."""
    q, r = size // (tau + 1), size % (tau + 1)
    longer = i - (tau + 1 - r)
    return i * q + np.maximum(longer, 0), q + (longer >= 0)


def shifts(i: int, delta: int, tau: int = TAU) -> range:
    """Shifts at which a string longer by delta may hold segment i, with i edits at most before it and tau - i behind."""
    return range(max(-i, delta - (tau - i)), min(i, delta + tau - i) + 1)


def _key(h: np.ndarray, size: np.ndarray, i: int) -> np.ndarray:
    return splitmix(h ^ splitmix(size.astype(np.uint64) * np.uint64(TAU + 1) + np.uint64(i + 1)))


def _code(i: int, d: int, shift: int) -> int:
    return i + (TAU + 1) * (d + (TAU + 1) * (shift + TAU))


#: Codes of index entries, which also probe; all others only probe.
INDEX = tuple(_code(i, 0, 0) for i in range(TAU + 1))
_CODES = {_code(i, d, x): (i, d, x) for i in range(TAU + 1) for d in range(TAU + 1) for x in shifts(i, d)}


def postings(hasher: Hasher, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(rows, keys, code)."""
    rows = np.arange(len(start))
    for code, (i, d, shift) in _CODES.items():
        m = size - d  # the size of the indexed, shorter line
        p, n = segments(m, i)
        s = p + shift
        ok = (s >= 0) & (s <= size - n) & (n > 0)
        at = rows if ok.all() else rows[ok]
        if len(at):
            yield at, _key(hasher.of(start[at] + s[at], n[at]), m[at], i), code


_kinds: np.ndarray | None = None


def signature(points: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sixteen character-class counts of each line, modulo 16, in 64 bits."""
    global _kinds
    if _kinds is None:
        _kinds = (splitmix(np.arange(LIMIT, dtype=np.uint64)) >> np.uint64(60)).astype(np.uint8)
    kind = _kinds[points]
    out = np.zeros(len(start), np.uint64)
    # Four counts to a running sum, in fields of 16 bits; lines so long that fields could overflow are counted one by one.
    total = np.zeros(len(points) + 1, np.uint64)
    for k in range(0, 16, 4):
        one = np.zeros(16, np.uint64)
        one[k : k + 4] = np.uint64(1) << np.arange(0, 64, 16, dtype=np.uint64)
        np.cumsum(one[kind], out=total[1:])
        sums = total[start + size] - total[start]
        for f in range(4):
            out |= ((sums >> np.uint64(16 * f)) & np.uint64(15)) << np.uint64(4 * (k + f))
    for r in np.flatnonzero(size >= 1 << 16):
        counts = np.bincount(kind[start[r] : start[r] + size[r]], minlength=16).astype(np.uint64) & np.uint64(15)
        out[r] = np.bitwise_or.reduce(counts << np.arange(0, 64, 4, dtype=np.uint64))
    return out


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = np.zeros(np.broadcast(x, y).shape, np.uint8)
    for k in range(0, 64, 4):
        a, b = (((z >> np.uint64(k)) & np.uint64(15)).astype(np.uint8) for z in (x, y))
        e = (a - b) & np.uint8(15)
        d += np.minimum(e, np.uint8(16) - e)
    return d


def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix of whether two signatures may belong to lines within TAU edits."""
    return _apart(a[:, None], b[None, :]) <= 2 * TAU


def edit_distance(a: str, b: str, most: int = TAU) -> int:
    """Edit distance if at most `most`, else most + 1: bit-parallel, on a diagonal band of 64 bits (Hyyro's banded form)."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    n = 0
    while n < len(b) and a[n] == b[n]:
        n += 1
    a, b = a[n:], b[n:]
    n = 0
    while n < len(b) and a[-1 - n] == b[-1 - n]:
        n += 1
    a, b = a[: len(a) - n], b[: len(b) - n]
    if not b:
        return len(a)
    full = (1 << 64) - 1
    match: dict[str, int] = {}
    for i, c in enumerate(a):
        match[c] = match.get(c, 0) | 1 << i
    vp, vn = (full << (64 - most - 1)) & full, 0
    dist, at = min(most, len(a)), most + 1 - 64
    side = 1 << 62 + min(0, len(a) - most)  # the last row, once it is in the band
    for i, c in enumerate(b):
        pm = match.get(c, 0)
        x = (pm >> at if at >= 0 else pm << -at) & full
        d0 = ((((x & vp) + vp) & full) ^ vp) | x | vn
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        if i < len(a) - most:
            dist += not d0 >> 63 & 1
        else:
            dist += bool(hp & side) - bool(hn & side)
            side >>= 1
        vp = (hn | ~((d0 >> 1) | hp)) & full
        vn = (d0 >> 1) & hp
        at += 1
    return min(dist, most + 1)


def _eligible(points, starts, ends, min_chars, short_repeats=False):
    doc, number, start, size = lines_of(points, starts, ends)
    ok = size >= min_chars
    if short_repeats:
        solid = np.zeros(len(points) + 1, np.int64)
        np.cumsum((points != 32) & ((points < 9) | (points > 13)), out=solid[1:])
        ok |= solid[start + size] > solid[start]
    return doc[ok], number[ok], start[ok], size[ok]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def occurrences(docs: DataFrame, min_chars: int, short_repeats: bool = False) -> DataFrame:
    """(h1, h2, doc_id, text_id, line) of every line that takes part."""
    src = docs.select("doc_id", F.xxhash64("text").alias("text_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, _, points, starts, ends in chunks(b.column(2)):
                doc, number, start, size = _eligible(points, starts, ends, min_chars, short_repeats)
                h1, h2 = (Hasher(points, base).of(start, size) for base in BASES)
                at = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays([_signed(h1), _signed(h2), b.column(0).take(at), b.column(1).take(at), pa.array(number, pa.int64())], ["h1", "h2", "doc_id", "text_id", "line"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"h1 long, h2 long, doc_id {kind}, text_id long, line long")


def members(docs: DataFrame, min_chars: int) -> DataFrame:
    """(bucket, id, sig, code, hot): lines, by hash, in the buckets of segments where they may have a partner within TAU
    edits; all lines of buckets that are too large to look."""
    partitions, parts = parts_for(docs, 1.3)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, records, held = [], [], 0
        for b in batches:
            for _, _, _, points, starts, ends in chunks(b.column(0)):
                _, _, start, size = _eligible(points, starts, ends, min_chars)
                if not len(start):
                    continue
                hasher = Hasher(points, BASES[0])
                line = hasher.of(start, size)
                line, once = np.unique(line, return_index=True)
                start, size = start[once], size[once]
                sig = signature(points, start, size)
                for rows, keys, code in postings(hasher, start, size):
                    r = np.empty(len(rows), POSTING)
                    r["k"], r["line"], r["sig"], r["code"] = keys & np.uint64(0xFFFFFFFF), line[rows], sig[rows], code
                    records.append(r)
                    part.append(((keys >> np.uint64(32)) % np.uint64(parts)).astype(np.int32))
                    held += r.nbytes
                if held >= HELD:
                    yield from pack(np.concatenate(part), np.concatenate(records))
                    part, records, held = [], [], 0
        if records:
            yield from pack(np.concatenate(part), np.concatenate(records))
        trim()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, r = unpack(batches, POSTING)
        key = part.astype(np.uint64) << np.uint64(32) | r["k"]
        order = np.argsort(key, kind="stable")
        same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        multi = np.zeros(len(key), bool)
        multi[same] = multi[same + 1] = True
        order = order[multi]
        key, line, sig, code = key[order], r["line"][order], r["sig"][order], r["code"][order]
        del r, part, order
        # Repeats of one line, as of several batches, are one.
        order = np.lexsort((code, line, key))
        key, line, sig, code = key[order], line[order], sig[order], code[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1]) | (code[1:] != code[:-1])
        key, line, sig, code = key[new], line[new], sig[new], code[new]
        index = np.isin(code, INDEX)
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]) if len(key) else np.zeros(1, int)
        width = np.diff(bounds)
        wanted, hot = np.zeros(len(key), bool), np.zeros(len(key), bool)
        in_small = np.repeat((width > 1) & (width <= 32), width)
        for step in range(1, min(32, int(width.max(initial=1)))):
            x = np.flatnonzero(in_small[:-step] & (key[step:] == key[:-step]))
            y = x + step
            x, y = (z[(index[x] | index[y]) & (line[x] != line[y])] for z in (x, y))
            ok = _apart(sig[x], sig[y]) <= 2 * TAU
            wanted[x[ok]] = wanted[y[ok]] = True
        for g in np.flatnonzero(width > 32):
            s, e = bounds[g], bounds[g + 1]
            own = s + np.flatnonzero(index[s:e])
            if not len(own) or (line[s:e] == line[s]).all():
                continue
            if e - s > HOT:
                wanted[s:e] = hot[s:e] = True
                continue
            for x in range(s, e, 512):
                z = min(x + 512, e)
                near = close(sig[x:z], sig[own]) & (line[x:z, None] != line[None, own])
                wanted[x:z] |= near.any(1)
                wanted[own] |= near.any(0)
        for x in range(0, len(key), 1 << 20):
            at = x + np.flatnonzero(wanted[x : x + (1 << 20)])
            if len(at):
                yield pa.RecordBatch.from_arrays([_signed(key[at]), _signed(line[at]), _signed(sig[at]), pa.array(code[at].astype(np.int32)), pa.array(hot[at])], ["bucket", "id", "sig", "code", "hot"])
        trim()

    return exchange(docs.select("text").mapInArrow(emit, SCHEMA), partitions).mapInArrow(meet, "bucket long, id long, sig long, code int, hot boolean")


def _bitset(ids: DataFrame) -> np.ndarray:
    """A set of fixed size (2 MB) that holds the low bits of ids."""
    word = F.expr(f"cast(shiftrightunsigned(id, 6) & {(1 << (SEEN_BITS - 6)) - 1} as int)").alias("w")
    rows = ids.select(word, F.expr("shiftleft(1L, cast(id & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    out = np.zeros(1 << (SEEN_BITS - 6), np.int64)
    for r in rows:
        out[r["w"]] = r["b"]
    return out.view(np.uint64)


def _lines(docs: DataFrame, ids: DataFrame, min_chars: int) -> DataFrame:
    """(id, line, at): the lines of these hashes, with the place of the first."""
    seen = docs.sparkSession.sparkContext.broadcast(_bitset(ids))
    src = docs.select("doc_id", F.xxhash64("text").alias("text_id"), "text")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = seen.value
        for b in batches:
            for i, _, own, points, starts, ends in chunks(b.column(2)):
                doc, number, start, size = _eligible(points, starts, ends, min_chars)
                h = Hasher(points, BASES[0]).of(start, size)
                word = (h >> np.uint64(6)) & np.uint64(len(table) - 1)
                hit = np.flatnonzero(table[word] >> (h & np.uint64(63)) & np.uint64(1))
                _, once = np.unique(h[hit], return_index=True)
                first = np.zeros(len(hit), bool)
                first[once] = True  # the text is sent once a chunk, the place of every repeat
                text = [own[doc[k]][start[k] - starts[doc[k]] : start[k] - starts[doc[k]] + size[k]] if f else None for k, f in zip(hit, first, strict=True)]
                at = pa.array(doc[hit] + i)
                yield pa.RecordBatch.from_arrays([_signed(h[hit]), b.column(0).take(at), pa.array(number[hit], pa.int64()), b.column(1).take(at), pa.array(text, pa.string())], ["id", "doc_id", "number", "text_id", "line"])

    kind = src.schema["doc_id"].dataType.simpleString()
    found = src.mapInArrow(again, f"id long, doc_id {kind}, number long, text_id long, line string")
    # Grouped before the join: a line of very many texts is one row a task.
    return found.groupBy("id").agg(F.min(F.struct("doc_id", "number", "text_id")).alias("at"), F.min("line").alias("line")).join(ids, "id", "left_semi")


def _mixed(*parts: np.ndarray) -> np.ndarray:
    out = np.full(len(parts[0]), BASES[1])
    for x in parts:
        out = splitmix(out ^ x) * BASES[0]
    return splitmix(out)


def _windows(hasher: Hasher, start: np.ndarray, size: np.ndarray, delta: int, tau: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(segment, whether there, its hash) for each place of each segment that strings (start, size) may share with strings
    shorter by delta and within tau edits."""
    for j in range(tau + 1):
        q, w = segments(size - delta, j, tau)
        for shift in shifts(j, delta, tau):
            s = q + shift
            ok = (s >= 0) & (w >= 0) & (s + w <= size)
            yield j, ok, hasher.of(start + np.where(ok, s, 0), np.where(ok, w, 0))


def _second(bucket: np.ndarray, code: int, hasher: Hasher, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, keys) of a hot bucket's lines by another segment of what is left and right of the shared one."""
    i, d, shift = _CODES[code]
    p, n = segments(size - d, i)
    s = p + shift
    left = (start, s, shift, i)
    right = (start + s + n, size - s - n, d - shift, TAU - i)
    for j, ok, h in _windows(hasher, *left):
        for k, ok2, h2 in _windows(hasher, *right):
            rows = np.flatnonzero(ok & ok2)
            if len(rows):
                yield rows, _mixed(bucket[rows], np.full(len(rows), np.uint64(j * (TAU + 1) + k)), h[rows], h2[rows])


def _refined(full: DataFrame) -> DataFrame:
    """(bucket, id, sig, index, at, line): members of hot buckets under a second segment, all others as they are."""
    kind = full.schema["at"].dataType.simpleString()
    names = ["bucket", "id", "sig", "index", "at", "line"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, hot = b.column("code").to_numpy(), b.column("hot").to_numpy(zero_copy_only=False)
            index = np.isin(code, INDEX)
            for calm in [np.flatnonzero(~hot)]:
                yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(calm)) if c != "index" else pa.array(index[calm]) for c in names], names)
            rows = np.flatnonzero(hot)
            if not len(rows):
                continue
            picked = b.take(pa.array(rows))
            bucket = picked.column("bucket").to_numpy().view(np.uint64)
            for i, j, _, points, starts, ends in chunks(picked.column("line")):
                hasher, own = Hasher(points, BASES[0]), np.arange(i, j)
                for c in np.unique(code[rows[i:j]]):
                    of = own[code[rows[i:j]] == c]
                    for at, key in _second(bucket[of], int(c), hasher, starts[of - i], (ends - starts)[of - i]):
                        take = pa.array(of[at])
                        yield pa.RecordBatch.from_arrays([_signed(key), *(picked.column(x).take(take) if x != "index" else pa.array(index[rows[of[at]]]) for x in names[1:])], names)

    return full.mapInArrow(run, f"bucket long, id long, sig long, index boolean, at {kind}, line string")


def near_losers(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1): hashes of lines within TAU edits of a different line that comes first earlier."""
    found = cut(members(docs, min_chars))
    lines = _lines(docs, found.select("id").distinct(), min_chars)
    known = cut(_refined(found.join(lines, "id")))
    shares = known.groupBy("bucket").count().where(F.col("count") > GRID).select("bucket", F.ceil(F.col("count") / GRID).alias("k"))
    dealt = known.join(shares, "bucket", "left").withColumn("slot", F.pmod(F.xxhash64("id", "bucket"), "k"))
    # Cells (row, column): a line probes in all cells of its row and is a witness in all of its column.
    cell = F.explode(F.when(F.col("k").isNull(), F.array(F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(0).alias("side")))).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda y: F.struct(F.col("slot").alias("x"), y.alias("y"), F.lit(1).alias("side"))),
            F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda x: F.struct(x.alias("x"), F.col("slot").alias("y"), F.lit(2).alias("side"))),
        )
    ))
    cells = dealt.withColumn("cell", cell).select(F.xxhash64("bucket", "cell.x", "cell.y").alias("cell"), "at", "id", "sig", "index", F.col("cell.side").alias("side"), "line")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by cell and place."""
        lost: set[int] = set()
        held: list[pa.RecordBatch] = []

        def done() -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            key = t.column("cell").to_numpy()
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            ids, index, side = (t.column(c).to_numpy(zero_copy_only=False) for c in ("id", "index", "side"))
            sig, text = t.column("sig").to_numpy().view(np.uint64), t.column("line").to_pylist()
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                if index[s:e].any():
                    _settle(ids[s:e], sig[s:e], side[s:e], text[s:e], lost)

        for b in batches:  # a cell may run over several batches: hold its rows until the next begins
            while b.num_rows:
                key = b.column(0).to_numpy()
                if held and held[-1].column(0)[-1].as_py() != key[0]:
                    done()
                    held = []
                last = int(np.flatnonzero(key == key[-1])[0])
                if last and last < len(key):
                    held.append(b.slice(0, last))
                    done()
                    held = []
                    b = b.slice(last)
                held.append(b)
                b = b.slice(b.num_rows)
        if held:
            done()
        yield pa.RecordBatch.from_arrays([pa.array(sorted(lost), pa.int64())], ["h1"])

    rows = cells.repartition("cell").sortWithinPartitions("cell", "at").select("cell", "id", "sig", "index", "side", "line")
    return rows.mapInArrow(settle, "h1 long").distinct()


def _settle(ids: np.ndarray, sig: np.ndarray, side: np.ndarray, text: list[str], lost: set[int]) -> None:
    """Add the ids of lines that have a witness among the lines before them in this cell."""
    for x in range(0, len(ids), 256):
        z = min(x + 256, len(ids))
        near = close(sig[x:z], sig[:z]) & (side[None, :z] != 1) & (ids[x:z, None] != ids[None, :z])
        for r in range(x, z):
            if side[r] == 2 or int(ids[r]) in lost:
                continue
            for y in np.flatnonzero(near[r - x, :r]):
                if edit_distance(text[y], text[r]) <= TAU:
                    lost.add(int(ids[r]))
                    break


def _deduped(docs: DataFrame, min_chars: int, short_repeats: bool) -> DataFrame:
    """docs and __hg_out: (text, n_lines, n_kept_lines)."""
    first = occurrences(docs, min_chars, short_repeats).groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line", "text_id")).alias("at"))
    first = cut(first)
    left = first.join(near_losers(docs, min_chars), "h1", "left_anti")
    kept = left.groupBy("at.doc_id", "at.text_id").agg(F.collect_list(F.col("at.line").cast("int")).alias("__hg_kept"))

    @F.arrow_udf("struct<text string, n_lines long, n_kept_lines long>")
    def apply(texts: pa.Array, kept: pa.Array) -> pa.Array:
        out = []
        for t, k in zip(texts.to_pylist(), kept.to_pylist(), strict=True):
            if t is None:
                out.append({})
                continue
            lines, k = t.split("\n"), set(k or ())
            free = (lambda x: not x.strip(SPACE)) if short_repeats else (lambda x: True)
            stay = [x for i, x in enumerate(lines) if i in k or len(x) < min_chars and free(x)]
            out.append({"text": "\n".join(stay), "n_lines": len(lines), "n_kept_lines": len(stay)})
        return pa.array(out, pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_kept_lines", pa.int64())]))

    apply = apply.asNondeterministic()  # so that a filter on the new text does not work it out again
    own = docs.withColumn("__hg_tid", F.xxhash64("text")).alias("d")
    right = kept.toDF("__hg_id", "__hg_rid", "__hg_kept").alias("k")
    both = own.join(right, (F.col("doc_id").eqNullSafe(F.col("__hg_id"))) & (F.col("__hg_tid") == F.col("__hg_rid")), "left")
    return both.withColumn("__hg_out", apply("text", "__hg_kept"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, short_repeats: bool = False) -> DataFrame:
    """docs with the text's repeated lines removed, and n_lines, n_kept_lines (null texts: null)."""
    out = _deduped(docs, min_chars, short_repeats)
    columns = [c for c in docs.columns if c not in ("n_lines", "n_kept_lines")]
    return out.select(*[F.col("__hg_out.text").alias(c) if c == "text" else F.col(c) for c in columns], "__hg_out.n_lines", "__hg_out.n_kept_lines")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_kept_lines", F.length("text").cast("long").alias("kept_chars"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their repeated lines removed; a document of which no word is left goes."""
    out = _deduped(docs, MIN_CHARS, True)
    new = {"text": F.col("__hg_out.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("__hg_out.text").cast(docs.schema["n_chars"].dataType)
    return out.where(F.col("__hg_out.text").rlike(WORD)).select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


ORACLE = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d),
f AS (SELECT line, min(struct_pack(d := doc_id, i := i)) AS p, length(line) AS n FROM l WHERE length(line) >= {MIN_CHARS} GROUP BY line),
g AS (SELECT *, substr(line, 1, n // 3) AS s1, substr(line, 1 + n // 3, CASE WHEN n % 3 = 2 THEN n // 3 + 1 ELSE n // 3 END) AS s2,
             substr(line, 1 + n // 3 + CASE WHEN n % 3 = 2 THEN n // 3 + 1 ELSE n // 3 END) AS s3 FROM f),
c AS (SELECT a.line AS la, b.line AS lb, a.p AS pa, b.p AS pb FROM g a JOIN f b ON b.n IN (a.n, a.n + 1, a.n + 2) AND a.line <> b.line
      AND (contains(b.line, a.s1) OR contains(b.line, a.s2) OR contains(b.line, a.s3))),
x AS (SELECT DISTINCT CASE WHEN pa < pb THEN lb ELSE la END AS line FROM c WHERE levenshtein(la, lb) <= {TAU}),
k AS (SELECT f.line, f.p FROM f ANTI JOIN x ON f.line = x.line),
r AS (SELECT l.doc_id, l.i, l.line FROM l LEFT JOIN k ON l.line = k.line AND k.p.d = l.doc_id AND k.p.i = l.i WHERE length(l.line) < {MIN_CHARS} OR k.line IS NOT NULL),
t AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS t FROM r GROUP BY doc_id)
SELECT d.doc_id, len(ls)::BIGINT AS n_lines, coalesce(t.n, 0)::BIGINT AS n_kept_lines, length(coalesce(t.t, ''))::BIGINT AS kept_chars, md5(coalesce(t.t, '')) AS kept_md5
FROM d LEFT JOIN t ON d.doc_id = t.doc_id
"""
