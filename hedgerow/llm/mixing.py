"""Mixing sources to target weights by Pareto order sampling.

Targets: sources by code point (null last) weigh 5, 2, 1, repeating, and share `budget` times all words; a target stops
at `most` times its source's size and the excess is shared again by weight (water filling: target = min(cap, level *
weight)). Copies: every document of a source gets floor(target / size) whole copies; the rest of the target is drawn as
an unequal-probability sample. A document's inclusion intensity is proportional to the bit length of its size (longer
documents are likelier); intensities of 1 or more are certain and become a whole copy; the others are ranked by the
Pareto key, random odds u / (1 - u) divided by inclusion odds p / (1 - p), and the leading documents are taken until
the words taken come nearest the target. u comes from md5 of doc_id, so reruns agree.

Scale: sizes are computed once and written as a narrow table; sources are summed with partial aggregation. The cut in
the ranking is found by histograms: keys are binned (monotone in the key), bins are summed per source before the
shuffle, and only the bin in which the cut falls is looked at again with finer bins, until it is small; only that last
bin is ranked in a window. So no source, however large, is sorted in one task.

Defined results: null text has size 0; null sources form one source, ranked last; sources without words have target 0;
repeated rows of one doc_id are separate documents (equal ones are interchangeable); an empty table gives no rows.
The list of sources with their sizes is held by the driver, as the weights are its configuration.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, read, unit, word_count

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
MOST = 2
#: A boundary bin of at most so many rows is ranked by a window; larger ones are binned again.
RANKED = 20_000
BINS = 1024
#: Bits of the whole number that stands for a key's logarithm (within +-128) in the binning.
RANK_BITS = 52


def fill(sizes: list[tuple[str | None, int]], weights=WEIGHTS, budget: float = BUDGET, most: int = MOST) -> list[float]:
    """Water-filled targets of sources in their order."""
    total, caps = budget * sum(n for _, n in sizes), [most * n for _, n in sizes]
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    order = sorted(range(len(sizes)), key=lambda i: (caps[i] / w[i], i))
    full, open_w = 0.0, float(sum(w))
    out = [0.0] * len(sizes)
    for k, i in enumerate(order):
        level = (total - full) / open_w
        if caps[i] / w[i] <= level:
            out[i] = float(caps[i])
            full, open_w = full + caps[i], open_w - w[i]
            continue
        for j in order[k:]:
            out[j] = (total - full) * w[j] / open_w
        break
    return out


def _source_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    schema = "_name string, _known boolean, source_size long, target double, _base long, _rest double, _f double, _ws long"
    return spark.createDataFrame(rows, schema)


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", weights=WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """One row a document: its id, source, size, source_size, target, copies and taken."""
    spark = docs.sparkSession
    size = F.col("size")
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    # The bit length of a size is its weight within the source; whole numbers keep all sums exact.
    narrow = cut(narrow.withColumn("_w", F.when(size > 0, F.length(F.bin(size))).otherwise(0).cast("long")))
    sums = narrow.groupBy("source").agg(F.sum("size").alias("s"), F.sum(size * F.col("_w")).alias("ws")).collect()
    sums.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    goals = fill([(r["source"], r["s"]) for r in sums], weights, budget, most)
    rows = []
    for r, t in zip(sums, goals, strict=True):
        base = int(t // r["s"]) if r["s"] else 0
        rest = t - base * r["s"]
        rows.append((r["source"] or "", r["source"] is not None, r["s"], t, base, rest, rest / r["s"] if r["s"] else 0.0, r["ws"]))
    table = _source_rows(spark, rows)
    small = F.broadcast(table) if len(rows) <= 20_000 else table  # some 100 bytes a source
    name = F.coalesce(F.col("source"), F.lit(""))
    known = F.col("source").isNotNull()
    x = F.col("_f") * F.col("_w") * F.col("source_size") / F.greatest(F.col("_ws"), F.lit(1))
    sure = x >= 1
    u = unit(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    key = F.when(sure | (x <= 0), F.lit(float("inf"))).otherwise((u / (1 - u)) / (x / (1 - x)))
    keyed = (
        narrow.join(small, (name == F.col("_name")) & (known == F.col("_known")))
        .withColumns({"_sure": sure & (size > 0), "_key": key})
        .withColumn("_rank", F.when(F.col("_key") < float("inf"), F.floor((F.ln("_key") + 128) * float(1 << (RANK_BITS - 8)))).otherwise((1 << RANK_BITS) - 1))
        .withColumn("_slot", F.struct("_key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), "size"))
    )
    certain = {(r["_name"], r["_known"]): r["n"] for r in keyed.where("_sure").groupBy("_name", "_known").agg(F.sum("size").alias("n")).collect()}
    left = {(r[0], r[1]): r[5] - certain.get((r[0], r[1]), 0) for r in rows}
    cuts = _cuts(keyed.where(~F.col("_sure") & (size > 0) & (F.col("_f") > 0)), left)
    limit = spark.createDataFrame(
        [(*k, lo, hi, *(slot or (None, None, None))) for k, (lo, hi, slot) in cuts.items()],
        "_name string, _known boolean, _lo long, _hi long, _ck double, _ci string, _cs long",
    )
    limit = F.broadcast(limit) if len(rows) <= 20_000 else limit
    got = keyed.join(limit, ["_name", "_known"], "left")
    last = F.struct(F.col("_ck").alias("_key"), F.col("_ci").alias("_id"), F.col("_cs").alias("size"))
    ahead = (F.col("_rank") < F.col("_lo")) | ((F.col("_rank") < F.col("_hi")) & F.col("_ck").isNotNull() & (F.col("_slot") <= last))
    drawn = ~F.col("_sure") & (size > 0) & (F.col("_f") > 0) & F.coalesce(ahead, F.lit(False))
    copies = F.col("_base") + F.when((F.col("_sure") & (size > 0)) | drawn, 1).otherwise(0)
    return got.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * size).cast("long").alias("taken"))


def _cuts(rows: DataFrame, left: dict[tuple, float]) -> dict[tuple, tuple]:
    """Where the ranking of each source is cut: all ranks below lo are taken, and in [lo, hi) the slots up to the last."""
    spark = rows.sparkSession
    state = {k: (0, RANK_BITS, 0) for k, n in left.items() if n > 0}  # first rank, bits of the range, words before it
    done: dict[tuple, tuple] = {}
    step = BINS.bit_length() - 1
    while state:
        span = spark.createDataFrame([(*k, *v, max(v[1] - step, 0), left[k]) for k, v in state.items()], "_name string, _known boolean, _lo long, _bits int, _before long, _shift int, _left double")
        span = F.broadcast(span) if len(state) <= 20_000 else span
        inside = rows.join(span, ["_name", "_known"]).where((F.col("_rank") >= F.col("_lo")) & F.expr("shiftright(_rank - _lo, _bits) = 0"))
        found = inside.groupBy("_name", "_known", F.expr("shiftright(_rank - _lo, _shift)").alias("b")).agg(F.sum("size").alias("n"), F.count("*").alias("m"))
        by: dict[tuple, list] = {}
        for r in found.collect():  # at most BINS rows a source
            by.setdefault((r["_name"], r["_known"]), []).append((r["b"], r["n"], r["m"]))
        ask, again = {}, {}
        for k, (lo, bits, before) in state.items():
            bins, shift = sorted(by.get(k, [])), max(bits - step, 0)
            for b, n, m in bins:
                if before + n >= left[k] or b == bins[-1][0]:
                    (ask if m <= RANKED or shift == 0 else again)[k] = (lo + (b << shift), shift, before)
                    break
                before += n
        if ask:
            span = spark.createDataFrame([(*k, *v, left[k]) for k, v in ask.items()], "_name string, _known boolean, _lo long, _bits int, _before long, _left double")
            span = F.broadcast(span) if len(ask) <= 20_000 else span
            near = rows.join(span, ["_name", "_known"]).where((F.col("_rank") >= F.col("_lo")) & F.expr("shiftright(_rank - _lo, _bits) = 0"))
            w = Window.partitionBy("_name", "_known").orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
            run = near.withColumn("_cum", F.col("_before") + F.sum("size").over(w))
            taken = run.where(F.col("_cum") - F.col("size") / 2 <= F.col("_left")).groupBy("_name", "_known").agg(F.max("_slot").alias("s"))
            slots = {(r["_name"], r["_known"]): tuple(r["s"]) for r in taken.collect()}
            done |= {k: (lo, lo + (1 << bits), slots.get(k)) for k, (lo, bits, _) in ask.items()}
        state = again
    return done


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a row for each copy taken, with the columns of documents and copy (1, 2), which replaces a column
    of that name."""
    tagged = docs.withColumn("__hg_tid", F.xxhash64("text"))
    taken = mix(tagged.select("text", "source", F.struct("doc_id", "__hg_tid").alias("doc_id")))
    # Rows equal in id and text are drawn alike: the first of them stands for all.
    taken = taken.where("copies > 0").groupBy(F.col("doc_id.doc_id").alias("__hg_id"), F.col("doc_id.__hg_tid").alias("__hg_t")).agg(F.max("copies").alias("__hg_copies"))
    got = tagged.join(taken, F.col("doc_id").eqNullSafe(F.col("__hg_id")) & F.col("__hg_tid").eqNullSafe(F.col("__hg_t")))
    return got.drop("copy").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__hg_copies").cast("int")))).select(*[c for c in docs.columns if c != "copy"], "copy")


ORACLE = """
WITH d AS (SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), '') AS id,
                  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
b AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS bits FROM d),
s AS (SELECT source, sum(size)::BIGINT AS s, sum(size * bits)::BIGINT AS ws FROM b GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3]::DOUBLE AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 2 * s / w, encode(source) NULLS LAST) AS r, 1.5::DOUBLE * sum(s) OVER () AS total FROM w),
f AS (SELECT *, (total - coalesce(sum(2 * s) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) AS rest_total,
             sum(w) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM o),
c AS (SELECT *, min(CASE WHEN 2 * s / w > rest_total / open_w THEN r END) OVER () AS first FROM f),
t AS (SELECT source, s, ws, CASE WHEN first IS NULL OR r < first THEN (2 * s)::DOUBLE
             ELSE max(CASE WHEN r = first THEN rest_total END) OVER () * w / max(CASE WHEN r = first THEN open_w END) OVER () END AS target FROM c),
p AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END AS base FROM t),
q AS (SELECT *, target - base * s AS rest, CASE WHEN s > 0 THEN (target - base * s) / s ELSE 0 END AS f FROM p),
x AS (SELECT b.*, q.s, q.target, q.base, q.rest, q.f, q.f * bits * q.s / greatest(q.ws, 1) AS x,
             (('0x' || substr(md5(b.id), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
      FROM b JOIN q ON b.source IS NOT DISTINCT FROM q.source),
k AS (SELECT *, x >= 1 AND size > 0 AS sure, CASE WHEN x < 1 AND x > 0 THEN (u / (1 - u)) / (x / (1 - x)) END AS key FROM x),
g AS (SELECT *, coalesce(sum(CASE WHEN sure THEN size END) OVER (PARTITION BY source), 0) AS certain,
             sum(CASE WHEN key IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY key NULLS LAST, id, size ROWS UNBOUNDED PRECEDING) AS cum FROM k),
h AS (SELECT *, CASE WHEN sure THEN 1 WHEN key IS NOT NULL AND f > 0 AND rest - certain > 0 AND cum - size / 2.0::DOUBLE <= rest - certain THEN 1 ELSE 0 END AS more FROM g)
SELECT doc_id, size, s AS source_size, target, ((base + more) * size)::BIGINT AS taken FROM h
"""
