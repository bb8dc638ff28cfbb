"""Benchmark decontamination by spaced-seed hashing, in native expressions only.

Words (white space separated, A-Z lower-cased, punctuation deleted) of test items are hashed under fixed masks that
ignore some places of a window, so a substituted word at an ignored place still gives a hit. Documents are matched in
two steps that stay in their row: words outside the test vocabulary become null (a bit set of fixed size over word
hashes, false positives only cost time), and a window is a candidate only if no kept place is null; the conjunction
stops at the first null, so most places cost one look-up. Only candidates are exploded and joined with the test hashes.
A hit is verified on its diagonal: the item is laid over the document at that offset and must agree in at least half of
its words (and no fewer than `min_matches`; the whole item where it is shorter).

Test hashes carry no words (some 40 bytes a row) and are broadcast up to `SEEDS_PER_JOIN` rows; more are joined by hash
with the candidates, which are written once, so the documents are read and hashed once for any number of items. A
candidate carries only the stretch of its document that an item could cover, and an item's words are joined once it is
hit (broadcast up to `ITEM_BYTES`). Documents are never shuffled for the search.

Items shorter than the window are matched by all their words. Defined results: null and empty texts (of either side)
match nothing; very long texts are searched whole; a document row is reported once per item with its best diagonal;
repeated rows of a doc_id are pooled, as are all rows without one; items that share an item_id are laid over each other's
hits too; empty tables give an empty result; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, SPACE_RX, cut, let, read

SPAN = 12
#: Kept places of a window of SPAN words.
MASKS = ((0, 1, 2, 4, 7, 8, 10, 11), (0, 1, 3, 5, 6, 8, 9, 11), (0, 2, 3, 5, 7, 9, 10, 11))
MIN_MATCHES = 8
SEEDS_PER_JOIN = 200_000
ITEM_BYTES = 16 << 20
#: log2 of the bits of the vocabulary set, at most.
MOST_BITS = 22

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PUNCTUATION = ".,;:!?\"'()[]"


def plain_words(text: Column) -> Column:
    body = F.btrim(F.translate(F.coalesce(text, F.lit("")), UPPER + PUNCTUATION, UPPER.lower()), F.lit(SPACE))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACE_RX))


def _hash(h: Column, places: list[Column]) -> Column:
    return F.xxhash64(*[F.get(h, p) for p in places])


def _items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, item): word hashes of each test item with words."""
    return items.select(F.col(id_col).alias("item_id"), F.transform(plain_words(F.col(text_col)), lambda x: F.xxhash64(x)).alias("item")).where(F.size("item") > 0)


def seeds(words: DataFrame) -> DataFrame:
    """Test hashes: mask (-1: a short item as a whole), hash, item_id, item_at (offset in the item)."""
    n = F.size("item")

    def spaced(k: int, mask: tuple[int, ...]) -> Column:
        hashed = lambda i: F.struct(F.lit(k).alias("mask"), _hash(F.col("item"), [i + p for p in mask]).alias("hash"), i.alias("item_at"))
        return F.transform(F.sequence(F.lit(0), n - SPAN), hashed)

    whole = F.array(F.struct((-n).alias("mask"), F.xxhash64("item").alias("hash"), F.lit(0).alias("item_at")))
    every = F.when(n >= SPAN, F.concat(*[spaced(k, m) for k, m in enumerate(MASKS)])).otherwise(whole)
    return words.select("item_id", F.explode(every).alias("s")).select("item_id", "s.*")


def _vocabulary(items: DataFrame, text_col: str) -> Column:
    """Word hash -> whether it may be in the test vocabulary, by an array of 64-bit words in the plan."""
    v = items.select(F.explode(plain_words(F.col(text_col))).alias("w")).select(F.xxhash64("w").alias("h")).distinct()
    n = v.count()
    bits = min(MOST_BITS, max(12, (16 * max(n, 1)).bit_length()))
    word = F.expr(f"cast(shiftrightunsigned(h, 6) & {(1 << (bits - 6)) - 1} as int)").alias("word")
    rows = v.select(word, F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b")).groupBy("word").agg(F.bit_or("b").alias("b")).collect()
    table = [0] * (1 << (bits - 6))  # at most 2**16 numbers
    for r in rows:
        table[r["word"]] = r["b"]
    lit = F.lit(table).cast("array<bigint>")

    def known(h: Column) -> Column:
        at = F.shiftrightunsigned(h, 6).bitwiseAND(F.lit((1 << (bits - 6)) - 1).cast("long")).cast("int")
        hit = F.get(lit, at).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63).cast("long")).cast("int")))
        return hit != 0

    return known


def _candidates(docs: DataFrame, known, lengths: list[int], reach: int) -> DataFrame:
    """doc_id and exploded (mask, at, hash) of the windows that consist of test words, with the word hashes (near) of up to
    reach places before and behind at, from place low on."""
    h = F.transform(plain_words(F.col("text")), lambda x: let(F.xxhash64(x), lambda y: F.when(known(y), y)))
    words = docs.select("doc_id", h.alias("w"))
    n = F.size("w")

    def windows(span: int, places: tuple[int, ...], mask: int, hashed) -> Column:
        ok = lambda i: reduce(lambda a, b: a & b, [F.get(F.col("w"), i + p).isNotNull() for p in places])
        at = F.filter(F.sequence(F.lit(0), n - span), ok)
        rows = F.transform(at, lambda i: F.struct(F.lit(mask).alias("mask"), i.alias("at"), hashed(i).alias("hash")))
        return F.when(n >= span, rows)

    found = [windows(SPAN, m, k, lambda i, m=m: _hash(F.col("w"), [i + p for p in m])) for k, m in enumerate(MASKS)]
    found += [windows(s, tuple(range(s)), -s, lambda i, s=s: F.xxhash64(F.slice(F.col("w"), i + 1, s))) for s in lengths]
    empty = F.array().cast("array<struct<mask:int,at:int,hash:bigint>>")
    every = F.concat(*[F.coalesce(x, empty) for x in found])
    low = F.greatest(F.col("c.at") - reach, F.lit(0))
    return words.select("doc_id", "w", F.explode(every).alias("c")).select("doc_id", "c.*", low.alias("low"), F.slice("w", low + 1, F.lit(2 * reach + 1)).alias("near"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", share: float = 0.5, min_matches: int = MIN_MATCHES) -> DataFrame:
    """(doc_id, item_id, n_matched, n_item_words) of every document that holds a test item, at its best diagonal."""
    items = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("text"))
    words = _items(items, "item_id", "text")
    n = F.size("item")
    short = [r["n"] for r in words.where(n < SPAN).select(n.alias("n")).distinct().collect()]  # fewer than SPAN values
    long_ones = F.when(n >= SPAN, n - SPAN + 1).otherwise(0).cast("long")
    about = words.agg(F.max(n).alias("longest"), F.sum(n.cast("long")).alias("words"), F.sum(long_ones * len(MASKS)).alias("seeds")).first()
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    cand = _candidates(src, _vocabulary(items, "text"), sorted(short), about["longest"] or 1)
    test = seeds(words)
    if (about["seeds"] or 0) <= SEEDS_PER_JOIN:
        test = F.broadcast(test)
    else:
        cand = cut(cand)
    if 8 * (about["words"] or 0) <= ITEM_BYTES:
        words = F.broadcast(words)
    hit = cand.join(test, ["mask", "hash"]).join(words, "item_id")
    first = F.col("at") - F.col("item_at") - F.col("low")  # the item's first word in near; before it where negative
    same = F.filter(F.sequence(F.lit(0), n - 1), lambda j: F.when(first + j >= 0, F.get(F.col("near"), first + j) == F.get(F.col("item"), j)).otherwise(False))
    scored = hit.select("doc_id", "item_id", F.size(same).cast("long").alias("m"), n.cast("long").alias("n"))
    enough = (F.col("m") >= F.least(F.col("n"), F.lit(min_matches))) & (F.col("m") >= share * F.col("n"))
    return scored.where(enough).groupBy("doc_id", "item_id").agg(F.max("m").alias("n_matched"), F.max("n").alias("n_item_words"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a test item, told apart by doc_id and text, null-safely."""
    text_id = F.xxhash64("text")
    keyed = docs.select(F.struct("doc_id", text_id.alias("text_id")).alias("__hg_row"), "text")
    bad = contaminated(keyed, read(spark, sf_dir, "benchmark"), id_col="__hg_row").select("doc_id.*").distinct()
    bad = bad.toDF("__hg_id", "__hg_bad")
    same = F.col("doc_id").eqNullSafe(F.col("__hg_id")) & (F.col("__hg_tid") == F.col("__hg_bad"))
    return docs.withColumn("__hg_tid", text_id).join(bad, same, "left_anti").select(*docs.columns)


def _oracle() -> str:
    norm = "translate(coalesce(text, ''), '{}', '{}')".format((UPPER + PUNCTUATION).replace("'", "''"), UPPER.lower())
    toks = f"regexp_extract_all({norm}, '[^\\x20\\x09-\\x0D]+')"
    key = lambda m: "[" + ", ".join(f"w[i + {p}]" for p in m) + "]"
    spaced = lambda t: " UNION ALL ".join(f"SELECT id, w, i, {k} AS mask, {key(m)} AS k FROM {t} WHERE len(w) >= {SPAN} AND i <= len(w) - {SPAN - 1}" for k, m in enumerate(MASKS))
    return f"""
WITH d AS (SELECT doc_id AS id, {toks} AS w FROM documents), b AS (SELECT item_id AS id, {toks} AS w FROM benchmark),
di AS (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM d), bi AS (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM b),
dk AS ({spaced("di")}), bk AS ({spaced("bi")}),
sh AS (SELECT id, w, len(w) AS n FROM b WHERE len(w) BETWEEN 1 AND {SPAN - 1}),
hit AS (SELECT DISTINCT dk.id AS doc_id, bk.id AS item_id, dk.w AS w, bk.w AS item, dk.i - bk.i AS first FROM dk JOIN bk ON dk.mask = bk.mask AND dk.k = bk.k
        UNION SELECT di.id, sh.id, di.w, sh.w, di.i - 1 FROM di JOIN sh ON di.w[di.i:di.i + sh.n - 1] = sh.w),
s AS (SELECT doc_id, item_id, len(item) AS n, len(list_filter(range(1, len(item) + 1), lambda j: first + j >= 1 AND first + j <= len(w) AND w[first + j] = item[j])) AS m FROM hit)
SELECT doc_id, item_id, max(m)::BIGINT AS n_matched, max(n)::BIGINT AS n_item_words FROM s
WHERE m >= least(n, {MIN_MATCHES}) AND m >= 0.5 * n GROUP BY doc_id, item_id
"""


ORACLE = _oracle()
