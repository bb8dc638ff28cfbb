"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams of letters (lower-cased, every run of other characters as one blank) per language
on a bounded, hash-chosen sample of the labelled rows (`max_train_docs`, drawn evenly per language); the smoothed
log-probability matrix (languages x buckets, float32: 256 kB a language) is broadcast, and texts are scored in numpy:
a gather and a segment sum per language, over whole texts.

The score is a softmax over whole texts, so it comes near 1 after a few words, whatever they are. How well a text fits its
language at all is a second figure: the mean log-probability of its n-grams, less what is expected of the language itself
(its entropy, from the model), less what is allowed to a text of so few n-grams. The pipeline stage rejects texts below 0.

Defined results: null texts and texts without a letter give `und` with score 0; very long texts are scored whole;
repeated rows give equal rows; without any labelled row every text is `und`; ties go to the smallest language name; an
empty table gives no rows; extra columns pass through, but `detect` replaces those named lang_pred and score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .codepoints import LIMIT, chunks, span_sums
from .common import fold, read, splitmix, trim

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
#: A text's mean log-probability an n-gram may fall short of its language's by MISFIT + SHORT / sqrt(n-grams).
MISFIT, SHORT = 2.5, 10.0
UNDETERMINED = "und"

_table: np.ndarray | None = None


def letters() -> np.ndarray:
    """Code point -> lower-case letter, or blank for everything that is no letter."""
    global _table
    if _table is None:
        t = np.full(LIMIT, 32, dtype=np.uint32)
        for i in range(LIMIT):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                t[i] = ord(low) if len(low) == 1 else i
        _table = t
    return _table


def ngrams(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the n-gram that starts at each kept place, n by n; BUCKETS marks places without one.

    Returns (buckets of shape orders x places, starts, ends) with spans over kept places.
    """
    c = letters()[points]
    c[ends] = 32
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    place = np.concatenate([[0], np.cumsum(keep)])
    c = c[keep].astype(np.uint64)
    s, e = place[starts], place[np.minimum(ends + 1, len(keep))]
    n = len(c)
    owned = np.zeros(n, dtype=np.int64)
    owned[_spans(s, e)] = np.repeat(e, e - s)
    out = np.full((len(ORDERS), n), BUCKETS, dtype=np.int32)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(max(ORDERS)):
        if k >= n:
            break
        h[: n - k] = splitmix(h[: n - k] + c[k:] + np.uint64(k + 1))
        if k + 1 in ORDERS:
            row = out[ORDERS.index(k + 1)]
            good = np.arange(n) + k < owned
            if k == 0:
                good &= c != 32
            row[good] = (h[good] & np.uint64(BUCKETS - 1)).astype(np.int32)
    return out, s, e


def _spans(s: np.ndarray, e: np.ndarray) -> np.ndarray:
    size = e - s
    return np.repeat(s - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


@dataclass
class Model:
    languages: list[str]
    log_prob: np.ndarray  # languages x (BUCKETS + 1); the last column, for no n-gram, is 0
    prior: np.ndarray

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, fit) of each text; a fit below 0 means that the text is hardly of any learned language."""
        names, scores, fits = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        if not self.languages:
            return names, scores, fits
        own_mean = np.array([(np.exp(x, dtype=np.float64) * x).sum() for x in self.log_prob[:, :BUCKETS]])
        for i, _, own, points, starts, ends in chunks(texts):
            grams, s, e = ngrams(points, starts, ends)
            total = np.stack([self.prior[k] + sum(span_sums(self.log_prob[k][g], s, e) for g in grams) for k in range(len(self.languages))])
            n = span_sums((grams != BUCKETS).sum(axis=0), s, e)
            best = total.argmax(axis=0)
            mean = (total.max(axis=0) - self.prior[best]) / np.maximum(n, 1)
            fit = mean - own_mean[best] + MISFIT + SHORT / np.sqrt(np.maximum(n, 1))
            share = 1 / np.exp(total - total.max(axis=0)).sum(axis=0)
            for d in range(len(own)):
                if n[d]:  # it has a letter
                    names[i + d], scores[i + d], fits[i + d] = self.languages[best[d]], share[d], fit[d]
        return names, scores, fits


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_train_docs: int = 20_000, alpha: float = 0.1) -> Model:
    """Fit on at most about max_train_docs rows with a language, the same number for each language where there are as many."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}  # one row a language
    if not sizes:
        return Model([], np.zeros((0, BUCKETS + 1), np.float32), np.zeros(0))
    each, steps = max_train_docs / len(sizes), 1 << 30
    cutoff = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, each / n) * steps))])
    pick = F.pmod(F.xxhash64(F.col(id_col), F.lit("language sample")), F.lit(steps)) < F.element_at(cutoff, F.col(lang_col))
    sample = rows.where(pick).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).repartition(16)
    schema = "lang string, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), dtype=object)
            for i, j, _, points, starts, ends in chunks(b.column(1)):
                grams, s, e = ngrams(points, starts, ends)
                for lang in set(langs[i:j]):
                    at = np.flatnonzero(langs[i:j] == lang)
                    where = _spans(s[at], e[at])
                    hits = np.bincount(grams[:, where].ravel(), minlength=BUCKETS + 1)[:BUCKETS]
                    sums[lang] = sums.get(lang, 0) + hits
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "counts": pa.array([x.astype(np.int64).tobytes() for x in sums.values()], pa.binary())})

    def merge(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in t.column("counts").to_pylist())
        return pa.table({"lang": t.column("lang")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    parts = sample.mapInArrow(count, schema).groupBy("lang").applyInArrow(merge, schema).collect()  # one row a language
    parts.sort(key=lambda r: r["lang"])
    langs = [r["lang"] for r in parts]
    counts = np.stack([np.frombuffer(r["counts"], np.int64) for r in parts]).astype(np.float64) + alpha
    log_prob = np.zeros((len(langs), BUCKETS + 1), np.float32)
    log_prob[:, :BUCKETS] = np.log(counts / counts.sum(axis=1, keepdims=True))
    share = np.array([sizes[x] for x in langs], dtype=np.float64)
    return Model(langs, log_prob, np.log(share / share.sum()))


def _predicted(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """docs with __hg_lang, __hg_score and __hg_fit."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(*[c for c in docs.columns if c != text_col], text_col)
    schema = T.StructType([*src.schema.fields, T.StructField("__hg_lang", T.StringType()), T.StructField("__hg_score", T.DoubleType()), T.StructField("__hg_fit", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores, fits = shared.value.predict(b.column(b.num_columns - 1))
            new = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(fits, pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, "__hg_lang", "__hg_score", "__hg_fit"])
        trim()

    return src.mapInArrow(run, schema)


def detect(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score; both replace columns of these names."""
    src = docs.drop("lang_pred", "score")
    return _predicted(src, model, text_col).select(*src.columns, F.col("__hg_lang").alias("lang_pred"), F.col("__hg_score").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", (fold(F.col("doc_id")) == 2).alias("held_out"))
    model = train(docs.where(~F.col("held_out")))
    return detect(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


#: A document whose best language is less likely than this is rejected by the pipeline stage.
MIN_SCORE = 0.5


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a determined language that they fit; the learned rows are those of `docs` outside the held-out fold."""
    columns = docs.columns
    model = train(docs.where(fold(F.col("doc_id")) != 2))
    found = _predicted(docs, model, "text").where((F.col("__hg_lang") != UNDETERMINED) & (F.col("__hg_score") >= MIN_SCORE) & (F.col("__hg_fit") >= 0))
    return found.select(*columns)
