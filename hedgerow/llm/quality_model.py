"""Quality classifier: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

A document becomes a row of statistics (`STATS`, from whole texts, counted in numpy over code points); standardized,
they are mapped to `features` random Fourier features cos(Wx + b), an approximation of a Gaussian kernel. Each
partition of the training sample sums its part of the normal equations; the driver adds these fixed-size matrices and
solves the ridge system. Raw scores of a part of the sample that the ridge fit did not see are calibrated by isotonic
regression (pool adjacent violators), so a score is the share of good documents among those scored like it.

Only labels and text statistics are used. The sample is bounded (`max_train_docs`, drawn by a hash of doc_id); every
document is scored.

Defined results: null and empty texts are scored as texts without words; very long texts are read whole; repeated label
rows of a document count as their mean; without labels every score is 0.5; repeated rows give equal rows.
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
from .common import fold, read

STATS = (
    "log_words", "word_length", "upper_share", "digit_share", "symbol_share", "punctuation_share", "letter_share",
    "distinct_words", "top_word_share", "repeat_next_share", "line_length", "duplicate_lines", "exclamations",
)
SPACE_C, LETTER, UPPER, DIGIT, SYMBOL, PUNCT, EXCLAIM, OTHER = range(8)
THRESHOLD = 0.7

_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """Code point -> one of the eight classes."""
    global _classes
    if _classes is None:
        t = np.full(LIMIT, OTHER, dtype=np.uint8)
        for i in range(LIMIT):
            c = chr(i)
            if c.isupper():
                t[i] = UPPER
            elif c.isalpha():
                t[i] = LETTER
            elif c.isdigit():
                t[i] = DIGIT
        for cs, k in ((" \t\n\x0b\x0c\r", SPACE_C), ("#*$%&|<>=@^~_{}[]\\+/", SYMBOL), (".,;:?'\"()-", PUNCT), ("!", EXCLAIM)):
            for c in cs:
                t[ord(c)] = k
        _classes = t
    return _classes


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATS for each text."""
    out = np.zeros((len(texts), len(STATS)))
    for i, j, own, points, starts, ends in chunks(texts):
        kind = classes()[points]
        n = np.stack([span_sums((kind == k).astype(np.int64), starts, ends) for k in range(8)]).astype(float)
        chars = np.maximum(n.sum(axis=0) - n[SPACE_C], 1)
        letters = np.maximum(n[LETTER] + n[UPPER], 1)
        rows = out[i:j]
        for d, text in enumerate(own):
            w = text.split()
            lines = [x for x in text.split("\n") if x.strip()]
            counts: dict[str, int] = {}
            for x in w:
                counts[x] = counts.get(x, 0) + 1
            m = max(len(w), 1)
            rows[d, 0] = np.log1p(len(w))
            rows[d, 1] = np.log1p(chars[d] / m)
            rows[d, 7] = len(counts) / m * np.log1p(m)
            rows[d, 8] = max(counts.values(), default=0) / m
            rows[d, 9] = sum(map(str.__eq__, w, w[1:])) / m
            rows[d, 10] = np.log1p(len(text) / max(len(lines), 1))
            rows[d, 11] = 1 - len(set(lines)) / max(len(lines), 1)
        rows[:, 2], rows[:, 3], rows[:, 4], rows[:, 5], rows[:, 6] = (n[UPPER] / letters, n[DIGIT] / chars, n[SYMBOL] / chars, n[PUNCT] / chars, (n[LETTER] + n[UPPER]) / chars)
        rows[:, 12] = n[EXCLAIM] / chars
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    knots: np.ndarray  # raw scores, ascending
    values: np.ndarray  # calibrated scores at the knots

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        f = np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.hstack([f, z, np.ones((len(z), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.features(x) @ self.beta, self.knots, self.values), 0, 1)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators, with the mean of each pool pulled slightly to 1/2 (Laplace), as knots of a step-wise line."""
    order = np.lexsort((y, raw))
    pools: list[list[float]] = []  # sum of y, count, first raw, last raw
    for r, v in zip(raw[order], y[order], strict=True):
        if pools and pools[-1][3] == r:
            pools[-1][0] += v
            pools[-1][1] += 1
        else:
            pools.append([v, 1, r, r])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, n, _, last = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][3] = last
    knots, values = [], []
    for s, n, first, last in pools:
        v = (s + 0.5) / (n + 1)
        for k in dict.fromkeys((first, last)):
            knots.append(k)
            values.append(v)
    return np.array(knots), np.maximum.accumulate(np.array(values)) if values else np.array(values)


def _sample(docs: DataFrame, labels: DataFrame, max_train_docs: int) -> DataFrame:
    """Text statistics and labels of the training sample: doc_id, y, part (0 fits the ridge, 1 calibrates)."""
    known = labels.where(F.col("quality").isNotNull() & (fold(F.col("doc_id")) != 2))
    n = known.count()
    steps = 1 << 30
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("quality sample")), F.lit(steps)) < F.lit(int(min(1.0, max_train_docs / max(n, 1)) * steps)))
    known = known.groupBy("doc_id").agg(F.avg("quality").alias("y"))
    # About max_train_docs rows of 16 bytes: the bound makes this side safe to broadcast.
    hit = docs.join(F.broadcast(known), "doc_id")
    part = (F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(4)) == 0).cast("int").alias("part")
    src = hit.select("y", part, "text").repartition(16)
    names = [f"s{k}" for k in range(len(STATS))]

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x[:, k]) for k in range(len(STATS)))], ["y", "part", *names])

    return src.mapInArrow(stats, "y double, part int, " + ", ".join(f"{n} double" for n in names))


def train(docs: DataFrame, labels: DataFrame, max_train_docs: int = 20_000, features: int = 192, gamma: float = 0.08, ridge: float = 1e-3, seed: int = 7) -> Model:
    from .common import cut

    sample = cut(_sample(docs, labels, max_train_docs))
    names = [f"s{k}" for k in range(len(STATS))]
    r = sample.agg(*[F.avg(n).alias("m" + n) for n in names], *[F.stddev_pop(n).alias("d" + n) for n in names], F.count("*").alias("n")).first()
    rng = np.random.default_rng(seed)
    w = rng.normal(0, np.sqrt(2 * gamma), (len(STATS), features))
    b = rng.uniform(0, 2 * np.pi, features)
    zero = np.zeros(features + len(STATS) + 1)
    model = Model(np.zeros(len(STATS)), np.ones(len(STATS)), w, b, zero, np.zeros(0), np.zeros(0))
    if not r["n"]:
        return model
    model.mean = np.array([r["m" + n] for n in names])
    model.scale = np.maximum(np.array([r["d" + n] for n in names]), 1e-6)
    size = len(zero)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xx, xy, seen = np.zeros((size, size)), np.zeros(size), 0
        for t in batches:
            x = model.features(np.column_stack([t.column(k).to_numpy() for k in range(2, 2 + len(STATS))]))
            y = t.column(0).to_numpy() * 2 - 1
            xx, xy, seen = xx + x.T @ x, xy + x.T @ y, seen + len(y)
        yield pa.RecordBatch.from_pydict({"xx": pa.array([xx.tobytes()], pa.binary()), "xy": pa.array([xy.tobytes()], pa.binary()), "n": pa.array([seen], pa.int64())})

    sums = sample.where("part = 0").mapInArrow(equations, "xx binary, xy binary, n long").collect()  # at most 16 partitions
    xx = sum(np.frombuffer(s["xx"]).reshape(size, size) for s in sums)
    xy = sum(np.frombuffer(s["xy"]) for s in sums)
    model.beta = np.linalg.solve(xx + ridge * max(sum(s["n"] for s in sums), 1) * np.eye(size), xy)
    rest = sample.where("part = 1").toPandas()  # a quarter of the bounded sample
    if len(rest) < 20:
        rest = sample.toPandas()
    raw = model.features(rest[names].to_numpy()) @ model.beta
    model.knots, model.values = isotonic(raw, rest["y"].to_numpy())
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the text, with score and predicted (both replace columns of these names)."""
    keep = [c for c in docs.columns if c not in (text_col, "score", "predicted")]
    src = docs.select(*keep, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*src.drop(text_col).schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.score(statistics(b.column(b.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64())], [*b.schema.names[:-1], "score"])

    return src.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels").select("doc_id", "quality"))
    held = docs.withColumn("held_out", fold(F.col("doc_id")) == 2)
    return score(held, model).select("doc_id", "held_out", "score", "predicted")
