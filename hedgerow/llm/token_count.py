"""Token counts: batch encoding in Arrow functions that return lengths only.

Every Arrow batch is cut into runs of about `batch_bytes`, so tasks hold bounded text whatever the row sizes. Texts are
split at safe boundaries before encoding: for tokenizers whose pre-tokenizer drops white space, ASCII white space is
such a boundary (no rule, merge, normalization or special string reaches across it), so the pieces between are encoded
as one batch of distinct strings and a text's count is the sum over its pieces. For sentencepiece models (and any
tokenizer not known to drop white space) texts are encoded whole.

Defined results: null text counts as empty (0 bytes, 0 tokens); very long texts are counted whole; repeated rows give
equal rows; an empty table gives an empty result; other columns (also named n_tokens etc.) are replaced, not duplicated.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, runs_of

BATCH_BYTES = 8 << 20
#: Pieces whose counts one worker remembers, and the bytes that such a piece may have: about 50 MB at most. At the bound
#: the memory is cleared; longer pieces are encoded each time.
MEMO, SHORT = 400_000, 64


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Counter:
    """Counts tokens of a batch of texts; made once per Python worker."""

    def __init__(self, name: str):
        path = vocabulary_path(name)
        self.memo: dict[str, int] = {}
        if name.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            self.splits = False
        else:
            import os

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            batch = getattr(t, "encode_batch_fast", t.encode_batch)
            self.encode = lambda texts: [len(x.ids) for x in batch(texts, add_special_tokens=False)]
            with open(path, encoding="utf-8") as f:
                self.splits = drops_white_space(json.load(f))

    def count(self, texts: pa.Array) -> np.ndarray:
        texts = pc.fill_null(texts, "")
        if not self.splits:
            return np.array(self.encode(texts.to_pylist()), dtype=np.int64)
        lists = pc.ascii_split_whitespace(texts)
        pieces = lists.flatten().dictionary_encode()
        kinds = pieces.dictionary.to_pylist()
        each = np.zeros(len(kinds), np.int64)
        short = np.array(pc.binary_length(pieces.dictionary).to_numpy(zero_copy_only=False)) <= SHORT
        for x in range(0, len(kinds), MEMO):
            few = [(i, kinds[i]) for i in range(x, min(x + MEMO, len(kinds))) if short[i]]
            if len(self.memo) + len(few) > MEMO:
                self.memo.clear()
            if new := [k for _, k in few if k not in self.memo]:
                self.memo.update(zip(new, self.encode(new), strict=True))
            for i, k in few:
                each[i] = self.memo[k]
        for i in np.flatnonzero(~short):
            each[i] = self.encode([kinds[i]])[0]
        at = np.concatenate([[0], np.cumsum(each[pieces.indices.to_numpy(zero_copy_only=False)])])
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return at[ends[1:]] - at[ends[:-1]]


def drops_white_space(spec: dict) -> bool:
    """Whether pieces between ASCII white space are tokenized independently by this tokenizer file.

    True for the word-end BPE family: white space is collapsed by the normalizer, a removing split isolates words, and
    no added token holds or strips white space.
    """
    parts = lambda x: x.get("normalizers") or x.get("pretokenizers") or [x] if x else []
    pre = parts(spec.get("pre_tokenizer"))
    split = any(p.get("type") == "Split" and p.get("invert") and p.get("behavior") == "Removed" for p in pre)
    word_end = bool(spec.get("model", {}).get("end_of_word_suffix"))
    plain = all(
        not (a.get("lstrip") or a.get("rstrip") or a.get("single_word") or any(c.isspace() for c in a["content"]))
        for a in spec.get("added_tokens", [])
    )
    norm = {p.get("type") for p in parts(spec.get("normalizer"))}
    return split and word_end and plain and norm <= {"NFC", "Replace", "Lowercase"}


_counters: dict[str, Counter] = {}


def count_tokens(
    df: DataFrame, tokenizer: str, text_col: str = "text", limit: int = 2048, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """df's other columns with n_bytes, n_tokens and over_limit; the text itself is not returned from Python."""
    keep = [c for c in df.columns if c not in (text_col, "n_bytes", "n_tokens", "over_limit")]
    src = df.select(*keep, F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"), F.col(text_col).alias("__hg_text"))
    schema = T.StructType([*src.drop("__hg_text").schema.fields, T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(tokenizer) or _counters.setdefault(tokenizer, Counter(tokenizer))
        for b in batches:
            col = b.column(b.schema.get_field_index("__hg_text"))
            sizes = b.column(b.schema.get_field_index("n_bytes")).to_pylist()
            counts = [counter.count(col.slice(i, j - i)) for i, j in runs_of(sizes, batch_bytes)]
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            rest = b.drop_columns(["__hg_text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(n, pa.int64())], [*rest.schema.names, "n_tokens"])

    return src.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, "word_bpe_49k.json")
