"""The corpus pipeline: language ID, line dedup, near-duplicate documents, decontamination, source mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hedgerow.llm import decontamination, langid, line_dedup, mixing, ngram_jaccard
from hedgerow.llm.common import cut, read

STAGES = [
    ("language_id", langid.stage),
    ("line_dedup", line_dedup.stage),
    ("near_duplicates", ngram_jaccard.stage),
    ("decontamination", decontamination.stage),
    ("source_mix", mixing.stage),
]

#: Language ID is a trained model, which SQL cannot express; tests/llm compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
