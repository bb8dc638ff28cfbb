"""Readers and writers: labelled JSON corpora, whole text files, request logs, redacted copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.policy import Policy


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases (text, expected and, where given, category) of {"cases": [...]} files."""
    cases = "array<struct<text:string,expected:boolean,category:string>>"
    return spark.read.schema(f"cases {cases}").option("multiLine", True).json(path).select(F.explode("cases").alias("c")).select("c.*")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Each file as one text, with its path."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


class BlockedError(RuntimeError):
    """Strict redaction met a blocked text; nothing was written."""


def write_redacted(df: DataFrame, policy: Policy, path: str, text_col: str = "text", strict: bool = False) -> None:
    """Redacted texts as text files; strict: raise before anything is written if a text is blocked."""
    judged = policy.apply(df, text_col, redact=True)
    if strict and not judged.where("blocked").isEmpty():
        raise BlockedError("input blocked by policy")
    judged.select("redacted_text").write.text(path)
