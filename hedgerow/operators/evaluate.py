"""Evaluation of scanners and policies on labelled cases, as DataFrame queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .policy import Policy
from .scanners import REGISTRY, Scanner, of
from .transforms import TRANSFORMS

#: Scanners as the labelled corpora assume them.
SETUPS: dict[str, dict] = {
    "url_allowlist": {"allowed_domains": ["example.com", "trusted.org"]},
    "token_limit": {"max_tokens": 50},
    "regex": {"forbidden": [r"\bclassified\b"], "required": [r"\bhello\b"]},
}


def setup(name: str) -> Scanner:
    return REGISTRY[name](**SETUPS.get(name, {}))


def _share(top: Column, of_: Column) -> Column:
    return F.coalesce(F.try_divide(top, of_), F.lit(0.0))


def confusion(found: DataFrame, by: str = "scanner") -> DataFrame:
    """Rows (by, found, expected) as cases, tp, fp, tn, fn, precision, recall and f1 for each group, and overall (null)."""
    f, e = F.col("found"), F.col("expected")
    counts = found.rollup(by).agg(
        F.count("*").alias("cases"), F.count_if(f & e).alias("tp"), F.count_if(f & ~e).alias("fp"), F.count_if(~f & ~e).alias("tn"), F.count_if(~f & e).alias("fn"),
    )
    rated = counts.withColumns({"precision": _share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": _share(F.col("tp"), F.col("tp") + F.col("fn"))})
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumn("f1", _share(2 * p * r, p + r))


def scan_cases(cases: DataFrame, scanners: dict[str, Scanner] | None = None) -> DataFrame:
    """Cases (scanner, text, expected) with found: whether the case's own scanner, called directly, finds anything."""
    names = scanners or {n: setup(n) for n in REGISTRY}
    t = of(F.col("text"))
    parts = [cases.where(F.col("scanner") == n).withColumn("found", F.size(s.scan(t)) > 0) for n, s in names.items()]
    return reduce(DataFrame.unionByName, parts)


def failures(found: DataFrame) -> DataFrame:
    """Wrong cases with the head of their text."""
    kind = F.when(F.col("found"), "FP").otherwise("FN").alias("kind")
    return found.where(F.col("found") != F.col("expected")).select("scanner", kind, F.substring("text", 1, 80).alias("text"))


def adversarial(cases: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Recall of each scanner, in a policy of its own, on clean and disguised cases, and neg_ok over all disguises."""
    kinds = {"clean": lambda c: c} | TRANSFORMS
    every = reduce(DataFrame.unionByName, [cases.withColumn("text", fn(F.col("text"))).withColumn("transform", F.lit(k)) for k, fn in kinds.items()])
    parts = [Policy([setup(n)]).apply(every.where(F.col("scanner") == n)).withColumn("found", F.size("findings") > 0) for n in names or list(REGISTRY)]
    found = reduce(DataFrame.unionByName, parts).select("scanner", "transform", "expected", "found")
    recall = found.groupBy("scanner").pivot("transform", list(kinds)).agg(_share(F.count_if(F.col("found") & F.col("expected")), F.count_if("expected")))
    clean_neg = F.col("transform") != "clean"
    rest = found.groupBy("scanner").agg(
        F.count_if(F.col("transform") == "clean").alias("n"),
        _share(F.count_if(clean_neg & ~F.col("expected") & ~F.col("found")), F.count_if(clean_neg & ~F.col("expected"))).alias("neg_ok"),
    )
    return recall.join(rest, "scanner")


def adversarial_overall(by_scanner: DataFrame) -> DataFrame:
    """Case-weighted means of the recall table's columns."""
    cols = ["clean", *TRANSFORMS, "neg_ok"]
    return by_scanner.agg(F.sum("n").alias("n"), *[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in cols])


def policy_accuracy(cases: DataFrame, policy: Policy) -> DataFrame:
    """Share of cases (category, text, expected) whose verdict is right, by category and overall (null)."""
    judged = policy.apply(cases)
    right = F.count_if(F.col("blocked") == F.col("expected"))
    return judged.rollup("category").agg(F.count("*").alias("cases"), right.alias("correct"), (right / F.count("*")).alias("accuracy"))
