"""Hedgerow: text guardrails and training-data operators on Spark."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

from .functions.normalize import normalize_text, normalize_with_map
from .functions.scalars import register
from .operators.evaluate import adversarial, confusion, policy_accuracy, scan_cases
from .operators.guards import GuardedError, guard_http, guard_payloads, guarded, redact_column, redact_payloads
from .operators.policy import COLLECT_ALL, FAIL_FAST, Policy, explode_findings, redact_spans
from .operators.scanners import REGISTRY, Scanner, default_scanners, full_scanners
from .operators.transforms import TRANSFORMS

__all__ = [
    "COLLECT_ALL", "FAIL_FAST", "REGISTRY", "TRANSFORMS", "GuardedError", "Policy", "Scanner", "adversarial", "confusion", "default_scanners", "explode_findings",
    "full_scanners", "guard_http", "guard_payloads", "guarded", "normalize_text", "normalize_with_map", "policy_accuracy", "redact_column", "redact_payloads",
    "redact_spans", "register", "scan_cases", "ship",
]


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_hedgerow_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="hedgerow-"), "hedgerow.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("hedgerow", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._hedgerow_shipped = True
