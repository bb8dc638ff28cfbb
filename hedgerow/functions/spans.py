"""Findings as a column type, and as Arrow arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

FINDING = "struct<scanner:string,score:double,start:int,end:int,matched_text:string,message:string>"
FINDINGS = f"array<{FINDING}>"
_FIELDS = [("scanner", pa.string()), ("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32()), ("matched_text", pa.string()), ("message", pa.string())]


def none() -> Column:
    return F.array().cast(FINDINGS)


def findings_array(rows: list[list[tuple]]) -> pa.Array:
    """Lists of (scanner, score, start, end, matched text, message), one list a text."""
    flat = list(zip(*(f for r in rows for f in r), strict=True)) or [()] * len(_FIELDS)
    structs = pa.StructArray.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(flat, _FIELDS, strict=True)], [n for n, _ in _FIELDS])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), structs)
