"""Scalar functions of scanners: validity checks, entropy, estimates. Each has a column and, where useful, a Python form."""

from __future__ import annotations

import base64
import json
import math
from collections import Counter

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def estimate_tokens_text(text: str) -> int:
    return max(1, len(text) // 4)


def ssn_valid_text(ssn: str) -> bool:
    d = ssn.replace("-", "")
    return len(d) == 9 and d.isdigit() and int(d[:3]) not in (0, 666, *range(900, 1000)) and int(d[3:5]) > 0 and int(d[5:]) > 0


def card_valid_text(candidate: str) -> bool:
    """Luhn over the digits of a candidate with separators; of other scripts' digits the code point counts from "0"."""
    values = [ord(c) - 48 for c in reversed(candidate) if c not in " -"]
    twice = [2 * v for v in values[1::2]]
    return (sum(values[::2]) + sum(v - 9 if v > 9 else v for v in twice)) % 10 == 0


def ssn_valid(ssn: Column) -> Column:
    """Nine digits (dashes aside) with an area, group and serial that can be issued."""
    d = F.replace(ssn, F.lit("-"))
    area = F.substring(d, 1, 3)
    ok = d.rlike(r"^[0-9]{9}$") & ~area.isin("000", "666") & (area < "900")
    return ok & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")


def luhn_valid(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def card_valid(candidate: Column) -> Column:
    """Luhn over the digits of a candidate with separators."""
    return luhn_valid(F.regexp_replace(candidate, "[^0-9]", ""))


def entropy(token: Column) -> Column:
    """Shannon entropy in bits a character, for short strings: quadratic in different characters at most."""
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    n = F.length(token).cast("double")
    part = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    bits = F.aggregate(F.transform(F.array_distinct(chars), part), F.lit(0.0), lambda a, p: a - p * F.log2(p))
    return F.when(F.length(token) == 0, F.lit(0.0)).otherwise(bits)


def shannon_entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def looks_random(token: Column, min_length: int = 20, min_entropy: float = 4.2) -> Column:
    """A long token of high entropy; hexadecimal ones have their own bar."""
    shape = token.rlike(r"^[A-Za-z0-9_\-+/=]+\z")
    is_hex = token.rlike(r"^[0-9a-fA-F]+\z")
    n, e = F.length(token), entropy(token)
    return shape & F.when(is_hex, (n >= 32) & (e >= 3.7)).otherwise((n >= min_length) & (e >= min_entropy))


def looks_random_text(token: str, min_length: int = 20, min_entropy: float = 4.2) -> bool:
    if all(c in "0123456789abcdefABCDEF" for c in token):
        return len(token) >= 32 and shannon_entropy(token) >= 3.7
    return len(token) >= min_length and shannon_entropy(token) >= min_entropy


def jwt_valid(token: Column) -> Column:
    """Three dotted parts of which the first two decode to JSON objects."""

    def decodes(k: int) -> Column:
        p = F.translate(F.get(F.split(token, r"\."), F.lit(k)), "-_", "+/")
        padded = F.rpad(p, F.ceil(F.length(p) / 4).cast("int") * 4, F.lit("="))
        raw = F.try_to_binary(padded, F.lit("base64")).cast("string")
        return F.coalesce(raw.rlike(r"^\s*\{") & F.try_parse_json(raw).isNotNull(), F.lit(False))

    return (F.size(F.split(token, r"\.")) == 3) & decodes(0) & decodes(1)


def jwt_valid_text(token: str) -> bool:
    parts = token.split(".")
    if len(parts) != 3:
        return False
    try:
        return all(isinstance(json.loads(base64.urlsafe_b64decode(p + "=" * (-len(p) % 4))), dict) for p in parts[:2])
    except ValueError:
        return False


def url_netloc(url: Column) -> Column:
    """Between :// and the next slash, question mark or hash; empty where brackets are unbalanced."""
    loc = F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*)", 1)
    return F.when(F.contains(loc, F.lit("[")) != F.contains(loc, F.lit("]")), F.lit("")).otherwise(loc)


def url_host(url: Column) -> Column:
    loc = F.substring_index(url_netloc(url), "@", -1)
    return F.lower(F.substring_index(loc, ":", 1))


def registered_domain(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def decode_utf8(data: Column) -> Column:
    """Bytes as text, invalid sequences left out."""
    return F.replace(F.make_valid_utf8(data.cast("string")), F.lit("�"))


def register(spark: SparkSession) -> None:
    """Temporary SQL functions of these names: SQL expressions, and Arrow functions for those that need Python."""
    for name, fn, kind in (("jwt_valid", jwt_valid_text, "boolean"), ("looks_random", looks_random_text, "boolean"), ("shannon_entropy", shannon_entropy, "double")):
        spark.udf.register(name, F.udf(lambda t, fn=fn: None if t is None else fn(t), kind, useArrow=True))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION estimate_tokens(t STRING) RETURNS INT RETURN greatest(1, length(t) div 4)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION luhn_valid(d STRING) RETURNS BOOLEAN RETURN luhn_check(d)")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION ssn_valid(s STRING) RETURNS BOOLEAN RETURN replace(s, '-') rlike '^[0-9]{9}$' "
        "AND substr(replace(s, '-'), 1, 3) NOT IN ('000', '666') AND substr(replace(s, '-'), 1, 3) < '900' "
        "AND substr(replace(s, '-'), 4, 2) <> '00' AND substr(replace(s, '-'), 6, 4) <> '0000'"
    )
