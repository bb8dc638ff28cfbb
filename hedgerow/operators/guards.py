"""Guards: policies around functions, chat tables, API payloads and request logs."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import decode_utf8
from .policy import Policy, fired


class GuardedError(ValueError):
    """A policy blocked an input or an output; the message names scanners, never the text."""


def _blocked_by(judged: DataFrame) -> list[str]:
    rows = judged.where("blocked").select(F.explode(fired(F.col("findings"))).alias("s")).distinct().collect()  # at most one row a scanner
    return sorted(r["s"] for r in rows)


def guarded(policy: Policy, *, text_col: str = "text", on_input: bool = True, on_output: bool = True, redact: bool = False) -> Callable:
    """Decorate a function from DataFrames to a DataFrame.

    A DataFrame argument with a blocked text raises; inputs are never redacted. A result with blocked texts raises, or,
    with redact, has those texts replaced by their redacted form.
    """

    def decorate(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(fn)
        def run(*args, **kwargs):
            if on_input:
                for df in [*args, *kwargs.values()]:
                    if isinstance(df, DataFrame) and text_col in df.columns and (names := _blocked_by(policy.apply(df, text_col))):
                        raise GuardedError(f"guarded function {fn.__name__!r}: input blocked by " + ", ".join(names))
            out = fn(*args, **kwargs)
            if not on_output or not isinstance(out, DataFrame) or text_col not in out.columns:
                return out
            if redact:
                return redact_column(out, policy, text_col)
            if names := _blocked_by(policy.apply(out, text_col)):
                raise GuardedError(f"guarded function {fn.__name__!r}: output blocked by " + ", ".join(names))
            return out

        return run

    return decorate


def redact_column(df: DataFrame, policy: Policy, text_col: str = "text", when: str = "blocked") -> DataFrame:
    """df with texts redacted: when "blocked", only blocked ones; when "any", all that have findings."""
    judged = policy.apply(df, text_col, redact=True)
    due = F.col("blocked") if when == "blocked" else F.size("findings") > 0
    return judged.withColumn(text_col, F.when(due, F.col("redacted_text")).otherwise(F.col(text_col))).select(*df.columns)


def guard_turns(turns: DataFrame, inputs: Policy, outputs: Policy, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Chat turns with a verdict: assistant turns by the output policy, all others by the input policy."""
    said = F.coalesce(F.col(role_col) == "assistant", F.lit(False))
    return inputs.apply(turns.where(~said), text_col, True).unionByName(outputs.apply(turns.where(said), text_col, True))


def guard_conversations(turns: DataFrame, inputs: Policy, outputs: Policy, conv_col: str = "conv_id") -> DataFrame:
    """One row a conversation: its turns, blocked turns and whether any is blocked."""
    judged = guard_turns(turns, inputs, outputs)
    return judged.groupBy(conv_col).agg(F.count("*").alias("turns"), F.count_if("blocked").alias("blocked_turns"), F.coalesce(F.bool_or("blocked"), F.lit(False)).alias("blocked"))


def guard_joined(turns: DataFrame, policy: Policy, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """Turns of a conversation scanned as one text, joined by newlines in their order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(turn_col, text_col))), lambda t: t[text_col])
    return policy.apply(turns.groupBy(conv_col).agg(F.array_join(parts, "\n").alias("text")), "text", True)


def guard_http(log: DataFrame, policy: Policy, path_col: str = "path", request_col: str = "request", response_col: str = "response", include: list[str] | None = None, redact: bool = False) -> DataFrame:
    """Requests with status: 400 where the request is blocked, 500 where the response is; with redact, responses are
    never blocked and every finding in them is replaced. Paths outside the included prefixes pass. Bodies are strings or
    bytes; bytes are read as UTF-8, invalid sequences left out."""
    prefixes = F.lit(True)
    if include is not None:
        prefixes = F.lit(False)
        for p in include:
            prefixes = prefixes | F.startswith(F.col(path_col), F.lit(p))
    binary = dict(log.dtypes)[response_col] == "binary"
    text = lambda c: decode_utf8(F.col(c)) if dict(log.dtypes)[c] == "binary" else F.col(c)
    judged = log.withColumns({"__hg_q": text(request_col), "__hg_r": text(response_col)})
    judged = policy.apply(judged, "__hg_q").withColumnsRenamed({"findings": "request_findings", "blocked": "__hg_in"})
    judged = policy.apply(judged, "__hg_r", redact=True).withColumnsRenamed({"findings": "response_findings", "blocked": "__hg_out"})
    bad_out = F.lit(False) if redact else F.col("__hg_out")
    status = F.when(prefixes & F.col("__hg_in"), 400).when(prefixes & bad_out, 500).otherwise(200)
    redacted = F.encode("redacted_text", "UTF-8") if binary else F.col("redacted_text")
    body = F.when(prefixes & F.lit(redact) & (F.size("response_findings") > 0), redacted).otherwise(F.col(response_col))
    return judged.withColumns({"status": status, response_col: body}).select(*log.columns, "status", "request_findings", "response_findings")


Change = Callable[[str], str]


def map_content(content: Any, fn: Change) -> Any:
    """A message content with fn applied to its texts: a string, or strings and blocks with text and nested content."""
    if isinstance(content, str):
        return fn(content)
    if isinstance(content, dict):
        own = {"text": fn(content["text"])} if isinstance(content.get("text"), str) else {}
        return content | own | ({"content": map_content(content["content"], fn)} if content.get("content") is not None else {})
    return [map_content(x, fn) for x in content] if isinstance(content, list | tuple) else content


def map_messages(messages: Any, fn: Change) -> Any:
    if not isinstance(messages, list | tuple):
        return messages
    return [m | {"content": map_content(m.get("content"), fn)} if isinstance(m, dict) and "content" in m else m for m in messages]


def map_request(payload: dict, fn: Change) -> dict:
    """fn applied to what a chat, completion or responses request sends: messages, system, prompt, input, instructions."""
    strings = lambda x: [fn(p) if isinstance(p, str) else p for p in x] if isinstance(x, list) else x
    kinds = {
        "messages": lambda x: map_messages(x, fn), "system": lambda x: map_content(x, fn), "prompt": lambda x: fn(x) if isinstance(x, str) else strings(x),
        "input": lambda x: fn(x) if isinstance(x, str) else map_messages(x, fn), "instructions": lambda x: fn(x) if isinstance(x, str) else x,
    }
    return payload | {k: change(payload[k]) for k, change in kinds.items() if k in payload}


def map_response(payload: dict, fn: Change) -> dict:
    """fn applied to what a response holds: output_text, completion, output and content blocks, choices."""
    blocks = lambda x: map_content(x, fn) if isinstance(x, list) else x
    plain = lambda x: fn(x) if isinstance(x, str) else x
    item = lambda x: x | {"content": blocks(x["content"])} if isinstance(x, dict) and "content" in x else x

    def choice(c: Any) -> Any:
        if not isinstance(c, dict):
            return c
        m = c.get("message")
        said = {"message": m | {"content": plain(m["content"])}} if isinstance(m, dict) and "content" in m else {}
        return c | said | ({"text": plain(c["text"])} if "text" in c else {})

    each = lambda f: lambda x: [f(y) for y in x] if isinstance(x, list) else x
    kinds = {"output_text": plain, "completion": plain, "output": each(item), "content": blocks, "choices": each(choice)}
    return payload | {k: change(payload[k]) for k, change in kinds.items() if k in payload}


def request_texts(payload: dict) -> list[str]:
    return _texts(map_request, payload)


def response_texts(payload: dict) -> list[str]:
    return _texts(map_response, payload)


def _texts(walk: Callable[[dict, Change], dict], payload: dict) -> list[str]:
    out: list[str] = []
    walk(payload, lambda t: (out.append(t), t)[1])
    return out


def redact_payloads(df: DataFrame, policy: Policy, payload_col: str, kind: str = "response") -> DataFrame:
    """df with the blocked texts of its JSON payloads redacted in place; all else in a payload stays. Payloads that are no
    JSON objects, or have nothing to redact, stay byte by byte."""
    walk = map_request if kind == "request" else map_response

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            out = b.to_pylist()
            for k, v in enumerate(out):
                try:
                    x = json.loads(v) if v is not None else None
                except ValueError:
                    continue
                if isinstance(x, dict) and (new := walk(x, policy.redacted_if_blocked)) != x:
                    out[k] = json.dumps(new, ensure_ascii=False)
            yield pa.array(out, pa.string())

    return df.withColumn(payload_col, run(F.col(payload_col)))


def payload_texts(payload: Column, kind: str = "request") -> Column:
    """array<string> of the texts in a JSON payload; malformed JSON has none."""
    take = request_texts if kind == "request" else response_texts

    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in values:
            out = []
            for v in s:
                try:
                    x = json.loads(v) if v is not None else None
                except ValueError:
                    x = None
                out.append(take(x) if isinstance(x, dict) else [])
            yield pd.Series(out)

    return F.pandas_udf(run, "array<string>")(payload)


def guard_payloads(df: DataFrame, policy: Policy, payload_col: str, kind: str = "request", id_col: str = "id") -> DataFrame:
    """One row a payload: each of its texts is scanned by itself; blocked if any is."""
    texts = df.select(id_col, F.explode_outer(payload_texts(F.col(payload_col), kind)).alias("text"))
    judged = policy.apply(texts)
    return judged.groupBy(id_col).agg(F.coalesce(F.bool_or("blocked"), F.lit(False)).alias("blocked"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(fired(F.col("findings")))))).alias("scanners"))
