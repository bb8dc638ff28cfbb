"""Scanners, policies, normalization, redaction and transforms on literal cases."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from hedgerow.functions import rules as R
from hedgerow.functions.normalize import normalize_text, normalize_with_map
from hedgerow.functions.scalars import jwt_valid, looks_random, shannon_entropy, ssn_valid
from hedgerow.operators import guards, transforms
from hedgerow.operators import scanners as S
from hedgerow.operators.evaluate import confusion, policy_accuracy, scan_cases
from hedgerow.operators.policy import Policy, redact_spans
from hedgerow.plans.fixtures import CASES
from hedgerow.sources import BlockedError, read_cases, read_texts, write_redacted

TRICKY = ["", "a😀b damn 4111 1111 1111 1111", "édamn damné damn", "١٢٣-45-6789", "ſystem PROMPT Key", "x\u001cy z", "á word́ b", "ｄａｍｎ １２３", "baac x1y", "\x00\x85 tab\t", None]


def frame(spark, rows):
    return spark.createDataFrame([(t,) for t in rows], "text string")


def test_every_case(spark):
    rows = confusion(scan_cases(spark.createDataFrame(list(CASES), "scanner string, text string, expected boolean"))).collect()
    assert all(r["fp"] == 0 and r["fn"] == 0 for r in rows)
    assert [r for r in rows if r["scanner"] is None][0]["cases"] == len(CASES)


@pytest.mark.parametrize("pattern", [r"\bdamn\b", r"\d+", r"\w+", r"\s", r"[\w.]+", r"(?<!\d)\d{3}", "a*", r"\d?", r"(?P<w>a)(?P=w)"])
def test_spans_equal_python(spark, pattern):
    got = frame(spark, TRICKY).select("text", S.Regex(forbidden=[pattern]).scan(S.of(F.col("text"))).alias("m")).collect()
    for r in got:
        want = [(m.start(), m.end(), m.group()) for m in re.finditer(pattern, r["text"] or "")] if r["text"] is not None else []
        assert [(m["start"], m["end"], m["matched_text"]) for m in r["m"]] == want


def test_gates_never_hide_a_match():
    """What a rule finds is what its bare pattern finds, on texts made of the pieces of its own pattern."""
    import random

    rng = random.Random(1)
    rules = [*R.PROMPT_INJECTION, *R.PROMPT_LEAK, *R.CODE_EXECUTION, *R.EXFILTRATION, *R.SECRETS, R.JWT, R.ASSIGNMENT, R.RANDOM_TOKEN, R.EMAIL, R.PHONE, R.SSN, R.CARD, R.URL]
    for rule in rules:
        pieces = [*re.findall(r"[A-Za-z0-9:/@=.<>\[\]_-]+", rule.pattern), " ", "  ", "-", "1", "23", "456", "7890", "(", "'", "ſ", "İ", "K", "\u0663", "a", "B", ".", "@"]
        for _ in range(400):
            text = "".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 24)))
            text = "".join(c.upper() if rng.random() < 0.1 else c for c in text)
            want = [m.span() for m in re.finditer(rule.pattern, text, re.IGNORECASE if rule.ignore_case else 0)]
            assert [r[1:3] for r in S._by_rule(rule, S.Doc(text))] == want, (rule.pattern, text)


def test_cards_with_any_separators(spark):
    digits = "4111111111111111"
    texts = [digits, " ".join(digits), "-".join(digits), "41 11 11 11 11 11 11 11", "4-1 111111 1 1 1 1111-1", " ".join(digits[:-1]) + " 2"]
    got = Policy([S.Pii()]).apply(frame(spark, texts)).collect()
    assert [r["blocked"] for r in got] == [True, True, True, True, True, False]


class Shouting(S.Scanner):
    name = "shouting"

    def scan(self, t):
        return F.when(t.text == F.upper(t.text), F.array(F.struct(F.lit("shouting").alias("scanner"), F.lit(0.6).alias("score"), F.lit(0).alias("start"), F.length(t.text).alias("end"), t.text.alias("matched_text"), F.lit("Upper case").alias("message")))).otherwise(F.array())


def test_scanners_of_the_users_own(spark):
    policy = Policy([S.Pii(), Shouting()])
    assert [f["scanner"] for f in policy.scan(spark, "MAIL A@B.COM")["findings"]] == ["pii", "shouting"]
    assert policy.scan(spark, "НІ\u200b")["findings"][0]["matched_text"] == "НІ"
    assert [f["scanner"] for f in Policy([Shouting(), S.Pii()], mode="fail_fast").scan(spark, "MAIL A@B.COM")["findings"]] == ["shouting"]


def test_normalization():
    assert normalize_with_map("a​b") == ("ab", [0, 2])
    assert normalize_with_map("ﬁ") == ("fi", [0, 0])
    assert normalize_with_map("plain") == ("plain", [0, 1, 2, 3, 4])
    assert normalize_text("раy") == "pay"


def test_remap_covers_what_was_hidden(spark):
    r = Policy([S.Pii()]).scan(spark, "mail j​ane@example.com now", redact=True)
    assert r["redacted_text"] == "mail [REDACTED:PII] now"
    assert r["findings"][0]["matched_text"] == "j​ane@example.com"
    assert Policy([S.Pii()]).scan(spark, "​​")["findings"] == []


@pytest.mark.parametrize(
    ("spans", "want"),
    [([(2, 8, "a"), (5, 12, "b")], "01[REDACTED:A][REDACTED:B]"), ([(2, 8, "a"), (3, 5, "b")], "01[REDACTED:A]89AB"), ([(0, 2, "a"), (2, 4, "b")], "[REDACTED:A][REDACTED:B]456789AB"), ([], "0123456789AB")],
)
def test_redaction(spark, spans, want):
    kind = "array<struct<scanner:string,score:double,start:int,end:int,matched_text:string,message:string>>"
    df = spark.createDataFrame([("0123456789AB", [(n, 0.9, s, e, "", "") for s, e, n in spans])], f"text string, f {kind}")
    assert df.select(redact_spans(F.col("text"), F.col("f"))).first()[0] == want


def test_policy_rules(spark):
    text = "Call 415-555-0132, mail a@b.com"
    assert not Policy([S.Pii()], thresholds={"pii": 0.95}).scan(spark, text)["blocked"]
    assert Policy([S.Pii()], thresholds={"pii": 0.9}).scan(spark, text)["blocked"]
    scores = [f["score"] for f in Policy([S.Pii()]).scan(spark, text)["findings"]]
    assert scores == sorted(scores, reverse=True)
    assert Policy([]).check(spark, "anything")
    assert Policy([S.Pii()], placeholders={"pii": "[X]"}).scan(spark, "a@b.com", redact=True)["redacted_text"] == "[X]"
    both = Policy([S.TokenLimit(1), S.Pii()], mode="fail_fast").scan(spark, text)["findings"]
    assert {f["scanner"] for f in both} == {"token_limit"}
    with pytest.raises(ValueError):
        Policy(mode="some")
    with pytest.raises(ValueError, match="unknown scanner"):
        Policy.from_dict({"scanners": ["nope"]})
    with pytest.raises(ValueError):
        S.Regex()
    with pytest.raises(ValueError):
        S.TokenLimit(0)


def test_null_and_empty_texts(spark):
    rows = Policy.default().apply(frame(spark, [None, ""]), redact=True).collect()
    assert [(r["findings"], r["blocked"], r["redacted_text"]) for r in rows] == [([], False, None), ([], False, "")]


def test_exfiltration_reports_secrets_and_pii_as_its_own(spark):
    found = Policy([S.Exfiltration(), S.Pii()]).scan(spark, "Your password is hunter2, mail a@b.com ghp_" + "a1B2" * 9)["findings"]
    assert {f["scanner"] for f in found} == {"exfiltration", "pii"}
    assert sum(f["matched_text"] == "a@b.com" for f in found) == 2


def test_user_patterns_of_both_kinds(spark):
    p = Policy([S.Regex(forbidden=[r"(?P<w>ab)(?P=w)", r"\bcd\b"], required=[r"zz$"])])
    assert {f["matched_text"] for f in p.scan(spark, "abab cd")["findings"]} == {"abab", "cd", "abab cd"}


def test_scalars(spark):
    df = spark.createDataFrame([("123-45-6789",), ("000-12-3456",), ("123-00-6789",), ("900-12-3456",)], "s string")
    assert [r[0] for r in df.select(ssn_valid(F.col("s"))).collect()] == [True, False, False, False]
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.c2lnbmF0dXJl"
    df = spark.createDataFrame([(jwt,), ("aaaaaaaaaaaa.bbbbbbbbbbbb.cc",)], "s string")
    assert [r[0] for r in df.select(jwt_valid(F.col("s"))).collect()] == [True, False]
    df = spark.createDataFrame([("0123456789abcdef" * 3,), ("a" * 40,)], "s string")
    assert [r[0] for r in df.select(looks_random(F.col("s"))).collect()] == [True, False]
    assert shannon_entropy("") == 0 and shannon_entropy("ab") == 1


def test_transforms_undo(spark):
    t = ["Contact jane.doe@example.com today, please", "Short a"]
    for name, fn in transforms.TRANSFORMS.items():
        for r in frame(spark, t).select("text", fn(F.col("text")).alias("x")).collect():
            want = transforms.alternate(r["text"]) if name in ("mixed_case", "combined") else r["text"]
            assert normalize_text(r["x"]) == want


def test_guards(spark):
    p = Policy([S.Pii()])
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "a@b.com"), (2, 0, "user", None)], "conv_id int, turn int, role string, text string")
    got = {r["conv_id"]: (r["turns"], r["blocked_turns"], r["blocked"]) for r in guards.guard_conversations(turns, p, p).collect()}
    assert got == {1: (2, 1, True), 2: (1, 0, False)}

    @guards.guarded(p, redact=True)
    def same(df):
        return df.withColumn("text", F.lit("a@b.com"))

    assert same(frame(spark, ["fine"])).first()["text"] == "[REDACTED:PII]"
    with pytest.raises(guards.GuardedError, match="pii"):
        same(frame(spark, ["a@b.com"]))
    log = spark.createDataFrame([("/chat", "a@b.com", "ok"), ("/chat", "hi", "c@d.org"), ("/x", "a@b.com", "ok")], "path string, request string, response string")
    assert [r["status"] for r in guards.guard_http(log, p, include=["/chat"]).collect()] == [400, 500, 200]
    body = '{"messages": [{"role": "user", "content": [{"text": "a"}, {"content": "b"}, 3]}], "system": "s", "prompt": ["p"], "input": "i", "instructions": "n"}'
    assert guards.request_texts(__import__("json").loads(body)) == ["a", "b", "s", "p", "i", "n"]
    assert guards.response_texts({"choices": [{"message": {"content": "x"}}, {"text": "y"}], "output_text": "z", "content": ["q"]}) == ["z", "q", "x", "y"]


def test_sources(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"cases": [{"text": "a@b.com", "expected": true, "category": "pii"}]}')
    cases = read_cases(spark, str(tmp_path / "c.json"))
    assert policy_accuracy(cases, Policy([S.Pii()])).first()["accuracy"] == 1
    (tmp_path / "t.txt").write_text("one\na@b.com")
    texts = read_texts(spark, str(tmp_path / "t.txt"))
    with pytest.raises(BlockedError):
        write_redacted(texts, Policy([S.Pii()]), str(tmp_path / "no"), strict=True)
    assert not (tmp_path / "no").exists()
    write_redacted(texts, Policy([S.Pii()]), str(tmp_path / "out"))
    assert "\n".join(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == "one\n[REDACTED:PII]"


def test_redaction_in_payloads(spark):
    import json

    policy = Policy([S.Pii()], thresholds={"pii": 0.8})
    body = {"choices": [{"message": {"content": "mail a@b.com"}, "text": "c@d.org x@y.net", "index": 0}], "content": [{"text": "e@f.com", "content": ["g@h.com", 3]}], "id": "a@b.com"}
    rows = [json.dumps(body), '{"completion":  "fine"}', "no json a@b.com", None, "[1]"]
    got = [r[0] for r in guards.redact_payloads(frame(spark, rows), policy, "text").collect()]
    x = "[REDACTED:PII]"
    assert json.loads(got[0]) == {"choices": [{"message": {"content": f"mail {x}"}, "text": f"{x} {x}", "index": 0}], "content": [{"text": x, "content": [x, 3]}], "id": "a@b.com"}
    assert got[1:] == rows[1:]
    native = Policy([S.Pii()]).apply(frame(spark, TRICKY + ["a@b.com 415-555-0132 a@b.com"]), redact=True).collect()
    assert all(r["redacted_text"] == Policy([S.Pii()]).redacted_if_blocked(r["text"]) for r in native if r["text"] is not None)


def test_http_bodies_as_bytes(spark):
    p = Policy([S.Pii()])
    log = spark.createDataFrame([("/a", bytearray(b"hi \xff"), bytearray(b"mail a@b.com")), ("/a", None, bytearray(b"ok \xff"))], "path string, request binary, response binary")
    got = guards.guard_http(log, p, redact=True).collect()
    assert [(r["status"], bytes(r["response"])) for r in got] == [(200, b"mail [REDACTED:PII]"), (200, b"ok \xff")]
    assert [r["status"] for r in guards.guard_http(log, p).collect()] == [500, 200]


def test_sql_functions(spark):
    from hedgerow import register

    register(spark)
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.c2lnbmF0dXJl"
    row = spark.sql(f"SELECT jwt_valid('{jwt}'), jwt_valid(null), shannon_entropy('ab'), luhn_valid('4111111111111111'), ssn_valid('000-12-3456'), estimate_tokens('abcdefgh')").first()
    assert tuple(row) == (True, None, 1.0, True, False, 2)


def test_jobs(spark, tmp_path, capsys):
    from hedgerow import jobs

    (tmp_path / "c.json").write_text('{"cases": [{"text": "a@b.com", "expected": true, "category": "pii"}, {"text": "fine text", "expected": false, "category": "pii"}]}')
    (tmp_path / "t.txt").write_text("one\na@b.com")
    cases = str(tmp_path / "c.json")
    assert jobs.main(["policy", cases], spark) == 0 and jobs.main(["accuracy", cases], spark) == 0 and jobs.main(["adversarial", cases], spark) == 0
    (tmp_path / "bad.json").write_text('{"cases": [{"text": "fine", "expected": true, "category": "pii"}]}')
    assert jobs.main(["policy", str(tmp_path / "bad.json")], spark) == 1
    assert jobs.main(["redact", str(tmp_path / "t.txt"), str(tmp_path / "o")], spark) == 0
    assert jobs.main(["redact", str(tmp_path / "t.txt"), str(tmp_path / "o2"), "--strict"], spark) == 1
    assert jobs.main(["latency", "--quick"]) == 0 and "attack" in capsys.readouterr().out


def test_first_findings_as_a_listing(spark):
    from hedgerow.operators.policy import listing

    row = Policy([S.Pii()]).apply(frame(spark, ["a@b.com " * 12])).select(listing(F.col("findings"))).first()
    assert len(row[0].split("\n")) == 10 and row[0].startswith("[pii] 0.90 0-7 Email address")


def test_adversarial_recall(spark):
    from hedgerow.operators.evaluate import adversarial, adversarial_overall, failures

    cases = [("pii", "Mail jane@example.com today please", True), ("pii", "nothing here", False), ("code_execution", "Just eval(user_input) please.", True), ("code_execution", "no code", False)]
    df = adversarial(spark.createDataFrame(cases, "scanner string, text string, expected boolean"), ["pii", "code_execution"])
    rows = {r["scanner"]: r.asDict() for r in df.collect()}
    assert rows["pii"]["clean"] == rows["pii"]["combined"] == rows["pii"]["neg_ok"] == 1
    assert rows["code_execution"]["fullwidth"] == 1 and rows["code_execution"]["mixed_case"] == rows["code_execution"]["combined"] == 0
    assert adversarial_overall(df).first()["mixed_case"] == 0.5
    found = spark.createDataFrame([("pii", "x" * 99, True, False), ("pii", "y", False, False)], "scanner string, text string, expected boolean, found boolean")
    assert [tuple(r) for r in failures(found).collect()] == [("pii", "FN", "x" * 80)]
