"""The training-data operators against plain Python on small fixtures, with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hedgerow.llm import decontamination, langid, license_scan, line_dedup, mixing, ngram_jaccard, quality_model, quality_rules, token_count, warc

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}{'.' if rng.random() < 0.1 else ''}" for _ in range(n))


def documents(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)], SCHEMA)


# ---- N-gram Jaccard join


def shingle_set(text):
    w = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def linked(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def near_copies(rng, n, groups):
    out = []
    for g in range(groups):
        base = prose(rng, 120).split()
        for _ in range(n):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(w))
    return out


def test_jaccard_equals_brute_force(spark):
    rng = random.Random(3)
    passage = prose(rng, 60)
    texts = [None, "", " \n", "A b", "a B", "a b c", "One two three four five", "one two three four FIVE"]
    texts += near_copies(rng, 6, 8) + [prose(rng, 50) + " " + passage + " " + prose(rng, 60) for _ in range(30)] + [prose(rng, 3000)] * 3
    rows = [(i, t) for i, t in enumerate(texts)] + [(20, texts[20]), (-5, texts[30])]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, node int, n_shingles string")
    got = sorted(tuple(r) for r in ngram_jaccard.near_duplicates(df).collect())
    assert got == linked(rows)


def test_jaccard_large_group(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 16)
    rows = list(enumerate(near_copies(random.Random(5), 90, 1)))
    got = sorted(tuple(r) for r in ngram_jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == linked(rows)


def test_jaccard_empty_table(spark):
    assert ngram_jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- Line dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def edit(rng, line, n):
    s = list(line)
    for _ in range(n):
        k = rng.randrange(len(s) + 1)
        s[k : k + rng.randrange(2)] = [rng.choice("abc é😀")] * rng.randrange(2)
    return "".join(s)


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.choice([1, 2, 3, 9, 40, 90])))
        b = edit(rng, a, rng.randrange(4)) or "a"
        assert line_dedup.edit_distance(a, b) == min(distance(a, b), 3)


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(2)
    base = [prose(rng, 6 + k % 5) for k in range(12)]
    texts = [None, "", "\n\n", "short\nshort"]
    texts += ["\n".join(edit(rng, rng.choice(base), rng.randrange(4)) for _ in range(rng.randrange(1, 6))) for _ in range(40)] + [base[0] * 200, base[0] * 200]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents(spark, texts).withColumn("h1", F.lit(1)).withColumn("_kept", F.lit(1))).collect()}
    seen, want = [], {}
    for d, t in enumerate(texts):
        keep = []
        for line in (t or "").split("\n"):
            if len(line) >= line_dedup.MIN_CHARS:
                if any(abs(len(x) - len(line)) < 3 and line_dedup.edit_distance(x, line) <= 2 for x in seen):
                    seen.append(line)
                    continue
                seen.append(line)
            keep.append(line)
        want[d] = None if t is None else "\n".join(keep)
    assert got == want


# ---- Token counts


def test_token_counts(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_count.vocabulary_path("word_bpe_49k.json"))
    texts = [None, "", " ", "Hello there's <|endoftext|> x\u001c.\u001c y", "é ΑΣ\x85b", "a" * 5000, "word " * 4000, "Hello"]
    got = token_count.count_tokens(documents(spark, texts).withColumn("n_tokens", F.lit("clash")), "word_bpe_49k.json", batch_bytes=100).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]
    assert [r["n_bytes"] for r in got] == [len((x or "").encode()) for x in texts]
    assert got[6]["over_limit"] and not got[7]["over_limit"]


def test_token_counts_of_a_piece_model(spark):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=token_count.vocabulary_path("piece_bpe_32k.model"))
    got = token_count.count_tokens(documents(spark, ["Hello  world", None]), "piece_bpe_32k.model").orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == [len(m.encode("Hello  world")), 0]


# ---- Decontamination


def test_decontamination(spark):
    rng = random.Random(4)
    items = [prose(rng, n) for n in (14, 30, 59, 5)] + [None, ""]
    w = items[1].split()
    w[7] = "other"
    texts = [prose(rng, 200), "intro " + items[0].upper() + " outro", prose(rng, 90) + " " + " ".join(w), " ".join(items[2].split()[:40]), "so " + items[3] + " end", None, "", items[2][: len(items[2]) // 5]]
    df = documents(spark, texts).withColumn("item_id", F.lit(9)).withColumn("at", F.lit(1))
    got = decontamination.contaminated(df, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(df, none).count() == 0


# ---- Quality rules


def test_quality_rules_equal_brute_force(spark):
    rng = random.Random(6)
    texts = [None, "", "a a a a", prose(rng, 60, 8), prose(rng, 400, 30) + "\n\nx y\nx y\n \nx y", "## | & word\n" * 30, "🙂 " * 60, prose(rng, 20000, 3000)]
    got = quality_rules.quality_columns(documents(spark, texts).withColumn("kept", F.lit(5))).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        w, t = WORDS.findall(t or ""), t or ""
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        places = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(places))
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(places) > 50 * len(w))


# ---- Mixing


def test_fill():
    goals = mixing.fill([("a", 100), ("b", 1000), ("c", 0)])
    assert sum(goals) == pytest.approx(1.5 * 1100) and goals[0] == 200 and goals[2] == 0


def test_mix(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["b", "a", "c", None, "é"])) for i in range(900)] + [(5, "x y", "a"), (5, "x y", "a"), (901, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == len(rows)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 60
    assert mixing.mix(df.limit(0)).count() == 0


def test_mix_narrows_down_large_bins(spark, monkeypatch):
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), "s") for i in range(500)] + [(1000 + i, "w " * 9, "t") for i in range(2000)], "doc_id long, text string, source string")
    want = sorted(map(repr, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "RANKED", 1)
    assert sorted(map(repr, mixing.mix(df).collect())) == want


# ---- WARC


def test_warc_round_trip(spark, tmp_path):
    html = '<html><head><title>A &amp; B</title></head><body><!-- x --><p>One<br>two</p><script>no()</script><a href="/l?a=1&amp;b=2">go</a></body>'
    pages = spark.createDataFrame([(1, "http://a/b", html), (2, None, None), (3, "http://c", "<p>open <b"), (1, "http://a/b", html)], "page_id long, url string, html string")
    records = warc.build(pages)
    rows = records.collect()
    assert len(rows) == 12
    by = {(r["page_id"], r["type"]): r for r in rows}
    assert by[1, "conversion"]["block"] == b"One\ntwo\ngo" and by[1, "metadata"]["title"] == "A & B" and by[1, "metadata"]["n_links"] == 1
    assert by[1, "conversion"]["refers_to"] == by[1, "metadata"]["refers_to"] == by[1, "response"]["record_id"]
    assert by[1, "response"]["payload_digest"] == warc.digest(html.encode()) and by[2, "conversion"]["block"] == b""
    warc.write_warc(records, str(tmp_path / "w"))
    back = {r["headers"]["WARC-Record-ID"]: (r["headers"].get("WARC-Refers-To"), bytes(r["block"])) for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert back == {r["record_id"]: (r["refers_to"], bytes(r["block"])) for r in rows}


# ---- Language ID, quality model


def test_languages(spark):
    words = {"en": "the of and to in that was for", "de": "der die und nicht ein auf für mit", "xx": "жук лес дом кот мир луна"}
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(words[k].split()) for _ in range(1 + i % 30)), k) for i, k in enumerate(sorted(words) * 60)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(train)
    odd = [(500, None), (501, "123 --- "), (502, "Nicht für mich " * 3000), (503, "Дом")]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.detect(spark.createDataFrame(odd, "doc_id long, text string").withColumn("score", F.lit("clash")), model).collect()}
    assert [got[k][0] for k in (500, 501, 502, 503)] == ["und", "und", "de", "xx"] and all(0 <= s <= 1 for _, s in got.values())
    assert langid.train(train.limit(0)).languages == []


def test_quality_model(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 80) if i % 2 else "### $$ " * rng.randrange(5, 90)) for i in range(400)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    got = quality_model.score(docs, quality_model.train(docs, labels)).collect()
    held = [r for r in got if r["doc_id"] < 400 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum(r["predicted"] == r["doc_id"] % 2 for r in held) >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality_model.score(docs, quality_model.train(docs, labels.limit(0))).collect()} == {0.5}


def test_isotonic():
    import numpy as np

    knots, values = quality_model.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 1]))
    assert list(knots) == sorted(knots) and list(values) == sorted(values)


# ---- Licences


def test_alignment():
    assert license_scan.align("a b c d".split(), "a b c d".split()) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert license_scan.align("x b y d".split(), "b d".split()) == [(1, 0), (3, 1)]
    assert license_scan.align(["p"], ["q"]) == []


def test_license_scan(spark):
    rng = random.Random(10)
    mit, gpl = license_scan.TEMPLATES["MIT"], license_scan.TEMPLATES["GPL-3.0"]
    texts = [None, "", prose(rng, 50) + "\n" + mit + "\n" + prose(rng, 50), gpl.upper() + "\n" + gpl, prose(rng, 3000), "This work is licensed under the old GNU General Public License, version 3."]
    got = {r["doc_id"]: [x["license"] for x in r["licenses"]] for r in license_scan.scan_licenses(documents(spark, texts).withColumn("licenses", F.lit(1))).collect()}
    assert got == {0: [], 1: [], 2: ["MIT"], 3: ["GPL-3.0"], 4: [], 5: ["GPL-3.0"]}
