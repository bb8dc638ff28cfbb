"""Cases that earlier versions of the training-data operators left out, against plain Python on small fixtures."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from hedgerow.llm import decontamination, langid, license_scan, line_dedup, mixing, ngram_jaccard, token_count, warc


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


# ---- Line dedup


def test_stage_drops_repeats_of_short_lines(spark):
    rng = random.Random(11)
    short = ["Les.", "é", " x ", "All rights reserved.", "Les!", "a" * 23]
    texts = [None, "", "Les.\nLes.", " \n\t\n ", "Les.", prose(rng, 40) + "\n\n" + prose(rng, 40) + "\n\nend"]
    texts += ["\n".join(rng.choice([*short, "", "  ", prose(rng, 9), "long line " * 5]) for _ in range(12)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.stage(spark, df, "").collect()}
    long_ones, seen, want = [], set(), {}
    for d, t in enumerate(texts):
        keep = []
        for line in (t or "").split("\n"):
            if not line.strip(" \t") and len(line) < line_dedup.MIN_CHARS:
                keep.append(line)
                continue
            near = len(line) >= line_dedup.MIN_CHARS and any(line_dedup.edit_distance(x, line) <= 2 for x in long_ones)
            if line not in seen and not near:
                keep.append(line)
            seen.add(line)
            if len(line) >= line_dedup.MIN_CHARS:
                long_ones.append(line)
        if "".join(keep).strip(" \t"):
            want[d] = "\n".join(keep)
    assert got == want and 4 not in got


def kept_lines(texts):
    """Plain Python: each text without lines that an earlier line is within two edits of."""
    seen, out = [], []
    for t in texts:
        keep = []
        for line in (t or "").split("\n"):
            if len(line) >= line_dedup.MIN_CHARS:
                if not any(abs(len(x) - len(line)) < 3 and line_dedup.edit_distance(x, line) <= 2 for x in seen):
                    keep.append(line)
                seen.append(line)
            else:
                keep.append(line)
        out.append(None if t is None else "\n".join(keep))
    return out


def edited(rng, line, n):
    s = list(line)
    for _ in range(n):
        k = rng.randrange(len(s) + 1)
        s[k : k + rng.randrange(2)] = [rng.choice("abcd ")] * rng.randrange(2)
    return "".join(s)


@pytest.mark.parametrize(("hot", "grid"), [(8, 5), (8, 8192), (4096, 7)])
def test_hot_segments_are_split(spark, monkeypatch, hot, grid):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "GRID", grid)
    rng = random.Random(21)
    head, tail, middle = "a common beginning of a line ", " and a common end of a line", " common in the middle "
    lines = [head + prose(rng, 12) for _ in range(50)] + [prose(rng, 12) + tail for _ in range(50)]
    lines += [prose(rng, 5)[:20] + middle + prose(rng, 5)[:20] for _ in range(50)]
    lines += [edited(rng, rng.choice(lines), rng.randrange(1, 5)) for _ in range(250)]
    rng.shuffle(lines)
    texts = ["\n".join(lines[i : i + 4]) for i in range(0, len(lines), 4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert got == dict(enumerate(kept_lines(texts)))


def test_rows_of_a_large_group_of_near_copies_grow_with_its_size(spark):
    rng = random.Random(22)
    base = prose(rng, 14)
    lines = list({edited(rng, base, 2) for _ in range(2000)})
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    assert line_dedup.members(df, line_dedup.MIN_CHARS).count() <= 12 * len(lines)
    lost = line_dedup.near_losers(df.where("doc_id < 400")).count()
    assert lost == sum(not x for x in kept_lines(lines[:400]))


def test_line_dedup_of_nothing_and_of_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_lines int")
    assert line_dedup.dedup_lines(empty).count() == 0 and line_dedup.stage(spark, empty, "").columns == empty.columns
    rows = [(None, "the same line of text for all\nx", 77, "a"), (4, "the same line of text for all\ny", 78, "b"), (None, None, 79, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, n_kept_lines string")
    assert sorted(map(tuple, line_dedup.stage(spark, df, "").collect()), key=repr) == sorted([rows[0], (4, "y", 78, "b")], key=repr)
    assert {(r["text"], r["n_lines"], r["n_kept_lines"]) for r in line_dedup.dedup_lines(df).collect()} == {(rows[0][1], 2, 2), ("y", 2, 1), (None, None, None)}


def test_signature_of_long_and_short_lines():
    import numpy as np

    rng = random.Random(23)
    for n in (30, 300, 70_000):
        a = "".join(rng.choice("abc é😀") for _ in range(n))
        b = edited(rng, a, 2)
        points = np.frombuffer((a + b).encode("utf-32-le"), np.uint32)
        sig = line_dedup.signature(points, np.array([0, len(a)]), np.array([len(a), len(b)]))
        assert line_dedup.close(sig[:1], sig[1:])[0, 0]


# ---- Near duplicates


def shingle_set(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_many_alike_but_unlinked_documents(spark, monkeypatch):
    """A common passage within the prefixes of documents that all survive: copies in pairs, pairs unlinked."""
    rng = random.Random(31)
    pairs = []
    cut = ngram_jaccard.cut

    def watched(df):
        out = cut(df)
        if out.columns == ["p", "q"]:
            pairs.append(out.count())
        return out

    monkeypatch.setattr(ngram_jaccard, "cut", watched)
    passage = prose(rng, 90).split()
    texts, parts = [], [prose(rng, 9).split() for _ in range(40)]
    for i in range(600):
        w = list(passage)
        for x in rng.sample(range(0, 90, 9), 3):
            w[x : x + 9] = rng.choice(parts)
        texts.append(" ".join(w))
    texts = list(dict.fromkeys(texts))
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = sorted((r["doc_id"], r["component_id"]) for r in ngram_jaccard.near_duplicates(df).collect())
    assert got == [(i, find(i)) for i in range(len(texts))]
    assert len(set(find(i) for i in range(len(texts)))) > 300 and pairs[0] < 5000


def test_near_duplicates_stage_of_null_and_repeated_ids(spark):
    rng = random.Random(12)
    a, b, c, d, e, f = (prose(rng, 60) for _ in range(6))
    rows = [(None, a), (None, b), (7, c), (7, d), (7, d), (3, e), (None, e + " end"), (9, e), (None, f), (None, f + " end"), (8, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in ngram_jaccard.stage(spark, df, "").collect()), key=repr)
    last = min((x for x in got if x[1] in (f, f + " end")), default=None)
    want = [(None, a), (None, b), (7, c), (7, d), (3, e), last, (8, None), (None, "")]
    assert got == sorted(want, key=repr)


# ---- Decontamination


def test_decontamination_stage_of_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(13)
    item, clean, other = prose(rng, 30), prose(rng, 80), prose(rng, 50)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, "so " + item + " end"), (None, clean), (5, clean + " " + item), (5, other), (6, item), (7, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontamination.stage(spark, df, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(None, clean), (5, other), (7, None), (None, None)]))


# ---- Licences


def test_notice_with_foreign_words_inside():
    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.THRESHOLD)
    w = license_scan.normal_words(license_scan.TEMPLATES["GPL-3.0-header"])
    rng = random.Random(14)
    at = next(i for i in range(len(w)) if w[i : i + 4] == "as published by the".split())
    for n in range(4, 11):
        foreign = [f"x{i}" for i in range(n)]
        words = prose(rng, 30).split() + w[:at] + foreign + w[at + 4 :] + prose(rng, 30).split()
        found = {x[0]: x[1:] for x in scanner.scan(words)}
        assert found["GPL-3.0-header"] == ((len(w) - 4) / len(w), 30, 30 + len(w) - 4 + n)
        found = {x[0]: x[1:] for x in scanner.scan([*w[:at], *foreign, *w[at:], *prose(rng, 40).split(), *w[:at], *foreign, *w[at:]])}
        assert found["GPL-3.0-header"] == (1.0, 0, len(w) + n)


def test_coverage_with_words_inserted_deleted_and_moved():
    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.THRESHOLD)
    rng = random.Random(41)
    for name in ("GPL-3.0-header", "MIT-text", "Apache-2.0-header", "BSD-3-Clause"):
        w = license_scan.normal_words(license_scan.TEMPLATES[name])
        n = len(w)

        def found(words):
            text = [f"y{rng.randrange(99)}" for _ in range(40)] + words + [f"y{rng.randrange(99)}" for _ in range(40)]
            return {x[0]: x[1:] for x in scanner.scan(text)}.get(name)

        for k in (1, 5, 20, 40):
            at = rng.randrange(1, n)
            assert found(w[:at] + [f"x{i}" for i in range(k)] + w[at:]) == (1.0, 40, 40 + n + k), (name, k)
        spread = [y for i, x in enumerate(w) for y in ([x, "xa", "xb"] if i % 2 and i < n - 1 else [x])]
        assert found(spread)[0] == 1.0
        gone = set(rng.sample(range(1, n - 1), n // 6))
        assert found([x for i, x in enumerate(w) if i not in gone])[0] >= 1 - (len(gone) + 2) / n
        gone = set(rng.sample(range(n), n // 4 + 1))
        assert found([x for i, x in enumerate(w) if i not in gone]) is None
        at = rng.randrange(2, n - 4)
        moved = w[:at] + w[at + 2 :] + w[at : at + 2]
        assert found(moved)[0] >= (n - 4) / n
        assert found(rng.sample(w, n)) is None
    assert license_scan.Scanner({"a": "one two"}, 0.8).scan([]) == []


def test_license_scan_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, licenses int")
    assert license_scan.scan_licenses(empty).count() == 0


# ---- Decontamination at any number and length of items


def test_long_items_and_many_seeds(spark, monkeypatch):
    rng = random.Random(42)
    item = prose(rng, 1_200, 900)
    items = spark.createDataFrame([(1, item), (2, prose(rng, 30)), (3, None), (4, "two words")], "item_id long, text string")
    docs = [(1, "so " + item), (2, prose(rng, 50)), (3, " ".join(item.split()[:700])), (4, "x two words y"), (5, " ".join(item.split()[:300]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = [(1, 1, 1_200), (3, 1, 700), (4, 4, 2)]
    got = lambda: sorted((r["doc_id"], r["item_id"], r["n_matched"]) for r in decontamination.contaminated(df, items).collect())
    assert got() == want
    monkeypatch.setattr(decontamination, "SEEDS_PER_JOIN", 10)
    monkeypatch.setattr(decontamination, "ITEM_BYTES", 10)
    assert got() == want


# ---- Clashing names, odd ids, nothing at all


def test_clashing_names_of_stages(spark, tmp_path):
    spark.createDataFrame([(1, prose(random.Random(1), 30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(i, f"the cat {i} sat on a mat with the dog and the bird number {i} of many", "en", "s", 9, 0.25, "mine", 77, "t") for i in range(12)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, n_lines int, _text string"
    df = spark.createDataFrame(rows, schema).withColumn("copy", F.lit("c")).withColumn("at", F.lit(1)).withColumn("node", F.lit(2))
    for stage in (langid.stage, line_dedup.stage, ngram_jaccard.stage, decontamination.stage):
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns
        for r in out.collect():
            assert (r["score"], r["lang_pred"], r["n_lines"], r["_text"], r["copy"], r["at"], r["node"]) == (0.25, "mine", 77, "t", "c", 1, 2)
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
    out = mixing.stage(spark, df, str(tmp_path))
    assert sorted(out.columns) == sorted(df.columns) and {r["copy"] for r in out.collect()} <= {1, 2}
    counted = token_count.count_tokens(df, "word_bpe_49k.json")
    assert counted.columns.count("_text") == 1 and counted.count() == 12


def test_token_counts_of_long_pieces(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_count, "MEMO", 2)
    t = Tokenizer.from_file(token_count.vocabulary_path("word_bpe_49k.json"))
    texts = ["a b c d e f", "x" * 3000 + " y", "字" * 500, "a b a b " * 20, "q" * 65 + " " + "q" * 64]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    got = {r["doc_id"]: r["n_tokens"] for r in token_count.count_tokens(df, "word_bpe_49k.json").collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}
    assert token_count.count_tokens(df.limit(0), "word_bpe_49k.json").count() == 0


# ---- WARC


def test_markup_is_read_in_one_pass():
    seconds = []
    for n in (50_000, 200_000):
        start = time.perf_counter()
        for tag in ("<a ", "<script ", "<title ", "<a href=\"", "<!-- ", "</script ", "<p", "<"):
            page = tag * n
            warc.plain_text(page), warc.links(page), warc.title(page)
        seconds.append(time.perf_counter() - start)
    assert seconds[1] < 12 * seconds[0]
    assert warc.plain_text("<p>a<b>c</b><script>x</script>d<!-- e -->f < g &lt;p&gt;<br/>h<i") == "ac d f < g <p>\nh"
    assert warc.links("<a class=x href='/1'>u</a><A HREF=/2>v<a name=z>w<!-- <a href=3> --><abbr href=4><a href=\"5&amp;6\">") == ["/1", "/2", "5&6"]
    assert warc.title("<TITLE lang=x> A\n&amp; B</title >") == "A & B" and warc.title("<title") == ""


def test_records_of_given_responses(spark, tmp_path):
    head = "HTTP/1.1 404 Not Found\r\nContent-Type: text/html\r\nX-Odd: a: b"
    payload = "<title>é</title><p>Grüße</p><a href=/x>".encode() + b"\xff"
    rows = [("k-1", "http://a/", bytearray(payload), "<urn:uuid:1>", "2020-02-02T02:02:02Z", head), ("k-2", None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html binary, rid string, date string, head string")
    records = warc.build(pages, record_id_col="rid", date_col="date", head_col="head")
    by = {(r["page_id"], r["type"]): r for r in records.collect()}
    one = by["k-1", "response"]
    assert (one["record_id"], one["date"], bytes(one["block"])) == ("<urn:uuid:1>", "2020-02-02T02:02:02Z", head.encode() + b"\r\n\r\n" + payload)
    assert one["payload_digest"] == warc.digest(payload) and by["k-1", "conversion"]["refers_to"] == "<urn:uuid:1>"
    about = __import__("json").loads(bytes(by["k-1", "metadata"]["block"]))
    assert about["http_headers"] == {"Status": "404 Not Found", "Content-Type": "text/html", "X-Odd": "a: b"} and about["links"] == ["/x"]
    assert bytes(by["k-1", "conversion"]["block"]).decode() == "é\nGrüße\n\ufffd".replace("é\n", "é\n") and len(by) == 6
    warc.write_warc(records, str(tmp_path / "w"))
    back = warc.responses(warc.read_warc(spark, str(tmp_path / "w")))
    again = warc.build(back.withColumn("page_id", F.lit("k-1")).where("record_id = '<urn:uuid:1>'"), record_id_col="record_id", date_col="date", head_col="head").collect()
    assert {(r["type"], r["record_id"], r["block_digest"], r["date"]) for r in again} == {(r["type"], r["record_id"], r["block_digest"], r["date"]) for k, r in by.items() if k[0] == "k-1"}
    assert warc.build(pages.limit(0)).count() == 0


def test_broken_warc_files():
    whole = warc.serialize(warc.derive("1", "u", "<p>x")[0])
    assert [x["block"] for x in warc.parse(whole)] == [warc.derive("1", "u", "<p>x")[0]["block"]]
    cut = list(warc.parse(whole + whole[:-20]))
    assert len(cut) == 2 and cut[1]["block"] == cut[0]["block"][: len(cut[1]["block"])]
    assert list(warc.parse(b"WARC/1.1\r\nno colon here\r\nContent-Length: 1\r\n\r\nx")) == [{"headers": {"Content-Length": "1"}, "block": b"x"}]
    assert list(warc.parse(b"WARC/1.1\r\nbroken")) == []
