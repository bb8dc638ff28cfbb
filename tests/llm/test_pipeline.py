"""The pipeline on a small corpus, and oracle SQL of the llm queries."""

from __future__ import annotations

import hashlib
import math
import os
import random
from collections import Counter

import pytest
import xxhash
from test_operators import linked

import corpus_pipeline
from hedgerow.llm import decontamination, langid, line_dedup, quality_model

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "source_mix"]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and set(docs.columns) | {"copy"} == set(out[0].asDict())
    assert {r["copy"] for r in out} <= {1, 2}
    kept = {r["doc_id"] for r in out}
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not [r["doc_id"] for r in out if any(b in r["text"] for b in bench)]
    assert len(kept) > 0.5 * docs.count()


def test_stages_keep_columns_and_work(spark):
    rng = random.Random(0)
    w = lambda n: " ".join("the of and to in that was for with".split()[rng.randrange(9)] + str(rng.randrange(99)) for _ in range(n))
    base = w(80)
    texts = [base, base + " end", w(60), None, "", "12 34", w(90) + "\n" + w(30)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "more") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, extra string")
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        got[name] = stage(spark, df, SF)
        assert set(df.columns) <= set(got[name].columns)
    assert {r["doc_id"] for r in got["language_id"].collect()} == {0, 1, 2, 6}
    assert {r["doc_id"] for r in got["near_duplicates"].collect()} == {0, 2, 3, 4, 5, 6}
    assert {r["doc_id"] for r in got["line_dedup"].collect()} == {0, 1, 2, 5, 6}
    assert line_dedup.MIN_CHARS > 5


def tid(text):
    """The id of a text in the stages' row keys."""
    n = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return n - (1 << 64) if n >> 63 else n


def key(row):
    return (row["doc_id"] is None, row["doc_id"] or 0, tid(row["text"]))


def plain_line_dedup(rows):
    lines = {(r["doc_id"] is not None, r["doc_id"] or 0, i, tid(r["text"]), x) for r in rows for i, x in enumerate(r["text"].split("\n"))}
    long_ones, seen, gone = [], set(), set()
    for at in sorted(lines):
        x = at[4]
        if x in seen or len(x) >= line_dedup.MIN_CHARS and any(line_dedup.edit_distance(y, x) <= 2 for y in long_ones):
            gone.add(at)
        if x.strip():
            seen.add(x)
        if len(x) >= line_dedup.MIN_CHARS:
            long_ones.append(x)
    out = []
    for r in rows:
        text = "\n".join(x for i, x in enumerate(r["text"].split("\n")) if (r["doc_id"] is not None, r["doc_id"] or 0, i, tid(r["text"]), x) not in gone)
        if text.strip():
            out.append(r | {"text": text, "n_chars": len(text)})
    return out


def plain_near_duplicates(rows):
    by = {key(r): r for r in rows}
    keys = sorted(by)
    return [by[keys[d]] for d, _, least in linked([(i, by[k]["text"]) for i, k in enumerate(keys)]) if d == least]


def plain_decontamination(rows, items):
    strip = str.maketrans(decontamination.UPPER, decontamination.UPPER.lower(), decontamination.PUNCTUATION)
    of = lambda t: t.translate(strip).split()

    def holds(w, item):
        n, span = len(item), decontamination.SPAN
        if n < span:
            return any(w[i : i + n] == item for i in range(len(w) - n + 1))
        hits = {i - j for i in range(len(w) - span + 1) for j in range(n - span + 1) for m in decontamination.MASKS if all(w[i + p] == item[j + p] for p in m)}
        same = [sum(0 <= f + j < len(w) and w[f + j] == item[j] for j in range(n)) for f in hits]
        return any(m >= decontamination.MIN_MATCHES and 2 * m >= n for m in same)

    return [r for r in rows if not any(holds(of(r["text"]), of(x)) for x in items)]


def plain_mix(rows):
    """Counter of (row's key, copy)."""
    sources = sorted({r["source"] for r in rows}, key=lambda x: (x is None, x or ""))
    of = {s: [(len(r["text"].split()), r) for r in rows if r["source"] == s] for s in sources}
    size = {s: sum(n for n, _ in of[s]) for s in sources}
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(sources)}
    total, target = 1.5 * sum(size.values()), {}
    while True:
        left, free = total - sum(target.values()), [s for s in sources if s not in target]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 2.0 * size[s] for s in free if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        target |= over
    out = Counter()
    for s in sources:
        base = int(target[s] // size[s])
        rest = target[s] - base * size[s]
        bits = sum(n * n.bit_length() for n, _ in of[s])
        queue = []
        for n, r in of[s]:
            x = rest / size[s] * n.bit_length() * size[s] / bits
            name = "{" + f"{'NULL' if r['doc_id'] is None else r['doc_id']}, {tid(r['text'])}" + "}"
            u = (int(hashlib.md5(name.encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)
            copies = base
            if x >= 1:
                copies, rest = base + 1, rest - n
            elif x > 0:
                queue.append(((u / (1 - u)) / (x / (1 - x)), name, n, r))
            for c in range(1, copies + 1):
                out[key(r), c] += 1
        words = 0
        for _, _, n, r in sorted(queue, key=lambda q: q[:3]):
            if words + n / 2 > rest:
                break
            words += n
            out[key(r), base + 1] += 1
    return out


def test_run_equals_plain_python(spark, tmp_path):
    """All rows of run(), from the language stage's rows on, on copies, repeats, null and repeated ids, nulls and benchmark items."""
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [line(30), line(14), line(7)]
    shared = [line(9) for _ in range(6)] + ["Fin.", "All rights reserved."]
    texts = ["\n".join(line(rng.randrange(5, 40)) for _ in range(rng.randrange(1, 7))) for _ in range(70)]
    texts += [t + "\n" + rng.choice(shared) for t in texts[:15]] + [t.replace("e", "a", 1) for t in texts[15:20]] + texts[20:25]
    base = line(150).split()
    for _ in range(8):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(150)] = "zz" + str(rng.randrange(9))
        texts.append(" ".join(w))
    for x in items:
        texts.append(line(20) + "\n" + line(8) + " " + x.upper().replace(" ", ", ", 1) + " " + line(12))
    swapped = items[0].split()
    swapped[4] = swapped[17] = "other"
    texts += [line(9) + " " + " ".join(swapped), items[0][: len(items[0]) // 4] + " " + line(30)]
    texts += ["\n".join(rng.choice(shared) for _ in range(4)), None, "", "12 34", "Это предложение на русском языке о погоде и о завтрашнем дне"]
    rows = [{"doc_id": i, "text": t, "lang": "en" if t and t.isascii() else None, "source": rng.choice(["a", "b", "c", None]), "n_chars": len(t or "")} for i, t in enumerate(texts)]
    rows += [rows[3], rows[4] | {"text": line(60)}, rows[5] | {"doc_id": None}, rows[6] | {"doc_id": None, "text": line(33)}]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    known = [r.asDict() for r in langid.stage(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), "").collect()]
    assert len(known) == len(rows) - 4 and all(r["text"].isascii() for r in known)
    lines = plain_line_dedup(known)
    single = plain_near_duplicates(lines)
    clean = plain_decontamination(single, items)
    assert len(known) > len(lines) > len(single) > len(clean) == len(single) - 4
    got = [r.asDict() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert Counter((key(r), r["copy"]) for r in got) == plain_mix(clean)
    want = {key(r): r for r in clean}
    assert all({k: v for k, v in r.items() if k != "copy"} == want[key(r)] for r in got)


def test_language_stage_rejects_what_fits_no_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = ["Tämä on suomenkielinen lause, jossa kerrotaan säästä ja huomisesta päivästä järven rannalla.", "xqzt wvnb kdjs hmpl frtz gxqw", "Это предложение на русском языке о погоде", "12 34", None]
    fine = ["The weather is nice today", "Les.", "ok"]
    added = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate([*odd, *fine])], docs.schema)
    kept = {r["doc_id"] for r in langid.stage(spark, docs.union(added), "").select("doc_id").collect()}
    assert {d for d in kept if d < 0} == {-1 - i for i in range(len(odd), len(odd) + len(fine))}
    with_letters = {r["doc_id"] for r in docs.where("text rlike '[A-Za-z]'").collect()}
    assert with_letters <= kept


def test_held_out_accuracy_of_the_models(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    langs = [(docs[r["doc_id"]], r["lang_pred"]) for r in langid.query(spark, sf).where("held_out").collect() if docs[r["doc_id"]]]
    assert len(langs) > 200 and sum(a == b for a, b in langs) >= 0.97 * len(langs)
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect()}
    scored = [(marks[r["doc_id"]], r["score"]) for r in quality_model.query(spark, sf).where("held_out").collect() if marks.get(r["doc_id"]) is not None]
    good, bad = ([s for m, s in scored if m == k] for k in (1, 0))
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert len(scored) > 50 and all(0 <= s <= 1 and math.isfinite(s) for _, s in scored) and wins >= 0.95 * len(good) * len(bad)
