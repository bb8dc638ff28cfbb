"""Quality rules: a threshold table compiled into one projection of native expressions.

Every rule is a row (name, ratio, low, high); `compile_rules` turns the table into one boolean column and one
array with the names of the failed rules. No user functions, no shuffle: scan -> project.

Defined results: a null text counts as a text without words (it fails the length rules); empty texts the same;
very long texts are processed whole, in O(n log n); repeated rows are judged one by one; an empty table gives
an empty result; extra columns pass through `quality_columns` unless their name is one it adds, which it replaces.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, let, read, words

SYMBOLS = "#*$%&|<>"

#: Frequent function words of the corpus languages (fixed values, public knowledge).
STOP_WORDS = (
    # English
    "the be to of and that have with a in is it for as on was are this at by from or an"
    # German
    " der die das und ist nicht ein eine den dem des sich auf für von zu mit als auch im"
    # French
    " le la les de des du et est un une que qui dans pour par sur pas au avec il ce"
    # Spanish
    " el los las y es un una por con para su se al lo como del en que no"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes when low <= ratio <= high; None leaves a side open."""

    name: str
    ratio: str
    low: float | None = None
    high: float | None = None


#: Thresholds are parameters; these hold ordinary prose of any of the languages.
RULES = (
    Rule("mean_word_length", "chars_per_word", 2.5, 12.0),
    Rule("symbols", "symbols_per_word", None, 0.10),
    Rule("stop_words", "stop_words_per_word", 0.05, None),
    Rule("duplicate_lines", "dup_lines_per_line", None, 0.50),
    Rule("repeated_words", "repeat_words_per_word", None, 0.50),
)


def _repeat_words(w: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more.

    Windows are 64-bit hashes of word hashes. When all are distinct (array_distinct is a hash set) the answer is 0;
    else sorting (hash, place) puts equal windows side by side, and each flagged place covers min(3, gap to the next)
    further words. Hash collisions within one text are below 1e-9 even at a million words.
    """
    n = F.size(w)

    def count(hashes: Column) -> Column:
        def covered(s: Column) -> Column:
            m = F.size(s)
            same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
            flagged = F.filter(
                s,
                lambda x, k: F.coalesce((k > 0) & same(k, k - 1), F.lit(False))
                | F.coalesce((k < m - 1) & same(k, k + 1), F.lit(False)),
            )
            places = F.array_sort(F.transform(flagged, lambda x: x["i"]))
            return let(
                places,
                lambda p: F.aggregate(
                    F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
                    F.lit(0),
                    lambda a, x: a + x,
                ),
            )

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, covered))

    def windows(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))
        )

    hashed = F.transform(w, lambda x: F.xxhash64(x))
    return F.when(n < 3, F.lit(0)).otherwise(let(hashed, lambda h: let(windows(h), count))).cast("long")


def base_measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words (all long)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    w = words(F.col(text_col))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    stop = F.filter(w, lambda x: F.rtrim(F.lower(x), F.lit(".,;:")).isin(STOP_WORDS))
    return df.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.translate(text, SPACE, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": let(w, _repeat_words),
            "n_lines": F.size(lines).cast("long"),
            "n_stop_words": F.size(stop).cast("long"),
        }
    )


def ratio(name: str) -> Column:
    """A named ratio over the base measures; 0 where the denominator is 0."""
    top, under = {
        "chars_per_word": ("word_chars", "n_words"),
        "symbols_per_word": ("n_symbols", "n_words"),
        "stop_words_per_word": ("n_stop_words", "n_words"),
        "dup_lines_per_line": ("n_dup_lines", "n_lines"),
        "repeat_words_per_word": ("n_repeat_words", "n_words"),
    }[name]
    return F.col(top) / F.greatest(F.col(under), F.lit(1)).cast("double")


def compile_rules(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The rule table as (passes boolean, failed array<string>)."""
    failed = []
    for r in rules:
        x = ratio(r.ratio)
        ok = F.lit(True)
        if r.low is not None:
            ok = ok & (x >= F.lit(float(r.low)))
        if r.high is not None:
            ok = ok & (x <= F.lit(float(r.high)))
        failed.append(F.when(~ok, F.lit(r.name)))
    names = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
    return F.size(names) == 0, names


def quality_columns(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with the base measures, base_failed, failed_rules and kept."""
    passes, names = compile_rules(rules)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return base_measures(df, text_col).withColumns({"base_failed": base, "failed_rules": names, "kept": ~base & passes})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_columns(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _quoted(xs) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, struct_pack(a := ws[i], b := ws[i+1], c := ws[i+2]) AS g
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
hit AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n >= 2),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i+1, i+2]) AS p FROM hit) GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
             len(list_filter(ws, lambda x: rtrim(lower(x), '.,;:') IN ({_quoted(dict.fromkeys(STOP_WORDS))}))) AS n_stop
      FROM w LEFT JOIN cov ON w.rid = cov.rid)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       (n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words
        AND word_chars / n_words::DOUBLE BETWEEN 2.5 AND 12.0 AND n_symbols / n_words::DOUBLE <= 0.10
        AND n_stop / n_words::DOUBLE >= 0.05 AND n_dup_lines / greatest(n_lines, 1)::DOUBLE <= 0.50
        AND n_repeat_words / n_words::DOUBLE <= 0.50) AS kept
FROM m
"""
