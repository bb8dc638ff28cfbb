"""Scanners: each turns a text into findings. All are stateless and run in batch and in streams.

A built-in scanner is a Python function of one text (`rows`), with compiled patterns behind cheap gates: literals that a
text must hold, looked for with plain substring search. A policy runs all of them in one Arrow pass, so a text travels
once, is normalized and lower-cased once, and most rules cost a substring search. Users' scanners may override `rows`,
or `scan` to be a Spark column of their own.
"""

from __future__ import annotations

import functools
import operator
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.normalize import normalize_with_map
from ..functions.scalars import card_valid_text, estimate_tokens_text, jwt_valid_text, looks_random_text, shannon_entropy, ssn_valid_text
from ..functions.spans import FINDINGS, findings_array, none

#: (score, start, end, matched text, message)
Row = tuple[float, int, int, str, str]
_FOLDED = str.maketrans("İıſK", "iisk")


def fold(text: str) -> str:
    """Lower case, with the letters that case-insensitive matching equates with ASCII ones."""
    return text.lower() if text.isascii() else text.translate(_FOLDED).lower()


class Doc:
    """A text with what scanners share about it, worked out when first asked for."""

    def __init__(self, text: str):
        self.text = text
        self._low: str | None = None
        self._known: dict[object, list[Row]] = {}

    @property
    def low(self) -> str:
        if self._low is None:
            self._low = fold(self.text)
        return self._low

    def once(self, key: object, rows: Callable[[Doc], list[Row]]) -> list[Row]:
        if key not in self._known:
            self._known[key] = rows(self)
        return self._known[key]


@dataclass(frozen=True)
class Text:
    text: Column


def of(text: Column) -> Text:
    return Text(text)


class Scanner:
    """Anything with a name and rows(Doc), or scan(Text) -> findings column; normalize_input=False asks for the raw text."""

    name = ""
    normalize_input = True

    def rows(self, doc: Doc) -> list[Row]:
        raise NotImplementedError

    def scan(self, t: Text) -> Column:
        """The scanner called directly, on the text as it is."""

        @F.arrow_udf(FINDINGS)
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for b in batches:
                yield findings_array([[] if x is None else [(self.name, *r) for r in self.rows(Doc(x))] for x in b.to_pylist()])

        return F.coalesce(run.asNondeterministic()(t.text), none())  # so that a filter on the findings does not scan again


@functools.lru_cache(4096)
def _compiled(pattern: str, ignore_case: bool = False) -> re.Pattern:
    return re.compile(pattern, re.IGNORECASE if ignore_case else 0)


def _found(rx: re.Pattern, text: str, score: float, message: str, keep: Callable[[str], bool] | None = None) -> list[Row]:
    return [(score, *m.span(), m.group(), message) for m in rx.finditer(text) if keep is None or keep(m.group())]


def _by_rule(rule: R.Rule, doc: Doc, keep: Callable[[str], bool] | None = None) -> list[Row]:
    if rule.needs and not any(x in doc.low for x in rule.needs):
        return []
    if rule.probe and not _compiled(rule.probe).search(doc.low):
        return []
    return _found(_compiled(rule.pattern, rule.ignore_case), doc.text, rule.score, rule.message, keep)


def _user_rows(patterns: list[tuple[str, float, str]], doc: Doc, ignore_case: bool = False) -> list[Row]:
    return [r for p, score, message in patterns for r in _found(_compiled(p, ignore_case), doc.text, score, message)]


class _Rules(Scanner):
    default: tuple[R.Rule, ...] = ()

    def __init__(self, patterns=None):
        """patterns: rows (pattern, score, message) instead of the built-in rules; an empty list matches nothing."""
        self.patterns = None if patterns is None else [tuple(p) for p in patterns]
        for p, _, _ in self.patterns or []:
            re.compile(p)

    def rows(self, doc: Doc) -> list[Row]:
        if self.patterns is not None:
            return _user_rows(self.patterns, doc, True)
        return [r for rule in self.default for r in _by_rule(rule, doc)]


class PromptInjection(_Rules):
    name, default = "prompt_injection", R.PROMPT_INJECTION


class PromptLeak(_Rules):
    name, default = "prompt_leak", R.PROMPT_LEAK


class CodeExecution(Scanner):
    name = "code_execution"

    def rows(self, doc: Doc) -> list[Row]:
        return [r for rule in R.CODE_EXECUTION for r in _by_rule(rule, doc)]


class BanTopics(Scanner):
    """A finding for every occurrence of every phrase of topics: {topic: [phrase]}."""

    name = "ban_topics"

    def __init__(self, topics: dict[str, list[str]] | None = None):
        topics = R.DEFAULT_TOPICS if topics is None else topics
        self.phrases = [(p.lower() if p.isascii() else "", rf"\b{re.escape(p)}\b", f"Banned topic '{k}': matched {p!r}") for k, ps in topics.items() for p in ps]

    def rows(self, doc: Doc) -> list[Row]:
        return [r for need, p, message in self.phrases if need in doc.low for r in _found(_compiled(p, True), doc.text, 0.7, message)]


class Toxicity(Scanner):
    """Listed words; the score of each grows with the number of hits in the text."""

    name = "toxicity"

    def __init__(self, words=None):
        words = sorted(R.PROFANITY if words is None else words, key=lambda w: (-len(w), w))
        self.pattern = r"\b(?:" + "|".join(map(re.escape, words)) + r")\b" if words else None
        roots = [w for w in words if not any(v != w and v in w for v in words)]
        self.roots = [w.lower() for w in roots] if all(w.isascii() for w in words) else [""]

    def rows(self, doc: Doc) -> list[Row]:
        if self.pattern is None or not any(w in doc.low for w in self.roots):
            return []
        hits = list(_compiled(self.pattern, True).finditer(doc.text))
        score = round(min(0.95, 0.4 + 0.15 * len(hits)), 2)
        return [(score, *m.span(), m.group(), f"Profanity ({len(hits)} hit(s) in text)") for m in hits]


class Regex(Scanner):
    """Patterns that must not occur, and patterns that must."""

    name = "regex"

    def __init__(self, *, forbidden=None, required=None):
        self.forbidden, self.required = list(forbidden or []), list(required or [])
        if not self.forbidden and not self.required:
            raise ValueError("regex scanner needs at least one forbidden or required pattern")
        for p in [*self.forbidden, *self.required]:
            re.compile(p)

    def rows(self, doc: Doc) -> list[Row]:
        out = _user_rows([(p, 0.8, f"Forbidden pattern matched: {p!r}") for p in self.forbidden], doc)
        missing = [p for p in self.required if not _compiled(p).search(doc.text)]
        return out + [(0.8, 0, len(doc.text), doc.text[:60], f"Required pattern not found: {p!r}") for p in missing]


class Pii(Scanner):
    """Email, phone, US Social Security and payment card numbers, in this order."""

    name = "pii"

    def rows(self, doc: Doc) -> list[Row]:
        return doc.once("pii", self._rows)

    @staticmethod
    def _rows(doc: Doc) -> list[Row]:
        return _by_rule(R.EMAIL, doc) + _by_rule(R.PHONE, doc) + _by_rule(R.SSN, doc, ssn_valid_text) + _by_rule(R.CARD, doc, card_valid_text)


class UrlAllowlist(Scanner):
    """URLs whose host is neither an allowed domain nor below one; without domains nothing is found. A URL whose host has
    unbalanced brackets is skipped."""

    name = "url_allowlist"

    def __init__(self, allowed_domains=None):
        self.allowed = {d.lower().lstrip(".") for d in allowed_domains or []}

    def rows(self, doc: Doc) -> list[Row]:
        out = []
        for score, s, e, url, _ in _by_rule(R.URL, doc) if self.allowed else []:
            netloc = re.split("[/?#]", url.partition("://")[2], maxsplit=1)[0]
            host = netloc.rpartition("@")[2].partition(":")[0].lower()
            labels = host.split(".")
            if netloc and ("[" in netloc) == ("]" in netloc) and not any(".".join(labels[k:]) in self.allowed for k in range(len(labels))):
                out.append((score, s, e, url, f"URL points outside the allowlist ({'.'.join(labels[-2:])})"))
        return out


class TokenLimit(Scanner):
    name = "token_limit"

    def __init__(self, max_tokens: int = 4000):
        if max_tokens <= 0:
            raise ValueError("max_tokens must be positive")
        self.max_tokens = max_tokens

    def rows(self, doc: Doc) -> list[Row]:
        n = estimate_tokens_text(doc.text)
        return [(0.9, 0, len(doc.text), doc.text[:60], f"Estimated {n} tokens exceeds limit of {self.max_tokens}")] if n > self.max_tokens else []


class Secrets(Scanner):
    """Credentials by their public shapes, labelled assignments, and (entropy_scan) unlabelled random-looking tokens."""

    name = "secrets"

    def __init__(self, extra_patterns=None, entropy_scan: bool = True):
        """extra_patterns: rows (label, pattern, score)."""
        self.extra, self.entropy_scan = [(p, score, label) for label, p, score in extra_patterns or []], entropy_scan
        for p, _, _ in self.extra:
            re.compile(p)

    def rows(self, doc: Doc) -> list[Row]:
        return doc.once(("secrets", tuple(self.extra), self.entropy_scan), self._rows)

    def _rows(self, doc: Doc) -> list[Row]:
        out = [r for rule in R.SECRETS for r in _by_rule(rule, doc)]
        out += _by_rule(R.JWT, doc, jwt_valid_text) + _by_rule(R.ASSIGNMENT, doc) + _user_rows(self.extra, doc)
        return out + (_by_rule(R.RANDOM_TOKEN, doc, looks_random_text) if self.entropy_scan else [])


class Exfiltration(Scanner):
    """Disclosure in output: its own rules, and the findings of secrets and pii under its name."""

    name = "exfiltration"

    def __init__(self, extra_patterns=None, entropy_scan: bool = True):
        self.secrets, self.pii = Secrets(extra_patterns, entropy_scan), Pii()

    def rows(self, doc: Doc) -> list[Row]:
        own = [r for rule in R.EXFILTRATION for r in _by_rule(rule, doc)]
        return own + _user_rows(self.secrets.extra, doc) + self.secrets.rows(doc) + self.pii.rows(doc)


_VOWELS = str.maketrans("", "", "aeiouAEIOU")
_GIBBERISH_WORD = re.compile(r"[A-Za-z]{4,}")


class Gibberish(Scanner):
    """Consonant-heavy words or abnormal character entropy."""

    name = "gibberish"

    def __init__(self, *, min_words: int = 4, monster_token_len: int = 16, monster_consonant_ratio: float = 0.80, mean_consonant_ratio: float = 0.80, white_space: str | None = None):
        """white_space: the characters left out of the entropy, instead of all that Python counts as white space."""
        self.args = (min_words, monster_token_len, monster_consonant_ratio, mean_consonant_ratio)
        self.white_space = white_space

    def rows(self, doc: Doc) -> list[Row]:
        min_words, size, monster, mean_limit = self.args
        words = [(m, w := m.group(), len(w.translate(_VOWELS)) / len(w)) for m in _GIBBERISH_WORD.finditer(doc.text)]
        found = [(0.85, *m.span(), w, "Gibberish-like token (very long, consonant-heavy)") for m, w, r in words if len(w) >= size and r >= monster]
        if found or len(words) < min_words:
            return found
        # Added up one by one, as SQL does: sum() corrects its rounding since Python 3.12, which decides means at the limit otherwise.
        mean = functools.reduce(operator.add, (r for _, _, r in words), 0.0) / max(len(words), 1)
        if words and mean >= mean_limit:
            score = round(min(0.9, 0.5 + (mean - 0.6) * 2), 2)
            return [(score, *m.span(), w, "Gibberish-like token (text-wide consonant anomaly)") for m, w, r in words if r >= 0.8]
        if not 2.8 <= shannon_entropy(self._dense(doc.text)) <= 5.2:
            return [(0.45, 0, len(doc.text), doc.text[:60], "Abnormal character entropy for natural text")]
        return []

    def _dense(self, text: str) -> str:
        if self.white_space is None:
            return "".join(text.split())
        return functools.reduce(lambda t, c: t.replace(c, ""), self.white_space, text)


_ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
_BIDI = "\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069\u200e\u200f"
_ESCAPE = re.compile(r"\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}")
_OTHER_SCRIPT = re.compile(r"[Ͱ-ϿЀ-џ]")
_OTHER_RUN = re.compile(r"[Ͱ-ϿЀ-џ]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_LATIN = re.compile(r"[A-Za-z]")
_ODD = re.compile(r"[^\x20-\x7e\t\n\r]")


class Obfuscation(Scanner):
    """Invisible, direction-changing, control and fullwidth characters, escapes, mixed scripts and encoded blobs."""

    name, normalize_input = "obfuscation", False

    def __init__(self, blob_min_length: int = 40, min_entropy: float = 4.5, fullwidth_min_length: int = 4):
        self.blob_min, self.entropy, self.full_min = blob_min_length, min_entropy, fullwidth_min_length

    def rows(self, doc: Doc) -> list[Row]:
        return [(score, s, s + len(m), m, message) for score, s, m, message in self._placed(doc.text)]

    def _placed(self, text: str) -> list[tuple]:
        out: list[tuple] = []
        blob = _compiled(rf"[A-Za-z0-9+/=]{{{self.blob_min},}}")
        odd = [(m.start(), m.group()) for m in _ODD.finditer(text)] if not text.isascii() or _ODD.search(text) else []
        out += [(0.9, i, c, "Zero-width/format character (possible hidden text)") for i, c in odd if c in _ZERO_WIDTH]
        out += [(0.9, i, c, "Unicode direction override") for i, c in odd if c in _BIDI]
        out += [(0.7, i, c, "Stray control character") for i, c in odd if c not in _ZERO_WIDTH and c not in _BIDI and unicodedata.category(c) in ("Cc", "Cf")]
        escapes = [m.span() for m in _ESCAPE.finditer(text)] if "\\" in text else []
        out += [(0.5, s, text[s:e], "Literal unicode escape (possible obfuscated payload)") for s, e in escapes]
        out += [(0.7, m.start(), m.group(), "Fullwidth character run (possible lookalike evasion)") for m in re.finditer(rf"[！-～]{{{self.full_min},}}", text)] if odd else []
        if odd and _OTHER_SCRIPT.search(text):
            out += self.mixed(text)
        blobs = self.blobs(blob, text)
        out += [(0.55, s, text[s:e], "Long high-entropy blob (possible encoded payload)") for s, e in blobs]
        if odd and not text.isascii():
            out += self.folded(blob, text, escapes, blobs)
        return out

    def blobs(self, blob: re.Pattern, text: str) -> list[tuple[int, int]]:
        found = []
        for m in blob.finditer(text):
            body = m.group().rstrip("=")
            if len(body) >= self.blob_min and shannon_entropy(body) >= self.entropy:
                found.append(m.span())
        return found

    @staticmethod
    def mixed(text: str) -> list[tuple]:
        out, runs = [], []
        if len(_OTHER_SCRIPT.findall(text)) >= 2 and len(_LATIN.findall(text)) >= 10:
            runs = [m.span() for m in _OTHER_RUN.finditer(text)]
            out = [(0.7, s, text[s:e], "Mixed-script run inside Latin text (possible homoglyph attack)") for s, e in runs]
        for m in _LETTERS.finditer(text):
            w = m.group()
            if len(w) < 4 or len(_OTHER_SCRIPT.findall(w)) < 2 or not _LATIN.search(w):
                continue
            if not any(m.start() < e and s < m.end() for s, e in runs):
                out.append((0.7, m.start(), w, "Mixed-script word (possible homoglyph attack)"))
        return out

    def folded(self, blob: re.Pattern, text: str, escapes: list, blobs: list) -> list[tuple]:
        """Escapes and blobs that show only after normalization, at their original places."""
        norm, places = normalize_with_map(text)
        if norm == text:
            return []
        out = []
        kinds = (
            (0.5, [m.span() for m in _ESCAPE.finditer(norm)], escapes, "Literal unicode escape (possible obfuscated payload)"),
            (0.55, self.blobs(blob, norm), blobs, "Long high-entropy blob (possible encoded payload)"),
        )
        for score, spans, seen, message in kinds:
            for s, e in spans:
                a, b = places[s], places[e - 1] + 1
                if not any(a < y and x < b for x, y in seen):
                    out.append((score, a, text[a:b], message))
        return out


REGISTRY = {
    c.name: c
    for c in (PromptInjection, Secrets, Pii, Toxicity, Gibberish, BanTopics, CodeExecution, TokenLimit, Regex, UrlAllowlist, Obfuscation, PromptLeak, Exfiltration)
}


def default_scanners() -> list[Scanner]:
    return [PromptInjection(), Secrets(), Pii(), Toxicity(), Gibberish(), BanTopics(), CodeExecution(), TokenLimit()]


def full_scanners() -> list[Scanner]:
    return [*default_scanners(), Obfuscation(), PromptLeak(), Exfiltration()]
