"""Secret scans: three fixed patterns, and password guess costs of values in credential contexts.

A value that follows a credential word is segmented into words, dates, repeats, keyboard walks,
sequences and brute-force characters at minimum cost (log10 of the guesses an attacker needs).
Values of at least GUESSES become spans of kind `guess`.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fingerloom.llm.common import as_texts, table, text_slices

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "guess")

#: A credential word, a separator and a value without white space, quotes or brackets.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth(?:orization)?|bearer|credentials?|private[_-]?key)["']?\s{0,3}(?:[:=]|=>|is:)\s{0,3}["']?([^\s"'<>(){}\[\],;]{6,})""",
    re.A | re.I,
)
_MAYBE = ("pass", "pwd", "secret", "token", "api", "access", "auth", "bearer", "credential", "private")
#: log10 of the guesses from which a value counts as a secret.
GUESSES = 10.0
#: Longer values are judged by windows of so many characters that overlap by half, so that time grows with the length only.
WINDOW = 256
#: Characters that end a sentence rather than a value, and a value's least length without them.
TRAILING = ".!?:"
LEAST_VALUE = 6
_JOINT = re.compile("['\u2019-]")

# Words that attackers try first, commonest first.
WORDS = (
    "password 123456 qwerty admin letmein welcome monkey dragon master login hello secret shadow test user root guest "
    "changeme default example demo sample token key api access auth true false null none undefined string value name "
    "football baseball soccer hockey superman batman princess sunshine flower freedom computer internet server database "
    "system network security private public pass word"
).split()
#: Where further words are read from, in order of their rank: a public tokenizer's vocabulary.
VOCABULARY = "word_bpe_49k.json"
#: Characters of a word of the list at most, and at least in what the vocabulary adds.
LONGEST_WORD, SHORTEST_WORD = 20, 3
# Rows of a keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("4@301!5$7", "aaeoiisst")
BRUTE = {"lower": math.log10(26), "upper": math.log10(26), "digit": 1.0, "other": math.log10(33)}
SEGMENT = math.log10(2)  # each further segment doubles the guesses

_beside = {}
for _row in ROWS:
    for _a, _b in zip(_row, _row[1:]):
        _beside.setdefault(_a, set()).add(_b)
        _beside.setdefault(_b, set()).add(_a)
for _upper, _lower in zip(ROWS, ROWS[1:]):
    for _i, _a in enumerate(_lower):
        for _j in (_i, _i + 1):
            if _j < len(_upper):
                _beside.setdefault(_a, set()).add(_upper[_j])
                _beside.setdefault(_upper[_j], set()).add(_a)

_DATE = re.compile(r"(?:19|20)\d\d[-./]?(?:0[1-9]|1[0-2])[-./]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-./]?(?:0[1-9]|1[0-2])[-./]?(?:19|20)\d\d|(?:19|20)\d\d")


@lru_cache(maxsize=4)
def ranked_words(path: str | None) -> dict[str, int]:
    """Rank of each word: WORDS, then the whole words of a tokenizer file in the order of their ids, which follows their frequency."""
    ranks = {w: i + 1 for i, w in enumerate(WORDS)}
    if path:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        begin, end = ("", model["end_of_word_suffix"]) if model.get("end_of_word_suffix") else ("\u0120", "")
        for token in sorted(model["vocab"], key=model["vocab"].get):
            word = token.removeprefix(begin).removesuffix(end).lower()
            whole = token.startswith(begin) and token.endswith(end)
            if whole and word.isascii() and word.isalpha() and SHORTEST_WORD <= len(word) <= LONGEST_WORD:
                ranks.setdefault(word, len(ranks) + 1)
    return ranks


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def brute_cost(c: str) -> float:
    return BRUTE["lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "other"]


def word_cost(part: str, ranks: dict[str, int]) -> float | None:
    """log10 guesses of a word of the list, its case and its digits for letters; None if it is none."""
    low = part.lower()
    rank, twist = ranks.get(low), 0.0
    if rank is None:
        rank, twist = ranks.get(low.translate(LEET)), math.log10(4)
    if rank is None:
        return None
    case = 0.0 if part == low else math.log10(2) if part.isupper() or part[1:].islower() else math.log10(2 ** min(len(part), 8))
    return math.log10(rank) + 0.3 + twist + case


def segments(value: str, ranks: dict[str, int]) -> list[list[tuple[int, float]]]:
    """For each end position, (start, cost) of the segments that end there and are cheaper than single characters may be."""
    n = len(value)
    low = value.lower()
    ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for i in range(n):
        for j in range(i + 2, min(n, i + LONGEST_WORD) + 1):
            cost = word_cost(value[i:j], ranks)
            if cost is not None:
                ending[j].append((i, cost))
        if i + 3 <= n:
            step = ord(low[i + 1]) - ord(low[i])
            j = i + 1
            while step in (-1, 0, 1) and j < n and ord(low[j]) - ord(low[j - 1]) == step:
                j += 1
                if j - i >= 3:  # repeats of one character (0) and sequences (1, -1)
                    ending[j].append((i, brute_cost(value[i]) + math.log10(j - i) + (0.3 if step else 0)))
            j = i + 1
            while j < n and low[j] in _beside.get(low[j - 1], ()):
                j += 1
                if j - i >= 4:
                    ending[j].append((i, math.log10(47) + (j - i) * math.log10(2.5)))
        base = brute_cost(value[i])
        for size in range(2, (n - i) // 2 + 1):  # repeats of a part
            base += brute_cost(value[i + size - 1])
            j = i + size
            while value[j : j + size] == value[i : i + size]:
                j += size
                ending[j].append((i, base + math.log10((j - i) // size)))
    for m in re.finditer(r"(?=(%s))" % _DATE.pattern, value):
        ending[m.end(1)].append((m.start(1), math.log10(365 * 130) if len(m[1]) > 4 else math.log10(130)))
    return ending


def guess_cost(value: str, ranks: dict[str, int] | None = None) -> float:
    """log10 guesses of the cheapest segmentation, by dynamic programming over end positions."""
    n = len(value)
    ending = segments(value, ranked_words(None) if ranks is None else ranks)
    best = [0.0] + [math.inf] * n
    for j in range(1, n + 1):
        best[j] = best[j - 1] + brute_cost(value[j - 1])
        for i, cost in ending[j]:
            total = best[i] + cost + (SEGMENT if i else 0)
            if total < best[j]:
                best[j] = total
    return best[n]


def is_prose(value: str) -> bool:
    """Words of a text that goes on after a colon: letters only, small but for the first one of each, perhaps joined by hyphens or apostrophes."""
    return all(w.isalpha() and (w.islower() or w[1:].islower() or w.isupper()) for w in _JOINT.split(value))


def is_secret(value: str, ranks: dict[str, int] | None = None) -> bool:
    """Whether a credential-context value is costly to guess; prose with its punctuation isn't asked about.

    All other values are judged by their cost alone, in windows of WINDOW characters.
    """
    value = value.rstrip(TRAILING)
    if len(value) < LEAST_VALUE or is_prose(value):
        return False
    return any(guess_cost(value[i : i + WINDOW], ranks) >= GUESSES for i in range(0, max(1, len(value) - WINDOW // 2), WINDOW // 2))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns' matches, in code points, by start and kind."""
    spans = []
    low = text.lower()
    if any(w in low for w in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def guess_spans(text: str, ranks: dict[str, int] | None = None) -> list[tuple[int, int, int]]:
    low = text.lower()
    if not any(w in low for w in _MAYBE):
        return []
    return [(m.start(1), 3, m.start(1) + len(m[1].rstrip(TRAILING))) for m in CONTEXT.finditer(text) if is_secret(m[1], ranks)]


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by [SECRET]."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, *carry: str, words: str | None = None) -> DataFrame:
    """Secrets in every row's whole text (null: empty), with the columns named in `carry`.

    `words` is the path of a tokenizer file whose vocabulary extends the list of words.

    Adds n_assign, n_access, n_hex, base_sha256, spans (all, base and guessed, by start and then
    kind) and redacted (the text with each secret replaced; null stays null). Spans are in code
    points, the end exclusive. Texts without secrets have empty spans. One pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranked_words(words)
        for batch in batches:
            for part in text_slices(batch, 0):
                texts = as_texts(part.column(0))
                base = [base_spans(t) for t in texts]
                every = [sorted(b + guess_spans(t, ranks)) for b, t in zip(base, texts)]
                clean = [redact(t, s) if s else t for t, s in zip(texts, every)]
                made = [pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in range(3)]
                made.append(pa.array([hashlib.sha256(spelled(b).encode()).hexdigest() for b in base], pa.string()))
                made.append(pa.array([spelled(s) for s in every], pa.string()))
                made.append(pa.array([None if null else c for null, c in zip(part.column(0).is_null().to_pylist(), clean)], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *made], names=[*carry, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select("text", *carry).mapInArrow(run, f"{kinds}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", words=vocabulary_path()).drop("redacted")
