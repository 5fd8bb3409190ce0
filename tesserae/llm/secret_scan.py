"""Secret scans: three exact patterns, and guess costs of values in credential contexts.

The guess cost of a value is the least sum, over all ways to cut it into segments, of the base-10 logarithms of
the guesses each segment needs: a dictionary word, a date, a repeat, a keyboard walk or brute force over the
character classes used. It is found by dynamic programming over the positions of the value. The dictionary is
ranked: passwords in common use come first, then the words among the pieces of a public vocabulary file, which lists
them from the most to the less frequent.
"""

from __future__ import annotations

import hashlib
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import per_text, tokenizer_path

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Contexts in which a value is weighed: a credential's name, by itself or as the last part of a longer one, then :, =
#: or "is", then a value without spaces.
CONTEXT = re.compile(r"""(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|auth(?:orization)?|bearer|credentials?|(?:api|access|private|secret|auth)[_-]?key)["']?(?:\x20*(?::=|=>|[:=])\x20*|\x20+is\x20+)(?:bearer\x20+|basic\x20+)?["']?([^\s"'<>]{6,})""", re.A | re.I)
#: The names and verbs by which a text can hold a match at all.
_HINT = re.compile(r"pass|pwd|secret|token|auth|bearer|credential|(?:api|access|private)[_-]?key", re.A | re.I)
KINDS = ("assign", "access", "hex", "guess")
#: Passwords in common use and words by which they are named, from the most to the less common. Fixed values.
WORDS = ["password", "qwerty", "iloveyou", "admin", "letmein", "welcome", "monkey", "dragon", "sunshine", "princess", "football", "baseball", "shadow", "master", "superman", "batman", "trustno", "changeme", "secret", "default", "root", "login", "user", "test", "pass", "token", "hello", "summer", "winter", "spring", "autumn", "flower", "hunter", "killer", "jordan", "michael", "jennifer", "charlie", "access", "starwars", "whatever", "freedom", "example", "sample", "dummy", "guest", "server", "correct", "horse", "battery", "staple"]
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_AT = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
_LEET = str.maketrans("@430157$!", "aaeoistsi")
_DATE = re.compile(r"(?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")


_ranked: dict[str, tuple[dict[str, int], int]] = {}


def ranks(path: str | None = None) -> tuple[dict[str, int], int]:
    """Rank of each dictionary word, from 1, and the length of the longest. path: a sentencepiece model, whose pieces of
    three and more letters a to z follow WORDS in their order; without one, WORDS are all."""
    key = path or ""
    if key not in _ranked:
        words = dict.fromkeys(WORDS)
        if path:
            import sentencepiece

            own = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = (own.id_to_piece(i).lstrip("\u2581").lower() for i in range(own.get_piece_size()))
            words |= dict.fromkeys(p for p in pieces if len(p) > 2 and p.isascii() and p.isalpha())
        _ranked[key] = {w: i for i, w in enumerate(words, 1)}, max(map(len, words))
    return _ranked[key]


def _alphabet(text: str) -> int:
    return sum(n for n, has in ((26, any("a" <= c <= "z" for c in text)), (26, any("A" <= c <= "Z" for c in text)), (10, any("0" <= c <= "9" for c in text)), (33, any(not c.isalnum() for c in text)), (100, any(c.isalnum() and not c.isascii() for c in text))) if has)


def _move(low: str, b: int) -> tuple[int, int] | None:
    """The step on the keyboard to the character at b from the one before it, if they are neighbours."""
    if low[b] not in _AT or low[b - 1] not in _AT:
        return None
    (r, i), (s, j) = _AT[low[b - 1]], _AT[low[b]]
    return (s - r, j - i) if abs(s - r) <= 1 and abs(j - i) <= 1 else None


def _variants(word: str, plain: str) -> int:
    """Binary choices that spelling a dictionary word so takes: one for a first or all capitals, else one for each
    letter, and one for each letter replaced by a look-alike."""
    low = word.lower()
    capitals = 0 if word == low else 1 if word[1:] == low[1:] or word == word.upper() else sum(map(str.isalpha, word))
    return capitals + sum(x != y for x, y in zip(low, plain, strict=True))


def segments(value: str, limit: float = math.inf, dictionary: tuple[dict[str, int], int] | None = None) -> tuple[float, list[tuple[str, int, int]]]:
    """The least guess cost of a value, as a base-10 logarithm, and the segments (kind, start, end) that give it. A cost
    of limit or more counts as infinite, without segments: as no segment is free, a long value is then soon decided."""
    rank_of, longest = dictionary or ranks()
    n, low = len(value), value.lower()
    if len(low) != n:  # a few letters grow in lower case
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain, one = low.translate(_LEET), math.log10(max(_alphabet(value), 10))
    cost, back = [0.0] + [math.inf] * n, [("", 0)] * (n + 1)

    far, ends = 0, [-1] * 5  # the furthest place with a cost; by period, where the last repeat ended
    walks, turns, before = [], 0, None  # open walks (start, turns before it)

    def offer(kind: str, a: int, b: int, price: float) -> None:
        nonlocal far
        if cost[a] + price < min(cost[b], limit):
            cost[b], back[b], far = cost[a] + price, (kind, a), max(far, b)

    cut = math.log10(2)  # each further segment doubles the guesses
    for a in range(n + 1):
        if a > far + 2 and not walks:
            break
        if a > 1:
            move = _move(low, a - 1)
            turns, before = turns + (move != before), move
            walks = [*walks, (a - 2, turns - 1)] if move and cost[a - 2] < limit else walks if move else []
            least, still = limit, []
            for start, at in walks:
                price = math.log10(47 * (a - start)) + (turns - at) * math.log10(6) + cut
                if a - start >= 4:
                    offer("walk", start, a, price)
                if cost[start] + price < least:  # else an earlier start is and stays as cheap
                    least = cost[start] + price
                    still.append((start, at))
            walks = still
        if a == n or cost[a] >= limit:
            continue
        offer("brute", a, a + 1, one + (cut if a and back[a][0] != "brute" else 0))
        for b in range(a + 3, min(n, a + longest) + 1):
            rank = rank_of.get(plain[a:b])
            if rank:
                offer("word", a, b, math.log10(rank + 1) + cut * (_variants(value[a:b], plain[a:b]) + 1))
        for m in (_DATE.match(value, a, a + 4), _DATE.match(value, a)):
            if m:
                offer("date", a, m.end(), math.log10(366 * 130 if m.end() - a > 4 else 130) + cut)
        for period in (1, 2, 3, 4):
            b = max(a + period, ends[period])
            while a + period > ends[period] and b < n and low[b] == low[b - period]:
                b += 1
            ends[period] = b
            if b - a >= max(3, 2 * period):
                offer("repeat", a, b, one * period + math.log10((b - a) / period) + cut)
    if cost[n] >= limit:
        return math.inf, []
    out, b = [], n
    while b:
        kind, a = back[b]
        if kind == "brute" and out and out[-1][0] == "brute":
            out[-1] = ("brute", a, out[-1][2])
        else:
            out.append((kind, a, b))
        b = a
    return cost[n], out[::-1]


def spans(text: str, min_guesses: float, dictionary: tuple[dict[str, int], int] | None = None) -> list[tuple[int, int, str]]:
    """All spans of a text as (start, end, kind), by start, then kind. A base span covers its whole match. A value in a
    credential context that needs at least 10**min_guesses guesses adds a span of kind guess, unless a base span
    covers it; it may overlap base spans. Values may be of any length; those of fewer than six characters are not
    weighed."""
    out = [(m.start(), m.end(), k) for k, p in ((1, ACCESS), (2, HEX)) for m in p.finditer(text)]
    if _HINT.search(text):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        base = list(out)
        for m in CONTEXT.finditer(text):
            value = m[1].rstrip(".,;:!?)]}")
            a, b = m.start(1), m.start(1) + len(value)
            if len(value) < 6 or any(x <= a and b <= y for x, y, _ in base):
                continue
            if segments(value, min_guesses, dictionary)[0] >= min_guesses:
                out.append((a, b, 3))
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2], x[1]))]


FOUND = "n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string, redacted string"


def found(min_guesses: float = 10.0, redact: str | None = None, vocabulary: str | None = None) -> Column:
    """What is found in column text: counts by kind, the digest of the base spans and all spans. With redact, field
    redacted has the text with each span replaced by it, spans that overlap as one; else it is null. A null text counts
    as empty; redacted stays null. vocabulary: the file that ranks the dictionary (see ranks), a public one by default."""
    path = vocabulary or tokenizer_path("piece_bpe_32k.model")

    def one(text: str | None, dictionary: tuple[dict[str, int], int]) -> tuple:
        got = spans(text, min_guesses, dictionary) if text else []
        counts = [sum(x[2] == k for x in got) for k in KINDS]
        joined = [f"{k}:{a}:{b}" for a, b, k in got]
        base = ",".join(s for s, x in zip(joined, got, strict=True) if x[2] != "guess")
        return (*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(joined), _redact(text, got, redact) if text is not None and redact is not None else None)

    def make():
        columns, dictionary = [f.split()[0] for f in FOUND.split(", ")], ranks(path)
        return lambda texts: pd.DataFrame([one(t, dictionary) for t in texts], columns=columns)

    return per_text(FOUND, make)


def scan(docs: DataFrame, min_guesses: float = 10.0, redact: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text), with the fields of found(). A null or empty text has no spans; very long
    texts and values are scanned whole. Repeated rows give repeated rows, an empty table an empty one; other columns
    are left out. There is no shuffle."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), found(min_guesses, redact, vocabulary).alias("r")).select("doc_id", "r.*")


def _redact(text: str, found: list[tuple[int, int, str]], by: str) -> str:
    out, at = [], 0
    for a, b, _ in found:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], by]
        at = b
    return "".join([*out, text[at:]])
