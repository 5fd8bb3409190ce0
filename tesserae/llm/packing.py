"""Packing of token pieces into sequences by minimum bin slack.

What is packed is only lengths, and there are at most `capacity` of them. So the bins are planned from the
table of lengths and their counts, which is bounded whatever the input: per bin, a bitset subset-sum dynamic
programme over the lengths still available finds the fullest feasible combination; it is removed as often as
the counts allow, as the next bins would choose it again. Pieces then take the planned places by their rank
among those of their length.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import PLAIN, Scratch, per_text, tokenizer_path
from tesserae.llm.trie_bpe import byte_symbols

PIECES = "piece: int, start: long, length: long, ids_crc32: long"
#: The byte-level pre-tokenizer's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Ranks are counted within shares of each length, which hold about so many pieces each.
SHARE = 250_000


def fullest(counts: dict[int, int], capacity: int) -> list[int]:
    """The lengths of the fullest combination of at most capacity; of equally full ones that with the longest pieces."""
    lengths = sorted(x for x, n in counts.items() if n and x <= capacity)
    everything = (1 << capacity + 1) - 1
    reach, below = 1, []  # bit s: sum s can be had from the lengths so far
    for x in lengths:
        below.append(reach)
        left, step = min(counts[x], capacity // x), 1
        while left:
            step = min(step, left)
            reach |= reach << x * step & everything
            left -= step
            step *= 2
    total, out = reach.bit_length() - 1, []
    for x, before in zip(reversed(lengths), reversed(below), strict=True):
        use = max(k for k in range(min(counts[x], total // x) + 1) if before >> total - k * x & 1)
        out += [x] * use
        total -= x * use
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Bins as (how many of them, their lengths), from the counts of lengths."""
    counts = {x: n for x, n in counts.items() if n > 0}
    if any(not 0 < x <= capacity for x in counts):
        raise ValueError("a length is not between 1 and the capacity")
    out = []
    while counts:
        lengths = fullest(counts, capacity)
        need = {x: lengths.count(x) for x in lengths}
        times = min(counts[x] // k for x, k in need.items())
        out.append((times, lengths))
        for x, k in need.items():
            counts[x] -= k * times
            if not counts[x]:
                del counts[x]
    return out


def places(bins: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, pieces of that length in a sequence, offset of the first)."""
    rows: dict[int, list] = {}
    rank: dict[int, int] = {}
    first = 0
    for times, lengths in bins:
        offset = 0
        for x in sorted(set(lengths), reverse=True):
            k = lengths.count(x)
            rows.setdefault(x, []).append((rank.get(x, 0), first, k, offset))
            rank[x] = rank.get(x, 0) + k * times
            offset += k * x
        first += times
    return {x: np.array(r, dtype="int64") for x, r in rows.items()}


class _Encoder:
    """Ids as the tokenizers library gives them for a byte-level BPE file. On plain text a faster library with the
    same vocabulary and pattern gives the same ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        of = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")


_loaded: dict[str, _Encoder] = {}


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of the documents of docs (doc_id, text): their ids and end_id. Only longer ones are cut, into pieces
    of capacity; the first takes what is left over."""

    def make():
        if path not in _loaded:
            _loaded[path] = _Encoder(path)
        own = _loaded[path]

        def one(text: str | None) -> list[tuple]:
            ids = np.append(own.encode(text) if text else np.array([], dtype="<u4"), np.array([end_id], dtype="<u4"))
            starts = [0, *range((len(ids) - 1) % capacity + 1, len(ids), capacity)]
            return [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True))]

        return lambda texts: pd.DataFrame({"pieces": [one(t) for t in texts]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), per_text(f"pieces array<struct<{PIECES}>>", make).alias("r")).select("doc_id", F.inline("r.pieces"))


def pack(docs: DataFrame, path: str | None = None, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece of the documents of docs (doc_id, text), with its sequence and its offset there.

    A null or empty text gives one piece, the end id; a very long one as many as it takes. Repeated rows and null
    doc_ids are packed as any other; equal lengths are ordered by doc_id, piece and checksum within a share. An empty
    table gives an empty one; other columns are left out. The lengths' counts (at most capacity rows), the plan (a few
    rows per length) and one count per share, a row for SHARE pieces, are the only things on the driver.
    """
    spark = docs.sparkSession
    path = path or tokenizer_path("byte_bpe_50k.json")
    scratch = Scratch(spark, "packing")
    cut = scratch.table(pieces(docs, path, capacity, end_id), "pieces")
    of_length = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = places(plan(of_length, capacity))
    held = spark.sparkContext.broadcast(where)  # bounded: a few rows per length

    # a length of very many pieces, as that of full ones, is ranked in as many shares as it needs
    many = {x: -(-n // SHARE) for x, n in of_length.items() if n > SHARE}
    shares = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in many.items() for v in pair]), F.col("length")), F.lit(1)) if many else F.lit(1)
    cut = cut.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), shares).cast("int"))
    counts = scratch.table(cut.groupBy("length", "share").agg(F.count("*").alias("n")), "counts")
    before = counts.select("length", "share", (F.sum("n").over(Window.partitionBy("length").orderBy("share")) - F.col("n")).alias("before"))

    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "share"]).withColumn("rank", F.col("rank") + F.col("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(rank: pd.Series, length: pd.Series) -> pd.DataFrame:
        rank, length = rank.to_numpy(), length.to_numpy()
        sequence, offset = np.empty(len(rank), dtype="int64"), np.empty(len(rank), dtype="int64")
        for x in np.unique(length):
            at, rows = np.flatnonzero(length == x), held.value[int(x)]
            r = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
            nth = rank[at] - r[:, 0]
            sequence[at], offset[at] = r[:, 1] + nth // r[:, 2], r[:, 3] + nth % r[:, 2] * x
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", place(F.col("rank").cast("long"), "length").alias("at")).select("doc_id", "piece", "start", "length", "ids_crc32", "at.*")
