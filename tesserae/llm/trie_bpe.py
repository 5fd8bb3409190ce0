"""BPE encoding and decoding by a prefix-sharing trie traversal.

The distinct words of a batch are walked in sorted order, which is the depth-first order of their trie. Each
trie node carries the last token of the encoding of its prefix, so that a prefix shared by many words is
encoded once: the last token at a node is the one vocabulary entry that ends there and stays beside the last
token of the node where it starts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import PLAIN, per_text, tokenizer_path

DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"
FULL = DIGESTS + ", ids array<int>, decoded string"
WORDS = 150_000  # words of a generation; a worker holds the encodings of two generations
PAIRS = 500_000
PART = 4_000_000  # characters worked through at a time
#: The pre-tokenizer's pattern, for text of PLAIN characters in lower case.
_PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


class TrieBPE:
    """Encoder and decoder of a word-end BPE vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        final = [v[: -len(self.end)] for v in self.vocab if self.end and v.endswith(self.end)]
        #: What tokens end in, inside a word and at its end.
        self.ends = {False: {v[i:] for v in self.vocab for i in range(len(v))}, True: {v[i:] for v in (final or self.vocab) for i in range(len(v))}}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes = byte_symbols()
        self.pairs: dict[tuple[str, str, bool], bool] = {}
        self.known: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}

    def parts(self, symbols: str, ends: bool) -> list[str]:
        out = list(symbols)
        if ends:
            out[-1] += self.end
        return out

    def merge(self, parts: list[str]) -> list[str]:
        """Plain BPE over the merge ranks, the leftmost pair first on ties."""
        none, rank = len(self.rank), self.rank.get
        ranks = [rank(p, none) for p in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) != none:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
        return parts

    def fits(self, left: str, right: str, ends: bool) -> bool:
        """Whether the two tokens stay as they are side by side; without left, whether right does alone."""
        known = self.pairs.get((left, right, ends))
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            own = self.parts(right[: len(right) - len(self.end) * ends], ends)
            known = self.pairs[left, right, ends] = self.merge([*left, *own]) == ([left, right] if left else [right])
        return known

    def last(self, word: str, i: int, tokens: list[str], ends: bool) -> str:
        """The last token of word[:i], given those of all shorter prefixes."""
        tail, endings, vocab = self.end if ends else "", self.ends[ends], self.vocab
        j = i - 1
        while j >= 0 and word[j:i] in endings:
            j -= 1
        for k in range(j + 1, i):
            token = word[k:i] + tail
            if token in vocab and self.fits(tokens[k], token, ends):
                return token
        raise ValueError(f"{word[:i]!r} has a symbol outside the vocabulary")

    def learn(self, words: list[str]) -> None:
        """Encodes words (in byte symbols) by depth-first traversal of their trie."""
        before, tokens = "", [""]
        for word in sorted(words):
            if not word:
                continue
            shared = len(os.path.commonprefix((before, word)))
            del tokens[shared + 1 :]
            for i in range(len(tokens), len(word)):
                tokens.append(self.last(word, i, tokens, False))
            out, i = [self.last(word, len(word), tokens, True)], len(word)
            i -= len(out[0]) - len(self.end)
            while i > 0:
                out.append(tokens[i])
                i -= len(tokens[i])
            out.reverse()
            self.known[word] = np.array([self.vocab[t] for t in out], dtype="<u4").tobytes(), " ".join(out)
            before = word

    def words(self, text: str) -> list[str]:
        """The words of a text without special strings, in byte symbols."""
        if PLAIN.fullmatch(text):
            found = _PLAIN_WORDS.findall(text.lower())
            return found if text.isascii() else [w if w.isascii() else "".join(self.bytes[b] for b in w.encode()) for w in found]
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def segments(self, text: str) -> list:
        """Lists of words, and the ids of special strings between them."""
        if self.split is None or not any(s in text for s in self.special):
            return [self.words(text)]
        return [self.special[s] if s in self.special else self.words(s) for s in self.split.split(text) if s]

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Ids (little-endian unsigned 32 bits) and decoded text of each text."""
        cut = [self.segments(t) for t in texts]
        need = {w for segments in cut for words in segments if isinstance(words, list) for w in words}
        if len(self.known) > WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        known.update((w, older[w]) for w in need if w in older and w not in known)
        self.learn([w for w in need if w not in known])
        names = {i: (np.array([i], dtype="<u4").tobytes(), s) for s, i in self.special.items()}
        out = []
        for segments in cut:
            got = [known[w] for w in segments[0]] if len(segments) == 1 and isinstance(segments[0], list) else [x for s in segments for x in ([names[s]] if isinstance(s, int) else [known[w] for w in s])]
            out.append((b"".join([x[0] for x in got]), " ".join([x[1] for x in got])))
        return out


_loaded: dict[str, TrieBPE] = {}


def encode(docs: DataFrame, path: str | None = None, full: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): the number of ids, SHA-256 of the ids and of the decoded text;
    with full, the ids and the decoded text too.

    A null text counts as empty: no ids, and the digests of nothing. Repeated rows give repeated rows; other
    columns are left out. There is no shuffle.
    """
    path = path or tokenizer_path("word_bpe_49k.json")

    def make():
        if path not in _loaded:
            _loaded[path] = TrieBPE(path)
        own = _loaded[path]

        def work(texts: list[str | None]) -> pd.DataFrame:
            rows, part, chars = [], [], 0
            for k, text in enumerate(texts):  # so many characters at a time, or one text
                part.append(text or "")
                chars += len(part[-1])
                if chars >= PART or k == len(texts) - 1:
                    for ids, decoded in own.encode_batch(part):
                        row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                        rows.append((*row, np.frombuffer(ids, dtype="<u4").astype("int32"), decoded) if full else row)
                    part, chars = [], 0
            return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 5 if full else 3])

        return work

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), per_text(FULL if full else DIGESTS, make).alias("r")).select("doc_id", "r.*")
