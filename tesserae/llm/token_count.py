"""Token counts by a compiled finite-state transducer.

The vocabulary of a scored-piece BPE model is compiled, on demand, into a deterministic transducer over
characters. A state holds what later characters can still depend on: the longest suffix read that begins
some piece, and for each place inside it where a later token can start, the last token of the encoding up to
there with the tokens emitted since. A transition carries the change in the number of emitted tokens. Texts are cut into chunks; the state
map of a chunk (exit state and count for an entry state) composes with its neighbour's, so that a text of any
length is counted by combining chunk maps pairwise, as in a parallel prefix scan.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import per_text, tokenizer_path

SPACE = "▁"
BLOCK = 1 << 16  # characters in a chunk of a long text
WORDS = 300_000  # memoised words of a generation; a worker holds two generations
STATES = 350_000  # states a worker holds; then it compiles anew

COUNTS = "n_bytes long, n_tokens long, over_limit boolean"


class Transducer:
    """Counts pieces of a BPE model with byte fallback. pieces: text -> score (higher merges first)."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.begins = {p[:i] for p in pieces for i in range(1, len(p) + 1)}
        if any(c not in pieces for p in pieces for c in p):
            raise ValueError("a character of a longer piece is no piece itself")
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece has a word start in its middle")
        self.pairs: dict[tuple[str | None, str], bool] = {}
        self.words: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.arcs: dict[tuple[str, str], tuple[str, list, list]] = {}
        self.restart()

    def restart(self) -> None:
        #: A state: the suffix, and its past: here, and at each place in it where a piece can start, from the right,
        #: the last token up to there and its count less the present one.
        self.start = ("", ((None, 0),))
        self.ids, self.states, self.steps = {self.start: 0}, [self.start], [{}]

    def merge(self, text: str) -> list[str]:
        """Plain BPE: the best-scored adjacent pair merges, the leftmost on ties."""
        none, score = float("-inf"), self.pieces.get
        parts = list(text)
        scores = [score(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while scores and (best := max(scores)) != none:
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i < len(scores):
                scores[i] = score(parts[i] + parts[i + 1], none)
            if i:
                scores[i - 1] = score(parts[i - 1] + parts[i], none)
        return parts

    def fits(self, left: str | None, right: str) -> bool:
        """Whether the two tokens stay as they are side by side; without left, whether right does alone."""
        known = self.pairs.get((left, right))
        if known is None:
            known = self.pairs[left, right] = self.merge((left or "") + right) == ([right] if left is None else [left, right])
        return known

    def arc(self, suffix: str, char: str) -> tuple[str, list, list]:
        """What a character does to a suffix, whatever the tokens: the next suffix; the tokens that end there,
        longest first, with the place in the state's past where each starts; and the places that stay in it."""
        begins = self.begins
        places = [0, *(d for d in range(1, len(suffix) + 1) if suffix[-d:] in begins)]
        to = suffix + char
        while to not in begins:
            to = to[1:]
        ends = [(places.index(n - 1), to[-n:]) for n in range(len(to), 0, -1) if to[-n:] in self.pieces]
        made = self.arcs[suffix, char] = to, ends, [places.index(d - 1) for d in range(1, len(to) + 1) if to[-d:] in begins]
        return made

    def step(self, state: int, char: str) -> tuple[int, int]:
        """Compiles the transition: next state and emitted-token count."""
        if char not in self.pieces:  # its bytes are tokens, and nothing merges with them
            made = (0, len(char.encode("utf-8", "surrogatepass")))
        else:
            suffix, past = self.states[state]
            to, ends, stay = self.arcs.get((suffix, char)) or self.arc(suffix, char)
            for place, token in ends:
                before, emitted = past[place]
                if self.fits(before, token):
                    break
            else:
                raise ValueError(f"no token ends at {to!r}")
            emitted += 1
            key = (to, ((token, 0), *[(past[i][0], past[i][1] - emitted) for i in stay]))
            at = self.ids.get(key)
            if at is None:
                at = self.ids[key] = len(self.states)
                self.states.append(key)
                self.steps.append({})
            made = (at, emitted)
        self.steps[state][char] = made
        return made

    def run(self, state: int, text: str) -> tuple[int, int]:
        total = 0
        for char in text:
            state, n = self.steps[state].get(char) or self.step(state, char)
            total += n
        return state, total

    def word(self, word: str) -> int:
        """Tokens, from the start state, of a space and word; of word alone if it begins with a line feed. Memoised."""
        n = self.words.get(word)
        if n is None:
            n = self.older.get(word)
            if n is None:
                n = self.run(0, word if word[:1] == "\n" else SPACE + word)[1]
            self.words[word] = n
        return n

    # The map of a chunk: (head, None, 0) if no word starts in it, else (head, exit state, tokens after head).
    # The head is what comes before the first word start; its count depends on the entry state.
    def chunk(self, text: str) -> tuple[str, int | None, int]:
        head, *words = re.split(f"(?<!{SPACE})(?={SPACE})", text)
        if not words:
            return head, None, 0
        state, last = self.run(0, words[-1])
        return head, state, sum(self.run(0, w)[1] if w[1:2] == "\n" else self.word(w[1:]) for w in words[:-1]) + last

    def compose(self, a: tuple, b: tuple) -> tuple:
        if a[1] is None and a[0].endswith(SPACE) and b[0] == "" and b[1] is not None:
            raise AssertionError("chunks are cut inside a word start")
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        state, n = self.run(a[1], b[0])
        return a[0], (state if b[1] is None else b[1]), a[2] + n + b[2]

    def count(self, text: str) -> int:
        if not text:
            return 0
        if len(self.states) > STATES:
            self.restart()
        if len(self.words) > WORDS:
            self.words, self.older = {}, self.words
        cut = "\n" in text
        if cut and ("\n" in self.pieces or " \n" in text or text[0] == "\n"):
            pass
        elif len(text) <= BLOCK and SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            # a line feed is no piece: it emits its byte's token and leads back to the start state, as a space does
            words = (text.replace("\n", " \n") if cut else text).split(" ")
            counts = list(map(self.words.get, words))
            if None in counts:
                counts = [self.word(w) if n is None else n for w, n in zip(words, counts, strict=True)]
            return sum(counts)
        text = SPACE + text.replace(" ", SPACE)
        cuts = [0]
        while cuts[-1] < len(text):
            cut = min(cuts[-1] + BLOCK, len(text))
            while cut < len(text) and text[cut] == SPACE and text[cut - 1] == SPACE:
                cut += 1  # never inside a run of spaces
            cuts.append(cut)
        maps = [self.chunk(text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, state, n = maps[0]
        return n + self.run(0, head)[1]


_loaded: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """Of a sentencepiece BPE model with byte fallback and identity normalization, once per worker."""
    if path not in _loaded:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        _loaded[path] = Transducer({model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_unknown(i) or model.is_control(i) or model.is_unused(i))})
    return _loaded[path]


def token_counts(docs: DataFrame, model_path: str | None = None, limit: int = 4096) -> DataFrame:
    """One row per row of docs (doc_id, text): bytes, tokens and whether the tokens are over the limit.

    A null text counts as empty: 0 bytes, 0 tokens. A null doc_id stays null; repeated rows give repeated
    rows; an empty table gives an empty one; other columns are left out. There is no shuffle.
    """
    path = model_path or tokenizer_path("piece_bpe_32k.model")

    def make():
        own = transducer(path)

        def work(texts: list[str | None]) -> pd.DataFrame:
            tokens = pd.Series([own.count(t or "") for t in texts], dtype="int64")
            return pd.DataFrame({"n_bytes": [len((t or "").encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": tokens, "over_limit": tokens > limit})

        return work

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), per_text(COUNTS, make).alias("r")).select("doc_id", "r.*")
