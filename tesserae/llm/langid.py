"""Language identification by a byte convolutional network.

Filters of several widths run over the bytes of a fixed-length window, their maxima over the window feed a
softmax. The network is trained in numpy on the driver, on a bounded sample of labelled texts; it is then applied
to all windows of every text. Filters of even width are sums over byte pairs, so a convolution is a look-up of one
table row per pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import per_text

WINDOW = 256  # bytes
WIDTHS = (2, 4, 6)
FILTERS = 16  # of each width
#: The bound of the training sample: texts (about so many, at most twice), and windows of each.
SAMPLE_TEXTS, SAMPLE_WINDOWS = 3_000, 2
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.01, 7
#: Windows a batch of texts is worked through by.
ROWS = 2_048
_LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"

PREDICTED = "lang_pred string, score double"


def windows(raw: bytes) -> np.ndarray:
    """All windows of a text's bytes, the last one filled up with zeros."""
    n = max(1, -(-len(raw) // WINDOW))
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), dtype=np.uint8).reshape(n, WINDOW)


class ByteCNN:
    """Weights: for each width an array (width, 256, filters); the softmax layer and its bias."""

    def __init__(self, labels: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.conv = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype("float32") for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), dtype="float32")
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype("float32")
        self.shift = np.zeros(len(labels), dtype="float32")

    def tables(self) -> list[list[np.ndarray]]:
        """Per width, for each byte pair in the filter the 65,536 sums."""
        return [[(w[k][:, None, :] + w[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, len(w), 2)] for w in self.conv]

    @staticmethod
    def pool(x: np.ndarray, tables: list[list[np.ndarray]], where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Maxima of each filter over the windows x, and with where their places."""
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        tops, at = [], []
        for parts in tables:
            n = pair.shape[1] - 2 * (len(parts) - 1)
            sums = parts[0][pair[:, :n]]
            for k, part in enumerate(parts[1:], 1):
                sums += part[pair[:, 2 * k : 2 * k + n]]
            tops.append(sums.max(axis=1))
            if where:
                at.append(sums.argmax(axis=1))
        return np.concatenate(tops, axis=1), np.concatenate(at, axis=1) if where else None

    def softmax(self, tops: np.ndarray) -> np.ndarray:
        logits = np.maximum(tops + self.bias, 0) @ self.out + self.shift
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = RATE) -> None:
        """Adam on the cross-entropy; only the bytes under a filter's maximum get its gradient."""
        rng = np.random.default_rng(SEED)
        params = [*self.conv, self.bias, self.out, self.shift]
        first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(order), BATCH):
                rows = order[a : a + BATCH]
                xb, n = x[rows], len(rows)
                tops, at = self.pool(xb, self.tables(), where=True)
                hidden = np.maximum(tops + self.bias, 0)
                p = self.softmax(tops)
                p[np.arange(n), y[rows]] -= 1
                p /= n
                back = p @ self.out.T * (hidden > 0)
                grads = []
                for i, w in enumerate(WIDTHS):
                    g = np.zeros((w, 256, FILTERS), dtype="float32")
                    cols = slice(i * FILTERS, (i + 1) * FILTERS)
                    for k in range(w):
                        byte = np.take_along_axis(xb, at[:, cols] + k, axis=1)
                        np.add.at(g[k], (byte, np.arange(FILTERS)[None, :]), back[:, cols])
                    grads.append(g)
                grads += [back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
                t += 1
                for q, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    q -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """Label and score of each text: the mean of the softmax over all its windows. Of equal scores the first label in
        alphabetical order counts."""
        cut = [windows(t.encode("utf-8", "surrogatepass")) for t in texts]
        owner = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
        total, tables = np.zeros((len(cut), len(self.labels))), self.tables()
        x = np.concatenate(cut) if cut else np.zeros((0, WINDOW), dtype=np.uint8)
        for a in range(0, len(x), 64):
            tops, _ = self.pool(x[a : a + 64], tables)
            np.add.at(total, owner[a : a + 64], self.softmax(tops))
        total /= np.bincount(owner, minlength=len(cut))[:, None] if len(cut) else 1
        best = total.argmax(axis=1)
        return [(self.labels[b], float(min(1.0, total[i, b]))) for i, b in enumerate(best)]


def fit(docs: DataFrame, texts: int = SAMPLE_TEXTS) -> ByteCNN | None:
    """Trains on about `texts` labelled rows whose crc32(doc_id) mod 4 is not 2, and on at most twice as many: those
    whose hash lies under a threshold set by their count. Only their windows leave the executors. None if there are no
    labels, or no column of them."""
    if "lang" not in docs.columns:
        return None
    learn = docs.where("lang is not null and doc_id is not null").where("crc32(cast(doc_id as string)) % 4 <> 2").select("doc_id", "lang", "text")
    share = min(1.0, texts / max(1, learn.count()))
    learn = learn.where(F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30)) < int(share * (1 << 30))).where("text is not null and text <> ''")
    raw = F.encode("text", "UTF-8")
    n = F.ceil(F.length(raw) / WINDOW).cast("int")
    at = [F.pmod(F.xxhash64("doc_id") + i * F.greatest(n / SAMPLE_WINDOWS, F.lit(1)).cast("int"), n).cast("int") for i in range(SAMPLE_WINDOWS)]
    picked = F.transform(F.array_sort(F.array_distinct(F.array(*at))), lambda i: F.substring(raw, i * WINDOW + 1, F.lit(WINDOW)))
    rows = learn.select("lang", "doc_id", picked.alias("windows")).limit(2 * texts).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"], r["windows"]))
    labels = sorted({r["lang"] for r in rows})
    if not labels:
        return None
    x, y = [], []
    for r in rows:
        for w in r["windows"]:
            x.append(windows(bytes(w))[0])
            y.append(labels.index(r["lang"]))
    model = ByteCNN(labels)
    if len(labels) > 1:
        model.train(np.stack(x), np.array(y))
    return model


def predicted(docs: DataFrame, model: ByteCNN | None = None) -> Column:
    """Column text's (lang_pred, score), by the model or by one trained on docs."""
    own = model or fit(docs)
    held = docs.sparkSession.sparkContext.broadcast(own)  # bounded: some 100,000 weights

    def make():
        net = held.value

        def work(texts: list[str | None]) -> pd.DataFrame:
            out: list = [(UNKNOWN, 0.0)] * len(texts)
            at = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if net else []
            step, size = [], 0
            for j, i in enumerate(at):  # so many windows at a time, or one text
                step.append(i)
                size += len(texts[i]) // WINDOW + 1
                if size >= ROWS or j == len(at) - 1:
                    for k, got in zip(step, net.predict([texts[k] for k in step]), strict=True):
                        out[k] = got
                    step, size = [], 0
            return pd.DataFrame(out, columns=["lang_pred", "score"])

        return work

    return per_text(PREDICTED, make)


def predict(docs: DataFrame, model: ByteCNN | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text; lang for training, if no model is given): doc_id, held_out, lang_pred, score.

    A null text, one without a letter, or any text when there is nothing to learn from is `und` with score 0. A null
    doc_id is not held out. Very long texts are read whole, window by window; of equal scores the first label in
    alphabetical order counts. Repeated rows give repeated rows, an empty table an empty one; other columns are left
    out. Predictions take only the text. Without a model and without lang there is nothing to learn from.
    """
    held_out = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), predicted(docs, model).alias("r")).select("doc_id", "held_out", "r.*")
