"""MinHash near-dedup by a chosen-path set similarity join.

A document's set is its distinct two-word shingles. Equal sets are one class; the join works on classes. In each of
TREES independent trees a class goes down a path: at each level, a tree has a coordinate of its own, which no other tree
and no other level uses, and the class's minwise token there chooses the child. Nodes of at most LIMIT classes are compared exhaustively; larger ones branch
again, LEVELS deep. Comparisons pass a size filter and a filter on 2-bit minwise sketches, and are then confirmed on
the full sets.

A pair of similarity 0.8 shares a node at depth d of a tree with probability 0.8**d; with 16 trees all of which go
four deep it is missed with probability (1 - 0.41)**16 = 0.0002, and with one level with 10**-11.

Only classes are wanted, so links are confirmed in two steps: first from each node's pivot to its members, then, for
members still in different components, all pairs of small nodes, and in nodes still large at the last level all
pairs but those inside the node's largest component. No pair of different components is left out. In such large nodes
the pairs are compared inside tasks, block by block, on the full sets' hashes, and only links that join components
leave a task: at most one fewer than its members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import Scratch, per_text, small_batches
from tesserae.llm.links import components

COORDINATES = 64
TREES, LEVELS, LIMIT = 16, 4, 48
STAR_TREES = 2
#: Shingles in a block of a large node. A task holds two blocks.
BLOCK = 1_000_000
#: Equal 2-bit sketch coordinates a pair must have: at similarity 0.8, 54 of 64 are expected, and fewer than 40 come
#: with a probability of 10**-5.
SKETCH = 40
SIMILAR = 80  # per cent
_rng = np.random.default_rng(20_240_501)
_MULTIPLY = (_rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))

SKETCHED = "sid binary, n long, tokens array<int>, s1 long, s2 long"


def words(text: str) -> list[bytes]:
    """Words of a text, A-Z in lower case. bytes.split() cuts at x20 and x09-x0D only."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str) -> set:
    w = words(text)
    return set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} if w else set()


def _hashes(w: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    for x in set(w).difference(known):
        known[x] = xxhash.xxh64_intdigest(x)
    h = np.array([known[x] for x in w], dtype=np.uint64)
    x = h[:-1] * _C1 ^ ((h[1:] * _C2) << np.uint64(31) | (h[1:] * _C2) >> np.uint64(33)) if len(h) > 1 else h ^ _C3
    x = (x ^ x >> np.uint64(29)) * _C3
    return np.unique((x ^ x >> np.uint64(32)) * _C1)


def _minwise(x: np.ndarray) -> np.ndarray:
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(x), 4096):
        np.minimum(least, (x[a : a + 4096, None] * _MULTIPLY).min(axis=0), out=least)
    return least


def sketches(docs: DataFrame) -> DataFrame:
    """Per row its set's id (128 bits of its hashes), size, minwise tokens and sketch; null ids for empty sets."""

    def make():
        weights = np.uint64(1) << (np.arange(32, dtype=np.uint64) * np.uint64(2))
        known: dict[bytes, int] = {}

        def one(text: str | None) -> tuple:
            w = words(text) if text else []
            if not w:
                return None, 0, None, None, None
            if len(known) > 200_000:
                known.clear()
            x = _hashes(w, known)
            least = _minwise(x)
            bits = least >> np.uint64(33) & np.uint64(3)
            s = [int((bits[k : k + 32] * weights).sum().astype(np.int64)) for k in (0, 32)]
            return xxhash.xxh3_128_digest(x.tobytes()), len(x), (least >> np.uint64(32)).astype(np.uint32).view(np.int32), *s

        return lambda texts: pd.DataFrame([one(t) for t in texts], columns=["sid", "n", "tokens", "s1", "s2"]).astype({"s1": "Int64", "s2": "Int64"})

    return docs.select("doc_id", "text_md5", per_text(SKETCHED, make).alias("r")).select("doc_id", "text_md5", "r.*")


def _alike(a: str, b: str) -> Column:
    """Whether two classes may be similar: by their sizes and sketches."""
    even = F.lit(0x5555555555555555)
    odd = [F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}")) for s in ("s1", "s2")]
    differ = sum(F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(even)) for x in odd)
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (small * 100 >= large * SIMILAR) & (differ <= COORDINATES - SKETCH)


def tree_nodes(classes: DataFrame, scratch: Scratch, trees: int = TREES, levels: int = LEVELS, limit: int = LIMIT) -> DataFrame:
    """(tree, node, sid, n, s1, s2, large): the nodes of two classes and more at which the trees end."""
    share = COORDINATES // levels
    if trees > share:
        raise ValueError("more trees than coordinates in a level: trees would not be independent")
    rows = classes.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    path = F.xxhash64("tree")
    for level in range(levels):
        rows = rows.withColumn(f"p{level}", F.xxhash64(path, F.get("tokens", F.col("tree") + level * share)))
        path = F.col(f"p{level}")
    rows = rows.select("tree", "sid", "n", "s1", "s2", *[f"p{level}" for level in range(levels)])
    ended = []
    for level in range(levels):
        node = f"p{level}"
        sizes = rows.groupBy(node).agg(F.count("*").alias("size")).where("size > 1")
        rows = rows.join(sizes, node)
        rows = scratch.table(rows, f"level{level}")
        last = level == levels - 1
        keep = rows if last else rows.where(F.col("size") <= limit)
        ended.append(keep.select("tree", F.col(node).alias("node"), "sid", "n", "s1", "s2", (F.col("size") > limit).alias("large")))
        rows = rows.where(F.col("size") > limit).drop("size", node)
    out = ended[0]
    for x in ended[1:]:
        out = out.union(x)
    return out


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar. texts: (sid, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, set] = {}
        for pdf in frames:
            good = []
            for a, b, ta, tb in zip(pdf["a"], pdf["b"], pdf["ta"], pdf["tb"], strict=True):
                x = shingle_set(tb)
                y = held.get(a)
                if y is None:
                    held.clear()
                    y = held[a] = shingle_set(ta)
                both = len(x & y)
                good.append(100 * both >= SIMILAR * (len(x) + len(y) - both))
            yield pdf.loc[good, ["a", "b"]]

    full = pairs.join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a")
    return full.select("a", "b", "ta", "tb").mapInPandas(run, "a binary, b binary")


def _hashed(texts: DataFrame) -> DataFrame:
    """(sid, shingles) of texts (sid, text): the hashes of the full set, eight bytes each."""

    def make():
        known: dict[bytes, int] = {}

        def one(text: str) -> bytes:
            if len(known) > 200_000:
                known.clear()
            return _hashes(words(text), known).astype("<u8").tobytes()

        return lambda texts: pd.DataFrame({"shingles": [one(t) for t in texts]})

    return texts.select("sid", per_text("shingles binary", make).alias("r")).select("sid", "r.shingles")


def joining_links(block: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b) between rows of a block (rest, sid, label, shingles): each row of rest is compared with all others
    on full sets. Of the links, those that join components (labels) not yet joined."""
    empty = pd.DataFrame({"a": [], "b": []}, dtype=object)
    rest, others = block[block["rest"]], block[~block["rest"]]
    if rest.empty or others.empty:
        return empty
    sets = [np.frombuffer(x, dtype="<u8") for x in others["shingles"]]
    sizes = np.array([len(x) for x in sets])
    shingles = np.concatenate(sets)
    order = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[order], np.repeat(np.arange(len(sets)), sizes)[order]
    code = {x: k for k, x in enumerate(dict.fromkeys([*others["label"], *rest["label"]]))}
    joined = np.arange(len(code))
    of_other, sids = np.array([code[x] for x in others["label"]]), others["sid"].to_numpy()
    found = []
    for sid, label, raw in zip(rest["sid"], rest["label"], rest["shingles"], strict=True):
        x = np.frombuffer(raw, dtype="<u8")
        start, end = np.searchsorted(shingles, x, "left"), np.searchsorted(shingles, x, "right")
        n = end - start
        at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        linked = np.flatnonzero(100 * both >= SIMILAR * (len(x) + sizes - both))
        components_hit, first = np.unique(joined[of_other[linked]], return_index=True)
        for k, other in zip(components_hit.tolist(), linked[first].tolist(), strict=True):
            own = joined[code[label]]
            if k != own:
                found.append((min(sid, sids[other]), max(sid, sids[other])))
                joined[joined == k] = own
    return pd.DataFrame(found, columns=["a", "b"]) if found else empty


def dealt_blocks(large: DataFrame) -> DataFrame:
    """(node, r, g, rest, sid, label) of large (node, sid, n, label): in each node of several components, block r of the
    members outside the largest one (rest) meets each block g of all members. Blocks hold about BLOCK shingles."""
    parts = large.groupBy("node", "label").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    nodes = parts.groupBy("node").agg(F.max(F.struct("size", "label", "weight")).alias("main"), F.sum("weight").alias("weight"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda weight: F.ceil(weight / BLOCK).cast("int")
    nodes = nodes.select("node", F.col("main.label").alias("main"), blocks(F.col("weight")).alias("gs"), blocks(F.col("weight") - F.col("main.weight")).alias("rs"))
    as_any = F.expr("transform(sequence(0, rs - 1), r -> struct(false AS rest, r AS r, cast(pmod(xxhash64(sid), gs) AS int) AS g))")
    as_rest = F.expr("transform(sequence(0, gs - 1), g -> struct(true AS rest, cast(pmod(xxhash64(sid), rs) AS int) AS r, g AS g))")
    places = F.when(F.col("label") == F.col("main"), as_any).otherwise(F.concat(as_any, as_rest))
    return large.join(nodes, "node").select("node", "sid", "label", F.explode(places).alias("p")).select("node", "p.r", "p.g", "p.rest", "sid", "label")


def classes_of(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    component_id is the least doc_id of the documents reachable by links; kept is whether that is the row's own. A
    null or empty text, or one of blanks, has an empty set (n_shingles 0), links with nothing and is kept. Rows that
    repeat a doc_id are kept or dropped alike. A null doc_id never names a component, unless all its members have
    none; then they are kept. An empty table gives an empty one; other columns are left out.
    """
    with small_batches(docs.sparkSession):
        return _classes_of(docs)


def _classes_of(docs: DataFrame) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "near-dedup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_md5", F.md5("text"))
    rows = scratch.table(sketches(docs), "sketches")

    first = F.min_by(F.struct("doc_id", "text_md5"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_md5"))
    least = rows.where("sid is not null").groupBy("sid").agg(first.alias("first"))
    reps = rows.where("sid is not null").join(least, "sid").where(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_md5") == F.col("first.text_md5")))
    reps = scratch.table(reps.select("sid", "doc_id", "text_md5", "n", "tokens", "s1", "s2").dropDuplicates(["sid"]), "classes")

    nodes = scratch.table(tree_nodes(reps.select("sid", "n", "tokens", "s1", "s2"), scratch), "nodes")
    scratch.drop(*[f"level{k}" for k in range(LEVELS)])

    def texts_of(sids: DataFrame) -> DataFrame:
        ids = sids.distinct().join(reps.select("sid", "doc_id", "text_md5"), "sid")
        ids = ids.select("sid", F.col("doc_id").alias("rep"), "text_md5")
        return docs.join(ids, (docs.text_md5 == ids.text_md5) & docs.doc_id.eqNullSafe(ids.rep)).select("sid", "text").dropDuplicates(["sid"])

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        pairs = scratch.table(pairs, f"{name}-pairs")
        texts = scratch.table(texts_of(pairs.select(F.col("a").alias("sid")).union(pairs.select("b"))), f"{name}-texts")
        links = scratch.table(confirm(pairs, texts), f"{name}-links")
        scratch.drop(f"{name}-texts", f"{name}-pairs")
        return links

    # from each node's pivot to its members, in the first trees and in nodes that stayed large
    star = nodes.where((F.col("tree") < STAR_TREES) | F.col("large"))
    pivots = star.groupBy("node").agg(F.min(F.struct("sid", "n", "s1", "s2")).alias("a"))
    pairs = star.select("node", F.struct("sid", "n", "s1", "s2").alias("b")).join(pivots, "node").where("a.sid < b.sid").where(_alike("a", "b"))
    links = confirmed(pairs.select(F.col("a.sid").alias("a"), F.col("b.sid").alias("b")).distinct(), "star")
    labels = scratch.table(components(links, scratch), "labels")

    # all pairs that are still in different components
    near = nodes.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    near = scratch.table(near, "labelled")
    scratch.drop("nodes")
    one = F.struct("sid", "n", "s1", "s2", "label")
    small = near.where(~F.col("large"))
    mixed = small.groupBy("node").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("node")
    small = small.join(mixed, "node").select("node", one.alias("x"))
    pairs = small.select("node", F.col("x").alias("a")).join(small.select("node", F.col("x").alias("b")), "node")
    pairs = pairs.where("a.sid < b.sid and a.label <> b.label").where(_alike("a", "b")).select("a.sid", "b.sid")
    large = near.where("large")
    blocks = scratch.table(dealt_blocks(large), "blocks")
    sets = scratch.table(_hashed(texts_of(blocks.select("sid"))), "sets")
    of_large = blocks.join(sets, "sid").groupBy("node", "r", "g").applyInPandas(joining_links, "a binary, b binary")
    more = confirmed(pairs.union(of_large).toDF("a", "b").distinct(), "rest")
    labels = scratch.table(components(links.union(more), scratch), "labels")

    own = reps.select("sid", "doc_id").join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    least = own.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_set = scratch.table(own.join(least, "label").select("sid", "component_id"), "components")
    scratch.keep("sketches", "components")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "sid").join(of_set, "sid", "left")
    component = F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
