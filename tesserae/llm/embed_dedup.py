"""Embedding near-dedup by NN-descent.

Equal vectors are one class. A neighbour graph of K neighbours a class starts from the leaves of random-hyperplane
trees and is refined by neighbours-of-neighbours joins: at each hub, all pairs of its neighbours (forward and
reverse) are compared, and those better than what a list holds enter it. Edges of the threshold and more are links.

A list is saturated when even its worst entry is a link: there may be more, also to other components. A link that no
list has lies between two saturated ones, as an unsaturated list has all its class's links. So saturated classes are
compared with those of all other components: first in the leaves of trees, which join most, then exactly. For the
exact step they are dealt into cells, each with a centre and the angle within which its members lie; only cells whose
angles can touch are compared. The lists of a component with a saturated member are then enlarged to the whole
component, in blocks of bounded size, of which only sums of links leave the task.

Recall of the other lists is audited: AUDIT classes, a bounded sample, are compared with all rows; missed links are
added, and while recall is below RECALL more trees are grown. If it stays below, all classes count as saturated, so
that all are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import Scratch
from tesserae.llm.links import components

K, LEAF, TREES, ROUNDS = 8, 256, 6, 2
AUDIT, RECALL, MORE = 256, 0.999, 3
BLOCK = 512
#: Hubs whose members are compared in one call: some 2,000 vectors.
HUBS = 128
#: Cells in a block of centres.
CENTRES = 2048
EDGE = "cid binary, other binary, sim double"


def _unit(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(v, dtype="<f8") for v in vectors]) if len(vectors) else np.zeros((0, 1))


def plain(embedding: Column) -> Column:
    """The vector as doubles, with 0.0 for -0.0, so that equal vectors have equal texts."""
    return F.transform(embedding, lambda x: x.cast("double") + F.lit(0.0))


def class_id(embedding: Column) -> Column:
    """128 bits of a plain() vector's text; null if a component is."""
    gaps = F.exists(embedding, lambda x: x.isNull())
    return F.when(~gaps, F.unhex(F.md5(F.array_join(embedding, ","))))


def classes(vectors: DataFrame) -> DataFrame:
    """(cid, first, copies, unit) for each distinct usable vector (vec_id, embedding, a plain one): unit is the vector
    divided by its norm, as doubles. Null, empty and zero vectors and those with null or non-finite components are left out."""
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    own = vectors.where(usable).withColumn("cid", class_id(F.col("embedding")))
    out = own.groupBy("cid").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.any_value("embedding").alias("embedding"))

    def unit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for v in pdf.pop("embedding"):
                x = np.asarray(v, dtype="f8")
                x = x / np.abs(x).max()
                rows.append((x / np.sqrt(x @ x)).astype("<f8").tobytes())
            yield pdf.assign(unit=rows)

    return out.select("cid", "first", "copies", "embedding").mapInPandas(unit, "cid binary, first long, copies long, unit binary")


def _top(edges: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("cid").orderBy(F.col("sim").desc(), "other")
    return edges.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")


def _best(ids: np.ndarray, sims: np.ndarray, k: int) -> pd.DataFrame:
    """Edges from each row to its k most similar others."""
    n = len(ids)
    np.fill_diagonal(sims, -np.inf)
    k = min(k, n - 1)
    if k < 1:
        return pd.DataFrame({"cid": [], "other": [], "sim": []})
    at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    sim = np.take_along_axis(sims, at, axis=1)
    return pd.DataFrame({"cid": np.repeat(ids, k), "other": ids[at.ravel()], "sim": np.clip(sim.ravel(), -1, 1)})


def _dealt_leaves(own: DataFrame, n: int, trees: int, seed: int, scratch: Scratch) -> DataFrame:
    """(tree, code, dim, part, cid, unit): the leaves of random-hyperplane trees. A leaf that stays large, as of many
    near copies, is dealt out by hash."""
    bits = max(0, int(np.ceil(np.log2(max(1, n / LEAF)))))

    def codes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            parts = []
            for _, same in pdf.groupby(pdf["unit"].str.len()):
                x = _unit(same["unit"])
                planes = np.random.default_rng((seed, x.shape[1])).normal(size=(x.shape[1], trees * bits)) if bits else np.zeros((x.shape[1], 0))
                sign = (x @ planes > 0).reshape(len(x), trees, bits) @ (1 << np.arange(bits, dtype="int64")) if bits else np.zeros((len(x), trees), dtype="int64")
                for t in range(trees):
                    parts.append(pd.DataFrame({"tree": t, "code": sign[:, t], "dim": x.shape[1], "cid": same["cid"].array, "unit": same["unit"].array}))
            if parts:
                yield pd.concat(parts)

    rows = scratch.table(own.mapInPandas(codes, "tree int, code long, dim int, cid binary, unit binary"), "leaves")
    sizes = rows.groupBy("tree", "code", "dim").agg(F.ceil(F.count("*") / (2 * LEAF)).alias("parts"))
    return rows.join(sizes, ["tree", "code", "dim"]).withColumn("part", F.pmod(F.xxhash64("cid", "tree"), F.col("parts")))


def _leaves(own: DataFrame, n: int, trees: int, seed: int, scratch: Scratch) -> DataFrame:
    """Edges inside the leaves of random-hyperplane trees."""

    def leaf(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _unit(pdf["unit"])
        return _best(pdf["cid"].to_numpy(), x @ x.T, K)

    return _dealt_leaves(own, n, trees, seed, scratch).groupBy("tree", "code", "dim", "part").applyInPandas(leaf, EDGE)


def _descend(graph: DataFrame, own: DataFrame, n: int) -> DataFrame:
    """One round: neighbours of a hub are compared with each other. A hub has at most 2 K + 1 of them, itself included;
    a task works through some HUBS hubs at a time."""
    floor = graph.groupBy("cid").agg(F.min("sim").alias("floor"), F.count("*").alias("n")).select(F.col("cid").alias("member"), F.when(F.col("n") >= K, F.col("floor")).otherwise(-2.0).alias("floor"))
    rank = Window.partitionBy("other").orderBy(F.col("sim").desc(), "cid")
    reverse = graph.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= K).select(F.col("other").alias("hub"), F.col("cid").alias("member"))
    seats = graph.select(F.col("cid").alias("hub"), F.col("other").alias("member")).union(reverse).union(graph.select("cid", "cid").distinct()).distinct()
    seats = seats.join(own.select(F.col("cid").alias("member"), "unit").join(floor, "member"), "member")
    seats = seats.withColumn("some", F.pmod(F.xxhash64("hub"), F.lit(-(-max(1, n) // HUBS))))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, same in pdf.groupby(pdf["unit"].str.len()):
            out += _around_hubs(same["hub"], same["member"].to_numpy(), _unit(same["unit"]), same["floor"].to_numpy())
        return pd.concat(out) if out else pd.DataFrame({"cid": [], "other": [], "sim": []})

    return seats.groupBy("some").applyInPandas(join, EDGE)


def _around_hubs(hubs: pd.Series, ids: np.ndarray, x: np.ndarray, floor: np.ndarray) -> list[pd.DataFrame]:
    """For each hub the edges from each of its members to the K most similar others, if they beat the member's floor.
    Hubs of equally many members are worked through together."""
    hub = pd.factorize(hubs)[0]
    order, sizes = np.argsort(hub, kind="stable"), np.bincount(hub)
    starts, out = np.cumsum(sizes) - sizes, []
    for size in np.unique(sizes[sizes > 1]):
        rows = order[starts[sizes == size][:, None] + np.arange(size)]
        sims = x[rows] @ x[rows].transpose(0, 2, 1)
        sims[:, np.arange(size), np.arange(size)] = -np.inf
        k = min(K, size - 1)
        at = np.argpartition(-sims, k - 1, axis=2)[:, :, :k]
        sim = np.take_along_axis(sims, at, axis=2)
        h, member, place = np.nonzero(sim > floor[rows][:, :, None])
        other = rows[h, at[h, member, place]]
        out.append(pd.DataFrame({"cid": ids[rows[h, member]], "other": ids[other], "sim": np.clip(sim[h, member, place], -1, 1)}))
    return out


def _audit(own: DataFrame, threshold: float) -> DataFrame:
    """All links (cid, other) of a bounded sample of classes, by comparing them with all rows."""
    sample = own.select("cid", "unit").orderBy(F.xxhash64("cid")).limit(AUDIT).collect()
    held = own.sparkSession.sparkContext.broadcast([(bytes(r["cid"]), bytes(r["unit"])) for r in sample])

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for size, same in pdf.groupby(pdf["unit"].str.len()):
                mine = [(c, u) for c, u in held.value if len(u) == size]
                if mine:
                    sims = _unit(same["unit"]) @ _unit(pd.Series([u for _, u in mine])).T
                    a, b = np.nonzero(sims >= threshold)
                    out = pd.DataFrame({"cid": [mine[j][0] for j in b], "other": same["cid"].to_numpy()[a], "sim": np.clip(sims[a, b], -1, 1)})
                    yield out[out["cid"] != out["other"]]

    return own.select("cid", "unit").mapInPandas(compare, EDGE)


def _joins_in_leaves(members: DataFrame, n: int, threshold: float, seed: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between labels of members (cid, label, unit) that meet in a leaf: in each, those that join
    components not yet joined there."""
    rows = _dealt_leaves(members.select("cid", "unit"), n, TREES, seed, scratch).join(members.select("cid", "label"), "cid")

    def leaf(pdf: pd.DataFrame) -> pd.DataFrame:
        code, names = pd.factorize(pdf["label"])
        x, joined, out = _unit(pdf["unit"]), np.arange(len(names)), []
        i, j = np.nonzero((x @ x.T >= threshold) & (code[:, None] < code))
        for a, b in np.unique(np.stack([code[i], code[j]]), axis=1).T.tolist():
            if joined[a] != joined[b]:
                joined[joined == joined[b]] = joined[a]
                out.append((names[a], names[b]))
        return pd.DataFrame(out, columns=["a", "b"], dtype=object)

    return rows.groupBy("tree", "code", "dim", "part").applyInPandas(leaf, "a binary, b binary")


def _joins_of_cells(members: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """All pairs (a, b) of labels of members (cid, label, unit) between which there is a link, by exact comparison."""
    parts = members.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    members = members.join(parts, "label").withColumn("cell", F.concat("label", F.encode(F.pmod(F.xxhash64("cid"), F.col("parts")).cast("string"), "UTF-8")))
    members = scratch.table(members.select("cell", "cid", "label", "unit"), "cells")

    def centre(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _unit(pdf["unit"])
        c = x.mean(axis=0)
        c = c / np.sqrt(c @ c) if c @ c > 0 else x[0]
        return pd.DataFrame({"cell": pdf["cell"].iloc[:1], "label": pdf["label"].iloc[:1], "centre": [c.astype("<f8").tobytes()], "reach": [float(np.arccos(np.clip(x @ c, -1, 1)).max())]})

    cells = scratch.table(members.groupBy("cell").applyInPandas(centre, "cell binary, label binary, centre binary, reach double"), "centres")
    blocks = max(1, -(-cells.count() // CENTRES))
    own = F.pmod(F.xxhash64("cell"), F.lit(blocks))
    dealt = cells.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select(F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "cell", "label", "centre", "reach")
    slack = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6

    def touching(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, same in pdf.groupby(pdf["centre"].str.len()):
            p, q = same[same["own"] == same["i"].iloc[0]], same[same["own"] == same["j"].iloc[0]]
            if len(p) and len(q):
                angle = np.arccos(np.clip(_unit(p["centre"]) @ _unit(q["centre"]).T, -1, 1))
                i, j = np.nonzero(angle <= p["reach"].to_numpy()[:, None] + q["reach"].to_numpy() + slack)
                found = pd.DataFrame({"p": p["cell"].to_numpy()[i], "q": q["cell"].to_numpy()[j], "a": p["label"].to_numpy()[i], "b": q["label"].to_numpy()[j]})
                found = found[found["a"] != found["b"]]
                out.append(found[found["p"] < found["q"]] if same["i"].iloc[0] == same["j"].iloc[0] else found)
        return pd.concat(out) if out else pd.DataFrame({"p": [], "q": [], "a": [], "b": []}, dtype=object)

    pairs = scratch.table(dealt.groupBy("i", "j").applyInPandas(touching, "p binary, q binary, a binary, b binary"), "touching")
    seats = pairs.select("p", "q", F.col("p").alias("cell")).union(pairs.select("p", "q", "q")).join(members, "cell")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf["cell"] == pdf["p"]
        p, q = pdf[first], pdf[~first]
        near = len(p) and len(q) and (_unit(p["unit"]) @ _unit(q["unit"]).T >= threshold).any()
        return pd.DataFrame({"a": [p["label"].iloc[0]] if near else [], "b": [q["label"].iloc[0]] if near else []}, dtype=object)

    return seats.groupBy("p", "q").applyInPandas(link, "a binary, b binary")


def _relabelled(labels: DataFrame, joins: DataFrame, scratch: Scratch) -> DataFrame:
    """The labels after components are joined by joins (a, b) of labels."""
    joins = scratch.table(joins.distinct(), "joins")
    if joins.isEmpty():
        return labels
    new = components(joins, scratch, "joined").select(F.col("node").alias("label"), F.col("label").alias("new"))
    return scratch.table(labels.join(new, "label", "left").select("node", F.coalesce("new", "label").alias("label")), "labels")


def _in_blocks(members: DataFrame, threshold: float) -> DataFrame:
    """(cid, n): links of each class inside its component, from blocks of (label, cid, copies, unit, parts)."""
    part = F.pmod(F.xxhash64("cid"), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = members.withColumn("part", part).withColumn("with", other)
    dealt = dealt.select("label", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "part", "cid", "copies", "unit")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        a, b = pdf[pdf["part"] == i], pdf[pdf["part"] == j]
        near = _unit(a["unit"]) @ _unit(b["unit"]).T >= threshold if len(a) and len(b) else np.zeros((len(a), len(b)), dtype=bool)
        if i == j:
            np.fill_diagonal(near, False)
            return pd.DataFrame({"cid": a["cid"].array, "n": near @ b["copies"].to_numpy()})
        return pd.DataFrame({"cid": [*a["cid"], *b["cid"]], "n": np.concatenate([near @ b["copies"].to_numpy(), near.T @ a["copies"].to_numpy()])})

    return dealt.groupBy("label", "i", "j").applyInPandas(count, "cid binary, n long").groupBy("cid").agg(F.sum("n").alias("n"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """One row per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors of different lengths link with nothing of another length. Null, empty and zero vectors and those with null
    or non-finite components link with nothing: n_links 0, component_id their vec_id. Repeated rows are vectors of
    their own: they link with each other, and are kept or dropped alike. A null vec_id never names a component, unless
    all members have none; then they are kept. Equal similarities are ordered by the vectors' ids; that decides only
    which candidates are tried first. Vectors may be of any length. An empty table gives an empty one; other columns are
    left out.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), plain(F.col("embedding")).alias("embedding"))
    scratch = Scratch(vectors.sparkSession, "embed-dedup")
    own = scratch.table(classes(vectors), "classes")
    n = own.count()
    units = own.select("cid", "unit")

    graph = scratch.table(_top(_leaves(units, n, TREES, 0, scratch), K), "graph")
    for _ in range(ROUNDS):
        graph = scratch.table(_top(graph.union(_descend(graph, units, n)), K), "graph")
        scratch.drop("graph", last=1)
    scratch.drop("leaves")
    truth = scratch.table(_audit(own, threshold), "audit")
    real = truth.count()
    for more in range(MORE + 1):
        links = scratch.table(_links(graph, truth, threshold), "links")
        labels = scratch.table(components(links, scratch), "labels")
        full = graph.groupBy("cid").agg(F.min("sim").alias("floor"), F.count("*").alias("k")).where((F.col("k") >= K) & (F.col("floor") >= threshold)).select("cid")
        if not real:
            break
        held = truth.join(full, "cid", "left_anti")  # those of saturated lists are all compared below
        wanted, got = held.count(), held.join(graph, ["cid", "other"], "left_semi").count()
        if got >= RECALL * wanted:
            break
        if more == MORE:
            full = units.select("cid")
            labels = full.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select(F.col("cid").alias("node"), F.coalesce("label", "cid").alias("label"))
            labels = scratch.table(labels, "labels")
            break
        graph = scratch.table(_top(graph.union(_leaves(units, n, TREES, more + 1, scratch)), K), "graph")
        graph = scratch.table(_top(graph.union(_descend(graph, units, n)), K), "graph")

    full = scratch.table(full, "saturated")
    saturated = lambda: labels.withColumnRenamed("node", "cid").join(full, "cid").join(units, "cid")
    labels = _relabelled(labels, _joins_in_leaves(saturated(), full.count(), threshold, MORE + 1, scratch), scratch)
    labels = _relabelled(labels, _joins_of_cells(saturated(), threshold, scratch), scratch)

    dense = labels.join(full.withColumnRenamed("cid", "node"), "node").select("label").distinct()
    sizes = labels.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).alias("parts")).join(dense, "label")
    members = labels.join(sizes, "label").join(own.select(F.col("cid").alias("node"), "copies", "unit"), "node").withColumnRenamed("node", "cid")
    in_dense = scratch.table(_in_blocks(members.select("label", "cid", "copies", "unit", "parts"), threshold), "dense")
    both = links.select(F.col("a").alias("cid"), F.col("b").alias("other")).union(links.select("b", "a")).distinct()
    in_lists = both.join(own.select(F.col("cid").alias("other"), "copies"), "other").groupBy("cid").agg(F.sum("copies").alias("listed"))

    of_class = own.select("cid", "first", "copies").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = of_class.groupBy("label").agg(F.min("first").alias("component_id"))
    of_class = of_class.join(least, "label").join(in_lists, "cid", "left").join(in_dense, "cid", "left")
    of_class = scratch.table(of_class.select("cid", "component_id", (F.coalesce("n", "listed", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "result")
    scratch.keep("result")
    out = vectors.select("vec_id", class_id(F.col("embedding")).alias("cid")).join(of_class, "cid", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _links(graph: DataFrame, truth: DataFrame, threshold: float) -> DataFrame:
    every = graph.where(F.col("sim") >= threshold).union(truth)
    return every.select(F.least("cid", "other").alias("a"), F.greatest("cid", "other").alias("b")).distinct()
