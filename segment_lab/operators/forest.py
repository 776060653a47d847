"""Random forest whose trees grow in groups of bounded rows (L4, M7).

Settings and model are those of Spark ML's classifier: features in at most
about 32 bins by quantiles, bootstrap weights by Poisson draws, the square
root of the features tried at a node, Gini gain, leaves with weighted class
shares.  Spark's fit sends dense statistics of every node from every
partition, which for deep trees is far more than the rows.  Here only nodes
of many rows are split by summed statistics; a smaller node's rows meet in
one group, which grows the rest of its tree by sorting them.

Bootstrap draws depend on the row and the tree, the tried features on the
node: neither on the layout of the table.  The finished trees, some ten bytes
a node, are a written table; to score rows they are sent to the tasks a few
trees at a time, so the driver never holds them all.
"""

from __future__ import annotations

from math import ceil, exp, factorial, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.base import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import checked_collect
from ..session import SENT_BYTES, drop_paths, free_shuffles, materialize, scratch_path, ship_package

#: Bins of a feature by quantiles (a value that fills a bin gets one more cut).
BINS = 32
#: Rows (drawn) of a node up to which its subtree is grown in one group; and how many such groups a tree may need at most, about.
GROUP_ROWS, GROUPS = 16_384, 64
#: Cumulative shares of the Poisson(1) draws.
_POISSON = np.cumsum([exp(-1.0) / factorial(i) for i in range(12)])
_MASK = (1 << 64) - 1


def _draws(row: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row (a 64-bit hash) is drawn for a tree."""
    salt = ((seed & 0xFFFFFFFF) << 32 ^ (tree + 1) * 0x9E3779B97F4A7C15) & _MASK
    z = row.view(np.uint64) ^ np.uint64(salt)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * (1.0 / (1 << 53))
    return np.searchsorted(_POISSON, u, side="right").astype(np.uint8)


def _tried(rng, nodes: int, d: int, tries: int) -> np.ndarray:
    """Features tried at each node (rows), without repeats."""
    return np.argsort(rng.random((nodes, d)), axis=1)[:, :tries] if tries < d else np.tile(np.arange(d), (nodes, 1))


def _gain(left: np.ndarray, total: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Gini gain times the weight of the node, of splits given by the class counts (rows) of the left side and of the node."""
    def spread(counts):
        w = counts * weights
        n = w.sum(axis=-1)
        return n - (w * w).sum(axis=-1) / np.where(n > 0, n, 1.0)
    return spread(total) - spread(left) - spread(total - left)


class Tree:
    """Nodes in arrays.  ``feature`` -1 marks a leaf: its ``child`` is a class, or ~ the row of ``shares``; else the left child (the right one follows)."""

    def __init__(self, feature, cut, child, shares):
        self.feature, self.cut, self.child, self.shares = feature, cut, child, shares

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node each row (of bins) ends at."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(rows):
            here = at[rows]
            rows = rows[self.feature[here] >= 0]
            here = at[rows]
            at[rows] = self.child[here] + (bins[rows, self.feature[here]] > self.cut[here])
        return at

    def add(self, bins: np.ndarray, votes: np.ndarray) -> None:
        """Add each row's class shares to ``votes``."""
        says, rows = self.child[self.leaves(bins)], np.arange(len(bins))
        sure = says >= 0
        votes[rows[sure], says[sure]] += 1.0
        votes[~sure] += self.shares[~says[~sure]]


def grow(bins: np.ndarray, y: np.ndarray, drawn: np.ndarray, weights: np.ndarray, tries: int, levels: int, rng):
    """``(tree, importance)`` grown on rows drawn so often, at most ``levels`` deep: all nodes of a level at once."""
    d, k = bins.shape[1], len(weights)
    hot = np.zeros((len(y), k))
    hot[np.arange(len(y)), y] = drawn
    rows, node, m, base, importance = np.arange(len(y)), np.zeros(len(y), np.int64), 1, 0, np.zeros(d)
    out, shares = [], []
    for level in range(levels + 1):
        total = np.bincount(node * k + y[rows], drawn[rows], m * k).reshape(m, k)
        feature, cut, child = np.full(m, -1, np.int32), np.zeros(m, np.uint8), total.argmax(axis=1).astype(np.int32)
        open_ = np.flatnonzero((total > 0).sum(axis=1) > 1) if level < levels else np.zeros(0, np.int64)
        if len(open_):
            number = np.full(m, -1)
            number[open_] = np.arange(len(open_))
            own = np.flatnonzero(number[node] >= 0)
            at, r = number[node[own]], rows[own]
            first = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(open_)))[:-1]])
            best, tried = np.full(len(open_), 1e-12), _tried(rng, len(open_), d, tries)
            for s in range(tried.shape[1]):
                key = at * 256 + bins[r, tried[at, s]]
                order = np.argsort(key, kind="stable")
                key, run = key[order], np.cumsum(hot[r[order]], axis=0)
                ends = np.flatnonzero((key[1:] != key[:-1]) & (key[1:] >> 8 == key[:-1] >> 8))
                if not len(ends):
                    continue
                of = key[ends] >> 8
                before = np.concatenate([np.zeros((1, k)), run])[first]
                gain = _gain(run[ends] - before[of], total[open_[of]], weights)
                start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                most = np.maximum.reduceat(gain, start)
                top = np.flatnonzero(gain == np.repeat(most, np.diff(np.append(start, len(of)))))
                one = top[np.unique(of[top], return_index=True)[1]]  # the first of the best
                better = one[gain[one] > best[of[one]]]
                n = of[better]
                best[n], feature[open_[n]], cut[open_[n]] = gain[better], tried[n, s], key[ends[better]] & 255
            split = np.flatnonzero(feature >= 0)
            np.add.at(importance, feature[split], best[number[split]])
        split = np.flatnonzero(feature >= 0)
        mixed = np.flatnonzero((feature < 0) & ((total > 0).sum(axis=1) > 1))
        child[mixed] = ~(np.arange(len(mixed)) + sum(map(len, shares)))
        w = total[mixed] * weights
        shares.append(w / w.sum(axis=1, keepdims=True))
        child[split] = base + m + 2 * np.arange(len(split))
        out.append((feature, cut, child))
        if not len(split):
            break
        below = np.full(m, -1)
        below[split] = 2 * np.arange(len(split))
        keep = below[node] >= 0
        rows, node = rows[keep], node[keep]
        node = below[node] + (bins[rows, feature[node]] > cut[node])
        base, m = base + m, 2 * len(split)
    return Tree(*(np.concatenate(v) for v in zip(*out)), np.concatenate(shares)), importance


def _cuts(rows: DataFrame, d: int) -> list[np.ndarray]:
    """Per feature the values up to which rows go left: all but the last of few values, else about equal shares of the rows."""
    long = rows.select(F.posexplode("x").alias("at", "v"))
    shares = [i / BINS for i in range(1, BINS)]
    found = {r["at"]: r["q"] for r in long.groupBy("at").agg(F.percentile_approx("v", shares, 10_000).alias("q")).collect()}  # a row a feature
    few = [j for j, q in found.items() if len(set(q)) < len(q)]
    values = {}
    if few:
        sparse = long.where(F.col("at").isin(few))
        short = [r["at"] for r in sparse.groupBy("at").agg(F.approx_count_distinct("v").alias("n")).where(F.col("n") <= 2 * BINS).collect()]
        for r in checked_collect(sparse.where(F.col("at").isin(short)).distinct(), 4 * BINS * d, "values of features with few values") if short else []:
            values.setdefault(r["at"], []).append(r["v"])
    out = []
    for j in range(d):
        if j in values and len(values[j]) <= BINS:
            out.append(np.sort(np.array(values[j], float))[:-1])
            continue
        q, times = np.unique(np.array(found[j], float), return_counts=True)
        out.append(np.unique(np.concatenate([q, np.nextafter(q[times > 1], -np.inf)])))  # a frequent value is cut off on both sides
    return out


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1).astype(np.uint8)


class _Tops:
    """What summed statistics decided, for each tree: splits, node -> (feature, cut), and leaves, node -> class counts.

    The root is 1, the children of node i are 2i and 2i + 1.
    """

    def __init__(self, trees: int):
        self.splits, self.leaves = [{} for _ in range(trees)], [{} for _ in range(trees)]

    def route(self, tree: int, bins: np.ndarray) -> np.ndarray:
        """The node each row has come to."""
        at = np.ones(len(bins), np.int64)
        for number, (feature, cut) in sorted(self.splits[tree].items()):  # parents before their children
            own = np.flatnonzero(at == number)
            at[own] = 2 * number + (bins[own, feature] > cut)
        return at


def _packed(d: int) -> np.dtype:
    return np.dtype([("row", "<i8"), ("y", "<i2"), ("drawn", "u1"), ("bins", "u1", (d,))])


def _best_splits(data: DataFrame, packed: np.dtype, tops: _Tops, nodes: list[tuple], weights: np.ndarray, slots: int, tries: int, seed: int) -> DataFrame:
    """The best split of each of ``nodes`` (tree, node), from class counts by tried feature and bin that every task sums over its rows."""
    k, d = len(weights), packed["bins"].shape[0]
    of_tree: dict[int, list[int]] = {}
    for t, number in nodes:
        of_tree.setdefault(t, []).append(number)

    def tried(t: int, number: int) -> np.ndarray:
        return _tried(np.random.default_rng([seed, t, number, 1]), 1, d, tries)[0]

    def count(batches):
        counts = {}
        for b in batches:
            for blob in b.column("rows"):
                own = np.frombuffer(blob.as_buffer(), packed)
                for t, numbers in of_tree.items():
                    drawn = _draws(own["row"], t, seed)
                    some = own[drawn > 0]
                    drawn, at = drawn[drawn > 0], tops.route(t, some["bins"])
                    for number in numbers:
                        here = np.flatnonzero(at == number)
                        sums = counts.setdefault((t, number), np.zeros((tries, slots * k)))
                        for s, j in enumerate(tried(t, number)):
                            sums[s] += np.bincount(some["bins"][here, j].astype(np.int64) * k + some["y"][here], drawn[here], slots * k)
        for (t, number), sums in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([number], pa.int64()), pa.array([sums.tobytes()], pa.binary())], ["tree", "node", "sums"])

    def best(table: pa.Table) -> pa.Table:
        t, number = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        sums = sum(np.frombuffer(v.as_buffer()) for v in table.column("sums")).reshape(tries, slots, k)
        total, left = sums[0].sum(axis=0), np.cumsum(sums, axis=1)[:, :-1]
        gain = np.where((left.sum(axis=2) > 0) & (left.sum(axis=2) < total.sum()), _gain(left, total, weights), -1.0)
        s, cut = np.unravel_index(gain.argmax(), gain.shape) if gain.size else (0, 0)
        most = float(gain[s, cut]) if gain.size else -1.0
        split = most > 1e-12 and (total > 0).sum() > 1
        n_left = float(left[s, cut].sum()) if split else 0.0
        return pa.table({"tree": pa.array([t], pa.int32()), "node": pa.array([number], pa.int64()), "feature": pa.array([int(tried(t, number)[s]) if split else -1], pa.int32()),
                         "cut": pa.array([int(cut)], pa.int32()), "gain": [most], "n_left": [n_left], "n_right": [float(total.sum()) - n_left],
                         "total": pa.array([total.tolist()], pa.list_(pa.float64()))})

    return data.mapInArrow(count, "tree int, node long, sums binary").groupBy("tree", "node").applyInArrow(
        best, "tree int, node long, feature int, cut int, gain double, n_left double, n_right double, total array<double>")


def _subtrees(data: DataFrame, packed: np.dtype, tops: _Tops, weights: np.ndarray, tries: int, max_depth: int, seed: int) -> DataFrame:
    """The subtree below every node that is not decided: its drawn rows meet in one group."""
    trees = len(tops.splits)

    def deal(batches):
        for b in batches:
            for blob in b.column("rows"):
                own = np.frombuffer(blob.as_buffer(), packed)
                for t in range(trees):
                    drawn = _draws(own["row"], t, seed)
                    some = own[drawn > 0].copy()
                    some["drawn"] = drawn[drawn > 0]
                    at = tops.route(t, some["bins"])
                    numbers = [v for v in np.unique(at).tolist() if v not in tops.leaves[t]]
                    yield pa.RecordBatch.from_arrays([pa.array([t] * len(numbers), pa.int32()), pa.array(numbers, pa.int64()),
                                                      pa.array([some[at == v].tobytes() for v in numbers], pa.binary())], ["tree", "node", "rows"])

    def finish(table: pa.Table) -> pa.Table:
        t, number = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        rows = np.concatenate([np.frombuffer(v.as_buffer(), packed) for v in table.column("rows")])
        rows = rows[np.argsort(rows["row"], kind="stable")]
        tree, importance = grow(rows["bins"], rows["y"].astype(np.int64), rows["drawn"], weights, tries, max_depth + 1 - number.bit_length(), np.random.default_rng([seed, t, number]))
        parts = {"feature": tree.feature, "cut": tree.cut, "child": tree.child, "shares": tree.shares, "importance": importance}
        return pa.table({"tree": pa.array([t], pa.int32()), "node": pa.array([number], pa.int64()), **{c: pa.array([v.tobytes()], pa.binary()) for c, v in parts.items()}})

    return data.mapInArrow(deal, "tree int, node long, rows binary").groupBy("tree", "node").applyInArrow(
        finish, "tree int, node long, feature binary, cut binary, child binary, shares binary, importance binary")


def _joined(splits: dict, leaves: dict, below: dict[int, Tree], weights: np.ndarray) -> Tree:
    """One tree of the decided nodes and the subtrees below them."""
    order, feature, cut, child = [1], [], [], []
    for number in order:  # grows as it is read
        f, c = splits.get(number, (-1, 0))
        feature.append(f), cut.append(c), child.append(len(order))
        order += [2 * number, 2 * number + 1] if number in splits else []
    parts, shares = [[np.array(feature, np.int32), np.array(cut, np.uint8), np.array(child, np.int32)]], [np.zeros((0, len(weights)))]
    for place, number in enumerate(order):
        n, known = sum(len(p[0]) for p in parts), sum(map(len, shares))
        if number in below:
            sub = below[number]
            moved = np.where(sub.feature >= 0, sub.child + n - 1, np.where(sub.child < 0, sub.child - known, sub.child)).astype(np.int32)
            for whole, own in zip(parts[0], (sub.feature, sub.cut, moved)):
                whole[place] = own[0]
            parts.append([sub.feature[1:], sub.cut[1:], moved[1:]])
            shares.append(sub.shares)
        elif number not in splits:  # a leaf, or a tree for which no row was drawn: it has no vote
            w = leaves.get(number, np.zeros(len(weights))) * weights
            parts[0][2][place] = ~known
            shares.append((w / (w.sum() or 1.0))[None, :])
    return Tree(*(np.concatenate(v) for v in zip(*parts)), np.concatenate(shares))


class ForestClassifier(Estimator):
    """A forest on a vector column; a row's weight depends on its class alone, and its draws on the row with its id, if there is one."""

    def __init__(self, features: str = "features", label: str = "label", weight: str = "weight", id_col: str = "id", trees: int = 100,
                 max_depth: int = 30, seed: int = 1987, group_rows: int = GROUP_ROWS):
        super().__init__()
        self.features, self.label, self.weight, self.id_col = features, label, weight, id_col
        self.trees, self.max_depth, self.seed, self.group_rows = trees, max_depth, seed, group_rows

    def _classes(self, df: DataFrame) -> tuple[np.ndarray, int]:
        """The weight of each class, and the number of rows."""
        own = df.groupBy(F.col(self.label).cast("int").alias("y")).agg(
            F.count(F.lit(1)).alias("n"), F.min(self.weight).alias("low"), F.max(self.weight).alias("high")).collect()  # a row a class
        if any(r["low"] != r["high"] for r in own):
            raise ValueError("rows of one class have different weights")
        named = df.schema[self.label].metadata.get("ml_attr", {}).get("vals", [])
        weights = np.zeros(max([len(named), *(r["y"] + 1 for r in own)]))
        for r in own:
            weights[r["y"]] = r["low"]
        return weights, sum(r["n"] for r in own)

    def _fit(self, dataset: DataFrame) -> ForestModel:
        ship_package(dataset.sparkSession)
        d = len(dataset.select(self.features).first()[0])
        weights, n = self._classes(dataset)
        keys = [F.col(c) for c in (self.id_col,) if c in dataset.columns]
        rows = dataset.select(vector_to_array(self.features).alias("x"), F.col(self.label).cast("int").alias("y"), *keys)
        cuts, packed, tries = _cuts(rows, d), _packed(d), ceil(sqrt(d))

        def pack(batches):
            for b in batches:
                own = np.zeros(b.num_rows, packed)
                own["row"], own["y"] = b.column("row").to_numpy(), b.column("y").to_numpy()
                own["bins"] = _binned(b.column("x").flatten().to_numpy().reshape(b.num_rows, d), cuts)
                yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], ["rows"])

        # a row of ``data`` holds a batch of rows in bins
        data = materialize(rows.select(F.xxhash64(*keys, "x", "y").alias("row"), "x", "y").mapInArrow(pack, "rows binary"))
        tops, gains, most = _Tops(self.trees), np.zeros((self.trees, d)), max(self.group_rows, n // GROUPS)
        wide = [(t, 1) for t in range(self.trees)] if n > most and self.max_depth else []
        while wide:
            found = _best_splits(data, packed, tops, wide, weights, max(map(len, cuts)) + 1, tries, self.seed).collect()  # a row a node of many rows
            wide = []
            for r in found:
                t, number = r["tree"], r["node"]
                if r["feature"] < 0:
                    tops.leaves[t][number] = np.array(r["total"])
                    continue
                tops.splits[t][number] = (r["feature"], r["cut"])
                gains[t, r["feature"]] += r["gain"]
                wide += [(t, 2 * number + side) for side, rows_of in enumerate((r["n_left"], r["n_right"])) if rows_of > most and number.bit_length() < self.max_depth]
        path = scratch_path(dataset.sparkSession, "forest")
        below = _subtrees(data, packed, tops, weights, tries, self.max_depth, self.seed)
        below.repartition("tree").write.partitionBy("tree").parquet(path)
        below = dataset.sparkSession.read.schema(below.schema).parquet(path)
        for r in below.select("tree", "importance").collect():  # a row a group
            gains[r["tree"]] += np.frombuffer(r["importance"])
        # as in Spark: each tree's gains sum to one, and so do the means of the trees
        gains = (gains / np.maximum(gains.sum(axis=1, keepdims=True), 1e-300)).sum(axis=0)
        free_shuffles(dataset.sparkSession)
        return ForestModel(self.features, below, path, tops, weights, cuts, gains / (gains.sum() or 1.0))


class ForestModel(Model):
    """Adds ``probability`` (the mean of the trees' class shares) and ``prediction`` (the first most probable class).

    ``below``, written under ``path``, has the subtrees below what ``tops`` decided.
    """

    def __init__(self, features: str, below: DataFrame, path: str, tops: _Tops, weights: np.ndarray, cuts: list[np.ndarray], importances: np.ndarray):
        super().__init__()
        self.features, self.below, self.path, self.tops, self.weights, self.cuts = features, below, path, tops, weights, cuts
        self.numClasses, self.numFeatures = len(weights), len(cuts)
        self.featureImportances, self._sent = Vectors.dense(importances), None

    def grown(self, numbers: list[int]) -> list[Tree]:
        """Some of the trees."""
        below: dict[int, dict] = {t: {} for t in numbers}
        for r in self.below.where(F.col("tree").isin(numbers)).select("tree", "node", "feature", "cut", "child", "shares").collect():
            below[r["tree"]][r["node"]] = Tree(np.frombuffer(r["feature"], np.int32), np.frombuffer(r["cut"], np.uint8), np.frombuffer(r["child"], np.int32),
                                               np.frombuffer(r["shares"]).reshape(-1, self.numClasses))
        return [_joined(self.tops.splits[t], self.tops.leaves[t], below[t], self.weights) for t in numbers]

    @property
    def trees(self) -> list[Tree]:
        """All trees, read anew: as large as the forest."""
        return self.grown(list(range(len(self.tops.splits))))

    def pieces(self) -> list[list[int]]:
        """The trees in runs of at most ``SENT_BYTES`` (or of one tree)."""
        size = sum(F.length(c) for c in ("feature", "cut", "child", "shares"))
        bytes_of = {r["tree"]: r["bytes"] for r in self.below.groupBy("tree").agg(F.sum(size).alias("bytes")).collect()}  # a row a tree
        out, room = [], 0
        for t in range(len(self.tops.splits)):
            own = bytes_of.get(t, 0)
            if not out or own > room:
                out.append([])
                room = SENT_BYTES
            out[-1].append(t)
            room -= own
        return out

    def drop(self) -> None:
        """Delete the trees, here and in the tasks; the rows they scored must be stored."""
        for piece in self._sent or []:
            piece.destroy()
        self._sent = None
        drop_paths(self.path)

    def getFeaturesCol(self) -> str:
        return self.features

    def getProbabilityCol(self) -> str:
        return "probability"

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self._sent is None:
            self._sent = [dataset.sparkSession.sparkContext.broadcast(self.grown(piece)) for piece in self.pieces()]
        sent, cuts, classes = self._sent, self.cuts, self.numClasses

        @F.pandas_udf("array<double>")
        def shares(x: pd.Series) -> pd.Series:
            votes = np.zeros((len(x), classes))
            if len(x):
                bins = _binned(np.stack(x.to_numpy()), cuts)
                for piece in sent:
                    for tree in piece.value:
                        tree.add(bins, votes)
                votes /= np.maximum(votes.sum(axis=1, keepdims=True), 1e-300)
            return pd.Series(list(votes))

        scored = dataset.withColumn("__shares", shares(vector_to_array(self.features)))
        return scored.withColumn("probability", array_to_vector("__shares")) \
            .withColumn("prediction", (F.array_position("__shares", F.array_max("__shares")) - 1).cast("double")).drop("__shares")
