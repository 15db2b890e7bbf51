"""ML7: random forests of many fits, one task per few trees of a fit.

Every tree is grown on a bootstrap of all training rows of its fit.  The rows reach a task in
blocks and are held there as plain arrays, once for all its trees.  Nodes split on the best
Gini gain among about sqrt(d) random features, until they are pure; the nodes of a level, of
several trees, are split together.  Held-out rows pass block by block through every part of
the forest, which is read once, and the parts are averaged by an aggregation.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionpulse.operators.batched import KEYS, X, blocks


Tree = tuple[np.ndarray, ...]


def _ranks(x: np.ndarray) -> np.ndarray:
    """(d, n): the rank of every value among the distinct values of its column."""
    out = np.zeros(x.shape[::-1], np.int32)
    for f in range(x.shape[1]):
        order = x[:, f].argsort(kind="stable")
        v = x[order, f]
        out[f, order[1:]] = (v[1:] > v[:-1]).cumsum()
    return out


def grow_together(x: np.ndarray, y: np.ndarray, times: np.ndarray, rngs: Sequence[np.random.Generator], tried: int, most_depth: int, ranks: np.ndarray | None = None) -> list[Tree]:
    """A tree for each row of ``times``, which says how often it holds each row of ``x``:
    (feature, threshold, left, right, share of class 1) of the nodes; feature -1: a leaf.

    All nodes of a level are split in the same sorts, and ``rngs`` (one a tree) draw the
    features of a level, so a tree does not depend on the others."""
    d, ranks = x.shape[1], _ranks(x) if ranks is None else ranks
    tree, row = times.nonzero()
    w = times[tree, row].astype(float)
    wy = w * y[row]
    node, of = tree, np.arange(len(times))  # of each held row: its node; of each node: its tree
    levels, known = [], 0
    while len(of):
        total, ones = np.bincount(node, w, len(of)), np.bincount(node, wy, len(of))
        feature, threshold, left = np.full(len(of), -1, np.int8), np.zeros(len(of)), np.zeros(len(of), np.int64)
        levels.append((of, feature, threshold, left, ones / total))
        mixed = np.flatnonzero((ones > 0) & (ones < total)) if len(levels) <= most_depth else []
        if not len(mixed):
            break
        # from here on nodes are places in ``mixed``
        place = np.full(len(of), -1)
        place[mixed] = np.arange(len(mixed))
        inner = place[node] >= 0
        node, row, w, wy = place[node[inner]], row[inner], w[inner], wy[inner]
        total, ones, of = total[mixed], ones[mixed], of[mixed]
        drawn = np.vstack([rngs[t].random((k, d)) for t, k in zip(*np.unique(of, return_counts=True))]).argsort(axis=1)
        best, split, at = np.full(len(mixed), -np.inf), np.full(len(mixed), -1), np.zeros(len(mixed))
        looked = np.zeros(len(mixed), np.int64)
        for j in range(d):
            todo = looked < tried
            if not todo.any():
                break
            some = slice(None) if todo.all() else np.flatnonzero(todo[node])
            key = node[some] * np.int64(len(x)) + ranks[drawn[node[some], j], row[some]]
            order = key.argsort()
            key, s = key[order], node[some][order]
            cut = np.flatnonzero((key[1:] > key[:-1]) & (s[1:] == s[:-1]))
            if not len(cut):
                continue  # a constant feature is no candidate
            sc = s[cut]
            before = lambda sums: np.where(todo, sums, 0).cumsum() - sums
            n_left, a = w[some][order].cumsum()[cut] - before(total)[sc], wy[some][order].cumsum()[cut] - before(ones)[sc]
            n_right, b = total[sc] - n_left, ones[sc] - a
            gain = (a * a + (n_left - a) ** 2) / n_left + (b * b + (n_right - b) ** 2) / n_right
            first = np.flatnonzero(np.r_[True, sc[1:] > sc[:-1]])
            top = np.maximum.reduceat(gain, first)
            hit = np.flatnonzero(gain == np.repeat(top, np.diff(np.r_[first, len(sc)])))
            hit = hit[np.r_[True, sc[hit[1:]] > sc[hit[:-1]]]]
            has = sc[first]
            looked[has] += 1
            better = top > best[has]
            has, hit = has[better], cut[hit[better]]
            f, rows = drawn[has, j], row[some][order]
            low, high = x[rows[hit], f], x[rows[hit + 1], f]
            middle = low / 2 + high / 2
            best[has], split[has], at[has] = top[better], f, np.where((low <= middle) & (middle < high), middle, low)
        cuts = split >= 0
        known += len(place)
        feature[mixed], threshold[mixed] = split, at
        left[mixed[cuts]] = known + 2 * np.arange(cuts.sum())
        below = cuts.cumsum() - 1
        inner = cuts[node]
        node, row, w, wy = node[inner], row[inner], w[inner], wy[inner]
        node = 2 * below[node] + ~(x[row, split[node]] <= at[node])
        of = np.repeat(of[cuts], 2)
    of, feature, threshold, left, share = (np.concatenate(v) for v in zip(*levels))
    # the nodes of each tree by themselves; brothers stay side by side
    order = of.argsort(kind="stable")
    starts = np.searchsorted(of[order], np.arange(len(times) + 1))
    own = np.empty(len(of), np.int64)
    own[order] = np.arange(len(of)) - starts[of[order]]
    left = np.where(feature >= 0, own[left], 0)
    right = np.where(feature >= 0, left + 1, 0)
    return [tuple(v[order[lo:hi]] for v in (feature, threshold, left, right, share)) for lo, hi in zip(starts[:-1], starts[1:])]


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, tried: int, most_depth: int) -> Tree:
    """The tree that holds every row once."""
    return grow_together(x, y, np.ones((1, len(y)), np.int64), [rng], tried, most_depth)[0]


def bootstrap_trees(x: np.ndarray, y: np.ndarray, numbers: Sequence[int], seed: int, tried: int, most_depth: int, most_pairs: int = 1 << 17) -> list[Tree]:
    """The trees of these numbers, each on a bootstrap of all rows; as many grow together as
    hold about ``most_pairs`` rows, at least one."""
    ranks, out, at_once = _ranks(x), [], max(1, most_pairs // len(y))
    for k in range(0, len(numbers), at_once):
        rngs = [np.random.default_rng([seed, t]) for t in numbers[k:k + at_once]]
        times = np.stack([np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)) for rng in rngs])
        out += grow_together(x, y, times, rngs, tried, most_depth, ranks)
    return out


def pack(trees: Sequence[Tree]) -> bytes:
    """13 bytes a node: feature, left child (the right one is the next), threshold or a leaf's share."""
    return pickle.dumps([(f, np.where(f >= 0, at, share), low.astype(np.int32)) for f, at, low, _, share in trees])


def unpack(packed: bytes) -> Iterator[Tree]:
    for f, value, low in pickle.loads(packed):
        yield f, value, low, low + 1, value


def shares(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    feature, threshold, left, right, share = tree
    at = np.zeros(len(x), np.int64)
    while True:
        inner = np.flatnonzero(feature[at] >= 0)
        if not len(inner):
            return share[at]
        f = feature[at[inner]]
        low = x[inner, f] <= threshold[at[inner]]
        at[inner] = np.where(low, left[at[inner]], right[at[inner]])


def fit(train: DataFrame, by: Sequence[str] = KEYS, columns: Sequence[str] = X, trees: int = 200, trees_per_task: int = 25,
        most_depth: int = 30, seed: int = 0, block_rows: int = 8192, tasks: int = 64) -> DataFrame:
    """(by..., part, grown): the forest of every fit in parts of ``trees_per_task`` trees."""
    by, d = list(by), len(columns)
    parts = blocks(train, by, columns, block_rows, seed=seed).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(-(-trees // trees_per_task) - 1))))
    # a part's task sees all rows of the fit, block by block
    parts = parts.repartition(tasks, *by, "part").sortWithinPartitions(*by, "part", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _runs(batches, [*by, "part"], ["x", "label"]):
            x, y = (np.concatenate(v) for v in zip(*rows))
            part = key[-1].as_py()
            grown = bootstrap_trees(x.reshape(-1, d), y, range(part * trees_per_task, min(trees, (part + 1) * trees_per_task)), seed, max(1, int(d ** 0.5)), most_depth)
            yield pa.RecordBatch.from_arrays([*[pa.array([v.as_py()], v.type) for v in key], pa.array([pack(grown)], pa.binary())], names=[*by, "part", "grown"])

    types = {f.name: f.dataType.simpleString() for f in train.schema}
    fields = ", ".join(f"`{b}` {types[b]}" for b in by)
    return parts.select(*by, "part", "label", "x").mapInArrow(run, f"{fields}, part int, grown binary")


def _runs(batches: Iterator[pa.RecordBatch], by: Sequence[str], columns: Sequence[str]) -> Iterator[tuple[tuple, list]]:
    """(key, [arrays of ``columns`` of each row]) of the runs of rows with equal keys, across batches."""
    at, held = None, []
    for batch in batches:
        n = batch.schema.get_field_index
        for k in range(batch.num_rows):
            key = tuple(batch.column(n(b))[k] for b in by)
            if key != at and held:
                yield at, held
                held = []
            at = key
            held.append([np.array(batch.column(n(c))[k].values) for c in columns])
    if held:
        yield at, held


def scores(held: DataFrame, model: DataFrame, by: Sequence[str] = KEYS, columns: Sequence[str] = X, block_rows: int = 8192, tasks: int = 64) -> DataFrame:
    """(by..., label, score, prediction): score is the mean share of class 1 over all trees."""
    by, d = list(by), len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: list[Tree] = []
        for batch in batches:
            n = batch.schema.get_field_index
            for k in range(batch.num_rows):
                grown = batch.column(n("grown"))[k]
                if grown.is_valid:  # a part of a forest comes before the rows it scores
                    trees = list(unpack(grown.as_py()))
                    continue
                x = np.array(batch.column(n("x"))[k].values).reshape(-1, d)
                total = sum(shares(tree, x) for tree in trees)
                at = pa.array(np.full(len(x), k))
                label = pa.array(np.array(batch.column(n("label"))[k].values).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*[batch.column(n(b)).take(at) for b in [*by, "block"]], pa.array(np.arange(len(x), dtype=np.int32)), label, pa.array(total), pa.array(np.full(len(x), len(trees)))],
                                                 names=[*by, "block", "place", "label", "total", "trees"])

    types = {f.name: f.dataType.simpleString() for f in held.schema}
    fields = ", ".join(f"`{b}` {types[b]}" for b in by)
    empty = F.lit(None).cast("array<double>")
    rows = blocks(held, by, columns, block_rows).join(model.select(*by, "part"), by).select(*by, "part", "block", "label", "x", F.lit(None).cast("binary").alias("grown"))
    # a part goes to one task, which the blocks of its fit pass through: no block takes a copy of the forest along
    both = rows.unionByName(model.select(*by, "part", F.lit(-1).alias("block"), empty.alias("label"), empty.alias("x"), "grown"))
    scored = both.repartition(tasks, *by, "part").sortWithinPartitions(*by, "part", "block").mapInArrow(run, f"{fields}, block int, place int, label int, total double, trees long")
    mean = scored.groupBy(*by, "block", "place", "label").agg((F.sum("total") / F.sum("trees")).alias("score"))
    return mean.select(*by, "label", "score", (F.col("score") > 0.5).cast("int").alias("prediction"))
