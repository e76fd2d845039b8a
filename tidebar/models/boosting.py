"""Gradient boosting on binned features; the trees of many tasks (folds, classes, parameter sets) grow side by side.

Rows are binned once and lie in chunks, with one score a task. A task trains on a range of times, so no row is copied for it. Each
level of all trees is one job: chunks give histograms of (tree, node, feature, bin), a shuffle adds them up, and only the
best split of each node reaches the driver. Chunks of a few thousand rows bound the memory of a task.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.session import materialize

# functions that run in tasks travel with the task, so executors need no copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a chunk, cut points of a feature from all prefixes of the rows, growth of these prefixes, and their number at most.
CHUNK, CUTS, GROWTH, PREFIXES = 4096, 64, 1.3, 4
#: Gradients are whole multiples of this, so that sums do not depend on their order; trees between two written states.
GRAIN, WRITE_EVERY = 2.0**-16, 25

DEFAULTS = {
    "n_estimators": 500, "max_depth": 6, "learning_rate": 0.05, "num_leaves": 31, "subsample": 0.8, "colsample_bytree": 0.8,
    "min_child_samples": 20, "reg_alpha": 0.1, "reg_lambda": 0.1, "random_state": 42, "early_stopping_rounds": None,
}


@dataclass
class Task:
    """What one model trains on: times before ``end`` (null: all) but for those in ``skip``; times from ``held_from`` on only
    tell when to stop."""

    end: int | None = None
    skip: tuple[int, int] | None = None
    held_from: int | None = None
    params: dict[str, Any] = field(default_factory=dict)

    def rows(self, df: DataFrame, row: str = "row_idx") -> DataFrame:
        """The rows to fit and to hold out, as a DataFrame."""
        at = F.col(row)
        df = df if self.end is None else df.filter(at < self.end)
        return df.filter((at < self.skip[0]) | (at >= self.skip[1])) if self.skip else df

    def masks(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows to fit, and rows to hold out."""
        inside = np.ones(len(row), bool) if self.end is None else row < self.end
        if self.skip:
            inside &= (row < self.skip[0]) | (row >= self.skip[1])
        held = inside & (row >= self.held_from) if self.held_from is not None else np.zeros(len(row), bool)
        return inside & ~held, held


@dataclass
class Booster:
    """A trained model: for each class column a list of trees (feature, cut value, leaf value, in heap order)."""

    features: list[str]
    objective: str  # binary, classes or value
    base: list[float]
    trees: list[list[tuple[list[int], list[float], list[float]]]]
    losses: list[float] = field(default_factory=list)

    @property
    def rounds(self) -> int:
        return max((len(t) for t in self.trees), default=0)

    def importances(self) -> list[float]:
        """Share of the splits."""
        counts = np.zeros(len(self.features))
        for trees in self.trees:
            for feature, _, _ in trees:
                used = np.array(feature)
                counts += np.bincount(used[used >= 0], minlength=len(self.features))
        return (counts / max(counts.sum(), 1)).tolist()

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(np.array(self.base), (len(x), 1))
        at = np.arange(len(x))
        for k, trees in enumerate(self.trees):
            for feature, cut, value in trees:
                feature, cut, value = np.array(feature), np.array(cut), np.array(value)
                node = np.zeros(len(x), np.int64)
                while True:
                    f = feature[node]
                    if (f < 0).all():
                        break
                    node = np.where(f < 0, node, 2 * node + 1 + (x[at, np.maximum(f, 0)] > cut[node]))
                out[:, k] += value[node]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the classes, or the value in one column."""
        raw = self.raw(x)
        if self.objective == "value":
            return raw
        if self.objective == "binary":
            p = 1 / (1 + np.exp(-raw[:, 0]))
            return np.stack((1 - p, p), axis=1)
        return softmax(raw)

    def as_dict(self) -> dict[str, Any]:
        return {"features": self.features, "objective": self.objective, "base": self.base, "trees": self.trees}


def softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def predictions(boosters: Sequence[Booster], which: Column | None = None) -> Column:
    """array<double> of the row's prediction by its booster: the one numbered ``which``, or the only one."""
    features = boosters[0].features

    @F.arrow_udf("array<double>")
    def of(number: pa.Array, *columns: pa.Array) -> pa.Array:
        x = np.stack([np.asarray(v, dtype=np.float64) for v in columns], axis=1)
        number = np.asarray(number)
        out = np.zeros((len(x), 0))
        for k in np.unique(number):
            part = boosters[int(k)].predict(x[number == k])
            if out.shape[1] == 0:
                out = np.zeros((len(x), part.shape[1]))
            out[number == k] = part
        width = out.shape[1]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array(out.ravel()))

    return of(F.lit(0) if which is None else which.cast("int"), *[F.col(f).cast("double") for f in features])


def cut_points(df: DataFrame, features: Sequence[str], row: str, tasks: Sequence[Task]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per feature the sorted cut values, and the first end of training from which each may be used.

    Quantiles of growing prefixes of the rows: a task uses the cuts of prefixes that end no later than its own training rows do, so
    no cut tells of later times.
    """
    last = df.agg(F.max(row)).first()[0]
    ends = sorted({last + 1 if t.end is None else min(t.end, last + 1) for t in tasks})
    chosen = [ends[0]]
    for end in ends[1:]:
        if end >= chosen[-1] * GROWTH and len(chosen) < PREFIXES:
            chosen.append(end)
    count = CUTS // len(chosen)
    shares = [(k + 1) / (count + 1) for k in range(count)]
    found: list[dict[float, int]] = [{} for _ in features]
    for end in chosen:
        quantiles = df.filter(F.col(row) < end).approxQuantile(list(features), shares, 0.25 / count)
        for cuts, values in zip(found, quantiles):
            for v in values:
                cuts.setdefault(float(v), end)
    values = [np.array(sorted(cuts)) for cuts in found]
    return values, [np.array([cuts[v] for v in sorted(cuts)], np.int64) for cuts in found]


CHUNKS = "chunk long, n int, bins binary, y binary, w binary, row binary, key binary, scores binary, loss binary"


def packed(chunk: int, n: int, *arrays: np.ndarray) -> pa.RecordBatch:
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    columns = [pa.array([chunk], pa.int64()), pa.array([n], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in arrays]]
    return pa.RecordBatch.from_arrays(columns, names=names)


@dataclass
class Chunk:
    number: int
    bins: np.ndarray
    y: np.ndarray
    w: np.ndarray
    row: np.ndarray
    key: np.ndarray
    scores: np.ndarray


def unpacked(batches, width: int, columns: int):
    for batch in batches:
        for i in range(len(batch)):
            number, n = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            raw = [batch.column(k)[i].as_py() for k in range(2, 8)]
            yield Chunk(
                number, np.frombuffer(raw[0], np.uint8).reshape(n, width), np.frombuffer(raw[1]), np.frombuffer(raw[2]),
                np.frombuffer(raw[3], np.int64), np.frombuffer(raw[4], np.int64), np.frombuffer(raw[5]).reshape(n, columns),
            )


def chunked(df: DataFrame, features: Sequence[str], label: str, weight: str | None, row: str, cuts: list[np.ndarray], columns: int) -> DataFrame:
    names = list(features)
    rows = df.select(
        *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(names)], F.col(label).cast("double").alias("y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), F.col(row).cast("long").alias("row"),
        F.xxhash64(row, *names).alias("key"),
    )

    def to_chunks(batches):
        number = 0
        for batch in batches:
            for low in range(0, len(batch), CHUNK):
                part = batch.slice(low, CHUNK)
                n = len(part)
                bins = np.empty((n, len(names)), np.uint8)
                for i in range(len(names)):
                    bins[:, i] = np.searchsorted(cuts[i], np.asarray(part.column(i)), side="left")
                y, w, at, key = (np.asarray(part.column(len(names) + k)) for k in range(4))
                yield packed(number, n, bins, y, w, at, key, np.zeros((n, columns)), np.zeros(0))
                number += 1

    return rows.mapInArrow(to_chunks, CHUNKS)


def mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    """A number from 0 to 1 for each key."""
    x = keys.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (salt + 1) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53


def nodes_of(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Heap number of each row's node in one tree."""
    node, at = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while True:
        f = feature[node]
        if (f < 0).all():
            return node
        node = np.where(f < 0, node, 2 * node + 1 + (bins[at, np.maximum(f, 0)] > cut[node]))


class Training:
    """All tasks of one call: columns of scores, one tree a column and round."""

    def __init__(self, df, features, tasks, objective, classes, label, weight, row, balance):
        self.features, self.tasks, self.objective = list(features), list(tasks), objective
        self.params = [{**DEFAULTS, **t.params} for t in tasks]
        self.per = classes if objective == "classes" else 1
        self.columns = len(tasks) * self.per
        self.cuts, self.since = cut_points(df, features, row, tasks)
        self.bins = max((len(c) for c in self.cuts), default=0) + 1
        if self.bins > 255 or max(p["max_depth"] for p in self.params) > 12:
            raise ValueError("at most 254 cut points a feature and 12 levels")
        self.state = chunked(df, features, label, weight, row, self.cuts, self.columns).persist(StorageLevel.MEMORY_AND_DISK)
        self.first, self.scale = self.start(balance)
        self.trees = [[] for _ in range(self.columns)]
        self.losses: list[list[float]] = [[] for _ in tasks]
        self.old: list[DataFrame] = []  # states that are not needed once the present one has been read
        self.done = [False] * len(tasks)

    def start(self, balance: bool) -> tuple[np.ndarray, np.ndarray]:
        """First scores (the mean, or the log odds), and the weight of class 1, for each column."""
        tasks, objective, per, width, columns = self.tasks, self.objective, self.per, len(self.features), self.columns
        kinds = max(per, 2)

        def sums(batches):
            total = np.zeros((len(tasks), kinds, 2))
            for chunk in unpacked(batches, width, columns):
                for k, task in enumerate(tasks):
                    fit, _ = task.masks(chunk.row)
                    y, w = chunk.y[fit], chunk.w[fit]
                    if objective == "value":
                        total[k, 0] += (w * y).sum(), w.sum()
                    else:
                        for kind in range(kinds):
                            total[k, kind] += w[y == kind].sum(), (y == kind).sum()
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

        parts = [np.frombuffer(bytes(r[0])) for r in self.state.mapInArrow(sums, "total binary").collect()]  # a row a partition
        total = np.sum(parts, axis=0).reshape(len(tasks), kinds, 2) if parts else np.zeros((len(tasks), kinds, 2))
        scale = np.ones(columns)
        if objective == "value":
            return total[:, 0, 0] / np.maximum(total[:, 0, 1], 1e-12), scale
        if objective == "binary":
            pos, neg = total[:, 1, 1], total[:, 0, 1]
            if balance:
                scale = np.where((pos > 0) & (neg > 0), neg / np.maximum(pos, 1), 1.0)
            return np.log(np.maximum(total[:, 1, 0] * scale, 1e-6) / np.maximum(total[:, 0, 0], 1e-6)), scale
        shares = np.maximum(total[:, :, 0], 1e-6) / np.maximum(total[:, :, 0].sum(axis=1, keepdims=True), 1e-6)
        return np.log(shares).ravel(), scale

    def gradients(self):
        """A function of (chunk, scores, task) to gradient and curvature of its columns, a row each."""
        objective, per, scale = self.objective, self.per, self.scale

        def of(chunk, k):
            scores, w = chunk.scores[:, k * per : (k + 1) * per], chunk.w
            if objective == "value":
                g, h = w * (scores[:, 0] - chunk.y), w
                return [(g, h)]
            if objective == "binary":
                w = np.where(chunk.y == 1, w * scale[k], w)
                p = 1 / (1 + np.exp(-scores[:, 0]))
                return [(w * (p - chunk.y), w * p * (1 - p))]
            p = softmax(scores)
            return [(w * (p[:, c] - (chunk.y == c)), w * p[:, c] * (1 - p[:, c]) * per / (per - 1)) for c in range(per)]

        return of

    def level(self, number: int, open_nodes: dict[int, list[int]], feature: np.ndarray, cut: np.ndarray) -> list:
        """Best split of each open node (column, node) of this round's trees."""
        tasks, params, per, width, columns, bins = self.tasks, self.params, self.per, len(self.features), self.columns, self.bins
        gradients, cuts_of = self.gradients(), [len(c) for c in self.cuts]
        used = {k: self.sampled(k, number) for k in open_nodes}

        def histograms(batches):
            for chunk in unpacked(batches, width, columns):
                for task in sorted({k // per for k in open_nodes}):
                    p = params[task]
                    fit, _ = tasks[task].masks(chunk.row)
                    fit &= mixed(chunk.key, number * 1009 + p["random_state"]) < p["subsample"]
                    at = np.flatnonzero(fit)
                    if not len(at):
                        continue
                    out = []
                    place = (chunk.bins[at] + np.arange(width) * bins).astype(np.int32)
                    for c, (g, h) in enumerate(gradients(chunk, task)):
                        k = task * per + c
                        if k not in open_nodes:
                            continue
                        node = nodes_of(chunk.bins[at], feature[k], cut[k])
                        slot_of = np.full(len(feature[k]), -1)
                        slot_of[open_nodes[k]] = np.arange(len(open_nodes[k]))
                        slot = slot_of[node]
                        here = slot >= 0
                        slot, fs = slot[here], used[k]
                        size = width * bins
                        code = (place[here] if len(fs) == width else place[here][:, fs]) + (slot * size).astype(np.int32)[:, None]
                        grains = [np.rint(v[at][here] / GRAIN) for v in (g, h)]
                        # curvature and number of rows share a sum: whole numbers, the count above the curvature
                        high = 2.0 ** np.ceil(np.log2(grains[1].sum() + 2))
                        if high * (len(slot) + 1) > 2.0**53:
                            raise ValueError("sample weights are too large")
                        sums = [np.bincount(code.ravel(), np.repeat(v, len(fs)), len(open_nodes[k]) * size) for v in (grains[0], grains[1] + high)]
                        n = np.floor(sums[1] / high)
                        cube = np.stack([(v * GRAIN).reshape(-1, width, bins)[:, fs].reshape(len(open_nodes[k]), -1) for v in (sums[0], sums[1] - n * high)], axis=1)
                        cube = np.concatenate((cube, n.reshape(-1, width, bins)[:, fs].reshape(len(open_nodes[k]), 1, -1)), axis=1).astype(np.float32)
                        for s in np.unique(slot).tolist():
                            out.append((k, open_nodes[k][s], cube[s].tobytes()))
                    if out:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))], names=["column", "node", "cube"]
                        )

        allowed = {k: self.allowed(k // per) for k in open_nodes}

        def best(batches):
            total: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for k, node, cube in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    cube = np.frombuffer(cube, np.float32).astype(np.float64)
                    total[k, node] = total[k, node] + cube if (k, node) in total else cube
            out = []
            for (k, node), cube in total.items():
                p, fs = params[k // per], used[k]
                g, h, n = np.cumsum(cube.reshape(3, len(fs), bins), axis=2)
                (gl, hl, nl), (ga, ha, na) = (x[:, :-1] for x in (g, h, n)), (x[:, -1:] for x in (g, h, n))
                worth = lambda a, b: np.maximum(np.abs(a) - p["reg_alpha"], 0) ** 2 / (b + p["reg_lambda"] + 1e-12)  # noqa: B023, E731
                gain = worth(gl, hl) + worth(ga - gl, ha - hl) - worth(ga, ha)
                fine = (nl >= p["min_child_samples"]) & (na - nl >= p["min_child_samples"]) & (hl > 1e-3) & (ha - hl > 1e-3)
                fine &= allowed[k][fs][:, : gain.shape[1]]
                gain = np.where(fine, gain, 0.0)
                f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
                if gain[f, b] > 1e-9:
                    out.append((k, node, int(fs[f]), int(b), float(gain[f, b]), *map(float, (gl[f, b], hl[f, b], nl[f, b], ga[f, 0], ha[f, 0], na[f, 0]))))
                elif node == 0:
                    out.append((k, node, -1, 0, 0.0, 0.0, 0.0, 0.0, *map(float, (ga[0, 0], ha[0, 0], na[0, 0]))))
            names = ["column", "node", "feature", "bin", "gain", "gl", "hl", "nl", "g", "h", "n"]
            types = [pa.int32()] * 4 + [pa.float64()] * 7
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

        most = int(self.state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = max(1, min(most, sum(map(len, open_nodes.values())) // 32))
        cubes = self.state.mapInArrow(histograms, "column int, node int, cube binary").repartition(parts, "column", "node")
        kinds = ", ".join(f"{x} int" for x in ("column", "node", "feature", "bin")) + ", " + ", ".join(f"{x} double" for x in ("gain", "gl", "hl", "nl", "g", "h", "n"))
        splits = cubes.mapInArrow(best, kinds).collect()  # a row for each open node at most: columns x leaves
        while self.old:
            self.old.pop().unpersist()
        return splits

    def sampled(self, k: int, number: int) -> np.ndarray:
        """Features that the tree may use."""
        width, p = len(self.features), self.params[k // self.per]
        take = max(1, int(np.ceil(width * p["colsample_bytree"])))
        order = np.argsort(mixed(np.arange(width, dtype=np.int64) + width * (k % self.per), number * 7919 + p["random_state"] + 13), kind="stable")
        return np.sort(order[:take])

    def allowed(self, task: int) -> np.ndarray:
        """May the task split a feature behind a bin?"""
        end = self.tasks[task].end
        out = np.zeros((len(self.features), self.bins), bool)
        for i, since in enumerate(self.since):
            out[i, : len(since)] = True if end is None else since <= end
        return out

    def grow(self, number: int) -> bool:
        """One tree for each task that goes on."""
        per = self.per
        active = [k for k in range(self.columns) if not self.done[k // per] and number < self.params[k // per]["n_estimators"]]
        if not active:
            return False
        depth = max(self.params[k // per]["max_depth"] for k in active)
        feature = np.full((self.columns, 2 ** (depth + 1) - 1), -1, np.int16)
        cut = np.zeros(feature.shape, np.int16)
        value = np.zeros(feature.shape)
        leaves = dict.fromkeys(active, 1)
        open_nodes = {k: [0] for k in active}
        for level in range(depth):
            found: dict[int, list] = {}
            for r in self.level(number, open_nodes, feature, cut) if open_nodes else []:
                found.setdefault(r["column"], []).append(r)
            open_nodes = {}
            for k, splits in found.items():
                p = self.params[k // per]
                leaf = lambda g, h: -p["learning_rate"] * np.sign(g) * max(abs(g) - p["reg_alpha"], 0) / (h + p["reg_lambda"] + 1e-12)  # noqa: B023, E731
                for r in sorted(splits, key=lambda r: (-r["gain"], r["node"])):
                    node = r["node"]
                    if node == 0:
                        value[k, 0] = leaf(r["g"], r["h"])
                    if r["feature"] < 0 or leaves[k] >= p["num_leaves"]:
                        continue
                    leaves[k] += 1
                    feature[k, node], cut[k, node] = r["feature"], r["bin"]
                    value[k, 2 * node + 1], value[k, 2 * node + 2] = leaf(r["gl"], r["hl"]), leaf(r["g"] - r["gl"], r["h"] - r["hl"])
                    if level + 1 < p["max_depth"]:
                        sizes = ((2 * node + 1, r["nl"]), (2 * node + 2, r["n"] - r["nl"]))
                        open_nodes.setdefault(k, []).extend(c for c, n in sizes if n >= 2 * p["min_child_samples"])
                if k in open_nodes and (not open_nodes[k] or leaves[k] >= p["num_leaves"]):
                    del open_nodes[k]
        for task in {k // per for k in active}:
            own = range(task * per, (task + 1) * per)
            if all(feature[k, 0] < 0 for k in own):  # nothing more to split
                self.done[task] = True
                value[own] = 0.0
                continue
            for k in own:
                real = [float(self.cuts[f][b]) if f >= 0 else 0.0 for f, b in zip(feature[k].tolist(), cut[k].tolist())]
                self.trees[k].append((feature[k].tolist(), real, value[k].tolist()))
        self.advance(number, feature, cut, value)
        return True

    def advance(self, number: int, feature: np.ndarray, cut: np.ndarray, value: np.ndarray) -> None:
        """Add this round's trees to the scores, and note what is held out of each task."""
        tasks, per, width, columns, objective = self.tasks, self.per, len(self.features), self.columns, self.objective

        def added(batches):
            for chunk in unpacked(batches, width, columns):
                scores = chunk.scores.copy()
                for k in range(columns):
                    if feature[k, 0] >= 0:
                        scores[:, k] += value[k][nodes_of(chunk.bins, feature[k], cut[k])]
                loss = np.zeros((len(tasks), 2))
                for k, task in enumerate(tasks):
                    if task.held_from is not None:
                        _, held = task.masks(chunk.row)
                        loss[k] = loss_of(objective, chunk.y[held], scores[held, k * per : (k + 1) * per]), held.sum()
                yield packed(chunk.number, len(scores), chunk.bins, chunk.y, chunk.w, chunk.row, chunk.key, scores, loss)

        before = self.state
        self.state = before.mapInArrow(added, CHUNKS)
        self.state = materialize(self.state) if number % WRITE_EVERY == WRITE_EVERY - 1 else self.state.persist(StorageLevel.MEMORY_AND_DISK)
        if any(t.held_from is not None for t in tasks):

            def summed(batches):
                total = np.zeros((len(tasks), 2))
                for batch in batches:
                    for raw in batch.column(0).to_pylist():
                        total += np.frombuffer(raw).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["loss"])

            parts = self.state.select("loss").mapInArrow(summed, "loss binary").collect()  # a row a partition
            total = np.sum([np.frombuffer(bytes(r[0])).reshape(-1, 2) for r in parts], axis=0)
            for k, task in enumerate(tasks):
                patience = self.params[k]["early_stopping_rounds"]
                if task.held_from is not None and not self.done[k] and number < self.params[k]["n_estimators"]:
                    self.losses[k].append(float(total[k, 0] / max(total[k, 1], 1)))
                    if patience and len(self.losses[k]) - 1 - int(np.argmin(self.losses[k])) >= patience:
                        self.done[k] = True
            before.unpersist()
        else:  # the next level reads the new scores first, and keeps them
            self.old.append(before)

    def with_first_scores(self) -> None:
        """Scores begin at the base."""
        width, columns, base = len(self.features), self.columns, self.first

        def begun(batches):
            for chunk in unpacked(batches, width, columns):
                yield packed(chunk.number, len(chunk.y), chunk.bins, chunk.y, chunk.w, chunk.row, chunk.key, chunk.scores + base, np.zeros(0))

        before = self.state
        self.state = before.mapInArrow(begun, CHUNKS).persist(StorageLevel.MEMORY_AND_DISK)
        self.state.count()
        before.unpersist()

    def run(self) -> list[Booster]:
        self.with_first_scores()
        number = 0
        while self.grow(number):
            number += 1
        for one in (*self.old, self.state):
            one.unpersist()
        out = []
        for k, task in enumerate(self.tasks):
            own = range(k * self.per, (k + 1) * self.per)
            keep = None
            if task.held_from is not None and self.losses[k] and self.params[k]["early_stopping_rounds"]:
                keep = int(np.argmin(self.losses[k])) + 1
            trees = [self.trees[c][:keep] for c in own]
            out.append(Booster(self.features, self.objective, [float(self.first[c]) for c in own], trees, self.losses[k]))
        return out


def loss_of(objective: str, y: np.ndarray, scores: np.ndarray) -> float:
    """Sum of the squared errors, or of the negative log likelihoods."""
    if objective == "value":
        return float(((scores[:, 0] - y) ** 2).sum())
    if objective == "binary":
        return float(np.logaddexp(0, np.where(y == 1, -scores[:, 0], scores[:, 0])).sum())
    p = softmax(scores)[np.arange(len(y)), y.astype(np.int64)] if len(y) else np.ones(0)
    return float(-np.log(np.maximum(p, 1e-15)).sum())


def train(
    df: DataFrame, features: Sequence[str], tasks: Sequence[Task], objective: str = "binary", classes: int = 2,
    label: str = "label", weight: str | None = None, row: str = "row_idx", balance: bool = True,
) -> list[Booster]:
    """One booster a task, all grown together.

    ``objective``: binary (labels 0 and 1), classes (0 to ``classes`` - 1) or value. Features must not be null. ``row``: position of the
    row's time. With ``balance`` rows of class 1 weigh as much as those of class 0 in each binary task. A task without any row, or whose
    rows cannot be split, keeps its first score.
    """
    return Training(df, features, tasks, objective, classes, label, weight, row, balance).run()
