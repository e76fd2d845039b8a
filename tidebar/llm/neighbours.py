"""Approximate nearest neighbours by balanced posting lists whose centroids are searched by a graph in memory."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm.common import checkpointed


@dataclass(frozen=True)
class ListPlan:
    """sample: distinct vectors that centroids are fitted on at most; every vector is indexed. per_list: distinct vectors a list
    aims at; lists: most lists, which bounds what is broadcast. copies, spread: a vector also goes to up to `copies` lists whose
    centroids are at most `spread` times as far as its nearest. probes, reach: a query reads up to `probes` lists
    at most `reach` times as far as its nearest. degree: neighbours in the graph. part: vectors or queries handled at once."""

    sample: int = 20_000
    per_list: int = 128
    lists: int = 4096
    copies: int = 4
    spread: float = 1.15
    probes: int = 64
    reach: float = 1.6
    degree: int = 24
    part: int = 4096


def balanced_centroids(points: np.ndarray, count: int, seed: int = 5) -> np.ndarray:
    """Means of `count` cells of nearly equal size: the largest cell is halved, at the median between two means, again and again."""
    rng = np.random.default_rng(seed)
    cells = [np.arange(len(points))]
    while len(cells) < count and max(map(len, cells)) > 1:
        at = max(range(len(cells)), key=lambda i: len(cells[i]))
        own = points[cells[at]]
        pair = own[rng.choice(len(own), 2, replace=False)]
        for _ in range(6):
            side = own @ (pair[1] - pair[0])
            upper = side > np.median(side)
            if upper.all() or not upper.any():
                break
            pair = np.stack([own[~upper].mean(0), own[upper].mean(0)])
        order = np.argsort(own @ (pair[1] - pair[0]), kind="stable")
        half = len(order) // 2
        members = cells.pop(at)
        cells += [members[order[:half]], members[order[half:]]]
    return np.stack([points[c].mean(0) for c in cells])


def nearest_centroids(centroids: np.ndarray, degree: int) -> np.ndarray:
    """Numbers of the `degree` centroids next to each."""
    count, squares = len(centroids), (centroids**2).sum(1)
    near = np.zeros((count, min(degree, count - 1)), np.int32)
    for a in range(0, count, 512):
        d = squares[None] - 2 * centroids[a : a + 512] @ centroids.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        near[a : a + 512] = np.argsort(d, axis=1)[:, : near.shape[1]]
    return near


class Graph:
    """Each centroid with its nearest ones. A search keeps the best `width` seen, and looks at the neighbours of the
    best that it has not looked at yet, for many vectors in step."""

    def __init__(self, centroids: np.ndarray, near: np.ndarray):
        self.centroids, self.near = centroids, near
        self.squares = (centroids**2).sum(1)
        count = len(centroids)
        self.entries = np.unique(np.linspace(0, count - 1, min(count, 48)).astype(int))

    def search(self, vectors: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and distances of up to `width` centroids, nearest first; -1 and infinity where there are fewer."""
        count = len(self.centroids)
        width = min(width, count)
        own = (vectors**2).sum(1)
        if count <= max(len(self.entries), width):
            d = np.sqrt(np.maximum(own[:, None] + self.squares[None] - 2 * vectors @ self.centroids.T, 0))
            order = np.argsort(d, axis=1, kind="stable")[:, :width]
            return order, np.take_along_axis(d, order, 1)
        rows = np.arange(len(vectors))[:, None]
        first = own[:, None] + self.squares[self.entries][None] - 2 * vectors @ self.centroids[self.entries].T
        ids = np.broadcast_to(self.entries, first.shape)
        pool = np.full((len(vectors), width), -1, np.int64)
        far = np.full((len(vectors), width), np.inf)
        done = np.ones((len(vectors), width), dtype=bool)
        seen = np.zeros((len(vectors), count), dtype=bool)
        seen[rows, ids] = True

        def merge(new_ids, new_far):
            nonlocal pool, far, done
            all_ids, all_far = np.concatenate((pool, new_ids), 1), np.concatenate((far, new_far), 1)
            all_done = np.concatenate((done, np.isinf(new_far)), 1)
            best = np.argsort(all_far, axis=1, kind="stable")[:, :width]
            pool, far, done = (np.take_along_axis(x, best, 1) for x in (all_ids, all_far, all_done))

        merge(ids, first)
        while not done.all():
            pick = np.argmin(np.where(done, np.inf, far), axis=1)[:, None]
            busy = ~np.take_along_axis(done, pick, 1)[:, 0]
            at = np.take_along_axis(pool, pick, 1)[:, 0]
            np.put_along_axis(done, pick, True, 1)
            next_ids = self.near[np.maximum(at, 0)]
            d = own[:, None] + self.squares[next_ids] - 2 * np.einsum("bd,bkd->bk", vectors, self.centroids[next_ids])
            d[seen[rows, next_ids] | ~busy[:, None]] = np.inf
            seen[rows[busy], next_ids[busy]] = True
            merge(next_ids, d)
        return pool, np.sqrt(np.maximum(far, 0))


def matrix(column) -> np.ndarray:
    """A list column as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double> of the stored values): rows that take part, once each."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where("vec_id is not null and v is not null").where(~bad & F.exists("v", lambda x: x != 0))
    return rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).distinct()


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, plan: ListPlan = ListPlan()) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every` the k rows of largest inner product
    that the search finds, itself excepted; ties to the smaller vec_id.

    Equal vectors are searched once, as one node with its k + 1 smallest ids: more of them can never be among the first
    k. Vectors are null-free, finite and not zero, and of the most frequent length (of equally frequent ones the
    longest); all others take no part. Inner products are distances after one more component that evens the norms out. A
    query that finds fewer than k reads all lists.
    """
    spark = vectors.sparkSession
    rows = valid(vectors)
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = sizes["size"] if sizes else 1
    rows = checkpointed(rows.where(F.size("v") == size))
    # the smallest ids of each vector; Spark limits the groups before it shuffles them
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    nodes = rows.withColumn("at", rank).where(F.col("at") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    nodes = checkpointed(nodes.select(F.monotonically_increasing_id().alias("node"), "v", "ids", norm.alias("square")))
    asking = checkpointed(rows.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id").join(nodes.select("v", "node"), "v").select("query_id", "node"))
    facts = nodes.agg(F.count("*"), F.coalesce(F.max("square"), F.lit(0.0)), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    count, square, ids = facts
    taken = nodes.orderBy(F.xxhash64("v"), "node").limit(plan.sample).select("v", "square").toArrow()
    points = matrix(taken["v"]) if count else np.zeros((1, size))
    extra = np.sqrt(np.maximum(square - np.asarray(taken["square"], dtype=float), 0)) if count else np.zeros(1)
    centroids = balanced_centroids(np.hstack([points, extra[:, None]]), int(np.clip(count // plan.per_list, 1, plan.lists)))
    # plan.lists rows at most
    shared = spark.sparkContext.broadcast((centroids, nearest_centroids(centroids, plan.degree)))

    def assign(batches):
        graph = Graph(*shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                v = matrix(part.column("v"))
                more = np.sqrt(np.maximum(square - np.asarray(part.column("square"), dtype=float), 0))
                found, far = graph.search(np.hstack([v, more[:, None]]), max(16, plan.copies))
                keep = (far <= far[:, :1] * plan.spread) & (found >= 0)
                keep[:, plan.copies :] = False
                at, which = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(found[at, which].astype(np.int64)), part.column("node").take(pa.array(at))], names=["list", "node"])

    postings = checkpointed(nodes.select("node", "v", "square").mapInArrow(assign, "list long, node long"))
    lengths = postings.groupBy("list").agg(F.ceil(F.count("*") / plan.part).alias("parts"))
    wanted = nodes.select("node", "v").join(asking.select("node").distinct(), "node")

    def probe(batches):
        graph = Graph(*shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                v = matrix(part.column("v"))
                found, far = graph.search(np.hstack([v, np.zeros((len(v), 1))]), plan.probes)
                keep = (far <= far[:, :1] * plan.reach) & (found >= 0)
                at, which = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(found[at, which].astype(np.int64)), part.column("node").take(pa.array(at))], names=["list", "query"])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        if len(left) and len(right):
            q, v = matrix(left["query_v"]), matrix(right["v"])
            names, least = np.asarray(left["query"]), np.asarray(right["least"])
            order = np.argsort(least, kind="stable")
            v, node = v[order], np.asarray(right["node"])[order]
            for a in range(0, len(q), 512):
                scores = q[a : a + 512] @ v.T
                best = np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]
                out[0].append(np.repeat(names[a : a + 512], best.shape[1]))
                out[1].append(node[best].ravel())
                out[2].append(np.take_along_axis(scores, best, 1).ravel())
        kinds = (np.int64, np.int64, np.float64)
        return pa.Table.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, t)) for x, t in zip(out, kinds)], names=["query", "node", "score"])

    def search(probes: DataFrame) -> DataFrame:
        """Best nodes by query. Lists are dealt in parts of plan.part vectors, and where many queries read one, so are they."""
        load = probes.groupBy("list").agg(F.ceil(F.count("*") / plan.part).alias("shares"))
        plan_of = F.broadcast(lengths.join(load, "list"))  # a row a list, plan.lists at most
        every_part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
        every_share = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))
        asked = probes.join(plan_of, "list").withColumn("share", F.pmod(F.xxhash64("query"), "shares")).withColumn("part", every_part)
        asked = asked.select("list", "part", "share", "query").join(nodes.select(F.col("node").alias("query"), F.col("v").alias("query_v")), "query")
        held = postings.join(plan_of, "list").withColumn("part", F.pmod(F.xxhash64("node"), "parts")).withColumn("share", every_share)
        names = [F.col(c).alias(f"held_{c}") for c in ("list", "part", "share")]
        held = held.select(*names, "node").join(nodes.select("node", "v", F.col("ids")[0].alias("least")), "node")
        met = asked.groupBy("list", "part", "share").cogroup(held.groupBy("held_list", "held_part", "held_share")).applyInArrow(compare, "query long, node long, score double")
        once = met.groupBy("query", "node").agg(F.max("score").alias("score"))
        each = once.join(nodes.select("node", "ids"), "node").select("query", "score", F.explode("ids").alias("vec_id"))
        first = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
        return each.withColumn("at", first).where(F.col("at") <= k + 1).drop("at")

    found = checkpointed(search(checkpointed(wanted.mapInArrow(probe, "list long, query long"))))
    short = found.groupBy("query").count().where(F.col("count") < min(k + 1, ids)).select("query")
    if short.limit(1).count():
        short = checkpointed(short)
        everything = short.withColumn("list", F.explode(F.array([F.lit(i).cast("long") for i in range(len(centroids))])))
        found = found.join(short, "query", "left_anti").unionByName(search(everything.select("list", "query")))
    pairs = asking.join(found.withColumnRenamed("query", "node"), "node").where("vec_id <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
