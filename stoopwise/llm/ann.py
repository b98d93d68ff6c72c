"""Approximate nearest neighbours with learnt partitions.

A bounded sample of the vectors gives a graph of nearest neighbours, and the graph is cut
into balanced parts that keep neighbours together. A small neural network learns, from a
vector, in which parts its neighbours are. Every vector is filed under its most probable
part; a query is sent to its several most probable parts, and the vectors there are
ranked by the exact measure. How many parts are asked is the smallest number that finds
``AIMED`` of the true neighbours of the sample.

Nearness is the inner product in double precision. Vectors that are null, empty, zero, or
hold null or non-finite components take no part, nor do vectors of another length than
most have, or rows without an id. Of rows that repeat an id the smallest vector counts.
Equal vectors are one node of the index that lists its smallest ids, as many as an answer
can need, so a vector that a third of the rows share is compared once.

Parts of any size are cut into blocks of candidates and blocks of queries that meet in
tiles of bounded size; a tile gives each query its nearest few.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stoopwise.llm.common import bounded, ship
from stoopwise.session import dropped, written

K = 20
MOST_FIT = 4096
NODES_PER_PART = 512
MOST_PARTS = 128
GRAPH_NEIGHBOURS = 10
# How much larger than the mean a part of the sample may be.
IMBALANCE = 1.1
AIMED = 0.92
HIDDEN = 64
EPOCHS = 20
BATCH = 512
SEED = 5
CANDIDATES_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 1024


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, in no order."""
    k = min(k, scores.shape[1])
    return np.argpartition(-scores, k - 1, axis=1)[:, :k]


def neighbours(sample: np.ndarray, k: int) -> np.ndarray:
    """For each row the k other rows of largest inner product."""
    out = []
    for start in range(0, len(sample), 1024):
        scores = sample[start : start + 1024] @ sample.T
        rows = np.arange(len(scores))
        scores[rows, start + rows] = -np.inf
        out.append(_top(scores, min(k, len(sample) - 1)))
    return np.concatenate(out)


def balanced_parts(sample: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """A part per row: no part is much larger than the mean, neighbours mostly together.

    Starts from rows near common directions, then moves rows to the part that most of
    their neighbours, both ways, are in, as long as that part has room.
    """
    count = len(sample)
    room = int(np.ceil(count / parts * IMBALANCE))
    centers = sample[rng.choice(count, parts, replace=False)]
    part = np.full(count, -1)
    for _ in range(4):
        likes = sample @ centers.T
        order = np.argsort(-(likes.max(axis=1)))
        sizes = np.zeros(parts, int)
        for row in order.tolist():
            allowed = np.where(sizes < room, likes[row], -np.inf)
            part[row] = best = int(np.argmax(allowed))
            sizes[best] += 1
        centers = np.stack([sample[part == p].mean(axis=0) if sizes[p] else centers[p] for p in range(parts)])
        centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    around: list[list[int]] = [list(row) for row in graph.tolist()]
    for row, others in enumerate(graph.tolist()):
        for other in others:
            around[other].append(row)
    for _ in range(6):
        moved = 0
        for row in rng.permutation(count).tolist():
            votes = np.bincount(part[around[row]], minlength=parts)
            now = part[row]
            votes[(sizes >= room) & (np.arange(parts) != now)] = -1
            best = int(np.argmax(votes))
            if votes[best] > votes[now]:
                part[row] = best
                sizes[now] -= 1
                sizes[best] += 1
                moved += 1
        if not moved:
            break
    return part


class Router:
    """A network with one hidden layer: a vector to the log-odds of the parts."""

    def __init__(self, dims: int, parts: int, rng: np.random.Generator):
        self.weights = [
            rng.normal(0, (2 / dims) ** 0.5, (dims, HIDDEN)),
            np.zeros(HIDDEN),
            rng.normal(0, (1 / HIDDEN) ** 0.5, (HIDDEN, parts)),
            np.zeros(parts),
        ]
        self.scale = 1.0

    def logits(self, vectors: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.maximum(vectors * self.scale @ a + b, 0) @ c + d

    def learn(self, vectors: np.ndarray, targets: np.ndarray, rng: np.random.Generator) -> None:
        """Cross entropy with soft targets, by Adam."""
        self.scale = (vectors.shape[1] / max(1e-12, float((vectors**2).sum(axis=1).mean()))) ** 0.5
        first = [np.zeros_like(w) for w in self.weights]
        second = [np.zeros_like(w) for w in self.weights]
        step = 0
        for epoch in range(EPOCHS):
            rate = 2e-3 * (1 - epoch / EPOCHS) + 1e-4
            order = rng.permutation(len(vectors))
            for start in range(0, len(order), BATCH):
                rows = order[start : start + BATCH]
                x = vectors[rows] * self.scale
                a, b, c, d = self.weights
                inner = np.maximum(x @ a + b, 0)
                out = inner @ c + d
                out = np.exp(out - out.max(axis=1, keepdims=True))
                off = (out / out.sum(axis=1, keepdims=True) - targets[rows]) / len(rows)
                back = (off @ c.T) * (inner > 0)
                slopes = [x.T @ back, back.sum(axis=0), inner.T @ off, off.sum(axis=0)]
                step += 1
                for w, g, m, v in zip(self.weights, slopes, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def fit(sample: np.ndarray, nodes: int, k: int = K) -> tuple[Router, int]:
    """A router for ``nodes`` vectors of which ``sample`` is a part, and how many parts to ask."""
    rng = np.random.default_rng(SEED)
    dims = sample.shape[1] if len(sample) else 1
    parts = max(1, min(MOST_PARTS, nodes // NODES_PER_PART, len(sample) // (2 * GRAPH_NEIGHBOURS)))
    router = Router(dims, parts, rng)
    if parts == 1:
        return router, 1
    near = neighbours(sample, max(k, GRAPH_NEIGHBOURS))
    scores = np.einsum("ij,ikj->ik", sample, sample[near])
    near = np.take_along_axis(near, np.argsort(-scores, axis=1, kind="stable"), axis=1)
    graph = near[:, :GRAPH_NEIGHBOURS]
    part = balanced_parts(sample, graph, parts, rng)
    targets = np.zeros((len(sample), parts))
    np.add.at(targets, (np.arange(len(sample)), part), 0.5)
    for column in graph.T:
        np.add.at(targets, (np.arange(len(sample)), part[column]), 0.5 / graph.shape[1])
    router.learn(sample, targets, rng)
    logits = router.logits(sample)
    filed = logits.argmax(axis=1)
    ranks = np.empty_like(logits, dtype=int)
    np.put_along_axis(ranks, np.argsort(-logits, axis=1), np.arange(parts)[None, :], axis=1)
    asked_at = np.take_along_axis(ranks, filed[near[:, :k]], axis=1)
    found = np.array([(asked_at < m).mean() for m in range(1, parts + 1)])
    return router, int(np.argmax(found >= AIMED)) + 1 if (found >= AIMED).any() else parts


def _routed(nodes: DataFrame, router: Router, most: int, per_bin: int) -> DataFrame:
    """``nodes`` sent to their ``most`` likeliest parts, by bins of ``per_bin`` parts each.

    One row per node and bin: adds ``_bin`` and ``_parts``, the parts meant within the bin.
    """
    sent = nodes.sparkSession.sparkContext.broadcast(router)
    names = nodes.columns
    at = names.index("_vector")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = np.stack(batch.column(at).to_numpy(zero_copy_only=False)).astype(np.float64)
            best = np.sort(np.argsort(-sent.value.logits(vectors), axis=1, kind="stable")[:, :most], axis=1)
            rows, bins, parts = [], [], []
            for row, chosen in enumerate(best):
                own = chosen // per_bin
                for one in np.unique(own).tolist():
                    rows.append(row)
                    bins.append(one)
                    parts.append(chosen[own == one].tolist())
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(bins, pa.int32()), pa.array(parts, pa.list_(pa.int32()))],
                names=[*names, "_bin", "_parts"],
            )

    added = nodes.select("*", F.lit(0).alias("_bin"), F.array().cast("array<int>").alias("_parts"))
    return nodes.mapInArrow(run, added.schema)


def _tile(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """Each query's k nearest ids among the candidates' ids, ties to the smaller id."""
    out = {"_query": [], "_id": [], "_score": []}
    if len(queries) and len(candidates):
        ids = [np.asarray(x) for x in candidates["_ids"]]
        q = np.stack(queries["_vector"].to_numpy()).astype(np.float64)
        c = np.stack(candidates["_vector"].to_numpy()).astype(np.float64)
        rough = q @ c.T
        # A bin may hold parts that a query does not ask.
        part = np.array([parts[0] for parts in candidates["_parts"]])
        for row, asked in enumerate(queries["_parts"]):
            rough[row, ~np.isin(part, asked)] = -np.inf
        chosen = min(k, len(c))
        edge = np.partition(rough, len(c) - chosen, axis=1)[:, len(c) - chosen]
        for row, node in enumerate(queries["_node"].to_numpy()):
            # Products of matrices may round otherwise than the measure: keep what may tie.
            least = edge[row] - 1e-9 * (1 + abs(edge[row])) if np.isfinite(edge[row]) else -np.inf
            near = np.flatnonzero((rough[row] >= least) & (rough[row] > -np.inf))
            if not len(near):
                continue
            exact = (c[near] * q[row]).sum(axis=1)
            sizes = [len(ids[i]) for i in near]
            all_ids = np.concatenate([ids[i] for i in near])
            all_scores = np.repeat(exact, sizes)
            best = np.lexsort((all_ids, -all_scores))[:k]
            out["_query"].append(np.full(len(best), node))
            out["_id"].append(all_ids[best])
            out["_score"].append(all_scores[best])
    if not out["_query"]:
        return pd.DataFrame({"_query": np.empty(0, np.int64), "_id": np.empty(0, np.int64), "_score": np.empty(0)})
    return pd.DataFrame({name: np.concatenate(parts) for name, parts in out.items()})


def search(
    vectors: DataFrame,
    asks: Column,
    k: int = K,
    id: str = "vec_id",  # noqa: A002
    vector: str = "embedding",
    most_fit: int = MOST_FIT,
) -> DataFrame:
    """The k nearest rows found of every row that ``asks`` chooses, itself left out.

    query_id, rank from 1, vec_id, score; nearest first, ties to the smaller id.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.where(F.col(id).isNotNull()).select(
        F.col(id).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_vector"), asks.alias("_asks")
    )
    sound = F.forall("_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(sound & F.exists("_vector", lambda x: x != 0))
    rows = rows.groupBy("_id").agg(F.min("_vector").alias("_vector"), F.max("_asks").alias("_asks"))
    rows = written(rows, "ann-rows")
    lengths = rows.groupBy(F.size("_vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if lengths is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows_in = rows.where(F.size("_vector") == lengths["n"])

    # Map tasks keep the smallest ids of a vector, so one that very many rows share stays small.
    copies = Window.partitionBy("_vector").orderBy("_id")
    few = rows_in.withColumn("_nth", F.row_number().over(copies)).where(F.col("_nth") <= k + 1)
    asked = rows_in.where("_asks").select("_vector").distinct().withColumn("_asked", F.lit(True))
    nodes = (
        few.groupBy("_vector")
        .agg(F.sort_array(F.collect_list("_id")).alias("_ids"))
        .join(asked, "_vector", "left")
        .withColumn("_node", F.monotonically_increasing_id())
    )
    nodes = written(nodes, "ann-nodes")
    sample = nodes.select("_vector").orderBy(F.xxhash64("_vector"), "_vector").limit(most_fit).collect()
    router, most = fit(np.array([r["_vector"] for r in sample], float).reshape(len(sample), -1), nodes.count(), k)

    # Small parts share a bin, so a query's answers from several parts are cut to k together.
    parts = router.weights[-1].shape[0]
    per_bin = max(1, CANDIDATES_PER_BLOCK * parts // max(1, nodes.count()))
    filed = written(_routed(nodes.select("_node", "_vector", "_ids"), router, 1, per_bin), "ann-filed")
    asking = nodes.where("_asked").select("_node", "_vector")
    sent = written(_routed(asking, router, most, per_bin), "ann-sent")
    blocks = (
        filed.groupBy("_bin").agg(F.ceil(F.count("*") / CANDIDATES_PER_BLOCK).cast("int").alias("_c_blocks"))
        .join(sent.groupBy("_bin").agg(F.ceil(F.count("*") / QUERIES_PER_BLOCK).cast("int").alias("_q_blocks")), "_bin")
    )
    # One row per bin, and parts are bounded.
    blocks = F.broadcast(written(blocks, "ann-blocks"))

    def dealt(table: DataFrame, mine: str, others: str) -> DataFrame:
        block = F.pmod(F.xxhash64("_node"), F.col(f"_{mine}_blocks")).cast("int")
        meets = F.explode(F.sequence(F.lit(0), F.col(f"_{others}_blocks") - 1))
        return table.join(blocks, "_bin").withColumn(f"_{mine}", block).withColumn(f"_{others}", meets)

    keys = ["_bin", "_c", "_q"]
    tiles = (
        dealt(sent, "q", "c").select(*keys, "_node", "_vector", "_parts").groupBy(*keys)
        .cogroup(dealt(filed, "c", "q").select(*keys, "_vector", "_ids", "_parts").groupBy(*keys))
    )

    def nearest(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        return _tile(queries, candidates, k + 1)

    near = tiles.applyInPandas(nearest, "_query bigint, _id bigint, _score double")
    # Enough for each row of the node: its own id may be among them.
    ranked = Window.partitionBy("_query").orderBy(F.desc("_score"), "_id")
    lists = (
        near.withColumn("_nth", F.row_number().over(ranked)).where(F.col("_nth") <= k + 1)
        .groupBy("_query").agg(F.sort_array(F.collect_list(F.struct("_nth", "_id", "_score"))).alias("_near"))
    )
    lists = lists.join(nodes.select(F.col("_node").alias("_query"), "_vector"), "_query").select("_vector", "_near")
    lists = written(lists, "ann-lists")
    dropped(filed, sent)
    answers = rows_in.where("_asks").join(bounded(lists, 100_000), "_vector")
    others = F.slice(F.filter("_near", lambda n: n["_id"] != F.col("_id")), 1, k)
    return answers.select(F.col("_id").alias("query_id"), F.posexplode(others).alias("_place", "_n")).select(
        "query_id",
        (F.col("_place") + 1).cast("int").alias("rank"),
        F.col("_n._id").alias("vec_id"),
        F.col("_n._score").alias("score"),
    )
