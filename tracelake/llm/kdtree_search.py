"""Exact top-k search by inner product with KD-trees per shard.

Vectors are dealt to shards by a hash, and each shard becomes one row with its tree: points in leaf order, and for every node
the tight box around them. Queries travel in blocks; a block meets each shard in one task. There nodes are visited best first
by box-to-query bounds; a node is opened only for the queries whose bound reaches their k-th score, which
starts from a first search in one shard and rises with every leaf. What no shard rules out is merged.

Vectors that are null or hold a null or non-finite component take no part, nor do rows without an id; a query meets only
vectors of its own length. Ties go to the smaller id; rows with the query's id are never its results; repeated rows count
as one. An empty table, or one without queries, gives no rows. Other columns take no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import stored

LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Search:
    k: int = 20
    shard_rows: int = 4096
    block_rows: int = 512
    leaf: int = 64


class Tree:
    """Points in leaf order and, for each node, its slice, its box and its smallest id; children of node i follow as pairs."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int):
        order = np.arange(len(ids))
        self.slices: list[tuple[int, int]] = [(0, len(ids))]
        self.children: list[int] = [-1]
        lows, highs = [points.min(0)], [points.max(0)]
        at = 0
        while at < len(self.slices):
            a, b = self.slices[at]
            spread = highs[at] - lows[at]
            if b - a > leaf and spread.max() > 0:
                axis, middle = int(spread.argmax()), (a + b) // 2
                own = order[a:b]
                order[a:b] = own[np.argpartition(points[own, axis], middle - a)]
                self.children[at] = len(self.slices)
                for x, y in ((a, middle), (middle, b)):
                    part = points[order[x:y]]
                    self.slices.append((x, y))
                    self.children.append(-1)
                    lows.append(part.min(0))
                    highs.append(part.max(0))
            at += 1
        self.ids, self.points = ids[order], points[order]
        self.low, self.high = np.array(lows), np.array(highs)
        self.first = np.array([self.ids[a:b].min() for a, b in self.slices])

    def search(self, asked: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query its best k (score, id) here, without those below ``floor`` and its own id."""
        n = len(queries)
        best = np.full((n, k), -np.inf)
        names = np.full((n, k), LAST)
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        kth, last = floor.copy(), np.full(n, LAST)
        heap = [(-np.inf, 0, np.arange(n))]
        while heap:
            _, node, live = heapq.heappop(heap)
            bound = up[live] @ self.high[node] + down[live] @ self.low[node]
            live = live[(bound > kth[live]) | ((bound == kth[live]) & (self.first[node] <= last[live]))]
            if not len(live):
                continue
            child = self.children[node]
            if child >= 0:
                for c in (child, child + 1):
                    gain = up[live] @ self.high[c] + down[live] @ self.low[c] - kth[live]
                    heapq.heappush(heap, (-float(gain.max()) if np.isfinite(gain).all() else -np.inf, c, live))
                continue
            a, b = self.slices[node]
            score = queries[live] @ self.points[a:b].T
            score[self.ids[a:b][None, :] == asked[live][:, None]] = -np.inf
            all_scores = np.hstack([best[live], score])
            all_names = np.hstack([names[live], np.broadcast_to(self.ids[a:b], score.shape)])
            order = np.lexsort((all_names, -all_scores), axis=1)[:, :k]
            best[live], names[live] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_names, order, 1)
            full = best[live, -1] > -np.inf
            better = full & (best[live, -1] >= kth[live])
            kth[live[better]], last[live[better]] = best[live[better], -1], names[live[better], -1]
        out = []
        for i in range(n):
            good = (best[i] >= floor[i]) & (best[i] > -np.inf)
            out.append((best[i][good], names[i][good]))
        return out


def scaled(vec: Column, by: float) -> Column:
    """floor(by * x) of each component as a double."""
    return F.transform(vec, lambda x: F.floor(x.cast("double") * by).cast("double"))


def clean(rows: DataFrame, key: str, vec: str, by: float) -> DataFrame:
    """(id, dim, x): usable vectors, scaled."""
    x = F.col(vec)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(x.isNotNull() & (F.size(x) > 0) & fine & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.size(x).alias("dim"), scaled(x, by).alias("x")).distinct()


def _packed(rows: DataFrame, count: int, label: str, work, schema: str) -> DataFrame:
    """Rows dealt to ``count`` groups of about equal size by a hash of the id, each made one row by ``work``."""
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int"))
    return stored(dealt.groupBy("dim", "part").applyInPandas(work, schema), label)


def build_index(rows: DataFrame, how: Search) -> DataFrame:
    """One row (dim, shard, ids, points) for each shard; the arrays lie in leaf order."""
    shards = max(1, -(-rows.count() // how.shard_rows))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        return pd.DataFrame({"dim": [part["dim"].iloc[0]], "shard": [part["part"].iloc[0]], "ids": [part["id"].to_numpy(np.int64).tobytes()], "points": [np.vstack(part["x"].to_numpy()).astype(np.float64).tobytes()]})

    return _packed(rows, shards, "shards", build, "dim int, shard int, ids binary, points binary")


def _search(pairs: DataFrame, how: Search) -> DataFrame:
    """Pairs of a shard and a query block (with the floors of the queries) to (query_id, id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, held = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if held != (row["dim"], row["shard"]):
                    points = np.frombuffer(row["points"]).reshape(-1, row["dim"])
                    tree, held = Tree(np.frombuffer(row["ids"], np.int64), points, how.leaf), (row["dim"], row["shard"])
                asked = np.frombuffer(row["asked"], np.int64)
                queries = np.frombuffer(row["vectors"]).reshape(-1, row["dim"])
                found = tree.search(asked, queries, how.k, np.frombuffer(row["floors"], np.float64))
                sizes = [len(s) for s, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(sum(sizes), row["block"]), pa.int32()),
                        pa.array(np.repeat(asked, sizes), pa.int64()),
                        pa.array(np.concatenate([n for _, n in found]), pa.int64()),
                        pa.array(np.concatenate([s for s, _ in found]), pa.float64()),
                    ],
                    ["block", "query_id", "id", "score"],
                )

    # the rows of a shard come one after the other, so its tree is built once in a task
    sorted_pairs = pairs.repartition(F.col("dim"), F.col("shard"), F.pmod(F.col("block"), F.lit(8))).sortWithinPartitions("dim", "shard", "block")
    return sorted_pairs.mapInArrow(run, "block int, query_id long, id long, score double")


def top_k(rows: DataFrame, queries: DataFrame, how: Search = Search()) -> DataFrame:
    """(query_id, rank, id, score) of both frames' rows (id, dim, x): the best k others of each query, from rank 1."""
    index = build_index(rows, how)
    blocks_n = max(1, -(-queries.count() // how.block_rows))

    def block(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        return pd.DataFrame({"dim": [part["dim"].iloc[0]], "block": [part["part"].iloc[0]], "asked": [part["id"].to_numpy(np.int64).tobytes()], "vectors": [np.vstack(part["x"].to_numpy()).astype(np.float64).tobytes()], "floors": [np.full(len(part), -np.inf).tobytes()]})

    blocks = _packed(queries, blocks_n, "blocks", block, "dim int, block int, asked binary, vectors binary, floors binary")
    # first one shard for each block: the k-th score found there is a floor for all others
    homes = index.groupBy("dim").agg(F.array_sort(F.collect_set("shard")).alias("all"))
    home = blocks.join(homes, "dim").withColumn("shard", F.get("all", F.pmod(F.col("block"), F.size("all")))).drop("all")
    pilot = _search(home.join(index, ["dim", "shard"]), how)
    floors = pilot.groupBy("block", "query_id").agg(F.when(F.count("*") >= how.k, F.min("score")).alias("floor"))
    floors = floors.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("query_id", "floor"))).alias("known"))

    def raise_floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for asked, known in zip(batch.column(2).to_pylist(), batch.column(5).to_pylist()):
                found = dict(known or [])
                out.append(np.array([-np.inf if (f := found.get(q)) is None else f for q in np.frombuffer(asked, np.int64).tolist()]).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.binary())], ["dim", "block", "asked", "vectors", "floors"])

    raised = blocks.join(floors, "block", "left").select("dim", "block", "asked", "vectors", "floors", "known").mapInArrow(raise_floors, blocks.schema)
    raised = stored(raised, "floors")
    # every block goes to every shard of its length: the stated query set against all rows
    everywhere = raised.join(homes, "dim").withColumn("shard", F.explode("all")).drop("all")
    found = _search(everywhere.join(index, ["dim", "shard"]), how)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.select("query_id", "id", "score", place.alias("rank")).where(F.col("rank") <= how.k)
