"""Nearest neighbours by inner product with balanced posting lists.

Inner product becomes Euclidean distance by one more coordinate, sqrt(M^2 - |x|^2) for stored vectors
and 0 for queries. Centroids come from halving a bounded sample again and again at the median of its
widest direction, so their lists are balanced. A vector is stored in the list of its nearest centroid,
and in those of further centroids that are hardly farther away (boundary vectors are replicated). The
centroids are searched by a graph held in memory; a query reads all lists whose centroids are within a
ratio of the nearest one's distance, however many they are. Lists and their queries are cut into blocks of bounded size.

Lists are read in two steps. The few nearest lists of a query give a score that its k-th answer reaches
at least; the other lists then send only what reaches it. This loses nothing, and what a query sends does
not grow with the number of lists that it reads.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwell.llm.common import ship
from panelwell.session import store


@dataclass(frozen=True)
class IndexSettings:
    """``sample`` bounds the vectors that the centroids are fitted on and ``lists`` the centroids; every vector is indexed. ``first`` lists of a query are read before its others. ``beam`` is where the graph search for a query's lists starts; it widens until it holds all of them."""

    list_rows: int = 512
    lists: int = 4096
    sample: int = 20_000
    replicas: int = 4
    replica_ratio: float = 1.06
    probe_ratio: float = 1.22
    beam: int = 64
    degree: int = 24
    block: int = 4096
    first: int = 4


def halved(points: np.ndarray, parts: int) -> list[np.ndarray]:
    """Cuts points into ``parts`` groups of nearly equal size along their directions of largest spread."""
    if parts <= 1 or len(points) <= 1:
        return [points]
    centred = points - points.mean(axis=0)
    direction = centred[np.argmax((centred ** 2).sum(axis=1))]
    for _ in range(8):  # power iteration
        direction = centred.T @ (centred @ direction)
        length = np.linalg.norm(direction)
        if length == 0:
            break
        direction = direction / length
    left = parts // 2
    order = np.argsort(centred @ direction, kind="stable")
    cut = len(points) * left // parts
    return halved(points[order[:cut]], left) + halved(points[order[cut:]], parts - left)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a ** 2).sum(1)[:, None] + (b ** 2).sum(1) - 2 * a @ b.T))


class CentroidGraph:
    """Each centroid knows its nearest ones; a search walks from the best of a few entry points."""

    def __init__(self, centroids: np.ndarray, degree: int):
        self.centroids = centroids
        n = len(centroids)
        near = np.empty((n, min(degree, n)), np.int32)
        for start in range(0, n, 1024):
            near[start:start + 1024] = np.argsort(distances(centroids[start:start + 1024], centroids), axis=1, kind="stable")[:, :near.shape[1]]
        self.near = near
        self.entries = np.arange(0, n, max(1, int(math.sqrt(n)) // 2))

    def nearest(self, points: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Per point the ``beam`` nearest centroids found, nearest first, and their distances (all of them if they are fewer)."""
        n = len(self.centroids)
        if n <= beam:
            every = distances(points, self.centroids)
            order = np.argsort(every, axis=1, kind="stable")
            return order, np.take_along_axis(every, order, 1)
        first = distances(points, self.centroids[self.entries])
        order = np.argsort(first, axis=1, kind="stable")[:, :min(beam, len(self.entries), 8)]
        ids = np.full((len(points), beam), n, np.int64)
        gap = np.full((len(points), beam), np.inf)
        ids[:, :order.shape[1]], gap[:, :order.shape[1]] = self.entries[order], np.take_along_axis(first, order, 1)
        opened = np.zeros((len(points), n + 1), bool)
        seen = np.zeros((len(points), n + 1), bool)
        opened[:, n] = seen[:, n] = True
        row = np.arange(len(points))[:, None]
        seen[row, ids] = True
        length = (points ** 2).sum(1)[:, None]
        norms = (self.centroids ** 2).sum(1)
        for _ in range(n):
            closed = ~opened[row, ids]
            active = np.flatnonzero(closed.any(axis=1))
            if not len(active):
                break
            # four at a time: the lists are sorted, so these are the nearest that were not opened yet
            rank = np.argsort(~closed[active], axis=1, kind="stable")[:, :4]
            chosen = np.where(np.take_along_axis(closed[active], rank, 1), np.take_along_axis(ids[active], rank, 1), n)
            at = active[:, None]
            opened[at, chosen] = True
            fresh = np.where((chosen < n)[:, :, None], self.near[np.minimum(chosen, n - 1)], n).reshape(len(active), -1).astype(np.int64)
            fresh.sort(axis=1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = n
            fresh = np.where(seen[at, fresh], n, fresh)
            seen[at, fresh] = True
            safe = np.minimum(fresh, n - 1)
            product = np.einsum("ijk,ik->ij", self.centroids[safe], points[active])
            new_gap = np.where(fresh < n, np.sqrt(np.maximum(0, length[active] + norms[safe] - 2 * product)), np.inf)
            ids_all, gap_all = np.hstack([ids[active], fresh]), np.hstack([gap[active], new_gap])
            best = np.argsort(gap_all, axis=1, kind="stable")[:, :beam]
            ids[active], gap[active] = np.take_along_axis(ids_all, best, 1), np.take_along_axis(gap_all, best, 1)
        return ids, gap

    def within(self, points: np.ndarray, ratio: float, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, centroid, place) of all centroids within ``ratio`` of the nearest one's distance; the beam widens for the points that fill it."""
        n, rest, found = len(self.centroids), np.arange(len(points)), []
        while len(rest):
            ids, gap = self.nearest(points[rest], beam)
            close = (gap <= gap[:, :1] * ratio + 1e-12) & (ids < n)
            done = ~close[:, -1] | (beam >= n)
            row, column = np.nonzero(close & done[:, None])
            found.append((rest[row], ids[row, column], column))
            rest, beam = rest[~done], beam * 4
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


@dataclass(frozen=True)
class Centroids:
    graph: CentroidGraph
    largest: float
    settings: IndexSettings

    def lists_of(self, vectors: np.ndarray, stored: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, place) of the lists where a vector is stored, or that a query reads; the nearest list has place 0."""
        rest = np.sqrt(np.maximum(0, self.largest - (vectors ** 2).sum(1))) if stored else np.zeros(len(vectors))
        points = np.column_stack([vectors, rest])
        if not stored:
            return self.graph.within(points, self.settings.probe_ratio, self.settings.beam)
        ids, gap = self.graph.nearest(points, self.settings.beam)
        close = (gap <= gap[:, :1] * self.settings.replica_ratio + 1e-12) & (ids < len(self.graph.centroids))
        close &= np.cumsum(close, axis=1) <= self.settings.replicas
        row, column = np.nonzero(close)
        return row, ids[row, column], column


def usable(vector: Column) -> Column:
    """Not null, not empty, finite in all components, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def search(vectors: DataFrame, query: Column, k: int = 20, settings: IndexSettings = IndexSettings()) -> DataFrame:
    """The k stored vectors of largest inner product for each query row: query_id, rank, vec_id, score.

    ``vectors`` has vec_id and embedding; ``query`` is a condition over vec_id that names the queries. A
    query's own row is no candidate. Equal scores rank by smaller vec_id. Vectors that are null, empty,
    zero or hold null or non-finite components, rows without an id, and vectors whose length is not the
    most frequent one take no part; repeated rows count once, and of several vectors with one id the
    smallest counts. Scores are sums in double precision over the original components. An empty table
    gives no rows.

    Equal vectors are stored once, with their k + 1 smallest ids: no other copy can be in a result.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    width_row = rows.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").first()
    result = "query_id long, rank int, vec_id long, score double"
    if width_row is None:
        return spark.createDataFrame([], result)
    width = width_row["w"]
    one = rows.where(F.size("embedding") == width).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    kept = one.withColumn("place", place).where(F.col("place") <= k + 1)
    groups = kept.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("key"), "ids", "embedding")
    base = store(groups, "vectors")
    asked = one.where(query).select(F.col("vec_id").alias("query_id"), "embedding")
    keys = base.select("key", "embedding")
    questions = store(asked.join(keys, "embedding").select("query_id", "key"), "questions")

    stats = base.agg(F.count("*").alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("largest")).first()
    # bounded by the settings
    sample = [r["embedding"] for r in base.orderBy(F.xxhash64("key")).limit(settings.sample).select("embedding").collect()]
    points = np.array(sample, np.float64)
    points = np.column_stack([points, np.sqrt(np.maximum(0, stats["largest"] - (points ** 2).sum(1)))])
    n_lists = max(1, min(settings.lists, stats["n"] // settings.list_rows, len(points) // 4))
    centroids = np.array([part.mean(axis=0) for part in halved(points, n_lists) if len(part)])
    index = ship(spark, Centroids(CentroidGraph(centroids, settings.degree), stats["largest"], settings))

    def assign(stored: bool):
        def run(batches):
            fitted = index()
            for batch in batches:
                for start in range(0, batch.num_rows, 512):
                    part = batch.slice(start, 512)
                    row, lists, place = fitted.lists_of(matrix(part.column(1), width), stored)
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(at), part.column(1).take(at), pa.array(lists.astype(np.int32)), pa.array(place.astype(np.int32))],
                        names=["key", "embedding", "list", "place"],
                    )

        return run

    kind = base.schema["embedding"].dataType.simpleString()
    schema = f"key long, embedding {kind}, list int, place int"
    stored = store(base.select("key", "embedding").mapInArrow(assign(True), schema).drop("place"), "lists")
    asked_keys = questions.select("key").distinct()
    probes = store(keys.join(asked_keys, "key").select("key", "embedding").mapInArrow(assign(False), schema), "probes")

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if a.num_rows and b.num_rows:
            ids, x = a.column("key").to_numpy(), matrix(a.column("embedding"), width)
            asked_ids, y, least = b.column("key").to_numpy(), matrix(b.column("embedding"), width), b.column("least").to_numpy()
            top = min(k + 1, len(ids))
            for start in range(0, len(y), 256):
                scores = y[start:start + 256] @ x.T
                floor = -np.partition(-scores, top - 1, axis=1)[:, top - 1:top]
                q, c = np.nonzero(scores >= np.maximum(floor, least[start:start + 256, None]) - 1e-9)
                out.append((asked_ids[start + q], ids[c], (y[start + q] * x[c]).sum(axis=1)))
        q, c, s = (np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"asked": pa.array(q, pa.int64()), "key": pa.array(c, pa.int64()), "score": pa.array(s, pa.float64())})

    own = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def blocks(df: DataFrame) -> dict[int, int]:
        """Blocks per list; at most settings.lists rows."""
        return {r["list"]: -(-r["count"] // settings.block) for r in df.groupBy("list").count().collect()}

    stored_blocks = blocks(stored)

    def read(asking: DataFrame) -> DataFrame:
        """asked, key, score: per list the best of its vectors for the queries (key, embedding, list, least) that read it."""
        asking_blocks = blocks(asking)
        parts = F.broadcast(spark.createDataFrame([(i, stored_blocks.get(i, 1), n) for i, n in asking_blocks.items()], "list int, b_parts int, q_parts int"))
        left = stored.join(parts, "list").select("list", own("b_parts").alias("b"), every("q_parts").alias("q"), "key", "embedding")
        right = asking.join(parts, "list").select("list", every("b_parts").alias("b"), own("q_parts").alias("q"), "key", "embedding", "least")
        return left.groupBy("list", "b", "q").cogroup(right.groupBy("list", "b", "q")).applyInArrow(compare, "asked long, key long, score double")

    best = Window.partitionBy("asked").orderBy(F.desc("score"), "key")

    def leading(met: DataFrame) -> DataFrame:
        return met.repartition("asked").dropDuplicates(["asked", "key"]).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)

    near = store(leading(read(probes.where(F.col("place") < settings.first).withColumn("least", F.lit(float("-inf"))))), "near")
    reached = near.where(F.col("place") == k + 1).select(F.col("asked").alias("key"), F.col("score").alias("least"))
    later = probes.where(F.col("place") >= settings.first)
    further = store(later.join(reached, "key", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))), "further")
    met = near.select("asked", "key", "score").unionByName(read(further))
    single = leading(met)
    named = single.select("asked", "key", "score").join(base.select("key", "ids"), "key").select("asked", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    top = named.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    lists = top.groupBy("asked").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))
    answers = questions.join(lists, questions["key"] == lists["asked"])
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("at", "f")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score")
    )
