"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

Unit vectors are rotated so that the signs of their coordinates lose as little as possible (a rotation and
the signs are fitted in turn), and cut at the medians, so each bit is balanced. Bits in a row form the
substrings of the code, and each substring is the key of one table: two vectors that agree in one
substring share a bucket there. The length of substrings follows from the number of vectors, their number
from the chance that a pair at the threshold agrees in one; if that takes more bits than a vector has
coordinates, further rotations are learned from other starts.

Buckets are reranked with the original vectors in double precision. Inside a bucket pairs are counted
and united, never emitted; a pair that meets in several tables counts in the first. Large buckets
are cut into blocks that meet pair by pair.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwell.llm.common import ship
from panelwell.llm.jaccard_join import components, small
from panelwell.llm.nearest_neighbours import matrix, usable
from panelwell.session import store


@dataclass(frozen=True)
class NearDedupSettings:
    """``recall`` is the least chance that a pair at the threshold shares a bucket, if bits flip independently.

    ``sample`` bounds the vectors that rotations are fitted on (all are indexed); of those with the same
    ``thin`` random signs one is used, so that a large group of copies doesn't draw the rotation to itself.
    ``bucket`` is the number of vectors that a substring should leave together, ``block`` what one comparison holds.
    """

    cosine: float = 0.98
    recall: float = 0.98
    bucket: int = 512
    least_bits: int = 4
    most_bits: int = 16
    sample: int = 20_000
    thin: int = 16
    rounds: int = 50
    block: int = 2048

    def bits(self, rows: int) -> int:
        """Bits of a substring."""
        return min(self.most_bits, max(self.least_bits, math.ceil(math.log2(max(1, rows) / self.bucket))))

    def tables(self, bits: int) -> int:
        agree = (1 - math.acos(self.cosine) / math.pi) ** bits
        return max(1, math.ceil(math.log(1 - self.recall) / math.log(1 - agree)))


def iterative_quantisation(points: np.ndarray, seed: int, rounds: int) -> np.ndarray:
    """A rotation of the (centred) points under which their signs come close to them: signs and rotation are fitted in turn."""
    width = points.shape[1]
    axes = np.linalg.eigh(points.T @ points)[1]
    turned = points @ axes
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))[0]
    for _ in range(rounds):
        signs = np.where(turned @ rotation >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(signs.T @ turned)
        rotation = v.T @ u.T
    return axes @ rotation


@dataclass(frozen=True)
class Quantiser:
    mean: np.ndarray
    rotations: np.ndarray  # the rotations side by side, cut to the bits used
    cuts: np.ndarray
    bits: int

    @classmethod
    def fit(cls, unit: np.ndarray, bits: int, tables: int, settings: NearDedupSettings) -> Quantiser:
        width = unit.shape[1]
        signs = unit @ np.random.default_rng(0).standard_normal((width, settings.thin)) > 0
        few = unit[np.unique(signs @ (1 << np.arange(settings.thin)), return_index=True)[1]]
        mean = few.mean(axis=0)
        used = bits * tables
        turns = [iterative_quantisation(few - mean, seed, settings.rounds) for seed in range(1, -(-used // width) + 1)]
        rotations = np.hstack(turns)[:, :used]
        return cls(mean, rotations, np.median((few - mean) @ rotations, axis=0), bits)

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """The substrings of each vector as numbers, a column per table."""
        signs = (unit - self.mean) @ self.rotations > self.cuts
        return (signs.reshape(len(unit), -1, self.bits) @ (1 << np.arange(self.bits))).astype(np.int32)


def united_bucket(table: pa.Table, width: int, cosine: float) -> pa.Table:
    """node, root, links for the vectors of a block pair with a link in it."""
    low, high, t = (table.column(c)[0].as_py() for c in ("low", "high", "t"))
    x, part = matrix(table.column("embedding"), width), table.column("part").to_numpy()
    copies, m = table.column("copies").to_numpy(), len(x)
    codes = np.array(table.column("codes").to_pylist(), np.int32)[:, :t]
    length = np.sqrt((x * x).sum(axis=1))
    unit = x / length[:, None]
    linked, links = np.zeros((m, m), bool), np.zeros(m, np.int64)
    for start in range(0, m, 512):
        rows = slice(start, start + 512)
        value = unit[rows] @ unit.T
        r, c = np.nonzero(np.abs(value - cosine) < 1e-9)
        value[r, c] = (x[start + r] * x[c]).sum(axis=1) / (length[start + r] * length[c])
        near = value >= cosine
        near[np.arange(len(near)), start + np.arange(len(near))] = False
        if low != high:  # pairs within a part are compared where the part meets itself
            near &= part[rows, None] != part
        linked[rows] = near
        r, c = np.nonzero(near)
        for some in range(0, len(r), 100_000):
            a, b = r[some:some + 100_000] + start, c[some:some + 100_000]
            fresh = ~(codes[a] == codes[b]).any(axis=1)
            links += np.bincount(a[fresh], copies[b[fresh]], m).astype(np.int64)
    label = np.arange(m)
    while True:
        near = label.copy()
        for start in range(0, m, 512):
            rows = slice(start, start + 512)
            near[rows] = np.minimum(label[rows], np.where(linked[rows], label, m).min(axis=1))
        near = near[near]
        if (near == label).all():
            break
        label = near
    node = table.column("node").to_pylist()
    some = np.flatnonzero(linked.any(axis=1))
    return pa.table({
        "node": pa.array([node[i] for i in some], pa.binary()), "root": pa.array([node[label[i]] for i in some], pa.binary()), "links": pa.array(links[some], pa.int64()),
    })


def embedding_duplicates(vectors: DataFrame, settings: NearDedupSettings = NearDedupSettings()) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, label, embedding): vec_id, n_links, component_id, kept.

    Two vectors with the same label are linked if their cosine is ``cosine`` at least and they share a
    bucket. ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest vec_id that
    links reach, and ``kept`` is whether it is the row's own. Rows with a null label or id, with a vector
    that is null, empty, zero or holds null or non-finite components, and with a vector of another length than
    the most frequent one, link with nothing. Equal vectors of a label are compared once, and repeated
    rows are copies of each other. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    some = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))
    sizes = some.where(fit).groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if sizes is None:
        return some.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    width = sizes["w"]
    half = lambda *more: F.lpad(F.hex(F.xxhash64(*more, "label", "embedding")), 16, "0")
    name = F.unhex(F.concat(half(), half(F.lit("second"))))
    rows = some.withColumn("node", F.when(fit & (F.size("embedding") == width), name))
    nodes = store(rows.where("node IS NOT NULL").groupBy("node").agg(
        F.min("vec_id").alias("lead"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
    ), "nodes")
    count = nodes.count()
    bits = settings.bits(count)
    # bounded by the settings
    sample = matrix(nodes.orderBy("node").limit(settings.sample).select("embedding").toArrow().column(0), width)
    model = Quantiser.fit(sample / np.sqrt((sample * sample).sum(axis=1))[:, None], bits, settings.tables(bits), settings)
    shared = ship(spark, model)

    def code(batches):
        quantiser = shared()
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                x = matrix(part.column(3), width)
                codes = quantiser.codes(x / np.sqrt((x * x).sum(axis=1))[:, None])
                ends = pa.array(np.arange(0, codes.size + 1, codes.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, pa.array(codes.ravel()))], names=["node", "label", "copies", "embedding", "codes"])

    kinds = {c: nodes.schema[c].dataType.simpleString() for c in ("label", "embedding")}
    coded = store(nodes.select("node", "label", "copies", "embedding").mapInArrow(
        code, f"node binary, label {kinds['label']}, copies long, embedding {kinds['embedding']}, codes array<int>"
    ), "codes")
    key = ["label", "t", "code"]
    buckets = coded.select("node", "label", F.posexplode("codes").alias("t", "code")).groupBy(*key).agg(F.count("*").alias("members"))
    # a vector alone in its bucket meets nobody there
    met = store(buckets.where("members > 1").withColumn("parts", F.ceil(F.col("members") / settings.block).cast("int")).drop("members"), "buckets")
    placed = coded.select("node", "label", "copies", "embedding", "codes", F.posexplode("codes").alias("t", "code")).join(small(met), key)
    placed = placed.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    meet = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("part")).alias("low"), F.greatest(o, F.col("part")).alias("high")))
    dealt = placed.select(*key, "part", "node", "copies", "embedding", "codes", F.explode(meet).alias("p")).select(*key, "p.low", "p.high", "part", "node", "copies", "embedding", "codes")
    cosine = settings.cosine
    found = dealt.groupBy(*key, "low", "high").applyInArrow(lambda table: united_bucket(table, width, cosine), "node binary, root binary, links long")
    edges = store(found, "links")
    links = edges.groupBy("node").agg(F.sum("links").alias("links"))
    joined = store(components(edges).join(links, "node").join(nodes.select("node", "lead"), "node"), "linked")
    heads = joined.groupBy("root").agg(F.min("lead").alias("head"))
    # only nodes with copies or links tell more than the row itself
    told = nodes.select("node", "lead", "copies").join(joined.join(heads, "root").select("node", "links", "head"), "node", "left")
    told = store(told.where("copies > 1 OR links IS NOT NULL").select(
        F.col("node").alias("__node"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("head", "lead").alias("head")
    ), "classes")
    answer = rows.select("vec_id", "node").join(small(told), F.col("node") == F.col("__node"), "left")
    component = F.coalesce("head", "vec_id")
    return answer.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept")
    )
