"""Similarity join of word shingles by chosen paths.

Texts with the same set of shingles form one node. A node's set is embedded as min-hash coordinates,
each a shared-token sample: two sets agree in a coordinate with their Jaccard similarity. A run
starts by splitting all nodes on one coordinate; a bucket with too many nodes is split again on two
further coordinates that its path chooses, and so on. Buckets of bounded size, and those left at the
last depth (in bounded blocks), are compared exactly. Runs are repeated until a pair at the threshold
is missed with at most the given probability. Inside a bucket pairs are counted and united, never
emitted; a pair that meets in several buckets counts in the smallest of them only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwell.llm.common import groups_in_order, in_pieces, words_of
from panelwell.session import broadcast_rows, cut_lineage, store

MEMO = 300_000
#: Nodes that share a rare token.
RARE = 12


@dataclass(frozen=True)
class JoinSettings:
    """``recall`` is the least chance to find a pair at the threshold; ``bucket`` the nodes compared without a further split.

    A larger bucket is still not split if the mean similarity of its nodes is ``dense`` or more. Buckets of
    more than ``block`` nodes are compared block by block.
    """

    words: int = 5
    similarity: float = 0.8
    recall: float = 0.9999
    bucket: int = 256
    depth: int = 3
    block: int = 1024
    dense: float = 0.3
    coordinates: int = 24

    def runs(self) -> int:
        """Runs for the target recall: the first split keeps a pair together with its similarity, each later one in one of two ways."""
        one = self.similarity * (1 - (1 - self.similarity) ** 2) ** (self.depth - 1)
        return math.ceil(math.log(1 - self.recall) / math.log(1 - one))

    def width(self) -> int:
        """Coordinates of a sketch: each run starts with one of its own, so there are as many as runs at least."""
        return max(self.coordinates, self.runs())


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int, memo: dict[str, int]) -> np.ndarray:
    """The distinct hashes of runs of ``size`` words, sorted; fewer words, but not none, are one run."""
    parts = []
    for piece in in_pieces(text or ""):
        tokens = words_of(piece)
        try:
            numbers = [memo[t] for t in tokens]
        except KeyError:
            if len(memo) > MEMO:
                memo.clear()
            for t in tokens:
                if t not in memo:
                    memo[t] = xxhash.xxh64_intdigest(t)
            numbers = [memo[t] for t in tokens]
        parts.append(np.array(numbers, np.uint64))
    words = np.concatenate(parts)
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    run = np.zeros(n, np.uint64)
    for i in range(min(size, len(words))):
        run = run * np.uint64(0x9E3779B97F4A7C15) + words[i:i + n]
    return np.unique(mixed(run))


def coordinate_seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return numbers[:n] | np.uint64(1), numbers[n:]


def sketches(docs: DataFrame, settings: JoinSettings) -> DataFrame:
    """One row per document: doc_id, text_hash, n (shingles), node (16 bytes that name the set), sketch."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text_hash", "n", "node", "sketch"]

    def run(batches):
        memo: dict[str, int] = {}
        odd, offset = coordinate_seeds(settings.width())
        for batch in batches:
            for start in range(0, batch.num_rows, 250):
                part = batch.slice(start, 250)
                sets = [shingles(t, settings.words, memo) for t in part.column(2).to_pylist()]
                size = np.array([len(s) for s in sets])
                some = np.flatnonzero(size)
                coordinates = np.zeros((len(sets), settings.width()), np.int64)
                node = [b"" for _ in sets]
                if len(some):
                    flat, first = np.concatenate([sets[i] for i in some]), np.r_[0, np.cumsum(size[some])[:-1]]
                    for c in range(settings.width()):
                        coordinates[some, c] = np.minimum.reduceat(flat * odd[c] + offset[c], first).view(np.int64)
                    a, b = np.add.reduceat(flat, first), np.add.reduceat(mixed(flat + np.uint64(1)), first)
                    for i, x, y in zip(some, a.tolist(), b.tolist()):
                        node[i] = x.to_bytes(8, "big") + y.to_bytes(8, "big")
                values = pa.array(coordinates.ravel())
                ends = pa.array(np.arange(0, len(sets) * settings.width() + 1, settings.width()), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(size, pa.int64()), pa.array(node, pa.binary()), pa.ListArray.from_arrays(ends, values)], names=names
                )

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        run, f"doc_id {kind}, text_hash long, n long, node binary, sketch array<long>"
    )


def leaves(nodes: DataFrame, settings: JoinSettings) -> DataFrame:
    """The buckets to be compared: bucket, node, members. Buckets of one node, or with the same nodes as another, are left out."""
    sketch = nodes.select("node", "sketch")
    rows = sketch.select("node", F.posexplode(F.slice("sketch", 1, settings.runs())).alias("run", "value")).select("node", F.xxhash64("run", "value").alias("bucket"))
    found = []
    for depth in range(1, settings.depth + 1):
        rows = cut_lineage(rows)
        sizes = rows.groupBy("bucket").agg(
            F.count("*").alias("members"), F.sum(F.xxhash64("node") % (1 << 40)).alias("added"), F.bit_xor(F.xxhash64("node")).alias("xored")
        ).where(F.col("members") > 1)
        # the same nodes need no second comparison
        single = sizes.groupBy("members", "added", "xored").agg(F.min("bucket").alias("bucket")).select("bucket", "members")
        sized = cut_lineage(rows.join(single, "bucket").select("bucket", "node", "members"))
        final = F.lit(True) if depth == settings.depth else F.col("members") <= settings.bucket
        found.append(sized.where(final))
        if depth == settings.depth:
            break
        large = sized.where(~final)
        if large.isEmpty():
            break
        split = cut_lineage(large.join(sketch, "node"))
        chosen = [F.pmod(F.xxhash64("bucket", F.lit(way)), F.lit(settings.width())).cast("int") for way in (1, 2)]
        # how often two nodes of the bucket agree in the first coordinate is their mean similarity;
        # where it is high a split would only repeat the bucket, so it is compared as it is
        agree = split.groupBy("bucket", F.get("sketch", chosen[0]).alias("value")).agg(F.count("*").alias("k"))
        mean = agree.groupBy("bucket").agg((F.sum(F.col("k") * F.col("k")) / F.pow(F.sum("k"), F.lit(2))).alias("mean"))
        dense = cut_lineage(mean.where(F.col("mean") >= settings.dense).select("bucket"))
        found.append(split.select("bucket", "node", "members").join(dense, "bucket", "left_semi").select(*sized.columns))
        split = split.join(dense, "bucket", "left_anti")
        children = F.array(*(F.xxhash64("bucket", c, F.get("sketch", c)) for c in chosen))
        rows = split.select("node", F.explode(F.array_distinct(children)).alias("bucket"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def compare_block(table: pa.Table, low: int, high: int, similarity: float) -> list[tuple[bytes, bytes, int]]:
    """(node, smallest linked node, documents linked) for the nodes of a block pair with a link."""
    node = table.column("node").to_pylist()
    copies = np.array(table.column("copies").to_pylist(), np.int64)
    part = np.array(table.column("part").to_pylist())
    bucket = table.column("bucket")[0].as_py()
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    size = np.array([len(s) for s in sets])
    m = len(sets)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    begins = np.r_[True, flat[1:] != flat[:-1]]
    token = np.cumsum(begins) - 1
    shared = np.bincount(token)[token] > 1
    token, owner = np.unique(token[shared], return_inverse=True)[1], owner[shared]
    common = np.zeros((m, m), np.float32)
    if m > 64:
        # tokens of few nodes add their pairs one by one; the others go through a dense product
        first, count = np.unique(token, return_index=True, return_counts=True)[1:]
        for c in range(2, RARE + 1):
            places = owner[first[count == c][:, None] + np.arange(c)]
            for i in range(c) if len(places) else ():
                for j in range(c):
                    np.add.at(common, (places[:, i], places[:, j]), 1)
        often = np.repeat(count > RARE, count)
        token, owner = np.unique(token[often], return_inverse=True)[1], owner[often]
    width = 4096
    for start in range(0, int(token.max()) + 1 if len(token) else 0, width):
        a, b = np.searchsorted(token, [start, start + width])
        dense = np.zeros((m, width), np.float32)
        dense[owner[a:b], token[a:b] - start] = 1
        common += dense @ dense.T
    union = size[:, None] + size - common
    linked = common >= similarity * union - 1e-6
    np.fill_diagonal(linked, False)
    if low != high:  # pairs within a part are compared where the part meets itself
        linked &= part[:, None] != part
    if not linked.any():
        return []
    label = np.arange(m)
    while True:
        near = np.minimum(label, np.where(linked, label, m).min(axis=1))
        near = near[near]
        if (near == label).all():
            break
        label = near
    met: dict[int, list[int]] = {}
    for i, own in enumerate(table.column("buckets").to_pylist()):
        for other in own:
            if other < bucket:
                met.setdefault(other, []).append(i)
    counted = linked.copy()
    for members in met.values():
        if len(members) > 1:
            counted[np.ix_(members, members)] = False
    links = counted @ copies
    best: dict[int, bytes] = {}
    for i, r in enumerate(label.tolist()):
        best[r] = min(best.get(r, node[i]), node[i])
    return [(node[i], best[label[i]], int(links[i])) for i in np.flatnonzero(linked.any(axis=1))]


def components(edges: DataFrame) -> DataFrame:
    """The smallest node that each node is connected with: node, root. ``edges`` has node and root, in one direction."""
    pairs = edges.where("node != root").select("node", "root").distinct()
    both = cut_lineage(pairs.unionByName(pairs.select(F.col("root").alias("node"), F.col("node").alias("root"))))
    if both.count() <= broadcast_rows(edges.sparkSession):
        both = cut_lineage(both.coalesce(1))  # few edges: in one partition the joins need no exchange
    labels = cut_lineage(both.groupBy("node").agg(F.min("root").alias("root")).withColumn("root", F.least("node", "root")))
    while True:
        seen = both.select("node", F.col("root").alias("other")).join(labels.select(F.col("node").alias("other"), "root"), "other")
        nearest = seen.groupBy("node").agg(F.min("root").alias("near"))
        step = labels.join(nearest, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        # a jump to the label's own label halves the distance left
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        moved = cut_lineage(step.join(jump, "root").select("node", "old", F.least("root", "far").alias("root")))
        labels = moved.select("node", "root")
        if moved.where("old != root").isEmpty():
            return labels


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= broadcast_rows(df.sparkSession) else df


def similarity_join(docs: DataFrame, settings: JoinSettings = JoinSettings()) -> DataFrame:
    """One row per document row: doc_id, text_hash, class_id, n_links, n_copies, representative.

    Documents are linked if the Jaccard similarity of their sets of word shingles is at least the
    threshold. ``n_links`` counts the linked other documents, ``n_copies`` those of them with the same
    set. Documents connected by links share a class; its id is their smallest doc_id, and the row with
    that id (and the smallest text_hash, if the id repeats) is the ``representative``; of fully repeated
    rows all are marked. Texts that are null, empty or without words are linked to nothing and
    represent themselves. A class whose ids are all null has a null id. Repeated rows are copies of each
    other. Only doc_id and text are read.
    """
    rows = store(sketches(docs, settings), "sketches")
    lead = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    nodes = store(
        rows.where("n > 0").groupBy("node").agg(F.min(lead).alias("lead"), F.count("*").alias("copies"), F.first("sketch").alias("sketch")), "nodes"
    )
    found = store(leaves(nodes, settings), "leaves")
    member = found.groupBy("node").agg(F.sort_array(F.collect_list("bucket")).alias("buckets"))
    info = store(member.join(nodes.select("node", "lead", "copies"), "node").select("node", "buckets", "copies", "lead.doc_id", "lead.text_hash"), "members")

    def make_sets(batches):
        memo: dict[str, int] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 250):
                part = batch.slice(start, 250)
                sets = [shingles(t, settings.words, memo).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    right = small(info.select("node", F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash")))
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").join(
        right, (F.col("text_hash") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__doc"))
    )
    sets = texts.select("node", "text").mapInArrow(make_sets, "node binary, shingles binary").dropDuplicates(["node"])
    parts = F.ceil(F.col("members") / settings.block).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    placed = found.withColumn("parts", parts).withColumn("part", own)
    meet = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("part")).alias("low"), F.greatest(o, F.col("part")).alias("high")))
    dealt = placed.select("bucket", "node", "part", F.explode(meet).alias("p")).select("bucket", "node", "part", "p.low", "p.high")
    whole = dealt.join(info.select("node", "buckets", "copies").join(sets, "node"), "node")

    def compare(batches):
        for key, table in groups_in_order(batches, ["bucket", "low", "high"]):
            out = compare_block(table, key[1], key[2], settings.similarity)
            if out:
                node, root, links = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(root, pa.binary()), pa.array(links, pa.int64())], names=["node", "root", "links"])

    ordered = whole.select("bucket", "low", "high", "node", "part", "copies", "buckets", "shingles").repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    edges = store(ordered.mapInArrow(compare, "node binary, root binary, links long"), "links")
    links = edges.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(edges).join(links, "node", "left")
    table = nodes.select("node", "lead", "copies").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    table = store(table.select("node", "lead", "copies", "root", F.coalesce("links", F.lit(0)).alias("links")), "classes")
    heads = table.groupBy("root").agg(F.min("lead").alias("head"))
    classes = store(table.join(heads, "root").select(F.col("node").alias("__node"), "copies", "links", "head"), "heads")
    answer = rows.select("doc_id", "text_hash", "node", "n").join(small(classes), F.col("node") == F.col("__node"), "left")
    alone = F.col("n") == 0
    first = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash"))
    return answer.select(
        "doc_id", "text_hash", F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.when(alone, 0).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
        F.when(alone, 0).otherwise(F.col("copies") - 1).cast("long").alias("n_copies"), (alone | first).alias("representative"),
    )
