"""Row manifests: pin a read to recorded rows, and audit whether those rows are unchanged.

The digest is the root of a tree of hashes over ids. Each row text is hashed with SHA-256; a leaf
holds the rows of one chunk of ids, an inner node a fixed number of neighbouring nodes. A node's
digest is taken over the sums of its children's hashes (each cut into four 60-bit numbers), so it
does not depend on the order of rows and needs partial aggregations only, no sort. Two trees are
compared from the root down, and only children of nodes that differ are read.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwell.functions.text import row_text
from panelwell.operators.ordered import ordered_columns
from panelwell.session import broadcast_rows, cut_lineage, store

#: Up to this many ranges become one pushed-down predicate; more are joined by id block.
PREDICATE_RANGES = 50

ID_BLOCK = 1 << 16

#: A leaf of the digest tree covers so many ids, an inner node so many nodes; the root is at ``ROOT``.
CHUNK_IDS = 1 << 12
FANOUT = 1 << 8
ROOT = 3


def ranges_frame(spark: SparkSession, ranges: Sequence[tuple[int, int]]) -> DataFrame:
    schema = T.StructType([T.StructField("first_id", T.LongType()), T.StructField("last_id", T.LongType())])
    return spark.createDataFrame([(int(a), int(b)) for a, b in ranges], schema)


def write_by_id(df: DataFrame, path: str, block_ids: int = ID_BLOCK) -> DataFrame:
    """Writes a table with one folder per block of ``block_ids`` ids (column ``id_block``) and reads it back.

    A block is written by one task and sorted, so that ranges prune folders, and row groups inside them.
    ``block_ids`` is chosen for files of some hundred MB; rows without an id have a folder of their own.
    """
    block = F.floor(F.col("id") / F.lit(block_ids).cast("bigint")).cast("bigint")
    placed = df.withColumn("id_block", block).repartition("id_block").sortWithinPartitions("id_block", "id")
    placed.write.mode("overwrite").partitionBy("id_block").parquet(path)
    fields = [f for f in df.schema.fields if f.name != "id_block"]
    schema = T.StructType([*fields, T.StructField("id_block", T.LongType())])
    return df.sparkSession.read.schema(schema).parquet(path)


def pinned_scan(
    df: DataFrame, ranges: Sequence[tuple[int, int]] | DataFrame | None, block_ids: int = ID_BLOCK
) -> DataFrame:
    """Rows whose ``id`` lies in any inclusive range. ``None`` (table not listed) keeps all rows.

    A short list is a predicate that reaches the scan. A table of ranges is joined: each range
    is cut into id blocks, rows look up their own block, and the range bounds are the residual.
    Overlapping ranges are merged first, so the block table stays proportional to the ids covered.
    A table with a column ``id_block`` (see ``write_by_id``; same ``block_ids``) is read from the folders
    of the wanted blocks only.
    """
    if ranges is None:
        return df
    if not isinstance(ranges, DataFrame):
        if not ranges:
            return df.filter(F.lit(False))
        if len(ranges) <= PREDICATE_RANGES:
            keep = F.lit(False)
            for first, last in ranges:
                inside = F.col("id").between(F.lit(int(first)), F.lit(int(last)))
                if "id_block" in df.columns:
                    inside = inside & F.col("id_block").between(int(first) // block_ids, int(last) // block_ids)
                keep = keep | inside
            return df.filter(keep)
        ranges = ranges_frame(df.sparkSession, ranges)
    return _pinned_by_block(df, ranges, block_ids)


def _pinned_by_block(df: DataFrame, ranges: DataFrame, block_ids: int) -> DataFrame:
    block = F.lit(block_ids).cast("bigint")
    laid_out = "id_block" in df.columns
    # ranges that end beyond the table would only add empty blocks; folder names tell the ends of a laid out table
    ends = [F.min("id_block") * block, (F.max("id_block") + 1) * block - 1] if laid_out else [F.min("id"), F.max("id")]
    bounds = df.agg(ends[0].alias("low"), ends[1].alias("high")).first()
    if bounds["low"] is None:
        return df.filter(F.lit(False))
    clipped = ranges.select(
        F.greatest("first_id", F.lit(bounds["low"])).alias("first_id"),
        F.least("last_id", F.lit(bounds["high"])).alias("last_id"),
    ).filter("first_id <= last_id")
    # the filter tells the optimizer that the blocks are few, so that it prunes folders by them
    merged = merge_ranges(clipped).filter("first_id <= last_id")
    blocks = merged.withColumn(
        "__wanted", F.explode(F.sequence(F.floor(F.col("first_id") / block), F.floor(F.col("last_id") / block)))
    )
    if blocks.limit(broadcast_rows(df.sparkSession) + 1).count() <= broadcast_rows(df.sparkSession):
        blocks = F.broadcast(blocks)
    rows = df if laid_out else df.withColumn("__block", F.floor(F.col("id") / block))
    own = rows["id_block"] if laid_out else rows["__block"]
    hit = (own == blocks["__wanted"]) & rows["id"].between(blocks["first_id"], blocks["last_id"])
    return rows.join(blocks, hit, "left_semi").drop("__block")


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """Overlapping or touching ranges become one."""
    distinct = cut_lineage(ranges.distinct())
    reach = ordered_columns(
        distinct, [], [F.col("first_id"), F.col("last_id")], maxima={"__reach": F.col("last_id")}
    )
    lagged = ordered_columns(
        reach, [], [F.col("first_id"), F.col("last_id")], lags={"__prev": F.col("__reach")}
    )
    starts = F.when(F.col("__prev").isNull() | (F.col("first_id") > F.col("__prev") + 1), 1).otherwise(0)
    grouped = ordered_columns(
        lagged, [], [F.col("first_id"), F.col("last_id")], sums={"__island": starts}
    )
    return grouped.groupBy("__island").agg(
        F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id")
    ).select("first_id", "last_id")


def id_ranges(df: DataFrame, block_rows: int = ID_BLOCK) -> DataFrame:
    """Distinct ids collapsed into inclusive runs.

    Two levels: runs inside each block of ids (a block has at most ``block_rows`` distinct
    ids, so its window is bounded), then runs that touch at a block edge are stitched.
    """
    width = F.lit(block_rows).cast("bigint")
    ids = df.select(F.col("id").cast("bigint").alias("id")).filter("id is not null").distinct()
    ids = ids.withColumn("__block", F.floor(F.col("id") / width))
    rank = F.row_number().over(Window.partitionBy("__block").orderBy("id"))
    runs = (
        ids.withColumn("__island", F.col("id") - rank)
        .groupBy("__block", "__island")
        .agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
        .select("first_id", "last_id")
    )
    # the two passes below count the runs before they order them; the runs are written once
    runs = cut_lineage(runs)
    linked = ordered_columns(runs, [], [F.col("first_id")], lags={"__prev": F.col("last_id")})
    starts = F.when(F.col("__prev") + 1 == F.col("first_id"), 0).otherwise(1)
    grouped = ordered_columns(linked, [], [F.col("first_id")], sums={"__run": starts})
    return (
        grouped.groupBy("__run")
        .agg(F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"))
        .select("first_id", "last_id", (F.col("last_id") - F.col("first_id") + 1).alias("n_ids"))
    )


def canonical_row(df: DataFrame, json_columns: Collection[str] = ()) -> DataFrame:
    """``id`` (if any) and the stable text of each row."""
    text = row_text([(F.col(f.name), f.dataType, f.name in json_columns) for f in df.schema.fields])
    keep = [F.col("id")] if "id" in df.columns else []
    return df.select(*keep, text.alias("row_text"))


def _lanes(digest: Column) -> list[Column]:
    return [
        F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)
    ]


def _parent(node: Column | str, level: int) -> Column:
    """Number of the node at ``level`` over a node of the level below; rows without id stay apart."""
    node = F.col(node) if isinstance(node, str) else node
    return F.lit(0).cast("bigint") if level == ROOT else F.floor(node / F.lit(FANOUT)).cast("bigint")


def _node_columns(head: Column, digest: str, rows: Column) -> list[Column]:
    """Aggregates that yield ``rows`` and ``digest`` of a node from its children's digests."""
    zero = F.lit(0).cast("decimal(38,0)")
    lanes = [F.coalesce(F.sum(lane).cast("decimal(38,0)"), zero).cast("string") for lane in _lanes(F.col(digest))]
    rows = F.coalesce(rows, F.lit(0)).cast("bigint")
    return [rows.alias("rows"), F.sha2(F.concat_ws("\n", head, rows.cast("string"), *lanes), 256).alias("digest")]


def _named(level: int) -> Column:
    return F.concat_ws("\n", F.lit(str(level)), F.coalesce(F.col("node").cast("string"), F.lit("none")))


def _leaves(df: DataFrame, json_columns: Collection[str]) -> DataFrame:
    text = canonical_row(df, json_columns)
    chunk = F.floor(F.col("id") / F.lit(CHUNK_IDS)) if "id" in df.columns else F.lit(None)
    hashed = text.select(chunk.cast("bigint").alias("node"), F.sha2("row_text", 256).alias("__hash"))
    return hashed.groupBy("node").agg(*_node_columns(_named(0), "__hash", F.count(F.lit(1))))


def _above(nodes: DataFrame, level: int) -> DataFrame:
    grouped = nodes.select(_parent("node", level).alias("node"), "rows", F.col("digest").alias("__hash")).groupBy("node")
    return grouped.agg(*_node_columns(_named(level), "__hash", F.sum("rows")))


def _root(nodes: DataFrame, columns: Sequence[str]) -> DataFrame:
    return nodes.withColumnRenamed("digest", "__hash").agg(*_node_columns(F.lit("\x1f".join(columns)), "__hash", F.sum("rows")))


def table_digest(df: DataFrame, json_columns: Collection[str] = ()) -> DataFrame:
    """One row: number of rows and content digest of the table, the root of its digest tree.

    An empty table has 0 rows and the digest of its column names.
    """
    nodes = _leaves(df, json_columns)
    for level in range(1, ROOT):
        nodes = _above(nodes, level)
    return _root(nodes, df.columns)


def digest_tree(df: DataFrame, json_columns: Collection[str] = ()) -> DataFrame:
    """All nodes ``(level, node, rows, digest)`` of a table's digest tree; one root, node 0 of level ``ROOT``.

    Node numbers are id chunks at level 0, null for rows without id. The leaves, a small fraction of
    the table, are written once and every level is taken from them.
    """
    nodes = store(_leaves(df, json_columns), "digest-leaves")
    tree = nodes.select(F.lit(0).alias("level"), "node", "rows", "digest")
    for level in range(1, ROOT):
        nodes = _above(nodes, level)
        tree = tree.unionByName(nodes.select(F.lit(level).alias("level"), "node", "rows", "digest"))
    root = _root(nodes, df.columns).select(F.lit(ROOT).alias("level"), F.lit(0).cast("bigint").alias("node"), "rows", "digest")
    return tree.unionByName(root)


def changed_chunks(found: DataFrame, recorded: DataFrame) -> DataFrame:
    """The id chunks in which tables differ from their recorded trees.

    Both sides are trees with their ``table`` name. Returns ``(table, first_id, last_id, rows,
    pinned_rows, status)``: ``added`` and ``deleted`` chunks are on one side only, ``changed`` ones
    on both. Ids are null for the chunk of rows without id. Tables that only one side has, and
    tables of other columns but equal rows, have no chunks here; ``manifest_audit`` names them.
    """

    def side(tree: DataFrame, level: int, rows: str, digest: str) -> DataFrame:
        at = tree.filter(F.col("level") == level)
        return at.select("table", F.col("node").alias("__node"), F.col("rows").alias(rows), F.col("digest").alias(digest))

    now, then = side(found, ROOT, "rows", "__now"), side(recorded, ROOT, "pinned_rows", "__then")
    nodes = now.join(then, ["table", "__node"]).filter("__now <> __then")
    for level in range(ROOT - 1, -1, -1):
        # few nodes differ, as a rule; written so that both sides read the same ones
        over = cut_lineage(nodes.select(F.col("table").alias("__table"), F.col("__node").alias("__over")))

        def under(part: DataFrame) -> DataFrame:
            child = (part["table"] == over["__table"]) & _parent(part["__node"], level + 1).eqNullSafe(over["__over"])
            return part.join(over, child, "left_semi")

        now = under(side(found, level, "rows", "__now")).withColumnRenamed("table", "__t").withColumnRenamed("__node", "__n")
        then = under(side(recorded, level, "pinned_rows", "__then"))
        same = (F.col("__t") == F.col("table")) & F.col("__n").eqNullSafe(F.col("__node"))
        nodes = (
            now.join(then, same, "full")
            .filter(~F.col("__now").eqNullSafe(F.col("__then")))
            .select(F.coalesce("table", "__t").alias("table"), F.coalesce("__node", "__n").alias("__node"), "rows", "pinned_rows", "__now", "__then")
        )
    status = F.when(F.col("__then").isNull(), "added").when(F.col("__now").isNull(), "deleted").otherwise("changed")
    first = F.col("__node") * F.lit(CHUNK_IDS)
    return nodes.select(
        "table", first.alias("first_id"), (first + F.lit(CHUNK_IDS - 1)).alias("last_id"),
        F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("pinned_rows", F.lit(0)).alias("pinned_rows"), status.alias("status"),
    )


def write_manifest(df: DataFrame, path: str, table: str, json_columns: Collection[str] = ()) -> DataFrame:
    """Writes the manifest of a table: its id ranges (JSON, one line each) under ``ranges``, its row
    count and digest (JSON) under ``tables``, its digest tree (Parquet by level) under ``tree``.
    Ranges are rows, not one document, so a table with many gaps is written in parallel."""
    named = id_ranges(df).select(F.lit(table).alias("table"), "first_id", "last_id")
    named.write.mode("overwrite").json(f"{path}/ranges")
    tree = digest_tree(df, json_columns).select(F.lit(table).alias("table"), "level", "node", "rows", "digest")
    tree.write.mode("overwrite").partitionBy("level").parquet(f"{path}/tree")
    root = read_manifest_tree(df.sparkSession, path).filter(F.col("level") == ROOT)
    root.select("table", "rows", "digest").write.mode("overwrite").json(f"{path}/tables")
    return read_manifest(df.sparkSession, path)


def read_manifest_tree(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's tree rows ``(table, level, node, rows, digest)``."""
    schema = "table string, node bigint, rows bigint, digest string, level int"
    return spark.read.schema(schema).parquet(f"{path}/tree").select("table", "level", "node", "rows", "digest")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's table rows ``(table, rows, digest)``."""
    return spark.read.schema("table string, rows bigint, digest string").json(f"{path}/tables")


def read_manifest_ranges(spark: SparkSession, path: str, table: str) -> DataFrame:
    ranges = spark.read.schema("table string, first_id bigint, last_id bigint").json(f"{path}/ranges")
    return ranges.filter(F.col("table") == table).select("first_id", "last_id")


def manifest_audit(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Status per table. ``found`` and ``manifest`` have ``(table, rows, digest)``, one row per table."""
    listed = manifest.select("table", F.col("rows").alias("pinned_rows"), F.col("digest").alias("pinned_digest"))
    status = (
        F.when(F.col("pinned_rows").isNull(), "unpinned")
        .when(F.col("rows") != F.col("pinned_rows"), "deleted")
        .when(F.col("digest") != F.col("pinned_digest"), "changed")
        .otherwise("match")
    )
    return found.join(listed, "table", "left").select("table", "rows", "pinned_rows", status.alias("status"))
