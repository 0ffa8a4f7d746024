"""Session settings and lineage cuts shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: A group of at most this many rows may be ordered inside one task. Larger groups are
#: split into range segments first (see ``operators.ordered``).
GROUP_ROWS_KEY = "spark.panelwell.groupRows"
GROUP_ROWS_DEFAULT = 2_000_000

#: A table of at most this many rows may be broadcast once its size has been counted.
BROADCAST_ROWS_KEY = "spark.panelwell.broadcastRows"
BROADCAST_ROWS_DEFAULT = 200_000


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("panelwell")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # rows are few but costly here: small shuffles should still use all cores
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(GROUP_ROWS_KEY, str(GROUP_ROWS_DEFAULT)))


def broadcast_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_ROWS_KEY, str(BROADCAST_ROWS_DEFAULT)))


def require_utc(spark: SparkSession) -> None:
    """Naive timestamps are turned into microseconds through the session zone, which must be UTC."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"spark.sql.session.timeZone must be UTC for the time grid; got {zone!r}")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared checkpoint folder of the session; a private one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master == "local" or context.master.startswith("local["):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="panelwell-checkpoint-"))
    else:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and continues from the written rows.

    Used where two consumers must see the very same rows (range segments, iterative jumps):
    after an executor loss the rows are read back instead of being recomputed.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@dataclass
class Run:
    """The stored copies of one run: their folder, and which plan each of them holds."""

    folder: str
    copies: dict[tuple, list[tuple[DataFrame, DataFrame]]] = field(default_factory=dict)

    def find(self, df: DataFrame, key: tuple) -> DataFrame | None:
        # equal hashes only nominate a copy: the plans themselves are compared
        return next((copy for plan, copy in self.copies.get(key, []) if plan.sameSemantics(df)), None)


_RUN: ContextVar[Run | None] = ContextVar("panelwell_run", default=None)


@contextmanager
def run_scope(spark: SparkSession) -> Iterator[Run]:
    """A run that owns what is stored and checkpointed inside it.

    All of it lies in one fresh folder of the shared checkpoint folder. Inside the run, a plan that has
    been stored already is read from its copy instead of being written again; equal plans are found by
    their fingerprint. The folder is removed at the end, also after an error, so results have to be
    written or collected inside. Runs may be nested; an inner one owns its own copies.

    Input tables must not change during a run. Only deterministic plans are shared; ``store`` writes
    others (random numbers, partition ids) anew.
    """
    ensure_checkpoint_dir(spark)
    context = spark.sparkContext
    outer = context.getCheckpointDir()
    run = Run(f"{outer}/run-{uuid.uuid4().hex}")
    context.setCheckpointDir(run.folder)
    token = _RUN.set(run)
    try:
        yield run
    finally:
        _RUN.reset(token)
        # the context opens a new folder below the one that is named, so name the parent
        context.setCheckpointDir(outer.rsplit("/", 1)[0])
        path = context._jvm.org.apache.hadoop.fs.Path(run.folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the session's checkpoints, which all executors can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/panelwell/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it from there.

    Unlike a checkpoint, later readers see only the columns and partitions they ask for. Inside a
    ``run_scope`` an equal plan is written once, and the copy is removed when the run ends.
    """
    run = _RUN.get()
    deterministic = run is not None and df._jdf.queryExecution().analyzed().deterministic()
    key = (df.semanticHash(), tuple(partition_by), df.schema.json()) if deterministic else None
    if key is not None and (copy := run.find(df, key)) is not None:
        return copy
    path = shared_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    copy = df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
    if key is not None:
        run.copies.setdefault(key, []).append((df, copy))
    return copy


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
