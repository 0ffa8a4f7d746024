"""Stored copies belong to a run: reused inside it, gone after it."""

import pathlib

import pytest
from pyspark.sql import functions as F

from panelwell.session import cut_lineage, ensure_checkpoint_dir, run_scope, shared_path, store


def root(spark):
    ensure_checkpoint_dir(spark)
    return pathlib.Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))


def files(folder):
    return sorted(str(p) for p in folder.rglob("*") if p.is_file())


def numbers(spark, n=50):
    return spark.range(n).select("id", (F.col("id") % 3).alias("part"))


def test_copies_are_reused_and_removed(spark):
    folder = root(spark)
    before = files(folder)
    with run_scope(spark) as run:
        first = store(numbers(spark), "numbers")
        written = files(folder)
        again = store(numbers(spark), "same")
        assert files(folder) == written != before
        assert first.inputFiles() == again.inputFiles()
        # another plan, another layout and a plan with random numbers get copies of their own
        assert store(numbers(spark, 51), "more").count() == 51
        assert store(numbers(spark), "numbers", ["part"]).columns == ["id", "part"]
        drawn = numbers(spark).withColumn("r", F.rand())
        assert store(drawn, "drawn").inputFiles() != store(drawn, "drawn").inputFiles()
        assert cut_lineage(again).agg(F.sum("id")).first()[0] == 1225
        assert pathlib.Path(run.folder.removeprefix("file:")).is_dir()
    assert files(folder) == before
    assert not pathlib.Path(run.folder.removeprefix("file:")).exists()
    # outside of a run nothing is shared
    assert store(numbers(spark), "a").inputFiles() != store(numbers(spark), "a").inputFiles()


def test_a_failed_run_leaves_nothing_and_runs_nest(spark):
    folder = root(spark)
    before = files(folder)
    with pytest.raises(ValueError, match="stop"), run_scope(spark):
        outer = store(numbers(spark), "outer")
        with run_scope(spark):
            inner = store(numbers(spark), "inner")
            assert inner.inputFiles() != outer.inputFiles()
        assert store(numbers(spark), "outer").count() == outer.count() == 50
        raise ValueError("stop")
    assert files(folder) == before and len(root(spark).parts) == len(folder.parts)
    assert store(numbers(spark), "after").count() == 50 and shared_path(spark, "x").startswith("file:")
