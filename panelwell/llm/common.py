"""Helpers that the training-data operators share."""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of ASCII letters and digits or of any characters beyond ASCII.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = re.compile(WORD_PATTERN)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = {ord(a): b for a, b in zip(UPPER, LOWER)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[str]:
    """The words of a text, A-Z lower-cased; null has none."""
    if not text:
        return []
    return WORD.findall(text.lower() if text.isascii() else text.translate(TO_LOWER))


def hash_number(column: Column, digits: int = 15) -> Column:
    """A number below 16**digits from the MD5 of a string; the same in SQL."""
    return F.conv(F.substring(F.md5(column), 1, digits), 16, 10).cast("long")


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; null ids are never held out (1)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(1).cast("long"))


def groups_in_order(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Cuts a stream whose equal keys are adjacent into one table per key.

    Holds the rows of one key and one batch at a time.
    """
    held: list[pa.RecordBatch] = []
    current: tuple | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        rows = list(zip(*columns))
        start = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i] != rows[start]:
                piece = batch.slice(start, i - start)
                if current is not None and rows[start] != current:
                    yield current, pa.Table.from_batches(held)
                    held = []
                current = rows[start]
                held.append(piece)
                start = i
    if current is not None:
        yield current, pa.Table.from_batches(held)


def ship(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcasts ``value`` with the code of its classes; a task calls the result to get it. Its size must be bounded."""
    from pyspark import cloudpickle

    shared = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(shared.value)


def in_pieces(text: str, size: int = 1_000_000) -> Iterator[str]:
    """Cuts a long text where a non-space is followed by white space, so that no word is cut."""
    start, n = 0, len(text)
    while n - start > size:
        at = start + size
        while at < n and (text[at - 1].isspace() or not text[at].isspace()):
            at += 1
        yield text[start:at]
        start = at
    yield text[start:]
