"""Spelling variants by Bloom-guided neighbourhoods.

The words of all texts and their counts are aggregated first. Blocked Bloom filters of the vocabulary, one
shard per word length, are built by Spark tasks and broadcast; their total size is bounded by the settings.
Each word's edits are generated as hashes alone: a polynomial hash of an edited word follows from that of
the word. Only edits that pass the filter of their length become strings and shuffle to the vocabulary,
where an equi-join removes the false positives, so the filters' size changes no result.

Being near is mutual, so a word probes only its deletions (insertions are deletions of the longer word)
and the replacements by a later letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwell.llm.bloom import BlockedBloom, blooms_of, mixed
from panelwell.llm.common import ship
from panelwell.session import broadcast_rows, store

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: The letters of runs after A-Z are lower-cased.
LETTERS = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.uint64)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


@dataclass(frozen=True)
class VariantSettings:
    """``every`` is how often a run loses a letter; words have ``letters`` and ``least`` occurrences at least, a form ``ratio`` times its word's.

    ``bits`` per word and at most ``most`` bits make the filters; ``held`` words are counted in a task
    before they are sent, and ``probes`` edits are generated at a time.
    """

    every: int = 97
    letters: int = 5
    least: int = 3
    ratio: int = 2
    bits: int = 16
    most: int = 1 << 29
    held: int = 500_000
    probes: int = 2_000_000


def noted_word(run: str, seed: int, every: int) -> str:
    """The run, without one code point where ``every`` divides the crc32 that continues ``seed`` with it."""
    h = zlib.crc32(run.encode(), seed)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, settings: VariantSettings) -> DataFrame:
    """word and n over all documents, for the words of enough letters and occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                part = batch.slice(start, 100)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                    if not text:
                        continue
                    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    # the lower() of bytes is that of A-Z alone
                    runs = Counter(RUN.findall(text.lower().decode()))
                    for word, n in runs.items():
                        if len(word) < settings.letters:
                            continue
                        word = noted_word(word, seed, settings.every)
                        if len(word) >= settings.letters:
                            total[word] = total.get(word, 0) + n
                    if len(total) >= settings.held:
                        yield sent()
                        total = {}
        if total:
            yield sent()

    counted = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= settings.least)


def letters_of(words: list[str]) -> np.ndarray:
    """The code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def powers(n: int, base: int = BASE) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, base, np.uint64)])[:max(1, n)]


def word_hashes(letters: np.ndarray) -> np.ndarray:
    return mixed((letters * powers(letters.shape[1])).sum(axis=1, dtype=np.uint64))


def edits(words: list[str], shards: dict[int, BlockedBloom], probes: int) -> Iterator[tuple[str, str]]:
    """(word, edit) for the edits of words of one length that pass the filters: all deletions, and replacements by a later letter."""
    n = len(words[0])
    step = max(1, probes // (n * len(LETTERS)))
    power = powers(n)
    for start in range(0, len(words), step):
        some = words[start:start + step]
        letters = letters_of(some)
        terms = letters * power
        whole = terms.sum(axis=1, dtype=np.uint64)
        if n - 1 in shards:
            before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
            after = (whole[:, None] - before - terms) * np.uint64(BASE_INVERSE)
            # of a run of one letter the first is deleted
            fresh = np.column_stack([np.ones(len(some), bool), letters[:, 1:] != letters[:, :-1]])
            row, at = np.nonzero(fresh)
            found = shards[n - 1].holds(mixed((before + after)[row, at]))
            for r, i in zip(row[found].tolist(), at[found].tolist()):
                yield some[r], some[r][:i] + some[r][i + 1:]
        if n in shards:
            # a few places at a time, so that one very long word stays bounded, too
            width = max(1, probes // (len(some) * len(LETTERS)))
            for first in range(0, n, width):
                own = letters[:, first:first + width, None]
                row, at, to = np.nonzero(LETTERS > own)
                key = whole[row] + (LETTERS[to] - letters[row, first + at]) * power[first + at]
                found = shards[n].holds(mixed(key))
                for r, i, c in zip(row[found].tolist(), (first + at[found]).tolist(), LETTERS[to[found]].tolist()):
                    yield some[r], f"{some[r][:i]}{chr(c)}{some[r][i + 1:]}"


def by_length(words: list[str]) -> dict[int, list[int]]:
    places: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        places.setdefault(len(word), []).append(i)
    return places


def vocabulary_filters(vocabulary: DataFrame, settings: VariantSettings) -> dict[int, BlockedBloom]:
    """A filter for each word length; all together have ``most`` bits at most, but for 512 per length."""
    counts = {r["size"]: r["count"] for r in vocabulary.groupBy(F.char_length("word").alias("size")).count().collect()}
    total = sum(counts.values())
    # sizes are rounded up to powers of two
    words = {size: BlockedBloom.size(settings.bits * n, max(512, settings.most // 2 * n // total)) for size, n in sorted(counts.items())}

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for batch in batches:
            some = batch.column(0).to_pylist()
            for size, places in by_length(some).items():
                step = max(1, settings.probes // size)
                for i in range(0, len(places), step):
                    yield size, word_hashes(letters_of([some[p] for p in places[i:i + step]]))

    return blooms_of(vocabulary.select("word"), hashes, words)


def near_pairs(vocabulary: DataFrame, settings: VariantSettings) -> DataFrame:
    """word, n, other, other_n: all pairs of near words, once each."""
    shared = ship(vocabulary.sparkSession, vocabulary_filters(vocabulary, settings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = shared()
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            known = dict(zip(words, counts))
            for places in by_length(words).values():
                out: list[tuple[str, str]] = []
                for pair in edits([words[p] for p in places], shards, settings.probes):
                    out.append(pair)
                    if len(out) >= 50_000:
                        yield rows(out, known)
                        out = []
                if out:
                    yield rows(out, known)

    def rows(pairs: list[tuple[str, str]], known: dict[str, int]) -> pa.RecordBatch:
        word, other = zip(*pairs)
        return pa.RecordBatch.from_arrays([pa.array(word), pa.array([known[w] for w in word], pa.int64()), pa.array(other)], names=["word", "n", "other"])

    probed = vocabulary.select("word", "n").mapInArrow(run, "word string, n long, other string")
    return probed.join(vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").select("word", "n", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """word and the last form that is reached from it; ``forms`` has word and form, without circles."""
    reached = store(forms.select("word", F.col("form").alias("root")), "roots")
    few = reached.count() <= broadcast_rows(forms.sparkSession)
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = reached.join(F.broadcast(further) if few else further, "root", "left")
        moved = store(step.select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        reached = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return reached


def spelling_variants(docs: DataFrame, settings: VariantSettings = VariantSettings()) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    A word's near words differ by one inserted, deleted or replaced code point; its form is the one of
    largest n (of equal ones the smallest word) if that is ``ratio`` times its own at least, else null.
    ``root`` is where following forms ends; counts at least double on the way, so there are no circles
    (``ratio`` is 2 or more). Null and empty texts and texts without letters have no words, a null doc_id
    counts as an empty one, and repeated rows count each. Only doc_id and text are read.
    """
    if settings.ratio < 2:
        raise ValueError("ratio must be 2 at least")
    vocabulary = store(word_counts(docs, settings), "vocabulary")
    pairs = store(near_pairs(vocabulary, settings), "near-words")
    nearest: list[Column] = [F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word"))).alias("best")]
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    near = both.groupBy("word").agg(*nearest)
    counted = vocabulary.join(near, "word", "left")
    enough = -F.col("best.less") >= F.col("n") * settings.ratio
    table = store(counted.select(
        "word", F.when(enough, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, -F.col("best.less")).alias("form_n"),
    ), "forms")
    ends = roots(table.where("form IS NOT NULL"))
    return table.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
