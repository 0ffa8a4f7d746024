"""Token counts of byte-level BPE by rank-synchronous merging of ragged arrays.

A batch of texts is cut into pre-tokens; the distinct ones that have no count yet are held as one
flat array of symbols with a start per pre-token. In each round every pre-token finds the lowest
rank among its adjacent pairs and merges all its pairs of that rank at once, left to right. A
pre-token without a ranked pair is finished: its surviving symbols are its tokens.

Merging all pairs of the lowest rank at once equals merging them one by one: a pair made by a merge
always has a higher rank than the merge, because its symbol is learned later.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwell.llm.common import in_pieces, ship

NO_RANK = np.iinfo(np.int32).max
#: Known counts kept per task, and pre-tokens merged together; both bound memory, not the result.
MEMO, BLOCK = 400_000, 65_536


def pre_token(last: int | None) -> re.Pattern:
    """The published pre-token pattern of this vocabulary, for texts without characters beyond ``last``.

    Fixed value: the pattern's branches. With a bound, letters, numbers and white space are spelled as
    character ranges, so that the faster standard engine can match them from a bitmap. Words come first
    because no other branch can match where they do.
    """
    names = {"L": r"\p{L}", "N": r"\p{N}", "White_Space": r"\p{White_Space}"}
    if last is not None:
        every = "".join(chr(c) for c in range(last + 1) if not 0xD800 <= c < 0xE000)
        for name in names:
            runs = regex.findall(rf"\p{{{name}}}+", every)
            names[name] = "".join(f"{re.escape(run[0])}-{re.escape(run[-1])}" for run in runs)
    letter, number, space = names.values()
    return (regex if last is None else re).compile(
        rf" ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


@dataclass(frozen=True)
class Merges:
    """Symbols are numbered by vocabulary id; ``keys`` are sorted pairs, with their rank and merged symbol."""

    byte_symbol: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    width: int
    special: tuple[str, ...]

    @classmethod
    def from_json(cls, text: str) -> "Merges":
        data = json.loads(text)
        vocab = data["model"]["vocab"]
        width = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        keys = np.array([vocab[a] * width + vocab[b] for a, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys, kind="stable")
        return cls(
            np.array([vocab[c] for c in byte_letters()], np.int32), keys[order], order.astype(np.int32), merged[order],
            width, tuple(t["content"] for t in data.get("added_tokens", ()) if t["special"]),
        )

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], NO_RANK), np.where(found, self.merged[at], -1)


def merge_counts(pieces: list[bytes], merges: Merges) -> np.ndarray:
    """Symbols that survive in each (non-empty) pre-token."""
    counts = np.zeros(len(pieces), np.int64)
    length = np.fromiter(map(len, pieces), np.int64, len(pieces))
    symbols = merges.byte_symbol[np.frombuffer(b"".join(pieces), np.uint8)]
    owner = np.repeat(np.arange(len(pieces)), length)
    rank, target = np.full(len(symbols), NO_RANK, np.int32), np.full(len(symbols), -1, np.int32)
    stale = np.ones(len(symbols), bool)
    while len(symbols):
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        last = np.r_[first[1:], len(symbols)] - 1
        stale[last] = False
        rank[last] = NO_RANK
        at = np.flatnonzero(stale)
        rank[at], target[at] = merges.look_up(symbols[at], symbols[at + 1])
        lowest = np.minimum.reduceat(rank, first)
        size = last - first + 1
        done = lowest == NO_RANK
        counts[owner[first[done]]] = size[done]
        hit = (rank == np.repeat(lowest, size)) & (rank != NO_RANK)
        # overlapping hits (aaa) merge from the left: every second one of a run
        position = np.arange(len(symbols))
        run_start = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], position, 0))
        hit &= (position - run_start) % 2 == 0
        symbols = np.where(hit, target, symbols)
        gone = np.r_[False, hit[:-1]]
        changed = hit.copy()
        keep = ~gone & ~np.repeat(done, size)
        symbols, owner, rank, target, changed = symbols[keep], owner[keep], rank[keep], target[keep], changed[keep]
        stale = changed | np.r_[changed[1:], False]
    return counts


class Counter:
    """Counts texts; keeps the counts of pre-tokens it has seen."""

    def __init__(self, merges: Merges):
        self.merges, self.known, self.patterns = merges, {}, {}
        self.special = re.compile("|".join(re.escape(s) for s in merges.special)) if merges.special else None

    def cut(self, text: str) -> list[str]:
        narrow = len(text.encode("utf-16-le")) == 2 * len(text)
        last = 0x7F if text.isascii() else 0xFFFF if narrow else None
        if last not in self.patterns:
            self.patterns[last] = pre_token(last)
        return self.patterns[last].findall(text)

    def learn(self, tokens: set[str]) -> None:
        fresh = [t for t in tokens if t not in self.known]
        if len(self.known) + len(fresh) > MEMO:
            self.known.clear()
            fresh = list(tokens)
        fresh.sort(key=len)
        for i in range(0, len(fresh), BLOCK):
            block = fresh[i:i + BLOCK]
            self.known.update(zip(block, merge_counts([t.encode() for t in block], self.merges).tolist()))

    def plain(self, text: str) -> int:
        total = 0
        for piece in in_pieces(text):
            tokens = self.cut(piece)
            self.learn(set(tokens))
            total += sum(map(self.known.__getitem__, tokens))
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.plain(p) for p in parts if p)

    def count_all(self, texts: list[str | None]) -> list[int]:
        """As count, with the pre-tokens of short texts learned together."""
        pieces = [None if t is None or len(t) > 200_000 or (self.special and self.special.search(t)) else self.cut(t) for t in texts]
        self.learn({token for tokens in pieces if tokens for token in tokens})
        known = self.known
        short = [None if c is None else sum(map(known.__getitem__, c)) for c in pieces]
        return [self.count(t) if n is None else n for t, n in zip(texts, short)]


def count_tokens(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 512) -> DataFrame:
    """Adds up the tokens of whole texts: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    One row per input row in any order of rows; repeated ids and rows are counted each. A null or
    empty text has 0 bytes and tokens; a null id stays null. The special strings of the tokenizer
    count one token each, as its library does by default. Other columns are not read, so their names
    cannot clash. No shuffle; the merge table (bounded by the vocabulary) goes to each task.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        merges = ship(spark, Merges.from_json(file.read()))
    id_type = docs.schema[id_column].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(merges())
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                tokens = counter.count_all(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                    names=["id", "n_bytes", "n_tokens", "over_limit"],
                )

    text = F.col(text_column)
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    kind = id_type.simpleString()
    counted = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return counted.withColumnRenamed("id", id_column)
