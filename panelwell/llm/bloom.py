"""Blocked Bloom filters of bounded size, built by Spark tasks and united by segments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: 64-bit words of one segment that tasks exchange.
SEGMENT = 8192


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class BlockedBloom:
    """A filter of blocks of eight 64-bit words; a key sets one bit in each word of its block."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits  # a power of two of words, eight at least

    @staticmethod
    def size(bits: int, most: int) -> int:
        """The number of 64-bit words for so many bits: a power of two, at most ``most`` bits."""
        return max(8, 1 << (min(max(bits, 512), most) - 1).bit_length() >> 6)

    def places(self, keys: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        block = (keys >> np.uint64(20)) & np.uint64(len(self.bits) // 8 - 1)
        # the bits come from another scrambling than the block
        bit = (mixed(keys + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(6 * i)) & np.uint64(63)
        return (block * np.uint64(8) + np.uint64(i)).astype(np.int64), np.uint64(1) << bit

    def add(self, keys: np.ndarray) -> None:
        for i in range(8):
            place, bit = self.places(keys, i)
            np.bitwise_or.at(self.bits, place, bit)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may have been added; surely True for those that were."""
        left = np.arange(len(keys))
        for i in range(8):
            place, bit = self.places(keys[left], i)
            left = left[self.bits[place] & bit != 0]
            if not len(left):
                break
        out = np.zeros(len(keys), bool)
        out[left] = True
        return out


def blooms_of(
    rows: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, np.ndarray]]], words: dict[int, int]
) -> dict[int, BlockedBloom]:
    """One filter per shard, of ``words[shard]`` 64-bit words, with all keys that ``hashes`` makes of the rows.

    Tasks send the segments they touched; they are united by segment, so the driver gets each filter once.
    """
    begin, total = {}, 0
    for shard, size in words.items():
        begin[shard], total = total, total + size

    def shards(bits: np.ndarray) -> dict[int, BlockedBloom]:
        return {shard: BlockedBloom(bits[at:at + words[shard]]) for shard, at in begin.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(total, np.uint64)
        own = shards(bits)
        for shard, keys in hashes(batches):
            own[shard].add(keys)
        for start in range(0, total, SEGMENT):
            part = bits[start:start + SEGMENT]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([start], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["start", "bits"])

    def unite(table: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(b.as_py(), np.uint64) for b in table.column("bits")])
        return pa.table({"start": table.column("start")[:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    whole = np.zeros(total, np.uint64)
    parts = rows.mapInArrow(run, "start long, bits binary").groupBy("start").applyInArrow(unite, "start long, bits binary").toArrow()
    for start, part in zip(parts.column("start").to_pylist(), parts.column("bits").to_pylist()):
        whole[start:start + SEGMENT] = np.frombuffer(part, np.uint64)
    return shards(whole)
