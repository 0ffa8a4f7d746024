"""Phrase collocations from weighted acyclic automata.

Each task holds a bounded number of words, sorts their n-grams and builds from them, order by order, a
count transducer: an acyclic automaton over words whose arcs carry how often the phrase read so far
occurs. Equal states of one arc are merged through a register. The transducers are cut at borders in
phrase order; those of one prefix range meet in one task, which unites them and sums their weights. A
phrase belongs to one range only (its own place in the order), so united weights are whole counts.

Two rounds keep the automata small without losing a phrase: the first counts phrases of one and two words.
A longer phrase can reach the least count only where all its pairs do, so the second round counts the
longer ones at places whose pairs pass a Bloom filter of the frequent pairs; the filter's size is bounded, and
a false positive only costs a count that stays below the least one. The counts of a candidate's parts
are looked up by composing the parts, sent to their ranges, with the transducers there.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwell.llm.bloom import BlockedBloom, blooms_of, mixed
from panelwell.llm.common import LOWER, UPPER, ship
from panelwell.session import broadcast_rows, store

#: Piece ends become line feeds, tabs spaces, and A-Z small letters.
FOLD = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t" + UPPER.encode(), b"\n" * 10 + b" " + LOWER.encode())
BREAK, NOTHING = 0, 1


@dataclass(frozen=True)
class CollocationSettings:
    """``words`` is the longest phrase, ``least`` the least count of a candidate; a cut scores floor(scale a / (l + r)).

    A candidate goes if a longer one around it has ``inside`` per cent of its count; ``top`` are returned per
    language. The others set sizes only: words held before transducers are built, occurrences in a range,
    documents and phrases of each that borders are chosen from, requests looked up together, and bits of
    the filter per pair and at most.
    """

    words: int = 4
    least: int = 30
    scale: int = 2_000_000
    inside: int = 80
    top: int = 2000
    shard_words: int = 2_000_000
    range_words: int = 2_000_000
    sample: int = 2000
    sample_phrases: int = 64
    requests: int = 500_000
    filter_bits: int = 16
    filter_most: int = 1 << 27


def token_chunks(text: bytes | None, size: int = 2_000_000) -> Iterator[list[bytes]]:
    """The tokens of a text: words, line feeds where a piece ends, and empty strings; a chunk may end inside a piece."""
    data = (text or b"").translate(FOLD)
    start, n = 0, len(data)
    while start < n:
        stop = n if n - start <= size else data.find(b" ", start + size)
        stop = n if stop < 0 else stop
        yield data[start:stop].replace(b"\n", b" \n ").split(b" ")
        start = stop
    yield [b"\n"]


class Numbers(dict):
    """Numbers words as they come."""

    def __init__(self) -> None:
        super().__init__({b"\n": BREAK, b"": NOTHING})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def spans(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each start to before its stop, one range after the other, and the ranges' sizes."""
    size = stop - start
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum())), size


def summed(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, the sums of their weights, and where each input key is among them."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.r_[True, ordered[1:] != ordered[:-1]][:len(key)]
    place = np.empty(len(key), np.int64)
    place[order] = np.cumsum(first) - 1
    begin = np.flatnonzero(first)
    return ordered[begin], np.add.reduceat(weight[order], begin) if len(begin) else weight, place


def narrow(x: np.ndarray) -> bytes:
    """The numbers in the fewest bytes each, after a byte that says how many."""
    most = int(x.max()) if len(x) else 0
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def widened(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


@dataclass
class Level:
    """The phrases of one length in order: last word, count, and the place of the phrase without it one level up."""

    label: np.ndarray
    weight: np.ndarray
    parent: np.ndarray


@dataclass
class CountTransducer:
    """An acyclic automaton: state s has the arcs starts[s] to starts[s+1]; state 0 has none, the last state is the root.

    Labels are places in ``words`` (sorted); an arc's weight is the count of the phrase that ends with it,
    0 where the phrase is only the beginning of others.
    """

    words: list[bytes]
    starts: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    target: np.ndarray

    @classmethod
    def build(cls, words: Sequence[bytes], levels: list[Level]) -> CountTransducer:
        """From the deepest phrases up; equal states of one arc become one."""
        used = np.unique(np.concatenate([lv.label for lv in levels])) if levels else np.zeros(0, np.int64)
        labels, weights, targets, sizes, states = [], [], [], [np.zeros(1, np.int64)], 1
        below = np.zeros(len(levels[-1].label) if levels else 0, np.int64)
        for m in range(len(levels) - 1, -1, -1):
            level, above = levels[m], len(levels[m - 1].label) if m else 1
            label = np.searchsorted(used, level.label)
            children = np.bincount(level.parent, minlength=above)
            alone = children[level.parent] == 1
            state = np.zeros(above, np.int64)
            # the register: a state of one arc is its label, target and weight
            one = np.flatnonzero(alone)
            key = label[one] << 32 | below[one]
            order = np.lexsort((level.weight[one], key))
            fresh = np.r_[True, (np.diff(key[order]) != 0) | (np.diff(level.weight[one][order]) != 0)][:len(one)]
            state[level.parent[one[order]]] = states + np.cumsum(fresh) - 1
            kept = one[order[fresh]]
            states += len(kept)
            many = np.flatnonzero(children > 1)
            state[many] = states + np.arange(len(many))
            states += len(many)
            arcs = np.r_[kept, np.flatnonzero(~alone)]
            labels.append(label[arcs])
            weights.append(level.weight[arcs])
            targets.append(below[arcs])
            sizes += [np.ones(len(kept), np.int64), children[many]]
            below = state
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        starts = np.r_[0, np.cumsum(np.concatenate(sizes))]
        return cls([words[i] for i in used.tolist()], starts, join(labels), join(weights), join(targets))

    def pack(self) -> tuple[bytes, ...]:
        return (b" ".join(self.words), *(narrow(x) for x in (np.diff(self.starts), self.label, self.weight, self.target)))

    @classmethod
    def unpack(cls, words: bytes, sizes: bytes, label: bytes, weight: bytes, target: bytes) -> CountTransducer:
        return cls(words.split(b" ") if words else [], np.r_[0, np.cumsum(widened(sizes))], widened(label), widened(weight), widened(target))

    def levels(self) -> list[Level]:
        """All phrases, level by level in order; the labels are places in ``words``."""
        out: list[Level] = []
        states = np.array([len(self.starts) - 2])
        while True:
            arcs, size = spans(self.starts[states], self.starts[states + 1])
            if not len(arcs):
                return out
            out.append(Level(self.label[arcs], self.weight[arcs], np.repeat(np.arange(len(states)), size)))
            states = self.target[arcs]

    def phrases(self) -> Iterator[tuple[tuple[bytes, ...], int]]:
        """All accepted phrases with their counts, by length."""
        above: list[tuple[bytes, ...]] = [()]
        for level in self.levels():
            here = [(*above[p], self.words[w]) for p, w in zip(level.parent.tolist(), level.label.tolist())]
            yield from ((p, n) for p, n in zip(here, level.weight.tolist()) if n)
            above = here

    def compose(self, parts: Sequence[Sequence[bytes]]) -> np.ndarray:
        """The counts of the given phrases, all followed at once, one arc at a time; 0 for those not accepted."""
        number = {w: i for i, w in enumerate(self.words)}
        state = np.full(len(parts), len(self.starts) - 2)
        count = np.zeros(len(parts), np.int64)
        source = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        arc_key = source << 32 | self.label  # in order: arcs of a state are sorted by label
        active = np.arange(len(parts))
        for depth in range(max(map(len, parts), default=0)):
            active = active[[len(parts[i]) > depth for i in active.tolist()]]
            label = np.array([number.get(parts[i][depth], -1) for i in active.tolist()], np.int64)
            count[active] = 0
            active, label = active[label >= 0], label[label >= 0]
            key = state[active] << 32 | label
            at = np.minimum(np.searchsorted(arc_key, key), max(0, len(arc_key) - 1))
            found = arc_key[at] == key if len(arc_key) else np.zeros(len(key), bool)
            active, at = active[found], at[found]
            count[active], state[active] = self.weight[at], self.target[at]
        return count


@dataclass
class Shard:
    """Words of one language, held until their transducers are built."""

    ids: Numbers = field(default_factory=Numbers)
    held: list[np.ndarray] = field(default_factory=list)
    size: int = 0

    def add(self, tokens: list[bytes]) -> None:
        ids = self.ids
        found = np.array([ids[t] for t in tokens], np.int32)
        found = found[found != NOTHING]
        self.held.append(found)
        self.size += len(found)

    def words(self) -> tuple[list[bytes], np.ndarray]:
        """The words in order, and the running text as places among them, 1 for the first; 0 is a break."""
        words = sorted(w for w in self.ids if w not in (b"\n", b""))
        rank = np.zeros(len(self.ids), np.int64)
        rank[[self.ids[w] for w in words]] = np.arange(1, len(words) + 1)
        return words, rank[np.concatenate(self.held)] if self.held else np.zeros(0, np.int64)


def grams(text: np.ndarray, starts: int, longest: int, least: int, chained: np.ndarray | None = None) -> list[Level]:
    """The phrases of up to ``longest`` words that begin before place ``starts``, each order sorted from the one before.

    Phrases of fewer than ``least`` words have weight 0. With ``chained`` (whether the pair at a place may be
    frequent) only phrases whose pairs all are count, and shorter ones only as their beginnings.
    """
    n = len(text)
    padded = np.r_[text, np.zeros(longest, np.int64)]
    at = np.flatnonzero(text[:starts] > 0)
    if chained is not None:
        pair = np.r_[chained, np.zeros(longest, bool)]
        for m in range(least - 1):
            at = at[pair[at + m]]
    levels, above = [], np.zeros(len(at), np.int64)
    for m in range(longest):
        more = padded[at + m] > 0
        if chained is not None and m >= least:
            more &= pair[at + m - 1]
        at, above = at[more], above[more]
        key, weight, above = summed(above << 32 | padded[at + m] - 1, np.ones(len(at), np.int64))
        if not len(key):
            break
        levels.append(Level(key & 0xFFFFFFFF, weight if m + 1 >= least else np.zeros_like(weight), key >> 32))
    return levels if n else []


class SortedWords(list):
    """Sorted words with their places."""

    def __init__(self, words: Sequence[bytes]):
        super().__init__(words)
        self.place = {w: i for i, w in enumerate(words)}


def cut_places(words: SortedWords, levels: list[Level], border: Sequence[bytes]) -> list[int]:
    """How many phrases of each level come before the border."""
    # ``low`` counts the phrases before the border's beginning, ``path`` is the place of that beginning
    cuts, low, path = [], 0, 0
    for m, level in enumerate(levels):
        if path is None or m >= len(border):
            low, path = int(np.searchsorted(level.parent, low)), None
            cuts.append(low)
            continue
        a, b = np.searchsorted(level.parent, [path, path + 1])
        place = words.place.get(border[m])
        low = int(a + np.searchsorted(level.label[a:b], bisect_right(words, border[m]) if place is None else place))
        path = low if place is not None and low < b and level.label[low] == place else None
        # a phrase that begins the border comes before it
        cuts.append(low + (path is not None and m + 1 < len(border)))
    return cuts


def ranged(words: Sequence[bytes], levels: list[Level], borders: Sequence[Sequence[bytes]]) -> Iterator[tuple[int, CountTransducer]]:
    """One transducer for each range between the borders that holds a phrase; beginnings that belong to other ranges weigh 0."""
    if not levels:
        return
    known = SortedWords(words)
    cuts = [[0] * len(levels), *(cut_places(known, levels, b) for b in borders), [len(lv.label) for lv in levels]]
    for i, (start, stop) in enumerate(zip(cuts, cuts[1:])):
        if start == stop:
            continue
        piece: list[Level] = []
        first = None  # the parent of the first phrase one level down
        for m in range(len(levels) - 1, -1, -1):
            level, hi = levels[m], stop[m]
            lo = start[m] if first is None else min(start[m], first)
            if hi == lo:
                continue
            weight = level.weight[lo:hi].copy()
            weight[:start[m] - lo] = 0
            first = int(level.parent[lo])
            offset = min(start[m - 1], first) if m else 0
            piece.append(Level(level.label[lo:hi], weight, level.parent[lo:hi] - offset))
        yield i, CountTransducer.build(words, piece[::-1])


def united(parts: Sequence[CountTransducer]) -> tuple[list[bytes], list[Level]]:
    """The union of transducers with summed weights, level by level."""
    words = sorted({w for t in parts for w in t.words})
    number = {w: i for i, w in enumerate(words)}
    maps = [np.array([number[w] for w in t.words], np.int64) for t in parts]
    each = [t.levels() for t in parts]
    places = [np.zeros(1, np.int64) for _ in parts]
    out: list[Level] = []
    for m in range(max(map(len, each), default=0)):
        with_level = [i for i, levels in enumerate(each) if len(levels) > m]
        key = np.concatenate([places[i][each[i][m].parent] << 32 | maps[i][each[i][m].label] for i in with_level])
        keys, weight, place = summed(key, np.concatenate([each[i][m].weight for i in with_level]))
        ends = np.cumsum([len(each[i][m].label) for i in with_level])
        for i, a, b in zip(with_level, np.r_[0, ends[:-1]], ends):
            places[i] = place[a:b]
        out.append(Level(keys & 0xFFFFFFFF, weight, keys >> 32))
    return words, out


def pruned(levels: list[Level], least: int) -> list[Level]:
    """Without the phrases below the least count, but for the beginnings of others, which weigh 0 then."""
    kept: list[Level] = []
    for m in range(len(levels) - 1, -1, -1):
        level = levels[m]
        enough = level.weight >= least
        keep = enough.copy()
        if kept:
            keep[kept[-1].parent] = True
            kept[-1].parent = (np.cumsum(keep) - 1)[kept[-1].parent]
        if keep.any():
            kept.append(Level(level.label[keep], np.where(enough, level.weight, 0)[keep], level.parent[keep]))
    return kept[::-1]


TRANSDUCER = ("words", "sizes", "label", "weight", "target")
BLOBS = ", ".join(f"{c} binary" for c in TRANSDUCER)


def shard_transducers(rows: DataFrame, borders: dict[str, list[tuple[bytes, ...]]], settings: CollocationSettings, least: int, longest: int,
                      frequent: Callable[[], BlockedBloom] | None = None) -> DataFrame:
    """lang, range and a transducer of each shard of (lang, text) for the phrases of ``least`` to ``longest`` words."""
    shared = ship(rows.sparkSession, borders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shards = shared(), {}
        pairs = frequent() if frequent else None

        def built(unfinished: str | None) -> Iterator[pa.RecordBatch]:
            for lang, shard in list(shards.items()):
                words, text = shard.words()
                starts, rest = len(text), []
                if lang == unfinished:  # phrases that begin with the last words go on in the next shard
                    tail = text[-(longest - 1):] if longest > 1 else text[:0]
                    breaks = np.flatnonzero(tail == 0)
                    tail = tail[breaks[-1] + 1:] if len(breaks) else tail
                    starts, rest = len(text) - len(tail), [words[i - 1] for i in tail.tolist()]
                chained = None
                if pairs is not None:
                    codes = np.array([0, *(xxhash.xxh64_intdigest(w) for w in words)], np.uint64)
                    two = (text[:-1] > 0) & (text[1:] > 0)
                    chained = np.zeros(len(text), bool)
                    chained[:-1][two] = pairs.holds(pair_hash(codes[text[:-1][two]], codes[text[1:][two]]))
                out = list(ranged(words, grams(text, starts, longest, least, chained), known.get(lang, [])))
                shards[lang] = Shard()
                if rest:
                    shards[lang].add(rest)
                else:
                    del shards[lang]
                if out:
                    columns = zip(*(t.pack() for _, t in out))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(out)), pa.array([i for i, _ in out], pa.int32()), *(pa.array(c, pa.binary()) for c in columns)],
                        names=["lang", "range", *TRANSDUCER],
                    )

        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                part = batch.slice(start, 100)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                    for tokens in token_chunks(text):
                        shards.setdefault(lang, Shard()).add(tokens)
                        if sum(s.size for s in shards.values()) >= settings.shard_words:
                            yield from built(lang)
        yield from built(None)

    return rows.mapInArrow(run, f"lang string, range int, {BLOBS}")


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * np.uint64(0x9E3779B97F4A7C15) + second)


def union_by_range(shards: DataFrame, least: int) -> DataFrame:
    """One transducer per language and range with all phrases of the least count; ``n`` sums all words of the range, ``pairs`` counts its frequent pairs."""

    def run(table: pa.Table) -> pa.Table:
        words, levels = united([CountTransducer.unpack(*row) for row in zip(*(table.column(c).to_pylist() for c in TRANSDUCER))])
        n = int(levels[0].weight.sum()) if levels else 0
        levels = pruned(levels, least)
        pairs = int((levels[1].weight > 0).sum()) if len(levels) > 1 else 0
        packed = CountTransducer.build(words, levels).pack()
        return pa.table({
            "lang": table.column("lang")[:1], "range": table.column("range")[:1], "n": pa.array([n], pa.int64()), "pairs": pa.array([pairs], pa.int64()),
            **{c: pa.array([x], pa.binary()) for c, x in zip(TRANSDUCER, packed)},
        })

    return shards.groupBy("lang", "range").applyInArrow(run, f"lang string, range int, n long, pairs long, {BLOBS}")


def range_borders(docs: DataFrame, rows: DataFrame, settings: CollocationSettings) -> dict[str, list[tuple[bytes, ...]]]:
    """Borders in phrase order per language, from a bounded sample of documents; they balance the ranges and change no result."""
    key = F.xxhash64(*(c for c in ("doc_id", "text", "lang") if c in docs.columns))
    marked = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text", key.alias("key"))
    bound = marked.select("key").orderBy("key").limit(settings.sample).agg(F.max("key")).first()[0]
    size = {r["lang"]: r["size"] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size")).collect()}
    if bound is None:
        return {}
    longest, most = settings.words, settings.sample_phrases

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                found: list[bytes] = []
                for tokens in token_chunks(text):
                    tokens = [t for t in tokens if t]
                    for i in range(0, len(tokens), max(1, len(tokens) // 8)):
                        phrase = tokens[i:i + longest]
                        phrase = phrase[:phrase.index(b"\n")] if b"\n" in phrase else phrase
                        if phrase and len(found) < most:
                            found.append(b" ".join(phrase))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.binary())], names=["lang", "phrase"])

    sampled: dict[str, list[tuple[bytes, ...]]] = {}
    # repeated rows share a key, so the number of phrases is bounded once more
    few = marked.where(F.col("key") <= bound).select("lang", "text").mapInArrow(run, "lang string, phrase binary").limit(settings.sample * most)
    for row in few.collect():
        sampled.setdefault(row["lang"], []).append(tuple(bytes(row["phrase"]).split(b" ")))
    out = {}
    for lang, phrases in sampled.items():
        phrases.sort()
        n = int((size.get(lang) or 0) // (6 * settings.range_words)) + 1
        out[lang] = sorted({phrases[len(phrases) * i // n] for i in range(1, n)})
    return out


def part_requests(stored: DataFrame, borders: dict[str, list[tuple[bytes, ...]]]) -> DataFrame:
    """What each candidate asks for: its lang, phrase and count ``a``; ``role`` k for its first k words, -k for the rest, 0 for words inside; the part and its range."""
    shared = ship(stored.sparkSession, borders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared()
        for batch in batches:
            for row in batch.to_pylist():
                lang, limits = row["lang"], known.get(row["lang"], [])
                whole, count, roles, parts, places = [], [], [], [], []
                for phrase, a in CountTransducer.unpack(*(row[c] for c in TRANSDUCER)).phrases():
                    n = len(phrase)
                    if n < 2:
                        continue
                    text = b" ".join(phrase)
                    asked = [(k, phrase[:k]) for k in range(1, n)] + [(-k, phrase[k:]) for k in range(1, n)]
                    asked += [(0, phrase[i:j]) for i in range(1, n) for j in range(i + 2, n)]
                    for role, part in asked:
                        whole.append(text)
                        count.append(a)
                        roles.append(role)
                        parts.append(b" ".join(part))
                        places.append(bisect_right(limits, part))
                for i in range(0, len(whole), 100_000):
                    cut = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(whole[cut]), pa.string()), pa.array(places[cut], pa.int32()), pa.array(whole[cut], pa.binary()).cast(pa.string()),
                         pa.array(count[cut], pa.int64()), pa.array(roles[cut], pa.int32()), pa.array(parts[cut], pa.binary()).cast(pa.string())],
                        names=["lang", "range", "phrase", "a", "role", "part"],
                    )

    return stored.select("lang", *TRANSDUCER).mapInArrow(run, "lang string, range int, phrase string, a long, role int, part string")


def composed(requests: DataFrame, stored: DataFrame, settings: CollocationSettings) -> DataFrame:
    """The requests with the ``found`` counts of their parts; many requests for one range are dealt to several tasks."""
    parts = requests.groupBy("lang", "range").agg(F.ceil(F.count("*") / settings.requests).cast("int").alias("shares"))
    parts = store(parts, "shares")
    if parts.count() <= broadcast_rows(parts.sparkSession):
        parts = F.broadcast(parts)
    asked = requests.join(parts, ["lang", "range"]).withColumn("share", F.pmod(F.xxhash64("phrase"), F.col("shares")).cast("int"))
    there = stored.join(parts, ["lang", "range"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = [tuple(p.split(b" ")) for p in left.column("part").cast(pa.binary()).to_pylist()]
        found = np.zeros(len(wanted), np.int64)
        for row in zip(*(right.column(c).to_pylist() for c in TRANSDUCER)):
            found += CountTransducer.unpack(*row).compose(wanted)
        return left.select(["lang", "phrase", "a", "role", "part"]).append_column("found", pa.array(found))

    keys = ["lang", "range", "share"]
    return asked.select(*keys, "phrase", "a", "role", "part").groupBy(*keys).cogroup(there.select(*keys, *TRANSDUCER).groupBy(*keys)).applyInArrow(
        run, "lang string, phrase string, a long, role int, part string, found long"
    )


def collocations(docs: DataFrame, settings: CollocationSettings = CollocationSettings()) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are cut into pieces at ``. , ; : ! ?`` and line breaks, pieces into words at spaces and tabs, A-Z lower-cased.
    ``a`` counts the phrase, ``l`` and ``r`` its two parts at the cut of lowest score (the first of equal
    ones), ``n`` all words of the language. Null languages are ``und``, null texts have no words; repeated rows
    count each; a language without candidates has no rows. Equal scores rank by larger ``a``, then by the
    phrase's UTF-8 bytes. Arithmetic is exact: counts are 64-bit, products decimal of 38 digits. Only lang and
    text (and doc_id for the sample) are read.
    """
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    borders = range_borders(docs, rows, settings)
    short = store(union_by_range(shard_transducers(rows, borders, settings, 1, min(2, settings.words)), settings.least), "short-phrases")
    stored = short.select("lang", "range", *TRANSDUCER)
    if settings.words > 2:
        pairs = short.agg(F.sum("pairs")).first()[0] or 0

        def pair_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
            for batch in batches:
                for row in batch.to_pylist():
                    two = [p for p, _ in CountTransducer.unpack(*(row[c] for c in TRANSDUCER)).phrases() if len(p) == 2]
                    if two:
                        codes = {w: xxhash.xxh64_intdigest(w) for p in two for w in p}
                        yield 0, pair_hash(np.array([codes[a] for a, _ in two], np.uint64), np.array([codes[b] for _, b in two], np.uint64))

        frequent = blooms_of(short.select(*TRANSDUCER), pair_hashes, {0: BlockedBloom.size(pairs * settings.filter_bits, settings.filter_most)})[0]
        long = shard_transducers(rows, borders, settings, 3, settings.words, ship(docs.sparkSession, frequent))
        stored = stored.unionByName(store(union_by_range(long, settings.least), "long-phrases").select(*stored.columns))
    found = store(composed(part_requests(stored, borders), stored, settings), "parts")

    big = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = []
    for k in range(1, settings.words):
        found_at = lambda role: F.max(F.when(F.col("role") == role, F.col("found")))
        cuts += [found_at(k).alias(f"l{k}"), found_at(-k).alias(f"r{k}")]
    each = found.groupBy("lang", "phrase").agg(F.max("a").alias("a"), *cuts)
    options = []
    for k in range(1, settings.words):
        score = F.expr(f"(CAST({settings.scale} AS DECIMAL(18,0)) * CAST(a AS DECIMAL(20,0))) div (CAST(l{k} AS DECIMAL(20,0)) + CAST(r{k} AS DECIMAL(20,0)))")
        options.append(F.when(F.col(f"l{k}").isNotNull(), F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))))
    best = F.least(*options) if len(options) > 1 else options[0]
    scored = each.select("lang", "phrase", "a", best.alias("best"))
    around = found.where(F.contains("part", F.lit(" ")) & (big("a") * 100 >= big("found") * settings.inside))
    around = around.select("lang", F.col("part").alias("phrase")).distinct()
    left = scored.join(around, ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within parts of a language, so that a large one is not sorted in one task
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = left.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= settings.top)
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= settings.top)
    words = short.groupBy("lang").agg(F.sum("n").cast("long").alias("n"))
    return first.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
