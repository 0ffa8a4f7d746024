"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are words and their beginnings of 4 to 6 letters, so that inflected or compounded forms meet.
The examples are a bounded number of labelled texts of each class; all their terms are indexed, and
norms are over all of them. A term's TF-IDF weight is multiplied by how much it tells the classes apart
(the root of its likelihood ratio among the examples, whichever class it speaks for); document
frequencies are counted over the whole corpus.
Terms are 64-bit hashes, so neither tasks nor the driver hold them as strings.

The examples' vectors form an inverted index in blocks of examples: each term knows its largest
weight in each block. Lists of frequent terms are kept as dense blocks, those of rare ones as postings. A batch of
texts reads the few blocks of largest bound first; of the others only those whose bound reaches the k-th best cosine
found so far are read. Where that spares little, the next batches read all blocks at once. Terms that stand in the same
examples equally often are one list. Blocks are added up in single precision with a bound on the error; all
examples that may belong to the nearest within that bound are finished in double precision. Votes of the neighbours are weighted by similarity and class share, and
a logistic curve fitted on left-one-out votes turns them into probabilities.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Collection, Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwell.llm.common import WORD, in_pieces, ship
from panelwell.session import store

PREFIXES = (4, 5, 6)
#: Words whose terms are remembered per task; bounds memory, not the result.
MEMO = 300_000
#: Numbers of the dense blocks; bounds their memory, and terms beyond it are kept as postings.
DENSE = 1 << 24
#: Characters of the texts whose new words are looked up together.
TOGETHER = 500_000
#: Bytes that end a word become spaces, A-Z lower case; all bytes of characters beyond ASCII stay.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Texts searched together, and blocks that each reads first.
BATCH, FIRST = 250, 6
#: Where the bounds left a batch more than half of its blocks to read, so many batches read all blocks at once before they are tried again.
UNTRIED = 15
#: A term in this share of the examples (one in so many) is frequent: its dense column costs each text less than the
#: postings cost the texts that hold it.
SHARE = 16


@dataclass(frozen=True)
class ToxicitySettings:
    """``examples`` bounds the labelled rows of each class that are fitted on, ``least`` is the smallest factor of a term."""

    examples: int = 2000
    least: float = 0.01
    neighbours: int = 15
    block: int = 64
    pseudo_weight: float = 0.3


def terms_of(word: str) -> list[str]:
    """A word's own term and its beginnings (marked by an asterisk, so that they differ from words)."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


class Terms:
    """The terms of texts as hashes or, with a sorted vocabulary of hashes, as places in it; other terms are left out."""

    def __init__(self, vocabulary: np.ndarray | None = None):
        self.vocabulary, self.memo = vocabulary, {}
        # stands for no term: the place after the vocabulary's last, or a hash that no term has
        self.none = 0 if vocabulary is None else len(vocabulary)
        self.table = np.zeros((1024, 1 + len(PREFIXES)), np.int64 if vocabulary is None else np.int32)
        self.seat = None if vocabulary is None else np.zeros(self.none + 1, np.int32)

    def learn(self, words: Collection[bytes]) -> None:
        if len(self.memo) + len(words) > MEMO:
            self.memo.clear()
        first, new = len(self.memo), [w for w in words if w not in self.memo]
        while first + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[first:first + len(new)] = self.none
        # ``terms_of`` by columns; a word of ASCII alone is cut as it is
        texts = [w if w.isascii() else w.decode() for w in new]
        star = {bytes: b"*", str: "*"}
        for column, n in enumerate((0, *PREFIXES)):
            long = [i for i, t in enumerate(texts) if len(t) >= n]
            flat = np.array([xxhash.xxh64_intdigest(t[:n] + star[type(t)] if n else t) for t in map(texts.__getitem__, long)], np.uint64).view(np.int64)
            if self.vocabulary is not None:
                place = np.searchsorted(self.vocabulary, flat)
                found = self.vocabulary[np.minimum(place, self.none - 1)] == flat if self.none else np.zeros(len(flat), bool)
                flat = np.where(found, place, self.none)
            self.table[first + np.array(long, np.int64), column] = flat
        self.memo.update(zip(new, range(first, first + len(new))))

    def each(self, texts: Iterable[str | None], of: Callable[[Terms, np.ndarray], object]) -> Iterator:
        """``of`` the table's rows of every text's words; the new words of some texts are learnt at once."""
        held, size = [], 0
        for text in texts:
            if held and size + len(text or "") > TOGETHER:
                yield from self._some(held, of)
                held, size = [], 0
            held.append(text or "")
            size += len(text or "")
        yield from self._some(held, of)

    def _some(self, texts: list[str], of: Callable[[Terms, np.ndarray], object]) -> Iterator:
        if len(texts) == 1:  # it may be long: each piece learns by itself
            yield of(self, np.concatenate([self.rows(words, set(words)) for words in map(words_in, in_pieces(texts[0]))]))
            return
        lists = [words_in(text) for text in texts]
        new = set().union(*lists)
        for words in lists:
            yield of(self, self.rows(words, new))
            new = ()

    def rows(self, words: list[bytes], new: Collection[bytes]) -> np.ndarray:
        """The rows of the words in the table, once the new ones are learnt."""
        if new:
            self.learn(new)
        return self.table[np.fromiter(map(self.memo.__getitem__, words), np.int32, len(words))]

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return next(self.each([text], Terms.counted))

    def counted(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct terms in order, and how often each occurs."""
        flat = found.ravel()
        if self.seat is None:
            return np.unique(flat[flat != self.none], return_counts=True)
        # every place is held by one of its occurrences, for which all of them are counted; nothing is sorted but what is left
        at = np.arange(len(flat), dtype=np.int32)
        self.seat[flat] = at
        holder = self.seat[flat]
        first = np.flatnonzero((holder == at) & (flat != self.none))
        ids, tf = flat[first], np.bincount(holder, minlength=len(flat))[first]
        order = np.argsort(ids)
        return ids[order], tf[order]

    def distinct(self, found: np.ndarray) -> np.ndarray:
        """The distinct places in the vocabulary, in no order."""
        flat = found.ravel()
        at = np.arange(len(flat), dtype=np.int32)
        self.seat[flat] = at
        return flat[(self.seat[flat] == at) & (flat != self.none)]


def words_in(piece: str) -> list[bytes]:
    """The words of a text in UTF-8, A-Z lower-cased."""
    return piece.encode().translate(TO_WORDS).split()


def spans(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each start to before its stop, one range after the other, and the ranges' sizes."""
    size = stop - start
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum())), size


def likelihood_ratio(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """The root of each term's G statistic, from the toxic and clean examples that hold it."""
    n, seen = n_toxic + n_clean, toxic + clean
    total = np.zeros(len(toxic))
    for found, row, column in ((toxic, seen, n_toxic), (clean, seen, n_clean), (n_toxic - toxic, n - seen, n_toxic), (n_clean - clean, n - seen, n_clean)):
        total += found * np.log(np.maximum(found, 1) * n / (np.maximum(row, 1) * column))
    return np.sqrt(np.maximum(0, 2 * total))


def same_postings(term: np.ndarray, example: np.ndarray, tf: np.ndarray, n: int) -> np.ndarray:
    """For each of n terms the first term that stands in the same examples, as often in each; itself if there is none."""
    order = np.argsort(term, kind="stable")
    term, example, tf = term[order], example[order], tf[order]
    start = np.searchsorted(term, np.arange(n + 1))
    count, used = np.diff(start), np.flatnonzero(np.diff(start))
    first = np.arange(n)
    if not len(used):
        return first
    h = (example.astype(np.uint64) << np.uint64(32) | tf.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    total = np.add.reduceat(h, start[used])
    del h
    place = np.lexsort((total, count[used]))
    begins = np.r_[True, (np.diff(total[place]) != 0) | (np.diff(count[used][place]) != 0)]
    first[used[place]] = used[place][np.flatnonzero(begins)][np.cumsum(begins) - 1]
    # equal sums only nominate a term: the postings themselves are compared
    other = np.repeat((start[first] - start[:-1]), count) + np.arange(len(term))
    wrong = np.unique(term[(example[other] != example) | (tf[other] != tf)])
    first[wrong] = wrong
    return first


def narrowed(counts: np.ndarray) -> np.ndarray:
    """The counts in the smallest type that holds them."""
    return counts.astype(np.min_scalar_type(int(counts.max())) if len(counts) else np.uint8)


class BlockMaxIndex:
    """Examples as unit vectors: postings by term, the largest weight per (term, block of examples), and each example's terms."""

    def __init__(self, texts: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, idf: np.ndarray, block: int):
        """``texts`` are the distinct terms of each example in order, and how often each occurs."""
        self.n, self.block, self.idf, self.blocks = len(labels), block, idf, -(-len(labels) // block)
        # similar examples share a block, which makes the blocks' bounds tight
        lead = [int(ids[np.argmax((1 + np.log(tf.astype(float))) * idf[ids])]) if len(ids) else len(idf) for ids, tf in texts]
        self.order = np.lexsort((np.arange(self.n), lead, -labels))
        self.labels = labels[self.order]
        chosen = [texts[i] for i in self.order.tolist()]
        self.terms = np.concatenate([ids.astype(np.int32) for ids, _ in chosen] or [np.zeros(0, np.int32)])
        self.tf = narrowed(np.concatenate([tf for _, tf in chosen] or [np.zeros(0, np.int64)]))
        self.ends = np.r_[0, np.cumsum([len(ids) for ids, _ in chosen])].astype(np.int64)
        self.first = same_postings(self.terms, self.examples(), self.tf, len(idf)).astype(np.int32)

    def examples(self) -> np.ndarray:
        """The example of each entry of ``terms``."""
        return np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.ends))

    def __getstate__(self) -> dict:
        """Counts alone are sent; what follows from them is computed where they arrive."""
        return {name: getattr(self, name) for name in ("n", "block", "idf", "blocks", "order", "labels", "terms", "tf", "ends", "first")}

    def derive(self) -> None:
        """For the first search where the index is: weights, dense blocks with their largest weights, and postings of the rare terms."""
        example = self.examples()
        tf = 1 + np.log(self.tf.astype(float))
        weight = tf * self.idf[self.terms]
        length = np.sqrt(np.bincount(example, weight * weight, self.n))
        scale = (1 / np.where(length > 0, length, 1))[example]
        self.weight = weight * scale
        # terms of equal postings, such as a rare word and its beginnings, are one list, whose weights lack the term's own factor
        lists = np.flatnonzero(self.first == np.arange(len(self.first)))
        self.list = np.searchsorted(lists, self.first).astype(np.int32)
        kept = np.flatnonzero(self.first[self.terms] == self.terms)
        term, example, weight = self.list[self.terms[kept]], example[kept], (tf[kept] * scale[kept]).astype(np.float32)
        del tf, scale, kept
        count = np.bincount(term, minlength=len(lists))
        often = np.lexsort((np.arange(len(count)), -count))[:DENSE // max(1, self.n)]
        often = np.sort(often[count[often] >= max(2, self.n // SHARE)])
        self.column = np.full(len(count), -1, np.int32)
        self.column[often] = np.arange(len(often))
        self.dense = np.zeros((self.blocks * self.block, len(often)), np.float32)
        inside = self.column[term] >= 0
        self.dense[example[inside], self.column[term[inside]]] = weight[inside]
        self.most = self.dense.reshape(self.blocks, self.block, -1).max(axis=1) if self.n else np.zeros((0, len(often)), np.float32)
        place = np.flatnonzero(~inside)
        place = place[np.argsort(term[place], kind="stable")]
        # an example and its weight are read as one number
        self.posted = np.stack([example[place], weight[place].view(np.int32)], axis=1).view(np.int64).ravel()
        self.start = np.r_[0, np.cumsum(np.where(self.column < 0, count, 0))]
        self.untried = 0

    def listed(self, ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of a text's terms, each once, and their weights."""
        lists = self.list[ids]
        order = np.argsort(lists)
        lists = lists[order]
        begins = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
        return lists[begins], np.add.reduceat((values * self.idf[ids])[order], begins)

    def vector(self, ids: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Weights (1 + ln tf) idf, scaled to length one."""
        values = (1 + np.log(tf)) * self.idf[ids]
        return values / math.sqrt(float(values @ values))

    def nearest(self, texts: Sequence[tuple[np.ndarray, np.ndarray]], k: int, without: Sequence[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text (ids, tf) the k examples of largest positive cosine, ties to the earlier one; ``without`` names one that takes no part."""
        if not hasattr(self, "dense"):
            self.derive()
        out = []
        for start in range(0, len(texts), BATCH):
            some = texts[start:start + BATCH]
            out += self._batch(some, k, None if without is None else np.asarray(without[start:start + BATCH]))
        return out

    def _batch(self, texts: Sequence[tuple[np.ndarray, np.ndarray]], k: int, without: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
        m, padded = len(texts), self.blocks * self.block
        values = [self.vector(*t) if len(t[0]) else np.zeros(0) for t in texts]
        asked, base, most = np.zeros((m, self.dense.shape[1]), np.float32), np.zeros((m, padded), np.float32), 0
        for i, (ids, _) in enumerate(texts):
            if not len(ids):
                continue
            lists, value = self.listed(ids, values[i])
            column = self.column[lists]
            often, rare = column >= 0, column < 0
            asked[i, column[often]] = value[often]
            most = max(most, int(often.sum()))
            lists, value = lists[rare], value[rare].astype(np.float32)
            at, size = spans(self.start[lists], self.start[lists + 1])
            found = self.posted.take(at).view(np.int32).reshape(-1, 2)
            base[i] = np.bincount(found[:, 0], np.repeat(value, size) * found[:, 1].view(np.float32), padded)
        # sums in single precision of positive numbers are off by this share at most: a rounding for every number
        # added, two for what it is made of, and some for the rare terms; twice, as two sums are compared
        slack = 2 * (most + 16) * 2.0 ** -23
        scores = np.full((m, padded), -1.0, np.float32)

        def read(wanted: np.ndarray) -> np.ndarray:
            """Adds up the wanted (text, block) pairs; returns what sums must reach that may belong to the k best of each text."""
            if 2 * wanted.sum() > wanted.size:  # one product is faster than many small ones
                np.add(asked @ self.dense.T, base, out=scores)
                wanted = np.zeros_like(wanted)
            for b in np.flatnonzero(wanted.any(axis=0)).tolist():
                rows, cut = np.flatnonzero(wanted[:, b]), slice(b * self.block, (b + 1) * self.block)
                scores[rows, cut] = asked[rows] @ self.dense[cut].T + base[rows, cut]
            if without is not None:
                scores[np.arange(m), without] = -1.0
            if k >= padded:
                return np.zeros(m)
            best = np.partition(scores, padded - k, axis=1)[:, padded - k].astype(float)
            # cosines are told apart to twelve places
            return np.maximum(0.0, best * (1 - slack) - 1e-11)

        if self.untried:
            self.untried -= 1
            floor = read(np.ones((m, self.blocks), bool))
        else:
            bound = asked @ self.most.T + base.reshape(m, self.blocks, self.block).max(axis=2)
            first = np.zeros((m, self.blocks), bool)
            first[np.arange(m)[:, None], np.argpartition(-bound, min(FIRST, self.blocks) - 1, axis=1)[:, :FIRST]] = True
            floor = read(first)
            more = ~first & (bound >= floor[:, None])
            self.untried = UNTRIED if 2 * more.sum() > more.size else 0
            floor = read(more)
        spread, out = np.zeros(len(self.idf)), []
        for i in range(m):
            some = np.flatnonzero((scores[i, :self.n] >= floor[i]) & (scores[i, :self.n] > 0))
            # the text's vector spread out over all terms, to finish the examples that are left
            spread[texts[i][0]] = values[i]
            found = np.array([spread.take(self.terms[a:b]) @ self.weight[a:b] for a, b in zip(self.ends[some].tolist(), self.ends[some + 1].tolist())])
            spread[texts[i][0]] = 0.0
            some, found = some[found > 0], found[found > 0]
            best = np.lexsort((some, -np.round(found, 12)))[:k]
            out.append((some[best], found[best]))
        return out


@dataclass(frozen=True)
class ToxicityModel:
    vocabulary: np.ndarray  # the hashes of all terms, sorted
    examples: list  # an id of each example, in the order of the index
    index: BlockMaxIndex
    settings: ToxicitySettings
    class_weight: tuple[float, float]
    prior: float
    slope: float
    offset: float

    def votes(self, texts: Sequence[tuple[np.ndarray, np.ndarray]], without: Sequence[int] | None = None) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Per text the share of the toxic class among its neighbours, weighted by squared cosine and class share, and the neighbours."""
        mass, out = self.settings.pseudo_weight * self.prior, []
        for members, cosines in self.index.nearest(texts, self.settings.neighbours, without):
            labels = self.index.labels[members]
            weight = cosines ** 2 * np.where(labels == 1, self.class_weight[1], self.class_weight[0])
            out.append(((float(weight @ labels) + mass * self.prior) / (float(weight.sum()) + mass), members, cosines))
        return out

    def score(self, vote: float) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.offset + self.slope * logit(vote)))))


def logit(p: float) -> float:
    p = min(1 - 1e-6, max(1e-6, p))
    return math.log(p / (1 - p))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Slope and offset of a weighted logistic curve by Newton steps, with the slope held near one."""
    slope, offset = 1.0, 0.0
    design = np.column_stack([x, np.ones_like(x)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - ridge * np.array([slope - 1, offset])
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        change = np.linalg.solve(hessian, gradient)
        slope, offset = slope + change[0], offset + change[1]
        if abs(change).max() < 1e-9:
            break
    return max(0.05, float(slope)), float(offset)


def example_terms(examples: DataFrame) -> DataFrame:
    """One row per example: example, label, and its terms (hashes in order) with their numbers as packed arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            for example, label, text in zip(*(c.to_pylist() for c in batch.columns)):
                found, tf = terms.counts(text)
                if len(found):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([example], pa.int64()), pa.array([label], pa.int32()), pa.array([found.astype(np.int64).tobytes()]), pa.array([tf.astype(np.int32).tobytes()])],
                        names=["example", "label", "terms", "tf"],
                    )

    return examples.select("example", "label", "text").mapInArrow(run, "example long, label int, terms binary, tf binary")


def left_out_votes(rows: DataFrame, model: ToxicityModel, places: dict[int, int]) -> dict[int, float]:
    """The vote of each example (at its place) by the others; tasks search, only votes come back."""
    shared = ship(rows.sparkSession, (model, places))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, at = shared()
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                example, terms, tf = (c.to_pylist() for c in batch.slice(start, BATCH).columns)
                texts = [(np.searchsorted(fitted.vocabulary, np.frombuffer(t, np.int64)), np.frombuffer(n, np.int32)) for t, n in zip(terms, tf)]
                here = [at[e] for e in example]
                votes = [v for v, _, _ in fitted.votes(texts, here)]
                yield pa.RecordBatch.from_arrays([pa.array(here, pa.int64()), pa.array(votes, pa.float64())], names=["place", "vote"])

    return {r["place"]: r["vote"] for r in rows.select("example", "terms", "tf").mapInArrow(run, "place long, vote double").collect()}


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Documents with each term of the vocabulary, over all documents; the last entry counts the documents."""
    n = len(vocabulary)
    shared = ship(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, total = Terms(shared()), np.zeros(n + 1, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                texts = batch.column(0).slice(start, 500).to_pylist()
                for found in terms.each(texts, Terms.distinct):
                    total[found] += 1
                total[n] += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["term", "df"])

    # bounded by the examples' terms
    rows = docs.select("text").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(n + 1, np.int64)
    out[rows.column("term").to_numpy()] = rows.column("df").to_numpy()
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, settings: ToxicitySettings = ToxicitySettings()) -> ToxicityModel | None:
    """Fits on the documents (doc_id, text) that ``labels`` (doc_id, label 0/1) names; all documents give frequencies.

    At most ``settings.examples`` texts per class are used, the first by a hash of the text; equal texts
    are one example, toxic if any label of theirs says so. Null ids, labels and texts take no part, nor do
    texts without words. Without a text of each class there is no model (None).
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    # only a hash of each text is moved to meet its label
    hashes = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("example"))
    texts = store(hashes.join(known, "doc_id").groupBy("example").agg(F.max("label").alias("label"), F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "labelled-texts")
    shares = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    if len(shares) < 2:
        return None
    first = [texts.where(F.col("label") == label).orderBy("example").limit(settings.examples) for label in (0, 1)]
    # bounded by the settings, so it may be broadcast
    chosen = F.broadcast(first[0].unionByName(first[1]).select("doc_id", "example", "label"))
    examples = docs.select("doc_id", "text", F.xxhash64("text").alias("example")).join(chosen, ["doc_id", "example"]).select("example", "label", "text")
    # an id for each example, as evidence
    named = {r["example"]: r["doc_id"] for r in chosen.collect()}
    rows = store(example_terms(examples.dropDuplicates(["example"])), "toxicity-terms")
    # bounded: the terms of the examples, as packed numbers
    posted = rows.toArrow()
    labels = posted.column("label").to_numpy().astype(np.int64)
    size = np.bincount(labels, minlength=2)
    if not size.all():
        return None
    known = posted.column("example").to_pylist()
    hashes = [np.frombuffer(t.as_buffer(), np.int64) for t in posted.column("terms")]
    vocabulary = np.unique(np.concatenate(hashes))
    counts = [(np.searchsorted(vocabulary, h).astype(np.int32), narrowed(np.frombuffer(n.as_buffer(), np.int32))) for h, n in zip(hashes, posted.column("tf"))]
    del posted, hashes
    held = np.zeros((2, len(vocabulary)), np.int64)
    for label, (ids, _) in zip(labels.tolist(), counts):
        held[label, ids] += 1
    factor = likelihood_ratio(held[1], held[0], int(size[1]), int(size[0]))
    df = document_frequencies(docs, vocabulary)
    idf = (np.log((df[-1] + 1) / (df[:-1] + 1)) + 1) * np.maximum(settings.least, factor)
    index = BlockMaxIndex(counts, labels, idf, settings.block)
    del counts
    total = shares[0] + shares[1]
    weight = (shares[0] / int(size[0]), shares[1] / int(size[1]))
    scale = max(weight)
    ids = [named[known[i]] for i in index.order]
    model = ToxicityModel(vocabulary, ids, index, settings, (weight[0] / scale, weight[1] / scale), shares[1] / total, 1.0, 0.0)
    # left-one-out votes of all examples
    votes = left_out_votes(rows.repartition(rows.sparkSession.sparkContext.defaultParallelism), model, {known[i]: at for at, i in enumerate(index.order.tolist())})
    x, y = np.array([logit(votes[at]) for at in range(index.n)]), index.labels.astype(float)
    w = np.where(index.labels == 1, weight[1], weight[0])
    slope, offset = fit_logistic(x, y, w)
    return replace(model, slope=slope, offset=offset)


def score_toxicity(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """One row per document: doc_id, text_hash, score, predicted, n_neighbours, nearest_cosine, toxic_votes, nearest_examples.

    ``text_hash`` tells apart documents that share an id. The last four are the evidence: how many examples share a term, the largest cosine, how many
    of the neighbours are toxic, and the ids of the three nearest. Null and empty texts, and texts without a term of the examples, get
    the score of a text without neighbours; without a model every score is 0. Repeated rows and null
    ids are scored each. Only ``doc_id`` and ``text`` are read; no shuffle. The broadcast index is
    bounded by the examples' terms.
    """
    shared = ship(docs.sparkSession, model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text_hash", "score", "predicted", "n_neighbours", "nearest_cosine", "toxic_votes", "nearest_examples"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared()
        terms = Terms(fitted.vocabulary) if fitted else None
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                rows = [] if fitted else [(0.0, 0, 0.0, 0, [])] * part.num_rows
                for vote, members, cosines in fitted.votes(list(terms.each(part.column(2).to_pylist(), Terms.counted))) if fitted else ():
                    named = [fitted.examples[i] for i in members[:3].tolist()]
                    rows.append((fitted.score(vote), len(members), float(cosines[0]) if len(cosines) else 0.0, int(fitted.index.labels[members].sum()), named))
                score, near, cosine, toxic, named = zip(*rows) if rows else ((), (), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32()),
                     pa.array(near, pa.int32()), pa.array(cosine, pa.float64()), pa.array(toxic, pa.int32()), pa.array(named, pa.list_(part.column(0).type))], names=names,
                )

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        run, f"doc_id {kind}, text_hash long, score double, predicted int, n_neighbours int, nearest_cosine double, toxic_votes int, nearest_examples array<{kind}>"
    )
