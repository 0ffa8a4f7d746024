"""Quality by the perplexity of an interpolated modified Kneser-Ney bigram model of trusted text.

Every word of the trusted texts is a token of its own; words that stand in none have the chance of an unseen word of
their shape. A token that repeats the one before it is a class of its own. Texts are written once as numbers, in blocks with
their own numbering. The distinct bigrams of the blocks, with their counts in trusted documents, meet by ranges of their
hashes, where the counts are added up and given back to each block in the order it asked in; counts per word take the
same way. Words and bigrams are sharded alike, so nothing that grows with the corpus passes the driver or one task.

Among many words a repetition is no rarer than any of them, so the share of repetitions is judged by itself.

A trusted document is scored by the model without that document, so that its score compares with those of the others.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import count
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwell.llm.common import in_pieces, ship
from panelwell.llm.decontamination import small
from panelwell.session import store

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
SHAPES = [f"{case}{size}" for case in ("lower", "title", "upper", "mixed") for size in (3, 7, 12, 99)] + ["digits", "marks", "again"]
#: Numbers, in every block and as hashes, of a document's start and of a repetition.
START, AGAIN = 0, 1
#: Bits of a word's hash: of 100 million words some 4,500 share theirs with another.
BITS = 40


@dataclass(frozen=True)
class QualitySettings:
    """``chunk_tokens``: tokens of a block.

    A document is rejected if its log perplexity, drawn towards the language's median as if it had
    ``prior_tokens`` more tokens, is over the ``high`` quantile of the trusted documents by more than
    ``reach`` times the distance from ``low`` to ``high`` quantile; the log of its share of repetitions is judged alike,
    drawn as if the document had as many more tokens as hold ``prior_repeats`` of them. Copies of trusted texts
    spread the lower half of the scores, so the upper one counts. That distance is drawn towards the one within
    the languages of all trusted documents as if it were known from ``prior_documents`` more.
    """

    chunk_tokens: int = 1 << 21
    prior_tokens: int = 20
    prior_repeats: int = 2
    prior_documents: int = 50
    low: float = 0.5
    high: float = 0.75
    reach: float = 5.0


def shape(token: str) -> str:
    """The shape of a word: its case and length, or digits or marks."""
    if token[0].isdigit():
        return "digits"
    if not token[0].isalpha():
        return "marks"
    case = "lower" if token.islower() else "title" if token[1:].islower() or len(token) == 1 else "upper" if token.isupper() else "mixed"
    return f"{case}{next(n for n in (3, 7, 12, 99) if len(token) <= n or n == 99)}"


def word_hash(word: str) -> int:
    """A number of ``BITS`` bits, over those of start and repetition."""
    return max(2, int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> (64 - BITS))


def pack(numbers: np.ndarray) -> bytes:
    """Compressed by byte planes, as high bytes are mostly equal."""
    numbers = np.ascontiguousarray(numbers)
    return zlib.compress(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes(), 1)


def unpack(packed: bytes, kind: type = np.int64) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def numbered(texts: Iterator[str | None], numbers: dict[str, int]) -> Iterator[np.ndarray]:
    """The word numbers of each text; those of repetitions are negative."""
    for text in texts:
        parts = []
        for piece in in_pieces(text or ""):
            tokens = TOKEN.findall(piece)
            part = np.array([numbers[t] for t in tokens], np.int64)
            again = np.fromiter(map(eq, tokens[1:], tokens), bool, max(0, len(tokens) - 1))
            part[1:][again] *= -1
            parts.append(part)
        yield np.concatenate(parts)


@dataclass(frozen=True)
class Block:
    """Documents as numbers: 0 is the start, 1 a repetition, then the block's words, the commonest first."""

    sizes: np.ndarray  # tokens per document
    ids: np.ndarray  # word numbers; a repetition keeps that of its word, over ``len(hashes)``
    hashes: np.ndarray  # by number
    shapes: np.ndarray

    @staticmethod
    def made(parts: list[np.ndarray], numbers: dict[str, int]) -> Block:
        signed = np.concatenate([np.zeros(0, np.int64), *parts])
        size = len(numbers) + 2
        often = np.bincount(np.abs(signed), minlength=size)[2:]
        order = np.argsort(-often, kind="stable")
        place = np.r_[START, AGAIN, np.zeros(size - 2, np.int64)]
        place[order + 2] = np.arange(2, size)
        words = list(numbers)
        ids = place[np.abs(signed)] + np.where(signed < 0, size, 0)
        hashes = np.array([START, AGAIN, *(word_hash(words[i]) for i in order)], np.int64)
        kinds = {s: i for i, s in enumerate(SHAPES)}
        shapes = np.array([kinds["marks"], kinds["again"], *(kinds[shape(words[i])] for i in order)], np.uint8)
        return Block(np.array([len(p) for p in parts], np.int64), ids, hashes, shapes)

    def packed(self) -> list[bytes]:
        return [pack(self.sizes.astype(np.uint32)), pack(self.ids.astype(np.uint32)), pack(self.hashes), pack(self.shapes)]

    @staticmethod
    def read(sizes: bytes, ids: bytes, hashes: bytes, shapes: bytes) -> Block:
        return Block(unpack(sizes, np.uint32).astype(np.int64), unpack(ids, np.uint32).astype(np.int64), unpack(hashes), unpack(shapes, np.uint8))

    def pairs(self) -> np.ndarray:
        """Bigrams of numbers as one number each, from the documents' starts on; a repetition is a class of its own to come, and its word as what went before."""
        n = len(self.hashes)
        before = np.r_[START, self.ids % n][:-1]
        before[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = START
        return before * n + np.where(self.ids >= n, AGAIN, self.ids)

    def repeats(self) -> np.ndarray:
        """Repetitions per document."""
        run = np.r_[0, np.cumsum(self.ids >= len(self.hashes))]
        ends = np.cumsum(self.sizes)
        return run[ends] - run[ends - self.sizes]

    def trusted_tokens(self, good: list[int]) -> np.ndarray:
        flags = np.zeros(len(self.sizes), bool)
        flags[good] = True
        return np.repeat(flags, self.sizes)

    def by_range(self, every: np.ndarray, ranges: int) -> Iterator[tuple[int, np.ndarray]]:
        """Cuts distinct pairs into hash ranges: (range, places in ``every`` ordered by first word)."""
        u, v = self.hashes[every // len(self.hashes)], self.hashes[every % len(self.hashes)]
        # what follows a frequent word is spread over an eighth of the ranges
        return cut((u + v % max(1, ranges // 8)) % ranges, u)


def cut(keys: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each key, sorted by ``order``, which has ``BITS`` bits."""
    places = np.argsort((keys << BITS) + order, kind="stable")
    ends = np.flatnonzero(np.diff(keys[places])) + 1
    for at in np.split(places, ends) if len(places) else []:
        yield int(keys[at[0]]), at


def discounts(of_counts: list[int]) -> tuple[float, float, float]:
    """The discounts of counts 1, 2 and 3 or more, from how many n-grams have counts 1 to 4."""
    n1, n2, n3, n4 = of_counts
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    raw = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0
    return tuple(min(k, max(0.05, d)) for k, d in zip((0.95, 1.95, 2.95), raw))


@dataclass(frozen=True)
class KneserNey:
    """What the model knows beyond the counts of single words and bigrams, a few numbers."""

    discount: np.ndarray  # taken off bigram counts 0, 1, 2 and 3 or more
    lower_discount: np.ndarray  # the same of continuation counts
    continued: float  # distinct bigrams
    freed: float  # what the lower discounts take off them
    new: np.ndarray  # per shape: the chance of one word, seen or not, that all words of the shape share what is freed

    @staticmethod
    def fitted(pairs: np.ndarray, words: np.ndarray) -> KneserNey:
        """From how many bigrams have counts 1 to 4, the sums over words that ``word_sums`` gives."""
        known, once = words[:len(SHAPES)], words[len(SHAPES):2 * len(SHAPES)]
        total, ways = words[-6], words[-5:]
        lower = np.r_[0.0, discounts([int(x) for x in ways[:4]])]
        share = (once + 1) / (once + 1).sum()
        # as many words of a shape are unseen as were seen after one word only, and one more
        new = share / (known + once + 1)
        freed = lower[1] * ways[0] + lower[2] * ways[1] + lower[3] * (ways[2] + ways[3] + ways[4])
        return KneserNey(np.r_[0.0, discounts([int(x) for x in pairs])], lower, float(total), float(freed), new)

    def lower(self, k: np.ndarray, shapes: np.ndarray, continued: float | None = None, freed: float | None = None) -> np.ndarray:
        """Continuation probabilities; the unseen words of a shape have one each."""
        continued = self.continued if continued is None else continued
        if continued <= 0:
            return self.new[shapes]
        freed = self.freed if freed is None else freed
        return np.maximum(0, k - self.lower_discount[np.minimum(k, 3)]) / continued + max(0.0, freed) / continued * self.new[shapes]

    def chance(self, c: np.ndarray, total: np.ndarray, freed: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Of bigrams with counts ``c`` whose first words have ``total`` bigrams and free ``freed`` of them."""
        kept = np.maximum(0, c - self.discount[np.minimum(c, 3)]) / np.maximum(1, total)
        return kept + np.where(total > 0, np.maximum(freed, 1e-12) / np.maximum(1, total), 1.0) * lower


def word_sums(k: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Words per shape, those after one word only, then all continuations and how many words have 1, 2, 3, 4 and more."""
    per = lambda which: np.bincount(shapes[which], minlength=len(SHAPES))
    return np.r_[per(k > 0), per(k == 1), k.sum(), [(k == i).sum() for i in (1, 2, 3, 4)], (k > 4).sum()].astype(np.int64)


def losses(block: Block, good: list[int], every: np.ndarray, place: np.ndarray, c: np.ndarray, words: np.ndarray, model: KneserNey) -> np.ndarray:
    """Per document the sum of negative log probabilities; of trusted ones by the model without them.

    ``every`` are the distinct pairs, ``place`` each token's pair in them, ``c`` their counts; ``words`` has per word its bigrams,
    those of counts 1, 2 and 3 or more, and its continuations.
    """
    n = len(block.hashes)
    u, v = every // n, every % n
    total, k = words[0], words[4]
    freed = model.discount[1:] @ words[1:4]
    cost = -np.log(model.chance(c, total[u], freed[u], model.lower(k, block.shapes)[v]))
    ends = np.cumsum(block.sizes)
    run = np.r_[0.0, np.cumsum(cost[place])]
    result = run[ends] - run[ends - block.sizes]
    for d in good:
        own, o = np.unique(place[ends[d] - block.sizes[d]:ends[d]], return_counts=True)
        left = c[own] - o
        first, at = np.unique(u[own], return_inverse=True)
        taken = model.discount[np.minimum(c[own], 3)] - model.discount[np.minimum(left, 3)]
        t, f = total[first] - np.bincount(at, o, len(first)), freed[first] - np.bincount(at, taken, len(first))
        second, to = np.unique(v[own], return_inverse=True)
        gone = np.bincount(to, left == 0, len(second)).astype(np.int64)
        less = model.lower_discount[np.minimum(k[second], 3)] - model.lower_discount[np.minimum(k[second] - gone, 3)]
        lower = model.lower(k[second] - gone, block.shapes[second], model.continued - gone.sum(), model.freed - less.sum())
        result[d] = -(o * np.log(model.chance(left, t[at], f[at], lower[to]))).sum()
    return result


def perplexities(docs: DataFrame, trusted: DataFrame, settings: QualitySettings) -> DataFrame:
    """One row per document: doc_id, text_hash, lang, n_tokens, repeats (of them), loss (sum of negative log probabilities)."""
    spark = docs.sparkSession
    id_kind, lang_kind = docs.schema["doc_id"].dataType.simpleString(), docs.schema["lang"].dataType.simpleString()

    def encode(batches):
        first, serial = TaskContext.get().partitionId() << 32, count()
        rows, parts, numbers, held = [], [], defaultdict(count(2).__next__), 0

        def emit():
            block = Block.made(parts, numbers)
            columns = [pa.array([next(serial) + first], pa.int64()), pa.array([held], pa.int64())]
            columns += [pa.array([pa.concat_arrays([r.column(i) for r in rows]).to_pylist()], pa.list_(rows[0].column(i).type)) for i in range(3)]
            return pa.RecordBatch.from_arrays(columns + [pa.array([x], pa.binary()) for x in block.packed()], names=["block", "tokens", "doc_id", "text_hash", "lang", "sizes", "ids", "hashes", "shapes"])

        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                part = batch.slice(start, 100)
                made = list(numbered(part.column(3).to_pylist(), numbers))
                rows.append(part)
                parts += made
                held += sum(map(len, made))
                if held >= settings.chunk_tokens:
                    yield emit()
                    rows, parts, numbers, held = [], [], defaultdict(count(2).__next__), 0
        if rows:
            yield emit()

    whole = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "lang", "text")
    shape_of = "sizes binary, ids binary, hashes binary, shapes binary"
    # texts are tokenized once: counting and scoring read the written numbers
    blocks = store(whole.mapInArrow(encode, f"block long, tokens long, doc_id array<{id_kind}>, text_hash array<long>, lang array<{lang_kind}>, {shape_of}"), "blocks")
    chunks = -(-(blocks.agg(F.sum("tokens")).first()[0] or 1) // settings.chunk_tokens)
    ranges, word_ranges = -(-chunks // 2), -(-chunks // 4)
    known = trusted.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast(id_kind).alias("doc_id")).distinct()
    places = blocks.select("block", F.posexplode("doc_id").alias("place", "doc_id"))
    flags = store(places.join(known, "doc_id").groupBy("block").agg(F.collect_list("place").alias("good")), "flags")
    marked = blocks.join(small(flags), "block", "left").select("block", "doc_id", "text_hash", "lang", F.coalesce("good", F.array().cast("array<int>")).alias("good"), *shape_of.replace(" binary", "").split(", "))

    def ask_pairs(batches):
        for batch in batches:
            for block, good, *packed in zip(*(batch.column(i).to_pylist() for i in range(6))):
                held = Block.read(*packed)
                n, pairs = len(held.hashes), held.pairs()
                every = np.unique(pairs)
                learned, times = np.unique(pairs[held.trusted_tokens(good)], return_counts=True)
                c = np.zeros(len(every), np.uint32)
                c[np.searchsorted(every, learned)] = times
                rows = []
                for r, at in held.by_range(every, ranges):
                    u, runs = np.unique(held.hashes[every[at] // n], return_counts=True)
                    rows.append((r, *map(pack, (np.diff(u, prepend=0), runs.astype(np.uint32), held.hashes[every[at] % n], c[at]))))
                r, *blobs = zip(*rows) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r, pa.int32()), pa.array([block] * len(r), pa.int64()), *(pa.array(x, pa.binary()) for x in blobs)],
                    names=["range", "block", "u", "runs", "v", "n"],
                )

    answer = "kind string, block long, range int, words binary, data binary"
    to_answers = lambda rows: pa.table(
        list(map(list, zip(*rows))) if rows else [[]] * 5,
        schema=pa.schema([("kind", pa.string()), ("block", pa.int64()), ("range", pa.int32()), ("words", pa.binary()), ("data", pa.binary())]),
    )

    def add_pairs(table: pa.Table) -> pa.Table:
        asked = table.select(["block", "range", "u", "runs", "v", "n"]).to_pylist()
        heads, runs = np.concatenate([np.cumsum(unpack(r["u"])) for r in asked]), np.concatenate([unpack(r["runs"], np.uint32) for r in asked])
        v, n = np.concatenate([unpack(r["v"]) for r in asked]), [unpack(r["n"], np.uint32) for r in asked]
        names, at = np.unique(np.r_[heads, v], return_inverse=True)
        key = np.repeat(at[:len(heads)], runs) * len(names) + at[len(heads):]
        distinct, place = np.unique(key, return_inverse=True)
        total = np.bincount(place, np.concatenate(n), len(distinct)).astype(np.int64)
        given = np.split(total[place].astype(np.uint32), np.cumsum([len(x) for x in n])[:-1])
        rows = [("pairs", r["block"], r["range"], None, pack(x)) for r, x in zip(asked, given)]
        distinct, c = distinct[total > 0], total[total > 0]
        first, sums = distinct // len(names), np.zeros((5, len(names)), np.int64)
        for i, w in enumerate((c, c == 1, c == 2, c > 2)):
            sums[i] = np.bincount(first, w, len(names))
        sums[4] = np.bincount(distinct % len(names), minlength=len(names))
        held = np.flatnonzero(sums.any(axis=0))
        for w, at in cut(names[held] % word_ranges, names[held]):
            rows.append(("part", None, w, pack(names[held[at]]), pack(sums[:, held[at]].ravel())))
        return to_answers([*rows, ("sum", None, None, None, pack(np.array([(c == i).sum() for i in (1, 2, 3, 4)])))])

    def ask_words(batches):
        for batch in batches:
            for block, hashes, shapes in zip(*(batch.column(i).to_pylist() for i in range(3))):
                h, s = unpack(hashes), unpack(shapes, np.uint8)
                yield from to_answers([("ask", block, r, pack(h[at]), pack(s[at])) for r, at in cut(h % word_ranges, h)]).to_batches()

    def add_words(table: pa.Table) -> pa.Table:
        rows = table.select(["kind", "block", "range", "words", "data"]).to_pylist()
        parts = [(unpack(r["words"]), unpack(r["data"]).reshape(5, -1)) for r in rows if r["kind"] == "part"]
        every = np.concatenate([np.zeros(0, np.int64), *(w for w, _ in parts)])
        names, place = np.unique(every, return_inverse=True)
        given = np.concatenate([np.zeros((5, 0), np.int64), *(x for _, x in parts)], axis=1)
        # the last column is for words that no trusted text has
        sums = np.array([np.bincount(place, x, len(names) + 1) for x in given]).astype(np.int64)
        shapes = np.zeros(len(names) + 1, np.uint8)
        out = []
        for r in rows:
            if r["kind"] == "ask":
                words = unpack(r["words"])
                at = np.searchsorted(names, words)
                at[np.r_[names, -1][at] != words] = len(names)
                shapes[at] = unpack(r["data"], np.uint8)
                out.append(("words", r["block"], r["range"], None, pack(sums[:, at].ravel())))
        return to_answers([*out, ("sum", None, None, None, pack(word_sums(sums[4], shapes)))])

    def summed(found: DataFrame, size: int) -> np.ndarray:
        # one short row per range
        return sum((unpack(r["data"]) for r in found.where("kind = 'sum'").select("data").collect()), np.zeros(size, np.int64))

    asked = marked.select("block", "good", "sizes", "ids", "hashes", "shapes").mapInArrow(ask_pairs, "range int, block long, u binary, runs binary, v binary, n binary")
    pairs = store(asked.groupBy("range").applyInArrow(add_pairs, answer), "pairs")
    wanted = blocks.select("block", "hashes", "shapes").mapInArrow(ask_words, answer).unionByName(pairs.where("kind = 'part'"))
    words = store(wanted.groupBy("range").applyInArrow(add_words, answer), "words")
    model = ship(spark, KneserNey.fitted(summed(pairs, 4), summed(words, 2 * len(SHAPES) + 6)))

    def score(rows: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        held_answers = {(r["kind"], r["range"]): r["data"] for r in found.select(["kind", "range", "data"]).to_pylist()}
        for row in rows.select(["good", "sizes", "ids", "hashes", "shapes"]).to_pylist():
            held = Block.read(row["sizes"], row["ids"], row["hashes"], row["shapes"])
            every, place = np.unique(held.pairs(), return_inverse=True)
            c, sums = np.zeros(len(every), np.int64), np.zeros((5, len(held.hashes)), np.int64)
            for r, at in held.by_range(every, ranges):
                c[at] = unpack(held_answers["pairs", r], np.uint32)
            for r, at in cut(held.hashes % word_ranges, held.hashes):
                sums[:, at] = unpack(held_answers["words", r]).reshape(5, -1)
            out.append(pa.table({"n_tokens": held.sizes, "repeats": held.repeats(), "loss": losses(held, row["good"], every, place, c, sums, model())}))
        flat = {k: pa.chunked_array([x.flatten() for x in rows.column(k).chunks], rows.column(k).type.value_type) for k in ("doc_id", "text_hash", "lang")}
        scored = pa.concat_tables(out) if out else pa.table({"n_tokens": np.zeros(0, np.int64), "repeats": np.zeros(0, np.int64), "loss": np.zeros(0)})
        return pa.table({**flat, **{c: scored.column(c) for c in scored.column_names}})

    answers = pairs.where("kind = 'pairs'").unionByName(words.where("kind = 'words'")).select("kind", "block", "range", "data")
    return marked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"doc_id {id_kind}, text_hash long, lang {lang_kind}, n_tokens long, repeats long, loss double")


#: Columns that a document is judged by, and those of their limits.
JUDGED = {"score": "threshold", "repeat_score": "repeat_threshold"}


def quality(docs: DataFrame, trusted: DataFrame, settings: QualitySettings = QualitySettings()) -> DataFrame:
    """One row per document: doc_id, text_hash, lang, n_tokens, perplexity, score, threshold, repeat_score, repeat_threshold, keep.

    ``docs`` has doc_id, lang and text, ``trusted`` the doc_id of the documents to learn from; other
    columns are not read. ``score`` is the log perplexity drawn towards the language's median, ``repeat_score`` the log of the
    share of repetitions drawn towards the language's, so that
    a few words alone don't decide; thresholds come from quantiles of the trusted documents of the
    language, or of all trusted ones for null and unseen languages. A document over either is not kept. Texts that are null, empty or
    without tokens have perplexity 1, scores 0 and are kept, and so is everything if nothing is trusted
    (thresholds null). Repeated rows and null ids are scored each.
    """
    scored = store(perplexities(docs, trusted, settings), "losses")
    good = trusted.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    learned = scored.where(F.col("n_tokens") > 0).join(good, "doc_id")

    def middles(df: DataFrame) -> DataFrame:
        share = (F.sum("repeats") + 1) / (F.sum("n_tokens") + 1)
        return df.agg(F.percentile_approx(F.col("loss") / F.col("n_tokens"), 0.5, 10000).alias("middle"), share.alias("share"))

    every = middles(learned).first()

    def adjusted(df: DataFrame, medians: DataFrame) -> DataFrame:
        near, often = (F.coalesce(c, F.lit(every[c]), F.lit(0.5)) for c in ("middle", "share"))
        prior = F.lit(settings.prior_tokens)
        drawn = lambda total, prior, more: (F.col(total) + more) / (F.col("n_tokens") + prior)
        value = {"score": drawn("loss", prior, prior * near), "repeat_score": F.log(drawn("repeats", settings.prior_repeats / often, settings.prior_repeats))}
        made = {c: F.when(F.col("n_tokens") > 0, v).otherwise(0.0) for c, v in value.items()}
        return df.join(medians, "lang", "left").withColumns(made).drop("middle", "share")

    def spread(df: DataFrame) -> DataFrame:
        return df.agg(*[F.percentile_approx(c, [settings.low, settings.high], 10000).alias(f"{c}_q") for c in JUDGED], F.count("*").alias("n"))

    medians = store(middles(learned.where(F.col("lang").isNotNull()).groupBy("lang")), "medians")
    judged = store(adjusted(learned, medians), "judged")
    by_language = store(spread(judged.where(F.col("lang").isNotNull()).groupBy("lang")), "spreads")
    all_q = spread(judged).first()
    # how far scores spread within the languages, whose levels differ
    off = {c: F.col(c) - F.coalesce(F.col(f"{c}_q")[0], F.lit((all_q[f"{c}_q"] or [None])[0]).cast("double")) for c in JUDGED}
    within = spread(judged.join(by_language, "lang", "left").select(*[v.alias(c) for c, v in off.items()])).first()
    widths = {c: 0.0 if within[f"{c}_q"] is None else float(within[f"{c}_q"][1] - within[f"{c}_q"][0]) for c in JUDGED}

    def limit(c: str) -> Column:
        # few trusted documents say little about how far their language spreads
        known, own = F.col("n"), F.col(f"{c}_q")[1] - F.col(f"{c}_q")[0]
        width = (known * own + settings.prior_documents * widths[c]) / (known + settings.prior_documents)
        return (F.col(f"{c}_q")[1] + settings.reach * width).alias(f"{c}_limit")

    limits = store(by_language.select("lang", *map(limit, JUDGED)), "limits")
    out, keep = adjusted(scored, medians).join(limits, "lang", "left"), F.lit(True)
    for c, threshold in JUDGED.items():
        q = all_q[f"{c}_q"]
        fallback = F.lit(None).cast("double") if q is None else F.lit(float(q[1]) + settings.reach * widths[c])
        out = out.withColumn(threshold, F.coalesce(f"{c}_limit", fallback))
        keep = keep & (F.col(threshold).isNull() | (F.col(c) <= F.col(threshold)))
    perplexity = F.when(F.col("n_tokens") > 0, F.exp(F.col("loss") / F.col("n_tokens"))).otherwise(1.0)
    judgement = [x for pair in JUDGED.items() for x in pair]
    return out.select("doc_id", "text_hash", "lang", "n_tokens", perplexity.alias("perplexity"), *judgement, ((F.col("n_tokens") == 0) | keep).alias("keep"))
