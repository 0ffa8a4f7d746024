"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

The index holds the postings (document, term, position) of every benchmark term in the training
texts, and one entry per document with its number of words. Terms are counted in the index. A
benchmark window is looked up from its two rarest terms: their postings are shifted by the terms'
offsets in the item, and where both fall on the same diagonal (document position minus item position)
the window may occur. Windows with a term that has no posting are dropped at once. The candidates
are then compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwell.llm.common import LOWER, UPPER, WORD_PATTERN
from panelwell.session import broadcast_rows, store

#: Term number of the entry that holds a document's number of words.
LENGTH_TERM = -1


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null has none."""
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(WORD_PATTERN), F.lit(0)), F.array().cast("array<string>"))


def small(df: DataFrame) -> DataFrame:
    """Marks a table for broadcast if it was counted as short; else the join is left to a shuffle."""
    return F.broadcast(df) if df.count() <= broadcast_rows(df.sparkSession) else df


class PositionalIndex:
    """Postings of the benchmark's terms, stored in the shared folder.

    ``items``: item (number of a distinct id and text), item_id, terms (term numbers), n.
    ``terms``: term (number), word.
    ``postings``: doc_id, text_hash, term, pos. Documents are known by id and hash of their text, so
    documents that share an id keep apart; repeated rows have repeated postings.
    """

    def __init__(self, docs: DataFrame, benchmark: DataFrame):
        # items without an id can't be named in a result, those without words have no window
        named = benchmark.where(F.col("item_id").isNotNull()).select("item_id", "text").distinct()
        listed = named.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
        item = F.xxhash64("item_id", "words")
        self.items = store(listed.select(item.alias("item"), "item_id", "words", F.size("words").alias("n")).dropDuplicates(["item"]), "items")
        distinct = self.items.select(F.explode("words").alias("word")).distinct()
        # numbers by hash; unlike positions in an order they need no single task
        self.terms = store(distinct.select("word", F.xxhash64("word").alias("term")), "terms")
        tokens = words(F.col("text"))
        row = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), tokens.alias("words")).withColumn("n", F.size("words"))
        marked = row.select("doc_id", "text_hash", "n", F.posexplode(F.concat(F.array(F.lit("\x00")), F.col("words"))).alias("at", "word"))
        sentinel = docs.sparkSession.createDataFrame([("\x00", LENGTH_TERM)], "word string, term long")
        known = marked.join(small(self.terms.unionByName(sentinel)), "word")
        place = F.when(F.col("term") == LENGTH_TERM, F.col("n")).otherwise(F.col("at") - 1)
        self.postings = store(known.select("doc_id", "text_hash", "term", place.alias("pos")), "postings")

    def lengths(self) -> DataFrame:
        """One row per document row: doc_id, text_hash, n_words."""
        return self.postings.where(F.col("term") == LENGTH_TERM).select("doc_id", "text_hash", F.col("pos").alias("n_words"))

    def anchors(self, window: int) -> DataFrame:
        """Per item: its windows as (start, a, b) with the positions of their two rarest terms; a window of one word has a = b."""
        counts = self.postings.where(F.col("term") != LENGTH_TERM).groupBy("term").agg(F.count("*").alias("n_postings"))
        places = self.items.select("item", "n", F.posexplode("words").alias("at", "word")).withColumn("term", F.xxhash64("word"))
        found = places.join(small(counts), "term", "left")
        rare = found.groupBy("item").agg(
            F.first("n").alias("n"),
            F.transform(F.sort_array(F.collect_list(F.struct("at", "n_postings"))), lambda x: x["n_postings"]).alias("frequency"),
        )
        width = F.least(F.col("n"), F.lit(window))

        def one(start: Column) -> Column:
            inside = F.transform(F.slice("frequency", start + 1, width), lambda f, i: F.struct(f.alias("f"), (start + i).alias("at")))
            order = F.sort_array(inside)
            return F.struct(start.alias("start"), order[0]["at"].alias("a"), F.coalesce(F.get(order, F.lit(1))["at"], order[0]["at"]).alias("b"),
                            F.exists(inside, lambda x: x["f"].isNull()).alias("absent"))

        windows = F.filter(F.transform(F.sequence(F.lit(0), F.col("n") - width), one), lambda w: ~w["absent"])
        return rare.select("item", windows.alias("windows")).where(F.size("windows") > 0)

    def near(self, window: int) -> tuple[DataFrame, DataFrame]:
        """The anchors, and their postings moved onto diagonals: doc_id, text_hash, item, diagonal, at (item position)."""
        anchors = store(self.anchors(window), "anchors")
        both = F.flatten(F.transform("windows", lambda w: F.array(w["a"], w["b"])))
        places = anchors.select("item", F.explode(F.array_distinct(both)).alias("at"))
        terms = self.items.select("item", "words").join(small(places), "item").select("item", "at", F.xxhash64(F.col("words")[F.col("at")]).alias("term"))
        shifted = self.postings.where(F.col("term") != LENGTH_TERM).join(small(terms), "term")
        return anchors, shifted.select("doc_id", "text_hash", "item", (F.col("pos") - F.col("at")).alias("diagonal"), "at")

    def phrase_matches(self, docs: DataFrame, window: int) -> DataFrame:
        """Per document, item and diagonal with an occurring window: doc_id, text_hash, item_id, hits (positions in the document)."""
        anchors, shifted = self.near(window)
        meets = shifted.groupBy("doc_id", "text_hash", "item", "diagonal").agg(F.collect_set("at").alias("found"))
        has = lambda w: F.array_contains("found", w["a"]) & F.array_contains("found", w["b"])
        likely = meets.join(small(anchors), "item").where(F.exists("windows", has))
        sizes = small(self.items.select("item", "n"))
        grouped = store(
            likely.join(sizes, "item").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("item", "diagonal", "n")).alias("candidates")), "candidates"
        )
        texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
        right = small(grouped.select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), "candidates"))
        rows = texts.join(right, (F.col("text_hash") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__doc")))
        rows = rows.select("doc_id", "text_hash", "candidates", words(F.col("text")).alias("words"))

        def cut(c: Column) -> Column:
            low = F.greatest(c["diagonal"], F.lit(0))
            return F.struct(c["item"].alias("item"), low.alias("low"), (low - c["diagonal"]).alias("skip"),
                            F.slice("words", low + 1, c["n"] - (low - c["diagonal"])).alias("part"))

        # repeated rows say the same: one of them is compared
        parts = rows.select("doc_id", "text_hash", F.explode(F.transform("candidates", cut)).alias("c")).select("doc_id", "text_hash", "c.*").distinct()
        side = small(self.items.select("item", "item_id", F.col("words").alias("item_words"), "n"))
        pairs = parts.join(side, "item")
        width = F.least(F.col("n"), F.lit(window))
        equal = F.transform("part", lambda w, i: w == F.get(F.col("item_words"), F.col("skip") + i))
        flagged = pairs.withColumn("equal", equal).where(F.size("equal") >= width)
        starts = F.filter(F.sequence(F.lit(0), F.size("equal") - width), lambda i: ~F.exists(F.slice("equal", i + 1, width), lambda e: ~e))
        hits = F.array_distinct(F.flatten(F.transform(F.col("starts"), lambda i: F.sequence(F.col("low") + i, F.col("low") + i + width - 1))))
        return flagged.withColumn("starts", starts).where(F.size("starts") > 0).select("doc_id", "text_hash", "item_id", hits.alias("hits"))

    def proximity_matches(self, window: int, slack: int = 5) -> DataFrame:
        """Documents and items with at least two rare terms of the item within ``slack`` words of their places.

        One row per document and item: doc_id, text_hash, item_id, n_terms (most rare terms that meet).
        """
        _, shifted = self.near(window)
        bin_of = F.floor(F.col("diagonal") / slack)
        binned = shifted.withColumn("bin", F.explode(F.array(bin_of, bin_of + 1)))
        meets = binned.groupBy("doc_id", "text_hash", "item", "bin").agg(F.countDistinct("at").alias("n_terms")).where(F.col("n_terms") >= 2)
        named = meets.join(small(self.items.select("item", "item_id")), "item")
        return named.groupBy("doc_id", "text_hash", "item_id").agg(F.max("n_terms").alias("n_terms"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, part: int = 20) -> DataFrame:
    """One row per document row: doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in an occurrence of a window of ``window`` consecutive item words (an item
    of fewer words, but not none, is one window). A document is contaminated if at least one in ``part``
    of its words is hit. Null and empty texts have no words and are never contaminated; a null doc_id is
    kept; repeated rows are judged each; items without an id take no part, repeated items count once, and
    items that share an id are one item with the windows of all. Only doc_id, text and item_id are read.
    """
    index = PositionalIndex(docs, benchmark)
    matches = index.phrase_matches(docs, window)
    per_doc = matches.groupBy("doc_id", "text_hash").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("n_hit"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    right = per_doc.select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), "n_hit", "items")
    joined = index.lengths().join(right, (F.col("text_hash") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__doc")), "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), ((n_hit > 0) & (F.lit(part) * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
