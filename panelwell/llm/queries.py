"""The queries opN_<name> over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwell.llm.chat_format import MARKED, conversation_digests, render_turns
from panelwell.llm.collocations import collocations
from panelwell.llm.common import fold_of, hash_number, table
from panelwell.llm.decontamination import contamination
from panelwell.llm.embedding_dedup import embedding_duplicates
from panelwell.llm.html_text import extract_text
from panelwell.llm.jaccard_join import similarity_join
from panelwell.llm.nearest_neighbours import search
from panelwell.llm.oracles import URL_FILTERS_SQL, collocations_sql, contamination_sql, mixture_sql, variants_sql
from panelwell.llm.quality import quality
from panelwell.llm.source_mixture import Margin, mixture
from panelwell.llm.spelling_variants import spelling_variants
from panelwell.llm.token_counts import count_tokens
from panelwell.llm.url_filters import filter_urls, host_of, step_of, suffixes
from panelwell.llm.toxicity import fit_toxicity, score_toxicity

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# --- 1 ---

MARGINS = (
    Margin("source", temperature=0.7),
    Margin("lang", shares={"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}),
    Margin("mix_topic", temperature=0.8),
)


def topic():
    """Documents have no topic column: their form stands for it."""
    n = F.char_length("text")
    return F.when(F.contains("text", F.lit("License")), "software").when(n < 500, "note").when(n < 5000, "article").otherwise("long")


def token_estimate():
    """Space-separated pieces; texts are never empty pieces alone."""
    return F.when(F.trim("text") == "", 0).otherwise(F.regexp_count(F.trim("text"), F.lit(r"\s+")) + 1)


def mixed(docs: DataFrame) -> DataFrame:
    return mixture(docs, token_estimate(), topic(), MARGINS)


def op1_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("tokens"),
                       F.round("mix_probability", 9).alias("probability"), F.col("mix_sampled").alias("sampled"))


# --- 3 ---


def learned_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) of the labelled documents that are not held out."""
    return labels.where(fold_of(F.col("doc_id")) != 0).select("doc_id", F.col(column).alias("label"))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit_toxicity(docs, learned_labels(labels, "toxic"))
    return score_toxicity(docs, model)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("held_out", fold_of(F.col("doc_id")) == 0).select(
        "doc_id", "held_out", "score", "predicted", "n_neighbours", "nearest_cosine", "toxic_votes", "nearest_examples"
    )


# --- 4 ---


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


# --- 7 ---


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


# --- 8 ---


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return conversation_digests(render_turns(rows, MARKED))


# --- 10 ---


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


# --- 6 ---


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


# --- 9 ---


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents labelled good by every label they have, without the held-out fifth."""
    kept = labels.where((fold_of(F.col("doc_id")) != 0) & F.col("quality").isNotNull())
    return kept.groupBy("doc_id").agg(F.min("quality").alias("quality")).where(F.col("quality") == 1).select("doc_id")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality(docs, trusted_ids(labels))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("held_out", fold_of(F.col("doc_id")) == 0).drop("text_hash")


# --- 5 ---


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join(table(spark, sf_dir, "documents")).drop("text_hash")


# --- 2 ---


def dated_captures(pages: DataFrame) -> DataFrame:
    """Pages carry no fetch day: one of a year's days is drawn from the page id."""
    day = hash_number(F.concat(F.lit("fetch:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))), 8) % 366
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day.cast("int")).alias("fetched"))


def dated_lists(pages: DataFrame) -> DataFrame:
    """Two lists drawn from the hosts of the pages: each host and step, host and domain may be entered, allowed and removed."""
    places = pages.select(host_of(F.col("url")).alias("host"), step_of(F.col("url")).alias("step")).where("host IS NOT NULL").distinct()
    domain = F.element_at(suffixes(F.col("host")), -1)
    patterns = places.select(F.explode(F.array("host", domain, F.when(F.col("step") != "", F.concat("host", F.lit("/"), "step")))).alias("pattern"))
    entry = F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.lit(i).alias("i")) for c in ("malware", "spam") for i in range(4)))).alias("e")
    rows = patterns.where("pattern IS NOT NULL").distinct().select("pattern", entry).select("pattern", "e.category", "e.i")
    number = hash_number(F.concat_ws(":", "pattern", "category", F.col("i").cast("string")), 8)
    action = F.element_at(F.array(*map(F.lit, ("block", "remove", "block", "allow", "remove"))), (F.floor(number / 8) % 5 + 1).cast("int"))
    return rows.where(number % 8 < 3).select(
        "pattern", "category", action.alias("action"), F.date_add(F.lit("2023-12-01").cast("date"), (F.floor(number / 64) % 420).cast("int")).alias("day")
    )


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rows = filter_urls(dated_captures(pages), dated_lists(pages))
    return rows.select("page_id", "fetched", "url_host", "url_blocked", "url_pattern", F.array_join("url_categories", ",").alias("url_categories"))


# --- 11 ---


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


# --- 12 ---


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


# --- 13 ---


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_source_mixture, op2_url_filters, op3_toxicity, op4_token_counts, op5_jaccard_join, op6_nearest_neighbours,
              op7_decontamination, op8_chat_format, op9_quality, op10_html_text, op11_collocations, op12_embedding_dedup, op13_spelling_variants)
}

ORACLES = {
    "op1_source_mixture": mixture_sql(MARGINS, 0.5, 12, 8, "mixture"),
    "op2_url_filters": URL_FILTERS_SQL,
    "op7_decontamination": contamination_sql(),
    "op11_collocations": collocations_sql(),
    "op13_spelling_variants": variants_sql(),
}
