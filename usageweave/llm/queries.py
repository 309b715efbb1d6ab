"""Registered queries of the text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usageweave.llm import byte_bpe, collocations, conversations, language_id, line_dedup
from usageweave.llm import hashing_ann, minhash, mixing, ngram_join, quality, secret_scan
from usageweave.llm import substring_dedup, url_filter
from usageweave.llm.shared import ship_package
from usageweave.llm.sql import ORACLES

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(function: Callable) -> Callable:
    @wraps(function)
    def query(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return function(spark, folder)

    QUERIES[function.__name__] = query
    return query


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@register
def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document: base kinds counted, all spans listed."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secret_scan.find(docs, secret_scan.learn(docs)).drop("text")
    secrets = F.col("secrets")

    def listed(spans):
        shown = F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
        )
        return F.array_join(shown, ",")

    def number(kind):
        return F.size(F.filter(secrets, lambda s: s["kind"] == kind)).cast("long")

    base = F.filter(secrets, lambda s: s["kind"].isin(*secret_scan.BASE))
    return found.select(
        "doc_id",
        *[number(k).alias(f"n_{k}") for k in secret_scan.BASE],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(secrets).alias("spans"),
        number(secret_scan.FORMAT).alias("n_format"),
    )


@register
def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How many words the mix takes of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    taken = mixing.plan_mix(docs).taken()
    return taken.select("doc_id", "size", "source_size", "target", "taken", "source")


@register
def op3_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Shingles of every document, and its component of near duplicates."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return ngram_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


@register
def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every text, and the bytes they decode to, as digests."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    bpe = byte_bpe.Bpe(spark, path, public_tokenizers.PATTERN)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs).drop("text")
    return bpe.decode(encoded).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


@register
def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from the two thirds that aren't held out."""
    docs = table(spark, folder, "documents")
    third = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = language_id.learn(docs.where(~third).select("lang", "text"))
    found = language_id.identify(docs.select("doc_id", third.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


@register
def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, winning site rule and verdict of every page."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    found = url_filter.judge_urls(pages).select("page_id", "url_filter.*")
    site_rule = F.when(F.col("rank") == 1, F.col("rule"))
    return found.select(
        "page_id",
        "host",
        "path",
        site_rule.alias("rule"),
        "verdict",
        F.when(F.col("rank") == 0, F.col("rule")).alias("pattern_rule"),
    )


@register
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of every page, how many its host's boilerplate took, and what is left."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    host = url_filter.host_and_path(F.col("url"))[0]
    lines = line_dedup.html_lines(F.col("html"))
    out = line_dedup.drop_boilerplate(pages, host, lines)
    return out.select(
        "page_id",
        F.col("line_dedup.n_lines").alias("n_lines"),
        F.col("line_dedup.n_dropped").alias("n_dropped"),
        F.sha2(F.array_join("line_dedup.kept", "\n"), 256).alias("kept_sha256"),
    )


@register
def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document, how many repeated windows cover, and what is left."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = substring_dedup.repeats(docs)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@register
def op9_hashing_ann(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one, among all."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return hashing_ann.neighbours(vectors, F.col("vec_id") % 100 == 0)


@register
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of every document and whether it stays."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    judged = quality.judge(docs, columns=["doc_id"]).select("doc_id", "quality.*")
    return judged.drop("class_distance", "word_distance")


@register
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of every conversation after damage, and its cheapest repair."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.repaired_conversations(conversations.damaged(rows), rows)


@register
def op12_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Shingles of every document, its component of near duplicates, and whether it stays."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs).drop("text_hash")


@register
def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The best phrases of every language."""
    docs = table(spark, folder, "documents").select("lang", "text")
    return collocations.phrases(docs)
