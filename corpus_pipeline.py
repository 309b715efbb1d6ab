"""From raw documents to token ids: quality, line dedup, near duplicates, mix, tokens.

Every stage but the last returns the columns it was given, further ones included, whatever
their names; an empty table passes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usageweave.llm import byte_bpe, line_dedup, mixing, ngram_join, quality
from usageweave.llm.shared import ship_package, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the divergence from their language reject go: null,
    empty and short texts, whatever else they hold. Of rows that are alike all stay or none.
    """
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").alias("of_doc"), F.xxhash64(text).alias("of_text"), "lang", "text"
    )
    # What is stored of a row is its key and its counts, not the document.
    judged = quality.judge(rows, columns=["of_doc", "of_text", "lang"])
    kept = judged.where("quality.kept").select("of_doc", "of_text", F.col("lang").alias("of_lang"))
    alike = (
        "d.doc_id <=> k.of_doc AND d.lang <=> k.of_lang"
        " AND xxhash64(CAST(d.text AS STRING)) = k.of_text"
    )
    return docs.alias("d").join(kept.alias("k"), F.expr(alike), "left_semi")


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go; documents stay. Copies of a document
    do not make its lines boilerplate: they are whole when near duplicates are looked for.
    A null source is one of its own; a null text stays null.
    """
    columns = docs.columns
    rows = docs.select(F.struct(*columns).alias("doc"), "source", "text")
    lines = line_dedup.text_lines(F.col("text"))
    options = line_dedup.LineOptions(count_copies=False)
    out = line_dedup.drop_boilerplate(rows, F.col("source"), lines, options)
    text = F.when(F.col("line_dedup.n_dropped") == 0, F.col("text")).otherwise(
        F.array_join("line_dedup.kept", "\n")
    )
    return _with_text(out.withColumn("text", text), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays: five words a shingle, and
    a similarity of 0.8 or more. Texts without words all stay.
    """
    ship_package(spark)
    return ngram_join.one_of_each(docs, ngram_join.JoinOptions(n=5, percent=80))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources reads them. A null source is one of its own;
    texts without words have no size and are never read.
    """
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text. A null text has no
    tokens, as an empty one. Other columns than the documents' own end here.
    """
    import public_tokenizers

    ship_package(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    bpe = byte_bpe.Bpe(spark, path, public_tokenizers.PATTERN)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", digest, "text")).drop("text")
    return bpe.decode(encoded).select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        (F.sha2("bytes", 256) == F.col("digest")).alias("round_trip"),
    )


def _with_text(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from the struct ``doc``, with a new text and its length."""
    new = {"text": F.col("text"), "n_chars": F.length("text")}
    types = dict(docs.dtypes)
    return rows.select(
        *[new.get(c, F.col("doc")[c]).cast(types[c]).alias(c) for c in docs.columns]
    )


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_common_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("byte-level BPE", tokenize),
]

#: Hash order and token ids are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each one's result is written and read again."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        df = stored(stage(spark, df, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return df
