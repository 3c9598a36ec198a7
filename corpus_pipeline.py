"""A training corpus from ``documents``: language, quality, near duplicates, repeated passages, packing.

Every stage works on all rows that the one before kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.llm import language_id, near_dedup, packing, quality_rules, substring_dedup
from spanwright.llm.common import Scratch, settled
from spanwright.llm.queries import held_out

#: Mean probability under which a text counts as of no learned language.
LEAST_SCORE = 0.4

ORACLE_SQL = None  # SQL cannot express the network of the first stage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, and those whose language the network, trained on the labelled ones, is unsure of.

    Without a labelled document there is no language to know, and every document stays.
    """
    net = language_id.learned(docs, ~held_out())
    return language_id.recognised(docs, net, LEAST_SCORE) if net.languages else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rule or are probably bad."""
    return quality_rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group with similarity 0.8 on five-word shingles only the document of least doc_id stays.

    Of rows that agree in doc_id and text one stays, whichever; rows of a kept document with different texts stay all.
    Rows without doc_id stay.
    """
    found = near_dedup.near_duplicates(docs, 5, 80).filter("doc_id is not null")
    told = found.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    once = docs.join(told.filter("n > 1 or not kept").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    repeated = settled(told.filter("n > 1 and kept").select("doc_id"))
    if repeated.isEmpty():  # the usual case needs no second look at the texts
        return once
    several = docs.join(repeated, "doc_id", "left_semi").select(*docs.columns)
    return once.unionByName(several.dropDuplicates(["doc_id", "text"]))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words in windows of 50 that an earlier document holds; texts without such a window stay as they are."""
    key = ["of_doc", "of_text"]
    cut = substring_dedup.without_repeats(docs, 50).filter("kept_text is not null").select(F.col("doc_id").alias(key[0]), F.col("text_key").alias(key[1]), "kept_text").dropDuplicates(key)
    boxed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias(key[0]), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias(key[1]))
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    shorter = F.col("row").withField("text", F.col("kept_text"))
    if kind is not None:
        shorter = shorter.withField("n_chars", F.length("kept_text").cast(kind))
    return boxed.join(cut, key, "left").select(F.when(F.col("kept_text").isNotNull(), shorter).otherwise(F.col("row")).alias("row")).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of packing.CAPACITY byte tokens."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("passages", passages),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the others keep is written to the shared folder, read again and at last deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hold = Scratch(spark)
    try:
        for name, stage in STAGES[:-1]:
            docs = hold.keep(stage(spark, docs, sf_dir), name)
        return settled(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        hold.close()
