"""A training-data pipeline over documents.

Each stage works on what the one before kept; its result is written to the
shared folder and read again. Stages but the last return the columns of documents.
"""

from __future__ import annotations

from itertools import accumulate

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streetloom.llm import bpe, mixing, ngram_join, quality, secrets
from streetloom.llm.shared import prepare, table, written


#: A document goes if its score, the probability that it is good, is below this: if the classifier predicts it as 0.
REJECTED = quality.DECISION


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled rows that aren't held out, doesn't reject."""
    net = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.score(docs, net, out="__score").filter(F.col("__score") >= REJECTED).drop("__score")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each component of documents with similar 5-word shingles; documents without a doc_id stay.

    Of rows that share a doc_id one stays, the first by a hash of the text.
    """
    groups = ngram_join.jaccard_components(docs)
    kept = groups.filter("doc_id = component_id").select("doc_id").distinct()
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    named = docs.join(kept, "doc_id", "left_semi").withColumn("__n", F.row_number().over(first)).filter("__n = 1")
    return named.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by their kind; n_chars follows."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix, those of sources that start again as often as they come."""
    return mixing.mix(docs).repartitionByRange("__slot", "__source").sortWithinPartitions("__slot", "__source", "__offset").select(*docs.columns)


def positions(docs: DataFrame) -> DataFrame:
    """docs, read from a Parquet folder, with position: a row's number from 0 on in the order of writing, by part files and rows within each.

    Reading alone doesn't keep that order: Spark deals the files out by length.
    """
    part = lambda pattern: F.regexp_extract("__file", pattern, 1).try_cast("long")
    rows = docs.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    files = rows.groupBy("__file").agg(F.count("*").alias("n")).orderBy(part(r"^part-(\d+)"), part(r"-c(\d+)[^-]*$"), "__file").collect()
    starts = accumulate((r["n"] for r in files), initial=0)
    bases = docs.sparkSession.createDataFrame([(r["__file"], at) for r, at in zip(files, starts, strict=False)], "__file string, __base long")
    return rows.join(F.broadcast(bases), "__file").select(*docs.columns, (F.col("__base") + F.col("__row")).alias("position"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and its position in the mix; rows come in that order."""
    ordered = positions(docs).orderBy("position")
    got = bpe.encode(ordered, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id", "lang", "source", "position"])
    return got.select("doc_id", "lang", "source", "position", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding", encode),
]

#: The classifier and the tokenizer can't be put in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a null or empty table gives an empty result."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
