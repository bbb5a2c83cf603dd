"""A training corpus from raw documents: quality, toxicity, near-duplicates, source mixture, tokens.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns the next stage's documents, the last
one the encoded corpus. run() applies them one after another, each result written as Parquet and read again. Null or
empty texts fail the quality rules; rows with a null id stay as long as the rules keep them and are never merged with
others; repeated rows leave the near-duplicate stage once. The mixture repeats and leaves out documents by design.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.bpe_codec import digests, round_trip
from tesserae.llm.common import cut, shared_folder, table
from tesserae.llm.near_copies import near_copies
from tesserae.llm.quality_rules import judge
from tesserae.llm.source_mixing import mix
from tesserae.llm.toxicity import toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words to a shingle; near-duplicates have 0.8 or more of their shingles in common (Jaccard similarity).
SHINGLE = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules; a bad host's documents stay if no soft rule fails."""
    return judge(docs.select(*COLUMNS)).where("q_kept").select(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, taught by this stage's documents, doesn't call toxic."""
    return toxicity(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("tox_predicted = 0").select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the least id and, of rows with that id, the least hash of its text.

    Rows are told apart by id and text, so that different texts under one id are each kept or dropped on their own.
    """
    docs = docs.select(*COLUMNS)
    own = docs.where("doc_id is not null").withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    leads = near_copies(own.select("doc_id", "text"), size=SHINGLE).where("leads").groupBy("doc_id", "text_hash").agg(F.count("*").alias("times"))
    leads = cut(leads)
    kept = own.join(leads.select("doc_id", "text_hash"), ["doc_id", "text_hash"], "left_semi")
    if not leads.where("times > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "text_hash"])
    return kept.select(*COLUMNS).unionByName(docs.where("doc_id is null"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture uses it, none included."""
    used = mix(docs.select(*COLUMNS)).where("mix_copies > 0")
    return used.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "mix_copies"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, for each copy."""
    return digests(round_trip(docs.select("doc_id", "text")).drop("text"))


STAGES = [("quality", quality), ("toxicity", clean), ("near_duplicates", distinct), ("mixture", mixture), ("tokens", tokens)]

#: Toxicity is a fitted model, shingles and BPE are byte loops: SQL can't express the stages. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, through Parquet tables in the shared checkpoint folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
