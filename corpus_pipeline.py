"""A corpus through language ID, near-duplicates, decontamination, personal data and encoding.

Each stage takes (spark, docs, sf_dir) and works on whatever the stage before it kept. Columns of `documents` stay as
they are until the last stage, and columns beyond those pass through. Empty tables give empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genemill.llm import bpe, decontaminate, lang_id, pii, simhash
from genemill.llm.common import held_out, table
from genemill.llm.queries import PATTERN, VOCABULARY
from genemill.session import ensure_checkpoint_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told; null texts and texts without a letter go."""
    model = lang_id.fit(docs.where(~held_out(F.col("doc_id"), 4)))
    if not model.langs:  # no labelled row to learn from: all that has a letter stays
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = lang_id.predict(docs, model, pred="__lang", score="__score")
    return found.where("__lang <> 'und'").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each class of near-duplicates; rows without an id stay, once for each text."""
    named = docs.where("doc_id IS NOT NULL")
    classes = simhash.near_duplicates(named)
    first = classes.where("doc_id = component_id").select("doc_id").distinct()
    kept = named.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id IS NULL").dropDuplicates(["text"])).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    found = decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark"), out="__hits")
    hit = F.col("__hits.n_hit")
    return found.where((hit == 0) | (20 * hit < F.col("__hits.n_words"))).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows."""
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids (binary, four bytes each), and the digest of the text they decode to."""
    coded = bpe.round_trip(docs, VOCABULARY, PATTERN)
    return coded.select(
        "doc_id", bpe.n_ids(F.col("ids")).alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("text_sha256")
    )


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("PII", personal_data),
    ("byte-level BPE", encode),
]

ORACLE_SQL = None  # SQL can express neither the classifier nor the fingerprints nor the encoder


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage returns is written to the shared checkpoint folder and read by the next."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir() or spark.conf.get('spark.checkpoint.dir')}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
