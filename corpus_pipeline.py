"""A training corpus from documents, stage by stage; every stage is a written table.

Language identification drops what has no language, near-duplicate detection all but
one document of each group, decontamination the documents that hold test phrases. Then
secrets are blanked out, and the texts are encoded.

Stages take and return the columns of documents, the last one with the pieces added;
other columns of the table are not carried, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee.llm import blob_ledger, byte_cnn, fmindex, piece_lattice, simhash
from perigee.llm.shared import shared_folder, stored

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
LEAST_SCORE = 0.4
PRINT_WORDS = 3
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, and those of which the network is unsure."""
    found = byte_cnn.identify(docs.select(*COLUMNS))
    return found.where((F.col("lang_pred") != byte_cnn.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of copies and near copies, that with the smallest id.

    Fingerprints link documents as in op2; those farther apart are linked by similarity."""
    return simhash.one_of_each(docs.select(*COLUMNS), print_words=PRINT_WORDS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a phrase of the test set."""
    found = fmindex.contaminated_spans(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("hit_items") == 0).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blank out the secrets; n_chars follows the text."""
    docs = docs.select(*COLUMNS, F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"))
    found = blob_ledger.scan(docs, shared_folder(spark)).where(F.size("found") > 0).select("blob", "found").distinct()
    joined = docs.join(found, "blob", "left")
    blanked = joined.withColumn("blanked", blob_ledger.redacted(F.col("text"), F.col("found")))
    kept = F.col("found").isNull()
    return blanked.select(
        "doc_id",
        F.when(kept, F.col("text")).otherwise(F.col("blanked")).alias("text"),
        "lang",
        "source",
        F.when(kept, F.col("n_chars")).otherwise(F.length("blanked").cast("long")).alias("n_chars"),
    )


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode: the last stage adds the piece ids to the columns of documents."""
    return piece_lattice.encode(docs.select(*COLUMNS), MODEL).drop("next_best")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("pieces", pieces),
]

# No SQL expresses the trained stage, the fingerprints or the lattice.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs
