"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee.llm import (
    blob_ledger,
    byte_cnn,
    fmindex,
    hybrid_search,
    line_crf,
    link_graph,
    notices,
    piece_lattice,
    simhash,
    unit_dedup,
    vector_codes,
    warc,
    word_merges,
)
from perigee.llm.shared import shared_folder

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
WORD_MODEL = "/opt/tokenizers/word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures(table(spark, sf_dir, "pages")).select(
        F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op2_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op3_piece_lattice(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    found = piece_lattice.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return found.select("doc_id", "n_pieces", "score", "ids", "next_best", "round_trip")


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blob_ledger.scan(table(spark, sf_dir, "documents"), shared_folder(spark))
    base = blob_ledger.of_kinds("found", tuple(r.kind for r in blob_ledger.BASE))
    count = lambda kind: F.size(blob_ledger.of_kinds("found", (kind,))).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(blob_ledger.written(base), 256).alias("base_sha256"),
        blob_ledger.written(F.col("found")).alias("spans"),
    )


def op5_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = byte_cnn.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", byte_cnn.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op6_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = notices.scan(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices"
    )


def op7_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = link_graph.judge(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "trust", "distrust")


def op8_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = fmindex.contaminated_spans(documents, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        fmindex.n_hit().alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        fmindex.items_digest().alias("items_sha256"),
        (fmindex.n_hit() > 0).alias("contaminated"),
    )


def op9_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_crf.label_lines(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(
        F.col("id").alias("doc_id"),
        *["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"],
    )


def op10_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = unit_dedup.deduplicate(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["line"], x["start"], x["end"])), ",")
    return found.select(
        F.col("id").alias("doc_id"), F.size("removed").cast("long").alias("n_removed"), spans.alias("removed"), "text"
    )


def op11_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hybrid_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


def op12_word_merges(spark: SparkSession, sf_dir: str, path: str = WORD_MODEL) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = word_merges.encode(documents, path, ids_as=word_merges.BYTES).select("doc_id", "n_tokens", "ids")
    return word_merges.decode(encoded, path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    digits = F.transform("codes", lambda x: F.lower(F.lpad(F.hex(x), 2, "0")))
    return vector_codes.label_errors(coded).select(
        F.col("id").alias("vec_id"),
        F.array_join(digits, "").alias("code"),
        "error",
        "label_error",
        F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_captures,
        op2_simhash_components,
        op3_piece_lattice,
        op4_secret_ledger,
        op5_byte_cnn,
        op6_notices,
        op7_link_graph,
        op8_fm_index,
        op9_line_crf,
        op10_unit_dedup,
        op11_hybrid_search,
        op12_word_merges,
        op13_vector_codes,
        pipeline,
    )
}
