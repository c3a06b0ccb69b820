"""The queries of this subpackage, by operator number, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh.llm import fingerprints, infill, licenses, lines, mixing, packing, quality, resampling, simhash, suffixes, tokens, toxicity, urls
from waymesh.llm.text import table

#: Context limits that are answered whether a document has that length or not.
CONTEXT_LIMITS = tuple(1 << k for k in range(7, 21))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def conversation_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations under three limits, of which only answers bear loss."""
    sizes = packing.conversation_sizes(table(spark, sf_dir, "conversations"))
    return packing.pack_sizes(sizes, packing.Limits(tokens=2048, segments=16, loss=1024))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.link_components(simhash.fingerprints(table(spark, sf_dir, "documents"), words=3), lanes=1, budget=3)
    return found.select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.length_table(tokens.length_histogram(table(spark, sf_dir, "documents")), limits=CONTEXT_LIMITS)


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeats(table(spark, sf_dir, "documents"), length=50)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), statistics=True)
    return judged.select("row.doc_id", *quality.STATISTICS, "base_failed", "kept")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return urls.filter_urls(table(spark, sf_dir, "pages"), outcomes)


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=1, min_docs=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2(infill.restored("output", "form"), 256).alias("restored_sha256"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_simhash, op3_toxicity, op4_token_counts, op5_suffixes, op6_quality, op7_mixing, op8_urls, op9_lines, op10_fingerprints,
        op11_licenses, op12_infill, op13_resampling, conversation_packing,
    )
}

SQL = {
    "op6_quality": quality.QUALITY_SQL, "op7_mixing": mixing.MIX_SQL, "op8_urls": urls.URLS_SQL, "op9_lines": lines.LINES_SQL,
    "op12_infill": infill.INFILL_SQL,
}
