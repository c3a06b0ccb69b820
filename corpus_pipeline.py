"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, mixing, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from waymesh.llm import lines, mixing, packing, quality, simhash
from waymesh.llm.text import table

#: Lines that so many documents share go from all of them.
COMMON_LINE_DOCS = 10


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go; the others stay as they are.

    Null and empty texts have no words and go; whole texts are judged, row by row, so that
    repeated rows stay or go together. Extra columns stay; an empty table gives one.
    """
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go from all of them; n_chars follows the text.

    A null text is one empty line and stays empty; rows that repeat a doc_id count as one
    document and lose the same lines. Whole texts are read, order is kept, extra columns
    stay, an empty table gives one.
    """
    kept = lines.drop_common_lines(docs, min_chars=1, min_docs=COMMON_LINE_DOCS)
    return mixing.with_length(kept.select(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays.

    Null and empty texts are equal to each other. Rows that repeat a doc_id stay or go
    together, rows without one stay. Texts are compared whole, extra columns stay, an
    empty table gives one.
    """
    return simhash.deduplicate(docs, words=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights; documents taken twice appear twice.

    A null source is a source, the last one; null and empty texts have no words and are
    not taken. Rows that agree in doc_id, source and size share what the mix takes of
    them. The document at a source's cut keeps its first words. Extra columns stay, an
    empty table gives one.
    """
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences with their token ids.

    A null or empty text has the end mark alone; texts are encoded whole and cut over
    sequences, repeated rows are packed each, extra columns are dropped, an empty table
    gives no pieces.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Tokenization and SimHash are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store the path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written to the warehouse and read again by the next.

    What a stage has read is deleted once its own result is written; the last stage's
    input stays, as the returned DataFrame reads it.
    """
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/corpus-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/{k}_{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before is not None:
                _remove(spark, before)
            before = path
    return docs
