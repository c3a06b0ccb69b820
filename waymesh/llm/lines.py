"""Line deduplication across documents by range-partitioned hashes and keep bitmaps.

Lines travel as hashes with their document and position. They are range-partitioned
by (hash, document) and sorted by position, so that a line which very many documents
share is spread over partitions and each partition is one stream: it counts the
documents of a hash and notes its first occurrence without holding a group. What
comes back to a document is a compressed bitmap of the lines it keeps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.llm.text import ASCII_LOWER, LOWER, UPPER, as_bytes
from waymesh.session import materialize

SPACE = b" \t\n\r\x0b\x0c"
#: Stands for a null doc_id where documents are counted.
NO_ID = -(1 << 63)


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).translate(ASCII_LOWER)


def code_points(data: bytes) -> int:
    return len(data) - sum(1 for c in data if c & 0xC0 == 0x80) if not data.isascii() else len(data)


def _with_row_key(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text; the first and the last tell documents apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("doc_hash", F.xxhash64("text"))


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """Rows (h1, h2, doc_id, doc_hash, pos) for every line whose key has `min_chars` code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, row, pos = [], [], []
            for k, data in enumerate(as_bytes(batch.column(1))):
                for at, line in enumerate((data or b"").split(b"\n")):
                    key = line_key(line)
                    if len(key) >= min_chars and code_points(key) >= min_chars:
                        digests.append(xxhash.xxh3_128_digest(key))
                        row.append(k)
                        pos.append(at)
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            row = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column(0).take(row), batch.column(2).take(row), pa.array(pos, pa.int32())], names=["h1", "h2", "doc_id", "doc_hash", "pos"]
            )

    return docs.mapInArrow(run, "h1 long, h2 long, doc_id long, doc_hash long, pos int")


def _count_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows: for each hash and batch, how many documents begin and the first occurrence.

    The partition's first and last document of a hash may go on in its neighbours. They
    are given back with a count of -1 and named, to be counted once for all partitions.
    """
    first = last = None
    names = ["h1", "h2", "n_docs", "doc_id", "doc_hash", "pos", "edge"]
    for batch in batches:
        if not batch.num_rows:
            continue
        doc_id = batch.column(2).fill_null(NO_ID).to_numpy()
        h1, h2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        key = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        doc = key.copy()
        doc[1:] |= doc_id[1:] != doc_id[:-1]
        begin = (h1[0], h2[0], doc_id[0])
        first = first or begin
        doc[0] = last != begin
        last = (h1[-1], h2[-1], doc_id[-1])
        at = np.flatnonzero(key)
        n = np.add.reduceat(doc.astype(np.int64), at)
        take = pa.array(at)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), batch.column(1).take(take), pa.array(n), *(batch.column(c).take(take) for c in (2, 3, 4)), pa.nulls(len(at), pa.int64())], names=names
        )
    for h1, h2, edge in {first, last} - {None}:
        none = [pa.nulls(1, kind) for kind in (pa.int64(), pa.int64(), pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array([h1]), pa.array([h2]), pa.array([-1], pa.int64()), *none, pa.array([edge], pa.int64())], names=names)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for dropped in batch.column(2).to_pylist():
            keep = np.ones(8 * (max(dropped) // 8 + 1), np.uint8)
            keep[dropped] = 0
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], names=["doc_id", "doc_hash", "keep"])


def line_bitmaps(docs: DataFrame, min_chars: int = 1, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """Rows (doc_id, doc_hash, keep) for documents that lose lines.

    A line's key is the line without ASCII white space at its ends and A-Z
    lower-cased. Keys of `min_chars` code points or more that occur in `min_docs`
    documents or more lose their lines, all of them or, with `keep_first`, all but
    the first in (doc_id, position) order. keep: zlib-compressed bits, one for each
    line, 1 to keep it; lines beyond its end are kept. Rows of one doc_id, or of none,
    are one document.
    """
    lines = materialize(line_hashes(_with_row_key(docs), min_chars))
    dealt = lines.repartitionByRange("h1", "h2", "doc_id", "doc_hash").sortWithinPartitions("h1", "h2", "doc_id", "doc_hash", "pos")
    counted = dealt.mapInArrow(_count_stream, "h1 long, h2 long, n_docs long, doc_id long, doc_hash long, pos int, edge long")
    # at most two edges for each partition
    n_docs = F.sum("n_docs") + F.size(F.collect_set("edge"))
    counted = counted.groupBy("h1", "h2").agg(n_docs.alias("n_docs"), F.min(F.when(F.col("edge").isNull(), F.struct("doc_id", "doc_hash", "pos"))).alias("first"))
    common = materialize(counted.where(F.col("n_docs") >= min_docs).select("h1", "h2", "first"))
    drop = lines.join(common, ["h1", "h2"])
    if keep_first:
        first = F.struct("doc_id", "doc_hash", "pos")
        drop = drop.where(~first.eqNullSafe(F.col("first")))
    dropped = drop.groupBy("doc_id", "doc_hash").agg(F.collect_set("pos").alias("dropped"))
    return dropped.mapInArrow(_bitmaps, "doc_id long, doc_hash long, keep binary")


def _kept_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, lines, gone = [], [], []
        for data, keep in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            parts = (data or b"").split(b"\n")
            n = len(parts)
            if keep is not None:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[:n]
                kept = [x for x, k in zip(parts, bits.tolist(), strict=False) if k] + parts[len(bits) :]
                data, parts = b"\n".join(kept), kept
            text.append(data or b"")
            lines.append(n)
            gone.append(n - len(parts))
        texts = pa.array(text, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], names=["row", "text", "n_lines", "n_dropped"])


def drop_common_lines(docs: DataFrame, min_chars: int = 1, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """The rows of `docs` without the lines that documents share; adds n_lines and n_dropped.

    Other lines stay as they are, joined by newlines. A null or empty text is one
    empty line and becomes an empty text. All other columns stay, whatever their names.
    """
    maps = line_bitmaps(docs, min_chars, min_docs, keep_first)
    others = [c for c in docs.columns if c != "text"]
    keyed = docs.select(F.struct(*others).alias("row"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("_h"), F.col("doc_id").cast("long").alias("_id"))
    joined = keyed.join(maps, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("doc_hash")), "left").select("row", "text", "keep")
    row = joined.schema["row"].dataType.simpleString()
    kept = joined.mapInArrow(_kept_text, f"row {row}, text string, n_lines long, n_dropped long")
    clash = {"n_lines", "n_dropped"} & set(others)
    return kept.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in clash), "n_lines", "n_dropped")


#: DuckDB SQL for the lines that `documents` lose; rows of one doc_id are one document, and a row each.
LINES_SQL = f"""
with d as (select row_number() over () as row, doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
l as (
  select row, doc_id, u.line, u.pos,
         translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') as key
  from (select row, doc_id, unnest(parts) as line, generate_subscripts(parts, 1) as pos from d) u),
c as (select key from l where length(key) >= 1 group by key having count(distinct doc_id) + bool_or(doc_id is null)::int >= 10)
select l.doc_id, count(*) as n_lines, count(c.key) as n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) order by l.pos) filter (where c.key is null), '')) as kept_sha256
from l left join c on l.key = c.key group by l.row, l.doc_id
"""
