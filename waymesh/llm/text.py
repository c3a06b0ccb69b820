"""What several operators of this subpackage share: tables, words, grouped Arrow streams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: bytes.translate table that lower-cases A-Z only.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: bytes.translate table that lower-cases A-Z and blanks all other ASCII but digits and a-z.
ALNUM_LOWER = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in ASCII_LOWER)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: str | Column) -> Column:
    """Number of words of a text column; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column without decoding them."""
    return column.cast(pa.large_binary()).to_pylist()


def alnum_words(data: bytes, chunk: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text with A-Z lower-cased, some at a time.

    A word is whole however long it is; besides one, about `chunk` bytes are split at once.
    """
    data = data.translate(ALNUM_LOWER)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + chunk) if len(data) - at > chunk else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end + 1


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, least_rows: int = 1) -> Iterator[pa.Table]:
    """Tables of whole groups from batches in which the rows of a key follow each other.

    At most one group and the rows up to `least_rows` are held back at a time.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(key))
        last = column[batch.num_rows - 1].as_py()
        cut = batch.num_rows - _tail(column, last)
        if cut:
            held.append(batch.slice(0, cut))
            if sum(x.num_rows for x in held) >= least_rows:
                yield pa.Table.from_batches(held)
                held = []
        if cut < batch.num_rows:
            tail = batch.slice(cut)
            if cut == 0 and held and held[-1].column(held[-1].schema.get_field_index(key))[held[-1].num_rows - 1].as_py() != last:
                if sum(x.num_rows for x in held) >= least_rows:
                    yield pa.Table.from_batches(held)
                    held = []
            held.append(tail)
    if held:
        yield pa.Table.from_batches(held)


def _tail(column: pa.Array, last) -> int:
    """How many rows at the end of a column equal its last value."""
    other = pc.not_equal(column, last)
    at = pc.index(pc.fill_null(other, True).slice(0)[::-1], True).as_py()
    return len(column) if at < 0 else at
