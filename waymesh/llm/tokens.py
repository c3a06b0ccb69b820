"""Public tokenizers inside tasks, and exact statistics of encoded lengths."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator, Sequence
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymesh.llm.text import as_bytes
from waymesh.session import materialize

WORD_BPE = "word_bpe_49k.json"
#: Chunks and parts of chunks that a worker remembers at most, and how long a chunk is at most.
REMEMBERED, REMEMBERED_PARTS, LONGEST = 300_000, 400_000, 64


def tokenizer_path(name: str) -> str:
    """A path as it is, or the place of a file of the installed public tokenizers."""
    if Path(name).is_absolute():
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


class _Ids(dict):
    """Ids of a chunk of text, as little-endian unsigned 32-bit numbers; encoded when first asked for.

    Most chunks are one Latin word and the marks after it. Their two parts are looked
    up in turn, encoded by the tokenizer's model alone, as its rules for case and
    splitting leave such parts whole; any other chunk goes through all of it. A
    tokenizer with other rules is found out at the start and never takes the short way.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.encode, self.model = tokenizer.encode, tokenizer.model
        self.parts: dict[str, bytes] = {}
        self.visible = _byte_level()
        probes = ["word", "Größe", "ÉTÉ", "the.", "Ñu,;", "x)%%%", "ab***", "ßÿ\"", "q"]
        texts = ["a b", " a", "a ", "The cat,  the\tdog\n\nand the end.\r\n", "x\x0b\x0cy", "été Ñu; 12 3 4", "日本 語\n", "don't we 'll"]
        self.chunked = all(b"".join(map(self.long, x.split())) == self.long(x) for x in texts)
        self.simple = self.chunked and all(self.short(x) == self.long(x) for x in probes)

    def long(self, text: str) -> bytes:
        return array("I", self.encode(text, add_special_tokens=False).ids).tobytes()

    def part(self, text: str) -> bytes:
        ids = self.parts.get(text)
        if ids is None:
            if len(self.parts) >= REMEMBERED_PARTS:
                self.parts.clear()
            ids = self.parts[text] = array("I", [x.id for x in self.model.tokenize(text.translate(self.visible))]).tobytes()
        return ids

    def short(self, text: str) -> bytes | None:
        found = WORD_AND_MARKS.fullmatch(text)
        if found is None:
            return None
        word, marks = found.groups()
        return self.part(word.lower()) + self.part(marks) if marks else self.part(word.lower())

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        ids = self.short(text) if self.simple and len(chunk) <= LONGEST else None
        if ids is None:
            ids = self.long(text)
        if len(chunk) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = ids
        return ids


#: A word of ASCII and Latin-1 letters, then ASCII marks; apostrophes have rules of their own.
WORD_AND_MARKS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def _byte_level() -> dict[int, str]:
    """For str.translate: Latin-1 letters as the visible stand-ins of their UTF-8 bytes."""
    from tokenizers.pre_tokenizers import ByteLevel

    level = ByteLevel(add_prefix_space=False, use_regex=False)
    return {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}


@cache
def _remembered(name: str) -> _Ids:
    from tokenizers import Tokenizer

    return _Ids(Tokenizer.from_file(tokenizer_path(name)))


def chunk_encoder(name: str = WORD_BPE) -> Callable[[bytes], bytes]:
    """A function from a text's UTF-8 bytes to its ids.

    A tokenizer that drops white space and merges nothing across it gives a text the
    ids of its white-space separated chunks in turn. Chunks repeat, so each worker
    encodes one once and looks it up afterwards. Any other tokenizer, which the probes
    find out, encodes texts whole.
    """
    ids = _remembered(name)
    if not ids.chunked:
        return lambda data: ids.long(data.decode())
    return lambda data: b"".join(map(ids.__getitem__, data.split()))


def token_counts(docs: DataFrame, tokenizer: str = WORD_BPE) -> DataFrame:
    """Rows (doc_id, n_tokens); a null or empty text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = chunk_encoder(tokenizer)
        for batch in batches:
            n = [len(encode(data or b"")) // 4 for data in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def length_histogram(docs: DataFrame, tokenizer: str = WORD_BPE) -> DataFrame:
    """Rows (n_tokens, n_docs), one for each encoded length that occurs.

    Workers add up their own documents first, so what is shuffled is bounded by
    the number of different lengths of each task. Texts are encoded whole; a null or
    empty one has length 0, repeated rows count each, extra columns are not read and an
    empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = chunk_encoder(tokenizer)
        for batch in batches:
            n, docs_of = np.unique(np.array([len(encode(data or b"")) // 4 for data in as_bytes(batch.column(0))], np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(docs_of.astype(np.int64))], names=["n_tokens", "n_docs"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "n_tokens long, n_docs long")
    return counted.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def length_table(histogram: DataFrame, limits: Sequence[int] = (), band: int = 1024) -> DataFrame:
    """Exact answers for every context limit that occurs as a length, and for `limits`.

    Input: rows (n_tokens, n_docs). Output, for each n_tokens L:
    n_docs of that length, docs_longer and tokens_longer (documents of more than L
    ids and their ids), docs_upto and tokens_upto (the others), truncated_total (ids
    left when every document is cut at L) and quantile (share of documents of at most
    L ids). Suffix sums are taken within bands of lengths and over the bands, so that
    neither needs all lengths in one task: a band is at most `band` lengths. An empty
    histogram gives `limits` alone, with null quantiles.
    """
    tokens = F.col("n_tokens") * F.col("n_docs")
    asked = histogram.sparkSession.createDataFrame([(int(x), 0) for x in limits], "n_tokens long, n_docs long")
    rows = histogram.unionByName(asked).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    rows = materialize(rows.withColumn("band", F.floor(F.col("n_tokens") / band)))
    bands = rows.groupBy("band").agg(F.sum("n_docs").alias("band_docs"), F.sum(tokens).alias("band_tokens"))
    above = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    bands = bands.select(
        "band",
        F.coalesce(F.sum("band_docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("band_tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("band_docs").over(every).alias("all_docs"),
        F.sum("band_tokens").over(every).alias("all_tokens"),
    )
    within = Window.partitionBy("band").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(bands, "band").select(
        "n_tokens",
        "n_docs",
        (F.col("docs_above") + F.coalesce(F.sum("n_docs").over(within), F.lit(0))).alias("docs_longer"),
        (F.col("tokens_above") + F.coalesce(F.sum(tokens).over(within), F.lit(0))).alias("tokens_longer"),
        "all_docs",
        "all_tokens",
    )
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_longer",
        "tokens_longer",
        (F.col("all_docs") - F.col("docs_longer")).alias("docs_upto"),
        (F.col("all_tokens") - F.col("tokens_longer")).alias("tokens_upto"),
        (F.col("all_tokens") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")).alias("truncated_total"),
        F.when(F.col("all_docs") > 0, (F.col("all_docs") - F.col("docs_longer")) / F.col("all_docs")).alias("quantile"),
    )


def length_quantiles(table: DataFrame, shares: Sequence[float]) -> DataFrame:
    """Rows (share, n_tokens): the least length that this share of all documents does not exceed.

    From the rows of `length_table`. Without documents lengths are null.
    """
    least = [F.min(F.when((F.col("n_docs") > 0) & (F.col("quantile") >= p), F.col("n_tokens"))) for p in shares]
    each = F.array(*(F.struct(F.lit(float(p)).alias("share"), x.alias("n_tokens")) for p, x in zip(shares, least, strict=True)))
    return table.agg(each.alias("each")).select(F.inline("each"))
