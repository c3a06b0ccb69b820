"""Packing tokenized documents and conversations into sequences: vector bin packing by dot products.

Each partition packs its own items, so that no text is shuffled for it. A bin has
several limits at once (tokens, segments, loss-bearing tokens). Of the items that
fit, the one goes in whose demand has the largest dot product with what the bin has
left (Panigrahy et al. 2011), so that items which use up scarce room meet bins that
have it. Where cutting is allowed, the gap that no whole item fits is filled with a
prefix of the largest one.

Documents bear loss on every id. In instruction data only answers do: conversations
are counted turn by turn, and what is packed are their counts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.llm.text import as_bytes
from waymesh.llm.tokens import WORD_BPE, chunk_encoder

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Items that wait for a bin at once, and how few of them call for more.
POOL, LOW = 1024, 512


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most. Documents bear loss on every id but the end mark."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


@dataclass
class Item:
    """The part of a document from id `start` on that is still to be placed."""

    doc_id: int | None
    ids: bytes
    start: int
    tokens: int
    loss: int
    total: int

    def cut(self, tokens: int) -> tuple[Item, Item]:
        """The first `tokens` ids and the rest; the ids that bear loss come first."""
        head = min(self.loss, tokens)
        return (
            Item(self.doc_id, self.ids, self.start, tokens, head, self.total),
            Item(self.doc_id, self.ids, self.start + tokens, self.tokens - tokens, self.loss - head, self.total),
        )


class Packer:
    """Bins for a stream of items; what it holds is bounded by the pool and one document."""

    def __init__(self, limits: Limits, cut: bool):
        self.limits, self.cut = limits, cut
        self.most = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.pool: list[Item] = []

    def add(self, item: Item) -> Iterator[list[Item]]:
        full = min(self.limits.tokens, self.limits.loss)
        while self.cut and item.tokens >= full:
            head, item = item.cut(full)
            yield from self._closed([head])
        if item.tokens:
            self.pool.append(item)
        if len(self.pool) >= POOL:
            yield from self.bins(LOW)

    def bins(self, down_to: int = 0) -> Iterator[list[Item]]:
        while len(self.pool) > down_to:
            size = np.array([[x.tokens, 1, x.loss] for x in self.pool], float)
            demand, alive = size / self.most, np.ones(len(size), bool)
            while alive.sum() > down_to:
                left, chosen = self.most.copy(), []
                while True:
                    fits = alive & (size <= left).all(1)
                    if not fits.any():
                        break
                    best = int(np.where(fits, demand @ (left / self.most), -1).argmax())
                    chosen.append(self.pool[best])
                    alive[best] = False
                    left -= size[best]
                gap = int(min(left[0], left[2]))
                if self.cut and gap and left[1] >= 1 and alive.any():
                    largest = int(np.where(alive, size[:, 0], -1).argmax())
                    head, self.pool[largest] = self.pool[largest].cut(gap)
                    size[largest] = [self.pool[largest].tokens, 1, self.pool[largest].loss]
                    demand[largest] = size[largest] / self.most
                    chosen.append(head)
                again: list[Item] = []
                for sequence in self._closed(chosen, again):
                    yield sequence
                if again:  # a bin that could not be filled gave back its tail
                    self.pool = [x for x, y in zip(self.pool, alive, strict=True) if y] + again
                    break
            else:
                self.pool = [x for x, y in zip(self.pool, alive, strict=True) if y]

    def _closed(self, chosen: list[Item], again: list[Item] | None = None) -> Iterator[list[Item]]:
        """The bin as a sequence; if it is short and may be cut, its first power of two of ids."""
        used = sum(x.tokens for x in chosen)
        if not self.cut or used == self.limits.tokens or used & (used - 1) == 0 or again is None:
            yield chosen
            return
        room, kept = 1 << (used.bit_length() - 1), []
        for x in chosen:
            if room == 0:
                again.append(x)
            elif x.tokens > room:
                head, rest = x.cut(room)
                kept.append(head)
                again.append(rest)
                room = 0
            else:
                kept.append(x)
                room -= x.tokens
        yield kept


def fits(tokens: int, loss: int, limits: Limits) -> bool:
    return tokens <= limits.tokens and loss <= limits.loss and limits.segments > 0


def pack_documents(docs: DataFrame, limits: Limits = Limits(), cut: bool = True, tokenizer: str = WORD_BPE, end_id: int = 1) -> DataFrame:
    """Rows (doc_id, start, length, ids, doc_tokens, sequence_id, offset): the pieces of every sequence.

    A document's ids are those of its text (none for a null or empty one) and then
    `end_id`. `ids` has the piece's ids as little-endian unsigned 32-bit numbers.
    With `cut`, a piece may be any run of a document's ids, and a sequence that
    cannot be filled ends at a power of two; without it, documents stay whole and one
    that exceeds a limit by itself has no sequence (null sequence_id, offset 0).
    Repeated rows are packed each; extra columns are dropped. No rows give no pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = chunk_encoder(tokenizer), end_id.to_bytes(4, "little")
        number = itertools.count((TaskContext.get().partitionId() if TaskContext.get() else 0) << 33)
        packer = Packer(limits, cut)
        rows: list[tuple] = []

        def take(sequences: Iterator[list[Item]]) -> None:
            for pieces in sequences:
                sequence, offset = next(number), 0
                for x in pieces:
                    rows.append((x.doc_id, x.start, x.tokens, x.ids[4 * x.start : 4 * (x.start + x.tokens)], x.total, sequence, offset))
                    offset += x.tokens

        def flush() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * 7
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            rows.clear()
            return out

        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                ids = encode(data or b"") + end
                n = len(ids) // 4
                if cut or fits(n, n - 1, limits):
                    take(packer.add(Item(doc_id, ids, 0, n, n - 1, n)))
                else:
                    rows.append((doc_id, 0, n, ids, n, None, 0))
                if len(rows) >= 4096:
                    yield flush()
        take(packer.bins())
        yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def conversation_sizes(turns: DataFrame, loss_roles: Sequence[str] = ("assistant",), tokenizer: str = WORD_BPE) -> DataFrame:
    """Rows (conv_id, tokens, loss) for rows (conv_id, turn, role, text): ids of a conversation and those that bear loss.

    A turn's ids are those of its text and one end mark; turns of `loss_roles` bear
    loss on all of them. Turns are counted where they are read and added up for each
    conversation, so that one of any length is a row. Repeated turns count each, a null
    text has the end mark alone, a null role bears no loss, null ids are one conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = chunk_encoder(tokenizer)
        for batch in batches:
            n = [len(encode(data or b"")) // 4 + 1 for data in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(2)], names=["conv_id", "tokens", "answer"])

    answer = F.coalesce(F.col("role").isin(*loss_roles), F.lit(False))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("text").cast("string").alias("text"), answer.alias("answer"))
    counted = rows.mapInArrow(run, "conv_id long, tokens long, answer boolean")
    return counted.groupBy("conv_id").agg(F.sum("tokens").alias("tokens"), F.sum(F.when(F.col("answer"), F.col("tokens")).otherwise(0)).alias("loss"))


def pack_sizes(sizes: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Rows (conv_id, tokens, loss, sequence_id, offset) for rows (conv_id, tokens, loss), each in one sequence.

    A conversation that exceeds a limit by itself has no sequence (null sequence_id,
    offset 0), so that no row is lost and none breaks a limit; nor has one without
    tokens, which takes no room. A null count is 0, rows that repeat a conv_id, null
    ones too, are packed each, extra columns are dropped and no rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = itertools.count((TaskContext.get().partitionId() if TaskContext.get() else 0) << 33)
        packer, rows = Packer(limits, cut=False), []

        def take(sequences: Iterator[list[Item]]) -> None:
            for pieces in sequences:
                sequence, offset = next(number), 0
                for x in pieces:
                    rows.append((x.doc_id, x.tokens, x.loss, sequence, offset))
                    offset += x.tokens

        def flush() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * 5
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["conv_id", "tokens", "loss", "sequence_id", "offset"])
            rows.clear()
            return out

        for batch in batches:
            for conv_id, tokens, loss in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if tokens and fits(tokens, loss, limits):
                    take(packer.add(Item(conv_id, b"", 0, tokens, loss, tokens)))
                else:
                    rows.append((conv_id, tokens, loss, None, 0))
            yield flush()
        take(packer.bins())
        yield flush()

    counts = (F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in ("tokens", "loss"))
    return sizes.select(F.col("conv_id").cast("long").alias("conv_id"), *counts).mapInArrow(run, "conv_id long, tokens long, loss long, sequence_id long, offset long")
