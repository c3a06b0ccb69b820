"""Importance resampling towards a target: Gumbel top-k draws by hashed n-gram weights, with ranks.

A bucket of hashed features gains by how much more frequent it is in the target than
in the corpus; a document's weight is the mean gain of its features, and adding
Gumbel noise to the weights makes the highest scores a draw without replacement.
Counts and gains are arrays of one number for each bucket.

The draw is an external merge sort that stops: tasks write sorted runs of the
documents that can be drawn, and ranges of ranks are merged from them by tournament
trees. An exact histogram of the scores gives the cut and where each range's ranks
begin. What lies below the cut is neither sorted nor shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby, islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymesh.llm.text import alnum_words, as_bytes
from waymesh.session import materialize, shuffle_partitions

#: Rows of a sorted run, ranks of a range at least, records of a block and copies that leave a task as one row.
RUN_ROWS, RANGE_ROWS, BLOCK, SLICE = 1 << 18, 1 << 13, 128, 4096
#: What the draw carries of a document; rows that agree in all are one record with a count.
RECORD = ("negative_score", "no_id", "doc_id", "text_key", "n_words", "n_features", "weight", "copies")
SCORED = "doc_id long, text_key long, n_words long, n_features long, weight long, score long"


@dataclass(frozen=True)
class Settings:
    """buckets: of hashed features. least_words: that a document needs to be drawn. percent: of those to draw. seed: of the noise."""

    buckets: int = 10_000
    least_words: int = 20
    percent: int = 25
    seed: int = 7


def feature_buckets(data: bytes, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features that end with them) of a text, some words at a time."""
    before = None
    for words in alnum_words(data):
        if not words:
            continue
        hashes = list(map(crc32, words))
        # the hash of "a b" goes on from that of "a"
        pairs = [crc32(w, crc32(b" ", h)) for w, h in zip(words[1:], hashes, strict=False)]
        if before is not None:
            pairs.append(crc32(words[0], crc32(b" ", before)))
        before = hashes[-1]
        yield len(words), np.array(hashes + pairs, np.int64) % buckets


def bucket_counts(docs: DataFrame, s: Settings = Settings()) -> np.ndarray:
    """How many features of all whole texts fall into each bucket; tasks add up their own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(s.buckets, np.int64)
        for batch in batches:
            for data in as_bytes(batch.column(0)):
                for _, found in feature_buckets(data or b"", s.buckets):
                    total += np.bincount(found, minlength=s.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    counts = np.zeros(s.buckets, np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():  # one row for a bucket at most
        counts[bucket] = n
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the smoothed log ratio of a bucket's shares, rounded down."""
    k = float(len(corpus))
    in_corpus, in_target = float(corpus.sum()) + k, float(target.sum()) + k
    ratios = ((float(t) + 1) * in_corpus / ((float(s) + 1) * in_target) for s, t in zip(corpus.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Thousandths of a Gumbel variate for a doc_id, rounded down; a null one counts as an empty string."""
    h = int.from_bytes(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:4], "big")
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, s: Settings = Settings()) -> DataFrame:
    """Rows of SCORED, one for each row of `docs`; text_key tells texts of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column(0).to_pylist(), as_bytes(batch.column(2)), strict=True):
                n = features = total = 0
                for words, found in feature_buckets(data or b"", s.buckets):
                    n, features, total = n + words, features + len(found), total + int(gain[found].sum())
                weight = total // features if features else 0
                rows.append((n, features, weight, weight + noise(doc_id, s.seed)))
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * 4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=[c.split()[0] for c in SCORED.split(", ")])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key(text).alias("text_key"), text.alias("text")).mapInArrow(run, SCORED)


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


class Tournament:
    """A winner tree over sorted sequences that may join while others are merged."""

    def __init__(self):
        self.size, self.heads, self.rest, self.free = 1, [None], [iter(())], [0]
        self.tree = [0, 0]

    def add(self, sequence: Iterator) -> None:
        if not self.free:
            self.free = list(range(self.size, 2 * self.size))
            self.heads += [None] * self.size
            self.rest += [iter(())] * self.size
            self.size *= 2
            self.tree = [0] * self.size + list(range(self.size))
            for node in range(self.size - 1, 0, -1):
                self.tree[node] = self._better(node)
        slot = self.free.pop()
        self.rest[slot] = sequence
        self._next(slot)

    def least(self):
        """The first head, None when all sequences have ended."""
        return self.heads[self.tree[1]]

    def pop(self):
        slot = self.tree[1]
        head = self.heads[slot]
        self._next(slot)
        return head

    def _better(self, node: int) -> int:
        a, b = self.tree[2 * node], self.tree[2 * node + 1]
        x, y = self.heads[a], self.heads[b]
        return a if y is None or (x is not None and x <= y) else b

    def _next(self, slot: int) -> None:
        """The next item of a slot plays the matches up to the root."""
        self.heads[slot] = next(self.rest[slot], None)
        if self.heads[slot] is None:
            self.free.append(slot)
        node = (self.size + slot) // 2
        while node:
            self.tree[node] = self._better(node)
            node //= 2


def merged(blocks: Iterable[list[tuple]]) -> Iterator[tuple]:
    """All records in order, from sorted blocks that come in the order of their first records.

    A block joins the tournament when its first record is due, so that only blocks
    around the current one are held, about one for a run.
    """
    tree = Tournament()
    for block in blocks:
        while (head := tree.least()) is not None and head < block[0]:
            yield tree.pop()
        tree.add(iter(block))
    while tree.least() is not None:
        yield tree.pop()


class Plan:
    """Where the ranks of each score begin, and ranges of scores down to the cut.

    A range has about as many ranks as make one for each shuffle partition, and
    `range_rows` at least.
    """

    def __init__(self, counts: list[tuple[int, int]], percent: int, range_rows: int, partitions: int):
        counts = sorted(counts, reverse=True)
        n = np.array([c for _, c in counts], np.int64)
        before = np.cumsum(n) - n
        self.draw = int(n.sum()) * percent // 100
        some = before < self.draw
        self.scores = np.array([x for x, _ in counts], np.int64)[some][::-1]  # ascending
        before = before[some]
        range_rows = max(range_rows, -(-self.draw // partitions))
        ranges, first = np.unique(before // range_rows, return_index=True)
        self.n_ranges = len(ranges)
        self.starts = before[first]
        self.ranges = (np.cumsum(np.isin(np.arange(len(before)), first)) - 1)[::-1]


def sorted_runs(candidates: DataFrame, plan: Plan, run_rows: int = RUN_ROWS) -> DataFrame:
    """Rows (range, first record's key, run, block, data) of the sorted runs of each partition, cut at ranges and into blocks."""

    def blocks(batches: list[pa.RecordBatch], run: int) -> Iterator[tuple]:
        rows = pa.Table.from_batches(batches)
        ids = rows["doc_id"]
        wide = [ids.fill_null(0), rows["text_key"], rows["n_words"], rows["n_features"], rows["weight"]]
        wide = [-rows["score"].to_numpy(), ids.is_null().to_numpy().astype(np.int64), *(c.to_numpy() for c in wide)]
        wide = np.stack(wide, axis=1)[np.lexsort(wide[::-1])]
        first = np.flatnonzero(np.append(True, (wide[1:] != wide[:-1]).any(axis=1)))
        records = np.column_stack([wide[first], np.diff(np.append(first, len(wide)))]).astype("<i8")
        at = plan.ranges[np.searchsorted(plan.scores, -records[:, 0])]
        edges = np.flatnonzero(np.diff(at)) + 1
        for part in np.split(np.arange(len(records)), edges):
            for k in range(0, len(part), BLOCK):
                piece = records[part[k : k + BLOCK]]
                yield (int(at[part[k]]), *(int(x) for x in piece[0, :3]), run, int(part[k]), piece.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, runs = TaskContext.get().partitionId(), [], 0

        def out() -> pa.RecordBatch:
            columns = zip(*blocks(held, (part << 20) + runs), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= run_rows:
                yield out()
                held, runs = [], runs + 1
        if held:
            yield out()

    kinds = [pa.int32(), *([pa.int64()] * 5), pa.binary()]
    names = ["range", *RECORD[:3], "run", "block", "data"]
    return candidates.mapInArrow(run, "range int, negative_score long, no_id long, doc_id long, run long, block long, data binary")


def merge_ranges(runs: DataFrame, plan: Plan) -> DataFrame:
    """Rows of SCORED with their ranks, null beyond the draw, from the sorted runs of all partitions.

    Spark deals the blocks by range and puts them in the order of their first records,
    on disk where memory does not suffice; a task merges the runs of a range block by
    block, so what it holds does not depend on how many rows share a score.
    """
    starts, draw, width = plan.starts, plan.draw, len(RECORD)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        rows = ((x[0].as_py(), x[1].as_py()) for b in batches for x in zip(b.column("range"), b.column("data"), strict=True))
        for at, group in groupby(rows, key=lambda x: x[0]):
            rank = int(starts[at])
            for record in merged(list(map(tuple, np.frombuffer(data, "<i8").reshape(-1, width).tolist())) for _, data in group):
                negative, no_id, doc_id, *others, copies = record
                drawn = max(0, min(copies, draw - rank))
                for first, n in ((rank + 1, drawn), (None, copies - drawn)):
                    for k in range(0, n, SLICE):
                        yield None if no_id else doc_id, *others, -negative, first and first + k, min(SLICE, n - k)
                rank += copies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = found(batches)
        while some := list(islice(rows, 8192)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*some, strict=True)], names=names)

    names = [*(c.split()[0] for c in SCORED.split(", ")), "first", "n"]
    dealt = runs.repartition(max(1, plan.n_ranges), "range").sortWithinPartitions("range", *RECORD[:3], "run", "block").select("range", "data")
    ranked = dealt.mapInArrow(run, f"{SCORED}, first long, n long")
    # copies of one record take ranks in a row
    ranked = ranked.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return ranked.select(*names[:-2], (F.col("first") + F.col("_k")).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, s: Settings = Settings(), run_rows: int = RUN_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows (doc_id, text_key, n_words, n_features, weight, score, rank), one for each row of `docs`.

    Exactly `percent` of a hundred of the documents with `least_words` are drawn, by
    score and then the smaller doc_id (null ids last, then the smaller text_key); others
    have a null rank. A null text has no words, and a document without features weighs
    0. Rows that repeat a doc_id have the same noise and are drawn each by itself, with
    ranks of their own; equal rows take ranks in a row. An empty target or table gives
    gains of smoothing alone. Extra columns of both tables are dropped.

    Scores are whole numbers within [-91000, 110000]: a log ratio of counts below 2^63
    is within 88 and the noise of 32 bits within (-4, 23). So the histogram of the
    scores that comes to the driver has at most about 200,000 rows, whatever the corpus.
    """
    found = materialize(scored(docs, gains(bucket_counts(docs, s), bucket_counts(target, s)), s))
    able = F.col("n_words") >= s.least_words
    plan = Plan([tuple(r) for r in found.where(able).groupBy("score").count().collect()], s.percent, range_rows, shuffle_partitions(docs.sparkSession))
    if not plan.draw:
        return found.withColumn("rank", F.lit(None).cast("long"))
    due = able & (F.col("score") >= int(plan.scores[0]))
    ranked = merge_ranges(sorted_runs(found.where(due), plan, run_rows), plan)
    return ranked.unionByName(found.where(~due).withColumn("rank", F.lit(None).cast("long")))


def drawn(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    """`rank` and the columns of `docs`, one row for each rank of `ranks`, as `resample` gave them for `docs`.

    Rows with the same doc_id and text stand for each other: each of their ranks gets
    the columns of one of them.
    """
    key = [F.col("doc_id").cast("long").alias("_id"), _text_key(F.col("text").cast("string")).alias("_key")]
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *key)
    chosen = ranks.where(F.col("rank").isNotNull()).select(F.col("doc_id").alias("_i"), F.col("text_key").alias("_k"), "rank")
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k"))
    once = rows.join(chosen.select("_i", "_k").distinct(), same, "left_semi").dropDuplicates(["_id", "_key"])
    out = chosen.join(once, same).select("rank", "_row")
    return out.select("rank", *(F.col("_row").getField(c).alias(c) for c in docs.columns if c != "rank"))
