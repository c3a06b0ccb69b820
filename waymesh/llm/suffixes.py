"""Removal of byte strings that an earlier document has, by two-stage suffix sorting.

Repeats of `length` bytes are found in four steps, each a shuffle by key:

1. Documents are dealt to blocks. In each window of `length` bytes the smallest hash
   of its half-length grams is the window's anchor, so equal windows have equal
   anchors. Blocks send their anchors to buckets.
2. Buckets find the anchors that several documents have and send those back.
3. Blocks send the text around shared anchors, each different piece once with its
   smallest doc_id, to the anchors' buckets. A bucket sorts the suffixes of its pieces
   in two stages: only suffixes smaller than their successors are sorted directly,
   the others are induced from them by scanning the buckets of first bytes. Adjacent
   suffixes whose common prefix is long enough are equal windows; the smallest doc_id
   of each class tells which windows an earlier document has.
4. Blocks get back one bit for each window and cut the covered bytes.

Blocks and buckets are as many as the text needs, so that each holds about
BLOCK_BYTES of text or of pieces, and a task takes them one after the other. A
passage that very many documents share is one piece for each block. The windows of
an anchor that very many different surroundings have go to buckets by their own
hashes, so that no bucket gets more of them than it gets equal windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.session import shuffle_partitions

#: Bytes of text of a block and of a partition of blocks, and windows scanned at once.
BLOCK_BYTES, PARTITION_BYTES, PIECE = 8 << 20, 32 << 20, 1 << 15
#: A piece of text has so many windows at most.
LONGEST_RUN = 1 << 12
#: Bits of an anchor's hash that travel besides its bucket.
KEY_BITS = 38
#: An anchor is common if so many blocks have it, or a block so many times.
COMMON_BLOCKS, COMMON_RUNS = 256, 1024
#: Stands for a null doc_id, which no other one follows.
LAST_ID = (1 << 63) - 1
#: An odd number whose powers weigh the bytes of a gram.
BASE = 0x9E3779B97F4A7C15


@cache
def _weights(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, and n powers of BASE and of its inverse modulo 2^64, from the first on."""
    values = np.random.default_rng(50).integers(0, 1 << 64, 256, np.uint64)
    powers, inverse = (np.cumprod(np.full(n, x, np.uint64)) for x in (BASE, pow(BASE, -1, 1 << 64)))
    return values, powers, inverse


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k bytes, from differences of weighted prefix sums."""
    values, powers, inverse = _weights(1 << max(16, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers[: len(data)], out=sums[1:])
    out = sums[k:] - sums[:-k]
    out *= inverse[: len(out)]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xE7037ED1A0B428DB)
    out ^= out >> np.uint64(29)
    return out


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _inside(bounds: np.ndarray, length: int) -> np.ndarray:
    """For each byte whether the window that starts there ends in the same document."""
    n = int(bounds[-1])
    change = np.zeros(n + 1, np.int8)
    np.add.at(change, np.maximum(bounds[:-1], bounds[1:] - length + 1), 1)
    np.add.at(change, bounds[1:], -1)
    return np.cumsum(change[:n], dtype=np.int8) == 0


def anchor_runs(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor hash) of runs of windows with one anchor.

    bounds: where each document begins, and the end. Windows lie within a document.
    """
    k, inside = length // 2, _inside(bounds, length)
    lows, highs, anchors = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for a in range(0, len(data) - length + 1, PIECE):
        least = sliding_least(gram_hashes(data[a : a + PIECE + length - 1], k), length - k + 1)
        own = inside[a : a + len(least)]
        cut = np.ones(len(least), bool)
        # documents are at least one window without an inside apart
        cut[1:] = (least[1:] != least[:-1]) | (own[1:] != own[:-1])
        cut[::LONGEST_RUN] = True
        low = np.flatnonzero(cut)
        high = np.append(low[1:], len(least)) - 1
        some = own[low]
        lows.append(low[some] + a)
        highs.append(high[some] + a)
        anchors.append(least[low[some]])
    return np.concatenate(lows), np.concatenate(highs), np.concatenate(anchors)


def _pack(keys: np.ndarray) -> bytes:
    """Numbers below 2^40 as five bytes each."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a column of binary values without nulls."""
    values = pa.chunked_array(column.chunks, pa.large_binary()).combine_chunks()
    values = pa.concat_arrays(values.chunks) if isinstance(values, pa.ChunkedArray) else values
    if not len(values):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = values.buffers()
    bounds = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


class Block:
    """The documents of a block in doc_id order as one buffer, and its runs of windows."""

    def __init__(self, rows: pa.Table, length: int, buckets: int):
        rows = pa.table({"doc_id": rows["doc_id"].fill_null(LAST_ID), "text": rows["text"].cast(pa.large_binary())})
        rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids = rows["doc_id"].to_numpy()
        self.bytes, self.bounds = _flat(rows["text"])
        self.length, self.buckets = length, buckets
        self.low, self.high, anchor = anchor_runs(self.bytes, self.bounds, length)
        self.doc = np.searchsorted(self.bounds, self.low, "right") - 1
        self.bucket = (anchor % np.uint64(buckets)).astype(np.int64)
        self.key = anchor >> np.uint64(64 - KEY_BITS)

    def joint_key(self) -> np.ndarray:
        return (self.bucket.astype(np.uint64) << np.uint64(KEY_BITS)) | self.key

    def anchors(self, common_runs: int) -> Iterator[tuple[int, bytes]]:
        """For each bucket its anchors, each once; the lowest bits say that several documents and that very many runs have it."""
        joint = self.joint_key()
        order = np.argsort(joint)
        joint, doc = joint[order], self.doc[order]
        at = np.flatnonzero(np.concatenate([[True], joint[1:] != joint[:-1]])) if len(joint) else np.empty(0, np.int64)
        if not len(at):
            return
        several = np.maximum.reduceat(doc, at) != np.minimum.reduceat(doc, at)
        many = np.diff(np.append(at, len(joint))) >= common_runs
        packed = ((joint[at] & np.uint64((1 << KEY_BITS) - 1)) << np.uint64(2)) | (many.astype(np.uint64) << np.uint64(1)) | several.astype(np.uint64)
        yield from _by_bucket((joint[at] >> np.uint64(KEY_BITS)).astype(np.int64), lambda a, b: _pack(packed[a:b]))

    def keep_shared(self, shared: list[tuple[int, bytes]]) -> None:
        """Only runs whose anchor is shared stay, in the order of their buckets; those of common anchors as single windows."""
        parts = [((np.uint64(b) << np.uint64(KEY_BITS + 1)) | _unpack(keys)) for b, keys in shared]
        known = np.sort(np.concatenate(parts)) if parts else np.empty(0, np.uint64)
        joint = self.joint_key()
        at = np.minimum(np.searchsorted(known, joint << np.uint64(1)), max(0, len(known) - 1))
        chosen = np.flatnonzero(known[at] >> np.uint64(1) == joint) if len(known) else np.empty(0, np.int64)
        common = (known[at[chosen]] & np.uint64(1)).astype(bool)
        few, more = chosen[~common], chosen[common]
        low, high, doc, bucket = self.low[few], self.high[few], self.doc[few], self.bucket[few]
        if len(more):
            count = self.high[more] - self.low[more] + 1
            single = _expand(self.low[more], count)
            window = _hash_each(self.bytes, single, np.full(len(single), self.length))
            low, high = np.concatenate([low, single]), np.concatenate([high, single])
            doc, bucket = np.concatenate([doc, np.repeat(self.doc[more], count)]), np.concatenate([bucket, (window % np.uint64(self.buckets)).astype(np.int64)])
        order = np.lexsort([low, bucket])
        self.low, self.high, self.doc, self.bucket = low[order], high[order], doc[order], bucket[order]

    def pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """For each run the number of its piece of text; for each piece the first run that has it."""
        seen: dict[bytes, int] = {}
        number, first, more, data = [], [], self.length, self.bytes.tobytes()
        for r, (a, b) in enumerate(zip(self.low.tolist(), self.high.tolist(), strict=True)):
            k = seen.setdefault(data[a : b + more], len(first))
            if k == len(first):
                first.append(r)
            number.append(k)
        return np.array(number, np.int64), np.array(first, np.int64)


def _hash_each(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The gram hash of each stretch of bytes, a few thousand stretches at a time."""
    out = [np.empty(0, np.uint64)]
    for a in range(0, len(start), 1 << 12):
        own, n = start[a : a + (1 << 12)], size[a : a + (1 << 12)]
        text = data[_expand(own, n)]
        if len(set(n.tolist())) == 1:
            out.append(gram_hashes(text, int(n[0]))[:: int(n[0])])
        else:
            out.append(np.array([gram_hashes(x, len(x))[0] for x in np.split(text, np.cumsum(n)[:-1])], np.uint64))
    return np.concatenate(out)


def _by_bucket(bucket: np.ndarray, make) -> Iterator[tuple]:
    """(bucket, make(a, b)) for each stretch [a, b) of equal buckets."""
    if len(bucket):
        at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        for a, b in zip(at.tolist(), np.append(at[1:], len(bucket)).tolist(), strict=True):
            yield int(bucket[a]), make(a, b)


def suffix_classes(text: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Class of each window (ascending starts): windows of equal `length` bytes share one.

    Two-stage sorting of the suffixes at the windows, as far as their first `length`
    bytes tell them apart.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(length + 16, np.uint8)])
    words = _words(padded)
    # a suffix is of type S if it is smaller than its successor; in a run of equal bytes what follows decides
    small = padded[:n] < padded[1 : n + 1]
    equal = padded[:n] == padded[1 : n + 1]
    if equal.any():
        differs, equal = np.flatnonzero(~equal), np.flatnonzero(equal)
        after = np.searchsorted(differs, equal)
        small[equal] = small[differs[np.minimum(after, max(0, len(differs) - 1))]] & (after < len(differs)) if len(differs) else False
    needed = np.zeros(n + 1, bool)
    needed[windows] = True
    # an induced suffix needs its successor, which may be induced itself
    edge = windows
    while True:
        edge = edge[~small[edge]] + 1
        edge = edge[edge < n]
        edge = edge[~needed[edge]]
        if not len(edge):
            break
        needed[edge] = True
    direct = _sorted_by_bytes(np.flatnonzero(needed[:n] & small), words, length)
    split = np.searchsorted(padded[direct], np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n and needed[n - 1] and not small[n - 1]:
        pending[int(padded[n - 1])].append(np.array([n - 1]))  # its successor is the empty suffix, the smallest
    induced = needed[:n] & ~small
    order = []
    for c in range(256):
        front, scanned = np.concatenate(pending[c]) if pending[c] else np.empty(0, np.int64), []
        while len(front):
            scanned.append(front)
            back = front - 1
            back = back[(back >= 0)]
            front = back[induced[back] & (padded[back] == c)]
        scanned.append(direct[split[c] : split[c + 1]])
        here = np.concatenate(scanned)
        order.append(here)
        back = here - 1
        back = back[back >= 0]
        back = back[induced[back] & (padded[back] > c)]
        if len(back):
            back = back[np.argsort(padded[back], kind="stable")]
            byte = padded[back]
            cut = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
            for a, b in zip(cut.tolist(), np.append(cut[1:], len(back)).tolist(), strict=True):
                pending[int(byte[a])].append(back[a:b])
    ranked = np.concatenate(order)
    wanted = np.zeros(n + 1, bool)
    wanted[windows] = True
    ranked = ranked[wanted[ranked]]
    classes = np.empty(n + 1, np.int64)
    classes[ranked] = np.cumsum(common_prefixes(ranked, words, length) < length)
    return classes[windows]


def _words(padded: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a big-endian number."""
    x = padded.astype(np.uint64)
    for size in (1, 2, 4):
        x = (x[:-size] << np.uint64(8 * size)) | x[size:]
    return x


def _sorted_by_bytes(at: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """The places sorted by the `length` bytes there: by the first eight, then ties by the next eight."""
    if not len(at):
        return at
    key = words[at]
    order = np.argsort(key)
    at, key = at[order], key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    for k in range(8, length, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        tied = np.flatnonzero(tied)
        if not len(tied):
            break
        key = words[at[tied] + k] >> np.uint64(8 * max(0, k + 8 - length))
        first = np.argsort(key)
        # by group, and within it in the order of the keys
        group = np.sort((np.cumsum(new)[tied[first]].astype(np.uint64) << np.uint64(32)) | np.arange(len(first), dtype=np.uint64))
        order = first[(group & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        at[tied], key = at[tied][order], key[order]
        new[tied[1:]] |= key[1:] != key[:-1]
    return at


def common_prefixes(ranked: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """How many bytes, `length` at most, each suffix shares with the one ranked before it; the first has none."""
    out = np.zeros(len(ranked), np.int64)
    left = np.arange(1, len(ranked))
    for k in range(0, length, 8):
        differ = words[ranked[left] + k] ^ words[ranked[left - 1] + k]
        out[left] = k + _leading_zero_bytes(differ)
        left = left[differ == 0]
    return np.minimum(out, length)


def _leading_zero_bytes(x: np.ndarray) -> np.ndarray:
    return sum(((x >> np.uint64(8 * k)) == 0).astype(np.int64) for k in range(8))


def _expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... count[i] numbers each, one after the other."""
    total = np.cumsum(count)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(first - (total - count), count)


def _block_anchors(length: int, buckets: int, common_runs: int = COMMON_RUNS):
    def run(rows: pa.Table) -> pa.Table:
        found = list(Block(rows, length, buckets).anchors(common_runs))
        block = rows["block"][0].as_py()
        return pa.table({"block": pa.array([block] * len(found), pa.int32()), "bucket": pa.array([b for b, _ in found], pa.int32()), "keys": pa.array([x for _, x in found], pa.binary())})

    return run


def _shared_anchors(common_blocks: int = COMMON_BLOCKS):
    def run(rows: pa.Table) -> pa.Table:
        """Of a bucket's anchors, for each block those that several documents or blocks have, and whether they are common."""
        lists = [_unpack(x) for x in rows["keys"].to_pylist()]
        every = np.concatenate(lists)
        order = np.argsort(every)
        every = every[order]
        key = every >> np.uint64(2)
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        blocks = np.diff(np.append(at, len(key)))
        bits = np.bitwise_or.reduceat(every, at)
        shared = (blocks > 1) | ((bits & np.uint64(1)) > 0)
        common = (blocks >= common_blocks) | ((bits & np.uint64(2)) > 0)
        # 0: of one document, else the key with a bit for common ones, back in the order of the lists
        told = np.repeat(np.where(shared, ((key[at] << np.uint64(1)) | common) + np.uint64(1), np.uint64(0)), blocks)
        back = np.empty(len(told), np.uint64)
        back[order] = told
        out = np.split(back, np.cumsum([len(x) for x in lists])[:-1])
        out = [x[x > 0] - np.uint64(1) for x in out]
        some = pa.array([k for k, x in enumerate(out) if len(x)], pa.int64())
        return pa.table({**{c: rows[c].combine_chunks().take(some) for c in ("block", "bucket")}, "keys": pa.array([_pack(x) for x in out if len(x)], pa.binary())})

    return run


def _block_pieces(length: int, buckets: int):
    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        columns: dict[str, list] = {"block": [], "bucket": [], "keys": [], "text": [], "sizes": [], "ids": []}
        if docs.num_rows and shared.num_rows:
            block, keys = Block(docs, length, buckets), dict(zip(shared["bucket"].to_pylist(), shared["keys"].to_pylist(), strict=True))
            block.keep_shared(list(keys.items()))
            _, first = block.pieces()
            low, size = block.low[first], block.high[first] - block.low[first] + length
            ids = block.ids[block.doc[first]]
            number, places = docs["block"][0].as_py(), dict(_by_bucket(block.bucket[first], lambda a, b: (a, b)))
            # a bucket whose anchors are all common gets its keys back without pieces
            for bucket in sorted(keys.keys() | places.keys()):
                a, b = places.get(bucket, (0, 0))
                columns["block"].append(number)
                columns["bucket"].append(bucket)
                columns["keys"].append(keys.get(bucket, b""))
                columns["text"].append(block.bytes[_expand(low[a:b], size[a:b])].tobytes())
                columns["sizes"].append(size[a:b].astype("<u4").tobytes())
                columns["ids"].append(ids[a:b].astype("<i8").tobytes())
        return pa.table({k: pa.array(v, pa.int32() if k in ("block", "bucket") else pa.binary()) for k, v in columns.items()})

    return run


def _bucket_bits(length: int):
    def run(rows: pa.Table) -> pa.Table:
        """One bit for each window of each block's pieces: whether a smaller doc_id has it."""
        seen: dict[bytes, int] = {}
        least: list[int] = []
        numbers, own_ids = [], []
        for text, sizes, ids in zip(rows["text"].to_pylist(), rows["sizes"].to_pylist(), rows["ids"].to_pylist(), strict=True):
            ends = np.cumsum(np.frombuffer(sizes, "<u4").astype(np.int64))
            ids = np.frombuffer(ids, "<i8")
            number, a = [], 0
            for b, doc in zip(ends.tolist(), ids.tolist(), strict=True):
                piece = text[a:b]
                k = seen.get(piece)
                if k is None:
                    k = seen[piece] = len(least)
                    least.append(doc)
                elif doc < least[k]:
                    least[k] = doc
                number.append(k)
                a = b
            numbers.append(np.array(number, np.int64))
            own_ids.append(ids)
        size = np.fromiter(map(len, seen), np.int64, len(seen))
        start, count = np.cumsum(size) - size, size - length + 1
        first = np.cumsum(count) - count
        windows = _expand(start, count)
        classes = suffix_classes(np.frombuffer(b"".join(seen), np.uint8), windows, length)
        earliest = np.full(int(classes.max()) + 1 if len(classes) else 0, LAST_ID)
        np.minimum.at(earliest, classes, np.repeat(np.array(least, np.int64), count))
        earliest = earliest[classes]
        bits = []
        for number, ids in zip(numbers, own_ids, strict=True):
            bits.append(np.packbits(earliest[_expand(first[number], count[number])] < np.repeat(ids, count[number])).tobytes())
        return pa.table({"block": rows["block"], "bucket": rows["bucket"], "keys": rows["keys"], "bits": pa.array(bits, pa.binary())})

    return run


def _block_cut(length: int, buckets: int):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        block = Block(docs, length, buckets)
        n, bounds = len(block.bytes), block.bounds
        gone = np.zeros(n + 1, bool)
        if found.num_rows:
            by_bucket = dict(zip(found["bucket"].to_pylist(), zip(found["keys"].to_pylist(), found["bits"].to_pylist(), strict=True), strict=True))
            block.keep_shared([(b, keys) for b, (keys, _) in by_bucket.items() if keys])
            number, first = block.pieces()
            count = block.high[first] - block.low[first] + 1
            bits = [np.unpackbits(np.frombuffer(by_bucket[b][1], np.uint8))[:total].astype(bool) for b, total in _by_bucket(block.bucket[first], lambda a, b: int(count[a:b].sum()))]
            bits = np.concatenate(bits) if bits else np.empty(0, bool)
            at = np.cumsum(count) - count
            # a piece that a smaller doc_id of the block has is covered; else the bits of its first run tell
            known = block.ids[block.doc] > block.ids[block.doc[first[number]]]
            count = count[number]
            covered = np.repeat(known, count) | bits[_expand(at[number], count)]
            mark = np.zeros(n + 1, bool)
            mark[_expand(block.low, count)[covered]] = True
            start = np.flatnonzero(mark)
            # first and last window of each stretch of windows that touch or overlap
            if len(start):
                gap, change = np.flatnonzero(np.diff(start) > length), np.zeros(n + 1, np.int8)
                change[start[np.concatenate([[0], gap + 1])]] += 1
                change[start[np.concatenate([gap, [len(start) - 1]])] + length] -= 1
                gone = np.cumsum(change, dtype=np.int8) > 0
        # windows never reach over a document's end, but stretches of neighbours may touch there
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        firsts = bounds[:-1][bounds[:-1] < bounds[1:]]
        begins[firsts] = gone[firsts]
        spans, removed = (np.concatenate([[0], np.cumsum(x[:n])])[bounds] for x in (begins, gone))
        kept = block.bytes[~gone[:n]]
        offsets = bounds - removed
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(block.ids), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(kept)])
        ids = pa.array(block.ids, mask=block.ids == LAST_ID)
        return pa.table({"doc_id": ids, "n_bytes": np.diff(bounds), "n_removed": np.diff(removed), "n_spans": np.diff(spans), "kept": texts.cast(pa.binary())})

    return run


def remove_repeats(docs: DataFrame, length: int = 50, block_bytes: int = BLOCK_BYTES, common_blocks: int = COMMON_BLOCKS, common_runs: int = COMMON_RUNS) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept), one for each row of `docs`.

    Texts are UTF-8 bytes (null: empty). Each byte is removed that a string of
    `length` bytes covers which also starts in a document with a smaller doc_id;
    overlaps count, repeats within a document do not, and strings are judged on the
    input. kept: the other bytes, n_spans: maximal removed runs. A null doc_id comes
    after all others; rows of one doc_id remove nothing from each other. Texts
    shorter than `length` stay whole. Extra columns are dropped.

    Blocks have about `block_bytes` of text, a longer text is a block of its own.
    What blocks send to buckets and back is packed to one row for a block and bucket,
    which are never more than the anchors.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    least = shuffle_partitions(docs.sparkSession)
    blocks, parts = max(least, -(-total // block_bytes)), max(least, -(-total // PARTITION_BYTES))
    rows = docs.select(F.pmod(F.xxhash64("doc_id", F.xxhash64(text)), F.lit(blocks)).cast("int").alias("block"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.repartition(parts, "block")
    anchors = rows.groupBy("block").applyInArrow(_block_anchors(length, blocks, common_runs), "block int, bucket int, keys binary").repartition(parts, "bucket")
    shared = anchors.groupBy("bucket").applyInArrow(_shared_anchors(common_blocks), "block int, bucket int, keys binary").repartition(parts, "block")
    pieces = rows.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_block_pieces(length, blocks), "block int, bucket int, keys binary, text binary, sizes binary, ids binary")
    bits = pieces.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_bucket_bits(length), "block int, bucket int, keys binary, bits binary").repartition(parts, "block")
    return rows.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(_block_cut(length, blocks), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
