"""SimHash near-duplicates by a binary trie self-join.

Fingerprints that agree on a key (one quarter of their bits, or one of the
document's smallest shingle hashes) go to one task. There they are a binary trie,
kept as a sorted array in which a node is a range. The self-join walks pairs of
nodes down together, adds up the bits in which the paths differ and drops a pair
once the error budget is exceeded. Each task returns a spanning forest of the
links it has found, never all pairs, and the forests are joined to components by
a distributed fixpoint.

Where a similarity is asked for, these components are only where to look: inside
them, shingle sets are compared exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.llm.text import ASCII_LOWER, as_bytes, whole_groups
from waymesh.plans.components import connected_components
from waymesh.session import materialize, shuffle_partitions

SEED = 42
#: Shingle hashes whose bits are counted at once, which bounds memory for very long texts.
CHUNK = 1 << 15
#: Pairs of trie nodes that one walk holds at most when it starts.
WALK = 1 << 21
#: Pairs of trie nodes that go down together.
AT_ONCE = 1 << 14
#: Below so many pairs of leaves, two nodes are compared leaf by leaf.
LEAVES = 32
#: Rows of a key that meet in one task at most, as the pairs of nodes may grow with their square.
MOST = 1 << 14
#: Smallest shingle hashes that candidates share one of: sets of similarity s share none with a chance of (1 - s) ** MINIMA.
MINIMA = 8
#: Standard deviations by which the fingerprints of a candidate pair may exceed the expected distance.
DEVIATIONS = 6
#: Documents, and shingles, of a chunk of candidates, and how many members stand for what is linked within a chunk.
CHUNK_SETS, CHUNK_SHINGLES, SPEAKERS = 512, 1 << 19, 16


def shingle_hashes(data: bytes, words: int) -> np.ndarray:
    """XXH64 of each run of `words` words of lower-cased text, repeats included."""
    parts = data.translate(ASCII_LOWER).split()
    if not parts:
        return np.empty(0, "<u8")
    text, n = b" ".join(parts), len(parts)
    if n < words:
        return np.array([xxhash.xxh64_intdigest(text, SEED)], "<u8")
    sizes = np.fromiter(map(len, parts), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(text[a:b], SEED) for a, b in zip((ends - sizes).tolist(), ends[words - 1 :].tolist(), strict=False)], "<u8")


def _lane(hashes: np.ndarray, lane: int) -> np.ndarray:
    """The hashes themselves for lane 0, independent mixes of them for the others."""
    if lane == 0:
        return hashes
    mixed = (hashes ^ np.uint64(lane)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(31))


def simhash(hashes: np.ndarray, lanes: int) -> bytes:
    """64 x lanes bits, the highest first: a bit is 1 if it is set in over half of the hashes."""
    out = b""
    for lane in range(lanes):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), CHUNK):
            bits = np.unpackbits(_lane(hashes[at : at + CHUNK], lane).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            counts += bits.sum(0, dtype=np.int64)
        out += np.packbits(counts * 2 > len(hashes)).tobytes()
    return out


def fingerprints(docs: DataFrame, words: int = 5, lanes: int = 1, minima: int = 0) -> DataFrame:
    """Rows (doc_id, fingerprint, minima): the fingerprint as 8 x lanes bytes, highest bit first.

    A null or blank text has fingerprint zero. `minima` holds that many of the
    smallest shingle hashes (fewer if the text has fewer; none for a blank text).
    """
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.binary()), ("minima", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, least = [], []
            for data in as_bytes(batch.column(1)):
                hashes = shingle_hashes(data or b"", words)
                prints.append(simhash(hashes, lanes))
                least.append(np.unique(hashes)[:minima].view(np.int64).tolist() if minima else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary()), pa.array(least, pa.list_(pa.int64()))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint binary, minima array<long>")


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; root points from each leaf to the first leaf of its set."""
    while True:
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            return
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        low = np.minimum(ra, rb)
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(1)


def trie_forest(lanes: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int) -> np.ndarray:
    """First leaf of each leaf's set when leaves of one group that differ in `budget` bits at most are joined.

    lanes: one row of uint64 words for each leaf, ascending and distinct within
    each group [starts[g], ends[g]).
    """
    n, words = lanes.shape
    root = np.arange(n)
    sizes = ends - starts
    keep = sizes > 1
    starts, ends, sizes = starts[keep], ends[keep], sizes[keep]
    cost = np.cumsum(np.minimum(sizes * sizes, WALK))
    for part in np.split(np.arange(len(starts)), np.searchsorted(cost, np.arange(WALK, cost[-1] if len(cost) else 0, WALK))):
        if len(part):
            lo, hi = int(starts[part[0]]), int(ends[part[-1]])
            own = root[lo:hi] - lo
            _walk(lanes[lo:hi], starts[part] - lo, ends[part] - lo, budget, own)
            root[lo:hi] = own + lo
    return root


def _walk(lanes: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int, root: np.ndarray) -> None:
    """Joins the leaves of groups in `root`; of the pairs of nodes that are open, so many go down together that memory does not grow with a group."""
    todo = [(0, starts, ends, starts, ends, np.zeros(len(starts), np.int64))]
    while todo:
        depth, a0, a1, b0, b1, spent = todo.pop()
        if len(a0) > AT_ONCE:
            todo += [(depth, *(x[half] for x in (a0, a1, b0, b1, spent))) for half in (slice(AT_ONCE, None), slice(AT_ONCE))]
            continue
        # leaf level: few enough pairs are compared outright, joined subtrees need no more work
        fresh = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])]) if len(root) else np.zeros(1, int)
        same = (root[a0] == root[b0]) & (fresh[a1 - 1] == fresh[a0]) & (fresh[b1 - 1] == fresh[b0])
        few = ~same & ((a1 - a0) * (b1 - b0) <= LEAVES)
        if few.any():
            na, nb = (a1 - a0)[few], (b1 - b0)[few]
            total = na * nb
            which = np.repeat(np.arange(len(total)), total)
            k = np.arange(len(which)) - np.repeat(np.cumsum(total) - total, total)
            i, j = a0[few][which] + k // nb[which], b0[few][which] + k % nb[which]
            i, j = i[i < j], j[i < j]
            near = _distance(lanes[i], lanes[j]) <= budget
            _unite(root, i[near], j[near])
        go = ~same & ~few
        a0, a1, b0, b1, spent = a0[go], a1[go], b0[go], b1[go], spent[go]
        if not len(a0):
            continue
        bit = (lanes[:, depth // 64] >> np.uint64(63 - depth % 64)) & np.uint64(1)
        ones = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        itself = a0 == b0
        other = ~itself
        c0 = np.concatenate([a0, am, a0, am[other]])
        c1 = np.concatenate([am, a1, am, a1[other]])
        d0 = np.concatenate([b0, bm, bm, b0[other]])
        d1 = np.concatenate([bm, b1, b1, bm[other]])
        cost = np.concatenate([spent, spent, spent + 1, spent[other] + 1])
        go = (c1 > c0) & (d1 > d0) & (cost <= budget)
        todo.append((depth + 1, c0[go], c1[go], d0[go], d1[go], cost[go]))


def _forest_edges(lanes: int, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, "task", 1 << 14):
            task = part["task"].to_numpy()
            node = part["node"].to_numpy()
            words = np.frombuffer(b"".join(part["fingerprint"].to_pylist()), ">u8").reshape(-1, lanes).astype(np.uint64)
            order = np.lexsort([*(words[:, k] for k in reversed(range(lanes))), task])
            task, node, words = task[order], node[order], words[order]
            # equal fingerprints of a task are one leaf
            first = np.concatenate([[True], (task[1:] != task[:-1]) | (words[1:] != words[:-1]).any(1)])
            leaf = np.flatnonzero(first)
            starts = np.flatnonzero(np.concatenate([[True], task[leaf][1:] != task[leaf][:-1]]))
            root = leaf[trie_forest(words[leaf], starts, np.append(starts[1:], len(leaf)), budget)[np.cumsum(first) - 1]]
            linked = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[root[linked]])], names=["a", "b"])

    return run


def _candidate_edges(keyed: DataFrame, lanes: int, budget: int, least_capacity: int) -> DataFrame:
    """Spanning forests (a, b) of the rows (node, fingerprint, key) that share a key and differ in `budget` bits at most.

    A key held by more rows than a task's fair share, or than MOST, is dealt out as pairs of chunks.
    """
    capacity = max(least_capacity, min(MOST, 4 * keyed.count() // shuffle_partitions(keyed.sparkSession)))
    # keys above the capacity: fewer than a quarter of the shuffle partitions, or rows / least_capacity
    hot = keyed.groupBy("key").count().where(F.col("count") > capacity).select("key", F.ceil(F.col("count") / capacity).cast("int").alias("chunks"))
    dealt = keyed.join(F.broadcast(hot), "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("pair", F.explode(_chunk_pairs("node"))).select(F.xxhash64("key", "pair").alias("task"), "node", "fingerprint")
    return dealt.repartition("task").sortWithinPartitions("task").mapInArrow(_forest_edges(lanes, budget), "a long, b long")


def _chunk_pairs(*by: str) -> Column:
    """The pairs of chunks, of the row's number `chunks`, in which a row's own chunk takes part."""
    own = F.pmod(F.xxhash64(*by), F.col("chunks")).cast("int")
    return F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.least(own, o) * F.col("chunks") + F.greatest(own, o))


def link_components(prints: DataFrame, lanes: int, budget: int, least_capacity: int = 4096) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id) for rows (doc_id, fingerprint, minima).

    Fingerprints link at `budget` differing bits or fewer. The 64 bits are cut into
    budget + 1 blocks, of which linked ones share at least one, so that no link is
    lost. Equal fingerprints are one leaf, so that copies are never paired.
    component_id is the smallest doc_id reachable; rows with a null doc_id link to
    nothing and have none. Rows that repeat a doc_id count as one document.
    """
    if lanes != 1 or not 0 <= budget <= 15:
        raise ValueError("blocks need 64-bit fingerprints and a budget of 0 to 15")
    prints = materialize(prints)
    nodes = materialize(prints.where("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("node")))
    bits = F.conv(F.hex("fingerprint"), 16, 2)
    bits = F.lpad(bits, 64, "0")
    cuts = [round(64 * k / (budget + 1)) for k in range(budget + 2)]
    keys = [F.xxhash64(F.lit(k), F.substring(bits, lo + 1, hi - lo)) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))]
    keyed = materialize(nodes.select("node", "fingerprint", F.explode(F.array(*keys)).alias("key")))
    found = connected_components(_candidate_edges(keyed, lanes, budget, least_capacity))
    return _labelled(prints, nodes, found, "fingerprint").select("doc_id", "fingerprint", "component_id")


def _labelled(prints: DataFrame, nodes: DataFrame, found: DataFrame, by: str) -> DataFrame:
    """Rows of `prints` with the component_id of their class, whose column is `by`."""
    labelled = materialize(nodes.select("node", by).join(found, "node", "left").select(by, F.coalesce("component", "node").alias("component_id")))
    return prints.join(labelled, by, "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


def _class(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _shingle_classes(docs: DataFrame, words: int, lanes: int) -> DataFrame:
    """Rows (doc_id, class, size, fingerprint, minima): texts of one class have equal sets of shingles.

    The size and the fingerprint are those of the set, the minima its MINIMA smallest
    hashes (none for a blank text).
    """
    schema = pa.schema([("doc_id", pa.int64()), ("class", pa.binary()), ("size", pa.int64()), ("fingerprint", pa.binary()), ("minima", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in as_bytes(batch.column(1)):
                hashes = np.unique(shingle_hashes(data or b"", words))
                rows.append((_class(hashes), len(hashes), simhash(hashes, lanes), hashes[:MINIMA].view(np.int64).tolist()))
            columns = [pa.array([r[k] for r in rows], schema.types[k + 1]) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, class binary, size long, fingerprint binary, minima array<long>")


def _shingle_sets(asked: DataFrame, words: int) -> DataFrame:
    """Rows (node, class, component, shingles), ascending 64-bit hashes, of rows (node, class, component, text) whose text is of the class."""
    schema = pa.schema([("node", pa.int64()), ("class", pa.binary()), ("component", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for data, wanted in zip(as_bytes(batch.column(3)), batch.column(1).to_pylist(), strict=True):
                hashes = np.unique(shingle_hashes(data or b"", words))
                sets.append(hashes.tobytes() if _class(hashes) == wanted else None)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2), pa.array(sets, pa.binary())], schema=schema)
            yield out.filter(out.column(3).is_valid())

    found = asked.select("node", "class", "component", F.col("text").cast("string").alias("text")).mapInArrow(run, "node long, class binary, component long, shingles binary")
    return found.dropDuplicates(["node", "class"])  # rows that repeat a document


def similar_sets(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """First set of each set's component when sets of that Jaccard similarity or more are joined; none is empty.

    Each set is compared with all that nothing has joined yet, at once.
    """
    n = len(sets)
    root, held, free = np.arange(n), np.arange(n), np.ones(n, bool)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.split(flat, np.cumsum(sizes)[:-1])
    mark = np.zeros(int(flat.max()) + 1, np.int64)
    for seed in range(n):
        queue = [seed] if free[seed] else []
        free[seed] = False
        while queue:
            at, left = queue.pop(), int(np.count_nonzero(free))
            if not left:
                return root
            if 2 * left < len(held):
                held = np.flatnonzero(free)
                flat = np.concatenate([own[k] for k in held])
            mark[own[at]] = 1
            shared = np.add.reduceat(mark[flat], np.cumsum(sizes[held]) - sizes[held])
            mark[own[at]] = 0
            near = held[free[held] & (shared / (sizes[held] + sizes[at] - shared) >= similarity)]
            root[near], free[near] = seed, False
            queue += near.tolist()
    return root


def _exact_edges(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, "task"):
            task, node, shingles = part["task"].to_numpy(), part["node"].to_numpy(), part["shingles"].to_pylist()
            starts = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
            root = np.concatenate([a + similar_sets([np.frombuffer(x, "<u8") for x in shingles[a:b]], similarity) for a, b in zip(starts, np.append(starts[1:], len(task)), strict=True)])
            linked = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[root[linked]])], names=["a", "b"])

    return run


def _compared(dealt: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) from the rows (task, node, shingles) of a task whose sets are similar to the smallest node that they lead to there."""
    return dealt.repartition("task").sortWithinPartitions("task", "node").mapInArrow(_exact_edges(similarity), "a long, b long").distinct()


def _renamed(rows: DataFrame, columns: list[str], found: DataFrame) -> DataFrame:
    """`rows` whose columns name the component (node, component) of what they named, where there is one."""
    for c in columns:
        rows = rows.join(found.select(F.col("node").alias(c), F.col("component").alias("_low")), c, "left").withColumn(c, F.coalesce("_low", c)).drop("_low")
    return rows


def _exact_components(sets: DataFrame, similarity: float, chunk_sets: int) -> DataFrame:
    """Rows (node, component), the smallest node reachable, of nodes that similar sets join to a smaller one.

    sets: rows (node, component, shingles), in whose components links are looked for.

    1. Components are cut into chunks at random, and all sets of a chunk compared.
    2. Of components with several chunks, a few members of each group found speak for
       it: they are dealt to chunks again and compared. A large group of near copies is
       one group after that.
    3. What is still in several groups then is compared as all pairs of chunks, so that
       no link is lost.
    """
    counted = F.greatest(F.ceil(F.count("*") / chunk_sets), F.ceil(F.sum(F.octet_length("shingles")) / (8 * CHUNK_SHINGLES))).cast("int")
    chunk = lambda salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col("chunks")).cast("int")
    chunks = materialize(sets.groupBy("component").agg(counted.alias("chunks")))
    sets = sets.join(chunks, "component")
    # within a chunk all members of a group are linked to its smallest one
    near = materialize(_compared(sets.select(F.xxhash64("component", chunk(1)).alias("task"), "node", "shingles"), similarity))
    near = near.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    large = materialize(sets.where("chunks > 1"))
    if large.isEmpty():
        return near
    near = materialize(near)
    grouped = materialize(_renamed(large.withColumn("group", F.col("node")), ["group"], near))
    place = F.row_number().over(Window.partitionBy("component", "group").orderBy(F.xxhash64("node", F.lit(2)), "node"))
    speakers = grouped.withColumn("place", place).where(F.col("place") <= SPEAKERS)
    again = speakers.groupBy("component").agg(counted.alias("chunks"))
    speakers = speakers.drop("chunks").join(again, "component").select(F.xxhash64("component", chunk(3)).alias("task"), "node", "shingles")
    found = materialize(connected_components(_renamed(_compared(speakers, similarity), ["a", "b"], near)))
    grouped = _renamed(grouped, ["group"], found)
    apart = grouped.groupBy("component").agg((F.min("group") != F.max("group")).alias("apart")).where("apart").select("component")
    rest = materialize(grouped.join(apart, "component"))
    near = _renamed(near, ["component"], found).unionByName(found.join(near, "node", "left_anti"))
    if rest.isEmpty():
        return near
    groups = rest.select("node", F.col("group").alias("component")).distinct()
    pairs = rest.withColumn("pair", F.explode(_chunk_pairs("node"))).select(F.xxhash64("component", "pair").alias("task"), "node", "shingles")
    more = materialize(connected_components(_renamed(_compared(pairs, similarity), ["a", "b"], groups)))
    near = materialize(near)
    return _renamed(near, ["component"], more).unionByName(more.join(near, "node", "left_anti"))


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, chunk_sets: int = CHUNK_SETS) -> DataFrame:
    """Rows (doc_id, component_id) of documents whose sets of word shingles are that similar (Jaccard), or linked by such.

    Candidates share one of the smallest shingle hashes, and 256-bit fingerprints of
    their sets differ in no more bits than sets of that similarity do by chance. In each
    component of candidates sets are then compared exactly (as sets of 64-bit hashes).
    Equal sets, blank texts among them, are one class; component_id is the smallest
    doc_id reachable, none for a null doc_id. Rows that repeat a doc_id with other texts
    link what either of them links.
    """
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    budget = int(256 * share + DEVIATIONS * np.sqrt(256 * share * (1 - share)))
    prints = materialize(_shingle_classes(docs, words, 4))
    nodes = materialize(prints.where("doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("node"), *(F.min(c).alias(c) for c in ("size", "fingerprint", "minima"))))
    # a blank text has no shingles; as one class holds all of them, nothing is lost
    keyed = materialize(nodes.select("node", "fingerprint", F.explode("minima").alias("key")))
    near = connected_components(_candidate_edges(keyed, 4, budget, 4096))
    # a component's smallest node is not a row of its own there
    near = near.unionByName(near.select(F.col("component").alias("node"), "component").distinct())
    asked = materialize(nodes.where("size > 0").join(near, "node").select("node", "class", "component"))
    sets = materialize(_shingle_sets(docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(asked, "node"), words))
    found = _exact_components(sets, similarity, chunk_sets)
    return _labelled(prints.select("doc_id", "class"), nodes, found, "class").select("doc_id", "component_id")


def deduplicate(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each group, the smallest doc_id stays.

    Rows with a null doc_id stay, and so do all columns.
    """
    gone = near_duplicates(docs, words, similarity).where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
