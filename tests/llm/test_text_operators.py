"""Each operator against a brute-force version, on odd texts and on an empty table."""

import hashlib
import random
import re
import tracemalloc
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from waymesh.llm import fingerprints, lines, mixing, packing, quality, simhash, suffixes, tokens

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def encode(text):
    from tokenizers import Tokenizer

    if not hasattr(encode, "tokenizer"):
        encode.tokenizer = Tokenizer.from_file(tokens.tokenizer_path(tokens.WORD_BPE))
    return encode.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_chunked_ids_are_the_tokenizers(rows):
    own = tokens.chunk_encoder()
    odd = ["Große ÉTÉ, naïve. x_y a__ co-op don't we'll <|endoftext|> a<b ªº µm", "İstanbul ΑΣ ΑΣΑ 日本語 テキスト 4５6", "été ﬁ \x1cx\x85y z", "y" * 300 + " z\r\n\t\x0b\x0cq"]
    for text in [*odd, *(r[1] for r in rows)]:
        assert np.frombuffer(own((text or "").encode()), "<u4").tolist() == encode(text)


def test_other_tokenizers_encode_texts_whole(docs, rows):
    from tokenizers import Tokenizer

    name = tokens.tokenizer_path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(name)
    want = {(r[0], len(whole.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows}
    assert {(r["doc_id"], r["n_tokens"]) for r in tokens.token_counts(docs, name).collect()} == want


def test_packing_places_every_id_once(docs, rows, none):
    pieces = packing.pack_documents(docs).collect()
    want = Counter((r[0], tuple(encode(r[1]) + [1])) for r in rows)
    by_row = defaultdict(list)
    for p in pieces:
        assert p["length"] * 4 == len(p["ids"])
        by_row[p["doc_id"]].append((p["start"], tuple(np.frombuffer(p["ids"], "<u4").tolist()), p["doc_tokens"]))
    for doc_id in {r[0] for r in rows}:
        ids = [k for k in want.elements() if k[0] == doc_id]
        found = sorted(by_row[doc_id])
        assert sum(len(x[1]) for x in found) == sum(len(k[1]) for k in ids)
        if len(ids) == 1:
            at = 0
            for start, part, total in found:
                assert (start, total) == (at, len(ids[0][1])) and part == ids[0][1][at : at + len(part)]
                at += len(part)
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and len(parts) <= 256
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0
    assert packing.pack_documents(none).count() == 0


def test_packing_keeps_to_all_limits_without_cutting(docs):
    limits = packing.Limits(tokens=30_000, segments=3, loss=25_000)
    pieces = packing.pack_documents(docs, limits, cut=False).groupBy("sequence_id").agg(F.count("*").alias("n"), F.sum("length").alias("tokens"), F.sum("doc_tokens").alias("whole")).collect()
    assert all(p["n"] <= 3 and p["tokens"] == p["whole"] <= 30_000 and p["tokens"] - p["n"] <= 25_000 for p in pieces)
    assert len(pieces) < docs.count() / 2
    # a document beyond the limits has no sequence, and all others have one
    small = packing.pack_documents(docs, packing.Limits(tokens=200), cut=False)
    assert small.where("(doc_tokens > 200) <> (sequence_id is null)").count() == 0 and small.count() == docs.count()


def test_conversations_bear_loss_on_answers_alone(spark):
    rng = random.Random(9)
    turns = [(c, t, ("user", "assistant", "system", None)[t % 4], "word " * rng.randint(0, 60) if t % 7 else None) for c in range(120) for t in range(rng.randint(1, 6))]
    turns += [(500, t, "assistant", "word " * 50) for t in range(40)]  # one beyond the limits
    turns.append(turns[3])  # a repeated turn
    table = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn int, role string, text string, tokens string").repartition(3)
    sizes = packing.conversation_sizes(table)
    want = defaultdict(lambda: [0, 0])
    for c, _, role, text in turns:
        n = len(encode(text)) + 1
        want[c][0] += n
        want[c][1] += n if role == "assistant" else 0
    assert {r["conv_id"]: [r["tokens"], r["loss"]] for r in sizes.collect()} == want
    limits = packing.Limits(tokens=400, segments=5, loss=90)
    packed = packing.pack_sizes(sizes.repartition(2), limits).collect()
    assert {r["conv_id"]: [r["tokens"], r["loss"]] for r in packed} == want and len(packed) == len(want)
    bins = defaultdict(list)
    for r in packed:
        assert (r["sequence_id"] is None) == (r["tokens"] > 400 or r["loss"] > 90)
        if r["sequence_id"] is not None:
            bins[r["sequence_id"]].append(r)
    binding = 0
    for b in bins.values():
        used = [sum(r["tokens"] for r in b), len(b), sum(r["loss"] for r in b)]
        assert used[0] <= 400 and used[1] <= 5 and used[2] <= 90
        assert sorted(r["offset"] for r in b) == [sum(r["tokens"] for r in sorted(b, key=lambda r: r["offset"])[:k]) for k in range(len(b))]
        binding += used[2] > 60
    assert binding > len(bins) / 3  # the loss limit decides
    assert packing.pack_sizes(sizes.limit(0)).count() == 0
    odd = sizes.sparkSession.createDataFrame([(1, None, None, 9), (2, 10, None, 9), (None, 5, 2, 9), (2, 10, 3, 9), (4, None, 7, 9), (5, 10**6, 1, 9)], "conv_id long, tokens long, loss long, offset long")
    got = {(r["conv_id"], r["tokens"], r["loss"], r["sequence_id"] is not None) for r in packing.pack_sizes(odd).collect()}
    assert got == {(1, 0, 0, False), (2, 10, 0, True), (None, 5, 2, True), (2, 10, 3, True), (4, 0, 7, False), (5, 10**6, 1, False)}


def brute_simhash(text, k):
    words = WORDS.findall((text or "").translate(LOWER))
    parts = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if linked(a, b) and low[b] < low[a]:
                    low[a], changed = low[b], True
    return low


def test_simhash_components(docs, rows, none):
    found = simhash.link_components(simhash.fingerprints(docs, 3), 1, 3, least_capacity=4)
    got = {(r["doc_id"], r["fingerprint"].hex(), r["component_id"]) for r in found.collect()}
    assert found.count() == len(rows)
    prints = {r[0]: brute_simhash(r[1], 3) for r in rows}
    ids = [i for i in prints if i is not None]
    low = brute_components(ids, lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 3)
    assert got == {(i, f"{p:016x}", low.get(i)) for i, p in prints.items()}
    assert simhash.link_components(simhash.fingerprints(none, 3), 1, 3).count() == 0


def test_trie_joins_what_brute_force_joins():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    lanes = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 12).astype(np.uint64)) for _ in range(9))]))
    for budget in (0, 1, 2, 3, 9):
        half = len(lanes) // 2
        root = simhash.trie_forest(lanes[:, None], np.array([0, half]), np.array([half, len(lanes)]), budget)
        for lo, hi in ((0, half), (half, len(lanes))):
            low = brute_components(range(lo, hi), lambda a, b: bin(int(lanes[a] ^ lanes[b])).count("1") <= budget)
            assert root[lo:hi].tolist() == [low[i] for i in range(lo, hi)]


def test_near_duplicates_leave_one_of_each_group(docs, none):
    kept = [r["doc_id"] for r in simhash.deduplicate(docs.where("text is not null and length(text) > 300")).select("doc_id").collect()]
    assert {24, 25, 26, 27} & set(kept) == set() and {3, 5, 7, *range(8, 24)} <= set(kept)
    assert simhash.deduplicate(none).columns == none.columns


def jaccard_components(texts, k, similarity):
    shingles = []
    for text in texts:
        words = WORDS.findall((text or "").translate(LOWER))
        shingles.append({" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    return brute_components(range(len(texts)), lambda a, b: len(shingles[a] & shingles[b]) >= similarity * max(1e-9, len(shingles[a] | shingles[b])) or shingles[a] == shingles[b])


def test_near_duplicates_are_those_of_exact_jaccard(spark):
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(40):  # replaced words bring similarities from 0.4 to 1
        base = rng.integers(0, 5000, int(rng.integers(8, 150))).tolist()
        texts.append(base)
        for _ in range(4):
            edited = list(base)
            for at in rng.integers(0, len(base), int(rng.integers(1, 2 + len(base) // 25))):
                edited[at] = int(rng.integers(5000, 9000))
            texts.append(edited)
    # a passage repeated so often that its shingles decide the fingerprint, in different sets
    passage = rng.integers(0, 5000, 9).tolist() * 40
    texts += [passage + rng.integers(0, 5000, 60).tolist() for _ in range(6)]
    # sets of four and of five shingles, of similarity 0.8
    for _ in range(20):
        base = rng.integers(0, 5000, 9).tolist()
        texts += [base, base[:8]]
    texts = [" ".join(f"w{x}" for x in t) for t in texts] + ["", " ", "one two", "One  two"]
    # a chain of sets whose ends differ, so that members of a few chunks do not speak for all of it
    chain = rng.integers(0, 5000, 60).tolist()
    for k in range(12):
        texts.append(" ".join(f"c{x}" for x in chain[: 60 - 3 * k]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = jaccard_components(texts, 5, 0.8)
    for chunk_sets in (512, 2):  # whole components, and as chunks, their speakers and pairs of chunks
        found = simhash.near_duplicates(docs, 5, 0.8, chunk_sets=chunk_sets).collect()
        assert {r["doc_id"]: r["component_id"] for r in found} == want


def test_length_table(docs, rows, none):
    lengths = [len(encode(r[1])) for r in rows]
    answers = tokens.length_table(tokens.length_histogram(docs), limits=(0, 64, 77, 1 << 20), band=64)
    table = answers.collect()
    assert sorted(r["n_tokens"] for r in table) == sorted({*lengths, 0, 64, 77, 1 << 20})
    ranked = sorted(lengths)
    for r in tokens.length_quantiles(answers, (0.1, 0.5, 0.9, 1.0)).collect():
        assert r["n_tokens"] == ranked[int(np.ceil(r["share"] * len(ranked))) - 1]
    for r in table:
        n = r["n_tokens"]
        longer = [x for x in lengths if x > n]
        assert (r["n_docs"], r["docs_longer"], r["tokens_longer"], r["docs_upto"]) == (lengths.count(n), len(longer), sum(longer), len(lengths) - len(longer))
        assert r["truncated_total"] == sum(min(x, n) for x in lengths) and r["tokens_upto"] == sum(lengths) - sum(longer)
    assert tokens.length_table(tokens.length_histogram(none)).count() == 0
    empty = tokens.length_table(tokens.length_histogram(none), limits=(5,))
    assert [(r["n_tokens"], r["truncated_total"], r["quantile"]) for r in empty.collect()] == [(5, 0, None)]
    assert [tuple(r) for r in tokens.length_quantiles(empty, (0.5,)).collect()] == [(0.5, None)]
    assert {(r["doc_id"], r["n_tokens"]) for r in tokens.token_counts(docs).collect()} == {(r[0], n) for r, n in zip(rows, lengths, strict=True)}


def brute_cut(texts, length):
    first = {}
    for i in sorted(texts):
        for s in range(len(texts[i]) - length + 1):
            first.setdefault(texts[i][s : s + length], i)
    out = {}
    for i, b in texts.items():
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < i:
                gone[s : s + length] = True
        out[i] = (len(b), int(gone.sum()), int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum()), np.frombuffer(b, np.uint8)[~gone].tobytes())
    return out


def test_repeats_are_cut_as_by_brute_force(docs, rows, none):
    last = 1 << 62
    texts = {last if r[0] is None else r[0]: (r[1] or "").encode() for r in rows}
    # as blocks need them, then with all anchors and with some anchors common, in small blocks
    for length, settings in ((50, {}), (17, {}), (50, {"common_blocks": 1, "block_bytes": 2000}), (17, {"common_runs": 3, "block_bytes": 6000})):
        found = suffixes.remove_repeats(docs, length, **settings).collect()
        want = brute_cut(texts, length)
        assert len(found) == len(rows)
        for r in found:
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want[last if r["doc_id"] is None else r["doc_id"]]
    assert suffixes.remove_repeats(none).count() == 0


def test_suffix_classes_are_those_of_equal_windows():
    rng = np.random.default_rng(1)
    for letters, size, length in ((1, 80, 9), (2, 400, 5), (3, 900, 12), (200, 500, 3)):
        text = rng.integers(0, letters, size).astype(np.uint8)
        text[-40:] = text[:40]
        windows = np.flatnonzero(rng.random(size - length + 1) < 0.8)
        classes = suffixes.suffix_classes(text, windows, length)
        seen = {}
        for w, c in zip(windows.tolist(), classes.tolist(), strict=True):
            assert seen.setdefault(text[w : w + length].tobytes(), c) == c
        assert len(set(classes.tolist())) == len(seen)


def test_quality_statistics_and_verdicts(docs, rows, none):
    for r in quality.judge(docs, statistics=True).collect():
        text = next(x[1] for x in rows if x[0] == r["row"]["doc_id"]) or ""
        words = WORDS.findall(text)
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        again = {p for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
        filled = [x for x in text.split("\n") if WORDS.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(filled) - len(set(filled)), len(again))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(again) > 50 * len(words))
        assert not (r["base_failed"] and r["kept"])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and set(range(24)) <= {r["doc_id"] for r in kept.collect()}
    assert quality.keep_good(none).count() == 0 and quality.judge(none, statistics=True).count() == 0


def test_mix_meets_targets(docs, rows, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORDS.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= over
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and abs(r["target"] - target[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["taken"]
    assert all(target[s] - 1 < taken[s] <= target[s] + 1e-6 for s in order)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(none).count() == 0


def test_mixed_documents_have_the_words_taken(docs, none):
    distinct = docs.dropDuplicates(["doc_id"])
    out = mixing.apply_mix(distinct)
    assert out.columns == docs.columns
    words = out.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n"))
    assert {(r["doc_id"], r["taken"]) for r in mixing.mix(distinct).where("taken > 0").collect()} == {(r["doc_id"], r["n"]) for r in words.collect()}
    assert out.where("n_chars <> length(text)").count() == 0
    assert mixing.apply_mix(none).count() == 0


def test_repeated_ids_keep_the_exact_budgets(spark):
    rng = random.Random(4)
    rows = []
    for k in range(60):
        text = " ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([3, 3, 3, 7, 40])))
        rows.append((k % 5 if k % 3 else None, text, "s" + str(k % 2), 0, "x"))
    rows += [(7, "same words here", "s0", 0, "y")] * 90 + [(7, "other words there", "s0", 0, "y")] * 30  # a hot id
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, size string").repartition(3)
    for share in (0.4, 1.5, 1.9):
        words = mixing.apply_mix(docs, share=share).groupBy("source").agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).collect()
        targets = {r["source"]: r["taken"] for r in mixing.mix(docs, share=share).groupBy("source").agg(F.sum("taken").alias("taken")).collect()}
        assert {r["source"]: r["n"] for r in words} == {s: n for s, n in targets.items() if n}


def test_common_lines_go(docs, rows, none):
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").translate(LOWER)
    texts = {r[0]: (r[1] or "").split("\n") for r in rows}
    holders = defaultdict(set)
    for i, parts in texts.items():
        for x in parts:
            holders[key(x)].add(i)
    out = lines.drop_common_lines(docs, 1, 10)
    assert out.columns == [*[c for c in docs.columns if c != "n_lines"], "n_lines", "n_dropped"]
    for r in out.collect():
        parts = texts[r["doc_id"]]
        kept = [x for x in parts if not (key(x) and len(holders[key(x)]) >= 10)]
        assert (r["text"], r["n_lines"], r["n_dropped"], r["lang"]) == ("\n".join(kept), len(parts), len(parts) - len(kept), "en")
    # twelve rows of one doc_id, or of none, are one document, whatever partitions they are in
    repeated = [(1 if k < 12 else None, f"the line\nown {k % 5}") for k in range(24)] + [(50 + k, "the line") for k in range(8)]
    for more, gone in (([], 32), ([(90, "x")], 32), ([(91, "The LINE")], 33)):
        table = docs.sparkSession.createDataFrame(repeated + more, "doc_id long, text string").repartition(7)
        lost = lines.drop_common_lines(table, 1, 10 if len(more) == 0 or more[0][0] != 91 else 11).agg(F.sum("n_dropped")).first()[0]
        assert lost == gone
    assert lines.drop_common_lines(table, 1, 12).agg(F.sum("n_dropped")).first()[0] == 0
    first = lines.drop_common_lines(docs.select("doc_id", "text"), 1, 10, keep_first=True).agg(F.sum("n_dropped")).first()[0]
    assert first == out.agg(F.sum("n_dropped")).first()[0] - 1
    assert lines.drop_common_lines(none).count() == 0


def brute_canonical(text):
    folded = unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).casefold())
    return re.sub(r"[ \t-\r\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " ", unicodedata.normalize("NFC", folded)).strip(" ")


def test_fingerprints_of_documents_and_their_edits(docs, rows, none):
    texts = sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is None, -(r[0] or 0)))
    got = {r["doc_id"]: r for r in fingerprints.edited_likeness(docs).collect()}
    assert len(got) == len(texts)
    prints = defaultdict(set)
    for k, (i, text) in enumerate(texts):
        follow = texts[(k + 1) % len(texts)]
        m = len(text) // 3
        edited = text[: len(text) - m] + follow[1][:m]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        same, same_next = (brute_canonical(text) == brute_canonical(x) for x in (edited, follow[1]))
        assert (r["near_edited"], r["near_next"]) == (float(same), float(same_next))
        prints[brute_canonical(text)].add(r["fingerprint"])
        prints[brute_canonical(edited)].add(r["edited_fingerprint"])
    assert all(len(p) == 1 for p in prints.values()) and len(set.union(*prints.values())) == len(prints)
    assert fingerprints.edited_likeness(none).count() == 0


def odd_texts():
    """Characters that normalisation or folding changes, alone, taken apart and mixed up with marks."""
    rng = random.Random(1)
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    changing = [c for c in every if unicodedata.normalize("NFD", c) != c]
    marks = [c for c in every if unicodedata.combining(c)]
    cased = [c for c in every if c.casefold() != c]
    yield from marks
    yield from cased
    for c in changing:
        apart = list(unicodedata.normalize("NFD", c))
        yield c
        yield "".join(apart)
        rng.shuffle(apart)
        yield "a" + "".join(apart) + "b"
        yield c + rng.choice(marks) + rng.choice(marks)
    pool = [*marks[:60], *"aeoêờsṩßẞÅKক가각각αςΣΰᾳᾼᾴİIı", "ে", "া", "ᄀ", "ᅡ", "ᆨ", "̈́", "ཱི", "\u0345", "ﬁ", "ǰ", "\U0010f0e6", "\U0001d15e", "x", " ", "\n"]
    for _ in range(5000):
        yield "".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))


def test_canonical_text_is_that_of_the_unicode_database(spark):
    cases = ["", "plain", "STRASSE straße", "Σίσυφος ΣΊΣΥΦΟΣ", *odd_texts()]
    df = spark.createDataFrame(list(enumerate(cases)), "k long, text string")
    for r in df.select("k", fingerprints.compose(F.col("text")).alias("composed"), fingerprints.canonical(F.col("text")).alias("canon")).collect():
        assert r["composed"] == unicodedata.normalize("NFC", cases[r["k"]])
        assert r["canon"] == brute_canonical(cases[r["k"]])


def test_crc_of_ids_is_that_of_the_bytes(docs):
    for r in packing.pack_documents(docs).select("ids", F.crc32("ids").alias("crc")).limit(20).collect():
        assert r["crc"] == zlib.crc32(r["ids"])


def test_rules_that_reject_nothing_come_last_and_ties_keep_their_order(spark):
    import time

    from waymesh.llm import quality

    def slow(d):
        time.sleep(0.002)
        return True

    rules = (("never_slow", lambda d: not slow(d)), ("never", lambda d: False), ("slow", slow), ("always", lambda d: True))
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(60)], "doc_id long, text string")
    order = [r[0] for r in quality.cascade_order(docs, rules)]
    assert order == ["always", "slow", "never", "never_slow"]
    none = docs.limit(0)
    assert [r[0] for r in quality.cascade_order(none, rules)] == [r[0] for r in rules] and quality.judge(none, rules).count() == 0


def test_memory_of_a_walk_does_not_follow_a_group(rng=np.random.default_rng(5)):
    n = 4096
    words = rng.integers(0, 1 << 63, (n, 4), np.uint64)
    words[1::2] = words[::2] ^ (np.uint64(1) << rng.integers(0, 63, (n // 2, 4)).astype(np.uint64))
    words = words[np.lexsort([words[:, k] for k in reversed(range(4))])]
    tracemalloc.start()
    root = simhash.trie_forest(words, np.array([0]), np.array([n]), 73)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(np.unique(root)) == n // 2 and most < 400e6
