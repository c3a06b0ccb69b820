"""Licence scans, fill-in-the-middle and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from waymesh.llm import infill, licenses, queries, resampling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row string, n_lines string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def licensed(spark, rows):
    """The shared documents and others with licence texts, whole, torn, repeated and in odd spellings."""
    mit = licenses.TEMPLATES[0][1]
    half = mit.split()
    more = [
        "MIT License\n\n" + mit,
        "x " * 500 + mit.upper() + " y" * 500,
        " ".join(half[:40]) + " some words between " + " ".join(half[45:]),
        " ".join(half[100:]),
        mit + "\n" + mit,
        "mit-license MIT LICENSE apache license general public license gnu lesser general public license",
        "general public general public license of a mit licenses",
        "Licensed under the Apache License, Version 2.0.",
        ("software without restriction including " * 400).strip(),
        "mitlicense mit license mit　license",
        "a" * 300_000 + " mit license " + "b " * 200_000 + "apache license",
    ]
    extra = [(1000 + k, t, "en", "s", len(t), "clash", "clash", "clash") for k, t in enumerate(more)]
    return spark.createDataFrame([*rows, *extra], SCHEMA).repartition(3).cache()


def test_phrases_stand_where_a_plain_search_finds_them(licensed):
    got = licenses.scan_licenses(licensed).collect()
    assert len(got) == licensed.count()
    texts = {r["doc_id"]: r["text"] for r in licensed.collect()}
    for r in got:
        w = words(texts[r["row"]["doc_id"]])
        found = [(k, label) for phrase, label in licenses.PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        assert r["n_words"] == len(w) and r["n_base"] == len(found)
        places = [k for k, _ in found]
        assert (r["first_word"], r["last_word"]) == ((min(places), max(places)) if places else (None, None))
        base = sorted({label for _, label in found})
        assert r["base_labels"] == ",".join(base)
        assert set(base) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
        assert r["labels"].split(",") == sorted(set(r["labels"].split(",")))


def test_templates_are_found_whole_torn_and_repeated(licensed):
    got = {r["row"]["doc_id"]: r for r in licenses.scan_licenses(licensed).where("row.doc_id >= 1000").collect()}
    size = len(words(licenses.TEMPLATES[0][1]))
    whole = [s for s in got[1001]["spans"] if s["template"] == 0]
    assert [(s["first_word"], s["end_word"], s["covered"]) for s in whole] == [(500, 500 + size, 1.0)]
    torn = [s for s in got[1002]["spans"] if s["template"] == 0]
    assert len(torn) == 1 and 0.9 < torn[0]["covered"] < 1 and got[1002]["labels"] == "mit" and got[1002]["base_labels"] == ""
    assert [(s["first_word"], s["end_word"]) for s in got[1004]["spans"] if s["template"] == 0] == [(0, size), (size, 2 * size)]
    assert got[1003]["labels"] in ("", "mit") and got[1003]["score"] == pytest.approx(len(words(" ".join(licenses.TEMPLATES[0][1].split()[100:]))) / size)
    assert got[1005]["labels"] == "apache,gpl,lgpl,mit" and got[1007]["labels"] == "apache"
    assert got[1008]["labels"] == "" and 0 < got[1008]["score"] < 0.1  # one passage again and again covers its words once
    assert got[1009]["n_base"] == 0


def test_matching_statistics_against_all_substrings():
    rng = random.Random(5)
    templates = [("t", " ".join(rng.choice("abc") for _ in range(n))) for n in (1, 5, 12, 20)]
    a = licenses.Automaton(templates, (), 2)
    runs = {}
    for t, (_, text) in enumerate(templates):
        w = text.split()
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                runs.setdefault(tuple(w[i:j]), set()).add((t, j))
    for _ in range(50):
        text = [rng.choice("abcd") for _ in range(40)]
        state = size = 0
        for k, word in enumerate(text):
            while state and word.encode() not in a.next[state]:
                state = a.link[state]
                size = a.length[state]
            to = a.next[state].get(word.encode())
            state, size = (to, size + 1) if to is not None else (0, 0)
            longest = max((n for n in range(k + 2) if n == 0 or tuple(text[k + 1 - n : k + 1]) in runs), default=0)
            assert size == longest
            if size >= 2:
                assert set(a.ends[state]) == runs[tuple(text[k + 1 - size : k + 1])]


def test_license_scan_of_nothing(spark, none):
    assert licenses.scan_licenses(none).count() == 0
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "mit license")], "doc_id long, text string")
    got = licenses.scan_licenses(odd).collect()
    assert sorted((r["n_words"], r["n_base"], r["labels"], r["score"]) for r in got) == [(0, 0, "", 0.0)] * 3 + [(2, 1, "mit", 1.0)]
    assert all(r["base_labels"] == r["labels"] for r in licenses.scan_licenses(odd, templates=()).collect())


def plain_infill(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill_against_plain_python_and_back(spark, rows):
    marks = ["<P>", "a <S> b", "x<M>", "<", "<S", "a <P b> <", "<<P", " \t\n ", "  　 \x1f x", "é " * 5000, "z" * 200_000 + " end", "𝒳 𝒴 ñ <", "S> P> M> <"]
    many = [(2000 + 40 * k + j, t, "en", "s", 0, "clash", "clash", "clash") for k, t in enumerate(marks) for j in range(40)]
    docs = spark.createDataFrame([*rows, *many, (None, None, None, None, None, None, None, None), many[5]], SCHEMA).repartition(3).cache()
    made = infill.fill_in_middle(docs)
    assert {r["form"] for r in made.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    got = made.withColumn("back", infill.restored("output", "form")).collect()
    source = {}
    for r in docs.collect():
        source.setdefault(r["doc_id"], []).append(r["text"])
    assert len(got) == docs.count()
    for r in got:
        found = tuple(r[c] for c in ("n", "form", "prefix_chars", "middle_chars", "output"))
        texts = source[r["row"]["doc_id"]]
        match = [t for t in texts if plain_infill(r["row"]["doc_id"], t) == found]
        assert match and r["back"] in [t or "" for t in match]
        assert r["output_sha256"] == hashlib.sha256(r["output"].encode()).hexdigest()
        assert r["row"]["kept"] in ("clash", None)


def test_infill_of_nothing(none):
    assert infill.fill_in_middle(none).count() == 0


def plain_resample(docs, target, s):
    def features(text):
        w = words(text)
        return w, w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]

    def buckets(texts):
        counts = [0] * s.buckets
        for t in texts:
            for f in features(t)[1]:
                counts[zlib.crc32(f.encode()) % s.buckets] += 1
        return counts

    c, t = buckets(x for _, x in docs), buckets(target)
    n_c, n_t = sum(c), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (n_c + s.buckets) / ((a + 1) * (n_t + s.buckets)))) for a, b in zip(c, t, strict=True)]
    out = []
    for doc_id, text in docs:
        w, f = features(text)
        weight = math.floor(sum(gain[zlib.crc32(x.encode()) % s.buckets] for x in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"{s.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= s.least_words), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    return out, [(k + 1, *x) for k, x in enumerate(able[: len(able) * s.percent // 100])]


@pytest.mark.parametrize("sizes", [(1 << 18, 1 << 13), (7, 3), (1, 1)])
def test_resampling_against_plain_python(spark, rows, sizes):
    rng = random.Random(1)
    more = [(3000 + k, " ".join(rng.choice(("the", "tari", "moné", "Lu", "ka9")) for _ in range(rng.randint(0, 60)))) for k in range(400)]
    docs = [(r[0], r[1]) for r in rows] + more + [more[3]] * 40 + [(3001, "other text " * 20), (None, "no id " * 20)]
    target = [t for _, t in more[::7]] + [None, "", "passage the the"]
    s = resampling.Settings(percent=40)
    table = spark.createDataFrame([(d, t, "clash", 7) for d, t in docs], "doc_id long, text string, rank string, score int").repartition(5)
    aims = spark.createDataFrame([(t, "x") for t in target], "text string, doc_id string")
    got = resampling.resample(table, aims, s, *sizes).collect()
    every, ranked = plain_resample(docs, target, s)
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in got), key=key) == sorted(every, key=key)
    have = sorted((r["rank"], r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in got if r["rank"] is not None)
    assert [x[0] for x in have] == list(range(1, len(ranked) + 1))
    # rows that agree in score and doc_id may take each other's ranks
    assert [(x[1], x[5]) for x in have] == [(x[1], x[5]) for x in ranked]


def test_drawn_documents_carry_their_columns(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    ranks = resampling.resample(docs, docs.where("doc_id < 5")).cache()
    got = resampling.drawn(docs, ranks).collect()
    n = ranks.where("n_words >= 20").count()
    assert sorted(r["rank"] for r in got) == list(range(1, n * 25 // 100 + 1))
    texts = {(r[0], r[1]) for r in rows}
    assert all((r["doc_id"], r["text"]) in texts and r["kept"] in ("clash", None) for r in got)


def test_resampling_of_nothing(spark, none, docs):
    assert resampling.resample(none, none).count() == 0
    got = resampling.resample(docs, none)
    assert got.count() == docs.count() and got.where(F.col("rank").isNotNull()).count() == got.where("n_words >= 20").count() * 25 // 100
    short = spark.createDataFrame([(k, "few words") for k in range(9)], "doc_id long, text string")
    assert resampling.resample(short, docs).where(F.col("rank").isNotNull()).count() == 0


def test_a_tournament_merges_runs_that_join_late():
    rng = random.Random(2)
    for _ in range(30):
        runs = [sorted((rng.randint(0, 30), rng.randint(0, 3)) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 9))]
        blocks = sorted((run[k : k + 4], i, k) for i, run in enumerate(runs) for k in range(0, len(run), 4))
        blocks.sort(key=lambda b: (b[0][0], b[1], b[2]))
        assert list(resampling.merged(b for b, _, _ in blocks)) == sorted(x for run in runs for x in run)


def test_queries_over_a_table(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "The on and"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name in ("op11_licenses", "op12_infill", "op13_resampling"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == len(rows)
