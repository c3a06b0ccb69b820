"""URL verdicts, toxicity on held-out documents, and the pipeline's stages."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from waymesh.llm import toxicity, urls

PAGES = [
    ("https://Good.Example.NET/en/1?x#y", "good.example.net", "/en/1", None, "allow"),
    ("http://bad.example.net/a", "bad.example.net", "/a", None, "block"),
    ("https://example.org/es/9", "example.org", "/es/9", "example.org/es/", "block"),
    ("https://a.example.org/en/12", "a.example.org", "/en/12", "example.org/en/1", "block"),
    ("https://a.example.org/en/2", "a.example.org", "/en/2", "org/", "allow"),
    ("https://notexample.org/es/9", "notexample.org", "/es/9", "org/", "allow"),
    ("ftp://x.com/de/1", "x.com", "/de/1", "com/de/", "block"),
    ("ftp://x.com/fr/1", "x.com", "/fr/1", "com/fr/", "allow"),
    ("https://x.org", "x.org", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("://", "", "", None, "allow"),
]


def test_url_rules_and_reputation(spark):
    extra = [(100 + k, f"https://bad.example.net/{k}", 0) for k in range(60)] + [(200 + k, f"https://good.example.net/{k}", 1) for k in range(60)]
    pages = spark.createDataFrame([(k, p[0], "host", "verdict") for k, p in enumerate(PAGES)] + [(i, u, None, None) for i, u, _ in extra], "page_id long, url string, host string, verdict string")
    labels = spark.createDataFrame([(i, g) for i, _, g in extra] + [(100, None), (9999, 0)], "page_id long, good int")
    got = {r["page_id"]: r for r in urls.filter_urls(pages, labels).collect()}
    assert len(got) == len(PAGES) + len(extra)
    for k, (_, *want) in enumerate(PAGES):
        assert [got[k][c] for c in ("host", "path", "rule", "verdict")] == want
    assert urls.filter_urls(pages.limit(0), labels.limit(0)).count() == 0
    assert {r["verdict"] for r in urls.filter_urls(pages.where("page_id = 1"), labels.limit(0)).collect()} == {"allow"}


def test_very_long_and_repeated_urls(spark):
    host, path = "h" * 100_000, "/" + "p" * 500_000
    rows = [(1, f"https://{host}.EXAMPLE.org{path}"), (1, f"https://{host}.EXAMPLE.org{path}"), (None, f"https://a.com/de/{path}"), (2, "x" * 300_000)]
    got = sorted(urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([(1, 1)], "page_id long, good int")).collect(), key=lambda r: (r["page_id"] is None, r["page_id"]))
    assert [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got[:2]] == [(1, f"{host}.example.org", path, "org/", "allow")] * 2
    assert (got[2]["host"], got[2]["path"], got[2]["verdict"]) == ("", "", "allow") and (got[3]["rule"], got[3]["verdict"]) == ("com/de/", "block")


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    calm = ["".join(rng.choice(["ta", "ri", "mo", "ne", "lu", "ka"]) for _ in range(rng.randint(1, 3))) for _ in range(80)]
    rows = []
    for i in range(900):
        words = [rng.choice(calm) for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            bad = rng.choice(["scoundrel", "nitwit", "blockhead"])
            k = rng.randrange(1, len(bad) - 2)
            words.insert(rng.randrange(len(words)), bad[:k] + rng.choice("aeiou") + bad[k:])  # misspelt
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([(i, t, "score", True) for i, t, _ in rows] + [(9000, None, "", None), (None, "", "", None)], "doc_id long, text string, predicted string, held_out boolean")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), {i: y for i, _, y in rows}


def test_toxicity_on_held_out_documents(labelled):
    docs, labels, truth = labelled
    settings = toxicity.Settings(sample_rows=600, epochs=4)
    got = toxicity.score(docs, toxicity.fit(docs, labels, settings), settings).collect()
    assert len(got) == docs.count()
    held = []
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0)
        if r["held_out"] and r["doc_id"] in truth:
            held.append(r["predicted"] == truth[r["doc_id"]])
    assert np.mean(held) > 0.9


def test_toxicity_without_labels(labelled):
    docs, labels, _ = labelled
    model = toxicity.fit(docs, labels.limit(0))
    assert {r["predicted"] for r in toxicity.score(docs, model).collect()} == {0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_pipeline_stages_hand_on_documents(spark, rows, none, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    (spark.createDataFrame([r[:5] for r in rows], schema).write.parquet(f"{tmp_path}/in/documents.parquet"))
    docs = spark.read.parquet(f"{tmp_path}/in/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, f"{tmp_path}/in")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            if name == "quality_rules":
                assert set(range(24)) <= {r["doc_id"] for r in docs.collect()}
            if name == "near_dedup":
                assert not {24, 25, 26, 27} & {r["doc_id"] for r in docs.collect()}
    last = {(r["doc_id"], r["start"], r["length"], bytes(r["ids"])) for r in out.collect()}
    # columns that operators use themselves come through
    clash = [c for c in none.columns if c != "n_lines"] + ["size", "task", "component"]
    odd = spark.createDataFrame([(*r[:7], "s", "t", "c") for r in rows], ", ".join(f"{c} {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in clash))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        odd = stage(spark, odd, "")
        assert odd.columns == clash and odd.where("kept = 'clash' and size = 's' and task = 't' and component = 'c'").count() == odd.count() > 0, name
    assert last == {(r["doc_id"], r["start"], r["length"], bytes(r["ids"])) for r in corpus_pipeline.run(spark, f"{tmp_path}/in").collect()}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none.select("doc_id", "text", "lang", "source", "n_chars"), "").count() == 0, name


def brute_buckets(word, s):
    """The buckets of a word in plain integers."""
    mask, text = (1 << 64) - 1, word.translate(toxicity.ASCII_LOWER).strip(toxicity.TRIM).decode("utf-8", "replace")
    if not text:
        return []
    codes, out = [ord(c) for c in f"<{text}>"], []
    for n in range(s.shortest, s.longest + 1):
        for i in range(len(codes) - n + 1):
            h = 0
            for c in codes[i : i + n]:
                h = (h * 0xC2B2AE3D27D4EB4F + (c + 1) * 0x9E3779B97F4A7C15) & mask
            out.append((h + n) & mask)
    whole = 0
    for i, c in enumerate(codes):
        p = (c * 0xD6E8FEB86659FD93 & mask) ^ ((len(codes) - i) * 0xA0761D6478BD642F & mask)
        whole += p * (p | 1)
    out.append(whole & mask)
    return [(((h ^ (h >> 32)) * 0xE7037ED1A0B428DB & mask) >> 33) % s.buckets for h in out]


def brute_score(text, weight, bias, s):
    own = [weight[b] for w in text.encode().split() for b in brute_buckets(w, s) if not np.isnan(weight[b])]
    return 1 / (1 + np.exp(-(sum(own) / max(1, len(own)) + bias)))


def test_scores_are_those_of_brute_force(spark, rows):
    rng = np.random.default_rng(3)
    texts = [(r[0], r[1]) for r in rows] + [(700, "word " * 3 + "語" * 300), (700, "the same id, other text"), (701, ". ! *** ..."), (702, "aa\x00b " * 900)]
    docs = spark.createDataFrame([(*t, 1.0) for t in texts], "doc_id long, text string, score double").repartition(3)
    s = toxicity.Settings(buckets=512)
    weight = rng.normal(0, 2, s.buckets).astype(np.float32)
    weight[rng.random(s.buckets) < 0.4] = np.nan
    got = toxicity.score(docs, (weight, -0.3), s).collect()
    assert len(got) == len(texts)
    want = sorted((-1 if i is None else i, brute_score(t or "", weight.astype(float), -0.3, s)) for i, t in texts)
    assert np.allclose([x for _, x in want], [x for _, x in sorted((-1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in got)])


def test_training_is_that_of_plain_loops():
    """Vocabulary, averages and steps on a small set, in plain Python from the same random numbers."""
    texts = [b"foul words here foul", b"nice words there", b"", b"foul", b"kind words and nice ones", b"here and there", b"fowl foul play", b"nice"] * 3
    labels = np.array([1, 0, 1, 1, 0, 0, 1, 0] * 3, float)
    s = toxicity.Settings(buckets=256, epochs=3, deviations=1.5, rate=0.7)
    weight, bias = toxicity.train(texts, labels, s)
    bags = [[b for w in t.split() for b in brute_buckets(w, s)] for t in texts]
    known = []
    for bucket in range(s.buckets):
        n, toxic = sum(bucket in b for b in bags), sum(y for b, y in zip(bags, labels, strict=True) if bucket in b)
        if toxic - n * 0.5 >= 1.5 * np.sqrt(n * 0.25 + 1):
            known.append(bucket)
    assert 0 < len(known) < s.buckets and known == np.flatnonzero(~np.isnan(weight)).tolist()
    rng = np.random.default_rng(s.seed)
    table = rng.normal(0, 0.1 / s.width, (len(known), s.width))
    out, b0 = rng.normal(0, 1 / np.sqrt(s.width), s.width), 0.0
    for epoch in range(s.epochs):
        rate = s.rate * (1 - epoch / s.epochs)
        for k in rng.permutation(len(texts)):
            own = [known.index(b) for b in bags[k] if b in known]
            if not own:
                b0 -= 0.01 * rate * (1 / (1 + np.exp(-b0)) - labels[k])
                continue
            x = {i: own.count(i) / len(own) for i in own}
            mean = sum(v * table[i] for i, v in x.items())
            error = 1 / (1 + np.exp(-(mean @ out + b0))) - labels[k]
            step = rate * error / (sum(v * v for v in x.values()) * (out @ out) + mean @ mean)
            for i, v in x.items():
                table[i] = table[i] - step * v * out
            out = out - step * mean
            b0 -= 0.01 * rate * error
    assert np.allclose(weight[known], table @ out, atol=1e-3) and abs(bias - b0) < 1e-4


def test_fitting_takes_a_document_once_and_no_null_ids(labelled):
    docs, labels, truth = labelled
    s = toxicity.Settings(sample_rows=100, epochs=1, buckets=1 << 12)
    plain = toxicity.fit(docs, labels, s)
    spark = docs.sparkSession
    again = docs.where("doc_id < 200").unionByName(docs.where("doc_id < 200")).unionByName(docs)
    more = labels.unionByName(spark.createDataFrame([(None, 1), (None, 0), (3, None)], "doc_id long, toxic int")).unionByName(labels.limit(50))
    weight, bias = toxicity.fit(again, more, s)
    assert bias == plain[1] and np.array_equal(weight, plain[0], equal_nan=True) and not np.isnan(weight).all()


def test_long_words_are_hashed_whole():
    s = toxicity.Settings()
    long = "語" * 60
    (_, short_b), (_, long_b) = toxicity.gram_buckets([long.encode()], s), toxicity.gram_buckets([(long + "zqxvk").encode()], s)
    inner = toxicity.gram_buckets([b"zqxvk"], s)[1]
    assert set(inner.tolist()) & (set(long_b.tolist()) - set(short_b.tolist()))
    # a weight on what follows the fortieth code point moves the score
    weight = np.zeros(s.buckets, np.float32)
    weight[inner] = 100
    low, high = toxicity.Scorer(weight, -1.0, s).scores([long.encode(), (long + "zqxvk").encode()])
    assert high > low


def test_training_reads_documents_to_their_end(spark):
    rng = random.Random(8)
    plain = [f"plain{k}" for k in range(40)]
    rows = []
    for k in range(120):  # toxic words come after word 900 alone
        words = [rng.choice(plain) for _ in range(1000)]
        if k % 2:
            words[950:960] = ["zqxvk"] * 10
        rows.append((k, " ".join(words), k % 2))
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    s = toxicity.Settings()
    weight, bias = toxicity.fit(data.select("doc_id", "text"), data.select("doc_id", "toxic"), s)
    toxic, clean = toxicity.Scorer(weight, bias, s).scores([b"plain1 plain2 zqxvk zqxvk zqxvk", b"plain1 plain2 plain3 plain4 plain5"])
    assert toxic > 0.5 > clean
    # rows alone bound the sample: a text of any length is learnt from
    longest = data.where("doc_id > 0").unionByName(data.where("doc_id = 1").selectExpr("doc_id - 1 as doc_id", "repeat(concat(text, ' '), 400) as text", "toxic"))
    assert toxicity.fit(longest.select("doc_id", "text"), longest.select("doc_id", "toxic"), s)[1] != bias
