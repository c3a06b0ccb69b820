"""Exact document fingerprints of canonical text, with DataFrame functions only.

Canonical text is in Unicode's composed form (NFC), case-folded and has single
spaces. Its fingerprint is a 128-bit xxhash; documents of equal hash are compared
byte by byte, and where they differ the ones that are not the smallest get a longer
fingerprint.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.session import materialize

#: Stands for a null doc_id in keys; such rows come last in descending order.
NO_ID = -(1 << 63)
#: Hangul: first letters, vowels and last letters, the syllables, and how many letters there are of each.
LETTER, VOWEL, FINAL, SYLLABLE, VOWELS, FINALS, SYLLABLES = 0x1100, 0x1161, 0x11A7, 0xAC00, 21, 28, 11172
#: Before this code point no character changes by composition.
BEYOND = 0x300
#: Characters that stand for the combining classes 1 to 254 while marks are ordered.
RANKS = 0x10F000


class _Tables(NamedTuple):
    """What composition and case folding need, from the Unicode database.

    full: canonical decomposition of each character that has one, Hangul left out.
    pairs: for each character that composes with one before it, those and the results.
    rank: combining class of each mark. joins: characters that may change what stands
    before them; alone: others that do not stay as they are.
    """

    full: dict[str, str]
    pairs: dict[str, tuple[str, str]]
    rank: dict[str, int]
    joins: set[str]
    alone: set[str]


@cache
def _tables() -> _Tables:
    every = [chr(c) for c in range(sys.maxunicode + 1) if not SYLLABLE <= c < SYLLABLE + SYLLABLES and not 0xD800 <= c < 0xE000]
    full = {c: d for c in every if (d := unicodedata.normalize("NFD", c)) != c}
    rank = {c: r for c in every if (r := unicodedata.combining(c))}
    pairs: dict[str, tuple[str, str]] = {}
    for c in full:
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and unicodedata.normalize("NFC", c) == c:
            first, second = (chr(int(x, 16)) for x in parts)
            firsts, wholes = pairs.get(second, ("", ""))
            pairs[second] = (firsts + first, wholes + c)
    letters = {chr(c) for c in (*range(VOWEL, VOWEL + VOWELS), *range(FINAL + 1, FINAL + FINALS))}
    joins = {c for c in every if (d := full.get(c, c)[0]) in rank or d in pairs or d in letters}
    alone = {c for c in full if unicodedata.normalize("NFC", c) != c} - joins
    return _Tables(full, pairs, rank, joins, alone)


def _class(chars: set[str]) -> str:
    """The characters as ranges of a regular expression's character class."""
    runs: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs)


def _let(value: Column, f) -> Column:
    """f(value), with the value's expression in the plan once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _map(table: dict) -> Column:
    """The table as one constant of type map<string, string>."""
    return F.str_to_map(F.lit("\n".join(f"{k}\t{v}" for k, v in table.items())), F.lit("\n"), F.lit("\t"))


def _decomposed(char: Column) -> Column:
    """A character's full canonical decomposition, looked up place by place."""
    full = _tables().full
    places = []
    for k in range(max(map(len, full.values()))):
        # characters without a k-th part come last, which translate() takes for deletions
        having = sorted(full, key=lambda c: len(full[c]) <= k)
        places.append(F.translate(char, "".join(having), "".join(full[c][k] for c in having if len(full[c]) > k)))
    return F.when(places[0] != char, F.concat(*places)).otherwise(char)


def _rank(char: Column) -> Column:
    """The combining class of a character."""
    rank = _tables().rank
    # ranks travel as private characters; those of the text count as the letter a
    own = "".join(chr(RANKS + r) for r in range(1, 255))
    code = F.ascii(F.translate(char, own + "".join(rank), "a" * len(own) + "".join(chr(RANKS + r) for r in rank.values())))
    return F.when(code.between(RANKS + 1, RANKS + 254), code - RANKS).otherwise(0)


def _composite(first: Column, second: Column) -> Column:
    """What two characters compose to, or null."""
    pairs = _tables().pairs
    firsts = F.element_at(_map({k: v[0] for k, v in pairs.items()}), second)
    wholes = F.element_at(_map({k: v[1] for k, v in pairs.items()}), second)
    listed = _let(F.instr(firsts, first), lambda place: F.when(place > 0, F.substring(wholes, place, F.lit(1))))
    a, b = F.ascii(first), F.ascii(second)
    syllable = F.when(a.between(LETTER, LETTER + 18) & b.between(VOWEL, VOWEL + VOWELS - 1), SYLLABLE + ((a - LETTER) * VOWELS + b - VOWEL) * FINALS)
    syllable = syllable.when(a.between(SYLLABLE, SYLLABLE + SYLLABLES - 1) & ((a - SYLLABLE) % FINALS == 0) & b.between(FINAL + 1, FINAL + FINALS - 1), a + b - FINAL)
    hangul = F.decode(F.unhex(F.hex(syllable)), "UTF-16BE")
    return F.when(first != "", F.coalesce(listed, hangul))


def compose(text: Column) -> Column:
    """Text in NFC: characters are decomposed, marks ordered by class and composed with what they follow.

    Texts without a character that may change, nearly all, are only searched for one;
    in others, only the stretches around such characters are taken apart.
    """
    t = _tables()
    # Latin letters are told apart first
    joins, alone = (f"\\x{{{BEYOND:x}}}-\\x{{10FFFF}}&&[{_class(x)}]" for x in (t.joins, t.alone))

    def composed(piece: Column, head: Column) -> Column:
        chars = _chars(F.array_join(F.transform(_chars(head), _decomposed), ""))
        ranked = F.transform(chars, lambda c, i: F.struct(_rank(c).alias("rank"), i.alias("at"), c.alias("char")))
        start = F.struct(F.lit("").alias("out"), F.lit("").alias("base"), F.lit("").alias("tail"), F.lit(0).alias("rank"))
        done = F.aggregate(_let(ranked, ordered), start, step, lambda a: F.concat(a["out"], a["base"], a["tail"]))
        return F.when(head == "", piece).otherwise(F.concat(done, F.substring(piece, F.length(head) + 1, F.length(piece))))

    def ordered(ranked: Column) -> Column:
        # a character of class zero begins a run, within which marks are ordered
        run = lambda x: F.size(F.filter(F.slice(ranked, F.lit(1), x["at"] + 1), lambda y: y["rank"] == 0))
        return F.array_sort(F.transform(ranked, lambda x: F.struct(run(x).alias("run"), x["rank"].alias("rank"), x["at"].alias("at"), x["char"].alias("char"))))

    def step(acc: Column, x: Column) -> Column:
        state = lambda out, base, tail, rank: F.struct(out.alias("out"), base.alias("base"), tail.alias("tail"), rank.alias("rank"))
        free = (acc["tail"] == "") | (acc["rank"] < x["rank"])
        return _let(
            F.when(free, _composite(acc["base"], x["char"])),
            lambda whole: F.when(whole.isNotNull(), state(acc["out"], whole, acc["tail"], acc["rank"]))
            .when(x["rank"] == 0, state(F.concat(acc["out"], acc["base"], acc["tail"]), x["char"], F.lit(""), F.lit(0)))
            .otherwise(state(acc["out"], acc["base"], F.concat(acc["tail"], x["char"]), x["rank"])),
        )

    head = f"(?s)^(?:(?![{joins}]).[{joins}]+|[{alone}]|[{joins}]+)"
    # never between the two halves of a character outside the basic plane
    pieces = F.split(text, f"(?s)(?=.[{joins}])(?![{joins}])(?![\\x{{DC00}}-\\x{{DFFF}}])|(?=[{alone}])")
    return F.when(_has(text, t.joins | t.alone), F.array_join(F.transform(pieces, lambda piece: _let(F.regexp_extract(piece, head, 0), lambda x: composed(piece, x))), "")).otherwise(text)


def _has(text: Column, chars: set[str]) -> Column:
    """Whether the text has one of the characters; deleting them looks each character up once."""
    return F.translate(text, "".join(sorted(chars)), "") != text


@cache
def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """Full case folding, in NFC, of the characters that lower-casing leaves other than folded: all others, and those with an iota below."""
    lows = {c for k in range(sys.maxunicode + 1) if not 0xD800 <= k < 0xE000 for c in chr(k).lower()}
    folds = {c: unicodedata.normalize("NFC", c.casefold()) for c in sorted(lows)}
    folds = {c: f for c, f in folds.items() if f != unicodedata.normalize("NFC", c)}
    iota = {c for c in folds if "\u0345" in unicodedata.normalize("NFD", c)}
    return {c: f for c, f in folds.items() if c not in iota}, {c: folds[c] for c in iota}


def _replaced(text: Column, table: dict[str, str]) -> Column:
    """Text with characters replaced."""
    single, several = ({c: f for c, f in table.items() if (len(f) == 1) == one} for one in (True, False))
    by = F.array(*(F.struct(F.lit(c).alias("char"), F.lit(f).alias("by")) for c, f in sorted(several.items())))
    found = F.translate(text, "".join(single), "".join(single.values()))
    return _let(found, lambda x: F.when(_has(x, set(several)), F.aggregate(by, x, lambda acc, y: F.replace(acc, y["char"], y["by"]))).otherwise(x))


def canonical(text: Column) -> Column:
    """Case-folded, composed text with each run of white space as one space and none at its ends.

    Full case folding is lower case and what differs from it, sharp s and final sigma
    among them. An iota below, which orders as a mark but folds to a letter, is folded
    after composition, so that canonical caseless matches have one form.
    """
    folds, iota = _folds()
    # sharp s is the one fold that is frequent in texts that need no more than lower case
    low = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    folds = {c: f for c, f in folds.items() if c != "ß"}
    composed = compose(_replaced(low, folds))
    # beyond Latin letters anything may change, and of those only a few
    other = F.regexp_like(low, F.lit(f"[{_class({c for c in folds if c < chr(BEYOND)})}\\x{{{BEYOND:x}}}-\\x{{10FFFF}}]"))
    folded = F.when(other, _let(composed, lambda x: _iota_folded(x, iota))).otherwise(low)
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}\x85]+", " "))


def _iota_folded(text: Column, iota: dict[str, str]) -> Column:
    """Each character with an iota below becomes the one without, the marks that follow, and an iota."""
    chars = sorted(iota, key=lambda c: -len(iota[c]))  # the mark alone comes last and is deleted
    apart = F.regexp_replace(text, f"([{_class(set(iota))}])([{_class(set(_tables().rank) - iota.keys())}]*)", "$1$2ι")
    folded = F.translate(apart, "".join(chars), "".join(iota[c][:-1] for c in chars))
    return F.when(_has(text, iota.keys()), folded).otherwise(text)


def digest(canon: Column) -> Column:
    """Two xxhashes with different seeds as 32 hexadecimal digits."""
    half = [F.lpad(F.lower(F.hex(h)), 16, "0") for h in (F.xxhash64(canon), F.xxhash64(F.lit(1), canon))]
    return F.concat(*half)


def _next_in_order(keys: DataFrame) -> DataFrame:
    """Adds next_id, next_hash: the key that follows in descending id order, the first after the last.

    Keys are range-partitioned, each partition looks ahead within itself, and its last
    key is followed by the first one of the next partition that has any. Only those
    first keys, one for each partition, meet in one task.
    """
    dealt = materialize(keys.repartitionByRange(F.desc("id"), "hash").withColumn("part", F.spark_partition_id()))
    within = Window.partitionBy("part").orderBy(F.desc("id"), "hash")
    firsts = dealt.withColumn("place", F.row_number().over(within)).where("place = 1").select("part", "id", "hash")
    ahead, every = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = lambda c: F.coalesce(F.lead(c).over(ahead), F.first(c).over(every))
    # one row for each partition
    firsts = firsts.select("part", follow("id").alias("first_id"), follow("hash").alias("first_hash"))
    out = dealt.withColumns({"next_id": F.lead("id").over(within), "next_hash": F.lead("hash").over(within)}).join(F.broadcast(firsts), "part")
    last = F.col("next_hash").isNull()
    return out.withColumns({"next_id": F.when(last, F.col("first_id")).otherwise(F.col("next_id")), "next_hash": F.when(last, F.col("first_hash")).otherwise(F.col("next_hash"))}).drop("part", "first_id", "first_hash")


def fingerprint(docs: DataFrame) -> DataFrame:
    """Rows (id, hash, n_chars, fingerprint) with a row for each different (doc_id, text).

    id is the doc_id (NO_ID for null), hash the xxhash of the text as it is. Of equal
    digests whose canonical texts differ, all but the smallest text get the text's
    SHA-256 appended.
    """
    texts = _texts(docs)
    light = _digests(texts)
    return _told_apart(light, texts.dropDuplicates(["id", "hash"]))


def _texts(docs: DataFrame) -> DataFrame:
    """Rows (id, text, hash) as they are; only where texts are needed are repeated ones dropped."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"))
    return rows.withColumn("hash", F.xxhash64("text"))


def _digests(texts: DataFrame) -> DataFrame:
    """Rows (id, hash, n_chars, digest), each once; texts are digested where they are read."""
    light = texts.select("id", "hash", F.length("text").cast("long").alias("n_chars"), canonical(F.col("text")).alias("canon"))
    return materialize(light.select("id", "hash", "n_chars", digest(F.col("canon")).alias("digest")).dropDuplicates(["id", "hash"]))


def _told_apart(light: DataFrame, texts: DataFrame) -> DataFrame:
    """Fingerprints of digests after a comparison of the bytes inside equal ones."""
    shared = materialize(light.groupBy("digest").count().where("count > 1").select("digest"))
    alike = materialize(light.select("id", "hash", "digest").join(shared, "digest"))
    members = texts.join(alike, ["id", "hash"]).select("id", "hash", "digest", canonical(F.col("text")).alias("canon"))
    # tasks compare their own members first, so that a digest is one row for each of them
    bounds = members.groupBy("digest").agg(F.min("canon").alias("low"), F.max("canon").alias("high"))
    # buckets in which bytes differ: none but by a collision of 128-bit hashes
    split = materialize(bounds.where("low <> high").select("digest", "low"))
    if split.isEmpty():
        return light.select("id", "hash", "n_chars", F.col("digest").alias("fingerprint"))
    apart = members.join(split, "digest").where("canon <> low").select("id", "hash", F.concat(F.lit("-"), F.sha2("canon", 256)).alias("more"))
    return light.join(apart, ["id", "hash"], "left").select("id", "hash", "n_chars", F.concat("digest", F.coalesce("more", F.lit(""))).alias("fingerprint"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents and of their edited texts, and how alike they are.

    The edited text has its last floor(n_chars / 3) code points replaced by the first
    as many, or all, of the next document in descending doc_id order (after the last:
    the first). An exact fingerprint makes two texts alike (1.0) or not (0.0). Null
    texts are empty, a null doc_id comes last, and rows that repeat doc_id and text
    are one document with one row.
    """
    texts = _texts(docs)
    light = _digests(texts)
    follows = materialize(_next_in_order(light.select("id", "hash", "n_chars")))
    # one shuffle of the texts serves the comparison of bytes, the heads and the whole
    texts = texts.dropDuplicates(["id", "hash"])
    prints = _told_apart(light, texts).select("id", "hash", "fingerprint")
    light = follows.join(prints, ["id", "hash"])
    light = light.join(prints.toDF("next_id", "next_hash", "next_fingerprint"), ["next_id", "next_hash"])
    gone = F.floor(F.col("n_chars") / 3).cast("int")
    asked = follows.select(F.col("next_id").alias("id"), F.col("next_hash").alias("hash"), F.col("id").alias("for_id"), F.col("hash").alias("for_hash"), gone.alias("gone"))
    heads = texts.join(asked, ["id", "hash"]).select(F.col("for_id").alias("id"), F.col("for_hash").alias("hash"), F.substring(F.col("text"), F.lit(1), F.col("gone")).alias("head"))
    whole = texts.join(light, ["id", "hash"]).join(heads, ["id", "hash"])
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - gone), F.col("head"))
    whole = whole.select("id", "n_chars", "fingerprint", "next_fingerprint", canonical(F.col("text")).alias("canon"), edited.alias("edited"))
    whole = whole.withColumn("edited_canon", canonical(F.col("edited")))
    same = F.col("canon") == F.col("edited_canon")
    return whole.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        F.when(same, F.col("fingerprint")).otherwise(digest(F.col("edited_canon"))).alias("edited_fingerprint"),
        same.cast("double").alias("near_edited"),
        (F.col("fingerprint") == F.col("next_fingerprint")).cast("double").alias("near_next"),
    )
