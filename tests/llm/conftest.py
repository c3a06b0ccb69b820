import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row string, n_lines string"


def sentence(rng: random.Random, n: int) -> str:
    parts = ["ta", "ri", "mo", "né", "ß", "lu", "ka", "shi", "on", "der", "The", "and"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, shared passages and lines, and all kinds of odd texts; extra columns clash."""
    rng = random.Random(3)
    passage = sentence(rng, 30)
    line = "Shared Line, everywhere"
    texts = [sentence(rng, rng.randint(60, 160)) for _ in range(24)]
    texts += [texts[3], texts[3], texts[5].replace(" ", "  ")]  # copies
    near = texts[7].split()
    near[40] = "changed"
    texts.append(" ".join(near))  # a near copy
    texts += [sentence(rng, 20) + " " + passage + " " + sentence(rng, 20) for _ in range(4)]
    texts += [f"{sentence(rng, 9)}\n  {line if k % 2 else line.upper()} \n{sentence(rng, 60)}" for k in range(11)]
    texts += [None, "", " ", "\n\n", "x", "two words", "a b c", "é" * 60, "aaaa" * 400, ("word " * 70).strip(), ". ".join(["!"] * 60), "| a " * 80]
    texts.append(" ".join(sentence(rng, 50) for _ in range(60)))  # a long one
    out = [(k, t, "en", f"s{k % 4}" if k % 9 else None, len(t or ""), "clash", "clash", "clash") for k, t in enumerate(texts)]
    out.append((None, "a document without an id and " + passage, "en", "s1", 1, None, None, None))
    out.append(out[2])  # a repeated row
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
