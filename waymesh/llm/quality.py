"""Quality rules as a short-circuit cascade ordered by rejection per cost.

Rules are measured on a bounded sample: how long each takes and how many documents
it rejects. The cascade then runs them in the order of rejections per second, and a
document leaves at the first rule that rejects it. A document is kept if no rule
rejects it, so the measured order changes the time that is taken, never a verdict.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.llm.text import as_bytes

SYMBOLS = b"#*$%&|<>"


class Doc:
    """A text and its statistics, each computed when a rule first asks for it."""

    def __init__(self, data: bytes):
        self.data = data

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        joined = b"".join(self.words)
        return len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(self.data.count(c) for c in SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        """The lines with a word."""
        return [x for x in self.data.split(b"\n") if x and not x.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in three-word windows that the text has twice or more."""
        words = self.words
        windows = list(zip(words, words[1:], words[2:], strict=False))
        times = Counter(windows)
        if len(times) == len(windows):
            return 0
        again = np.fromiter((times[x] > 1 for x in windows), bool, len(windows))
        covered = np.zeros(len(words), bool)
        for shift in range(3):
            covered[shift : shift + len(again)] |= again
        return int(covered.sum())

    @cached_property
    def n_lettered(self) -> int:
        """Words with a letter; bytes outside ASCII count as letters."""
        return sum(1 for x in self.words if not x.isascii() or any(65 <= c <= 90 or 97 <= c <= 122 for c in x))


#: Name and rejection test of each rule. The thresholds leave ordinary prose well alone.
RULES: tuple[tuple[str, Callable[[Doc], bool]], ...] = (
    ("few_words", lambda d: d.n_words < 50),
    ("repeated_windows", lambda d: 100 * d.n_repeat_words > 50 * d.n_words),
    ("symbols", lambda d: 10 * d.n_symbols > 2 * d.n_words),
    ("duplicate_lines", lambda d: 3 * d.n_dup_lines > 2 * len(d.lines)),
    ("word_length", lambda d: not 2 * d.n_words <= d.word_chars <= 20 * d.n_words),
    ("letters", lambda d: 2 * d.n_lettered < d.n_words),
)
BASE = ("few_words", "repeated_windows")
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def cascade_order(docs: DataFrame, rules: Sequence = RULES, sample_rows: int = 500) -> list[tuple[str, float, float]]:
    """(rule, seconds a document, share rejected), best rejection per second first.

    Measured on a random sample of about `sample_rows` documents of the whole table,
    with their whole texts, where they lie: tasks return seconds and rejections of each
    rule. Rules that reject nothing come last, cheap ones first; without a sample the
    given order stays.
    """
    names = [name for name, _ in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, rejected, n = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for data in as_bytes(batch.column(0)):
                n += 1
                for k, (_, test) in enumerate(rules):
                    began = time.perf_counter()
                    rejected[k] += test(Doc(data or b""))
                    seconds[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(seconds), pa.array(rejected, pa.int64()), pa.array([n] * len(rules), pa.int64())], names=["rule", "seconds", "rejected", "n"])

    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = docs.select(F.col("text").cast("string").alias("text")).sample(share, seed=6)
    totals = sample.mapInArrow(run, "rule string, seconds double, rejected long, n long").groupBy("rule").agg(*(F.sum(c).alias(c) for c in ("seconds", "rejected", "n"))).collect()
    found = {r["rule"]: (r["seconds"] / r["n"], r["rejected"] / r["n"]) for r in totals if r["n"]}
    measured = [(name, *found.get(name, (0.0, 0.0))) for name in names]
    return sorted(measured, key=lambda x: (-x[2] / max(x[1], 1e-9), x[1]))


def judge(docs: DataFrame, rules: Sequence = RULES, sample_rows: int = 500, statistics: bool = False) -> DataFrame:
    """A row for each row of `docs`: `row`, a struct of all columns but the text, `text` and `kept`.

    With `statistics`, `row` has the doc_id alone, and STATISTICS and base_failed stand
    in for the text.

    A null text has no words. Rows are judged one by one, so repeated rows and ties
    need no rule, and an empty table gives an empty one.
    """
    order = [x[0] for x in cascade_order(docs, rules, sample_rows)]
    tests = [test for _, test in sorted(rules, key=lambda r: order.index(r[0]))]
    base = [test for name, test in rules if name in BASE]

    def verdict(data: bytes) -> tuple:
        doc = Doc(data)
        found = (*(getattr(doc, s) for s in STATISTICS), any(test(doc) for test in base)) if statistics else ()
        return (*found, not any(test(doc) for test in tests))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # one document's words at a time
            found = zip(*(verdict(data or b"") for data in as_bytes(batch.column(1))), strict=True) if batch.num_rows else [()] * len(kinds)
            columns = [pa.array(values, kind) for values, kind in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *([] if statistics else [batch.column(1)]), *columns], names=names)

    kinds = [*([pa.int64()] * len(STATISTICS) + [pa.bool_()] if statistics else []), pa.bool_()]
    names = ["row", *([*STATISTICS, "base_failed"] if statistics else ["text"]), "kept"]
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*(["doc_id"] if statistics else others)).alias("row"), F.col("text").cast("string").alias("text"))
    extra = ", ".join(f"{s} long" for s in STATISTICS) + ", base_failed boolean" if statistics else "text string"
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {extra}, kept boolean")


def keep_good(docs: DataFrame, rules: Sequence = RULES, sample_rows: int = 500) -> DataFrame:
    """The rows of `docs` that no rule rejects, with their columns, extra ones of any name too.

    A null or empty text has no words and is rejected; texts are read whole, rows are
    judged one by one, so that repeated ones stay or go together, and an empty table
    gives an empty one.
    """
    kept = judge(docs, rules, sample_rows).where("kept")
    return kept.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
#: DuckDB SQL for the verdicts on `documents`.
QUALITY_SQL = f"""
with d as (
  select doc_id, coalesce(text, '') as text, {_WORDS} as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from documents),
g as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from d where len(w) >= 3),
v as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as n from g),
c as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from v where n > 1) group by doc_id),
s as (
  select d.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, len(lines) as n_lines,
         coalesce(c.n_repeat_words, 0)::bigint as n_repeat_words,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\\x00-\\x7F]'))) as n_lettered
  from d left join c on c.doc_id is not distinct from d.doc_id),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or 10 * n_symbols > 2 * n_words or 3 * n_dup_lines > 2 * n_lines
            or word_chars < 2 * n_words or word_chars > 20 * n_words or 2 * n_lettered < n_words) as kept
from b
"""
