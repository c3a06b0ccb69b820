"""Fill-in-the-middle: a document's prefix, middle and suffix in an order that a model learns to fill from.

Units are words with the white space before them. Where a text is cut and which form
it takes depend on the seed and its doc_id alone, so reruns and retried tasks agree.
One Arrow-batched pandas UDF does the work: the ends of all units go to a compact
array, two lookups give the cuts, and the text is sliced twice.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Possessive, so that white space at the end of a text is read twice at most.
UNIT = regex.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++")
#: Marks before the prefix, the suffix and the middle; a text that contains one stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


@dataclass(frozen=True)
class Settings:
    """seed: of the draws. rate: percent of documents that are transformed. spm: percent of these with the suffix first."""

    seed: int = 42
    rate: int = 50
    spm: int = 80


def draws(doc_id: str | None, seed: int) -> tuple[int, ...]:
    """Four numbers below 2^32 for a doc_id in decimal; a null one counts as an empty string."""
    digest = hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4))


def transform(doc_id: str | None, text: str, s: Settings) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix and of the middle, output) of one text."""
    ends = array("I", [0])  # code points of a Spark string are fewer than 2^31
    ends.extend(unit.end() for unit in UNIT.finditer(text))
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(doc_id, s.seed)
    if not text or h3 % 100 >= s.rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends[low], ends[high]
    head, body, tail = PREFIX + text[:a], MIDDLE + text[a:b], SUFFIX + text[b:]
    form = "spm" if h4 % 100 < s.spm else "psm"
    return n, form, a, b - a, (tail + head if form == "spm" else head + tail) + body


def fill_in_middle(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """A row for each row of `docs`: `row`, a struct of all columns but the text, and the columns of SCHEMA.

    A null text counts as an empty one, which stays plain, as does a text with one of
    the marks. A null doc_id is drawn for as an empty string; rows that repeat a doc_id
    are cut by the same draws, each over its own units. Whole texts are cut, in batches
    of Arrow, and extra columns are in `row`, so their names clash with nothing. An
    empty table gives an empty one. No shuffle is needed.
    """

    @F.pandas_udf(SCHEMA)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            found = [transform(i, t or "", s) for i, t in zip(ids, texts, strict=True)]
            rows = pd.DataFrame(found, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            rows = rows.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})
            rows["output_sha256"] = [hashlib.sha256(x.encode()).hexdigest() for x in rows["output"]]
            yield rows

    row = F.struct(*(c for c in docs.columns if c != "text")).alias("row")
    # ids pass as text, so that a null among them turns none into a rounded number
    made = docs.select(row, cut(F.col("doc_id").cast("string"), F.col("text").cast("string")).alias("_made"))
    return made.select("row", "_made.*")


def restored(output: str | Column, form: str | Column) -> Column:
    """The text that an output was made from, by its form.

    No piece has a mark, and a mark cannot arise where a piece meets one, as it has its
    first character once; so the first place of each mark is where it was put.
    """
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    tail = output.substr(F.lit(len(PREFIX) + 1), F.length(output))

    def two(second: str) -> tuple[Column, Column, Column]:
        a = F.substring_index(tail, second, 1)
        rest = tail.substr(F.length(a) + len(second) + 1, F.length(tail))
        b = F.substring_index(rest, MIDDLE, 1)
        return a, b, rest.substr(F.length(b) + len(MIDDLE) + 1, F.length(rest))

    prefix, suffix, middle = two(SUFFIX)
    by_psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = two(PREFIX)
    return F.when(form == "psm", by_psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


#: DuckDB SQL for the outputs on `documents`.
INFILL_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(doc_id::varchar, '')) as h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u from documents),
r as (
  select *, len(u) as n, ('0x' || h[1:8])::bigint % (len(u) + 1) as k1, ('0x' || h[9:16])::bigint % (len(u) + 1) as k2,
         ('0x' || h[17:24])::bigint % 100 as k3, ('0x' || h[25:32])::bigint % 100 as k4 from d),
p as (
  select doc_id, t, n, array_to_string(u[1:least(k1, k2)], '') as a, array_to_string(u[least(k1, k2) + 1:greatest(k1, k2)], '') as b,
         array_to_string(u[greatest(k1, k2) + 1:], '') as c,
         case when t = '' or k3 >= 50 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') then 'plain' when k4 < 80 then 'spm' else 'psm' end as form from r)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(a)::bigint end as prefix_chars, case when form <> 'plain' then length(b)::bigint end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || a || '<S>' || c || '<M>' || b else '<S>' || c || '<P>' || a || '<M>' || b end) as output_sha256,
       sha256(t) as restored_sha256
from p
"""
