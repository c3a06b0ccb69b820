"""Mixing sources to target weights with exact word budgets.

Every document gets a hash-random key. Keys are uniform, so equal-width key ranges
(segments) within each source are its range partitions. Sums over segments and
running sums within them give each document's prefix sum, and each source is cut
where its budget is reached; a budget above the source's size repeats it first.
Only ids and sizes are shuffled, never text.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymesh.llm.text import WORD, n_words
from waymesh.session import materialize

KEY_BITS = 60
#: Weights of the sources in code point order, repeated as often as needed.
WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Rows (source, source_size, target) from rows (source, size).

    The sources, ordered by code point with null last, weigh `weights` in turn and
    share `share` times all sizes. A target stops at `most` times its source's size;
    what that leaves over is shared again by weight among the others. With the
    sources ordered by cap per weight, those below the first level that suffices are
    capped, so one pass over the (few) sources settles it.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    per = per.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("weight", weight)
    per = per.withColumn("cap", most * F.col("source_size"))
    ratio = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, every = ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total = share * F.sum("source_size").over(every)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("level", level)
    per = per.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(every)["level"])
    return per.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def hash_key(seed: str) -> F.Column:
    """A uniform 60-bit key of the doc_id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, taken), one for each row of `docs`.

    size: words of the text (null: 0). taken: words that the mix takes of it, repeats
    counted: whole epochs while the source's target, rounded down, allows, then
    documents in key order until it is reached, the last one in part. So a source's
    taken words differ from its target by less than one word. The same rows give the
    same mix; rows that repeat a doc_id are taken one after the other. Sources of
    size 0, null sources and null ids are mixed like any other; extra columns are
    dropped.
    """
    rows = materialize(docs.select("doc_id", "source", n_words("text").alias("size"), hash_key(seed).alias("key")))
    targets = source_targets(rows, weights, share, most)
    # about as many segments as each has rows, so that sums over and within them stay short
    segments = 1 << max(6, math.ceil(math.log2(max(1, rows.count())) / 2))
    rows = rows.withColumn("segment", F.shiftright("key", KEY_BITS - int(math.log2(segments))))
    sums = rows.groupBy("source", "segment").agg(F.sum("size").alias("segment_size"))
    earlier = Window.partitionBy("source").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "segment", F.coalesce(F.sum("segment_size").over(earlier), F.lit(0)).alias("base"))
    offsets = materialize(
        sums.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.source", "segment", "base", "source_size", "target")
    )
    within = Window.partitionBy("source", "segment").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
    same = F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.segment") == F.col("o.segment"))
    joined = rows.alias("r").join(offsets.alias("o"), same).select("doc_id", "r.source", "size", "source_size", "target", (F.col("base") + F.col("ahead")).alias("ahead"))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least("size", rest - F.col("ahead")))
    return joined.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """The mixed documents, with the columns of `docs`.

    A document of which the mix takes two epochs appears twice, one of which it takes
    nothing not at all, and the last one of a source with its first words only.
    Documents without words are not taken. Rows of one doc_id, source and size share
    what the mix takes of them all: those first in the order of their texts' hashes get
    the copies beyond the others'. Equal rows travel as one with their number.
    """
    keys = ["doc_id", "source", "size"]
    whole, rest = F.floor(F.col("taken") / F.col("size")).cast("int"), (F.col("taken") % F.col("size")).cast("int")
    taken = mix(docs, weights, share, most, seed).where("size > 0").withColumns({"whole": whole, "rest": rest}).groupBy(*keys)
    # epochs differ by one at most among documents of a source, and one of them is cut
    taken = taken.agg(F.count("*").alias("n"), F.min("whole").alias("least"), F.sum("whole").alias("all"), F.max("rest").alias("rest")).where("all > 0 or rest > 0")
    taken = materialize(taken.withColumn("more", F.col("all") - F.col("n") * F.col("least")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", n_words("text").alias("size"))
    same = F.col("r.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("r.source").eqNullSafe(F.col("t.source")) & (F.col("r.size") == F.col("t.size"))

    def joined(rows: DataFrame, taken: DataFrame) -> DataFrame:
        return rows.alias("r").join(taken.alias("t"), same).select("r.*", "n", "least", "more", "rest")

    single = joined(rows, taken.where("n = 1")).select("row", "size", "least", "rest", F.lit(1).alias("count"))
    several = taken.where("n > 1")
    if not several.isEmpty():
        # `more` of the rows get a copy more and the next one the cut copy
        equal = joined(rows, several).groupBy("row", *keys, "least", "more", "rest").agg(F.count("*").alias("count"))
        before = F.sum("count").over(Window.partitionBy(*keys).orderBy(F.xxhash64("row.text"), F.xxhash64("row")).rowsBetween(Window.unboundedPreceding, -1))
        equal = equal.withColumn("before", F.coalesce(before, F.lit(0)))
        high = F.greatest(F.lit(0), F.least("count", F.col("more") - F.col("before")))
        cut = (F.col("before") <= F.col("more")) & (F.col("more") < F.col("before") + F.col("count")) & (F.col("rest") > 0)
        parts = F.array(
            F.struct((F.col("least") + 1).alias("least"), F.lit(0).alias("rest"), high.alias("count")),
            F.struct(F.col("least").alias("least"), F.col("rest").alias("rest"), cut.cast("long").alias("count")),
            F.struct(F.col("least").alias("least"), F.lit(0).alias("rest"), (F.col("count") - high - cut.cast("long")).alias("count")),
        )
        equal = equal.select("row", "size", F.inline(parts)).where("count > 0").select("row", "size", "least", "rest", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("count"))
        single = single.unionByName(equal)
    # the words of each copy: whole copies first, then the part
    copies = F.concat(F.array_repeat(F.col("size").cast("int"), F.col("least")), F.array_repeat(F.col("rest"), F.when(F.col("rest") > 0, 1).otherwise(0)))
    out = single.select("row", "size", F.explode(copies).alias("words"))
    ends = F.split("row.text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    text = F.when(F.col("words") < F.col("size"), F.array_join(F.slice(ends, 1, F.col("words")), "")).otherwise(F.col("row.text"))
    return with_length(out.select(*(text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns)))


def with_length(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, as the length of the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


#: DuckDB SQL for the mix of `documents`.
MIX_SQL = f"""
with r as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as key
  from documents),
p as (
  select source, sum(size)::double as source_size,
         [3.0::double, 1.0::double, 2.0::double][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight
  from r group by source),
q as (
  select *, 2 * source_size as cap, 1.5::double * sum(source_size) over () as total, sum(weight) over () as weights,
         coalesce(sum(2 * source_size) over o, 0) as cap_before, coalesce(sum(weight) over o, 0) as weight_before
  from p window o as (order by 2 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)),
l as (select *, (total - cap_before) / (weights - weight_before) as level from q),
t as (
  select source, source_size, least(cap, weight * (
    select level from l order by case when level * weight <= cap then 0 else 1 end, cap / weight, source nulls last limit 1)) as target
  from l),
a as (
  select r.*, t.source_size, t.target,
         coalesce(sum(size) over (partition by r.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as ahead,
         case when t.source_size > 0 then floor(floor(t.target) / t.source_size) else 0 end as epochs
  from r join t on r.source is not distinct from t.source)
select doc_id, size, source_size::bigint as source_size, target,
       (epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - ahead)))::bigint as taken
from a
"""
