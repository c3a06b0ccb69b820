"""Road networks and traces derived from the driver's tables, the same in Spark and in DuckDB.

A 25 x 25 grid of nodes comes from `nation`, with edges to the right and upwards.
Traces are random walks of the users of `events` in whole decimetres, so that sums
are exact in any order. A second network, the towns, grows with `orders`: each order is
a node, 40 to a row, moved about in whole metres; edges to the right and upwards skip
some orders, bend, are one-way or without length, and every 50 rows a new town begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("a"))
    grid = a.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"))))
    return grid.select(F.concat(F.lit("n"), "a", F.lit("_"), "b").alias("id"), (25 * F.col("b") + F.col("a")).alias("ord"), (100.0 * F.col("a")).alias("x"), (100.0 * F.col("b")).alias("y"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = nodes(spark, sf_dir).select((F.col("x") / 100).cast("long").alias("a"), (F.col("y") / 100).cast("long").alias("b"))
    ahead = F.array(F.struct(F.lit(0).cast("long").alias("k"), F.lit(1).alias("da"), F.lit(0).alias("db")), F.struct(F.lit(1).cast("long").alias("k"), F.lit(0).alias("da"), F.lit(1).alias("db")))
    ends = grid.withColumn("e", F.explode(ahead)).select("a", "b", "e.k", (F.col("a") + F.col("e.da")).alias("c"), (F.col("b") + F.col("e.db")).alias("d")).where("c < 25 and d < 25")
    number = 2 * (25 * F.col("b") + F.col("a")) + F.col("k")
    point = lambda x, y: F.struct((100.0 * F.col(x)).alias("x"), (100.0 * F.col(y)).alias("y"))
    return ends.select(
        number.alias("ord"), F.concat(F.lit("e"), number).alias("edge_id"), F.concat(F.lit("n"), "a", F.lit("_"), "b").alias("start_node_id"), F.concat(F.lit("n"), "c", F.lit("_"), "d").alias("end_node_id"),
        F.array(point("a", "b"), point("c", "d")).alias("polyline"),
    )


def town_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    place = lambda at, step: (100 * at + (k * step) % 41 - 20).cast("double")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("v"), k).alias("id"), k.alias("ord"), place(k % 40, 7919).alias("x"), place(F.floor(k / 40), 6007).alias("y"))


def town_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with osm_oneway and lane_count."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    k, c = F.col("k"), F.col("c")
    way = lambda j, ahead, when: F.when(when, F.struct(F.lit(j).alias("j"), (k + ahead).alias("to")))
    ways = F.array(way(0, 1, (k % 40 != 39) & (c % 9 != 0)), way(1, 40, (F.floor(k / 40) % 50 != 49) & (c % 7 != 0)), way(2, 0, k % 97 == 0))
    ends = rows.select("k", F.explode(F.array_compact(ways)).alias("w")).select("k", "w.j", "w.to")
    spots = town_nodes(spark, sf_dir).select("ord", F.struct("x", "y").alias("p"))
    ends = ends.join(spots.select(F.col("ord").alias("k"), F.col("p").alias("a")), "k").join(spots.select(F.col("ord").alias("to"), F.col("p").alias("b")), "to")
    bent = ((F.col("j") == 0) & (k % 3 == 0)) | ((F.col("j") == 1) & (k % 4 == 0))
    middle = F.struct(((F.col("a.x") + F.col("b.x")) / 2 + 25 * F.col("j")).alias("x"), ((F.col("a.y") + F.col("b.y")) / 2 + 30 * (1 - F.col("j"))).alias("y"))
    oneway = F.when((F.col("j") == 0) & (k % 5 == 0), "yes").when((F.col("j") == 0) & (k % 11 == 0), "-1")
    number = 3 * k + F.col("j")
    return ends.select(
        number.alias("ord"), F.concat(F.lit("r"), number).alias("edge_id"), F.concat(F.lit("v"), k).alias("start_node_id"), F.concat(F.lit("v"), "to").alias("end_node_id"),
        F.when(bent, F.array("a", middle, "b")).otherwise(F.array("a", "b")).alias("polyline"), oneway.alias("osm_oneway"), (1 + k % 3).cast("int").alias("lane_count"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id")
    walk = Window.partitionBy("user_id").orderBy("ts", "event_id")
    so_far = walk.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def place(factor: int, step: int):
        return F.pmod(F.col("user_id") * factor + F.sum((F.col("event_id") * step) % 401 - 200).over(so_far), F.lit(24000)) / 10.0

    ordinal = F.row_number().over(walk).cast("long")
    return events.select(
        F.col("user_id").cast("string").alias("trace_id"), ordinal.alias("ord"), (4.0 * ordinal).alias("t"), place(1709, 7919).alias("x"), place(911, 6007).alias("y"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("epoch"),
    )


#: The same as DuckDB common table expressions.
SQL = """
nodes as (
  select 'n' || a || '_' || b as id, 25 * b + a as ord, (100 * a)::double as x, (100 * b)::double as y, a, b
  from (select n_nationkey::bigint as a from nation), (select unnest(range(0, 25)) as b)),
edges as (
  select 2 * (25 * b + a) + k as ord, 'e' || (2 * (25 * b + a) + k) as edge_id, 'n' || a || '_' || b as start_node_id, 'n' || c || '_' || d as end_node_id,
         (100 * a)::double as x0, (100 * b)::double as y0, (100 * c)::double as x1, (100 * d)::double as y1
  from (select a, b, k, case when k = 0 then a + 1 else a end as c, case when k = 1 then b + 1 else b end as d from nodes, (select unnest([0, 1]) as k)) where c < 25 and d < 25),
walk as (
  select user_id, event_id, ts, row_number() over w as ord,
         user_id * 1709 + sum((event_id * 7919) % 401 - 200) over w as wx, user_id * 911 + sum((event_id * 6007) % 401 - 200) over w as wy
  from events window w as (partition by user_id order by ts, event_id rows unbounded preceding)),
samples as (
  select user_id::varchar as trace_id, ord, (4 * ord)::double as t, (((wx % 24000) + 24000) % 24000)::double / 10 as x, (((wy % 24000) + 24000) % 24000)::double / 10 as y,
         epoch_us(ts) / 1e6::double as epoch
  from walk)
"""

#: The towns as DuckDB common table expressions: legs are the segments of edges, tadj the edges in both directions.
TOWN_SQL = """
tn as (select 'v' || o_orderkey as id, o_orderkey as k, o_custkey as c, (100 * (o_orderkey % 40) + (o_orderkey * 7919) % 41 - 20)::double as x, (100 * (o_orderkey // 40) + (o_orderkey * 6007) % 41 - 20)::double as y from orders),
te as (
  select 3 * a.k + j as ord, 'r' || (3 * a.k + j) as edge_id, a.id as s, b.id as t, a.k as k, a.x as x0, a.y as y0, b.x as x1, b.y as y1, (a.x + b.x) / 2 + 25 * j as mx, (a.y + b.y) / 2 + 30 * (1 - j) as my,
         (j = 0 and a.k % 3 = 0) or (j = 1 and a.k % 4 = 0) as bent, case when j = 0 and a.k % 5 = 0 then 'yes' when j = 0 and a.k % 11 = 0 then '-1' end as oneway, (1 + a.k % 3)::int as lanes
  from (select *, unnest([0, 1, 2]) as j from tn) a join tn b on b.k = a.k + [1, 40, 0][j + 1]
  where (j = 0 and a.k % 40 <> 39 and a.c % 9 <> 0) or (j = 1 and (a.k // 40) % 50 <> 49 and a.c % 7 <> 0) or (j = 2 and a.k % 97 = 0)),
tl as (
  select *, case when bent then sqrt((mx - x0) ** 2 + (my - y0) ** 2) + sqrt((x1 - mx) ** 2 + (y1 - my) ** 2) else sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) end as len,
         case when bent then mx else x1 end as sx, case when bent then my else y1 end as sy, case when bent then mx else x0 end as tx, case when bent then my else y0 end as ty from te),
tadj as (select edge_id, s as u, t as v, 'forward' as direction, len, oneway, lanes from tl union all select edge_id, t, s, 'reverse', len, oneway, lanes from tl where s <> t)
"""

#: Samples with their nearest edge closer than 15 m (nulls without one), after SQL.
SNAP_SQL = (
    SQL
    + """,
hits as (
  select trace_id, s.ord, e.ord as edge_ord, edge_id, x0 + u * (x1 - x0) as qx, y0 + u * (y1 - y0) as qy, 100 * u as arc, x, y
  from (select s.trace_id, s.ord, s.x, s.y, e.*, greatest(0, least(1, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / 10000)) as u
        from samples s join (select ord as eord, edge_id, x0, y0, x1, y1 from edges) e
          on s.x between least(x0, x1) - 15 and greatest(x0, x1) + 15 and s.y between least(y0, y1) - 15 and greatest(y0, y1) + 15) s
  join (select ord, edge_id as eid from edges) e on e.eid = s.edge_id),
ranked as (
  select *, (x - qx) * (x - qx) + (y - qy) * (y - qy) as d2,
         row_number() over (partition by trace_id, ord order by (x - qx) * (x - qx) + (y - qy) * (y - qy), edge_ord) as rank
  from hits where (x - qx) * (x - qx) + (y - qy) * (y - qy) < 225),
snapped as (
  select s.*, r.edge_id, r.edge_ord, r.qx, r.qy, r.arc, sqrt(r.d2) as d
  from samples s left join (select * from ranked where rank = 1) r on r.trace_id = s.trace_id and r.ord = s.ord)
"""
)
