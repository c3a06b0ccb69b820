"""Queries over the driver's tables and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymesh.functions import geometry
from waymesh.operators import camera, compare, guidance, hd, image_lanes, incremental, lanes, matching, routing, spatial, topology, traces
from waymesh.plans import build
from waymesh.plans.views import SNAP_SQL, SQL, TOWN_SQL, edges, nodes, samples, town_edges, town_nodes
from waymesh.session import shuffle_partitions
from waymesh.sources import documents, lanelets

#: A camera 1.5 m above the ground that looks a little down.
_CAMERA = camera.Calibration(500.0, 500.0, 320.0, 240.0, mount=camera.rotation(0.0, 0.1, 0.0), shift=(0.0, 0.0, 1.5))

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query by its name, with the SQL that it is compared to."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of sums does not show."""
    return df.select(*(F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


# traces

@query(f"""with {SQL}, f as (select trace_id, ord, x, y, coalesce((sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2) > 20)::int, 0) as far
  from samples window w as (partition by trace_id order by ord))
select trace_id, ord, sum(far) over (partition by trace_id order by ord rows unbounded preceding)::bigint as segment from f""")
def traj_gap_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.gap_split(samples(spark, sf_dir), 20.0).select("trace_id", "ord", "segment")


_STOPS = """
fw as (select *, lead(t) over w as nt, sqrt((lead(x) over w - x) ** 2 + (lead(y) over w - y) ** 2) / (lead(t) over w - t) as speed from samples window w as (partition by trace_id order by ord)),
fl as (select *, coalesce(speed < {speed}, false) as slow from fw),
fr as (select *, sum((not slow)::int) over (partition by trace_id order by ord rows unbounded preceding) as run from fl),
rn as (select trace_id, run, min(ord) as first_ord, max(ord) + 1 as last_ord, min(t) as t_start, max(nt) as t_end from fr where slow group by trace_id, run),
stops as (select r.trace_id, first_ord, last_ord, t_start, t_end, t_end - t_start as duration,
                 (select avg(x) from samples s where s.trace_id = r.trace_id and s.ord between first_ord and last_ord) as x,
                 (select avg(y) from samples s where s.trace_id = r.trace_id and s.ord between first_ord and last_ord) as y
          from rn r where t_end - t_start >= {least})
"""


@query(f"""with {SQL}, {_STOPS.format(speed=3, least=8)}
select trace_id, first_ord, last_ord::bigint as last_ord, t_start, t_end, duration, round(x, 6) as x, round(y, 6) as y from stops""")
def traj_stop_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(traces.stop_windows(samples(spark, sf_dir), 3.0, 8.0))


_TRIPS = f"""{SNAP_SQL}, {_STOPS.format(speed=3, least=12)},
mk as (select distinct trace_id, unnest([first_ord, last_ord + 1]) as ord from stops),
br as (select s.*, (m.ord is not null or coalesce(sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2) > 25, false))::int as brk
       from snapped s left join mk m on m.trace_id = s.trace_id and m.ord = s.ord window w as (partition by s.trace_id order by s.ord)),
pt as (select *, sum(brk) over (partition by trace_id order by ord rows unbounded preceding) as part from br),
sq as (select *, sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2) as step,
              last_value(edge_id ignore nulls) over (partition by trace_id, part order by ord rows between unbounded preceding and 1 preceding) as prev
       from pt window w as (partition by trace_id, part order by ord)),
tp as (select trace_id, part, min(ord) as first_ord, max(ord) as last_ord, min(t) as t_start, max(t) as t_end, count(*) as samples, coalesce(sum(step), 0) as distance, count(edge_id) as matched_samples,
              coalesce(string_agg(case when edge_id is distinct from prev then edge_id end, '>' order by ord), '') as edge_sequence
       from sq group by trace_id, part having count(*) >= 3 and coalesce(sum(step), 0) >= 10),
trips as (select trace_id, row_number() over (partition by trace_id order by part) - 1 as trip, first_ord, last_ord, t_start, t_end, samples, distance, matched_samples, distance / (t_end - t_start) as mean_speed, edge_sequence from tp)
"""


def _trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.trips(samples(spark, sf_dir), edges(spark, sf_dir), max_gap_m=25.0, stop_speed=3.0, min_stop_s=12.0)


@query(f"with {_TRIPS} select trace_id, trip::int as trip, first_ord, last_ord, t_start, t_end, samples, round(distance, 6) as distance, matched_samples, round(mean_speed, 6) as mean_speed, edge_sequence from trips")
def traj_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_trips(spark, sf_dir).withColumn("edge_sequence", F.array_join("edge_sequence", ">")))


@query(f"""with {_TRIPS} select count(*) as trips, sum(samples)::bigint as samples, sum(matched_samples)::bigint as matched_samples, round(sum(distance), 4) as total_distance,
  round(avg(distance), 6) as mean_distance, round(avg(t_end - t_start), 6) as mean_duration from trips""")
def trip_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(traces.trip_summary(_trips(spark, sf_dir))).withColumn("total_distance", F.round("total_distance", 4))


# joins of samples and edges

@query(f"with {SNAP_SQL} select trace_id, ord, edge_id, round(qx, 6) as qx, round(qy, 6) as qy, round(arc, 6) as arc, round(d, 6) as d from snapped")
def snap_nearest_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.snap(samples(spark, sf_dir), edges(spark, sf_dir)).select("trace_id", "ord", "edge_id", "qx", "qy", "arc", "d"))


@query(f"with {SNAP_SQL} select trace_id, ord, rank, edge_id, round(sqrt(d2), 6) as d from ranked where rank <= 2")
def snap_topk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.candidates(samples(spark, sf_dir), edges(spark, sf_dir), 15.0, 2).select("trace_id", "ord", "rank", "edge_id", "d"))


@query(f"""with {SNAP_SQL} select count(*) as samples, count(edge_id) as matched, round(count(edge_id) / count(*), 6) as matched_ratio, count(distinct edge_id) as edges_touched,
  round(avg(d), 6) as mean_distance, round(max(d), 6) as max_distance from snapped""")
def snap_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.coverage(spatial.snap(samples(spark, sf_dir), edges(spark, sf_dir))))


@query(f"""with {SQL} select trace_id, ord, node_id, round(d, 6) as d from (
  select trace_id, s.ord, n.id as node_id, sqrt((s.x - n.x) ** 2 + (s.y - n.y) ** 2) as d,
         row_number() over (partition by trace_id, s.ord order by (s.x - n.x) ** 2 + (s.y - n.y) ** 2, n.ord) as r
  from samples s join nodes n on abs(s.x - n.x) <= 100 and abs(s.y - n.y) <= 100) where r = 1""")
def nearest_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = samples(spark, sf_dir).withColumn("key", F.struct("trace_id", "ord"))
    return rounded(spatial.nearest_nodes(points, nodes(spark, sf_dir), 50.0).select("key.trace_id", "key.ord", "node_id", "d"))


@query(f"""with {SNAP_SQL} select e.edge_id, count(distinct trace_id) as trace_count, count(trace_id) as sample_count, round(min(epoch), 3) as first_t, round(max(epoch), 3) as last_t
  from edges e left join snapped s on s.edge_id = e.edge_id group by e.edge_id""")
def fuse_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = samples(spark, sf_dir).withColumn("t", F.col("epoch"))
    return rounded(traces.fuse_traces(timed, edges(spark, sf_dir)), 3)


@query(f"with {SNAP_SQL} select edge_id, extract(hour from to_timestamp(epoch))::int as bin, count(*) as samples from snapped where edge_id is not null group by 1, 2")
def fuse_hour_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.observation_times(samples(spark, sf_dir).withColumn("t", F.col("epoch")), edges(spark, sf_dir))


@query(f"with {SNAP_SQL} select edge_id, (isodow(to_timestamp(epoch)) - 1)::int as bin, count(*) as samples from snapped where edge_id is not null group by 1, 2")
def fuse_weekday_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.observation_times(samples(spark, sf_dir).withColumn("t", F.col("epoch")), edges(spark, sf_dir), by="weekday")


@query(f"""with {SNAP_SQL}, f as (select edge_id, count(distinct trace_id) as n, count(*) as m from snapped where edge_id is not null group by 1)
select (select count(distinct trace_id) from samples) as traces, count(*) as edges_observed, sum(m)::bigint as matched_samples, sum(n)::bigint as edge_hits from f""")
def trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    return traces.trace_summary(s, traces.fuse_traces(s, edges(spark, sf_dir)))


@query(f"""with {SNAP_SQL}, f as (select e.edge_id, count(distinct trace_id) as n from edges e left join snapped s on s.edge_id = e.edge_id group by e.edge_id)
select count(*) filter (where n = 0) as never, count(*) filter (where n = 1) as once, count(*) filter (where n >= 2) as two_plus, count(*) filter (where n >= 5) as five_plus from f""")
def coverage_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.coverage_buckets(traces.fuse_traces(samples(spark, sf_dir), edges(spark, sf_dir)))


_CLASSES = f"""{SNAP_SQL},
sp as (select edge_id, lead(edge_id) over w as nx, sqrt((lead(x) over w - x) ** 2 + (lead(y) over w - y) ** 2) / (lead(t) over w - t) as v from snapped window w as (partition by trace_id order by ord)),
rk as (select edge_id, v, row_number() over (partition by edge_id order by v) - 1 as place, count(*) over (partition by edge_id) as n from sp where edge_id = nx and v <= 70),
classes as (select edge_id, n as samples, v as median_speed, case when v >= 6 then 'highway' when v >= 3 then 'arterial' else 'residential' end as road_class from rk where place = n // 2 and n >= 3)
"""


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.road_class(samples(spark, sf_dir), edges(spark, sf_dir), highway=6.0, arterial=3.0)


@query(f"with {_CLASSES} select edge_id, samples, round(median_speed, 6) as median_speed, road_class from classes")
def road_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_classes(spark, sf_dir))


@query(f"with {_CLASSES} select road_class, count(*) as edges from classes group by 1")
def road_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(spark, sf_dir).groupBy("road_class").agg(F.count("*").alias("edges"))


_EVENTS = f"""{SQL}, {_STOPS.format(speed=3, least=8)},
ev as (select trace_id, first_ord, duration, node_id, d from (
  select p.trace_id, first_ord, duration, n.id as node_id, sqrt((p.x - n.x) ** 2 + (p.y - n.y) ** 2) as d,
         row_number() over (partition by p.trace_id, first_ord order by (p.x - n.x) ** 2 + (p.y - n.y) ** 2, n.ord) as r
  from stops p join nodes n on abs(p.x - n.x) <= 40 and abs(p.y - n.y) <= 40) where r = 1 and d <= 40)
"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.stop_events(samples(spark, sf_dir), nodes(spark, sf_dir), 3.0, 8.0, 40.0)


@query(f"with {_EVENTS} select trace_id, first_ord, duration, node_id, round(d, 6) as d from ev")
def stop_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_events(spark, sf_dir))


@query(f"with {_EVENTS} select node_id, count(*) as stop_count, sum(duration) as stop_seconds from ev group by 1 having count(*) >= 2")
def signalized_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.signalized_junctions(_events(spark, sf_dir))


# the graph

@query(f"""with {SQL} select (select count(*) from nodes) as nodes, 0.0::double as x_min, 2400.0::double as x_max, 0.0::double as y_min, 2400.0::double as y_max, count(*) as edges,
  min(abs(x1 - x0) + abs(y1 - y0)) as min_m, median(abs(x1 - x0) + abs(y1 - y0)) as median_m, max(abs(x1 - x0) + abs(y1 - y0)) as max_m, sum(abs(x1 - x0) + abs(y1 - y0)) as total_m from edges""")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.graph_stats(nodes(spark, sf_dir), edges(spark, sf_dir))


_DEGREES = f"""{SQL},
ends as (select start_node_id as node_id from edges union all select end_node_id from edges),
deg as (select id, count(node_id) as degree from nodes left join ends on node_id = id group by id),
hints as (select id, degree, case when degree >= 3 then 'multi_branch' when degree = 1 then 'dead_end' else 'through_or_corner' end as junction_hint from deg)
"""


@query(f"with {_DEGREES} select * from hints")
def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.node_degrees(nodes(spark, sf_dir), edges(spark, sf_dir))


@query(f"with {_DEGREES} select id, case degree when 3 then 't_junction' when 4 then 'crossroads' end as junction_type from hints where degree >= 3")
def junction_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.junction_types(nodes(spark, sf_dir), edges(spark, sf_dir))


@query(f"""with {_DEGREES} select 'hint' as kind, junction_hint as label, count(*) as n from hints group by 2
  union all select 'type', case degree when 3 then 't_junction' when 4 then 'crossroads' end, count(*) from hints where degree >= 3 group by 2""")
def junction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir)
    return topology.junction_counts(topology.node_degrees(n, e), topology.junction_types(n, e))


_MANEUVERS = f"""{SQL},
vs as (select edge_id, false as reverse, end_node_id as node_id, x1 - x0 as vx, y1 - y0 as vy from edges union all select edge_id, true, start_node_id, x0 - x1, y0 - y1 from edges),
os as (select edge_id as out_id, start_node_id as node_id, x1 - x0 as ox, y1 - y0 as oy from edges union all select edge_id, end_node_id, x0 - x1, y0 - y1 from edges),
ag as (select v.edge_id, reverse, out_id, atan2(vx * oy - vy * ox, vx * ox + vy * oy) as g from vs v left join os o on o.node_id = v.node_id and out_id <> v.edge_id),
fl as (select edge_id, reverse, count(distinct out_id) as n, bool_or(abs(g) < 0.26) as ahead, bool_or(g >= 0.26 and abs(g) < pi() - 0.52) as l, bool_or(g <= -0.26 and abs(g) < pi() - 0.52) as r, coalesce(bool_or(abs(g) >= pi() - 0.52), false) as u from ag group by 1, 2),
mv as (select edge_id, reverse, 'straight' || case when l or (ahead and n >= 2 and r) then ',left' else '' end || case when r or (ahead and n >= 2 and l) then ',right' else '' end || case when u or n = 0 then ',u_turn' else '' end as maneuvers from fl)
"""


@query(f"with {_MANEUVERS} select * from mv")
def edge_maneuvers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.maneuvers(edges(spark, sf_dir)).withColumn("maneuvers", F.array_join("maneuvers", ","))


@query(f"""with {_MANEUVERS} select e.edge_id, start_node_id, end_node_id, 100.0::double as length_m, 2 as vertices, a.maneuvers as allowed, b.maneuvers as allowed_reverse
  from edges e join mv a on a.edge_id = e.edge_id and not a.reverse join mv b on b.edge_id = e.edge_id and b.reverse""")
def sd_nav_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.sd_nav_edges(edges(spark, sf_dir))


def _strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps of the traces, as edges that cross and double each other; steps over the map's rim, where walks go on at the other side, are none."""
    a = samples(spark, sf_dir)
    b = a.select("trace_id", (F.col("ord") - 1).alias("ord"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    out = a.join(b, ["trace_id", "ord"]).where("abs(x - x2) < 100 and abs(y - y2) < 100").withColumn("edge_id", F.concat("trace_id", F.lit("-"), "ord"))
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return out.select((F.col("trace_id").cast("long") * 1_000_000 + F.col("ord")).alias("ord"), "edge_id", F.array(point("x", "y"), point("x2", "y2")).alias("polyline"))


_STROKES = f"""{SQL},
st as (select a.trace_id::bigint * 1000000 + a.ord as ord, a.trace_id || '-' || a.ord as edge_id, a.x as x0, a.y as y0, b.x as x1, b.y as y1
       from samples a join samples b on b.trace_id = a.trace_id and b.ord = a.ord + 1 where abs(a.x - b.x) < 100 and abs(a.y - b.y) < 100)
"""


@query(f"""with {_STROKES}, pr as (
  select a.edge_id as edge_a, b.edge_id as edge_b, a.x0, a.y0, a.x1, a.y1, (a.x1 - a.x0) * (b.y1 - b.y0) - (a.y1 - a.y0) * (b.x1 - b.x0) as det,
         (b.x0 - a.x0) * (b.y1 - b.y0) - (b.y0 - a.y0) * (b.x1 - b.x0) as nt, (b.x0 - a.x0) * (a.y1 - a.y0) - (b.y0 - a.y0) * (a.x1 - a.x0) as nu
  from st a join st b on a.ord < b.ord and least(a.x0, a.x1) <= greatest(b.x0, b.x1) and greatest(a.x0, a.x1) >= least(b.x0, b.x1) and least(a.y0, a.y1) <= greatest(b.y0, b.y1) and greatest(a.y0, a.y1) >= least(b.y0, b.y1))
select edge_a, edge_b, round(x0 + nt / det * (x1 - x0), 6) as x, round(y0 + nt / det * (y1 - y0), 6) as y from pr
where abs(det) >= 1e-12 and nt / det > 1e-9 and nt / det < 1 - 1e-9 and nu / det > 1e-9 and nu / det < 1 - 1e-9""")
def segment_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.segment_crossings(_strokes(spark, sf_dir), 50.0).select("edge_a", "edge_b", "x", "y"))


@query(f"""with recursive {SQL.strip()}, p as (select trace_id::bigint * 1000000 + ord as key, x, y from samples),
pr as (select a.key as a, b.key as b from p a join p b on (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 64),
re as (select key as a, key as b from p union select re.a, pr.b from re join pr on pr.a = re.b),
cl as (select b as key, min(a) as rep from re group by b),
ct as (select rep, avg(x) as node_x, avg(y) as node_y, row_number() over (order by rep) - 1 as k from cl join p using (key) group by rep)
select key, 'n' || k as node, round(node_x, 6) as node_x, round(node_y, 6) as node_y from cl join ct using (rep)""")
def endpoint_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = samples(spark, sf_dir).select((F.col("trace_id").cast("long") * 1_000_000 + F.col("ord")).alias("key"), "x", "y")
    return rounded(spatial.endpoint_clusters(points, 8.0).select("key", "node", "node_x", "node_y"))


@query(f"""with {_STROKES}, pr as (select a.edge_id as edge_a, b.edge_id as edge_b,
  least(sqrt((a.x0 - b.x0) ** 2 + (a.y0 - b.y0) ** 2) + sqrt((a.x1 - b.x1) ** 2 + (a.y1 - b.y1) ** 2), sqrt((a.x0 - b.x1) ** 2 + (a.y0 - b.y1) ** 2) + sqrt((a.x1 - b.x0) ** 2 + (a.y1 - b.y0) ** 2)) as apart
  from st a join st b on a.ord < b.ord)
select edge_a, edge_b, round(apart, 6) as apart from pr where apart < 20""")
def near_parallel_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(topology.near_parallel_pairs(_strokes(spark, sf_dir), 10.0).drop("turned"))


@query(f"""with {_STROKES}, g as (select least(a, b) as a, greatest(a, b) as b, edge_id, ord, flip, x0, y0, x1, y1 from (
    select *, 'c' || (floor(x0 / 200)::bigint) || '_' || (floor(y0 / 200)::bigint) as a, 'c' || (floor(x1 / 200)::bigint) || '_' || (floor(y1 / 200)::bigint) as b,
           ('c' || (floor(x0 / 200)::bigint) || '_' || (floor(y0 / 200)::bigint)) > ('c' || (floor(x1 / 200)::bigint) || '_' || (floor(y1 / 200)::bigint)) as flip from st)),
f as (select *, first_value(flip) over w as f0, first_value(edge_id) over w as e0, count(*) over (partition by a, b) as n from g window w as (partition by a, b order by ord))
select e0 as edge_id, n as merged_edge_count, k::int as k, round(avg(case when flip = f0 or a = b then x0 + (x1 - x0) * k / 7 else x1 + (x0 - x1) * k / 7 end), 4) as x,
       round(avg(case when flip = f0 or a = b then y0 + (y1 - y0) * k / 7 else y1 + (y0 - y1) * k / 7 end), 4) as y
from f, (select unnest(range(0, 8)) as k) where n > 1 group by e0, n, k
union all select e0, n, k::int, round(case k when 0 then x0 else x1 end, 4), round(case k when 0 then y0 else y1 end, 4) from f, (select unnest([0, 1]) as k) where n = 1""")
def duplicate_edge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = lambda k: F.concat(F.lit("c"), F.floor(F.element_at("polyline", k)["x"] / 200).cast("long"), F.lit("_"), F.floor(F.element_at("polyline", k)["y"] / 200).cast("long"))
    strokes = _strokes(spark, sf_dir).withColumns({"start_node_id": node(1), "end_node_id": node(-1)})
    merged = topology.merge_duplicate_edges(strokes, 8)
    return rounded(merged.select("edge_id", "merged_edge_count", F.posexplode("polyline").alias("k", "p")).select("edge_id", "merged_edge_count", "k", "p.x", "p.y"), 4)


# routing

ORIGINS = ("n0_0", "n12_12", "n24_3")
_BACK = "select edge_id, end_node_id as u, start_node_id as v, 'reverse' as direction from edges"
_ADJ = f"""{SQL.strip()}, adj as (select edge_id, start_node_id as u, end_node_id as v, 'forward' as direction from edges union all {_BACK})"""
_REACHED = f"""{_ADJ}, rc as (select o.id as origin, n.id as node, abs(n.a - o.a) * 100.0::double + abs(n.b - o.b) * 100.0::double as cost from nodes o, nodes n)
"""


def _origins(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(o,) for o in ORIGINS], "origin string")


def _every(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select(F.col("id").alias("origin"))


def _start(origins: DataFrame) -> DataFrame:
    return origins.select("origin", F.col("origin").alias("state"), F.lit(0.0).alias("cost"))


@query(f"with {_REACHED} select origin, node, cost from rc where cost <= 550")
def reachable_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = routing.cheapest(routing.adjacency(edges(spark, sf_dir)), _start(_every(spark, sf_dir)), 550.0)
    return found.select("origin", F.col("state").alias("node"), "cost")


@query(f"with {_REACHED} select origin, edge_id, direction, cost as start_cost, least(1, (550 - cost) / 100)::double as fraction from rc join adj on adj.u = rc.node where cost < 550")
def reachable_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    adj = routing.adjacency(edges(spark, sf_dir))
    return routing.reachable_spans(adj, routing.cheapest(adj, _start(_every(spark, sf_dir)), 550.0), 550.0)


# of the cheapest routes on the grid, the one whose edges' names are smaller, read from the end
_PATHS = f"""{_ADJ},
og as (select id as origin, a as oa, b as ob from nodes where id in ('n0_0', 'n12_12', 'n24_3')),
lk as (
  select origin, a, b, case when h is null or v < h then v else h end as step, case when h is null or v < h then a else a - sign(a - oa)::bigint end as pa, case when h is null or v < h then b - sign(b - ob)::bigint else b end as pb
  from (select origin, oa, ob, a, b,
               case when a > oa then 'e' || (2 * (25 * b + a - 1)) || '/forward' when a < oa then 'e' || (2 * (25 * b + a)) || '/reverse' end as h,
               case when b > ob then 'e' || (2 * (25 * (b - 1) + a) + 1) || '/forward' when b < ob then 'e' || (2 * (25 * b + a) + 1) || '/reverse' end as v
        from og, nodes) where h is not null or v is not null),
wk as (
  select origin, a as ta, b as tb, a, b, 0 as hops, []::varchar[] as steps from og, nodes
  union all select wk.origin, ta, tb, pa, pb, hops + 1, list_prepend(step, steps) from wk join lk on lk.origin = wk.origin and lk.a = wk.a and lk.b = wk.b),
pth as (select origin, 'n' || ta || '_' || tb as to_node, max(hops) as hops, arg_max(steps, hops) as steps from wk group by 1, 2)
"""


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _origins(spark).select(F.col("origin").alias("from_node")).join(nodes(spark, sf_dir).select(F.col("id").alias("to_node")), F.lit(True))
    return routing.paths(routing.adjacency(edges(spark, sf_dir)), pairs)


@query(f"""with recursive {_PATHS} select origin as from_node, to_node, hops * 100.0::double as cost, hops::bigint as hops, array_to_string(steps, '>') as route from pth""")
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routes(spark, sf_dir).select("from_node", "to_node", "cost", F.size("edges").cast("long").alias("hops"), F.array_join("edges", ">").alias("route"))


def _one_way_rules(e: DataFrame) -> DataFrame:
    """Bans of turning round and of going on against an edge after one along it."""
    adj = routing.adjacency(e)
    a, b = adj.alias("a"), adj.alias("b")
    turn = a.join(b, F.col("a.v") == F.col("b.u")).where("a.edge_id = b.edge_id or (a.direction = 'forward' and b.direction = 'reverse')")
    return turn.select(F.col("a.v").alias("junction_node_id"), F.col("a.edge_id").alias("from_edge_id"), F.col("a.direction").alias("from_direction"), F.col("b.edge_id").alias("to_edge_id"), F.col("b.direction").alias("to_direction"), F.lit("no_turn").alias("restriction"))


_FACTS = "fx as (select edge_id, case when ord % 3 = 0 then 2 else 0 end as trace_count, (ord % 5 - 2)::double as slope, case when ord % 7 = 0 then 0.2::double when ord % 7 < 4 then 0.9::double end as conf from edges)"


@query(f"""with {_ADJ}, {_FACTS}, sl as (select adj.*, trace_count, conf, slope * case when direction = 'forward' then 1 else -1 end as s from adj join fx using (edge_id))
select edge_id, direction, round(100 * case when trace_count > 0 then 0.5::double else 2 end * (1 + case when s > 0 then s * 0.1::double else -s * 0.05::double end), 6) as cost from sl where conf is null or conf >= 0.5""")
def weighted_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    r = F.col("ord") % 7
    facts = e.select("edge_id", F.when(F.col("ord") % 3 == 0, 2).otherwise(0).alias("trace_count"), (F.col("ord") % 5 - 2).cast("double").alias("slope_deg"), F.when(r == 0, 0.2).when(r < 4, 0.9).alias("confidence"))
    return rounded(routing.weighted(routing.adjacency(e), facts, uphill=0.1, downhill=0.05, min_confidence=0.5).select("edge_id", "direction", "cost"))


@query(f"""with recursive {_ADJ}, mv as (
  select a.edge_id || '/' || a.direction as u, b.edge_id || '/' || b.direction as v from adj a join adj b on a.v = b.u
  where not (a.edge_id = b.edge_id) and not (a.direction = 'forward' and b.direction = 'reverse')),
wk as (
  select u as origin, edge_id || '/' || direction as state, 1 as hops from adj
  union select origin, mv.v, hops + 1 from wk join mv on mv.u = wk.state where hops < 5)
select origin, node, min(cost) as cost from (
  select origin, adj.v as node, hops * 100.0::double as cost from wk join adj on adj.edge_id || '/' || adj.direction = state union all select id, id, 0 from nodes) group by 1, 2""")
def restricted_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return routing.restricted_costs(e, _one_way_rules(e), _every(spark, sf_dir), 500.0)


@query(f"""with recursive {_ADJ}, ln as (select adj.*, 1 + e.ord % 3 as n, unnest(range(0, 1 + e.ord % 3)) as lane from adj join edges e using (edge_id)),
wk as (
  select u as origin, v as node, lane, 100.0::double as cost from ln
  union select origin, v, ln.lane, cost + 100 + case when ln.n > 1 and ln.lane <> wk.lane then 50 else 0 end from wk join ln on ln.u = wk.node where cost + 100 + case when ln.n > 1 and ln.lane <> wk.lane then 50 else 0 end <= 400)
select origin, node, lane::int as lane, min(cost) as cost from wk group by 1, 2, 3 union all select id, id, null, 0 from nodes""")
def lane_level_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return routing.lane_costs(e, e.select("edge_id", (1 + F.col("ord") % 3).cast("int").alias("lane_count")), _every(spark, sf_dir), 400.0)


@query(f"""with r as (select o_orderkey % 500 as k, o_orderkey as pos, (o_orderkey % 3)::int as src, o_orderpriority as restriction from orders),
f as (select *, row_number() over (partition by k order by src, pos) as n from r)
select 'tr' || k as id, restriction from f where n = 1""")
def turn_restriction_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("tr"), F.col("o_orderkey") % 500).alias("id"), F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") % 3).alias("src"), F.col("o_orderpriority").alias("restriction"))
    return routing.merge_restrictions(*(rows.where(F.col("src") == k).drop("src") for k in range(3)))


# lanes and points

_POINTS = f"""{SQL}, pts as (select key, min(x) as x, min(y) as y, min(z) as z from (select l_orderkey * 10 + l_linenumber as key, ((l_orderkey * 7919 + l_linenumber * 131) % 24000)::double / 10 as x,
  ((l_partkey * 6007 + l_linenumber * 17) % 24000)::double / 10 as y, ((l_suppkey * 31 + l_linenumber) % 100)::double / 100 as z from lineitem) group by key)"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), (((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 131) % 24000) / 10.0).cast("double").alias("x"),
        (((F.col("l_partkey") * 6007 + F.col("l_linenumber") * 17) % 24000) / 10.0).cast("double").alias("y"), (((F.col("l_suppkey") * 31 + F.col("l_linenumber")) % 100) / 100.0).cast("double").alias("z"),
    ).groupBy("key").agg(*(F.min(c).alias(c) for c in "xyz"))


@query(f"""with {_POINTS}, pr as (
  select e.edge_id, x, y, (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0) as cr, greatest(0, least(1, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / 10000)) as u, x0, y0, x1, y1
  from pts join edges e on x between least(x0, x1) - 5 and greatest(x0, x1) + 5 and y between least(y0, y1) - 5 and greatest(y0, y1) + 5)
select edge_id, case when cr > 0 then 'left' else 'right' end as side, least(31, floor(u * 32))::int as bin, round(median(x), 6) as x, round(median(y), 6) as y, count(*) as n
from pr where cr <> 0 and (x - x0 - u * (x1 - x0)) ** 2 + (y - y0 - u * (y1 - y0)) ** 2 <= 25 group by 1, 2, 3""")
def lidar_side_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lanes.side_bins(_points(spark, sf_dir), edges(spark, sf_dir)))


@query(f"with {_POINTS} select key, round(0.6::double * y + 0.8::double * z - 700, 6) as h from pts where 0.6::double * y + 0.8::double * z - 700 between 0 and 3")
def height_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lanes.height_band(_points(spark, sf_dir), (0.0, 0.6, 0.8, 700.0), 0.0, 3.0).select("key", "h"))


@query()
def ground_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([lanes.ground_plane(_points(spark, sf_dir))], "a double, b double, c double, d double")


_VALUES = "vs as (select 'e' || (l_orderkey % 1200) as edge_id, ((l_partkey * 37 + l_linenumber * 11) % 140 - 70)::double / 10 as value, l_orderkey % 3 as kind from lineitem)"


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.concat(F.lit("e"), F.col("l_orderkey") % 1200).alias("edge_id"), (((F.col("l_partkey") * 37 + F.col("l_linenumber") * 11) % 140 - 70) / 10.0).cast("double").alias("offset"), (F.col("l_orderkey") % 3).alias("kind"),
    )


@query(f"""with {_VALUES}, g as (select *, coalesce((value - lag(value) over w > 0.8)::int, 0) as wide from vs window w as (partition by edge_id order by value)),
c as (select edge_id, value, sum(wide) over (partition by edge_id order by value rows unbounded preceding) as cluster from g)
select edge_id, cluster::bigint as cluster, round(avg(value), 6) as mean, count(*) as n from c group by 1, 2""")
def lane_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lanes.clusters_1d(_values(spark, sf_dir), "edge_id", "offset", 0.8)
    return rounded(found.groupBy("edge_id", "cluster").agg(F.avg("offset").alias("mean"), F.count("*").alias("n")))


def _cluster_sql(kind: int, name: str) -> str:
    return f"""{name} as (select edge_id, max(c) + 1 as {name} from (select edge_id, sum(w) over (partition by edge_id order by value rows unbounded preceding) as c from (
      select *, coalesce((value - lag(value) over (partition by edge_id order by value) > 0.8)::int, 0) as w from vs where kind = {kind})) group by 1)"""


@query(f"""with {SQL}, {_VALUES}, {_cluster_sql(0, "m")}, {_cluster_sql(1, "o")}
select e.edge_id, greatest(1, least(6, case when m is not null then greatest(1, m - 1) when e.ord % 4 = 0 then 2 when o is not null then o else 1 end))::int as lane_count,
       case when m is not null then 'lane_markings' when e.ord % 4 = 0 then 'osm_lanes' when o is not null then 'trace_offsets' else 'default' end as source
from edges e left join m on m.edge_id = e.edge_id left join o on o.edge_id = e.edge_id""")
def lane_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = _values(spark, sf_dir), edges(spark, sf_dir)
    tags = e.where("ord % 4 = 0").select("edge_id", F.lit(2).alias("osm_lanes"))
    return hd.lane_inferences(e, v.where("kind = 0"), tags, v.where("kind = 1"), gap=0.8).select("edge_id", "lane_count", "source")


@query(f"""with {SQL}, {_VALUES}, es as (select edge_id, kind, avg(abs(value) + 0.5) as w, count(*) as b from vs group by 1, 2),
pe as (select edge_id, avg(w) as w, sum(b) as b, count(*) as n from es group by 1)
select e.edge_id, round(coalesce(w, 1.75), 6) as half_width, round(least(coalesce(n, 0), 3) / 3.0::double * (1 - exp(-coalesce(b, 0) / 10.0::double)), 4) as confidence, coalesce(n, 0) as sources
from edges e left join pe on pe.edge_id = e.edge_id""")
def hd_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _values(spark, sf_dir).groupBy("edge_id", F.col("kind").cast("string").alias("source")).agg(F.avg(F.abs("offset") + 0.5).alias("half_width"), F.lit(None).cast("double").alias("offset"), F.count("*").alias("bins"))
    found = hd.refinements(edges(spark, sf_dir), per)
    return rounded(found.select("edge_id", "half_width", "confidence", F.size("sources").alias("sources")))


@query("""with n as (select p_partkey, (p_size % 6 + 1) as c from part)
select p_partkey, i::int as lane, round(((c - 1) / 2.0::double - i) * 3.5, 6) as lane_offset from n, lateral (select unnest(range(0, c)) as i)""")
def lane_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_size") % 6 + 1).alias("c"))
    return rounded(rows.select("p_partkey", F.posexplode(lanes.lane_offsets(F.col("c"), 3.5)).alias("lane", "lane_offset")))


@query("""with p as (select l_orderkey, l_linenumber, ((l_partkey % 640) - 320)::double / 500 as r, ((l_suppkey % 48) * 10 - 240)::double / 500 as d, (l_orderkey % 628)::double / 100 as yaw from lineitem),
q as (select *, cos(0.1::double) - d * sin(0.1::double) as ahead, -(sin(0.1::double) + d * cos(0.1::double)) as up from p),
s as (select *, case when abs(up) >= 1e-9 and -1.5::double / up > 0 then -1.5::double / up end as k from q)
select l_orderkey, l_linenumber, round(k * (ahead * cos(yaw) + r * sin(yaw)), 6) as gx, round(k * (ahead * sin(yaw) - r * cos(yaw)), 6) as gy from s where k is not null""")
def camera_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    zero = F.lit(0.0)
    turned = camera.rotation(zero, zero, (F.col("l_orderkey") % 628) / 100.0)
    gx, gy = camera.pixel_on_ground((F.col("l_partkey") % 640).cast("double"), ((F.col("l_suppkey") % 48) * 10).cast("double"), _CAMERA, (zero, zero, zero), turned)
    return rounded(rows.select("l_orderkey", "l_linenumber", gx.alias("gx"), gy.alias("gy")).where("gx is not null"))


@query(f"""with {SQL}, s as (select trace_id, ord, x, y, sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2) as step from samples window w as (partition by trace_id order by ord)),
a as (select *, sum(coalesce(step, 0)) over (partition by trace_id order by ord rows unbounded preceding) as s, sum(coalesce(step, 0)) over (partition by trace_id) as total,
             first_value(x) over v as fx, first_value(y) over v as fy, last_value(x) over v as lx, last_value(y) over v as ly
      from s window v as (partition by trace_id order by ord rows between unbounded preceding and unbounded following)),
w as (select *, exp(-0.5::double * ((s - total * k / 9) / case when total > 0 then total / 10 else 1 end) ** 2) as w from a, (select unnest(range(0, 10)) as k))
select trace_id, k::int as k, round(case k when 0 then any_value(fx) when 9 then any_value(lx) else sum(w * x) / sum(w) end, 4) as x, round(case k when 0 then any_value(fy) when 9 then any_value(ly) else sum(w * y) / sum(w) end, 4) as y from w group by trace_id, k""")
def centerline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lanes.centerlines(samples(spark, sf_dir), ["trace_id"], 10), 4)


@query()
def rdp_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.transform(F.array_sort(F.collect_list(F.struct("ord", "x", "y"))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))
    lines = samples(spark, sf_dir).groupBy("trace_id").agg(order.alias("polyline"))
    return lanes.simplify(lines, 20.0).select("trace_id", F.size("polyline").alias("points"))


@query("""with p as (select s_suppkey, (s_suppkey * 37 % 2000 - 1000)::double as x, (s_suppkey * 53 % 2000 - 1000)::double as y from supplier)
select s_suppkey, round(x, 6) as x, round(y, 6) as y, round(13.4::double + degrees(x / (6371000 * cos(radians(52.5::double)))), 9) as lon, round(52.5::double + degrees(y / 6371000), 9) as lat from p""")
def lonlat_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", (F.col("s_suppkey") * 37 % 2000 - 1000).cast("double").alias("x0"), (F.col("s_suppkey") * 53 % 2000 - 1000).cast("double").alias("y0"))
    lon, lat = geometry.metres_to_lonlat(F.col("x0"), F.col("y0"), 52.5, 13.4)
    rows = rows.withColumns({"lon": lon, "lat": lat})
    x, y = geometry.lonlat_to_metres(F.col("lon"), F.col("lat"), 52.5, 13.4)
    return rows.select("s_suppkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))


@query(f"""with {SQL}, ln as (select trace_id || '-' || ord as line_id, list_value((x, y), (lead(x) over w, lead(y) over w)) as p, x, y, lead(x) over w as zx, lead(y) over w as zy from samples window w as (partition by trace_id order by ord)),
vt as (select line_id, unnest([1, 2]) as k, unnest([x, zx]) as x, unnest([y, zy]) as y from ln where zx is not null),
ht as (select line_id, k, e.ord, e.edge_id from vt v join edges e on v.x between least(x0, x1) - 12 and greatest(x0, x1) + 12 and v.y between least(y0, y1) - 12 and greatest(y0, y1) + 12
  where (v.x - x0 - greatest(0, least(1, ((v.x - x0) * (x1 - x0) + (v.y - y0) * (y1 - y0)) / 10000)) * (x1 - x0)) ** 2
      + (v.y - y0 - greatest(0, least(1, ((v.x - x0) * (x1 - x0) + (v.y - y0) * (y1 - y0)) / 10000)) * (y1 - y0)) ** 2 <= 144),
fu as (select line_id, ord, edge_id from ht group by 1, 2, 3 having count(distinct k) = 2)
select l.line_id, (select arg_min(edge_id, ord) from fu where fu.line_id = l.line_id) as edge_id from ln l where zx is not null""")
def incremental_absorb(spark: SparkSession, sf_dir: str) -> DataFrame:
    walk = Window.partitionBy("trace_id").orderBy("ord")
    rows = samples(spark, sf_dir).withColumns({"zx": F.lead("x").over(walk), "zy": F.lead("y").over(walk)}).where("zx is not null")
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    lines = rows.select(F.concat("trace_id", F.lit("-"), "ord").alias("line_id"), F.array(point("x", "y"), point("zx", "zy")).alias("polyline"))
    return incremental.absorb(lines, edges(spark, sf_dir), 12.0)


@query(f"""with recursive {_PATHS},
st as (select origin, to_node, hops, generate_subscripts(steps, 1) - 1 as k, unnest(steps) as step from pth where hops > 0),
hd as (select *, split_part(step, '/', 1) as edge_id, (case when substr(split_part(step, '/', 1), 2)::bigint % 2 = 0 then 0 else 90 end + case when step like '%reverse' then 180 else 0 end) as heading from st),
ch as (select *, ((heading - lag(heading) over (partition by origin, to_node order by k) + 540) % 360) - 180 as change from hd)
select origin as from_node, to_node, k::int as k, edge_id, k * 100.0::double as start_m, 100.0::double as length_m,
       case when k = 0 then 'depart' when k = hops - 1 then 'arrive' when change = 90 then 'left' when change = -90 then 'right' else 'straight' end as maneuver from ch""")
def guidance_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = guidance.guidance(_routes(spark, sf_dir), edges(spark, sf_dir))
    return found.select("from_node", "to_node", "k", "edge_id", "start_m", "length_m", "maneuver")


@query()
def hmm_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.hmm_match(samples(spark, sf_dir), edges(spark, sf_dir))


_LON, _LAT = ("{lon} + degrees({x} / (6371000 * cos(radians(52.5::double))))".replace("{lon}", "13.4::double"), "52.5::double + degrees({y} / 6371000)")


@query(f"""with {SQL}, n as (select max(ord) + 2 as base from nodes),
p as (select ord, k, x, y from (select ord, unnest([0, 1]) as k, unnest([x0, x1]) as x, unnest([y0, y1]) as y from edges))
select 0 as part, ord, '  <node id="' || (ord + 1) || '" lat="' || printf('%.9f', {_LAT.format(y="y")}) || '" lon="' || printf('%.9f', {_LON.format(x="x")}) || '"><tag k="graph_node_id" v="' || id || '"/></node>' as value from nodes
union all select 1, base + 3 * ord + k, '  <node id="' || (base + 3 * ord + k) || '" lat="' || printf('%.9f', {_LAT.format(y="y")}) || '" lon="' || printf('%.9f', {_LON.format(x="x")}) || '"/>' from p, n
union all select 2, ord, '  <way id="' || (base + 3 * ord + 2) || '"><nd ref="' || (base + 3 * ord) || '"/><nd ref="' || (base + 3 * ord + 1) || '"/><tag k="type" v="line_thin"/><tag k="edge_id" v="' || edge_id || '"/></way>' from edges, n""")
def osm_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.osm_xml(nodes(spark, sf_dir), edges(spark, sf_dir), 52.5, 13.4)


@query(f"""with {SQL}, f as (
  select 'node' as layer, id as key, x, y, 1 as points from nodes union all select 'centerline', edge_id, x0, y0, 2 from edges
  union all select unnest(['lane_boundary_left', 'lane_boundary_right']), edge_id, x0 - unnest([1.75, -1.75]::double[]) * (y1 - y0) / 100, y0 + unnest([1.75, -1.75]::double[]) * (x1 - x0) / 100, 2 from edges
  union all select 'trajectory', trace_id, arg_min(x, ord), arg_min(y, ord), count(*) from samples group by 2 having count(*) >= 2)
select layer, key, round({_LON.format(x="x")}, 9) as lon, round({_LAT.format(y="y")}, 9) as lat, points::int as points from f""")
def map_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = hd.enrich(nodes(spark, sf_dir), edges(spark, sf_dir), 3.5)
    rows = documents.map_features(n, e, samples(spark, sf_dir), 52.5, 13.4, "grid")
    get = lambda path: F.get_json_object("value", f"$.{path}")
    line = F.from_json(get("geometry.coordinates"), "array<array<double>>")
    spot = F.from_json(get("geometry.coordinates"), "array<double>")
    at = lambda k: F.when(F.col("layer") == "node", spot[k]).otherwise(line[0][k])
    key = F.coalesce(get("properties.node_id"), get("properties.edge_id"), get("properties.trace_id"))
    return rounded(rows.select("layer", key.alias("key"), at(0).alias("lon"), at(1).alias("lat"), F.when(F.col("layer") == "node", 1).otherwise(F.size(line)).alias("points")), 9)


@query(f"""with {SQL}, rim as (select distinct a * 100.0::double as c from nodes)
select (100 * a)::double as x, (100 * b)::double as y, 4::bigint as degree, 'crossroads' as junction_type from nodes
union all select unnest([c, c, -20, 2420]), unnest([-20, 2420, c, c]), 1, null from rim""")
def grid_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).select(F.col("x").alias("c")).distinct()
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    low, high = F.lit(-20.0), F.lit(2420.0)
    rows = n.select(F.concat(F.lit("h"), "c").alias("line"), F.array(point(low, F.col("c")), point(high, F.col("c"))).alias("polyline"))
    columns = n.select(F.concat(F.lit("v"), "c").alias("line"), F.array(point(F.col("c"), low), point(F.col("c"), high)).alias("polyline"))
    built = build.assemble(rows.unionByName(columns))
    return rounded(built["nodes"].select("x", "y", "degree", "junction_type"))


# lane-level geometry

_TRACE_LINES = f"""{SQL},
vt as (select trace_id, ord, x, y, lag(x) over w as px, lag(y) over w as py, lead(x) over w as nx, lead(y) over w as ny from samples window w as (partition by trace_id order by ord)),
vl as (select *, sqrt((x - px) ** 2 + (y - py) ** 2) as lu, sqrt((nx - x) ** 2 + (ny - y) ** 2) as lv from vt)
"""


def _trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.transform(F.array_sort(F.collect_list(F.struct("ord", "x", "y"))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))
    return samples(spark, sf_dir).groupBy("trace_id").agg(order.alias("polyline"))


@query(f"""with {_TRACE_LINES},
nm as (select *, case when lu < 1e-12 then 0 else -(y - py) / lu end as ux, case when lu < 1e-12 then 0 else (x - px) / lu end as uy, case when lv < 1e-12 then 0 else -(ny - y) / lv end as vx, case when lv < 1e-12 then 0 else (nx - x) / lv end as vy from vl),
en as (select trace_id, ord, x, y, coalesce(ux, 0) as ux, coalesce(uy, 0) as uy, coalesce(vx, 0) as vx, coalesce(vy, 0) as vy, sqrt((coalesce(ux, 0) + coalesce(vx, 0)) ** 2 + (coalesce(uy, 0) + coalesce(vy, 0)) ** 2) as sz from nm),
bs as (select *, case when sz < 1e-12 and (ux <> 0 or uy <> 0) and (vx <> 0 or vy <> 0) then ux else (ux + vx) / case when sz < 1e-12 then 1 else sz end end as mx,
              case when sz < 1e-12 and (ux <> 0 or uy <> 0) and (vx <> 0 or vy <> 0) then uy else (uy + vy) / case when sz < 1e-12 then 1 else sz end end as my from en),
al as (select *, case when ux = 0 and uy = 0 and vx = 0 and vy = 0 then 1 when ux = 0 and uy = 0 then mx * vx + my * vy else mx * ux + my * uy end as al from bs),
pt as (select trace_id, al < 0.25::double as sharp, unnest([1.75, -1.75]::double[]) as o, x, y, ux, uy, vx, vy, mx, my, al, count(*) over (partition by trace_id) as n from al)
select trace_id, case when o > 0 then 'left' else 'right' end as side, sum(case when sharp then 2 else 1 end)::bigint as vertices,
       round(sum(case when sharp then 2 * x + o * (ux + vx) else x + o / al * mx end) / sum(case when sharp then 2 else 1 end), 4) as mean_x, round(sum(case when sharp then 2 * y + o * (uy + vy) else y + o / al * my end) / sum(case when sharp then 2 else 1 end), 4) as mean_y
from pt where n >= 2 group by 1, 2""")
def lane_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = hd.boundaries("polyline", F.lit(3.5))
    side = lambda name, line: F.struct(F.lit(name).alias("side"), line.alias("line"))
    sides = _trace_lines(spark, sf_dir).select("trace_id", F.explode(F.array(side("left", left), side("right", right))).alias("s"))
    points = sides.select("trace_id", "s.side", F.explode("s.line").alias("p"))
    return rounded(points.groupBy("trace_id", "side").agg(F.count("*").alias("vertices"), F.avg("p.x").alias("mean_x"), F.avg("p.y").alias("mean_y")), 4)


@query(f"""with {_TRACE_LINES},
an as (select trace_id, case when lu >= 1e-9 and lv >= 1e-9 then acos(greatest(-1, least(1, ((x - px) * (nx - x) + (y - py) * (ny - y)) / (lu * lv)))) end as g from vl)
select trace_id, round(coalesce(avg(g), 0), 5) as curvature from an group by 1""")
def trace_curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_trace_lines(spark, sf_dir).select("trace_id", hd.mean_curvature("polyline").alias("curvature")), 5)


@query(f"""with {SNAP_SQL} select e.edge_id, round(coalesce(sqrt(avg(d * d)), 0), 6) as rms, count(d) as n from edges e left join snapped s on s.edge_id = e.edge_id group by 1""")
def fit_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    matched = spatial.snap(samples(spark, sf_dir), e).where("edge_id is not null").select("edge_id", "x", "y")
    return rounded(hd.rms_residual(matched, e, "edge_id"))


@query(f"""with {SQL}, {_VALUES}, sd as (select edge_id, case when value > 0 then 'left' when value < 0 then 'right' else 'center' end as side, value from vs where kind = 0),
m as (select edge_id, avg(value) filter (where side = 'left') as l, avg(value) filter (where side = 'right') as r, count(*) as b from sd group by 1 having count(*) filter (where side <> 'center') > 0),
c as (select edge_id, avg(abs(value)) as w, count(*) as b from vs where kind = 1 group by 1),
t as (select edge_id, count(*) as b from vs where kind = 2 group by 1 having count(*) >= 3),
al as (select edge_id, 'lane_markings' as source, case when l is not null and r is not null then (abs(l) + abs(r)) / 2 else abs(coalesce(l, r)) end as w, case when l is not null and r is not null then (l + r) / 2 else 0 end as o, b from m
  union all select edge_id, 'camera', w, null, b from c union all select edge_id, 'traces', null, null, b from t),
pe as (select edge_id, avg(w) as w, avg(o) as o, string_agg(source, ',' order by source) as sources, count(*) as n, sum(b) as b from al group by 1)
select e.edge_id, 1.75::double as base_half_width, round(coalesce(w, 1.75), 6) as half_width, round(coalesce(o, 0), 6) as centerline_offset, coalesce(sources, '') as sources,
       coalesce(round(least(n, 3) / 3.0::double * (1 - exp(-b / 10.0::double)), 4), 0) as confidence from edges e left join pe on pe.edge_id = e.edge_id""")
def hd_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = _values(spark, sf_dir), edges(spark, sf_dir)
    side = F.when(F.col("offset") > 0, "left").when(F.col("offset") < 0, "right").otherwise("center")
    markings_ = hd.marking_widths(v.where("kind = 0").select("edge_id", side.alias("side"), "offset", F.lit(1).alias("points")))
    cameras = hd.camera_widths(v.where("kind = 1").select("edge_id", F.lit("lane").alias("kind"), "offset"))
    seen = hd.trace_support(v.where("kind = 2").groupBy("edge_id").agg(F.count("*").alias("matched_samples")))
    found = hd.refinements(e, markings_.unionByName(cameras).unionByName(seen))
    return rounded(found.withColumn("sources", F.array_join("sources", ",")))


@query(f"""with {SQL}, {_VALUES}, {_cluster_sql(0, "m")}, {_cluster_sql(1, "o")},
ct as (select e.*, greatest(1, least(6, case when m is not null then greatest(1, m - 1) when e.ord % 4 = 0 then 2 when o is not null then o else 1 end)) as n,
              case when m is null and e.ord % 4 = 0 then 3.5::double else 1.75::double end as half from edges e left join m on m.edge_id = e.edge_id left join o on o.edge_id = e.edge_id),
ln as (select edge_id, x0, y0, x1, y1, unnest(range(0, n::bigint)) as lane, n, half from ct),
og as (select *, case when n = 1 then 0 else half - half / n - lane * 2 * half / n end as off from ln)
select edge_id, lane::int as lane_index, round(off, 6) as offset_m, round(x0 - off * (y1 - y0) / 100, 6) as x0, round(y0 + off * (x1 - x0) / 100, 6) as y0, round(x1 - off * (y1 - y0) / 100, 6) as x1, round(y1 + off * (x1 - x0) / 100, 6) as y1 from og""")
def lane_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = _values(spark, sf_dir), edges(spark, sf_dir)
    found = hd.lane_inferences(e, v.where("kind = 0"), e.where("ord % 4 = 0").select("edge_id", F.lit(2).alias("osm_lanes")), v.where("kind = 1"), gap=0.8)
    rows = found.select("edge_id", F.explode("lanes").alias("l")).select("edge_id", "l.*")
    at = lambda k, c: F.element_at("centerline", k)[c].alias(f"{c}{0 if k == 1 else 1}")
    return rounded(rows.select("edge_id", "lane_index", "offset_m", at(1, "x"), at(1, "y"), at(2, "x"), at(2, "y")))


@query(f"""with {SQL}, p as (select distinct concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey) as pos, ((l_partkey % 640) - 320)::double / 500 as r, ((l_suppkey % 48) * 10 - 240)::double / 500 as d, (l_orderkey % 628)::double / 100 as yaw,
  ((l_orderkey * 7919 + l_linenumber * 131) % 24000)::double / 10 as x, ((l_partkey * 6007 + l_linenumber * 17) % 24000)::double / 10 as y from lineitem),
q as (select *, cos(0.1::double) - d * sin(0.1::double) as ahead, -(sin(0.1::double) + d * cos(0.1::double)) as up from p),
g as (select pos, k, x + k * (ahead * cos(yaw) + r * sin(yaw)) as gx, y + k * (ahead * sin(yaw) - r * cos(yaw)) as gy from (select *, case when abs(up) >= 1e-9 and -1.5::double / up > 0 then -1.5::double / up end as k from q)),
h as (select pos, e.edge_id, e.ord, (gx - x0 - u * (x1 - x0)) ** 2 + (gy - y0 - u * (y1 - y0)) ** 2 as d2
      from (select g.*, e.*, greatest(0, least(1, ((gx - x0) * (x1 - x0) + (gy - y0) * (y1 - y0)) / 10000)) as u from g join edges e
            on gx between least(x0, x1) - 5 and greatest(x0, x1) + 5 and gy between least(y0, y1) - 5 and greatest(y0, y1) + 5) e),
n as (select pos, arg_min(edge_id, (d2, ord)) as edge_id from h where d2 < 25 group by 1)
select g.pos, n.edge_id, case when k is null then 'above_horizon' when n.edge_id is null then 'no_edge' else 'on_edge' end as fate from g left join n on n.pos = g.pos""")
def camera_on_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    zero = F.lit(0.0)
    seen = rows.select(
        F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("pos"), (((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 131) % 24000) / 10.0).cast("double").alias("x"),
        (((F.col("l_partkey") * 6007 + F.col("l_linenumber") * 17) % 24000) / 10.0).cast("double").alias("y"), zero.alias("z"), zero.alias("roll"), zero.alias("pitch"), ((F.col("l_orderkey") % 628) / 100.0).cast("double").alias("yaw"),
        F.lit("sign").alias("kind"), (F.col("l_partkey") % 640).cast("double").alias("u"), ((F.col("l_suppkey") % 48) * 10).cast("double").alias("v"),
    ).dropDuplicates(["pos"])
    return camera.observations_on_edges(seen, _CAMERA, edges(spark, sf_dir)).select("pos", "edge_id", "fate")


@query("""with r as (select o_orderkey as pos, case when o_custkey % 3 = 0 then 'turn_restriction' else 'sign' end as kind, case when o_orderkey % 5 <> 0 then 'n' || o_custkey end as junction, case when o_orderkey % 4 = 0 then 'own' || o_orderkey end as own from orders),
k as (select *, row_number() over (order by pos) - 1 as n from r where kind = 'turn_restriction' and junction is not null)
select coalesce(own, 'tr_camera_' || lpad(n::varchar, greatest(4, length(n::varchar))::int, '0')) as id, junction as junction_node_id, 'forward' as from_direction, 'camera_detection' as source from k""")
def camera_restrictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    item = F.to_json(F.struct(F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("own"), "o_orderkey")).alias("id"), F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("n"), "o_custkey")).alias("junction_node_id"), F.lit("e1").alias("from_edge_id")))
    seen = rows.select(F.col("o_orderkey").alias("pos"), F.when(F.col("o_custkey") % 3 == 0, "turn_restriction").otherwise("sign").alias("kind"), item.alias("item"))
    return camera.restrictions_seen(seen).select("id", "junction_node_id", "from_direction", "source")


# maps and comparisons

@query(f"""with {_STROKES}, en as (select edge_id || '/' || k as key, case k when 0 then x0 else x1 end as x, case k when 0 then y0 else y1 end as y from st, (select unnest([0, 1]) as k)),
h as (select key, e.edge_id, x, y, x0, y0, x1, y1, greatest(0, least(1, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / 10000)) as u from en join edges e
  on x between least(x0, x1) - 8 and greatest(x0, x1) + 8 and y between least(y0, y1) - 8 and greatest(y0, y1) + 8)
select key, edge_id, round(100 * u, 6) as arc from h where (x - x0 - u * (x1 - x0)) ** 2 + (y - y0 - u * (y1 - y0)) ** 2 <= 64 and 100 * u >= 1 and 100 - 100 * u >= 1""")
def t_junction_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = _strokes(spark, sf_dir).select("edge_id", F.posexplode("polyline").alias("k", "p")).select(F.concat("edge_id", F.lit("/"), "k").alias("key"), "p.x", "p.y")
    return rounded(build.t_junctions(ends, edges(spark, sf_dir), 8.0).select("key", "edge_id", "arc"))


@query(f"""with {SQL}, ln as (select trace_id || '-' || ord as line_id, x, y, lead(x) over w as zx, lead(y) over w as zy from samples window w as (partition by trace_id order by ord)),
vt as (select line_id, unnest([1, 2]) as k, unnest([x, zx]) as x, unnest([y, zy]) as y from ln where zx is not null),
ht as (select line_id, k, e.ord, e.edge_id from vt v join edges e on v.x between least(x0, x1) - 12 and greatest(x0, x1) + 12 and v.y between least(y0, y1) - 12 and greatest(y0, y1) + 12
  where (v.x - x0 - greatest(0, least(1, ((v.x - x0) * (x1 - x0) + (v.y - y0) * (y1 - y0)) / 10000)) * (x1 - x0)) ** 2
      + (v.y - y0 - greatest(0, least(1, ((v.x - x0) * (x1 - x0) + (v.y - y0) * (y1 - y0)) / 10000)) * (y1 - y0)) ** 2 <= 144),
fu as (select line_id, ord, edge_id from ht group by 1, 2, 3 having count(distinct k) = 2),
fs as (select line_id, arg_min(edge_id, ord) as edge_id from fu group by 1)
select e.edge_id, count(f.line_id) as trace_observation_count from edges e left join fs f on f.edge_id = e.edge_id group by 1""")
def incremental_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return incremental.update_counts(e, incremental_absorb(spark, sf_dir)).select("edge_id", "trace_observation_count")


# each order is a road of 100 m; by customer a trace crosses it, runs along it, begins 5 m beside it, or none is there
@query("""with r as (select o_custkey % 4 as kind, (100 + 200 * (o_orderkey % 400))::double as x, (100 + 200 * (o_orderkey // 400))::double as y, (30 + o_orderkey % 41)::double as c from orders),
e as (select x as x0, y as y0, x + 100 as x1, y as y1, 100::double as length_m, (kind = 1)::bigint as trace_observation_count from r
union all select x, y, x + c, y + case when kind = 2 then 5 / 3 else 0 end, c, 1 from r where kind in (0, 2)
union all select x + c, y + case when kind = 2 then 5 / 3 else 0 end, x + 100, y, 100 - c, 1 from r where kind in (0, 2)
union all select x + c, y - 30, x + c, y, 30, 1 from r where kind = 0
union all select x + c, y, x + c, y + 30, 30, 1 from r where kind = 0
union all select x + c, y + 5 / 3, x + c, y + 65, 60, 1 from r where kind = 2)
select round(x0, 6) as x0, round(y0, 6) as y0, round(x1, 6) as x1, round(y1, 6) as y1, length_m, trace_observation_count from e""")
def graph_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    at = lambda v: (100 + 200 * v).cast("double")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 4).alias("kind"))
    rows = rows.select("k", "kind", at(k % 400).alias("x"), at(F.floor(k / 400)).alias("y"), (30 + k % 41).cast("double").alias("c"))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ends = F.array(point(F.col("x"), F.col("y")), point(F.col("x") + 100, F.col("y")))
    roads = rows.select(k.alias("ord"), F.concat(F.lit("e"), "k").alias("edge_id"), F.concat(F.lit("n"), 2 * k).alias("start_node_id"), F.concat(F.lit("n"), 2 * k + 1).alias("end_node_id"), ends.alias("polyline"))
    spots = rows.select(F.posexplode(ends).alias("j", "p"), "k").select(F.concat(F.lit("n"), 2 * k + F.col("j")).alias("id"), (2 * k + F.col("j")).alias("ord"), "p.x", "p.y")
    walk = rows.where("kind < 3").select("*", F.explode(F.sequence(F.lit(0), F.when(F.col("kind") == 1, 8).otherwise(6))).alias("j"))
    x = F.col("x") + F.when(F.col("kind") == 1, 10 + 10 * F.col("j")).otherwise(F.col("c"))
    y = F.col("y") + F.when(F.col("kind") == 1, 1).when(F.col("kind") == 0, 10 * F.col("j") - 30).otherwise(10 * F.col("j") + 5)
    traced = walk.select(k.cast("string").alias("trace_id"), F.col("j").cast("long").alias("ord"), F.col("j").cast("double").alias("t"), x.alias("x"), y.alias("y"))
    n, e = build.update_graph(spots, roads, traced)
    end = lambda name, j: n.select(F.col("id").alias(name), F.col("x").alias(f"x{j}"), F.col("y").alias(f"y{j}"))
    found = e.join(end("start_node_id", 0), "start_node_id").join(end("end_node_id", 1), "end_node_id")
    return rounded(found.select("x0", "y0", "x1", "y1", geometry.polyline_length("polyline").alias("length_m"), "trace_observation_count"))


@query(f"""with {_DEGREES}, n as (select count(*) as e from edges), j as (select sum(degree * (degree - 1))::bigint as c from deg)
select 'node' as kind, (select count(*) from nodes) + e * 6 as n from n union all select 'way', e * 3 from n union all select 'lanelet/road', e from n union all select 'regulatory_element/lane_connection', c from j""")
def lanelet_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = hd.enrich(nodes(spark, sf_dir), edges(spark, sf_dir), 3.5)
    value = F.col("value")
    tag = lambda k: F.regexp_extract(value, f'k="{k}" v="([^"]*)"', 1)
    kind = F.when(value.startswith("<node"), "node").when(value.startswith("<way"), "way").when(value.startswith("<relation"), F.concat_ws("/", tag("type"), tag("subtype")))
    return lanelets.lanelet_map(n, e, 52.5, 13.4).select(kind.alias("kind")).where("kind is not null").groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""with {SQL}, p as (select s_suppkey as pos, (s_suppkey * 3701 % 24000)::double / 10 as x, (s_suppkey * 5309 % 24000)::double / 10 as y,
  case s_suppkey % 6 when 0 then 'traffic_light' when 1 then 'stop_line' when 2 then 'stop_line' when 3 then 'crosswalk' when 4 then 'speed_camera' end as kind from supplier),
h as (select pos, kind, e.edge_id, e.ord, x0, y0, x1, y1, x0 + u * (x1 - x0) as qx, y0 + u * (y1 - y0) as qy, (x - x0 - u * (x1 - x0)) ** 2 + (y - y0 - u * (y1 - y0)) ** 2 as d2
      from (select p.*, e.*, greatest(0, least(1, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / 10000)) as u from p join edges e on kind is not null
            and x between least(x0, x1) - 20 and greatest(x0, x1) + 20 and y between least(y0, y1) - 20 and greatest(y0, y1) + 20) e),
b as (select pos, kind, arg_min((edge_id, qx, qy, x1 - x0, y1 - y0), (d2, ord)) as e, min(d2) as d2 from h where d2 < 400 group by 1, 2)
select pos, e[1] as edge_id, kind, round(sqrt(d2), 6) as distance_m, case when kind = 'stop_line' then round(e[2] + 2 * e[5] / 100, 6) end as line_x0, case when kind = 'stop_line' then round(e[3] - 2 * e[4] / 100, 6) end as line_y0,
       case when kind = 'stop_line' then round(e[2] - 2 * e[5] / 100, 6) end as line_x1, case when kind = 'stop_line' then round(e[3] + 2 * e[4] / 100, 6) end as line_y1, case when kind = 'speed_camera' then (30 + pos % 50)::int end as value_kmh from b""")
def mapped_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    value = F.element_at(F.array(*(F.lit(v) for v in ("traffic_signals", "stop", "give_way", "crossing", "speed_camera", "bus_stop"))), (F.col("s_suppkey") % 6 + 1).cast("int"))
    tags = F.create_map(F.lit("highway"), value, F.lit("maxspeed"), F.concat((30 + F.col("s_suppkey") % 50).cast("string"), F.lit(" km/h")))
    places = rows.select(F.col("s_suppkey").alias("pos"), ((F.col("s_suppkey") * 3701 % 24000) / 10.0).cast("double").alias("x"), ((F.col("s_suppkey") * 5309 % 24000) / 10.0).cast("double").alias("y"), tags.alias("tags"))
    rule = F.from_json("rule", "struct<polyline_m:array<array<double>>,value_kmh:int>")
    found = compare.mapped_rules(places, edges(spark, sf_dir)).withColumn("r", rule)
    line = [F.get(F.get("r.polyline_m", F.lit(k)), F.lit(j)).alias(f"line_{c}{k}") for k in (0, 1) for j, c in enumerate("xy")]
    return rounded(found.select("pos", "edge_id", "kind", "distance_m", *line, "r.value_kmh"))


@query(f"""with {SQL} select 'node' as kind, count(*) filter (where ord % 7 <> 0) as common, count(*) filter (where ord % 7 = 0) as missing, 0::bigint as added, max(case when ord % 7 <> 0 then (ord % 11)::double / 8 end) as max_m from nodes
  union all select 'vertex', 2 * count(*), 0, 0, 0.0 from edges""")
def graph_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir)
    moved = n.where("ord % 7 <> 0").withColumn("y", F.col("y") + (F.col("ord") % 11) / 8.0)
    return compare.drift({"nodes": n, "edges": e}, {"nodes": moved, "edges": e})


@query(f"""with {SQL} select count(*) as edges, count(*) filter (where ord % 5 <> 0) as matched, round(avg(abs(ord % 3 - ord % 2)) filter (where ord % 5 <> 0), 6) as mae,
  round(avg((ord % 3 = ord % 2)::int) filter (where ord % 5 <> 0), 6) as exact from edges""")
def lane_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    aside = F.transform("polyline", lambda p: F.struct((p["x"] + 3.0).alias("x"), (p["y"] + 3.0).alias("y")))
    ways = e.select(F.col("ord").alias("way_id"), F.when(F.col("ord") % 5 != 0, F.col("ord") % 2 + 1).alias("lanes"), aside.alias("polyline"))
    return rounded(compare.lane_accuracy(e.withColumn("lane_count", F.col("ord") % 3 + 1), ways))


@query(f"""with recursive {_ADJ}, mv as (
  select a.edge_id || '/' || a.direction as u, b.edge_id || '/' || b.direction as v from adj a join adj b on a.v = b.u where a.edge_id <> b.edge_id and not (a.direction = 'forward' and b.direction = 'reverse')),
wk as (
  select u as origin, edge_id || '/' || direction as state, 1 as hops from adj where u in ('n0_0', 'n12_12', 'n24_3')
  union select origin, mv.v, hops + 1 from wk join mv on mv.u = wk.state where hops < 60)
select origin as from_node, node as to_node, hops * 100.0::double as cost, hops::bigint as hops from (
  select origin, adj.v as node, min(hops) as hops from wk join adj on adj.edge_id || '/' || adj.direction = state where adj.v <> origin group by 1, 2 union all select id, id, 0 from nodes where id in ('n0_0', 'n12_12', 'n24_3'))""")
def restricted_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    pairs = _origins(spark).select(F.col("origin").alias("from_node")).join(nodes(spark, sf_dir).select(F.col("id").alias("to_node")), F.lit(True))
    found = routing.restricted_paths(e, _one_way_rules(e), pairs)
    return found.select("from_node", "to_node", "cost", F.size("edges").cast("long").alias("hops"))


# towns: a network that grows, with bends, skew angles, one-way edges, edges without length and several components

_TOWN_ENDS = f"""{TOWN_SQL},
en as (
  select s as node, edge_id, ord, 0 as at_end, s = t as lp, sx - x0 as dx, sy - y0 as dy from tl
  union all select t, edge_id, ord, 1, s = t, tx - x1, ty - y1 from tl),
eu as (select node, edge_id, ord, at_end, lp, dx = 0 and dy = 0 as flat, case when dx = 0 and dy = 0 then 1 else dx end as dx, dy from en),
dg as (select node, count(*) as degree, count(distinct edge_id) = 1 and bool_and(lp) as own from eu group by 1)
"""


@query(f"""with {TOWN_SQL} select count(*) as edges, round(min(len), 6) as min_m, round(median(len), 6) as median_m, round(max(len), 6) as max_m, round(sum(len), 3) as total_m,
  (select count(*) from tn) as nodes, (select min(x) from tn) as x_min, (select max(x) from tn) as x_max, (select min(y) from tn) as y_min, (select max(y) from tn) as y_max from tl""")
def town_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topology.graph_stats(town_nodes(spark, sf_dir), town_edges(spark, sf_dir))
    return rounded(found.withColumn("total_m", F.round("total_m", 3)))


# ends of a node in the order of edges; of those of three and four ends, the straightest pairs
@query(f"""with {_TOWN_ENDS},
tg as (select *, row_number() over (partition by node order by ord, at_end) as i, count(*) over (partition by node) as n from eu where not (flat and at_end = 1 and lp)),
pr as (select a.node, a.n, a.i, b.i as j, abs(atan2(a.dx * b.dy - a.dy * b.dx, a.dx * b.dx + a.dy * b.dy)) as g from tg a join tg b on a.node = b.node and a.i < b.i where a.n in (3, 4)),
co as (select *, row_number() over (partition by node order by abs(g - pi()), i, j) as r from pr where abs(g - pi()) <= radians(25)),
k3 as (select c.node, case when abs(p.g - pi() / 2) <= radians(25) then 't_junction' else 'y_junction' end as kind
       from co c join pr p on p.node = c.node and p.i = least(c.i, 6 - c.i - c.j) and p.j = greatest(c.i, 6 - c.i - c.j) where c.n = 3 and c.r = 1),
k4 as (select c.node, case when abs(case when p.g > pi() / 2 then pi() - p.g else p.g end - pi() / 2) <= radians(25) then 'crossroads' else 'x_junction' end as kind
       from co c join co d on d.node = c.node and d.i not in (c.i, c.j) and d.j not in (c.i, c.j) join pr p on p.node = c.node and p.i = least(c.i, d.i) and p.j = greatest(c.i, d.i) where c.n = 4 and c.r = 1),
nn as (select node, count(*) as n from tg group by 1)
select id, coalesce(degree, 0) as degree, case when own then 'self_loop' when degree >= 3 then 'multi_branch' when degree = 1 then 'dead_end' else 'through_or_corner' end as junction_hint,
       case when degree >= 3 then coalesce(k3.kind, k4.kind, case when nn.n = 3 then 'y_junction' else 'complex_junction' end) end as junction_type
from tn left join dg on dg.node = id left join nn on nn.node = id left join k3 on k3.node = id left join k4 on k4.node = id""")
def town_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = town_nodes(spark, sf_dir), town_edges(spark, sf_dir)
    return topology.node_degrees(n, e).join(topology.junction_types(n, e), "id", "left")


@query(f"""with {_TOWN_ENDS},
pr as (select i.edge_id, i.at_end, d.degree, o.edge_id as nx, case when i.flat then atan2(i.dx * o.dy - i.dy * o.dx, i.dx * o.dx + i.dy * o.dy) else atan2(i.dy * o.dx - i.dx * o.dy, -i.dx * o.dx - i.dy * o.dy) end as g
       from eu i join dg d on d.node = i.node left join (select * from eu where not (lp and at_end = 1)) o on o.node = i.node and o.edge_id <> i.edge_id),
fl as (select edge_id, at_end, degree, bool_or(abs(g) < 0.26) as ahead, coalesce(bool_or(g >= 0.26 and abs(g) < pi() - 0.52), false) as l, coalesce(bool_or(g <= -0.26 and abs(g) < pi() - 0.52), false) as r, coalesce(bool_or(abs(g) >= pi() - 0.52), false) as u from pr group by 1, 2, 3)
select edge_id, at_end = 0 as reverse, 'straight' || case when l or (ahead and degree >= 3 and r) then ',left' else '' end || case when r or (ahead and degree >= 3 and l) then ',right' else '' end || case when u or degree = 1 then ',u_turn' else '' end as maneuvers from fl""")
def town_maneuvers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.maneuvers(town_edges(spark, sf_dir)).withColumn("maneuvers", F.array_join("maneuvers", ","))


_ONE_WAY = "oa as (select * from tadj where not coalesce((oneway = 'yes' and direction = 'reverse') or (oneway = '-1' and direction = 'forward'), false))"


@query(f"""with recursive {TOWN_SQL}, {_ONE_WAY},
d(origin, node, cost) using key (origin, node) as (
  select id, id, 0.0::double from tn
  union select d.origin, oa.v, min(d.cost + oa.len) from d join oa on oa.u = d.node left join recurring.d k on k.origin = d.origin and k.node = oa.v
  where d.cost + oa.len <= 260 and (k.cost is null or d.cost + oa.len < k.cost - 1e-9) group by 1, 2)
select origin, node, round(cost, 6) as cost from d""")
def town_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = town_nodes(spark, sf_dir)
    return rounded(routing.service_areas(town_edges(spark, sf_dir), n.select(F.col("id").alias("origin")), n, 260.0, respect_oneway=True))


def _town_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier goes somewhere in its town or, without a way, in the next."""
    s = F.col("s_suppkey")
    node = lambda k: F.concat(F.lit("v"), k)
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(node(13 * s).alias("from_node"), node(13 * s + 40 * (s % 12) + s % 29).alias("to_node"))


_TOWN_PAIRS = "sp as (select 'v' || (13 * s_suppkey) as a, 'v' || (13 * s_suppkey + 40 * (s_suppkey % 12) + s_suppkey % 29) as b from supplier)"


@query(f"""with recursive {TOWN_SQL}, {_ONE_WAY}, {_TOWN_PAIRS},
d(origin, node, cost) using key (origin, node) as (
  select distinct a, a, 0.0::double from sp
  union select d.origin, oa.v, min(d.cost + oa.len) from d join oa on oa.u = d.node left join recurring.d k on k.origin = d.origin and k.node = oa.v
  where k.cost is null or d.cost + oa.len < k.cost - 1e-9 group by 1, 2)
select distinct a as from_node, b as to_node, round(cost, 6) as cost from sp join d on origin = a and node = b""")
def town_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    adj = routing.adjacency(town_edges(spark, sf_dir), respect_oneway=True)
    return rounded(routing.paths(adj, _town_pairs(spark, sf_dir), town_nodes(spark, sf_dir)).select("from_node", "to_node", "cost"))


# lanes change at the flat cost of 50 where the next edge has several, within an edge too
@query(f"""with recursive {TOWN_SQL}, {_TOWN_PAIRS}, ln as (select *, unnest(range(0, lanes::bigint)) as lane from tadj),
d(origin, edge_id, direction, lane, node, cost) using key (origin, edge_id, direction, lane) as (
  select distinct a, edge_id, direction, lane, v, len from sp join ln on ln.u = a
  union select origin, edge_id, direction, lane, node, min(cost) from (
    select d.origin, ln.edge_id, ln.direction, ln.lane, ln.v as node, d.cost + ln.len + case when ln.lanes > 1 and ln.lane <> d.lane then 50 else 0 end as cost from d join ln on ln.u = d.node
    union all select d.origin, ln.edge_id, ln.direction, ln.lane, ln.v, d.cost + 50 from d join ln on ln.edge_id = d.edge_id and ln.direction = d.direction and ln.lane <> d.lane) m
  left join (select origin as ko, edge_id as ke, direction as kd, lane as kl, cost as kc from recurring.d) k on ko = origin and ke = edge_id and kd = direction and kl = lane
  where cost <= 2000 and (kc is null or cost < kc - 1e-9) group by 1, 2, 3, 4, 5)
select a as from_node, b as to_node, round(case when a = b then 0 else min(cost) end, 6) as cost from sp join d on origin = a and (node = b or a = b) group by 1, 2""")
def town_lane_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = town_edges(spark, sf_dir)
    found = routing.lane_paths(e, e.select("edge_id", "lane_count"), _town_pairs(spark, sf_dir), nodes=town_nodes(spark, sf_dir))
    return rounded(found.select("from_node", "to_node", "cost").where("cost <= 2000"))


def _town_rules(e: DataFrame) -> DataFrame:
    """At some nodes traffic along the row must go on, at others it must not turn up."""
    rows = e.where("ord % 3 = 0").select((F.col("ord") / 3).cast("long").alias("k"), "edge_id")
    before = rows.select((F.col("k") + 1).alias("k"), F.col("edge_id").alias("from_edge_id"))
    up = e.where("ord % 3 = 1").select(((F.col("ord") - 1) / 3).cast("long").alias("k"), F.col("edge_id").alias("to_edge_id"), F.lit("no_left_turn").alias("restriction")).where("k % 4 = 1")
    on = rows.select("k", F.col("edge_id").alias("to_edge_id"), F.lit("only_straight_on").alias("restriction")).where("k % 6 = 0")
    rules = before.join(up.unionByName(on), "k")
    return rules.select(F.concat(F.lit("v"), "k").alias("junction_node_id"), "from_edge_id", F.lit("forward").alias("from_direction"), "to_edge_id", F.lit("forward").alias("to_direction"), "restriction")


@query(f"""with recursive {TOWN_SQL},
f as (select k + 1 as k, edge_id from te where ord % 3 = 0),
ru as (select 'v' || f.k as node, f.edge_id as a, te.edge_id as b, case when ord % 3 = 1 then 'no' else 'only' end as kind from f join te on te.k = f.k where (ord % 3 = 1 and f.k % 4 = 1) or (ord % 3 = 0 and f.k % 6 = 0)),
mv as (
  select p.edge_id as pe, p.direction as pd, q.edge_id as qe, q.direction as qd, q.v, q.len from tadj p join tadj q on q.u = p.v
  left join (select distinct node, a from ru where kind = 'only') o on o.node = p.v and o.a = p.edge_id and p.direction = 'forward'
  left join ru r on r.node = p.v and r.a = p.edge_id and r.b = q.edge_id and p.direction = 'forward' and q.direction = 'forward'
  where coalesce(r.kind, '') <> 'no' and (o.a is null or r.kind = 'only')),
d(origin, edge_id, direction, node, cost) using key (origin, edge_id, direction) as (
  select u, edge_id, direction, v, len from tadj where len <= 230
  union select d.origin, qe, qd, mv.v, min(d.cost + mv.len) from d join mv on pe = d.edge_id and pd = d.direction left join recurring.d k on k.origin = d.origin and k.edge_id = qe and k.direction = qd
  where d.cost + mv.len <= 230 and (k.cost is null or d.cost + mv.len < k.cost - 1e-9) group by 1, 2, 3, 4)
select origin, node, round(min(cost), 6) as cost from (select origin, node, cost from d union all select id, id, 0 from tn) group by 1, 2""")
def town_turn_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = town_edges(spark, sf_dir)
    n = town_nodes(spark, sf_dir)
    return rounded(routing.restricted_costs(e, _town_rules(e), n.select(F.col("id").alias("origin")), 230.0, nodes=n))


# camera images: a white stripe, a second one that touches its corner or its foot, and a yellow one

_IMAGES = """im as (select p_partkey as id, (2 + p_partkey % 5)::int as ac, (1 + p_partkey % 4)::int as aw, (p_partkey % 7)::int as ar, (20 + p_partkey % 23)::int as ah, (p_partkey % 11)::int as br, (25 + p_partkey % 17)::int as bh, (1 + p_partkey % 3)::int as bw, p_partkey % 2 = 0 as joined from part),
bx as (
  select id, 'white' as kind, ar as top, ac as "left", case when joined then 55 else ar + ah - 1 end as bottom, case when joined then ac + aw else ac + aw - 1 end as "right", case when joined then aw * ah + 2 * (56 - ar - ah) else aw * ah end as pixels from im
  union all select id, 'white', ar + ah, ac + aw, 55, ac + aw + 1, 2 * (56 - ar - ah) from im where not joined
  union all select id, 'yellow', br, 30, br + bh - 1, 29 + bw, bw * bh from im)"""


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A PPM image of 48 x 56 pixels for each part."""
    p = F.col("p_partkey")
    v = {"ac": 2 + p % 5, "aw": 1 + p % 4, "ar": p % 7, "ah": 20 + p % 23, "br": p % 11, "bh": 25 + p % 17, "bw": 1 + p % 3}
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(p.alias("image_id"), *(c.cast("int").alias(n) for n, c in v.items()), (p % 2 == 0).alias("joined"))
    # images are thousands of times larger than the rows that they are drawn from, so a file's few tasks would not do
    rows = rows.repartition(shuffle_partitions(spark), "image_id")
    cc = F.col("ac") + F.col("aw") - F.col("joined").cast("int")
    stripe = lambda colour, first, n, size: F.concat(F.repeat(F.lit("303030"), first), F.repeat(F.lit(colour), n), F.repeat(F.lit("303030"), size - first - n))
    # a row is 30 pixels with the white stripes and 18 with the yellow one
    kinds = {"high": stripe("F0F0F0", F.col("ac"), F.col("aw"), 30), "low": stripe("F0F0F0", cc, F.lit(2), 30), "side": stripe("FFA000", F.lit(0), F.col("bw"), 18)}
    inside = lambda v, low, n: (v >= F.col(low)) & (v < F.col(low) + F.col(n))
    left = lambda r: F.when(inside(r, "ar", "ah"), F.col("high")).when(r >= F.col("ar") + F.col("ah"), F.col("low")).otherwise(F.lit("303030" * 30))
    right = lambda r: F.when(inside(r, "br", "bh"), F.col("side")).otherwise(F.lit("303030" * 18))
    body = F.transform(F.sequence(F.lit(0), F.lit(55)), lambda r: F.concat(left(r), right(r)))
    return rows.withColumns(kinds).select("image_id", F.concat(F.encode(F.lit("P6\n48 56\n255\n"), "US-ASCII"), F.unhex(F.array_join(body, ""))).alias("content"))


@query(f"""with {_IMAGES} select id as image_id, kind, top, "left", bottom, "right", pixels::int as pixels, round(sqrt((bottom - top) ** 2 + ("right" - "left") ** 2), 6) as length_px from bx where pixels >= 10 and greatest(bottom - top, "right" - "left") >= 30""")
def camera_lane_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = image_lanes.image_markings(_images(spark, sf_dir)).select(F.col("image_id").cast("long").alias("image_id"), F.explode("lanes").alias("l"))
    return rounded(found.select("image_id", "l.kind", "l.top", "l.left", "l.bottom", "l.right", "l.pixels", "l.length_px"))


# the yellow stripe's middle, seen by a camera of 48 x 56 pixels
@query(f"""with {SQL}, {_IMAGES},
ym as (select id, (30 + 29 + bw) / 2.0::double as u, (br + br + bh - 1) / 2.0::double as v, ((id * 7919) % 24000)::double / 10 as px, ((id * 6007) % 24000)::double / 10 as py, (id % 628)::double / 100 as yaw, least(1, sqrt((bh - 1) ** 2 + (bw - 1) ** 2) / 200)::double as confidence from im where bh - 1 >= 30),
q as (select *, (u - 24) / 40 as r, cos(0.3::double) - (v - 28) / 40 * sin(0.3::double) as ahead, -(sin(0.3::double) + (v - 28) / 40 * cos(0.3::double)) as up from ym),
g as (select *, px + k * (ahead * cos(yaw) + r * sin(yaw)) as gx, py + k * (ahead * sin(yaw) - r * cos(yaw)) as gy from (select *, case when abs(up) >= 1e-9 and -1.5::double / up > 0 then -1.5::double / up end as k from q) where k is not null),
h as (select id, confidence, gx, gy, e.edge_id, e.ord, (gx - x0 - w * (x1 - x0)) ** 2 + (gy - y0 - w * (y1 - y0)) ** 2 as d2, (x1 - x0) * (gy - y0 - w * (y1 - y0)) - (y1 - y0) * (gx - x0 - w * (x1 - x0)) as cr
      from (select g.*, e.*, greatest(0, least(1, ((gx - x0) * (x1 - x0) + (gy - y0) * (y1 - y0)) / 10000)) as w from g join edges e
            on gx between least(x0, x1) - 4 and greatest(x0, x1) + 4 and gy between least(y0, y1) - 4 and greatest(y0, y1) + 4) e)
select id as image_id, arg_min(edge_id, (d2, ord)) as edge_id, round(any_value(gx), 6) as x, round(any_value(gy), 6) as y, 'yellow' as kind, case when arg_min(cr, (d2, ord)) > 0 then 'left' else 'right' end as side, round(any_value(confidence), 6) as confidence from h where d2 <= 12.25 group by 1""")
def camera_lanes_on_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = camera.Calibration(40.0, 40.0, 24.0, 28.0, mount=camera.rotation(0.0, 0.3, 0.0), shift=(0.0, 0.0, 1.5))
    p = F.col("p_partkey")
    poses = spark.read.parquet(f"{sf_dir}/part.parquet").select(p.alias("image_id"), ((p * 7919) % 24000 / 10.0).cast("double").alias("pose_x_m"), ((p * 6007) % 24000 / 10.0).cast("double").alias("pose_y_m"), (p % 628 / 100.0).cast("double").alias("heading_rad"))
    found = image_lanes.markings_on_edges(image_lanes.image_markings(_images(spark, sf_dir)), poses, view, edges(spark, sf_dir)).where("kind = 'yellow'")
    return rounded(found.select(F.col("image_id").cast("long").alias("image_id"), "edge_id", "x", "y", "kind", "side", "confidence"))
