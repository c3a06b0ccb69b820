"""Streams of samples: edge observations and live trips with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from waymesh.operators.spatial import HIT, point_segment_pairs, segments

SAMPLES = "trace_id string, ord long, t double, x double, y double"


def read_samples(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the Parquet files of samples that arrive in a folder."""
    return spark.readStream.schema(SAMPLES).parquet(folder)


def edge_observations(stream: DataFrame, edges: DataFrame, radius: float = 15.0, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Samples by edge and time window: (edge_id, start, samples), late ones up to `delay`.

    Each sample is snapped within its batch: the nearest edge is the least hit of a
    sample, so the stream is aggregated twice, by sample and by edge and window.
    """
    timed = stream.withColumn("at", F.timestamp_seconds("t")).withWatermark("at", delay)
    hits = point_segment_pairs(timed, segments(edges), radius)
    best = hits.groupBy("trace_id", "ord", "at").agg(F.min(F.struct(*HIT)).alias("hit"))
    return best.groupBy(F.window("at", window).alias("w"), F.col("hit.edge_id").alias("edge_id")).agg(F.count("*").alias("samples")).select("edge_id", F.col("w.start").alias("start"), "samples")


def live_trips(stream: DataFrame, max_gap_s: float = 300.0, delay: str = "10 minutes") -> DataFrame:
    """Trips as they end: (trace_id, t_start, t_end, samples, distance), cut where a trace is silent for `max_gap_s`.

    A trip is held as a few numbers for each trace. It ends with the first sample
    after the gap, or by timer once the watermark has passed it. Samples of a trace
    are expected in order within a batch's time range; later ones than the watermark
    are dropped.
    """
    timed = stream.withColumn("at", F.timestamp_seconds("t")).withWatermark("at", delay)
    output = "trace_id string, t_start double, t_end double, samples long, distance double"
    state = "t_start double, t_end double, samples long, distance double, x double, y double"

    def advance(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        ended = []
        now = held.get if held.exists else None
        if held.hasTimedOut:
            ended.append((key[0], *now[:4]))
            held.remove()
        else:
            rows = pd.concat(list(parts)).sort_values(["t", "ord"])
            for t, x, y in rows[["t", "x", "y"]].itertuples(index=False):
                if now is not None and t - now[1] > max_gap_s:
                    ended.append((key[0], *now[:4]))
                    now = None
                if now is None:
                    now = (t, t, 1, 0.0, x, y)
                else:
                    step = ((x - now[4]) ** 2 + (y - now[5]) ** 2) ** 0.5
                    now = (now[0], t, now[2] + 1, now[3] + step, x, y)
            held.update(now)
            held.setTimeoutTimestamp(int(max((now[1] + max_gap_s) * 1000, held.getCurrentWatermarkMs() + 1)))
        if ended:
            yield pd.DataFrame(ended, columns=["trace_id", "t_start", "t_end", "samples", "distance"])

    return timed.groupBy("trace_id").applyInPandasWithState(advance, output, state, "append", GroupStateTimeout.EventTimeTimeout)


def store_versions(stream: DataFrame, folder: str, checkpoint: str, update) -> object:
    """Runs `update(spark, batch, version_before)` on every batch and writes its result as the next version.

    Versions are Parquet folders named by batch, so a batch that is repeated after a
    failure writes the same version again.
    """

    def step(batch: DataFrame, number: int) -> None:
        before = f"{folder}/version={number - 1}" if number else None
        update(batch.sparkSession, batch, before).write.mode("overwrite").parquet(f"{folder}/version={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
