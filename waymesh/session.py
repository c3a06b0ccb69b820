"""Session factory and the one place that cuts lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Bits of the estimated size of a checkpointed table.
LONGEST_ESTIMATE = 256


def get_session(app: str = "waymesh", **conf: str) -> SparkSession:
    """A session with the settings that results rely on: UTC, ANSI SQL, adaptive execution."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` with checkpoint() in the cluster's shared folder.

    The folder is spark.checkpoint.dir. Where that is unset, one is made up on a single
    machine, as in tests, and a cluster is an error: executors share no local folder.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="waymesh-checkpoint-"))
    out = df.checkpoint(eager=True)
    # a checkpoint keeps the estimate of its size, which joins multiply: in a fixpoint its digits double with every round
    # until the driver is filled by a number, so tables with a long one are made anew from their rows
    if out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() > LONGEST_ESTIMATE:
        out = DataFrame(df.sparkSession._jsparkSession.createDataFrame(out._jdf.javaRDD(), out._jdf.schema()), df.sparkSession)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
