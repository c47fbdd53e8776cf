"""Tables kept between jobs in the folder that all executors share, and prefix sums without a single-task window."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode, as in tests, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="stackweave-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts by size rather than by 10,000 rows, so that Python workers stay small.

    A setting that the session already has stays, whatever its form.  Results are computed after the operator returns, so the
    setting has to stay in the session.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(BATCH_BYTES))


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/stackweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a chunk of ids, and the most chunks.
CHUNK_ROWS, CHUNKS = 1 << 14, 4096


def chunked(df: DataFrame, key: Column, name: str) -> DataFrame:
    """Adds `name`: the number of the chunk of the whole-number key, which doesn't decrease with it; null keys come first.

    Chunks are bounded by quantiles of the keys, so they are of like size for dense, sparse and hashed keys alike.
    """
    number = key.cast("double")
    n = df.agg(F.count(number)).first()[0]
    bounds = []
    if n > CHUNK_ROWS:
        k = min(CHUNKS, n // CHUNK_ROWS + 1)
        bounds = df.agg(F.percentile_approx(number, [i / k for i in range(1, k)], F.lit(10 * k))).first()[0]
    splits = [-math.inf, *sorted(set(bounds)), math.inf]
    if len(splits) == 2:
        return df.withColumn(name, F.when(number.isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("long"))
    cut = Bucketizer(splits=splits, inputCol="__sw_number", outputCol="__sw_bucket")
    cut = cut.transform(df.withColumn("__sw_number", F.coalesce(number, F.lit(0.0))))
    return cut.withColumn(name, F.when(number.isNull(), F.lit(-1)).otherwise(F.col("__sw_bucket")).cast("long")).drop("__sw_number", "__sw_bucket")


def numbered(df: DataFrame, group: Column, key: Column, order: list[Column], amount: Column, name: str) -> DataFrame:
    """Adds `name`: the sum of the whole-number `amount` over the rows of the group before this one in the order.

    The order begins with the whole-number key, nulls first.  Sums of chunks of keys are added up first, so that no task
    holds a whole group; rows are shuffled once, as the join has the window's partitioning.
    """
    # Keys without nulls: a null-safe join would shuffle the rows again.
    text = group.cast("string")
    df = chunked(df, key, "__sw_c").withColumns({"__sw_g": F.coalesce(F.concat(F.lit("="), text), F.lit("")), "__sw_a": amount})
    per_chunk = df.groupBy("__sw_g", "__sw_c").agg(F.sum("__sw_a").alias("__sw_s"))
    before = Window.partitionBy("__sw_g").orderBy("__sw_c").rowsBetween(Window.unboundedPreceding, -1)
    per_chunk = per_chunk.select("__sw_g", "__sw_c", F.coalesce(F.sum("__sw_s").over(before), F.lit(0)).alias("__sw_before"))
    within = Window.partitionBy("__sw_g", "__sw_c").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("__sw_in", F.coalesce(F.sum("__sw_a").over(within), F.lit(0)))
    joined = inner.join(per_chunk, ["__sw_g", "__sw_c"])
    return joined.withColumn(name, F.col("__sw_before") + F.col("__sw_in")).drop("__sw_g", "__sw_c", "__sw_a", "__sw_before", "__sw_in")
