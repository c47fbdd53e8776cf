"""Incremental classification with Structured Streaming: micro-batches, commit markers, resume, guards and caches.

A batch's rows go to a folder of its own number, which a repeated batch overwrites, and its commit
marker is written last; readers see committed batches only.  The stream's checkpoint and the
output lie in folders that all executors share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.stats import first_of, stable_hash


def _path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def write_batch(tables: dict[str, DataFrame], out: str, batch: int) -> None:
    """INC-03: all tables of a batch, then its marker; idempotent."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch:05d}")
    spark.range(1).select(F.lit(batch).alias("batch")).coalesce(1).write.mode("overwrite").parquet(f"{out}/_committed/batch={batch:05d}")


def committed(spark: SparkSession, out: str, name: str, schema: StructType | str) -> DataFrame:
    """INC-02, INC-06: the rows of a table in committed batches; none where there is none."""
    path, fs = _path(spark, f"{out}/_committed")
    if not fs.exists(path):
        return spark.createDataFrame([], schema)
    done = [s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("batch=")]
    paths = [f"{out}/{name}/{d}" for d in sorted(done) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{name}/{d}"))]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def remaining(rows: DataFrame, done: DataFrame, key: str = "repo_id") -> DataFrame:
    """INC-02: rows that no committed batch has."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def guard(spark: SparkSession, out: str, config: str, ids: DataFrame) -> None:
    """INC-04: a run goes on only with the configuration and the ids that it began with."""
    digest = ids.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("repo_id").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum"))
    now = digest.select(stable_hash(F.lit(config)).alias("config"), stable_hash(F.col("n"), F.col("sum")).alias("ids"))
    path, fs = _path(spark, f"{out}/_run")
    if fs.exists(path):
        if now.exceptAll(spark.read.parquet(f"{out}/_run")).count():
            raise ValueError("the folder belongs to a run with another configuration or other repositories")
    else:
        now.coalesce(1).write.parquet(f"{out}/_run")


def classify_stream(spark: SparkSession, source: str, schema: StructType | str, out: str, classify: Callable[[DataFrame], dict[str, DataFrame]], files_per_batch: int = 1) -> int:
    """INC-01, INC-05: classifies the files that are new in `source`, one micro-batch at a time, and returns how many batches ran."""
    ran = 0

    def each(batch: DataFrame, number: int) -> None:
        nonlocal ran
        write_batch(classify(batch), out, number)
        ran += 1

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{out}/_stream").trigger(availableNow=True).start()
    query.awaitTermination()
    return ran


def progress(spark: SparkSession, out: str, total: int) -> DataFrame:
    """INC-05: one row: batches done, and the state of the run."""
    done = committed(spark, out, "decisions", "repo_id long").agg(F.count_distinct("repo_id").alias("processed"))
    return done.select("processed", F.lit(total).alias("total"), F.when(F.col("processed") >= total, "completed").otherwise("running").alias("state"))


def upsert_cache(cache: DataFrame, entries: DataFrame, keys: tuple[str, ...] = ("full_name", "pushed_at", "config_hash")) -> DataFrame:
    """INC-07: the cache with new entries; the last of a key wins, and a changed key is another entry."""
    both = cache.withColumn("__new", F.lit(0)).unionByName(entries.withColumn("__new", F.lit(1)))
    order = [F.col("__new").desc(), *[F.col(c).desc() for c in sorted(set(cache.columns) - set(keys))]]
    return first_of(both, list(keys), order).drop("__new")


def merge_timings(*runs: DataFrame) -> DataFrame:
    """AGG-24: stage timings of all attempts, equal ones (seconds to six places) once."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out.withColumn("seconds", F.round("seconds", 6)).dropDuplicates(["stage_id", "seconds", "item_count", "notes", "attempt_id"])
