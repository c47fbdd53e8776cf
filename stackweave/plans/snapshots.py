"""Comparison, validation and merging of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import verdict


def compare_decisions(left: DataFrame, right: DataFrame) -> DataFrame:
    """SNP-01, JOI-15: repositories whose final flag or segment differs; a null segment is an empty one."""
    a = left.select("repo_id", F.col("passed_major").alias("left_final"), F.coalesce("primary_segment", F.lit("")).alias("left_segment"))
    b = right.select("repo_id", F.col("passed_major").alias("right_final"), F.coalesce("primary_segment", F.lit("")).alias("right_segment"))
    joined = a.join(b, "repo_id", "full_outer")
    change = F.when(F.col("left_final").isNull(), "added").when(F.col("right_final").isNull(), "removed").when(~F.col("left_final").eqNullSafe(F.col("right_final")), "final").when(F.col("left_segment") != F.col("right_segment"), "segment")
    return joined.withColumn("change", change).filter("change is not null").select("repo_id", "change")


def edge_changes(left: DataFrame, right: DataFrame) -> DataFrame:
    """SET-03: edges only in one of two snapshots, by anti joins.

    exceptAll is a sum over a union, which Spark 4.1 doesn't shuffle if both sides are partitioned alike; it then sums each side by
    itself, and every edge of both counts as a change.
    """
    a, b = left.select("repo_id", "technology_id"), right.select("repo_id", "technology_id")
    return a.subtract(b).withColumn("change", F.lit("removed")).unionByName(b.subtract(a).withColumn("change", F.lit("added")))


def scorecard(left: DataFrame, right: DataFrame, better: dict[str, str]) -> DataFrame:
    """SNP-02, MAT-09: one row a metric of two one-row tables; a metric that is null on either side is left out."""
    names = list(better)
    a = left.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("before")) for n in names])))
    b = right.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("after")) for n in names])))
    joined = a.join(b, "metric").filter("before is not null and after is not null").withColumn("delta", F.col("after") - F.col("before"))
    result = F.lit(None).cast("string")
    for n, way in better.items():
        result = F.when(F.col("metric") == n, verdict(F.col("delta"), way)).otherwise(result)
    return joined.withColumn("result", result)


def validate(repos: DataFrame, decisions: DataFrame, edges: DataFrame, technologies: DataFrame, segments: list[str], serious: int = 3) -> DataFrame:
    """REP-07, SET-04, FIL-11: each constraint with the number of rows that break it and its status."""
    final = decisions.filter(F.coalesce("passed_major", F.lit(False)))
    checks = [
        ("decision without repository", "error", decisions.join(repos, "repo_id", "left_anti")),
        ("repository without decision", "error", repos.join(decisions, "repo_id", "left_anti")),
        ("edge without final", "error", edges.join(final, "repo_id", "left_anti")),
        ("edge without technology", "error", edges.join(technologies, "technology_id", "left_anti")),
        ("repeated edge", "error", edges.groupBy("repo_id", "technology_id").count().filter("count > 1")),
        ("final below threshold", "error", final.filter(F.col("score_serious") < serious)),
        ("segment not configured", "warning", final.filter(F.col("primary_segment").isNull() | ~F.col("primary_segment").isin(segments))),
        ("final without edge", "warning", final.join(edges, "repo_id", "left_anti")),
    ]
    out = None
    for name, level, rows in checks:
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n", F.when(F.col("n") == 0, "ok").otherwise(level).alias("status"))
        out = one if out is None else out.unionByName(one)
    return out


def overlay(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """SET-06, SNP-03: base with the rows of `over` in the place of those with their key, and the new ones behind."""
    return base.join(over.select(key).distinct(), key, "left_anti").unionByName(over, allowMissingColumns=True)


def channels(*found: tuple[str, DataFrame]) -> DataFrame:
    """SET-02, TOP-07: distinct repositories of all discovery channels with the sorted channels that found them."""
    out = None
    for name, df in found:
        one = df.select("full_name", F.lit(name).alias("source"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("full_name").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
