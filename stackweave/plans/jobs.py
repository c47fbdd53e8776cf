"""Whole jobs over a folder of snapshot tables: edges, repair, refresh, reports, and their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify as C
from ..operators import edges as E
from ..sources import tables as T
from . import reports as Q
from . import snapshots as N

TIE = ["package_name", "source_path"]


def build_edges(evidence: DataFrame, decisions: DataFrame, providers: DataFrame | None = None, identity: DataFrame | None = None, contexts: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """NRM-01: the strongest of the evidence, provider rows and identities of finals for each technology; readme mentions only where there is nothing else."""
    own = evidence.filter("technology_id is not null").join(Q.finals(decisions).select("repo_id"), "repo_id", "left_semi")
    if "match_method" not in own.columns:
        own = own.withColumn("match_method", F.lit(None).cast("string"))
    rows = own
    if providers is not None:
        rows = rows.unionByName(E.provider_edges(own, providers), allowMissingColumns=True)
    if identity is not None:
        named = identity.join(Q.finals(decisions).select("repo_id"), "repo_id", "left_semi").select("repo_id", "technology_id", F.lit("repo_identity").alias("evidence_type"), F.lit("high").alias("confidence"), F.lit("unknown").alias("scope"), F.lit("repo_identity").alias("match_method"))
        rows = rows.unionByName(named, allowMissingColumns=True)
    best = E.strongest(rows, TIE)
    if contexts is not None and aliases is not None:
        inside = contexts.join(Q.finals(decisions).select("repo_id"), "repo_id", "left_semi")
        read = E.readme_edges(inside, aliases, best).select("repo_id", "technology_id", F.lit("readme_mention").alias("evidence_type"), F.lit("low").alias("confidence"), F.lit("readme_alias").alias("match_method"))
        best = best.unionByName(read, allowMissingColumns=True)
    return best


def repair(contexts: DataFrame, evidence: DataFrame, rules: C.Rules, out: str, judge: DataFrame | None = None, **edge_sources) -> dict[str, DataFrame]:
    """REP-08: decisions and edges made anew from stored contexts and evidence, written, and the reports on them."""
    spark = contexts.sparkSession
    made = C.classify(contexts, rules).withColumn("passed_major", F.col("passed_major_filter")).join(contexts.select("repo_id", "stars"), "repo_id")
    if judge is not None:
        made = C.judged(made, judge)
    T.write_table(made, f"{out}/repo_inclusion_decisions.parquet")
    decisions = spark.read.parquet(f"{out}/repo_inclusion_decisions.parquet")
    T.write_table(build_edges(evidence, decisions, **edge_sources), f"{out}/repo_technology_edges.parquet")
    edges = spark.read.parquet(f"{out}/repo_technology_edges.parquet")
    return {"decisions": decisions, "edges": edges, "adoption": Q.adoption(edges, decisions), "gaps": Q.gap_reasons(decisions, edges, evidence), "tiers": Q.evidence_tiers(decisions, edges), "profiles": Q.evidence_profiles(decisions, edges)}


def refresh_targets(contexts: DataFrame, decisions: DataFrame, names: list[str], least: int, limit: int) -> DataFrame:
    """FIL-10: the named repositories, or those with an empty tree and enough AI score; at most limit."""
    rows = contexts.join(decisions.select("repo_id", "score_ai"), "repo_id")
    chosen = rows.filter(F.col("full_name").isin(names)) if names else rows.filter((F.size("tree_paths") == 0) & (F.col("score_ai") >= least))
    return chosen.orderBy("repo_id").limit(limit).drop("score_ai")


def refresh(contexts: DataFrame, fresh: DataFrame) -> DataFrame:
    """SNP-03: contexts with the fresh ones in their place, in the order of their ids."""
    return N.overlay(contexts, fresh, "repo_id").orderBy("repo_id")


def metrics(decisions: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of the measures that scorecards compare."""
    a = decisions.agg(F.count(F.lit(1)).alias("repositories"), F.count_if(F.coalesce("passed_major", F.lit(False))).alias("finals"))
    b = edges.agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("technology_id").alias("technologies"))
    c = Q.missing_edges(decisions, edges).agg(F.count(F.lit(1)).alias("missing"))
    return a.crossJoin(b).crossJoin(c)


BETTER = {"repositories": "higher", "finals": "higher", "edges": "higher", "technologies": "higher", "missing": "lower"}


def read_snapshot(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    names = {"repos": "repos", "decisions": "repo_inclusion_decisions", "edges": "repo_technology_edges", "technologies": "technologies", "evidence": "repo_dependency_evidence"}
    out = {k: spark.read.parquet(f"{folder}/{f}.parquet") for k, f in names.items() if T.exists(spark, f"{folder}/{f}.parquet")}
    if "decisions" in out and "passed_major" not in out["decisions"].columns:
        out["decisions"] = out["decisions"].withColumn("passed_major", F.col("passed_major_filter"))
    return out
