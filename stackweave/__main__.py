"""python -m stackweave report|validate|compare|manifest|validate-config: reports on snapshot folders as Markdown."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from .plans import jobs, reports, snapshots
from .sources import tables


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> str:
    """CLI-02..04; the steps of CLI-01 are streaming.incremental and plans.jobs."""
    p = argparse.ArgumentParser(prog="stackweave", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("report", "validate", "manifest"):
        c = sub.add_parser(name)
        c.add_argument("folder")
        c.add_argument("--top", type=int, default=20)
        c.add_argument("--segments", nargs="*", default=[])
    c = sub.add_parser("compare")
    c.add_argument("left")
    c.add_argument("right")
    c = sub.add_parser("validate-config")
    c.add_argument("file")
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.appName("stackweave").getOrCreate()
    if a.command == "report":
        t = jobs.read_snapshot(spark, a.folder)
        top = reports.top(reports.adoption(t["edges"], t["decisions"]), "n_repos", "technology_id", a.top)
        parts = {"Technologies": top, "Evidence tiers": reports.evidence_tiers(t["decisions"], t["edges"]), "Evidence profiles": reports.evidence_profiles(t["decisions"], t["edges"])}
        return "\n".join(f"## {k}\n\n{tables.markdown(v)}" for k, v in parts.items())
    if a.command == "validate":
        t = jobs.read_snapshot(spark, a.folder)
        return tables.markdown(snapshots.validate(t["repos"], t["decisions"], t["edges"], t["technologies"], a.segments))
    if a.command == "manifest":
        return tables.markdown(tables.manifest(spark, a.folder))
    if a.command == "compare":
        x, y = jobs.read_snapshot(spark, a.left), jobs.read_snapshot(spark, a.right)
        card = snapshots.scorecard(jobs.metrics(x["decisions"], x["edges"]), jobs.metrics(y["decisions"], y["edges"]), jobs.BETTER)
        return tables.markdown(card) + "\n" + tables.markdown(snapshots.compare_decisions(x["decisions"], y["decisions"]).groupBy("change").count())
    text = Path(a.file).read_text()
    get = lambda s, k: tables.config(spark, text, s, f"{k} string, technology_ids array<string>", {"technology_ids": []})
    tech = tables.config(spark, text, "technologies", "technology_id string, repo_names array<string>", {"repo_names": []})
    return tables.markdown(tables.config_issues(tech, get("entities", "entity_id"), get("segments", "segment_id")))


if __name__ == "__main__":
    print(main())
