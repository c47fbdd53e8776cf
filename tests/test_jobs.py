"""Whole jobs: repair from contexts, the command line, the discovery report."""


from stackweave import catalog
from stackweave.__main__ import main
from stackweave.operators import classify as C
from stackweave.operators import parsers as P
from stackweave.plans import jobs, reports

SF = "/root/testdata/sf0.001"
TREE = ["pyproject.toml", *[f"src/{x}.py" for x in "abcde"], "tests/test_app.py", ".github/workflows/ci.yml"]
CONTEXT = "repo_id long, full_name string, description string, topics array<string>, stars int, primary_language string, readme_text string, tree_paths array<string>, manifest_paths array<string>, manifest_tech array<string>, sbom_tech array<string>, import_tech array<string>, provider_tech array<string>"
RULES = C.Rules(segments={"agents": {"topics": ("llm",)}}, precedence=("agents",))


def context(i, **changes):
    row = dict(repo_id=i, full_name=f"o/r{i}", description="an llm tool", topics=["llm"], stars=1500, primary_language="Python", readme_text="## Installation\n## Usage", tree_paths=TREE, manifest_paths=["pyproject.toml"], manifest_tech=["1", "2"], sbom_tech=["3"], import_tech=[], provider_tech=[])
    row.update(changes)
    return tuple(row.values())


def contexts(spark):
    rows = [
        context(1), context(2, full_name="o/awesome-llm"), context(3, topics=["llm", "tutorial"]), context(4, tree_paths=["README.md", "docs/a.md"], manifest_paths=[], primary_language=None, readme_text=None),
        context(5, manifest_tech=[], sbom_tech=[], topics=[], description=None), context(6, stars=10), context(7, tree_paths=[], manifest_paths=[], topics=[]),
    ]
    return spark.createDataFrame(rows, CONTEXT)


def test_classification_cases(spark):
    got = {r.repo_id: r for r in C.classify(contexts(spark), RULES).collect()}
    assert got[1].score_serious == 7 and got[1].score_ai == 10 and got[1].passed_major_filter and got[1].primary_segment == "agents"
    assert got[2].exclusion_reason == "hard exclusion: awesome" and not got[2].passed_serious_filter
    assert got[3].exclusion_reason is None and got[3].passed_major_filter
    assert got[4].score_serious == -5 and not got[4].passed_serious_filter
    assert got[5].passed_serious_filter and not got[5].passed_ai_relevance_filter
    assert got[6].passed_ai_relevance_filter and not got[6].passed_major_filter and got[6].primary_segment is None


def test_repair_writes_decisions_and_edges(spark, tmp_path):
    evidence = spark.createDataFrame(
        [(1, "openai", "a", "10", "manifest", "high", "runtime"), (1, "openai", "b", "10", "sbom", "high", "runtime"), (3, "x", "a", None, "manifest", "high", "dev"), (5, "openai", "a", "10", "manifest", "high", "runtime")],
        "repo_id long, package_name string, source_path string, technology_id string, evidence_type string, confidence string, scope string",
    )
    readme = contexts(spark).select("repo_id", "readme_text")
    aliases = spark.createDataFrame([("20", "usage", 0), ("21", "none", 1)], "technology_id string, alias string, ord int")
    made = jobs.repair(contexts(spark), evidence, RULES, str(tmp_path))
    assert {(r.repo_id, r.technology_id, r.evidence_type) for r in made["edges"].collect()} == {(1, "10", "manifest")}
    assert {(r.repo_id, r.reason) for r in made["gaps"].collect()} == {(3, "unmapped_dependency_evidence")}
    assert {r.tier: r.n_repos for r in made["tiers"].collect()} == {"direct_only": 1, "reviewed_fallback": 1, "full_population": 2}
    best = jobs.build_edges(evidence, made["decisions"], contexts=readme, aliases=aliases)
    assert {(r.repo_id, r.technology_id, r.evidence_type) for r in best.collect()} == {(1, "10", "manifest"), (3, "20", "readme_mention")}
    targets = jobs.refresh_targets(contexts(spark), made["decisions"], [], 3, 5)
    assert [r.repo_id for r in targets.collect()] == [7]


def test_command_line(spark, tmp_path):
    t = catalog.Lens(spark, SF)
    for side, decisions in (("a", t.decisions), ("b", t.old_decisions)):
        for name, df in (("repos", t.repos), ("repo_inclusion_decisions", decisions), ("repo_technology_edges", t.edges), ("technologies", t.technologies)):
            df.write.parquet(f"{tmp_path}/{side}/{name}.parquet")
    assert "## Evidence tiers" in main(["report", f"{tmp_path}/a", "--top", "3"], spark)
    assert "| final without edge |" in main(["validate", f"{tmp_path}/a", "--segments", "BUILDING"], spark)
    assert "| finals |" in main(["compare", f"{tmp_path}/b", f"{tmp_path}/a"], spark)
    assert "sha256" in main(["manifest", f"{tmp_path}/a"], spark)
    (tmp_path / "c.yaml").write_text("technologies:\n- {technology_id: a, repo_names: [bad]}\n")
    assert "malformed repository name" in main(["validate-config", f"{tmp_path}/c.yaml"], spark)


def test_discovery_report_orders_families(spark):
    rows = catalog.QUERIES["q_discovery_report"](spark, SF).collect()
    assert len(rows) > 3 and [r.priority for r in rows] == sorted((r.priority for r in rows), reverse=True)
    assert all(0 <= r.priority <= 100 for r in rows)


def test_plans_push_down_and_avoid_nested_loops(spark):
    """Filters reach the scan, few columns are read, and the prefix join is an equi-join."""

    def plan(name):
        return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()

    adoption = plan("q_last_wins")
    assert "l_extendedprice" not in adoption and "PushedFilters: [" in adoption
    prefix = plan("q_prefix_join")
    assert "NestedLoop" not in prefix and "Cartesian" not in prefix
    assert "NestedLoop" not in plan("q_cooccurrence") and "WindowGroupLimit" in plan("q_edges_argmax")


def test_contexts_are_assembled(spark):
    trees = spark.createDataFrame([(1, ["requirements.txt", "src/a.py"]), (2, ["src/a.py", "x/b.py"]), (3, [])], "repo_id long, tree_paths array<string>")
    text = "repo_id long, path string, text string"
    files = spark.createDataFrame([(1, "requirements.txt", "openai>=1\n"), (1, "other/requirements.txt", "torch\n")], text)
    sbom = '{"packages": [{"SPDXID": "A", "name": "X"}], "relationships": [{"spdxElementId": "D", "relatedSpdxElement": "R", "relationshipType": "DESCRIBES"}, {"spdxElementId": "R", "relatedSpdxElement": "A", "relationshipType": "DEPENDS_ON"}]}'
    sources = spark.createDataFrame([(1, "src/a.py", "import os"), (2, "src/a.py", "import torch"), (2, "x/b.py", "import rich")], text)
    got = {r.repo_id: r for r in P.assemble(trees, files, spark.createDataFrame([(3, "sbom.json", sbom)], text), sources).collect()}
    assert got[1].manifest_packages == ["openai"] and got[1].imported == []
    assert got[2].imported == ["rich", "torch"] and got[3].sbom_packages == ["x"] and got[3].imported == []


def test_composed_reports(spark):
    t = catalog.Lens(spark, SF)
    made = reports.report_summary(t.repos, t.decisions, t.edges, t.technologies, 5)
    assert made["funnel"].first().total == t.decisions.count() and 0 < made["technologies"].count() <= 5
    gaps = reports.gap_report(t.repos, t.decisions, t.edges, t.evidence, 5)
    missing = reports.missing_edges(t.decisions, t.edges).count()
    assert sum(r.n_repos for r in gaps["reasons"].collect()) == missing and gaps["queue"].count() == min(5, missing)
