"""Column functions on worked examples."""

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stackweave.functions import stats as S
from stackweave.functions import text as X
from stackweave.operators import parsers as P
from stackweave.operators import resolve as R


def run(spark, f, rows, schema):
    """f of the columns of each row."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}")
    return [r[0] for r in df.orderBy("_i").select(f(*[F.col(c) for c in df.columns[1:]]).alias("x")).collect()]


ONE = {
    X.package_prefix: {"@ai-sdk/openai": "@ai-sdk/", "langchain-openai": "langchain", "a_b-c": "a_b", "x.y_z": "x.y", "torch": "torch"},
    X.family_id: {"@mastra/core": "mastra", "@mastra/agent-kit": "mastra", "@browserbasehq/stagehand": "stagehand", "@pydantic/logfire-api": "logfire", "llama-index-core": "llama", "@x/ui": "x", "@acmelabs/ui": "acme"},
    X.ai_affinity: {"@pydantic/logfire-api": True, "typescript": False, "langfuse": True, "mail": False, "storage": False, "openai-agents": True, "fastembed": False, "serde": False},
    X.requirement_name: {'OpenAI[extra]>=1.0; python_version>"3"': "openai", "torch ~= 2.0": "torch", "'requests'==2": "requests", "git+https://x": "git+https://x"},
    X.domain: {"https://www.OpenAI.com/x": "openai.com", "openai.com.": "openai.com", "sub.a.io/p": "sub.a.io"},
    X.slugify: {"@AI SDK/Core!": "ai-sdk-core"},
    X.generic_penalty: {"react": 0.65, "github": 0.85, "githubx": 0.25, "langchain": 0.0},
    X.segment_key: {" RAG-search/App ": "rag_search_app"},
    X.evidence_strength: {"manifest": "direct", "repo_identity": "identity", "readme_mention": "fallback", "?": "unknown"},
    P.python_imports: {"import os.path\nfrom google.genai import types\n  import openai as o": ["os.path", "openai", "os", "google.genai", "google", "google.genai.types"]},
    P.js_imports: {'import x from "@ai-sdk/openai"; const y=require("fs")': ["@ai-sdk/openai", "fs", "openai"]},
    P.go_imports: {'import (\n  "github.com/openai/openai-go"\n)': ["github.com/openai/openai-go", "openai-go"]},
    P.rust_imports: {"use tokio::sync::mpsc;": ["tokio::sync::mpsc", "tokio"]},
}


@pytest.mark.parametrize("f", ONE, ids=lambda f: f.__name__)
def test_one_argument(spark, f):
    assert run(spark, f, [(k,) for k in ONE[f]], "a string") == list(ONE[f].values())


def test_sbom_candidates(spark):
    rows = {
        ("openai", "pkg:npm/%40langchain/openai@0.1.0"): ["@langchain/openai", "openai"],
        ("modal", "pkg:npm/%40scope/modal@1"): ["@scope/modal", "modal"],
        ("x", "pkg:golang/github.com/openai/openai-go@1.12.0"): ["github.com/openai/openai-go", "openai-go", "x"],
        ("actions/checkout", "pkg:githubactions/actions/checkout@v4"): ["actions/checkout", "checkout"],
        ("plain", None): ["plain"],
    }
    assert run(spark, X.sbom_candidates, list(rows), "a string, b string") == list(rows.values())


PREFIX_CASES = {("langchain-openai", "langchain"): True, ("langchainx", "langchain"): False, ("@ai-sdk/openai", "@ai-sdk/"): True, ("databend", "databend-"): False, ("databend-", "databend-"): True, ("a", "a"): True}


def test_prefix_match(spark):
    assert run(spark, R.matches_prefix, list(PREFIX_CASES), "a string, b string") == list(PREFIX_CASES.values())


def test_prefix_join_equals_the_predicate(spark):
    """The exploded equi-join finds what a nested loop over the predicate finds."""

    @settings(max_examples=8, deadline=None)
    @given(st.lists(st.text("ab-_/.", min_size=1, max_size=6), min_size=1, max_size=12), st.lists(st.text("ab-/", min_size=1, max_size=4), min_size=1, max_size=6))
    def check(names, rules):
        p = spark.createDataFrame([(n,) for n in sorted(set(names))], "package_name string")
        r = spark.createDataFrame([(x, i) for i, x in enumerate(sorted(set(rules)))], "prefix string, technology_id int")
        got = {(x.package_name, x.prefix) for x in R.longest_prefix(p, r).collect()}
        loop = p.join(r, R.matches_prefix(F.col("package_name"), F.col("prefix"))).collect()
        best = {}
        for x in loop:
            best[x.package_name] = min(best.get(x.package_name, x.prefix), x.prefix, key=lambda s: (-len(s), s))
        assert got == set(best.items())

    check()


def test_mentions(spark):
    rows = {("uses langchain.", "langchain"): True, ("uses langchainx", "langchain"): False, ("@langchain/core", "langchain"): True, ("my_langchain", "langchain"): True, ("a+b (c++)", "c++"): True}
    assert run(spark, X.mentions, list(rows), "a string, b string") == list(rows.values())


def test_suppressed_packages(spark):
    rows = {("react", None): True, ("@types/node", None): True, ("@rollup/x", None): True, ("@my-org/x", "myorg/repo"): True, ("reactive", None): False, ("react-dom", None): True}
    assert run(spark, X.suppressed_package, list(rows), "a string, b string") == list(rows.values())


def test_prefix_kinds(spark):
    rows = {
        ("llama", 0): (False, True), ("langchain", 0): (False, True), ("@unknownco/", 2): (False, False), ("@crawlee/", 1): (False, True), ("google", 5): (True, False),
        ("foo", 0): (True, False), ("foo", 2): (False, False), ("ai", 1): (False, False), ("agents", 0): (False, True),
    }
    got = zip(run(spark, X.commodity_prefix, list(rows), "a string, b int"), run(spark, X.ai_prefix, list(rows), "a string, b int"))
    assert list(got) == list(rows.values())


def test_profiles(spark):
    rows = [
        ([], "unmapped"), (["readme_mention"], "readme_only"), (["repo_identity"], "repo_identity_only"), (["repo_identity", "readme_mention"], "repo_identity_plus_fallback"),
        (["manifest", "readme_mention"], "mixed_direct_and_fallback"), (["repo_identity", "manifest"], "direct_only"), (["weird"], "other"),
    ]
    assert run(spark, X.evidence_profile, [(k,) for k, _ in rows], "a array<string>") == [v for _, v in rows]


def test_ratios_and_intervals(spark):
    rows = {(1, 3): 0.3333, (2, 3): 0.6667, (5, 0): 0.0, (7, 119): 0.0588, (1, 8): 0.125, (17, 119): 0.1429}
    assert run(spark, S.rounded_ratio, list(rows), "a int, b int") == list(rows.values())
    rows = {(7, 119): (0.02878294603515636, 0.11645775418366203), (0, 10): (0.0, 0.2775401687666165), (10, 10): (0.7224598312333834, 1.0), (0, 0): (0.0, 0.0)}
    for i in (0, 1):
        got = run(spark, lambda a, b, i=i: S.wilson(a, b)[i], list(rows), "a int, b int")
        assert got == pytest.approx([v[i] for v in rows.values()], abs=1e-12)


def test_bands_paths_and_dates(spark):
    assert run(spark, S.score_band, [(None,), (1,), (2,), (4,), (6,), (9,)], "a int") == ["unknown", "0-1", "2-3", "4-5", "6-8", "9+"]
    paths = ["pyproject.toml", "src/a/pyproject.toml", "x/requirements.txt", "x/pom.xml"]
    assert [tuple(r) for r in run(spark, S.manifest_priority, [(p,) for p in paths], "a string")] == [(0, 0, paths[0]), (1, 2, paths[1]), (2, 1, paths[2]), (3, 1, paths[3])]
    assert run(spark, lambda a: S.manifest_paths(a, ("vendor",)), [(["x/go.mod", "vendor/go.mod", "src/b/package.json", "pyproject.toml", "a.py"],)], "a array<string>") == [["pyproject.toml", "src/b/package.json", "x/go.mod"]]
    assert run(spark, lambda a: S.import_paths(a, (".py",), cap=2), [(["z.py", "src/b.py", "a.py", "x.js"],)], "a array<string>") == [["src/b.py", "a.py"]]
    assert run(spark, S.subprojects, [(["packages/a", "apps/b", "packages", "x/y"],)], "a array<string>") == [2]
    days = {(datetime.date(2026, 3, 25),): datetime.date(2026, 2, 25), (datetime.date(2026, 3, 31),): datetime.date(2026, 2, 28)}
    assert run(spark, lambda d: S.freshness_cutoff(d, 1), list(days), "a date") == list(days.values())


def test_scores_and_verdicts(spark):
    assert run(spark, S.verdict, [(0.5,), (-0.5,), (1e-12,)], "a double") == ["improved", "regressed", "unchanged"]
    assert run(spark, lambda a: S.verdict(a, "lower"), [(0.5,)], "a double") == ["regressed"]
    assert run(spark, lambda a: S.scaled(a, 0, 10, 0, 100), [(5.0,), (20.0,)], "a double") == [50.0, 100.0]
    assert run(spark, lambda n, c: S.sample_size(n, 0.1, c), [(5, 9), (95, 99), (500, 20)], "a int, b int") == [1, 10, 20]
    assert run(spark, lambda a, b, c: S.anchor_multiplier(a, b, c), [(0, 1, False), (1, 0, False), (0, 0, False)], "a int, b int, c boolean") == [1.0, 0.35, 0.2]
    assert run(spark, S.family_affine, [(False, 2, 10), (False, 1, 2), (True, 0, 9)], "a boolean, b int, c int") == [True, False, True]


def test_manifest_parsers(spark):
    files = [
        (1, "a/pyproject.toml", '[project]\ndependencies = ["OpenAI[x]>=1", "torch"]\n[tool.poetry.dependencies]\npython = "^3"\nrich = "*"', {"openai": "runtime", "torch": "runtime", "rich": "runtime"}),
        (2, "Cargo.toml", '[dependencies]\nserde = { version = "1" }\n[dev-dependencies]\ninsta = "1"', {"serde": "runtime", "insta": "dev"}),
        (3, "go.mod", "module m\nrequire github.com/a/one v1\nrequire (\n\tgithub.com/b/two v2 // indirect\n)", {"one": "runtime", "two": "runtime"}),
        (4, "package.json", '{"dependencies": {"@AI-sdk/openai": "1"}, "devDependencies": {"jest": "2"}, "peerDependencies": {"zod": "3"}}', {"@ai-sdk/openai": "runtime", "jest": "dev", "zod": "runtime"}),
        (5, "requirements.txt", "# c\n-r x\n\nFlask==2\n", {"flask": "runtime"}),
        (6, "pyproject.toml", "not [toml", {}), (7, "package.json", "{", {}), (8, "other.txt", "x", {}),
    ]
    rows = P.manifests(spark.createDataFrame([f[:3] for f in files], "repo_id long, path string, text string")).collect()
    for i, _, _, want in files:
        assert {r.package_name: r.scope for r in rows if r.repo_id == i} == want


def test_landed_repositories(spark):
    rows = [('{"id": 1, "full_name": "a/b", "stargazers_count": 5, "owner": {"type": "User"}, "license": {"spdx_id": "MIT"}}',), ('{"databaseId": 2, "nameWithOwner": "c/d", "primaryLanguage": {"name": "Go"}, "isFork": true}',)]
    a, b = P.repository(spark.createDataFrame(rows, "json string")).orderBy("repo_id").collect()
    assert (a.full_name, a.stars, a.owner_type, a.license_spdx, a.topics) == ("a/b", 5, "User", "MIT", []) and (b.full_name, b.primary_language, b.is_fork) == ("c/d", "Go", True)
