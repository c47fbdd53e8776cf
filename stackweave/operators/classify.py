"""Rule scores and decisions over repository contexts: expressions over arrays, no Python functions.

A context has repo_id, full_name, description, topics, stars, primary_language, readme_text,
tree_paths, manifest_paths and, as arrays of technology ids, manifest_tech, sbom_tech, import_tech
and provider_tech.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import extension, file_name, in_directories, subprojects
from ..functions.text import contains_any, educational, keyword_sources, product_docs


@dataclass(frozen=True)
class Rules:
    """Thresholds and word lists of the classification."""

    serious: int = 3
    ai: int = 3
    override: int = 5
    min_stars: int = 1000
    exclusion_terms: tuple[str, ...] = ("awesome", "list", "course", "tutorial", "template")
    fixed_terms: tuple[str, ...] = ("awesome", "list", "course", "tutorial")
    extensions: tuple[str, ...] = (".py", ".ts", ".js", ".go", ".rs", ".java")
    lockfiles: tuple[str, ...] = ("poetry.lock", "uv.lock", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "Cargo.lock", "go.sum")
    release_files: tuple[str, ...] = ("CHANGELOG.md", "Dockerfile", "docker-compose.yml")
    strong: tuple[str, ...] = ("curriculum", "syllabus")
    weak: tuple[str, ...] = ("lesson", "exercise", "homework", "chapter")
    topics: tuple[str, ...] = ("llm", "rag", "ai", "agents")
    keywords: tuple[str, ...] = ("llm", "language model", "agent", "rag")
    config_terms: tuple[str, ...] = ("openai", "anthropic", "prompt", "vector")
    segments: dict[str, dict[str, tuple[str, ...]]] = field(default_factory=dict)
    precedence: tuple[str, ...] = ()


def any_path(paths: Column, test) -> Column:
    return F.exists(paths, test)


def share(paths: Column, test) -> Column:
    """ARR-01: the share of paths that pass."""
    return F.when(F.size(paths) > 0, F.size(F.filter(paths, test)).cast("double") / F.size(paths)).otherwise(0.0)


def serious_signals(r: Rules) -> dict[str, tuple[Column, int]]:
    """CLS-01: each signal with its weight."""
    p = F.col("tree_paths")
    code = lambda x: extension(x).isin(*r.extensions)
    sources = F.filter(p, code)
    docs = lambda x: in_directories(x, ("docs", "doc")) | extension(x).isin(".md", ".rst")
    has_manifest = F.size("manifest_paths") > 0
    return {
        "manifest": (has_manifest, 2),
        "lockfile": (any_path(p, lambda x: file_name(x).isin(*r.lockfiles)), 1),
        "code": (F.size(sources) >= 5, 2),
        "tests": (any_path(p, lambda x: in_directories(x, ("tests", "test")) | x.contains("/tests/")), 1),
        "ci": (any_path(p, lambda x: x.startswith(".github/workflows/")), 1),
        "release": (any_path(p, lambda x: file_name(x).isin(*r.release_files)), 1),
        "subprojects": (subprojects(p) >= 2, 1),
        "product docs": (product_docs(F.coalesce("readme_text", F.lit(""))), 1),
        "no language and no manifest": (F.col("primary_language").isNull() & ~has_manifest, -2),
        "mostly documentation": (share(p, docs) >= 0.7, -3),
        "code only in examples": ((F.size(sources) > 0) & F.forall(sources, lambda x: in_directories(x, ("examples", "example", "demos"))), -3),
        "mostly prompts": (share(p, lambda x: x.contains("prompt")) >= 0.5, -2),
        "educational": (educational(F.coalesce("readme_text", F.lit("")), r.strong, r.weak), -4),
    }


def score(signals: dict[str, tuple[Column, int]]) -> tuple[Column, Column]:
    total = F.lit(0)
    for test, weight in signals.values():
        total = total + F.when(test, weight).otherwise(0)
    return total, F.filter(F.array(*[F.when(t, F.lit(n)) for n, (t, _) in signals.items()]), lambda x: x.isNotNull())


def exclusion(r: Rules, terms: Column, serious: Column) -> Column:
    """CLS-02: the reason for exclusion or null; one term can be overridden by a good score."""
    names = F.map_keys(terms)
    only = F.get(names, F.lit(0))
    only_topic = F.get(F.map_values(terms), F.lit(0)) == F.array(F.lit("topics"))
    root = any_path(F.col("manifest_paths"), lambda x: ~x.contains("/"))
    can = only_topic | (root & ~only.isin(*r.fixed_terms))
    excluded = (F.size(names) > 1) | ((F.size(names) == 1) & ((serious < r.override) | ~can))
    return F.when(excluded, F.concat(F.lit("hard exclusion: "), F.array_join(F.array_sort(names), ", ")))


def ai_score(r: Rules) -> Column:
    """CLS-03, ARR-03."""
    capped = lambda c, n: F.least(F.size(c), F.lit(n))
    m, s, i = F.col("manifest_tech"), F.col("sbom_tech"), F.col("import_tech")
    hit = lambda t: F.when(t, 1).otherwise(0)
    return (
        3 * capped(m, 3) + 2 * capped(F.col("provider_tech"), 2) + 2 * capped(F.array_except(s, m), 3) + capped(F.array_except(i, F.array_union(m, s)), 2)
        + hit(contains_any(F.lower(F.array_join("tree_paths", "\n")), r.config_terms)) + hit(F.arrays_overlap(F.transform("topics", F.lower), F.array(*map(F.lit, r.topics))))
        + hit(contains_any(F.lower(F.coalesce("description", F.lit(""))), r.keywords))
    )


def segment_list(r: Rules) -> Column:
    """CLS-04, WIN-05, ARR-06: segments with a positive score, the best first, ties by precedence."""
    techs = F.array_union(F.array_union("manifest_tech", "sbom_tech"), "import_tech")
    blob, about = F.lower(F.array_join("tree_paths", "\n")), F.lower(F.coalesce("description", F.lit("")))
    scored = []
    for name, rule in r.segments.items():
        points = F.lit(0)
        for t in rule.get("topics", ()):
            points = points + F.when(F.array_contains(F.transform("topics", F.lower), t), 1).otherwise(0)
        for t in rule.get("description", ()):
            points = points + F.when(F.contains(about, F.lit(t)), 1).otherwise(0)
        for t in rule.get("technologies", ()):
            points = points + F.when(F.array_contains(techs, t), 1).otherwise(0)
        for t in rule.get("config", ()):
            points = points + F.when(F.contains(blob, F.lit(t)), 1).otherwise(0)
        place = r.precedence.index(name) if name in r.precedence else len(r.precedence)
        scored.append(F.struct((-points).alias("minus"), F.lit(place).alias("place"), F.lit(name).alias("name")))
    if not scored:
        return F.array().cast("array<string>")
    return F.transform(F.array_sort(F.filter(F.array(*scored), lambda x: x["minus"] < 0)), lambda x: x["name"])


def passed(serious: Column, ai: Column, stars: Column, excluded: Column, r: Rules = Rules()) -> dict[str, Column]:
    """FIL-03."""
    ok = (serious >= r.serious) & excluded.isNull()
    relevant = ok & (ai >= r.ai)
    return {"passed_candidate_filter": stars >= r.min_stars, "passed_serious_filter": ok, "passed_ai_relevance_filter": relevant, "passed_major_filter": relevant & (stars >= r.min_stars)}


def classify(contexts: DataFrame, r: Rules = Rules()) -> DataFrame:
    """CLS-05: contexts to decisions."""
    total, notes = score(serious_signals(r))
    terms = keyword_sources({"name": F.col("full_name"), "description": F.col("description"), "topics": F.array_join("topics", " ")}, r.exclusion_terms)
    df = contexts.withColumns({"score_serious": total, "notes": notes, "_terms": terms, "score_ai": ai_score(r), "segments": segment_list(r)})
    df = df.withColumn("exclusion_reason", exclusion(r, F.col("_terms"), F.col("score_serious")))
    df = df.withColumns(passed(F.col("score_serious"), F.col("score_ai"), F.col("stars"), F.col("exclusion_reason"), r))
    primary = F.when(F.col("passed_major_filter"), F.get("segments", F.lit(0)))
    return df.select("repo_id", "full_name", "score_serious", "score_ai", "exclusion_reason", *passed(F.lit(0), F.lit(0), F.lit(0), F.lit(None)), primary.alias("primary_segment"), "segments", "notes")


def hard_filter(repos: DataFrame, min_stars: int = 1000) -> DataFrame:
    """FIL-01."""
    return repos.filter(~F.col("is_archived") & ~F.col("is_fork") & ~F.col("is_template") & (F.col("stars") >= min_stars))


ANCHOR_CATEGORIES = ("model_access", "orchestration_and_agents", "serving_inference_and_local_runtimes")


def llm_anchor(providers: tuple[str, ...], categories: tuple[str, ...] = ANCHOR_CATEGORIES, ids: tuple[str, ...] = (), capabilities: tuple[str, ...] = ("llm",)) -> Column:
    """CLS-06."""
    known = F.col("provider_id").isin(*providers) | F.col("category_id").isin(*categories) | F.col("technology_id").isin(*ids) | F.arrays_overlap("capabilities", F.array(*map(F.lit, capabilities)))
    return F.coalesce(known, F.lit(False))


def found_by(sources: Column, queries: Column) -> tuple[Column, Column, Column]:
    """CLS-10: by search, by anchor, only as a seed."""
    search = F.exists(queries, lambda q: ~q.startswith("repo:"))
    anchor = F.array_contains(sources, "anchor")
    return search, anchor, ~search & ~anchor


def judged(decisions: DataFrame, judge: DataFrame, override: bool = True, least: str = "high") -> DataFrame:
    """JDG-01: decisions with the judge's word: a validation row decides; a hardening row only if overriding is on and its confidence suffices."""
    rank = lambda c: F.when(c == "high", 2).when(c == "medium", 1).otherwise(0)
    joined = decisions.join(judge.select("repo_id", "judge_mode", "include_in_final_set", "confidence"), "repo_id", "left")
    decides = (F.col("judge_mode") == "validation") | ((F.col("judge_mode") == "hardening") & F.lit(override) & (rank(F.col("confidence")) >= rank(F.lit(least))))
    decides = F.coalesce(decides, F.lit(False))
    return joined.withColumns(
        {
            "judge_applied": F.col("judge_mode").isNotNull(),
            "judge_override_applied": decides & ~F.col("include_in_final_set").eqNullSafe(F.col("passed_major")),
            "rule_passed": F.col("passed_major"),
            "passed_major": F.when(decides, F.col("include_in_final_set")).otherwise(F.col("passed_major")),
        }
    )


def judge_wanted(serious: Column, ai: Column, excluded: Column, r: Rules = Rules()) -> Column:
    """FIL-12: excluded, or close to a threshold."""
    return excluded.isNotNull() | (F.abs(serious - r.serious) <= 1) | (F.abs(ai - r.ai) <= 1)


def judge_candidates(decisions: DataFrame, done: DataFrame, cap: int, seed: str) -> DataFrame:
    """JDG-02: cases for hardening up to the cap, then a validation sample of finals fills it; judged ones are left out."""
    fresh = decisions.join(done.select("repo_id").distinct(), "repo_id", "left_anti")
    hard = fresh.filter(judge_wanted(F.col("score_serious"), F.col("score_ai"), F.col("exclusion_reason"))).withColumn("mode", F.lit("hardening"))
    rest = fresh.filter(~judge_wanted(F.col("score_serious"), F.col("score_ai"), F.col("exclusion_reason")) & F.col("passed_major")).withColumn("mode", F.lit("validation"))
    key = F.md5(F.concat(F.col("repo_id").cast("string"), F.lit(f"-{seed}")))
    return hard.unionByName(rest).orderBy(F.col("mode"), key, "repo_id").limit(cap).select("repo_id", "mode")


def stratified_sample(decisions: DataFrame, n: int, seed: str) -> DataFrame:
    """JDG-03: round-robin over segments, each in a seeded order that both engines can make."""
    from .resolve import round_robin

    key = F.md5(F.concat(F.col("repo_id").cast("string"), F.lit(f"-{seed}")))
    return round_robin(decisions, "primary_segment", [key, F.col("repo_id")], [F.col("primary_segment")], n).select("repo_id", "primary_segment", "turn")
