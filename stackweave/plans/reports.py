"""Reports over decisions, edges, evidence and technologies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.stats import coarse_score, ratio, top_per_group, wilson


def finals(decisions: DataFrame) -> DataFrame:
    """FIL-02: null counts as not passed."""
    return decisions.filter(F.coalesce("passed_major", F.lit(False)))


def funnel(decisions: DataFrame) -> DataFrame:
    """AGG-01."""
    return decisions.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(c) for c in ("passed_candidate", "passed_serious", "passed_ai", "passed_major")])


def adoption(edges: DataFrame, decisions: DataFrame, key: str = "technology_id") -> DataFrame:
    """AGG-02: repositories of finals for each key, and their share; null keys are left out."""
    total = finals(decisions).agg(F.count(F.lit(1)).alias("n_finals"))
    counts = edges.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct("repo_id").alias("n_repos"))
    return counts.crossJoin(F.broadcast(total)).select(key, "n_repos", ratio(F.col("n_repos"), F.col("n_finals")).alias("share"))  # one row


def top(df: DataFrame, count: str, key: str, n: int) -> DataFrame:
    """TOP-01: ties by key."""
    return df.orderBy(F.col(count).desc(), F.col(key)).limit(n)


def frequency(df: DataFrame, key: Column, default: str = "Unknown") -> DataFrame:
    """AGG-03."""
    return df.groupBy(F.coalesce(key, F.lit(default)).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def missing_edges(decisions: DataFrame, edges: DataFrame) -> DataFrame:
    """JOI-04: finals without an edge."""
    return finals(decisions).join(edges.select("repo_id").distinct(), "repo_id", "left_anti")


def gap_reasons(decisions: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """AGG-08, AGG-09, TOP-02: finals without an edge, with what evidence they have."""
    seen = evidence.groupBy("repo_id").agg(F.count_if(F.col("technology_id").isNull()).alias("unmatched"), F.count_if(F.col("technology_id").isNotNull()).alias("mapped"))
    reason = F.when(F.coalesce("unmatched", F.lit(0)) > 0, "unmapped_dependency_evidence").when(F.coalesce("mapped", F.lit(0)) > 0, "mapped_without_edge").otherwise("no_dependency_evidence")
    return missing_edges(decisions, edges).join(seen, "repo_id", "left").select("repo_id", "full_name", "stars", F.coalesce("unmatched", F.lit(0)).alias("unmatched"), reason.alias("reason"))


def unmatched_packages(evidence: DataFrame, repos: DataFrame) -> DataFrame:
    """FIL-06: evidence of no technology, without noise and own packages."""
    rows = evidence.filter("technology_id is null").join(repos.select("repo_id", "full_name"), "repo_id")
    return rows.filter(~X.suppressed_package(F.col("package_name"), F.col("full_name")))


def unmatched_prefixes(evidence: DataFrame, repos: DataFrame) -> DataFrame:
    """STR-05, AGG-03, FIL-09: prefixes with counts and kinds."""
    rows = unmatched_packages(evidence, repos).withColumns({"prefix": X.package_prefix(F.col("package_name")), "ai": X.ai_affinity(F.col("package_name")).cast("int")})
    g = rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.sum("ai").alias("ai_count"))
    return g.withColumns({"is_commodity": X.commodity_prefix(F.col("prefix"), F.col("ai_count")), "is_ai": X.ai_prefix(F.col("prefix"), F.col("ai_count"))})


def evidence_profiles(decisions: DataFrame, edges_or_evidence: DataFrame) -> DataFrame:
    """AGG-04, AGG-11: how many finals have which profile."""
    kinds = edges_or_evidence.groupBy("repo_id").agg(F.collect_set("evidence_type").alias("kinds"))
    each = finals(decisions).join(kinds, "repo_id", "left").select(X.evidence_profile(F.coalesce("kinds", F.array().cast("array<string>"))).alias("profile"))
    return each.groupBy("profile").agg(F.count(F.lit(1)).alias("n_repos"))


def evidence_tiers(decisions: DataFrame, edges: DataFrame) -> DataFrame:
    """AGG-10: direct evidence only, with reviewed fallbacks, and all finals: one scan of the edges."""
    direct = F.col("evidence_type").isin("manifest", "sbom", "import")
    own = edges.join(finals(decisions).select("repo_id"), "repo_id")
    e = own.agg(F.count_distinct(F.when(direct, F.col("repo_id"))).alias("r1"), F.count_if(direct).alias("e1"), F.count_distinct("repo_id").alias("r2"), F.count(F.lit(1)).alias("e2"))
    n = finals(decisions).agg(F.count(F.lit(1)).alias("r3"))
    tiers = F.array(*[F.struct(F.lit(t).alias("tier"), F.col(r).alias("n_repos"), F.col(x).alias("n_edges")) for t, r, x in (("direct_only", "r1", "e1"), ("reviewed_fallback", "r2", "e2"), ("full_population", "r3", "e2"))])
    return e.crossJoin(n).select("r3", F.inline(tiers)).select("tier", "n_repos", "n_edges", ratio(F.col("n_repos"), F.col("r3")).alias("share"))


def families(evidence: DataFrame, decisions: DataFrame, edges: DataFrame) -> DataFrame:
    """AGG-05..07, MAT-04, MAT-07: candidate families of packages without a technology."""
    rows = evidence.filter("technology_id is null").withColumn("family", X.family_id(F.col("package_name"))).filter(~X.low_signal_family(F.col("family")) & ~X.ignored_in_discovery(F.col("package_name"), F.lit(None).cast("string")))
    missing = missing_edges(decisions, edges).select("repo_id", F.lit(True).alias("missing"))
    each = rows.groupBy("family", "repo_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(X.ai_affinity(F.col("package_name"))).alias("hints"), F.count_if(F.col("package_name").startswith("@")).alias("scoped"))
    joined = each.join(decisions.select("repo_id", "stars", "passed_major"), "repo_id").join(missing, "repo_id", "left")
    g = joined.groupBy("family").agg(
        F.count(F.lit(1)).alias("n_repos"), F.count_if("passed_major").alias("n_finals"), F.count_if("missing").alias("n_missing"), F.sum("stars").alias("stars"),
        F.sum("n").alias("n_rows"), F.sum("hints").alias("n_hints"), F.sum("scoped").alias("n_scoped"),
    )
    return g.withColumn("penalty", X.generic_penalty(F.col("family")))


def family_priority(fams: DataFrame) -> DataFrame:
    """MAT-04, TOP-04, TOP-05."""
    s = coarse_score(F.col("n_missing"), F.col("n_finals"), F.col("n_repos"), F.col("stars"), F.lit(0), F.col("penalty"))
    return fams.withColumn("score", s)


def family_packages(evidence: DataFrame, n: int = 5) -> DataFrame:
    """TOP-06: the n commonest packages of each family."""
    g = evidence.filter("technology_id is null").withColumn("family", X.family_id(F.col("package_name"))).groupBy("family", "package_name").agg(F.count(F.lit(1)).alias("n"))
    return top_per_group(g, ["family"], [F.col("n").desc(), F.col("package_name")], n)


def audit(decisions: DataFrame, judge: DataFrame) -> DataFrame:
    """AGG-12, MAT-02: of the validated finals, how many the judge would exclude, with the interval of the rate."""
    v = finals(decisions).join(judge.filter("judge_mode = 'validation'"), "repo_id")
    g = v.agg(F.count(F.lit(1)).alias("n_sample"), F.count_if(~F.col("include_in_final_set")).alias("n_excluded"), F.count_if(~F.col("ai_relevant")).alias("n_irrelevant"))
    low, high = wilson(F.col("n_excluded"), F.col("n_sample"))
    return g.withColumns({"rate": ratio(F.col("n_excluded"), F.col("n_sample")), "low": low, "high": high})


def robustness(decisions: DataFrame) -> DataFrame:
    """AGG-13: finals by rule and as adjusted; null against false is a change."""
    return decisions.agg(F.count_if("rule_passed_major").alias("rule_only"), F.count_if("passed_major").alias("adjusted"), F.count_if(~F.col("rule_passed_major").eqNullSafe(F.col("passed_major"))).alias("changed"))


def provider_pairs(edges: DataFrame, technologies: DataFrame) -> DataFrame:
    """AGG-16: repositories that use both providers."""
    from ..operators.resolve import pairs

    return pairs(edges.join(technologies.select("technology_id", "provider_id"), "technology_id").filter("provider_id is not null"), item="provider_id")


def category_stats(edges: DataFrame, technologies: DataFrame) -> DataFrame:
    """AGG-17."""
    total = edges.agg(F.count(F.lit(1)).alias("all_edges"))
    g = edges.join(technologies.select("technology_id", "category_id"), "technology_id").groupBy("category_id").agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("repo_id").alias("n_repos"), F.count_distinct("technology_id").alias("n_technologies"))
    return g.crossJoin(F.broadcast(total)).select("category_id", "n_edges", "n_repos", "n_technologies", ratio(F.col("n_edges"), F.col("all_edges")).alias("share"))  # one row


def family_rollup(edges: DataFrame, technologies: DataFrame, family: str = "family_no") -> DataFrame:
    """AGG-18: a family's repositories count once."""
    return edges.join(technologies.select("technology_id", family), "technology_id").groupBy(family).agg(F.count_distinct("repo_id").alias("n_repos"), F.count_distinct("technology_id").alias("n_technologies"))


def summary(df: DataFrame, value: str) -> DataFrame:
    """AGG-19: exact percentiles with linear interpolation."""
    p = lambda q: F.percentile(value, q)
    return df.agg(F.min(value).alias("least"), p(0.25).alias("p25"), p(0.5).alias("median"), p(0.75).alias("p75"), F.max(value).alias("most"))


def vendor_terms(names: DataFrame, stop: tuple[str, ...], least: int = 4) -> DataFrame:
    """AGG-22: the words of names (name) with enough letters, apart from stop words."""
    words = names.select(F.explode(F.split(F.lower("name"), "[@/_. -]+")).alias("term"))
    return words.filter((F.length("term") >= least) & ~F.col("term").isin(*stop)).distinct()


def weighted_adoption(edges: DataFrame, repos: DataFrame) -> DataFrame:
    """EXT-01: sum of the square roots of stars, in exact decimals."""
    each = edges.select("repo_id", "technology_id").distinct().join(repos.select("repo_id", "stars"), "repo_id")
    root = F.floor(F.sqrt(F.col("stars").cast("double")) * 1_000_000).cast("long")
    return each.groupBy("technology_id").agg((F.sum(root).cast("double") / 1e6).alias("weighted_repo_count"))


def share_within(edges: DataFrame, decisions: DataFrame, band: str) -> DataFrame:
    """EXT-02, EXT-03: a technology's share of the finals of each segment or language."""
    own = finals(decisions).select("repo_id", F.coalesce(F.col(band), F.lit("Unknown")).alias("band"))
    size = own.groupBy("band").agg(F.count(F.lit(1)).alias("band_repos"))
    g = edges.select("repo_id", "technology_id").distinct().join(own, "repo_id").groupBy("band", "technology_id").agg(F.count(F.lit(1)).alias("n_repos"))
    return g.join(size, "band").select("band", "technology_id", "n_repos", ratio(F.col("n_repos"), F.col("band_repos")).alias("share"))


def tail_coverage(edges: DataFrame, decisions: DataFrame, technologies: DataFrame, tail: tuple[str, ...]) -> DataFrame:
    """EXT-05: finals of each segment that use a technology of the operational tail."""
    using = edges.join(technologies.filter(F.col("category_id").isin(*tail)).select("technology_id"), "technology_id", "left_semi").select("repo_id").distinct().withColumn("covered", F.lit(True))
    g = finals(decisions).join(using, "repo_id", "left").groupBy("primary_segment").agg(F.count(F.lit(1)).alias("n_repos"), F.count_if("covered").alias("n_covered"))
    return g.withColumn("coverage", ratio(F.col("n_covered"), F.col("n_repos")))


def scoped_ranking(evidence: DataFrame, decisions: DataFrame, scopes: tuple[str, ...] = ("runtime", "prod", "optional")) -> DataFrame:
    """EXT-06: repositories by technology from evidence of the scopes only."""
    own = evidence.filter(F.col("scope").isin(*scopes) & F.col("technology_id").isNotNull()).join(finals(decisions).select("repo_id"), "repo_id", "left_semi")
    return own.groupBy("technology_id").agg(F.count_distinct("repo_id").alias("n_repos"))


def benchmark(entities: DataFrame, repos: DataFrame, decisions: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """JOI-16: for entities (entity_id, repo_name, technology_id, prefix, expectation, split) whether each was discovered, included, adopted and seen in evidence."""
    from ..operators.resolve import longest_prefix

    names = repos.select(F.lower("full_name").alias("repo_name"), F.lit(True).alias("discovered")).distinct()
    inside = finals(decisions).select(F.lower("full_name").alias("repo_name"), F.lit(True).alias("included")).distinct()
    used = edges.groupBy("technology_id").agg(F.count_distinct("repo_id").alias("adoption"))
    by_tech = evidence.filter("technology_id is not null").groupBy("technology_id").agg(F.count(F.lit(1)).alias("by_tech"))
    rules = entities.filter("prefix is not null").select("prefix", F.col("entity_id").alias("technology_id"))
    packages = evidence.filter("technology_id is null").groupBy("package_name").agg(F.count(F.lit(1)).alias("n"))
    by_prefix = longest_prefix(packages, rules).join(packages, "package_name").groupBy(F.col("technology_id").alias("entity_id")).agg(F.sum("n").alias("by_prefix"))
    out = entities.join(names, "repo_name", "left").join(inside, "repo_name", "left").join(used, "technology_id", "left").join(by_tech, "technology_id", "left").join(by_prefix, "entity_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return out.select(
        "entity_id", "expectation", "split", yes("discovered").alias("discovered"), yes("included").alias("included"), F.coalesce("adoption", F.lit(0)).alias("adoption"),
        (F.coalesce("by_tech", F.lit(0)) + F.coalesce("by_prefix", F.lit(0))).alias("n_evidence"),
    )


def benchmark_rates(found: DataFrame) -> DataFrame:
    """AGG-15."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    flags = found.withColumns({"adopted": F.col("adoption") > 0, "seen": F.col("n_evidence") > 0})
    return flags.groupBy("expectation", "split").agg(F.count(F.lit(1)).alias("n"), *[rate(c).alias(f"{c}_rate") for c in ("discovered", "included", "adopted", "seen")])


def benchmark_gaps(found: DataFrame) -> DataFrame:
    """REP-03 in part: an additive urgency with its reasons; prioritized_gaps has the seven checks."""
    checks = [
        ("not discovered", ~F.col("discovered"), 100), ("not included", F.col("discovered") & ~F.col("included"), 70), ("no adoption", F.col("adoption") == 0, 60),
        ("no evidence", F.col("n_evidence") == 0, 40), ("holdout", F.col("split") == "holdout", 20), ("evidence without adoption", (F.col("n_evidence") > 0) & (F.col("adoption") == 0), 30),
    ]
    urgency = F.lit(0)
    for _, test, w in checks:
        urgency = urgency + F.when(test, w).otherwise(0)
    reasons = F.array_join(F.filter(F.array(*[F.when(t, F.lit(n)) for n, t, _ in checks]), lambda x: x.isNotNull()), "; ")
    return found.filter("expectation = 'positive'").select("entity_id", urgency.alias("urgency"), reasons.alias("reasons")).filter("urgency > 0")


def prioritized_gaps(found: DataFrame) -> DataFrame:
    """REP-03: the seven checks of positive entities, with reasons and actions; a null flag counts as false."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    discovered, included = yes("repo_discovered"), yes("repo_included")
    checks = [
        (~discovered, 100, "benchmark repo not discovered", "add discovery seed or discovery query coverage"),
        (discovered & ~yes("repo_discovered_by_search"), 30, "benchmark repo discovered only via exact seed", "improve topic or description query coverage"),
        (discovered & yes("is_anchor_entity") & ~yes("repo_discovered_by_anchor"), 20, "anchor entity is not covered by anchor seed inputs", "add or fix anchor repo_names coverage"),
        (discovered & ~included, 70, "benchmark repo discovered but not included", "review classification thresholds or exclusions"),
        (included & ~yes("repo_identity_mapped"), 80, "repo included but canonical repo identity is not mapped", "add or fix repo_names mapping in registry"),
        (yes("third_party_dependency_evidence_found") & ~yes("third_party_adoption"), 60, "dependency evidence exists but no third-party adoption edge was created", "add or fix package_prefix mapping in registry"),
        (~yes("dependency_evidence_found"), 40, "no dependency evidence found for benchmark entity", "expand package prefixes or manifest/SBOM extraction coverage"),
    ]
    hits = F.filter(F.array(*[F.when(t, F.struct(F.lit(w).alias("w"), F.lit(r).alias("r"), F.lit(a).alias("a"))) for t, w, r, a in checks]), lambda x: x.isNotNull())
    out = found.filter("expectation = 'positive'").withColumn("__sw_hits", hits).filter(F.size("__sw_hits") > 0)
    score = F.aggregate("__sw_hits", F.lit(0), lambda n, x: n + x.w)
    return out.select("entity_id", "display_name", score.alias("priority_score"), F.col("__sw_hits.r").alias("reasons"), F.array_distinct(F.col("__sw_hits.a")).alias("suggested_actions"))


def review_queue(gaps: DataFrame, changed: DataFrame, readme_only: DataFrame, bench: DataFrame) -> DataFrame:
    """TOP-09: all that wants a look, by priority, kind and name."""
    rows = [
        gaps.select((1000 + F.col("unmatched")).cast("long").alias("priority"), F.lit("missing_edge").alias("kind"), F.col("full_name").alias("name")),
        changed.select((500 + F.col("stars")).cast("long").alias("priority"), F.lit("audit").alias("kind"), F.col("full_name").alias("name")),
        readme_only.select(F.col("stars").cast("long").alias("priority"), F.lit("readme").alias("kind"), F.col("full_name").alias("name")),
        bench.select(F.col("urgency").cast("long").alias("priority"), F.lit("benchmark").alias("kind"), F.col("entity_id").cast("string").alias("name")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.orderBy(F.col("priority").desc(), "kind", "name")


CATEGORY_TERMS = (
    (("vector", "qdrant", "weaviate", "milvus", "chroma"), "vector_and_knowledge_storage"),
    (("agent", "lang", "crew", "workflow"), "orchestration_and_agents"),
    (("serve", "inference", "vllm", "ollama", "runtime"), "serving_inference_and_local_runtimes"),
)


def suggestions(fams: DataFrame, known: DataFrame, least: int = 2) -> DataFrame:
    """REP-05, REP-06 in part: families worth registering: not known, not generic, with enough finals; category by their words, confidence by their hints."""
    category = F.lit("ai_developer_tools_and_sdk_families")
    for terms, name in reversed(CATEGORY_TERMS):
        category = F.when(X.contains_any(F.col("family"), terms), name).otherwise(category)
    confidence = F.when(ratio(F.col("n_hints"), F.col("n_rows")) >= 0.5, "high").when(F.col("n_hints") > 0, "medium").otherwise("low")
    fresh = fams.join(known.select(F.col("token").alias("family")).distinct(), "family", "left_anti").filter((F.col("n_finals") >= least) & (F.col("penalty") < 0.65))
    return fresh.select("family", "n_finals", category.alias("category_id"), confidence.alias("confidence"))


def report_summary(repos: DataFrame, decisions: DataFrame, edges: DataFrame, technologies: DataFrame, n: int = 20) -> dict[str, DataFrame]:
    """REP-01, JOI-01..03: the funnel, and the n technologies, providers and categories that most finals use."""
    own = edges.join(finals(decisions).select("repo_id"), "repo_id", "left_semi")
    named = own.join(technologies, "technology_id", "left")
    return {
        "funnel": funnel(decisions),
        "technologies": top(adoption(own, decisions), "n_repos", "technology_id", n),
        "providers": top(adoption(named, decisions, "provider_id"), "n_repos", "provider_id", n),
        "categories": top(adoption(named, decisions, "category_id"), "n_repos", "category_id", n),
        "languages": top(frequency(repos.join(finals(decisions).select("repo_id"), "repo_id", "left_semi"), F.col("primary_language")), "n", "label", n),
    }


def gap_report(repos: DataFrame, decisions: DataFrame, edges: DataFrame, evidence: DataFrame, n: int = 20) -> dict[str, DataFrame]:
    """REP-02: finals without an edge by reason, their queue, and the commonest packages and AI prefixes without a technology."""
    gaps = gap_reasons(decisions, edges, evidence)
    prefixes = unmatched_prefixes(evidence, repos)
    return {
        "reasons": gaps.groupBy("reason").agg(F.count(F.lit(1)).alias("n_repos")),
        "queue": gaps.orderBy((F.col("reason") == "unmapped_dependency_evidence").desc(), F.col("unmatched").desc(), F.col("stars").desc(), "full_name").limit(n),
        "packages": top(unmatched_packages(evidence, repos).groupBy("package_name").agg(F.count(F.lit(1)).alias("n")), "n", "package_name", n),
        "prefixes": top(prefixes, "n", "prefix", n),
        "ai_prefixes": top(prefixes.filter("is_ai"), "n", "prefix", n),
    }
