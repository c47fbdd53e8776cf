"""Queries over the test tables, one or more for each operator, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import stats as S
from .functions import text as X
from .functions import words as W
from .lens import Lens, oracle
from .operators import classify as C
from .operators import edges as E
from .operators import graph as G
from .operators import parsers as P
from .operators import resolve as R
from .plans import discovery as D
from .plans import jobs as J
from .plans import reports as Q
from .plans import snapshots as N

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a Lens as a query, with its DuckDB text."""

    def add(f: Callable[[Lens], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Lens(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = oracle(sql.replace("count_if(", "count(*) filter (where "))
        return f

    return add


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


STEM_RE = "(^|[^a-z0-9])(" + "|".join(W.AI_STEMS) + ")"
WORD_RE = "(^|[^a-z0-9])(" + "|".join(W.AI_TOKENS) + ")([^a-z0-9]|$)"
AI = lambda c: f"(regexp_matches(lower({c}), '{STEM_RE}') or regexp_matches(lower({c}), '{WORD_RE}'))"
PREFIX = lambda c: f"case when {c} like '@%' and contains({c}, '/') then split_part({c}, '/', 1) || '/' when contains({c}, '-') then split_part({c}, '-', 1) when contains({c}, '_') then split_part({c}, '_', 1) when contains({c}, '.') then split_part({c}, '.', 1) else {c} end"
FAMILY = lambda c: (
    f"case when {c} like '@%' and contains({c}, '/') then case when length(regexp_extract(split_part({c}, '/', 2), '^[^-_.]*')) >= 3 and regexp_extract(split_part({c}, '/', 2), '^[^-_.]*') not in ({quoted(W.GENERIC_BASES)}) "
    f"then regexp_extract(split_part({c}, '/', 2), '^[^-_.]*') else regexp_replace(substr(split_part({c}, '/', 1), 2), '^(.+?)(hq|inc|labs|dev)$', '\\1') end else regexp_extract({c}, '^[^-_.]*') end"
)
FINALS = "finals as (select * from decisions where coalesce(passed_major, false))"
MISSING = f"{FINALS}, missing as (select * from finals where repo_id not in (select repo_id from edges))"
PAIRS = "pairs as (select a.technology_id as \"left\", b.technology_id as \"right\", count(*) as weight from edges a join edges b on a.repo_id = b.repo_id and a.technology_id < b.technology_id group by all)"
NOISY = f"(lower(package_name) in ({quoted(W.NOISY_NAMES)}) or {' or '.join(f'lower(package_name) like {chr(39)}{s}%{chr(39)}' for s in W.NOISY_STEMS)})"
UNMATCHED = f"unmatched as (select e.*, r.full_name from evidence e join repos r on e.repo_id = r.repo_id where e.technology_id is null and not {NOISY} and not (package_name like '@%' and replace(substr(split_part(package_name, '/', 1), 2), '-', '') = split_part(full_name, '/', 1)))"


# Adoption and coverage


@query("select count(*) as total, count_if(passed_candidate) as passed_candidate, count_if(passed_serious) as passed_serious, count_if(passed_ai) as passed_ai, count_if(passed_major) as passed_major from decisions")
def q_funnel(t):
    return Q.funnel(t.decisions)


@query(f"with {FINALS} select technology_id, count(distinct repo_id) as n_repos, cast(count(distinct repo_id) as double) / cast((select count(*) from finals) as double) as share from edges group by technology_id order by n_repos desc, technology_id limit 10")
def q_top_technologies(t):
    return Q.top(Q.adoption(t.edges, t.decisions), "n_repos", "technology_id", 10)


@query(f"with {FINALS} select provider_id, count(distinct repo_id) as n_repos, cast(count(distinct repo_id) as double) / cast((select count(*) from finals) as double) as share from edges join technologies using (technology_id) where provider_id is not null group by provider_id order by n_repos desc, provider_id limit 10")
def q_top_providers(t):
    return Q.top(Q.adoption(t.edges.join(t.technologies, "technology_id"), t.decisions, "provider_id"), "n_repos", "provider_id", 10)


@query("select coalesce(primary_language, 'Unknown') as label, count(*) as n from repos group by 1")
def q_language_frequency(t):
    return Q.frequency(t.repos, F.col("primary_language"))


@query(f"with {MISSING} select repo_id, full_name, stars from missing")
def q_gap_missing_edges(t):
    return Q.missing_edges(t.decisions, t.edges).select("repo_id", "full_name", "stars")


GAP = f"{MISSING}, seen as (select repo_id, count_if(technology_id is null) as unmatched, count_if(technology_id is not null) as mapped from evidence group by repo_id), gaps as (select m.repo_id, full_name, stars, coalesce(unmatched, 0) as unmatched, case when coalesce(unmatched, 0) > 0 then 'unmapped_dependency_evidence' when coalesce(mapped, 0) > 0 then 'mapped_without_edge' else 'no_dependency_evidence' end as reason from missing m left join seen on m.repo_id = seen.repo_id)"


@query(f"with {GAP} select * from gaps order by reason = 'unmapped_dependency_evidence' desc, unmatched desc, stars desc, full_name limit 50")
def q_gap_queue(t):
    g = Q.gap_reasons(t.decisions, t.edges, t.evidence)
    return g.orderBy((F.col("reason") == "unmapped_dependency_evidence").desc(), F.col("unmatched").desc(), F.col("stars").desc(), "full_name").limit(50)


@query(f"with {GAP} select reason, count(*) as n_repos, cast(sum(unmatched) as bigint) as unmatched from gaps group by reason")
def q_gap_reasons(t):
    return Q.gap_reasons(t.decisions, t.edges, t.evidence).groupBy("reason").agg(F.count(F.lit(1)).alias("n_repos"), F.sum("unmatched").alias("unmatched"))


PREFIXES = f"{UNMATCHED}, p as (select {PREFIX('package_name')} as prefix, count(*) as n, cast(sum(case when {AI('package_name')} then 1 else 0 end) as bigint) as ai_count from unmatched group by 1), c as (select *, case when prefix in ({quoted(X.HIGH_SIGNAL)}) then false when prefix in ({quoted(W.COMMODITY)}) then true else ai_count <= 0 and not {AI('prefix')} end as is_commodity from p)"


@query(f"with {PREFIXES} select prefix, n, ai_count, is_commodity, not (prefix not like '@%' and length(prefix) < 4) and not is_commodity and (prefix in ({quoted(X.HIGH_SIGNAL + X.HIGH_SIGNAL_SCOPES)}) or {AI('prefix')}) as is_ai from c")
def q_unmatched_prefixes(t):
    return Q.unmatched_prefixes(t.evidence, t.repos)


KINDS = f"{FINALS}, k as (select repo_id, list(distinct evidence_type) as kinds from evidence where technology_id is not null group by repo_id), f as (select f.repo_id, list_has_any(kinds, ['manifest', 'sbom', 'import']) as direct, list_contains(kinds, 'readme_mention') as readme, list_contains(kinds, 'repo_identity') as identity, coalesce(len(kinds), 0) as n from finals f left join k on f.repo_id = k.repo_id)"


@query(f"with {KINDS} select case when n = 0 then 'unmapped' when direct and readme then 'mixed_direct_and_fallback' when direct then 'direct_only' when readme and identity and n = 2 then 'repo_identity_plus_fallback' when readme and n = 1 then 'readme_only' when identity and n = 1 then 'repo_identity_only' else 'other' end as profile, count(*) as n_repos from f group by 1")
def q_evidence_profiles(t):
    return Q.evidence_profiles(t.decisions, t.evidence.filter("technology_id is not null"))


@query(f"with {FINALS}, e as (select edges.*, evidence_type in ('manifest', 'sbom', 'import') as direct from edges join finals using (repo_id)), x as (select 'direct_only' as tier, count(distinct repo_id) as n_repos, count(*) as n_edges from e where direct union all select 'reviewed_fallback', count(distinct repo_id), count(*) from e union all select 'full_population', (select count(*) from finals), (select count(*) from e)) select tier, n_repos, n_edges, cast(n_repos as double) / cast((select count(*) from finals) as double) as share from x")
def q_evidence_tiers(t):
    return Q.evidence_tiers(t.decisions, t.edges)


@query("with v as (select d.repo_id, j.include_in_final_set, j.ai_relevant from decisions d join judge j on d.repo_id = j.repo_id where passed_major and judge_mode = 'validation'), c as (select count(*) as n_sample, count_if(not include_in_final_set) as n_excluded, count_if(not ai_relevant) as n_irrelevant from v), p as (select *, cast(n_excluded as double) / cast(n_sample as double) as rate, cast(n_sample as double) as n from c) select n_sample, n_excluded, n_irrelevant, rate, greatest(0.0::double, (rate + 1.96::double * 1.96::double / (2 * n)) / (1 + 1.96::double * 1.96::double / n) - 1.96::double * sqrt(rate * (1 - rate) / n + 1.96::double * 1.96::double / (4 * n * n)) / (1 + 1.96::double * 1.96::double / n)) as low, least(1.0::double, (rate + 1.96::double * 1.96::double / (2 * n)) / (1 + 1.96::double * 1.96::double / n) + 1.96::double * sqrt(rate * (1 - rate) / n + 1.96::double * 1.96::double / (4 * n * n)) / (1 + 1.96::double * 1.96::double / n)) as high from p")
def q_validation_audit(t):
    return Q.audit(t.decisions, t.judge)


@query("select count_if(rule_passed_major) as rule_only, count_if(passed_major) as adjusted, count_if(rule_passed_major is distinct from passed_major) as changed from decisions")
def q_robustness(t):
    return Q.robustness(t.decisions)


@query("select category_id, count(*) as n_edges, count(distinct repo_id) as n_repos, count(distinct technology_id) as n_technologies, cast(count(*) as double) / cast((select count(*) from edges) as double) as share from edges join technologies using (technology_id) group by category_id")
def q_category_stats(t):
    return Q.category_stats(t.edges, t.technologies)


@query("select family_no, count(distinct repo_id) as n_repos, count(distinct technology_id) as n_technologies from edges join technologies using (technology_id) group by family_no")
def q_family_rollup(t):
    return Q.family_rollup(t.edges, t.technologies)


@query("select min(stars) as least, quantile_cont(stars, 0.25) as p25, quantile_cont(stars, 0.5) as median, quantile_cont(stars, 0.75) as p75, max(stars) as most from decisions where passed_major")
def q_star_summary(t):
    return Q.summary(Q.finals(t.decisions), "stars")


@query("with d as (select repo_id, count(*) as degree from edges group by repo_id) select case when degree <= 1 then '1' when degree <= 3 then '2-3' when degree <= 6 then '4-6' when degree <= 10 then '7-10' else '11+' end as bucket, count(*) as n from d group by 1")
def q_degree_histogram(t):
    d = t.edges.groupBy("repo_id").agg(F.count(F.lit(1)).alias("degree"))
    return d.groupBy(S.degree_bucket(F.col("degree")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("select case when score_ai is null then 'unknown' when score_ai <= 1 then '0-1' when score_ai <= 3 then '2-3' when score_ai <= 5 then '4-5' when score_ai <= 8 then '6-8' else '9+' end as band, count(*) as n from decisions group by 1")
def q_score_bands(t):
    return t.decisions.groupBy(S.score_band(F.col("score_ai")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("select technology_id, cast(sum(cast(floor(sqrt(cast(stars as double)) * 1000000) as bigint)) as double) / 1e6 as weighted_repo_count from edges join repos using (repo_id) group by technology_id")
def q_weighted_adoption(t):
    return Q.weighted_adoption(t.edges, t.repos)


@query(f"with {FINALS}, s as (select primary_segment as band, count(*) as c from finals group by 1) select band, technology_id, count(*) as n_repos, cast(count(*) as double) / cast(any_value(c) as double) as share from edges join finals using (repo_id) join s on primary_segment = band group by band, technology_id")
def q_segment_share(t):
    return Q.share_within(t.edges, t.decisions, "primary_segment")


@query(f"with {FINALS}, l as (select f.repo_id, coalesce(primary_language, 'Unknown') as band from finals f join repos r on f.repo_id = r.repo_id), s as (select band, count(*) as c from l group by 1) select l.band, technology_id, count(*) as n_repos, cast(count(*) as double) / cast(any_value(c) as double) as share from edges join l using (repo_id) join s on l.band = s.band group by l.band, technology_id")
def q_language_share(t):
    return Q.share_within(t.edges, t.decisions.join(t.repos.select("repo_id", "primary_language"), "repo_id"), "primary_language")


@query(f"with {FINALS}, u as (select distinct repo_id from edges join technologies using (technology_id) where category_id in ('ASIA', 'EUROPE')) select primary_segment, count(*) as n_repos, count(u.repo_id) as n_covered, cast(count(u.repo_id) as double) / cast(count(*) as double) as coverage from finals f left join u on f.repo_id = u.repo_id group by primary_segment")
def q_tail_coverage(t):
    return Q.tail_coverage(t.edges, t.decisions, t.technologies, ("ASIA", "EUROPE"))


@query(f"with {FINALS} select technology_id, count(distinct repo_id) as n_repos from evidence where scope in ('runtime', 'prod', 'optional') and technology_id is not null and repo_id in (select repo_id from finals) group by technology_id")
def q_scoped_ranking(t):
    return Q.scoped_ranking(t.evidence, t.decisions)


# Filters


@query("select repo_id, stars from repos where not is_archived and not is_fork and not is_template and stars >= 1000")
def q_hard_filter(t):
    return C.hard_filter(t.repos).select("repo_id", "stars")


@query("select repo_id, stars >= 1000 as passed_candidate_filter, score_serious >= 3 and exclusion_reason is null as passed_serious_filter, score_serious >= 3 and exclusion_reason is null and score_ai >= 3 as passed_ai_relevance_filter, score_serious >= 3 and exclusion_reason is null and score_ai >= 3 and stars >= 1000 as passed_major_filter from decisions")
def q_thresholds(t):
    flags = C.passed(F.col("score_serious"), F.col("score_ai"), F.col("stars"), F.col("exclusion_reason"))
    return t.decisions.select("repo_id", *[c.alias(n) for n, c in flags.items()])


@query("select source_path, split_part(source_path, '/', -1) as name, regexp_extract(source_path, '(\\.[^./]+)$', 1) as ext, starts_with(source_path, 'docs/') or starts_with(source_path, 'x/') as excluded, count(*) as n from evidence group by all")
def q_path_predicates(t):
    p = F.col("source_path")
    return t.evidence.groupBy("source_path", S.file_name(p).alias("name"), S.extension(p).alias("ext"), S.in_directories(p, ("docs", "x")).alias("excluded")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {UNMATCHED} select package_name, count(*) as n from unmatched group by 1 order by n desc, package_name limit 25")
def q_unmatched_packages(t):
    return Q.top(Q.unmatched_packages(t.evidence, t.repos).groupBy("package_name").agg(F.count(F.lit(1)).alias("n")), "n", "package_name", 25)


@query("select repo_id, exclusion_reason is not null or abs(score_serious - 3) <= 1 or abs(score_ai - 3) <= 1 as wanted from decisions")
def q_judge_entry(t):
    return t.decisions.select("repo_id", C.judge_wanted(F.col("score_serious"), F.col("score_ai"), F.col("exclusion_reason")).alias("wanted"))


# Argmax, windows, top-k

RANKS = "case evidence_type when 'repo_identity' then 4 when 'manifest' then 3 when 'sbom' then 2 when 'import' then 1 else 0 end desc, case confidence when 'high' then 2 when 'medium' then 1 else 0 end desc, case scope when 'runtime' then 4 when 'optional' then 3 when 'prod' then 2 when 'unknown' then 1 else 0 end desc"
TIE = ["l_partkey", "l_orderkey", "l_linenumber", "source_path", "package_name"]


@query(f"select repo_id, technology_id, evidence_type, confidence, scope, package_name from evidence where technology_id is not null qualify row_number() over (partition by repo_id, technology_id order by {RANKS}, {', '.join(TIE)}) = 1")
def q_edges_argmax(t):
    return E.strongest(t.evidence, E.nulls_last(TIE)).select("repo_id", "technology_id", "evidence_type", "confidence", "scope", "package_name")


@query(f"select repo_id, package_name, source_path, scope, evidence_type from evidence qualify row_number() over (partition by repo_id, package_name, source_path, scope order by case evidence_type when 'manifest' then 3 when 'sbom' then 2 else 0 end desc, case scope when 'runtime' then 2 when 'optional' then 1 else 0 end desc, {', '.join(TIE)}, technology_id) = 1")
def q_distinct_dependencies(t):
    return E.distinct_dependencies(t.evidence, [*TIE, "technology_id"]).select("repo_id", "package_name", "source_path", "scope", "evidence_type")


@query("select repo_id, package_name, source_path, technology_id, strftime(l_shipdate, '%Y-%m-%d') as shipped from evidence where evidence_type = 'import' qualify row_number() over (partition by repo_id, package_name, source_path, technology_id order by l_shipdate desc, l_orderkey desc, l_linenumber desc) = 1")
def q_last_wins(t):
    rows = E.last_wins(t.evidence.filter("evidence_type = 'import'"), ["repo_id", "package_name", "source_path", "technology_id"], ["l_shipdate", "l_orderkey", "l_linenumber"])
    return rows.select("repo_id", "package_name", "source_path", "technology_id", F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"))


@query("with k as (select repo_id, primary_segment, md5(cast(repo_id as varchar) || '-s1') as h from decisions where passed_major), r as (select *, row_number() over (partition by primary_segment order by h, repo_id) as turn from k) select repo_id, primary_segment, cast(turn as int) as turn from r order by turn, primary_segment limit 60")
def q_stratified_sample(t):
    return C.stratified_sample(Q.finals(t.decisions), 60, "s1")


@query("select repo_id, stars from repos order by stars desc, repo_id limit 40")
def q_running_cap(t):
    return R.running_cap(t.repos, [F.col("stars").desc(), F.col("repo_id")], 40).select("repo_id", "stars")


@query("with c as (select provider_id, category_id as label, count(*) as n from technologies where provider_id is not null group by 1, 2) select provider_id, label from c qualify row_number() over (partition by provider_id order by n desc, label) = 1")
def q_provider_label(t):
    return S.commonest(t.technologies.filter("provider_id is not null").select("provider_id", F.col("category_id").alias("label")), "provider_id", "label")


@query("select p_partkey, case when p_size % 2 = 0 then p_brand || ',x' else p_brand || ',' || p_type || ',x' end as kept from part")
def q_unique_ordered(t):
    values = F.array("p_brand", F.when(F.col("p_size") % 2 == 0, F.lower("p_brand")).otherwise(F.col("p_type")), F.upper("p_brand"), F.lit("x"), F.lit("X"))
    return t.part.select("p_partkey", F.array_join(S.unique_ordered(values), ",").alias("kept"))


@query(f"with {PAIRS} select * from pairs order by weight desc, \"left\", \"right\" limit 25")
def q_top_pairs(t):
    return G.top_pairs(R.pairs(G.bipartite(t.edges)), 25)


FAM = f"fam as (select {FAMILY('package_name')} as family, * from evidence where technology_id is null)"


@query(f"with {FAM}, g as (select family, package_name, count(*) as n from fam group by 1, 2) select family, package_name, n, cast(row_number() over (partition by family order by n desc, package_name) as int) as rank from g qualify rank <= 5")
def q_family_packages(t):
    return Q.family_packages(t.evidence)


FAMS = f"{MISSING}, {FAM}, e as (select family, repo_id, count(*) as n, count_if({AI('package_name')}) as hints, count_if(package_name like '@%') as scoped from fam where length(family) >= 3 and lower(package_name) not in ({quoted(W.NOISY_NAMES)}) group by 1, 2), fams as (select family, count(*) as n_repos, count_if(d.passed_major) as n_finals, count(m.repo_id) as n_missing, cast(sum(d.stars) as bigint) as stars, cast(sum(n) as bigint) as n_rows, cast(sum(hints) as bigint) as n_hints, cast(sum(scoped) as bigint) as n_scoped, least(0.85::double, case when family in ({quoted(W.GENERIC_FAMILIES)}) then 0.65::double else 0.0::double end) as penalty from e join decisions d on e.repo_id = d.repo_id left join missing m on e.repo_id = m.repo_id group by family)"


@query(f"with {FAMS} select * from fams")
def q_family_stats(t):
    return Q.families(t.evidence, t.decisions, t.edges)


@query(f"with {FAMS}, x as (select max(n_finals) as a, max(n_missing) as b, max(n_repos) as c from fams) select family, case when a > 0 then cast(n_finals as double) / a else 0 end as n_finals_norm, case when b > 0 then cast(n_missing as double) / b else 0 end as n_missing_norm, case when c > 0 then cast(n_repos as double) / c else 0 end as n_repos_norm from fams, x")
def q_family_normalised(t):
    return S.max_normalized(Q.families(t.evidence, t.decisions, t.edges), ["n_finals", "n_missing", "n_repos"]).select("family", "n_finals_norm", "n_missing_norm", "n_repos_norm")


@query(f"with {FAMS} select family, (5 * n_missing + 4 * n_finals + 2 * n_repos + 0.5::double * ln(1 + cast(stars as double)) + 2 * 0) * greatest(0.05::double, 1 - penalty) as score from fams order by score desc, family limit 30")
def q_family_priority(t):
    return Q.top(Q.family_priority(Q.families(t.evidence, t.decisions, t.edges)), "score", "family", 30).select("family", "score")


@query(f"with {FAMS} select family, n_finals, case when contains(family, 'agent') or contains(family, 'lang') or contains(family, 'crew') or contains(family, 'workflow') then 'orchestration_and_agents' else 'ai_developer_tools_and_sdk_families' end as category_id, case when cast(n_hints as double) / n_rows >= 0.5 then 'high' when n_hints > 0 then 'medium' else 'low' end as confidence from fams where family not in ('red', 'blue') and n_finals >= 2 and penalty < 0.65")
def q_suggestions(t):
    known = t.spark.createDataFrame([("red",), ("blue",)], "token string")
    return Q.suggestions(Q.families(t.evidence, t.decisions, t.edges), known)


# Resolution

ALIASES = "aliases as (select replace(lower(p_name), ' ', '-') as alias, p_partkey % 10 as technology_id, p_partkey as ord from part where p_partkey < 40)"
KEYS = f"{ALIASES}, keys as (select unnest(list_distinct([alias, replace(alias, '-', '_'), replace(alias, '_', '-')])) as key, technology_id, ord from aliases), lookup as (select key, technology_id from keys qualify row_number() over (partition by key order by ord desc, technology_id desc) = 1)"
RULES = "rules as (select split_part(p_name, ' ', 1) as prefix, min(p_partkey) % 7 + 100 as technology_id from part group by 1 union all select '@' || replace(lower(p_brand), '#', '') || '/', min(p_partkey) % 7 + 200 from part where p_partkey < 30 group by 1)"
NAMES = "names as (select distinct package_name from evidence)"
LONGEST = f"longest as (select package_name, prefix, technology_id from names join rules on package_name = prefix or (starts_with(package_name, prefix) and (right(prefix, 1) in ('-', '_', '/', '.') or substr(package_name, length(prefix) + 1, 1) in ('-', '_', '/', '.'))) qualify row_number() over (partition by package_name order by length(prefix) desc, prefix, technology_id) = 1)"


def _aliases(t):
    return t.part.filter("p_partkey < 40").select(F.replace(F.lower("p_name"), F.lit(" "), F.lit("-")).alias("alias"), (F.col("p_partkey") % 10).alias("technology_id"), F.col("p_partkey").alias("ord"))


def _rules(t):
    plain = t.part.groupBy(F.substring_index("p_name", " ", 1).alias("prefix")).agg((F.min("p_partkey") % 7 + 100).alias("technology_id"))
    scope = F.concat(F.lit("@"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")), F.lit("/"))
    return plain.unionByName(t.part.filter("p_partkey < 30").groupBy(scope.alias("prefix")).agg((F.min("p_partkey") % 7 + 200).alias("technology_id")))


@query(f"with {KEYS} select key, technology_id from lookup")
def q_alias_lookup(t):
    return R.alias_lookup(_aliases(t)).select("key", "technology_id")


@query(f"with {RULES}, {NAMES}, {LONGEST} select package_name, prefix, technology_id from longest")
def q_prefix_join(t):
    return R.longest_prefix(t.evidence.select("package_name"), _rules(t)).select("package_name", "prefix", "technology_id")


@query(f"with {KEYS}, {RULES}, {NAMES}, {LONGEST}, hits as (select package_name, technology_id, 0 as step, 'exact_alias' as match_method from names join lookup on package_name = key union all select package_name, technology_id, 2, 'package_prefix' from longest) select package_name, technology_id, match_method, (select count(*) from evidence e where e.package_name = h.package_name) as n from hits h qualify row_number() over (partition by package_name order by step) = 1")
def q_alias_cascade(t):
    names = t.evidence.select("package_name").distinct()
    c = names.select(F.col("package_name").alias("id"), F.lit(0).alias("pos"), F.col("package_name").alias("name"))
    empty = t.spark.createDataFrame([], "key string, technology_id bigint")
    hit = R.resolve(c, R.alias_lookup(_aliases(t)), empty, _rules(t)).withColumnRenamed("id", "package_name")
    n = t.evidence.groupBy("package_name").agg(F.count(F.lit(1)).alias("n"))
    return hit.join(n, "package_name").select("package_name", "technology_id", "match_method", "n")


@query(f"with {KEYS}, {NAMES}, tried as (select package_name, unnest([package_name, replace(package_name, '-', '_'), replace(package_name, '_', '-')]) as key, unnest([0, 1, 2]) as pos from names) select package_name as name, technology_id from tried join lookup using (key) qualify row_number() over (partition by package_name order by pos, technology_id) = 1")
def q_import_lookup(t):
    names = t.evidence.select(F.col("package_name").alias("name")).distinct()
    return R.resolve_imports(names, R.alias_lookup(_aliases(t)), t.spark.createDataFrame([], "key string, technology_id bigint"))


PROVIDERS = "plook as (select split_part(p_name, ' ', 2) as key, min(p_partkey) % 5 as provider_id from part group by 1)"


@query(f"with {NAMES}, {PROVIDERS}, tried as (select package_name, unnest([package_name, case when package_name like '@%' then substr(split_part(package_name, '/', 1), 2) end, case when contains(package_name, '/') then split_part(package_name, '/', 2) end, split_part(package_name, '/', -1), split_part(split_part(package_name, '/', -1), '-', 1), split_part(split_part(package_name, '/', -1), '-', -1), split_part(split_part(package_name, '/', -1), '_', 1), split_part(split_part(package_name, '/', -1), '_', -1)]) as key, unnest([0, 1, 2, 3, 4, 5, 6, 7]) as pos from names) select package_name, provider_id from tried join plook using (key) qualify row_number() over (partition by package_name order by pos, provider_id) = 1")
def q_infer_provider(t):
    lookup = t.part.groupBy(F.substring_index("p_name", " ", -1).alias("key")).agg((F.min("p_partkey") % 5).alias("provider_id"))
    return R.infer_provider(t.evidence, lookup)


@query("with terms as (select distinct split_part(p_name, ' ', 1) as term from part), names as (select distinct p_name from part) select p_name, list_aggregate(list_sort(list(distinct term)), 'string_agg', ',') as terms from names join terms on contains(lower(p_name), term) group by p_name")
def q_contained_terms(t):
    terms = t.part.select(F.substring_index("p_name", " ", 1).alias("term")).distinct()
    return R.contained_terms(t.part.select("p_name").distinct(), terms, "p_name").select("p_name", F.array_join("terms", ",").alias("terms"))


REG = "reg as (select full_name as repo_name, repo_id % 10 as technology_id from repos where repo_id % 50 = 0), ali as (select full_name as repo_name, repo_id % 10 + 50 as technology_id from repos where repo_id % 25 = 0)"


@query(f"with {REG} select repo_id, coalesce(reg.technology_id, ali.technology_id) as technology_id from repos left join reg on lower(full_name) = lower(reg.repo_name) left join ali on lower(full_name) = lower(ali.repo_name) where reg.technology_id is not null or ali.technology_id is not null")
def q_identity_match(t):
    one = lambda k, add: t.repos.filter(f"repo_id % {k} = 0").select(F.col("full_name").alias("repo_name"), (F.col("repo_id") % 10 + add).alias("technology_id"))
    return R.identity_match(t.repos, one(50, 0), one(25, 50))


@query("select repo_id, case when repo_id % 40 = 0 then 'named' else 'org' || cast(org_id as varchar) end as entity_id, case when repo_id % 40 = 0 then 'repo_name' else 'github_org' end as evidence_type, 'high' as confidence from repos where repo_id % 40 = 0 or org_id in (3, 4)")
def q_entity_match(t):
    named = t.repos.filter("repo_id % 40 = 0").select(F.col("full_name").alias("repo_name"), F.lit("named").alias("entity_id"))
    orgs = t.repos.filter("org_id in (3, 4)").select(F.substring_index("full_name", "/", 1).alias("org"), F.concat(F.lit("org"), F.col("org_id").cast("string")).alias("entity_id")).distinct()
    return R.entity_match(t.repos, named, orgs)


# Co-occurrence and graphs


@query(f"with {PAIRS} select * from pairs")
def q_cooccurrence(t):
    return R.pairs(t.edges)


@query(f"with {PAIRS}, s as (select technology_id, count(distinct repo_id) as n from edges group by 1), {FINALS}, total as (select count(*) as n_repos from finals) select \"left\", \"right\", weight, cast(weight as double) / cast(n_repos as double) as share, cast(weight as double) * cast(n_repos as double) / (cast(a.n as double) * cast(b.n as double)) as lift from pairs join s a on a.technology_id = \"left\" join s b on b.technology_id = \"right\", total")
def q_lift(t):
    return G.lift(t.edges, Q.finals(t.decisions).agg(F.count(F.lit(1)).alias("n_repos")))


@query(f"with {PAIRS} select least(a.category_id, b.category_id) as category_a, greatest(a.category_id, b.category_id) as category_b, cast(sum(weight) as bigint) as weight from pairs join technologies a on a.technology_id = \"left\" join technologies b on b.technology_id = \"right\" group by 1, 2")
def q_category_mixing(t):
    return G.category_mixing(R.pairs(t.edges), t.technologies)


PP = "pe as (select distinct repo_id, provider_id from edges join technologies using (technology_id) where provider_id is not null), pp as (select a.provider_id as \"left\", b.provider_id as \"right\", count(*) as weight from pe a join pe b on a.repo_id = b.repo_id and a.provider_id < b.provider_id group by all)"


@query(f"with {PP} select * from pp")
def q_provider_pairs(t):
    return Q.provider_pairs(t.edges, t.technologies)


@query(f"with {PAIRS}, b as (select \"left\" as node, weight from pairs union all select \"right\", weight from pairs), n as (select cast(count(distinct technology_id) - 1 as double) as n from edges) select node, count(*) as degree, cast(sum(weight) as bigint) as strength, cast(count(*) as double) / any_value(n) as centrality from b, n group by node")
def q_degrees(t):
    return G.degrees(R.pairs(t.edges), t.edges.select("technology_id").distinct().count())


@query(f"with {PAIRS}, n as (select count(distinct technology_id) as n_nodes from edges), m as (select count(*) as n_edges from pairs) select n_nodes, n_edges, 2.0::double * n_edges / (cast(n_nodes as double) * (n_nodes - 1)) as density from n, m")
def q_density(t):
    return G.density(R.pairs(t.edges), t.edges.select("technology_id").distinct())


LINKS = "links as (select o_custkey % 211 as a, o_custkey % 211 + 211 * (o_orderkey % 3 + 1) as b from orders where o_totalprice > 480000 union select o_orderkey % 97 + 1000, o_orderkey % 89 + 1000 from orders where o_totalprice > 499000)"


@query(f"with recursive {LINKS}, n as (select a as node from links union select b from links), two as (select a, b from links union select b, a from links), reach as (select node, node as component from n union select two.b, component from reach join two on reach.node = two.a where component < two.b) select node, min(component) as component from reach group by node")
def q_components(t):
    o = t.orders
    one = o.filter("o_totalprice > 480000").select((F.col("o_custkey") % 211).alias("left"), (F.col("o_custkey") % 211 + 211 * (F.col("o_orderkey") % 3 + 1)).alias("right"))
    two = o.filter("o_totalprice > 499000").select((F.col("o_orderkey") % 97 + 1000).alias("left"), (F.col("o_orderkey") % 89 + 1000).alias("right"))
    links = one.unionByName(two).distinct()
    nodes = links.select(F.col("left").alias("node")).union(links.select("right")).distinct()
    return G.components(nodes, links)


@query()
def q_centralities(t):
    return G.centralities(Q.provider_pairs(t.edges, t.technologies))


# Classification and judge


@query("select d.repo_id, j.judge_mode is not null as judge_applied, coalesce((judge_mode = 'validation' or (judge_mode = 'hardening' and confidence = 'high')) and include_in_final_set is distinct from passed_major, false) as judge_override_applied, passed_major as rule_passed, case when coalesce(judge_mode = 'validation' or (judge_mode = 'hardening' and confidence = 'high'), false) then include_in_final_set else passed_major end as passed_major from decisions d left join judge j on d.repo_id = j.repo_id")
def q_judge_apply(t):
    return C.judged(t.decisions, t.judge).select("repo_id", "judge_applied", "judge_override_applied", "rule_passed", "passed_major")


@query("with fresh as (select d.* from decisions d where repo_id not in (select repo_id from judge)), m as (select repo_id, case when exclusion_reason is not null or abs(score_serious - 3) <= 1 or abs(score_ai - 3) <= 1 then 'hardening' when passed_major then 'validation' end as mode from fresh) select repo_id, mode from m where mode is not null order by mode, md5(cast(repo_id as varchar) || '-j1'), repo_id limit 200")
def q_judge_candidates(t):
    return C.judge_candidates(t.decisions, t.judge, 200, "j1")


RULESET = C.Rules(segments={"tools": {"topics": ("llm",), "description": ("bolt",), "config": ("ci.yml",)}, "search": {"description": ("ring", "widget"), "technologies": ("3",)}}, precedence=("search", "tools"))
PATHS = "array('pyproject.toml', 'src/a.py', 'src/b.py', 'src/c.py', 'src/d.py', 'src/e.py')"


def _contexts(t):
    """Contexts read off `part`: tree, manifests and technologies by the digits of its key."""
    k = F.col("p_partkey")
    on = lambda test, *paths: F.when(test, F.array(*map(F.lit, paths))).otherwise(F.array().cast("array<string>"))
    tree = F.concat(
        on(k % 2 == 0, "pyproject.toml"), on(k % 3 > 0, "src/a.py", "src/b.py", "src/c.py", "src/d.py", "src/e.py"), on(k % 5 == 0, "tests/t.py"), on(k % 7 == 0, ".github/workflows/ci.yml"),
        on(k % 11 == 0, "docs/a.md", "docs/b.md"), on(k % 13 == 0, "packages/x/a.ts", "apps/y/b.ts"), on(k % 17 == 0, "uv.lock"), on(k % 19 == 0, "Dockerfile"),
    )
    tech = lambda test, *ids: on(test, *ids)
    return t.part.select(
        k.alias("repo_id"), F.concat(F.lit("o/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.when(k % 23 == 0, "-list").otherwise("")).alias("full_name"), F.col("p_name").alias("description"),
        on(k % 29 == 0, "llm", "Tutorial").alias("topics"), (F.col("p_size") * 100).alias("stars"), F.when(k % 4 == 0, F.lit(None)).otherwise(F.lit("Python")).alias("primary_language"),
        F.when(k % 6 == 0, "## Installation").when(k % 6 == 1, "a lesson and an exercise").alias("readme_text"), tree.alias("tree_paths"), on(k % 2 == 0, "pyproject.toml").alias("manifest_paths"),
        tech(k % 3 == 0, "1", "2").alias("manifest_tech"), tech(k % 4 == 1, "2", "3", "4", "5", "6").alias("sbom_tech"), tech(k % 5 == 2, "1", "7").alias("import_tech"), tech(k % 7 == 3, "8").alias("provider_tech"),
    )


CTX = """k as (select *, p_partkey as k, p_name || case when p_partkey % 23 = 0 then '-list' else '' end as nm from part),
sig as (select *, case when k % 3 > 0 then 5 else 0 end + case when k % 5 = 0 then 1 else 0 end + case when k % 13 = 0 then 2 else 0 end as n_code,
 case when k % 2 = 0 then 1 else 0 end + case when k % 3 > 0 then 5 else 0 end + case when k % 5 = 0 then 1 else 0 end + case when k % 7 = 0 then 1 else 0 end + case when k % 11 = 0 then 2 else 0 end + case when k % 13 = 0 then 2 else 0 end + case when k % 17 = 0 then 1 else 0 end + case when k % 19 = 0 then 1 else 0 end as n_all from k),
sc as (select *, case when k % 2 = 0 then 2 else 0 end + case when k % 17 = 0 then 1 else 0 end + case when n_code >= 5 then 2 else 0 end + case when k % 5 = 0 then 1 else 0 end + case when k % 7 = 0 then 1 else 0 end
 + case when k % 19 = 0 then 1 else 0 end + case when k % 13 = 0 then 1 else 0 end + case when k % 6 = 0 then 1 else 0 end - case when k % 4 = 0 and k % 2 <> 0 then 2 else 0 end
 - case when n_all > 0 and (case when k % 11 = 0 then 2 else 0 end)::double / n_all >= 0.7 then 3 else 0 end - case when k % 6 = 1 then 4 else 0 end as score_serious,
 case when k % 3 = 0 then 6 else 0 end + case when k % 7 = 3 then 2 else 0 end
 + 2 * (case when k % 4 = 1 then case when k % 3 = 0 then 3 else 3 end else 0 end)
 + case when k % 5 = 2 then (case when k % 3 = 0 then 1 when true then 2 end) else 0 end + case when k % 29 = 0 then 1 else 0 end as score_ai,
 k % 23 = 0 as has_list, k % 29 = 0 as has_tutorial from sig),
ex as (select *, case when (has_list and has_tutorial) or ((has_list or has_tutorial) and (score_serious < 5 or not (has_tutorial and not has_list)))
 then 'hard exclusion: ' || case when has_list and has_tutorial then 'list, tutorial' when has_list then 'list' else 'tutorial' end end as exclusion_reason from sc)"""


@query(f"with {CTX} select k as repo_id, score_serious, score_ai, exclusion_reason, score_serious >= 3 and exclusion_reason is null as passed_serious_filter, score_serious >= 3 and exclusion_reason is null and score_ai >= 3 and p_size * 100 >= 1000 as passed_major_filter from ex")
def q_classify(t):
    return C.classify(_contexts(t), RULESET).select("repo_id", "score_serious", "score_ai", "exclusion_reason", "passed_serious_filter", "passed_major_filter")


@query("with s as (select p_partkey as k, case when p_partkey % 29 = 0 then 1 else 0 end + case when contains(p_name, 'bolt') then 1 else 0 end + case when p_partkey % 7 = 0 then 1 else 0 end as tools, case when contains(p_name, 'ring') then 1 else 0 end + case when contains(p_name, 'widget') then 1 else 0 end + case when p_partkey % 4 = 1 then 1 else 0 end as search from part) select k as repo_id, case when search > 0 and tools > 0 then case when search >= tools then 'search,tools' else 'tools,search' end when search > 0 then 'search' when tools > 0 then 'tools' else '' end as segments from s")
def q_segments(t):
    return _contexts(t).select("repo_id", F.array_join(C.segment_list(RULESET), ",").alias("segments"))


# Edges


@query("with p as (select s_suppkey as technology_id, (s_suppkey + 1) % 7 as provider_technology_id from supplier where s_suppkey % 3 = 0) select e.repo_id, provider_technology_id as technology_id, 'derived_provider' as match_method, count(*) as n from edges e join p using (technology_id) where provider_technology_id <> technology_id group by 1, 2, 3")
def q_provider_edges(t):
    p = t.supplier.filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("technology_id"), ((F.col("s_suppkey") + 1) % 7).alias("provider_technology_id"))
    return E.provider_edges(t.edges, p).groupBy("repo_id", "technology_id", "match_method").agg(F.count(F.lit(1)).alias("n"))


WORDS_ = [("of", 1), ("their", 2), ("theaer", 3), ("that", 4), ("with", 5), ("und", 6), ("this", 7)]


@query("with w(alias, t, o) as (values ('of', 1, 0), ('their', 0, 1), ('theaer', 1, 2), ('that', 0, 3), ('with', 1, 4), ('und', 0, 5), ('this', 1, 6)), h as (select doc_id as repo_id, t as technology_id, alias, o from documents join w on length(alias) >= 4 and regexp_matches(lower(substr(text, 1, 50000)), '(^|[^a-z0-9])' || alias || '([^a-z0-9]|$)') where doc_id not in (select repo_id from edges)) select repo_id, cast(technology_id as bigint) as technology_id, alias from h qualify row_number() over (partition by repo_id, technology_id order by o, alias) = 1")
def q_readme_edges(t):
    aliases = t.spark.createDataFrame([(a, i % 2, n) for n, (a, i) in enumerate(WORDS_)], "alias string, technology_id bigint, ord int")
    contexts = t.documents.select(F.col("doc_id").alias("repo_id"), F.col("text").alias("readme_text"))
    return E.readme_edges(contexts, aliases, t.edges)


@query(f"with {RULES}, {NAMES}, {LONGEST} select e.package_name, coalesce(l.technology_id, -1) as technology_id, count(*) as n from evidence e left join longest l on e.package_name = l.package_name group by 1, 2")
def q_rebind(t):
    bound = R.longest_prefix(t.evidence.select("package_name"), _rules(t)).select("package_name", "technology_id", F.lit("package_prefix").alias("match_method"))
    return E.rebind(t.evidence, bound).groupBy("package_name", F.coalesce("technology_id", F.lit(-1)).alias("technology_id")).agg(F.count(F.lit(1)).alias("n"))


# Snapshots and benchmark


@query("with a as (select repo_id, passed_major as f, coalesce(primary_segment, '') as s from old_decisions), b as (select repo_id, passed_major as f, coalesce(primary_segment, '') as s from decisions), j as (select coalesce(a.repo_id, b.repo_id) as repo_id, case when a.repo_id is null then 'added' when b.repo_id is null then 'removed' when a.f is distinct from b.f then 'final' when a.s <> b.s then 'segment' end as change from a full join b on a.repo_id = b.repo_id) select * from j where change is not null")
def q_snapshot_diff(t):
    return N.compare_decisions(t.old_decisions, t.decisions)


@query("with a as (select repo_id, technology_id from old_edges), b as (select repo_id, technology_id from edges) select *, 'removed' as change from (select * from a except select * from b) union all select *, 'added' from (select * from b except select * from a)")
def q_edge_changes(t):
    return N.edge_changes(t.old_edges, t.edges)


@query("with a as (select count(*) as total, count_if(passed_major) as finals from old_decisions), b as (select count(*) as total, count_if(passed_major) as finals from decisions), m as (select 'total' as metric, a.total::double as before, b.total::double as after from a, b union all select 'finals', a.finals, b.finals from a, b) select *, after - before as delta, case when after - before > 1e-9 then 'improved' when before - after > 1e-9 then 'regressed' else 'unchanged' end as result from m")
def q_scorecard(t):
    one = lambda d: d.agg(F.count(F.lit(1)).alias("total"), F.count_if("passed_major").alias("finals"))
    return N.scorecard(one(t.old_decisions), one(t.decisions), {"total": "higher", "finals": "higher"})


@query(f"with {FINALS}, c as (select 'decision without repository' as rule, 'error' as level, (select count(*) from decisions where repo_id not in (select repo_id from repos)) as n union all select 'repository without decision', 'error', (select count(*) from repos where repo_id not in (select repo_id from decisions)) union all select 'edge without final', 'error', (select count(*) from edges where repo_id not in (select repo_id from finals)) union all select 'edge without technology', 'error', (select count(*) from edges where technology_id not in (select technology_id from technologies)) union all select 'repeated edge', 'error', (select count(*) from (select 1 from edges group by repo_id, technology_id having count(*) > 1)) union all select 'final below threshold', 'error', (select count(*) from finals where score_serious < 3) union all select 'segment not configured', 'warning', (select count(*) from finals where primary_segment is null or primary_segment not in ('BUILDING', 'MACHINERY')) union all select 'final without edge', 'warning', (select count(*) from finals where repo_id not in (select repo_id from edges))) select rule, n, case when n = 0 then 'ok' else level end as status from c")
def q_validate_snapshot(t):
    return N.validate(t.repos, t.decisions, t.edges, t.technologies, ["BUILDING", "MACHINERY"])


@query("select technology_id, case when technology_id % 10 = 0 then 'registry' else display_name end as display_name from technologies")
def q_overlay(t):
    base = t.technologies.select("technology_id", "display_name")
    return N.overlay(base, base.filter("technology_id % 10 = 0").withColumn("display_name", F.lit("registry")), "technology_id")


@query("with s as (select full_name, 'search' as source from repos where stars > 8000 union all select full_name, 'seed' from repos where repo_id % 50 = 0 union all select full_name, 'seed' from repos where repo_id % 100 = 0) select full_name, string_agg(distinct source, ',' order by source) as sources from s group by full_name")
def q_channels(t):
    return N.channels(("search", t.repos.filter("stars > 8000")), ("seed", t.repos.filter("repo_id % 50 = 0")), ("seed", t.repos.filter("repo_id % 100 = 0")))


BENCH = f"{RULES}, ent as (select 'e' || cast(repo_id as varchar) as entity_id, case when repo_id % 60 = 0 then 'gone/' || full_name else full_name end as repo_name, repo_id % 120 as technology_id, case when repo_id % 90 = 0 then (select min(prefix) from rules where prefix not like '@%') end as prefix, case when repo_id % 80 = 0 then 'negative' else 'positive' end as expectation, case when repo_id % 100 = 0 then 'holdout' else 'tuning' end as split from repos where repo_id % 20 = 0), {NAMES}, one as (select entity_id, min(prefix) as prefix from ent where prefix is not null group by 1), px as (select package_name, entity_id from (select distinct package_name from evidence where technology_id is null) join one on package_name = prefix or (starts_with(package_name, prefix) and substr(package_name, length(prefix) + 1, 1) in ('-', '_', '/', '.')) qualify row_number() over (partition by package_name order by length(prefix) desc, prefix, entity_id) = 1), bp as (select px.entity_id, count(*) as n from px join evidence e on e.package_name = px.package_name and e.technology_id is null group by 1), found as (select ent.entity_id, expectation, split, exists (select 1 from repos r where lower(r.full_name) = ent.repo_name) as discovered, exists (select 1 from decisions d where passed_major and lower(d.full_name) = ent.repo_name) as included, (select count(distinct repo_id) from edges e where e.technology_id = ent.technology_id) as adoption, (select count(*) from evidence e where e.technology_id = ent.technology_id) + coalesce(bp.n, 0) as n_evidence from ent left join bp on ent.entity_id = bp.entity_id)"


def _entities(t):
    k = F.col("repo_id")
    first = _rules(t).filter("prefix not like '@%'").agg(F.min("prefix").alias("least"))
    return t.repos.filter("repo_id % 20 = 0").crossJoin(F.broadcast(first)).select(
        F.concat(F.lit("e"), k.cast("string")).alias("entity_id"), F.when(k % 60 == 0, F.concat(F.lit("gone/"), "full_name")).otherwise(F.col("full_name")).alias("repo_name"), (k % 120).alias("technology_id"),
        F.when(k % 90 == 0, F.col("least")).alias("prefix"), F.when(k % 80 == 0, "negative").otherwise("positive").alias("expectation"), F.when(k % 100 == 0, "holdout").otherwise("tuning").alias("split"),
    )


@query(f"with {BENCH} select * from found")
def q_benchmark_recall(t):
    return Q.benchmark(_entities(t), t.repos, t.decisions, t.edges, t.evidence)


@query(f"with {BENCH} select expectation, split, count(*) as n, avg(discovered::int::double) as discovered_rate, avg(included::int::double) as included_rate, avg((adoption > 0)::int::double) as adopted_rate, avg((n_evidence > 0)::int::double) as seen_rate from found group by 1, 2")
def q_benchmark_rates(t):
    return Q.benchmark_rates(Q.benchmark(_entities(t), t.repos, t.decisions, t.edges, t.evidence))


GAPS = f"{BENCH}, bg as (select entity_id, case when not discovered then 100 else 0 end + case when discovered and not included then 70 else 0 end + case when adoption = 0 then 60 else 0 end + case when n_evidence = 0 then 40 else 0 end + case when split = 'holdout' then 20 else 0 end + case when n_evidence > 0 and adoption = 0 then 30 else 0 end as urgency, concat_ws('; ', case when not discovered then 'not discovered' end, case when discovered and not included then 'not included' end, case when adoption = 0 then 'no adoption' end, case when n_evidence = 0 then 'no evidence' end, case when split = 'holdout' then 'holdout' end, case when n_evidence > 0 and adoption = 0 then 'evidence without adoption' end) as reasons from found where expectation = 'positive')"


@query(f"with {GAPS} select entity_id, urgency, reasons from bg where urgency > 0")
def q_benchmark_gaps(t):
    return Q.benchmark_gaps(Q.benchmark(_entities(t), t.repos, t.decisions, t.edges, t.evidence))


@query(f"with {GAP}, {GAPS} select (1000 + unmatched)::bigint as priority, 'missing_edge' as kind, full_name as name from gaps union all select (500 + stars)::bigint, 'audit', full_name from decisions where rule_passed_major is distinct from passed_major union all select stars::bigint, 'readme', full_name from finals where repo_id % 37 = 0 union all select urgency::bigint, 'benchmark', entity_id from bg where urgency > 0")
def q_review_queue(t):
    gaps = Q.gap_reasons(t.decisions, t.edges, t.evidence)
    changed = t.decisions.filter("not (rule_passed_major <=> passed_major)")
    return Q.review_queue(gaps, changed, Q.finals(t.decisions).filter("repo_id % 37 = 0"), q_benchmark_gaps(t))


# Strings, dates, parsers


@query(f"with {NAMES} select package_name, {PREFIX('package_name')} as prefix, {FAMILY('package_name')} as family, {AI('package_name')} as ai from names")
def q_package_functions(t):
    c = F.col("package_name")
    return t.evidence.select("package_name").distinct().select("package_name", X.package_prefix(c).alias("prefix"), X.family_id(c).alias("family"), X.ai_affinity(c).alias("ai"))


@query("select page_id, regexp_replace(regexp_replace(split_part(split_part(split_part(split_part(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '/', 1), '?', 1), '#', 1), ':', 1), '^www\\.', ''), '\\.+$', '') as domain, url like '%example.org%' as is_example from pages")
def q_pages_domains(t):
    d = X.domain(F.col("url"))
    return t.pages.select("page_id", d.alias("domain"), X.in_domain(d, F.lit("example.org")).alias("is_example"))


@query("select p_partkey, trim(regexp_replace(lower(p_type || ' ' || p_name || '!'), '[^a-z0-9]+', '-', 'g'), '-') as slug, translate(lower(trim(p_brand)), '-/ #', '____') as brand, printf('%.1f%%', p_size::double / 50 * 100) as pct from part")
def q_text_functions(t):
    return t.part.select("p_partkey", X.slugify(F.concat_ws(" ", "p_type", F.concat("p_name", F.lit("!")))).alias("slug"), F.translate(X.segment_key(F.col("p_brand")), "#", "_").alias("brand"), X.format_percent(F.col("p_size") / F.lit(50.0)).alias("pct"))


@query("select o_orderkey, make_date(year(o_orderdate - interval 5 month), month(date_trunc('month', o_orderdate) - interval 5 month), least(day(o_orderdate), 28))::varchar as cutoff from orders where month(o_orderdate) <> 7 or day(o_orderdate) < 31")
def q_freshness_cutoff(t):
    d = F.col("o_orderdate")
    return t.orders.filter((F.month(d) != 7) | (F.dayofmonth(d) < 31)).select("o_orderkey", S.freshness_cutoff(d.cast("date"), 5).cast("string").alias("cutoff"))


@query("with f as (select doc_id % 100 as repo_id, unnest(string_split(text, chr(10))) as line from documents), l as (select repo_id, trim(line) as line from f) select repo_id, lower(split_part(regexp_extract(line, '^[^;\\[]*'), ' ', 1)) as package_name, count(*) as n from l where line <> '' and line not like '#%' and line not like '-%' and not regexp_matches(line, '[<>=!~\"'';\\[]') and not regexp_matches(line, '[^\\x00-\\x7f]') group by 1, 2")
def q_requirements(t):
    files = t.documents.select((F.col("doc_id") % 100).alias("repo_id"), F.lit("requirements.txt").alias("path"), "text")
    rows = P.requirements(files).filter("not rlike(specifier, '[<>=!~\"\\';\\\\[]') and not rlike(specifier, '[^\\\\x00-\\\\x7f]')")
    return rows.groupBy("repo_id", "package_name").agg(F.count(F.lit(1)).alias("n"))


@query("with e as (select user_id, event_id, event_type, cast(json_extract(props, '$.k') as int) as k from events) select user_id as repo_id, event_type as package_name, case when k % 3 = 0 then 'dev' else 'runtime' end as scope, count(*) as n from e group by 1, 2, 3")
def q_package_json(t):
    k = F.get_json_object("props", "$.k").cast("int")
    spec = F.concat(F.lit('{"'), F.when(k % 3 == 0, "devDependencies").otherwise("dependencies"), F.lit('": {"'), F.col("event_type"), F.lit('": "'), k.cast("string"), F.lit('"}}'))
    files = t.events.select(F.col("user_id").alias("repo_id"), F.lit("package.json").alias("path"), spec.alias("text"))
    return P.package_json(files).groupBy("repo_id", "package_name", "scope").agg(F.count(F.lit(1)).alias("n"))


@query("select e.user_id as repo_id, 'pkg' || cast(json_extract(props, '$.k') as varchar) as package_name, count(*) as n from events e where event_type <> 'error' group by 1, 2")
def q_spdx(t):
    k = F.get_json_object("props", "$.k")
    doc = F.concat(
        F.lit('{"packages": [{"SPDXID": "R", "name": "root"}, {"SPDXID": "A", "name": "x", "externalRefs": [{"referenceType": "purl", "referenceLocator": "pkg:npm/pkg'), k, F.lit('@1.0"}]}, {"SPDXID": "B", "name": "far"}], "relationships": [{"spdxElementId": "D", "relatedSpdxElement": "R", "relationshipType": "DESCRIBES"}, {"spdxElementId": "'),
        F.when(F.col("event_type") == "error", "B").otherwise("R"), F.lit('", "relatedSpdxElement": "A", "relationshipType": "DEPENDS_ON"}]}'),
    )
    files = t.events.select(F.col("user_id").alias("repo_id"), F.lit("sbom.json").alias("path"), doc.alias("text"))
    return P.spdx(files).groupBy("repo_id", "package_name").agg(F.count(F.lit(1)).alias("n"))


@query("select event_id as repo_id, 'src/m' || cast(user_id % 3 as varchar) || '.py' as path, unnest(list_distinct(['m' || cast(user_id as varchar) || '.x', 'm' || cast(user_id as varchar), event_type, event_type || '.run'])) as name from events")
def q_imports(t):
    u = F.col("user_id").cast("string")
    text = F.concat(F.lit("import m"), u, F.lit(".x\nfrom "), F.col("event_type"), F.lit(" import run\n"))
    return P.imports(t.events.select(F.col("event_id").alias("repo_id"), F.concat(F.lit("src/m"), (F.col("user_id") % 3).cast("string"), F.lit(".py")).alias("path"), text.alias("text")))


@query("select event_id as repo_id, 'mod' || cast(user_id as varchar) as package_name, 'runtime' as scope from events union all select event_id, lower(event_type), 'dev' from events")
def q_toml_and_go(t):
    u = F.col("user_id").cast("string")
    go = t.events.select(F.col("event_id").alias("repo_id"), F.lit("go.mod").alias("path"), F.concat(F.lit("module x\nrequire (\n  example.com/a/mod"), u, F.lit(" v1.0.0 // indirect\n)\n")).alias("text"))
    cargo = t.events.select(F.col("event_id").alias("repo_id"), F.lit("Cargo.toml").alias("path"), F.concat(F.lit("[dev-dependencies]\n"), "event_type", F.lit(' = "1"\n')).alias("text"))
    return P.manifests(go.unionByName(cargo)).select("repo_id", "package_name", "scope")


# Incremental


@query("select user_id as repo_id, count(*) as score, count_if(event_type = 'error') as errors from events group by user_id")
def q_stream_incremental(t):
    """Feeds the events as files of users to the stream, batch by batch, and reads what it committed."""
    import uuid

    from .streaming.incremental import classify_stream, committed

    where = f"{G.shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    t.events.select("user_id", "event_type").repartition(4, "user_id").write.parquet(f"{where}/in")
    decide = lambda b: {"decisions": b.groupBy(F.col("user_id").alias("repo_id")).agg(F.count(F.lit(1)).alias("score"), F.count_if(F.col("event_type") == "error").alias("errors"))}
    classify_stream(t.spark, f"{where}/in", "user_id long, event_type string", f"{where}/out", decide)
    return committed(t.spark, f"{where}/out", "decisions", "repo_id long, score long, errors long")


@query("select user_id as repo_id, event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') as last from events group by 1, 2")
def q_cache_upsert(t):
    from .streaming.incremental import upsert_cache

    e = t.events.select(F.col("user_id").alias("repo_id"), "event_type", "ts")
    early = S.first_of(e.filter("ts < timestamp '2024-01-15'"), ["repo_id", "event_type"], [F.col("ts").desc()])
    late = S.first_of(e.filter("ts >= timestamp '2024-01-15'"), ["repo_id", "event_type"], [F.col("ts").desc()])
    return upsert_cache(early, late, ("repo_id", "event_type")).select("repo_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last"))


@query("select distinct stage_id, seconds, item_count, notes, attempt_id from (select event_type as stage_id, round(value, 6) as seconds, user_id as item_count, 'n' as notes, cast(user_id % 4 as varchar) as attempt_id from events)")
def q_stage_timings(t):
    from .streaming.incremental import merge_timings

    rows = t.events.select(F.col("event_type").alias("stage_id"), F.col("value").alias("seconds"), F.col("user_id").alias("item_count"), F.lit("n").alias("notes"), (F.col("user_id") % 4).cast("string").alias("attempt_id"))
    return merge_timings(rows, rows.filter("seconds > 5"))


# Discovery, entities and jobs


@query("with p as (select o_custkey as repo_id, o_orderpriority as package_name, 'pkg:' || cast(max(o_orderkey) as varchar) as purl from orders group by 1, 2), e as (select o_custkey as repo_id, o_orderpriority as package_name, count(*) as n from orders where o_orderstatus = 'F' group by 1, 2) select e.repo_id, e.package_name, n, purl from e left join p on e.repo_id = p.repo_id and e.package_name = p.package_name")
def q_last_purl(t):
    o = t.orders.select(F.col("o_custkey").alias("repo_id"), F.col("o_orderpriority").alias("package_name"), "o_orderkey", "o_orderstatus")
    e = o.filter("o_orderstatus = 'F'").groupBy("repo_id", "package_name").agg(F.count(F.lit(1)).alias("n"))
    return D.with_purl(e, o.withColumn("purl", F.concat(F.lit("pkg:"), F.col("o_orderkey").cast("string"))), ["o_orderkey"])


FGRAPH = f"{FAMS}, fe as (select distinct family, repo_id from fam where repo_id in (select repo_id from missing) and family in (select family from fams)), fg as (select a.family as \"left\", b.family as \"right\", count(*) as weight from fe a join fe b on a.repo_id = b.repo_id and a.family < b.family group by all)"


def _families(t):
    """The families and their graph, from decisions and repositories with an edge that are computed once."""
    decisions = G.kept(t.decisions.select("repo_id", "stars", "passed_major"), "decisions")
    covered = G.kept(t.edges.select("repo_id").distinct(), "covered")
    fams = G.kept(Q.families(t.evidence, decisions, covered), "families")
    return fams, D.family_graph(t.evidence, decisions, covered, D.retained(fams, 20))


@query(f"with {FGRAPH} select * from fg")
def q_family_graph(t):
    return _families(t)[1]


@query()
def q_discovery_report(t):
    return D.discovery_report(*_families(t))


ENT = "links as (select s_suppkey as technology_id, 'n' || cast(s_nationkey as varchar) as entity_id from supplier), stew as (select repo_id, 'n' || cast(org_id as varchar) as entity_id from repos where repo_id % 3 = 0)"


@query(f"with {ENT}, names as (select distinct entity_id from links), a as (select entity_id, count(distinct technology_id) as n from links group by 1), b as (select entity_id, count(distinct repo_id) as n from stew group by 1), c as (select entity_id, count(distinct repo_id) as n from edges join links using (technology_id) group by 1) select names.entity_id, coalesce(a.n, 0) as n_technologies, coalesce(b.n, 0) as n_stewarded, coalesce(c.n, 0) as n_using from names left join a on a.entity_id = names.entity_id left join b on b.entity_id = names.entity_id left join c on c.entity_id = names.entity_id")
def q_entity_report(t):
    name = lambda c: F.concat(F.lit("n"), F.col(c).cast("string")).alias("entity_id")
    ents = t.supplier.groupBy(name("s_nationkey")).agg(F.collect_list("s_suppkey").alias("technology_ids"))
    return D.entity_report(ents, t.repos.filter("repo_id % 3 = 0").select("repo_id", name("org_id")), t.edges)


VENDOR = f"{MISSING}, vterms as (select distinct term from (select unnest(string_split_regex(lower(s_name), '[@/_. -]+')) as term from supplier union all select 'customer-0000000' || cast(n_nationkey % 10 as varchar) from nation) where length(term) >= 4 and term not in ('open', 'tool')), vend as (select repo_id, full_name, stars, string_agg(distinct term, ',' order by term) as terms from missing join vterms on contains(lower(full_name), term) group by all)"


def _vendor_terms(t):
    names = t.supplier.select(F.col("s_name").alias("name"))
    return Q.vendor_terms(names, ("open", "tool")).unionByName(t.nation.select(F.concat(F.lit("customer-0000000"), (F.col("n_nationkey") % 10).cast("string")).alias("term")).distinct())


@query(f"with {VENDOR} select * from vend")
def q_vendor_like(t):
    return D.vendor_like(t.repos, t.decisions, t.edges, _vendor_terms(t)).withColumn("terms", F.array_join("terms", ","))


@query(f"with {VENDOR}, {UNMATCHED}, p as (select {PREFIX('package_name')} as prefix, count(*) as n from unmatched group by 1), x as (select 'prefix' as kind, prefix as name, n * 10 as weight from p union all select 'repo', full_name, stars from vend) select * from x order by weight desc, kind, name limit 25")
def q_suggested_inputs(t):
    return D.suggested_inputs(Q.unmatched_prefixes(t.evidence, t.repos), D.vendors(t.decisions, t.edges, _vendor_terms(t)), 25)


@query("select repo_id, stars from repos order by case when repo_id % 30 = 0 then 0 else 1 end, stars desc, repo_id limit 70")
def q_preflight(t):
    return D.preflight(t.repos, t.repos.filter("repo_id % 30 = 0"), 70).select("repo_id", "stars")


@query("with s as (select full_name, 'benchmark' as source from repos where repo_id % 30 = 0 union all select full_name, 'manual' from repos where repo_id % 45 = 0) select lower(full_name) as full_name, string_agg(distinct source, ',' order by source) as sources from s group by 1")
def q_seeds(t):
    return D.seeds(benchmark=t.repos.filter("repo_id % 30 = 0"), manual=t.repos.filter("repo_id % 45 = 0"))


@query("with w as (select distinct p_partkey, unnest(string_split_regex(lower(p_name || ' ' || p_type), '[^a-z0-9]+')) as family from part) select family, count(*) as overlap from w where length(family) >= 3 group by 1")
def q_token_overlap(t):
    return D.token_overlap(t.part.select(F.col("p_partkey").alias("entity_id"), F.concat_ws(" ", "p_name", "p_type").alias("name")))


@query("with c as (select repo_id, bool_or(evidence_type = 'manifest') as m, bool_or(evidence_type = 'sbom') as s, bool_or(evidence_type = 'import') as i, bool_or(evidence_type = 'repo_identity') as d, bool_or(evidence_type = 'readme_mention') as r from evidence group by 1) select case when (m or s or i) and r then 'mixed_direct_and_fallback' when m or s or i then 'direct_only' when d and r then 'repo_identity_plus_fallback' when d then 'repo_identity_only' when r then 'readme_only' else 'unmapped' end as profile, count(*) as n from c group by 1")
def q_context_profiles(t):
    has = lambda k: F.bool_or(F.col("evidence_type") == k)
    kinds = ("manifest", "sbom", "import", "repo_identity", "readme_mention")
    c = t.evidence.groupBy("repo_id").agg(*[has(k).alias(k) for k in kinds])
    return c.groupBy(D.context_profile(*[F.col(k) for k in kinds]).alias("profile")).agg(F.count(F.lit(1)).alias("n"))


@query("with g as (select repo_id, technology_id % 3 as community, count(distinct technology_id) as overlap from edges group by 1, 2) select community, repo_id, overlap, stars, cast(row_number() over (partition by community order by overlap desc, stars desc, repo_id) as int) as rank from g join repos using (repo_id) qualify rank <= 5")
def q_exemplars(t):
    communities = t.technologies.select(F.col("technology_id").alias("node"), (F.col("technology_id") % 3).alias("community"))
    return D.exemplars(t.edges, communities, t.repos).select("community", "repo_id", "overlap", "stars", "rank")


@query(f"with {PAIRS}, b as (select \"left\" as technology_id, \"right\" as neighbour, weight from pairs union all select \"right\", \"left\", weight from pairs) select *, cast(row_number() over (partition by technology_id order by weight desc, neighbour) as int) as rank from b qualify rank <= 5")
def q_technology_neighbours(t):
    return D.neighbours(t.edges)


@query("with g as (select technology_id, count(distinct repo_id) as n_repos from edges group by 1) select technology_id, n_repos, category_id, cast(row_number() over (partition by category_id order by n_repos desc, technology_id) as int) as rank from g join technologies using (technology_id) qualify rank <= 5")
def q_category_top(t):
    return D.category_top(t.edges, t.technologies)


@query(f"with {FINALS}, g as (select primary_segment, provider_id, count(distinct e.repo_id) as n_repos from edges e join technologies using (technology_id) join finals f on e.repo_id = f.repo_id where provider_id is not null group by 1, 2) select *, cast(row_number() over (partition by primary_segment order by n_repos desc, provider_id) as int) as rank from g")
def q_segment_providers(t):
    return D.segment_adoption(t.edges, t.decisions, t.technologies)


@query(f"with {FINALS}, ev as (select e.repo_id, technology_id, evidence_type, confidence, scope, package_name, source_path, null::varchar as match_method from evidence e join finals using (repo_id) where technology_id is not null and l_shipdate < timestamp '1996-01-01 00:00:00'), idn as (select repo_id, repo_id % 10 as technology_id from repos where repo_id % 7 = 0), r as (select * from ev union all select repo_id, (technology_id + 1) % 7, evidence_type, confidence, scope, package_name, source_path, 'derived_provider' from ev where technology_id % 3 = 0 and (technology_id + 1) % 7 <> technology_id union all select repo_id, technology_id, 'repo_identity', 'high', 'unknown', null, null, 'repo_identity' from idn join finals using (repo_id)) select repo_id, technology_id, evidence_type, confidence, scope from r qualify row_number() over (partition by repo_id, technology_id order by {RANKS}, package_name nulls first, source_path nulls first) = 1")
def q_build_edges(t):
    p = t.supplier.filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("technology_id"), ((F.col("s_suppkey") + 1) % 7).alias("provider_technology_id"))
    identity = t.repos.filter("repo_id % 7 = 0").select("repo_id", (F.col("repo_id") % 10).alias("technology_id"))
    return J.build_edges(t.evidence.filter("l_shipdate < timestamp '1996-01-01 00:00:00'"), t.decisions, p, identity).select("repo_id", "technology_id", "evidence_type", "confidence", "scope")


@query(f"with {MISSING}, a as (select count(*) as repositories, (select count(*) from finals) as finals from decisions) select a.*, (select count(*) from edges) as edges, (select count(distinct technology_id) from edges) as technologies, (select count(*) from missing) as missing from a")
def q_snapshot_metrics(t):
    return J.metrics(t.decisions, t.edges)


@query("select repo_id, case when k % 10 = 0 then 'fresh' else 'old' end as state from (select p_partkey as repo_id, p_partkey as k from part)")
def q_refresh(t):
    old = t.part.select(F.col("p_partkey").alias("repo_id"), F.lit("old").alias("state"))
    return J.refresh(old, old.filter("repo_id % 10 = 0").withColumn("state", F.lit("fresh")))


# Scalars


@query("select p_partkey, case when p_size = 0 then 0 else round_even(p_size::double / 37::double * 100, 1) end as pct, p_size > 45 or (p_partkey % 7 >= 2 and (p_partkey % 7)::double / p_size >= 0.15) as affine, greatest(0.0::double, least(100.0::double, 0 + (p_size - 10) * 100.0::double / 30)) as scaled, least(p_partkey % 9, greatest(1, ceil(p_size * 0.1::double)::bigint)) as sample from part")
def q_scalars(t):
    n, k = F.col("p_size"), F.col("p_partkey")
    return t.part.select("p_partkey", S.percent(n, F.lit(37)).alias("pct"), S.family_affine(n > 45, k % 7, n).alias("affine"), S.scaled(n, 10, 40, 0.0, 100.0).alias("scaled"), S.sample_size(n, 0.1, k % 9).cast("bigint").alias("sample"))


@query("select evidence_type, case when evidence_type in ('manifest', 'sbom', 'import') then 'direct' when evidence_type = 'repo_identity' then 'identity' else 'fallback' end as strength, count(*) as n from evidence group by 1, 2")
def q_evidence_strength(t):
    return t.evidence.groupBy("evidence_type", X.evidence_strength(F.col("evidence_type")).alias("strength")).agg(F.count(F.lit(1)).alias("n"))


@query("select technology_id, coalesce(provider_id in (3, 4), false) or category_id in ('ASIA') or technology_id in (7) or technology_id % 4 = 0 as anchor from technologies")
def q_llm_anchor(t):
    rows = t.technologies.withColumns({"provider_id": F.coalesce(F.col("provider_id"), F.lit(-1)).cast("string"), "technology_id": F.col("technology_id").cast("string"), "capabilities": F.when(F.col("technology_id") % 4 == 0, F.array(F.lit("llm"))).otherwise(F.array(F.lit("x")))})
    return rows.select(F.col("technology_id").cast("bigint").alias("technology_id"), C.llm_anchor(("3", "4"), ("ASIA",), ("7",)).alias("anchor"))


@query("select repo_id, repo_id % 2 = 0 as by_search, repo_id % 3 = 0 as by_anchor, repo_id % 2 <> 0 and repo_id % 3 <> 0 as only_seed from repos")
def q_found_by(t):
    k = F.col("repo_id")
    rows = t.repos.select("repo_id", F.when(k % 3 == 0, F.array(F.lit("anchor"), F.lit("seed"))).otherwise(F.array(F.lit("seed"))).alias("s"), F.when(k % 2 == 0, F.array(F.lit("repo:x"), F.lit("topic:llm"))).otherwise(F.array(F.lit("repo:x"))).alias("q"))
    a, b, c = C.found_by(F.col("s"), F.col("q"))
    return rows.select("repo_id", a.alias("by_search"), b.alias("by_anchor"), c.alias("only_seed"))


@query("select event_id, epoch_us(ts + interval 90 second)::double / 1e6 - epoch_us(ts)::double / 1e6 > 89.9 as late, sha256('{\"event_type\":\"' || event_type || '\",\"user_id\":' || cast(user_id as varchar) || '}') as digest from events")
def q_hash_and_elapsed(t):
    ts = F.col("ts").cast("timestamp")
    return t.events.select("event_id", (S.elapsed_seconds(ts, ts + F.expr("interval 90 seconds")) > 89.9).alias("late"), S.stable_hash("event_type", "user_id").alias("digest"))


@query("select doc_id as repo_id, substr(text, 1, 2500) as readme, least(2, (doc_id % 5)::int) as n_notes from documents")
def q_judge_packet(t):
    d = t.documents.select(F.col("doc_id").alias("repo_id"), F.col("source").alias("full_name"), F.col("text").alias("readme_text"), F.array_repeat(F.lit("n"), (F.col("doc_id") % 5).cast("int")).alias("notes"), F.array(F.lit("a"), F.lit("b")).alias("tree_paths"))
    return D.judge_packet(d, 2).select("repo_id", "readme", F.size("notes").alias("n_notes"))


@query("select event_id as repo_id, cast(case when user_id % 3 = 0 then 0 else event_id % 4 end as int) as n_manifests, user_id % 3 = 0 or event_id % 4 = 0 or (event_type = 'error' and user_id % 2 = 0) as wanted from events")
def q_import_scan(t):
    n = F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("event_id") % 4)
    hits, topics = F.when(F.col("event_type") == "error", 0).otherwise(1), F.when(F.col("user_id") % 2 == 0, 1).otherwise(0)
    return t.events.select(F.col("event_id").alias("repo_id"), n.cast("int").alias("n_manifests"), P.import_scan_wanted(n, hits, topics).alias("wanted"))


@query("select p_partkey, case when p_size % 2 = 0 then 'go.mod' when p_size % 3 = 0 then 'src/a/package.json' else 'x/y/Cargo.toml' end || case when p_partkey % 5 > 0 and p_size % 2 <> 0 and p_size % 3 <> 0 then '|z/go.mod' else '' end as chosen from part")
def q_manifest_paths(t):
    s, k = F.col("p_size"), F.col("p_partkey")
    first = F.when(s % 2 == 0, "go.mod").when(s % 3 == 0, "src/a/package.json").otherwise("x/y/Cargo.toml")
    tree = F.array(F.lit("a.py"), F.lit("vendor/go.mod"), first, F.when((k % 5 > 0) & (s % 2 != 0) & (s % 3 != 0), "z/go.mod").otherwise("z/readme"))
    # The deeper manifest comes behind the shallower one of the same rank.
    return t.part.select("p_partkey", F.array_join(F.reverse(S.manifest_paths(tree, ("vendor",))), "|").alias("chosen"))
