"""From evidence to repository-technology edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import first_of
from ..functions.text import mentions, usable_alias

KIND_RANK = {"repo_identity": 4, "manifest": 3, "sbom": 2, "import": 1, "readme_mention": 0}
CONFIDENCE_RANK = {"high": 2, "medium": 1, "low": 0}
SCOPE_RANK = {"runtime": 4, "optional": 3, "prod": 2, "unknown": 1, "dev": 0}


def ranked(c: Column, ranks: dict[str, int], other: int = -1) -> Column:
    out = F.lit(None).cast("int")
    for name, r in ranks.items():
        out = F.when(c == name, r).otherwise(out)
    return F.coalesce(out, F.lit(other))


def evidence_order() -> list[Column]:
    """WIN-01: the strongest evidence first."""
    return [ranked(F.col("evidence_type"), KIND_RANK).desc(), ranked(F.col("confidence"), CONFIDENCE_RANK).desc(), ranked(F.col("scope"), SCOPE_RANK).desc()]


def strongest(evidence: DataFrame, tie: list[str] | list[Column]) -> DataFrame:
    """WIN-01: the strongest evidence of each repository and technology; ties by the columns of `tie`, names with nulls first."""
    return first_of(evidence.filter("technology_id is not null"), ["repo_id", "technology_id"], [*evidence_order(), *[F.col(c) if isinstance(c, str) else c for c in tie]])


def nulls_last(names: list[str]) -> list[Column]:
    """Ascending with nulls last, as an ORDER BY of DuckDB has them; Spark's own default is nulls first."""
    return [F.col(c).asc_nulls_last() for c in names]


def distinct_dependencies(evidence: DataFrame, tie: list[str]) -> DataFrame:
    """WIN-02: one dependency for each package, path and scope: manifests before SBOMs before others; ties by the columns of `tie`, nulls last, then by kind."""
    kind = F.when(F.col("evidence_type") == "manifest", 3).when(F.col("evidence_type") == "sbom", 2).otherwise(0)
    scope = F.when(F.col("scope") == "runtime", 2).when(F.col("scope") == "optional", 1).otherwise(0)
    return first_of(evidence, ["repo_id", "package_name", "source_path", "scope"], [kind.desc(), scope.desc(), *nulls_last([*tie, "evidence_type"])])


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """WIN-03, WIN-04."""
    return first_of(rows, keys, [F.col(c).desc() for c in order])


def provider_edges(evidence: DataFrame, providers: DataFrame) -> DataFrame:
    """NRM-02: a second row for the provider's own technology (technology_id, provider_technology_id) where that is another."""
    joined = evidence.join(providers, "technology_id").filter("provider_technology_id is not null and provider_technology_id <> technology_id")
    return joined.withColumns({"technology_id": F.col("provider_technology_id"), "match_method": F.lit("derived_provider")}).drop("provider_technology_id")


def readme_edges(contexts: DataFrame, aliases: DataFrame, covered: DataFrame, stop: tuple[str, ...] = ("core", "agent", "tools")) -> DataFrame:
    """NRM-03: for repositories without other edges, the first alias (technology_id, alias, ord) of each technology that the readme mentions."""
    rest = contexts.join(covered.select("repo_id").distinct(), "repo_id", "left_anti")
    terms = aliases.filter(usable_alias(F.col("alias"), stop))
    few = terms.limit(10_001).count() <= 10_000
    hits = rest.join(F.broadcast(terms) if few else terms, mentions(F.col("readme_text"), F.col("alias")))
    return first_of(hits.select("repo_id", "technology_id", "alias", "ord"), ["repo_id", "technology_id"], [F.col("ord"), F.col("alias")]).drop("ord")


def rebind(evidence: DataFrame, bound: DataFrame) -> DataFrame:
    """NRM-04: evidence with the technology that its package has in `bound` (package_name, technology_id, match_method); null where it has none."""
    return evidence.drop("technology_id", "match_method").join(bound, "package_name", "left")
