"""Technology discovery, entities, seeds, preflight samples and communities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.stats import anchor_multiplier, first_of, max_normalized, priority, top_per_group
from ..operators.graph import MAX_NODES, both_ways, centralities, degrees, kept
from ..operators.resolve import pairs
from .reports import family_priority, finals, missing_edges


def with_purl(evidence: DataFrame, purls: DataFrame, order: list[str]) -> DataFrame:
    """JOI-17: evidence with the purl of its repository and package; of several the last by `order`."""
    last = first_of(purls, ["repo_id", "package_name"], [F.col(c).desc() for c in order]).select("repo_id", "package_name", "purl")
    return evidence.join(last, ["repo_id", "package_name"], "left")


def retained(fams: DataFrame, top_n: int) -> DataFrame:
    """TOP-05: the best max(250, 25 n) families by the coarse score."""
    return family_priority(fams).orderBy(F.col("score").desc(), "family").limit(max(250, 25 * top_n))


def family_graph(evidence: DataFrame, decisions: DataFrame, edges: DataFrame, keep: DataFrame) -> DataFrame:
    """GRA-09: families that occur together in finals without an edge."""
    rows = evidence.filter("technology_id is null").withColumn("family", X.family_id(F.col("package_name")))
    own = rows.join(missing_edges(decisions, edges).select("repo_id"), "repo_id", "left_semi").join(keep.select("family"), "family", "left_semi")
    return pairs(own, item="family")


def discovery_report(fams: DataFrame, graph: DataFrame, overlap: DataFrame | None = None) -> DataFrame:
    """REP-04, MAT-05, MAT-06: families by weighted priority; centralities count where the graph is small enough for the kernel.

    Families and graph are used several times: both are kept, so that the evidence is read once for each.
    """
    fams, graph = kept(fams, "families"), kept(graph, "graph")
    nodes = both_ways(graph).select("left").distinct().limit(MAX_NODES + 1).count()
    deg = degrees(graph, nodes).select(F.col("node").alias("family"), F.col("strength").alias("degree"))
    joined = fams.join(deg, "family", "left")
    if 0 < nodes <= MAX_NODES:
        joined = joined.join(centralities(graph).select(F.col("node").alias("family"), "eigenvector", "betweenness"), "family", "left")
    else:
        joined = joined.withColumns({"eigenvector": F.lit(0.0), "betweenness": F.lit(0.0)})
    joined = joined.join(overlap, "family", "left") if overlap is not None else joined.withColumn("overlap", F.lit(0))
    filled = joined.fillna(0, ["degree", "eigenvector", "betweenness", "overlap"])
    names = {"final": "n_finals", "missing": "n_missing", "repos": "n_repos", "stars": "stars", "eigenvector": "eigenvector", "betweenness": "betweenness", "degree": "degree", "benchmark": "overlap"}
    normal = max_normalized(filled, list(names.values()))
    anchor = anchor_multiplier(F.col("n_scoped"), F.col("overlap"), F.lit(False))
    return normal.withColumn("priority", priority({k: F.col(f"{c}_norm") for k, c in names.items()}, F.col("penalty"), anchor)).orderBy(F.col("priority").desc(), F.col("n_missing").desc(), F.col("n_finals").desc(), "family")


def entity_links(entities: DataFrame) -> DataFrame:
    """JOI-13: (technology_id, entity_id) of entities with an array of technologies."""
    return entities.select(F.explode("technology_ids").alias("technology_id"), "entity_id").distinct()


def entity_report(entities: DataFrame, stewards: DataFrame, edges: DataFrame) -> DataFrame:
    """AGG-14: for each entity its technologies, the repositories it stewards (repo_id, entity_id), and those that use its technologies."""
    links = entity_links(entities)
    tech = links.groupBy("entity_id").agg(F.count_distinct("technology_id").alias("n_technologies"))
    own = stewards.groupBy("entity_id").agg(F.count_distinct("repo_id").alias("n_stewarded"))
    using = edges.join(links, "technology_id").groupBy("entity_id").agg(F.count_distinct("repo_id").alias("n_using"))
    out = entities.select("entity_id").join(tech, "entity_id", "left").join(own, "entity_id", "left").join(using, "entity_id", "left")
    return out.fillna(0)


def vendors(decisions: DataFrame, edges: DataFrame, terms: DataFrame) -> DataFrame:
    """Finals without an edge whose name holds a vendor's term, in no order."""
    from ..operators.resolve import contained_terms

    return contained_terms(missing_edges(decisions, edges).select("repo_id", "full_name", "stars"), terms, "full_name")


def vendor_like(repos: DataFrame, decisions: DataFrame, edges: DataFrame, terms: DataFrame) -> DataFrame:
    """TOP-03: finals without an edge whose name holds a vendor's term, most stars first."""
    return vendors(decisions, edges, terms).orderBy(F.col("stars").desc(), "full_name")


def suggested_inputs(prefixes: DataFrame, vendors: DataFrame, n: int) -> DataFrame:
    """TOP-10: prefixes at ten times their count and repositories at their stars, the n first."""
    a = prefixes.select(F.lit("prefix").alias("kind"), F.col("prefix").alias("name"), (F.col("n") * 10).cast("long").alias("weight"))
    b = vendors.select(F.lit("repo").alias("kind"), F.col("full_name").alias("name"), F.col("stars").cast("long").alias("weight"))
    return a.unionByName(b).orderBy(F.col("weight").desc(), "kind", "name").limit(n)


def preflight(repos: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """TOP-08: repositories of the benchmark first, then the others, each by stars."""
    listed = wanted.select(F.lower("full_name").alias("key")).distinct().withColumn("listed", F.lit(0))
    rows = repos.join(listed, F.lower("full_name") == F.col("key"), "left")
    return rows.orderBy(F.coalesce("listed", F.lit(1)), F.col("stars").desc(), "repo_id").limit(n).drop("key", "listed")


def seeds(**sources: DataFrame) -> DataFrame:
    """CLS-09: (full_name, sources): repositories that configuration names, with the sorted kinds of places that name them."""
    out = None
    for name, df in sources.items():
        one = df.select(F.lower("full_name").alias("full_name"), F.lit(name).alias("source"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("full_name").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def token_overlap(benchmark_names: DataFrame) -> DataFrame:
    """AGG-23: (family, overlap): how many benchmark entities (entity_id, name) hold the token."""
    words = benchmark_names.select("entity_id", F.explode(F.split(F.lower("name"), "[^a-z0-9]+")).alias("family"))
    return words.filter(F.length("family") >= 3).distinct().groupBy("family").agg(F.count(F.lit(1)).alias("overlap"))


def context_profile(manifest: Column, sbom: Column, imports: Column, identity: Column, readme: Column) -> Column:
    """CLS-07: the evidence profile of a context from what it has."""
    direct = manifest | sbom | imports
    return (
        F.when(direct & readme, "mixed_direct_and_fallback").when(direct, "direct_only").when(identity & readme, "repo_identity_plus_fallback")
        .when(identity, "repo_identity_only").when(readme, "readme_only").otherwise("unmapped")
    )


def judge_packet(contexts: DataFrame, notes: int = 20, paths: int = 50, head: int = 2500) -> DataFrame:
    """ARR-07: what a judge is shown."""
    return contexts.select("repo_id", "full_name", F.slice("notes", 1, notes).alias("notes"), F.slice("tree_paths", 1, paths).alias("tree_paths"), F.left("readme_text", F.lit(head)).alias("readme"))


def exemplars(edges: DataFrame, communities: DataFrame, repos: DataFrame, n: int = 5) -> DataFrame:
    """REP-09: the repositories that use most technologies of each community (node, community), then by stars."""
    g = edges.join(communities.select(F.col("node").alias("technology_id"), "community"), "technology_id").groupBy("community", "repo_id").agg(F.count_distinct("technology_id").alias("overlap"))
    return top_per_group(g.join(repos.select("repo_id", "stars"), "repo_id"), ["community"], [F.col("overlap").desc(), F.col("stars").desc(), F.col("repo_id")], n)


def neighbours(edges: DataFrame, n: int = 5) -> DataFrame:
    """The n technologies that most often occur with each technology."""
    g = both_ways(pairs(edges)).select(F.col("left").alias("technology_id"), F.col("right").alias("neighbour"), "weight")
    return top_per_group(g, ["technology_id"], [F.col("weight").desc(), F.col("neighbour")], n)


def category_top(edges: DataFrame, technologies: DataFrame, n: int = 5) -> DataFrame:
    """AGG-17: the n most used technologies of each category."""
    g = edges.groupBy("technology_id").agg(F.count_distinct("repo_id").alias("n_repos")).join(technologies.select("technology_id", "category_id"), "technology_id")
    return top_per_group(g, ["category_id"], [F.col("n_repos").desc(), F.col("technology_id")], n)


def segment_adoption(edges: DataFrame, decisions: DataFrame, technologies: DataFrame) -> DataFrame:
    """Finals of each segment that use a provider, with the provider's rank within the segment."""
    g = edges.join(technologies.select("technology_id", "provider_id"), "technology_id").filter("provider_id is not null").join(finals(decisions).select("repo_id", "primary_segment"), "repo_id")
    counts = g.groupBy("primary_segment", "provider_id").agg(F.count_distinct("repo_id").alias("n_repos"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("primary_segment").orderBy(F.col("n_repos").desc(), "provider_id")))
