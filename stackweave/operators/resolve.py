"""Resolution of package names to technologies: aliases, prefixes, imports, providers, identities.

Prefix rules are an equi-join: a package is exploded into its prefixes that end before or after a
separator, so no nested-loop join is needed and the work is linear in the names' separators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import first_of

SEPARATORS = "-_/."


def alias_keys(alias: Column) -> Column:
    """JOI-05: the keys of an alias: lower case, with - and _ exchanged."""
    low = F.lower(alias)
    return F.array_distinct(F.array(low, F.replace(low, F.lit("-"), F.lit("_")), F.replace(low, F.lit("_"), F.lit("-"))))


def alias_lookup(aliases: DataFrame) -> DataFrame:
    """JOI-05: (key, technology_id, ord) from (alias, technology_id, ord); the last definition of a key wins."""
    keys = aliases.select(F.explode(alias_keys(F.col("alias"))).alias("key"), "technology_id", "ord")
    return first_of(keys, ["key"], [F.col("ord").desc(), F.col("technology_id").desc()])


def prefixes_of(name: Column) -> Column:
    """Every prefix of the name by which a rule can match it: the whole, and those that end before or after a separator."""
    at = F.filter(F.sequence(F.lit(1), F.length(name)), lambda i: F.instr(F.lit(SEPARATORS), F.substr(name, i, F.lit(1))) > 0)
    return F.array_distinct(F.concat(F.array(name), F.transform(at, lambda i: F.left(name, i)), F.filter(F.transform(at, lambda i: F.left(name, i - 1)), lambda x: x != "")))


def matches_prefix(name: Column, prefix: Column) -> Column:
    """JOI-08 as a predicate: equal, or the name goes on behind a separator."""
    ends = F.instr(F.lit(SEPARATORS), F.right(prefix, F.lit(1))) > 0
    follows = F.length(name) > F.length(prefix)
    next_ = F.substr(name, F.length(prefix) + 1, F.lit(1))
    return (name == prefix) | (F.startswith(name, prefix) & F.when(ends, F.lit(True)).otherwise(follows & (F.instr(F.lit(SEPARATORS), next_) > 0)))


def longest_prefix(packages: DataFrame, rules: DataFrame, name: str = "package_name") -> DataFrame:
    """JOI-08: packages with the technology of the longest rule (prefix, technology_id) that matches; ties by prefix."""
    tried = packages.select(name).distinct().select(name, F.explode(prefixes_of(F.col(name))).alias("prefix"))
    hits = tried.join(rules, "prefix").filter(matches_prefix(F.col(name), F.col("prefix")))
    return first_of(hits, [name], [F.length("prefix").desc(), F.col("prefix"), F.col("technology_id")])


def resolve(candidates: DataFrame, aliases: DataFrame, registry: DataFrame, rules: DataFrame) -> DataFrame:
    """JOI-07: (id, technology_id, match_method) for ids with ordered candidates (id, pos, name): for each candidate in turn its alias,
    the registry's alias, the longest registry prefix; the first hit wins."""
    names = candidates.withColumn("name", F.lower("name"))
    one = names.join(aliases.select(F.col("key").alias("name"), "technology_id"), "name").select("id", "pos", F.lit(0).alias("step"), "technology_id", F.lit("exact_alias").alias("match_method"))
    two = names.join(registry.select(F.col("key").alias("name"), "technology_id"), "name").select("id", "pos", F.lit(1).alias("step"), "technology_id", F.lit("registry_alias").alias("match_method"))
    longest = longest_prefix(names, rules, "name")
    three = names.join(longest.select("name", "technology_id"), "name").select("id", "pos", F.lit(2).alias("step"), "technology_id", F.lit("package_prefix").alias("match_method"))
    return first_of(one.unionByName(two).unionByName(three), ["id"], [F.col("pos"), F.col("step"), F.col("technology_id")]).select("id", "technology_id", "match_method")


def resolve_imports(imports: DataFrame, aliases: DataFrame, registry: DataFrame) -> DataFrame:
    """JOI-06: (name, technology_id) of imports: raw, with - as _, with _ as -, in this order; aliases overlay the registry."""
    both = aliases.select("key", "technology_id", F.lit(0).alias("rank")).unionByName(registry.select("key", "technology_id", F.lit(1).alias("rank")))
    lookup = first_of(both, ["key"], [F.col("rank"), F.col("technology_id")])
    low = F.lower("name")
    tried = imports.select("name", F.posexplode(F.array(low, F.replace(low, F.lit("-"), F.lit("_")), F.replace(low, F.lit("_"), F.lit("-")))).alias("pos", "key"))
    return first_of(tried.join(lookup, "key"), ["name"], [F.col("pos"), F.col("technology_id")]).select("name", "technology_id")


def provider_candidates(name: Column) -> Column:
    """JOI-09: whole, scope, remainder, last part, first and last of the parts by - and by _."""
    low = F.lower(name)
    scope = F.when(low.startswith("@") & F.contains(low, F.lit("/")), F.substring_index(F.substring(low, 2, 1 << 30), "/", 1))
    rest = F.when(F.contains(low, F.lit("/")), F.regexp_replace(low, "^[^/]*/", ""))
    base = F.substring_index(low, "/", -1)
    parts = [low, scope, rest, base]
    for mark in "-_":
        parts += [F.substring_index(base, mark, 1), F.substring_index(base, mark, -1)]
    return F.array_distinct(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")))


def infer_provider(packages: DataFrame, lookup: DataFrame) -> DataFrame:
    """JOI-09: (package_name, provider_id): the first candidate whose alias (key, provider_id) has a provider."""
    tried = packages.select("package_name").distinct().select("package_name", F.posexplode(provider_candidates(F.col("package_name"))).alias("pos", "key"))
    hits = tried.join(lookup.filter("provider_id is not null"), "key")
    return first_of(hits, ["package_name"], [F.col("pos"), F.col("provider_id")]).select("package_name", "provider_id")


def contained_terms(rows: DataFrame, terms: DataFrame, hay: str) -> DataFrame:
    """JOI-10: rows with the sorted terms that their text holds.

    An equi-join: each text's parts of the lengths that terms have are joined with the terms, so the work grows with the texts and
    not with their number times that of the terms.  Terms are broadcast only if counted to be few.  The rows go along with their
    parts, so what they come from is computed once; equal rows become one.
    """
    n, sizes = terms.agg(F.count("term"), F.sort_array(F.collect_set(F.length("term")))).first()
    side = terms.select(F.col("term").alias("__sw_term")).distinct()
    text, size = F.col("__sw_text"), F.col("__sw_size")
    sized = rows.withColumn("__sw_text", F.lower(hay)).select("*", F.explode(F.lit(sizes).cast("array<int>")).alias("__sw_size")).filter(size <= F.length(text))
    parts = sized.select(*rows.columns, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(text, i, size)))).alias("__sw_term"))
    hits = parts.join(F.broadcast(side) if n <= 10_000 else side, "__sw_term")
    return hits.groupBy(*rows.columns).agg(F.array_sort(F.collect_set("__sw_term")).alias("terms"))


def identity_match(repos: DataFrame, registry: DataFrame, aliases: DataFrame) -> DataFrame:
    """JOI-11: (repo_id, technology_id) by the repository's own name; the registry overrides."""
    both = registry.select(F.lower("repo_name").alias("key"), "technology_id", F.lit(0).alias("rank")).unionByName(aliases.select(F.lower("repo_name").alias("key"), "technology_id", F.lit(1).alias("rank")))
    lookup = first_of(both, ["key"], [F.col("rank"), F.col("technology_id")])
    return repos.join(lookup, F.lower("full_name") == F.col("key")).select("repo_id", "technology_id")


def entity_match(repos: DataFrame, by_name: DataFrame, by_org: DataFrame) -> DataFrame:
    """JOI-12: (repo_id, entity_id, evidence_type): by repository name, else by its owner."""
    owner = F.lower(F.substring_index("full_name", "/", 1))
    joined = repos.join(by_name.select(F.lower("repo_name").alias("n"), F.col("entity_id").alias("e1")), F.lower("full_name") == F.col("n"), "left").join(
        by_org.select(F.lower("org").alias("o"), F.col("entity_id").alias("e2")), owner == F.col("o"), "left"
    )
    kind = F.when(F.col("e1").isNotNull(), "repo_name").otherwise("github_org")
    return joined.filter("e1 is not null or e2 is not null").select("repo_id", F.coalesce("e1", "e2").alias("entity_id"), kind.alias("evidence_type"), F.lit("high").alias("confidence")).distinct()


def pairs(edges: DataFrame, group: str = "repo_id", item: str = "technology_id") -> DataFrame:
    """JOI-14, GRA-02: (left, right, weight): how many groups hold both items.  One shuffle on the group, one on the pair."""
    sets = edges.select(group, item).distinct()
    a = sets.select(group, F.col(item).alias("left"))
    b = sets.select(group, F.col(item).alias("right"))
    return a.join(b, group).filter(F.col("left") < F.col("right")).groupBy("left", "right").agg(F.count(F.lit(1)).alias("weight"))


def running_cap(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """WIN-08: the first n rows in the order, by a distributed top-k."""
    return df.orderBy(*order).limit(n)


def round_robin(df: DataFrame, stratum: str, within: list[Column], strata: list[Column], n: int) -> DataFrame:
    """WIN-07: one of each stratum in turn until n are drawn."""
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy(*within))
    return df.withColumn("turn", turn).filter(F.col("turn") <= n).orderBy("turn", *strata).limit(n)
