"""Column functions on numbers, paths and dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """MAT-01, unrounded: 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def rounded_ratio(a: Column, b: Column) -> Column:
    """MAT-01 with four places, halves to even."""
    return F.bround(ratio(a, b), 4)


def percent(a: Column, b: Column) -> Column:
    """MAT-03."""
    return F.bround(ratio(a, b) * 100, 1)


def wilson(successes: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """MAT-02: the interval's ends, within 0 and 1; both 0 without a trial."""
    n, p = total.cast("double"), ratio(successes, total)
    scale = 1 + z * z / n
    middle = (p + z * z / (2 * n)) / scale
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    none = total <= 0
    return F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), middle - spread)), F.when(none, 0.0).otherwise(F.least(F.lit(1.0), middle + spread))


def coarse_score(missing: Column, final: Column, repos: Column, stars: Column, overlap: Column, penalty: Column) -> Column:
    """MAT-04."""
    return (5 * missing + 4 * final + 2 * repos + 0.5 * F.log1p(stars.cast("double")) + 2 * overlap) * F.greatest(F.lit(0.05), 1 - penalty)


def max_normalized(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """MAT-05: each column by its maximum; 0 where that isn't positive.  The maxima come by aggregation, not by a window over all."""
    top = df.agg(*[F.max(c).cast("double").alias(f"__max_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(top))  # one row
    return out.withColumns({f"{c}_norm": F.when(F.col(f"__max_{c}") > 0, F.col(c).cast("double") / F.col(f"__max_{c}")).otherwise(0.0) for c in columns}).drop(*[f"__max_{c}" for c in columns])


WEIGHTS = {"final": 0.22, "missing": 0.20, "repos": 0.14, "stars": 0.12, "eigenvector": 0.12, "betweenness": 0.10, "degree": 0.05, "benchmark": 0.05}


def priority(norm: dict[str, Column], penalty: Column, anchor: Column) -> Column:
    """MAT-06."""
    total = F.lit(0.0)
    for name, w in WEIGHTS.items():
        total = total + w * norm.get(name, F.lit(0.0))
    return 100 * total * (1 - penalty) * anchor


def anchor_multiplier(scoped: Column, overlap: Column, named: Column) -> Column:
    """MAT-07."""
    return F.when((overlap > 0) | named, 1.0).when(scoped > 0, 0.35).otherwise(0.2)


def family_affine(own: Column, hints: Column, total: Column) -> Column:
    """MAT-08."""
    return own | ((hints >= 2) & (ratio(hints, total) >= 0.15))


def verdict(delta: Column, better: str = "higher", tolerance: float = 1e-9) -> Column:
    """MAT-09."""
    signed = delta if better == "higher" else -delta
    return F.when(signed > tolerance, "improved").when(signed < -tolerance, "regressed").otherwise("unchanged")


def scaled(x: Column, lo: float, hi: float, to_lo: float, to_hi: float) -> Column:
    """MAT-10: linear, and kept within the target range."""
    y = to_lo + (x - lo) * (to_hi - to_lo) / (hi - lo) if hi != lo else F.lit(to_lo)
    return F.greatest(F.lit(float(min(to_lo, to_hi))), F.least(F.lit(float(max(to_lo, to_hi))), y))


def sample_size(n: Column, fraction: float, capacity: Column) -> Column:
    """MAT-11."""
    return F.least(capacity, F.greatest(F.lit(1), F.ceil(n * fraction)))


def stable_hash(*columns: Column) -> Column:
    """MAT-12: sha256 of the canonical JSON of the columns."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def score_band(c: Column) -> Column:
    """AGG-20."""
    return F.when(c.isNull(), "unknown").when(c <= 1, "0-1").when(c <= 3, "2-3").when(c <= 5, "4-5").when(c <= 8, "6-8").otherwise("9+")


def degree_bucket(c: Column) -> Column:
    """AGG-20."""
    return F.when(c <= 1, "1").when(c <= 3, "2-3").when(c <= 6, "4-6").when(c <= 10, "7-10").otherwise("11+")


def freshness_cutoff(day: Column, months: int) -> Column:
    """DAT-01: so many months back, on the 28th at most."""
    back = F.add_months(F.trunc(day, "month"), -months)
    return F.make_date(F.year(back), F.month(back), F.least(F.dayofmonth(day), F.lit(28)))


def elapsed_seconds(start: Column, end: Column) -> Column:
    """DAT-02."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """FIL-05."""
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def in_directories(path: Column, directories: Sequence[str]) -> Column:
    """FIL-04."""
    out = F.lit(False)
    for d in directories:
        out = out | path.startswith(d.rstrip("/") + "/")
    return out


SOURCE_DIRECTORIES = ("src", "app", "apps", "backend", "frontend", "lib", "packages", "server", "services")
MANIFESTS = ("go.mod", "package.json", "requirements.txt", "pyproject.toml", "Cargo.toml")


def manifest_priority(path: Column) -> Column:
    """TOP-11: (rank, depth, path)."""
    depth = F.size(F.split(path, "/")) - 1
    rank = F.when(depth == 0, 0).when(F.split(path, "/")[0].isin(*SOURCE_DIRECTORIES), 1).when(file_name(path).isin(*MANIFESTS), 2).otherwise(3)
    return F.struct(rank.alias("rank"), depth.alias("depth"), path.alias("path"))


def manifest_paths(paths: Column, excluded: Sequence[str] = (), cap: int = 40) -> Column:
    """PAR-11: a tree's manifests, the likeliest first, at most cap."""
    wanted = F.filter(paths, lambda p: file_name(p).isin(*MANIFESTS) & ~in_directories(p, excluded))
    return F.transform(F.slice(F.array_sort(F.transform(wanted, manifest_priority)), 1, cap), lambda x: x["path"])


def import_paths(paths: Column, extensions: Sequence[str], signal: Sequence[str] = SOURCE_DIRECTORIES, cap: int = 40) -> Column:
    """TOP-12: a tree's source files, those in telling directories first, at most cap."""
    wanted = F.filter(paths, lambda p: extension(p).isin(*extensions))
    ranked = F.transform(wanted, lambda p: F.struct(F.when(in_directories(p, signal), 0).otherwise(1).alias("rank"), p.alias("path")))
    return F.transform(F.slice(F.array_sort(ranked), 1, cap), lambda x: x["path"])


def subprojects(paths: Column) -> Column:
    """ARR-02: how many of packages, apps and services are top directories of the tree."""
    roots = F.transform(F.filter(paths, lambda p: F.contains(p, F.lit("/"))), lambda p: F.split(p, "/")[0])
    return F.size(F.array_intersect(roots, F.array(F.lit("packages"), F.lit("apps"), F.lit("services"))))


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """WIN-01..04: the first row of each key in the order, which must be total for a stable result."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """TOP-06; Spark limits each group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def unique_ordered(values: Column) -> Column:
    """WIN-06: the first of the values that are equal without case, in their order."""
    low = F.transform(values, F.lower)
    return F.filter(values, lambda v, i: F.array_position(low, F.lower(v)) == i + 1)


def commonest(df: DataFrame, key: str, label: str) -> DataFrame:
    """WIN-09: the most frequent label of each key, ties by label."""
    counts = df.groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))
    return first_of(counts, [key], [F.col("n").desc(), F.col(label)]).select(key, label)
