"""Table, JSON, configuration and manifest sources and sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DEPENDENCY = (
    "package_name string, dependency_scope string, source_path string, evidence_type string, confidence string, raw_specifier string, raw_version string, purl string, license_spdx string, "
    "technology_id string, provider_id string, provider_technology_id string, entity_type string, canonical_product_id string, match_method string"
)
SCHEMAS = {
    "repos": "repo_id long, full_name string, html_url string, description string, owner_type string, stars int, forks int, primary_language string, topics array<string>, license_spdx string, is_archived boolean, is_fork boolean, is_template boolean, created_at string, updated_at string, pushed_at string, default_branch string, snapshot_date date, discovery_queries array<string>, discovery_source_types array<string>",
    "repo_dependency_evidence": f"{DEPENDENCY}, repo_id long, snapshot_date string",
    "repo_contexts": f"repo_id long, full_name string, default_branch string, readme_text string, tree_paths array<string>, manifest_paths array<string>, manifest_dependencies array<struct<{DEPENDENCY.replace(' ', ':').replace(',:', ', ')}>>, sbom_dependencies array<struct<{DEPENDENCY.replace(' ', ':').replace(',:', ', ')}>>, import_dependencies array<struct<{DEPENDENCY.replace(' ', ':').replace(',:', ', ')}>>",
    "technologies": "technology_id string, display_name string, category_id string, provider_id string, entity_type string, canonical_product_id string, aliases array<string>, package_prefixes array<string>, repo_names array<string>, capabilities array<string>",
}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scan(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """SRC-01, SRC-02: the schema's columns; a missing table is empty, a missing column null."""
    want = spark.createDataFrame([], schema).schema
    if not exists(spark, path):
        return spark.createDataFrame([], want)
    df = spark.read.parquet(path)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])


def scan_available(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """SRC-03: those of the columns that the table has."""
    df = spark.read.parquet(path)
    return df.select(*[c for c in columns if c in df.columns])


def scan_typed(spark: SparkSession, path: str, schema: str, defaults: dict[str, object]) -> DataFrame:
    """SRC-04: nulls and missing columns take their defaults."""
    df = scan(spark, path, schema)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in defaults.items()})


def row_count(spark: SparkSession, path: str) -> int:
    """SRC-05: from the footers; 0 for a missing table."""
    return spark.read.parquet(path).count() if exists(spark, path) else 0


def flatten_contexts(contexts: DataFrame) -> DataFrame:
    """SET-01, ARR-04: one row for each dependency of the three arrays."""
    arrays = F.concat(*[F.coalesce(c, F.array()) for c in ("manifest_dependencies", "sbom_dependencies", "import_dependencies")])
    return contexts.select("repo_id", F.inline(arrays))


def evidence(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-06: the flat evidence table, or the contexts' arrays where there is none, with the repositories' names."""
    if exists(spark, f"{folder}/repo_dependency_evidence.parquet"):
        df = scan(spark, f"{folder}/repo_dependency_evidence.parquet", SCHEMAS["repo_dependency_evidence"]).drop("snapshot_date")
    else:
        df = flatten_contexts(spark.read.parquet(f"{folder}/repo_contexts.parquet"))
    return df.join(scan(spark, f"{folder}/repos.parquet", "repo_id long, full_name string"), "repo_id", "left")


def snapshot_date(df: DataFrame) -> DataFrame:
    """SRC-07: one row, 'unknown' for none."""
    return df.limit(1).agg(F.coalesce(F.max(F.col("snapshot_date").cast("string")), F.lit("unknown")).alias("snapshot_date"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-08, SRC-11..14: a landed JSON document; what isn't an object is a row of nulls, a missing file no row."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="PERMISSIVE") if exists(spark, path) else spark.createDataFrame([], schema)


def landed_contents(items: DataFrame) -> DataFrame:
    """SRC-11: file contents of landed responses, base64 decoded; what can't be decoded is null."""
    return items.withColumn("text", F.try_to_binary(F.regexp_replace("content", r"\s", ""), F.lit("base64")).cast("string"))


def cache_key(*columns: str):
    """SRC-13: the name of a landed response."""
    return F.sha2(F.concat_ws("\n", *columns), 256)


def config(spark: SparkSession, text: str, section: str, schema: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """SRC-09: a section, a list of mappings, of a YAML or JSON configuration as a table."""
    try:
        import yaml

        data = yaml.safe_load(text)
    except ModuleNotFoundError:
        data = json.loads(text)
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    rows = [tuple(r.get(n, (defaults or {}).get(n)) for n in names) for r in (data or {}).get(section, [])]
    return spark.createDataFrame(rows, schema)


def config_issues(technologies: DataFrame, entities: DataFrame, segments: DataFrame) -> DataFrame:
    """SRC-10: (issue, subject): doubled ids, references to nothing, malformed names, technologies of two owners."""
    issue = lambda df, name, key: df.select(F.lit(name).alias("issue"), F.col(key).cast("string").alias("subject"))
    tech = technologies.groupBy("technology_id").count().filter("count > 1")
    refs = entities.select(F.explode("technology_ids").alias("technology_id"), "entity_id")
    names = technologies.select(F.explode("repo_names").alias("repo_name")).filter(~F.col("repo_name").rlike("^[^/]+/[^/]+$"))
    seg = segments.select(F.explode("technology_ids").alias("technology_id"))
    owners = refs.groupBy("technology_id").agg(F.count_distinct("entity_id").alias("n")).filter("n > 1")
    out = issue(tech, "doubled technology", "technology_id")
    for df, name, key in (
        (entities.groupBy("entity_id").count().filter("count > 1"), "doubled entity", "entity_id"),
        (refs.join(technologies, "technology_id", "left_anti"), "entity of unknown technology", "technology_id"),
        (seg.join(technologies, "technology_id", "left_anti"), "segment of unknown technology", "technology_id"),
        (names, "malformed repository name", "repo_name"),
        (owners, "technology of two owners", "technology_id"),
    ):
        out = out.unionByName(issue(df, name, key))
    return out.distinct()


def write_table(df: DataFrame, path: str, csv: str | None = None) -> None:
    """SRC-15: Parquet, committed as a whole; also CSV, with nested cells as JSON (ARR-05)."""
    df.write.mode("overwrite").parquet(path)
    if csv:
        flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
        flat.write.mode("overwrite").option("header", True).csv(csv)


def write_json(row: DataFrame, path: str) -> None:
    """SRC-16: a one-row table as a JSON object with sorted keys."""
    row.select(F.to_json(F.struct(*sorted(row.columns)), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-17: path, size and sha256 of every file; counts of rows come from each table's footers."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def append_ledger(row: DataFrame, path: str) -> None:
    """SRC-18."""
    row.coalesce(1).write.mode("append").json(path)


def copy_table(spark: SparkSession, source: str, target: str) -> None:
    """SRC-19."""
    spark.read.parquet(source).write.mode("overwrite").parquet(target)


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """SRC-20: a table of at most `limit` rows."""
    rows = df.limit(limit).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows]) + "\n"


def html_table(df: DataFrame, limit: int = 1000) -> str:
    """SRC-21."""
    import html

    rows = df.limit(limit).collect()
    tr = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{html.escape('' if c is None else str(c))}</{tag}>" for c in cells) + "</tr>"
    return "<table>" + tr("th", df.columns) + "".join(tr("td", r) for r in rows) + "</table>"
