"""Dependency parsers: one manifest, SBOM or source file to many evidence rows.

Line formats and JSON are native expressions; TOML and go.mod, which need a state, are table
functions over Arrow batches.  What can't be parsed gives no rows.
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import file_name, import_paths, manifest_paths
from ..functions.text import normalize_name, purl_name, requirement_name

ROW = "repo_id long, path string, package_name string, scope string, specifier string"


def requirements(files: DataFrame) -> DataFrame:
    """PAR-03: requirements.txt; blank lines, comments and options don't count.  files: (repo_id, path, text)."""
    lines = files.select("repo_id", "path", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line"))
    kept = lines.filter((F.col("line") != "") & ~F.col("line").startswith("#") & ~F.col("line").startswith("-"))
    return kept.select("repo_id", "path", requirement_name(F.col("line")).alias("package_name"), F.lit("runtime").alias("scope"), F.col("line").alias("specifier"))


PACKAGE_JSON = {"dependencies": "runtime", "optionalDependencies": "runtime", "peerDependencies": "runtime", "devDependencies": "dev"}


def package_json(files: DataFrame) -> DataFrame:
    """PAR-04."""
    schema = ", ".join(f"{k} map<string,string>" for k in PACKAGE_JSON)
    parsed = files.select("repo_id", "path", F.from_json("text", schema).alias("j"))

    def group(key: str, scope: str) -> Column:
        found = F.filter(F.map_entries(F.col("j")[key]), lambda e: e["key"].isNotNull())
        return F.coalesce(F.transform(found, lambda e: F.struct(e["key"].alias("name"), F.lit(scope).alias("scope"), e["value"].alias("spec"))), F.array().cast("array<struct<name:string,scope:string,spec:string>>"))

    entries = F.concat(*[group(k, s) for k, s in PACKAGE_JSON.items()])
    return parsed.select("repo_id", "path", F.inline(entries)).select("repo_id", "path", normalize_name(F.col("name")).alias("package_name"), "scope", F.col("spec").alias("specifier"))


def spdx(files: DataFrame) -> DataFrame:
    """PAR-07: direct dependencies of the root that the document describes.  files: (repo_id, path, text)."""
    schema = (
        "packages array<struct<SPDXID:string,name:string,versionInfo:string,externalRefs:array<struct<referenceType:string,referenceLocator:string>>>>, "
        "relationships array<struct<spdxElementId:string,relatedSpdxElement:string,relationshipType:string>>"
    )
    parsed = files.select("repo_id", "path", F.from_json("text", schema).alias("j"))
    root = F.get(F.filter("j.relationships", lambda r: r["relationshipType"] == "DESCRIBES"), F.lit(0))["relatedSpdxElement"]
    direct = F.transform(F.filter("j.relationships", lambda r: (r["relationshipType"] == "DEPENDS_ON") & (r["spdxElementId"] == F.col("root"))), lambda r: r["relatedSpdxElement"])
    rows = parsed.withColumn("root", root).withColumn("direct", direct)
    picked = rows.select("repo_id", "path", F.inline(F.filter("j.packages", lambda p: F.array_contains(F.col("direct"), p["SPDXID"]))))
    purl = F.get(F.filter("externalRefs", lambda r: r["referenceType"] == "purl"), F.lit(0))["referenceLocator"]
    name = F.coalesce(purl_name(purl), normalize_name(F.col("name")))
    return picked.filter(name.isNotNull()).select("repo_id", "path", name.alias("package_name"), F.lit("runtime").alias("scope"), F.col("versionInfo").alias("specifier"))


def _toml(text: str) -> list[tuple[str, str, str | None]]:
    """PAR-02."""
    try:
        t = tomllib.loads(text)
    except (tomllib.TOMLDecodeError, TypeError):
        return []
    out: list[tuple[str, str, str | None]] = []
    for line in t.get("project", {}).get("dependencies", []):
        out.append((re.split(r"[<>=!~ ;\[]", line.strip(), maxsplit=1)[0], "runtime", line))
    for name, spec in t.get("tool", {}).get("poetry", {}).get("dependencies", {}).items():
        if name.lower() != "python":
            out.append((name, "runtime", spec if isinstance(spec, str) else None))
    return out


def _cargo(text: str) -> list[tuple[str, str, str | None]]:
    """PAR-06."""
    try:
        t = tomllib.loads(text)
    except (tomllib.TOMLDecodeError, TypeError):
        return []
    groups = {"dependencies": "runtime", "build-dependencies": "runtime", "dev-dependencies": "dev"}
    return [(n, s, v if isinstance(v, str) else v.get("version") if isinstance(v, dict) else None) for g, s in groups.items() for n, v in t.get(g, {}).items()]


def _go(text: str) -> list[tuple[str, str, str | None]]:
    """PAR-05."""
    out, inside = [], False
    for line in (x.split("//")[0].strip() for x in (text or "").splitlines()):
        if line.startswith("require ("):
            inside = True
        elif inside and line == ")":
            inside = False
        elif inside or line.startswith("require "):
            parts = line.removeprefix("require ").split()
            if parts:
                out.append((parts[0].rsplit("/", 1)[-1], "runtime", " ".join(parts)))
    return out


PYTHON = {"pyproject.toml": _toml, "Cargo.toml": _cargo, "go.mod": _go}


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(i, p, n.strip().strip("\"'").lower(), s, v) for i, p, t in zip(*(b.column(k).to_pylist() for k in range(3))) for n, s, v in PYTHON[p.rsplit("/", 1)[-1]](t) if n]
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 0 else pa.string()) for k, c in enumerate(cols)], [x.split()[0] for x in ROW.split(", ")])


def manifests(files: DataFrame) -> DataFrame:
    """PAR-01: all manifests (repo_id, path, text) by file name."""
    name = file_name(F.col("path"))
    native = requirements(files.filter(name == "requirements.txt")).unionByName(package_json(files.filter(name == "package.json")))
    rest = files.filter(name.isin(*PYTHON)).select(F.col("repo_id").cast("long"), "path", "text").mapInArrow(_parse, ROW)
    return native.unionByName(rest)


def python_imports(text: Column) -> Column:
    """PAR-08: modules of import and from, their top packages, and module.name of from-imports."""
    plain = F.regexp_extract_all(text, F.lit(r"(?m)^\s*import\s+([\w.]+)"), 1)
    module = F.regexp_extract_all(text, F.lit(r"(?m)^\s*from\s+([\w.]+)\s+import\s+\w+"), 1)
    name = F.regexp_extract_all(text, F.lit(r"(?m)^\s*from\s+[\w.]+\s+import\s+(\w+)"), 1)
    top = lambda xs: F.transform(xs, lambda m: F.substring_index(m, ".", 1))
    return F.array_distinct(F.concat(plain, top(plain), module, top(module), F.zip_with(module, name, lambda m, n: F.concat(m, F.lit("."), n))))


def js_imports(text: Column) -> Column:
    """PAR-08: from, import and require, with the base names of scoped packages."""
    names = F.concat(F.regexp_extract_all(text, F.lit("""(?:from|import)\\s*\\(?["']([^"'.][^"']*)["']"""), 1), F.regexp_extract_all(text, F.lit("""require\\(\\s*["']([^"'.][^"']*)["']"""), 1))
    scoped = F.transform(F.filter(names, lambda n: n.startswith("@")), lambda n: F.get(F.split(n, "/"), F.lit(1)))
    return F.array_distinct(F.concat(names, F.filter(scoped, lambda n: n.isNotNull())))


def go_imports(text: Column) -> Column:
    names = F.regexp_extract_all(text, F.lit('(?m)^\\s*(?:import\\s+)?(?:\\w+\\s+)?"([^"]+)"'), 1)
    return F.array_distinct(F.concat(names, F.transform(names, lambda n: F.substring_index(n, "/", -1))))


def rust_imports(text: Column) -> Column:
    names = F.regexp_extract_all(text, F.lit(r"(?m)^\s*use\s+([\w:]+)"), 1)
    return F.array_distinct(F.concat(names, F.transform(names, lambda n: F.substring_index(n, "::", 1))))


def imports(files: DataFrame) -> DataFrame:
    """PAR-08: (repo_id, path, name) of source files by extension."""
    ext = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    names = F.when(ext == ".py", python_imports(F.col("text"))).when(ext.isin(".js", ".ts", ".tsx", ".jsx"), js_imports(F.col("text"))).when(ext == ".go", go_imports(F.col("text"))).when(ext == ".rs", rust_imports(F.col("text")))
    return files.select("repo_id", "path", F.explode(names).alias("name"))


def import_scan_wanted(manifest_count: Column, structured_hits: Column, topic_hits: Column) -> Column:
    """PAR-10."""
    return (manifest_count == 0) | ((structured_hits == 0) & (topic_hits > 0))


def repository(items: DataFrame) -> DataFrame:
    """PAR-13: landed JSON of a search or hydration call (`json`) to repository rows."""
    schema = (
        "id long, full_name string, nameWithOwner string, databaseId long, description string, owner struct<type:string,login:string>, stargazers_count int, stargazerCount int, forks_count int, forkCount int, "
        "language string, primaryLanguage struct<name:string>, topics array<string>, license struct<spdx_id:string>, archived boolean, isArchived boolean, fork boolean, isFork boolean, pushed_at string, pushedAt string, default_branch string"
    )
    j = items.select(F.from_json("json", schema).alias("j")).select("j.*")
    return j.select(
        F.coalesce("id", "databaseId").alias("repo_id"), F.coalesce("full_name", "nameWithOwner").alias("full_name"), "description", F.col("owner.type").alias("owner_type"),
        F.coalesce("stargazers_count", "stargazerCount", F.lit(0)).alias("stars"), F.coalesce("forks_count", "forkCount", F.lit(0)).alias("forks"), F.coalesce("language", "primaryLanguage.name").alias("primary_language"),
        F.coalesce("topics", F.array().cast("array<string>")).alias("topics"), F.col("license.spdx_id").alias("license_spdx"), F.coalesce("archived", "isArchived", F.lit(False)).alias("is_archived"),
        F.coalesce("fork", "isFork", F.lit(False)).alias("is_fork"), F.coalesce("pushed_at", "pushedAt").alias("pushed_at"), F.coalesce("default_branch", F.lit("main")).alias("default_branch"),
    )


def bounded_imports(trees: DataFrame, sources: DataFrame, extensions: tuple[str, ...] = (".py", ".js", ".ts", ".go", ".rs"), cap: int = 40) -> DataFrame:
    """PAR-09: imports of at most cap files of each tree (repo_id, tree_paths), the likeliest first; sources: (repo_id, path, text)."""
    chosen = trees.select("repo_id", F.explode(import_paths(F.col("tree_paths"), extensions, cap=cap)).alias("path"))
    return imports(sources.join(chosen, ["repo_id", "path"], "left_semi"))


def assemble(trees: DataFrame, files: DataFrame, sboms: DataFrame, sources: DataFrame) -> DataFrame:
    """PAR-12: contexts of trees (repo_id, tree_paths): manifests' paths, and the sorted distinct packages of manifests, SBOMs and imports.
    Imports are scanned only where there is no manifest (PAR-10)."""
    found = trees.withColumn("manifest_paths", manifest_paths(F.col("tree_paths")))
    listed = found.select("repo_id", F.explode("manifest_paths").alias("path"))
    names = lambda df, c, out: df.groupBy("repo_id").agg(F.array_sort(F.collect_set(c)).alias(out))
    parts = [
        names(manifests(files.join(listed, ["repo_id", "path"], "left_semi")), "package_name", "manifest_packages"),
        names(spdx(sboms), "package_name", "sbom_packages"),
        names(bounded_imports(found.filter(F.size("manifest_paths") == 0), sources), "name", "imported"),
    ]
    for p in parts:
        found = found.join(p, "repo_id", "left")
    none = F.array().cast("array<string>")
    return found.withColumns({c: F.coalesce(c, none) for c in ("manifest_packages", "sbom_packages", "imported")})
