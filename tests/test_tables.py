"""Sources, sinks, graph kernels and incremental runs."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackweave.operators import graph as G
from stackweave.sources import tables as T
from stackweave.streaming import incremental as I


def test_tolerant_scans(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    assert T.scan(spark, path, "a int, b string").collect() == [] and T.row_count(spark, path) == 0
    spark.createDataFrame([(1, "x"), (2, None)], "a int, c string").write.parquet(path)
    assert [tuple(r) for r in T.scan(spark, path, "a long, b string").orderBy("a").collect()] == [(1, None), (2, None)]
    assert T.scan_available(spark, path, ["b", "c"]).columns == ["c"] and T.row_count(spark, path) == 2
    assert {r.c for r in T.scan_typed(spark, path, "a int, c string", {"c": "none"}).collect()} == {"x", "none"}


def test_evidence_falls_back_to_contexts(spark, tmp_path):
    dep = {"package_name": "p", "evidence_type": "manifest"}
    ctx = spark.createDataFrame([], T.SCHEMAS["repo_contexts"])
    rows = [{"repo_id": 1, "manifest_dependencies": [dep], "import_dependencies": [dep, dep]}]
    spark.createDataFrame([tuple(r.get(f.name) for f in ctx.schema) for r in rows], ctx.schema).write.parquet(f"{tmp_path}/repo_contexts.parquet")
    spark.createDataFrame([(1, "a/b")], "repo_id long, full_name string").write.parquet(f"{tmp_path}/repos.parquet")
    got = T.evidence(spark, str(tmp_path)).collect()
    assert len(got) == 3 and {r.full_name for r in got} == {"a/b"}
    spark.createDataFrame([("q", 1)], "package_name string, repo_id long").write.parquet(f"{tmp_path}/repo_dependency_evidence.parquet")
    assert [r.package_name for r in T.evidence(spark, str(tmp_path)).collect()] == ["q"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["x", "y"])], "b int, a array<string>")
    T.write_table(df, f"{tmp_path}/p", f"{tmp_path}/c")
    assert spark.read.option("header", True).option("escape", "\\").csv(f"{tmp_path}/c").first().a.replace("\\", "") == '["x","y"]'
    T.write_json(df, f"{tmp_path}/j")
    text = "".join(r.value + "\n" for r in spark.read.text(f"{tmp_path}/j").collect())
    assert list(json.loads(text)) == ["a", "b"]
    for _ in range(2):
        T.append_ledger(df, f"{tmp_path}/l")
    assert spark.read.json(f"{tmp_path}/l").count() == 2
    assert T.manifest(spark, f"{tmp_path}/p").filter("bytes > 0 and length(sha256) = 64").count() >= 1
    assert T.markdown(df.select("b")) == "| b |\n| --- |\n| 1 |\n" and "<td>1</td>" in T.html_table(df)
    assert T.read_json(spark, f"{tmp_path}/none.json", "a int").collect() == []
    T.copy_table(spark, f"{tmp_path}/p", f"{tmp_path}/p2")
    assert T.row_count(spark, f"{tmp_path}/p2") == 1
    assert T.snapshot_date(spark.createDataFrame([], "snapshot_date date")).first()[0] == "unknown"


def test_configuration(spark):
    text = "technologies:\n- {technology_id: a, repo_names: [x/y, bad]}\n- {technology_id: a}\nentities:\n- {entity_id: e, technology_ids: [a, zz]}\n- {entity_id: f, technology_ids: [a]}\nsegments:\n- {segment_id: s, technology_ids: [q]}\n"
    tech = T.config(spark, text, "technologies", "technology_id string, repo_names array<string>", {"repo_names": []})
    ent = T.config(spark, text, "entities", "entity_id string, technology_ids array<string>")
    seg = T.config(spark, text, "segments", "segment_id string, technology_ids array<string>")
    got = {tuple(r) for r in T.config_issues(tech, ent, seg).collect()}
    assert got == {("doubled technology", "a"), ("entity of unknown technology", "zz"), ("segment of unknown technology", "q"), ("malformed repository name", "bad"), ("technology of two owners", "a")}


def test_kernels_on_known_graphs():
    path = np.zeros((5, 5))
    for i in range(4):
        path[i, i + 1] = path[i + 1, i] = 1
    between, close = G.betweenness_closeness(path)
    assert np.allclose(between, [0, 0.5, 2 / 3, 0.5, 0]) and math.isclose(close[2], 4 / 6)
    star = np.zeros((4, 4))
    star[0, 1:] = star[1:, 0] = 1
    x = G.eigenvector(star)
    assert math.isclose(x[0] / x[1], math.sqrt(3), rel_tol=1e-4)
    two = np.zeros((6, 6))
    for a, b in ((0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)):
        two[a, b] = two[b, a] = 1
    group = G.greedy_communities(two)
    assert list(group) == [0, 0, 0, 1, 1, 1] and math.isclose(G.modularity(two, group), 5 / 14)
    assert G.greedy_communities(np.zeros((3, 3))).tolist() == [0, 1, 2]


def test_stream_resumes_and_is_idempotent(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    decide = lambda b: {"decisions": b.select("repo_id", (F.col("stars") > 10).alias("passed"))}
    schema, result = "repo_id long, stars long", "repo_id long, passed boolean"
    assert I.committed(spark, out, "decisions", result).collect() == []
    put = lambda lo, hi: spark.range(lo, hi, 1, 1).select(F.col("id").alias("repo_id"), (F.col("id") * 3).alias("stars")).write.mode("append").parquet(source)
    put(0, 5)
    put(5, 9)
    assert I.classify_stream(spark, source, schema, out, decide) == 2
    assert I.classify_stream(spark, source, schema, out, decide) == 0
    put(9, 12)
    assert I.classify_stream(spark, source, schema, out, decide) == 1
    done = I.committed(spark, out, "decisions", result)
    want = spark.range(0, 12).select(F.col("id").alias("repo_id"), (F.col("id") * 3 > 10).alias("passed"))
    assert done.exceptAll(want).count() == 0 and done.count() == 12
    assert [r.id for r in I.remaining(spark.range(10, 14).withColumnRenamed("id", "repo_id"), done).select(F.col("repo_id").alias("id")).orderBy("id").collect()] == [12, 13]
    I.write_batch({"decisions": done.limit(3)}, out, 7)
    I.write_batch({"decisions": want.filter("repo_id = 3")}, out, 7)
    assert I.committed(spark, out, "decisions", result).count() == 13
    assert I.progress(spark, out, 12).first().state == "completed"


def test_guard(spark, tmp_path):
    ids = spark.range(3).withColumnRenamed("id", "repo_id")
    for _ in range(2):
        I.guard(spark, str(tmp_path), "c1", ids)
    with pytest.raises(ValueError):
        I.guard(spark, str(tmp_path), "c2", ids)
    with pytest.raises(ValueError):
        I.guard(spark, str(tmp_path), "c1", ids.limit(2))
