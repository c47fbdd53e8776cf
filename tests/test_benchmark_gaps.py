"""The seven checks of benchmark gaps."""

from stackweave.plans import reports

FLAGS = "repo_discovered repo_discovered_by_search repo_discovered_by_anchor is_anchor_entity repo_included repo_identity_mapped third_party_dependency_evidence_found third_party_adoption dependency_evidence_found".split()


def test_prioritized_gaps_have_scores_reasons_and_actions(spark):
    fine = dict.fromkeys(FLAGS, True)
    cases = {
        "fine": ({}, None), "unmapped": ({"repo_identity_mapped": False}, 80), "seed": ({"repo_discovered_by_search": False}, 30), "anchor": ({"repo_discovered_by_anchor": False}, 20),
        "no anchor": ({"repo_discovered_by_anchor": False, "is_anchor_entity": False}, None), "out": ({"repo_included": False, "repo_identity_mapped": False}, 70), "edge": ({"third_party_adoption": False}, 60),
        "own evidence": ({"third_party_adoption": False, "third_party_dependency_evidence_found": False}, None), "nothing": (dict.fromkeys(FLAGS, False), 140), "nulls": (dict.fromkeys(FLAGS), 140),
    }
    rows = [(n, n.title(), "positive", *(fine | c).values()) for n, (c, _) in cases.items()]
    rows.append(("negative", "Negative", "negative", *dict.fromkeys(FLAGS, False).values()))
    df = spark.createDataFrame(rows, "entity_id string, display_name string, expectation string, " + ", ".join(f"{f} boolean" for f in FLAGS))
    got = {r.entity_id: r for r in reports.prioritized_gaps(df).collect()}
    assert {n: r.priority_score for n, r in got.items()} == {n: w for n, (_, w) in cases.items() if w}
    assert got["unmapped"].suggested_actions == ["add or fix repo_names mapping in registry"]
    assert got["nothing"].reasons == ["benchmark repo not discovered", "no dependency evidence found for benchmark entity"]
