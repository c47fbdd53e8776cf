"""Graph measures: relational ones as DataFrames, centralities as kernels over one bounded projection.

The projection of technologies is a dimension: its size is checked against `MAX_NODES` before it
goes to a kernel, and beyond that only the relational measures and the iterative joins are used.
"""

from __future__ import annotations

import heapq
import re
import tempfile
import uuid
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_NODES = 5_000


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("left", "right", "weight").unionByName(pairs.select(F.col("right").alias("left"), F.col("left").alias("right"), "weight"))


def bipartite(edges: DataFrame) -> DataFrame:
    """GRA-01: the distinct edges between repositories and technologies; its projections are resolve.pairs by either side."""
    return edges.select("repo_id", "technology_id").distinct()


def top_pairs(pairs: DataFrame, n: int) -> DataFrame:
    """GRA-10, TOP-13: the n heaviest pairs."""
    return pairs.orderBy(F.col("weight").desc(), "left", "right").limit(n)


def degrees(pairs: DataFrame, nodes: int) -> DataFrame:
    """GRA-03: (node, degree, strength, centrality)."""
    g = both_ways(pairs).groupBy(F.col("left").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))
    return g.withColumn("centrality", F.col("degree").cast("double") / F.lit(float(max(1, nodes - 1))))


def density(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """GRA-04: one row (n_nodes, n_edges, density)."""
    n, m = nodes.agg(F.count(F.lit(1)).alias("n_nodes")), pairs.agg(F.count(F.lit(1)).alias("n_edges"))
    full = F.col("n_nodes").cast("double") * (F.col("n_nodes") - 1)
    return n.crossJoin(m).withColumn("density", F.when(full > 0, 2.0 * F.col("n_edges") / full).otherwise(0.0))


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, set as the checkpoint folder where there is none; in local mode without a setting, a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="stackweave-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: what is used several times is computed once."""
    path = f"{shared_folder(df.sparkSession)}/stackweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """GRA-04: (node, component): the least node that each is connected with, by label spreading and pointer jumping; each round is checkpointed."""
    shared_folder(nodes.sparkSession)
    links = both_ways(pairs.withColumn("weight", F.lit(1))).select("left", "right").checkpoint()
    labels = nodes.select("node", F.col("node").alias("component")).checkpoint()
    while True:
        near = links.join(labels, links["right"] == labels["node"]).groupBy("left").agg(F.min("component").alias("near"))
        spread = labels.join(near, labels["node"] == near["left"], "left").select("node", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("was"))
        up = spread.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = spread.join(up, "component", "left").select("node", F.least("component", F.coalesce("up", "component")).alias("component"), "was").checkpoint()
        if new.filter("component <> was").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")


def _matrix(pdf: pd.DataFrame) -> tuple[list, np.ndarray]:
    names = sorted(set(pdf["left"]) | set(pdf["right"]))
    at = {x: i for i, x in enumerate(names)}
    a = np.zeros((len(names), len(names)))
    for x, y, w in zip(pdf["left"], pdf["right"], pdf["weight"]):
        a[at[x], at[y]] = a[at[y], at[x]] = w
    return names, a


def eigenvector(a: np.ndarray, rounds: int = 1000, tolerance: float = 1e-6) -> np.ndarray:
    """GRA-07: power iteration x <- x + A x with unit length; all zeros if it doesn't settle."""
    n = len(a)
    x = np.full(n, 1 / n)
    for _ in range(rounds):
        new = x + a @ x
        new /= np.linalg.norm(new) or 1
        if np.abs(new - x).sum() < n * tolerance:
            return new
        x = new
    return np.zeros(n)


def shortest(a: np.ndarray, source: int) -> tuple[list[int], dict[int, list[int]], np.ndarray, np.ndarray]:
    """Dijkstra with distance 1 / weight: nodes by distance, predecessors, numbers of shortest paths, distances."""
    n = len(a)
    distance, paths = np.full(n, np.inf), np.zeros(n)
    before: dict[int, list[int]] = defaultdict(list)
    distance[source], paths[source] = 0, 1
    heap, order, done = [(0.0, source)], [], set()
    near = [np.flatnonzero(r) for r in a]
    while heap:
        d, v = heapq.heappop(heap)
        if v in done:
            continue
        done.add(v)
        order.append(v)
        for w in near[v]:
            to = d + 1 / a[v, w]
            if to < distance[w] - 1e-12:
                distance[w], paths[w], before[w] = to, paths[v], [v]
                heapq.heappush(heap, (to, int(w)))
            elif abs(to - distance[w]) <= 1e-12 and w not in done:
                paths[w] += paths[v]
                before[w].append(v)
    return order, before, paths, distance


def betweenness_closeness(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """GRA-05, GRA-06: Brandes' betweenness, normalised, and closeness scaled by the reachable share."""
    n = len(a)
    between, close = np.zeros(n), np.zeros(n)
    for s in range(n):
        order, before, paths, distance = shortest(a, s)
        total, reached = distance[order].sum(), len(order)
        if total > 0 and n > 1:
            close[s] = (reached - 1) / total * (reached - 1) / (n - 1)
        share = np.zeros(n)
        for w in reversed(order):
            for v in before[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                between[w] += share[w]
    return between / ((n - 1) * (n - 2)) if n > 2 else between, close


def modularity(a: np.ndarray, community: np.ndarray) -> float:
    m2, k = a.sum(), a.sum(0)
    return float(sum(a[np.ix_(c, c)].sum() / m2 - (k[c].sum() / m2) ** 2 for c in (np.flatnonzero(community == x) for x in np.unique(community)))) if m2 else 0.0


def greedy_communities(a: np.ndarray) -> np.ndarray:
    """GRA-08: merges the pair of communities that raises modularity most, until none does; labels by size, then least node."""
    n, m2 = len(a), a.sum()
    if not m2:
        return np.arange(n)
    e, share = a / m2, a.sum(0) / m2
    members = {i: [i] for i in range(n)}
    while len(members) > 1:
        live = sorted(members)
        gain = 2 * (e[np.ix_(live, live)] - np.outer(share[live], share[live]))
        gain[np.tril_indices(len(live))] = -np.inf
        i, j = divmod(int(gain.argmax()), len(live))
        if gain[i, j] <= 1e-15:
            break
        x, y = live[i], live[j]
        e[x] += e[y]
        e[:, x] += e[:, y]
        share[x] += share[y]
        members[x] += members.pop(y)
    out = np.zeros(n, np.int64)
    for label, group in enumerate(sorted(members.values(), key=lambda g: (-len(g), min(g)))):
        out[group] = label
    return out


def centralities(pairs: DataFrame) -> DataFrame:
    """GRA-05..08: (node, eigenvector, betweenness, closeness, community, modularity) of a projection of at most MAX_NODES nodes."""
    nodes = both_ways(pairs).select("left").distinct().limit(MAX_NODES + 1).count()
    if nodes > MAX_NODES:
        raise ValueError(f"the projection has more than {MAX_NODES} nodes; filter it by weight first")
    kind = dict(pairs.dtypes)["left"]

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        names, a = _matrix(pdf)
        between, close = betweenness_closeness(a)
        group = greedy_communities(a)
        return pd.DataFrame({"node": names, "eigenvector": eigenvector(a), "betweenness": between, "closeness": close, "community": group, "modularity": modularity(a, group)})

    return pairs.select("left", "right", "weight", F.lit(0).alias("all")).groupBy("all").applyInPandas(kernel, f"node {kind}, eigenvector double, betweenness double, closeness double, community long, modularity double")


def category_mixing(pairs: DataFrame, categories: DataFrame) -> DataFrame:
    """AGG-21: (category_a, category_b, weight) over unordered pairs of categories (technology_id, category_id)."""
    a = categories.select(F.col("technology_id").alias("left"), F.col("category_id").alias("ca"))
    b = categories.select(F.col("technology_id").alias("right"), F.col("category_id").alias("cb"))
    mixed = pairs.join(a, "left").join(b, "right")
    return mixed.groupBy(F.least("ca", "cb").alias("category_a"), F.greatest("ca", "cb").alias("category_b")).agg(F.sum("weight").alias("weight"))


def lift(edges: DataFrame, total: DataFrame) -> DataFrame:
    """EXT-04: (left, right, weight, share, lift) of technology pairs; total: one row with n_repos."""
    from .resolve import pairs as cooccurrence

    single = edges.groupBy("technology_id").agg(F.count_distinct("repo_id").alias("n"))
    a, b = single.select(F.col("technology_id").alias("left"), F.col("n").alias("na")), single.select(F.col("technology_id").alias("right"), F.col("n").alias("nb"))
    joined = cooccurrence(edges).join(a, "left").join(b, "right").crossJoin(F.broadcast(total))  # one row
    n = F.col("n_repos").cast("double")
    return joined.select("left", "right", "weight", (F.col("weight").cast("double") / n).alias("share"), (F.col("weight").cast("double") * n / (F.col("na").cast("double") * F.col("nb").cast("double"))).alias("lift"))
