"""Packing documents into bins of fixed capacity by a configuration linear program.

Lengths are words (runs without white space); a document longer than the capacity is cut into full
pieces, each a bin of its own, and a remainder.  Remainders are counted by length on a grid of
`grid` words: this histogram, at most capacity / grid numbers at any size of input, is all that
reaches the driver.  There the covering LP over bin configurations is solved by multiplicative
weights: prices fall with a length's coverage, each round takes the configuration that is worth
most at the present prices, from those known or, where none is near the last one's worth, from a
knapsack dynamic program.  Any prices bound the number of bins from below, so the solver
returns its best such bound too.  Weights on both sides, lengths and configurations, then polish the
solution.  Whole multiples of the configurations are kept, what they leave is packed best-fit decreasing in bulk (all
bins of one filling at a time), and documents take their slots by their rank within their length.
The plan is never worse than best-fit decreasing of everything, whose configurations the LP starts from, and which
is taken where it meets the bound to `SLACK` or rounding would cost more.  All of the driver's work
depends on the number of lengths, not of documents.

Edge cases: null, empty and blank texts have no piece; a null doc_id is packed as any other;
repeated rows are separate documents; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept, numbered

CAPACITY = 2048
GRID = 8
#: How fast prices fall with coverage, and by how much one round may lower them (both in exponents).
STEEP, STEP = 110.0, 0.7
#: A known configuration is taken if it is worth this share less than the best one priced last.
NEAR = 0.01
#: Share of bins above the bound that needs no further search.
SLACK = 0.002
POLISH = 1500


def best_configuration(price: np.ndarray, room: int) -> np.ndarray:
    """How many pieces of 1..len(price) grid units give the most within `room` units: an unbounded knapsack."""
    kinds = np.flatnonzero(price > 0) + 1
    each = price[kinds - 1]
    fits = np.searchsorted(kinds, np.arange(room + 1), "right")
    worth, chosen = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    for c in range(1, room + 1):
        worth[c] = worth[c - 1]
        if m := fits[c]:
            value = worth[c - kinds[:m]] + each[:m]
            best = int(value.argmax())
            if value[best] > worth[c]:
                worth[c], chosen[c] = value[best], kinds[best]
    counts, c = np.zeros(len(price), np.int64), room
    while c > 0:
        if chosen[c]:
            counts[chosen[c] - 1] += 1
            c -= chosen[c]
        else:
            c -= 1
    return counts


def best_fit(demand: np.ndarray, room: int) -> Counter:
    """Best-fit decreasing in bulk: configurations (tuples of (units, count)) and how many bins of each.

    Placing a piece makes its bin the best fit for the next of its length, so bins of one filling take their fill one
    after the other; they are counted, not listed.
    """
    free: dict[int, Counter] = {}
    for u in range(len(demand), 0, -1):
        left = int(demand[u - 1])
        while left:
            space = min((f for f in free if f >= u), default=room)
            own = free.get(space)
            before, most = next(iter(own.items())) if own else ((), left)
            k = min(space // u, left)
            bins = min(most, left // k)
            if own:
                own[before] -= bins
                if not own[before]:
                    del own[before]
                    if not own:
                        del free[space]
            free.setdefault(space - k * u, Counter())[(*before, (u, k))] += bins
            left -= bins * k
    out: Counter = Counter()
    for own in free.values():
        for config, n in own.items():
            out[tuple(sorted(config))] += n
    return out


def solve(demand: np.ndarray, room: int, steep: float = STEEP, step: float = STEP) -> tuple[dict[tuple, float], float]:
    """Fractional numbers of configurations that cover the demand for each length, and a lower bound of their sum."""
    rows = np.flatnonzero(demand)
    start = best_fit(demand, room)
    bound = float((demand * np.arange(1, len(demand) + 1)).sum()) / room
    if not len(rows) or sum(start.values()) <= bound * (1 + SLACK):
        return {c: float(n) for c, n in start.items()}, bound
    need, at = demand[rows].astype(float), {int(u) + 1: i for i, u in enumerate(rows)}
    configs = list(start)
    share = np.zeros((2 * len(configs) + 64, len(rows)))  # of each length's demand that one bin covers
    for i, config in enumerate(configs):
        for u, k in config:
            share[i, at[u]] = k / need[at[u]]
    amount, covered, aim = np.zeros(len(share)), np.zeros(len(rows)), None
    while (low := covered.min()) < 1:
        y = np.exp(-steep * (covered - low))
        worth = share[: len(configs)] @ y
        i = int(worth.argmax())
        if aim is None or worth[i] < aim * y.sum() * (1 - NEAR):
            price = np.zeros(len(demand))
            price[rows] = y / need
            counts = best_configuration(price, room)
            best = float(counts @ price)
            bound, aim = max(bound, float(y.sum()) / best), best / float(y.sum())
            if best > worth[i] * (1 + NEAR / 4):
                i = len(configs)
                configs.append(tuple((int(u) + 1, int(counts[u])) for u in np.flatnonzero(counts)))
                if i == len(share):
                    share, amount = np.r_[share, np.zeros_like(share)], np.r_[amount, np.zeros_like(amount)]
                share[i] = counts[rows] / need
        more = step / steep / share[i].max()
        amount[i] += more
        covered += share[i] * more
    n = len(configs)
    x = polish(share[:n].T, amount[:n] / covered.min())
    return dict(zip(configs, x.tolist())), bound


def polish(share: np.ndarray, x: np.ndarray, rounds: int = POLISH) -> np.ndarray:
    """Fewer bins of the same configurations: those worth more than the mean at the lengths' prices gain weight, with ever steeper prices."""
    best, least = x, x.sum()
    p = (x + 1e-9 * least) / (x + 1e-9 * least).sum()
    for i in range(rounds):
        covered = share @ p
        low = covered.min()
        if 1 / low < least:
            best, least = p / low, 1 / low
        y = np.exp(-50 * 12 ** (i / rounds) * (covered / low - 1))
        worth = y @ share
        p = p * np.exp(0.02 * np.clip(worth / (worth @ p) - 1, -1, 1))
        p /= p.sum()
    return best


def pack_counts(demand: np.ndarray, room: int) -> list[tuple[tuple, int]]:
    """(configuration, how many bins) that hold the whole demand: the LP rounded down and the rest best-fit, or best-fit alone if that takes fewer."""
    left = demand.astype(np.int64).copy()
    plan: Counter = Counter()
    x, _ = solve(demand, room)
    for config, amount in sorted(x.items(), key=lambda c: (-c[1], c[0])):
        n = min([int(amount + 1e-9), *(int(left[u - 1]) // k for u, k in config)])
        if n > 0:
            plan[config] += n
            for u, k in config:
                left[u - 1] -= n * k
    plan += best_fit(left, room)
    alone = best_fit(demand, room)
    return sorted((plan if sum(plan.values()) <= sum(alone.values()) else alone).items())


def allotment(plan: list[tuple[tuple, int]], grid: int) -> tuple[list[tuple], int]:
    """Rows (units, first rank, end rank, bin of the first, per bin, offset) and the number of bins."""
    rows, taken, first = [], Counter(), 0
    for config, n in plan:
        at = 0
        for u, k in config:
            rows.append((u, taken[u], taken[u] + n * k, first, k, at * grid))
            taken[u] += n * k
            at += u * k
        first += n
    return rows, first


def pack(docs: DataFrame, capacity: int = CAPACITY, grid: int = GRID) -> DataFrame:
    """(doc_id, piece, n_words, bin_id, bin_offset): every piece of every document, once."""
    spark = docs.sparkSession
    words = F.regexp_count(F.col("text").cast("string"), F.lit(r"\S+")).cast("long")
    light = kept(docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words")).filter("words > 0"), "lengths")
    light = light.withColumns({"full": F.expr(f"words div {capacity}"), "rest": F.col("words") % capacity})
    light = light.withColumn("units", F.expr(f"cast((rest + {grid - 1}) div {grid} as int)"))
    demand = np.zeros(-(-capacity // grid), np.int64)
    for units, n in light.filter("units > 0").groupBy("units").count().collect():
        demand[units - 1] = n
    rows, bins = allotment(pack_counts(demand, capacity // grid), grid)
    order = [F.col("doc_id").asc_nulls_first()]
    ranked = numbered(light.filter("units > 0"), F.col("units"), F.col("doc_id"), order, F.lit(1).cast("long"), "rank")
    table = spark.createDataFrame(rows, "u int, from_ long, to_ long, bin long, k long, start long")
    if len(rows) < 200_000:
        table = F.broadcast(table)
    slot = F.col("rank") - F.col("from_")
    rests = ranked.join(table, (F.col("units") == F.col("u")) & (F.col("rank") >= F.col("from_")) & (F.col("rank") < F.col("to_"))).select(
        "doc_id",
        F.col("full").cast("int").alias("piece"),
        F.col("rest").alias("n_words"),
        F.expr("bin + (rank - from_) div k").alias("bin_id"),
        (F.col("start") + slot % F.col("k") * F.col("units") * grid).alias("bin_offset"),
    )
    fulls = numbered(light.filter("full > 0"), F.lit(0), F.col("doc_id"), [*order, F.col("full")], F.col("full"), "before")
    fulls = fulls.select("doc_id", "before", F.explode(F.sequence(F.lit(0).cast("int"), (F.col("full") - 1).cast("int"))).alias("piece")).select(
        "doc_id", "piece", F.lit(capacity).cast("long").alias("n_words"), (F.lit(bins) + F.col("before") + F.col("piece")).alias("bin_id"), F.lit(0).cast("long").alias("bin_offset")
    )
    return rests.unionByName(fulls)
