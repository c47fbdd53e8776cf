"""Quality rules: gradient-boosted trees over document statistics.

Statistics come from whole texts, vectorised over batches.  The trees are trained here on at most
`max_train` labelled documents, chosen by a hash of their id (the one bounded sample); they are
flattened into node arrays that numpy walks for a whole batch at once.  The score may only fall
with the statistics of MONOTONE: repetition and symbols never improve a document.

Edge cases: a null, empty or wordless text scores 0 and is rejected; without labels of both kinds
there is nothing to learn from and every document with words is kept at score 1; a null doc_id is
scored as any other row; repeated rows get equal scores; labels that contradict each other all
count; further columns pass through, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .words import ROW_BITS, segment

STOP_WORDS = (
    "the of and to a in is it that this was for with as on are be at by or an from he not but have "
    "der die das und ist nicht ein eine zu den mit von auf für im sich des dem auch als "
    "le la les de des et est un une que qui dans pour pas sur avec au du en il plus par "
    "el los las y en que es un una por para con no se su lo del como al"
)
FEATURES = (
    "log_words", "mean_word", "distinct", "top_word", "run_words", "repeat_pairs", "stop_words", "symbols", "digits",
    "capitals", "letters", "line_words", "end_marks", "long_words", "repeat_lines",
)
#: Sign of the score's change with a statistic.
MONOTONE = {"top_word": -1, "run_words": -1, "repeat_pairs": -1, "symbols": -1}
MAX_TRAIN = 20_000
THRESHOLD = 0.5

_KIND = np.zeros((5, 256), bool)
_KIND[0, [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'\"-;:()"]] = True
_KIND[1, 48:58] = True
_KIND[2, 65:91] = True
_KIND[3, [*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_KIND[4, [ord(c) for c in ".!?"]] = True


def _stop_hashes() -> np.ndarray:
    (w,) = segment(pa.array([STOP_WORDS]))
    return np.unique(w.hash)


def statistics(texts: pa.Array) -> np.ndarray:
    """(n, len(FEATURES)) float64; a row of zeros for a text without words."""
    out = np.zeros((len(texts), len(FEATURES)))
    stops = _stop_hashes()
    for w in segment(texts):
        n = np.diff(w.first)
        has = n > 0
        if not has.any():
            continue
        at = w.first[:-1][has]
        per = n[has].astype(float)
        sums = lambda x: np.add.reduceat(x, at).astype(float)
        size = w.end - w.start
        # Words sorted within their row give distinct words and the most frequent one.
        bits = np.uint64(ROW_BITS)
        key = np.sort((w.row.astype(np.uint64) << (np.uint64(64) - bits)) | (w.hash >> bits))
        new = np.r_[True, key[1:] != key[:-1]]
        begin = np.flatnonzero(new)
        count = np.diff(np.r_[begin, len(key)])
        top = np.maximum.reduceat(count, np.cumsum(new)[at] - 1).astype(float)
        same = np.r_[False, (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])]
        pair = np.r_[w.hash[:-1] * np.uint64(31) ^ (w.hash[1:] >> np.uint64(1)), np.uint64(0)]
        pair[w.first[1:][has] - 1] = np.arange(len(at), dtype=np.uint64)  # the last word of a row has no pair
        pairs = np.sort((w.row.astype(np.uint64) << (np.uint64(64) - bits)) | (pair >> bits))
        again = np.r_[False, pairs[1:] == pairs[:-1]]
        length = np.diff(w.offsets)[has].astype(float)
        zero = np.r_[w.buf, np.uint8(0)]
        edges = w.offsets[:-1][has]

        def share(table: np.ndarray) -> np.ndarray:
            total = np.r_[0, np.cumsum(table[zero])]
            return (total[w.offsets[1:][has]] - total[edges]) / length

        breaks = share(np.eye(256, dtype=bool)[10]) * length
        gap = np.r_[True, (w.row[1:] != w.row[:-1])]
        newline = np.r_[0, np.cumsum(w.buf == 10)]
        lined = newline[w.start]
        starts_line = gap | np.r_[True, lined[1:] != lined[:-1]]
        line_at = np.flatnonzero(starts_line)
        line_key = np.add.reduceat(w.hash, line_at)
        line_row = w.row[line_at].astype(np.uint64)
        lk = np.sort((line_row << (np.uint64(64) - bits)) | (line_key >> bits))
        repeat = np.bincount((lk[1:][lk[1:] == lk[:-1]] >> (np.uint64(64) - bits)).astype(np.int64), minlength=len(n))[has]
        lines = np.bincount(line_row.astype(np.int64), minlength=len(n))[has]
        out[w.lo + np.flatnonzero(has)] = np.stack(
            [
                np.log1p(per), sums(size) / per, sums(new.astype(np.int64)) / per, top / per, sums(same.astype(np.int64)) / per,
                sums(again.astype(np.int64)) / per, sums(np.isin(w.hash, stops).astype(np.int64)) / per, share(_KIND[0]), share(_KIND[1]),
                share(_KIND[2]), share(_KIND[3]), per / (breaks + 1), share(_KIND[4]) * length / per, sums((size > 20).astype(np.int64)) / per,
                repeat / np.maximum(1, lines),
            ],
            1,
        )
    return out


@dataclass
class Trees:
    """All trees' nodes in flat arrays; tree t starts at root[t]; a leaf is its own child."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.root:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: int = 20, ridge: float = 1.0) -> Trees:
    """Histogram gradient boosting on the logistic loss; monotone splits keep their sides' values on either side of their middle."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    code = np.stack([np.searchsorted(q, c, "left") for q, c in zip(cuts, x.T)], 1)
    sign = [MONOTONE.get(f, 0) for f in FEATURES]
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    bias = float(np.log(p / (1 - p)))
    margin = np.full(len(y), bias)
    nodes: list[list[float]] = []
    roots: list[int] = []

    def value(g: float, h: float, lo: float, hi: float) -> float:
        return float(np.clip(-g / (h + ridge), lo, hi))

    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        grad, hess = q - y, q * (1 - q)
        todo = [(np.arange(len(y)), 0, -np.inf, np.inf, len(nodes))]
        roots.append(len(nodes))
        nodes.append([0, 0.0, len(nodes), len(nodes), 0.0])
        while todo:
            own, level, lo, hi, at = todo.pop()
            g, h = grad[own].sum(), hess[own].sum()
            best = None
            if level < depth and len(own) >= 2 * least:
                for f in range(x.shape[1]):
                    if not len(cuts[f]):
                        continue
                    c = code[own, f]
                    m = len(cuts[f]) + 1
                    gl = np.cumsum(np.bincount(c, grad[own], m))[:-1]
                    hl = np.cumsum(np.bincount(c, hess[own], m))[:-1]
                    nl = np.cumsum(np.bincount(c, minlength=m))[:-1]
                    ok = (nl >= least) & (len(own) - nl >= least)
                    vl, vr = np.clip(-gl / (hl + ridge), lo, hi), np.clip(-(g - gl) / (h - hl + ridge), lo, hi)
                    if sign[f]:
                        ok &= (vr - vl) * sign[f] >= 0
                    if not ok.any():
                        continue
                    gain = -(gl * vl + (hl + ridge) * vl**2 / 2) - ((g - gl) * vr + (h - hl + ridge) * vr**2 / 2)
                    gain = np.where(ok, gain, -np.inf)
                    k = int(gain.argmax())
                    if best is None or gain[k] > best[0]:
                        best = (gain[k], f, k, float(vl[k]), float(vr[k]))
            here = value(g, h, lo, hi)
            if best is None or best[0] <= -(g * here + (h + ridge) * here**2 / 2) + 1e-9:
                nodes[at][4] = here * rate
                margin[own] += here * rate
                continue
            _, f, k, vl, vr = best
            mid = (vl + vr) / 2
            left = code[own, f] <= k
            nodes[at][:4] = [f, float(cuts[f][k]), len(nodes), len(nodes) + 1]
            for side, rows in ((-1, own[left]), (1, own[~left])):
                bounds = (lo, hi) if not sign[f] else (max(lo, mid), hi) if side * sign[f] > 0 else (lo, min(hi, mid))
                todo.append((rows, level + 1, *bounds, len(nodes)))
                nodes.append([0, 0.0, len(nodes), len(nodes), 0.0])
    flat = np.array(nodes)
    return Trees(flat[:, 0].astype(np.int64), flat[:, 1], flat[:, 2].astype(np.int64), flat[:, 3].astype(np.int64), flat[:, 4], np.array(roots), depth, bias)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Trees | None:
    """Trees for labels.quality, from at most max_train labelled rows; None without both kinds."""
    small_batches(docs.sparkSession)
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("__sw_id"), F.col("quality").cast("int").alias("__sw_y"))
        .filter("__sw_id is not null and __sw_y in (0, 1)")
        .orderBy(F.xxhash64("__sw_id"), "__sw_id", "__sw_y")
        .limit(max_train)
    )
    # At most max_train pairs of numbers, so this side is small at any size of input.
    pairs = docs.select(F.col("doc_id").cast("long").alias("__sw_doc"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("__sw_doc") == F.col("__sw_id"))

    def measure(batches):
        for b in batches:
            x = statistics(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    rows = pairs.select("text", "__sw_y").mapInArrow(measure, "x array<double>, y int").toPandas()
    y = rows["y"].to_numpy(float)
    if len(y) == 0 or y.min() == y.max():
        return None
    return train(np.stack(rows["x"].to_list()), y)


def score(docs: DataFrame, model: Trees | None, name: str = "score") -> DataFrame:
    """docs with their score in `name`."""

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        x = statistics(pa.array(text, pa.string(), from_pandas=True))
        s = np.ones(len(x)) if model is None else model.score(x)
        return pd.Series(np.where(x[:, 0] > 0, s, 0.0))

    return docs.withColumn(name, scored(F.col("text").cast("string")))


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, score, keep) of every row."""
    s = score(docs.select("doc_id", "text"), fit(docs, labels, max_train), "score")
    return s.select("doc_id", "score", (F.col("score") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    """docs without the rows that the trees reject."""
    s = score(docs, fit(docs, labels, max_train), "__sw_score")
    return s.filter(F.col("__sw_score") >= threshold).drop("__sw_score")
