"""Repeated passages by a distributed merge sort of suffixes that knows common prefixes.

Two documents that share `min_words` words in a row share an anchor there: a word chosen by the
hashes of the grams of `GRAM` words around it.  Only anchors whose gram occurs twice can lie in a
repeated passage; their suffixes are sorted.  Each task sorts its suffixes into a run for every
shard and front-codes it (length of the prefix shared with the suffix before, and the rest); a
shard's runs are merged by a loser tree that keeps, for each loser, its common prefix with the last
winner, and compares two suffixes only behind it.  The merge yields the common-prefix lengths, from
which every window of min_words words that occurs twice is read off: windows that start l words
left of their anchor agree if the suffixes agree in min_words - l words and the l words to the left
are equal.  The first symbol of a suffix is its gram's hash, so shards are even and no suffix is
compared across shards.

Result: (doc_id, start_word, end_word, first_doc_id): the merged word ranges of a document that
are covered by windows which occurred before, by (doc_id, position); the first occurrence stays.
Exact but for collisions of hashes (64 bits for grams, 32 for each further word).

Edge cases: null, empty and shorter texts have no windows; rows with a null doc_id are left out;
rows that repeat a doc_id and its text count once; a text's repeats within itself count; texts of
any length are taken whole; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches
from .words import mix, segment

MIN_WORDS = 50
GRAM = 25
RUN = "shard int, n int, lcp binary, gram binary, word binary, left binary, n_left binary, doc_id binary, at binary"
SPAN = "doc_id long, start_word int, end_word int, first_doc_id long"


def _anchors(gram: int, window: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for w in segment(b.column(1)):
                at, g = w.anchors(gram, window)
                row = w.row[at]
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(ids[w.lo + row]), pa.array((at - w.first[row]).astype(np.int32))], ["g", "doc_id", "at"])

    return find


def sort_run(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of symbols, compared left to right, and each row's common prefix with the row before it."""
    flat = np.ascontiguousarray(symbols.astype(">u4"))
    order = np.argsort(flat.view(f"S{flat.shape[1] * 4}").ravel(), kind="stable")
    s = symbols[order]
    lcp = np.zeros(len(s), np.int64)
    if len(s) > 1:
        lcp[1:] = np.where((d := s[1:] != s[:-1]).any(1), d.argmax(1), s.shape[1])
    return order, lcp


def _runs(gram: int, min_words: int, shards: int):
    """Rows (doc_id, text, at list) to front-coded runs, one for each shard of a chunk of texts."""
    right, left = min_words - gram, min_words - gram

    def encode(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        g, sym, lef, nl, doc, at = (np.concatenate(x) for x in zip(*parts))
        shard = ((g >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        rows: list[list] = [[] for _ in range(9)]
        by = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[by], np.arange(shards + 1))
        for s in range(shards):
            own = by[bounds[s] : bounds[s + 1]]
            if not len(own):
                continue
            order, lcp = sort_run(np.concatenate([(g[own, None] >> np.array([32, 0], np.uint64)).astype(np.uint32), sym[own]], 1))
            own = own[order]
            lcp = np.maximum(lcp - 1, 0)  # the gram's two halves are one symbol
            rest = np.arange(1, right + 1)[None, :] >= lcp[:, None]
            for r, v in zip(rows, (s, len(own), lcp.astype(np.uint8).tobytes(), g[own][lcp == 0].tobytes(), sym[own][rest].tobytes(), lef[own].tobytes(), nl[own].tobytes(), doc[own].tobytes(), at[own].tobytes())):
                r.append(v)
        kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds)], ["shard", "n", "lcp", "gram", "word", "left", "n_left", "doc_id", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for b in batches:
            ids = b.column(0).to_numpy()
            lists = b.column(2)
            flat, offs = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            offs = offs - offs[0]
            for w in segment(b.column(1)):
                pos = flat[offs[w.lo] : offs[w.hi]].astype(np.int64)
                row = np.repeat(np.arange(w.hi - w.lo), np.diff(offs[w.lo : w.hi + 1]))
                begin, end = w.first[row], w.first[row + 1]
                here = begin + pos
                fits = here + gram <= end
                here, row, begin, end, pos = (x[fits] for x in (here, row, begin, end, pos))
                if not len(here):
                    continue
                word = np.r_[(w.hash >> np.uint64(32)).astype(np.uint32) | np.uint32(1), np.zeros(1, np.uint32)]
                none = len(word) - 1
                idx = here[:, None] + gram + np.arange(right)[None, :]
                sym = word[np.where(idx < end[:, None], idx, none)]
                idx = here[:, None] - 1 - np.arange(left)[None, :]
                lef = word[np.where(idx >= begin[:, None], idx, none)]
                # Anchors have the least hashes of their windows; mixed anew, they spread evenly over the shards.
                g = mix(w.grams(gram)[here] ^ np.uint64(0x9E3779B97F4A7C15))
                parts.append((g, sym, lef, np.minimum(pos, left).astype(np.uint8), ids[w.lo + row].astype(np.int64), pos.astype(np.int32)))
                size += len(here)
                if size >= 150_000:
                    yield from encode(parts)
                    parts, size = [], 0
        if parts:
            yield from encode(parts)

    return run


def merge_runs(runs: list[tuple[list[tuple], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Merges sorted runs (suffixes as tuples of symbols, common prefix of each with the one before in its run).

    A loser tree: each inner node holds a loser and its common prefix with the last winner.  Of two candidates, the
    one with the longer such prefix is less; only at equal lengths are symbols compared, from there on.
    Gives, in the merged order, run and place of each suffix and its common prefix with the one before.
    """
    k = 1
    while k < max(1, len(runs)):
        k *= 2
    n = len(runs)
    keys: list[tuple | None] = [r[0][0] if len(r[0]) else None for r in runs] + [None] * (k - n)
    place, common = [0] * k, [0] * k
    loser, out_run, out_at, out_lcp = [0] * k, [], [], []

    def less(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's common prefix becomes the one with the winner."""
        x, y = keys[a], keys[b]
        if x is None:
            return (b, a)
        if y is None:
            return (a, b)
        ca, cb = common[a], common[b]
        if ca != cb:
            return (a, b) if ca > cb else (b, a)
        m = len(x)
        while ca < m and x[ca] == y[ca]:
            ca += 1
        if ca == m or x[ca] < y[ca]:
            common[b] = ca
            return (a, b)
        common[a] = ca
        return (b, a)

    def build(node: int) -> int:
        if node >= k:
            return node - k
        w, loser[node] = less(build(2 * node), build(2 * node + 1))
        return w

    win = build(1)
    while keys[win] is not None:
        out_run.append(win)
        out_at.append(place[win])
        out_lcp.append(common[win])
        place[win] += 1
        seq, lcps = runs[win]
        if place[win] < len(seq):
            keys[win], common[win] = seq[place[win]], lcps[place[win]]
        else:
            keys[win] = None
        node = (win + k) >> 1
        while node:
            win, loser[node] = less(win, loser[node])
            node >>= 1
    return out_run, out_at, out_lcp


class _Rows:
    """A run's rows as tuples, made a block at a time while the merge walks through them."""

    def __init__(self, gram: np.ndarray, words: np.ndarray):
        self.gram, self.words, self.lo, self.block = gram, words, 0, []

    def __len__(self) -> int:
        return len(self.gram)

    def __getitem__(self, i: int) -> tuple:
        if not self.lo <= i < self.lo + len(self.block):
            self.lo = i
            self.block = [(g, *w) for g, w in zip(self.gram[i : i + 128].tolist(), self.words[i : i + 128].tolist())]
        return self.block[i - self.lo]


def _merge(gram: int, min_words: int):
    width = min_words - gram

    def merge(table: pa.Table) -> pa.Table:
        cols = {name: table.column(name).to_pylist() for name in table.column_names}
        runs, gs, lefs, nls, docs, ats = [], [], [], [], [], []
        for i, n in enumerate(cols["n"]):
            lcp = np.frombuffer(cols["lcp"][i], np.uint8).astype(np.int64)
            rest = np.arange(1, width + 1)[None, :] >= lcp[:, None]
            sym, g = np.zeros((n, width), np.uint32), np.zeros(n, np.uint64)
            # What front coding left out is the last value written above it in the same column.
            sym[rest] = np.frombuffer(cols["word"][i], np.uint32)
            last = np.maximum.accumulate(np.where(rest, np.arange(n)[:, None], 0), axis=0)
            sym = np.take_along_axis(sym, last, 0)
            g[lcp == 0] = np.frombuffer(cols["gram"][i], np.uint64)
            g = g[np.maximum.accumulate(np.where(lcp == 0, np.arange(n), 0))]
            runs.append((_Rows(g, sym), lcp.tolist()))
            lefs.append(np.frombuffer(cols["left"][i], np.uint32).reshape(n, width))
            nls.append(np.frombuffer(cols["n_left"][i], np.uint8))
            docs.append(np.frombuffer(cols["doc_id"][i], np.int64))
            ats.append(np.frombuffer(cols["at"][i], np.int32))
            gs.append(sym)
        run, at, lcp = (np.array(x, np.int64) for x in merge_runs(runs))
        base = np.cumsum([0, *cols["n"]])[run] + at
        n_right = (np.concatenate(gs)[base] != 0).sum(1)
        return spans(np.where(lcp > 0, gram + lcp - 1, 0), gram + n_right, np.concatenate(lefs)[base], np.concatenate(nls)[base].astype(np.int64), np.concatenate(docs)[base], np.concatenate(ats)[base].astype(np.int64), min_words)

    return merge


def spans(lcp: np.ndarray, right: np.ndarray, left: np.ndarray, n_left: np.ndarray, doc: np.ndarray, at: np.ndarray, min_words: int) -> pa.Table:
    """Word ranges covered by windows that occurred before.  The rows are sorted suffixes; lcp: words shared with the row before;
    right, n_left: words that follow from the anchor on (up to min_words) and that precede it; left: those, nearest first."""
    n, width = left.shape
    rank = np.lexsort((at, doc))
    new_doc, new_at = doc[rank], at[rank]
    hit = np.zeros((n, width + 1), bool)
    flagged = np.full((n, width + 1), np.iinfo(np.int64).max)
    hashed = np.zeros(n, np.uint64)
    for l in range(width + 1):
        if l:
            hashed = (hashed ^ left[:, l - 1].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            hashed ^= hashed >> np.uint64(32)
        group = np.cumsum(lcp < min_words - l).astype(np.uint64)
        fits = ((n_left >= l) & (right >= min_words - l))[rank]
        key = (hashed ^ (group * np.uint64(0xBF58476D1CE4E5B9)))[rank][fits]
        if len(key) < 2:
            continue
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        own = np.flatnonzero(fits)
        head = own[first[inverse]]
        later = (new_doc[own] != new_doc[head]) | (new_at[own] != new_at[head])
        flagged[own[later], l] = new_doc[head[later]]
        hit[own[later], l] = True
    marked = np.zeros((n, width + 3), bool)
    marked[:, 1:-1] = hit
    r0, begin = np.nonzero(marked[:, 1:] & ~marked[:, :-1])
    _, end = np.nonzero(~marked[:, 1:] & marked[:, :-1])
    # A run begin..end-1 of l covers the words from at - (end - 1) to at - begin + min_words.
    first = np.array([flagged[i, b:e].min() for i, b, e in zip(r0, begin, end)], np.int64)
    return pa.table({"doc_id": pa.array(new_doc[r0]), "start_word": pa.array((new_at[r0] - end + 1).astype(np.int32)), "end_word": pa.array((new_at[r0] - begin + min_words).astype(np.int32)), "first_doc_id": pa.array(first, pa.int64())})


def merge_spans(found: DataFrame) -> DataFrame:
    """Unions of overlapping or touching word ranges of a document, with the least first_doc_id."""
    order = Window.partitionBy("doc_id").orderBy("start_word", "end_word")
    reach = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start_word") > F.coalesce(F.col("_reach"), F.lit(-1)), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        found.withColumn("_reach", reach)
        .withColumn("_island", island)
        .groupBy("doc_id", "_island")
        .agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min("first_doc_id").alias("first_doc_id"))
        .drop("_island")
    )


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    small_batches(docs.sparkSession)
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    anchors = base.mapInArrow(_anchors(gram, min_words - gram + 1), "g long, doc_id long, at int")
    twice = anchors.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("g"))).filter("n > 1")
    wanted = twice.groupBy("doc_id").agg(F.collect_set("at").alias("at"))
    runs = base.join(wanted, "doc_id").select("doc_id", "text", "at").mapInArrow(_runs(gram, min_words, shards), RUN)
    found = runs.groupBy("shard").applyInArrow(_merge(gram, min_words), SPAN)
    return merge_spans(found)
