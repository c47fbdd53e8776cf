"""Line dedup by pairwise alignment.

A line is compared by its trimmed text (its 64-bit hash).  A pair of documents is aligned by patience
diff: lines that are unique in both documents are matched along the longest increasing sequence,
between them again, and matches grow to their equal neighbours.  Blocks of matched lines with at
least min_chars characters are deleted from the later document: exactly what the alignments with all
earlier documents delete.  A line's first holder never loses it through a pair that the line made.

Documents that overlap are found through the hashes of shared lines, and of the shortest runs of lines that together have
min_chars characters, so passages in short lines count too.  As lines of one document only match nothing, a document is first reduced
to its skeleton: its repeated lines, and a gap where others stand.  Documents of one skeleton align
alike, so skeletons are aligned, each as the earliest of its documents, and what comes out is the
least doc_id from which on a line goes.  Rare evidence counts first: the first rounds take the first holder of each run
and some eight more, which are all holders of a rare one.  A run that these leave undeleted is aligned with further holders,
four times as many in each round, until it is deleted or none is left; so frequent lines make no pairs that aren't needed, and nothing is capped.

Edge cases: null doc_ids and null or empty texts are returned as they are; an empty table gives no rows; rows that repeat a
doc_id are aligned each with the earlier documents, never with one another, and lose just their own text's lines;
rows that repeat doc_id and text lose the same lines; a text that loses all its lines becomes empty (the pipeline
drops it); lines and texts of any length are taken whole; further columns pass through, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept, small_batches

MIN_CHARS = 20
#: How many holders of a run, beside the first, a round takes, and by what factor they grow from round to round.
HOLDERS, GROWTH = 8, 4
NEVER = (1 << 63) - 1
#: Of the rolling hash of runs of lines.
PRIME, BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E681 % ((1 << 61) - 1)


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places (i, j) with a[i] == b[j], increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        na, nb = Counter(a[i0:i1]), Counter(b[j0:j1])
        where = {b[j]: j for j in range(j0, j1)}
        pairs = [(i, where[a[i]]) for i in range(i0, i1) if na[a[i]] == 1 and nb.get(a[i]) == 1]
        if not pairs:
            continue
        ends: list[int] = []
        tops: list[int] = []
        back = [-1] * len(pairs)
        for n, (_, j) in enumerate(pairs):
            p = bisect_left(ends, j)
            if p == len(ends):
                ends.append(j)
                tops.append(n)
            else:
                ends[p], tops[p] = j, n
            back[n] = tops[p - 1] if p else -1
        chain, n = [], tops[-1]
        while n >= 0:
            chain.append(pairs[n])
            n = back[n]
        chain.reverse()
        li, lj = i0, j0
        for i, j in chain:
            out.append((i, j))
            todo.append((li, i, lj, j))
            li, lj = i + 1, j + 1
        todo.append((li, i1, lj, j1))
    out.sort()
    return out


def common_blocks(a: list, b: list, size: list, min_chars: int) -> list[int]:
    """Places in b of the aligned blocks (runs of matches that follow one another in both) of at least min_chars characters."""
    gone: list[int] = []
    block: list[int] = []
    last = None
    for i, j in [*patience(a, b), (-9, -9)]:
        if last != (i - 1, j - 1):
            if block and sum(size[x] for x in block) >= min_chars:
                gone += block
            block = []
        block.append(j)
        last = (i, j)
    return gone


def evidence(seq: list, size: list, min_chars: int) -> list[tuple[int, int, int]]:
    """(key, i, j): runs of lines of a skeleton, numbered without its gaps, that together have at least min_chars characters.

    From each line the shortest run that begins there, and to each line the shortest that ends there, as far as no gap
    is between: any block of min_chars characters that two documents share is covered by such runs within it.
    """
    own: list[int] = []
    start: list[int] = []
    after_gap = 0
    for x in seq:
        if x is None:
            after_gap = len(own)
        else:
            start.append(after_gap)
            own.append(x)
    sums, rolled, power = [0], [0], [1]
    for h, n in zip(own, size):
        sums.append(sums[-1] + n)
        rolled.append((rolled[-1] * BASE + h) % PRIME)
        power.append(power[-1] * BASE % PRIME)
    runs = set()
    for i in range(len(own)):
        j = max(bisect_left(sums, sums[i] + min_chars), i + 1)
        if j <= len(own) and start[j - 1] <= i:
            runs.add((i, j))
        j = max(min(bisect_right(sums, sums[i + 1] - min_chars) - 1, i), -1)
        if j >= start[i]:
            runs.add((j, i + 1))
    return [((rolled[j] - rolled[i] * power[j - i]) % PRIME, i, j) for i, j in sorted(runs)]


def _without(text: pd.Series, gone: pd.Series) -> pd.Series:
    def cut(t, g):
        if t is None or g is None:
            return t
        g = set(g.tolist())
        return "\n".join(line for i, line in enumerate(t.split("\n")) if i not in g)

    return pd.Series([cut(t, g) for t, g in zip(text, gone)], dtype=object)


def _keys(min_chars: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each skeleton its evidence keys, each with the last of the ids from which on its lines are deleted so far."""
        for b in batches:
            out: list[tuple] = []
            for s, m, top, seq, size, gone in zip(*(b.column(i).to_pylist() for i in range(6))):
                gone = dict(gone or ())
                least = [gone.get(j, NEVER) for j in range(len(size))]
                worst: dict[int, int] = {}
                for key, i, j in evidence(seq, size, min_chars):
                    worst[key] = max(worst.get(key, -NEVER), *least[i:j])
                out += [(s, m, top, k, w) for k, w in worst.items()]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["__sw_s", "__sw_m", "__sw_top", "__sw_key", "__sw_worst"])

    return keys


def _align_skeletons(min_chars: int):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for s, t, old, new, size in zip(*(b.column(i).to_pylist() for i in range(5))):
                # A gap stands for lines that no other document holds: it matches nothing.
                n = -1
                index, chars = [], []
                for x in new:
                    n += x is not None
                    index.append(n)
                    chars.append(0 if x is None else size[n])
                found = common_blocks(old, ["" if x is None else x for x in new], chars, min_chars)
                out += [(s, index[j], t) for j in found]
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())], ["__sw_s", "__sw_j", "__sw_t"])

    return align


def deletions(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(__sw_id, __sw_c, __sw_gone): doc_id, hash of the text and the numbers of the lines that the alignments with all earlier documents delete."""
    lines = F.transform(F.split(F.col("text").cast("string"), "\n"), lambda x: F.trim(x))
    own = docs.select(F.col("doc_id").cast("long").alias("__sw_id"), F.col("text").cast("string").alias("__sw_x"), lines.alias("__sw_l")).filter("__sw_id is not null and __sw_l is not null")
    own = own.select("__sw_id", F.xxhash64("__sw_x").alias("__sw_c"), F.size("__sw_l").alias("__sw_of"), F.posexplode(F.transform("__sw_l", lambda x: F.struct(F.xxhash64(x).alias("h"), F.length(x).alias("n")))).alias("p", "x"))
    own = own.select("__sw_id", "__sw_c", "__sw_of", "p", "x.h", "x.n")
    repeated = own.groupBy("h").agg(F.min("__sw_id").alias("a"), F.max("__sw_id").alias("b")).filter("a < b").select("h")
    rows = own.join(repeated, "h").groupBy("__sw_id", "__sw_c", "__sw_of").agg(F.sort_array(F.collect_set(F.struct("p", "h", "n"))).alias("x"))
    before = lambda x, i: F.when(i == 0, F.lit(-1)).otherwise(F.get(F.col("x.p"), i - 1))
    gap = F.array(F.lit(None).cast("long"))
    seq = F.flatten(F.transform("x", lambda x, i: F.when(x.p == before(x, i) + 1, F.array(x.h)).otherwise(F.concat(gap, F.array(x.h)))))
    seq = F.when(F.element_at("x", -1).p == F.col("__sw_of") - 1, seq).otherwise(F.concat(seq, gap))
    rows = rows.select("__sw_id", "__sw_c", F.col("x.p").alias("__sw_p"), seq.alias("__sw_seq"), F.col("x.n").alias("__sw_n"))
    # xxhash64 passes over nulls, so gaps go in as text.
    rows = kept(rows.withColumn("__sw_s", F.xxhash64(F.transform("__sw_seq", lambda x: F.coalesce(x.cast("string"), F.lit("-"))))), "line-rows")
    skeletons = kept(rows.groupBy("__sw_s").agg(F.min("__sw_id").alias("__sw_m"), F.max("__sw_id").alias("__sw_top"), F.first("__sw_seq").alias("__sw_seq"), F.first("__sw_n").alias("__sw_n")), "line-skeletons")

    none = F.lit(None).cast("map<int,bigint>").alias("__sw_gone")
    key_schema = "__sw_s long, __sw_m long, __sw_top long, __sw_key long, __sw_worst long"
    cols = ["__sw_s", "__sw_m", "__sw_top", "__sw_seq", "__sw_n"]
    holders = skeletons.select(*cols, none).mapInArrow(_keys(min_chars), key_schema)
    per_key = holders.groupBy("__sw_key").agg(F.min(F.struct("__sw_m", "__sw_s")).alias("__sw_first"), F.max("__sw_top").alias("__sw_last"), F.count(F.lit(1)).alias("__sw_of"))
    holders = holders.join(per_key.filter("__sw_first.__sw_m < __sw_last"), "__sw_key")
    # Round 0 takes the first holder, the others take theirs from a hash, so that no task has to order all holders of a line.
    part = F.pmod(F.xxhash64("__sw_key", "__sw_s"), F.lit(1 << 30)) / float(1 << 30) * F.col("__sw_of") / HOLDERS
    later = F.lit(1) + F.greatest(F.lit(0.0), F.ceil(F.log(float(GROWTH), F.greatest(part, F.lit(1.0))))).cast("int")
    first = (F.col("__sw_first.__sw_m") == F.col("__sw_m")) & (F.col("__sw_first.__sw_s") == F.col("__sw_s"))
    holders = kept(holders.withColumn("__sw_round", F.when(first, 0).otherwise(later)).drop("__sw_first", "__sw_last", "__sw_of"), "line-holders")
    held = holders.select("__sw_key", "__sw_round", F.col("__sw_s").alias("__sw_old"), F.col("__sw_m").alias("__sw_t"))
    least = kept(held.groupBy("__sw_key", "__sw_round").agg(F.min("__sw_t").alias("__sw_t")), "line-least")
    useful = F.col("__sw_t") < F.least("__sw_worst", "__sw_top")
    still = holders.select("__sw_s", "__sw_top", "__sw_key", "__sw_worst")
    done, round_ = None, 0
    while True:
        pairs = still.join(held.filter(F.col("__sw_round") == round_), "__sw_key").filter(useful).select("__sw_s", "__sw_old", "__sw_t").distinct()
        old = skeletons.select(F.col("__sw_s").alias("__sw_old"), F.col("__sw_seq").alias("__sw_oldseq"))
        joined = pairs.join(old, "__sw_old").join(skeletons.select("__sw_s", "__sw_seq", "__sw_n"), "__sw_s").select("__sw_s", "__sw_t", "__sw_oldseq", "__sw_seq", "__sw_n")
        found = joined.mapInArrow(_align_skeletons(min_chars), "__sw_s long, __sw_j int, __sw_t long")
        found = found if done is None else found.unionByName(done)
        done = kept(found.groupBy("__sw_s", "__sw_j").agg(F.min("__sw_t").alias("__sw_t")), "line-done")
        round_ += 1
        by_skeleton = done.groupBy("__sw_s").agg(F.map_from_entries(F.collect_list(F.struct("__sw_j", "__sw_t"))).alias("__sw_gone"))
        live = skeletons.join(still.select("__sw_s").distinct(), "__sw_s", "left_semi").join(by_skeleton, "__sw_s", "left").select(*cols, "__sw_gone")
        left = least.filter(F.col("__sw_round") >= round_).groupBy("__sw_key").agg(F.min("__sw_t").alias("__sw_t"))
        still = live.mapInArrow(_keys(min_chars), key_schema).join(left, "__sw_key").filter(useful)
        still = kept(still.select("__sw_s", "__sw_top", "__sw_key", "__sw_worst"), "line-open")
        if still.isEmpty():
            break
    gone = F.filter("__sw_p", lambda p, i: F.coalesce(F.element_at("__sw_gone", i), F.lit(NEVER)) < F.col("__sw_id"))
    cut = rows.select("__sw_id", "__sw_c", "__sw_s", "__sw_p").join(by_skeleton, "__sw_s").select("__sw_id", "__sw_c", gone.alias("__sw_gone")).filter(F.size("__sw_gone") > 0)
    return cut.groupBy("__sw_id", "__sw_c").agg(F.array_distinct(F.flatten(F.collect_list("__sw_gone"))).alias("__sw_gone"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the lines deleted from `text`, and how many in `__sw_deleted`."""
    small_batches(docs.sparkSession)
    same = (F.col("doc_id").cast("long") == F.col("__sw_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__sw_c"))
    joined = docs.join(deletions(docs, min_chars), same, "left")
    hit = F.col("__sw_gone").isNotNull()
    once = F.pandas_udf(_without, "string").asNondeterministic()  # else a filter on text runs it a second time
    text = F.when(hit, once(F.when(hit, F.col("text")), F.col("__sw_gone"))).otherwise(F.col("text"))
    return joined.withColumns({"text": text, "__sw_deleted": F.coalesce(F.size("__sw_gone"), F.lit(0))}).drop("__sw_id", "__sw_c", "__sw_gone")
