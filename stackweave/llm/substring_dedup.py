"""Incremental substring dedup over a log-structured index of window hashes.

A document's windows of `WINDOW` words are chosen by content, so that any `WINDOW + SKIP - 1` words
in a row hold a chosen one.  The index is a list of immutable runs, Parquet tables bucketed and
sorted by hash, each with the first place of every window it has seen.  A new batch is hashed,
merge-joined with every run on the buckets (the history isn't shuffled again), and each hit is
verified by a second, independent 64-bit hash of its words.  The batch's new windows become a run of
their own; runs of like size are compacted into one (each hash keeps its first place).

Result: (doc_id, start_word, end_word, first_doc_id): merged ranges of a document's words covered
by windows that occurred before in an earlier batch, or earlier in the batch by (doc_id, position).

Edge cases: null, empty and shorter texts have no windows; null doc_ids are left out; rows that
repeat a doc_id and its text count once; a text of any length is taken whole; further columns are
ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import kept, shared_dir, small_batches
from .suffix_dedup import merge_spans
from .words import segment

WINDOW = 32
SKIP = 19
BATCHES = 4
FAN = 2
_SECOND = 0xA24BAED4963EE407 | 1


def _windows(window: int, skip: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for w in segment(b.column(1)):
                at, g = w.anchors(window, skip)
                row = w.row[at]
                check = w.grams(window, _SECOND)[at] if len(at) else g
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g.view(np.int64), check.view(np.int64), ids[w.lo + row], (at - w.first[row]).astype(np.int32))], ["hash", "check", "doc_id", "at"])

    return find


class FingerprintIndex:
    """The runs of a log-structured fingerprint index in the shared folder."""

    def __init__(self, spark: SparkSession, window: int = WINDOW, skip: int = SKIP, fan: int = FAN, buckets: int | None = None):
        small_batches(spark)
        self.spark, self.window, self.skip, self.fan = spark, window, skip, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = f"{shared_dir(spark)}/stackweave/index-{uuid.uuid4().hex}"
        self.runs: list[tuple[str, int]] = []  # table and level; a run of level n holds fan**n batches
        self.made = 0

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"stackweave_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "hash", "check").sortBy("hash", "check").option("path", f"{self.folder}/{self.made}").saveAsTable(name)
        self.made += 1
        self.runs.append((name, level))

    def add(self, docs: DataFrame) -> DataFrame:
        """Enters a batch; its spans that occurred before."""
        base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
        found = base.mapInArrow(_windows(self.window, self.skip), "hash long, check long, doc_id long, at int").repartition(self.buckets, "hash", "check")
        # The first place of a window in the batch; rows of the same place are one.
        place = F.struct("doc_id", "at")
        marked = found.withColumn("first", F.min(place).over(Window.partitionBy("hash", "check")))
        earlier = F.lit(None).cast("long")
        for i, (name, _) in enumerate(self.runs):
            run = self.spark.table(name).select("hash", "check", F.col("doc_id").alias(f"_seen{i}"))
            marked = marked.join(run.hint("merge"), ["hash", "check"], "left")
            earlier = F.coalesce(earlier, F.col(f"_seen{i}"))
        marked = kept(marked.select("hash", "check", "doc_id", "at", (place == F.col("first")).alias("is_first"), F.col("first.doc_id").alias("in_batch"), earlier.alias("before")), "marked")
        fresh = marked.filter("is_first and before is null").select("hash", "check", "doc_id", "at").distinct()
        self._write(fresh.repartition(self.buckets, "hash", "check"), 0)
        self._compact()
        again = marked.filter("before is not null or not is_first")
        return again.select("doc_id", F.col("at").alias("start_word"), (F.col("at") + self.window).alias("end_word"), F.coalesce("before", "in_batch").alias("first_doc_id"))

    def _compact(self) -> None:
        """Merges the newest runs while `fan` of them are of one level; no hash is in two runs, so rows are only brought together."""
        while len(self.runs) >= self.fan and len({level for _, level in self.runs[-self.fan :]}) == 1:
            old, level = self.runs[-self.fan :], self.runs[-1][1]
            rows = self.spark.table(old[0][0])
            for name, _ in old[1:]:
                rows = rows.unionByName(self.spark.table(name))
            self.runs = self.runs[: -self.fan]
            self._write(rows.repartition(self.buckets, "hash", "check"), level + 1)
            for name, _ in old:
                self._drop(name)

    def _drop(self, name: str) -> None:
        """Forgets a table and deletes its files."""
        where = self.spark.sql(f"describe formatted {name}").filter("col_name = 'Location'").first()[1]
        self.spark.sql(f"drop table {name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        for name, _ in self.runs:
            self._drop(name)
        self.runs = []


def incremental_repeats(docs: DataFrame, batches: int = BATCHES, window: int = WINDOW, skip: int = SKIP) -> DataFrame:
    """Feeds docs to an empty index as `batches` equal ranges of doc_id."""
    index = FingerprintIndex(docs.sparkSession, window, skip)
    low, high = docs.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).first()
    if low is None:
        return merge_spans(index.add(docs))
    out, step = None, (high - low) // batches + 1
    for i in range(batches):
        spans = index.add(docs.filter(F.col("doc_id").cast("long").between(low + i * step, low + (i + 1) * step - 1)))
        out = spans if out is None else out.unionByName(spans)
    index.close()
    return merge_spans(out)
