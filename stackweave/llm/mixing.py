"""Mixing sources to target weights by systematic sampling.

A source with weight w gets the share w / sum of weights of `epochs` times all characters; each of
its documents is then expected as often as this share is of the source's own characters.  Within a
source the expected copies are added up along doc_id from one random offset, and a document is
emitted once for every whole number that its part of the sum crosses: its copies differ from the
expectation by less than one, and so does the source's total.  All of it is exact arithmetic in
whole parts of 1 / UNIT of a copy, with sums of 38 digits; prefix sums go through sums of chunks of ids, so no task holds a source.

Edge cases: a null source is a source of its own; a source without characters gets no copies; a
source that `weights` doesn't name has weight 1, one with weight 0 is left out, and if all have, nothing is
drawn; an empty table gives no rows; null doc_ids come
first; repeated rows are separate documents; a null text has no characters but its row is drawn as
any other of its source; further columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import kept, numbered

UNIT = 10**12
#: Shares of the hot source and of the rest.
WEIGHTS = {"src0": 4}
SEED = "mix-1"
BROADCAST_SOURCES = 10_000


def offset(source: Column, seed: str = SEED) -> Column:
    """The source's random offset, in parts of 1 / UNIT."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("")))), 1, 15), 16, 10).cast("long") % UNIT


def rates(docs: DataFrame, weights: dict[str, int] = WEIGHTS, epochs: int = 1) -> DataFrame:
    """(_source, _rate): expected copies of each document of the source, in parts of 1 / UNIT."""
    source = F.col("source").cast("string")
    weight = F.lit(1)
    for name, w in weights.items():
        weight = F.when(F.col("__sw_source") == name, F.lit(w)).otherwise(weight)
    chars = docs.groupBy(source.alias("__sw_source")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("__sw_chars"))
    own = chars.filter("__sw_chars > 0").withColumn("__sw_w", weight.cast("long")).filter("__sw_w > 0")
    total = chars.agg(F.sum("__sw_chars").alias("__sw_all")).crossJoin(own.agg(F.sum("__sw_w").alias("__sw_ws")))
    big = "decimal(38,0)"
    share = own.crossJoin(total).selectExpr("__sw_source", f"cast({UNIT * epochs} as {big}) * cast(__sw_w as {big}) * cast(__sw_all as {big}) as a", f"cast(__sw_ws as {big}) * cast(__sw_chars as {big}) as b")
    # div would give a bigint, which a tiny source's rate can exceed.
    return share.selectExpr("__sw_source", "cast((a - a % b) / b as decimal(28,0)) as __sw_rate")


def mix(docs: DataFrame, weights: dict[str, int] = WEIGHTS, epochs: int = 1, seed: str = SEED) -> DataFrame:
    """docs' rows, each as often as it is drawn, with its copy's number in `__sw_copy`."""
    r = kept(rates(docs, weights, epochs), "rates")
    if r.count() <= BROADCAST_SOURCES:
        r = F.broadcast(r)  # else Spark joins by source, and splits the hot ones
    source, doc = F.col("source").cast("string"), F.col("doc_id").cast("long")
    rated = docs.join(r, source.eqNullSafe(F.col("__sw_source"))).filter("__sw_rate > 0")
    rest = [F.col(c).cast("string") if t.startswith("map") else F.col(c) for c, t in docs.dtypes if c not in ("doc_id", "source")]
    ties = [F.xxhash64(*rest)] if rest else []
    summed = numbered(rated, F.col("__sw_source"), doc, [doc.asc_nulls_first(), *ties], F.col("__sw_rate"), "__sw_sum")
    started = summed.withColumn("__sw_start", F.col("__sw_sum") + offset(F.col("__sw_source"), seed))
    copies = F.expr(f"cast((__sw_start + __sw_rate) div {UNIT} - __sw_start div {UNIT} as int)")
    drawn = started.withColumn("__sw_copies", copies).filter("__sw_copies > 0")
    return drawn.withColumn("__sw_copy", F.explode(F.sequence(F.lit(1), F.col("__sw_copies")))).drop("__sw_source", "__sw_rate", "__sw_sum", "__sw_start", "__sw_copies")


SQL = f"""
with d as (select doc_id, source, coalesce(length(text), 0) as chars from documents),
s as (select source, sum(chars)::hugeint as chars, (case when source = 'src0' then 4 else 1 end)::hugeint as w from d group by source having sum(chars) > 0),
r as (select source, (({UNIT}::hugeint * w * (select sum(chars)::hugeint from s)) // ((select sum(w)::hugeint from s) * chars)) as rate,
             ('0x' || substr(md5('{SEED}:' || coalesce(source, '')), 1, 15))::bigint % {UNIT} as start from s),
n as (select d.doc_id, d.source, r.rate, r.start + r.rate * (row_number() over (partition by d.source order by d.doc_id) - 1) as pos
      from d join r on d.source is not distinct from r.source),
c as (select doc_id, source, ((pos + rate) // {UNIT} - pos // {UNIT}) ::int as copies from n)
select doc_id, source, unnest(range(1, copies + 1))::int as "copy" from c where copies > 0
"""
