"""Mixing sources to target weights by nested hash thresholds, with DataFrame functions only.

Sizes are summed by (source, first hash bits). Running sums over these at most ``2**bits`` buckets a source find the
bucket in which the source's budget ends; only that bucket's documents are summed again by their next hash bits. What
a document gives then follows from two bucket decisions joined on (source, bucket): no document is sorted, and a
source that holds a third of all rows is spread over all of its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foreopen.llm.common import cut, read

BITS = 12
WORDS = r"[^\x20\x09-\x0D]+"


def doc_hash(doc_id: Column) -> Column:
    """60 hash bits of an id, the same in every engine that has MD5; a null id hashes as an empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``: one row a source, so the windows are small.

    A source's target is its weight times a level, or ``most`` times its size where that is less. Sources are taken by
    the ratio of cap to weight; the level is right at the first where the next source is not above its cap.
    """
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("double"))
    ranked = ranked.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    order, whole = Window.orderBy("ratio", F.col("source").asc_nulls_last()), Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("left", F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", F.col("left") / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    level = F.min_by(F.when(F.col("ratio") >= F.col("level"), F.col("level")), F.when(F.col("ratio") >= F.col("level"), F.col("ratio"))).over(whole)
    return ranked.select("source", "source_size", F.least("cap", F.coalesce(level, F.col("level")) * F.col("w")).alias("target"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (3, 1, 2), carry: tuple[str, ...] = ()) -> DataFrame:
    """How many words the mix takes of each document.

    Reads ``doc_id, text, source``; returns ``doc_id, source, size, source_size, target, copies, taken`` and the carried
    columns. ``copies`` is 0 up to ``most``; ``taken = copies * size``. A null text has size 0; a null source is a source
    of its own, last in order; rows with equal doc_id share one hash and so one decision. A document without words gives
    no words, however often it is taken, and is taken ``most`` times at most like any other; a source of such documents
    alone is taken once. Other columns are ignored. An empty table gives no rows. A source's words miss its target by half of one small hash bucket at most.
    """
    own = docs.select("doc_id", "source", *carry, F.coalesce(F.regexp_count(F.col("text"), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), doc_hash(F.col("doc_id")).alias("h"))
    own = own.withColumn("b1", F.shiftright("h", 60 - BITS)).withColumn("b2", F.shiftright("h", 60 - 2 * BITS).bitwiseAND((1 << BITS) - 1))
    slim = cut(own.drop(*carry))
    hist = cut(slim.groupBy("source", "b1").agg(F.sum("size").alias("n")))
    plan = targets(hist.groupBy("source").agg(F.sum("n").alias("source_size")), share, most, weights)
    plan = plan.withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = cut(plan.withColumn("extra", F.col("target") - F.col("base") * F.col("source_size")))
    # first level: buckets that fit whole, and the one in which the budget ends
    by = Window.partitionBy("source").orderBy("b1").rowsBetween(Window.unboundedPreceding, 0)
    first = hist.withColumn("upto", F.sum("n").over(by)).withColumnRenamed("source", "s").join(plan, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    # where the source is at its cap nothing is added, not even documents without words
    first = first.withColumn("whole", (F.col("upto") <= F.col("extra")) & (F.col("base") + 1 <= most)).withColumn("edge", ~F.col("whole") & (F.col("upto") - F.col("n") < F.col("extra")))
    first = cut(first.select(F.col("source").alias("s1"), F.col("b1").alias("k1"), "source_size", "target", "base", "whole", "edge", (F.col("extra") - F.col("upto") + F.col("n")).alias("rest")))
    same = F.col("source").eqNullSafe(F.col("s1")) & (F.col("b1") == F.col("k1"))
    # second level: only the documents of boundary buckets are summed again
    inner = slim.join(first.where("edge").select("s1", "k1", "rest"), same).groupBy("s1", "k1", "b2").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
    within = Window.partitionBy("s1").orderBy("b2").rowsBetween(Window.unboundedPreceding, 0)
    inner = inner.withColumn("upto", F.sum("n").over(within))
    # a bucket goes in when that brings the sum nearer to the budget
    inner = inner.where(F.col("upto") - F.col("rest") <= F.col("rest") - (F.col("upto") - F.col("n"))).select(F.col("s1").alias("s2"), F.col("k1").alias("k2"), F.col("b2").alias("j2"))
    out = (own if carry else slim).join(first.select("s1", "k1", "source_size", "target", "base", "whole"), same)
    out = out.join(inner, F.col("source").eqNullSafe(F.col("s2")) & (F.col("b1") == F.col("k2")) & (F.col("b2") == F.col("j2")), "left")
    copies = F.col("base") + (F.col("whole") | F.col("j2").isNotNull()).cast("long")
    return out.select("doc_id", "source", *carry, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         cast('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15) as bigint) >> 36 as h from documents),
s as (select source, sum(size)::bigint as source_size, ([3, 1, 2])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w from d group by source),
t as (select *, 2.0 * source_size as cap, (2.0 * source_size)::double / w as ratio,
        (1.5 * sum(source_size) over () - coalesce(sum(2.0 * source_size) over (order by (2.0 * source_size)::double / w, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
        / (sum(w) over () - coalesce(sum(w) over (order by (2.0 * source_size)::double / w, source nulls last rows between unbounded preceding and 1 preceding), 0)) as level from s),
l as (select arg_min(level, ratio) filter (ratio >= level) as level from t),
p as (select source, source_size, least(cap::double, l.level * w) as target from t, l),
q as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as base from p),
b as (select source, h, sum(size) as n from d group by source, h),
c as (select b.*, q.target - q.base * q.source_size as extra, sum(n) over (partition by b.source order by h) as upto from b join q on b.source is not distinct from q.source)
select d.doc_id, d.size, q.source_size, q.target,
       (d.size * (q.base + case when c.upto - c.extra <= c.extra - (c.upto - c.n) then 1 else 0 end))::bigint as taken
from d join q on d.source is not distinct from q.source join c on d.source is not distinct from c.source and d.h = c.h
"""
