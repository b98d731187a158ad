"""Mixing sources to target weights by capped water-filling. DataFrame operations only.

Every source has a weight and a cap, most_epochs times its size. Shares of the total are dealt by
weight; a source whose share exceeds its cap stops there, and the excess goes to the others by
weight, until no share is above its cap. With sources in the order of cap over weight, those that
stop are a start of that order, so running sums find the fill level without a loop.

A document of a source with target/size = r is taken floor(r) times; the fraction of one more
repetition goes to documents in a seeded random order, until they hold the fraction's words (a
document counts when its middle lies before that point). The point is found by descent: sums over
the order's first 8 bits name a slice, sums over the next 8 bits one within it, and only that
slice, a 65,536th of the source, is sorted. So no task takes a whole source, and each document's
own place tells whether it is taken: texts cross no network.

The texts are read once for their sizes (mix-rows, a few numbers a document), and once more if
columns are kept. The plan has a row for each source; its windows run in one task, so the list of
sources must fit one (weights are set for each source: thousands, not millions).

Null text: size 0, taken 0 times its size. Null sources are one source, the last by name. Empty
input: no rows. Rows that repeat an id are documents of their own; they share one place in the
order, ties among them by size and text; where such equal rows lie across the point, as many of
them are taken as lie before it. Sources without words have target 0. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spoorline.llm.common import hashed, n_words, written

CYCLE = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3
SEED = "mix-1"
#: Bits of the random order, and of each of the two descents into it.
ORDER_BITS, STEP_BITS = 52, 8
#: Tasks that the rows of one source spread over when they meet their target.
SALTS = 64


def source_sizes(sized: DataFrame) -> DataFrame:
    """(source, size) rows -> a row for each source: source, source_size."""
    return sized.groupBy("source").agg(F.sum("size").alias("source_size"))


def cyclic_weights(sources: DataFrame, cycle: Sequence[float] = CYCLE) -> DataFrame:
    """Adds weight: the cycle's numbers, dealt to sources by code point, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (place % len(cycle) + 1).cast("int")))


def water_fill(sources: DataFrame, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, weight) -> the same rows with target.

    The table has a row for each source, so its windows are as small as the list of sources.
    """
    cap = F.col("source_size") * F.lit(float(most_epochs))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    df = sources.withColumn("cap", cap)
    df = df.withColumn("total", F.sum("source_size").over(every)).withColumn("weights", F.sum("weight").over(every))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    df = df.withColumn("level", level)
    # The first source in order that does not stop gives the level for all that follow.
    df = df.withColumn("place", F.row_number().over(by))
    df = df.withColumn("fill", F.min_by("level", F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("place"))).over(every))
    target = F.when(F.col("fill").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("fill")))
    return df.select("source", "source_size", "weight", target.alias("target"))


def _of_source(df: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows (source, u) beside their source's plan.

    A plan of small size is broadcast by Spark's own threshold; beyond it a hot source's rows go
    to SALTS tasks, for the plan is repeated, not the rows.
    """
    salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.join(salted, F.col("source").eqNullSafe(F.col("of")) & (F.pmod("u", F.lit(SALTS)).cast("int") == F.col("salt"))).drop("salt", "of")


def _descend(sums: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds to the plan (of, part, before) the slice that holds the point, and what lies before it.

    sums: (source, slice, size), at most 2**STEP_BITS rows a source.
    """
    s = sums.join(plan.select(F.col("of").alias("of1"), "part", "before"), F.col("source").eqNullSafe(F.col("of1")))
    run_up = F.col("before") + F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    point = s.withColumn("upto", run_up).filter((F.col("upto") < F.col("part")) & (F.col("upto") + F.col("size") >= F.col("part")))
    point = point.groupBy("of1").agg(F.min(F.struct("slice", "upto")).alias("x")).select("of1", F.col("x.slice").alias("slice1"), F.col("x.upto").alias("upto1"))
    out = plan.drop("slice").join(point, F.col("of").eqNullSafe(F.col("of1")), "left").withColumn("before", F.coalesce("upto1", "before"))
    return out.withColumnRenamed("slice1", "slice").drop("of1", "upto1")


def mixture_plan(rows: DataFrame, cycle: Sequence[float] = CYCLE, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """(doc_id, source, size, u, tie) -> a row for each source: of, source_size, target, whole
    (repetitions of all its documents), slice and last (one more for documents up to there), and
    m of c rows at that place that are taken."""
    first = ORDER_BITS - STEP_BITS
    tops = written(rows.groupBy("source", F.shiftright("u", first).alias("slice")).agg(F.sum("size").alias("size")), "mix-slices")
    plan = water_fill(cyclic_weights(source_sizes(tops), cycle), most_epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.select(F.col("source").alias("of"), "source_size", "target", F.floor(ratio).alias("whole"))
    plan = plan.withColumn("part", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("before", F.lit(0).cast("long"))
    plan = written(_descend(tops, plan), "mix-plan")
    within = _of_source(rows, plan.filter("slice IS NOT NULL").select("of", "slice")).filter(F.shiftright("u", first) == F.col("slice"))
    plan = written(_descend(within.groupBy("source", F.shiftright("u", first - STEP_BITS).alias("slice")).agg(F.sum("size").alias("size")), plan), "mix-plan")
    inside = _of_source(rows, plan.filter("slice IS NOT NULL").select("of", "slice", "part", "before")).filter(F.shiftright("u", first - STEP_BITS) == F.col("slice"))
    run_up = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("u", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = inside.withColumn("taken", (F.col("before") + run_up + F.col("size") / 2 < F.col("part")).cast("int"))
    places = places.groupBy("source", "u", "doc_id", "size", "tie").agg(F.sum("taken").alias("m"), F.count("*").alias("c")).filter("m > 0")
    last = places.groupBy(F.col("source").alias("of1")).agg(F.max(F.struct(F.struct("u", "doc_id", "size", "tie").alias("last"), "m", "c")).alias("x")).select("of1", "x.*")
    return written(plan.join(last, F.col("of").eqNullSafe(F.col("of1")), "left").select("of", "source_size", "target", "whole", "slice", "last", "m", "c"), "mix-plan")


def mix(docs: DataFrame, size: Column | None = None, cycle: Sequence[float] = CYCLE, most_epochs: int = MOST_EPOCHS, seed: str = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, text, source) -> doc_id, size, source_size, target, taken, copies, and the columns to keep.

    copies: how often the mix takes the document; taken: its words times copies. A column to keep
    that is named as one of these (doc_id aside) is refused.
    """
    if clash := {"size", "source_size", "target", "taken", "copies"} & set(keep):
        raise ValueError(f"these names are the mix's own: {sorted(clash)}")
    text = F.col("text") if "text" in docs.columns else F.lit(None).cast("string")
    size = n_words(text) if size is None else size
    u = hashed(F.col("doc_id"), ORDER_BITS, seed)
    rows = written(docs.select("doc_id", "source", size.alias("size"), u.alias("u"), F.xxhash64(text).alias("tie")), "mix-rows")
    plan = mixture_plan(rows, cycle, most_epochs)
    # With columns to keep the documents are read again, and nothing of them moves.
    own = docs.select("doc_id", "source", u.alias("u"), size.alias("size"), text.alias("own_text"), F.struct(*keep).alias("kept")) if keep else rows
    df = _of_source(own, plan)
    place = F.struct("u", "doc_id", "size", F.xxhash64("own_text").alias("tie")) if keep else F.struct("u", "doc_id", "size", "tie")
    slice_, at = F.shiftright("u", ORDER_BITS - 2 * STEP_BITS), F.col("slice")
    upto = F.when(at.isNull(), False).when(slice_ != at, slice_ < at).otherwise(F.coalesce(place <= F.col("last"), F.lit(False)))
    if not plan.filter("m < c").isEmpty():  # equal rows across the point: m of them are taken
        there = F.coalesce((slice_ == at) & (F.col("m") < F.col("c")) & (place == F.col("last")), F.lit(False))
        nth = F.row_number().over(Window.partitionBy("source").orderBy("u"))
        df = df.filter(~there).withColumn("more", upto).unionByName(df.filter(there).withColumn("more", nth <= F.col("m")))
    else:
        df = df.withColumn("more", upto)
    copies = (F.col("whole") + F.col("more").cast("int")).cast("long")
    return df.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), *[F.col(f"kept.{k}").alias(k) for k in keep if k != "doc_id"])


#: The same rows of the query over documents, for an independent engine.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, ((sum(source_size) OVER ()) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
   / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level FROM w),
n AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source ASC NULLS LAST) AS place FROM l),
f AS (SELECT *, (SELECT arg_min(level, place) FROM n WHERE cap / weight >= level) AS fill FROM n),
t AS (SELECT source, source_size, CASE WHEN fill IS NULL THEN cap ELSE least(cap, weight * fill) END AS target FROM f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
r AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS part,
   coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
   FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN before + size / 2.0 < part THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
