"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 7).

Each source gets a budget of words. What whole epochs of the source don't cover is
drawn without replacement: a document with quality weight w and a hashed uniform u has
the key ln(u) / w, and documents are taken from the largest key down until the budget is
reached. The prefix sums over keys have two levels, buckets of the key's range and rows
of the one bucket that the budget ends in, so no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import GAP, documents, store

#: Equal steps of exp(key); the boundary step alone is ranked row by row.
BUCKETS = 1 << 16
#: Steps are first summed in groups of so many.
STRIDE = 256
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
#: No document is taken more often.
EPOCHS = 2


def word_count(text: Column) -> Column:
    """Words of a text (null: 0)."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), GAP, " ")
    body = F.trim(body)
    return F.when(body == "", F.lit(0)).otherwise(F.length(body) - F.length(F.replace(body, F.lit(" "), F.lit(""))) + 1).cast("long")


def quality(text: Column) -> Column:
    """A weight from 0.5 to 1.5: falls with the share of digits, marks and capitals."""
    text = F.coalesce(text, F.lit(""))
    odd = F.length(text) - F.length(F.translate(text, "0123456789#*$%&|<>!{}[]=_ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return F.lit(1.5) - F.least(F.lit(1.0), F.lit(5.0) * odd / F.greatest(F.length(text), F.lit(1)))


def uniform(doc_id: Column) -> Column:
    """A uniform number above 0 and below 1, from the first 48 bits of a digest of the id."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Of (source, source_size), each source's target; a row a source, so windows stay small.

    Weights repeat over the sources in code point order, null last. Where a target would
    pass ``epochs`` times its source, it stops there and the excess is shared by weight
    among the others, until none is above: all others stand at one level per weight.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    rows = sizes.withColumn("place", F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))))
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("place").cast("int") + 1))
    rows = rows.withColumn("cap", F.col("source_size") * float(epochs))
    rank = Window.orderBy(F.col("cap") / F.col("weight"), "place", F.col("source").isNull(), F.col("source").cast("binary"))
    every = Window.partitionBy()
    rows = rows.withColumns({"all_words": F.sum("source_size").over(every), "capped": F.coalesce(F.sum("cap").over(rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "open": F.sum("weight").over(rank.rowsBetween(0, Window.unboundedFollowing))})
    # The level at which all before this one are at their caps; the right one is the first that its own cap holds.
    rows = rows.withColumn("level", (F.lit(share) * F.col("all_words") - F.col("capped")) / F.col("open"))
    rows = rows.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(every)["level"])
    return rows.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _sized(docs: DataFrame) -> DataFrame:
    """Adds what the mix needs of a row, in a struct m: id, source, size, order, bucket."""
    key = F.log(uniform(F.col("doc_id"))) / quality(F.col("text"))
    rows = docs.withColumn("m", F.struct(F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), (-key).alias("rank")))
    bucket = F.floor((1 - F.exp(-F.col("m.rank"))) * BUCKETS)
    return rows.withColumn("m", F.col("m").withField("bucket", bucket))


def _order(m: Column) -> Column:
    """Rows are drawn in this order; null ids come first."""
    return F.struct(m["rank"].alias("rank"), F.coalesce(m["id"], F.lit(-(1 << 63))).alias("id"), m["size"].alias("size"))


def _crossing(steps: DataFrame, goal: DataFrame) -> DataFrame:
    """The step of each source in which its sum of words, from base, passes the rest: s, step, before."""
    joined = steps.join(goal.select("s", "rest", "base"), steps["source"].eqNullSafe(goal["s"]))
    order = Window.partitionBy("s").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)  # STRIDE rows a source at most
    joined = joined.withColumn("before", F.col("base") + F.coalesce(F.sum("words").over(order), F.lit(0)))
    found = joined.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
    return found.groupBy("s").agg(F.max(F.struct("step", "before")).alias("e")).select("s", "e.step", "e.before")


def goals(rows: DataFrame, weights: tuple[float, ...], share: float, epochs: int) -> DataFrame:
    """Of each source of ``rows`` (m): source_size, target, whole epochs, and where the rest ends.

    The rest takes all buckets before ``edge``, and of that bucket the rows up to ``last``.
    """
    steps = store(rows.groupBy("m.source", "m.bucket").agg(F.sum("m.size").alias("words")), "steps")
    goal = targets(steps.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, epochs)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(epochs))).otherwise(0))
    goal = goal.withColumn("rest", F.when(F.col("whole") >= epochs, F.lit(0.0)).otherwise(F.col("target") - F.col("whole") * F.col("source_size")))
    goal = store(goal.withColumnRenamed("source", "s"), "targets")
    coarse = _crossing(steps.groupBy("source", F.floor(F.col("bucket") / STRIDE).alias("step")).agg(F.sum("words").alias("words")), goal.withColumn("base", F.lit(0)))
    coarse = store(goal.join(coarse.withColumnRenamed("s", "e_s"), goal["s"].eqNullSafe(F.col("e_s"))).select("s", "rest", F.col("step").alias("coarse"), F.col("before").alias("base")), "coarse")
    fine = steps.join(coarse.select(F.col("s").alias("c_s"), "coarse"), steps["source"].eqNullSafe(F.col("c_s")) & (F.floor(F.col("bucket") / STRIDE) == F.col("coarse")))
    edges = _crossing(fine.select("source", F.col("bucket").alias("step"), "words"), coarse)
    goal = store(goal.join(edges.withColumnRenamed("s", "e_s"), goal["s"].eqNullSafe(F.col("e_s")), "left").select("s", "source_size", "target", "whole", "rest", F.col("step").alias("edge"), "before"), "edges")
    near = rows.select("m").join(goal, F.col("m.source").eqNullSafe(F.col("s")) & (F.col("m.bucket") == F.col("edge")))
    order = _order(F.col("m"))
    sums = F.coalesce(F.sum("m.size").over(Window.partitionBy("s").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = near.withColumn("upto", F.col("before") + sums + F.col("m.size") / 2).where((F.col("upto") <= F.col("rest")) & (F.col("rest") > 0)).groupBy("s").agg(F.max(order).alias("last"))
    return store(goal.join(last.withColumnRenamed("s", "l_s"), goal["s"].eqNullSafe(F.col("l_s")), "left").drop("l_s"), "goals")


def _taken(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """Adds source_size, target and copies. Goals are a row a source, and broadcast only if Spark finds them small."""
    m = F.col("m")
    more = F.when(F.col("rest") <= 0, 0).when(F.col("edge").isNull() | (m["bucket"] < F.col("edge")), 1).when((m["bucket"] == F.col("edge")) & (_order(m) <= F.col("last")), 1).otherwise(0)
    return rows.join(goal, m["source"].eqNullSafe(F.col("s"))).withColumn("copies", (F.col("whole") + more).cast("int"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Of each row: doc_id, size, source_size, target, taken.

    ``taken`` is size times the copies in the mix: all complete epochs of the target, and
    one more for the rows whose middle lies before the rest of the budget in key order.
    Null and empty texts have size 0 and are taken 0; a source without words has target 0.
    Rows with one id have one key and are ordered by size; rows equal in both are taken
    alike where the budget ends between them.
    """
    rows = store(_sized(docs.select("doc_id", "source", "text")).select("m"), "sizes")
    out = _taken(rows, goals(rows, weights, share, epochs))
    return out.select(F.col("m.id").alias("doc_id"), F.col("m.size").alias("size"), "source_size", "target", (F.col("m.size") * F.col("copies")).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, in its own columns."""
    columns = docs.columns
    inner = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    at = {c: F.col(f"c{columns.index(c)}") for c in ("doc_id", "source", "text")}
    sized = _sized(inner.withColumns(at))
    goal = goals(store(sized.select("m"), "sizes"), weights, share, epochs)
    out = _taken(sized.drop(*at), goal).withColumn("again", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


_ODD = "0123456789#*$%&|<>!{}[]=_ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
    / (1.5::DOUBLE - least(1.0::DOUBLE, 5.0::DOUBLE * (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '{_ODD}', ''))) / greatest(length(coalesce(text, '')), 1))) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS place FROM d GROUP BY source),
w AS (SELECT *, CASE place WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT a.cap / a.weight AS ratio, (1.5::DOUBLE * (SELECT sum(source_size) FROM w)
    - coalesce(sum(b.cap) FILTER (WHERE b.cap / b.weight < a.cap / a.weight), 0)) / sum(b.weight) FILTER (WHERE b.cap / b.weight >= a.cap / a.weight) AS lv
  FROM w a, w b GROUP BY ALL),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(lv, ratio) FROM l WHERE lv <= ratio) * weight, cap)) AS target FROM w),
g AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END AS whole FROM t),
r AS (SELECT d.doc_id, d.size, g.source_size, g.target, whole, target - whole * source_size AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k DESC, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN whole < 2 AND rest > 0 AND before + size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
