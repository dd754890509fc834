"""Exact quantiles of any number of distinct values, without one buffer.

Values are folded to (value, count), sorted by ranges, and stored. Counts per range,
summed from the left, tell in which ranges the wanted ranks lie; only those are read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmill.runtime import materialize


def folded(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Stored (m, v, n, part): occurrences of every value of the m-th measure, sorted by ranges; nulls are left out.

    One pass over `df` computes all measures.
    """
    values = F.array(*[F.struct(F.lit(i).alias("m"), x.cast("double").alias("v")) for i, x in enumerate(measures.values())])
    counts = df.select(F.inline(values)).where("v is not null").groupBy("m", "v").agg(F.count(F.lit(1)).alias("n"))
    ranges = counts.repartitionByRange("m", "v").sortWithinPartitions("m", "v")
    return materialize(ranges.withColumn("part", F.spark_partition_id()), "values")


def ranked_values(counts: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """(m, q, value) for all measures of `folded` values; between two ranks the value is interpolated.

    The ranges that hold a wanted rank are at most two per measure and quantile.
    """
    parts = counts.groupBy("m", "part").agg(F.sum("n").alias("n"))
    left = Window.partitionBy("m").orderBy("part")
    parts = parts.select(
        "m", "part", (F.sum("n").over(left) - F.col("n")).alias("before"), F.sum("n").over(left).alias("upto"),
        F.sum("n").over(Window.partitionBy("m")).alias("total"),
    )
    position = F.col("q") * (F.col("total") - 1)
    wanted = (
        parts.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in probabilities])))
        .withColumn("position", position)
        .withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("position"), F.ceil("position")))))
        .where("rank >= before and rank < upto")
    )
    wanted = materialize(wanted, "ranks")
    inside = Window.partitionBy("m", "part").orderBy("v")
    near = (
        counts.join(F.broadcast(wanted.select("m", "part", "before").distinct()), ["m", "part"])
        .withColumn("end", F.col("before") + F.sum("n").over(inside))
        .select("m", "part", "v", "end", (F.col("end") - F.col("n")).alias("begin"))
    )
    hit = near.join(F.broadcast(wanted.drop("before")), ["m", "part"]).where("rank >= begin and rank < end")
    low, high = F.floor("position"), F.ceil("position")
    value = lambda rank: F.max(F.when(F.col("rank") == rank, F.col("v")))
    ends = hit.groupBy("m", "q", "position").agg(value(low).alias("lo"), value(high).alias("hi"))
    between = (high - F.col("position")) * F.col("lo") + (F.col("position") - low) * F.col("hi")
    return ends.select("m", "q", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(between).alias("value"))


def quantiles(df: DataFrame, measures: dict[str, Column], probabilities: Sequence[float]) -> DataFrame:
    """(measure, q, value); a measure without values has no rows."""
    names = F.array(*[F.lit(name) for name in measures])
    found = ranked_values(folded(df, measures), probabilities)
    return found.select(F.get(names, F.col("m")).alias("measure"), "q", "value")
