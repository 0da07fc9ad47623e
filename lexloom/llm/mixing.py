"""Problem 8: mixing sources to target shares by Pareto order sampling.

A source with target size T and available size A gives floor(T / A) certain whole copies of every
record (at most ``max_repeats``) and, for the rest R of its target, a sample: each record has an
inclusion probability p in proportion to a power of its size, scaled so that R is expected (records
that would go beyond 1 are certain, and the rest is scaled up for what they leave), and the
order number (u / (1 - u)) / (p / (1 - p)) with a uniform u drawn from a hash of its key; the
records of the least order numbers are taken until R is reached as nearly as whole records allow.

The bound on the order numbers is found without sorting a source in one task: order numbers fall
into ``BINS`` bins whose sizes are summed per source; only the bin in which R is reached is ordered.

Defined results: records of no target source, with null source, null size or size 0 are not chosen;
a source of targets without records is reported with 0; a target beyond ``max_repeats`` copies is
filled up to those and the share reached is reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import cut

BINS = 4096


def plan(sized: DataFrame, source: str, size: str, targets: DataFrame, total_share: float, power: float) -> DataFrame:
    """One row per target source: target size, certain copies, size to sample and its scale."""
    total = sized.agg(F.coalesce(F.sum(size), F.lit(0)).alias("corpus_tokens"))
    have = sized.groupBy(source).agg(F.count("*").alias("records"), F.sum(size).alias("available_tokens"))
    wanted = targets.select(F.col("source").alias("__s"), F.col("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")).where("__s is not null").distinct()
    rows = wanted.join(have, F.col("__s") == F.col(source), "left").drop(source).withColumnRenamed("__s", "source").crossJoin(F.broadcast(total))  # one row
    rows = rows.fillna(0, ["records", "available_tokens"]).withColumn("target_tokens", F.col("corpus_tokens") * F.lit(total_share) * F.col("target_share"))
    ratio = F.when(F.col("available_tokens") > 0, F.col("target_tokens") / F.col("available_tokens")).otherwise(F.lit(0.0))
    rows = rows.withColumn("certain_copies", F.least(F.floor(ratio), F.col("max_repeats")).cast("int"))
    rest = F.when(F.col("certain_copies") < F.col("max_repeats"), F.col("target_tokens") - F.col("certain_copies") * F.col("available_tokens")).otherwise(F.lit(0.0))
    rows = cut(rows.withColumn("rest_tokens", rest))
    # The scale over the histogram of sizes: with all larger sizes certain, the first at which this size is not.
    lots = sized.where(F.col(size) > 0).groupBy(F.col(source).alias("source"), F.col(size).cast("double").alias("n")).agg(F.count("*").alias("k"))
    larger = Window.partitionBy("source").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)  # one row per size
    onwards = Window.partitionBy("source").orderBy(F.desc("n")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    lots = lots.join(rows.select("source", "rest_tokens"), "source").withColumns({"certain": F.coalesce(F.sum(F.col("n") * F.col("k")).over(larger), F.lit(0.0)), "weight": F.sum(F.col("k") * F.pow("n", F.lit(1 + power))).over(onwards)})
    lots = lots.withColumn("scale", F.greatest(F.lit(0.0), F.col("rest_tokens") - F.col("certain")) / F.col("weight")).where(F.col("scale") * F.pow("n", F.lit(power)) <= 1)
    scales = lots.groupBy("source").agg(F.max_by("scale", "n").alias("scale"))
    return rows.join(scales, "source", "left").withColumn("scale", F.when(F.col("rest_tokens") > 0, F.coalesce("scale", F.lit(1.0))).otherwise(F.lit(0.0)))


def mix(sized: DataFrame, key: str, source: str, size: str, targets: DataFrame, total_share: float, seed: int = 11, power: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares): chosen (key, source, size, copies) and one report row per target source."""
    rows = sized.where(F.col(source).isNotNull() & (F.col(size) > 0)).select(F.col(key), F.col(source).alias("source"), F.col(size).cast("bigint").alias("size"))
    planned = cut(plan(sized, source, size, targets, total_share, power))
    u = (F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    p = F.least(F.lit(1.0), F.col("scale") * F.pow(F.col("size").cast("double"), power))
    odds = (u / (1 - u)) / (p / (1 - p))
    # In (0, 1) and rising with the order number; below 0 for records that are certain (p = 1), spread over bins too.
    order = F.when(p >= 1, u - 1).otherwise(odds / (1 + odds))
    # The targets are as many rows as sources are named: broadcast by plan only below Spark's own limit.
    drawn = rows.join(planned.select("source", "certain_copies", "rest_tokens", "scale"), "source")
    drawn = drawn.withColumn("order", F.when(F.col("scale") > 0, order)).withColumn("bin", F.floor(F.col("order") * BINS).cast("int"))
    drawn = cut(drawn)
    bins = drawn.where("order is not null").groupBy("source", "bin").agg(F.sum("size").alias("own"), F.first("rest_tokens").alias("rest_tokens"))
    w = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most 2 x BINS rows each
    bins = bins.withColumn("through", F.sum("own").over(w)).withColumn("before", F.col("through") - F.col("own"))
    bins = bins.select("source", "bin", "before", F.when(F.col("through") <= F.col("rest_tokens"), 1).when(F.col("before") >= F.col("rest_tokens"), -1).otherwise(0).alias("side"))
    placed = drawn.join(bins, ["source", "bin"], "left")
    edge = placed.where("side = 0")
    w = Window.partitionBy("source").orderBy("order", key).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one bin of a source
    edge = edge.withColumn("extra", (F.col("before") + F.sum("size").over(w) - F.col("size") / 2.0 <= F.col("rest_tokens")).cast("int"))
    sure = placed.where("side is null or side <> 0").withColumn("extra", F.when(F.col("side") == 1, 1).otherwise(0))
    every = sure.unionByName(edge).withColumn("copies", F.col("certain_copies") + F.col("extra")).where("copies > 0").select(key, "source", "size", "copies")
    chosen = cut(every)
    reached = chosen.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("reached_tokens"), F.max("copies").alias("most_copies"))
    shares = planned.join(reached, "source", "left").fillna(0, ["reached_tokens", "most_copies"])
    whole = chosen.agg(F.sum(F.col("size") * F.col("copies")).alias("mix_tokens"))
    shares = shares.crossJoin(F.broadcast(whole)).withColumn("reached_share", F.when(F.col("mix_tokens") > 0, F.col("reached_tokens") / F.col("mix_tokens")).otherwise(F.lit(0.0)))
    return chosen, shares.select("source", "target_share", "max_repeats", "records", "available_tokens", "target_tokens", "certain_copies", "most_copies", "reached_tokens", "reached_share")
