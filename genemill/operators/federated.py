"""Aggregation of model updates (round_id, participant, layer, weights ARRAY<DOUBLE>, n, ...)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _positions(updates: DataFrame, *keep: str) -> DataFrame:
    return updates.select(*keep, F.posexplode("weights").alias("pos", "w"))


def weighted_average(updates: DataFrame) -> DataFrame:
    """Sum of n * w over sum of n, per layer and position."""
    w = _positions(updates, "layer", "n")
    return w.groupBy("layer", "pos").agg((F.sum(F.col("n") * F.col("w")) / F.sum("n")).alias("weight"))


def as_arrays(weights: DataFrame) -> DataFrame:
    """Long weights back to one array per layer, the shape of an update."""
    cells = F.array_sort(F.collect_list(F.struct("pos", "weight")))
    return weights.groupBy("layer").agg(F.transform(cells, lambda c: c["weight"]).alias("weights"))


def masked_average(updates: DataFrame) -> DataFrame:
    """Sum of masked (already n-weighted) values over sum of n."""
    w = _positions(updates, "layer", "n")
    return w.groupBy("layer", "pos").agg((F.sum("w") / F.sum("n")).alias("weight"))


def _uniform(*parts) -> Column:
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def _normal(seed: int, *parts) -> Column:
    """Standard normal from two hashes: the same for the same key, whatever the partitioning."""
    a, b = _uniform(*parts, F.lit(seed)), _uniform(*parts, F.lit(seed + 7919))
    return F.sqrt(-2 * F.log(a)) * F.cos(2 * math.pi * b)


def add_ring_masks(weights: DataFrame, n_participants: int, seed: int = 42) -> DataFrame:
    """Add r(i) - r(i + 1) around the ring to long weights (participant 0..n-1, layer, pos, w)."""
    i = F.col("participant")
    nxt = F.pmod(i + 1, F.lit(n_participants))
    mask = _normal(seed, i.cast("long"), "layer", "pos") - _normal(seed, nxt.cast("long"), "layer", "pos")
    return weights.withColumn("mask", mask).withColumn("masked", F.col("w") + F.col("mask"))


def mask_sums(masked: DataFrame, tol: float = 1e-8) -> DataFrame:
    """Sum of the masks at each position and whether it vanishes."""
    g = masked.groupBy("layer", "pos").agg(F.sum("mask").alias("total"))
    return g.select("layer", "pos", (F.abs("total") < tol).alias("zero_sum"))


def noise_scale(epsilon: float, delta: float, published: bool = True) -> float:
    """Gaussian mechanism: sqrt(2 ln(1.25/delta)) / epsilon, or without the root on request."""
    v = 2 * math.log(1.25 / delta)
    return (math.sqrt(v) if published else v) / epsilon


def add_noise(weights: DataFrame, epsilon: float = 1.0, delta: float = 1e-5, seed: int = 42, published: bool = True) -> DataFrame:
    z = _normal(seed, "layer", "pos")
    return weights.withColumn("weight", F.col("weight") + z * noise_scale(epsilon, delta, published))


def round_metrics(updates: DataFrame) -> DataFrame:
    return updates.groupBy("round_id").agg(
        F.count(F.lit(1)).alias("participants"),
        F.avg("loss").alias("mean_loss"),
        F.stddev_pop("loss").alias("std_loss"),
        F.avg("accuracy").alias("mean_accuracy"),
        F.stddev_pop("accuracy").alias("std_accuracy"),
        F.sum("n").alias("total_samples"),
        F.min("n").alias("min_samples"),
        F.max("n").alias("max_samples"),
    )


def aggregate_round(updates: DataFrame, round_id, min_participants: int = 2) -> DataFrame:
    """Average of a round that has enough participants and is not yet aggregated."""
    mine = updates.filter((F.col("round_id") == round_id) & ~F.col("aggregated"))
    enough = mine.agg((F.count_distinct("participant") >= min_participants).alias("ok")).scalar()
    return weighted_average(mine.filter(enough))


def status(participants: DataFrame, updates: DataFrame, since) -> DataFrame:
    recent = updates.agg(F.count_if(F.col("created_at") >= F.lit(since).cast("timestamp_ntz")).alias("r")).scalar()
    return participants.agg(
        F.count(F.lit(1)).alias("participants"), F.count_if("active").alias("active")
    ).withColumn("recent_updates", recent)


def last_rounds(rounds: DataFrame, n: int = 10) -> DataFrame:
    return rounds.orderBy(F.col("created_at").desc(), F.col("round_id").desc()).limit(n)


def score_linear(features: DataFrame, weights: DataFrame) -> DataFrame:
    """Predictions of a linear model given as long weights (pos 0 is the intercept).

    `features` holds id, y, x ARRAY<DOUBLE>. The weights become one array, as wide as the model, and each row
    multiplies it with its own: nothing is joined or shuffled.
    """
    by_pos = weights.groupBy("pos").agg(F.sum("weight").alias("w"))
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "w")))
    row = by_pos.agg(pairs.alias("m"), F.max("pos").alias("pos"))
    row = row.select(F.transform(F.sequence(F.lit(0), F.coalesce(F.col("pos").cast("int"), F.lit(0))), lambda p: F.try_element_at("m", p)).alias("w"))
    terms = F.zip_with(F.concat(F.array(F.lit(1.0)), "x"), "_w", lambda v, c: F.coalesce(v * c, F.lit(0.0)))
    z = F.col("_z")
    dot = features.withColumn("_w", row.scalar()).select("id", "y", F.aggregate(terms, F.lit(0.0), lambda a, t: a + t).alias("_z"))
    return dot.select("id", "y", F.when(z >= 0, 1).otherwise(0).alias("yhat"), (1 / (1 + F.exp(-z))).alias("score"))
