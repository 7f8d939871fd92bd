"""Assigning tokens to partitions: SimHash, an ablated SimHash, or the nearest of fixed centers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import doubles, literal, nearest, parities, sign_bits, with_bit
from ..plans.config import FdeConfig, Projection, ams_columns, hyperplanes


def _projected(vec: Column, rep: Column, cfg: FdeConfig) -> Column:
    """The token as its repetition projects it: every output is a signed sum of its own inputs."""
    if cfg.projection is Projection.IDENTITY:
        return vec
    columns, signs = ams_columns(cfg)
    # Input k with sign s is kept as s * (k + 1).
    inputs = [[[int(signs[r][k] * (k + 1)) for k in np.flatnonzero(columns[r] == o)] for o in range(cfg.width)] for r in range(cfg.reps)]
    pick = lambda e: F.element_at(vec, F.abs(e)) * F.signum(e)
    return F.transform(F.get(literal(inputs, "int"), rep), lambda own: F.aggregate(own, F.lit(0.0), lambda s, e: s + pick(e)))


def partitioned(tokens: DataFrame, cfg: FdeConfig, id_col: str = "doc_id") -> DataFrame:
    """id, tok, rep, raw, part, x: every token once for each repetition.

    raw holds the signs of its sketch, first hyperplane first; part is the partition these bits lead to when appended
    as a Gray code (the parity of each bit with those above it). A sketch of exactly 0 is bit 0. A forced bit changes
    part and not raw. Nothing is shuffled; the hyperplanes are constants of the plan.
    """
    vec = F.col("vec")
    raw = F.transform(literal(hyperplanes(cfg)), lambda planes: sign_bits(vec, planes)) if cfg.bits else F.array_repeat(F.lit(0).cast("long"), cfg.reps)
    t = tokens.select(id_col, "tok", doubles(vec).alias("vec")).select("*", F.posexplode(raw).alias("rep", "raw"))
    bits = F.col("raw") if cfg.forced_bit is None else with_bit(F.col("raw"), cfg.bits, cfg.forced_bit, cfg.forced_value)
    return t.select(id_col, "tok", "rep", "raw", parities(bits).cast("int").alias("part"), _projected(F.col("vec"), F.col("rep"), cfg).alias("x"))


def by_centers(tokens: DataFrame, centers: np.ndarray, id_col: str = "doc_id", components: np.ndarray | None = None) -> DataFrame:
    """id, tok, rep, part, x: the nearest of [reps, partitions, values] centers, the first of equals.

    components: [reps, values, dimension] projects tokens before (learnt axes); without it tokens are taken as they are.
    """
    from ..functions.vectors import dot

    vec = doubles(F.col("vec"))
    at = literal(centers)
    n = len(centers)
    t = tokens.select(id_col, "tok", vec.alias("vec"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("rep"))
    if components is not None:
        t = t.withColumn("vec", F.transform(F.get(literal(components), F.col("rep")), lambda axis: dot(axis, F.col("vec"))))
    return t.select(id_col, "tok", "rep", nearest(F.col("vec"), F.get(at, F.col("rep"))).alias("part"), F.col("vec").alias("x"))
