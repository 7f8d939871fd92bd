"""Statistics over partition counts(doc_id, rep, part, cnt; zeros kept) and over columns of measurements."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import ranges_below

#: Column statistics that one pass gives, quantiles by their share, and short forms of names.
METRICS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "count": F.count, "sum": F.sum}
QUANTILES = {"median": 0.5, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999}
ALL = ["mean", "median", "std", "min", "max", "p50", "p95", "p99", "p999", "count", "sum"]
ALIASES = {"avg": "mean", "med": "median"}


def partition_mask(counts: DataFrame, parts: int) -> DataFrame:
    """rep, doc_id, partition_mask, active_partition_count: a 0 or 1 for each partition in order.

    A mask is made of what partitions are used: one entry per partition at most is gathered for a document."""
    used = counts.where("cnt > 0").groupBy("rep", "doc_id").agg(F.collect_set("part").alias("used"))
    every = counts.select("rep", "doc_id").distinct().join(used, ["rep", "doc_id"], "left")
    has = F.coalesce("used", F.array().cast("array<int>"))
    digits = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.array_contains(has, p).cast("int").cast("string"))
    return every.select("rep", "doc_id", F.array_join(digits, "").alias("partition_mask"), F.size(has).cast("long").alias("active_partition_count"))


def partition_utilization(counts: DataFrame) -> DataFrame:
    """rep, part, utilized_docs, total_docs, utilization_rate (percent) and, over documents that use the partition, sum,
    mean, median, population deviation, least and greatest of the counts; all 0 for a partition never used."""
    some = F.when(F.col("cnt") > 0, F.col("cnt"))
    or0 = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    return counts.groupBy("rep", "part").agg(
        F.count(some).alias("utilized_docs"),
        F.count("*").alias("total_docs"),
        (F.count(some) / F.count("*") * 100).alias("utilization_rate"),
        F.coalesce(F.sum(some), F.lit(0)).alias("count_sum"),
        or0(F.avg(some)).alias("count_mean"),
        or0(F.median(some)).alias("count_median"),
        or0(F.stddev_pop(some)).alias("count_std"),
        or0(F.min(some)).alias("count_min"),
        or0(F.max(some)).alias("count_max"),
    )


def masking_summary(masks: DataFrame) -> DataFrame:
    """rep, n_docs, mean, median, min, max and sample deviation of the number of active partitions."""
    c = "active_partition_count"
    return masks.groupBy("rep").agg(F.count("*").alias("n_docs"), F.avg(c).alias("mean"), F.median(c).alias("median"), F.min(c).alias("min"), F.max(c).alias("max"), F.stddev_samp(c).alias("std"))


def utilization_summary(util: DataFrame) -> DataFrame:
    """rep, mean rate, the most and the least used partition (the first of equals), and all tokens counted."""
    rate = F.col("utilization_rate")
    return util.groupBy("rep").agg(
        F.avg(rate).alias("mean_rate"),
        F.min_by("part", F.struct(-rate, F.col("part"))).alias("most_used"),
        F.min_by("part", F.struct(rate, F.col("part"))).alias("least_used"),
        F.sum("count_sum").alias("total_count"),
    )


def repetition_stats(util: DataFrame) -> DataFrame:
    """rep, mean, sample deviation, least and greatest rate, tokens, mean of the partitions' mean counts and of their
    documents, and the number of partitions."""
    rate = "utilization_rate"
    return util.groupBy("rep").agg(F.avg(rate).alias("avg_rate"), F.stddev_samp(rate).alias("std_rate"), F.min(rate).alias("min_rate"), F.max(rate).alias("max_rate"), F.sum("count_sum").alias("total_count"), F.avg("count_mean").alias("avg_count"), F.avg("utilized_docs").alias("avg_docs"), F.count("*").alias("n_partitions"))


def repetition_extremes(reps: DataFrame) -> DataFrame:
    """The repetitions with the best and the worst mean rate and the most and fewest tokens (the first of equals)."""
    first = lambda by: F.min_by("rep", F.struct(by, F.col("rep")))
    return reps.agg(first(-F.col("avg_rate")).alias("best_rate"), first(F.col("avg_rate")).alias("worst_rate"), first(-F.col("total_count")).alias("most_tokens"), first(F.col("total_count")).alias("fewest_tokens"))


def _value(column: str) -> Column:
    """A number, null where it isn't one."""
    number = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(number), number)


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float], ranges: int = 1024) -> DataFrame:
    """column_name, share, value: linearly interpolated quantiles, null and NaN left out; empty columns have none.

    Values are counted, cut into ranges at approximate quantiles, and only the ranges that hold a wanted place are
    ordered: no task sees a whole column, however many values it has.
    """
    steps = F.expr(f"array({','.join(f'{k / ranges!r}D' for k in range(1, ranges))})")
    found = df.agg(*(c for k, x in enumerate(columns) for c in (F.percentile_approx(_value(x), steps, F.lit(10 * ranges)).alias(f"q{k}"), F.count(_value(x)).alias(f"n{k}")))).first()
    places = []
    for k, c in enumerate(columns):
        for p in shares if found[f"n{k}"] else ():
            at = p * (found[f"n{k}"] - 1)
            low = math.floor(at)
            places += [(c, p, low, 1 - (at - low))] + ([(c, p, low + 1, at - low)] if at > low else [])
    wanted = F.broadcast(df.sparkSession.createDataFrame(places, "column_name string, share double, place long, weight double"))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), _value(c).alias("v")) for c in columns)))
    counts = df.select(each.alias("e")).select("e.*").where("v is not null").groupBy("column_name", "v").agg(F.count("*").alias("n"))
    part = F.lit(0)
    for k, c in enumerate(columns):
        part = F.when(F.col("column_name") == c, ranges_below(F.col("v"), sorted({s for s in found[f"q{k}"] or [] if math.isfinite(s)}))).otherwise(part)
    parted = counts.withColumn("part", part)
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = parted.groupBy("column_name", "part").agg(F.sum("n").alias("total")).withColumn("before", before(W.partitionBy("column_name").orderBy("part"), "total"))
    held = sums.join(wanted, "column_name").where("before <= place and place < before + total").select("column_name", "part", "before").distinct()
    ordered = parted.join(F.broadcast(held), ["column_name", "part"])  # two ranges at most for each place wanted
    ordered = ordered.withColumn("first", F.col("before") + before(W.partitionBy("column_name", "part").orderBy("v"), "n"))
    met = ordered.join(wanted, "column_name").where("first <= place and place < first + n")
    return met.groupBy("column_name", "share").agg(F.sum(F.col("v") * F.col("weight")).alias("value"))


def column_stats(df: DataFrame, columns: list[str], metrics: list[str] | str = "all") -> DataFrame:
    """column_name and the metrics asked for, a row for each column: exact, with linearly interpolated quantiles and
    the sample deviation; null and NaN are left out."""
    names = ALL if metrics == "all" else [ALIASES.get(m, m) for m in metrics]
    if unknown := [m for m in names if m not in ALL]:
        raise ValueError(f"no such metrics: {unknown}")
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no such columns: {missing}")
    simple, shares = [m for m in names if m in METRICS], sorted({QUANTILES[m] for m in names if m in QUANTILES})
    wide = df.agg(F.lit(1).alias("one"), *(METRICS[m](_value(c)).alias(f"{k}__{m}") for k, c in enumerate(columns) for m in simple))
    rows = [F.struct(F.lit(c).alias("column_name"), *(F.col(f"{k}__{m}").cast("double").alias(m) for m in simple)) for k, c in enumerate(columns)]
    out = wide.select(F.explode(F.array(*rows)).alias("e")).select("e.*")
    if shares:
        q = exact_quantiles(df, columns, shares).groupBy("column_name").agg(*(F.max(F.when(F.col("share") == p, F.col("value"))).alias(f"q{k}") for k, p in enumerate(shares)))
        out = out.join(q, "column_name", "left")
    return out.select("column_name", *(F.col(f"q{shares.index(QUANTILES[m])}").alias(m) if m in QUANTILES else F.col(m) for m in names))


def validated(df: DataFrame, required: list[str]) -> DataFrame:
    """``df`` if it has all columns asked for."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def set_bits(mask: Column) -> Column:
    """The number of ones in a mask."""
    return F.length(F.replace(mask, F.lit("0"), F.lit("")))


def cumulative_timing(measured: DataFrame) -> DataFrame:
    """batch, phase, seconds, total: what each phase took in a batch and in all batches up to it, from
    measured(batch, phase, seconds), summed within a batch. A row for each batch and phase meets in a task per phase."""
    per = measured.groupBy("batch", "phase").agg(F.sum("seconds").alias("seconds"))
    return per.withColumn("total", F.sum("seconds").over(W.partitionBy("phase").orderBy("batch").rowsBetween(W.unboundedPreceding, 0)))


def latency_means(log: DataFrame) -> DataFrame:
    """metric, n, mean of the latency log's columns, what wasn't measured (-1) left out; null where nothing was."""
    names = [c for c in log.columns if c != "qid"]
    some = lambda c: F.when(F.col(c) >= 0, F.col(c))
    wide = log.agg(*(F.struct(F.lit(c).alias("metric"), F.count(some(c)).alias("n"), F.avg(some(c)).alias("mean")).alias(f"m{k}") for k, c in enumerate(names)))
    return wide.select(F.explode(F.array(*(f"m{k}" for k in range(len(names))))).alias("e")).select("e.*")


def timing_report(timings: dict[str, float], docs: int, reps: int) -> list[tuple[str, float, float, float, float]]:
    """phase, seconds, percent, milliseconds a document and a repetition, slowest phase first."""
    total = sum(timings.values()) or 1.0
    return [(k, v, 100 * v / total, 1000 * v / max(1, docs), 1000 * v / max(1, reps)) for k, v in sorted(timings.items(), key=lambda x: -x[1])]
