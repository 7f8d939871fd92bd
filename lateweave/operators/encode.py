"""Fixed-dimensional encodings of bags of tokens.

The working form is blocks(id, rep, part, cnt, vec): one row for each non-empty (or filled) partition. Sums and means
of vectors are one aggregate buffer per value, combined on the map side, so that a bag of any size costs its tokens
once and the shuffle carries encodings and not tokens.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import broadcast_if, elementwise, hamming, literal, parities, plus, scaled, squared_distance, with_bit
from ..plans.config import Encoding, FdeConfig, Fill, count_sketch, target_bits
from .partition import by_centers, partitioned


def blocks(tokens: DataFrame, cfg: FdeConfig, id_col: str = "doc_id", together: bool = False) -> DataFrame:
    """id, rep, part, cnt, vec of every bag. Filled partitions have cnt 0. A bag without tokens has no row.

    together: tokens are dealt out by bag, once. All blocks of a bag then are in one task, where its scores add up and
    compete without another shuffle; for bags of the length that encoders give. Else a bag of any size spreads.

    Tokens with equal bits are combined first. Only where partitions are filled, what a repetition of a bag has (at
    most one entry per partition) is then brought together.
    """
    keys = [id_col, "rep"]
    t = partitioned(tokens.repartition(id_col) if together else tokens, cfg, id_col)
    how = "sum" if cfg.encoding is Encoding.SUM else "avg"
    if cfg.fill is Fill.NONE:
        return t.groupBy(*keys, "part").agg(F.count("*").alias("cnt"), elementwise(how, "x", cfg.width).alias("vec"))
    first = [F.min_by(F.struct("tok", "x"), F.col("tok")).alias("first")] if cfg.fill is Fill.NEAREST else []
    top = [elementwise("max", "x", cfg.width).alias("top")] if cfg.fill is Fill.TIE_MAX else []
    alike = t.groupBy(*keys, "part", "raw").agg(F.count("*").alias("n"), elementwise("sum", "x", cfg.width).alias("total"), *first, *top)
    held = alike.groupBy(*keys).agg(F.collect_list(F.struct(*(c for c in alike.columns if c not in keys))).alias("has"))
    targets = literal([target_bits(cfg, p) for p in range(cfg.partitions)], "bigint")
    zeros = F.array_repeat(F.lit(0.0), cfg.width)
    total = lambda some: F.aggregate(some, zeros, lambda s, e: plus(s, e["total"]))
    count = lambda some: F.aggregate(some, F.lit(0).cast("long"), lambda s, e: s + e["n"])
    part = F.col("part")
    near = F.array_min(F.transform("has", lambda e: hamming(e["raw"], F.get(targets, part))))
    own = F.filter("has", lambda e: e["part"] == part)
    ties = F.filter("has", lambda e: hamming(e["raw"], F.get(targets, part)) == F.col("near"))
    if cfg.fill is Fill.NEAREST:
        filler = F.array_min(F.transform(ties, lambda e: e["first"]))["x"]
    elif cfg.fill is Fill.TIE_MEAN:
        filler = scaled(total(ties), F.lit(1.0) / count(ties))
    else:
        filler = F.aggregate(ties, F.array_repeat(F.lit(float("-inf")), cfg.width), lambda s, e: F.zip_with(s, e["top"], lambda x, y: F.greatest(x, y)))
    every = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(cfg.partitions - 1)))).withColumn("near", near).withColumn("own", own)
    mean = scaled(total(F.col("own")), F.lit(1.0) / count(F.col("own"))) if how == "avg" else total(F.col("own"))
    return every.select(*keys, "part", count(F.col("own")).alias("cnt"), F.when(F.size("own") > 0, mean).otherwise(filler).alias("vec"))


def ablated_blocks(tokens: DataFrame, cfg: FdeConfig, settings: list[tuple[int, int | None, int]], id_col: str = "doc_id") -> DataFrame:
    """run, id, rep, part, cnt, vec for settings (run, forced bit or None, value), from one pass over the tokens.

    A forced bit maps the bits of a token to another partition, so tokens of equal bits are combined once and only their
    sums are dealt out to the settings. Empty partitions stay empty. Tokens are dealt out by bag, once.
    """
    if cfg.fill is not Fill.NONE:
        raise ValueError("filled encodings are ablated one setting at a time")
    t = partitioned(tokens.repartition(id_col), cfg, id_col)
    alike = t.groupBy(id_col, "rep", "raw").agg(F.count("*").alias("n"), elementwise("sum", "x", cfg.width).alias("total"))
    raw = F.col("raw")
    codes = [F.struct(F.lit(run).alias("run"), parities(raw if bit is None else with_bit(raw, cfg.bits, bit, value)).cast("int").alias("part")) for run, bit, value in settings]
    dealt = alike.select(id_col, "rep", "n", "total", F.explode(F.array(*codes)).alias("to")).select("to.*", id_col, "rep", "n", "total")
    found = dealt.groupBy("run", id_col, "rep", "part").agg(F.sum("n").alias("cnt"), elementwise("sum", "total", cfg.width).alias("vec"))
    return found if cfg.encoding is Encoding.SUM else found.withColumn("vec", scaled(F.col("vec"), 1.0 / F.col("cnt")))


def center_blocks(tokens: DataFrame, centers: np.ndarray, encoding: Encoding = Encoding.AVERAGE, fill: bool = False, id_col: str = "doc_id", components: np.ndarray | None = None) -> DataFrame:
    """As :func:`blocks` with partitions around [reps, partitions, values] centers. If ``fill``, an empty partition gets
    the bag's token nearest to its center (the smallest tok of equals)."""
    width = centers.shape[2]
    t = by_centers(tokens, centers, id_col, components)
    how = "sum" if encoding is Encoding.SUM else "avg"
    found = t.groupBy(id_col, "rep", "part").agg(F.count("*").alias("cnt"), elementwise(how, "x", width).alias("vec"))
    if not fill:
        return found
    # The nearest token of each of the (few) centers is an aggregate too: no bag is gathered.
    each = t.select(id_col, "rep", "tok", "x", F.posexplode(F.get(literal(centers), F.col("rep"))).alias("part", "center"))
    near = each.groupBy(id_col, "rep", "part").agg(F.min_by("x", F.struct(squared_distance(F.col("x"), F.col("center")), F.col("tok"))).alias("near"))
    both = near.join(found, [id_col, "rep", "part"], "left")
    return both.select(id_col, "rep", "part", F.coalesce("cnt", F.lit(0).cast("long")).alias("cnt"), F.coalesce("vec", "near").alias("vec"))


def fde(tokens: DataFrame, cfg: FdeConfig, id_col: str = "doc_id") -> DataFrame:
    """Blocks by the encoding asked for: SUM is a query's (which can't be filled), AVERAGE a document's."""
    if cfg.encoding is Encoding.SUM and cfg.fill is not Fill.NONE:
        raise ValueError("the empty partitions of a query aren't filled")
    return blocks(tokens, cfg, id_col)


def long_form(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, rep, part, dim, val."""
    return found.select(id_col, "rep", "part", F.posexplode("vec").alias("dim", "val"))


def flat_form(found: DataFrame, cfg: FdeConfig, id_col: str = "doc_id") -> DataFrame:
    """id, flat, val: repetitions first, then partitions, then values; zeros of empty partitions left out."""
    flat = (F.col("rep") * cfg.partitions + F.col("part")).cast("long") * cfg.width + F.col("dim")
    return long_form(found, id_col).select(id_col, flat.alias("flat"), "val")


def dense_form(found: DataFrame, cfg: FdeConfig, docs: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """id, fde: the whole encoding as one array, zeros for empty partitions; bags of ``docs`` without tokens are zero.

    At most one entry per partition is gathered for a bag, whatever its size.
    """
    cells = cfg.reps * cfg.partitions
    zeros = F.array_repeat(F.lit(0.0), cfg.width)
    got = found.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct((F.col("rep") * cfg.partitions + F.col("part")).alias("cell"), "vec"))).alias("held"))
    if docs is not None:
        got = docs.select(id_col).distinct().join(got, id_col, "left")
    at = F.sequence(F.lit(0), F.lit(cells - 1))
    return got.select(id_col, F.flatten(F.transform(at, lambda k: F.coalesce(F.try_element_at("held", k), zeros))).alias("fde"))


def partition_counts(tokens: DataFrame, cfg: FdeConfig, docs: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """id, rep, part, cnt: tokens in every partition, zeros kept; bags of ``docs`` without tokens count zeros only."""
    got = partitioned(tokens, cfg, id_col).groupBy(id_col, "rep", "part").agg(F.count("*").alias("n"))
    per = got.groupBy(id_col, "rep").agg(F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("held"))
    if docs is not None:
        reps = docs.select(id_col).distinct().select(id_col, F.explode(F.sequence(F.lit(0), F.lit(cfg.reps - 1))).alias("rep"))
        per = reps.join(per, [id_col, "rep"], "left")
    per = per.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(cfg.partitions - 1))))
    return per.select(id_col, "rep", "part", F.coalesce(F.try_element_at("held", F.col("part")), F.lit(0)).cast("long").alias("cnt"))


def sketched(found: DataFrame, cfg: FdeConfig, id_col: str = "doc_id") -> DataFrame:
    """id, bucket, val: the encoding folded into ``final_dimension`` buckets by a count sketch; empty buckets left out."""
    bucket, sign = count_sketch(cfg.length, cfg.final_dimension, cfg.seed)
    table = parameter_table(found.sparkSession, {"at": np.arange(cfg.length), "bucket": bucket, "sign": sign})
    joined = flat_form(found, cfg, id_col).join(broadcast_if(table, cfg.length, 24), F.col("flat") == F.col("at"))
    return joined.groupBy(id_col, "bucket").agg(F.sum(F.col("sign") * F.col("val")).alias("val"))


def bit_variance(found: DataFrame, cfg: FdeConfig, docs: int, id_col: str = "doc_id") -> DataFrame:
    """rep, local_idx, variance: the population variance of every value over ``docs`` encodings, zeros included.

    Only what isn't zero is read: zeros enter through their number alone.
    """
    local = (F.col("part") * cfg.width + F.col("dim")).alias("local_idx")
    some = long_form(found, id_col).select("rep", local, "val").groupBy("rep", "local_idx").agg(F.count("*").alias("n"), F.avg("val").alias("m"), F.var_pop("val").alias("v"))
    whole = F.lit(float(max(1, docs)))
    variance = F.col("n") * (F.col("v") + F.col("m") * F.col("m") * (whole - F.col("n")) / whole) / whole
    every = found.sparkSession.range(cfg.reps).select(F.col("id").cast("int").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(cfg.partitions * cfg.width - 1))).alias("local_idx"))
    return every.join(some, ["rep", "local_idx"], "left").select("rep", "local_idx", F.coalesce(variance, F.lit(0.0)).alias("variance"))


def bit_selection(found: DataFrame, cfg: FdeConfig, docs: int, ratio: float = 0.5, id_col: str = "doc_id") -> DataFrame:
    """rep, local_idx, global_idx, variance of the most varying share of each repetition's values, the later of equals."""
    size = cfg.partitions * cfg.width
    ranked = bit_variance(found, cfg, docs, id_col).withColumn("place", F.row_number().over(W.partitionBy("rep").orderBy(F.desc("variance"), F.desc("local_idx"))))
    return ranked.where(F.col("place") <= int(size * ratio)).select("rep", "local_idx", (F.col("rep") * size + F.col("local_idx")).cast("long").alias("global_idx"), "variance")


def selected(found: DataFrame, chosen: DataFrame, cfg: FdeConfig, id_col: str = "doc_id") -> DataFrame:
    """id, flat, val of the chosen values only, for documents and queries alike."""
    keep = broadcast_if(chosen.select(F.col("global_idx").alias("flat")), cfg.length, 8)
    return flat_form(found, cfg, id_col).join(keep, "flat", "left_semi")


def parameter_table(spark: SparkSession, columns: dict[str, np.ndarray]) -> DataFrame:
    """A small table of settings, built on the driver."""
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame(columns))
