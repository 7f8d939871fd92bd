"""Mixing sources to target weights.

Every document gets a hash-random key of its id and text. Within a source, documents are ordered by key: the key's leading digits deal
them out to ranges (equally full, as the key is a digest), each range sums its words, prefix sums over the ranges of a
source and then within a range place every document, and the source is cut at its exact budget. A budget beyond the
source's size repeats it in whole epochs. The order depends on nothing but (seed, doc_id, text), so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut

BLANKS = r"[\x20\x09-\x0D]+"

#: A range is the key's first hex digits: three (4096 ranges a source), more if a range had more rows than this.
RANGE_ROWS = 1 << 21


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target from source, source_size.

    Sources in code point order, null last, take ``weights`` in turn and share ``share`` of all sizes. A target stops
    at ``most`` times its source's size and the excess goes to the others by weight, until none is above: with sources
    by size over weight, the first ones are capped and all others get the same multiple of their weight. If all are
    capped (``share`` of ``most`` or more), each has ``most`` times its size.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    up = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before, all_ = up.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    t = sizes.select("source", "source_size", weight.alias("w"))
    t = t.select("*", (F.lit(most) * F.col("source_size")).alias("cap")).select("*", (F.col("cap") / F.col("w")).alias("ratio"))
    rest = F.lit(share) * F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    t = t.select("*", (rest / (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0)))).alias("level"))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct(F.col("ratio"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(all_)["level"]
    return t.select("source", "source_size", F.least("cap", F.coalesce(level, F.lit(float("inf"))) * F.col("w")).alias("target"))


def mix(df: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, a row for each row of ``df``.

    taken is the number of the document's words in the mix, repeats counted; the document at a source's cut gives only
    the words up to it, so the words taken of a source are its target, rounded. Null and empty texts have size 0 and
    give nothing. A null source is a source of its own, a null id hashes as ``null``. The text is part of
    the key, so rows of one id or of none spread over the ranges; rows that tie in id and text share their places in
    any order. An empty table gives no row.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")), F.md5(text)))
    docs = cut(df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"), key.alias("key")))
    digits = max(3, math.ceil(math.log(max(1, docs.count()) / RANGE_ROWS, 16)))
    docs = docs.withColumn("range", F.substring("key", 1, digits))
    ranges = docs.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    per_source = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, most)
    so_far = F.coalesce(F.sum("range_size").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    per_range = ranges.select("source", "range", so_far.alias("range_from")).join(per_source.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), F.col("range").alias("r"), "range_from", "source_size", "target", budget.alias("budget"))
    within = F.coalesce(F.sum("size").over(W.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = docs.select("*", within.alias("within")).join(per_range, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0)
    last = F.col("budget") - epochs * F.col("source_size") - F.col("range_from") - F.col("within")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), last))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(df: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of ``df`` with all their columns, each as often as the mix takes it whole, and once more,
    cut after its last word taken, where the budget ends within it. Documents of no word aren't taken. Rows that agree
    in id, source and size share what the mix takes of them: all of them whole, as often as it goes, then one by one in
    the order of their texts' hashes."""
    keys = ["__id", "__source", "__size"]
    t = mix(df, weights, share, most, seed, id_col, text_col, source_col).where("size > 0")
    t = t.groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size")).agg(F.count("*").alias("__rows"), F.sum("taken").alias("__taken")).where("__taken > 0")
    text = F.col(f"`{text_col}`")
    at = df.withColumn("__words", word_count(text))
    got = at.join(t, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & F.col(f"`{source_col}`").eqNullSafe(F.col("__source")) & (F.col("__words") == F.col("__size")))
    placed = got.where("__rows = 1").withColumn("__place", F.lit(1))
    if not t.where("__rows > 1").isEmpty():
        order = W.partitionBy(*keys).orderBy(F.xxhash64(text))
        placed = placed.union(got.where("__rows > 1").withColumn("__place", F.row_number().over(order)))
    rest = "__taken % (__rows * __size)"
    whole = F.expr(f"cast(__taken div (__rows * __size) + if(__place <= ({rest}) div __size, 1, 0) as int)")
    part = F.expr(f"cast(if(__place = ({rest}) div __size + 1, ({rest}) % __size, 0) as int)")
    copies = F.concat(F.array_repeat(F.lit(0), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    out = placed.withColumn("__part", F.explode(copies))
    return out.withColumn(text_col, F.when(F.col("__part") == 0, text).otherwise(first_words(text, F.col("__part")))).select(*(F.col(f"`{c}`") for c in df.columns))


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its n-th word, blanks as they are; it has more than n words, and n is at least 1."""
    # Split after n words (one piece more if blanks lead), the last piece is what follows.
    after = F.element_at(F.split(text, BLANKS, n + 1 + F.regexp_like(text, F.lit(f"^{BLANKS}")).cast("int")), -1)
    return F.regexp_replace(F.left(text, F.length(text) - F.length(after)), f"{BLANKS}$", "")
