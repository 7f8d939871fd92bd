"""Tables as bags of tokens, queries and judgements, and the readers and samplers around them."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import doubles, literal


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bag_tokens(embeddings: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, tok, vec, label from one vector a row: ``size`` vectors of consecutive ids are a bag."""
    return embeddings.select(F.expr(f"vec_id div {size}").alias("doc_id"), F.expr(f"vec_id % {size}").alias("tok"), doubles(F.col("embedding")).alias("vec"), "label")


def split_queries(tokens: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """Query tokens(qid, qtok, vec): the bags of the first ``n`` ids; and the other bags' tokens(doc_id, tok, vec)."""
    q = tokens.where(F.col("doc_id") < n).select(F.col("doc_id").alias("qid"), F.col("tok").alias("qtok"), "vec")
    return q, tokens.where(F.col("doc_id") >= n).select("doc_id", "tok", "vec")


def as_tokens(qtokens: DataFrame) -> DataFrame:
    """Query tokens under the names that encoders read (qid, tok, vec)."""
    return qtokens.select("qid", F.col("qtok").alias("tok"), "vec")


def majority_labels(tokens: DataFrame) -> DataFrame:
    """doc_id, label: the most frequent label of a bag, the smallest of equals."""
    n = tokens.groupBy("doc_id", "label").agg(F.count("*").alias("n"))
    return n.groupBy("doc_id").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"))


def label_qrels(tokens: DataFrame, n: int = 10) -> DataFrame:
    """qid, doc_id, rel = 1 where a query bag and another bag have the same majority label.

    An equi-join of the (few, stated) queries with all bags on the label.
    """
    labels = majority_labels(tokens)
    q = labels.where(F.col("doc_id") < n).select(F.col("doc_id").alias("qid"), F.col("label").alias("q_label"))
    d = labels.where(F.col("doc_id") >= n)
    return d.join(q, F.col("label") == F.col("q_label")).select("qid", "doc_id", F.lit(1).alias("rel"))


# Readers


#: Names that each column of a judgement file may have.
QRELS_NAMES = {"qid": ("query-id", "qid", "query_id"), "doc_id": ("corpus-id", "docid", "doc_id"), "score": ("score", "label")}


def read_qrels(spark: SparkSession, path: str, binary: bool = True) -> DataFrame:
    """qid, doc_id, rel from a tab-separated file with a header; rows without a whole number above 0 are left out.

    The header may use any of ``QRELS_NAMES``. binary: every judgement counts 1, else its own number.
    """
    rows = spark.read.csv(path, sep="\t", header=True, mode="PERMISSIVE")
    return clean_qrels(rows, binary)


def clean_qrels(rows: DataFrame, binary: bool = True) -> DataFrame:
    """:func:`read_qrels` of rows already read."""
    cols = []
    for names in QRELS_NAMES.values():
        there = [F.col(f"`{n}`") for n in names if n in rows.columns]
        if not there:
            raise ValueError(f"none of the columns {names}")
        cols.append(F.coalesce(*there))
    q, d, s = cols
    rel = F.expr("try_cast(trim(__s) as int)")
    got = rows.select(q.cast("string").alias("qid"), d.cast("string").alias("doc_id"), s.cast("string").alias("__s")).withColumn("rel", rel)
    return got.where("qid is not null and doc_id is not null and rel > 0").select("qid", "doc_id", F.lit(1).alias("rel") if binary else F.col("rel"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, title, text from JSON lines with ``_id``, ``title`` and ``text``."""
    return spark.read.schema("_id string, title string, text string").json(path).select(F.col("_id").alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """qid, text from JSON lines with ``_id`` and ``text``."""
    return spark.read.schema("_id string, text string").json(path).select(F.col("_id").alias("qid"), F.coalesce("text", F.lit("")).alias("text"))


def read_collection(spark: SparkSession, folder: str, split: str = "test", binary: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus, queries and judgements of a folder with corpus.jsonl, queries.jsonl and qrels/{split}.tsv; queries
    without a judgement in that split are left out."""
    qrels = read_qrels(spark, f"{folder}/qrels/{split}.tsv", binary)
    judged = qrels.select("qid").distinct()
    return read_corpus(spark, f"{folder}/corpus.jsonl"), read_queries(spark, f"{folder}/queries.jsonl").join(judged, "qid", "left_semi"), qrels


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, or by its suffix a TSV, types inferred."""
    return spark.read.csv(path, header=True, inferSchema=True, sep="\t" if path.rstrip("/").endswith(".tsv") else ",")


# Samples


def first_n(df: DataFrame, n: int, order: str = "qid") -> DataFrame:
    """The first ``n`` rows in order; 0: all. The feature is the limit; a heap of n rows a task finds it."""
    return df if n == 0 else df.orderBy(order).limit(n)


def query_sample(queries: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` queries drawn with replacement, as qid ``{id}__rep{i}``; queries(qid, ..) are a stated, small set."""
    total = queries.count()
    if not total:
        return queries.limit(0).withColumn("qid", F.col("qid").cast("string"))
    draw = random.Random(seed)
    drawn = [draw.randrange(total) for _ in range(n)]
    numbered = queries.withColumn("__at", (F.row_number().over(W.orderBy("qid")) - 1).cast("long"))
    picks = queries.sparkSession.range(n).select(F.col("id").alias("__i"), F.get(literal(drawn, "bigint"), F.col("id").cast("int")).alias("__pick"))
    joined = picks.join(numbered, F.col("__pick") == F.col("__at"))
    qid = F.concat_ws("__rep", F.col("qid").cast("string"), F.col("__i").cast("string"))
    return joined.withColumn("qid", qid).select(*queries.columns)


def sample_qrels(sample: DataFrame, qrels: DataFrame) -> DataFrame:
    """Judgements of sampled queries, inherited from the query each was drawn from."""
    base = F.split("qid", "__rep", 2)[0]
    s = sample.select(F.col("qid").alias("sampled"), base.alias("base")).distinct()
    return qrels.join(s, F.col("qid").cast("string") == F.col("base")).select(F.col("sampled").alias("qid"), "doc_id", "rel")


# Cached rows


def query_key(qid: Column, text: Column) -> Column:
    """The key of a query's cached encoding."""
    return F.sha1(F.concat_ws("||", qid.cast("string"), text).cast("binary"))


def folder_key(settings: str) -> str:
    """A short name for a folder that holds what was made with these settings."""
    import hashlib

    return hashlib.md5(settings.encode()).hexdigest()[:10]


def missing(wanted: DataFrame, cached: DataFrame, key: str, dimension: int | None = None, vec: str = "vec") -> DataFrame:
    """Rows of ``wanted`` whose key isn't cached, or only with a vector of another length."""
    good = cached if dimension is None else cached.where(F.size(vec) == dimension)
    return wanted.join(good.select(key).distinct(), key, "left_anti")


def resolve(keys: DataFrame, sources: list[DataFrame], key: str) -> DataFrame:
    """The rows of the first source that has a key, for every key: external before internal before newly made."""
    out, left = None, keys.select(key).distinct()
    for s in sources:
        got = s.join(left, key, "left_semi")
        out = got if out is None else out.unionByName(got)
        left = left.join(s.select(key).distinct(), key, "left_anti")
    if out is None:
        raise ValueError("no source")
    return out
