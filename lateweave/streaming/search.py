"""Search over a stream of queries: each micro-batch is encoded, searched and re-ranked as one batch query.

Results don't depend on where micro-batches are cut. A batch that is run again after a failure replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.shared import exists
from ..operators.encode import blocks
from ..operators.search import fde_scores, rerank, topk
from ..plans.config import FdeConfig


def answer(qtokens: DataFrame, tokens: DataFrame, docs: DataFrame, cfg: FdeConfig, candidates: int, k: int) -> DataFrame:
    """qid, doc_id, score, rank, stage: first stage over document blocks, then Chamfer over what was found."""
    q = blocks(qtokens.select("qid", F.col("qtok").alias("tok"), "vec"), cfg.query(), "qid")
    return rerank(topk(fde_scores(q, docs, cfg.width), candidates), qtokens, tokens, k=k)


def search_stream(qtokens: DataFrame, tokens: DataFrame, docs: DataFrame, cfg: FdeConfig, out: str, checkpoint: str, candidates: int = 100, k: int = 10, available_now: bool = True) -> StreamingQuery:
    """Answers a stream of qtokens(qid, qtok, vec) into Parquet at ``out``, one folder for each micro-batch.

    A query's tokens must arrive in one micro-batch (one file, or one message of an array). A batch with a query that
    an earlier batch answered is an error, as part of its tokens would be answered apart. ``available_now`` stops after
    all that is there; else the stream goes on.
    """

    def one(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            if exists(batch.sparkSession, out):
                before = batch.sparkSession.read.schema("qid long, batch long").parquet(out).where(F.col("batch") < number)
                if twice := [r[0] for r in before.select("qid").distinct().join(held.select("qid").distinct(), "qid").limit(5).collect()]:
                    raise ValueError(f"queries over several micro-batches: {twice}")
            answer(held, tokens, docs, cfg, candidates, k).write.mode("overwrite").parquet(f"{out}/batch={number}")
        finally:
            held.unpersist()

    writer = qtokens.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def query_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """qtokens from Parquet files as they come, so many at a time."""
    return spark.readStream.schema("qid long, qtok long, vec array<double>").option("maxFilesPerTrigger", files_per_batch).parquet(path)


def waits(requests: DataFrame, batch: str = "1 minute") -> DataFrame:
    """qid, batch_start, wait_s, batch_size, shared_s of requests(qid, ts, seconds): a batch takes what was enqueued in
    the interval before it starts; a request waits from its ts to that start, and shares the batch's time evenly."""
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("batch_start", F.window("ts", batch)["end"])
    per = timed.groupBy("batch_start").agg(F.count("*").alias("batch_size"), (F.sum("seconds") / F.count("*")).alias("shared_s"))
    wait = F.unix_micros("batch_start") - F.unix_micros("ts")
    return timed.join(per, "batch_start").select("qid", "batch_start", (wait / 1e6).alias("wait_s"), "batch_size", "shared_s")


def latencies(events: DataFrame, watermark: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """window_start, kind, n, mean_value of events(ts, event_type, value) by event time; late rows beyond the watermark
    are left out of a stream and counted in a batch."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", watermark)
    got = timed.groupBy(F.window("ts", window).alias("w"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return got.select(F.col("w.start").alias("window_start"), "kind", "n", "mean_value")
