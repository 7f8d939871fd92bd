"""The full ranking holds every pair of a query and a document."""

from __future__ import annotations

import numpy as np

from lateweave.operators import search
from lateweave.queries import QUERIES, Scene


def test_every_pair_is_ranked(spark, tmp_path):
    """Bags of one direction, a document that shares no partition with a query among them."""
    rng = np.random.default_rng(8)
    rows = [(5 * bag + t, (rng.normal(0, 0.05, 64) + v).tolist(), bag % 10) for bag in range(30) for v in [rng.normal(0, 1, 64)] for t in range(5)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    met = {(r["qid"], r["doc_id"]) for r in Scene(spark, str(tmp_path)).scores().collect()}
    rows = QUERIES["fde_full_ranking"](spark, str(tmp_path)).collect()
    assert len(rows) == 10 * 20 > len(met)
    assert all(r["score"] == 0 for r in rows if (r["qid"], r["doc_id"]) not in met)
    for q in range(10):
        mine = sorted((r for r in rows if r["qid"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert [r["score"] for r in mine] == sorted((r["score"] for r in mine), reverse=True)


def test_ranks_over_ranges(spark):
    """Ties and few distinct scores, in more ranges than there are rows of some queries."""
    rng = np.random.default_rng(1)
    rows = [(q, d, float(rng.integers(0, 5)) if q else 0.0) for q in range(3) for d in range(1 + 200 * q)]
    df = spark.createDataFrame(rows, "qid long, doc_id long, score double")
    want = {(r["qid"], r["doc_id"]): r["rank"] for r in search.topk(df, None).collect()}
    assert {(r["qid"], r["doc_id"]): r["rank"] for r in search.full_ranking(df, 16).collect()} == want
