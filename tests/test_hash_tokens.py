"""The hash encoder: its values for short and long vectors, and that ``hash_encoder`` makes them all in compiled code."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lateweave.queries import QUERIES
from lateweave.sources import encoders


@pytest.mark.parametrize(("dimension", "first"), [(3, [-0.681984521476, 0.193572479157, 0.705284912486]), (20, [-0.293932352565, 0.083428893764, 0.303974719407])])
def test_values(spark, dimension, first):
    rows = encoders.hash_tokens(spark.createDataFrame([(1, "  B\x0bb\t\n")], "doc_id long, text string"), dimension).orderBy("tok").collect()
    assert [r["tok"] for r in rows] == [0, 1]
    assert all(len(r["vec"]) == dimension and r["vec"][:3] == pytest.approx(first, abs=1e-11) for r in rows)


def test_zero_stays_zero(spark):
    got = encoders.hash_tokens(spark.range(20_000).select("id", F.col("id").cast("string").alias("text")), 1, id_col="id")
    counts = {r["v"]: r["count"] for r in got.groupBy(F.abs(F.col("vec")[0]).alias("v")).count().collect()}
    assert set(counts) == {0.0, 1.0} and sum(counts.values()) == 20_000


def test_every_value_is_made_in_compiled_code(spark, folder):
    plan = QUERIES["hash_encoder"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan
    assert all(f"xxhash64(42, {k}, word" in plan for k in range(8))
