from __future__ import annotations

import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parent.parent))
from cases import documents, empty, odd, prose
from oracle import database, same

from lateweave.llm import mixing
from lateweave.llm.queries import ORACLES, QUERIES

SIZE = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def filled(sizes: dict, share: float = 1.5, most: float = 2.0) -> dict:
    """Targets by taking out what is above its cap, again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, fixed = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        total = sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / total > most * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / total for s in rest}
        for s in over:
            fixed[s] = most * sizes[s]
        left = share * sum(sizes.values()) - sum(fixed.values())


def test_same_as_sql(spark, folder):
    found = QUERIES["op1_source_mixing"](spark, folder).toArrow()
    same(found, database(folder).execute(ORACLES["op1_source_mixing"]).to_arrow_table())


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 500}, {"a": 1, "b": 1, "c": 1}, {"a": 0, None: 50}, {"z": 7}, {"a": 5, "b": 900, "c": 5, "d": 5, "e": 100, None: 30}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got == pytest.approx(filled(sizes))


def test_all_sources_capped(spark):
    df = documents(spark, [(k, prose(k, 10), "en", "ab"[k % 2]) for k in range(8)] + [(9, None, "en", None)])
    for share in (2.0, 3.0):
        rows = mixing.mix(df, share=share, most=2.0).collect()
        assert all(r["target"] == 2 * r["source_size"] and r["taken"] == 2 * r["size"] for r in rows)
    assert sum(r["taken"] for r in rows) == 160


def test_cut_texts_keep_their_blanks(spark):
    texts = ["a\n\nb\tc d\ne", "  a\x0b b  c", "x y", "\ta b"]
    df = spark.createDataFrame([(t, n) for t in texts for n in range(1, SIZE(t))], "t string, n int")
    for r in df.select("t", "n", mixing.first_words(F.col("t"), F.col("n")).alias("got")).collect():
        want = re.match(r"[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]*){%d}" % r["n"], r["t"]).group().rstrip(" \t\n\x0b\x0c\r")
        assert r["got"] == want


def test_budgets_and_reruns(spark, folder):
    df = spark.read.parquet(f"{folder}/documents.parquet")
    rows = mixing.mix(df).collect()
    by = defaultdict(int)
    for r in rows:
        assert r["taken"] <= 2 * r["size"]
        by[r["source"]] += r["taken"]
    want = filled({s: sum(r["size"] for r in rows if r["source"] == s) for s in by})
    assert {s: n for s, n in by.items()} == {s: int(t + 0.5) for s, t in want.items()}
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}


def test_the_mix_holds_what_was_taken(spark):
    rows = [(k, prose(k, 10 + k % 7), "en", "big" if k < 40 else "small") for k in range(50)]
    df = documents(spark, rows)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(df).collect()}
    out = mixing.mixed(df)
    assert out.columns == df.columns
    got = Counter()
    text = {r[0]: r[1] for r in rows}
    for r in out.collect():
        got[r["doc_id"]] += SIZE(r["text"])
        assert text[r["doc_id"]].startswith(r["text"])
    assert got == Counter({k: v for k, v in taken.items() if v})


def test_rows_that_repeat_share_what_is_taken(spark):
    rows = [(1, "a b c", "en", "s")] * 3 + [(1, "x y z", "en", "s"), (2, "d e f g", "en", "s"), (3, prose(1, 90), "en", "t")]
    df = documents(spark, rows)
    taken = Counter()
    for r in mixing.mix(df).collect():
        taken[r["doc_id"]] += r["taken"]
    got = Counter()
    for r in mixing.mixed(df).collect():
        got[r["doc_id"]] += SIZE(r["text"])
    assert got == Counter({k: v for k, v in taken.items() if v}) and sum(got.values()) > 100


def test_odd_rows(spark):
    rows = mixing.mix(odd(spark)).collect()
    assert len(rows) == odd(spark).count()
    assert all(r["size"] == 0 and r["taken"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    assert mixing.mixed(odd(spark)).columns == odd(spark).columns
    assert mixing.mix(empty(spark)).count() == mixing.mixed(empty(spark)).count() == 0
