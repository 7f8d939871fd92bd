"""Operators against NumPy written from their definitions, and edge cases."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lateweave.functions.vectors import checked_local
from lateweave.operators import encode, experiments, index, metrics, search, stats
from lateweave.operators.partition import partitioned
from lateweave.plans import config
from lateweave.plans.config import Encoding, FdeConfig, Fill, Projection
from lateweave.sources import encoders, store, tables
from lateweave.streaming import search as streaming

CFG = FdeConfig(dimension=6, reps=2, bits=3, seed=5)


def bags_of(spark, bags: dict[int, np.ndarray], name: str = "doc_id"):
    rows = [(i, t, v.tolist()) for i, x in bags.items() for t, v in enumerate(x)]
    return spark.createDataFrame(rows, f"{name} long, tok long, vec array<double>")


def random_bags(n: int = 12, seed: int = 1, d: int = 6) -> dict[int, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {i: rng.normal(size=(int(rng.integers(1, 9)), d)) for i in range(n)}


def gray_part(x: np.ndarray, planes: np.ndarray) -> tuple[int, int]:
    raw = part = 0
    for hv in planes:
        bit = int(float(x @ hv) > 0)
        raw, part = raw * 2 + bit, (part << 1) + (bit ^ (part & 1))
    return raw, part


def encoded(bag: np.ndarray, cfg: FdeConfig) -> np.ndarray:
    """[reps, partitions, width] by loops."""
    out = np.zeros((cfg.reps, cfg.partitions, cfg.width))
    planes = config.hyperplanes(cfg) if cfg.bits else np.zeros((cfg.reps, 0, cfg.dimension))
    for r in range(cfg.reps):
        x = bag
        if cfg.projection is Projection.AMS:
            column, sign = (a[r] for a in config.ams_columns(cfg))
            m = np.zeros((cfg.dimension, cfg.width))
            m[np.arange(cfg.dimension), column] = sign
            x = bag @ m
        codes = [gray_part(v, planes[r]) for v in bag]
        for p in range(cfg.partitions):
            mine = [k for k, (_, q) in enumerate(codes) if q == p]
            if mine:
                out[r, p] = x[mine].sum(0) if cfg.encoding is Encoding.SUM else x[mine].mean(0)
            elif cfg.fill is not Fill.NONE:
                far = np.array([(raw ^ config.target_bits(cfg, p)).bit_count() for raw, _ in codes])
                ties = x[far == far.min()]
                out[r, p] = {Fill.NEAREST: ties[0], Fill.TIE_MAX: ties.max(0), Fill.TIE_MEAN: ties.mean(0)}[cfg.fill]
    return out


def dense_of(df, name: str = "doc_id") -> dict[int, np.ndarray]:
    return {r[name]: np.array(r["fde"]) for r in df.collect()}


@pytest.mark.parametrize(
    "cfg",
    [
        CFG,
        CFG.document(),
        replace(CFG, bits=0).document(),
        replace(CFG, projection=Projection.AMS, projection_dimension=4).document(),
        *(replace(CFG, bits=b, fill=f, fill_target=t).document() for f in (Fill.NEAREST, Fill.TIE_MAX, Fill.TIE_MEAN) for b, t in ((1, "reference"), (4, "reference"), (4, "canonical"))),
    ],
    ids=lambda c: f"{c.encoding.name}-{c.bits}-{c.projection.name}-{c.fill.name}-{c.fill_target}",
)
def test_encoding(spark, cfg):
    bags = random_bags()
    found = dense_of(encode.dense_form(encode.blocks(bags_of(spark, bags), cfg), cfg))
    assert found.keys() == bags.keys()
    for i, bag in bags.items():
        np.testing.assert_allclose(found[i], encoded(bag, cfg).ravel(), atol=1e-12)


def test_zero_sketch_is_bit_zero_and_lsh_bit_one(spark):
    t = bags_of(spark, {1: np.zeros((1, 6))})
    assert {(r["raw"], r["part"]) for r in partitioned(t, CFG).collect()} == {(0, 0)}
    assert {r["hash"] for r in index.lsh_hashes(t, 6, 4, 2).collect()} == {15}


def test_lsh_of_64_bits(spark):
    bag = np.random.default_rng(3).normal(size=(5, 6))
    planes = config.lsh_planes(6, 64, 2)
    want = {(t, k): sum(int(v @ p >= 0) << (63 - b) for b, p in enumerate(planes[t])) for t in range(2) for k, v in enumerate(bag)}
    found = {(r["table_id"], r["tok"]): r["hash"] & ((1 << 64) - 1) for r in index.lsh_hashes(bags_of(spark, {1: bag}), 6, 64, 2).collect()}
    assert found == want


@given(st.integers(0, 2**31 - 1))
@settings(max_examples=50, deadline=None)
def test_gray(code):
    assert config.gray_decode(code) ^ (config.gray_decode(code) >> 1) == code


def test_targets_agree_up_to_two_bits_only():
    differ = [sum(config.target_bits(replace(CFG, bits=b), p) != config.target_bits(replace(CFG, bits=b, fill_target="canonical"), p) for p in range(1 << b)) for b in range(1, 6)]
    assert differ == [0, 0, 4, 12, 28]


def test_empty_bags_are_zero(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    t = bags_of(spark, {1: np.ones((1, 6))})
    cfg = CFG.document()
    found = dense_of(encode.dense_form(encode.blocks(t, cfg), cfg, docs))
    assert not found[2].any() and found[1].any() and len(found[2]) == cfg.length
    counts = encode.partition_counts(t, cfg, docs).groupBy("doc_id").agg(F.sum("cnt").alias("n"), F.count("*").alias("rows")).collect()
    assert {(r["doc_id"], r["n"], r["rows"]) for r in counts} == {(1, 2, 16), (2, 0, 16)}
    assert encode.blocks(t.limit(0), replace(cfg, fill=Fill.NEAREST)).collect() == []


def test_fill_leaves_used_partitions_and_counts(spark):
    bags = bags_of(spark, random_bags())
    cfg = CFG.document()
    full = {(r["doc_id"], r["rep"], r["part"]): r for r in encode.blocks(bags, replace(cfg, fill=Fill.NEAREST)).collect()}
    for r in encode.blocks(bags, cfg).collect():
        other = full[r["doc_id"], r["rep"], r["part"]]
        assert other["cnt"] == r["cnt"]
        np.testing.assert_allclose(other["vec"], r["vec"], atol=1e-12)
    assert len(full) == 12 * 2 * 8


def test_queries_are_not_filled(spark):
    with pytest.raises(ValueError):
        encode.fde(bags_of(spark, random_bags(1)), replace(CFG, fill=Fill.NEAREST))


@pytest.mark.parametrize("bad", [{"bits": 32}, {"bits": -1}, {"reps": 0}, {"projection": Projection.AMS}, {"fill_target": "x"}, {"forced_bit": 3}, {"final_dimension": -1}])
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        replace(CFG, **bad)


def test_count_sketch_is_linear(spark):
    cfg = replace(CFG, final_dimension=8)
    a, b = random_bags(1, 2)[0], random_bags(1, 3)[0]
    val = {(r["doc_id"], r["bucket"]): r["val"] for r in encode.sketched(encode.blocks(bags_of(spark, {1: a, 2: b, 3: np.concatenate([a, b])}), cfg), cfg).collect()}
    for k in range(8):
        assert abs(val.get((1, k), 0) + val.get((2, k), 0) - val.get((3, k), 0)) < 1e-9


def test_variance_counts_zeros(spark):
    bags, cfg = random_bags(), CFG.document()
    dense = np.stack([encoded(b, cfg).reshape(cfg.reps, -1) for b in bags.values()])
    found = encode.bit_variance(encode.blocks(bags_of(spark, bags), cfg), cfg, len(bags)).collect()
    assert len(found) == dense[0].size
    for r in found:
        assert abs(r["variance"] - dense[:, r["rep"], r["local_idx"]].var()) < 1e-12


def chamfer(q: np.ndarray, d: np.ndarray) -> float:
    return float((q @ d.T).max(1).sum()) if len(d) else search.EMPTY_SCORE


def scene(spark):
    q, d = random_bags(4, 7), random_bags(20, 8)
    qt = bags_of(spark, q, "qid").withColumnRenamed("tok", "qtok")
    return q, d, qt, bags_of(spark, d)


def test_chamfer_both_ways(spark, monkeypatch):
    q, d, qt, t = scene(spark)
    docs = spark.createDataFrame([(i,) for i in [*d, 99]], "doc_id long")
    want = {(i, j): chamfer(q[i], d[j]) for i in q for j in d} | {(i, 99): search.EMPTY_SCORE for i in q}
    for block in (512, 7):
        monkeypatch.setattr(search, "BLOCK", block)
        rows = search.chamfer_all(qt, t.repartition(5), docs).collect()
        assert {(r["qid"], r["doc_id"]): pytest.approx(r["score"]) for r in rows} == want and len(rows) == len(want)
    pairs = spark.createDataFrame(list(want), "qid long, doc_id long")
    rows = search.chamfer(pairs, qt, t).collect()
    assert {(r["qid"], r["doc_id"]): pytest.approx(r["score"]) for r in rows} == want and len(rows) == len(want)


def test_chamfer_with_itself_of_unit_rows(spark):
    x = np.random.default_rng(0).normal(size=(7, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = search.chamfer_all(bags_of(spark, {1: x}, "qid").withColumnRenamed("tok", "qtok"), bags_of(spark, {1: x})).collect()
    assert rows[0]["score"] == pytest.approx(7)


def test_scan_equals_join(spark, monkeypatch):
    _, _, qt, t = scene(spark)
    docs, q = encode.blocks(t, CFG.document()), encode.blocks(tables.as_tokens(qt), CFG, "qid")
    every = qt.select("qid").distinct().join(t.select("doc_id").distinct(), how="cross")
    show = lambda df: sorted((r["qid"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())
    joined = show(search.topk(search.fde_scores(q, docs, 6, every), 5))
    for block in (512, 3):
        monkeypatch.setattr(search, "BLOCK", block)
        assert show(search.scan_topk(encode.dense_form(q, CFG, id_col="qid"), encode.dense_form(docs, CFG), 5)) == joined
    assert search.scan_topk(encode.dense_form(q, CFG, id_col="qid").limit(0), encode.dense_form(docs, CFG), 5).count() == 0


def test_rerank_keeps_ties_and_tail(spark):
    cands = spark.createDataFrame([(1, d, 10.0 - r, r) for r, d in enumerate([5, 3, 9, 7], 1)], "qid long, doc_id long, score double, rank long")
    one = np.ones((1, 6))
    t = bags_of(spark, {3: one, 5: one, 7: 9 * one})
    qt = bags_of(spark, {1: one}, "qid").withColumnRenamed("tok", "qtok")
    got = [(r["doc_id"], r["stage"]) for r in search.rerank(cands, qt, t, n=3).orderBy("rank").collect()]
    assert got == [(5, "rerank"), (3, "rerank"), (9, "rerank"), (7, "tail")]  # 9 has no tokens
    assert [r["doc_id"] for r in search.rerank(cands, qt, t, n=0).orderBy("rank").collect()] == [7, 5, 3, 9]
    assert search.rerank(cands, qt, t, n=3, keep_tail=False).count() == 3


def test_topk_beyond_all_and_ties(spark):
    s = spark.createDataFrame([(1, 4, 1.0), (1, 2, 1.0), (1, 3, 2.0)], "qid long, doc_id long, score double")
    assert [r["doc_id"] for r in search.topk(s, 10).orderBy("rank").collect()] == [3, 2, 4]


def test_full_probe_is_exact_and_recall_grows(spark):
    _, _, qt, t = scene(spark)
    cfg = CFG.document()
    docs, q = encode.blocks(t, cfg), encode.blocks(tables.as_tokens(qt), CFG, "qid")
    centers = index.train_lists(encode.dense_form(docs, cfg), cfg, 3)
    lists = index.assign_lists(centers, docs, 6)
    exact = {(r["qid"], r["doc_id"]) for r in search.topk(search.fde_scores(q, docs, 6), 5).collect()}
    shares = []
    for n in (1, 2, 3):
        got = {(r["qid"], r["doc_id"]) for r in index.ivf_search(q, docs, lists, index.probe_lists(q, centers, 6, n), 6, 5).collect()}
        shares.append(len(got & exact))
    assert shares == sorted(shares) and shares[-1] == len(exact)


@pytest.mark.parametrize(("policy", "n", "want"), [("front", 5, [0, 1]), ("back", 5, [3, 4]), ("stride2", 8, [0, 1, 6, 7]), ("stride2", 1, [0]), ("front", 1, [0]), ("other", 4, [0, 1])])
def test_half_rows(spark, policy, n, want):
    assert sorted(r["tok"] for r in search.half_rows(bags_of(spark, {1: np.ones((n, 6))}), policy).collect()) == want


def test_spans_pack_and_offsets(spark):
    rows = spark.createDataFrame([(1, k) for k in (1, 2, 3, 7, 9, 10, 10)], "doc_id long, tok long")
    assert sorted((r["start"], r["length"]) for r in index.row_spans(rows).collect()) == [(1, 3), (7, 1), (9, 2)]
    bags = random_bags(9)
    got = [(r["row"], r["doc_id"], r["tok"]) for r in index.pack(bags_of(spark, bags), 4).orderBy("row").collect()]
    assert got == [(k, i, t) for k, (i, t) in enumerate((i, t) for i in bags for t in range(len(bags[i])))]


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1), (9, 1, 1)], "qid long, doc_id long, rank long")
    qrels = spark.createDataFrame([(1, 11, 2), (1, 12, 1), (1, 13, 1), (3, 5, 1), (2, 4, 0)], "qid long, doc_id long, rel int")
    got = {r["qid"]: r for r in metrics.per_query(ranked, qrels, 2).collect()}
    assert got.keys() == {1, 3}
    ideal = 3 / np.log2(2) + 1 / np.log2(3)
    assert (got[1]["hit"], got[1]["recall"], got[1]["ndcg"]) == (1, pytest.approx(1 / 3), pytest.approx(3 / np.log2(3) / ideal))
    assert (got[3]["hit"], got[3]["recall"], got[3]["ndcg"]) == (0, 0, 0)
    total = metrics.evaluate(ranked, qrels, (2,)).first()
    assert (total["queries"], total["hit_at_k"]) == (2, 0.5)
    assert metrics.evaluate(ranked, qrels.limit(0), (2,)).first()["ndcg_at_k"] == 0


def test_truth_with_negative_scores(spark):
    truth = spark.createDataFrame([(1, 10, -1.0, 1), (1, 11, -2.0, 2), (2, 10, 3.0, 1)], "qid long, doc_id long, score double, rank long")
    ranked = spark.createDataFrame([(1, 10, 1)], "qid long, doc_id long, rank long")
    got = {r["qid"]: (r["recall"], r["hit"], r["ndcg"]) for r in metrics.per_query_truth(ranked, truth, 2).collect()}
    assert got == {1: (0.5, 1, 0), 2: (0, 0, 0)}
    assert {r["qid"] for r in metrics.per_query_truth(ranked, truth, 2, "system").collect()} == {1}


def test_ideal_order_has_ndcg_one(spark):
    qrels = spark.createDataFrame([(1, k, 5 - k) for k in range(1, 5)], "qid long, doc_id long, rel int")
    ranked = spark.createDataFrame([(1, k, k) for k in range(1, 5)], "qid long, doc_id long, rank long")
    assert metrics.per_query(ranked, qrels, 4).first()["ndcg"] == pytest.approx(1)


def test_unused_partition_has_zero_statistics(spark):
    counts = spark.createDataFrame([(1, 0, 0, 3), (1, 0, 1, 0)], "doc_id long, rep int, part int, cnt long")
    row = stats.partition_utilization(counts).where("part = 1").first()
    assert set(row.asDict().values()) == {0, 1} and row["total_docs"] == 1
    mask = stats.partition_mask(counts, 2).first()
    assert (mask["partition_mask"], mask["active_partition_count"]) == ("10", 1)


def test_column_stats_names(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (None,)], "a double")
    assert stats.column_stats(df, ["a"], ["avg", "med", "count"]).first().asDict() == {"column_name": "a", "mean": 1.5, "median": 1.5, "count": 2}
    for columns, names in ((["b"], "all"), (["a"], ["mode"])):
        with pytest.raises(ValueError):
            stats.column_stats(df, columns, names)


@pytest.mark.parametrize("ranges", [1024, 4])
def test_exact_quantiles(spark, ranges):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=501), np.round(rng.exponential(size=501), 1)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b, strict=True)] + [(float("nan"), None)], "a double, `b c` double")
    shares = [0.0, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {(r["column_name"], r["share"]): r["value"] for r in stats.exact_quantiles(df, ["a", "b c"], shares, ranges).collect()}
    assert got == {(n, p): pytest.approx(float(np.quantile(x, p))) for n, x in (("a", a), ("b c", b)) for p in shares}
    assert stats.exact_quantiles(df.limit(0), ["a"], shares).collect() == []
    assert stats.column_stats(df.limit(0), ["a"]).first()["p95"] is None


def test_bad_judgements_are_left_out(spark, tmp_path):
    p = tmp_path / "qrels.tsv"
    p.write_text("query_id\tdocid\tscore\nq1\td1\t2\nq1\td2\t0\nq2\td3\tx\nq2\td4\n\td5\t1\n")
    assert [tuple(r) for r in tables.read_qrels(spark, str(p)).collect()] == [("q1", "d1", 1)]
    assert [tuple(r) for r in tables.read_qrels(spark, str(p), binary=False).collect()] == [("q1", "d1", 2)]


def test_sources_by_priority_and_bad_lengths(spark):
    a = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "doc_id long, vec array<double>")
    b = spark.createDataFrame([(1, [9.0]), (3, [3.0])], "doc_id long, vec array<double>")
    got = {r["doc_id"]: r["vec"] for r in tables.resolve(a.select("doc_id").union(b.select("doc_id")), [a, b], "doc_id").collect()}
    assert got == {1: [1.0], 2: [1.0, 2.0], 3: [3.0]}
    assert {r["doc_id"] for r in tables.missing(b.select("doc_id"), a, "doc_id", 2).collect()} == {1, 3}


def test_store_checks_settings(spark, tmp_path):
    path = str(tmp_path / "i")
    found = encode.blocks(bags_of(spark, random_bags(3)), CFG)
    assert store.load_blocks(spark, path) is None
    store.save_blocks(found, CFG, path)
    assert store.load_blocks(spark, path, CFG).count() == found.count()
    assert store.load_blocks(spark, path, replace(CFG, seed=1)) is None


def test_pack_is_read_by_predicates(spark, tmp_path):
    path = str(tmp_path / "pack")
    store.save_pack(index.pack(bags_of(spark, {1: np.ones((6, 6)), 2: np.ones((3, 6))}), 2), path, 2)
    df = store.read_span(spark, path, 1, 2, 4)
    assert sorted(r["tok"] for r in df.collect()) == [2, 3, 4]
    assert "PushedFilters: [IsNotNull(doc_id), IsNotNull(tok), EqualTo(doc_id,1)" in df._jdf.queryExecution().toString()


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5)], "a long, b double")
    for name in ("r.tsv", "r.csv"):
        store.write_table(df, str(tmp_path / name))
        assert [tuple(r) for r in tables.read_measurements(spark, str(tmp_path / name)).collect()] == [(1, 2.5)]
    store.write_report(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1


def test_encoders(spark):
    texts = spark.createDataFrame([(1, "B b  a"), (2, None), (3, "")], "doc_id long, text string")
    got = encoders.hash_tokens(texts, 16).orderBy("tok").collect()
    assert [(r["doc_id"], r["tok"]) for r in got] == [(1, 0), (1, 1), (1, 2)]
    assert got[0]["vec"] == got[1]["vec"] != got[2]["vec"] and np.linalg.norm(got[2]["vec"]) == pytest.approx(1)

    def load():
        return lambda some: [np.full((len(t), 2), len(t)) for t in some]

    rows = encoders.model_tokens(texts, load).groupBy("doc_id").count().collect()
    assert [tuple(r) for r in rows] == [(1, 6)]
    with pytest.raises(TypeError):
        encoders.as_matrix("x")
    with pytest.raises(ValueError):
        encoders.as_matrix([1.0])


def test_sampling(spark):
    q = spark.createDataFrame([(k, f"t{k}") for k in range(5)], "qid long, text string")
    a, b = (sorted(tuple(r) for r in tables.query_sample(q, 9, 3).collect()) for _ in range(2))
    assert a == b and len(a) == 9 and all(x[0].split("__rep")[0] == x[1][1:] for x in a)
    assert tables.query_sample(q.limit(0), 3).count() == 0


def test_ratios():
    assert config.kmeans_sample_ratio(6) == pytest.approx(0.2) and config.kmeans_sample_ratio(1) == 0.1 and config.kmeans_sample_ratio(20) == 0.3
    assert [config.pca_sample_ratio(p) for p in (16, 64, 128, 4096)] == [0.3, 0.2, 0.1, 0.05]
    assert config.memory_sample_ratio(10**9, 128, 64) == 0.05 and config.memory_sample_ratio(10, 128, 64) > 0.29


def test_stream_equals_batch(spark, tmp_path):
    _, _, qt, t = scene(spark)
    docs = encode.blocks(t, CFG.document())
    qt.select("qid", "qtok", "vec").repartitionByRange(3, "qid").write.parquet(str(tmp_path / "in"))
    streaming.search_stream(streaming.query_stream(spark, str(tmp_path / "in")), t, docs, CFG.document(), str(tmp_path / "out"), str(tmp_path / "state"), 6, 3).awaitTermination()
    show = lambda df: sorted((r["qid"], r["rank"], r["doc_id"]) for r in df.collect())
    assert show(spark.read.parquet(str(tmp_path / "out"))) == show(streaming.answer(qt, t, docs, CFG.document(), 6, 3))


def test_grid_and_extremes(spark):
    _, _, qt, t = scene(spark)
    qrels = spark.createDataFrame([(i, j, 1) for i in range(4) for j in range(5)], "qid long, doc_id long, rel int")
    got = experiments.grid(t, tables.as_tokens(qt), qrels, {"a": replace(CFG, reps=1), "b": CFG}).collect()
    assert {r["setting"] for r in got} == {"a", "b"} and all(0 <= r["recall"] <= 1 for r in got)


def test_planes_are_constants_and_tokens_are_not_exploded(spark):
    plan = encode.blocks(bags_of(spark, random_bags(2)), CFG)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_sum" in plan
    assert "Join" not in plan and "Generate explode" not in plan


def test_topk_limits_before_the_shuffle(spark):
    _, _, qt, t = scene(spark)
    q = encode.blocks(tables.as_tokens(qt), CFG, "qid")
    plan = search.topk(search.fde_scores(q, encode.blocks(t, CFG), 6), 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "BroadcastHashJoin" in plan


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_are_not_shuffled(spark, folder):
    """Between the encodings and the limit of a task there is one exchange, by document."""
    from lateweave.queries import Scene

    s = Scene(spark, folder)
    plan = plan_of(search.topk(s.scores(), 5))
    dealt = [x for x in plan.splitlines() if "Exchange" in x and "Broadcast" not in x]
    assert len(dealt) == 2 and "hashpartitioning(qid" in dealt[0] and "hashpartitioning(doc_id" in dealt[1], plan
    assert "rep" not in dealt[1].split("hashpartitioning(")[1].split(")")[0]


def test_tokens_stay_where_they_are_in_reranking(spark, folder):
    from lateweave.queries import Scene

    s = Scene(spark, folder)
    pairs, small = checked_local(s.candidates().select("qid", "doc_id"), 16)
    plan = plan_of(search.chamfer(pairs, s.q, s.d))
    assert small and "hashpartitioning(doc_id" not in plan and "hashpartitioning(t_doc" not in plan and "CartesianProduct" not in plan
    at = plan.index("Scan parquet")
    assert plan.rindex("BroadcastHashJoin", 0, at) > 0


def test_only_probed_lists_are_read(spark, tmp_path):
    path = str(tmp_path / "lists")
    rows = [(k % 7, k, 0, 0, [float(k), 1.0]) for k in range(70)]
    postings = spark.createDataFrame(rows, "list_id int, doc_id long, rep int, part int, vec array<double>")
    store.save_lists(postings, postings.limit(0), path)
    stored, _ = store.load_lists(spark, path)
    q = spark.createDataFrame([(0, 0, 0, [1.0, 0.0]), (1, 0, 1, [1.0, 0.0])], "qid long, rep int, part int, vec array<double>")
    probes = spark.createDataFrame([(0, 3), (0, 5), (1, 5)], "qid long, list_id int")
    found = index.stored_search(q, stored, probes, 2, 2)
    assert "PartitionFilters" in plan_of(found) and "list_id" in plan_of(found).split("PartitionFilters")[1][:80]
    assert {(r["qid"], r["doc_id"], r["score"]) for r in found.collect()} == {(0, 68, 68.0), (0, 66, 66.0), (1, 5, 0.0), (1, 12, 0.0)}


def test_query_side_is_checked(spark, monkeypatch):
    from lateweave.functions import vectors

    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 100)
    q = spark.createDataFrame([(k, 0, [1.0, 2.0]) for k in range(50)], "qid long, qtok long, vec array<double>")
    with pytest.raises(ValueError, match="split the query set"):
        search.chamfer_all(q, q.select(F.col("qid").alias("doc_id"), F.col("qtok").alias("tok"), "vec"))


def test_collection_folder(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id": "d1", "title": "T", "text": "x"}\n{"_id": "d2", "text": null}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q1", "text": "what"}\n{"_id": "q2", "text": "unjudged"}\n')
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t2\nq1\td2\t0\n")
    (tmp_path / "qrels" / "dev.tsv").write_text("query-id\tcorpus-id\tscore\nq2\td1\t1\n")
    corpus, queries, qrels = tables.read_collection(spark, str(tmp_path), binary=False)
    assert sorted(map(tuple, corpus.collect())) == [("d1", "T", "x"), ("d2", "", "")]
    assert [tuple(r) for r in queries.collect()] == [("q1", "what")] and [tuple(r) for r in qrels.collect()] == [("q1", "d1", 2)]
    assert [r["qid"] for r in tables.read_collection(spark, str(tmp_path), "dev")[1].collect()] == ["q2"]


def test_dimensions_of_the_axes(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, [5, 0.1, 3, 0.1, 0.1, 1], (400, 6))
    df = spark.createDataFrame([(k, 0, v) for k, v in enumerate(x.tolist())], "doc_id long, tok long, vec array<double>")
    value, vector = np.linalg.eigh(np.cov(x.T))
    order = np.argsort(-value)[:3]
    want = np.abs(vector[:, order]) @ (value[order] / value.sum())
    got = index.pca_dimensions(df, 3, 4)
    assert [d for d, _ in got][:2] == [0, 2] and len(got) == 4
    assert all(s == pytest.approx(want[d]) for d, s in got)
    assert index.pca_dimensions(df.limit(0)) == []


def test_a_query_over_two_batches_is_an_error(spark, tmp_path):
    tokens_ = spark.createDataFrame([(k, 0, [1.0, float(k)]) for k in range(4)], "doc_id long, tok long, vec array<double>")
    cfg = config.FdeConfig(dimension=2, reps=1, bits=1)
    for n in range(2):
        spark.createDataFrame([(1, n, [1.0, 2.0])], "qid long, qtok long, vec array<double>").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    job = streaming.search_stream(streaming.query_stream(spark, str(tmp_path / "in")), tokens_, encode.blocks(tokens_, cfg.document()), cfg, str(tmp_path / "out"), str(tmp_path / "state"), 4, 2)
    with pytest.raises(Exception, match="several micro-batches"):
        job.awaitTermination()
