import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatloom.operators import metrics as M
from threatloom.operators import pairs as PJ
from threatloom.operators import sampling as P
from threatloom.operators import windows as W


def test_window_ids_and_absent_nodes(spark):
    nodes = spark.createDataFrame([(0, "a", 5), (1, "a", 2), (2, "a", 9), (3, "a", 1)], "s int, ntype string, id long")
    ids = W.window_ids(nodes, 3)
    assert sorted(tuple(r) for r in ids.collect()) == [(3, "a", 2, 0), (3, "a", 5, 1), (3, "a", 9, 2)]
    feats = nodes.withColumn("vec", F.array(F.col("id").cast("float")))
    rows = {(r["local_id"], r["t"]): r["vec"] for r in W.window_features(feats, ids, 3, 1).collect()}
    assert rows == {(i, t): [v if t == at else 0.0] for i, (v, at) in enumerate([(2.0, 1), (5.0, 0), (9.0, 2)]) for t in range(3)}


def test_window_ids_are_made_by_tasks_of_bounded_size(spark, monkeypatch):
    rows = [(s, t, i) for s in range(4) for t in "ab" for i in range(500) if (i + s) % 3]
    nodes = spark.createDataFrame(rows, "s int, ntype string, id long")
    plain = sorted(tuple(r) for r in W.window_ids(nodes, 3).collect())
    assert plain == [(3, t, i, i) for t in "ab" for i in range(500)]
    monkeypatch.setattr(PJ, "TASK_ROWS", 250)
    cut = W.window_ids(nodes, 3)
    assert sorted(tuple(r) for r in cut.collect()) == plain
    assert max(r["n"] for r in cut.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()) <= 500


def test_reindex_adds_reversed_edges(spark):
    edges = spark.createDataFrame([(0, 0, "a", 7, "w", "p", 3)], "idx int, t int, src_type string, src long, etype string, dst_type string, dst long")
    ids = spark.createDataFrame([(0, "a", 7, 4), (0, "p", 3, 1)], "idx int, ntype string, id long, local_id long")
    assert sorted(tuple(r) for r in W.reindex_edges(edges, ids).collect()) == [(0, 0, "a", 4, "w", "p", 1), (0, 0, "p", 1, "w_r", "a", 4)]


@pytest.mark.parametrize("n, want", [(1, {0: {"train", "val", "test"}}), (2, {0: {"train"}, 1: {"val", "test"}}), (5, {0: {"train"}, 1: {"train"}, 2: {"train"}, 3: {"val"}, 4: {"test"}})])
def test_ratio_split(spark, n, want):
    got = {}
    for r in W.temporal_split(spark.createDataFrame([(i,) for i in range(n)], "s int")).collect():
        got.setdefault(r["s"], set()).add(r["split"])
    assert got == want


def test_node_split_sizes(spark):
    nodes = spark.createDataFrame([(f"k{i}", "a" if i < 33 else "b") for i in range(50)], "key string, ntype string")
    got = {(r["ntype"], r["split"]): r["count"] for r in W.node_split(nodes, 1).groupBy("ntype", "split").count().collect()}
    assert got == {("a", "train"): 19, ("a", "val"): 6, ("a", "test"): 8, ("b", "train"): 10, ("b", "val"): 3, ("b", "test"): 4}


def linked(spark, n_nodes, density, seed=0):
    rnd = random.Random(seed)
    rows = [(s, i, j, 1) for s in range(3) for i in range(n_nodes) for j in range(n_nodes) if i != j and rnd.random() < density]
    return spark.createDataFrame(rows, "s int, src long, dst long, n long"), rows


@pytest.mark.parametrize("density", [0.01, 0.6])
def test_negatives_are_free_pairs(spark, density):
    pairs, rows = linked(spark, 30, density)
    nodes = spark.createDataFrame([(i,) for i in range(30)], "key long")
    sizes = spark.createDataFrame([(1, 10), (2, 5000)], "s int, size long")
    got = [tuple(r) for r in P.negative_pairs(pairs, nodes, sizes, 3).collect()]
    used = {(s, i, j) for s, i, j, _ in rows}
    free = {s: {(i, j) for i in range(30) for j in range(30) if i != j and (s, i, j) not in used and (s - 1, i, j) not in used} for s in (1, 2)}
    assert len(got) == len(set(got))
    assert all((i, j) in free[s] for s, i, j in got)
    assert sum(s == 1 for s, _, _ in got) == min(10, len(free[1]))
    assert {(i, j) for s, i, j in got if s == 2} == free[2]
    counts = {r["s"]: r["n_negative"] for r in P.negative_counts(pairs, nodes).collect()}
    assert counts == {s: len(f) for s, f in free.items()}


def test_new_and_sampled_pairs(spark):
    pairs, rows = linked(spark, 20, 0.3, 4)
    have = {(s, i, j) for s, i, j, _ in rows}
    fresh = {(s, i, j) for s, i, j in have if s > 0 and (s - 1, i, j) not in have}
    assert {tuple(r) for r in P.new_pairs(pairs).collect()} == fresh
    nodes = spark.createDataFrame([(i,) for i in range(20)], "key long")
    got = P.sample_pairs(pairs, nodes, 0.1, 1).collect()
    pos = {(r["s"], r["src"], r["dst"]) for r in got if r["label"] == 1}
    neg = {(r["s"], r["src"], r["dst"]) for r in got if r["label"] == 0}
    assert pos <= fresh and not neg & have
    for s in (1, 2):
        size = int(0.1 * sum(f[0] == s for f in fresh))
        assert sum(p[0] == s for p in pos) == sum(p[0] == s for p in neg) == size


def test_shared_items(spark):
    edges = spark.createDataFrame([(0, "a", 1), (0, "b", 1), (0, "a", 2), (0, "b", 2), (0, "c", 2), (0, "a", 2)], "s int, src string, dst int")
    got = {(r["src"], r["dst"]): r["n"] for r in P.project_pairs(edges, "src", "dst").collect()}
    assert got == {("a", "b"): 2, ("b", "a"): 2, ("a", "c"): 1, ("c", "a"): 1, ("b", "c"): 1, ("c", "b"): 1}


@pytest.mark.parametrize("block", [2, 8192])
def test_shared_items_of_any_size(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK_ROWS", block)
    rnd = random.Random(5)
    rows = [(rnd.choice([0, 1, None]), rnd.choice([1, 2, 3, 4, 5, None]), rnd.choice([7, 7, 7, 8, 9, None])) for _ in range(60)]
    edges = spark.createDataFrame(rows, "s int, src int, dst int")
    whole = {r for r in rows if None not in r}
    want = Counter((s, a, b) for s, a, v in whole for t, b, w in whole if (s, v) == (t, w) and a != b)
    assert {(r["s"], r["src"], r["dst"]): r["n"] for r in P.project_pairs(edges, "src", "dst").collect()} == want


def test_pairs_of_neighbouring_snapshots_are_shuffled_once(spark):
    rows = [(s, a, b, 1) for s, a, b in [(0, 1, 2), (1, 1, 2), (3, 1, 2), (1, 2, 3), (1, 2, 3), (2, 2, 3), (0, None, 4), (1, None, 4), (None, 5, 6), (2, 7, 8)]]
    pairs = spark.createDataFrame(rows, "s int, src long, dst long, n long")
    cur = pairs.select("s", "src", "dst")
    fresh = cur.where("s > 0").join(cur.withColumn("s", F.col("s") + 1), ["s", "src", "dst"], "left_anti")
    linked = cur.unionByName(cur.withColumn("s", F.col("s") + 1)).distinct().where("s > 0 and s <= 3")
    listed = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(")
    got = P.new_pairs(pairs), P.linked_now_or_before(pairs)
    assert [shuffles(df) for df in (*got, P.project_pairs(pairs.withColumnRenamed("n", "via"), "src", "via"))] == [1, 1, 2]
    assert listed(got[0]) == listed(fresh) and listed(got[1]) == listed(linked)


def test_nodes_meet_pairs_by_broadcast(spark, monkeypatch):
    pairs, _ = linked(spark, 10, 0.2)
    nodes, sizes = spark.createDataFrame([(i,) for i in range(10)], "key long"), spark.createDataFrame([(1, 5)], "s int, size long")
    seen = []
    monkeypatch.setattr(P, "broadcast_if_small", lambda df, *a: seen.append(a) or df)
    few = P.negative_pairs(pairs, nodes, sizes, 3)
    assert seen == [(P.NODE_ROWS,)]
    monkeypatch.undo()
    assert sorted(few.collect()) == sorted(P.negative_pairs(pairs, nodes, sizes, 3).collect())


def test_sampled_edges(spark):
    edges = spark.createDataFrame([("a", "w", "p", i, i % 3) for i in range(20)] + [("p", "c", "p", 0, 1)], "src_type string, etype string, dst_type string, src_id long, dst_id long")
    ids = spark.createDataFrame([("a", i) for i in range(20)] + [("p", i) for i in range(3)], "ntype string, local_id long")
    true = {tuple(r) for r in edges.collect()}
    for test, k in ((False, 50), (True, 20)):
        got = P.sample_edges(edges, ids, 50, 1, test).collect()
        pos = [tuple(r[c] for c in edges.columns) for r in got if r["label"] == 1]
        assert set(pos) <= true and sum(p[1] == "w" for p in pos) == k and sum(p[1] == "c" for p in pos) == (1 if test else 50)
        assert all(0 <= r["dst_id"] < 3 for r in got)
    clean = P.sample_edges(edges, ids, 50, 1, exclude_true=True).where("label = 0").collect()
    assert not {tuple(r[c] for c in edges.columns) for r in clean} & true


def test_sampled_edges_are_uniform_and_repeatable(spark):
    """Draws with replacement: as many repeats as chance gives, every edge equally often, any partitioning."""
    edges = spark.range(30).selectExpr("'a' as src_type", "'e' as etype", "'b' as dst_type", "id as src_id", "id * 7 as dst_id")
    ids = spark.range(300).selectExpr("case when id < 30 then 'a' else 'b' end as ntype", "id as local_id")
    drawn = lambda df, seed: sorted((r["j"], r["src_id"], r["dst_id"]) for r in P.sample_edges(df, ids, 60, seed).where("label = 1").collect())
    assert drawn(edges.repartition(5), 3) == drawn(edges.coalesce(1), 3)
    counts, distinct = np.zeros(30), []
    for seed in range(25):
        rows = drawn(edges, seed)
        assert [r[0] for r in rows] == list(range(60)) and all(d == 7 * s for _, s, d in rows)
        distinct.append(len({r[1] for r in rows}))
        for _, s, _ in rows:
            counts[s] += 1
    # 50 draws an edge on average; 30 edges of which 60 draws leave out 3.9
    assert np.mean(distinct) == pytest.approx(30 * (1 - (29 / 30) ** 60), abs=1.0)
    assert ((counts - 50) ** 2 / 50).sum() < 2 * 60


def curves(scores, labels):
    """ROC area by comparing all pairs; precision steps threshold by threshold."""
    pos, neg = scores[labels == 1], scores[labels == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    recall, precision = [0.0], [1.0]
    for t in sorted(set(scores), reverse=True):
        hit = scores >= t
        recall.append((labels[hit] == 1).sum() / len(pos))
        precision.append((labels[hit] == 1).mean())
    r, p = np.array(recall), np.array(precision)
    return auc, float(np.sum(np.diff(r) * p[1:])), float(np.sum(np.diff(r) * (p[1:] + p[:-1]) / 2))


def test_curve_metrics_with_ties(spark):
    rng = np.random.RandomState(2)
    scores, labels = rng.randint(0, 15, 200) / 3.0, rng.randint(0, 2, 200)
    df = spark.createDataFrame([("g", float(s), int(y)) for s, y in zip(scores, labels)], "g string, score double, label int")
    auc, ap, pr = curves(scores, labels)
    assert M.roc_auc(df, ["g"]).first()["auc"] == pytest.approx(auc)
    assert M.average_precision(df).first()["ap"] == pytest.approx(ap)
    assert M.pr_auc(df).first()["pr_auc"] == pytest.approx(pr)
    alone = df.where("label = 1")
    assert M.roc_auc(alone).first()["auc"] is None


def test_losses(spark):
    rng = np.random.RandomState(4)
    s, y = rng.normal(0, 3, 50), rng.randint(0, 2, 50)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, label int")
    p = 1 / (1 + np.exp(-s))
    assert M.bce_logits(df).first()["loss"] == pytest.approx(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
    assert M.logistic_pair_loss(df).first()["loss"] == pytest.approx(-np.log(p[y == 1]).mean() - np.log(1 - p[y == 0]).mean())
    big = spark.createDataFrame([(1000.0, 0)], "score double, label int")
    assert M.bce_logits(big).first()["loss"] == 1000.0
    logits = rng.normal(0, 30, (40, 3))
    lab = rng.randint(0, 3, 40)
    rows = spark.createDataFrame([("a", 0, l.tolist(), int(k)) for l, k in zip(logits, lab)], "ntype string, snapshot_id int, logits array<double>, label int")
    m = logits.max(1, keepdims=True)
    want = np.mean(np.log(np.exp(logits - m).sum(1)) + m[:, 0] - logits[np.arange(40), lab])
    assert M.cross_entropy(rows).first()["loss"] == pytest.approx(want)
    assert M.accuracy(rows).first()["accuracy"] == pytest.approx((logits.argmax(1) == lab).mean())


def test_regression_error_is_a_mean_over_snapshots(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0), (0, 3.0, 0.0), (1, 5.0, 5.0)], "snapshot_id int, pred double, label double")
    r = M.regression_error(df).first()
    assert (r["mae"], r["rmse"]) == (1.0, pytest.approx(np.sqrt(5) / 2))
