"""No operator may lose rows silently."""

import numpy as np
import pytest

from threatloom.operators import attention as A
from threatloom.operators import features as X
from threatloom.operators import heads as H
from threatloom.operators import metrics as M
from threatloom.operators import sampling as P
from threatloom.operators.ranking import dense_index, take_per_group


def test_null_types_keep_their_numbers(spark):
    nodes = spark.createDataFrame([("a", None, 1, 0), ("b", None, 2, 0), ("c", "ip", 3, 0)], "key string, ntype string, ord long, pos long")
    ids = X.local_ids(nodes)
    assert sorted((r["key"], r["local_id"]) for r in ids.collect()) == [("a", 0), ("b", 1), ("c", 0)]
    assert X.onehot(ids).count() == 3


def test_take_per_group_with_a_null_group(spark):
    rows = spark.createDataFrame([(None, i) for i in range(5)] + [("x", i) for i in range(5)], "g string, i int")
    counts = spark.createDataFrame([(None, 2), ("x", 3)], "g string, size int")
    got = sorted(((r["g"] or "", r["i"]) for r in take_per_group(rows, ["i"], counts, ["g"]).collect()))
    assert got == [("", 0), ("", 1), ("x", 0), ("x", 1), ("x", 2)]
    assert dense_index(rows, ["i"], ["g"]).count() == 10


def test_curves_of_a_null_group(spark):
    rows = spark.createDataFrame([(g, s, y) for g in (None, "a") for s, y in ((0.9, 1), (0.4, 0), (0.5, 1), (0.5, 0))], "g string, score double, label int")
    for metric in (M.roc_auc, M.average_precision, M.pr_auc):
        values = {r["g"]: r[1] for r in metric(rows, ["g"]).collect()}
        assert set(values) == {None, "a"} and values[None] == values["a"]


def test_pairs_without_a_vector_are_an_error(spark):
    feats = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, vec array<float>")
    weights = {"W1": np.ones((2, 4)), "b1": np.zeros(2), "W2": np.ones((1, 2)), "b2": np.zeros(1)}
    pairs = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert H.score_pairs(pairs, feats, weights).count() == 1
    with pytest.raises(Exception, match="no vector for dst z"):
        H.score_pairs(spark.createDataFrame([("a", "z")], "src string, dst string"), feats, weights).collect()


def test_a_missing_time_step_is_a_zero_vector(spark):
    draw = np.random.default_rng(1)
    one = lambda *shape: draw.normal(size=shape)
    weights = {"n": {"proj": (one(3, 2), one(3)), "q": one(3, 3), "k": one(3, 3), "v": one(3, 3), "fc": (one(3, 3), one(3))}}
    schema = "ntype string, id string, t int, vec array<float>"
    full = [("n", "a", 0, [1.0, 2.0]), ("n", "a", 1, [0.0, 0.0]), ("n", "b", 0, [0.5, 0.5]), ("n", "b", 1, [1.0, 0.0])]
    run = lambda rows: {(r["id"], r["t"]): r["vec"] for r in A.temporal_attention(spark.createDataFrame(rows, schema), weights, 2).collect()}
    assert run(full) == run(full[:1] + full[2:])
    with pytest.raises(Exception, match="outside the window"):
        run([("n", "a", 5, [1.0, 2.0])])


def test_edges_without_weights_are_an_error(spark):
    feats = spark.createDataFrame([("n", 0, "a", [1.0, 2.0]), ("n", 0, "b", [1.0, 2.0])], "ntype string, t int, id string, vec array<float>")
    weights = {("n", "e", "n"): {"W": np.eye(2), "al": np.ones(2), "ar": np.ones(2), "b": np.zeros(2)}}
    edges = lambda kind: spark.createDataFrame([("n", kind, "n", 0, "a", "b")], "src_type string, etype string, dst_type string, t int, src string, dst string")
    assert A.attend_neighbors(edges("e"), feats, weights).count() == 2
    with pytest.raises(Exception, match="no weights for edges"):
        A.attend_neighbors(edges("other"), feats, weights).collect()


def test_residual_keeps_nodes_without_an_old_vector(spark):
    schema = "ntype string, t int, id string, vec array<float>"
    new = spark.createDataFrame([("n", 0, "a", [1.0, 2.0]), ("n", 0, "b", [3.0, 4.0])], schema)
    weights = {"n": {"a": 0.0, "W": np.eye(2), "b": np.zeros(2)}}
    got = {r["id"]: list(r["vec"]) for r in A.gated_residual(new, new.where("id = 'a'"), weights).collect()}
    assert got == {"a": [1.0, 2.0], "b": [1.5, 2.0]}


@pytest.mark.parametrize("size", [3, 40, 1000])
def test_negatives_are_one_fixed_order(spark, size):
    """The same seed gives the same first pairs however many are asked for, up to all free ones."""
    nodes = spark.createDataFrame([(i,) for i in range(9)], "key int")
    pairs = spark.createDataFrame([(s, a, b) for s in (0, 1) for a, b in ((0, 1), (1, 0), (2, 3), (3, 2))], "s int, src int, dst int")
    draw = lambda n: {(r["src"], r["dst"]) for r in P.negative_pairs(pairs, nodes, spark.createDataFrame([(1, n)], "s int, size long"), seed=5).collect()}
    got = draw(size)
    free = {(a, b) for a in range(9) for b in range(9) if a != b} - {(0, 1), (1, 0), (2, 3), (3, 2)}
    assert got <= free and len(got) == min(size, len(free))
    assert draw(2) <= got
