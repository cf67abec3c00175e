"""Snapshots to features, propagated vectors, link scores and their metrics."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threatloom.operators import metrics as M
from threatloom.operators.attention import propagate, weights_from_table
from threatloom.operators.features import random_features
from threatloom.operators.graph import Graph
from threatloom.operators.heads import score_pairs
from threatloom.session import checkpointed


def model_weights(table: DataFrame) -> dict:
    """Weights of a model from rows (name, shape, values).

    Names: ``input/<type>/W|b``, ``layers/<i>/attend/<src>|<edge>|<dst>/W|al|ar|b``, ``layers/<i>/relation/<t>/W|b|q``,
    ``layers/<i>/time/<type>/proj_W|proj_b|q|k|v|fc_W|fc_b``, ``layers/<i>/residual/<type>/a|W|b[|gamma|beta]``, ``head/W1|b1|W2|b2``.
    """
    tree = {}
    for name, values in weights_from_table(table).items():
        *folders, leaf = name.split("/")
        at = tree
        for f in folders:
            at = at.setdefault(f, {})
        at[leaf] = values
    layers = []
    for number in sorted(tree.get("layers", {}), key=int):
        layer = tree["layers"][number]
        time = {n: {"proj": (w["proj_W"], w["proj_b"]), "fc": (w["fc_W"], w["fc_b"]), **{c: w[c] for c in "qkv"}} for n, w in layer["time"].items()}
        layers.append(
            {
                "attend": {tuple(k.split("|")): w for k, w in layer["attend"].items()},
                "relation": {int(t): (w["W"], w["b"], w["q"]) for t, w in layer["relation"].items()},
                "time": time,
                "residual": layer["residual"],
            }
        )
    return {"input": {n: (w["W"], w["b"]) for n, w in tree["input"].items()}, "layers": layers, "head": tree["head"]}


def snapshot_steps(nodes: DataFrame) -> DataFrame:
    """(snapshot_id, t): the snapshots numbered in order; the window sorts one row a snapshot."""
    return nodes.select("snapshot_id").distinct().select("snapshot_id", (F.row_number().over(Window.orderBy("snapshot_id")) - 1).alias("t"))


def node_vectors(graph: Graph, weights: dict, seed=0) -> DataFrame:
    """(ntype, t, id, vec) of every node of a snapshot graph after all layers; features are random by key."""
    steps = F.broadcast(checkpointed(snapshot_steps(graph.nodes)))
    window = steps.count()
    dim = next(iter(weights["input"].values()))[0].shape[1]
    nodes = graph.nodes.where("ntype is not null").join(steps, "snapshot_id").select("snapshot_id", "t", "key", "ntype")
    feats = random_features(nodes, dim, seed).select("ntype", "t", F.col("key").alias("id"), "vec")
    kind = lambda side: nodes.select("snapshot_id", F.col("key").alias(side), F.col("ntype").alias(f"{side}_type"))
    edges = graph.edges.join(steps, "snapshot_id").join(kind("src"), ["snapshot_id", "src"]).join(kind("dst"), ["snapshot_id", "dst"])
    return propagate(checkpointed(edges.select("etype", "t", "src_type", "src", "dst_type", "dst")), feats, weights, window)


def link_metrics(graph: Graph, samples: DataFrame, ids: DataFrame, weights: dict, seed=0) -> DataFrame:
    """Metric rows (task, type, snapshot, metric, value) of sampled edges in the last snapshot, by edge kind.

    ``samples`` is (src_type, etype, dst_type, src_id, dst_id, label) and ``ids`` (key, ntype, local_id) of that snapshot.
    """
    vectors = node_vectors(graph, weights, seed)
    last = vectors.agg(F.max("t")).scalar()
    vectors = vectors.where(F.col("t") == last).select("id", "vec")
    end = lambda side: ids.select(F.col("ntype").alias(f"{side}_type"), F.col("local_id").alias(f"{side}_id"), F.col("key").alias(side))
    pairs = samples.join(end("src"), ["src_type", "src_id"]).join(end("dst"), ["dst_type", "dst_id"]).select("etype", "src", "dst", "label")
    scored = checkpointed(score_pairs(pairs, vectors, weights["head"]).select("etype", "label", F.col("score")[0].cast("double").alias("score")))
    curve = checkpointed(M.score_curve(scored, ["etype"]))
    hits = scored.groupBy("etype").agg(F.avg(((F.col("score") > 0) == (F.col("label") == 1)).cast("double")).alias("accuracy"))
    joined = hits.join(M.roc_auc(curve, ["etype"]), "etype").join(M.average_precision(curve, ["etype"]), "etype")
    snapshot = graph.nodes.agg(F.max("snapshot_id")).scalar()
    return M.metric_rows(joined.withColumn("snapshot_id", snapshot), "link", "etype", "snapshot_id", ["auc", "ap", "accuracy"])


def score_stage(spark: SparkSession, graph: Graph, samples: DataFrame, ids: DataFrame, weights_path: str, seed=0) -> DataFrame:
    """``link_metrics`` with the weights of a Parquet table."""
    return link_metrics(graph, samples, ids, model_weights(spark.read.parquet(weights_path)), seed)
