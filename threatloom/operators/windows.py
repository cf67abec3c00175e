"""Sliding windows over snapshots, and time splits."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threatloom.operators.joins import null_safe_join
from threatloom.operators.pairs import spread
from threatloom.operators.ranking import dense_index
from threatloom.session import checkpointed


def _snapshots(df: DataFrame, column: str):
    return df.agg((F.max(column) + 1).alias("n")).scalar()


def sliding_windows(df: DataFrame, w: int, column="s", n_snapshots=None) -> DataFrame:
    """Copy every row into the windows it belongs to, as (idx, t).

    Target ``idx`` looks at snapshots idx-w .. idx-1, renumbered t = 0 .. w-1. Snapshots are
    numbered from 0; only targets that exist and have a full window count.
    """
    n = F.lit(n_snapshots) if n_snapshots is not None else _snapshots(df, column)
    placed = df.withColumn("idx", F.explode(F.sequence(F.col(column) + 1, F.col(column) + w)))
    placed = placed.where((F.col("idx") >= w) & (F.col("idx") < n))
    return placed.withColumn("t", F.col(column) - F.col("idx") + w).drop(column)


def window_ids(nodes: DataFrame, w: int, column="s", n_snapshots=None) -> DataFrame:
    """Ids of all nodes of a window, numbered per type in id order: (idx, ntype, id, local_id)."""
    seen = checkpointed(nodes.select(column, "ntype", "id"))
    rows = seen.count() * w
    # a node's rows are dealt before they are copied into windows, so its copies meet without another shuffle
    ids = sliding_windows(spread(seen, rows, "ntype", "id"), w, column, n_snapshots)
    ids = ids.select("idx", "ntype", "id").distinct()
    return dense_index(ids, ["id"], ["idx", "ntype"], "local_id", rows)


def reindex_edges(windowed: DataFrame, ids: DataFrame) -> DataFrame:
    """Windowed edges (idx, t, src_type, src, etype, dst_type, dst) in window ids, plus reversed ``{etype}_r``."""
    end = lambda side: ids.select("idx", F.col("ntype").alias(f"{side}_type"), F.col("id").alias(side), F.col("local_id").alias(f"{side}_id"))
    both = windowed.join(end("src"), ["idx", "src_type", "src"]).join(end("dst"), ["idx", "dst_type", "dst"])
    there = both.select("idx", "t", "src_type", "src_id", "etype", "dst_type", "dst_id")
    back = both.select(
        "idx",
        "t",
        F.col("dst_type").alias("src_type"),
        F.col("dst_id").alias("src_id"),
        F.concat("etype", F.lit("_r")).alias("etype"),
        F.col("src_type").alias("dst_type"),
        F.col("src_id").alias("dst_id"),
    )
    return there.unionByName(back)


def window_features(feats: DataFrame, ids: DataFrame, w: int, dim: int, column="s", n_snapshots=None) -> DataFrame:
    """One vector per node and t of a window, zeros where the node is absent at t."""
    seen = sliding_windows(feats.select(column, "ntype", "id", "vec"), w, column, n_snapshots)
    grid = ids.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(w - 1))))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return grid.join(seen, ["idx", "ntype", "id", "t"], "left").select(
        "idx", "ntype", "local_id", "t", F.coalesce(F.col("vec").cast("array<float>"), zeros).alias("vec")
    )


def temporal_split(df: DataFrame, policy="ratio", column="s", w=0) -> DataFrame:
    """(snapshot, split) of every distinct snapshot by its place in time.

    ``ratio``: 60/20/20; with fewer than three snapshots all but the last train and the last
    both validates and tests. ``last30``: the last 30 test, the 30 before validate.
    ``last``: the last tests, the one before validates. The last two policies start at
    place ``w``, the first with a full window. The window sorts snapshots, not rows.
    """
    listed = df.select(column).distinct()
    at = listed.select(
        column, (F.row_number().over(W.orderBy(column)) - 1).alias("i"), F.count("*").over(W.partitionBy()).alias("n")
    )
    i, n = F.col("i"), F.col("n")
    if policy == "ratio":
        a, b = F.floor(n * F.lit(0.6)), F.floor(n * F.lit(0.8))
        many = F.array(F.when(i < a, "train").when(i < b, "val").otherwise("test"))
        few = F.when(i < n - 1, F.array(F.lit("train"))).otherwise(F.array(F.lit("val"), F.lit("test")))
        alone = F.array(F.lit("train"), F.lit("val"), F.lit("test"))
        splits = F.when(n >= 3, many).when(n == 1, alone).otherwise(few)
        return at.select(column, F.explode(splits).alias("split"))
    test, val = (30, 60) if policy == "last30" else (1, 2)
    split = F.when(i >= n - test, "test").when(i >= n - val, "val").otherwise("train")
    return at.where(i >= w).select(column, split.alias("split"))


def node_split(nodes: DataFrame, seed=0) -> DataFrame:
    """Random 60/20/20 split of the nodes of every type, with exact sizes and a repeatable order."""
    order = nodes.withColumn("_h", F.xxhash64("key", F.lit(seed)))
    ranked = dense_index(order, ["_h", "key"], ["ntype"], "_i").drop("_h")
    sizes = nodes.groupBy("ntype").agg(F.count("*").alias("_n"))
    a, b = F.floor(F.col("_n") * F.lit(0.6)), F.floor(F.col("_n") * F.lit(0.2))
    split = F.when(F.col("_i") < a, "train").when(F.col("_i") < a + b, "val").otherwise("test")
    return null_safe_join(ranked, sizes, ["ntype"]).withColumn("split", split).drop("_i", "_n")
