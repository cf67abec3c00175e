"""Graphs, vectors and metrics as tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.operators.graph import Graph


def save_graph(graph: Graph, path: str) -> None:
    """Write nodes and edges as parquet, partitioned by snapshot where there is one."""
    for name in ("nodes", "edges"):
        save_table(graph, name, path)


# The tables of a graph and the columns by which their files are sorted.
SORTED_BY = {"nodes": ("ntype", "key"), "edges": ("etype", "src"), "report_edges": ("etype", "src")}


def save_table(graph: Graph, name: str, path: str) -> None:
    """Write one table of a graph.

    Rows are sorted by kind and key inside each file, so a later filter on a kind skips row groups
    and the keys that repeat lie side by side, which makes the files smaller.
    """
    df = getattr(graph, name)
    by = ["snapshot_id"] if "snapshot_id" in df.columns else []
    df.sortWithinPartitions(*by, *SORTED_BY[name]).write.mode("errorifexists").partitionBy(*by).parquet(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def snapshot_count(graph: Graph) -> DataFrame:
    return graph.nodes.agg(F.countDistinct("snapshot_id").alias("n_snapshots"))


def write_metrics(df: DataFrame, path: str) -> None:
    """Metric rows (task, type, snapshot, metric, value) as JSON lines."""
    df.write.mode("errorifexists").json(path)


def read_embeddings(spark: SparkSession, path: str, key="key", vec="vec") -> DataFrame:
    return spark.read.parquet(path).select(F.col(key).cast("string").alias("key"), F.col(vec).cast("array<float>").alias("vec"))
