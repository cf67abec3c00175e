"""The whole run as stages that hand over tables.

Each stage reads the tables of the ones before and writes its own below ``base``; a stage
that is not asked for is taken as already written. ``base`` must be a folder that all
executors reach.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.functions.alerts import normalize_alerts
from threatloom.functions.text import extract_entities
from threatloom.operators import alert_graph as A
from threatloom.operators import links as L
from threatloom.operators import report_graph as R
from threatloom.operators import snapshots as S
from threatloom.operators.counts import edge_counts, node_counts, snapshot_counts
from threatloom.operators.features import local_ids, typed_edges
from threatloom.operators.sampling import sample_edges
from threatloom.operators.windows import node_split, temporal_split
from threatloom.plans.scoring import score_stage
from threatloom.sources.alerts import read_alerts
from threatloom.sources.entities import read_entities, write_entities
from threatloom.sources.reports import read_report_text
from threatloom.sources.tables import load_graph, save_graph, write_metrics

STAGES = ["extract", "report_graph", "alert_graph", "merge", "snapshots", "samples", "scores"]


def extract(spark: SparkSession, base: str, reports: str, suffixes: DataFrame = None):
    """Text reports to entity lists; ``suffixes`` are the public suffixes that domains must end in."""
    texts = read_report_text(spark, reports).drop("path")
    write_entities(extract_entities(texts, suffixes=suffixes), f"{base}/entities")


def report_graph(spark: SparkSession, base: str, n_snapshots=5):
    """Entity lists to mentions, report graph and its snapshots."""
    entities = read_entities(spark, f"{base}/entities")
    R.mentions(entities).write.parquet(f"{base}/mentions")
    entities.select("report_idx", "report_name").write.parquet(f"{base}/reports")
    mentions, reports = spark.read.parquet(f"{base}/mentions"), spark.read.parquet(f"{base}/reports")
    save_graph(R.build_report_graph(reports, mentions), f"{base}/report_graph")
    save_graph(S.snapshot_graph(load_graph(spark, f"{base}/report_graph"), n_snapshots), f"{base}/report_snapshots")


def alert_graph(spark: SparkSession, base: str, alerts: str, gate="all"):
    """Alert CSV to normalized rows and alert graph."""
    normalize_alerts(read_alerts(spark, alerts)).write.parquet(f"{base}/alert_rows")
    save_graph(A.build_alert_graph(spark.read.parquet(f"{base}/alert_rows"), gate), f"{base}/alert_graph")


def merge(spark: SparkSession, base: str, links="intended", pairs=False):
    """Both graphs to one graph, and their links as two factored tables; with ``pairs`` also as single edges."""
    a, b = load_graph(spark, f"{base}/report_graph"), load_graph(spark, f"{base}/alert_graph")
    if links:
        for side, table in zip(("reports", "partners"), L.link_tables(a, b, links)):
            table.write.parquet(f"{base}/links_{side}")
    edges = L.merged_link_edges(*L.merge_links(a, b, links)) if links and pairs else None
    save_graph(L.merge_graphs(a, b, edges), f"{base}/merged_graph")


def snapshots(spark: SparkSession, base: str, n_snapshots=5):
    """Merged graph to snapshots, with typed ids and edges in them."""
    save_graph(S.snapshot_graph(load_graph(spark, f"{base}/merged_graph"), n_snapshots, "all"), f"{base}/snapshots")
    g = load_graph(spark, f"{base}/snapshots")
    local_ids(g.nodes).write.partitionBy("snapshot_id").parquet(f"{base}/local_ids")
    ids = spark.read.parquet(f"{base}/local_ids")
    typed_edges(ids, g.edges).write.partitionBy("snapshot_id").parquet(f"{base}/typed_edges")


def samples(spark: SparkSession, base: str, k=100, seed=0):
    """Time split of the snapshots, node split and edge samples of the last one."""
    g = load_graph(spark, f"{base}/snapshots")
    temporal_split(g.nodes, "ratio", "snapshot_id").write.parquet(f"{base}/split")
    last = g.nodes.agg(F.max("snapshot_id").alias("s")).first()["s"]
    if last is None:
        return
    here = F.col("snapshot_id") == last
    node_split(g.nodes.where(here).select("key", "ntype"), seed).write.parquet(f"{base}/node_split")
    ids, edges = (spark.read.parquet(f"{base}/{t}").where(here) for t in ("local_ids", "typed_edges"))
    sample_edges(edges, ids, k, seed, test=True).write.parquet(f"{base}/edge_samples")


def scores(spark: SparkSession, base: str, weights: str = None, seed=0):
    """Metrics of the edge samples, scored with the model whose weights lie at ``weights``; nothing without a model."""
    if weights is None:
        return
    ids = spark.read.parquet(f"{base}/local_ids")
    last = ids.agg(F.max("snapshot_id")).first()[0]
    samples = spark.read.parquet(f"{base}/edge_samples")
    rows = score_stage(spark, load_graph(spark, f"{base}/snapshots"), samples, ids.where(F.col("snapshot_id") == last), weights, seed)
    write_metrics(rows, f"{base}/metrics")


def run_stages(spark: SparkSession, base: str, stages=tuple(STAGES), options=None) -> DataFrame:
    """Run the named stages in order and count the merged graph and its snapshots.

    ``options`` maps a stage to its arguments, for example ``{"extract": {"reports": path}}``.
    """
    options = options or {}
    for name in STAGES:
        if name in stages:
            globals()[name](spark, base, **options.get(name, {}))
    return summary(spark, base)


def summary(spark: SparkSession, base: str) -> DataFrame:
    """(part, kind, n): nodes and edges by type, and the size of each snapshot."""
    g, cut = load_graph(spark, f"{base}/merged_graph"), load_graph(spark, f"{base}/snapshots")
    nodes = node_counts(g.nodes).select(F.lit("nodes").alias("part"), F.col("ntype").alias("kind"), "n")
    edges = edge_counts(g.edges).select(F.lit("edges").alias("part"), F.col("etype").alias("kind"), "n")
    sizes = snapshot_counts(*cut).select(
        F.lit("snapshot").alias("part"), F.col("snapshot_id").cast("string").alias("kind"), F.col("n_nodes").alias("n")
    )
    return nodes.unionByName(edges).unionByName(sizes)
