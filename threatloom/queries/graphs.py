"""Whole report graph, dedup, counts and local ids."""

from pyspark.sql import functions as F

from threatloom.operators import report_graph as R
from threatloom.operators.counts import canonical_counts, edge_counts, node_counts
from threatloom.operators.writes import dedup_edges, dedup_nodes, edge_kind
from threatloom.queries.base import alerts, checksum, mention, query, reports, sql, sql_checksum, stage_graph
from threatloom.vocab import BASIC_KINDS


def report_graph(spark, sf, kinds=None):
    args = (reports(spark, sf), mention(spark, sf))
    return R.build_report_graph(*args, kinds) if kinds else R.build_report_graph(*args)


def stored_report_graph(spark, sf):
    """The report graph as a stage table."""
    return stage_graph(spark, sf, "report_graph", lambda: report_graph(spark, sf))


_EDGES = f"SELECT etype, count(*) AS n, {sql_checksum('src', 'dst')} FROM r_edges GROUP BY 1"
_BASIC_WRITES = """SELECT src, dst, etype, o FROM name_writes WHERE etype IN ('report_contains_ip', 'report_contains_domain', 'report_contains_hash', 'report_contains_file')
UNION ALL SELECT src, dst, etype, o FROM time_writes UNION ALL SELECT src, dst, etype, o FROM pair_writes WHERE contains(etype, '_appears_with_')"""


def edges_by_kind(edges):
    return edges.groupBy("etype").agg(F.count("*").alias("n"), checksum("src", "dst"))


@query("g18_report_graph_edges", sql(_EDGES))
def report_graph_edges(spark, sf):
    return edges_by_kind(report_graph(spark, sf).edges)


@query(
    "g18_report_graph_basic",
    sql(
        f"SELECT etype, count(*) AS n, {sql_checksum('src', 'dst')} FROM (SELECT src, dst, arg_max(etype, o) AS etype FROM basic_writes GROUP BY 1, 2) GROUP BY 1",
        basic_writes=_BASIC_WRITES,
    ),
)
def report_graph_basic(spark, sf):
    return edges_by_kind(report_graph(spark, sf, BASIC_KINDS).edges)


@query("g20_dedup_nodes", sql("SELECT key, ntype, o[1] AS first_report FROM r_nodes"))
def dedup_nodes_query(spark, sf):
    nodes = report_graph(spark, sf).nodes
    return nodes.select("key", "ntype", F.shiftright("ord", 7).alias("first_report"))


# Names that clash: every order's clerk-like key is written as domain by odd and as file by even orders.
_CLASH = """SELECT 'k' || CAST(o_custkey % 300 AS VARCHAR) AS key, CASE o_orderkey % 2 WHEN 1 THEN 'domain' ELSE 'file' END AS kind, o_orderkey AS idx FROM orders"""


@query(
    "g20_dedup_nodes_clash",
    sql(
        """SELECT key, arg_min(kind, [idx, CASE kind WHEN 'domain' THEN 1 ELSE 2 END]) AS ntype FROM clash GROUP BY 1""",
        clash=_CLASH,
    ),
)
def dedup_nodes_clash(spark, sf):
    from threatloom.operators.writes import node_writes

    return dedup_nodes(node_writes(_clash(spark, sf), "key", "idx", F.col("kind"))).select("key", "ntype")


def _clash(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return orders.select(
        F.concat(F.lit("k"), (F.col("o_custkey") % 300).cast("string")).alias("key"),
        F.when(F.col("o_orderkey") % 2 == 1, "domain").otherwise("file").alias("kind"),
        F.col("o_orderkey").alias("idx"),
        F.concat(F.lit("h"), (F.col("o_custkey") % 7).cast("string")).alias("other"),
    )


_CLASH_EDGES = """SELECT 'h' || CAST(o_custkey % 7 AS VARCHAR) AS src, 'k' || CAST(o_custkey % 300 AS VARCHAR) AS dst,
CASE o_orderkey % 2 WHEN 1 THEN 'report_contains_domain' ELSE 'report_contains_file' END AS etype, o_orderkey AS idx FROM orders"""


def _clash_writes(spark, sf):
    from threatloom.operators.writes import edge_writes, place

    where = F.when(F.col("kind") == "domain", place("report_contains_domain")).otherwise(place("report_contains_file"))
    return edge_writes(_clash(spark, sf), "other", "key", "idx", where)


@query("g21_dedup_edges", sql("SELECT src, dst, arg_max(etype, idx) AS etype FROM clash GROUP BY 1, 2", clash=_CLASH_EDGES))
def dedup_edges_last(spark, sf):
    return dedup_edges(_clash_writes(spark, sf)).select("src", "dst", "etype")


@query("g21_dedup_edges_multi", sql("SELECT DISTINCT src, dst, etype FROM clash", clash=_CLASH_EDGES))
def dedup_edges_multi(spark, sf):
    return dedup_edges(_clash_writes(spark, sf), "multi").select("src", "dst", "etype")


@query("a01_node_counts", sql("SELECT ntype, count(*) AS n FROM r_nodes GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM r_nodes"))
def node_counts_query(spark, sf):
    return node_counts(stored_report_graph(spark, sf).nodes)


@query("a02_edge_counts", sql("SELECT etype, count(*) AS n FROM r_edges GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM r_edges"))
def edge_counts_query(spark, sf):
    return edge_counts(stored_report_graph(spark, sf).edges)


@query(
    "a04_canonical_counts",
    sql(
        """SELECT s.ntype AS src_type, etype, d.ntype AS dst_type, count(*) AS n FROM r_edges JOIN r_nodes s ON s.key = src JOIN r_nodes d ON d.key = dst GROUP BY 1, 2, 3"""
    ),
)
def canonical_counts_query(spark, sf):
    return canonical_counts(*stored_report_graph(spark, sf))
