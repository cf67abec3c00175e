"""Cutting a graph into time snapshots."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.operators.graph import Graph
from threatloom.operators.pairs import broadcast_if_small
from threatloom.session import checkpointed

MICROS_PER_DAY = 86_400_000_000
REPORT_ENTITY_KINDS = ["ip", "domain", "hash", "file"]


def day_nodes(nodes: DataFrame) -> DataFrame:
    """Days of the graph that parse as dates.

    The date is an aggregate so that later joins on the day do not infer the same parse for
    every edge target.
    """
    days = nodes.where(F.col("ntype") == "timestamp").groupBy(F.col("key").alias("day"))
    return days.agg(F.max(F.try_to_date("key", "yyyy-MM-dd")).alias("date")).where("date is not null").select("day")


def assign_snapshot(days: DataFrame, n=5, mode="fractional", include_last=True) -> DataFrame:
    """Give every day its slot among ``n`` equal parts of the day range.

    Slot i is [min + i*step, min + (i+1)*step) with step = range in days / n as a double;
    ``fractional`` keeps the bounds to the microsecond, ``whole`` cuts them to whole days.
    The last day lies on the open end; ``include_last`` puts it into the last slot. A range
    of zero days has no slots.
    """
    dated = days.groupBy("day").agg(F.max(F.try_to_date("day", "yyyy-MM-dd")).alias("date"))
    date = F.col("date")
    span = dated.agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    dated = dated.withColumn("_lo", span.select("lo").scalar()).withColumn("_hi", span.select("hi").scalar())
    width = F.datediff("_hi", "_lo")
    step = width.cast("double") / F.lit(float(n))

    def bound(i: Column) -> Column:
        at = i.cast("double") * step
        if mode == "whole":
            return F.floor(at).cast("double") * F.lit(float(MICROS_PER_DAY))
        return F.rint(at * F.lit(float(MICROS_PER_DAY)))

    offset = F.datediff(date, F.col("_lo")).cast("double") * F.lit(float(MICROS_PER_DAY))
    hits = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (bound(i) <= offset) & (offset < bound(i + 1)))
    slot = F.get(hits, F.lit(0))
    if include_last:
        slot = F.when(date == F.col("_hi"), F.lit(n - 1)).otherwise(slot)
    return dated.where(width > 0).select("day", slot.cast("int").alias("snapshot_id")).where("snapshot_id is not null")


def snapshot_reports(nodes: DataFrame, edges: DataFrame, days: DataFrame) -> DataFrame:
    """Members (snapshot_id, key): the days, their reports, and the reports' addresses, domains, hashes and files.

    Of ``edges`` only those that leave a report are used.
    """
    # days are few, and the hottest targets: joined by shuffle, a day's edges would meet in one task
    days = broadcast_if_small(days)
    reports = nodes.where(F.col("ntype") == "report").select(F.col("key").alias("src"))
    into = edges.select("src", F.col("dst").alias("day")).join(days, "day").join(reports, "src", "left_semi")
    dated = checkpointed(into.select("snapshot_id", F.col("src")).distinct())
    entities = broadcast_if_small(nodes.where(F.col("ntype").isin(*REPORT_ENTITY_KINDS)).select(F.col("key").alias("dst")))
    named = edges.select("src", "dst").join(broadcast_if_small(dated), "src").join(entities, "dst", "left_semi")
    return _members(days, dated, named)


def snapshot_all(nodes: DataFrame, edges: DataFrame, days: DataFrame) -> DataFrame:
    """Members: the days, every node pointing at one, and everything those nodes point at."""
    days = broadcast_if_small(days)
    into = edges.select("src", F.col("dst").alias("day")).join(days, "day")
    dated = checkpointed(into.select("snapshot_id", "src").distinct())
    return _members(days, dated, edges.select("src", "dst").join(broadcast_if_small(dated), "src"))


def _members(days, dated, named):
    parts = days.select("snapshot_id", F.col("day").alias("key"))
    parts = parts.unionByName(dated.select("snapshot_id", F.col("src").alias("key")))
    return parts.unionByName(named.select("snapshot_id", F.col("dst").alias("key"))).distinct()


def induced_edges(members: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per snapshot, every edge between two members whose target is not a day.

    The snapshots of a node travel as one short list per key, so the edges pass each join
    once and are copied per snapshot only at the end.
    """
    listed = broadcast_if_small(members.groupBy("key").agg(F.collect_set("snapshot_id").alias("s")))
    kinds = nodes.where(F.col("ntype") != "timestamp").select("key")
    src = listed.select(F.col("key").alias("src"), F.col("s").alias("src_s"))
    dst = broadcast_if_small(listed.join(kinds, "key", "left_semi")).select(F.col("key").alias("dst"), F.col("s").alias("dst_s"))
    both = edges.select("src", "dst", "etype").join(src, "src").join(dst, "dst")
    return both.select(F.explode(F.array_intersect("src_s", "dst_s")).alias("snapshot_id"), "src", "dst", "etype")


def snapshot_graph(graph: Graph, n=5, scope="reports", include_last=True) -> Graph:
    """Nodes and edges of all non-empty snapshots.

    ``reports`` keeps reports and their entities, ``all`` everything around a day. Edges into
    days: in the report scope only those of a report to a day of the snapshot, always as
    ``timestamp_of_report``; in the wide scope every such edge of a node that points at a day
    of the snapshot.
    """
    mode = "fractional" if scope == "reports" else "whole"
    days = checkpointed(assign_snapshot(day_nodes(graph.nodes), n, mode, include_last))
    if scope == "reports":
        members = checkpointed(snapshot_reports(graph.nodes, graph.report_edges, days))
    else:
        members = checkpointed(snapshot_all(graph.nodes, graph.edges, days))

    def edges():
        leaving = graph.report_edges if scope == "reports" else graph.edges
        times = broadcast_if_small(graph.nodes.where(F.col("ntype") == "timestamp").select(F.col("key").alias("dst")))
        few = broadcast_if_small(days.withColumnRenamed("day", "dst"))
        into = leaving.select("src", "dst", "etype").join(times, "dst", "left_semi")
        if scope == "reports":
            reports = graph.nodes.where(F.col("ntype") == "report").select(F.col("key").alias("src"))
            own = into.join(few, "dst").join(reports, "src", "left_semi")
            own = own.withColumn("etype", F.lit("timestamp_of_report"))
        else:
            dated = into.join(few, "dst").select("snapshot_id", "src").distinct()
            own = into.join(dated, "src")
        return induced_edges(members, graph.nodes, graph.edges).unionByName(own.select("snapshot_id", "src", "dst", "etype"))

    return Graph(members.join(graph.nodes, "key"), edges)
