"""Time snapshots of both graphs, typed ids, and the tables they are saved as."""

from pyspark.sql import functions as F

from threatloom.operators import features as X
from threatloom.operators import links as L
from threatloom.operators import snapshots as S
from threatloom.operators.counts import snapshot_counts
from threatloom.queries.alerts import stored_alert_graph
from threatloom.queries.base import checksum, query, sql, sql_checksum, stage_graph
from threatloom.queries.graphs import stored_report_graph
from threatloom.queries.links import _ALL
from threatloom.session import checkpointed, scratch_folder
from threatloom.sources.tables import load_graph, save_graph, snapshot_count

N = 5


def _slots(rel, mode, last):
    at = f"(i * (w / {N}.0::DOUBLE))"
    bound = f"round_even({at} * 86400000000.0::DOUBLE, 0)" if mode == "fractional" else f"floor({at}) * 86400000000.0::DOUBLE"
    nxt = bound.replace("(i *", "((i + 1) *")
    slot = f"CASE WHEN date_diff('day', lo, d) = w THEN {N - 1} ELSE i END" if last else "i"
    reach = f"({bound} <= off AND off < {nxt})" + (f" OR (date_diff('day', lo, d) = w AND i = {N - 1})" if last else "")
    return f"""SELECT day, CAST({slot} AS INTEGER) AS snapshot_id FROM (
SELECT key AS day, CAST(key AS DATE) AS d, lo, date_diff('day', lo, hi) AS w, date_diff('day', lo, CAST(key AS DATE)) * 86400000000.0::DOUBLE AS off
FROM {rel}, (SELECT min(CAST(key AS DATE)) AS lo, max(CAST(key AS DATE)) AS hi FROM {rel} WHERE ntype = 'timestamp') WHERE ntype = 'timestamp'), range({N}) r(i)
WHERE w > 0 AND ({reach})"""


def _snap(p, nodes, edges, mode):
    """CTEs of the snapshots of one graph, named with prefix ``p``."""
    ctes = {f"{p}_days": _slots(nodes, mode, True)}
    if mode == "fractional":
        ctes[f"{p}_dated"] = f"SELECT DISTINCT snapshot_id, e.src, e.dst AS day FROM {edges} e JOIN {p}_days ON day = dst JOIN {nodes} n ON n.key = e.src AND n.ntype = 'report'"
        ctes[f"{p}_named"] = f"SELECT DISTINCT snapshot_id, e.dst FROM {edges} e JOIN (SELECT DISTINCT snapshot_id, src FROM {p}_dated) x ON x.src = e.src JOIN {nodes} n ON n.key = e.dst AND n.ntype IN ('ip', 'domain', 'hash', 'file')"
        ctes[f"{p}_own"] = f"SELECT snapshot_id, src, day AS dst, 'timestamp_of_report' AS etype FROM {p}_dated"
    else:
        ctes[f"{p}_dated"] = f"SELECT DISTINCT snapshot_id, e.src FROM {edges} e JOIN {p}_days ON day = dst"
        ctes[f"{p}_named"] = f"SELECT DISTINCT snapshot_id, e.dst FROM {edges} e JOIN {p}_dated x ON x.src = e.src"
        ctes[f"{p}_own"] = f"SELECT snapshot_id, e.src, e.dst, etype FROM {edges} e JOIN {p}_dated x ON x.src = e.src JOIN {nodes} n ON n.key = e.dst AND n.ntype = 'timestamp'"
    ctes[f"{p}_members"] = f"SELECT snapshot_id, day AS key FROM {p}_days UNION SELECT snapshot_id, src FROM {p}_dated UNION SELECT snapshot_id, dst FROM {p}_named"
    ctes[f"{p}_induced"] = f"""SELECT a.snapshot_id, e.src, e.dst, etype FROM {edges} e JOIN {p}_members a ON a.key = e.src JOIN {p}_members b ON b.key = e.dst AND b.snapshot_id = a.snapshot_id
JOIN {nodes} n ON n.key = e.dst AND n.ntype <> 'timestamp'"""
    ctes[f"{p}_edges"] = f"SELECT * FROM {p}_induced UNION ALL SELECT snapshot_id, src, dst, etype FROM {p}_own"
    ctes[f"{p}_nodes"] = f"SELECT snapshot_id, key, ntype, o FROM {p}_members JOIN {nodes} USING (key)"
    return ctes


_CTES = {**_ALL, **_snap("rs", "r_nodes", "r_edges", "fractional"), **_snap("ms", "m_nodes", "m_edges", "whole")}
_CTES["r_ids"] = "SELECT key, ntype, row_number() OVER (PARTITION BY ntype ORDER BY o, key) - 1 AS local_id FROM r_nodes"
_CTES["rs_ids"] = "SELECT snapshot_id, key, ntype, row_number() OVER (PARTITION BY snapshot_id, ntype ORDER BY o, key) - 1 AS local_id FROM rs_nodes"


def snap_sql(body):
    return sql(body, **_CTES)


def merged_graph(spark, sf):
    """Merged graph without links, as a stage table."""
    build = lambda: L.merge_graphs(stored_report_graph(spark, sf), stored_alert_graph(spark, sf, "all"))
    return stage_graph(spark, sf, "merged_graph", build)


def report_snapshots(spark, sf):
    return stage_graph(spark, sf, "report_snapshots", lambda: S.snapshot_graph(stored_report_graph(spark, sf), N))


def _assign(name, mode, last):
    @query(name, sql(_slots("r_nodes", mode, last)))
    def run(spark, sf):
        return S.assign_snapshot(S.day_nodes(stored_report_graph(spark, sf).nodes), N, mode, last)


_assign("w01_assign_snapshot", "fractional", True)
_assign("w01_assign_snapshot_open_end", "fractional", False)
_assign("w01_assign_snapshot_whole_days", "whole", True)


@query("w02_snapshot_reports", snap_sql("SELECT snapshot_id, key FROM rs_members"))
def snapshot_reports(spark, sf):
    g = stored_report_graph(spark, sf)
    return S.snapshot_reports(g.nodes, g.report_edges, S.assign_snapshot(S.day_nodes(g.nodes), N))


@query("w03_snapshot_all", snap_sql("SELECT snapshot_id, key FROM ms_members"))
def snapshot_all(spark, sf):
    g = merged_graph(spark, sf)
    return S.snapshot_all(g.nodes, g.edges, S.assign_snapshot(S.day_nodes(g.nodes), N, "whole"))


def _per_kind(edges):
    return edges.groupBy("snapshot_id", "etype").agg(F.count("*").alias("n"), checksum("src", "dst"))


@query("w04_induced_edges", snap_sql(f"SELECT snapshot_id, etype, count(*) AS n, {sql_checksum('src', 'dst')} FROM rs_induced GROUP BY 1, 2"))
def induced_edges(spark, sf):
    g = stored_report_graph(spark, sf)
    members = checkpointed(S.snapshot_reports(g.nodes, g.report_edges, S.assign_snapshot(S.day_nodes(g.nodes), N)))
    return _per_kind(S.induced_edges(members, g.nodes, g.edges))


@query("w05_snapshots", snap_sql(f"SELECT snapshot_id, etype, count(*) AS n, {sql_checksum('src', 'dst')} FROM rs_edges GROUP BY 1, 2"))
def snapshots(spark, sf):
    return _per_kind(S.snapshot_graph(stored_report_graph(spark, sf), N).edges)


@query("w05_snapshots_merged", snap_sql(f"SELECT snapshot_id, etype, count(*) AS n, {sql_checksum('src', 'dst')} FROM ms_edges GROUP BY 1, 2"))
def snapshots_merged(spark, sf):
    return _per_kind(S.snapshot_graph(merged_graph(spark, sf), N, "all").edges)


_COUNTS = "SELECT snapshot_id, n_nodes, n_edges FROM (SELECT snapshot_id, count(*) AS n_nodes FROM rs_nodes GROUP BY 1) JOIN (SELECT snapshot_id, count(*) AS n_edges FROM rs_edges GROUP BY 1) USING (snapshot_id)"


@query("a03_snapshot_counts", snap_sql(_COUNTS))
def snapshot_counts_query(spark, sf):
    return snapshot_counts(*report_snapshots(spark, sf))


@query("s09_save_graph", snap_sql(_COUNTS))
def save_graph_query(spark, sf):
    path = scratch_folder(spark, "saved_graph")
    save_graph(S.snapshot_graph(stored_report_graph(spark, sf), N), path)
    return snapshot_counts(*load_graph(spark, path))


@query("s10_load_graph", snap_sql("SELECT count(DISTINCT snapshot_id) AS n_snapshots FROM rs_nodes"))
def load_graph_query(spark, sf):
    return snapshot_count(report_snapshots(spark, sf))


@query("f01_local_ids", snap_sql("SELECT key, ntype, local_id FROM r_ids"))
def local_ids(spark, sf):
    return X.local_ids(stored_report_graph(spark, sf).nodes)


@query("f01_local_ids_by_snapshot", snap_sql(f"SELECT snapshot_id, ntype, count(*) AS n, max(local_id) AS top, {sql_checksum('key', 'local_id')} FROM rs_ids GROUP BY 1, 2"))
def local_ids_by_snapshot(spark, sf):
    ids = X.local_ids(report_snapshots(spark, sf).nodes)
    return ids.groupBy("snapshot_id", "ntype").agg(F.count("*").alias("n"), F.max("local_id").alias("top"), checksum("key", "local_id"))


@query(
    "f02_typed_edges",
    snap_sql(
        f"""SELECT src_type, etype, dst_type, count(*) AS n, {sql_checksum('src_id', 'dst_id')} FROM (
SELECT s.ntype AS src_type, etype, d.ntype AS dst_type, s.local_id AS src_id, d.local_id AS dst_id FROM r_edges JOIN r_ids s ON s.key = src JOIN r_ids d ON d.key = dst) GROUP BY 1, 2, 3"""
    ),
)
def typed_edges(spark, sf):
    g = stored_report_graph(spark, sf)
    typed = X.typed_edges(X.local_ids(g.nodes), g.edges)
    return typed.groupBy("src_type", "etype", "dst_type").agg(F.count("*").alias("n"), checksum("src_id", "dst_id"))


@query(
    "f03_onehot",
    snap_sql("SELECT ntype, local_id, count(*) OVER (PARTITION BY ntype) AS size, local_id AS at, 1.0::DOUBLE AS value FROM r_ids"),
)
def onehot(spark, sf):
    rows = X.onehot(X.local_ids(stored_report_graph(spark, sf).nodes))
    return rows.select("ntype", "local_id", "feat.size", F.col("feat.indices")[0].alias("at"), F.col("feat.values")[0].alias("value"))


@query("f04_random_features")
def random_features(spark, sf):
    rows = X.random_features(stored_report_graph(spark, sf).nodes.select("key", "ntype"), 16, 7)
    each = rows.select("ntype", F.explode("vec").alias("x"))
    return each.groupBy("ntype").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
