"""Alert rows and the alert graph."""

from pyspark.sql import functions as F

from threatloom.functions.alerts import normalize_alerts
from threatloom.functions.text import classify_stage
from threatloom.operators import alert_graph as A
from threatloom.operators.writes import dedup_nodes, edge_kind
from threatloom.queries.base import alerts, checksum, query, sql, sql_checksum, stage, stage_graph, table


def alert_rows(spark, sf):
    """Normalized alerts as a stage table: the graph reads them several times, the text is scanned once."""
    return stage(spark, sf, "alert_rows", lambda: normalize_alerts(alerts(spark, sf)))


def alert_graph(spark, sf, mode="all"):
    return A.build_alert_graph(alert_rows(spark, sf), mode)


@query("e13_classify_stage", sql("SELECT alert_idx, stage FROM a_rows"))
def classify(spark, sf):
    return alerts(spark, sf).select("alert_idx", classify_stage("description").alias("stage"))


@query(
    "e14_normalize_alerts",
    sql("SELECT alert_idx, alert, host, day, rule, process, port, usr AS \"user\", stage, array_to_string(list_distinct(ips), ',') AS ips, array_to_string(list_sort(list_distinct(files)), ',') AS files FROM a_rows"),
)
def normalized(spark, sf):
    rows = normalize_alerts(alerts(spark, sf))
    return rows.withColumn("ips", F.array_join("ips", ",")).withColumn("files", F.array_join(F.sort_array("files"), ","))


@query(
    "e14_port_and_user_fallbacks",
    """SELECT event_id AS alert_idx, CASE event_id % 6 WHEN 0 THEN 'port_http' WHEN 1 THEN 'port_443' WHEN 2 THEN 'port_8080' WHEN 3 THEN 'port_NaN' WHEN 4 THEN 'port_1e30' END AS port,
CASE WHEN event_id % 4 = 0 THEN 'u' || CAST(user_id AS VARCHAR) WHEN event_id % 4 < 3 THEN CAST(user_id AS VARCHAR) END AS "user" FROM events""",
)
def port_and_user_fallbacks(spark, sf):
    """Ports as names, numbers and odd numbers, from the source where the destination has none; users by id."""
    key, user = F.col("event_id"), F.col("user_id").cast("string")
    port = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (key % 6).cast("int"))
    rows = table(spark, sf, "events").select(
        key.alias("alert_idx"),
        port([" http ", "443.0", "0", "NaN", "1e30", ""]).alias("destination_port"),
        port(["1", "2", "8080", "3", "4", "0"]).alias("source_port"),
        F.when(key % 4 == 0, F.concat(F.lit("u"), user)).when(key % 4 == 1, "  ").alias("user_name"),
        F.when(key % 4 < 3, user).alias("user_id"),
    )
    return normalize_alerts(rows).select("alert_idx", "port", "user")


def stored_alert_graph(spark, sf, mode="first_seen"):
    """The alert graph as a stage table."""
    return stage_graph(spark, sf, f"alert_graph_{mode}", lambda: alert_graph(spark, sf, mode))


def _edges(name, etypes, mode="all"):
    listed = ", ".join(f"'{t}'" for t in etypes)
    suffix = "_all" if mode == "all" else "_first"
    body = f"SELECT etype, count(*) AS n, {sql_checksum('src', 'dst')} FROM (SELECT DISTINCT src, dst, etype FROM a_edge_writes{suffix} WHERE etype IN ({listed})) GROUP BY 1"

    @query(name, sql(body))
    def run(spark, sf):
        writes = A.alert_edges(A.gate(alert_rows(spark, sf), mode)).select("src", "dst", edge_kind().alias("etype"))
        found = writes.where(F.col("etype").isin(*etypes)).distinct()
        return found.groupBy("etype").agg(F.count("*").alias("n"), checksum("src", "dst"))


_edges("g30_alert_on_host", ["alert_on_host"])
_edges("g31_alert_at_timestamp", ["alert_at_timestamp"])
_edges("g32_alert_triggered_by_rule", ["alert_triggered_by_rule"])
_edges("g33_alert_ip_edges", ["host_has_ip", "alert_involves_ip"])
_edges("g34_alert_file_edges", ["rule_related_to_file", "alert_involves_file"])
_PROCESS = ["host_runs_process", "alert_involves_process", "process_accesses_file", "process_connects_to_ip"]
_PORT = ["ip_uses_port", "process_uses_port"]
_USER = ["alert_involves_user", "user_owns_process", "user_accesses_file"]
_STAGE = ["alert_related_to_attack_stage", "timestamp_of_attack_stage", "attack_stage_involves_ip", "attack_stage_involves_file", "attack_stage_involves_process"]
_edges("g35_alert_process_edges", _PROCESS)
_edges("g36_alert_port_edges", _PORT)
_edges("g37_alert_user_edges", _USER)
_edges("g38_alert_stage_edges", _STAGE)
_edges("g40_first_seen_gate", _PROCESS + _PORT + _USER + _STAGE, "first_seen")


@query("g39_stage_chain", sql("SELECT src, dst FROM a_stage_chain WHERE dst IS NOT NULL"))
def stage_chain(spark, sf):
    return A.stage_chain(dedup_nodes(A.alert_node_writes(alert_rows(spark, sf)))).select("src", "dst")


def _graph(name, mode, rel):
    @query(name, sql(f"SELECT etype, count(*) AS n, {sql_checksum('src', 'dst')} FROM {rel} GROUP BY 1"))
    def run(spark, sf):
        return alert_graph(spark, sf, mode).edges.groupBy("etype").agg(F.count("*").alias("n"), checksum("src", "dst"))


_graph("g41_alert_graph_edges", "all", "a_edges_all")
_graph("g41_alert_graph_edges_first_seen", "first_seen", "a_edges_first")


@query("g41_alert_graph_nodes", sql("SELECT key, ntype, o[1] AS first_alert FROM a_nodes"))
def alert_graph_nodes(spark, sf):
    return alert_graph(spark, sf).nodes.select("key", "ntype", F.shiftright("ord", 7).alias("first_alert"))
