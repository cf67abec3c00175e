"""Merging both graphs and linking them.

Each link is checked twice over the whole tables: partners per report from the groups, and
all single pairs as a count and checksum per report.
"""

from pyspark.sql import functions as F

from threatloom.operators import links as L
from threatloom.operators.containment import containment_pairs
from threatloom.operators.writes import place
from threatloom.queries.alerts import stored_alert_graph
from threatloom.queries.base import checksum, query, sql, sql_checksum
from threatloom.queries.graphs import edges_by_kind, stored_report_graph

# DuckDB side of every link, over the first-seen alert graph; ``_ALL`` has the same over the whole one.
_SHARED = "SELECT r.key, r.ntype FROM r_nodes r JOIN a_nodes a ON a.key = r.key AND a.ntype = r.ntype"
_LINKED = {
    "l_shared": _SHARED,
    "l_ip": """SELECT DISTINCT r.src, a.src AS dst FROM r_edges r JOIN l_shared s ON s.key = r.dst AND s.ntype = 'ip' JOIN a_edges_first a ON a.dst = r.dst
WHERE r.etype = 'report_contains_ip' AND a.etype IN ('alert_involves_ip', 'host_has_ip')""",
    "l_match": """SELECT DISTINCT r.key AS a_key, a.key AS b_key, r.ntype FROM r_nodes r JOIN a_nodes a ON a.ntype = r.ntype AND (contains(a.key, r.key) OR contains(r.key, a.key))
WHERE r.ntype IN ('file', 'process')""",
    "l_file": """SELECT DISTINCT r.src, a.src AS dst FROM r_edges r JOIN l_match m ON m.a_key = r.dst AND m.ntype = 'file' JOIN a_edges_first a ON a.dst = m.b_key
WHERE r.etype = 'report_contains_file' AND a.etype IN ('rule_related_to_file', 'alert_involves_file')""",
    "l_process": """SELECT DISTINCT r.src, a.src AS dst FROM r_edges r JOIN l_match m ON m.a_key = r.dst AND m.ntype = 'process' JOIN a_edges_first a ON a.dst = m.b_key
WHERE r.etype = 'report_contains_process' AND a.etype = 'alert_involves_process'""",
    "l_day": """SELECT DISTINCT r.src, a.src AS dst FROM r_edges r JOIN l_shared s ON s.key = r.dst AND s.ntype = 'timestamp' JOIN a_edges_first a ON a.dst = r.dst
WHERE r.etype = 'timestamp_of_report' AND a.etype = 'alert_at_timestamp'""",
    "l_stage": """SELECT DISTINCT r.src, a.src AS dst FROM r_edges r JOIN l_shared s ON s.key = r.dst AND s.ntype = 'attack_stage' JOIN a_edges_first a ON a.dst = r.dst
WHERE r.etype = 'report_describes_attack_stage' AND a.etype = 'alert_related_to_attack_stage'""",
    "l_loop_ip": """SELECT DISTINCT r.src, r.src AS dst FROM r_edges r JOIN l_shared s ON s.key = r.dst AND s.ntype = 'ip' JOIN a_edges_first a ON a.dst = r.dst AND a.src = r.src
WHERE r.etype = 'attack_stage_involves_ip' AND a.etype = 'attack_stage_involves_ip'""",
    "l_loop_process": """SELECT DISTINCT r.src, r.src AS dst FROM r_edges r JOIN l_match m ON m.a_key = r.dst AND m.ntype = 'process' JOIN a_edges_first a ON a.dst = m.b_key AND a.src = r.src
WHERE r.etype = 'attack_stage_involves_process' AND a.etype = 'attack_stage_involves_process'""",
    "l_same_day": """SELECT DISTINCT r.src, a.src AS dst FROM r_edges r JOIN l_shared s ON s.key = r.dst AND s.ntype = 'timestamp' JOIN a_edges_first a ON a.dst = r.dst
WHERE r.etype = 'timestamp_of_attack_stage' AND a.etype = 'timestamp_of_attack_stage'""",
    "l_parity": """SELECT src, dst, 'report_related_to_alert' AS etype, 1 AS o FROM l_ip UNION ALL SELECT src, dst, 'shared_attack_stage', 2 FROM l_loop_ip
UNION ALL SELECT src, dst, 'report_related_to_rule', 3 FROM l_file UNION ALL SELECT src, dst, 'attack_stages_at_same_time', 5 FROM l_same_day
UNION ALL SELECT src, dst, 'report_related_to_alert_by_process', 6 FROM l_process UNION ALL SELECT src, dst, 'shared_attack_stage', 7 FROM l_loop_process""",
    "l_all": """SELECT * FROM l_parity UNION ALL SELECT src, dst, 'report_related_to_alert_by_time', 4 FROM l_day
UNION ALL SELECT src, dst, 'report_related_to_alert_by_attack_stage', 8 FROM l_stage""",
    "m_edges": "SELECT * FROM r_edges UNION ALL SELECT a.* FROM a_edges_first a WHERE NOT EXISTS (SELECT 1 FROM r_edges r WHERE r.src = a.src AND r.dst = a.dst)",
    "m_nodes": """SELECT key, ntype, [0] || o AS o FROM r_nodes UNION ALL SELECT key, ntype, [1] || o AS o FROM a_nodes a WHERE NOT EXISTS (SELECT 1 FROM r_nodes r WHERE r.key = a.key)""",
    "m_linked": """SELECT src, dst, arg_max(etype, [lvl, o]) AS etype FROM (SELECT src, dst, etype, 0 AS lvl, 0 AS o FROM m_edges UNION ALL SELECT src, dst, etype, 1, o FROM l_parity) GROUP BY 1, 2""",
}


_ALL = {k: v.replace("a_edges_first", "a_edges_all") for k, v in _LINKED.items()}
# An alert has one day, process and stage, so partners add up over keys; listing pairs would be a product.
_ALL["c_stage"] = """SELECT r.src, sum(c.n)::BIGINT AS n FROM r_edges r JOIN l_shared s ON s.key = r.dst AND s.ntype = 'attack_stage'
JOIN (SELECT dst, count(DISTINCT src) AS n FROM a_edges_all WHERE etype = 'alert_related_to_attack_stage' GROUP BY 1) c ON c.dst = r.dst WHERE r.etype = 'report_describes_attack_stage' GROUP BY 1"""
_ALL["c_day"] = """SELECT r.src, sum(c.n)::BIGINT AS n FROM r_edges r JOIN l_shared s ON s.key = r.dst AND s.ntype = 'timestamp'
JOIN (SELECT dst, count(DISTINCT src) AS n FROM a_edges_all WHERE etype = 'alert_at_timestamp' GROUP BY 1) c ON c.dst = r.dst WHERE r.etype = 'timestamp_of_report' GROUP BY 1"""
_ALL["c_process"] = """SELECT src, sum(n)::BIGINT AS n FROM (SELECT DISTINCT r.src, m.b_key FROM r_edges r JOIN l_match m ON m.a_key = r.dst AND m.ntype = 'process' WHERE r.etype = 'report_contains_process')
JOIN (SELECT dst, count(DISTINCT src) AS n FROM a_edges_all WHERE etype = 'alert_involves_process' GROUP BY 1) c ON c.dst = b_key GROUP BY 1"""


def linked_sql(body, ctes=None):
    return sql(body, **(ctes or _LINKED))


def both(spark, sf, mode="first_seen"):
    """Report graph and alert graph, whole (``all``) or as first seen."""
    return stored_report_graph(spark, sf), stored_alert_graph(spark, sf, mode)


def _link(name, fn, rel, counted):
    """Partners per report over the whole alert graph, counted without pairs; for the first-seen graph also all pairs."""
    fn = fn if isinstance(fn, tuple) else (lambda a, b, f=fn: L.links_per_source(f(a, b)), fn)

    @query(name, linked_sql(f"SELECT src, n FROM ({counted})", _ALL))
    def run(spark, sf):
        return fn[0](*both(spark, sf, "all"))

    @query(f"{name}_first_seen", linked_sql(f"SELECT src, count(*) AS n FROM {rel} GROUP BY 1"))
    def run_first(spark, sf):
        return L.links_per_source(fn[1](*both(spark, sf)))

    @query(f"{name}_pairs", linked_sql(f"SELECT src, count(*) AS n, {sql_checksum('src', 'dst')} FROM {rel} GROUP BY 1"))
    def pairs(spark, sf):
        return L.link_pairs(fn[1](*both(spark, sf))).groupBy("src").agg(F.count("*").alias("n"), checksum("src", "dst"))


@query(
    "g51_shared_key_counts",
    linked_sql("SELECT k.kind, count(s.key) AS n FROM (VALUES ('ip'), ('file'), ('timestamp'), ('process'), ('attack_stage')) k(kind) LEFT JOIN l_shared s ON s.ntype = k.kind GROUP BY 1", _ALL),
)
def shared_key_counts(spark, sf):
    return L.shared_key_counts(*both(spark, sf, "all"))


def _modes(name, body):
    """One query over the whole alert graph and one over the first-seen graph."""

    def register(fn):
        for suffix, mode, ctes in (("", "all", _ALL), ("_first_seen", "first_seen", _LINKED)):
            query(name + suffix, linked_sql(body, ctes))(lambda spark, sf, mode=mode: fn(*both(spark, sf, mode)))
        return fn

    return register


_link("g52_link_by_ip", L.link_by_ip, "l_ip", "SELECT src, count(*) AS n FROM l_ip GROUP BY 1")
_link("g53_link_by_file", L.link_by_file, "l_file", "SELECT src, count(*) AS n FROM l_file GROUP BY 1")
_counted = lambda kind: lambda a, b: L.partner_counts(a, b, kind)
_link("g54_link_by_process", (_counted(L.BY_PROCESS), L.link_by_process), "l_process", "SELECT src, n FROM c_process")
_link("g55_link_by_day", (_counted(L.BY_DAY), L.link_by_day), "l_day", "SELECT src, n FROM c_day")
_link("g56_link_by_stage", (_counted(L.BY_STAGE), L.link_by_stage), "l_stage", "SELECT src, n FROM c_stage")


@query("g53_containment_pairs", linked_sql("SELECT ntype, a_key, b_key FROM l_match", _ALL))
def containment(spark, sf):
    a, b = both(spark, sf, "all")
    keys = lambda g, kind: g.nodes.where(F.col("ntype") == kind).select("key")
    found = [containment_pairs(keys(a, k), keys(b, k)).select(F.lit(k).alias("ntype"), "a_key", "b_key") for k in ("file", "process")]
    return found[0].unionByName(found[1])


@_modes("g57_shared_stage", "SELECT src, dst, 'ip' AS via FROM l_loop_ip UNION ALL SELECT src, dst, 'process' FROM l_loop_process")
def shared_stage(a, b):
    links = L.shared_stage(a, b)
    return links.select("src", "dst", F.when(F.col("place") == place("shared_attack_stage:ip"), "ip").otherwise("process").alias("via"))


@_modes("g58_stages_same_day", "SELECT src, dst FROM l_same_day")
def stages_same_day(a, b):
    return L.stages_same_day(a, b).select("src", "dst")


_LAST = "(SELECT src, dst, arg_max(etype, o) AS etype FROM l_all GROUP BY 1, 2)"


@query("g59_merge_links", linked_sql(f"SELECT etype, count(*) AS n FROM {_LAST} WHERE starts_with(etype, 'report_') GROUP BY 1"))
def merge_links(spark, sf):
    """Deciding link per pair, counted without pairs."""
    return L.deciding_counts(*both(spark, sf))


@query("g59_merge_links_pairs", linked_sql(f"SELECT etype, count(*) AS n, {sql_checksum('src', 'dst')} FROM {_LAST} GROUP BY 1"))
def merge_link_pairs(spark, sf):
    return edges_by_kind(L.merged_link_edges(*L.merge_links(*both(spark, sf))))


@_modes("g50_merge_graphs", f"SELECT etype, count(*) AS n, {sql_checksum('src', 'dst')} FROM m_edges GROUP BY 1")
def merge_graphs(a, b):
    return edges_by_kind(L.merge_graphs(a, b).edges)


@query("g50_merge_nodes", linked_sql(f"SELECT ntype, count(*) AS n, {sql_checksum('key')} FROM m_nodes GROUP BY 1", _ALL))
def merge_nodes(spark, sf):
    return L.merge_graphs(*both(spark, sf, "all")).nodes.groupBy("ntype").agg(F.count("*").alias("n"), checksum("key"))


@query("g59_merge_graphs_linked", linked_sql(f"SELECT etype, count(*) AS n, {sql_checksum('src', 'dst')} FROM m_linked GROUP BY 1"))
def merge_graphs_linked(spark, sf):
    a, b = both(spark, sf)
    return edges_by_kind(L.merge_graphs(a, b, L.merged_link_edges(*L.merge_links(a, b, "parity"))).edges)
