"""A graph's tables are made when they are read: what only edges need is not done for nodes, and the rows are those of the whole graph."""

import pytest
from pyspark.sql import functions as F

from threatloom.operators import links as L
from threatloom.operators import report_graph as R
from threatloom.operators import snapshots as S
from threatloom.operators.graph import Graph
from threatloom.operators.writes import dedup_nodes, node_ord
from threatloom.queries.base import stage_graph


@pytest.fixture
def ment(spark):
    rows = [(i, f"r{i % 3}", k, p, f"{k}{(i + p) % 3}") for i in range(5) for k in ("ip", "file", "process") for p in (0, 1)]
    rows += [(i, f"r{i % 3}", "timestamp", 0, f"2024-01-0{i + 1}") for i in range(5)]
    return spark.createDataFrame(rows, "report_idx long, report_name string, kind string, pos int, value string")


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_nodes_do_not_wait_for_edges(monkeypatch, ment):
    def refuse(*a):
        raise RuntimeError("edges are made")

    reports = ment.select("report_idx", "report_name").distinct()
    nodes = listed(R.build_report_graph(reports, ment).nodes)
    monkeypatch.setattr(R, "gathered_edges", refuse)
    g = R.build_report_graph(reports, ment)
    assert listed(g.nodes) == nodes and len(nodes) == 3 + 3 * 3 + 5
    with pytest.raises(RuntimeError, match="edges are made"):
        g.edges


def test_a_stored_graph_writes_the_table_that_is_read(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "ip", 1, 0)], "key string, ntype string, ord long, pos long")
    edges = spark.createDataFrame([("a", "b", "ip_uses_port", 1)], "src string, dst string, etype string, ord long")
    made = []

    def build():
        made.append("graph")
        return Graph(nodes, lambda: made.append("edges") or edges)

    stored = lambda: stage_graph(spark, str(tmp_path), "lazy", build)
    assert listed(stored().nodes) == listed(nodes) and made == ["graph"]
    assert listed(stored().edges) == listed(edges) and made == ["graph", "edges"]
    n, e = stored()
    assert (listed(n), listed(e), made) == (listed(nodes), listed(edges), ["graph", "edges"])


def test_snapshot_nodes_do_not_wait_for_edges(monkeypatch, ment):
    g = R.build_report_graph(ment.select("report_idx", "report_name").distinct(), ment)
    g = Graph(g.nodes.localCheckpoint(), g.edges.localCheckpoint())
    nodes = listed(S.snapshot_graph(g, 2).nodes)
    monkeypatch.setattr(S, "induced_edges", None)
    assert nodes and listed(S.snapshot_graph(g, 2).nodes) == nodes


def test_first_writes_are_found_without_sorting(spark):
    rows = [("a", 1, 2), ("a", 1, 1), ("a", 0, 9), ("b", 3, 0), ("b", 3, None), ("c", None, 4), ("c", 2, 0), (None, 1 << 55, 1), ("d", -1, 0)]
    writes = spark.createDataFrame(rows, "key string, idx long, pos long").select("key", node_ord("idx", "ip").alias("ord"), "pos")
    found = dedup_nodes(writes)
    ord_of = lambda i: i * 128 + 5
    want = [("a", "ip", ord_of(0), 9), ("b", "ip", ord_of(3), None), ("c", None, None, 4), (None, "ip", ord_of(1 << 55), 1), ("d", "ip", ord_of(-1), 0)]
    assert listed(found) == sorted(want, key=str)
    assert "SortAggregate" not in found._jdf.queryExecution().toString()


ODD = [  # entities that are called as reports are, in every way that writes edges from them, and rows without a name, number or value
    (10, "r0", "process", 0, "r1"), (10, "r0", "process", 1, "r2"), (10, "r0", "file", 0, "r2"), (10, "r0", "ip", 0, "r1"),
    (10, "r0", "attack_stage", 0, "only"), (10, "r0", "attack_stage", 1, "r0"), (10, "r0", "timestamp", 0, "2024-02-01"), (10, "r0", "file", 1, "x"),
    (11, "r1", "file", 0, "r2"), (11, "r1", "hash", 0, None), (11, "r1", "file", 1, "f"), (12, None, "ip", 0, "i"), (12, None, "file", 0, "f"),
    (None, "r2", "ip", 0, "lost"), (13, "x", "user", 0, "x"), (13, "x", "process", 0, "p"),
]


@pytest.mark.parametrize("odd", [False, True])
def test_edges_that_leave_reports_are_those_of_the_whole_graph(spark, ment, odd):
    if odd:
        ment = ment.unionByName(spark.createDataFrame(ODD, ment.schema))
    reports = ment.select("report_idx", "report_name").distinct().unionByName(spark.createDataFrame([(50, "only")], "report_idx long, report_name string"))
    g = R.build_report_graph(reports, ment)
    names = {r[0] for r in reports.select("report_name").collect()}
    want = [e for e in listed(g.edges) if e[0] in names]
    assert listed(g.report_edges) == want
    assert odd == ("only" in {e[0] for e in want}) == (None in {e[0] for e in want})
    assert odd == any(e[2].startswith("process_") for e in want)


def test_links_and_members_of_snapshots_read_only_edges_that_leave_reports(spark, ment):
    def refuse():
        raise RuntimeError("edges are read")

    whole = R.build_report_graph(ment.select("report_idx", "report_name").distinct(), ment)
    whole = Graph(whole.nodes.localCheckpoint(), whole.edges.localCheckpoint())
    part = Graph(whole.nodes, refuse, whole.edges.join(ment.select(F.col("report_name").alias("src")), "src", "left_semi").select(whole.edges.columns))
    alerts = [("a0", "ip0", "alert_involves_ip"), ("a1", "process1", "alert_involves_process"), ("a1", "/file2", "alert_involves_file"), ("a1", "2024-01-01", "alert_at_timestamp")]
    kind = {"alert_involves_ip": "ip", "alert_involves_process": "process", "alert_involves_file": "file", "alert_at_timestamp": "timestamp"}
    b = Graph(spark.createDataFrame([(d, kind[e]) for _, d, e in alerts], "key string, ntype string"), spark.createDataFrame(alerts, "src string, dst string, etype string"))
    for count in (lambda a: L.link_pairs(L.link_by_file(a, b)), lambda a: L.links_per_source(L.link_by_ip(a, b)), lambda a: L.partner_counts(a, b, L.BY_PROCESS), lambda a: S.snapshot_graph(a, 2).nodes):
        assert listed(count(part)) == listed(count(whole)) != []
