import itertools
import random

import pytest

from threatloom.functions.alerts import normalize_alerts
from threatloom.operators import alert_graph as A
from threatloom.operators import links as L
from threatloom.operators import pairs as PJ
from threatloom.operators import report_graph as R
from threatloom.operators import snapshots as S
from threatloom.operators.containment import containment_pairs
from threatloom.operators.features import local_ids
from threatloom.operators.graph import Graph
from threatloom.operators.ranking import dense_index
from threatloom.session import checkpointed
from threatloom.sources.entities import fill_entities
from threatloom.vocab import BASIC_KINDS, ENTITY_FIELDS

MENTION = "report_idx long, report_name string, kind string, pos int, value string"


def entities(spark, reports):
    """reports: list of (name, {field: [values]}) in index order."""
    data = [(i, n, tuple(e.get(f, None) for f in ENTITY_FIELDS)) for i, (n, e) in enumerate(reports)]
    fields = ", ".join(f"{f}: array<string>" for f in ENTITY_FIELDS)
    return fill_entities(spark.createDataFrame(data, f"report_idx long, report_name string, entities struct<{fields}>"))


def report_graph(spark, reports, **kw):
    e = entities(spark, reports)
    return R.build_report_graph(e.select("report_idx", "report_name"), R.mentions(e), **kw)


def edge_map(graph):
    return {(r["src"], r["dst"]): r["etype"] for r in graph.edges.collect()}


def node_map(graph):
    return {r["key"]: r["ntype"] for r in graph.nodes.collect()}


def test_clashing_names(spark):
    g = report_graph(
        spark,
        [
            ("r0", {"domains": ["same"], "ips": ["1.1.1.1"]}),
            ("r1", {"files": ["same"], "ips": ["1.1.1.1"]}),
            ("r2", {"files": ["r0"], "hashes": ["same"]}),
        ],
    )
    nodes, edges = node_map(g), edge_map(g)
    assert nodes["same"] == "domain" and nodes["r0"] == "report"
    assert edges["1.1.1.1", "same"] == "ip_appears_with_file"
    assert edges["r1", "same"] == "report_contains_file"
    assert edges["same", "1.1.1.1"] == "domain_resolves_to_ip"
    assert len(edges) == g.edges.count() and len(nodes) == g.nodes.count()


def test_duplicate_report_name_and_times(spark):
    reports = [
        ("r", {"timestamps": ["2020-01-03", "2020-01-02"], "attack_stages": ["S1", "S2", "S1"]}),
        ("r", {"timestamps": ["bad"], "users": ["u"]}),
    ]
    e = entities(spark, reports)
    assert [tuple(r) for r in R.report_nodes(e).collect()] == [("r", 1)]
    edges = edge_map(report_graph(spark, reports))
    assert edges["r", "2020-01-02"] == "timestamp_of_report" and edges["S2", "2020-01-02"] == "timestamp_of_attack_stage"
    assert edges["S1", "S2"] == edges["S2", "S1"] == "attack_stage_follows"
    assert ("r", "2020-01-03") not in edges


def test_process_chain_against_later_edges(spark):
    """A file named like a process: the chain wins only where it starts at the last position."""
    g = edge_map(report_graph(spark, [("r", {"processes": ["p", "q", "p"], "files": ["q"]})]))
    assert g["p", "q"] == "process_accesses_file"
    assert g["q", "p"] == "process_creates_process"
    g = edge_map(report_graph(spark, [("r", {"processes": ["p", "q"], "files": ["q"]})]))
    assert g["p", "q"] == "process_creates_process"


def test_reduced_graph_has_only_plain_pairs(spark):
    reports = [("r", {"ips": ["1.1.1.1", "2.2.2.2"], "domains": ["d"], "ports": ["80"], "processes": ["p"]})]
    kinds = set(edge_map(report_graph(spark, reports, kinds=BASIC_KINDS)).values())
    assert kinds == {"report_contains_ip", "report_contains_domain", "ip_appears_with_domain"}


def test_same_graph_for_any_partitioning(spark):
    rnd = random.Random(3)
    pool = [f"v{i}" for i in range(12)]
    reports = [(f"r{i % 9}", {f: rnd.sample(pool, 3) for f in ENTITY_FIELDS if f != "timestamps"}) for i in range(12)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        g = report_graph(spark, reports)
        found.append((edge_map(g), node_map(g)))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_hot_report_is_cut_into_blocks(spark, monkeypatch):
    reports = [("hot", {"ips": [f"i{k}" for k in range(40)], "files": [f"f{k}" for k in range(50)]}), ("r", {"ips": ["i1"], "files": ["x"]})]
    plain = edge_map(report_graph(spark, reports))
    monkeypatch.setattr(R, "BLOCK_ROWS", 8)
    monkeypatch.setattr(PJ.blocked_join, "__defaults__", (8,))
    assert edge_map(report_graph(spark, reports)) == plain
    assert sum(t == "ip_appears_with_file" for t in plain.values()) == 40 * 50 + 1


@pytest.mark.parametrize("block", [2, 5, 1000])
def test_blocked_join_is_the_plain_join(spark, sorted_rows, block):
    rnd = random.Random(block)
    make = lambda n, name: spark.createDataFrame([(rnd.choice("aaaab"), i) for i in range(n)], f"k string, {name} int")
    left, right = make(30, "x"), make(23, "y")
    assert sorted_rows(PJ.blocked_join(left, right, "k", "x", "y", block), "k", "x", "y") == sorted_rows(left.join(right, "k"), "k", "x", "y")


def test_dense_index_is_dense_and_ordered(spark):
    rnd = random.Random(1)
    data = [(rnd.choice("aaaaaab"), i) for i in rnd.sample(range(10000), 2000)]
    got = dense_index(spark.createDataFrame(data, "g string, v int"), ["v"], ["g"]).collect()
    for g in "ab":
        want = {v: i for i, v in enumerate(sorted(v for k, v in data if k == g))}
        assert {r["v"]: r["idx"] for r in got if r["g"] == g} == want


def test_local_ids_follow_first_write(spark):
    g = report_graph(spark, [("r1", {"processes": ["z", "a"]}), ("r0", {"processes": ["m", "z"]})])
    ids = {(r["ntype"], r["key"]): r["local_id"] for r in local_ids(g.nodes).collect()}
    assert ids == {("report", "r1"): 0, ("report", "r0"): 1, ("process", "z"): 0, ("process", "a"): 1, ("process", "m"): 2}


ALERT = "alert_idx long, agent_name string, ts_raw string, rule_id string, description string, process_name string, destination_port string, user_name string, full_log string"


def alert_graph(spark, rows, mode="all"):
    return A.build_alert_graph(normalize_alerts(spark.createDataFrame(rows, ALERT), text_columns=["full_log"]), mode)


def test_first_seen_gate(spark):
    rows = [
        (0, "h", "2024-01-01", "1", "scan", "p", "80", "u", "10.0.0.1 /etc/a"),
        (1, "h", None, "2", "scan", "p", "80", "u", "10.0.0.2 /etc/b"),
        (2, "p2", "2024-01-02", "3", "cve", "p2", None, "h", "10.0.0.3"),
    ]
    first, every = edge_map(alert_graph(spark, rows, "first_seen")), edge_map(alert_graph(spark, rows))
    assert ("p", "10.0.0.2") not in first and every["p", "10.0.0.2"] == "process_connects_to_ip"
    assert ("alert_1", "p") not in first and first["alert_0", "p"] == "alert_involves_process"
    # p2 is a host already, h as well: neither becomes a process or user of its own
    assert ("p2", "10.0.0.3") in first and first["p2", "10.0.0.3"] == "host_has_ip"
    assert ("alert_2", "h") not in first and every["alert_2", "h"] == "alert_involves_user"
    # no stale date: the alert without one dates nothing
    assert first["Reconnaissance", "2024-01-01"] == "timestamp_of_attack_stage"
    assert first["Reconnaissance", "Exploitation"] == "attack_stage_follows"
    assert node_map(alert_graph(spark, rows))["h"] == "host"


def small_sides(spark):
    reports = [
        ("r0", {"ips": ["10.0.0.1"], "files": ["/opt/a"], "processes": ["sh"], "timestamps": ["2024-01-01"], "attack_stages": ["Reconnaissance"]}),
        ("r1", {"ips": ["10.0.0.1", "10.0.0.9"], "files": ["/x/opt/a/b/c"], "timestamps": ["2024-01-01"]}),
        ("r2", {"ips": ["10.0.0.1"], "files": ["/opt/a"], "processes": ["sh"], "timestamps": ["2024-01-01"], "attack_stages": ["Reconnaissance"]}),
    ]
    alerts = [
        (0, "h0", "2024-01-01", "1", "scan", "bash", None, None, "10.0.0.1 /opt/a/b"),
        (1, "h0", "2024-01-01", "1", "scan", "bash", None, None, "10.0.0.1 /opt/a/b"),
        (2, "h1", "2024-01-02", "2", "other", "zzz", None, None, "10.0.0.7 /nothing/here"),
    ]
    stored = lambda g: Graph(*[checkpointed(df) for df in g])
    return stored(report_graph(spark, reports)), stored(alert_graph(spark, alerts))


def test_links_equal_nested_loops(spark):
    a, b = small_sides(spark)
    ea, eb = edge_map(a), edge_map(b)
    into = lambda e, kinds: [(s, d) for (s, d), t in e.items() if t in kinds]
    meet = {"=": lambda x, y: x == y, "in": lambda x, y: x in y or y in x}

    def brute(ra, rb, how):
        return {(s, t) for (s, x), (t, y) in itertools.product(into(ea, ra), into(eb, rb)) if meet[how](x, y)}

    cases = [
        (L.link_by_ip, L.BY_IP, "="),
        (L.link_by_file, L.BY_FILE, "in"),
        (L.link_by_process, L.BY_PROCESS, "in"),
        (L.link_by_day, L.BY_DAY, "="),
        (L.link_by_stage, L.BY_STAGE, "="),
    ]
    decided = {}
    for fn, kind, how in cases:
        links = fn(a, b)
        want = brute(kind.report_edges, kind.alert_edges, how)
        got = [(r["src"], r["dst"]) for r in L.link_pairs(links).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert {r["src"]: r["n"] for r in L.links_per_source(links).collect()} == {s: sum(p[0] == s for p in want) for s, _ in want}
        decided[kind.name] = want
    # sources that touch the same shared indicators form one group
    for fn, n in ((L.link_by_ip, 1), (L.link_by_file, 2)):
        assert fn(a, b).src_members.select("group").distinct().count() == n
    last = {}
    for name in ["report_related_to_alert", "report_related_to_rule", "report_related_to_alert_by_time", "report_related_to_alert_by_process", "report_related_to_alert_by_attack_stage"]:
        last.update({p: name for p in decided[name]})
    links, stages = L.merge_links(a, b)
    edges = {(r["src"], r["dst"]): r["etype"] for r in L.merged_link_edges(links, stages).collect()}
    assert {k: v for k, v in edges.items() if k in last} == last
    counts = {r["etype"]: r["n"] for r in L.link_counts(links).collect()}
    assert counts == {n: list(last.values()).count(n) for n in set(last.values())}
    assert {r["etype"]: r["n"] for r in L.deciding_counts(a, b).collect()} == counts
    assert L.link_pairs(L.link_by_day(a, b, "parity")).count() == 0


@pytest.mark.parametrize("mode", ["intended", "parity"])
def test_deciding_counts_equal_pairs(spark, mode):
    """Partners with several keys of a kind, indicators of several kinds, copies on both sides."""
    draw = random.Random(12)
    some = lambda pool, most: draw.sample(pool, draw.randint(0, most))
    names = {"ip": [f"10.0.0.{i}" for i in range(6)], "file": ["/a", "/a/b", "/a/b/c", "/d", "/d/e"], "process": ["sh", "bash", "zsh", "cron"], "timestamp": ["d1", "d2", "d3"], "attack_stage": ["x", "y"]}
    nodes = [(k, kind, i) for i, (kind, keys) in enumerate(names.items()) for k in keys]

    def side(prefix, count, edges):
        rows = []
        for n in range(count):
            for kind, etypes in edges.items():
                rows += [(f"{prefix}{n}", k, draw.choice(etypes)) for k in some(names[kind], 2)]
            if n % 3 == 0:
                rows += [(f"{prefix}{n}copy", d, e) for s, d, e in rows if s == f"{prefix}{n}"]
        # one edge kind for each pair, as in a graph
        last = {(s, d): (s, d, e, i) for i, (s, d, e) in enumerate(rows)}
        own = spark.createDataFrame(nodes, "key string, ntype string, ord long")
        return Graph(own, spark.createDataFrame(list(last.values()), "src string, dst string, etype string, ord long"))

    kinds = [L.BY_IP, L.BY_FILE, L.BY_PROCESS, L.BY_DAY, L.BY_STAGE]
    a = side("r", 12, {k.kind: k.report_edges for k in kinds})
    b = side("p", 25, {k.kind: k.alert_edges for k in kinds})
    want = {r["etype"]: r["n"] for r in L.link_counts(L.merge_links(a, b, mode)[0]).collect()}
    assert len(want) == (5 if mode == "intended" else 3)
    assert {r["etype"]: r["n"] for r in L.deciding_counts(a, b, mode).collect()} == want


def test_merge_prefers_reports_then_links(spark):
    a, b = small_sides(spark)
    links = L.merged_link_edges(*L.merge_links(a, b))
    merged = L.merge_graphs(a, b, links)
    edges = edge_map(merged)
    want = {**edge_map(b), **edge_map(a), **{(r["src"], r["dst"]): r["etype"] for r in links.collect()}}
    assert edges == want
    assert node_map(merged) == {**node_map(b), **node_map(a)}


def test_containment_equals_nested_loop(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("ab/") for _ in range(rnd.randint(1, 7)))
    x, y = sorted({word() for _ in range(60)}), sorted({word() for _ in range(60)})
    frame = lambda v: spark.createDataFrame([(s,) for s in v], "key string")
    got = {tuple(r) for r in containment_pairs(frame(x), frame(y)).collect()}
    assert got == {(s, t) for s in x for t in y if s in t or t in s}


def test_snapshot_slots(spark):
    days = lambda *ks: spark.createDataFrame([(f"2024-01-{k:02d}",) for k in ks], "day string")
    slots = lambda df, **kw: {int(r["day"][-2:]): r["snapshot_id"] for r in S.assign_snapshot(df, 5, **kw).collect()}
    whole = days(*range(1, 12))
    assert slots(whole) == {k: min((k - 1) // 2, 4) for k in range(1, 12)}
    assert slots(whole, include_last=False) == {k: (k - 1) // 2 for k in range(1, 11)}
    assert slots(days(1, 2, 3, 4)) == {1: 0, 2: 1, 3: 3, 4: 4}
    assert slots(days(1, 2, 3, 4), mode="whole") == {1: 1, 2: 3, 3: 4, 4: 4}
    assert slots(days(5, 5)) == {}


def test_snapshots_cut_the_graph(spark):
    g = report_graph(
        spark,
        [
            ("r0", {"timestamps": ["2024-01-01"], "ips": ["1.1.1.1"], "files": ["/a/b"]}),
            ("r1", {"timestamps": ["2024-01-11"], "ips": ["1.1.1.1"], "users": ["u"]}),
            ("r2", {"ips": ["9.9.9.9"]}),
        ],
    )
    cut = S.snapshot_graph(g, 5)
    nodes = {(r["snapshot_id"], r["key"]) for r in cut.nodes.collect()}
    assert nodes == {(0, "2024-01-01"), (0, "r0"), (0, "1.1.1.1"), (0, "/a/b"), (4, "2024-01-11"), (4, "r1"), (4, "1.1.1.1")}
    edges = {(r["snapshot_id"], r["src"], r["dst"]) for r in cut.edges.collect()}
    assert (0, "1.1.1.1", "/a/b") in edges and (4, "1.1.1.1", "/a/b") not in edges and (4, "r1", "2024-01-11") in edges
    wide = S.snapshot_graph(g, 5, "all")
    assert (4, "u") in {(r["snapshot_id"], r["key"]) for r in wide.nodes.collect()}
