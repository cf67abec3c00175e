"""Edges gathered at one end, and types by implied kind: the rows of the plain ways, with fewer of them shuffled."""

import itertools

import pytest

from threatloom.operators import gather as G
from threatloom.operators import report_graph as R
from threatloom.operators.counts import with_types
from threatloom.operators.writes import dedup_edges
from threatloom.vocab import ALL_KINDS, PAIR_EDGES

KINDS = ["ip", "domain", "hash", "file", "process", "port", "user", "attack_stage"]


def listed(df):
    return sorted((tuple(r) for r in df.select("src", "dst", "etype", "ord").collect()), key=str)


@pytest.fixture
def ment(spark):
    # "both" is an address, a path and the name of a report; "r1" names two reports; one report has no number
    rows = [(i, f"r{i}", k, p, f"{k}{(i * 7 + p * 3) % n}") for i in range(12) for k, n in zip(KINDS, (3, 40, 50, 40, 4, 2, 3, 2)) for p in range(3)]
    rows += [(20, "r1", "ip", 0, "both"), (20, "r1", "file", 0, "both"), (20, "r1", "domain", 0, "domain1"), (21, "both", "hash", 0, "both")]
    rows += [(22, None, "ip", 0, "ip1"), (22, None, "file", 0, ""), (None, "r9", "ip", 0, "ip2"), (None, "r9", "file", 0, "f"), (1, "r1b", "hash", 0, "h")]
    return spark.createDataFrame(rows, "report_idx long, report_name string, kind string, pos int, value string")


PAIRS = [p for p in PAIR_EDGES if p[2] in ("ip_appears_with_file", "ip_communicates_with_ip", "domain_resolves_to_ip", "hash_appears_with_file")]


@pytest.mark.parametrize("share, mode", [(1, "parity"), (30, "parity"), (10_000, "parity"), (30, "multi")])
def test_gathered_edges_are_those_of_the_plain_dedup(spark, monkeypatch, ment, share, mode):
    distinct = R.distinct_mentions(ment)
    times = spark.createDataFrame([(1, "r1", "ip1"), (21, "both", "d")], "report_idx long, report_name string, day string")
    more = [R.report_time_edges(times), R.chain(ment, distinct, "process", "process_creates_process")]
    plain = R.report_edges(ment, ALL_KINDS).unionByName(R.cooccur(distinct, PAIRS))
    for m in more:
        plain = plain.unionByName(m)
    want = listed(dedup_edges(plain, mode))
    monkeypatch.setattr(G, "SHARE", share)
    assert listed(R.gathered_edges(ment, PAIRS, ALL_KINDS, more, mode)) == want
    if share == 30:
        monkeypatch.setattr(R, "BLOCK_ROWS", 40)
        assert listed(R.gathered_edges(ment, PAIRS, ALL_KINDS, more, mode)) == want


def test_a_value_that_is_not_common_travels_once_a_report(spark, monkeypatch):
    rows = [(i, f"r{i}", k, p, f"{k}-{i}-{p}") for i in range(3) for k in ("hash", "file") for p in range(6)]
    df = spark.createDataFrame(rows, "report_idx long, report_name string, kind string, pos int, value string")
    monkeypatch.setattr(G, "SHARE", 1)
    seen = []
    monkeypatch.setattr(R, "dedup_gathered", lambda bundles, *a: seen.append(bundles.count()) or G.dedup_gathered(bundles, *a))
    edges = R.gathered_edges(df, [("hash", "file", "hash_appears_with_file")])
    assert edges.count() == 3 * 36
    assert seen == [3 * 6]


def test_types_by_implied_kind(spark):
    nodes = [("r", "report"), ("i", "ip"), ("x", "domain"), ("twice", "ip"), ("twice", "file"), ("untyped", None), (None, "ip")]
    ends = ["r", "i", "x", "twice", "untyped", "missing", None]
    kinds = ["report_contains_ip", "ip_appears_with_file", "of_no_kind", None]
    edges = spark.createDataFrame(list(itertools.product(ends, ends, kinds)), "src string, dst string, etype string")
    nodes = spark.createDataFrame(nodes, "key string, ntype string")
    of = lambda *a: sorted(tuple(r) for r in with_types(nodes, edges, *a).select("src", "dst", "etype", "src_type", "dst_type").collect())
    assert of(0) == of()
    by = lambda df: df.crossJoin(spark.range(2).withColumnRenamed("id", "snapshot_id"))
    nodes, edges = by(nodes), by(edges).where("snapshot_id = 1 or src <> 'x'")
    assert of(0) == of()
    assert "untyped" not in {r[0] for r in of(0)}
