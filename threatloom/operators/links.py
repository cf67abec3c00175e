"""Merging the report graph with the alert graph, and the links between them.

Reports and alerts that share an indicator are all linked with each other, so a common
indicator makes a product. Links are therefore kept between *groups*: sources that touch
exactly the same indicators (repeated alerts, copied reports) have the same links and
form one group. Counting and deciding between link kinds happen on groups; ``link_pairs`` writes the
single pairs out where they are wanted.
"""

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.operators.containment import containment_pairs
from threatloom.operators.graph import Graph
from threatloom.operators.pairs import blocked_join, broadcast_if_small
from threatloom.operators.writes import PHASE, PLACES, edge_kind, place
from threatloom.session import checkpointed

SHARED_KINDS = ["ip", "file", "timestamp", "process", "attack_stage"]


class Links(NamedTuple):
    """``groups(src_group, dst_group, place)`` and the members ``(group, key)`` of either side."""

    groups: DataFrame
    src_members: DataFrame
    dst_members: DataFrame


class LinkKind(NamedTuple):
    """Node kind, edge kinds into it on both sides, name of the link, and whether keys match by containment."""

    kind: str
    report_edges: list
    alert_edges: list
    name: str
    contained: bool = False


# Which edges meet in which link.
BY_IP = LinkKind("ip", ["report_contains_ip"], ["alert_involves_ip", "host_has_ip"], "report_related_to_alert")
BY_FILE = LinkKind("file", ["report_contains_file"], ["rule_related_to_file", "alert_involves_file"], "report_related_to_rule", True)
BY_DAY = LinkKind("timestamp", ["timestamp_of_report"], ["alert_at_timestamp"], "report_related_to_alert_by_time")
BY_PROCESS = LinkKind("process", ["report_contains_process"], ["alert_involves_process"], "report_related_to_alert_by_process", True)
BY_STAGE = LinkKind(
    "attack_stage", ["report_describes_attack_stage"], ["alert_related_to_attack_stage"], "report_related_to_alert_by_attack_stage"
)
# Edge kinds that the plain reading of the two late links looks for, and that no builder writes.
PARITY_EDGES = {"timestamp": ["report_at_timestamp"], "attack_stage": ["report_related_to_attack_stage"]}


def _merge_kinds(mode) -> list:
    """The link kinds of a merge, weakest first."""
    kinds = [BY_IP, BY_FILE, BY_PROCESS] + ([BY_DAY, BY_STAGE] if mode == "intended" else [])
    return sorted(kinds, key=lambda k: place(k.name))


def _union(frames):
    return reduce(DataFrame.unionByName, frames)


def _keys(graph: Graph, kind: str) -> DataFrame:
    return graph.nodes.where(F.col("ntype") == kind).select("key")


def shared_keys(a: Graph, b: Graph, kind: str) -> DataFrame:
    """Keys that are nodes of ``kind`` in both graphs."""
    return _keys(a, kind).join(_keys(b, kind), "key", "left_semi")


def shared_key_counts(a: Graph, b: Graph, kinds=tuple(SHARED_KINDS)) -> DataFrame:
    both = lambda g: g.nodes.where(F.col("ntype").isin(*kinds)).select("key", "ntype")
    common = both(a).join(both(b), ["key", "ntype"], "left_semi")
    found = common.groupBy(F.col("ntype").alias("kind")).agg(F.count("*").alias("n"))
    wanted = a.nodes.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    return wanted.join(found, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


def _matches(a: Graph, b: Graph, link: LinkKind) -> DataFrame:
    """Pairs (a_key, b_key) of keys that count as the same indicator."""
    if link.contained:
        return containment_pairs(_keys(a, link.kind), _keys(b, link.kind))
    return shared_keys(a, b, link.kind).select(F.col("key").alias("a_key"), F.col("key").alias("b_key"))


def _touches(edges: DataFrame, etypes, match: DataFrame, side: str, link: LinkKind) -> DataFrame:
    """(key, at, place): sources of the given edges into matched indicators."""
    into = edges.where(F.col("etype").isin(*etypes)).select(F.col("src").alias("key"), F.col("dst").alias("at"))
    matched = match.select(F.col(side).alias("at")).distinct()
    return into.join(matched, "at", "left_semi").distinct().withColumn("place", F.lit(place(link.name)))


def _grouped(touches: DataFrame):
    """Sources with the same set of (place, indicator) share a group, named by its first member.

    A set is recognised by its size and two 64-bit hashes folded with xor, which sums up before
    the shuffle and never holds a set in one place.
    """
    touches = checkpointed(touches)
    fold = lambda seed: F.bit_xor(F.xxhash64("place", "at", F.lit(seed)))
    sets = touches.groupBy("key").agg(fold(1).alias("h1"), fold(2).alias("h2"), F.count("*").alias("n"))
    names = sets.groupBy("h1", "h2", "n").agg(F.min("key").alias("group"))
    members = checkpointed(sets.join(names, ["h1", "h2", "n"]).select("group", "key"))
    heads = members.where("group = key").select("key")
    return checkpointed(touches.join(heads, "key", "left_semi").withColumnRenamed("key", "group")), members


def _link(a: Graph, b: Graph, kinds) -> Links:
    """Links of several kinds over one grouping of each side; of several kinds for a pair the last decides.

    Steps that later ones read more than once are checkpointed, so nothing is computed twice.
    """
    matches = {k.name: checkpointed(_matches(a, b, k)) for k in kinds}
    reports, src_members = _grouped(_union([_touches(a.report_edges, k.report_edges, matches[k.name], "a_key", k) for k in kinds]))
    alerts, dst_members = _grouped(_union([_touches(b.edges, k.alert_edges, matches[k.name], "b_key", k) for k in kinds]))
    found = []
    for k in kinds:
        here = F.col("place") == place(k.name)
        left = reports.where(here).select(F.col("group").alias("src_group"), F.col("at").alias("a_key"))
        right = alerts.where(here).select(F.col("group").alias("dst_group"), F.col("at").alias("b_key"))
        if k.contained:
            left = blocked_join(left, matches[k.name], "a_key", "src_group", "b_key").select("src_group", "b_key").distinct()
        else:
            left = left.withColumnRenamed("a_key", "b_key")
        met = blocked_join(left, right, "b_key", "src_group", "dst_group").select("src_group", "dst_group")
        found.append(met.withColumn("place", F.lit(place(k.name))))
    groups = _union(found).groupBy("src_group", "dst_group").agg(F.max("place").alias("place"))
    return Links(checkpointed(groups), src_members, dst_members)


def link_pairs(links: Links) -> DataFrame:
    """Every single pair (src, dst, place) of the links."""
    members = lambda m, side: m.select(F.col("group").alias(f"{side}_group"), F.col("key").alias(side))
    sources = blocked_join(links.groups, members(links.src_members, "src"), "src_group", "dst_group", "src")
    whole = blocked_join(checkpointed(sources.select("src", "dst_group", "place")), members(links.dst_members, "dst"), "dst_group", "src", "dst")
    return whole.select("src", "dst", "place")


def _sized(members, side):
    return members.groupBy(F.col("group").alias(f"{side}_group")).agg(F.count("*").alias(f"{side}_n"))


def link_counts(links: Links) -> DataFrame:
    """Number of pairs of every link kind, without writing the pairs out."""
    sized = links.groups.join(_sized(links.src_members, "src"), "src_group").join(_sized(links.dst_members, "dst"), "dst_group")
    return sized.groupBy(edge_kind("place").alias("etype")).agg(F.sum(F.col("src_n") * F.col("dst_n")).alias("n"))


def links_per_source(links: Links) -> DataFrame:
    """Number of linked partners of every report, without writing the pairs out."""
    sized = links.groups.join(_sized(links.dst_members, "dst"), "dst_group")
    totals = sized.groupBy(F.col("src_group").alias("group")).agg(F.sum("dst_n").alias("n"))
    return links.src_members.join(totals, "group").select(F.col("key").alias("src"), "n")


def partner_counts(a: Graph, b: Graph, kind: LinkKind) -> DataFrame:
    """Number of linked partners of every report for a kind of which a partner has one key at most.

    An alert has one day, one process and one stage, so no partner is met twice: partners are counted
    by key and added up over the report's matched keys, without groups or pairs.
    """
    into = lambda edges, etypes: edges.where(F.col("etype").isin(*etypes)).select("src", F.col("dst").alias("at")).distinct()
    sizes = into(b.edges, kind.alert_edges).groupBy(F.col("at").alias("b_key")).agg(F.count("*").alias("n"))
    reach = _matches(a, b, kind).join(sizes, "b_key").select(F.col("a_key").alias("at"), "b_key", "n")
    met = into(a.report_edges, kind.report_edges).join(reach, "at")
    if kind.contained:  # several keys of a report may lead to one key of the other side
        met = met.select("src", "b_key", "n").distinct()
    return met.groupBy("src").agg(F.sum("n").alias("n"))


def link_tables(a: Graph, b: Graph, mode="intended"):
    """All links in factored form: (report, place, indicator) and (place, indicator, partner), both distinct.

    A pair is linked by ``place`` if it meets in an indicator; the largest place of a pair decides. The
    tables are as long as the graphs' edges, where single pairs would be a product.
    """
    kinds = _merge_kinds(mode)
    left, right = [], []
    for k in kinds:
        match = checkpointed(_matches(a, b, k))
        left.append(_touches(a.report_edges, k.report_edges, match, "a_key", k).join(match.withColumnRenamed("a_key", "at"), "at").select(F.col("key").alias("src"), "place", F.col("b_key").alias("at")))
        right.append(_touches(b.edges, k.alert_edges, match, "b_key", k).select("place", "at", F.col("key").alias("dst")))
    return _union(left).distinct(), _union(right).distinct()


def deciding_counts(a: Graph, b: Graph, mode="intended") -> DataFrame:
    """(etype, n): pairs that each link kind decides, as ``link_counts`` of ``merge_links`` without the stage links.

    No pair is made. A partner's keys of one kind are a *part* (partners with the same keys share it), its parts
    a profile, and profiles are counted for every combination of kinds. A report reaches parts by its own keys. Pairs
    linked by the weakest kind of a combination and no stronger one follow by inclusion and exclusion: the combination
    counts with the sign of its size for its weakest kind. Combinations grow kind by kind and go on only while
    some partner has them, so the work follows the reports' own edges and not the partners behind them.
    """
    kinds = _merge_kinds(mode)
    places = [place(k.name) for k in kinds]
    fold = lambda *columns: [F.bit_xor(F.xxhash64(*columns, F.lit(seed))).alias(f"h{seed}") for seed in (1, 2)] + [F.count("*").alias("size")]
    same = ["h1", "h2", "size"]
    with_bit = lambda frames: _union([f.withColumn("bit", F.lit(1 << i)) for i, f in enumerate(frames)])

    matches = [checkpointed(_matches(a, b, k)) for k in kinds]
    touched = checkpointed(with_bit([_touches(b.edges, k.alert_edges, m, "b_key", k) for k, m in zip(kinds, matches)]))
    sets = checkpointed(touched.groupBy(F.col("key").alias("dst"), "bit").agg(*fold("at")))
    parts = checkpointed(sets.groupBy("bit", *same).agg(F.min("dst").alias("dst")).withColumn("part", F.monotonically_increasing_id()))
    of_partner = sets.join(parts.drop("dst"), ["bit", *same]).select("dst", "bit", "part")
    keys = touched.join(parts.select(F.col("dst").alias("key"), "bit", "part"), ["key", "bit"]).select("bit", F.col("at").alias("b_key"), "part")
    keys = checkpointed(with_bit(matches).join(keys, ["bit", "b_key"]).select("bit", "a_key", "part").distinct())
    bit_of = F.create_map(*[F.lit(v) for i, k in enumerate(kinds) for e in k.report_edges for v in (e, 1 << i)])
    into = a.report_edges.select("src", F.col("dst").alias("a_key"), bit_of[F.col("etype")].alias("bit")).where("bit is not null")
    reach = checkpointed(into.join(broadcast_if_small(keys), ["bit", "a_key"]).select("src", "bit", "part").distinct())
    # reports that reach the same parts are counted once, with their number
    alike = reach.groupBy("src").agg(*fold("bit", "part")).groupBy(*same).agg(F.min("src").alias("src"), F.count("*").alias("reports"))
    alike = checkpointed(alike.select("src", "reports").withColumn("report", F.monotonically_increasing_id()))
    reach = checkpointed(reach.join(alike, "src").select("report", "reports", "bit", "part"))

    columns = [f"part{i}" for i in range(len(places))]
    only = lambda wanted, part: [F.when(wanted(1 << i), part(c)).otherwise(-1).alias(c) for i, c in enumerate(columns)]
    profile = of_partner.groupBy("dst").agg(F.sum("bit").alias("has"), *[F.max(F.when(F.col("bit") == 1 << i, F.col("part"))).alias(c) for i, c in enumerate(columns)])
    profile = profile.groupBy("has", *columns).agg(F.count("*").alias("partners"))
    profile = profile.withColumn("mask", F.explode(F.sequence(F.lit(1), F.col("has").cast("int")))).where(F.col("mask").bitwiseAND(F.col("has")) == F.col("mask"))
    profile = profile.select("mask", "partners", *only(lambda one: F.col("mask").bitwiseAND(F.lit(one)) > 0, F.col))
    profile = checkpointed(profile.groupBy("mask", *columns).agg(F.sum("partners").alias("partners")))

    found = []
    state = reach.select("report", "reports", F.col("bit").alias("mask"), *only(lambda one: F.col("bit") == one, lambda c: F.col("part")))
    for size in range(1, len(places) + 1):
        met = checkpointed(state.join(profile, ["mask", *columns]))
        found.append(met.groupBy("mask").agg(F.sum(F.col("reports") * F.col("partners") * (1 if size % 2 else -1)).alias("n")))
        grown = met.drop("partners", "reports").join(reach, "report").where("bit > mask")
        kept = [F.when(F.col("bit") == 1 << i, F.col("part")).otherwise(F.col(c)).alias(c) for i, c in enumerate(columns)]
        state = grown.select("report", "reports", (F.col("mask") + F.col("bit")).alias("mask"), *kept)
    weakest = reduce(lambda x, i: F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) > 0, F.lit(places[i])).otherwise(x), reversed(range(len(places))), F.lit(None))
    counts = _union(found).groupBy(weakest.alias("place")).agg(F.sum("n").alias("n")).where("n > 0")
    return counts.groupBy(edge_kind("place").alias("etype")).agg(F.sum("n").cast("long").alias("n"))


def link_by_ip(a: Graph, b: Graph, alerts_only=False) -> Links:
    """Reports and the alerts (and hosts) that share an address."""
    return _link(a, b, [BY_IP._replace(alert_edges=["alert_involves_ip"]) if alerts_only else BY_IP])


def link_by_file(a: Graph, b: Graph) -> Links:
    """Reports and the rules and alerts whose path contains the report's, or the other way round."""
    return _link(a, b, [BY_FILE])


def link_by_process(a: Graph, b: Graph) -> Links:
    return _link(a, b, [BY_PROCESS])


def _mode(link: LinkKind, mode):
    return link if mode == "intended" else link._replace(report_edges=PARITY_EDGES[link.kind])


def link_by_day(a: Graph, b: Graph, mode="intended") -> Links:
    """Reports and alerts of one day; ``parity`` looks for an edge kind nobody writes."""
    return _link(a, b, [_mode(BY_DAY, mode)])


def link_by_stage(a: Graph, b: Graph, mode="intended") -> Links:
    return _link(a, b, [_mode(BY_STAGE, mode)])


def shared_stage(a: Graph, b: Graph) -> DataFrame:
    """Stages tied on both sides to one address or process; the link is a self-loop.

    By address the addresses are equal; by process one name may contain the other.
    """
    touch = lambda g, what: g.edges.where(F.col("etype") == f"attack_stage_involves_{what}").select("src", F.col("dst").alias("key"))
    by_ip = touch(a, "ip").join(shared_keys(a, b, "ip"), "key", "left_semi").join(touch(b, "ip"), ["src", "key"], "left_semi")
    match = containment_pairs(_keys(a, "process"), _keys(b, "process")).select(F.col("a_key").alias("key"), "b_key")
    reach = touch(a, "process").join(match, "key").select("src", F.col("b_key").alias("key"))
    by_process = reach.join(touch(b, "process"), ["src", "key"], "left_semi")
    loop = lambda d, name: d.select("src", F.col("src").alias("dst")).distinct().withColumn("place", F.lit(place(name)))
    return loop(by_ip, "shared_attack_stage:ip").unionByName(loop(by_process, "shared_attack_stage:process"))


def stages_same_day(a: Graph, b: Graph) -> DataFrame:
    """Stages of both sides on one day. An alert's stage is one of five, so a day cannot blow up."""
    dated = lambda g, name: g.edges.where(F.col("etype") == "timestamp_of_attack_stage").select(F.col("dst").alias("day"), F.col("src").alias(name))
    days = shared_keys(a, b, "timestamp").withColumnRenamed("key", "day")
    joined = dated(a, "src").join(days, "day", "left_semi").join(dated(b, "dst"), "day")
    return joined.select("src", "dst").distinct().withColumn("place", F.lit(place("attack_stages_at_same_time")))


def merge_links(a: Graph, b: Graph, mode="intended"):
    """All links: those between groups of reports and alerts, and the pairs of stages.

    Of several link kinds for one pair ip < file < day < process < stage decides. ``parity``
    leaves out the two links that never match in the plain reading.
    """
    kinds = _merge_kinds(mode)
    stages = shared_stage(a, b).unionByName(stages_same_day(a, b)).groupBy("src", "dst").agg(F.max("place").alias("place"))
    return _link(a, b, kinds), stages


def merged_link_edges(links: Links, stages: DataFrame) -> DataFrame:
    """All links as single edges."""
    last = link_pairs(links).unionByName(stages).groupBy("src", "dst").agg(F.max("place").cast("long").alias("ord"))
    return last.select("src", "dst", edge_kind().alias("etype"), "ord")


def merge_graphs(a: Graph, b: Graph, links: DataFrame = None) -> Graph:
    """Union of a report graph and an alert graph, and of link edges where given.

    A key or pair on both sides is the report graph's; a link replaces either. ``ord`` of the
    merged nodes puts all report nodes before the alert nodes.
    """
    nodes_b = b.nodes.join(a.nodes.select("key"), "key", "left_anti").withColumn("ord", F.col("ord") + F.lit(PHASE).cast("long"))
    nodes = a.nodes.unionByName(nodes_b)
    leveled = lambda e, n: e.select("src", "dst", (F.lit(n * PLACES) + F.col("ord").bitwiseAND(F.lit(PLACES - 1))).cast("long").alias("ord"))
    edges = leveled(b.edges, 0).unionByName(leveled(a.edges, 1))
    if links is not None:
        edges = edges.unionByName(leveled(links, 2))
    edges = edges.groupBy("src", "dst").agg(F.max("ord").alias("ord"))
    return Graph(nodes, edges.select("src", "dst", edge_kind().alias("etype"), "ord"))
