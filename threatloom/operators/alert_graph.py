"""Typed graph of alerts, hosts, rules and what they touch."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from threatloom.operators.graph import Graph
from threatloom.operators.writes import PLACES, dedup_edges, dedup_nodes, edge_ord, edge_writes, node_kind, node_ord, place
from threatloom.session import checkpointed
from threatloom.vocab import STAGE_ORDER, UNKNOWN_STAGE_ORDER

GATED = {"process": "process", "port": "port", "user": "user", "attack_stage": "stage"}


def alert_node_writes(rows: DataFrame) -> DataFrame:
    """Node writes of normalized alerts, all kinds from one pass over the rows."""

    def one(kind, column):
        return F.array(F.struct(node_ord("alert_idx", kind).alias("ord"), F.lit(0).cast("long").alias("pos"), F.col(column).alias("key")))

    def many(kind, column):
        return F.transform(
            column, lambda v, i: F.struct(node_ord("alert_idx", kind).alias("ord"), i.cast("long").alias("pos"), v.alias("key"))
        )

    writes = F.concat(
        one("alert", "alert"),
        one("host", "host"),
        one("timestamp", "day"),
        one("rule", "rule"),
        many("ip", "ips"),
        many("file", "files"),
        one("process", "process"),
        one("port", "port"),
        one("user", "user"),
        one("attack_stage", "stage"),
    )
    return rows.select(F.explode(writes).alias("w")).select("w.key", "w.ord", "w.pos").where("key is not null")


def gate(rows: DataFrame, mode="all", nodes: DataFrame = None) -> DataFrame:
    """Mark which of an alert's process, port, user and stage may write edges.

    ``all``: every one present. ``first_seen``: only where this alert is the first to write
    that key, and no other kind of node wrote it before. The first write of a key names its
    alert, so the marks come back by a join on the alert number, which no hot key can skew.
    ``nodes`` may hand in the finished nodes, whose ``ord`` is that first write.
    """
    marks = {f"new_{col}": kind for kind, col in GATED.items()}
    if mode == "all":
        return rows.select("*", *[F.col(GATED[kind]).isNotNull().alias(m) for m, kind in marks.items()])
    if nodes is None:
        firsts = alert_node_writes(rows).groupBy("key").agg(F.min("ord").alias("ord"))
    else:
        firsts = nodes.select("key", "ord")
    kind = node_kind("ord")
    firsts = firsts.where(kind.isin(*GATED)).select(F.shiftright("ord", PLACES.bit_length() - 1).alias("alert_idx"), kind.alias("kind"))
    flags = firsts.groupBy("alert_idx").agg(*[F.bool_or(F.col("kind") == k).alias(m) for m, k in marks.items()])
    joined = rows.join(flags, "alert_idx", "left")
    return joined.select(*rows.columns, *[F.coalesce(m, F.lit(False)).alias(m) for m in marks])


def alert_edges(gated: DataFrame) -> DataFrame:
    """Edge writes of gated alerts; each alert's writes are built as one list and exploded once."""

    def w(src, dst, name):
        return F.struct(src.alias("src"), dst.alias("dst"), F.lit(place(name)).alias("place"))

    none = F.array().cast("array<struct<src:string,dst:string,place:int>>")
    c = F.col

    def one(name, src, dst, when=None):
        both = c(src).isNotNull() & c(dst).isNotNull()
        return F.when(both if when is None else both & when, F.array(w(c(src), c(dst), name))).otherwise(none)

    def to_list(name, src, items, when=None):
        ok = c(src).isNotNull() if when is None else c(src).isNotNull() & when
        return F.when(ok, F.transform(items, lambda v: w(c(src), v, name))).otherwise(none)

    def from_list(name, items, dst, when):
        return F.when(c(dst).isNotNull() & when, F.transform(items, lambda v: w(v, c(dst), name))).otherwise(none)

    process, port, user, stage = c("new_process"), c("new_port"), c("new_user"), c("new_stage")
    writes = F.concat(
        one("alert_on_host", "alert", "host"),
        one("alert_at_timestamp", "alert", "day"),
        one("alert_triggered_by_rule", "alert", "rule"),
        to_list("host_has_ip", "host", "ips"),
        to_list("alert_involves_ip", "alert", "ips"),
        to_list("rule_related_to_file", "rule", "files"),
        to_list("alert_involves_file", "alert", "files"),
        one("host_runs_process", "host", "process", process),
        one("alert_involves_process", "alert", "process", process),
        to_list("process_accesses_file:alert", "process", "files", process),
        to_list("process_connects_to_ip:alert", "process", "ips", process),
        from_list("ip_uses_port:alert", "ips", "port", port),
        one("process_uses_port:alert", "process", "port", port),
        one("alert_involves_user", "alert", "user", user),
        one("user_owns_process:alert", "user", "process", user),
        to_list("user_accesses_file:alert", "user", "files", user),
        one("alert_related_to_attack_stage", "alert", "stage", stage),
        one("timestamp_of_attack_stage:alert", "stage", "day", stage),
        to_list("attack_stage_involves_ip:alert", "stage", "ips", stage),
        to_list("attack_stage_involves_file:alert", "stage", "files", stage),
        one("attack_stage_involves_process:alert", "stage", "process", stage),
    )
    return gated.select("alert_idx", F.explode(writes).alias("w")).select(
        "w.src", "w.dst", edge_ord("alert_idx", F.col("w.place")).alias("ord")
    )


def stage_chain(nodes: DataFrame) -> DataFrame:
    """Edge writes between neighbouring stages in kill-chain order.

    Stage nodes of alerts come from a fixed list of five names, so the unpartitioned window
    sorts a handful of rows.
    """
    order = F.create_map(*[F.lit(v) for p in STAGE_ORDER.items() for v in p])
    rank = F.coalesce(order[F.col("key")], F.lit(UNKNOWN_STAGE_ORDER))
    nxt = F.lead("key").over(W.orderBy(rank, "ord", "key"))
    stages = nodes.where(F.col("ntype") == "attack_stage").select("key", nxt.alias("next")).where("next is not null")
    return edge_writes(stages, "key", "next", F.lit(0), "attack_stage_follows:alert", phase=1)


def build_alert_graph(rows: DataFrame, mode="all") -> Graph:
    """Whole alert graph from normalized rows; ``mode`` is the first-seen gate's."""
    nodes = checkpointed(dedup_nodes(alert_node_writes(rows)))
    edges = alert_edges(gate(rows, mode, nodes)).unionByName(stage_chain(nodes))
    return Graph(nodes, dedup_edges(edges))
