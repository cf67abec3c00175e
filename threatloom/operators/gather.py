"""Dedup of edge writes that are gathered at one of their ends.

A pair of values is dealt by one end only, so the value travels once with a list of its partners and not once for every
pair, and the pairs are made where they are dedupped. Which end that is depends on the two values alone, so all
writes of a pair meet: the source unless it is common, else the target unless it is common too. Pairs of two common
values are few; they are summed up before their shuffle like any other rows.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.operators.writes import PLACES, edge_kind, place
from threatloom.session import checkpointed

# A value in more than one of SHARE rows is common, so there are fewer than SHARE of them.
SHARE = 10_000


def common_values(values: DataFrame, names: DataFrame) -> DataFrame:
    """The common ones of ``values(value)`` that are none of ``names(value)``, as a table small enough to be broadcast."""
    counted = checkpointed(values.where("value is not null").groupBy("value").agg(F.count("*").alias("n")))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common = checkpointed(counted.where(F.col("n") * SHARE > total).select("value"))
    named = names.join(F.broadcast(common), "value", "left_semi").distinct()
    return checkpointed(common.join(F.broadcast(named), "value", "left_anti"))


def gather(writes: DataFrame, common: DataFrame):
    """Writes (src, dst, ord) as bundles (key, at_src, base, values, places) of one partner each, and those of two common values."""
    flag = lambda end: F.broadcast(common.select(F.col("value").alias(end), F.lit(True).alias(f"{end}_common")))
    known = writes.join(flag("src"), "src", "left").join(flag("dst"), "dst", "left")
    at_src, at_dst = F.col("src_common").isNull(), F.col("dst_common").isNull()
    where = F.col("ord").bitwiseAND(F.lit(PLACES - 1).cast("long"))
    bundles = known.where(at_src | at_dst).select(
        F.when(at_src, F.col("src")).otherwise(F.col("dst")).alias("key"),
        at_src.alias("at_src"),
        (F.col("ord") - where).alias("base"),
        F.array(F.when(at_src, F.col("dst")).otherwise(F.col("src"))).alias("values"),
        F.array(where.cast("byte")).alias("places"),
    )
    return bundles, known.where(~at_src & ~at_dst).select("src", "dst", "ord")


def apart(first, second, where):
    """No address is linked with itself."""
    return (where != place("ip_communicates_with_ip")) | (first != second)


def dedup_gathered(bundles: DataFrame, writes: DataFrame, mode="parity") -> DataFrame:
    """``dedup_edges`` of the bundles' pairs and of the ``writes`` of two common values together."""
    rows = bundles.repartition("key").select("key", "at_src", "base", "places", F.posexplode("values").alias("i", "value"))
    where = F.get("places", F.col("i"))
    rows = rows.where(apart(F.col("key"), F.col("value"), where)).select("key", "at_src", "value", (F.col("base") + where).alias("ord"))
    kind = [] if mode == "parity" else ["etype"]
    tagged = lambda df: df.withColumn("etype", edge_kind()) if kind else df
    gathered = tagged(rows).groupBy("key", "at_src", "value", *kind).agg(F.max("ord").alias("ord"))
    gathered = gathered.select(
        F.when(F.col("at_src"), F.col("key")).otherwise(F.col("value")).alias("src"),
        F.when(F.col("at_src"), F.col("value")).otherwise(F.col("key")).alias("dst"),
        *kind,
        "ord",
    )
    both = gathered.unionByName(tagged(writes).groupBy("src", "dst", *kind).agg(F.max("ord").alias("ord")))
    return both.select("src", "dst", edge_kind().alias("etype"), "ord")
