"""Pair labels and samples."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threatloom.operators.pairs import BLOCK_ROWS, blocked_join, broadcast_if_small
from threatloom.operators.ranking import dense_index, take_per_group
from threatloom.session import checkpointed

# Nodes up to this number are broadcast as numbers to meet the pairs.
NODE_ROWS = 1_000_000


def project_pairs(edges: DataFrame, left: str, via: str, by=("s",)) -> DataFrame:
    """How many ``via`` items two ``left`` members share: (by, src, dst, n), both directions, no self pairs.

    An item's members are listed in one row and the pairs read off the list, so what is shuffled before the count is one row
    a member. An item with very many members is joined in blocks instead.
    """
    by = list(by)
    member = edges.select(*by, F.col(via).alias("_via"), F.col(left).alias("src")).dropna(subset=[*by, "_via", "src"])
    on = [*by, "_via"]
    large = checkpointed(member.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > BLOCK_ROWS).select(*on))
    few, many = member, None
    if not large.isEmpty():
        large = broadcast_if_small(large)
        few, many = member.join(large, on, "left_anti"), member.join(large, on, "left_semi").distinct()
    listed = few.groupBy(*on).agg(F.collect_set("src").alias("_m")).where(F.size("_m") > 1)
    pairs = listed.select(*by, "_m", F.explode("_m").alias("src")).select(*by, "src", F.explode("_m").alias("dst"))
    if many is not None:
        pairs = pairs.unionByName(blocked_join(many, many.withColumnRenamed("src", "dst"), on, "src", "dst").select(*by, "src", "dst"))
    return pairs.where("src <> dst").groupBy(*by, "src", "dst").agg(F.count("*").alias("n"))


def _snapshots_of_pairs(pairs: DataFrame, column):
    """One row per pair with the list ``_s`` of its snapshots; a pair is shuffled once for all questions about neighbouring ones."""
    rows = pairs.select(column, "src", "dst").repartition("src", "dst")
    return rows.groupBy("src", "dst").agg(F.collect_list(column).alias("_s"))


def new_pairs(pairs: DataFrame, column="s") -> DataFrame:
    """Pairs linked in a snapshot but not in the one before; the first snapshot has none before it and is left out."""
    first = pairs.agg(F.min(column).alias("f")).scalar()
    unknown = F.col("src").isNull() | F.col("dst").isNull()
    before = lambda s: F.array_contains("_s", s - 1)
    fresh = F.filter("_s", lambda s: unknown | ~before(s))
    rows = _snapshots_of_pairs(pairs, column).select(F.explode(fresh).alias(column), "src", "dst")
    return rows.where(F.col(column) > first)


def linked_now_or_before(pairs: DataFrame, column="s") -> DataFrame:
    """Pairs linked in a snapshot or in the one before, for every snapshot after the first."""
    lo = pairs.agg(F.min(column).alias("f")).scalar()
    hi = pairs.agg(F.max(column).alias("f")).scalar()
    both = F.array_distinct(F.concat("_s", F.transform("_s", lambda s: s + 1)))
    rows = _snapshots_of_pairs(pairs, column).select(F.explode(both).alias(column), "src", "dst")
    return rows.where((F.col(column) > lo) & (F.col(column) <= hi))


def negative_counts(pairs: DataFrame, nodes: DataFrame, column="s") -> DataFrame:
    """Number of ordered pairs linked neither now nor before, without listing them."""
    n = nodes.agg(F.count("*").alias("n")).scalar()
    linked = linked_now_or_before(pairs, column).groupBy(column).agg(F.count("*").alias("n_linked"))
    return linked.withColumn("n_negative", n * (n - 1) - F.col("n_linked"))


def negative_pairs(pairs: DataFrame, nodes: DataFrame, sizes: DataFrame, seed=0, column="s") -> DataFrame:
    """``size`` random pairs per snapshot that are linked neither now nor before; no self pairs.

    ``nodes`` has one column ``key``. Pair number c of n·(n-1) stands for one ordered pair. Each snapshot
    has one fixed random order of these numbers (a keyed permutation), and its sample is the first
    free ones in that order, so the same seed gives the same sample however many places are looked
    at. Places are added until every snapshot has enough; one with fewer free pairs than
    asked for yields all of them.
    """
    spark = nodes.sparkSession
    ids = checkpointed(dense_index(nodes.select("key").distinct(), ["key"], (), "id"))
    n = ids.count()
    wanted = checkpointed(sizes.select(column, F.col("size").cast("long").alias("size")))
    span = wanted.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.max("size").alias("top")).first()
    if span["lo"] is None or n < 2:
        return nodes.select(F.lit(0).alias(column), F.col("key").alias("src"), F.col("key").alias("dst")).limit(0)
    numbers = broadcast_if_small(ids, NODE_ROWS)
    end = lambda side: numbers.select(F.col("key").alias(side), F.col("id").alias(f"{side}_id"))
    known = pairs.select(column, "src", "dst").join(end("src"), "src").join(end("dst"), "dst")
    c = F.col("src_id") * (n - 1) + F.col("dst_id") - (F.col("dst_id") > F.col("src_id")).cast("long")
    # one row per pair number with its snapshots; these and the ones after them are taken
    first, last = pairs.agg(F.min(column), F.max(column)).first()
    both = F.array_distinct(F.concat("_s", F.transform("_s", lambda s: s + 1)))
    taken = known.select(column, c.alias("c")).repartition("c").groupBy("c").agg(F.collect_set(column).alias("_s"))
    taken = taken.select("c", F.filter(both, lambda s: (s > F.lit(first)) & (s <= F.lit(last))).alias("_s"))
    steps, space, lo = span["hi"] - span["lo"] + 1, n * (n - 1), span["lo"]
    half = max(1, (space.bit_length() + 1) // 2)
    places = 1 << 2 * half
    # a place is a pair's number with the chance space / places; most of those are free
    m = min(places, span["top"] * places * 5 // (4 * space) + 64)
    while True:
        at = spark.range(steps * m).select((F.lit(lo) + F.pmod("id", F.lit(steps))).alias(column), F.floor(F.col("id") / steps).cast("long").alias("i"))
        drawn = at.select(column, "i", _permuted("i", half, column, seed).alias("c")).where(F.col("c") < space)
        met = drawn.join(taken, "c", "left").where(~F.coalesce(F.array_contains("_s", F.col(column)), F.lit(False)))
        free = checkpointed(met.select(column, "i", "c"))
        if m == places:
            break
        have = wanted.join(free.groupBy(column).agg(F.count("*").alias("have")), column, "left")
        short = checkpointed(have.where(F.coalesce("have", F.lit(0)) < F.col("size")))
        if short.isEmpty():
            break
        # fewer pairs may be free than are asked for
        used = taken.select(F.explode("_s").alias(column)).groupBy(column).agg(F.count("*").alias("used"))
        goal = F.least("size", F.lit(space) - F.coalesce("used", F.lit(0)))
        if short.join(used, column, "left").where(F.coalesce("have", F.lit(0)) < goal).isEmpty():
            break
        m = min(places, 4 * m)
    picked = checkpointed(take_per_group(free, ["i"], wanted, [column]).select(column, "c"))
    src = F.floor(F.col("c") / (n - 1)).cast("long")
    rest = F.pmod("c", F.lit(n - 1))
    decoded = picked.select(column, src.alias("src_id"), (rest + (rest >= src).cast("long")).alias("dst_id"))
    return decoded.join(end("src"), "src_id").join(end("dst"), "dst_id").select(column, "src", "dst")


def _permuted(place, half: int, *salts):
    """Place number to another number of ``2 * half`` bits, one to one: four keyed rounds over its two halves."""
    mask = F.lit((1 << half) - 1).cast("long")
    left, right = F.shiftright(place, half), F.col(place).bitwiseAND(mask)
    for i in range(4):
        keyed = F.xxhash64(right, F.lit(i), *[F.col(x) if isinstance(x, str) else F.lit(x) for x in salts])
        left, right = right, left.bitwiseXOR(keyed.bitwiseAND(mask))
    return F.shiftleft(left, half).bitwiseOR(right)


def sample_sizes(pairs: DataFrame, frac=0.1, column="s") -> DataFrame:
    return pairs.groupBy(column).agg(F.floor(F.count("*") * F.lit(frac)).cast("long").alias("size"))


def sample_pairs(pairs: DataFrame, nodes: DataFrame, frac=0.1, seed=0, column="s") -> DataFrame:
    """``int(frac·n)`` of the new pairs of each snapshot with label 1, and as many negatives with label 0."""
    fresh = new_pairs(pairs, column)
    sizes = sample_sizes(fresh, frac, column)
    order = fresh.withColumn("_h", F.xxhash64("src", "dst", F.lit(seed)))
    pos = take_per_group(order, ["_h", "src", "dst"], sizes, [column]).drop("_h")
    neg = negative_pairs(pairs, nodes, sizes, seed, column)
    return pos.withColumn("label", F.lit(1)).unionByName(neg.withColumn("label", F.lit(0)))


def sample_edges(edges: DataFrame, ids: DataFrame, k=100, seed=0, test=False, exclude_true=False) -> DataFrame:
    """Per canonical edge type ``k`` edges drawn with replacement and ``k`` random node pairs.

    ``edges`` is (src_type, etype, dst_type, src_id, dst_id) and ``ids`` (ntype, local_id).
    ``test`` draws no more than there are edges; ``exclude_true`` drops negatives that are edges. Each draw is a hashed
    number below the number of edges, and draws of one number share an edge: the first number takes the edge of
    the smallest hash, the next new number the next one. So the edges with the ``k`` smallest hashes are all that
    is shuffled, kept per task before it, and the result depends on the seed and not on the partitioning.
    """
    kind = ["src_type", "etype", "dst_type"]
    edges = checkpointed(edges.select(*kind, "src_id", "dst_id"))
    sizes = edges.groupBy(*kind).agg(F.count("*").alias("n_edges"))
    nodes = ids.groupBy("ntype").agg(F.count("*").alias("n"))
    many = F.least(F.lit(k).cast("long"), F.col("n_edges")) if test else F.lit(k).cast("long")
    draws = sizes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("j"))
    at = lambda salt, n: F.pmod(F.xxhash64(*kind, "j", F.lit(seed), F.lit(salt)), F.col(n))
    of_kind = lambda *order: W.partitionBy(*kind).orderBy(*order)
    numbers = draws.select(*kind, "j", at(0, "n_edges").alias("number"))
    first_drawn = numbers.groupBy(*kind, "number").agg(F.min("j").alias("first"))
    numbers = numbers.join(first_drawn.withColumn("i", F.row_number().over(of_kind("first"))), [*kind, "number"])
    hashed = edges.withColumn("h", F.xxhash64("src_id", "dst_id", F.lit(seed)))
    least = hashed.withColumn("i", F.row_number().over(of_kind("h", "src_id", "dst_id"))).where(F.col("i") <= k)
    pos = numbers.join(least.drop("h"), [*kind, "i"]).select(*kind, "j", "src_id", "dst_id", F.lit(1).alias("label"))
    count = lambda side: nodes.select(F.col("ntype").alias(f"{side}_type"), F.col("n").alias(f"n_{side}"))
    neg = draws.join(count("src"), "src_type").join(count("dst"), "dst_type")
    neg = neg.select(*kind, "j", at(1, "n_src").alias("src_id"), at(2, "n_dst").alias("dst_id"), F.lit(0).alias("label"))
    if exclude_true:
        neg = neg.join(edges, [*kind, "src_id", "dst_id"], "left_anti").select(*pos.columns)
    return pos.unionByName(neg)
