"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

A sketch has ``t`` coordinates. In round i < t every element of a set falls into a hashed bin, and the
smallest value of a bin that no earlier round filled becomes its coordinate; rounds t to 2t - 1 put all
elements into bin i - t, so every coordinate is filled for every set with an element, after about t log t / n rounds
of n elements. Coordinates of two sets agree with a probability of their Jaccard similarity.

1. Equal sets are one node. Sketches are cut into bands; nodes that agree in a band share a bucket.
2. Each node of a bucket is compared with one of them, the one that shares most buckets with others, so a group
   of near copies is mostly joined by as many pairs as it has nodes.
3. Buckets whose other nodes are not all one component by then hold pairs that were not compared. Their nodes
   are compared by a prefix join: shingles in order of rarity among these nodes, the necessary first ones and
   levels of size as keys, bounds on sizes and positions. Nodes of one component meet as blocks and are not paired.

Every link is confirmed on the full sets of shingles (64-bit hashes). The number of bands follows from the
threshold: two sets exactly that similar share no bucket with a probability of at most ``MISSED``.

Defined results: a null or wordless text has an empty set and is linked with nothing, not even its equals;
fewer words than a shingle are one shingle; repeated rows are all returned; a null id stays null and
takes the smallest id of its component, or null; ``kept`` compares null with null as equal; an empty table gives no rows;
other columns are not read.
"""

import hashlib
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.llm.common import LOWER, materialized, mixed, slices, text_digest, text_rows, texts_of
from threatloom.llm.components import components
from threatloom.operators.pairs import broadcast_if_small

# Coordinates of a band, and the share of pairs at the threshold that may share no bucket.
BAND_ROWS, MISSED = 5, 1e-6
# Bytes of text sketched at once, words a worker remembers, nodes of one block of a posting: memory only.
STEP_BYTES, KNOWN_WORDS, BLOCK_NODES = 1 << 22, 300_000, 512
EMPTY = ~np.uint64(0)
# Ratio of the sizes of neighbouring levels in the prefix join.
LEVEL = 1.02


class WordHashes(dict):
    """XXH64 of words, remembered up to a bound."""

    def __missing__(self, word):
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: bytes, size: int, known: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``size`` lower-cased words; fewer words are one run."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(size, len(each))
    runs = np.zeros(len(each) - size + 1, np.uint64)
    for i in range(size):
        runs += mixed(each[i : len(each) - size + 1 + i], i)
    return np.unique(runs)


def sketches(values: np.ndarray, sizes: np.ndarray, t: int) -> np.ndarray:
    """One row of ``t`` coordinates for each set; ``values`` holds the sets one after the other."""
    table = np.full(len(sizes) * t, EMPTY)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    open_sets = np.flatnonzero(sizes)
    for i in range(2 * t):
        if not len(open_sets):
            break
        h = mixed(values, i)
        bins = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        cell = owner * t + bins
        unfilled = table[cell] == EMPTY
        np.minimum.at(table, cell[unfilled], h[unfilled] & np.uint64(0xFFFFFFFF) | np.uint64(i << 32))
        left = (table.reshape(-1, t)[open_sets] == EMPTY).any(axis=1)
        if not left.all():
            going_on = np.zeros(len(sizes), bool)
            going_on[open_sets[left]] = True
            open_sets, some = open_sets[left], going_on[owner]
            values, owner = values[some], owner[some]
    return table.reshape(-1, t)


def band_keys(table: np.ndarray, rows=BAND_ROWS) -> np.ndarray:
    """One 64-bit key for each band of each sketch."""
    bands = table.shape[1] // rows
    keys = np.tile(mixed(np.arange(bands, dtype=np.uint64), 1), (len(table), 1))
    for i in range(rows):
        keys = mixed(keys + table[:, i::rows], 2 + i)
    return keys


def band_count(percent: int, missed=MISSED) -> int:
    """Bands of which two sets that are ``percent`` alike share none with a probability of at most ``missed``."""
    alike = (percent / 100) ** BAND_ROWS
    return 1 if alike >= 1 else ceil(log(missed) / log(1 - alike))


def sketched(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int) -> DataFrame:
    """(id, digest, same, n, keys): text digest, digest of the set, its size and its band keys."""

    def run(batches):
        known = WordHashes()
        for batch in batches:
            texts = texts_of(batch)
            for lo, hi in slices([len(t) for t in texts], STEP_BYTES):
                sets = [shingle_set(t, shingle, known) for t in texts[lo:hi]]
                n = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(n)
                keys = np.zeros((len(sets), 0), np.uint64)
                if len(some):
                    keys = band_keys(sketches(np.concatenate(sets), n, bands * BAND_ROWS))[some]
                offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))
                same = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), same, pa.array(n), lists], names=["id", "digest", "same", "n", "keys"])

    schema = T.StructType(
        [T.StructField("id", docs.schema[id_col].dataType)]
        + [T.StructField(c, T.BinaryType()) for c in ("digest", "same")]
        + [T.StructField("n", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))]
    )
    return text_rows(docs, id_col, text_col, F.unhex(text_digest(docs[text_col])).alias("digest")).mapInArrow(run, schema)


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(node, shingles) of the nodes ``wanted`` (node, id, digest), each from one row of ``docs``."""

    def run(batches):
        known = WordHashes()
        for batch in batches:
            texts = texts_of(batch)
            for lo, hi in slices([len(t) for t in texts], STEP_BYTES):
                sets = [shingle_set(t, shingle, known) for t in texts[lo:hi]]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.slice(lo, hi - lo).column(0), lists], names=["node", "shingles"])

    rows = text_rows(docs, id_col, text_col, F.unhex(text_digest(docs[text_col])).alias("digest"))
    names = wanted.select("node", F.col("digest").alias("_digest"), F.col("id").alias("_id"))
    rows = rows.join(broadcast_if_small(names), (F.col("digest") == F.col("_digest")) & F.col("id").eqNullSafe(F.col("_id")))
    return rows.select("node", "text").dropDuplicates(["node"]).mapInArrow(run, "node long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have ``100 * intersection >= percent * union``."""
    side = lambda c, s: sets.select(F.col("node").alias(c), F.col("shingles").alias(s))
    both = pairs.join(side("b", "y"), "b").join(side("a", "x"), "a")
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    return both.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b")


def alike_sizes(a, b, percent: int):
    """Sizes that allow the similarity: the smaller set may be all of the intersection."""
    return 100 * F.least(F.col(a), F.col(b)) >= percent * F.greatest(F.col(a), F.col(b))


def prefix_pairs(points: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``points`` (node, n, component) of different components that may be similar; none that is, is left out.

    The first common shingle of two similar sets, by rarity, leaves enough shingles after it in both. So a set is a
    smaller partner by its first shingles as a set of equal size needs them, and at place ``p`` a larger partner only
    of sets up to the size that ``p`` allows. Sizes are keys too, as levels ``LEVEL`` apart.
    """
    p, whole = F.lit(percent), F.lit(100 + percent)
    level = lambda size: F.floor(F.log(size) / log(LEVEL)).cast("int")
    shingles = materialized(points.join(sets, "node").select("node", "n", "component", F.explode("shingles").alias("token")))
    rarity = materialized(shingles.groupBy("token").agg(F.count(F.lit(1)).alias("often")).where("often > 1"))
    # shingles of one set alone come first and are no keys; only how many there are matters
    listed = shingles.join(rarity, "token").groupBy("node", "n", "component")
    listed = listed.agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("tokens"))
    keys = listed.select("node", "n", "component", (F.col("n") - F.size("tokens")).alias("alone"), F.posexplode("tokens").alias("at", "t"))
    keys = keys.select(F.col("t.token").alias("token"), "component", "node", "n", (F.col("alone") + F.col("at") + 1).alias("place"))
    largest = F.least("n", F.floor(whole * (F.col("n") - F.col("place") + 1) / p - F.col("n") + 1e-9))
    keys = keys.withColumn("lowest", F.ceil(p * F.col("n") / 100 - 1e-9)).withColumn("largest", largest).where("largest >= lowest")
    small = keys.where((F.col("n") - F.col("place") + 1) * whole >= 2 * p * F.col("n")).withColumn("level", level("n"))
    large = keys.withColumn("level", F.explode(F.sequence(level("lowest"), level("largest"))))
    columns = ["token", "level", "component", "node", "n", "place"]
    keys = small.select(F.lit(True).alias("small"), *columns).unionByName(large.select(F.lit(False).alias("small"), *columns))
    keys = materialized(keys)
    sides = [F.min("small").alias("larger"), F.max("small").alias("smaller"), F.min("component").alias("lo"), F.max("component").alias("hi")]
    met = keys.groupBy("token", "level").agg(*sides).where("not larger and smaller and lo <> hi").select("token", "level")
    keys = keys.join(materialized(met), ["token", "level"], "left_semi")
    # blocks of nodes of one key and component, so that nodes of one component are not paired
    own = ["token", "level", "component", "small"]
    sized = keys.groupBy(*own).agg(F.ceil(F.count(F.lit(1)) / BLOCK_NODES).alias("blocks"))
    keys = keys.join(sized, own).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    blocks = materialized(keys.groupBy(*own, "block").agg(F.collect_list(F.struct("node", "n", "place")).alias("nodes")))
    left = blocks.where("small").select("token", "level", F.col("component").alias("ca"), F.col("nodes").alias("l"))
    right = blocks.where("not small").select("token", "level", F.col("component").alias("cb"), F.col("nodes").alias("r"))
    met = left.join(right, ["token", "level"]).where("ca <> cb").select("l", F.explode("r").alias("y")).select(F.explode("l").alias("x"), "y")
    need = F.ceil(p * (F.col("x.n") + F.col("y.n")) / whole - 1e-9)
    rest = 1 + F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    order = F.struct(F.col("x.n"), F.col("x.node")) < F.struct(F.col("y.n"), F.col("y.node"))
    met = met.where(order & alike_sizes("x.n", "y.n", percent) & (rest >= need))
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", shingle=3, percent=85) -> DataFrame:
    """(id, n_shingles, component_id, kept): documents linked by sets that are ``percent`` alike or more."""
    made = materialized(sketched(docs, id_col, text_col, shingle, band_count(percent)))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "digest")).alias("first")
    nodes = made.where("n > 0").groupBy("same").agg(first, F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = nodes.select("same", F.col("first.id").alias("id"), F.col("first.digest").alias("digest"), "n", "keys")
    nodes = materialized(nodes.withColumn("node", F.monotonically_increasing_id()))  # a short name for each set

    # only buckets of several nodes go on; the node that meets most others leads each of its buckets
    buckets = nodes.select("node", "n", F.explode("keys").alias("key"))
    sizes = materialized(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    members = materialized(buckets.join(sizes, "key"))
    meets = materialized(members.groupBy("node").agg(F.sum("size").alias("meets")))
    lead = members.join(meets, "node").groupBy("key").agg(F.max(F.struct("meets", "node", "n")).alias("lead"))
    members = members.join(materialized(lead), "key").where("node <> lead.node")
    members = materialized(members.select("key", "size", "node", "n", F.col("lead.node").alias("a"), F.col("lead.n").alias("m")))
    pairs = materialized(members.where(alike_sizes("n", "m", percent)).select("a", F.col("node").alias("b")).distinct())

    def sets_of(names):
        wanted = materialized(nodes.select("node", "id", "digest").join(names, "node"))
        return materialized(full_sets(docs, wanted, id_col, text_col, shingle))

    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    found = materialized(components(materialized(confirmed(pairs, sets, percent))))

    placed = members.where("size > 2").join(found, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component"))
    placed = materialized(placed)
    mixed_keys = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    points = materialized(placed.join(materialized(mixed_keys), "key", "left_semi").select("node", "n", "component").distinct())
    if not points.isEmpty():
        sets = sets_of(points.select("node"))
        more = materialized(confirmed(materialized(prefix_pairs(points, sets, percent)), sets, percent))
        part = points.select("node", "component")
        more = more.join(part.select(F.col("node").alias("a"), F.col("component").alias("x")), "a")
        more = more.join(part.select(F.col("node").alias("b"), F.col("component").alias("y")), "b")
        joined = components(more.select(F.col("x").alias("a"), F.col("y").alias("b")))
        joined = joined.select(F.col("node").alias("old"), F.col("component").alias("new"))
        # a single node has its own number as component and is in no table of components yet
        all_found = found.unionByName(points.where("node = component").select("node", "component")).distinct()
        found = materialized(all_found.join(joined, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component")))

    linked = nodes.select("same", "id", "node").join(found, "node")
    least = materialized(linked.groupBy("component").agg(F.min("id").alias("low")))
    low = linked.join(least, "component").select("same", "low")
    own = materialized(nodes.select("same", "id").join(low, "same", "left").select("same", F.coalesce("low", "id").alias("low")))
    rows = made.join(own, "same", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("id")).alias("component_id"),
    )
    return rows.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
