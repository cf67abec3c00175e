"""SimHash fingerprints and near-duplicate groups, with BK-trees.

Fingerprints within ``radius`` bits agree on at least two of ``radius + 2`` blocks of their bits
(a differing bit spoils one block). So each fingerprint goes to one shard for every pair of blocks,
and two that must be linked meet in a shard. A shard's fingerprints form a BK-tree: children hang at
the integer Hamming distance to their parent, and a search follows only edges within the radius.
Shards are small; one that is larger than ``shard_rows`` is cut into trees of that size, and each
of those trees is sent, whole, to the fingerprints of the other parts (rows are copied to the trees,
by shuffle, as no tree set has a size bound that would allow one broadcast).

Only links that join parts of a shard are kept, never all pairs of a group: a branch whose nodes
all belong to the component of the searched fingerprint is skipped, as it can add nothing. Links
of all shards then give connected components.

Defined results: a null or wordless text has fingerprint 0 and is linked like any other; texts with
fewer words than a shingle are one shingle; equal fingerprints are one group; an empty table gives
no rows; other columns are not read.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.llm.common import LOWER, fresh, lean, materialized, mixed, text_digest, text_rows, texts_of
from threatloom.llm.components import components
from threatloom.llm.fast_sketch import confirmed, prefix_pairs
from threatloom.operators.pairs import broadcast_if_small

# Fingerprints of one BK-tree: what one task holds at a time.
SHARD_ROWS = 20_000


def shingle_hashes(text: bytes, size: int, seed=42) -> np.ndarray:
    """XXH64 of each run of ``size`` lower-cased words, space-joined; fewer words are one run."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins, ends = (ends - lengths)[: 1 - size or None].tolist(), ends[size - 1 :].tolist()
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(begins, ends)), np.uint64, len(ends))


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes, as a number of 64 bits."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255  # sums of 255 bits fit into a byte
    ones = bits[whole:].sum(axis=0, dtype=np.uint8).astype(np.int64)
    if whole:
        ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", shingle=4, seed=42) -> DataFrame:
    """(id, fp): the 64-bit SimHash of each whole text; ``fp`` is the same bits as a signed long."""

    def run(batches):
        for batch in batches:
            fps = np.array([majority(shingle_hashes(t, shingle, seed)) for t in texts_of(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return text_rows(docs, id_col, text_col).mapInArrow(run, schema)


class Shard:
    """BK-tree of one shard that also keeps the components of its nodes."""

    def __init__(self, radius, far=None):
        self.radius, self.far = radius, far
        self.fps, self.nodes, self.sketches, self.children = [], [], [], []
        self.parent, self.uniform = [], []

    def find(self, i):
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def unite(self, i, j):
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)

    def search(self, fp, sketch):
        """Tree nodes to link to, at least one of every component that has a node in reach."""
        found, component = [], -1
        stack = [0] if self.fps else []
        while stack:
            i = stack.pop()
            if component >= 0 and self.uniform[i] >= 0 and self.find(self.uniform[i]) == component:
                continue
            d = (fp ^ self.fps[i]).bit_count()
            if d <= self.radius and (component < 0 or self.find(i) != component):
                if self.far is None or (sketch ^ self.sketches[i]).bit_count() <= self.far:
                    found.append(i)
                    if component >= 0:
                        self.unite(component, i)
                    component = self.find(i)
            below = self.children[i]
            if below:
                low, high = d - self.radius, d + self.radius
                stack.extend(c for edge, c in below.items() if low <= edge <= high)
        return found

    def add(self, fp, node, sketch):
        """Insert a fingerprint and unite it with what it reaches."""
        found = self.search(fp, sketch)
        new = len(self.fps)
        self.fps.append(fp)
        self.nodes.append(node)
        self.sketches.append(sketch)
        self.children.append(None)
        self.parent.append(new)
        self.uniform.append(new)
        for i in found:
            self.unite(new, i)
        own, at = self.find(new), 0
        while at != new:
            if self.uniform[at] >= 0 and self.find(self.uniform[at]) != own:
                self.uniform[at] = -1
            d = (fp ^ self.fps[at]).bit_count()
            if self.children[at] is None:
                self.children[at] = {}
            at = self.children[at].setdefault(d, new)

    def links(self):
        """Each node with its component's first node."""
        for i, node in enumerate(self.nodes):
            top = self.find(i)
            if top != i:
                yield node, self.nodes[top]


def shard_keys(radius: int) -> list:
    """One column for each pair of blocks: the pair's number and its bits of ``fp``."""
    blocks, width, at = radius + 2, [], 0
    for i in range(blocks):
        size = 64 // blocks + (i < 64 % blocks)
        width.append((at, size))
        at += size
    bits = lambda b: F.shiftrightunsigned("fp", b[0]).bitwiseAND(F.lit((1 << b[1]) - 1))
    keys = []
    for number, (a, b) in enumerate(combinations(width, 2)):
        keys.append(F.shiftleft(F.lit(number).cast("long"), 2 * (64 // blocks + 1)) + F.shiftleft(bits(a), 64 // blocks + 1) + bits(b))
    return keys


def link_fingerprints(points: DataFrame, radius: int, far=None, shard_rows=SHARD_ROWS) -> DataFrame:
    """Links (a, b) of ``points`` (node, fp[, sketch]) that join all nodes whose ``fp`` differ in at most ``radius`` bits.

    With ``far``, the sketches of two nodes must also differ in at most ``far`` bits. The links have the
    connected components of all such pairs.
    """
    wide = radius + 2 <= 12
    keys = shard_keys(radius) if wide else [F.lit(0).cast("long")]
    sketch = [F.col("sketch")] if far is not None else []
    rows = points.select("node", "fp", *sketch, F.explode(F.array(*keys)).alias("key"))
    hot = rows.groupBy("key").count().where(F.col("count") > shard_rows)
    hot = materialized(hot.select("key", F.ceil(F.col("count") / shard_rows).cast("int").alias("trees")))
    own = F.pmod(F.xxhash64("node", "fp"), F.coalesce("trees", F.lit(1))).cast("int")
    rows = rows.join(broadcast_if_small(hot), "key", "left").select("key", "node", "fp", *sketch, own.alias("own"))
    # a fingerprint is searched in the trees below its own, so each two trees meet once; guests come last
    rows = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), "own")))
    rows = rows.select("key", "tree", (F.col("own") != F.col("tree")).alias("guest"), "node", "fp", *sketch)
    kind = points.schema["node"].dataType

    def run(batches):
        shard, at = None, None
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            key, tree, guest = (get(c).to_numpy(zero_copy_only=False) for c in ("key", "tree", "guest"))
            fps, nodes = get("fp").to_numpy().view(np.uint64), get("node")
            edge = np.flatnonzero((key[1:] != key[:-1]) | (tree[1:] != tree[:-1])) + 1
            a, b = [], []
            bounds = [0, *edge.tolist(), len(key)]
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                if (key[lo], tree[lo]) != at:
                    if shard:
                        for x, y in shard.links():
                            a.append(x)
                            b.append(y)
                    at, shard = (key[lo], tree[lo]), None
                    if hi - lo == 1 and hi < len(key):
                        continue  # alone in its shard
                    shard = Shard(radius, far)
                own = nodes.slice(lo, hi - lo).to_pylist()
                close = [int.from_bytes(s, "little") for s in get("sketch").slice(lo, hi - lo).to_pylist()] if far is not None else [0] * (hi - lo)
                for fp, node, s, g in zip(fps[lo:hi].tolist(), own, close, guest[lo:hi].tolist()):
                    if not g:
                        shard.add(fp, node, s)
                    else:
                        for i in shard.search(fp, s):
                            a.append(node)
                            b.append(shard.nodes[i])
            yield links(a, b, nodes.type)
        if shard:
            found = list(shard.links())
            yield links([x for x, _ in found], [y for _, y in found], nodes.type)

    links = lambda a, b, kind: pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], names=["a", "b"])
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    return rows.repartition("key", "tree").sortWithinPartitions("key", "tree", "guest").mapInArrow(run, schema)


def near_groups(docs: DataFrame, id_col="doc_id", text_col="text", shingle=4, radius=4, seed=42, shard_rows=SHARD_ROWS) -> DataFrame:
    """(id, fingerprint, component_id): documents linked by fingerprints within ``radius`` bits.

    ``component_id`` is the smallest id that can be reached; null if all of a component are null.
    """
    made = materialized(fingerprints(docs, id_col, text_col, shingle, seed))
    distinct = made.groupBy("fp").agg(F.min("id").alias("first"))
    found = components(link_fingerprints(distinct.select(F.col("fp").alias("node"), "fp"), radius, shard_rows=shard_rows))
    linked = distinct.join(found.withColumnRenamed("node", "fp"), "fp")
    # written before they are joined, so that a hot component or fingerprint is split in the join
    least = materialized(linked.groupBy("component").agg(F.min("first").alias("low")))
    low = linked.join(least, "component").select("fp", "low")
    of_root = materialized(distinct.join(low, "fp", "left").select("fp", F.coalesce("low", "first").alias("component_id")))
    return made.join(of_root, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SKETCH_WORDS, SKETCH_BITS = 5, 512
# Smallest hashes of a band, the share of pairs at the wanted similarity that may meet in no band, and the
# standard errors of a SimHash distance that are left to the exact comparison.
BAND_ROWS, MISSED, ERRORS = 4, 0.001, 4
# Uncertain pairs a text may list before what is certain by then is used to leave out others.
FIRST_PAIRS = 4


def sketch_limits(similarity: float) -> tuple:
    """Differing bits of ``SKETCH_BITS`` up to which texts are surely, and may be, as similar as ``similarity``."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    middle, error = SKETCH_BITS * p, np.sqrt(SKETCH_BITS * p * (1 - p))
    return max(0, int(middle - ERRORS * error)), int(middle + ERRORS * error)


def band_count(similarity: float) -> int:
    """Bands of which two texts of this similarity share none with a probability of at most ``MISSED``."""
    alike = similarity**BAND_ROWS
    return 1 if alike >= 1 else int(np.ceil(np.log(MISSED) / np.log(1 - alike)))


def run_hashes(text: bytes) -> np.ndarray:
    """Hashes of the distinct runs of ``SKETCH_WORDS`` words; fewer words are one run."""
    words = text.translate(LOWER).split()
    known = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = max(1, min(SKETCH_WORDS, len(each)))
    runs = np.zeros(len(each) - size + 1 if len(each) else 0, np.uint64)
    for i in range(size if len(each) else 0):
        runs += mixed(each[i : len(each) - size + 1 + i], i)
    return np.unique(runs)


def band_keys(runs: np.ndarray, bands: int) -> np.ndarray:
    """One key for each band: its number and the smallest of all hashes by ``BAND_ROWS`` hash functions."""
    numbers = np.arange(bands * BAND_ROWS, dtype=np.uint64)
    least = np.full(len(numbers), ~np.uint64(0))
    for at in range(0, len(runs), 4096):
        some = runs[at : at + 4096, None] ^ mixed(numbers, 1)
        least = np.minimum(least, (some * (mixed(numbers, 2) | np.uint64(1))).min(axis=0))
    keys = mixed(np.arange(bands, dtype=np.uint64), 3)
    for i in range(BAND_ROWS):
        keys = mixed(keys + least[i::BAND_ROWS], i)
    return keys


class Bucket(Shard):
    """BK-tree of the sketches in one band's bucket, which lists pairs to compare.

    Pairs within ``sure`` bits join parts, and only those that join some are listed; of the pairs within
    ``radius`` bits all are that lie in different parts, up to ``most`` for each node. Equal sketches
    are one node of the tree. Nodes of one ``group`` are one part from the start.
    """

    def __init__(self, radius, sure, most):
        super().__init__(radius)
        self.sure, self.most, self.more, self.groups = sure, most, 0, {}

    def near(self, sketch, group):
        """Tree nodes to compare with, and the node's part or -1."""
        component = self.find(self.groups[group]) if group in self.groups else -1
        found = []
        stack = [0] if self.fps else []
        while stack:
            i = stack.pop()
            if component >= 0 and self.uniform[i] >= 0 and self.find(self.uniform[i]) == component:
                continue
            d = (sketch ^ self.fps[i]).bit_count()
            if d <= self.radius and (component < 0 or self.find(i) != component):
                found.append((d, i))
                if d <= self.sure:
                    if component >= 0:
                        self.unite(component, i)
                    component = self.find(i)
            below = self.children[i]
            if below:
                low, high = d - self.radius, d + self.radius
                stack.extend(c for edge, c in below.items() if low <= edge <= high)
        doubt = sorted((d, i) for d, i in found if d > self.sure and (component < 0 or self.find(i) != component))
        if self.most is not None:
            self.more += max(0, len(doubt) - self.most)
            doubt = doubt[: self.most]
        return [i for d, i in found if d <= self.sure] + [i for _, i in doubt], component

    def insert(self, sketch, node, component, group):
        """Insert a sketch into the tree as a node of a part."""
        new, at = len(self.fps), 0
        if new:
            while True:  # a sketch that is known stands for its equals
                d = (sketch ^ self.fps[at]).bit_count()
                if d == 0:
                    new = at
                    break
                after = (self.children[at] or {}).get(d)
                if after is None:
                    break
                at = after
        if new == len(self.fps):
            self.fps.append(sketch)
            self.nodes.append(node)
            self.children.append(None)
            self.parent.append(new)
            self.uniform.append(new)
        if component >= 0:
            self.unite(new, component)
        if group is not None:
            self.unite(new, self.groups.setdefault(group, new))
        own, at = self.find(new), 0
        while at != new:
            if self.uniform[at] >= 0 and self.find(self.uniform[at]) != own:
                self.uniform[at] = -1
            d = (sketch ^ self.fps[at]).bit_count()
            if self.children[at] is None:
                self.children[at] = {}
            at = self.children[at].setdefault(d, new)


def bucket_pairs(points: DataFrame, sure: int, far: int, most, shard_rows: int) -> DataFrame:
    """Pairs (a, b, more, key) of ``points`` (node, grp, keys, sketch) to compare: equal in ``key`` and within ``far`` bits.

    Left out are pairs whose nodes other pairs within ``sure`` bits or an equal ``grp`` join, and, if
    ``most`` is given, pairs beyond that many of a node; ``more`` says how many these are.
    """
    rows = points.select("node", "grp", "sketch", F.explode("keys").alias("key"))
    hot = rows.groupBy("key").count().where(F.col("count") > shard_rows)
    hot = materialized(hot.select("key", F.ceil(F.col("count") / shard_rows).cast("int").alias("trees")))
    own = F.pmod(F.xxhash64("node"), F.coalesce("trees", F.lit(1))).cast("int")
    rows = rows.join(broadcast_if_small(hot), "key", "left").withColumn("own", own)
    rows = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), "own")))
    rows = rows.select("key", "tree", (F.col("own") != F.col("tree")).alias("guest"), "node", "grp", "sketch")

    def run(batches):
        bucket, at, waiting = None, None, None
        for batch in batches:
            key, tree, guest, node, grp, sketch = (batch.column(i).to_pylist() for i in range(6))
            a, b, more, where = [], [], [], []
            for i in range(len(key)):
                row = (int.from_bytes(sketch[i], "little"), node[i], grp[i], guest[i])
                if (key[i], tree[i]) != at:
                    at, bucket, waiting = (key[i], tree[i]), None, row
                    continue
                if bucket is None:  # the second of its bucket
                    bucket = Bucket(far, sure, most)
                    if not waiting[3]:
                        bucket.insert(waiting[0], waiting[1], -1, waiting[2])
                before = bucket.more
                found, part = bucket.near(row[0], row[2])
                for x in found:
                    a.append(row[1])
                    b.append(bucket.nodes[x])
                    more.append(0)
                    where.append(key[i])
                if bucket.more > before:
                    more[-1] = bucket.more - before
                if not row[3]:
                    bucket.insert(row[0], row[1], part, row[2])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(more, pa.int64()), pa.array(where, pa.int64())], names=["a", "b", "more", "key"])

    return rows.repartition("key", "tree").sortWithinPartitions("key", "tree", "guest").mapInArrow(lean(run), "a long, b long, more long, key long")


def run_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, runs): the run hashes of the texts ``wanted`` (node, digest, id, n); ``n`` rows of ``docs`` have that id and text."""

    def run(batches):
        for batch in batches:
            runs = [run_hashes(t).view(np.int64) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.list_(pa.int64()))], names=["node", "runs"])

    rows = text_rows(docs, id_col, text_col, F.unhex(text_digest(docs[text_col])).alias("digest"))
    names = materialized(wanted.select("node", "n", F.col("digest").alias("_digest"), F.col("id").alias("_id")))
    rows = rows.join(broadcast_if_small(names), (F.col("digest") == F.col("_digest")) & F.col("id").eqNullSafe(F.col("_id")))
    # only texts that several rows hold with one id are shuffled to take one of them
    several = rows.where("n > 1").select("node", "text").dropDuplicates(["node"])
    return rows.where("n = 1").select("node", "text").unionByName(several).mapInArrow(lean(run), "node long, runs array<long>")


def similar_texts(docs: DataFrame, id_col="doc_id", text_col="text", similarity=0.8, shard_rows=SHARD_ROWS, first_pairs=FIRST_PAIRS) -> DataFrame:
    """(digest, id, n, component): one row for each distinct text, with its near-duplicate group.

    Candidates are texts that agree in a band of smallest hashes of their five-word runs, which depends on
    their similarity only and not on how they were edited. Candidates whose 512-bit SimHashes
    may be as near as ``similarity`` makes them are linked if the Jaccard similarity of their sets of runs is
    at least that. ``digest`` is the MD5 of the text, ``id`` the smallest id that has it, ``n`` how many
    rows have that id and text.
    """
    kind, bands = docs.schema[id_col].dataType, band_count(similarity)

    def run(batches):
        for batch in batches:
            keys, sketches = [], []
            for text in texts_of(batch):
                runs = run_hashes(text)
                keys.append(band_keys(runs, bands).view(np.int64))
                sketches.append(b"".join(majority(mixed(runs, s)).to_bytes(8, "little") for s in range(SKETCH_BITS // 64)))
            columns = [batch.column(batch.schema.get_field_index("digest")), batch.column(0), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "id", "keys", "sketch"])

    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("id", kind), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])
    rows = text_rows(docs, id_col, text_col, F.unhex(text_digest(docs[text_col])).alias("digest"))
    made = materialized(rows.mapInArrow(lean(run), schema))
    # rows of one digest and id are counted first, so that the smallest id (null only if there is no other) brings its count
    texts = made.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    low = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "n")).alias("low")
    texts = texts.groupBy("digest").agg(low, F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    texts = texts.select("digest", "low.id", "low.n", "keys", "sketch")
    texts = materialized(texts.withColumn("node", F.monotonically_increasing_id()))  # a short name for each text

    named = texts.select("node", "digest", "id", "n")

    def linked(points, most):
        """Pairs of ``points`` that are similar, the buckets that hold pairs not compared yet, and the sets of runs read."""
        pairs = materialized(bucket_pairs(points, *sketch_limits(similarity), most, shard_rows))
        left = materialized(pairs.where("more > 0").select("key").distinct())
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        sets = materialized(run_sets(docs, named.join(nodes, "node"), id_col, text_col))
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("runs").alias("x")), "a")
        both = both.join(sets.select(F.col("node").alias("b"), F.col("runs").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y"))
        either = F.size("x") + F.size("y") - shared
        return both.where((either == 0) | (shared / either >= similarity)).select("a", "b"), left, sets

    no_group = F.lit(None).cast("long").alias("grp")
    links, left, known = linked(texts.select("node", no_group, "keys", "sketch"), first_pairs)
    found = materialized(components(materialized(links)))
    if not left.isEmpty():
        # buckets that are one group by now hold nothing to compare; in the others no pair is left out that may be
        # similar, but texts are met by their rare runs of words, so alike ones that are not similar enough make no pairs
        placed = texts.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.explode("keys").alias("key"))
        placed = materialized(placed.join(broadcast_if_small(left), "key", "left_semi"))
        several = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
        points = materialized(placed.join(materialized(several), "key", "left_semi").select("node", "component").distinct())
        unread = named.join(points.select("node"), "node").join(known.select("node"), "node", "left_anti")
        sets = known.join(points.select("node"), "node").unionByName(run_sets(docs, unread, id_col, text_col))
        sets = materialized(sets.withColumnRenamed("runs", "shingles"))
        sized = points.join(sets.select("node", F.size("shingles").cast("long").alias("n")), "node").where("n > 0")
        percent = round(100 * similarity)
        more = confirmed(materialized(prefix_pairs(materialized(sized), sets, percent)), sets, percent)
        # the new links join whole components, so few links are left to be followed
        more = more.join(points.select(F.col("node").alias("a"), F.col("component").alias("x")), "a")
        more = more.join(points.select(F.col("node").alias("b"), F.col("component").alias("y")), "b")
        joined = materialized(components(materialized(more.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())))
        joined = joined.select(F.col("node").alias("old"), F.col("component").alias("new"))
        # a single text has its own number as component and is in no table of components yet
        found = found.unionByName(points.where("node = component")).distinct()
        found = found.join(joined, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
    return texts.join(found, "node", "left").select("digest", "id", "n", F.coalesce("component", "node").alias("component"))


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text", similarity=0.8, **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest id (a null id only if there is no other)."""
    texts = materialized(similar_texts(docs, id_col, text_col, similarity, **options))
    best = texts.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "digest", "n")).alias("w"))
    digest, own, low, rows = fresh(docs, "digest", "own_digest", "low_id", "rows")
    best = best.select(F.col("w.digest").alias(digest), F.col("w.id").alias(low), F.col("w.n").alias(rows))
    marked = docs.withColumn(own, F.unhex(text_digest(docs[text_col])))
    kept = marked.join(best, (F.col(own) == F.col(digest)) & marked[id_col].eqNullSafe(F.col(low)))
    single = kept.where(F.col(rows) == 1).select(*docs.columns)
    # the same text with the same id in several rows: one of them
    several = kept.where(F.col(rows) > 1).dropDuplicates([own]).select(*docs.columns)
    return single.unionByName(several)
