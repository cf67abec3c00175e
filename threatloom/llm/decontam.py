"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of ``window`` words, and a window into shingles of ``shingle`` words. The
shingles are ordered by rarity over all documents. A document that holds the whole window holds
its rarest shingle, so with full containment the necessary prefix is one shingle: only places of
prefix shingles are joined. The length bound asks that the window fits into the document, the
positional bound that it fits at the place the prefix gives it, and the words there are then
compared exactly.

Which shingles to look for is sent to the tasks as a bit table, sized by their number and never above
16 MB; the join itself is a Spark join on the shingle.

Defined results: null texts have no words; an item with fewer words than a window is one window;
an item without words has none; items that share a window all count; repeated documents are
answered row by row; empty tables give no hits; other columns are not read.
"""


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.llm.common import alnum_words, fresh, materialized, mixed, text_digest, text_rows, texts_of
from threatloom.operators.pairs import broadcast_if_small

# Bits of the table of wanted shingles: 64 for each, from 8 KB to 16 MB. Beyond two million shingles it is
# fuller, and the join drops what passes needlessly.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27


def word_hash(words: list) -> np.ndarray:
    known = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles_of(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(size if n else 0):
        out += mixed(words[i : i + n], i)
    return out


def item_windows(items: DataFrame, item_col="item_id", text_col="text", window=10, shingle=2) -> DataFrame:
    """(item_id, win, words, shingles): distinct windows of each item, words space-joined.

    ``shingles`` holds the hash of each run of ``shingle`` words of the window (of all its words if it has fewer).
    """
    kind = items.schema[item_col].dataType

    def run(batches):
        for batch in batches:
            keys, out = batch.column(0).to_pylist(), []
            for key, text in zip(keys, texts_of(batch)):
                words = alnum_words(text)
                size = min(window, len(words))
                for own in dict.fromkeys(tuple(words[i : i + size]) for i in range(len(words) - size + 1) if size):
                    grams = shingles_of(word_hash(list(own)), min(shingle, size))
                    out.append((key, b" ".join(own).decode(), size, grams.view(np.int64).tolist()))
            columns = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(0).type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.list_(pa.int64()))], names=["item_id", "words", "size", "shingles"])

    schema = T.StructType([T.StructField("item_id", kind), T.StructField("words", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("shingles", T.ArrayType(T.LongType()))])
    return text_rows(items, item_col, text_col).mapInArrow(run, schema)


def bit_table(hashes: DataFrame) -> np.ndarray:
    """Bits of the wanted hashes (column ``g``), ORed over all tasks; their number follows the hashes, within bounds."""
    wanted = materialized(hashes.select("g").distinct())
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (64 * wanted.count()).bit_length()))

    def run(batches):
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) % np.uint64(size)
            np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

    table = np.zeros(size // 8, np.uint8)
    for row in wanted.coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        table |= np.frombuffer(bytes(row["bits"]), np.uint8)
    return table


def wanted_places(table: np.ndarray, words: list, sizes) -> dict:
    """Size -> (places, hashes) of the runs of words whose bit is set."""
    hashed = word_hash(words)
    found = {}
    for size in sizes:
        grams = shingles_of(hashed, size)
        bits = grams % np.uint64(8 * len(table))
        at = np.flatnonzero(table[bits >> np.uint64(3)] >> (bits & np.uint64(7)).astype(np.uint8) & np.uint8(1))
        found[size] = (at, grams[at])
    return found


def shingle_sizes(windows: DataFrame, shingle: int) -> list:
    """Words of a shingle that occur: fewer than ``shingle`` only for items that are shorter."""
    return sorted(r[0] for r in windows.select(F.least("size", F.lit(shingle))).distinct().collect())


def shingle_counts(docs: DataFrame, windows: DataFrame, text_col: str, sizes: list) -> DataFrame:
    """(g, n): how often each shingle of the windows occurs in all documents."""
    context = docs.sparkSession.sparkContext
    table = context.broadcast(bit_table(windows.select(F.explode("shingles").alias("g"))))

    def run(batches):
        bits, sums, held = table.value, [], 0
        for batch in batches:
            for text in texts_of(batch):
                for _, grams in wanted_places(bits, alnum_words(text), sizes).values():
                    sums.append(grams)
                    held += len(grams)
            if held > 1 << 20:
                yield summed(sums)
                sums, held = [], 0
        if held:
            yield summed(sums)

    def summed(sums):
        g, n = np.unique(np.concatenate(sums), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n, pa.int64())], names=["g", "n"])

    texts = docs.select(F.coalesce(docs[text_col].cast("binary"), F.lit(b"")).alias("text"))
    return texts.mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))


def prefixed(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Distinct windows (words, size, prefix, at): the rarest shingle of each and its place in it."""
    own = windows.select("words", "size", "shingles").dropDuplicates(["words"])
    places = own.select("words", "size", F.posexplode("shingles").alias("at", "g"))
    ranked = places.join(broadcast_if_small(counts), "g", "left").groupBy("words", "size")
    best = ranked.agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g", "at")).alias("b"))
    return best.select("words", "size", F.col("b.g").alias("prefix"), F.col("b.at").alias("at"))


def window_hits(docs: DataFrame, prefixes: DataFrame, id_col: str, text_col: str, window: int, sizes: list) -> tuple:
    """(row, id, digest, n_words) of all documents, and (row, words, first, size) of the places where a window stands."""
    context = docs.sparkSession.sparkContext
    table = context.broadcast(bit_table(prefixes.select(F.col("prefix").alias("g"))))
    # what stands around a place is sent along: enough words on both sides for any window
    reach = window

    def run(batches):
        bits = table.value
        for batch in batches:
            ids = batch.column(0)
            n_words, places = [], []
            for text in texts_of(batch):
                words = alnum_words(text)
                n_words.append(len(words))
                own = []
                for _, (at, grams) in wanted_places(bits, words, sizes).items():
                    for p, g in zip(at.tolist(), grams.view(np.int64).tolist()):
                        low = max(0, p - reach + 1)
                        own.append({"g": g, "p": p, "low": low, "around": [w.decode() for w in words[low : p + reach]]})
                places.append(own)
            yield pa.RecordBatch.from_arrays([ids, batch.column(2), pa.array(n_words, pa.int64()), pa.array(places, arrow)], names=["id", "digest", "n_words", "places"])

    arrow = pa.list_(pa.struct([("g", pa.int64()), ("p", pa.int32()), ("low", pa.int32()), ("around", pa.list_(pa.string()))]))
    place = T.StructType([T.StructField("g", T.LongType()), T.StructField("p", T.IntegerType()), T.StructField("low", T.IntegerType()), T.StructField("around", T.ArrayType(T.StringType()))])
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("digest", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("places", T.ArrayType(place))])
    found = materialized(text_rows(docs, id_col, text_col, text_digest(docs[text_col]).alias("digest")).mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    places = found.where(F.size("places") > 0).select("row", "n_words", F.explode("places").alias("x")).select("row", "n_words", "x.*")
    first = F.col("p") - F.col("at")
    fits = (first >= 0) & (first + F.col("size") <= F.col("n_words"))  # position and length
    same = F.array_join(F.slice("around", first - F.col("low") + 1, F.col("size")), " ") == F.col("words")
    joined = places.join(broadcast_if_small(prefixes), places["g"] == prefixes["prefix"]).where(fits).where(same)
    return found.select("row", "id", "digest", "n_words"), joined.select("row", "words", first.alias("first"), "size")


def covered_words(spans) -> F.Column:
    """Words that lie in any of the spans (array of (first, end)), which may overlap."""
    ordered = F.array_sort(spans)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["first"], a["upto"]))).cast("long").alias("n"), F.greatest(a["upto"], s["end"]).alias("upto")
    )
    return F.aggregate(ordered, start, step, lambda a: a["n"])


def find_contamination(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", window=10, shingle=2) -> DataFrame:
    """One row a document: (row, id, digest, n_words, spans, items).

    ``spans`` are the distinct places (first word, end exclusive) of windows in the document, ``items`` the
    ids of the items they come from.
    """
    windows = materialized(item_windows(items, item_col, item_text_col, window, shingle))
    sizes = shingle_sizes(windows, shingle)
    counts = materialized(shingle_counts(docs, windows, text_col, sizes))  # written: the choice of join counts its rows first
    prefixes = materialized(prefixed(windows, counts))
    rows, hits = window_hits(docs, prefixes, id_col, text_col, window, sizes)
    hits = materialized(hits)
    spans = hits.select("row", F.struct("first", (F.col("first") + F.col("size")).alias("end")).alias("s")).distinct()
    spans = spans.groupBy("row").agg(F.collect_list("s").alias("spans"))
    owners = hits.select("row", "words").distinct().join(broadcast_if_small(windows.select("words", "item_id")), "words")
    owners = owners.select("row", "item_id").distinct().groupBy("row").agg(F.collect_list("item_id").alias("items"))
    return rows.join(spans, "row", "left").join(owners, "row", "left")


def decontaminate(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", **options) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of each document."""
    found = find_contamination(docs, items, id_col, text_col, item_col, item_text_col, **options)
    hit = F.when(F.col("spans").isNull(), F.lit(0).cast("long")).otherwise(covered_words(F.col("spans")))
    ids = F.array_sort(F.transform(F.coalesce("items", F.array()), lambda x: x.cast("string")))
    return found.select(
        F.col("id").alias(id_col),
        "n_words",
        hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def without_contamination(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", **options) -> DataFrame:
    """``docs`` without the rows whose text holds a window of an item. Only the text decides, so it is the key."""
    found = find_contamination(docs, items, id_col, text_col, item_col, item_text_col, **options)
    (name,) = fresh(docs, "digest")
    bad = materialized(found.where(F.col("spans").isNotNull()).select(F.col("digest").alias(name)).distinct())
    return docs.join(broadcast_if_small(bad), text_digest(docs[text_col]) == F.col(name), "left_anti")
