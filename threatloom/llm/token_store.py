"""Token-id files with one shared zstandard dictionary.

A store is a folder of two Parquet tables, written and read through Spark so that any file system
works: ``dictionary`` (one row: dictionary bytes, its hash, bytes per id, tokenizer end id) and
``chunks``. A chunk row holds the separately compressed ids of some documents one after the other
(``payload``), the index of where each begins (``offsets``, one more than documents), the ids of the
documents, their token counts and the hash of the dictionary that opens them. Chunks are in
ascending id order by (part, seq).

Defined results: a null text is empty (end id only); null ids come first; repeated ids stay as
documents of their own, in any order among themselves; an empty table gives a store without chunks.
"""

import hashlib
import json
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.llm.common import text_rows, texts_of
from threatloom.llm.tokens import encoded_batches, tokenizer_source

# The dictionary is trained on so many documents (those whose ids have the smallest hash) and so
# many first characters of each; it only affects sizes.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 1000, 8000, 65536
# A chunk ends at so many documents or payload bytes.
CHUNK_DOCS, CHUNK_BYTES = 1024, 4 << 20
LEVEL = 3


def train_dictionary(docs: DataFrame, source: str, width: str, id_col, text_col) -> bytes:
    """Dictionary from the serialized ids of a bounded sample; empty if there is too little to train on."""
    from threatloom.llm.tokens import encoder

    # ids first: only eight bytes a document are sorted, and texts of the chosen ones alone come to the driver
    order = F.xxhash64(docs[id_col])
    top = docs.select(order.alias("h")).orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h").alias("h")).first()["h"]
    texts = docs.where(order <= F.lit(top)).select(F.substring(docs[text_col], 1, SAMPLE_CHARS).cast("binary").alias("text"))
    sample = texts.where(F.length("text") > 0).limit(SAMPLE_DOCS).collect() if top is not None else []
    ids, counts = encoder(source).encode([bytes(r[0]) for r in sample])
    parts = [x.astype(width).tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if len(counts) else []
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:  # fewer bytes than a dictionary needs
        return b""


def dictionary_hash(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _codec(data: bytes):
    return zstandard.ZstdCompressionDict(data) if data else None


def write_token_store(docs: DataFrame, path: str, tokenizer_path: str, id_col="doc_id", text_col="text", end_id=2) -> None:
    """Write the ids of every document, in ascending id order, to a store at ``path``.

    One shuffle orders the texts by ranges of ids; encoding and compression follow it, so they run once.
    """
    spark = docs.sparkSession
    source = tokenizer_source(tokenizer_path)
    largest = max([end_id, *json.loads(source)["model"]["vocab"].values(), *(t["id"] for t in json.loads(source).get("added_tokens", []))])
    width = "<u2" if largest < 1 << 16 else "<u4"
    data = train_dictionary(docs, source, width, id_col, text_col)
    digest = dictionary_hash(data)
    shared = spark.sparkContext.broadcast((source, data))
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField(c, T.LongType()) for c in ("part", "seq")]
        + [T.StructField(c, id_type) for c in ("first_id", "last_id")]
        + [T.StructField("ids", T.ArrayType(id_type)), T.StructField("counts", T.ArrayType(T.LongType()))]
        + [T.StructField("offsets", T.ArrayType(T.LongType())), T.StructField("dictionary_sha256", T.StringType()), T.StructField("payload", T.BinaryType())]
    )

    def encode(batches):
        source, data = shared.value
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_codec(data))
        part, seq = TaskContext.get().partitionId(), 0
        ids, counts, offsets, frames = [], [], [0], []

        def chunk():
            row = {"part": part, "seq": seq, "first_id": ids[0], "last_id": ids[-1], "ids": ids, "counts": counts, "offsets": offsets, "dictionary_sha256": digest, "payload": b"".join(frames)}
            return pa.RecordBatch.from_pydict({c: [v] for c, v in row.items()}, schema=arrow)

        arrow = None
        for batch in batches:
            if arrow is None:
                kind = batch.schema.field(0).type
                arrow = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("first_id", kind), ("last_id", kind), ("ids", pa.list_(kind)), ("counts", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("dictionary_sha256", pa.string()), ("payload", pa.binary())])
            texts, keys = texts_of(batch), batch.column(0).to_pylist()
            for lo, _, flat, n in encoded_batches(source, texts):
                upto = np.concatenate([[0], np.cumsum(n + 1)]).tolist()
                ended = np.insert(flat, np.cumsum(n), end_id).astype(width)
                for i, (a, b) in enumerate(zip(upto[:-1], upto[1:])):
                    frames.append(packer.compress(ended[a:b]))
                    ids.append(keys[lo + i])
                    counts.append(b - a)
                    offsets.append(offsets[-1] + len(frames[-1]))
                    if len(ids) >= CHUNK_DOCS or offsets[-1] >= CHUNK_BYTES:
                        yield chunk()
                        seq += 1
                        ids, counts, offsets, frames = [], [], [0], []
        if ids:
            yield chunk()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = text_rows(docs, id_col, text_col).repartitionByRange(parts, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first())
    ordered.mapInArrow(encode, schema).write.option("compression", "none").parquet(f"{path}/chunks")
    spark.createDataFrame([(bytearray(data), digest, width, end_id)], "data binary, sha256 string, width string, end_id long").coalesce(1).write.parquet(f"{path}/dictionary")


def _opened(spark: SparkSession, path: str):
    """The store's chunks, and a function that gives the ids of each document of a batch of chunks."""
    head = spark.read.parquet(f"{path}/dictionary").first()
    shared = spark.sparkContext.broadcast(bytes(head["data"]))
    digest, width = head["sha256"], head["width"]

    def frames(payload, offsets, found):
        if found != digest:
            raise ValueError("chunk and dictionary do not belong together")
        opener = zstandard.ZstdDecompressor(dict_data=_codec(shared.value))
        return lambda i: np.frombuffer(opener.decompress(payload[offsets[i] : offsets[i + 1]]), width)

    return spark.read.parquet(f"{path}/chunks"), frames


def read_token_store(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files.

    ``start`` counts the ids of all documents before it. Sums are taken by part first, so the only
    window over everything has one row a part.
    """
    chunks, frames = _opened(spark, path)
    id_type = chunks.schema["first_id"].dataType
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("id", id_type)] + [T.StructField(c, T.LongType()) for c in ("within", "n_tokens", "ids_crc32")])

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids_of = frames(row["payload"], row["offsets"], row["dictionary_sha256"])
                n, crc = [], []
                for i in range(len(row["ids"])):
                    own = ids_of(i)
                    n.append(len(own))
                    crc.append(zlib.crc32(own.astype("<u4")))
                m = len(n)
                kind = batch.schema.field("first_id").type
                columns = [pa.array([row["part"]] * m, pa.int64()), pa.array([row["seq"]] * m, pa.int64()), pa.array(row["ids"], kind), pa.array(np.cumsum(n) - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    sizes = chunks.select("part", "seq", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", before(Window.orderBy("part")).alias("part_start"))
    starts = sizes.join(parts, "part").select("part", "seq", (F.col("part_start") + before(Window.partitionBy("part").orderBy("seq"))).alias("chunk_start"))
    docs = chunks.select("part", "seq", "first_id", "ids", "offsets", "dictionary_sha256", "payload").mapInArrow(read, schema)
    return docs.join(starts, ["part", "seq"]).select("id", (F.col("chunk_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, path: str, ids: list) -> DataFrame:
    """(id, tokens) of some documents: only chunks that can hold them are read, and only their frames opened."""
    chunks, frames = _opened(spark, path)
    near = F.lit(False)
    for x in ids:
        near = near | F.col("first_id").isNull() | ((F.col("first_id") <= F.lit(x)) & (F.col("last_id") >= F.lit(x)))
    schema = T.StructType([T.StructField("id", chunks.schema["first_id"].dataType), T.StructField("tokens", T.ArrayType(T.LongType()))])
    wanted = set(ids)

    def read(batches):
        for batch in batches:
            kind = batch.schema.field("first_id").type
            for row in batch.to_pylist():
                ids_of = frames(row["payload"], row["offsets"], row["dictionary_sha256"])
                hits = [i for i, x in enumerate(row["ids"]) if x in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([row["ids"][i] for i in hits], kind), pa.array([ids_of(i).tolist() for i in hits], pa.list_(pa.int64()))], names=["id", "tokens"])

    return chunks.where(near).select("first_id", "ids", "offsets", "dictionary_sha256", "payload").mapInArrow(read, schema)
