"""Packing of tokenized documents into sequences of fixed length.

First-fit decreasing with a tournament tree of bin capacities, run independently in randomised
groups of documents. A document longer than a sequence gives full pieces of their own and one
rest; the rests of a group are packed.

Defined results: a null text counts as empty (it has the end id only); repeated rows are documents
of their own; null ids stay; an empty table gives no pieces; other columns are not read.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.llm.common import lean, materialized, text_rows, texts_of
from threatloom.llm.tokens import encoded_batches, encoder, tokenizer_source

# Documents of one packing group on average: what one task holds, and enough for little padding.
GROUP_DOCS = 20_000


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple:
    """(bin, offset) of each size. Every size lies between 1 and ``capacity``.

    A tournament tree holds at each node the largest room among the bins below it. From the root,
    the leftmost child with enough room leads to the first bin that fits.
    """
    n = len(sizes)
    width = 1
    while width < n:
        width *= 2
    room = [capacity] * (2 * width)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for item in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[item]), 1
        while node < width:
            node *= 2
            if room[node] < size:
                node += 1
        bins[item], offsets[item] = node - width, capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


def document_pieces(docs: DataFrame, tokenizer_path: str, id_col="doc_id", text_col="text", capacity=1024, end_id=0, keep_cache=True) -> DataFrame:
    """(id, doc_tokens, crcs): token count with the end id, and a CRC-32 for each cut of ``capacity`` ids.

    Without ``keep_cache`` a worker forgets the pieces it knows when its task ends, for jobs that go on with other work.
    """
    source = docs.sparkSession.sparkContext.broadcast(tokenizer_source(tokenizer_path))

    def encode(batches):
        for batch in batches:
            texts, ids = texts_of(batch), batch.column(0)
            for lo, hi, flat, counts in encoded_batches(source.value, texts):
                upto = np.concatenate([[0], np.cumsum(counts + 1)]).tolist()
                ended = np.insert(flat, np.cumsum(counts), end_id).astype("<u4")
                crcs = [[zlib.crc32(ended[i : min(i + capacity, b)]) for i in range(a, b, capacity)] for a, b in zip(upto[:-1], upto[1:])]
                columns = [ids.slice(lo, hi - lo), pa.array(counts + 1, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "doc_tokens", "crcs"])

    def encode_and_forget(batches):
        try:
            yield from encode(batches)
        finally:
            encoder.cache_clear()

    encode_task = encode if keep_cache else lean(encode_and_forget)
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("doc_tokens", T.LongType()), T.StructField("crcs", T.ArrayType(T.LongType()))])
    return text_rows(docs, id_col, text_col).mapInArrow(encode_task, schema)


def pack_pieces(cut: DataFrame, capacity=1024, group_docs=GROUP_DOCS) -> DataFrame:
    """Sequences of the documents of ``document_pieces``: one row a piece with its place.

    The documents are dealt to groups by a hash of their place in the written table, so equal ids
    or sources do not meet in one group. Sequence ids are unique over all groups.
    """
    groups = max(1, -(-cut.count() // group_docs))
    dealt = cut.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    schema = T.StructType([cut.schema["id"]] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def pack(group):
        if not group.num_rows:
            return pa.Table.from_pylist([], schema=pa.schema([("id", group.schema.field("id").type)] + [(c.name, pa.int64()) for c in schema[1:]]))
        number = group.column("grp")[0].as_py()
        tokens = group.column("doc_tokens").to_numpy()
        pieces = -(-tokens // capacity)
        row = np.repeat(np.arange(len(tokens)), pieces)
        start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
        length = np.minimum(capacity, tokens[row] - start)
        order, offset = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        rest = np.flatnonzero(length < capacity)
        full = np.flatnonzero(length == capacity)
        order[rest], offset[rest] = first_fit_decreasing(length[rest], capacity)
        order[full] = np.arange(len(full)) + (order[rest].max() + 1 if len(rest) else 0)
        crcs = group.column("crcs").combine_chunks().flatten()
        longs = (start, length, crcs, tokens[row], order + (number << 40), offset)
        columns = [group.column("id").take(pa.array(row)), *(pa.array(c, pa.int64()) for c in longs)]
        return pa.Table.from_arrays(columns, names=[c.name for c in schema])

    return dealt.groupBy("grp").applyInArrow(pack, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col="doc_id", text_col="text", capacity=1024, end_id=0, group_docs=GROUP_DOCS, keep_cache=True) -> DataFrame:
    """One row for each piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    cut = materialized(document_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id, keep_cache))
    return pack_pieces(cut, capacity, group_docs).withColumnRenamed("id", id_col)
