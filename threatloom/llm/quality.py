"""Quality rules: measures of each text, and line frequency across the documents of a host.

Lines are normalised (lower case, single spaces) and hashed. A line is boilerplate on a host if more
than ``max(least_docs, share * documents)`` distinct documents of the host hold it. Equal texts are one
document there, and so are near copies: a document with half of its words or more in lines that are frequent
on the host is named by its middle line (by frequency, then hash, the one that holds its middle word), and documents of one
name count once. So a group of copies that differ in a few lines does not make its own text boilerplate. Boilerplate
lines are removed, and a document that keeps too few of its words is rejected. What happens to a document depends on its
host and text only, so the verdict is joined back on these.

Defined results: a null text has no words and fails; a null host is a host of its own; a text without
line breaks is one line; repeated rows get equal answers; an empty table gives no rows; other columns
are not read by the measures and stay in ``clean_documents``.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.llm.common import LOWER, fresh, lean, materialized, slices, spaced_words, text_digest, text_rows, texts_of
from threatloom.operators.pairs import broadcast_if_small

# A line on more documents of a host than this many and this share of them is boilerplate.
LEAST_DOCS, SHARE = 10, 0.02
# A document must keep this share of its words.
KEPT_WORDS = 0.2
# Base rules: fewest words, and most percent of words in repeated windows of WINDOW words.
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5

# Bytes of text measured at once: bounds memory only.
STEP_BYTES = 1 << 22

_DROPPED = bytes(range(0x80, 0xC0)) + b"\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = b"#*$%&|<>"


def line_key(line: bytes) -> int:
    """First 60 bits of the MD5 of a normalised line, as a number that is not negative."""
    return int.from_bytes(hashlib.md5(b" ".join(line.translate(LOWER).split())).digest()[:8], "big") >> 4


def repeated_words(words: list, window=WINDOW) -> int:
    """Words in runs of ``window`` words that occur twice or more, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    runs, base = ids, max(2, len(known))
    run_size = len(ids)
    for i in range(1, window):  # number the runs of i + 1 words, so that keys stay small and exact
        run_size -= 1
        keys = runs[:run_size] * base + ids[i : i + run_size]
        runs = keys if i + 1 < window and base ** (i + 2) < 1 << 62 else np.unique(keys, return_inverse=True)[1]
    counts = np.bincount(runs)
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(counts[runs] > 1)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def text_measures(text: bytes) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {line key: words in such lines})."""
    words = spaced_words(text)
    seen, doubled, lines = set(), 0, {}
    for line in text.split(b"\n"):
        size = len(line.split())
        if size:
            doubled += line in seen
            seen.add(line)
            key = line_key(line)
            lines[key] = lines.get(key, 0) + size
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    return len(words), len(text.translate(None, _DROPPED)), symbols, doubled, repeated_words(words), lines


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(row, id, host, digest, measures, lines): measures of each document and the hashes of its lines."""
    kind = docs.schema[id_col].dataType
    source = text_rows(docs, id_col, text_col, docs[host_col].cast("string").alias("host"), text_digest(docs[text_col]).alias("digest"))

    def run(batches):
        for batch in batches:
            texts = texts_of(batch)
            for lo, hi in slices([len(t) for t in texts], STEP_BYTES):
                rows = [text_measures(t) for t in texts[lo:hi]]
                numbers = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(r[5]) for r in rows])]).astype(np.int32))
                flat = [pa.array([x for r in rows for x in part(r[5])], pa.int64()) for part in (dict.keys, dict.values)]
                lines = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(flat, ["h", "n"]))
                own = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), own.column(3), *numbers, lines], names=["id", "host", "digest", *MEASURES, "lines"])

    line = T.StructType([T.StructField("h", T.LongType()), T.StructField("n", T.LongType())])
    schema = T.StructType(
        [T.StructField("id", kind), T.StructField("host", T.StringType()), T.StructField("digest", T.StringType())]
        + [T.StructField(c, T.LongType()) for c in MEASURES]
        + [T.StructField("lines", T.ArrayType(line))]
    )
    return materialized(source.mapInArrow(lean(run), schema).withColumn("row", F.monotonically_increasing_id()))


def boilerplate(made: DataFrame, least_docs=LEAST_DOCS, share=SHARE) -> DataFrame:
    """(host, h): lines that stand in too many distinct documents of their host.

    Documents are counted by adding up before and after the shuffle, so a host or line with a third of all rows is
    spread over the tasks. Only lines that reach the limit with every document counted are looked at again.
    """
    distinct = made.groupBy("host", "digest").agg(F.first("lines").alias("lines"), F.first("n_words").alias("n_words"))
    distinct = materialized(distinct.withColumn("doc", F.monotonically_increasing_id()))
    lines = distinct.select("host", "doc", "n_words", F.explode("lines").alias("l")).select("host", "doc", "n_words", "l.h", "l.n")
    often = lines.groupBy("host", "h").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > least_docs)
    often = materialized(often.select(F.col("host").alias("_host"), F.col("h").alias("_h"), "docs"))
    lines = lines.join(broadcast_if_small(often), (F.col("h") == F.col("_h")) & F.col("host").eqNullSafe(F.col("_host")))
    lines = materialized(lines.select("host", "doc", "n_words", "h", "n", "docs"))
    # the middle line: the first one, most frequent first, up to which half of the words stand
    order = W.partitionBy("doc").orderBy(F.col("docs").desc(), "h").rowsBetween(W.unboundedPreceding, 0)
    half = lines.withColumn("upto", F.sum("n").over(order)).where(2 * F.col("upto") >= F.col("n_words"))
    named = materialized(half.groupBy("host", "doc").agg(F.min_by("h", "upto").alias("name")))
    groups = named.select("host", "name").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("more"))
    alone = distinct.join(named.select("doc"), "doc", "left_anti").groupBy("host").agg(F.count(F.lit(1)).alias("more"))
    sizes = alone.unionByName(groups).groupBy(F.col("host").alias("_host")).agg(F.sum("more").alias("size"))
    # a line's documents: groups of one name, and the documents without a name
    held = lines.join(named.select("doc", "name"), "doc", "left")
    held = held.groupBy("host", "h", "name").agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.when(F.col("name").isNull(), F.col("n")).otherwise(1))
    counts = held.groupBy("host", "h").agg(F.sum("n").alias("n")).where(F.col("n") > least_docs)
    limit = F.greatest(F.lit(float(least_docs)), F.col("size") * share)
    over = counts.join(broadcast_if_small(materialized(sizes)), F.col("host").eqNullSafe(F.col("_host")))
    return materialized(over.where(F.col("n") > limit).select("host", "h"))


def with_verdict(made: DataFrame, over: DataFrame, kept_words=KEPT_WORDS) -> DataFrame:
    """``made`` with ``removed`` (line hashes), ``n_removed`` (words), ``base_failed`` and ``kept``."""
    lines = made.select("row", "host", F.explode("lines").alias("l")).select("row", "host", "l.h", "l.n")
    gone = over.select(F.col("host").alias("_host"), F.col("h").alias("_h"))
    found = lines.join(broadcast_if_small(gone), (F.col("h") == F.col("_h")) & F.col("host").eqNullSafe(F.col("_host")))
    by_row = found.groupBy("row").agg(F.collect_list("h").alias("removed"), F.sum("n").alias("n_removed"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    depleted = F.col("n_words") - F.col("n_removed") < kept_words * F.col("n_words")
    joined = made.join(by_row, "row", "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0).cast("long")))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def quality_verdicts(docs: DataFrame, id_col="doc_id", text_col="text", host_col="source", least_docs=LEAST_DOCS, share=SHARE, kept_words=KEPT_WORDS) -> DataFrame:
    """(id, measures, base_failed, kept, n_removed) of each document."""
    made = measured(docs, id_col, text_col, host_col)
    judged = with_verdict(made, boilerplate(made, least_docs, share), kept_words)
    return judged.select(F.col("id").alias(id_col), *MEASURES, "base_failed", "kept", "n_removed")


def clean_documents(docs: DataFrame, id_col="doc_id", text_col="text", host_col="source", least_docs=LEAST_DOCS, share=SHARE, kept_words=KEPT_WORDS, chars_col=None) -> DataFrame:
    """``docs`` without rejected rows and, in the others, without boilerplate lines.

    ``chars_col`` names a column that holds the text's number of characters; it follows the text.
    """
    made = measured(docs, id_col, text_col, host_col)
    judged = with_verdict(made, boilerplate(made, least_docs, share), kept_words)
    # equal host and text have equal verdicts; rows without any effect need no join partner
    host, digest, keep, removed = fresh(docs, "host", "digest", "kept", "removed")
    touched = judged.where(~F.col("kept") | F.col("removed").isNotNull()).groupBy(F.col("host").alias(host), F.col("digest").alias(digest))
    touched = touched.agg(F.first("kept").alias(keep), F.first("removed").alias(removed))
    joined = docs.join(touched, (text_digest(docs[text_col]) == F.col(digest)) & docs[host_col].cast("string").eqNullSafe(F.col(host)), "left")
    kept = joined.where(F.coalesce(keep, F.lit(True))).select(*docs.columns, removed)
    names = docs.columns

    def run(batches):
        for batch in batches:
            at, marks = batch.schema.get_field_index(text_col), batch.column(len(names)).to_pylist()
            texts = batch.column(at).to_pylist()
            for i, gone in enumerate(marks):
                if gone:
                    gone = set(gone)
                    lines = texts[i].encode().split(b"\n")
                    texts[i] = b"\n".join(x for x in lines if not x.split() or line_key(x) not in gone).decode()
            columns = [batch.column(i) if i != at else pa.array(texts, batch.schema.field(at).type) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = kept.mapInArrow(lean(run), docs.schema)
    return out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType)) if chars_col else out
