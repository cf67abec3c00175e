"""Small helpers that the operators of this folder share."""

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.session import checkpointed, scratch_folder

# Words of lower-cased text: bytes that split words become a space, A-Z become a-z. All bytes
# of a multi-byte character are from 0x80 on and so belong to words.
_ALNUM = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B))
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
LOWER_ALNUM = bytes(c if (c := LOWER[b]) >= 0x80 or c in _ALNUM else 0x20 for b in range(256))


def alnum_words(text: bytes) -> list:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 text."""
    return text.translate(LOWER_ALNUM).split()


def spaced_words(text: bytes) -> list:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text: ``bytes.split`` cuts at exactly these."""
    return text.split()


def text_rows(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(id, text as UTF-8 binary, more ...): only these columns are read; a null text is empty."""
    return df.select(
        df[id_col].alias("id"), F.coalesce(df[text_col].cast("binary"), F.lit(b"")).alias("text"), *more
    )


def fresh(df: DataFrame, *names: str) -> list:
    """The names with underscores in front, as many as no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def text_digest(text: Column) -> Column:
    """MD5 of a text; a null text has that of an empty one."""
    return F.md5(F.coalesce(text.cast("binary"), F.lit(b"")))


def materialized(df: DataFrame) -> DataFrame:
    """A copy in the shared checkpoint folder, so that lost executors do not repeat the work before it."""
    return checkpointed(df)


def new_folder(spark: SparkSession, name: str) -> str:
    return scratch_folder(spark, name)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def give_back() -> None:
    """Return to the system what Arrow and the C library keep of freed memory; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run):
    """``run`` for ``mapInArrow``, which gives memory back when its task ends."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def slices(lengths, limit):
    """Cut rows into runs whose lengths add up to about ``limit``; one row may exceed it."""
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """Another 64-bit hash of 64-bit hashes (multiply, xor-shift)."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
