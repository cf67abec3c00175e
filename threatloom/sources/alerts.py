"""Alert CSV."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.functions.alerts import ALERT_FIELDS
from threatloom.operators.ranking import dense_index


def read_alerts(spark: SparkSession, path: str, multi_line=False) -> DataFrame:
    """All columns as text, known ones in snake case, plus ``alert_idx``.

    Rows with more fields than the header are dropped, even if the surplus is empty; shorter ones
    are padded with nulls. Rows are numbered in file order, files by path. Every file must have the same
    header. Files are split; ``multi_line`` allows quoted line breaks, which keeps a file in one task.
    """
    options = {"header": True, "multiLine": multi_line, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_record"}
    header = spark.read.options(**options).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, "_record"]])
    rows = spark.read.options(**options, enforceSchema=False).schema(schema).csv(path)
    # a record of another length is kept as text; commas outside quotes tell longer from shorter
    plain = F.regexp_replace("_record", r'"(?:[^"]|"")*"', "")
    longer = F.coalesce(F.length(plain) - F.length(F.replace(plain, F.lit(","), F.lit(""))) >= len(header), F.lit(False))
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line")]
    named = [F.col(f"`{c}`").alias(ALERT_FIELDS.get(c, c.replace(".", "_"))) for c in header]
    kept = rows.select(*named, *place, longer.alias("_longer")).where("not _longer").drop("_longer")
    numbered = dense_index(kept, ["_file", "_block", "_line"], name="alert_idx")
    return numbered.select("alert_idx", *[c for c in kept.columns if c not in ("_file", "_block", "_line")])
