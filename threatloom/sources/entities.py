"""Report entities as JSON lines."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.operators.ranking import dense_index
from threatloom.vocab import ENTITY_FIELDS

ENTITY_SCHEMA = T.StructType(
    [
        T.StructField("report_name", T.StringType()),
        T.StructField("entities", T.StructType([T.StructField(f, T.ArrayType(T.StringType())) for f in ENTITY_FIELDS])),
    ]
)


def fill_entities(df: DataFrame) -> DataFrame:
    """Missing entity lists become empty ones."""
    have = df.schema["entities"].dataType.fieldNames()
    empty = F.array().cast("array<string>")
    lists = [(F.coalesce(f"entities.{f}", empty) if f in have else empty).alias(f) for f in ENTITY_FIELDS]
    return df.withColumn("entities", F.struct(*lists))


def entity_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(line) of every line that is no JSON object or names no report."""
    schema = T.StructType([*ENTITY_SCHEMA.fields, T.StructField("_line", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.col("value").alias("line"), F.from_json("value", schema, {"columnNameOfCorruptRecord": "_line"}).alias("e"))
    return parsed.where("e is null or e._line is not null or e.report_name is null").select("line")


def read_entities(spark: SparkSession, path: str, on_bad="raise") -> DataFrame:
    """(report_idx, report_name, entities) with every list present.

    Lines of a distributed read have no number, so reports are numbered once in the order of
    name and content. A malformed line or one without a name is an error; with ``on_bad="drop"`` such
    lines are left out, and ``entity_rejects`` lists them.
    """
    strict = on_bad == "raise"
    rows = fill_entities(spark.read.schema(ENTITY_SCHEMA).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path))
    if strict:
        unnamed = F.raise_error(F.lit("an entity line names no report")).cast("string")
        rows = rows.withColumn("report_name", F.coalesce("report_name", unnamed))
    else:
        rows = rows.where("report_name is not null")
    ordered = rows.withColumn("_text", F.to_json("entities"))
    return dense_index(ordered, ["report_name", "_text"], name="report_idx").select("report_idx", "report_name", "entities")


def write_entities(df: DataFrame, path: str) -> None:
    df.select("report_name", "entities").write.mode("errorifexists").json(path)
