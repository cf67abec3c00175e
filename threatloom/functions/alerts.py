"""Alert rows: field fallbacks, defaults and extracted lists."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.functions.text import alert_text, classify_stage, day_key, extract_alert_files, parse_ts, IP_PATTERN

# Raw field name -> column name after reading.
ALERT_FIELDS = {
    "agent.name": "agent_name",
    "@timestamp": "ts_raw",
    "rule.id": "rule_id",
    "rule.description": "description",
    "process.name": "process_name",
    "process.executable": "process_executable",
    "destination.port": "destination_port",
    "source.port": "source_port",
    "user.name": "user_name",
    "user.id": "user_id",
}


def _text(df, name):
    if name not in df.columns:
        return F.lit(None).cast("string")
    return F.nullif(F.trim(F.col(f"`{name}`").cast("string")), F.lit(""))


def _port(df, name):
    """A number without its fraction, null for zero; any other text (a service name) as it is."""
    text = _text(df, name)
    number = text.try_cast("double").try_cast("long")
    return F.when(number.isNull(), text).otherwise(F.nullif(number, F.lit(0).cast("long")).cast("string"))


def normalize_alerts(df: DataFrame, file_mode="intended", text_columns=None) -> DataFrame:
    """One clean row per alert: keys of all nodes it can touch, plus its address and path lists.

    ``df`` carries ``alert_idx``. The text scanned for addresses and paths is every other
    column in full, or ``text_columns`` where given. A missing second field is read as null.
    """
    idx = F.col("alert_idx").cast("string")
    scanned = text_columns or [c for c in df.columns if c != "alert_idx"]
    text = alert_text(df, scanned)
    return df.select(
        F.col("alert_idx").cast("long").alias("alert_idx"),
        F.concat(F.lit("alert_"), idx).alias("alert"),
        F.coalesce(_text(df, "agent_name"), F.concat(F.lit("host_"), idx)).alias("host"),
        day_key(parse_ts(_text(df, "ts_raw"), "alert")).alias("day"),
        F.coalesce(_text(df, "rule_id"), F.concat(F.lit("rule_"), idx)).alias("rule"),
        F.coalesce(_text(df, "process_name"), _text(df, "process_executable")).alias("process"),
        F.concat(F.lit("port_"), F.coalesce(_port(df, "destination_port"), _port(df, "source_port"))).alias("port"),
        F.coalesce(_text(df, "user_name"), _text(df, "user_id")).alias("user"),
        classify_stage(_text(df, "description")).alias("stage"),
        F.array_distinct(F.regexp_extract_all(text, F.lit(IP_PATTERN), F.lit(0))).alias("ips"),
        F.array_distinct(extract_alert_files(text, file_mode)).alias("files"),
    )
