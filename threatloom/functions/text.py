"""Indicator patterns and time parsing as column expressions (all inside the JVM)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.functions.domains import filter_domains
from threatloom.session import checkpointed
from threatloom.vocab import STAGE_WORDS

# Indicator patterns. Letters and digits of any script are word characters in paths.
IP_PATTERN = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
DOMAIN_PATTERN = r"\b(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}\b"
HASH_PATTERN = r"\b[0-9a-fA-F]{32,64}\b"
FILE_PATTERN = r"(?:[A-Za-z]:)?[\\/](?:[\p{L}\p{N}_.-]+[\\/])+[\p{L}\p{N}_.-]+"
TIME_PATTERN = r"(20\d{2}[-/\.]\d{1,2}[-/\.]\d{1,2}(?:[ T]\d{1,2}:\d{2}:\d{2})?)"
ALERT_FILE_PATTERN = r"\b/[\p{L}\p{N}_/.-]+\b"
ABSOLUTE_PATH_PATTERN = r"(?:^|[^\p{L}\p{N}_/.-])(/\.?[\p{L}\p{N}_](?:[\p{L}\p{N}_/.-]*[\p{L}\p{N}_])?)"

# Accepted time formats, each with the shape that makes a parse worth trying.
TIME_FORMATS = [
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d H:m:s"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
]
ALERT_TIME_FORMAT = (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}Z$", "yyyy-M-d'T'H:m:s.SSSSSS'Z'")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _find_all(c, pattern, group=0) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(pattern), F.lit(group))


def extract_ips(c) -> Column:
    """Distinct IPv4-shaped strings, in order of first appearance."""
    return F.array_distinct(_find_all(c, IP_PATTERN))


def extract_domains(c) -> Column:
    return F.array_distinct(_find_all(c, DOMAIN_PATTERN))


def extract_hashes(c) -> Column:
    """Distinct hex runs of 32 to 64 digits."""
    return F.array_distinct(_find_all(c, HASH_PATTERN))


def extract_files(c) -> Column:
    """Distinct paths with at least two separators."""
    return F.array_distinct(_find_all(c, FILE_PATTERN))


def extract_timestamps(c) -> Column:
    return F.array_distinct(_find_all(c, TIME_PATTERN))


def extract_alert_files(c, mode="intended") -> Column:
    """Paths in alert text: whole absolute paths, or with ``parity`` the loose word-bounded form."""
    if mode == "parity":
        return _find_all(c, ALERT_FILE_PATTERN)
    return _find_all(c, ABSOLUTE_PATH_PATTERN, 1)


def extract_entities(df: DataFrame, text="text", suffixes: DataFrame = None) -> DataFrame:
    """All five indicator lists of a text column in one projection.

    With ``suffixes`` (public suffix rules, see ``filter_domains``) the domain lists keep only names that end
    in a known suffix. The distinct names are checked once and come back as one list a row.
    """
    lists = F.struct(
        extract_ips(text).alias("ips"),
        extract_domains(text).alias("domains"),
        extract_hashes(text).alias("hashes"),
        extract_files(text).alias("files"),
        extract_timestamps(text).alias("timestamps"),
    )
    found = df.select(*[c for c in df.columns if c != text], lists.alias("entities"))
    if suffixes is None:
        return found
    found = checkpointed(found.withColumn("_at", F.monotonically_increasing_id()))
    names = found.select("_at", F.posexplode("entities.domains").alias("_pos", "domain"))
    known = filter_domains(names, suffixes).groupBy("_at").agg(F.sort_array(F.collect_list(F.struct("_pos", "domain"))).alias("_d"))
    kept = F.coalesce(F.transform("_d", lambda d: d["domain"]), F.array().cast("array<string>"))
    joined = found.join(known, "_at", "left")
    return joined.select(*[c for c in found.columns if c not in ("_at", "entities")], F.col("entities").withField("domains", kept).alias("entities"))


def parse_ts(c, mode="report") -> Column:
    """Wall-clock time of a string, null when no format fits; alerts know one format more.

    A failed parse costs an exception inside the JVM, so the shape is matched first.
    """
    formats = TIME_FORMATS + ([ALERT_TIME_FORMAT] if mode == "alert" else [])
    tries = [F.when(_col(c).rlike(shape), F.try_to_timestamp(_col(c), F.lit(f))) for shape, f in formats]
    return F.coalesce(*tries).cast("timestamp_ntz")


def report_time(timestamps, mode="report") -> Column:
    """Earliest parsable entry of a list of strings."""
    return F.array_min(F.filter(F.transform(_col(timestamps), lambda t: parse_ts(t, mode)), lambda t: t.isNotNull()))


def day_key(c) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd")


def classify_stage(c) -> Column:
    """Attack stage named by a rule description, null if no word fits."""
    text = F.lower(_col(c))
    stage = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, words in STAGE_WORDS:
        stage = stage.when(text.rlike("|".join(words)), F.lit(name))
    return stage


def alert_text(df: DataFrame, columns=None) -> Column:
    """All fields of an alert as one text; nulls are left out."""
    return F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in columns or df.columns])
