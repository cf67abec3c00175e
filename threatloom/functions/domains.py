"""Public-suffix check of domain names."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_domains(df: DataFrame, suffixes: DataFrame, column="domain", mode="intended") -> DataFrame:
    """Keep rows whose domain ends in a known public suffix.

    ``suffixes`` has one rule per row in column ``suffix``; ``*.x`` and ``!y.x`` rules count.
    ``parity`` keeps a row only if that suffix holds a dot. Every name is split into its label
    suffixes, so the check is an equi-join on the rule; Spark broadcasts the rules if they are small.
    """
    names = df.select(F.col(column).alias("_name")).distinct()
    labels = F.split(F.lower("_name"), r"\.")
    tail = names.select("_name", labels.alias("_labels")).select(
        "_name", "_labels", F.explode(F.sequence(F.lit(1), F.size("_labels"))).alias("_at")
    )
    tail = tail.select(
        "_name",
        F.array_join(F.expr("slice(_labels, _at, size(_labels))"), ".").alias("_own"),
        F.array_join(F.expr("slice(_labels, _at + 1, size(_labels))"), ".").alias("_parent"),
    )
    rules = tail.select(
        "_name",
        F.explode(
            F.array(
                F.struct(F.col("_own").alias("rule"), F.col("_own").alias("suffix"), F.lit(0).alias("exception")),
                F.struct(F.concat(F.lit("*."), "_parent").alias("rule"), F.col("_own").alias("suffix"), F.lit(0).alias("exception")),
                F.struct(F.concat(F.lit("!"), "_own").alias("rule"), F.col("_parent").alias("suffix"), F.lit(1).alias("exception")),
            )
        ).alias("r"),
    ).select("_name", "r.*")
    known = suffixes.select(F.lower("suffix").alias("rule")).distinct()
    best = (
        rules.join(known, "rule")
        .groupBy("_name")
        .agg(F.max_by("suffix", F.struct("exception", F.length("suffix"))).alias("_suffix"))
    )
    if mode == "parity":
        best = best.where(F.col("_suffix").contains("."))
    return df.join(best.select(F.col("_name").alias(column)), column, "left_semi")
