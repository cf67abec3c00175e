"""Joins that treat null keys as equal."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, on, how="inner") -> DataFrame:
    """``left`` joined with ``right`` on the columns ``on``, where null meets null; one copy of the keys stays."""
    on = list(on)
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(renamed, same, how).drop(*[f"_r_{c}" for c in on])
