"""Which strings contain which, without comparing every pair."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.operators.pairs import blocked_join
from threatloom.session import checkpointed


def _contained(needles: DataFrame, haystacks: DataFrame, q: int) -> DataFrame:
    """Pairs (needle, haystack) where the haystack contains the needle; inputs are distinct strings.

    A needle inside a haystack shares every q-gram with it, so it is enough to look it up by
    one gram: its rarest. A needle shorter than ``q`` is its own gram, which is why the
    haystacks are cut into grams of each length up to ``q``.
    """
    grams_of = lambda k, s: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(s) - (k - 1), F.lit(1))), lambda i: F.substring(s, i, k)
    )
    by_length = F.flatten(F.array(*[F.when(F.length("hay") >= k, grams_of(F.lit(k), F.col("hay"))).otherwise(F.array().cast("array<string>")) for k in range(1, q + 1)]))
    hay = checkpointed(haystacks.select("hay", F.explode(F.array_distinct(by_length)).alias("gram")))
    own = F.array_distinct(grams_of(F.least(F.lit(q), F.length("needle")), F.col("needle")))
    keyed = needles.where(F.length("needle") > 0).select("needle", F.explode(own).alias("gram"))
    freq = hay.join(keyed.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = keyed.join(freq, "gram").groupBy("needle").agg(F.min(F.struct("n", "gram")).alias("g"))
    rarest = checkpointed(rarest.select("needle", F.col("g.gram").alias("gram")))
    return blocked_join(rarest, hay, "gram", "needle", "hay").where(F.col("hay").contains(F.col("needle"))).select("needle", "hay")


def containment_pairs(a: DataFrame, b: DataFrame, q=3) -> DataFrame:
    """Distinct pairs (a_key, b_key) of the ``key`` columns where either contains the other."""
    a, b = a.select("key").distinct(), b.select("key").distinct()
    inside = _contained(a.select(F.col("key").alias("needle")), b.select(F.col("key").alias("hay")), q)
    around = _contained(b.select(F.col("key").alias("needle")), a.select(F.col("key").alias("hay")), q)
    return (
        inside.select(F.col("needle").alias("a_key"), F.col("hay").alias("b_key"))
        .unionByName(around.select(F.col("hay").alias("a_key"), F.col("needle").alias("b_key")))
        .distinct()
    )
