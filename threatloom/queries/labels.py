"""Losses and metrics over scored events."""

from pyspark.sql import functions as F

from threatloom.operators import metrics as M
from threatloom.operators.counts import repeat_summary
from threatloom.queries.base import query, scores, sql, table
from threatloom.session import scratch_folder
from threatloom.sources.tables import write_metrics

R = 6


def _round(df, *names):
    return df.select(*[F.round(c, R).alias(c) if c in names else F.col(c) for c in df.columns])


def _scores(spark, sf):
    return scores(spark, sf).withColumn("score", F.col("score") / 100.0)


_Z = "SELECT event_id, score / 100.0::DOUBLE AS score, label, grp, day FROM v_score"
_RANK = {
    "z": _Z,
    "curve": """SELECT grp, day, score, sum(label) AS p, count(*) - sum(label) AS q FROM z2 GROUP BY 1, 2, 3""",
    "z2": "SELECT 'g' || CAST(event_id % 3 AS VARCHAR) AS grp, day, score, label FROM z",
    "run": "SELECT *, sum(p) OVER w AS cp, sum(q) OVER w AS cq FROM curve WINDOW w AS (PARTITION BY grp, day ORDER BY score DESC)",
}


def _ranked(spark, sf):
    return _scores(spark, sf).withColumn("grp", F.concat(F.lit("g"), (F.col("event_id") % 3).cast("string")))


@query(
    "l06_logistic_pair_loss",
    sql(
        f"""SELECT day, round(pos, {R}) AS pos_loss, round(neg, {R}) AS neg_loss, round(pos + neg, {R}) AS loss FROM (SELECT day,
avg(CASE WHEN label = 1 THEN -ln(1 / (1 + exp(-score)) + 1e-15) END) AS pos, avg(CASE WHEN label = 0 THEN -ln(1 - 1 / (1 + exp(-score)) + 1e-15) END) AS neg FROM z GROUP BY 1)""",
        z=_Z,
    ),
)
def logistic_pair_loss(spark, sf):
    return _round(M.logistic_pair_loss(_scores(spark, sf), ["day"]), "pos_loss", "neg_loss", "loss")


@query("l07_bce_logits", sql(f"SELECT grp, round(avg(greatest(score, 0) - score * label + ln(1 + exp(-abs(score)))), {R}) AS loss FROM z GROUP BY 1", z=_Z))
def bce_logits(spark, sf):
    return _round(M.bce_logits(_scores(spark, sf), ["grp"]), "loss")


@query(
    "l08_roc_auc",
    sql(f"SELECT grp, day, round(sum(q * (cp - p + p / 2.0::DOUBLE)) / nullif(sum(p) * sum(q), 0), {R}) AS auc FROM run GROUP BY 1, 2", **_RANK),
)
def roc_auc(spark, sf):
    return _round(M.roc_auc(_ranked(spark, sf), ["grp", "day"]), "auc")


@query(
    "l08_roc_auc_total",
    sql(
        f"""SELECT round((sum(rnk) FILTER (label = 1) - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n0), {R}) AS auc FROM (
SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rnk, sum(label) OVER () AS n1, sum(1 - label) OVER () AS n0 FROM z) GROUP BY n1, n0""",
        z=_Z,
    ),
)
def roc_auc_total(spark, sf):
    return _round(M.roc_auc(_scores(spark, sf)), "auc")


@query("l09_average_precision", sql(f"SELECT grp, day, round(sum(p * cp / (cp + cq)) / nullif(sum(p), 0), {R}) AS ap FROM run GROUP BY 1, 2", **_RANK))
def average_precision(spark, sf):
    return _round(M.average_precision(_ranked(spark, sf), ["grp", "day"]), "ap")


@query(
    "l10_pr_auc",
    sql(
        f"""SELECT grp, day, round(sum((r - CASE WHEN lr IS NULL THEN 0 ELSE lr END) * (pr + coalesce(lp, 1)) / 2), {R}) AS pr_auc FROM (SELECT *, lag(r) OVER w AS lr, lag(pr) OVER w AS lp FROM (
SELECT grp, day, score, cp / nullif(SUM(p) OVER (PARTITION BY grp, day), 0) AS r, cp / (cp + cq) AS pr FROM run) WINDOW w AS (PARTITION BY grp, day ORDER BY score DESC)) GROUP BY 1, 2""",
        **_RANK,
    ),
)
def pr_auc(spark, sf):
    return _round(M.pr_auc(_ranked(spark, sf), ["grp", "day"]), "pr_auc")


_LOGITS = """SELECT event_id, event_type AS ntype, CAST(ts AS DATE) AS snapshot_id, [value / 100, (user_id % 10) / 10.0::DOUBLE, 0.5::DOUBLE] AS x, CAST(event_id % 3 AS INTEGER) AS label FROM events"""


def _logits(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_type").alias("ntype"),
        F.col("ts").cast("date").alias("snapshot_id"),
        F.array(F.col("value") / 100, (F.col("user_id") % 10) / 10.0, F.lit(0.5)).alias("logits"),
        (F.col("event_id") % 3).cast("int").alias("label"),
    )


@query(
    "l11_accuracy",
    sql(f"SELECT ntype, snapshot_id, round(avg(CASE WHEN list_position(x, list_max(x)) - 1 = label THEN 1 ELSE 0 END), {R}) AS accuracy FROM logit GROUP BY 1, 2", logit=_LOGITS),
)
def accuracy(spark, sf):
    return _round(M.accuracy(_logits(spark, sf)), "accuracy")


@query(
    "l12_regression_error",
    f"""SELECT round(avg(mae), {R}) AS mae, round(avg(rmse), {R}) AS rmse FROM (SELECT CAST(ts AS DATE) AS d, avg(abs(value - user_id)) AS mae, sqrt(avg((value - user_id) * (value - user_id))) AS rmse FROM events GROUP BY 1)""",
)
def regression_error(spark, sf):
    rows = table(spark, sf, "events").select(F.col("ts").cast("date").alias("snapshot_id"), F.col("value").alias("pred"), F.col("user_id").alias("label"))
    return _round(M.regression_error(rows), "mae", "rmse")


@query(
    "l13_cross_entropy",
    sql(f"SELECT ntype, round(avg(ln(exp(x[1]) + exp(x[2]) + exp(x[3])) - x[label + 1]), {R}) AS loss FROM logit GROUP BY 1", logit=_LOGITS),
)
def cross_entropy(spark, sf):
    return _round(M.cross_entropy(_logits(spark, sf), ["ntype"]), "loss")


_SERIES = f"""SELECT 'link' AS task, grp AS type, m.metric, CAST(row_number() OVER (PARTITION BY grp, m.metric ORDER BY day) - 1 AS INTEGER) AS i, day AS snapshot, round(m.value, {R}) AS value FROM (
SELECT grp, day, unnest([{{'metric': 'auc', 'value': sum(q * (cp - p + p / 2.0::DOUBLE)) / nullif(sum(p) * sum(q), 0)}}, {{'metric': 'ap', 'value': sum(p * cp / (cp + cq)) / nullif(sum(p), 0)}}]) AS m FROM run GROUP BY 1, 2)"""


def _metric_rows(spark, sf):
    curve = M.score_curve(_ranked(spark, sf), ["grp", "day"])
    both = M.roc_auc(curve, ["grp", "day"]).join(M.average_precision(curve, ["grp", "day"]), ["grp", "day"])
    return M.metric_rows(both, "link", "grp", "day", ["auc", "ap"])


@query("l14_metric_series", sql(_SERIES, **_RANK))
def metric_series(spark, sf):
    rows = M.metric_series(_metric_rows(spark, sf)).select("task", "type", "metric", F.posexplode("series").alias("i", "s"))
    return rows.select("task", "type", "metric", "i", "s.snapshot", F.round("s.value", R).alias("value"))


@query("s11_write_metrics", sql(f"SELECT task, type, metric, snapshot, value FROM ({_SERIES})", **_RANK))
def write_metrics_query(spark, sf):
    path = scratch_folder(spark, "metrics")
    write_metrics(_metric_rows(spark, sf), path)
    back = spark.read.schema("task string, type string, snapshot date, metric string, value double").json(path)
    return _round(back, "value").select("task", "type", "metric", "snapshot", "value")


@query("a05_repeat_summary", sql(f"SELECT grp AS metric, round(avg(v), {R}) AS mean, round(stddev_samp(v), {R}) AS std FROM (SELECT grp, day, avg(score) AS v FROM v_score GROUP BY 1, 2) GROUP BY 1"))
def repeats(spark, sf):
    """Daily means as repeated runs."""
    runs = scores(spark, sf).groupBy(F.col("grp").alias("metric"), "day").agg(F.avg("score").alias("value"))
    return _round(repeat_summary(runs), "mean", "std")
