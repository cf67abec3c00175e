"""Sliding windows, splits and pair labels over the order graph.

Author = supplier, paper = order, institution = nation; the snapshot is the order's month.
"""

from pyspark.sql import functions as F

from threatloom.operators import features as X
from threatloom.operators import sampling as P
from threatloom.operators import windows as Wn
from threatloom.operators.pairs import spread
from threatloom.queries.base import checksum, query, sql, sql_checksum, stage, table
from threatloom.queries.graphs import stored_report_graph
from threatloom.queries.snapshots import merged_graph, snap_sql
from threatloom.sources.tables import read_embeddings

WINDOW = 3

_CTES = {
    "p_item": """SELECT (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS s, l_suppkey AS author, l_orderkey AS paper, l_quantity AS qty
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "p_edges": "SELECT DISTINCT s, 'author' AS src_type, author AS src, 'writes' AS etype, 'paper' AS dst_type, paper AS dst FROM p_item",
    "p_feats": """SELECT s, 'author' AS ntype, author AS id, count(*) AS f0, sum(qty) AS f1 FROM p_item GROUP BY s, author
UNION ALL SELECT s, 'paper', paper, count(*), sum(qty) FROM p_item GROUP BY s, paper""",
    "p_n": "SELECT max(s) + 1 AS n FROM p_item",
    "p_win": f"SELECT i AS idx, s - i + {WINDOW} AS t, src_type, src, etype, dst_type, dst FROM p_edges, p_n, range(0, 1000) r(i) WHERE i > s AND i <= s + {WINDOW} AND i >= {WINDOW} AND i < n",
    "p_seen": f"SELECT i AS idx, s - i + {WINDOW} AS t, ntype, id, f0, f1 FROM p_feats, p_n, range(0, 1000) r(i) WHERE i > s AND i <= s + {WINDOW} AND i >= {WINDOW} AND i < n",
    "p_ids": "SELECT idx, ntype, id, row_number() OVER (PARTITION BY idx, ntype ORDER BY id) - 1 AS local_id FROM (SELECT DISTINCT idx, ntype, id FROM p_seen)",
    "p_pairs": """SELECT s, a.src, b.src AS dst, count(*) AS n FROM p_edges a JOIN (SELECT s AS s2, src, dst AS via FROM p_edges) b ON b.s2 = s AND b.via = a.dst AND b.src <> a.src GROUP BY 1, 2, 3""",
    "p_new": "SELECT c.s, c.src, c.dst FROM p_pairs c WHERE s > (SELECT min(s) FROM p_pairs) AND NOT EXISTS (SELECT 1 FROM p_pairs p WHERE p.s = c.s - 1 AND p.src = c.src AND p.dst = c.dst)",
    "p_linked": "SELECT s, src, dst FROM (SELECT s, src, dst FROM p_pairs UNION SELECT s + 1, src, dst FROM p_pairs) WHERE s > (SELECT min(s) FROM p_pairs) AND s <= (SELECT max(s) FROM p_pairs)",
}


def win_sql(body):
    return sql(body, **_CTES)


def items(spark, sf):
    month = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("paper"), month.alias("s"))
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("author"), F.col("l_orderkey").alias("paper"), F.col("l_quantity").alias("qty"))
    rows = lines.count()
    return spread(lines, rows, "paper").join(spread(orders, rows, "paper"), "paper").select("s", "author", "paper", "qty")


def writes(spark, sf):
    pairs = items(spark, sf).select("s", F.col("author").alias("src"), F.col("paper").alias("dst")).distinct()
    return pairs.select(
        "s", F.lit("author").alias("src_type"), "src", F.lit("writes").alias("etype"), F.lit("paper").alias("dst_type"), "dst"
    )


def features(spark, sf):
    def of(kind):
        rows = items(spark, sf).groupBy("s", F.col(kind).alias("id")).agg(F.count("*").alias("f0"), F.sum("qty").alias("f1"))
        vec = F.array(F.col("f0").cast("float"), F.col("f1").cast("float"))
        return rows.select("s", F.lit(kind).alias("ntype"), "id", vec.alias("vec"))

    return of("author").unionByName(of("paper"))


@query("w06_sliding_windows", win_sql(f"SELECT idx, t, count(*) AS n, {sql_checksum('src', 'dst')} FROM p_win GROUP BY 1, 2"))
def sliding_windows(spark, sf):
    windowed = Wn.sliding_windows(writes(spark, sf), WINDOW)
    return windowed.groupBy("idx", "t").agg(F.count("*").alias("n"), checksum("src", "dst"))


def _ids(spark, sf):
    return Wn.window_ids(features(spark, sf), WINDOW)


@query("w07_window_ids", win_sql("SELECT idx, ntype, id, local_id FROM p_ids"))
def window_ids(spark, sf):
    return _ids(spark, sf)


@query(
    "w08_reindex_edges",
    win_sql(
        f"""SELECT idx, t, etype, src_type, dst_type, count(*) AS n, {sql_checksum('src_id', 'dst_id')} FROM (
SELECT w.idx, t, src_type, a.local_id AS src_id, etype, dst_type, b.local_id AS dst_id FROM p_win w JOIN p_ids a ON a.idx = w.idx AND a.ntype = src_type AND a.id = src JOIN p_ids b ON b.idx = w.idx AND b.ntype = dst_type AND b.id = dst
UNION ALL SELECT w.idx, t, dst_type, b.local_id, etype || '_r', src_type, a.local_id FROM p_win w JOIN p_ids a ON a.idx = w.idx AND a.ntype = src_type AND a.id = src JOIN p_ids b ON b.idx = w.idx AND b.ntype = dst_type AND b.id = dst) GROUP BY 1, 2, 3, 4, 5"""
    ),
)
def reindex_edges(spark, sf):
    both = Wn.reindex_edges(Wn.sliding_windows(writes(spark, sf), WINDOW), _ids(spark, sf))
    return both.groupBy("idx", "t", "etype", "src_type", "dst_type").agg(F.count("*").alias("n"), checksum("src_id", "dst_id"))


@query(
    "w09_window_features",
    win_sql(
        f"""SELECT i.idx, i.ntype, g.t, count(*) AS n, sum(CASE WHEN f0 IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_zero, coalesce(sum(f0), 0)::DOUBLE AS f0, coalesce(sum(f1), 0)::DOUBLE AS f1
FROM p_ids i CROSS JOIN range({WINDOW}) g(t) LEFT JOIN p_seen s ON s.idx = i.idx AND s.ntype = i.ntype AND s.id = i.id AND s.t = g.t GROUP BY 1, 2, 3"""
    ),
)
def window_features(spark, sf):
    rows = Wn.window_features(features(spark, sf), _ids(spark, sf), WINDOW, 2)
    part = lambda k: F.sum(F.col("vec")[k].cast("double")).alias(f"f{k}")
    zero = F.sum((F.col("vec")[0] == 0).cast("long")).alias("n_zero")
    return rows.groupBy("idx", "ntype", "t").agg(F.count("*").alias("n"), zero, part(0), part(1))


_PLACED = "SELECT s, row_number() OVER (ORDER BY s) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT s FROM p_item)"


def _split(name, policy, w, expr):
    @query(name, win_sql(f"SELECT s, {expr} AS split FROM ({_PLACED}) WHERE i >= {w}"))
    def run(spark, sf):
        return Wn.temporal_split(items(spark, sf), policy, "s", w)


_split("w10_temporal_split_ratio", "ratio", 0, "CASE WHEN i < floor(n * 0.6::DOUBLE) THEN 'train' WHEN i < floor(n * 0.8::DOUBLE) THEN 'val' ELSE 'test' END")
_split("w10_temporal_split_last30", "last30", 7, "CASE WHEN i >= n - 30 THEN 'test' WHEN i >= n - 60 THEN 'val' ELSE 'train' END")
_split("w10_temporal_split_last", "last", 3, "CASE WHEN i = n - 1 THEN 'test' WHEN i = n - 2 THEN 'val' ELSE 'train' END")


@query(
    "w11_node_split",
    sql(
        """SELECT ntype, s.split, CASE s.split WHEN 'train' THEN a WHEN 'val' THEN b ELSE n - a - b END AS n
FROM (SELECT ntype, count(*) AS n, CAST(floor(count(*) * 0.6::DOUBLE) AS BIGINT) AS a, CAST(floor(count(*) * 0.2::DOUBLE) AS BIGINT) AS b FROM r_nodes GROUP BY 1),
(VALUES ('train'), ('val'), ('test')) s(split) WHERE CASE s.split WHEN 'train' THEN a WHEN 'val' THEN b ELSE n - a - b END > 0"""
    ),
)
def node_split(spark, sf):
    rows = Wn.node_split(stored_report_graph(spark, sf).nodes.select("key", "ntype"), 7)
    return rows.groupBy("ntype", "split").agg(F.count("*").alias("n"))


_VEC_IDS = """SELECT 'author' AS ntype, row_number() OVER (ORDER BY c_custkey) - 1 AS local_id, c_name AS key FROM customer
UNION ALL SELECT 'institution', row_number() OVER (ORDER BY n_nationkey) - 1, n_name FROM nation"""


@query(
    "f05_attach_embeddings",
    sql(
        """SELECT ntype, local_id, i.key, coalesce(embedding[1], 0)::DOUBLE AS head, coalesce(embedding[-1], 0)::DOUBLE AS tail
FROM vec_ids i LEFT JOIN embeddings ON ntype = 'author' AND vec_id = local_id""",
        vec_ids=_VEC_IDS,
    ),
)
def attach_embeddings(spark, sf):
    """Customers as authors, nations as institutions, parts as papers; filling stops at papers."""
    from threatloom.operators.ranking import dense_index

    def typed(name, key, order, kind):
        rows = table(spark, sf, name).select(F.col(order).alias("o"), F.col(key).alias("key"), F.lit(kind).alias("ntype"))
        return rows

    nodes = typed("customer", "c_name", "c_custkey", "author")
    nodes = nodes.unionByName(typed("nation", "n_name", "n_nationkey", "institution")).unionByName(typed("part", "p_name", "p_partkey", "paper"))
    ids = dense_index(nodes, ["o"], ["ntype"], "local_id").select("ntype", "local_id", "key")
    vectors = table(spark, sf, "embeddings").select(F.concat(F.lit("a_"), F.col("vec_id").cast("string")).alias("key"), F.col("embedding").alias("vec"))
    dim = len(vectors.first()["vec"])
    rows = X.attach_embeddings(ids, vectors, ["author", "institution", "paper", "field_of_study"], dim)
    return rows.select("ntype", "local_id", "key", F.col("vec")[0].cast("double").alias("head"), F.element_at("vec", -1).cast("double").alias("tail"))


@query("s12_read_embeddings", "SELECT CAST(vec_id AS VARCHAR) AS key, len(embedding) AS dim, embedding[1]::DOUBLE AS head, embedding[-1]::DOUBLE AS tail FROM embeddings")
def read_embeddings_query(spark, sf):
    rows = read_embeddings(spark, f"{sf}/embeddings.parquet", "vec_id", "embedding")
    return rows.select("key", F.size("vec").cast("long").alias("dim"), F.col("vec")[0].cast("double").alias("head"), F.element_at("vec", -1).cast("double").alias("tail"))


# -------------------------------------------------------------- pair labels


def pairs(spark, sf):
    return stage(spark, sf, "author_pairs", lambda: P.project_pairs(writes(spark, sf), "src", "dst"))


def authors(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"))


@query("l01_project_pairs", win_sql(f"SELECT s, count(*) AS n_pairs, sum(n)::BIGINT AS shared, {sql_checksum('src', 'dst', 'n')} FROM p_pairs GROUP BY 1"))
def project_pairs(spark, sf):
    rows = P.project_pairs(writes(spark, sf), "src", "dst")
    return rows.groupBy("s").agg(F.count("*").alias("n_pairs"), F.sum("n").alias("shared"), checksum("src", "dst", "n"))


@query("l02_new_pairs", win_sql(f"SELECT s, count(*) AS n, {sql_checksum('src', 'dst')} FROM p_new GROUP BY 1"))
def new_pairs(spark, sf):
    return P.new_pairs(pairs(spark, sf)).groupBy("s").agg(F.count("*").alias("n"), checksum("src", "dst"))


@query(
    "l03_negative_counts",
    win_sql("SELECT s, count(*) AS n_linked, (SELECT count(*) * (count(*) - 1) FROM supplier) - count(*) AS n_negative FROM p_linked GROUP BY 1"),
)
def negative_counts(spark, sf):
    return P.negative_counts(pairs(spark, sf), authors(spark, sf))


@query("l03_negative_pairs")
def negative_pairs(spark, sf):
    """As many negatives as a tenth of the snapshot's new pairs."""
    linked = pairs(spark, sf)
    return P.negative_pairs(linked, authors(spark, sf), P.sample_sizes(P.new_pairs(linked)), 7)


_SIZES = """SELECT s, n, least(n, (SELECT count(*) * (count(*) - 1) FROM supplier) - coalesce(used, 0)) AS n_free
FROM (SELECT s, CAST(floor(count(*) * 0.1::DOUBLE) AS BIGINT) AS n FROM p_new GROUP BY 1) LEFT JOIN (SELECT s, count(*) AS used FROM p_linked GROUP BY 1) USING (s)"""


@query("l03_negative_pairs_check", win_sql(f"SELECT s, n_free AS n, n_free AS n_distinct, 0 AS n_linked, 0 AS n_self FROM ({_SIZES}) WHERE n_free > 0"))
def negative_pairs_check(spark, sf):
    """Every snapshot gets its number of negatives, all different, none linked now or before, none with itself."""
    drawn = negative_pairs(spark, sf)
    linked = P.linked_now_or_before(pairs(spark, sf)).withColumn("linked", F.lit(1))
    marked = drawn.join(linked, ["s", "src", "dst"], "left")
    return marked.groupBy("s").agg(
        F.count("*").alias("n"),
        F.countDistinct("src", "dst").alias("n_distinct"),
        F.count("linked").cast("int").alias("n_linked"),
        F.count(F.when(F.col("src") == F.col("dst"), 1)).cast("int").alias("n_self"),
    )


@query("l04_sample_pairs", win_sql(f"SELECT s, 1 AS label, n FROM ({_SIZES}) WHERE n > 0 UNION ALL SELECT s, 0, n_free FROM ({_SIZES}) WHERE n_free > 0"))
def sample_pairs(spark, sf):
    rows = P.sample_pairs(pairs(spark, sf), authors(spark, sf), 0.1, 7)
    return rows.groupBy("s", "label").agg(F.count("*").alias("n"))


@query(
    "l05_sample_edges",
    snap_sql(
        """SELECT s.ntype AS src_type, etype, d.ntype AS dst_type, label, least(100, count(*)) AS n
FROM m_edges JOIN m_nodes s ON s.key = src JOIN m_nodes d ON d.key = dst, (VALUES (0), (1)) l(label) GROUP BY 1, 2, 3, 4"""
    ),
)
def sample_edges(spark, sf):
    g = merged_graph(spark, sf)
    ids = X.local_ids(g.nodes)
    rows = P.sample_edges(X.typed_edges(ids, g.edges), ids, 100, 7, test=True)
    return rows.groupBy("src_type", "etype", "dst_type", "label").agg(F.count("*").alias("n"))
