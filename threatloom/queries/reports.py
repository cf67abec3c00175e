"""Text functions and the pieces of the report graph."""

from pyspark.sql import functions as F

from threatloom.functions import text as T
from threatloom.functions.domains import filter_domains
from threatloom.operators import report_graph as R
from threatloom.operators.counts import edge_counts
from threatloom.operators.writes import edge_kind
from threatloom.queries.base import alerts, checksum, doc_text, mention, query, reports, sql, sql_checksum
from threatloom.vocab import ENTITY_FIELDS, PAIR_EDGES

IP, DOMAIN, HASH = T.IP_PATTERN, T.DOMAIN_PATTERN, T.HASH_PATTERN
FILE, TIME = T.FILE_PATTERN, T.TIME_PATTERN


def _extract(name, fn, pattern):
    body = f"""SELECT report_name, v AS value FROM (SELECT report_name, unnest(list_distinct(regexp_extract_all(text, '{pattern}'))) AS v FROM v_doc_text)"""

    @query(name, sql(body))
    def run(spark, sf):
        return doc_text(spark, sf).select("report_name", F.explode(fn("text")).alias("value"))


_extract("e01_extract_ips", T.extract_ips, IP)
_extract("e02_extract_domains", T.extract_domains, DOMAIN)
_extract("e03_extract_hashes", T.extract_hashes, HASH)
_extract("e04_extract_files", T.extract_files, FILE)

# Paths with letters beyond ASCII, put into every text.
_PATHS = "C:\\Users\\Zoë\\tmp\\x.exe /opt/日本/bin/a "


@query("e04_extract_files_any_script", sql(f"SELECT report_name, unnest(list_distinct(regexp_extract_all('{_PATHS}' || text, '{FILE}'))) AS value FROM v_doc_text"))
def extract_files_any_script(spark, sf):
    texts = doc_text(spark, sf).select("report_name", F.concat(F.lit(_PATHS), "text").alias("text"))
    return texts.select("report_name", F.explode(T.extract_files("text")).alias("value"))


@query(
    "e05_extract_timestamps",
    f"""WITH t AS (SELECT o_orderkey, 'seen ' || CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate + INTERVAL 30 YEAR, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate + INTERVAL 30 YEAR, '%Y/%m/%d')
WHEN 2 THEN strftime(o_orderdate + INTERVAL 30 YEAR, '%Y.%m.%d') ELSE strftime(o_orderdate + INTERVAL 30 YEAR, '%Y-%m-%d %H:%M:%S') END || ', filed ' || strftime(o_orderdate, '%Y-%m-%d') AS text FROM orders)
SELECT o_orderkey, unnest(list_distinct(regexp_extract_all(text, '{TIME}'))) AS value FROM t""",
)
def extract_timestamps(spark, sf):
    """Dates written into a text in four forms; years before 2000 never match."""
    later = F.expr("o_orderdate + INTERVAL 30 YEAR")
    forms = {0: "yyyy-MM-dd", 1: "yyyy/MM/dd", 2: "yyyy.MM.dd", 3: "yyyy-MM-dd HH:mm:ss"}
    key = F.col("o_orderkey") % 4
    shown = F.coalesce(*[F.when(key == k, F.date_format(later, f)) for k, f in forms.items()])
    text = F.concat(F.lit("seen "), shown, F.lit(", filed "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", text.alias("text"))
    return orders.select("o_orderkey", F.explode(T.extract_timestamps("text")).alias("value"))


# A small suffix table, as a caller would supply it.
SUFFIXES = ["com", "net", "org", "co.uk", "uk", "example.net", "*.ck", "!www.ck"]
_RULES = ", ".join(f"('{s}')" for s in SUFFIXES)
_DOMAINS = f"SELECT DISTINCT report_name, unnest(regexp_extract_all(text, '{DOMAIN}')) AS domain FROM v_doc_text UNION SELECT report_name, value FROM ment WHERE kind = 'domain'"


def _domain_sql(extra):
    return sql(
        f"""SELECT report_name, domain FROM doms WHERE domain IN (
SELECT domain FROM (SELECT domain, list_extract(string_split(lower(domain), '.'), -1) AS one,
array_to_string(list_slice(string_split(lower(domain), '.'), -2, -1), '.') AS two FROM doms) WHERE two IN (SELECT s FROM rules) {extra})""",
        doms=_DOMAINS,
        rules=f"SELECT * FROM (VALUES {_RULES}) r(s)",
    )


def _domains(spark, sf, mode):
    found = doc_text(spark, sf).select("report_name", F.explode(T.extract_domains("text")).alias("domain"))
    listed = mention(spark, sf, ["domain"]).select("report_name", F.col("value").alias("domain"))
    return filter_domains(found.unionByName(listed).distinct(), suffix_rules(spark), mode=mode).select("report_name", "domain")


@query("e06_filter_domains", _domain_sql("OR one IN (SELECT s FROM rules)"))
def filter_domains_intended(spark, sf):
    return _domains(spark, sf, "intended")


@query("e06_filter_domains_dotted", _domain_sql(""))
def filter_domains_parity(spark, sf):
    return _domains(spark, sf, "parity")


_LISTS = ", ".join(
    f"to_json(list_sort(list_distinct(regexp_extract_all(text, '{p}')))) AS {n}"
    for n, p in zip(["ips", "domains", "hashes", "files", "timestamps"], [IP, DOMAIN, HASH, FILE, TIME])
)


def suffix_rules(spark):
    return spark.createDataFrame([(s,) for s in SUFFIXES], "suffix string")


_KNOWN = "(list_extract(string_split(lower({0}), '.'), -1) IN ({1}) OR array_to_string(list_slice(string_split(lower({0}), '.'), -2, -1), '.') IN ({1}))".format("d", ", ".join(f"'{s}'" for s in SUFFIXES))
_KNOWN_LISTS = _LISTS.replace(f"list_distinct(regexp_extract_all(text, '{DOMAIN}'))", f"list_filter(list_distinct(regexp_extract_all(text, '{DOMAIN}')), lambda d: {_KNOWN})")


@query("e07_extract_entities", sql(f"SELECT report_name, {_KNOWN_LISTS} FROM v_doc_text"))
def extract_entities(spark, sf):
    rows = T.extract_entities(doc_text(spark, sf), suffixes=suffix_rules(spark))
    lists = [F.to_json(F.sort_array(f"entities.{f}")).alias(f) for f in ["ips", "domains", "hashes", "files", "timestamps"]]
    return rows.select("report_name", *lists)


_FIELDS = ["agent_name", "ts_raw", "rule_id", "description", "process_name", "process_executable", "destination_port", "user_name", "full_log"]


def _alert_files(name, mode, pattern, group):
    body = f"SELECT alert_idx, unnest(list_distinct(regexp_extract_all(concat_ws(' ', {', '.join(_FIELDS)}, ' /opt/日本/bin/a'), '{pattern}', {group}))) AS file FROM v_alert"

    @query(name, sql(body))
    def run(spark, sf):
        rows = alerts(spark, sf)
        text = F.concat_ws(" ", T.alert_text(rows, _FIELDS), F.lit(" /opt/日本/bin/a"))
        return rows.select("alert_idx", F.explode(F.array_distinct(T.extract_alert_files(text, mode))).alias("file"))


_alert_files("e08_extract_alert_files", "intended", T.ABSOLUTE_PATH_PATTERN, 1)
_alert_files("e08_extract_alert_files_loose", "parity", T.ALERT_FILE_PATTERN, 0)


@query(
    "e09_alert_text",
    sql(
        "SELECT alert_idx, concat_ws(' ', agent_name, ts_raw, rule_id, description, process_name, process_executable, destination_port, user_name, full_log) AS text FROM v_alert"
    ),
)
def alert_text(spark, sf):
    rows = alerts(spark, sf)
    return rows.select("alert_idx", T.alert_text(rows, [c for c in rows.columns if c != "alert_idx"]).alias("text"))


@query(
    "e10_parse_ts",
    sql(
        """SELECT 'r' AS side, value AS raw, count(*) AS n, strftime(try_strptime(value, ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d']), '%Y-%m-%d %H:%M:%S') AS parsed FROM v_mention WHERE kind = 'timestamp' GROUP BY value
UNION ALL SELECT 'a', ts_raw, count(*), strftime(try_strptime(ts_raw, ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d', '%Y-%m-%dT%H:%M:%S.%fZ']), '%Y-%m-%d %H:%M:%S') FROM v_alert GROUP BY ts_raw"""
    ),
)
def parse_ts(spark, sf):
    show = lambda mode: F.date_format(T.parse_ts("raw", mode), "yyyy-MM-dd HH:mm:ss").alias("parsed")
    r = mention(spark, sf, ["timestamp"]).groupBy(F.col("value").alias("raw")).agg(F.count("*").alias("n"))
    a = alerts(spark, sf).groupBy(F.col("ts_raw").alias("raw")).agg(F.count("*").alias("n"))
    r = r.select(F.lit("r").alias("side"), "raw", "n", show("report"))
    return r.unionByName(a.select(F.lit("a").alias("side"), "raw", "n", show("alert")))


@query("e11_report_time", sql("SELECT report_idx, strftime(t, '%Y-%m-%d %H:%M:%S') AS report_time FROM rtime"))
def report_time(spark, sf):
    stamps = mention(spark, sf, ["timestamp"]).groupBy("report_idx").agg(F.collect_list("value").alias("timestamps"))
    timed = stamps.select("report_idx", F.date_format(T.report_time("timestamps"), "yyyy-MM-dd HH:mm:ss").alias("report_time"))
    return timed.where("report_time is not null")


@query("e12_day_key", sql("SELECT strftime(t, '%Y-%m-%d') AS day, count(*) AS n FROM rtime GROUP BY 1"))
def day_key(spark, sf):
    times = R.report_times(mention(spark, sf, ["timestamp"]))
    return times.groupBy(T.day_key("report_time").alias("day")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------- report graph


@query("g01_mentions", sql("SELECT report_idx, kind, count(*) AS n, max(pos) AS last_pos, " + sql_checksum("report_name", "pos", "value") + " FROM ment GROUP BY 1, 2"))
def mentions(spark, sf):
    """Entity lists per report, rebuilt from the rows, exploded to mentions again."""
    rows = mention(spark, sf)
    lists = [
        F.transform(
            F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("pos", "value")))), lambda s: s["value"]
        ).alias(f)
        for f, k in ENTITY_FIELDS.items()
    ]
    entities = rows.groupBy("report_idx", "report_name").agg(*lists)
    entities = entities.select("report_idx", "report_name", F.struct(*ENTITY_FIELDS).alias("entities"))
    found = R.mentions(entities)
    return found.groupBy("report_idx", "kind").agg(
        F.count("*").alias("n"), F.max("pos").alias("last_pos"), checksum("report_name", "pos", "value")
    )


@query("g02_report_nodes", sql("SELECT report_name AS key, max(report_idx) AS id FROM v_report GROUP BY 1"))
def report_nodes(spark, sf):
    return R.report_nodes(reports(spark, sf))


def _by_kind(writes):
    """Distinct edges by kind, with a checksum of the pairs."""
    return _counted(writes.select("src", "dst", edge_kind().alias("etype")).distinct())


def _counted(pairs):
    return pairs.groupBy("etype").agg(F.count("*").alias("n"), checksum("src", "dst"))


def _by_kind_sql(rel, where="true"):
    return sql(f"SELECT etype, count(*) AS n, {sql_checksum('src', 'dst')} FROM (SELECT DISTINCT src, dst, etype FROM {rel} WHERE {where}) GROUP BY 1")


def _kinds(name, kinds):
    types = ["report_describes_attack_stage" if k == "attack_stage" else f"report_contains_{k}" for k in kinds]

    @query(name, _by_kind_sql("name_writes", f"etype IN {tuple(types)}" if len(types) > 1 else f"etype = '{types[0]}'"))
    def run(spark, sf):
        return _by_kind(R.report_edges(mention(spark, sf, kinds), kinds))


_kinds("g03_report_edges", ["ip", "domain", "hash", "file"])
_kinds("g04_report_edges_process_port_user", ["process", "port", "user"])
_kinds("g05_report_edges_stage", ["attack_stage"])


@query("g06_report_time_edges", sql("SELECT DISTINCT src, dst, etype FROM time_writes"))
def report_time_edges(spark, sf):
    return R.report_time_edges(R.report_times(mention(spark, sf, ["timestamp"]))).select("src", "dst", edge_kind().alias("etype")).distinct()


@query("g07_stage_time_edges", sql("SELECT DISTINCT src, dst, etype FROM stage_time_writes"))
def stage_time_edges(spark, sf):
    ment = mention(spark, sf, ["attack_stage", "timestamp"])
    return R.stage_time_edges(ment, R.report_times(ment)).select("src", "dst", edge_kind().alias("etype")).distinct()


def _pairs(name, types):
    pairs = [p for p in PAIR_EDGES if p[2] in types]
    listed = ", ".join(f"'{t}'" for t in types)

    @query(name, _by_kind_sql("pair_writes", f"etype IN ({listed})"))
    def run(spark, sf):
        kinds = {k for p in pairs for k in p[:2]}
        return _counted(R.gathered_edges(mention(spark, sf, kinds), pairs, mode="multi"))


_pairs("g08_cooccur_ip", ["ip_appears_with_domain", "ip_appears_with_hash", "ip_appears_with_file"])
_pairs("g09_cooccur_domain_hash", ["domain_appears_with_hash", "domain_appears_with_file", "hash_appears_with_file"])
_pairs("g10_ip_uses_port", ["ip_uses_port"])
_pairs("g11_ip_communicates_with_ip", ["ip_communicates_with_ip"])
_pairs("g12_domain_resolves_to_ip", ["domain_resolves_to_ip"])
_pairs("g13_process_edges", ["process_accesses_file", "process_connects_to_ip", "process_uses_port"])
_pairs("g15_user_edges", ["user_owns_process", "user_accesses_file"])
_pairs(
    "g17_stage_involves",
    ["attack_stage_involves_ip", "attack_stage_involves_domain", "attack_stage_involves_file", "attack_stage_involves_process"],
)


def _chain(name, kind, edge):
    @query(name, sql(f"SELECT DISTINCT src, dst, etype FROM chain_writes WHERE etype = '{edge}'"))
    def run(spark, sf):
        ment = mention(spark, sf, [kind])
        writes = R.chain(ment, R.distinct_mentions(ment), kind, edge)
        return writes.select("src", "dst", edge_kind().alias("etype")).distinct()


_chain("g14_process_chain", "process", "process_creates_process")
_chain("g16_stage_chain", "attack_stage", "attack_stage_follows")


@query(
    "flagship_edges_by_type",
    sql(
        f"""SELECT etype, count(*) AS n FROM (
SELECT DISTINCT report_name, 'report_contains_ip' AS etype, unnest(regexp_extract_all(text, '{IP}')) AS v FROM v_doc_text
UNION SELECT report_name, 'report_contains_domain', d FROM doms WHERE {_KNOWN}
UNION SELECT report_name, 'report_contains_hash', unnest(regexp_extract_all(text, '{HASH}')) FROM v_doc_text
UNION SELECT report_name, 'report_contains_file', unnest(regexp_extract_all(text, '{FILE}')) FROM v_doc_text) GROUP BY 1
UNION ALL SELECT 'total', (SELECT count(*) FROM (
SELECT DISTINCT report_name, 'i', unnest(regexp_extract_all(text, '{IP}')) AS v FROM v_doc_text
UNION SELECT report_name, 'd', d FROM doms WHERE {_KNOWN}
UNION SELECT report_name, 'h', unnest(regexp_extract_all(text, '{HASH}')) FROM v_doc_text
UNION SELECT report_name, 'f', unnest(regexp_extract_all(text, '{FILE}')) FROM v_doc_text))""",
        doms=f"SELECT DISTINCT report_name, unnest(regexp_extract_all(text, '{DOMAIN}')) AS d FROM v_doc_text",
    ),
)
def flagship(spark, sf):
    """Raw text to indicators to report edges, counted by type."""
    from threatloom.sources.entities import fill_entities

    ment = R.mentions(fill_entities(T.extract_entities(doc_text(spark, sf), suffixes=suffix_rules(spark))))
    edges = R.report_edges(ment, ["ip", "domain", "hash", "file"]).select("src", "dst", edge_kind().alias("etype")).distinct()
    return edge_counts(edges)
