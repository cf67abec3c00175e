import datetime as dt
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threatloom.functions import text as T
from threatloom.functions.alerts import normalize_alerts
from threatloom.functions.domains import filter_domains


# Python's own word class in place of the spelled-out one.
as_python = lambda pattern: pattern.replace(r"\p{L}\p{N}_", r"\w")


def test_patterns_agree_with_python(spark):
    samples = [
        "C:\\Users\\Zoë\\tmp\\x.exe /opt/日本/bin/a /var/été/ñ_1/²/ж.log",
        "from 10.1.2.3 and 10.1.2.3, then 999.1.1.1; c2.evil.co.uk x.com",
        "C:\\Windows\\System32\\cmd.exe /usr/local/bin/x http://a.b/c/d",
        "d41d8cd98f00b204e9800998ecf8427e " + "a" * 64 + " " + "b" * 65,
        "2016-1-2 2016/01/02 1999-01-01 2020.12.31 2016-01-02 03:04:05 2016-01-02T03:04:05",
        "地址10.1.2.3",
        "",
    ]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, text string")
    for fn, pattern in [
        (T.extract_ips, T.IP_PATTERN),
        (T.extract_domains, T.DOMAIN_PATTERN),
        (T.extract_hashes, T.HASH_PATTERN),
        (T.extract_files, T.FILE_PATTERN),
        (T.extract_timestamps, T.TIME_PATTERN),
    ]:
        got = {r["i"]: r["v"] for r in df.select("i", fn("text").alias("v")).collect()}
        for i, s in enumerate(samples):
            assert got[i] == list(dict.fromkeys(re.findall(as_python(pattern), s)))


def test_alert_paths(spark):
    df = spark.createDataFrame([(" /etc/passwd a=/usr/bin/x 05/01/2024 ",)], "t string")
    assert df.select(T.extract_alert_files("t")).first()[0] == ["/etc/passwd", "/usr/bin/x"]
    assert df.select(T.extract_alert_files("t", "parity")).first()[0] == ["/passwd", "/bin/x", "/01/2024"]


def test_time_forms(spark):
    forms = {
        "2016-1-2": dt.datetime(2016, 1, 2),
        "2016/01/02": None,
        "2016-02-30": None,
        "2016-01-02 3:04:05": dt.datetime(2016, 1, 2, 3, 4, 5),
        "2016-01-02T03:04:05": None,
        "2016-01-02 25:00:00": None,
        "": None,
    }
    df = spark.createDataFrame([(k,) for k in forms], "t string").select("t", T.parse_ts("t").alias("p"))
    assert {r["t"]: r["p"] for r in df.collect()} == forms
    late = spark.createDataFrame([("2016-01-02T03:04:05.25Z",)], "t string")
    assert late.select(T.parse_ts("t", "alert")).first()[0] == dt.datetime(2016, 1, 2, 3, 4, 5, 250000)
    assert late.select(T.parse_ts("t")).first()[0] is None


def test_report_time_is_the_earliest_valid(spark):
    df = spark.createDataFrame([(["2020-05-01", "bad", "2019-01-01 10:00:00"],), (["bad"],), ([],)], "t array<string>")
    got = [r[0] for r in df.select(T.report_time("t")).collect()]
    assert got == [dt.datetime(2019, 1, 1, 10), None, None]


def test_stage_words(spark):
    words = {
        "Port SCAN of data": "Reconnaissance",
        "CVE admin": "Exploitation",
        "pivot": "Lateral_Movement",
        "New admin": "Privilege_Escalation",
        "database changed": "Data_Exfiltration",
        "nothing": None,
    }
    df = spark.createDataFrame([(k,) for k in words], "d string").select("d", T.classify_stage("d").alias("s"))
    assert {r["d"]: r["s"] for r in df.collect()} == words


def test_domain_suffixes(spark):
    rules = spark.createDataFrame([("com",), ("uk",), ("co.uk",), ("*.ck",), ("!www.ck",)], "suffix string")
    names = ["x.com", "x.co.uk", "x.unknowntld", "a.b.ck", "www.ck"]
    df = spark.createDataFrame([(n,) for n in names], "domain string")
    keep = lambda mode: sorted(r[0] for r in filter_domains(df, rules, mode=mode).collect())
    assert keep("intended") == ["a.b.ck", "www.ck", "x.co.uk", "x.com"]
    assert keep("parity") == ["a.b.ck", "x.co.uk"]


def test_alert_defaults(spark):
    schema = "alert_idx long, agent_name string, ts_raw string, rule_id string, description string, process_name string, process_executable string, destination_port string, source_port string, user_name string, user_id string"
    rows = [
        (7, None, "2024-01-05T01:02:03.000Z", None, "scan", " ", "/bin/sh", "0", "22", None, "u1"),
        (8, " h ", "05.01.2024", "55", None, "p", None, "80.0", None, "root", None),
    ]
    got = normalize_alerts(spark.createDataFrame(rows, schema)).orderBy("alert_idx").collect()
    a, b = got
    assert (a["host"], a["day"], a["rule"], a["process"], a["port"], a["user"], a["stage"]) == (
        "host_7", "2024-01-05", "rule_7", "/bin/sh", "port_22", "u1", "Reconnaissance",
    )
    assert (b["host"], b["day"], b["rule"], b["process"], b["port"], b["user"], b["stage"]) == ("h", None, "55", "p", "port_80", "root", None)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="0123456789. ab/\\-_:éж日", max_size=60), min_size=1, max_size=30))
def test_random_text(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", T.extract_ips("t").alias("ips"), T.extract_files("t").alias("files")).collect()
    for r in got:
        assert r["ips"] == list(dict.fromkeys(re.findall(T.IP_PATTERN, r["t"])))
        assert r["files"] == list(dict.fromkeys(re.findall(as_python(T.FILE_PATTERN), r["t"])))
