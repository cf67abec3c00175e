import hashlib
import json

import pytest

from threatloom.operators.graph import Graph
from threatloom.sources import alerts, entities, reports, tables


def test_entities_round_trip(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text('{"report_name": "b", "entities": {"ips": ["1.1.1.1"]}}\n{"report_name": "a"}\n')
    rows = entities.read_entities(spark, str(path))
    got = {r["report_name"]: (r["report_idx"], r["entities"].asDict()) for r in rows.collect()}
    assert got["a"][0] == 0 and got["b"][0] == 1
    assert got["a"][1]["users"] == [] and got["b"][1]["ips"] == ["1.1.1.1"] and got["b"][1]["attack_stages"] == []
    entities.write_entities(rows, str(tmp_path / "out"))
    again = entities.read_entities(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))


def test_malformed_entity_lines(spark, tmp_path):
    path = tmp_path / "bad.jsonl"
    path.write_text('{"report_name": "b"}\nnot json\n{"entities": {}}\n\n')
    assert [r["report_name"] for r in entities.read_entities(spark, str(path), on_bad="drop").collect()] == ["b"]
    assert sorted(r["line"] for r in entities.entity_rejects(spark, str(path)).collect()) == ["not json", '{"entities": {}}']
    with pytest.raises(Exception):
        entities.read_entities(spark, str(path)).collect()


def test_surplus_fields_and_file_order(spark, tmp_path):
    (tmp_path / "b.csv").write_text("host,rule,port\nz,1,1\na,2,2\n")
    (tmp_path / "a.csv").write_text('host,rule,port\nh1,5,80\nh2,6,80,\nh3,7,80,,\n"h,4",8\n"h,5",9,"1,2",\n"h,6",9,"1,2"\n')
    rows = alerts.read_alerts(spark, str(tmp_path)).orderBy("alert_idx").collect()
    assert [(r["alert_idx"], r["host"], r["port"]) for r in rows] == [(0, "h1", "80"), (1, "h,4", None), (2, "h,6", "1,2"), (3, "z", "1"), (4, "a", "2")]
    (tmp_path / "c.csv").write_text("rule,host,port\n1,h,2\n")
    with pytest.raises(Exception):
        alerts.read_alerts(spark, str(tmp_path)).collect()


def test_corpus_check_on_real_files(spark, tmp_path):
    (tmp_path / "2016").mkdir()
    for name, data in (("one.pdf", b"1"), ("two.pdf", b"2"), ("odd name.txt", b"3")):
        (tmp_path / "2016" / name).write_bytes(data)
    files = reports.read_files(spark, str(tmp_path))
    entry = lambda name, data: ("2016", name, hashlib.sha1(data).hexdigest())
    listed = [entry("one.pdf", b"1"), entry("two.pdf", b"x"), entry("odd name.txt", b"3"), entry("absent", b"4")]
    manifest = spark.createDataFrame(listed, "Year string, Filename string, `SHA-1` string")
    got = {r["path"]: r["ok"] for r in reports.verify_corpus(files, manifest).collect()}
    assert got == {"2016/one.pdf": True, "2016/two.pdf": False, "2016/odd name.txt": True}
    assert [r["Filename"] for r in reports.pending_reports(manifest, files).collect()] == ["absent"]


def test_malformed_alert_rows(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('@timestamp,agent.name,full_log\n2024-01-02,h,ok\n2024-01-01,h,too,many\n2024-01-03,short\n2024-01-04,h,"two\nlines ""q"""\n')
    rows = alerts.read_alerts(spark, str(path), multi_line=True).orderBy("alert_idx").collect()
    assert [(r["alert_idx"], r["ts_raw"], r["agent_name"], r["full_log"]) for r in rows] == [
        (0, "2024-01-02", "h", "ok"),
        (1, "2024-01-03", "short", None),
        (2, "2024-01-04", "h", 'two\nlines "q"'),
    ]


def test_report_files(spark, tmp_path):
    (tmp_path / "d" / "2020").mkdir(parents=True)
    (tmp_path / "d" / "a.txt").write_text("hello\nthere")
    (tmp_path / "d" / "2020" / "b.txt").write_text(" \n\t")
    (tmp_path / "d" / "2020" / "c.pdf").write_text("not a text file")
    (tmp_path / "d" / "2020" / "e.TXT").write_bytes(b"bad \xff\xfe bytes")
    got = reports.read_report_text(spark, str(tmp_path / "d")).collect()
    assert sorted((r["report_name"], r["text"]) for r in got) == [("a.txt", "hello\nthere"), ("e.TXT", "bad  bytes")]
    (tmp_path / "d" / "2020" / "c.pdf").unlink()
    (tmp_path / "d" / "2020" / "e.TXT").unlink()
    (tmp_path / "d" / "x").write_bytes(b"%PDF-1.4 ...")
    (tmp_path / "d" / "y.pdf").write_bytes(b"%PDF-1.4 ...")
    (tmp_path / "d" / "z").write_bytes(b"PK\x03\x04....xl/workbook.xml")
    (tmp_path / "d" / "w").write_bytes(b"PK\x03\x04....word/")
    files = reports.read_files(spark, str(tmp_path / "d"))
    got = {r["path"]: r["new_path"] for r in reports.detect_filetype(files).where("length(path) = 1 or path like '%.pdf'").collect()}
    assert got == {"x": "x.pdf", "y.pdf": "y.pdf", "z": "z.xlsx", "w": "w"}


def test_manifest_and_pending(spark, tmp_path):
    path = tmp_path / "m.json"
    entry = lambda i, name: {"Date": "d", "Title": f"t{i}", "Year": "2016", "Source": "s", "Link": "l", "Filename": name, "SHA-1": "0"}
    path.write_text(json.dumps([entry(0, "one"), entry(1, "two.v2"), entry(2, "three")], indent=1))
    manifest = reports.read_manifest(spark, str(path))
    assert [r["Title"] for r in manifest.collect()] == ["t2", "t1", "t0"]
    files = spark.createDataFrame([("2016/one.tar.gz",), ("2016/two.v2",), ("2016/threefold.pdf",), ("2015/three",)], "path string")
    assert [r["Filename"] for r in reports.pending_reports(manifest, files).collect()] == ["three"]


def test_graph_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(0, "a", "ip"), (3, "a", "ip")], "snapshot_id int, key string, ntype string")
    edges = spark.createDataFrame([(0, "a", "a", "x")], "snapshot_id int, src string, dst string, etype string")
    tables.save_graph(Graph(nodes, edges), str(tmp_path / "g"))
    back = tables.load_graph(spark, str(tmp_path / "g"))
    assert tables.snapshot_count(back).first()[0] == 2
    assert [tuple(r) for r in back.edges.select(*edges.columns).collect()] == [(0, "a", "a", "x")]
