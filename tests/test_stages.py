import numpy as np

from threatloom.plans.stages import STAGES, run_stages
from threatloom.sources.tables import load_graph


def test_all_stages_and_resume(spark, tmp_path):
    texts, csv = tmp_path / "texts", tmp_path / "alerts.csv"
    texts.mkdir()
    for i in range(1, 12):
        (texts / f"r{i}.txt").write_text(f"On 2024-01-{i:02d} host 10.0.0.{i % 3} served bad{i}.example.com from /srv/www/f{i % 2}")
    lines = ["agent.name,@timestamp,rule.id,rule.description,process.name,destination.port,user.name,full_log"]
    lines += [f"h{i % 2},2024-01-{i:02d}T00:00:00.000Z,5,port scan,sshd,22,root,from 10.0.0.{i % 4} /srv/www/f1" for i in range(1, 12)]
    csv.write_text("\n".join(lines) + "\n")
    base = str(tmp_path / "run")
    options = {"extract": {"reports": str(texts)}, "alert_graph": {"alerts": str(csv), "gate": "first_seen"}, "merge": {"pairs": True}}
    first = {(r["part"], r["kind"]): r["n"] for r in run_stages(spark, base, STAGES, options).collect()}
    assert first["nodes", "report"] == first["nodes", "alert"] == first["nodes", "timestamp"] == 11
    assert first["edges", "report_related_to_alert_by_time"] == 11
    assert first["edges", "report_related_to_rule"] > 0
    assert sum(p == "snapshot" for p, _ in first) == 5
    reports, partners = (spark.read.parquet(f"{base}/links_{side}") for side in ("reports", "partners"))
    met = reports.join(partners, ["place", "at"]).select("src", "dst").distinct().count()
    linked = sum(n for (part, kind), n in first.items() if part == "edges" and kind.startswith("report_related_to"))
    assert met == linked > 11
    again = {(r["part"], r["kind"]): r["n"] for r in run_stages(spark, base, ()).collect()}
    assert again == first

    # a small random model for the types and relations that the snapshots have
    g = load_graph(spark, f"{base}/snapshots")
    types = sorted(r[0] for r in g.nodes.select("ntype").distinct().collect())
    kinds = sorted(tuple(r) for r in spark.read.parquet(f"{base}/typed_edges").select("src_type", "etype", "dst_type").distinct().collect())
    draw, table = np.random.default_rng(4), {}
    put = lambda name, *shape: table.__setitem__(name, draw.normal(0, 0.4, shape))
    for n in types:
        put(f"input/{n}/W", 3, 5), put(f"input/{n}/b", 3)
        for w, shape in (("proj_W", (3, 3)), ("proj_b", (3,)), ("q", (3, 3)), ("k", (3, 3)), ("v", (3, 3)), ("fc_W", (3, 3)), ("fc_b", (3,))):
            put(f"layers/0/time/{n}/{w}", *shape)
        put(f"layers/0/residual/{n}/a"), put(f"layers/0/residual/{n}/W", 3, 3), put(f"layers/0/residual/{n}/b", 3)
    for k in kinds:
        for w, shape in (("W", (3, 3)), ("al", (3,)), ("ar", (3,)), ("b", (3,))):
            put(f"layers/0/attend/{'|'.join(k)}/{w}", *shape)
    for t in range(5):
        put(f"layers/0/relation/{t}/W", 3, 3), put(f"layers/0/relation/{t}/b", 3), put(f"layers/0/relation/{t}/q", 3)
    put("head/W1", 4, 6), put("head/b1", 4), put("head/W2", 1, 4), put("head/b2", 1)
    rows = [(name, list(map(int, v.shape)), v.ravel().tolist()) for name, v in table.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").write.parquet(f"{base}/weights")
    run_stages(spark, base, ["scores"], {"scores": {"weights": f"{base}/weights"}})
    found = spark.read.json(f"{base}/metrics").collect()
    assert {r["metric"] for r in found} == {"auc", "ap", "accuracy"} and {r["task"] for r in found} == {"link"}
    sampled = {r[0] for r in spark.read.parquet(f"{base}/edge_samples").select("etype").distinct().collect()}
    assert {r["type"] for r in found} == sampled
    assert all(0 <= r["value"] <= 1 for r in found if r["value"] is not None)
