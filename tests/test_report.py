import glob
import gzip
import json

from verification.queries import QUERIES


def test_fleet_report_documents(spark, sf):
    docs = [json.loads(r.document) for r in QUERIES["fleet_report"](spark, sf).collect()]
    assert docs
    servers = [s for d in docs for s in d.get("servers", [])]
    assert servers and all("version" in s and "monitored_at" in s for s in servers)
    stats = [q for s in servers for q in s.get("queries", {}).get("stats", [])]
    assert stats and not any(v in (0, "", None) for q in stats for v in q.values())
    clients = [c for s in servers for c in s.get("replicas", [])]
    assert clients and not {"client_addr", "client_hostname", "client_port"} & set().union(*clients)
    tables = [t for s in servers for d in s.get("databases", []) for c in d["schemas"] for t in c.get("tables", [])]
    assert tables and all("name" in t for t in tables)
    assert any(d["collector"].get("errors") for d in docs) and any(d.get("log_metrics") for d in docs)


def test_reports_are_gzip_json_lines(spark, sf, tmp_path):
    from fleetlens.sources.tables import write_report_json
    from verification.queries import _small_documents

    write_report_json(_small_documents(spark, sf), str(tmp_path / "out"))
    lines = [x for f in glob.glob(str(tmp_path / "out" / "*.gz")) for x in gzip.open(f, "rt")]
    assert lines and all({"reported_at", "collector"} <= set(json.loads(x)) for x in lines)
