import json
import subprocess

import pytest
from pyspark.sql import functions as F

from codequarry.api import Engine
from codequarry.operators import findings as O
from codequarry.registry import DEFAULT_TYPE, EngineConfig
from codequarry.sinks import reports
from codequarry.sources import documents, files
from codequarry.streaming import incremental
from tests.test_detect import FILES
from tests.test_operators import finding


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for path, code in [*FILES, ("vendor/x/app/Models/V.php", "<?php"), ("app/Models/bin.php", "<?php \0"), ("app/Models/note.txt", "x"), (".env", "APP_ENV=local\nAPP_DEBUG=\"true\"\nKEY=x"), ("config/auth.php", "<?php return ['driver' => 'session'];")]:
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(code)
    return root


def test_scan_filters(spark, project):
    got = {r.path for r in files.scan(spark, str(project)).collect()}
    assert got == {"app/Models/Invoice.php", "app/Models/Account.php", "app/Http/Controllers/InvoiceController.php", "app/Http/Controllers/EditorController.php", "routes/web.php"}
    assert files.scan(spark, str(project), paths=["missing"]).count() == 0
    kinds = {r.path: r.type for r in files.classified(files.scan(spark, str(project))).collect()}
    assert kinds["app/Models/Invoice.php"] == "model" and kinds["routes/web.php"] == "route" and kinds["app/Http/Controllers/EditorController.php"] == "controller"
    assert {r.role for r in files.roles(files.scan(spark, str(project))).collect()} == {"models", "other", "routes"}


def test_targets(project):
    assert files.checked_target(str(project), "app/Models") == "app/Models"
    for bad in ("../x", "/etc", ".env", "keys/a.pem"):
        with pytest.raises(files.TargetError):
            files.checked_target(str(project), bad)


def test_settings(spark, project):
    env = spark.createDataFrame([(".env", (project / ".env").read_text())], "path string, content string")
    assert tuple(files.environment(env).first()) == (".env", "local", "true")
    cfg = spark.createDataFrame([("config/auth.php", (project / "config/auth.php").read_text())], "path string, content string")
    assert [(r.key, r["values"]) for r in files.config_facts(cfg).collect()] == [("guard_driver", ["session"])]


def test_engine_end_to_end(spark, project, tmp_path):
    engine = Engine(spark)
    found = engine.scan(str(project)).persist()
    report = engine.report(found, engine.coverage(files.scan(spark, str(project))))
    assert report["counts"]["total"] >= 4 and report["overall_score"] is not None and report["coverage"]["complete"]
    path = str(tmp_path / "baseline")
    reports.write_baseline(found, path)
    assert engine.scan(str(project), baseline=documents.baseline(spark, path)).count() == 0
    reports.save(reports.lines(found, "json", report), str(tmp_path / "report"))
    again = reports.read_json(spark, str(tmp_path / "report"))
    kept = ["type", "location", "line", "severity", "description", "proof", "class", "confidence", "fingerprint"]
    assert sorted(map(str, again.select(*kept).collect())) == sorted(map(str, found.select(*kept).collect()))
    whole = json.loads("".join(reports.text(reports.lines(found, "json", report))))
    assert whole["counts"] == report["counts"] and len(whole["vulnerabilities"]) == found.count()
    ranks = [reports._RANK[v["severity"]] for v in whole["vulnerabilities"]]
    assert ranks == sorted(ranks, reverse=True) and reports.headline(found).first().severity == whole["vulnerabilities"][0]["severity"]
    doc = json.loads("".join(reports.text(reports.sarif_lines(found, spark.createDataFrame([("b.php", "unreadable"), ("a.php", "other")], "path string, reason string")))))
    run = doc["runs"][0]
    rules = run["tool"]["driver"]["rules"]
    assert doc["version"] == "2.1.0" and len(run["results"]) == found.count() and all(rules[r["ruleIndex"]]["id"] == r["ruleId"] for r in run["results"])
    assert [n["message"]["text"].split(":")[0] for n in run["invocations"][0]["toolExecutionNotifications"]] == ["a.php", "b.php"]
    page, marked = "".join(reports.text(reports.lines(found, "html", report))), "\n".join(reports.text(reports.lines(found, "markdown", report)))
    assert page.count("<tr>") == found.count() + 1 and marked.startswith("# Security report") and marked.count("\n## ") == found.count()
    one = reports.save_history(found, str(tmp_path / "history"), report, scan_duration_ms=5)
    two = reports.save_history(found, str(tmp_path / "history"), report, scan_duration_ms=6)
    ids = [r.id for r in documents.history(spark, str(tmp_path / "history/scans")).orderBy("id").collect()]
    assert sorted(ids) == sorted([one, two]) and all(len(i) == 26 for i in ids)
    found.unpersist()


def test_diff(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@example.org", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    (tmp_path / "a.php").write_text("<?php")
    git("add", "."), git("commit", "-qm", "a"), git("checkout", "-qb", "work")
    (tmp_path / "b.php").write_text("<?php 1;")
    (tmp_path / "c.txt").write_text("x")
    git("add", "."), git("commit", "-qm", "b")
    assert files.changed_paths(str(tmp_path)) == ["b.php"]
    assert [r.path for r in files.scan_diff(spark, str(tmp_path)).collect()] == ["b.php"]
    with pytest.raises(files.TargetError):
        files.changed_paths(str(tmp_path), "nowhere")


def test_documents(spark, tmp_path):
    (tmp_path / "routes.json").write_text(json.dumps([{"verb": "GET", "uri": "/a", "action": "App\\C@show", "middleware": ["web"]}]))
    assert tuple(documents.routes(spark, str(tmp_path / "routes.json")).first()) == ("GET", "/a", "App\\C", "show", ["web"])
    (tmp_path / "bad.json").write_text(json.dumps([{"verb": "GET", "uri": "/a", "action": "nope"}]))
    with pytest.raises(Exception, match="Class@method"):
        documents.routes(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "truth.json").write_text(json.dumps({"samples": [{"file": "a.php", "expected": [{"type": " XSS ", "line": 4}]}, {"file": "b.php", "expected": []}, {"file": "c.php", "expected": [{"type": "idor", "line": 1, "engine": "deterministic", "accepted_types": ["auth_bypass"]}]}]}))
    got = {r.file: (r.type, r.engine, r.accepted_types, r.line_tolerance) for r in documents.ground_truth(spark, str(tmp_path / "truth.json")).collect()}
    assert got == {"a.php": ("xss", "ai", ["xss"], 3), "b.php": (None, None, None, 3), "c.php": ("idor", "deterministic", ["idor", "auth_bypass"], 3)}
    assert documents.ground_truth(spark, str(tmp_path / "truth.json"), "deterministic").where("type is not null").count() == 1
    assert documents.usage_log(spark, str(tmp_path / "none.json")).count() == 0
    raw = spark.createDataFrame([('{"input_tokens": 5, "output_tokens": 2}',), ('{"prompt_tokens": 7}',), ("x",)], "usage string")
    assert sorted((r.prompt_tokens, r.completion_tokens) for r in documents.usage_tokens(raw).collect()) == [(0, 0), (5, 2), (7, 0)]


def test_render(spark):
    row = spark.createDataFrame([("a```b", "a*b|c\nd", "<a & 'b'>", "a b/é~*.php")], "code string, md string, page string, path string")
    got = row.select(reports.md_fence(F.col("code")), reports.md_escape(F.col("md")), reports.html_escape(F.col("page")), reports.uri(F.col("path"))).first()
    assert tuple(got) == ("````\na```b\n````", "a\\*b\\|c d", "&lt;a &amp; &#x27;b&#x27;&gt;", "a%20b/%C3%A9~%2A.php")
    assert [reports.badge(s) for s in (80, 60, 40, 39)] == ["brightgreen", "yellow", "orange", "red"]
    first = reports.scan_id()
    __import__("time").sleep(0.002)
    assert first < reports.scan_id()


def test_suppressed(spark):
    none = spark.createDataFrame([], "type string, location string, line int, severity string, description string, proof string, fix string, class string, confidence string")
    report = reports.summary(none, {"complete": False})
    assert report["overall_score"] is None and report["score_suppression_reason"]
    assert "withheld" in "\n".join(reports.text(reports.lines(none, "markdown", report)))
    assert json.loads("".join(reports.text(reports.lines(none, "json", report))))["vulnerabilities"] == []
    assert json.loads("".join(reports.text(reports.lines(none, "sarif", report))))["runs"][0]["results"] == []
    equal = spark.createDataFrame([("xss", "a.php", 1, "high", "d", "p", "f", "vulnerability", "proven")] * 3, none.schema)
    assert len(json.loads("".join(reports.text(reports.lines(equal, "json", reports.summary(equal)))))["vulnerabilities"]) == 3


def test_any_json_layout_of_a_report_is_read(spark, tmp_path):
    import json

    report = {"overall_score": 3, "vulnerabilities": [{"type": "xss", "location": "a.php", "line": 4, "severity": "high", "description": "{\n", "confidence": "possible", "fix": "f"}, {"severity": "low"}]}
    for name, text in {"one": json.dumps(report), "indented": json.dumps(report, indent=2)}.items():
        (tmp_path / name).write_text(text)
        found = {(r.type, r.location, r.line, r["class"], r.fix) for r in reports.read_json(spark, str(tmp_path / name)).collect()}
        assert found == {("xss", "a.php", 4, "review", ""), (DEFAULT_TYPE, "", 1, "vulnerability", "")}
    (tmp_path / "none").write_text(json.dumps({"vulnerabilities": []}))
    assert reports.read_json(spark, str(tmp_path / "none")).collect() == []
    (tmp_path / "odd").write_text("<html>")
    with pytest.raises(Exception, match="not a saved report"):
        reports.read_json(spark, str(tmp_path / "odd")).collect()


def test_deleted_scans_are_gone(spark, tmp_path):
    path = str(tmp_path / "history")
    assert reports.delete_history(spark, path) == 0
    ids = [reports.save_history(finding(spark, [{"line": n}]), path, {"overall_score": n}) for n in range(3)]
    assert {r.id for r in documents.kept_scans(spark, path).collect()} == set(ids) == {r.id for r in documents.kept_findings(spark, path).collect()}
    assert reports.delete_history(spark, path, [ids[1], "unknown"]) == 1 and reports.delete_history(spark, path, [ids[1]]) == 0
    assert {r.id: r.overall_score for r in documents.kept_scans(spark, path).collect()} == {ids[0]: 0, ids[2]: 2}
    assert {(r.id, r.line) for r in documents.kept_findings(spark, path).collect()} == {(ids[0], 0), (ids[2], 2)}
    assert reports.delete_history(spark, path) == 2 and documents.kept_scans(spark, path).isEmpty()
    again = reports.save_history(finding(spark, [{}]), path, {"overall_score": 9})
    assert [r.id for r in documents.kept_scans(spark, path).collect()] == [again]


def test_rows_of_a_usage_log_that_cannot_be_read_are_kept_aside(spark, tmp_path):
    log, aside = tmp_path / "usage", tmp_path / "aside"
    log.mkdir()
    good = '{"timestamp": "2024-01-01T00:00:00Z", "prompt_tokens": 5, "provider": "p", "model": "m"}'
    (log / "a.json").write_text(good + "\n" + '{"prompt_tokens": "many", "x": }' + "\n" + good)
    (log / "b.json").write_text("[" + good + ", " + good + "]")
    (log / "c.json").write_text("[" + good + ", ")
    (log / "d.json").write_text(" \n")
    assert documents.usage_log(spark, str(log)).count() == 4
    assert reports.set_aside(spark, str(log), str(aside)) == 2 and reports.set_aside(spark, str(log), str(aside)) == 0
    kept = {r.file.rsplit("/", 1)[1]: r.value for r in documents.set_aside_rows(spark, str(aside)).collect()}
    assert kept == {"a.json": '{"prompt_tokens": "many", "x": }', "c.json": "[" + good + ", "}
