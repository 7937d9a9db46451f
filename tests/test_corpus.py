"""A corpus and its manifests: what is read, in which order, and what is kept as a reject."""

import json

import pytest

from codequarry.operators import catalogue
from codequarry.sources import corpus
from codequarry.sources.files import TargetError


def texts(spark, *values):
    return spark.createDataFrame([(f"m{i}", v) for i, v in enumerate(values)], "file string, value string")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for path, content in {
        "b/Orders.php": "<?php\nnamespace App;\nclass Orders extends Controller {}",
        "B.php": "<?php\nclass B extends Model {}",
        "a.php": "<?php\n// once: class A extends Controller\nclass Helper {}",
        "routes/web.php": "<?php\nclass X extends Controller {}",
        "notes.txt": "class N extends Controller {}",
        "vendor/V.php": "<?php class V extends FormRequest {}",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(content)
    return root


@pytest.mark.parametrize("patterns", [False, True])
def test_files_of_a_folder(spark, folder, patterns):
    got = [(r.path, r.type) for r in corpus.corpus(spark, str(folder), patterns).collect()]
    # A comment is no declaration; patterns cannot tell.
    assert got == [("B.php", "model"), ("a.php", "controller" if patterns else "other"), ("b/Orders.php", "controller"), ("routes/web.php", "route"), ("vendor/V.php", "request")]


def test_a_folder_that_is_not_there(spark, tmp_path):
    with pytest.raises(TargetError):
        corpus.corpus(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("wrap", [lambda rows: json.dumps({"routes": rows}), lambda rows: json.dumps(rows, indent=2), lambda rows: "\n".join(map(json.dumps, rows))])
def test_bad_rows_of_a_manifest_are_kept(spark, wrap):
    rows = [
        {"verb": "get", "uri": "/a", "action": "\\App\\C@show", "middleware": ["web", "auth"]}, {"action": "App\\C@show@x"}, {"uri": "/b"}, {"action": "show"}, {"action": "@show"}, {"action": "C@"}, "C@show", None, 5, ["C@show"],
        {"action": " C@show ", "middleware": "web", "uri": None}, {"action": None},
    ]
    found, gone = corpus.manifest(texts(spark, wrap(rows)))
    assert [tuple(r)[1:] for r in found.orderBy("ordinal").collect()] == [(0, "GET", "a", "App\\C", "show", ["web", "auth"]), (1, "GET", "", "App\\C@show", "x", []), (10, "GET", "", "C", "show", [])]
    want = {2: "no action", 3: "not Class@method", 4: "not Class@method", 5: "not Class@method", 6: "not an object", 7: "not an object", 8: "not an object", 9: "not an object", 11: "no action"}
    assert {r.ordinal: r.reason for r in gone.collect()} == want


def test_manifests_that_are_none(spark):
    found, gone = corpus.manifest(texts(spark, "", None, "[]", '{"routes": []}', '{"routes": 5}', "{cut", '{"action": "A@b"}\n{"action": "A@c"'))
    assert [(r.file, r.method) for r in found.collect()] == [("m6", "b")]
    assert sorted((r.file, r.ordinal, r.reason) for r in gone.collect()) == [("m4", 0, "no action"), ("m5", 0, "not an object"), ("m6", 1, "not an object")]


def test_labels(spark):
    files = spark.createDataFrame([("a.php",), ("b.php",), ("clean.php",), ("new.php",)], "path string")
    doc = {"samples": [
        {"file": "a.php", "expected": [{"type": " XSS ", "line": 4, "accepted_types": ["Sqli", "xss", None]}, {"line": 1}, {"type": "idor", "line": "9", "engine": "Rules"}, "x"]},
        {"file": "clean.php", "expected": []}, {"file": "b.php"}, {"file": "gone.php", "expected": [{"type": "xss", "line": 1}]}, {"expected": [{"type": "xss"}]}, 7,
    ]}
    found, gone = corpus.labels(texts(spark, json.dumps(doc)), files)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([
        ("a.php", "xss", 4, "ai", ["xss", "sqli"]), ("a.php", "idor", 9, "rules", ["idor"]), ("b.php", None, None, None, None), ("clean.php", None, None, None, None),
    ], key=str)
    assert sorted(((r.ordinal, r.item, r.reason) for r in gone.collect()), key=str) == sorted([(0, 1, "no type"), (0, 3, "label is not an object"), (3, None, "no such file"), (4, None, "no file"), (5, None, "not an object")], key=str)
    assert [r.path for r in corpus.unlabelled(files, found).collect()] == ["new.php"]
    assert corpus.labels(texts(spark, json.dumps(doc)))[0].where("file = 'gone.php'").count() == 1


def test_actions_that_no_manifest_names(spark, folder, tmp_path):
    (tmp_path / "routes.json").write_text(json.dumps({"routes": [{"action": "App\\Orders@show"}, {"action": "nothing"}]}))
    found, gone = corpus.manifest(corpus.raw_documents(spark, str(tmp_path)))
    actions = spark.createDataFrame([("App\\Orders", "show"), ("App\\Orders", "edit")], "class string, method string")
    routes = found.selectExpr("concat(class, '@', method) AS action")
    assert [r.method for r in catalogue.unrouted(actions, routes).collect()] == ["edit"]
    assert gone.first().value == '{"action":"nothing"}'
