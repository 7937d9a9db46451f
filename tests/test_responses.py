import json
import random
import re

from codequarry.operators import responses

ITEM = {"type": "xss", "location": "a.php", "line": 3, "severity": "high", "description": 'says "{" and \\ ] }', "proof": "p"}
ONE = json.dumps({"vulnerabilities": [ITEM]})


def parsed(spark, text):
    return responses.parse(spark.createDataFrame([(1, text)], "chunk int, response string"))


CASES = {
    "a fence after prose with a brace": ("the { handler\n```\n" + ONE + "\n```", "ok", 1),
    "an object of another key, then the report": ('{"note": {"vulnerabilities": 1}} then ' + ONE + " end", "ok", 1),
    "a brace that never closes before the report": ('{"never closes, ' + ONE, "ok", 1),
    "quotes in prose": ("She said \"look: " + ONE + '" {', "ok", 1),
    "the key in a string only": ('{"a": "vulnerabilities: [{}]"} no', "failed", None),
    "a cut list of the key in an inner object": ('{"x": {"vulnerabilities": [' + json.dumps(ITEM) + ', {"a', "truncated", 1),
    "cut inside the second": (ONE[:-2] + ', {"type": "ss', "truncated", 1),
    "cut inside a string with an escaped quote": (ONE[:-2] + ', {"type": "a\\"}', "truncated", 1),
    "cut before the first is whole": ('{"vulnerabilities": [{"type": "xss", "loc', "failed", None),
    "a trailing comma": (ONE[:-2] + ",]}", "ok", 1),
    "closed, malformed, nothing whole": ('{"vulnerabilities": [{"a": }]}', "ok", 0),
    "the key holds a number": ('{"vulnerabilities": 3}', "failed", None),
    "the key holds null": ('{"vulnerabilities": null}', "failed", None),
    "the key holds an object": ('{"vulnerabilities": {"0": ' + json.dumps(ITEM) + "}}", "ok", 1),
    "an empty list": ("[]", "failed", None),
    "a whole report of nothing": ('{"vulnerabilities": []}', "ok", 0),
    "no response": (None, "failed", None),
    "blank": (" \n", "failed", None),
    "a number": ("12", "failed", None),
    "a later key of the same name": ('{"vulnerabilities_": [], "b": [1], "vulnerabilities": [' + json.dumps(ITEM) + ", {", "truncated", 1),
}


def test_states(spark):
    rows = responses.parse(spark.createDataFrame([(name, text) for name, (text, *_) in CASES.items()], "chunk string, response string")).collect()
    got = {r.chunk: (r.state, r.elements if r.elements is None else len(r.elements)) for r in rows}
    assert got == {name: (state, n) for name, (_, state, n) in CASES.items()}
    assert all(json.loads(r.elements[0]) == ITEM for r in rows if r.elements)


def test_many_escapes_and_braces_in_one_string(spark):
    item = ITEM | {"proof": '\\"{[' * 5000 + "𝄞é"}
    text = "prose { " + json.dumps({"vulnerabilities": [item]}, ensure_ascii=False)
    row = parsed(spark, text).first()
    assert row.state == "ok" and json.loads(row.elements[0]) == item
    cut = parsed(spark, text[:-2] + ', {"').first()
    assert cut.state == "truncated" and json.loads(cut.elements[0]) == item


def test_fields_of_findings(spark):
    items = [ITEM, ITEM | {"line": "L42-45", "severity": 3}, ITEM | {"line": 0, "description": 7, "taint_trace": " "}, ITEM | {"line": 1e3, "description": ["x"]}, ITEM | {"type": 5}, ITEM | {"location": ["a"]}, [ITEM], "x", None]
    rows = responses.to_findings(parsed(spark, json.dumps({"vulnerabilities": items})))
    assert sorted((r.ordinal, r.line, r.severity, r.description) for r in rows[0].collect()) == [(0, 3, "high", ITEM["description"]), (1, 42, "low", ITEM["description"]), (2, 1, "high", "7"), (3, 1000, "high", "Cross-Site Scripting (XSS)")]
    assert sorted((r.ordinal, r.reason) for r in rows[1].collect()) == [(4, "unknown type"), (5, "no location"), (6, "unknown type"), (7, "not an object"), (8, "not an object")]


def test_locations_against_files(spark):
    files = spark.createDataFrame([("app/A.php", 5), ("app/x/B.php", 9), ("lib/x/B.php", 9)], "path string, lines int")
    items = [ITEM | {"location": x, "line": 8} for x in ("./app/A.php", "A.php", "/srv/app/A.php", "B.php", "x/C.php")]
    kept, gone = responses.to_findings(parsed(spark, json.dumps({"vulnerabilities": items})), files=files)
    assert sorted((r.ordinal, r.location, r.line) for r in kept.collect()) == [(0, "app/A.php", 5), (1, "app/A.php", 5), (2, "app/A.php", 5)]
    assert sorted((r.ordinal, r.reason) for r in gone.collect()) == [(3, "no such file"), (4, "no such file")]


def test_heads(spark):
    texts = [ONE[:-2] + ', {"', json.dumps({"vulnerabilities": [ITEM], "overall_score": 120, "summary": "fine", "ctf_idea": 4}), "nothing"]
    p = responses.parse(spark.createDataFrame(list(enumerate(texts)), "chunk int, response string"))
    heads = {r.chunk: (r.state, r.score, r.summary.split(";")[0], r.ctf_idea) for r in responses.report_heads(p, responses.to_findings(p)[0]).collect()}
    assert heads == {0: ("truncated", 80, "The response was cut off", ""), 1: ("ok", 100, "fine", "")}


# --- a plain reader of one text, character by character ---------------------------


def loads(text):
    """The value of a JSON text, or None; repeated keys are none."""

    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError
        return dict(pairs)

    try:
        return json.loads(text, object_pairs_hook=once, parse_constant=lambda _: 1 / 0)
    except (ValueError, ZeroDivisionError):
        return None


def object_starts(text):
    return [m.start() for m in re.finditer(r'\{(?=[ \n\r\t]*["}])', text)]


def walk(text, start):
    """(closing place of the first brace or None, whether a list under the key was found, whether all brackets closed, its whole elements)."""
    braces = depth = 0
    end = last = begun = None
    quoted = awaits = open_ = found = closed = False
    items, i = [], start
    while i < len(text):
        c = text[i]
        if quoted:
            if c == "\\":
                i += 1
            elif c == '"':
                quoted = False
                if depth == 1:
                    last = text[opened + 1 : i]
        elif c == '"':
            quoted, opened, awaits = True, i, False
        else:
            braces += (c == "{") - (c == "}")
            if c == "}" and braces == 0 and end is None:
                end = i
            if not closed and c not in " \n\r\t":
                opens, awaits = awaits and c == "[", c == ":" and depth == 1 and last == "vulnerabilities"
                depth += (c in "{[") - (c in "}]")
                if opens and depth == 2:
                    open_ = found = True
                elif c == "{" and open_ and depth == 3:
                    begun = i
                elif c == "}" and open_ and depth == 2 and begun is not None:
                    items.append(text[begun : i + 1])
                    begun = None
                elif c == "]" and open_ and depth == 1:
                    open_ = False
                closed = c in "}]" and depth == 0
        i += 1
    return end, found, closed, [x for x in items if loads(x) is not None]


def read(text):
    """(state, elements) of one response."""
    text = text.strip(" \n\r\t\v\0")
    fence = re.search(r"```(?:json)?[ \t\n\r\f\v]*\n?(.*?)\n?[ \t\n\r\f\v]*```", text, re.S)
    tries = [loads(text), loads(fence[1].strip(" \n\r\t\v\0")) if fence else None]
    value = next((x for x in tries if isinstance(x, list) or (isinstance(x, dict) and "vulnerabilities" in x)), None)
    if value is None:
        reach = 0
        for start in object_starts(text):
            end = walk(text, start)[0] if start >= reach else None
            got = loads(text[start : end + 1]) if end is not None else None
            if got is not None:
                reach = end + 1
                if "vulnerabilities" in got:
                    value = got
                    break
    if value is None:
        if not any(isinstance(x, dict) for x in tries):
            for start in object_starts(text):
                _, found, closed, items = walk(text, start)
                if found:
                    return ("ok" if closed else "truncated", items) if closed or items else ("failed", None)
        return "failed", None
    held = value if isinstance(value, list) and value else value["vulnerabilities"] if isinstance(value, dict) else None
    held = list(held.values()) if isinstance(held, dict) else held
    return ("ok", [json.dumps(x) for x in held]) if isinstance(held, list) else ("failed", None)


def test_random_texts_against_the_plain_reader(spark):
    rng = random.Random(9)
    pieces = ["{", "}", "[", "]", '"', "\\", ":", ",", " ", "\n", "x", "1", "é", '"a"', '"vulnerabilities"', '"vulnerabilities": [', '{"vulnerabilities": [', '{"type": "xss"}', '{"b": {}}', "]}", "```json\n", "\n```", ONE, ONE[:40]]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(1500)]
    rows = responses.parse(spark.createDataFrame(list(enumerate(texts)), "chunk int, response string")).collect()
    values = lambda found: found if found is None else [json.loads(x) for x in found]
    wrong = [(texts[r.chunk], r.state, r.elements, read(texts[r.chunk])) for r in rows if (r.state, values(r.elements)) != ((w := read(texts[r.chunk]))[0], values(w[1]))]
    assert not wrong, wrong[:3]
    assert {r.state for r in rows} == {"ok", "truncated", "failed"}
