import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codequarry.functions.rules import segment_pattern
from codequarry.operators import catalogue, findings as O
from codequarry.php.facts import extract
from codequarry.php.lexer import PhpError, strip_comments, tokenize
from tests.test_operators import finding


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_readers_never_fail_on_text(text):
    assert isinstance(extract("x.php", "<?php " + text), list)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["$a = 1;", "// c", "/* x\ny */", "'/* s */';", "\n", "# h", '"a // b";', "f();"]), max_size=12))
def test_comments_go_lines_stay(parts):
    code = "<?php\n" + "\n".join(parts)
    try:
        kept = [t.text for t in tokenize(code)]
    except PhpError:
        return
    out = strip_comments(code)
    assert out.count("\n") == code.count("\n") and [t.text for t in tokenize(out)] == kept


@settings(max_examples=100, deadline=None)
@given(st.text("ab*?/", max_size=12))
def test_exclude_patterns_compile(glob):
    import re

    p = segment_pattern(glob)
    assert p is None or re.compile(p)


@pytest.mark.parametrize("seed", [1, 2])
def test_order_free_operators_ignore_row_order(spark, seed):
    rng = random.Random(seed)
    items = [{"type": rng.choice(["xss", "idor", "csrf"]), "line": rng.randrange(1, 9), "location": rng.choice(["a.php", "b.php"]), "severity": rng.choice(["low", "high"])} for _ in range(40)]
    f = finding(spark, items)
    g = f.repartition(7).sortWithinPartitions("line")
    rows = lambda df: sorted(map(str, df.collect()))
    for op in (lambda d: O.fingerprint(d, ("scan_id",)), lambda d: O.drop_exact(d), lambda d: O.drop_near(d), lambda d: O.scores(d), lambda d: O.merge(d.where("line > 4"), d.where("line <= 4"))):
        assert rows(op(f)) == rows(op(g))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), max_size=12))
def test_closure_matches_brute_force(spark, pairs):
    up = {}
    for a, b in pairs:
        if a != b:
            up.setdefault(a, set()).add(b)
    want = set()
    for a in up:
        seen, todo = set(), set(up[a])
        while todo:
            x = todo.pop()
            if x != a and x not in seen:
                seen.add(x)
                todo |= up.get(x, set())
        want |= {(a, x) for x in seen}
    got = catalogue.ancestors(spark.createDataFrame(pairs, "child long, parent long") if pairs else spark.createDataFrame([], "child long, parent long"))
    assert {(r.child, r.ancestor) for r in got.collect()} == want
