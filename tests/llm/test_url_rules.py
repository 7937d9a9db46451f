"""Rules of one expression, of a table, and one by one."""

import random

import pytest

from codequarry.llm import url_filter as W

RULE = "verdict string, host string, path string"


def one_by_one(host, path, rules):
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = min(fits, key=lambda r: (-len(r[1] + r[2]), r), default=None)
    return best and (best[0], best[1] + best[2])


def made(seed, n_rules, n_places):
    rng = random.Random(seed)
    label = lambda: rng.choice(["a", "b", "com", "x1", ""])
    host = lambda: ".".join(label() for _ in range(rng.randrange(1, 4)))
    path = lambda: "".join(rng.choice(["/", "a", "bb", "é"]) for _ in range(rng.randrange(4)))
    return [(rng.choice(["allow", "block"]), host(), path()) for _ in range(n_rules)], [(i, host(), path()) for i in range(n_places)]


@pytest.mark.parametrize("seed, n_rules", [(1, 0), (2, 1), (3, 40), (4, 300)])
def test_expression_and_table_agree(spark, seed, n_rules):
    rules, places = made(seed, n_rules, 400)
    df = spark.createDataFrame(places, "page_id long, host string, path string")
    table = spark.createDataFrame(rules + rules[:5] + [(None, "a", ""), ("block", None, ""), ("block", "a", None)], RULE)
    want = {i: one_by_one(h, p, rules) for i, h, p in places}
    for given in (rules, table):
        got = W.with_hits(df, given).collect()
        assert len(got) == len(places)
        assert {r.page_id: r.hit and (r.hit.verdict, r.hit.rule) for r in got} == want


def test_ten_thousand_rules(spark):
    rules = [("block" if i % 3 else "allow", f"h{i % 2500}.org", f"/p{i // 2500}") for i in range(10_000)] + [("block", "org", "/p1/x")]
    pages = [(i, f"http://WWW.h{i * 7 % 3000}.org/p{i % 5}/x?q", None) for i in range(600)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.rule for r in W.url_filter(df, rules=rules).collect()}
    assert got == {i: (one_by_one(f"www.h{i * 7 % 3000}.org", f"/p{i % 5}/x", rules) or (None, None))[1] for i, *_ in pages}


def test_hot_host(spark):
    """One host with most pages and most rules: prefixes are as many as lengths, not as rules."""
    rules = [("block", "hot.org", f"/{i:05d}") for i in range(3000)]
    df = spark.range(4000).selectExpr("id AS page_id", "'hot.org' AS host", "concat('/', lpad(cast(id AS string), 5, '0')) AS path")
    assert W.with_hits(df, rules).where("hit is not null").count() == 3000
