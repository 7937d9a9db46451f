from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from codequarry.llm import url_filter as W
from tests.llm.test_chat_filter_score import brute_leaks

SF = "/root/testdata/sf0.001"


def test_operators_and_the_pipeline():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    assert sorted(str(tuple(r)) for r in df.select(*cols).collect()) == sorted(map(str, rel.select(", ".join(cols)).fetchall()))


def test_leaks_are_documents_with_whole_items(spark):
    rows = entry.queries()["op7_decontaminate"](spark, SF).collect()
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    whole = {d for d, t in texts.items() if any(x in t for x in items.values())}
    assert whole <= {r.doc_id for r in rows} and all(r.contaminated and r.best_coverage >= 0.5 and r["items"] for r in rows)


def test_leaks_match_brute_force_over_all_documents_and_items(spark):
    rows = {r.doc_id: (r.best_coverage, set(r["items"])) for r in entry.queries()["op7_decontaminate"](spark, SF).collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {i: (round(best, 6), found) for (i, _), (best, found) in zip(docs, brute_leaks(docs, items)) if found}
    assert rows == want


def test_links_and_names_change_verdicts_of_the_registered_query(spark):
    """Verdicts of pages without a rule are not just the votes of their host's own ruled pages."""
    sf = "/root/testdata/sf0.01"
    pages = entry.queries()["op10_url_filter"](spark, sf).collect()
    votes, own = Counter(), Counter(r.host for r in pages if r.host)
    for r in pages:
        if r.rule:
            votes[r.host, r.verdict] += 1
    total = {v: sum(n for (_, w), n in votes.items() if w == v) for v in ("allow", "block")}
    alone = lambda h: votes[h, "block"] / total["block"] >= max(2 * votes[h, "allow"] / total["allow"], W.LEAST * own[h] / sum(own.values()))
    assert any((r.verdict == "block") != alone(r.host) for r in pages if not r.rule and r.host)
