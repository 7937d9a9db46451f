"""A phrase that many documents and items share: what it makes of pairs, and that no hit is lost."""

import random

import pytest

from codequarry.llm.decontaminate import candidates, deciding, decontaminate
from tests.llm.test_chat_filter_score import brute_leaks


def test_what_decides_covers_the_rest():
    # Seeds of 2 words in an item of 8: the frequent ones may cover 3 words of 4 wanted, so 0 and 1.
    seeds = [(9, 100, [0]), (8, 101, [1]), (3, 102, [2]), (1, 106, [6])]
    assert deciding(8, 2, seeds, 0.5) == [102, 106]
    assert deciding(8, 2, seeds[:2], 0.5) == []
    assert deciding(8, 2, [(5, 1, [0, 4])], 0.5) == [1]
    assert deciding(1, 1, [(7, 3, [0])], 0.5) == [3]
    assert deciding(4, 2, [], 0.5) == [] and deciding(4, 2, [(1, 5, [0])], 0.0) == [5]


@pytest.mark.parametrize("seed", range(3))
def test_what_does_not_decide_never_suffices(seed):
    rng = random.Random(seed)
    for _ in range(300):
        n, size = rng.randrange(3, 30), rng.randrange(1, 4)
        of = {}
        for q in range(n - size + 1):
            of.setdefault(rng.randrange(n), []).append(q)
        share = rng.random()
        rest = set(of) - set(deciding(n, size, [(rng.randrange(5), g, qs) for g, qs in of.items()], share))
        assert not rest or len({w for g in rest for q in of[g] for w in range(q, q + size)}) / n < share


def test_a_shared_phrase_makes_no_pairs(spark):
    phrase = "as shown in the following example"
    docs = [(i, " ".join([f"d{i}w{j}" for j in range(20)]) + " " + phrase) for i in range(400)]
    items = [(i, phrase + " " + " ".join(f"i{i}w{j}" for j in range(12))) for i in range(300)]
    docs += [(1000, items[7][1]), (1001, "x " + items[7][1].replace("i7w5", "y")), (None, items[8][1])]
    found = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).where("contaminated").collect()
    assert sorted((str(r.doc_id), [h.item_id for h in r.hits]) for r in found) == [("1000", [7]), ("1001", [7]), ("None", [8])]
    seeds = spark.createDataFrame([(d, 0, g) for d in range(400) for g in (1, 2)], "d long, h long, g long")
    sought = spark.createDataFrame([(i, 18, g, [g - 1]) for i in range(300) for g in (1, 2)], "name long, n long, g long, qs array<long>")
    assert candidates(seeds, sought, 5, 0.5).count() == 0


@pytest.mark.parametrize("coverage", [0.3, 0.5, 1.0])
def test_brute_force_where_words_are_few(spark, coverage):
    rng = random.Random(7)
    words = lambda n: " ".join(rng.choice("abcde") for _ in range(n))
    docs = [(i, words(rng.randrange(30))) for i in range(40)]
    items = [(i, words(rng.randrange(1, 25))) for i in range(25)]
    want = {i: (round(best, 9), set(found)) for (i, _), (best, found) in zip(docs, brute_leaks(docs, items, 5, coverage)) if found}
    rows = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), coverage=coverage).where("contaminated").collect()
    n_items = {r.doc_id: (round(r.best_coverage, 9), {h.item_id for h in r.hits}) for r in rows}
    assert {i: b for i, (b, _) in n_items.items()} == {i: b for i, (b, _) in want.items()}
    assert all(found <= want[i][1] for i, (_, found) in n_items.items())
