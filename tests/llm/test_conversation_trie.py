import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from codequarry.llm import conversation_trie as T

KIND = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, block=None, most_shared=6):
    """All nodes, from every prefix of every conversation."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turn_ = (role or "", text or "")
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(turn_[0])}:{turn_[0]}{turn_[1]}".encode()).hexdigest(), turn_))
    own = {c: [x[3] for x in sorted(turns)] for c, turns in own.items()}
    convs = dict(own)
    if block:
        share = {c: zlib.crc32(str(c).encode()) % most_shared for c in own}
        convs = {c: own.get(c - c % block, [])[: share[c]] + own[c][share[c] :] for c in own}
    members = defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, held in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(held) - 1) * len(node[-1][1]) if node else 0
    out = []
    for node, held in members.items():
        ends = ",".join(str(c) for c in held if len(convs[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        out.append((held[0], len(node), parent, len(held), kids[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(df, **how):
    return sorted((tuple(r) for r in T.conversation_trie(df, **how).select(*COLUMNS).collect()), key=str)


@pytest.fixture(scope="module")
def chats():
    """Shared beginnings, copies, one conversation within another, nulls, ties, repeated rows, a long conversation and its long copy."""
    rng = random.Random(8)
    words = ["yes", "no", "größe 𝄞", "", None, "please go on"]
    rows = []
    for c in [*range(100, 140), *range(200, 220), 7, 399]:
        for t in range(rng.choice([1, 2, 3, 4, 5, 6])):
            rows.append((c, t, ["user", "assistant"][t % 2], words[min(rng.randrange(9), 5)]))
    for c in range(300, 340):  # one conversation, again and again
        rows += [(c, t, "user", f"turn {t}") for t in range(7)]
    long = [(t, "user", f"long {t}") for t in range(60)]
    rows += [(c, *x) for c in (401, 402) for x in long] + [(402, 60, "user", "more")]
    rows += [(None, 1, "user", "nobody"), (500, None, None, None), (501, 1, None, "x"), (501, 1, "", "x"), (501, 1, "x", ""), (501, None, "z", "z"), (501, 1, "x", "")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [None, 100])
def test_against_brute_force(spark, chats, crowd, block):
    assert trie(crowd(spark.createDataFrame(chats, KIND)).repartition(3), block=block) == brute(chats, block)


def test_one_conversation_over_many_ranges_and_digests_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(T, "IDS_A_PIECE", 3)
    monkeypatch.setattr(T, "STEP", 50)
    rows = [(0, t, "user", f"t{t % 7}") for t in range(160)] + [(0, 3, "user", "again")] * 3
    rows += [(c, t, "user", f"t{t}") for c in range(1, 40) for t in range(2)] + [(c, 0, "user", "alone") for c in range(40, 45)]
    rows = [(None if t == 0 else t, c, r, x) for c, t, r, x in rows]
    rows = [(c, t, r, x) for t, c, r, x in rows]
    assert trie(spark.createDataFrame(rows, KIND)) == brute(rows)


def test_rounds_follow_branchings_not_depth(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(8) for t in range(200)] + [(c, 200, "user", f"own {c}") for c in range(8)]
    df = spark.createDataFrame(rows, KIND)
    turns = T.numbered_turns(df.select(T.F.col("conv_id").alias("conv"), "turn", T.turn_hash(T.F.col("role"), T.F.col("text")).alias("key"), T.F.char_length("text").cast("long").alias("chars")))
    turns = T.materialize(turns.withColumnRenamed("k", "pos"), "turns")
    _, classes = T.classes_of(turns, turns.select("conv").distinct())
    assert [p.count() for p in T.grow(turns, classes)] == [1, 8]


def test_turnless_conversations(spark):
    rows = [(0, 0, "user", "a")] + [(c, t, "user", f"{c}") for c in range(201, 230) for t in range(2)]
    found = trie(spark.createDataFrame(rows, KIND), block=100)
    assert found == brute(rows, 100)
    root = next(r for r in found if r[1] == 0)
    assert root[7] != T.EMPTY  # some end at the root: block 200 is absent and all their own turns were to be replaced


def test_only_turnless_conversations(spark):
    only = [(c, 0, "user", "x") for c in range(201, 230) if zlib.crc32(str(c).encode()) % 6]
    assert trie(spark.createDataFrame(only, KIND), block=100) == brute(only, 100) and len(brute(only, 100)) == 1


def test_no_conversations(spark):
    assert trie(spark.createDataFrame([], KIND), block=100) == []
    assert trie(spark.createDataFrame([(None, 1, "user", "x")], KIND)) == []
    assert T.conversation_trie(spark.createDataFrame([], KIND)).columns == COLUMNS
