import random
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from codequarry.llm.sequence_packing import TextEncoder, best_two_fit, op11_best_fit_packing, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE, ENCODE = Tokenizer.from_file(PATH), TextEncoder(PATH)
SF = "/root/testdata/sf0.001"


def ids_of(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 0]


def check_layout(rows, length):
    """Pieces of a sequence follow one another without gaps from 0, and none is too long; sequences are numbered without gaps."""
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for found in bins.values():
        at = 0
        for offset, n in sorted(found):
            assert offset == at and n > 0
            at += n
        assert at <= length
    assert sorted(bins) == list(range(len(bins)))
    return len(bins)


def brute_pieces(docs, length):
    out = Counter()
    for i, text in docs:
        ids = ids_of(text)
        for k, at in enumerate(range(0, len(ids), length)):
            part = ids[at : at + length]
            out[i, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    return out


def simple_best_two_fit(lengths, size):
    """One bin at a time, over a plain list."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        room, held = size, []
        for n in list(left):
            if n <= room:
                held.append(n)
                left.remove(n)
                room -= n
        if room and len(held) > 1:
            least = min(held)
            sums = [(a + b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if least < a + b <= room + least]
            if sums:
                _, a, b = max(sums)
                held.remove(least)
                left.remove(a)
                left.remove(b)
                left = sorted([*left, least], reverse=True)
                held += [a, b]
        bins.append(tuple(sorted(held, reverse=True)))
    return bins


@given(st.lists(st.integers(1, 40), max_size=60), st.integers(40, 45))
@settings(max_examples=200, deadline=None)
def test_bins_made_together_are_those_made_one_by_one(lengths, size):
    counts = Counter(lengths)
    bins = best_two_fit([counts[n] for n in range(size + 1)], size)
    made = [tuple(n for n, m in items for _ in range(m)) for times, items in bins for _ in range(times)]
    assert made == simple_best_two_fit(lengths, size)


def test_a_smallest_item_makes_room_for_two():
    assert best_two_fit([0, 0, 0, 0, 2, 1, 1], 10) == [(1, [(6, 1), (4, 1)]), (1, [(5, 1), (4, 1)])]
    assert best_two_fit([0, 0, 0, 2, 1, 0, 0, 1], 13) == [(1, [(7, 1), (3, 2)]), (1, [(4, 1)])]  # 7 + 4, then 3 + 3 for the 4


def test_few_patterns_and_full_bins_for_many_items():
    rng = random.Random(3)
    counts = [0] + [rng.randrange(100_000) if n < 1000 else 0 for n in range(2048)]
    bins = best_two_fit(counts, 2048)
    total = sum(n * c for n, c in enumerate(counts))
    assert len(bins) < 3 * 2048 and sum(times for times, _ in bins) <= -(-total // 2048) * 1.002
    assert sum(times * m * n for times, items in bins for n, m in items) == total


PLAIN = st.sampled_from([*map(chr, range(0x250)), *"aAbB'stmd 1.İ"])


@given(st.one_of(st.text(st.characters(exclude_categories=["Cs"])), st.text(PLAIN, max_size=40)))
@settings(max_examples=300, deadline=None)
def test_ids_of_words_are_those_of_the_text(text):
    assert ENCODE(text) == struct.pack(f"<{len(ids_of(text)) - 1}I", *ids_of(text)[:-1])


def test_every_white_space_and_special_tokens_inside_texts():
    spaces = [c for c in map(chr, range(0x110000)) if c.isspace()]
    for text in ["".join(map(chr, range(0x250))), "".join(f"a{chr(c)}" for c in range(0x250)), *[f"Ab{c}cd{c}{c}'s 1 it's" for c in spaces]] + ["<|endoftext|> a<|startoftext|>b <|endof text|>", "e ́ ẛ̣", "x" * 500 + " y"]:
        assert ENCODE(text) == struct.pack(f"<{len(ids_of(text)) - 1}I", *ids_of(text)[:-1]), repr(text)


def test_every_plain_character_next_to_a_sign_a_letter_and_a_digit():
    for c in map(chr, range(0x300)):
        for text in (f":{c}", f"{c}:", f"a{c}", f"{c}a", f"1{c}", f"{c}1", f"{c}{c}", f"'{c}s", f"x {c}'s{c.upper()}{c.lower()} y"):
            assert ENCODE(text) == struct.pack(f"<{len(ids_of(text)) - 1}I", *ids_of(text)[:-1]), repr(text)


def test_a_worker_forgets_words_without_losing_ids(monkeypatch):
    monkeypatch.setattr("codequarry.llm.sequence_packing.UNITS_KEPT", 5)
    encode = TextEncoder(PATH)
    for text in ["one two three", "two four five six", "seven one eight two nine ten", "one"]:
        assert encode(text) == struct.pack(f"<{len(ids_of(text)) - 1}I", *ids_of(text)[:-1])
        assert len(encode.known) <= 6


@pytest.mark.parametrize("length", [7, 64, 2048])
def test_odd_documents(spark, docs, texts, crowd, length):
    rows = pack_documents(crowd(docs), PATH, length=length).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == brute_pieces(texts, length)
    bins = check_layout(rows, length)
    total = sum(r.length for r in rows)
    assert bins >= -(-total // length)
    again = pack_documents(docs.repartition(7), PATH, length=length)
    assert again.select("sequence_id").distinct().count() == bins


def test_ids_and_kept_columns_come_back(spark, docs, texts):
    rows = pack_documents(docs, PATH, length=100, with_ids=True, keep=("lang", "source")).collect()
    whole = Counter()
    by_start = defaultdict(dict)
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(struct.pack(f"<{len(r.ids)}I", *r.ids)) == r.ids_crc32
        by_start[r.doc_id][r.start] = r.ids
    for i, text in texts:
        if i != 9:  # two equal rows
            assert [x for _, part in sorted(by_start[i].items()) for x in part] == ids_of(text)
    for r in rows:
        whole[r.doc_id, r.kept.lang, r.kept.source] += r.piece == 0
    assert whole == Counter((r.doc_id, r.lang, r.source) for r in docs.collect())


def test_no_documents(spark, none):
    assert pack_documents(none, PATH).collect() == []


def test_query_against_brute_force(spark):
    rows = op11_best_fit_packing(spark, SF).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == brute_pieces(docs, 2048)
    bins = check_layout(rows, 2048)
    assert bins == len(simple_best_two_fit([r.length for r in rows], 2048))
    assert bins <= -(-sum(r.length for r in rows) // 2048) + 1
