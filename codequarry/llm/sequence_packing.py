"""Packing documents into token sequences by best-two-fit.

Texts are tokenized where they lie, cut into pieces of at most the sequence's
length, and only numbers leave that scan: id, piece, start, length, checksum, the
block (partition of the scan) and the piece's place among the block's pieces of
the same length. They are written once, so that places and blocks stay.

How many pieces there are of each length is all that packing needs to know, and
that is one number for each possible length, however many documents there are.
From these counts best-two-fit makes its bins: a bin is filled greedily, longest
first; then its smallest piece goes if two unpacked ones fit the expanded gap
more tightly. Equal bins follow one another until one of their lengths runs
short, so they are made together, as a pattern and the times it is used; there
are a few patterns a length at most. Each use of a length in a pattern is a range
of ranks, and the piece of that rank (pieces of its length in earlier blocks, by
a prefix sum over blocks, and its place in its own) gets its sequence and offset
by a look-up in sorted arrays. No length is ever gathered in a task.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, kept_type, materialize, table

LENGTH, END_ID = 2048, 0
UNITS_KEPT, LONGEST_KEPT = 500_000, 64  # units of text whose ids a worker remembers; longer ones are not remembered

# str.split also takes \x1c to \x1f, which are no white space to the tokenizer.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_WORD = re.compile("[\\S\x1c-\x1f]+")
_PLAIN_END = 0x250  # up to here no character changes under NFC, and lower-casing looks at one character only
_NOT_PLAIN = re.compile(f"[^\t-\r -~\x85\xa0-{chr(_PLAIN_END - 1)}]")
_ENCODERS: dict = {}  # path -> what this worker uses


class _Spelling(dict):
    """Code point -> how the tokenizer spells the character's bytes, asked once."""

    def __init__(self, tokenizer):
        self.spell = tokenizer.pre_tokenizer.pre_tokenize_str

    def __missing__(self, code: int) -> str:
        found = self[code] = "".join(x for x, _ in self.spell(chr(code)))
        return found


class TextEncoder:
    """Token ids of whole texts, unit by unit, as little-endian unsigned 32-bit integers.

    Most units of a corpus are repeated, so their ids are remembered. Units are
    words between white space, for tokenizers that drop white space and never join
    what stands on its two sides. Where a tokenizer lower-cases, then splits by one
    pattern, and a text is of plain characters, units are the pattern's matches,
    and new ones go to the tokenizer's model alone.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        spec = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.match = self._matches(spec)
        self.spelling = _Spelling(self.tokenizer)

    @staticmethod
    def _matches(spec: dict):
        """What finds the matches in a plain, lower-cased text, for a tokenizer of the kind above."""
        steps = lambda x, many: [y["type"] for y in (spec[x] or {}).get(many, [])]
        if steps("normalizer", "normalizers") != ["NFC", "Replace", "Lowercase"] or steps("pre_tokenizer", "pretokenizers") != ["Split", "ByteLevel"]:
            return None
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        pattern = split["pattern"].get("Regex", "")
        if not (split["behavior"] == "Removed" and split["invert"]):
            return None
        there = sorted({c for x in range(_PLAIN_END) for c in chr(x).lower()})  # some plain characters have a lower case beyond the plain ones
        for kind in "LN":  # letters and numbers, as classes of re
            members = [c for c in there if unicodedata.category(c)[0] == kind]
            pattern = pattern.replace(f"\\p{{{kind}}}", "".join(map(re.escape, members)))
        return None if "\\p" in pattern else re.compile(pattern).findall

    def _of_words(self, words: list[str]) -> dict[str, bytes]:
        found = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(found.ids, "<u4").tobytes()
        out, at = dict.fromkeys(words, b""), 0
        for word, run in groupby(found.word_ids):
            n = 4 * sum(1 for _ in run)
            out[words[word]] = ids[at : at + n]
            at += n
        return out

    def _of_matches(self, matches: list[str]) -> dict[str, bytes]:
        split = self.tokenizer.model.tokenize
        return {x: b"".join([t.id.to_bytes(4, "little") for t in split(x.translate(self.spelling))]) for x in matches}

    def __call__(self, text: str) -> bytes:
        if self.match and not _NOT_PLAIN.search(text) and not any(t in text for t in self.special):
            units, make = self.match(text.lower()), self._of_matches
        else:
            units, make = _WORD.findall(text) if _ODD_SPACE.search(text) else text.split(), self._of_words
        try:
            return b"".join(map(self.known.__getitem__, units))
        except KeyError:
            new = [x for x in set(units) if x not in self.known]
        found = make(new)
        ids = b"".join([found[x] if x in found else self.known[x] for x in units])
        if len(self.known) + len(new) > UNITS_KEPT:
            self.known.clear()
        self.known.update((x, b) for x, b in found.items() if len(x) <= LONGEST_KEPT)
        return ids


def _pieces(path: str, length: int, end_id: int, with_ids: bool):
    """Rows (id, kept, t) to rows of pieces."""
    end = end_id.to_bytes(4, "little")

    def run(batches):
        encode = _ENCODERS.get(path) or _ENCODERS.setdefault(path, TextEncoder(path))
        block, seen = TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        for batch in batches:
            source, piece, start, size, crc, place, ids = [], [], [], [], [], [], []
            for row, text in enumerate(batch["t"].to_pylist()):
                whole = encode(text or "") + end
                for k, at in enumerate(range(0, len(whole), 4 * length)):
                    part = whole[at : at + 4 * length]
                    n = len(part) // 4
                    source.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    size.append(n)
                    crc.append(zlib.crc32(part))
                    place.append(seen[n])
                    seen[n] += 1
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4"))
            out = batch.select(["doc_id", "kept"]).take(pa.array(source, pa.int64()))
            numbers = zip(("start", "ids_crc32", "place"), (start, crc, place))
            columns = {"piece": pa.array(piece, pa.int32()), "length": pa.array(size, pa.int32()), "block": pa.array([block] * len(size), pa.int32())}
            columns |= {name: pa.array(values, pa.int64()) for name, values in numbers}
            if with_ids:
                columns["ids"] = pa.array(ids, pa.list_(pa.uint32())).cast(pa.list_(pa.int64()))
            for name in ("piece", "start", "length", "ids_crc32", "block", "place", *(["ids"] if with_ids else [])):
                out = out.append_column(name, columns[name])
            yield out

    return run


def best_two_fit(counts, size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins for counts[l] items of each length l: (bins alike, [(length, items of it in a bin)]), longest first.

    Each bin is what best-two-fit makes of what is left: filled greedily with the
    longest that fit; then, if it holds more than one and is not full, its
    smallest is replaced with the two that fill it most without being too long
    (of equal pairs the one with the longest item).
    """
    left = np.array(counts, np.int64)
    out = []
    while len(there := np.flatnonzero(left)):
        room, items = size, {}
        for n in there[::-1].tolist():
            if n <= room:
                items[n] = min(int(left[n]), room // n)
                room -= n * items[n]
        need = dict(items)
        if room and sum(items.values()) > 1:
            last = min(items)
            rest = left.copy()
            for n, m in items.items():
                rest[n] -= m
            pair = _fullest_pair(rest, last, room + last)
            if pair:
                items[last] -= 1
                for n in pair:
                    items[n] = items.get(n, 0) + 1
                    need[n] = max(need.get(n, 0), items[n])
        items = {n: m for n, m in items.items() if m}
        times = min(int(left[n]) // m for n, m in need.items())
        for n, m in items.items():
            left[n] -= times * m
        out.append((times, sorted(items.items(), reverse=True)))
    return out


def _fullest_pair(rest: np.ndarray, least: int, most: int):
    """The two lengths that are left with the largest sum above least and up to most; None if there are none."""
    there = np.flatnonzero(rest[: most + 1])
    if not len(there):
        return None
    long = there[np.maximum(np.searchsorted(there, most - there, "right") - 1, 0)]
    ok = (long + there <= most) & (long + there > least) & ((long > there) | ((long == there) & (rest[there] > 1)))
    if not ok.any():
        return None
    long, short = long[ok], there[ok]
    best = np.lexsort((long, long + short))[-1]
    return int(long[best]), int(short[best])


def slots(bins, size: int):
    """Look-up arrays: pieces of length l with ranks from first on (l << 40 | first, sorted) are in bins from sequence on, each of them `each` a bin, from offset on."""
    taken, rows, sequence = {}, [], 0
    for times, items in bins:
        offset = 0
        for n, each in items:
            rows.append((n << 40 | taken.get(n, 0), sequence, each, offset))
            taken[n] = taken.get(n, 0) + times * each
            offset += n * each
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4).T


def _place(plan):
    def run(batches):
        key, sequence, each, offset = plan
        for b in batches:
            length, rank = (b[c].to_numpy().astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(key, length << 40 | rank, "right") - 1
            bins, within = np.divmod(rank - (key[at] & ((1 << 40) - 1)), each[at])
            out = b.drop_columns(["rank"])
            yield out.append_column("sequence_id", pa.array(sequence[at] + bins)).append_column("offset", pa.array(offset[at] + within * length))

    return run


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False, keep: tuple = ()) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most length tokens.

    tokenizer is the path of a file for the library tokenizers, there on every
    machine. It must drop white space and split at it: then a document's ids are
    those of its words, which is how they are made. A document is the ids of its
    whole text (null: none) and end_id. Only documents of more than length ids are
    cut, into pieces of length ids, the last perhaps shorter; a piece of length
    ids has a sequence of its own. Returns a row per piece: doc_id, piece (from
    0), start (the document's ids before it), length, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers), sequence_id (from 0, without gaps),
    offset (of the piece in its sequence; pieces follow without gaps), and the
    ids with with_ids.

    Every row is a document, also those that repeat an id or text, and those with
    a null id. A text of any length is one row of a scan, in one task. An empty
    table gives an empty result. Columns named in keep come back as the struct
    kept; others are ignored, whatever their names. Which of the pieces of equal
    length go together depends on how the scan was dealt; how many sequences there
    are does not. The driver makes the bins from one count for each possible
    length, length counts at most.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), kept(docs, keep).alias("kept"), F.col(text_col).cast("string").alias("t"))
    kinds = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, kept {kept_type(docs, keep)}"
    kinds += ", piece int, start long, length int, ids_crc32 long, block int, place long" + (", ids array<long>" if with_ids else "")
    pieces = materialize(rows.mapInArrow(_pieces(tokenizer, length, end_id, with_ids), kinds), "pieces")
    counts = materialize(pieces.groupBy("block", "length").agg(F.count("*").alias("n")), "counts")
    found = np.zeros(length + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        found[r["length"]] = r["n"]
    plan = slots(best_two_fit(found, length), length)
    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("block", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["block", "length"]).withColumn("rank", F.col("before") + F.col("place"))
    ranked = ranked.select("doc_id", "kept", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", *(["ids"] if with_ids else []), "rank")
    out = ranked.mapInArrow(_place(plan), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank") + ", sequence_id long, offset long")
    return out if keep else out.drop("kept")


def op11_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
