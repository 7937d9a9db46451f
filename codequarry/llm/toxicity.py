"""Toxicity of texts after noisy-channel deobfuscation.

A character model: counts of all runs of one to ORDER characters over the words
of all documents, a Spark table that grows with the corpus and is never sent
anywhere whole. A channel: a written word is a lattice of what may have been
meant (leetspeak characters stand for letters, separators inside a word and
repeats of a character may be left out); Viterbi decoding takes the cheapest
path under the model. Plain words have one path and are not decoded; letter-only
words with a doubled letter count as written and as decoded. Runs of single
characters are one lattice, in which a word may end at each gap: the words of
all paths within SLACK of the cheapest count.
A classifier on restored words and their beginnings, fitted on a bounded sample
of labelled rows (SAMPLE ids, taken by hash, one text of each): logistic
regression, and beside it each feature's precision, as a lower bound, so that
one word that is only ever seen in toxic texts is enough in a short text. The
larger of both counts.

Plan: one scan of the texts counts characters, one collects the features of
plain words and the written words that may hide a feature (leetspeak, separators
and repeats undone in the coarsest way, they read like one). Each such word is
decoded once, wherever it stands: the runs of characters that its lattice can
ask for are joined with the model, so a word brings its own costs.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXTS_A_BATCH, TEXTS_A_TASK, U, few, materialize, mix, table

SAMPLE = 20_000
LEAST_DOCS = 5
LEAST_ODDS = 3.0
THRESHOLD = 0.3
BOUND, SURE = 3.0, 0.9  # standard deviations of the lower bound, and the least one that counts
KNOWN_WORDS = 400_000
ORDER, BACKOFF = 4, 8.0
CHUNK_CHARS = 1 << 20

#: What a sign may stand for in leetspeak.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "%": "x"}
SEPARATORS = ".-_*~'`^,/\\:#"
EDGE_LEFT, EDGE_RIGHT = "\"'([{<«¿¡.,;:-_*~`", "\"')]}>».,;:!?-_*~`…"
SUBSTITUTE, LEAVE_OUT, REPEAT = 0.7, 0.5, 0.4
_TRIPLE = re.compile(r"(.)\1\1")
_DOUBLE = re.compile(r"(.)\1")
_GAP = r"[ \t.\-_*,/:;~]{1,4}"
_SINGLE = rf"(?:[^\W_]|[{re.escape(''.join(c for c in LEET if not c.isalnum()))}])"
_SPACED = re.compile(rf"(?<![^\W_]){_SINGLE}(?:{_GAP}{_SINGLE}){{2,}}(?![^\W_])")
_PIECE = re.compile(rf"({_SINGLE})({_GAP})?")
SLACK, LONGEST = 4.0, 40  # a run's word of more than LONGEST characters is none


RUN = "\n"  # begins a token that is a run of single characters; no word holds it

#: Letters that one sign may stand for are one class, and so are signs and what they stand for.
_CLASS: dict = {}
for _sign, _letters in LEET.items():
    _all = {_CLASS.get(c, c) for c in _sign + _letters}
    _letter = min(c for c in _all if c in "abcdefghijklmnopqrstuvwxyz")
    _CLASS |= {c: _letter for c in [*_CLASS, *_sign, *_letters] if _CLASS.get(c, c) in _all}
_COARSE = str.maketrans(_CLASS | {c: None for c in SEPARATORS})
_AGAIN = re.compile(r"(.)\1+", re.S)


def coarse(word: str) -> str:
    """What all readings of a word have in common: equal for a word and any way to write it."""
    return _AGAIN.sub(r"\1", word.translate(_COARSE))


# --- the character model -----------------------------------------------------


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(U)


def gram_hashes(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of each run of characters: columns are their first, second ... code points."""
    h = np.full(len(columns[0]), U(len(columns)))
    for c in columns:
        h = h * U(0x9E3779B97F4A7C15) + c
    return mix(h)


def hashes_of(grams: list[str]) -> np.ndarray:
    """The hash of each gram of 1 to ORDER characters."""
    out, sizes = np.zeros(len(grams), U), np.array([len(g) for g in grams])
    for o in range(1, ORDER + 1):
        at = np.flatnonzero(sizes == o)
        if len(at):
            out[at] = gram_hashes(list(code_points("".join(grams[i] for i in at)).reshape(-1, o).T))
    return out


def spaced_words(text: str) -> str:
    """The words of a text in lower case, each between ORDER - 1 spaces."""
    gap = " " * (ORDER - 1)
    return gap + gap.join(text.lower().split()) + gap


def model_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(o, g, n): counts of all runs of o = 1 to ORDER characters of words, by hash."""

    def counted(texts):
        # The runs of ORDER characters are counted one by one, shorter ones from the ends of those that differ.
        codes = code_points(" " * (ORDER - 1) + "".join(map(spaced_words, texts)))
        runs = gram_hashes([codes[i : len(codes) - ORDER + 1 + i] for i in range(ORDER)])
        kinds = pa.array(runs.view(np.int64)).dictionary_encode()
        which = kinds.indices.to_numpy()
        counts, place = np.bincount(which, minlength=len(kinds.dictionary)), np.empty(len(kinds.dictionary), np.int64)
        place[which] = np.arange(len(which))
        for o in range(1, ORDER + 1):
            found, at = np.unique(gram_hashes([codes[place + ORDER - o + i] for i in range(o)]), return_inverse=True)
            n = np.bincount(at, weights=counts).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), o, np.int32)), pa.array(found.view(np.int64)), pa.array(n)], names=["o", "g", "n"])

    def run(batches):
        texts, n = [], 0
        for batch in batches:
            for t in batch.column("t").to_pylist():
                if t:
                    texts.append(t.decode(errors="replace"))
                    n += len(t)
                if n >= CHUNK_CHARS:
                    yield from counted(texts)
                    texts, n = [], 0
        if texts:
            yield from counted(texts)

    found = docs.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "o int, g long, n long")
    return materialize(found.groupBy("o", "g").agg(F.sum("n").alias("n")), "model", TEXTS_A_BATCH)


class Costs:
    """-log P(c | up to ORDER - 1 characters before), backed off to shorter contexts; counts by (context, c), context maybe empty."""

    def __init__(self, counts: dict, total: int, kinds: int):
        self.counts, self.total, self.kinds, self.known = counts, total, kinds, {}

    def __call__(self, context: str, c: str) -> float:
        cost = self.known.get((context, c))
        if cost is None:
            p = (self.counts.get(c, 0) + 1) / (self.total + self.kinds + 1)
            for k in range(1, ORDER):
                before = context[-k:]
                p = (self.counts.get(before + c, 0) + BACKOFF * p) / (self.counts.get(before, 0) + BACKOFF)
            cost = self.known[context, c] = -math.log(p)
        return cost


class Asked(set):
    """Stands for the costs, and keeps what was asked for."""

    def __call__(self, context: str, c: str) -> float:
        for k in range(ORDER):
            before = context[len(context) - k :]
            self.add(before + c)
            if k:
                self.add(before)
        return 0.0


class Channel:
    """Restores words by Viterbi decoding of their lattices; costs: (context, character) -> cost."""

    def __init__(self, costs):
        self.costs = costs

    def steps(self, best: dict, c: str, repeat: bool) -> dict:
        """The states after one more character: last characters -> cost, reading as a linked list. Which states there are does not depend on costs."""
        options = []
        if c.isalpha():
            options.append((c, 0.0))
        else:
            options += [(x, SUBSTITUTE) for x in LEET.get(c, "")]
            if c in SEPARATORS:
                options.append(("", LEAVE_OUT))
            options.append((c, 1.0))
        if repeat:
            options.append(("", REPEAT))
        new: dict = {}
        for context, (cost, path) in best.items():
            for text, extra in options:
                state = (context + text)[1 - ORDER :]
                total = cost + extra + (self.costs(context, text) if text else 0.0)
                old = new.get(state)
                if old is None or total < old[0]:
                    new[state] = (total, (path, text) if text else path)
        return new

    @property
    def start(self) -> dict:
        return {" " * (ORDER - 1): (0.0, None)}

    def ended(self, best: dict) -> tuple[float, str]:
        """Cost and reading of the cheapest state when the word ends."""
        cost, path = min(((cost + self.costs(context, " "), path) for context, (cost, path) in best.items()), key=lambda x: x[0])
        out = []
        while path:
            path, text = path
            out.append(text)
        return cost, "".join(reversed(out))

    def decode(self, word: str) -> str:
        """The cheapest reading of a lower-case word."""
        best = self.start
        for k, c in enumerate(word):
            best = self.steps(best, c, k > 0 and word[k - 1] == c)
        return self.ended(best)[1]

    def words(self, run: str) -> set:
        """Words of the paths through a run of single characters that cost at most SLACK more than the cheapest."""
        pieces = _PIECE.findall(run)
        n = len(pieces)
        arcs, come = [], [0.0] + [math.inf] * n
        for i in range(n):
            best, extra = self.start, 0.0
            for j in range(i, min(n, i + LONGEST)):
                c = pieces[j][0]
                if j > i and len(pieces[j - 1][1]) > 1:
                    extra += LEAVE_OUT  # a wide gap rather ends a word
                best = self.steps(best, c, j > i and pieces[j - 1][0] == c)
                cost, text = self.ended(best)
                arcs.append((i, j + 1, cost + extra, text))
                come[j + 1] = min(come[j + 1], come[i] + cost + extra)
        go = [math.inf] * n + [0.0]
        for i, j, cost, _ in reversed(arcs):
            go[i] = min(go[i], cost + go[j])
        found = set()
        for i, j, cost, text in arcs:
            if j - i > 2 and come[i] + cost + go[j] <= come[n] + SLACK:
                found |= {text, "".join(c for c, _ in pieces[i:j])}
        return found

    def readings(self, token: str) -> set:
        """The words that a token may stand for."""
        if not token.startswith(RUN):
            return {self.decode(token)}
        found = self.words(token[1:])
        letters = re.sub(r"[\W_]", "", token)
        joined = self.decode(letters)
        joined = joined if _TRIPLE.search(letters) or not letters.isalpha() else letters
        # However unlikely to the model, the whole run may be a word, with one-letter words before or after.
        for start in range(min(3, len(joined) - 2)):
            found |= {joined[start:end] for end in range(len(joined), max(len(joined) - 3, start + 2), -1)}
        return found


def restored(tokens: DataFrame, model: DataFrame, documents: int | None = None) -> DataFrame:
    """(s, words) of the distinct tokens s, of so many documents if that is known: each is joined with what its lattice can ask of the model."""

    def ask(batches):
        for batch in batches:
            tokens, grams = [], []
            for token in batch.column("s").to_pylist():
                asked = Asked()
                Channel(asked).readings(token)
                grams += sorted(asked)
                tokens += [token] * len(asked)
            orders, hashes = pa.array([len(g) for g in grams], pa.int32()), pa.array(hashes_of(grams).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(grams, pa.string()), orders, hashes], names=["s", "x", "o", "g"])

    about = model.where("o = 1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()

    def decode(batches):
        for batch in batches:
            out = []
            for token, counts in zip(batch.column("s").to_pylist(), batch.column("counts").to_pylist()):
                costs = Costs({c["x"]: c["n"] for c in counts or () if c["n"]}, *about)
                out.append(sorted(Channel(costs).readings(token)))
            yield pa.RecordBatch.from_arrays([batch.column("s"), pa.array(out, pa.list_(pa.string()))], names=["s", "words"])

    # Few rows, but work for all cores: the number of partitions is set.
    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    asked = tokens.repartition(parts, "s").mapInArrow(ask, "s string, x string, o int, g long").join(model, ["o", "g"], "left")
    counts = asked.repartition(parts, "s").groupBy("s").agg(F.collect_list(F.struct("x", "n")).alias("counts"))
    words = counts.mapInArrow(decode, "s string, words array<string>")
    return materialize(words if documents is None else few(words, documents, TEXTS_A_TASK), "restored")


# --- features ----------------------------------------------------------------


def features(word: str) -> list[str]:
    """A restored word, and its beginnings of 4 to 6 letters (marked by a final *)."""
    return [word, *[word[:n] + "*" for n in (4, 5, 6) if len(word) > n]] if len(word) > 2 else []


class Reader(dict):
    """Written word -> (its features if it is plain, itself without its edges if it is to be decoded); remembers, and forgets when full.

    With wanted features, others are not returned, nor are words to be decoded
    that can't be read as one of them.
    """

    def __init__(self, wanted: frozenset | None):
        super().__init__()
        self.wanted = wanted
        if wanted is not None:
            whole, begun = [f for f in wanted if not f.endswith("*")], [f[:-1] for f in wanted if f.endswith("*")]
            self.whole, self.begun = {coarse(f) for f in whole}, {coarse(f) for f in begun}
            self.any = self.whole | self.begun
            self.sizes, self.begun_sizes = {len(f) for f in self.any}, {len(f) for f in self.begun}

    def may_be(self, token: str) -> bool:
        if self.wanted is None:
            return True
        x = coarse(re.sub(r"[\W_]", "", token.translate(_COARSE)) if token.startswith(RUN) else token)
        if token.startswith(RUN):
            return any(x[i : i + n] in self.any for n in self.sizes for i in range(len(x) - n + 1))
        return x in self.whole or any(x[:n] in self.begun for n in self.begun_sizes)

    def of(self, word: str) -> list[str]:
        return features(word) if self.wanted is None else [f for f in features(word) if f in self.wanted]

    def __missing__(self, word: str):
        if len(self) > KNOWN_WORDS:
            self.clear()
        core = word.lstrip(EDGE_LEFT).rstrip(EDGE_RIGHT)
        plain = core.isalpha()
        odd = bool(_DOUBLE.search(core)) if plain else any(c.isalpha() or c in LEET for c in core)
        found = self.of(core) if not odd or plain and not _TRIPLE.search(core) else []
        value = self[word] = found, core if odd and self.may_be(core) else None
        return value

    def read(self, text: str) -> tuple[set, set]:
        """(features, tokens) of a text."""
        text = text.lower()
        found, tokens = set(), set()
        for plain, token in map(self.__getitem__, set(text.split())):
            found.update(plain)
            if token:
                tokens.add(token)
        runs = {RUN + m[0].replace(RUN, " ") for m in _SPACED.finditer(text)}
        return found, tokens | {r for r in runs if self.may_be(r)}


def scanned(rows: DataFrame, wanted: frozenset | None, key: list[str]) -> DataFrame:
    """(*key, found, tokens): features of the plain words of each row's text t, and what is to be decoded."""

    def scan(batches):
        reader = Reader(wanted)
        for batch in batches:
            got = [reader.read(t.decode(errors="replace")) if t else (set(), set()) for t in batch.column("t").to_pylist()]
            both = [pa.array([sorted(g[i]) for g in got], pa.list_(pa.string())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in key], *both], names=[*key, "found", "tokens"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in key)
    return rows.select(*key, "t").mapInArrow(scan, f"{kinds}, found array<string>, tokens array<string>")


def read(rows: DataFrame, model: DataFrame, wanted: frozenset | None, key: list[str]) -> DataFrame:
    """(*key, found): the features of each row's text t; rows of equal key must have equal texts."""
    plain = materialize(scanned(rows, wanted, key), "plain", TEXTS_A_BATCH)
    n_docs = plain.count()
    tokens = plain.select(*key, F.explode("tokens").alias("s")).distinct()
    words = tokens.join(restored(tokens.select("s").distinct(), model, n_docs), "s").select(*key, F.explode("words").alias("word")).distinct()
    begun = [F.when(F.length("word") > n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in (4, 5, 6)]
    more = words.where(F.length("word") > 2).select(*key, F.explode(F.array_compact(F.array("word", *begun))).alias("f"))
    if wanted is not None:
        # The features are bounded by the sample they were fitted on.
        more = more.where(F.col("f").isin(sorted(wanted))) if len(wanted) <= 500 else more.join(rows.sparkSession.createDataFrame([(f,) for f in sorted(wanted)], "f string"), "f", "left_semi")
    more = materialize(few(more.groupBy(*key).agg(F.collect_set("f").alias("more")), n_docs), "hidden").alias("m")
    same = None
    for c in key:
        equal = F.col(f"p.{c}").eqNullSafe(F.col(f"m.{c}"))
        same = equal if same is None else same & equal
    every = F.array_sort(F.array_union("found", F.coalesce("more", F.array().cast("array<string>"))))
    return plain.alias("p").join(more, same, "left").select(*[F.col(f"p.{c}").alias(c) for c in key], every.alias("found"))


# --- the classifier ----------------------------------------------------------


def held_out(id_col):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def lower_bound(pos: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Wilson's lower bound of pos / n, 0 where it does not reach SURE: words that chance made look toxic don't."""
    z, n = BOUND**2, np.maximum(n, 1)
    share = pos / n
    low = (share + z / (2 * n) - BOUND * np.sqrt(share * (1 - share) / n + z / (4 * n**2))) / (1 + z / n)
    return np.where(low < SURE, 0.0, low)


def fit(docs: DataFrame, labels: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> tuple[dict, float]:
    """(feature -> (weight, lower bound of precision), bias) from at most sample labelled texts outside the held-out quarter.

    Of an id with several texts that with the smallest hash is taken; ids
    without a text are not counted.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("l")).agg(F.max(label_col).cast("int").alias("y"))
    chosen = marks.orderBy(F.xxhash64("l"), "l").limit(sample)
    texts = docs.select(F.col(id_col).alias("l"), F.col(text_col).cast("binary").alias("t")).join(F.broadcast(chosen), "l")
    rows = materialize(few(texts.groupBy("l", "y").agg(F.min_by("t", F.xxhash64("t")).alias("t")), sample, TEXTS_A_TASK), "sample")
    total = {r["y"]: r["n"] for r in rows.groupBy((F.col("y") > 0).alias("y")).agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = total.get(True, 0), total.get(False, 0)
    rate = (n_pos + 0.5) / (n_pos + n_neg + 1.0) if n_pos + n_neg else 0.0
    alike = {}, math.log(max(rate, 1e-6) / max(1 - rate, 1e-6))
    if not n_pos or not n_neg:
        return alike
    counts = lambda read_: read_.select(F.explode("found").alias("f")).groupBy("f").agg(F.count("*").alias("n"))
    toxic, clean = rows.where("y > 0"), rows.where("y <= 0")
    found = materialize(few(read(toxic, model, None, ["l"]), sample), "toxic")
    pos = {r["f"]: r["n"] for r in counts(found).where(F.col("n") >= LEAST_DOCS).collect()}
    # What says toxic: at least LEAST_ODDS times as usual in toxic texts. Counts in clean texts only grow with what is
    # hidden in them, so what fails by plain words alone needs no decoding.
    telling = lambda names, neg: [f for f in names if math.log((pos[f] + 0.1) / (n_pos + 0.2)) - math.log((neg.get(f, 0) + 0.1) / (n_neg + 0.2)) >= math.log(LEAST_ODDS)]
    plain = scanned(clean, frozenset(pos), ["l"])
    names = telling(sorted(pos), {r["f"]: r["n"] for r in counts(plain).collect()})
    other = materialize(few(read(clean, model, frozenset(names), ["l"]), sample), "clean")
    neg = {r["f"]: r["n"] for r in counts(other).collect()}
    names = telling(names, neg)
    if not names:
        return alike
    ids = {f: i for i, f in enumerate(names)}
    p = np.array([pos[f] for f in names], float)
    low = lower_bound(p, p + np.array([neg.get(f, 0) for f in names], float))
    # The ids of the features of each labelled text: at most sample rows; texts without one are counted.
    named = F.broadcast(rows.sparkSession.createDataFrame(list(ids.items()), "f string, i int"))

    def ids_of(read_: DataFrame, n: int) -> list[list[int]]:
        hits = read_.select("l", F.explode("found").alias("f")).join(named, "f").groupBy("l").agg(F.array_sort(F.collect_list("i")).alias("x"))
        some = [r["x"] for r in hits.select("x").collect()]
        return some + [[]] * (n - len(some))

    got = [(1.0, x) for x in ids_of(found, n_pos)] + [(0.0, x) for x in ids_of(other, n_neg)]
    got.sort()  # sums don't depend on the order of arrival
    y = np.array([r[0] for r in got])
    row = np.repeat(np.arange(len(got)), [len(r[1]) for r in got])
    col = np.array([i for r in got for i in r[1]], np.int64)
    w, b = np.zeros(len(names)), math.log(y.mean() / (1 - y.mean()))
    m1, m2 = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, 401):  # Adam on the whole sample
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, w[col], len(y)), -30, 30)))
        g = np.append(np.bincount(col, (p - y)[row], len(names)) / len(y) + 1e-4 * w, (p - y).mean())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        move = 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return {f: (float(w[i]), float(low[i])) for f, i in ids.items()}, float(b)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Score every text.

    Returns a row per input row: doc_id, text_hash (xxhash64), held_out, score (0
    to 1, from the text alone), predicted (1 from the threshold on) and found
    (the features that count). Null and empty texts get the score of a text
    without features. Labels may be null (ignored) or repeated (toxic if one says
    so); with none, or of one kind only, every text gets the same score. Repeated
    rows, and texts with the same features, get equal scores. Of readings of
    equal cost the first found in the order of the lattice is taken. Ids are cast
    to long (an id that is no integer fails); null ids are carried, are not held
    out, and have no label. Bytes that are no valid UTF-8 count as U+FFFD. Texts
    of any length are one row of the scans. Other columns are ignored, whatever
    their names. An empty table gives an empty result.
    """
    model = model_of(docs, text_col)
    known, b = fit(docs, labels, model, id_col, text_col, label_col, sample)

    def scored(batches):
        for batch in batches:
            found = [[known[f] for f in fs] for fs in batch.column("found").to_pylist()]
            x = np.array([b + sum(w for w, _ in f) for f in found], float)
            score = np.maximum(1 / (1 + np.exp(-np.clip(x, -30, 30))), np.array([max((low for _, low in f), default=0.0) for f in found], float))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t")).withColumn("text_hash", F.xxhash64("t"))
    found = read(base, model, frozenset(known), ["doc_id", "text_hash"])
    found = found.mapInArrow(scored, "doc_id long, text_hash long, found array<string>, score double")
    return found.select("doc_id", "text_hash", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "found")


def op9_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash", "found")
