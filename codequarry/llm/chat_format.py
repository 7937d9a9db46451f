"""Chat formatting by minimum-cost role repair.

Legal chats: an optional system turn, then user and assistant in turn, ending
with the assistant. A dynamic programme over the automaton of the last output
role (start, system, user, assistant) picks for every given turn to keep or
relabel it, to merge it into the turn before, or to insert empty turns first,
at the least total cost; of equal costs, the fewest changed turns, then the
least sum of hashes of turns and moves. All three add up along a conversation,
so a given turn acts as a 4 x 4 matrix over (min, +) with one best path, and the
result does not depend on how a conversation is cut: each run of turns is
reduced to its matrix, FAN neighbouring matrices at a time to one more until a
conversation has FAN at most, then states between them are found on the way
back, and each run is repaired by itself. No task holds more than FAN matrices
of a conversation or the turns of a few runs.
"""

from __future__ import annotations

import re
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
RELABEL, MERGE, INSERT = 3, 2, 4
RUN, FAN = 1024, 1024
BUCKET_ROWS, ROW_BYTES = 16_384, 4096  # a turn counts as one row for each ROW_BYTES of its text, begun
#: Bits of a path's cost, from below: sum of hashes, changed turns, cost.
HASH_BITS, COUNT_BITS = 112, 48
NEVER = 1 << (HASH_BITS + COUNT_BITS + 80)
#: What must be inserted between an output role and the next; no entry: not legal.
BETWEEN = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,),
    (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (), (USER, USER): (ASSISTANT,),
    (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
#: What must be inserted at the end.
CLOSING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def moves(role: int):
    """Of a given role (0: unknown): (from, to, cost, action, inserted)."""
    for a in range(4):
        for b in (SYSTEM, USER, ASSISTANT):
            wrong = RELABEL if b != role else 0
            if (a, b) in BETWEEN:
                added = BETWEEN[a, b]
                yield a, b, INSERT * len(added) + wrong, "relabel" if wrong else "keep", added
            if a == b:
                yield a, b, MERGE + wrong, "merge_relabel" if wrong else "merge", ()


MOVES = [list(moves(r)) for r in range(4)]


def priced(role: int, turn_hash: int):
    """The moves of one turn, each with its whole cost; the hash tells turns of one conversation apart."""
    for n, m in enumerate(MOVES[role]):
        noise = ((turn_hash * (2 * n + 3) ^ n) * 0x9E3779B97F4A7C15 >> 5) & ((1 << 60) - 1)
        yield (m[2] << HASH_BITS + COUNT_BITS) + ((m[3] != "keep") << HASH_BITS) + noise, m


def cost_of(total: int) -> int:
    return total >> HASH_BITS + COUNT_BITS


UNIT = [[0 if a == b else NEVER for b in range(4)] for a in range(4)]


def matrix_of(turns: list[tuple[int, int]]) -> list[list[int]]:
    """Least cost from each state to each over turns (role, hash)."""
    out = UNIT
    for role, turn_hash in turns:
        choices = [(m[0], m[1], cost) for cost, m in priced(role, turn_hash)]
        out = [_step(row, choices) for row in out]
    return out


def _step(costs: list[int], choices: list) -> list[int]:
    new = [NEVER] * 4
    for a, b, cost in choices:
        if costs[a] + cost < new[b]:
            new[b] = costs[a] + cost
    return new


def product(matrices: list) -> list[list[int]]:
    out = UNIT
    for m in matrices:
        out = [[min(NEVER, min(row[k] + m[k][b] for k in range(4))) for b in range(4)] for row in out]
    return out


def path_of(turns: list[tuple[int, int]], start: int, end: int) -> list[tuple]:
    """The best moves (from, to, cost, action, inserted) from start to end over turns (role, hash)."""
    costs = [0 if a == start else NEVER for a in range(4)]
    back = []
    for role, turn_hash in turns:
        new, by = [NEVER] * 4, [None] * 4
        for cost, m in priced(role, turn_hash):
            if costs[m[0]] + cost < new[m[1]]:
                new[m[1]], by[m[1]] = costs[m[0]] + cost, m
        back.append(by)
        costs = new
    out, at = [], end
    for by in reversed(back):
        out.append(by[at])
        at = by[at][0]
    return out[::-1]


def states_of(matrices: list, start: int = START, end: int | None = None) -> list[int]:
    """States before, between and after the given matrices on the best path; the end is free at the cost of its closing."""
    costs, back = [0 if a == start else NEVER for a in range(4)], []
    for m in matrices:
        rows = [[costs[a] + m[a][b] for a in range(4)] for b in range(4)]
        back.append([min(range(4), key=r.__getitem__) for r in rows])
        costs = [min(r) for r in rows]
    at = min(range(4), key=lambda s: costs[s] + (INSERT * len(CLOSING[s]) << HASH_BITS + COUNT_BITS)) if end is None else end
    out = [at]
    for by in reversed(back):
        at = by[at]
        out.append(at)
    return out[::-1]


def escaped(text):
    """A backslash between each < and | that only backslashes part, so that a text holds no mark; unescape() takes it out."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def parse_chat(chat: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a rendered chat."""
    return [(role, unescape(body)) for role, body in re.findall(r"<\|(\w+)\|>\n(.*?)<\|end\|>\n", chat, re.S)]


def _code(role):
    return F.when(role == "system", 1).when(role == "user", 2).when(role == "assistant", 3).otherwise(0)


def _place(r):
    return r["turn"] is not None, r["turn"] or 0, r["o"]


def _run(r):
    return r["c"], r["part"], r["sub"]


def _turn(r):
    return r["code"], r["z"]


def _pack(matrix) -> list[str]:
    return [str(x) for row in matrix for x in row]


def _unpack(m: list) -> list[list[int]]:
    return [[int(x) for x in m[i : i + 4]] for i in (0, 4, 8, 12)]


def _matrices(turns):
    out = []
    for at, rows in groupby(sorted(turns.to_pylist(), key=lambda r: (_run(r), _place(r))), _run):
        out.append((*at, _pack(matrix_of([_turn(r) for r in rows]))))
    return _table(out, RUNS)


def _groups(rows, *by):
    key = lambda r: tuple(r[c] for c in by)
    return groupby(sorted(rows.to_pylist(), key=lambda r: (key(r), r["pos"])), key)


def _products(rows):
    return _table([(*key, _pack(product([_unpack(r["m"]) for r in group]))) for key, group in _groups(rows, "c", "up")], LEVEL)


def _top(rows):
    out = []
    for (c,), group in _groups(rows, "c"):
        group = list(group)
        s = states_of([_unpack(r["m"]) for r in group])
        out += [(c, r["pos"], s[i], s[i + 1]) for i, r in enumerate(group)]
    return _table(out, STATES)


def _below(rows, states):
    known = {(r["c"], r["pos"]): r for r in states.to_pylist()}
    out = []
    for key, group in _groups(rows, "c", "up"):
        group = list(group)
        s = states_of([_unpack(r["m"]) for r in group], known[key]["enter"], known[key]["leave"])
        out += [(key[0], r["pos"], s[i], s[i + 1]) for i, r in enumerate(group)]
    return _table(out, STATES)


def _repair(turns, states):
    known = {_run(r): r for r in states.to_pylist()}
    out = []
    for at, group in groupby(sorted(turns.to_pylist(), key=lambda r: (_run(r), _place(r))), _run):
        rows, state = list(group), known[at]
        for n, (r, (a, b, cost, action, added)) in enumerate(zip(rows, path_of([_turn(r) for r in rows], state["enter"], state["leave"]))):
            end = state["last"] and n == len(rows) - 1
            closing = CLOSING[b] if end else ()
            inserted, closed = [ROLES[x] for x in added], [ROLES[x] for x in closing]
            out.append((r["conv_id"], r["turn"], r["o"], r["role"], r["text"], ROLES[b], action, inserted, closed, a == START, end, cost + INSERT * len(closing)))
    return _table(out, FIXED)


def _table(rows, schema):
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema) if rows else schema.empty_table()


_STR, _BIN, _LONG, _INT, _BOOL = pa.string(), pa.binary(), pa.int64(), pa.int32(), pa.bool_()
RUNS = pa.schema([("c", _STR), ("part", _LONG), ("sub", _LONG), ("m", pa.list_(_STR))])
LEVEL = pa.schema([("c", _STR), ("pos", _LONG), ("m", pa.list_(_STR))])
STATES = pa.schema([("c", _STR), ("pos", _LONG), ("enter", _INT), ("leave", _INT)])
FIXED = pa.schema(
    [("conv_id", _LONG), ("turn", _LONG), ("o", _LONG), ("role", _BIN), ("text", _BIN), ("new_role", _STR), ("action", _STR)]
    + [("inserted", pa.list_(_STR)), ("closing", pa.list_(_STR)), ("opens", _BOOL), ("closes", _BOOL), ("cost", _LONG)]
)
FIXED_DDL = "conv_id long, turn long, o long, role binary, text binary, new_role string, action string, inserted array<string>, closing array<string>, opens boolean, closes boolean, cost long"


def deal(turns: DataFrame, run: int) -> tuple[DataFrame, int]:
    """Turns with their run (c, part, sub) and a count of rows by weight.

    A run holds the turns of run consecutive numbers; where they weigh over four
    times that, those of one number; where these do, a part of them by the upper
    bits of o, as many bits as bring a run to about its size.
    """
    base = turns.withColumn("slot", F.coalesce(F.col("turn") - F.pmod("turn", F.lit(run)), F.lit(-(2**62))))
    weight = F.sum(1 + F.floor(F.coalesce(F.octet_length("text"), F.lit(0)) / ROW_BYTES)).alias("weight")
    numbers = materialize(base.groupBy("c", "slot", "turn").agg(weight), "numbers")
    total = numbers.agg(F.sum("weight")).first()[0] or 0
    heavy = numbers.groupBy("c", "slot").agg(F.sum("weight").alias("all")).where(F.col("all") > 4 * run).select("c", "slot")
    bits = F.when(F.col("weight") > 4 * run, F.ceil(F.log2(F.col("weight") / run))).otherwise(0).cast("int")
    heavy = materialize(numbers.join(heavy, ["c", "slot"]).select("c", "turn", bits.alias("bits")), "heavy").alias("v")
    dealt = base.alias("t").join(heavy, (F.col("t.c") == F.col("v.c")) & F.col("t.turn").eqNullSafe(F.col("v.turn")), "left")
    part = F.when(F.col("bits").isNotNull(), F.coalesce(F.col("t.turn"), F.lit(-(2**62)))).otherwise(F.col("slot"))
    sub = F.when(F.col("bits") > 0, F.call_function("shiftright", F.col("o"), 64 - F.col("bits"))).otherwise(F.lit(0))
    return dealt.select("t.*", part.cast("long").alias("part"), sub.cast("long").alias("sub")).drop("slot"), total


def repair_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", run: int = RUN, fan: int = FAN
) -> DataFrame:
    """Repair the roles of every conversation and render it turn by turn.

    Returns a row per distinct turn: conv_id, turn, position hash o, role,
    new_role, action (keep, relabel, merge, merge_relabel), inserted and closing
    (roles of empty turns put in before it, or at the very end), cost, and
    rendered; the rendered pieces of a conversation in order of (turn, o) are
    its whole chat, which parse_chat() reads back. Texts are escaped, so that
    none of them holds a mark. Roles are compared in lower case without outer
    white space; others, and null, must be relabelled. Null texts render as
    empty. Turns without conv_id are conversations of their own. Null turns come
    first; equal turn numbers are ordered by a hash of role and text. Rows that
    repeat all four values are one turn. Of repairs of equal cost that with the
    fewest changed turns is taken, then one by a hash of the turns, so the result
    depends on neither run nor fan. Conversation ids and turns are cast to long
    (others fail). Texts pass as bytes, valid UTF-8 or not. Conversations may
    have any length and texts any size; a single text is in one row. Other
    columns are ignored, whatever their names. An empty table gives an empty
    result.
    """
    base = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).distinct()
    base = base.withColumn("o", F.xxhash64("role", "text")).withColumn("z", F.xxhash64(F.lit(5), "turn", "o"))
    base = base.withColumn("c", F.coalesce(F.col("conv_id").cast("string"), F.concat_ws("|", F.lit("none"), "turn", "o"))).withColumn("code", _code(F.lower(F.trim("role"))))
    dealt, total = deal(base.withColumns({"role": F.col("role").cast("binary"), "text": F.col("text").cast("binary")}), run)
    n = max(3 * int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-total // BUCKET_ROWS))
    bucket = lambda *by: F.pmod(F.xxhash64(*by), F.lit(n))
    dealt = dealt.select(bucket("c", "part", "sub").alias("b"), "c", "part", "sub", "turn", "o", "z", "code", "conv_id", "role", "text")
    # Up: one matrix a run, then one for each fan of them, while a conversation has more than fan.
    runs = dealt.drop("conv_id", "role", "text").groupBy("b").applyInArrow(_matrices, "c string, part long, sub long, m array<string>")
    along = Window.partitionBy("c").orderBy("part", "sub")
    runs = materialize(runs.withColumn("pos", (F.row_number().over(along) - 1).cast("long")).withColumn("last", F.lead("pos").over(along).isNull()), "runs")
    levels = [runs.select("c", "pos", "m")]
    most = lambda df: df.agg(F.max("pos")).first()[0] or 0
    up = F.floor(F.col("pos") / fan).cast("long").alias("up")
    while most(levels[-1]) >= fan:
        above = levels[-1].select("*", up).groupBy(bucket("c", "up")).applyInArrow(_products, "c string, pos long, m array<string>")
        levels.append(materialize(above, "level"))
    # Down: the states between the matrices, then each run by itself.
    kind = "c string, pos long, enter int, leave int"
    states = levels.pop().groupBy(bucket("c")).applyInArrow(_top, kind)
    while levels:
        states = levels.pop().select("*", up).groupBy(bucket("c", "up")).cogroup(states.groupBy(bucket("c", "pos"))).applyInArrow(_below, kind)
    states = runs.select("c", "pos", "part", "sub", "last").join(states, ["c", "pos"])
    fixed = dealt.groupBy("b").cogroup(states.groupBy(bucket("c", "part", "sub"))).applyInArrow(_repair, FIXED_DDL)
    fixed = fixed.withColumns({"role": F.col("role").cast("string"), "text": F.col("text").cast("string")})
    empty = lambda c: F.concat_ws("", F.transform(c, lambda r: F.concat(F.lit("<|"), r, F.lit("|>\n<|end|>\n"))))
    merged = F.col("action").startswith("merge")
    opening = F.concat(F.when(F.col("opens"), F.lit("")).otherwise(F.lit("<|end|>\n")), empty("inserted"), F.lit("<|"), F.col("new_role"), F.lit("|>\n"))
    ending = F.when(F.col("closes"), F.concat(F.lit("<|end|>\n"), empty("closing"))).otherwise(F.lit(""))
    body = F.coalesce(escaped(F.col("text")), F.lit(""))
    rendered = F.concat(F.when(merged, F.lit("\n")).otherwise(opening), body, ending)
    return fixed.select("conv_id", "turn", "o", "role", "new_role", "action", "inserted", "closing", "cost", rendered.alias("rendered"))


def op5_chat_format(spark, sf_dir):
    found = repair_chats(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "turn", "role", "new_role", "action", F.array_join("inserted", ",").alias("inserted"), F.array_join("closing", ",").alias("closing"), "cost", "rendered")
