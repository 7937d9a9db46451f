"""Prefix trie of conversations, built level by level and rolled up backwards.

Conversations are known by a 128-bit hash of each turn's role and text; texts are
read once, to be hashed and counted. Turns are numbered, and their code points
added up, over ranges of (conversation, turn): a range holds part of a long
conversation or many short ones, and only a row per range is summed across
ranges. Conversations whose turns are all equal are one, with a weight.

Then conversations go down the trie together. In a round, all that are at one
node first pass the turns they all share - one grouping by (node, depth) tells
how far that is - and are then grouped by (node, next turn); each group is a node
at the next depth, named by its smallest conversation. So a round does as many
levels as nobody branches at, and there are as many rounds as branchings on a
path. A conversation that is alone at its node leaves: its remaining turns are
one path. What is kept is a row per path (first to last depth, all with the same
members). Backwards through the rounds, joins roll up leaves and savings from
paths to the paths they hang from, and at the end every depth of a path becomes a
row. All rounds are written to the shared folder.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

IDS_A_PIECE = 4096  # ids that are written to one string on the way to a digest
STEP = 1 << 12  # depths of a path that one row lays out
BLOCK, MOST_SHARED = 100, 6
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_hash(role, text):
    """128 bits, as hex; the role's length keeps the two apart."""
    return F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))


def ranges_of(df: DataFrame, *order: str) -> DataFrame:
    """df in ranges of order, sorted; a range per shuffle partition."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    by = [F.col(c).asc_nulls_first() for c in order]
    return df.repartitionByRange(parts, *by).sortWithinPartitions(*by)


def _number(batches):
    """Rows (conv, turn, key, chars) in order to (part, conv, k, key, sum): place in and code points of the conversation so far, within the range."""
    part, last, k, total = TaskContext.get().partitionId(), None, 0, 0
    for b in batches:
        ks, sums = [], []
        convs = b["conv"].to_pylist()
        for conv, chars in zip(convs, b["chars"].to_pylist()):
            if conv != last:
                last, k, total = conv, 0, 0
            k += 1
            total += chars
            ks.append(k)
            sums.append(total)
        columns = {"part": pa.array([part] * len(ks), pa.int32()), "conv": b["conv"], "k": pa.array(ks, pa.int64()), "key": b["key"], "sum": pa.array(sums, pa.int64())}
        yield pa.RecordBatch.from_pydict(columns)


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv, k, key, sum) from (conv, turn, key, chars): places from 1 by turn (null first), and code points up to and with the turn.

    Rows of one turn are in the order of their keys, rows that are equal in all in
    any. Each range is numbered by itself, and what earlier ranges hold of its
    first conversation is added; that is a row per range.
    """
    written = materialize(turns.withColumn("odd", F.xxhash64(F.monotonically_increasing_id())), "turns")
    ranged = ranges_of(written, "conv", "turn", "key", "odd").select("conv", "key", "chars")
    local = materialize(ranged.mapInArrow(_number, "part int, conv long, k long, key string, sum long"), "ranges")
    ends = local.groupBy("conv", "part").agg(F.max("k").alias("k"), F.max("sum").alias("sum"))
    bounds = local.groupBy("part").agg(F.min("conv").alias("first"), F.max("conv").alias("last"))
    # Only the last conversation of a range can go on in the next.
    ends = ends.join(bounds, "part").where("conv = last or conv = first").select("part", "conv", "k", "sum")
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("part", "conv", F.sum("k").over(earlier).alias("k0"), F.sum("sum").over(earlier).alias("s0")).where("k0 > 0")
    carried = materialize(carried, "carried")
    full = local.join(carried, ["part", "conv"], "left")
    return full.select("conv", (F.col("k") + F.coalesce("k0", F.lit(0))).alias("k"), "key", (F.col("sum") + F.coalesce("s0", F.lit(0))).alias("sum"))


def rebuilt(numbered: DataFrame, convs: DataFrame, block: int, most_shared: int) -> DataFrame:
    """(conv, pos, key, sum): the first h turns of the block's first conversation, then what the conversation has after its own first h."""
    shared = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(most_shared)).alias("h")
    base = F.col("conv") - F.col("conv") % block
    heads = materialize(numbered.where((F.col("conv") % block == 0) & (F.col("k") < most_shared)).select(F.col("conv").alias("base"), "k", "key", "sum"), "heads")
    whole = heads.groupBy("base").agg(F.sort_array(F.collect_list(F.struct("k", "sum"))).alias("ends"))  # fewer than most_shared each
    start = convs.select("conv", base.alias("base"), shared).join(whole, "base", "left")
    taken = F.least("h", F.coalesce(F.size("ends"), F.lit(0)))
    start = start.select("conv", "base", "h", taken.cast("long").alias("taken"), F.when(taken > 0, F.element_at("ends", taken.cast("int"))["sum"]).otherwise(F.lit(0)).alias("taken_sum"))
    own_head = numbered.where(F.col("k") < most_shared).select("conv", "k", F.col("sum").alias("own_sum"))
    # What a conversation has of its own before the first turn that it keeps.
    start = start.join(own_head.withColumnRenamed("k", "h"), ["conv", "h"], "left")
    start = materialize(start.withColumn("own_sum", F.coalesce("own_sum", F.lit(0))), "starts")
    first = start.select("conv", "base", "taken").join(heads, "base").where(F.col("k") <= F.col("taken")).select("conv", F.col("k").alias("pos"), "key", "sum")
    rest = numbered.join(start.select("conv", "h", "taken", "taken_sum", "own_sum"), "conv").where(F.col("k") > F.col("h"))
    rest = rest.select("conv", (F.col("k") - F.col("h") + F.col("taken")).alias("pos"), "key", (F.col("sum") - F.col("own_sum") + F.col("taken_sum")).alias("sum"))
    return first.union(rest)


def classes_of(turns: DataFrame, convs: DataFrame):
    """(members: rep, conv; classes: rep, w, size): conversations whose turns are all equal, by their smallest."""
    marks = [F.bit_xor(F.xxhash64(*c)).alias(f"f{i}") for i, c in enumerate((("pos", "key"), (F.lit(7), "key", "pos")))]
    prints = turns.groupBy("conv").agg(F.count("*").alias("size"), *marks)
    prints = convs.join(prints, "conv", "left").select("conv", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("size", "f0", "f1")])
    prints = materialize(prints, "prints")
    classes = materialize(prints.groupBy("size", "f0", "f1").agg(F.min("conv").alias("rep"), F.count("*").alias("w")), "classes")
    members = prints.join(classes, ["size", "f0", "f1"]).select("rep", "conv")
    return materialize(members, "members"), classes.select("rep", "w", "size")


def _pieces(batches):
    """Rows (rep, conv) in order to (rep, conv: the first, ids): up to IDS_A_PIECE ids, comma-joined."""
    rep, ids = None, []
    out = []

    def cut():
        if ids:
            out.append((rep, ids[0], ",".join(map(str, ids))))
            ids.clear()

    for b in batches:
        for r, c in zip(b["rep"].to_pylist(), b["conv"].to_pylist()):
            if r != rep or len(ids) == IDS_A_PIECE:
                cut()
            rep = r
            ids.append(c)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))], ["rep", "conv", "ids"])
            out.clear()
    cut()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))], ["rep", "conv", "ids"])


def _digests(batches):
    """Pieces in order to (rep, ends): one digest goes on from piece to piece."""
    rep, digest = None, None
    for b in batches:
        done = []
        for r, ids in zip(b["rep"].to_pylist(), b["ids"].to_pylist()):
            if digest is None or r != rep:
                if digest is not None:
                    done.append((rep, digest.hexdigest()))
                rep, digest = r, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["rep", "ends"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([digest.hexdigest()])], ["rep", "ends"])


def digests_of(members: DataFrame) -> DataFrame:
    """(rep, ends): SHA-256 of the members' ids, ascending, comma-joined.

    The ids of any number of members are joined where their ranges lie; a task
    that ends a digest gets a row for IDS_A_PIECE ids and keeps the digest only.
    """
    pieces = ranges_of(members, "rep", "conv").mapInArrow(_pieces, "rep long, conv long, ids string")
    return pieces.repartition("rep").sortWithinPartitions("rep", "conv").select("rep", "ids").mapInArrow(_digests, "rep long, ends string")


def grow(turns: DataFrame, classes: DataFrame) -> list[DataFrame]:
    """Paths by rounds, from the root down.

    A path: id (smallest member, one path of a round has it), first and last
    depth, n members, parent (the path of the round before that it hangs from),
    end (the class that ends at its last depth, if any), sum0 and sum1 (code
    points before its first turn and up to its last).
    """
    root = classes.agg(F.min("rep")).first()[0]
    if root is None:
        return []
    live = materialize(classes.select("rep", "w", "size", F.lit(root).cast("long").alias("id"), F.lit(0).cast("long").alias("first")), "live")
    groups = live.groupBy("id", "first").agg(F.sum("w").alias("n"), F.count("*").alias("reps"))
    groups = materialize(groups.withColumns({"parent": F.lit(None).cast("long"), "sum0": F.lit(0).cast("long")}), "groups")
    by_rep, single = turns.withColumnRenamed("conv", "rep"), classes.select(F.col("rep").alias("id"), "size")
    at_last = turns.select(F.col("conv").alias("id"), F.col("pos").alias("last"), F.col("sum").alias("sum1"))
    rounds = []
    while not groups.isEmpty():
        # Where the turns that all at a node have alike end; one that is alone goes to its end.
        ahead = by_rep.select("rep", "pos", "key").join(live.select("rep", "id", "first"), "rep").where("pos > first")
        alike = ahead.groupBy("id", "pos").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.count("*").alias("m")).join(groups.select("id", "reps"), "id")
        stops = alike.where("a <> b or m < reps").groupBy("id").agg((F.min("pos") - 1).alias("last"))
        stops = groups.join(stops, "id", "left").join(single, "id").withColumn("last", F.coalesce("last", "size")).drop("size")
        stops = materialize(stops, "stops")
        here = live.join(stops.select("id", "last"), "id")
        ended = here.where("size = last").select("id", F.col("rep").alias("end"))
        paths = stops.join(ended, "id", "left").join(at_last, ["id", "last"], "left")
        paths = paths.select("id", "first", "last", "parent", "n", "end", "sum0", F.coalesce("sum1", F.lit(0)).alias("sum1"))
        rounds.append(materialize(paths, "paths"))
        # The next depth: groups by (parent node, next turn).
        moved = here.where("size > last").select("rep", "w", "size", F.col("id").alias("parent"), (F.col("last") + 1).alias("pos"))
        moved = materialize(moved.join(by_rep.select("rep", "pos", "key"), ["rep", "pos"]), "moved")
        names = moved.groupBy("parent", "pos", "key").agg(F.min("rep").alias("id"), F.sum("w").alias("n"), F.count("*").alias("reps"))
        names = materialize(names.join(rounds[-1].select(F.col("id").alias("parent"), F.col("sum1").alias("sum0")), "parent"), "names")
        live = moved.join(names.select("parent", "pos", "key", "id"), ["parent", "pos", "key"]).select("rep", "w", "size", "id", F.col("pos").alias("first"))
        live = materialize(live, "live")
        groups = names.withColumnRenamed("pos", "first").drop("key")
    return rounds


def roll_up(rounds: list[DataFrame]) -> DataFrame:
    """All paths with kids, leaves, below (savings behind their last depth), from the last round back to the root."""
    done: list[DataFrame] = []
    for paths in reversed(rounds):
        total = (F.col("n") - 1) * (F.col("sum1") - F.col("sum0")) + F.col("below")
        sums = {"kids": F.lit(0), "leaves": F.lit(1), "below": F.lit(0)}
        if done:
            hung = done[-1].groupBy("parent").agg(F.count("*").alias("kids"), F.sum("leaves").alias("leaves"), F.sum(total).alias("below"))
            paths = paths.join(hung.withColumnRenamed("parent", "id"), "id", "left")
            sums = {c: F.coalesce(c, x) for c, x in sums.items()}
        done.append(materialize(paths.withColumns({c: x.cast("long") for c, x in sums.items()}), "rolled"))
    out = done[0]
    for paths in done[1:]:
        out = out.unionByName(paths)
    return out


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of conversations.

    turns: (conv, pos, key, sum) - turn pos (from 1, without gaps) of conversation
    conv, known by its key, and the code points up to and with it; equal prefixes
    have equal keys and sums. convs: (conv), distinct; some may have no turns.
    Returns a row per distinct sequence of first d turns, from the root (d = 0,
    all conversations): conv_id (the smallest of its members), depth,
    parent_conv_id (its parent's conv_id; null for the root), n_convs,
    n_children, n_leaves (nodes without children in its subtree, itself
    included), saved_tokens (over the subtree, itself included, members but one
    times the code points of a node's last turn), ends_sha256 (of the members
    that end there, ascending, comma-joined). No conversations give no nodes.
    """
    members, classes = classes_of(turns, convs)
    rounds = grow(turns, classes)
    if not rounds:
        none = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
        return turns.sparkSession.createDataFrame([], none)
    paths = roll_up(rounds).join(digests_of(members).withColumnRenamed("rep", "end"), "end", "left")
    depths = F.sequence("start", F.least(F.col("start") + (STEP - 1), "last"))
    nodes = paths.withColumn("start", F.explode(F.sequence("first", "last", F.lit(STEP).cast("long")))).withColumn("depth", F.explode(depths)).drop("start")
    nodes = materialize(nodes, "nodes")
    # A node that one conversation has saves nothing; for the others code points before the node are needed.
    sums = turns.select(F.col("conv").alias("id"), (F.col("pos") + 1).alias("depth"), F.col("sum").alias("before"))
    many = nodes.where("n > 1").join(sums, ["id", "depth"], "left").select(*nodes.columns, "before")
    found = many.union(nodes.where("n = 1").withColumn("before", F.lit(None).cast("long")))
    at_first, at_last = F.col("depth") == F.col("first"), F.col("depth") == F.col("last")
    before = F.when(at_first, F.col("sum0")).otherwise(F.coalesce("before", F.lit(0)))  # nothing before depth 1
    saved = F.when(F.col("n") > 1, (F.col("n") - 1) * (F.col("sum1") - before) + F.col("below")).otherwise(F.lit(0))
    return found.select(
        F.col("id").alias("conv_id"), "depth", F.when(at_first, F.col("parent")).otherwise(F.col("id")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(at_last, F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        saved.cast("long").alias("saved_tokens"), F.when(at_last & F.col("ends").isNotNull(), F.col("ends")).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )


def conversation_trie(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int | None = None, most_shared: int = MOST_SHARED
) -> DataFrame:
    """The prefix trie of conversations in rows of turns; the columns of prefix_trie.

    Turns are equal if role and text are (a null is an empty text), and go by turn
    (null first); turns of one number by a hash of role and text, so any order of
    the rows gives one result. Repeated rows are turns of their own. Rows with a
    null conversation id are left out. Ids are cast to long, turn numbers too. A
    conversation of any length is dealt over ranges. Other columns are ignored,
    whatever their names. An empty table gives an empty result.

    With block, conversations are rebuilt first: c begins with the first h turns of
    c - c % block (all of them if there are fewer, none if that is absent), and
    its own turns after its first h follow; h = crc32(decimal c) % most_shared.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col)]
    turns = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), turn_hash(*text).alias("key"), F.char_length(text[1]).cast("long").alias("chars")
    )
    turns = materialize(numbered_turns(turns), "numbered")
    convs = materialize(turns.select("conv").distinct(), "convs")
    if block:
        turns = materialize(rebuilt(turns, convs, block, most_shared), "rebuilt")
    else:
        turns = turns.withColumnRenamed("k", "pos")
    return prefix_trie(turns, convs)


def op12_conversation_trie(spark, sf_dir):
    return conversation_trie(table(spark, sf_dir, "conversations"), block=BLOCK)


# The CRC is worked out bit by bit: after each byte (0 or more) eight shifts (-1).
ORACLE = """
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(length(role), ':', role, text))) AS k
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
b AS (SELECT conv_id, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])) AS ops
  FROM (SELECT DISTINCT conv_id FROM t)),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(list_reduce(ops, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END, CAST(4294967295 AS BIGINT)), 4294967295) % 6 AS h FROM b),
s AS (SELECT conv_id, count(*) AS size FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, t.k AS pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.k <= c.h
  UNION ALL SELECT c.conv_id, t.k - c.h + least(c.h, coalesce(s.size, 0)), t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.k > c.h LEFT JOIN s ON s.conv_id = c.base),
l AS (SELECT c.conv_id, coalesce(list({'role': role, 'text': text} ORDER BY pos) FILTER (pos IS NOT NULL), []) AS seq FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
p AS (SELECT conv_id, d, seq[1:d] AS pre, len(seq) AS size, CASE WHEN d > 0 THEN length(seq[d].text) ELSE 0 END AS chars FROM (SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS d FROM l)),
n AS (SELECT d, pre, min(conv_id) AS id, count(*) AS n, any_value(chars) AS chars, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends FROM p GROUP BY d, pre),
k AS (SELECT a.d, a.pre, count(*) AS kids FROM n a JOIN n x ON x.d = a.d + 1 AND x.pre[1:a.d] = a.pre GROUP BY a.d, a.pre),
m AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k ON n.d = k.d AND n.pre = k.pre),
u AS (SELECT up, pre[1:up] AS top, kids, n, chars FROM (SELECT *, unnest(range(d + 1)) AS up FROM m)),
v AS (SELECT up, top, count(*) FILTER (kids = 0) AS leaves, sum((n - 1) * chars) AS saved FROM u GROUP BY up, top)
SELECT m.id AS conv_id, CAST(m.d AS BIGINT) AS depth, q.id AS parent_conv_id, CAST(m.n AS BIGINT) AS n_convs, CAST(m.kids AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, m.ends AS ends_sha256
FROM m JOIN v ON v.up = m.d AND v.top = m.pre LEFT JOIN n q ON q.d = m.d - 1 AND q.pre = m.pre[1:m.d - 1] AND m.d > 0
"""
