"""Trie of all conversation prefixes by ROLLUP over positional columns of turn ids.

A conversation is one row for each block of its turns: the ids of the block's
turns in a column each, keyed by the node that the block before it ends at.
GROUP BY block, node, ROLLUP(turn columns) then aggregates all prefixes of all
conversations in one query, however long they are; grouping_id tells a
prefix's depth. Turn ids are 128-bit hashes of position, role and text, and a
node's id is the exclusive-or of those on its path, so the key of a block is a
running exclusive-or.

What a subtree sums up is again a sum over its members. The nodes whose
smallest member a conversation is are the last ones of its path, so it shares
the characters before them with a smaller conversation: these are what it
saves, in each subtree from that depth on. A second ROLLUP adds them up.

Only ids, lengths and hashes of turns are shuffled, never texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scan import group_starts, scan
from .shared import discard, join_counted, materialise, table

#: Turns, and pairs of columns, of a block.
SLOTS = 6
#: Ids of a node that are joined into one string before they meet the others.
CHUNK = 4096
#: Conversations that share the first turns of another: the one whose id ends in zeros.
GROUP, MOST_SHARED = 100, 6
NODE = ["node_hi", "node_lo"]


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, hi, lo, chars, row): a 128-bit id and the length in code points of each turn; rows without a conv_id are none."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(role, text).alias("hi"), F.xxhash64(F.lit("second"), text, role).alias("lo"),
        F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row"),
    )


def rebuilt(conversations: DataFrame, shared: Column | None = None) -> DataFrame:
    """(conv_id, position, hi, lo, chars): the turns of each conversation after its first ones were taken from its group's.

    ``shared`` says how many are taken, from the column conv_id; a conversation
    has a row without a position besides, so that one without turns is there.
    """
    shared = F.crc32(F.col("conv_id").cast("string")) % MOST_SHARED if shared is None else shared
    own = materialise(turns(conversations), "turns")
    placed = materialise(scan(own, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("hi"), F.col("lo"), F.col("row")], lambda d: materialise(d, "ordered"), "at"), "placed")
    first = F.collect_list(F.struct("at", "hi", "lo", "chars"))
    heads = placed.filter((F.col("conv_id") % GROUP == 0) & (F.col("at") < MOST_SHARED)).groupBy("conv_id").agg(first.alias("head"))
    known = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumns({"h": shared, "base": F.col("conv_id") - F.col("conv_id") % GROUP})
    known = known.join(heads.withColumnRenamed("conv_id", "base"), "base", "left")
    head = F.filter(F.coalesce("head", F.array().cast("array<struct<at:bigint,hi:bigint,lo:bigint,chars:bigint>>")), lambda t: t["at"] <= F.col("h"))
    known = materialise(known.select("conv_id", "n", "h", head.alias("head")), "conversations")
    moved = join_counted(placed, known.select("conv_id", "n", "h", F.size("head").alias("m")), ["conv_id"], own.count()).filter("at > h")
    moved = moved.select("conv_id", (F.col("at") - F.col("h") + F.col("m")).alias("position"), "hi", "lo", "chars")
    taken = known.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.at").alias("position"), "t.hi", "t.lo", "t.chars")
    there = known.select("conv_id", *(F.lit(None).cast("long").alias(c) for c in ("position", "hi", "lo", "chars")))
    return moved.unionByName(taken).unionByName(there)


def blocks(turns: DataFrame, slots: int) -> DataFrame:
    """(conv_id, block, key_hi, key_lo, before, hi0, lo0, c0, ...): a row for each block, with the node and the characters before it."""
    position = F.col("position") - 1
    ids = {"hi": F.xxhash64("position", "hi", "lo"), "lo": F.xxhash64(F.lit("second"), "lo", "position", "hi")}
    rows = turns.select("conv_id", F.coalesce(F.floor(position / slots), F.lit(0)).cast("long").alias("block"), (position % slots).alias("slot"), *(F.when(F.col("position").isNotNull(), c).alias(n) for n, c in ids.items()), "chars")
    cells = [F.max(F.when(F.col("slot") == i, F.col(c))).alias(f"{n}{i}") for i in range(slots) for n, c in (("hi", "hi"), ("lo", "lo"), ("c", "chars"))]
    whole = {"key_hi": F.bit_xor("hi"), "key_lo": F.bit_xor("lo"), "before": F.sum("chars")}
    wide = rows.groupBy("conv_id", "block").agg(*cells, *(F.coalesce(c, F.lit(0)).alias(n) for n, c in whole.items()))
    wide = materialise(wide, "wide")
    write = lambda d: materialise(d, "running")
    run = scan(wide, ["conv_id"], [F.col("block")], write, "__at", ("before",), ("key_hi", "key_lo"))
    own = lambda n: [F.coalesce(f"{n}{i}", F.lit(0)) for i in range(slots)]
    undo = {f"key_{n}": _xor([F.col(f"key_{n}"), *own(n)]) for n in ("hi", "lo")}
    return materialise(run.withColumns({**undo, "before": F.col("before") - sum(own("c"), F.lit(0))}).drop("__at"), "blocks")


def _xor(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out.bitwiseXOR(c)
    return out


def rolled_up(rows: DataFrame, slots: int, aggregates: str) -> DataFrame:
    """Every node as (block, key, turn columns, level) with ``aggregates`` over its members.

    A level above the block's own is a node of the block before; one whose last
    turn is missing holds the conversations that end earlier, which are members
    of the shorter prefix too.
    """
    sets = ", ".join(f"(hi{i}, lo{i})" for i in range(slots))
    level = f"{slots} - bit_count(grouping_id()) / 2"
    columns = ", ".join(f"hi{i}, lo{i}" for i in range(slots))
    query = f"SELECT block, key_hi, key_lo, {columns}, CAST({level} AS INT) AS level, {aggregates} FROM {{rows}} GROUP BY block, key_hi, key_lo, ROLLUP({sets})"
    nodes = rows.sparkSession.sql(query, rows=rows)
    return nodes.filter(F.when(F.col("level") == 0, F.col("block") == 0).otherwise(_at_level("hi", slots).isNotNull()))


def _at_level(name: str, slots: int) -> Column:
    """The column of the last turn of a node, NULL at level 0."""
    return F.coalesce(*(F.when(F.col("level") == i + 1, F.col(f"{name}{i}")) for i in range(slots)))


def _named(nodes: DataFrame, slots: int) -> DataFrame:
    """Node ids, and those of the parents (NULL for the root), in place of the turn columns."""
    names = {}
    for n in ("hi", "lo"):
        names[f"node_{n}"] = _xor([F.col(f"key_{n}"), *(F.coalesce(f"{n}{i}", F.lit(0)) for i in range(slots))])
        names[f"up_{n}"] = names[f"node_{n}"].bitwiseXOR(_at_level(n, slots))
    nodes = nodes.withColumns({**names, "depth": F.col("block") * slots + F.col("level")})
    return nodes.drop("key_hi", "key_lo", *(f"{n}{i}" for i in range(slots) for n in ("hi", "lo")))


def ends(rows: DataFrame, slots: int) -> DataFrame:
    """(conv_id, node_hi, node_lo, chars): the node of each whole conversation, and its characters."""
    own = {n: _xor([F.coalesce(f"{n}{i}", F.lit(0)) for i in range(slots)]) for n in ("hi", "lo")}
    chars = sum((F.coalesce(f"c{i}", F.lit(0)) for i in range(slots)), F.lit(0))
    return rows.groupBy("conv_id").agg(F.bit_xor(own["hi"]).alias("node_hi"), F.bit_xor(own["lo"]).alias("node_lo"), F.sum(chars).alias("chars"), F.count(F.lit(1)).alias("n"))


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of each node in a sorted range, joined by commas, at most CHUNK of them in a row."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        hi, lo, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        new, last = group_starts(batch, NODE, None)
        cuts = np.flatnonzero(new)
        long = np.diff(np.append(cuts, len(ids))) > CHUNK
        cuts = np.unique(np.concatenate([cuts, *(np.arange(a, b, CHUNK) for a, b, m in zip(cuts, np.append(cuts[1:], len(ids)), long) if m)]).astype(np.int64))
        text = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(cuts, np.append(cuts[1:], len(ids)))]
        yield pa.RecordBatch.from_pydict({"node_hi": hi[cuts], "node_lo": lo[cuts], "first": ids[cuts], "ids": text}, pa.schema([("node_hi", pa.int64()), ("node_lo", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's chunks in order, fed one by one."""
    schema = pa.schema([("node_hi", pa.int64()), ("node_lo", pa.int64()), ("ends_sha256", pa.string())])
    node, state = None, None
    for batch in batches:
        done = ([], [], [])
        for hi, lo, ids in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in (*NODE, "ids"))):
            if (hi, lo) == node:
                state.update(b"," + ids.encode())
                continue
            if node is not None:
                for column, value in zip(done, (*node, state.hexdigest())):
                    column.append(value)
            node, state = (hi, lo), hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_pydict(dict(zip(schema.names, done)), schema)
    if node is not None:
        yield pa.RecordBatch.from_pydict(dict(zip(schema.names, ([v] for v in (*node, state.hexdigest())))), schema)


def digests(ended: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes that conversations end at: their ids, ascending, joined by commas.

    Ids are sorted in ranges, so a node with a third of them is joined to
    chunks in many tasks; what one task feeds to a node's hash is a row for
    every CHUNK ids, and never held as a whole.
    """
    order = [*NODE, "conv_id"]
    ranged = ended.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = ranged.mapInArrow(_joined_ids, "node_hi long, node_lo long, first long, ids string")
    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_digests, "node_hi long, node_lo long, ends_sha256 string")


def prefix_trie(turns: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The trie of ``turns`` (conv_id, position from 1, hi, lo, chars); see ``op11_prefix_trie`` for the columns.

    The root has every conversation, one without turns too. No turns at all,
    no nodes. Conversations of any length and nodes with any share of all
    conversations are cut into many tasks.
    """
    rows = blocks(turns, slots)
    most = ", ".join(f"max(c{i}) AS c{i}" for i in range(slots))
    found = _named(rolled_up(rows, slots, f"min(conv_id) AS conv_id, count(1) AS n_convs, max(before) AS before, {most}"), slots)
    chars = F.coalesce(_at_level("c", slots), F.lit(0))
    upto = F.col("before") + sum((F.when(F.col("level") > i, F.col(f"c{i}")).otherwise(0) for i in range(slots)), F.lit(0))
    found = materialise(found.select(*NODE, "up_hi", "up_lo", "conv_id", "depth", "n_convs", (upto - chars).alias("above")), "found")
    kids = found.filter("up_hi IS NOT NULL").groupBy(F.col("up_hi").alias("node_hi"), F.col("up_lo").alias("node_lo")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialise(found.join(kids, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    # What each conversation shares with a smaller one, and whether its end is a leaf of its own.
    ended = materialise(ends(rows, slots), "ends")
    owned = nodes.groupBy("conv_id").agg(F.min("above").alias("above"), F.max((F.col("n_children") == 0).cast("int")).alias("leaf"))
    shares = ended.join(owned, "conv_id", "left").select("conv_id", F.coalesce("above", "chars").alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf"), "n")
    shares = materialise(shares, "shares")
    sharing = join_counted(rows, shares, ["conv_id"], ended.agg(F.sum("n")).first()[0] or 0)
    left, saved = F.col("shared") - F.col("before"), {}
    for i in range(slots):
        saved[f"s{i}"] = F.greatest(left, F.lit(0))
        left = left - F.coalesce(f"c{i}", F.lit(0))
    sums = ", ".join(f"sum(s{i}) AS s{i}" for i in range(slots))
    below = _named(rolled_up(sharing.withColumns(saved), slots, f"sum(leaf) AS n_leaves, {sums}"), slots)
    below = below.select(*NODE, "n_leaves", F.coalesce(_at_level("s", slots), F.col("s0")).alias("saved_tokens"))
    nothing = hashlib.sha256(b"").hexdigest()
    trie = nodes.drop("above").join(below, NODE).join(digests(ended), NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(nothing)))
    trie = materialise(trie, "trie")
    inner = nodes.filter("n_children > 0").select(F.col("node_hi").alias("up_hi"), F.col("node_lo").alias("up_lo"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    inner = materialise(inner, "inner")
    under = join_counted(trie.filter("up_hi IS NOT NULL"), inner, ["up_hi", "up_lo"], trie.count())
    out = under.drop("n").unionByName(trie.filter("up_hi IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long")))
    discard(rows, found, nodes, ended, shares)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", *NODE, "up_hi", "up_lo")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all prefixes of the rebuilt conversations, one row for each node.

    Turns go by ``turn``, null first, and turns of one number by the hash of
    role and text; repeated rows are turns of their own. Null roles and texts
    are empty. Rows without a conv_id belong to no conversation. The group of
    an id is ``conv_id - conv_id % 100``, the remainder with the id's sign. An
    empty table has no node.
    """
    out = prefix_trie(rebuilt(table(spark, sf_dir, "conversations")))
    return out.drop(*NODE, "up_hi", "up_lo")


# Paths as lists of turns; the check sum by its table of 256 remainders.
ORACLE = """
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
own AS (SELECT conv_id, list({'r': coalesce(role, ''), 'x': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, turns, conv_id - conv_id % 100 AS base, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda b: CAST(ascii(b) AS BIGINT))),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 6 AS h FROM own, crc),
built AS (SELECT a.conv_id, list_concat(coalesce(list_slice(b.turns, 1, a.h), []), list_slice(a.turns, a.h + 1, len(a.turns))) AS turns FROM h a LEFT JOIN own b ON a.base = b.conv_id),
hashed AS (SELECT conv_id, list_transform(turns, lambda t: concat(md5(t.r), md5(t.x))) AS path, list_transform(turns, lambda t: length(t.x)) AS chars FROM built),
prefix AS (SELECT conv_id, path, chars, unnest(range(0, len(path) + 1)) AS depth FROM hashed),
node AS (SELECT list_slice(path, 1, depth) AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN depth > 0 THEN chars[depth] ELSE 0 END) AS chars,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(path) = depth), '')) AS ends_sha256 FROM prefix GROUP BY 1, 2),
kids AS (SELECT list_slice(p, 1, depth - 1) AS p, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
full_node AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids ON node.p = kids.p),
up AS (SELECT p, unnest(range(0, depth + 1)) AS d, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * chars AS saved FROM full_node),
below AS (SELECT list_slice(p, 1, d) AS p, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_node n JOIN below b ON n.p = b.p LEFT JOIN full_node q ON n.depth > 0 AND q.p = list_slice(n.p, 1, n.depth - 1)
"""
