"""The trie of conversation prefixes against a plain one of lists."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kinelake.llm import prefix_trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h, rest = zlib.crc32(str(c).encode()) % 6, abs(c) % 100
        built[c] = own.get(c - rest if c >= 0 else c + rest, [])[:h] + v[h:]
    members, children, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p in members:
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
            leaves[p[:d]] += not children[p]
    digest = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(built[c]) == len(p)).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], digest(p)) for p, m in members.items()), key=str)


def conversations():
    """Shared beginnings, copies, gaps in ids and groups, nulls, turns in any order, repeated rows, a long conversation and one that fills all blocks."""
    rng, rows = random.Random(4), []
    turn = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["a", "", None, "b" * 40, "éü" * 3]))
    for c in [*range(0, 40), *range(200, 215), *range(-30, -20), -100, 301, 305, 399]:
        rows += [(c, t, *turn()) for t in range(rng.randint(1, 9))]
    rows += [(1000, t, "user", str(t % 7)) for t in range(300)]
    rows += [(1050 + k, t, "user", str(t % 7)) for k in range(8) for t in range(12)]
    rows += [(7, None, "system", "first"), (None, 0, "user", "of none"), (None, None, None, None)]
    rows += [(2000, 1, "user", "again"), (2000, 1, "user", "again"), (2001, 3, "user", "again")]
    rng.shuffle(rows)
    return rows


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.mark.parametrize("slots", [2, 6])
def test_nodes_follow_brute_force(spark, slots):
    df = spark.createDataFrame(conversations(), SCHEMA).withColumns({c: F.lit("x") for c in ("hi", "at", "n", "block", "level", "c0")}).repartition(5)
    assert got(prefix_trie.prefix_trie(prefix_trie.rebuilt(df), slots)) == brute(conversations())


def test_a_common_conversation_is_in_many_tasks(spark, monkeypatch):
    """Most conversations alike, so that one node has most members and ends, in chunks of ids."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 16)
    rows = [(c, t, "user", "same" if c % 10 else f"{c} {t}") for c in range(400) for t in range(3)] + [(c, 0, None, None) for c in range(500, 700)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(4)
        built = prefix_trie.rebuilt(df)
        assert got(prefix_trie.prefix_trie(built)) == brute(rows)
        ended = prefix_trie.ends(prefix_trie.blocks(built, 6), 6)
        assert got(prefix_trie.prefix_trie(built, 3)) == brute(rows)
        assert ended.count() == 600
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_conversations(spark):
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(spark.createDataFrame([], SCHEMA))).count() == 0
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA))).count() == 0


def test_conversations_without_turns_are_members_of_the_root(spark):
    rows = [(c, 0, "user", "one turn") for c in range(101, 160)]  # their group's first conversation is missing
    assert got(prefix_trie.prefix_trie(prefix_trie.rebuilt(spark.createDataFrame(rows, SCHEMA)))) == brute(rows)
