"""Hard negatives against a plain loop over all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    valid = []
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        valid.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in e]))
    clip = lambda s: max(min(s, 2**63 - 1), -(2**63))
    out, anchors = [], {}
    for i, label, e in sorted(valid, key=lambda r: (r[1], r[2])):
        if i % 50 == 0:
            anchors.setdefault(i, (label, e))
    for a, (label, e) in anchors.items():
        scored = sorted((-clip(sum(x * y for x, y in zip(e, f))), i, same == label) for i, same, f in valid if i != a)
        for s, p, _ in [t for t in scored if t[2]][:5]:
            found = [(n, t) for t, n, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, p, k + 1, n, -s, -t) for k, (n, t) in enumerate(found)]
    return sorted(out)


def vectors():
    """Few directions, so that scores tie; gaps, repeated ids and rows, anchors alone in their label, short and empty vectors."""
    rng, rows = random.Random(3), []
    pool = [[rng.choice([-0.5, 0.0, 0.25, 1.0, 1.003]) for _ in range(4)] for _ in range(60)]
    for i in range(400):
        rows.append((i, pool[i % 60] if i % 3 else [rng.uniform(-1, 1) for _ in range(4)], rng.randrange(4)))
    rows += [(1000, [0.5, 0.5, 0.5, 0.5], 77), (1050, [0.0] * 4, 1), (1100, [], 2), (1150, [1.0, 1.0], 1), (-50, [0.9, -0.4, 0.2, 0.1], 1), (-7, [0.9] * 4, 3)]
    rows += [(None, [1.0] * 4, 1), (None, None, None), (5, None, 1), (6, [1.0, None, 1.0, 1.0], 1), (8, [1.0] * 4, None), (9, [float("nan")] * 4, 1), (11, [float("inf"), 0.0, 0.0, 0.0], 1)]
    rows += [rows[50], rows[50], rows[51], rows[51], (100, [0.1, 0.2, 0.3, 0.4], 3)]
    rng.shuffle(rows)
    return rows


def got(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("rows_at_once, anchor_bytes", [(2048, 32 << 20), (7, 200)])
def test_negatives_follow_brute_force(spark, rows_at_once, anchor_bytes):
    """In one block, and in many small ones with anchors in several parts."""
    df = spark.createDataFrame(vectors(), SCHEMA).withColumns({c: F.lit("x") for c in ("vector", "key", "id", "score", "f")}).repartition(3)
    rows = hard_negatives.vectors(df)
    found = got(hard_negatives.mine(rows, hard_negatives.anchors_of(rows), anchor_bytes, rows_at_once))
    assert found == brute(vectors()) and len(found) > 50


def test_scores_of_any_size_are_exact():
    rng = random.Random(5)
    for size in (1, 2**20, 2**40, 2**70):
        a, b = ([[float(rng.randint(-size, size)) for _ in range(3)] for _ in range(4)] for _ in range(2))
        want = [[max(min(sum(int(x) * int(y) for x, y in zip(p, q)), 2**63 - 1), -(2**63)) for q in b] for p in a]
        assert hard_negatives.scores(np.array(a), np.array(b)).tolist() == want


@pytest.mark.parametrize("size", [10, 2**55])
def test_first_by_score_then_place(size):
    rng = np.random.default_rng(1)
    found, allowed = rng.integers(-3, 4, (20, 9)) * size, rng.random((20, 9)) < 0.6
    for row, ok, columns in zip(found, allowed, hard_negatives._first(found, allowed, 4)):
        want = sorted(np.flatnonzero(ok), key=lambda j: (-row[j], j))[:4]
        assert columns.tolist() == want + [-1] * (4 - len(want))


def test_keys_sort_as_their_pairs_do():
    pairs = [(a, s, n, i) for a in (-50, 0, 50) for s in (-(2**63), -1, 0, 7, 2**63 - 1) for n in (False, True) for i in (-2, 0, 3)]
    keys = [hard_negatives.pack(np.array([a]), np.array([s]), n, np.array([i])).column(0)[0].as_py() for a, s, n, i in pairs]
    assert [hard_negatives.unpack(k) for k in keys] == pairs
    assert [hard_negatives.unpack(k) for k in sorted(keys)] == sorted(pairs, key=lambda p: (p[0], -p[1], p[2], p[3]))


def test_no_rows_and_no_anchors(spark):
    for rows in ([], [(1, [1.0], 1), (2, [1.0], 2)], [(50, [1.0], 1)]):
        v = hard_negatives.vectors(spark.createDataFrame(rows, SCHEMA))
        assert hard_negatives.mine(v, hard_negatives.anchors_of(v)).count() == 0
