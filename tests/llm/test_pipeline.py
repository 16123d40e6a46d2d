"""The stages of the corpus pipeline, each on what the one before it kept, and all of them against a brute-force version."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinelake.llm import queries, toxicity

from .test_operators import brute_components, shingles, water

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, times string, __times string, run string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Toxic documents, copies, near copies, leaks, rows without an id or a text, rows that repeat, ids that two texts share."""
    path = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(6)
    text = lambda k: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(k))
    leak, more = text(40), ("kept", None, "x")
    rows = [(i, text(rng.randint(30, 90)) + (" foulword foulword" if i % 5 == 0 else ""), "en", f"s{i % 3}", 0, *more) for i in range(300)]
    rows += [(1000, rows[1][1], "en", "s0", 0, *more), (1001, rows[2][1] + " more", "de", None, 0, *more), (1002, text(20) + " " + leak + " " + text(9), "en", "s1", 0, *more)]
    rows += [(1003, None, None, None, None, *more), (1004, "", "en", "s1", 0, *more), (None, text(50), "en", "s2", 0, *more), (None, text(60), "en", "s2", 0, *more)]
    rows += [rows[3], (4, text(45), "en", "s1", 0, *more), (None, None, None, None, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] % 5 == 0)) for r in rows[:300]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, leak


def test_stages_keep_columns_and_decide(spark, folder, tmp_path):
    path, rows, _ = folder
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    ids = lambda name: [i for i in kept[name] if i is not None and i < 300]
    assert sum(i % 5 == 0 for i in ids("toxicity")) <= 6 and sum(i % 5 != 0 for i in ids("toxicity")) >= 230
    assert not {1000, 1001} & set(kept["near_dedup"]) and {1, 2, 1003, 1004} <= set(kept["near_dedup"])
    # Rows without an id: two texts and none; rows that repeat: one; one id with two texts: both.
    assert kept["near_dedup"].count(None) == 3 and kept["near_dedup"].count(3) == 1 and kept["near_dedup"].count(4) == 2
    assert set(kept["near_dedup"]) - set(kept["decontamination"]) == {1002}
    assert set(kept["mixing"]) <= set(kept["decontamination"]) and {1, 2} & set(Counter(i for i in kept["mixing"] if i != 4).values()) == {1, 2} and None in kept["mixing"]
    assert Counter(kept["sharding"]) == Counter(kept["mixing"])


def brute_run(spark, path, rows, leak):
    """What run() returns, as counted (doc_id, digest), by plain loops; the scorer is trained as the stage does it."""
    docs = spark.read.parquet(f"{path}/documents.parquet")
    scorer = toxicity.train_scorer(docs, spark.read.parquet(f"{path}/labels.parquet"))
    import pyarrow as pa

    scores = scorer.scores(pa.array([r[1] for r in rows], pa.string()))
    rows = [r for r, s in zip(rows, scores) if s < scorer.thresholds.get(str(r[2]), 0.7)]
    sets = {i: shingles(r[1] or "") for i, r in enumerate(rows)}
    first = brute_components(sets)
    rows = [r for i, r in enumerate(rows) if first[i] == i]
    words = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    grams = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    weigh = lambda c: sum(n * sum(map(len, g)) for g, n in c.items())
    item = words(leak)

    def leaks(t):
        w, g = words(t), grams(item)
        n = min(len(w), len(item))
        found = [grams(w[k : k + n]) for k in range(len(w) - n + 1)] if n >= 5 else []
        return any(weigh(x & g) >= 0.8 * weigh(x | g) for x in found)

    rows = [r for r in rows if not leaks(r[1])]
    size = [len((r[1] or "").split()) for r in rows]
    by = defaultdict(list)
    for i, r in enumerate(rows):
        by[r[3]].append(i)
    order = sorted(s for s in by if s is not None) + ([None] if None in by else [])
    total = {s: sum(size[i] for i in by[s]) for s in order}
    target = water(total, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5, 2)
    return rows, size, by, total, target


def test_run_follows_brute_force(spark, folder):
    path, rows, leak = folder
    got = corpus_pipeline.run(spark, path).collect()
    kept, size, by, total, target = brute_run(spark, path, rows, leak)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    taken = Counter((r.doc_id, r.text_sha256) for r in got)
    assert set(taken) <= {(r[0], digest(r[1])) for r in kept}
    for s, own in by.items():
        times = [taken[kept[i][0], digest(kept[i][1])] for i in own]
        whole = int(target[s] // total[s]) if total[s] else 0
        # Every document whole times, some once more, and the words near the target.
        assert all(t in ((whole, whole + 1) if size[i] else (0,)) for t, i in zip(times, own))
        assert abs(sum(t * size[i] for t, i in zip(times, own)) - target[s]) <= max(size[i] for i in own)
    assert all(r.shard and r.shard_bytes > 0 for r in got)


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_scratch_is_deleted_at_the_end(spark):
    from kinelake.llm.shared import discard, materialise

    made = materialise(spark.range(3).withColumn("x", F.lit(1)), "made")
    assert made.count() == 3 and "/scratch-" in made._scratch
    discard(made)
    assert not spark._jvm.java.io.File(made._scratch.replace("file://", "")).exists()


def test_every_operator_has_one_query():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")] == list(range(1, 14))
