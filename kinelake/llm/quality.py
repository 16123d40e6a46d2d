"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or nothing on every whole text.
Expectation-maximisation over the counts of vote patterns estimates how often
each heuristic is right, without any true label; the posterior labels of a
bounded sample then train a linear scorer over hashed words and word shapes,
which scores every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_schema, first_by_hash, materialise, table
from .text import Words, column, token_batches, tokenize

LABELLERS = ("symbols", "repetition", "capitals", "length", "sentences", "separators", "variety", "letters", "wordless")
BUCKETS = 1 << 18
#: What labellers start from, as wrong about 1 in 100 good texts and as finding a third of the bad ones, counts as much as so many votes.
START, START_VOTES = (0.35, 0.01), 20
#: Words among which the distinct ones are counted: variety within stretches doesn't fall with a text's length.
STRETCH = 100
VOTES = "doc_id long, " + ", ".join(f"{n} byte" for n in LABELLERS)
RESULT = "doc_id long, score double, kept boolean"

_ASCII = [chr(b) if b < 128 else "a" for b in range(256)]
_LETTER = np.array([c.isalpha() for c in _ASCII])
_NUMBER = np.array([c.isdigit() for c in _ASCII])
_UPPER = np.array([c.isupper() for c in _ASCII])
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#$%&*~^<>{}[]\\_=+!@", np.uint8))
_END = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))
_BAR = np.isin(np.arange(256), np.frombuffer(b"|;\t", np.uint8))
#: The shape of a byte: A, a, 0, or itself.
_SHAPE = np.array([ord("A") if _UPPER[b] else ord("a") if _LETTER[b] else ord("0") if chr(b).isdigit() else b for b in range(256)], np.uint8)


def _per_doc(words: Words, values: np.ndarray) -> np.ndarray:
    return np.bincount(words.doc_of_word(), values, len(words.bounds) - 1)


def _spread(words: Words, member: np.ndarray) -> np.ndarray:
    """How many bytes of a kind each word has."""
    total = np.concatenate([[0], np.cumsum(member[words.data])])
    return total[words.ends] - total[words.starts]


def _repeats(words: Words) -> np.ndarray:
    """Whether a word equals the one before it in its document."""
    out = np.zeros(len(words.hashes), bool)
    out[1:] = words.hashes[1:] == words.hashes[:-1]
    out[words.bounds[:-1][words.counts > 0]] = False
    return out


def _vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.where(bad, -1, np.where(good, 1, 0)).astype(np.int8)


def votes(words: Words) -> np.ndarray:
    """1 good, -1 bad, 0 no vote: a row for each document, a column for each labeller."""
    n = words.counts.astype(float)
    least = np.maximum(n, 1)
    letters = np.maximum(_per_doc(words, _spread(words, _LETTER)), 1)
    size = np.maximum(_per_doc(words, words.ends - words.starts), 1)
    symbols = _per_doc(words, _spread(words, _SYMBOL)) / size
    repeats = _per_doc(words, _repeats(words)) / least
    capitals = _per_doc(words, _spread(words, _UPPER)) / letters
    ends = np.zeros(len(words.hashes))
    if len(ends):
        ends = _END[words.data[words.ends - 1]].astype(float)
    sentences = _per_doc(words, ends) / least
    bars = _per_doc(words, _spread(words, _BAR) > 0) / least
    distinct = np.zeros(len(n))
    if len(words.hashes):
        doc = words.doc_of_word()
        piece = (np.arange(len(doc)) - words.bounds[:-1][doc]) // STRETCH
        order = np.lexsort((words.hashes, piece, doc))
        h, q, d = words.hashes[order], piece[order], doc[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (q[1:] != q[:-1]) | (d[1:] != d[:-1])])
        distinct = np.bincount(d, new, len(n))
    variety = distinct / least
    some = n >= 20
    share = letters / size
    wordless = _per_doc(words, _spread(words, _LETTER | _NUMBER) == 0) / least
    return np.stack([
        _vote(symbols < 0.01, symbols > 0.04),
        _vote((repeats < 0.03) & some, repeats > 0.1),
        _vote(capitals < 0.1, capitals > 0.3),
        _vote(n >= 40, n < 5),
        _vote((sentences > 0.02) & (sentences < 0.3), (sentences < 0.002) & some),
        _vote((bars < 0.01) & some, bars > 0.1),
        _vote((variety > 0.5) & some, (variety < 0.25) & some),
        _vote(share > 0.93, share < 0.88),
        _vote(wordless < 0.02, wordless > 0.1),
    ], 1)


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each vote pattern, rates of bad votes, and the share of good.

    ``rates[c, j]`` is how many of labeller j's votes on texts of class c (bad,
    good) are bad: its accuracy for each class apart, as a labeller that knows
    one defect calls all other bad texts good. Votes are independent given
    the class, and no vote says nothing. Nothing bounds the rates: the start,
    which says which class is which, weighs START_VOTES votes, whatever the
    number of rows. Rounds end when the posteriors stay as they are.
    """
    start, floor = np.array(START), 1e-9
    rates, share, post = np.repeat(start[:, None], patterns.shape[1], 1), 0.8, np.zeros(len(counts))
    for _ in range(rounds):
        bad, good = (np.where(patterns == -1, np.log(r), np.where(patterns == 1, np.log1p(-r), 0)).sum(1) for r in rates)
        before, post = post, 1 / (1 + np.exp(np.clip(bad - good + np.log1p(-share) - np.log(share), -50, 50)))
        share = float(np.clip(((counts * post).sum() + 0.8) / (counts.sum() + 1), floor, 1 - floor))
        for c, weight in ((0, counts * (1 - post)), (1, counts * post)):
            said = [(weight[:, None] * (patterns == v)).sum(0) for v in (-1, 1)]
            rates[c] = np.clip((said[0] + start[c] * START_VOTES) / (said[0] + said[1] + START_VOTES), floor, 1 - floor)
        if len(post) and np.abs(post - before).max() < 1e-9:
            break
    return post, rates, share


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed rows of each document's words and word shapes, and their bounds."""
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    shape = _SHAPE[words.data]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[words.starts] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    size = len(words.bounds) - 1
    short = tokenize(shape[keep], at[words.offsets], slice(0, size))
    own = (words.hashes >> shift).astype(np.int64)
    shapes = ((short.hashes ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int64)
    repeat = np.where(_repeats(words), 1, 0)
    return np.stack([own, shapes, repeat], 1), words.bounds


@dataclass
class LinearScorer:
    """Logistic scorer of the mean weight of a text's words, shapes and repetitions."""

    weights: np.ndarray
    repeat: float = 0.0
    bias: float = 0.0

    def logits(self, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n = np.diff(bounds)
        doc = np.repeat(np.arange(len(n)), n)
        each = self.weights[rows[:, 0]] + self.weights[rows[:, 1]] + self.repeat * rows[:, 2]
        return np.bincount(doc, each, len(n)) / np.maximum(n, 1) + self.bias

    def fit(self, docs: list[np.ndarray], y: np.ndarray, epochs: int = 8, rate: float = 0.5) -> "LinearScorer":
        rng = np.random.default_rng(3)
        size, slow = np.full(BUCKETS, 1e-6), np.full(2, 1e-6)
        weight = np.where(y >= 0.5, 1 / max((y >= 0.5).mean(), 1e-3), 1 / max((y < 0.5).mean(), 1e-3)) / 2
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // 32)):
                rows = np.concatenate([docs[i] for i in batch])
                n = np.array([len(docs[i]) for i in batch])
                z = self.logits(rows, np.concatenate([[0], np.cumsum(n)]))
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) * weight[batch] / len(batch)
                each = np.repeat(g / np.maximum(n, 1), n)
                grad = np.bincount(rows[:, 0], each, BUCKETS) + np.bincount(rows[:, 1], each, BUCKETS)
                at = np.flatnonzero(grad)
                size[at] += grad[at] ** 2
                self.weights[at] -= rate * grad[at] / np.sqrt(size[at])
                both = np.array([(each * rows[:, 2]).sum(), g.sum()])
                slow += both**2
                self.repeat -= rate * both[0] / np.sqrt(slow[0])
                self.bias -= 0.1 * rate * both[1] / np.sqrt(slow[1])
        return self

    def score(self, texts: pa.Array) -> np.ndarray:
        out = [1 / (1 + np.exp(-np.clip(self.logits(*features(w)), -30, 30))) for w in token_batches(texts)]
        return np.concatenate(out) if out else np.zeros(0)


def weak_labels(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, votes, posterior) of every row, and the posterior of each vote pattern.

    EM sees the counts of all rows' patterns: at most 3 ** 9 rows reach the driver.
    """
    spark = docs.sparkSession
    schema = arrow_schema(spark.createDataFrame([], VOTES).schema)

    def run(batches):
        for b in batches:
            if b.num_rows:
                got = np.concatenate([votes(w) for w in token_batches(column(b, "text"))])
                ids = b.column(b.schema.get_field_index("doc_id"))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(got[:, k]) for k in range(len(LABELLERS)))], schema=schema)

    voted = materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, VOTES), "votes")
    counted = voted.groupBy(*LABELLERS).agg(F.count(F.lit(1)).alias("n")).orderBy(*LABELLERS).collect()
    patterns = np.array([[r[n] for n in LABELLERS] for r in counted], np.int64).reshape(-1, len(LABELLERS))
    post, _, _ = em(patterns, np.array([r.n for r in counted], float))
    rows = [(*map(int, p), float(q)) for p, q in zip(patterns, post)]
    table_of = spark.createDataFrame(rows, ", ".join(f"{n} byte" for n in LABELLERS) + ", posterior double")
    return voted.join(F.broadcast(table_of), list(LABELLERS)), table_of  # at most 3 ** 9 rows


def fit_scorer(docs: DataFrame, labelled: DataFrame, most: int = 3000) -> LinearScorer:
    """Train on at most ``most`` whole documents of each posterior label, the first by a hash of doc_id."""
    ids = labelled.groupBy("doc_id").agg(F.min("posterior").alias("posterior")).withColumn("h", F.xxhash64("doc_id", F.lit(2)))
    ids = materialise(ids, "posteriors")
    good = F.col("posterior") >= 0.5
    picked = first_by_hash(ids.filter(good), most).unionByName(first_by_hash(ids.filter(~good), most))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])  # at most 2 * most ids

    def run(batches):
        for b in batches:
            ids, posts = (b.column(b.schema.get_field_index(n)).to_pylist() for n in ("doc_id", "posterior"))
            found = []
            for w in token_batches(column(b, "text")):
                own, bounds = features(w)
                found += [
                    (ids[w.rows.start + d], posts[w.rows.start + d], own[bounds[d] : bounds[d + 1]].astype(np.int32).tobytes())
                    for d in range(len(bounds) - 1)
                ]
            if found:
                a, p, t = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(p, pa.float64()), pa.array(t, pa.binary())], names=["doc_id", "posterior", "words"])

    got = rows.select(F.col("doc_id").cast("long"), "posterior", "text").mapInArrow(run, "doc_id long, posterior double, words binary").collect()
    got.sort(key=lambda r: r.doc_id)
    scorer = LinearScorer(np.zeros(BUCKETS))
    if got:
        scorer.fit([np.frombuffer(r.words, np.int32).reshape(-1, 3).astype(np.int64) for r in got], np.array([r.posterior for r in got]))
    return scorer


def classify(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, score and kept for each row. Null and empty texts get the score of a text without words; repeated rows repeat."""
    spark = docs.sparkSession
    labelled, _ = weak_labels(docs)
    model = spark.sparkContext.broadcast(fit_scorer(docs, labelled))
    schema = arrow_schema(spark.createDataFrame([], RESULT).schema)

    def run(batches):
        for b in batches:
            if b.num_rows:
                score = model.value.score(column(b, "text"))
                ids = b.column(b.schema.get_field_index("doc_id"))
                yield pa.RecordBatch.from_arrays([ids, pa.array(score), pa.array(score >= threshold)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))
